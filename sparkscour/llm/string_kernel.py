"""Language identification with string kernels.

The blended-spectrum presence kernel of two texts counts the n-grams of characters, of all lengths
up to ``MAX_N``, that occur in both, relative to the numbers of n-grams in each. Nyström landmarks
turn it into features of a fixed size, and one ridge regression per language (this language against
the rest) is fitted on them. A score is linear in the kernel values against the landmarks, and these
are linear in the presence of n-grams, so landmarks and regressions fold into one matrix of n-grams
by languages, and a batch of documents is scored by the product of its presence matrix with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkscour.llm.common import name, packed, text_of, unpacked
from sparkscour.session import durable, join_hot

UNKNOWN = "und"
MAX_N = 4
# n-grams are hashed to this many places.
PLACES = 1 << 15
# Bounds of the labelled sample that the model is fitted on, and of its landmarks.
SAMPLE_PER_LANGUAGE = 400
SAMPLE_ROWS = 4000
LANDMARKS = 256
RIDGE = 1e-2
# Steepness that turns the lead of the best language into a score.
STEEPNESS = 6.0
SCORED_AT_ONCE = 256
# Labels whose counts are sent to every task.
MOST_SENT = 10_000
PART_CHARS = 1 << 20


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def presence(text: str) -> np.ndarray | None:
    """Places of the n-grams in a text, in order; None without a letter.

    Letters are lower-cased; runs of other characters count as one space. A long text is read in
    parts that overlap by what an n-gram needs.
    """
    flags = np.zeros(PLACES, bool)
    found = False
    for start in range(0, max(len(text), 1), PART_CHARS):
        part = text[max(0, start - MAX_N) : start + PART_CHARS].lower()
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = letter_table()[codes]
        if not letters.any():
            continue
        found = True
        codes = np.where(letters, codes, np.uint32(32))
        kept = np.ones(len(codes), bool)
        kept[1:] = letters[1:] | letters[:-1]
        codes = np.concatenate([[32], codes[kept], [32]]).astype(np.uint32)
        gram = np.zeros(len(codes), np.uint32)
        for n in range(1, MAX_N + 1):
            gram = (gram[: len(codes) - n + 1] * np.uint32(0x01000193) ^ codes[n - 1 :]) * np.uint32(0x9E3779B1)
            mixed = (gram ^ gram >> np.uint32(15)) * np.uint32(0x85EBCA6B)
            flags[mixed >> np.uint32(17)] = True
            if len(codes) <= n:
                break
    return np.flatnonzero(flags) if found else None


@dataclass(frozen=True)
class Model:
    """Languages in order, and the weight of each place for each of them."""

    languages: tuple[str, ...]
    weights: np.ndarray

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Documents by languages: presence matrix times weights, over the norms of the documents."""
        sizes = np.array([len(r) for r in rows])
        matrix = np.zeros((len(rows), PLACES), np.float32)
        matrix[np.repeat(np.arange(len(rows)), sizes), np.concatenate(rows)] = 1
        return (matrix @ self.weights) / np.sqrt(sizes)[:, None]

    def decide(self, rows: list[np.ndarray]) -> tuple[list[str], list[float]]:
        scores = self.scores(rows).astype(np.float64)
        odds = np.exp(STEEPNESS * (scores - scores.max(axis=1, keepdims=True)))
        best = scores.argmax(axis=1)
        share = odds[np.arange(len(rows)), best] / odds.sum(axis=1)
        return [self.languages[k] for k in best], share.tolist()


def learn(rows: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fit the model on (language, places) rows. Landmarks are dealt over the languages in turn."""
    languages = tuple(sorted({lang for lang, _ in rows}))
    if not languages:
        return Model((), np.zeros((PLACES, 0), np.float32))
    queues = {lang: [k for k, (x, _) in enumerate(rows) if x == lang] for lang in languages}
    chosen: list[int] = []
    while len(chosen) < min(landmarks, len(rows)):
        for queue in queues.values():
            if queue and len(chosen) < landmarks:
                chosen.append(queue.pop(0))

    def dense(keys: list[int]) -> np.ndarray:
        out = np.zeros((len(keys), PLACES), np.float32)
        for i, k in enumerate(keys):
            out[i, rows[k][1]] = 1 / np.sqrt(max(len(rows[k][1]), 1))
        return out

    marks = dense(chosen)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    strong = values > 1e-6 * values[-1]
    inverse_root = vectors[:, strong] / np.sqrt(values[strong])
    features = np.concatenate(
        [dense(list(range(low, min(low + 500, len(rows))))) @ marks.T for low in range(0, len(rows), 500)]
    ).astype(np.float64) @ inverse_root
    targets = np.full((len(rows), len(languages)), -1.0)
    for i, (lang, _) in enumerate(rows):
        targets[i, languages.index(lang)] = 1.0
    # Languages weigh the same, however many rows they have.
    weight = 1 / np.maximum((targets > 0).sum(axis=0), 1)
    row_weight = (targets > 0) @ weight
    scaled = features * row_weight[:, None]
    solved = np.linalg.solve(
        features.T @ scaled + ridge * len(languages) / len(rows) * np.eye(features.shape[1]), scaled.T @ targets
    )
    return Model(languages, (marks.T @ (inverse_root @ solved)).astype(np.float32))


def fit(
    docs: DataFrame,
    usable: Column | None = None,
    lang: str = "lang",
    per_language: int = SAMPLE_PER_LANGUAGE,
    sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """Fit on at most ``per_language`` labelled documents of a language and ``sample_rows`` in all.

    The sample are the rows with the smallest hash of their id, chosen from ids and labels alone;
    only their n-gram places (a bit each) go to the driver. ``usable`` tells which rows may be learned
    from. Rows without label, id, text or letter are not learned from.
    """
    doc, label = name("doc_id").cast("long"), name(lang).cast("string")
    known = label.isNotNull() & doc.isNotNull() & name("text").isNotNull()
    known = known if usable is None else known & F.coalesce(usable, F.lit(False))
    labelled = docs.filter(known).select(doc.alias("doc_id"), label.alias("lang"))
    order = F.xxhash64(F.lit(11), "doc_id")
    # Only rows whose hash is small enough for their language's number of rows are ranked, about twice as
    # many as are wanted and at least all of a small language.
    rows = durable(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")))
    share = F.lit(2.0 * per_language + 100) / F.col("rows")
    low = order.cast("double") / F.lit(2.0**64) + 0.5 <= share
    # Rows are never dealt out by language before the others are gone: a language may hold most of them.
    if rows.count() <= MOST_SENT:
        counted = labelled.join(F.broadcast(rows), "lang")
    else:
        counted = join_hot(labelled, rows, "lang", spread_by=F.col("doc_id"))
    some = counted.filter(low)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id"))
    ranked = some.withColumn("place", place).filter(F.col("place") <= per_language)
    # Bounded by sample_rows.
    picked = ranked.orderBy("place", "lang").limit(sample_rows).select("doc_id").distinct()
    texts = docs.filter(known).select(doc.alias("doc_id"), label.alias("lang"), text_of(docs).alias("text"))
    texts = texts.join(F.broadcast(picked), "doc_id", "left_semi")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(2):
                at = presence(text.as_py())
                if at is None:
                    out.append(None)
                else:
                    flags = np.zeros(PLACES, bool)
                    flags[at] = True
                    out.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "lang", "bits"]
            )

    found = texts.mapInArrow(bits, "doc_id long, lang string, bits binary").filter(F.col("bits").isNotNull())
    # Repeated ids could bring more rows than were picked.
    rows = found.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id", "lang", "bits").limit(sample_rows).collect()
    return learn(
        [(r["lang"], np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8)))) for r in rows]
    )


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``row`` (the whole row), ``lang_pred`` and ``score`` (0 to 1) of every document.

    Only the text is looked at. A text that is null, or has no letter, gives ``und`` and 0; so does
    any text if nothing was learned. Of languages with equal scores the first by name is taken.
    Repeated rows get equal results, and an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights))
    kinds = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def decided(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fitted = Model(*shared.value)
        for batch in batches:
            langs, scores = [UNKNOWN] * len(batch), [0.0] * len(batch)
            where: list[int] = []
            rows: list[np.ndarray] = []

            def settle() -> None:
                if rows:
                    for k, lang, score in zip(where, *fitted.decide(rows)):
                        langs[k], scores[k] = lang, score
                    where.clear()
                    rows.clear()

            for k, one in enumerate(batch):
                at = presence(one.as_py()) if fitted.languages and one.is_valid else None
                if at is not None:
                    where.append(k)
                    rows.append(at)
                if len(rows) == SCORED_AT_ONCE:
                    settle()
            settle()
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], fields=list(kinds))

    # Only texts go to Python, once; the rows wait on Spark's side. Taken for nondeterministic, so that a
    # filter on the result doesn't score the texts a second time.
    found = docs.select(packed(docs).alias("row"), decided.asNondeterministic()(name(text).cast("string")).alias("__found"))
    return found.select("row", F.col("__found.lang_pred").alias("lang_pred"), F.col("__found.score").alias("score"))


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from; a null id is not held out (and not learned from)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("long").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def keep_languages(
    docs: DataFrame, model: Model, languages: list[str] | None = None, least_score: float = 0.0
) -> DataFrame:
    """The documents in a known language (or one of ``languages``) with at least ``least_score``."""
    found = predict(docs, model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score))
    if languages is not None:
        found = found.filter(F.col("lang_pred").isin(*languages))
    return unpacked(found, "row", docs.columns)
