"""Quality rules: counts per text, and its divergence from the languages it may be written in.

A text in a natural language uses kinds of characters and common words about as other texts in that
language do. Both are counted as histograms and compared with the pooled histograms of each language
by the Jensen-Shannon distance. Everything is a column expression; the only data that reaches the
driver are the pooled counts, a row per language.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkscour.llm.common import SPACES, let, let_all, name, text_of, words_of
from sparkscour.session import durable

# Frequent function words of some languages; those of other labels are counted from their texts.
COMMON_WORDS: dict[str, str] = {
    "en": "the of and to a in is that was for it with as on be at by are this from or an",
    "de": "der die und das ist ein eine zu den mit von im auf für nicht sich des dem als auch",
    "fr": "de la le et les des un une est que en dans pour qui par sur pas au du ne",
    "es": "de la el que y los en un una es las por con para del se no su al lo",
}
# Classes of characters in the order in which they are taken out; what is left is the last class.
CHARACTER_CLASSES = [
    ("lower", "[a-z]+"),
    ("space", SPACES),
    ("other letters", r"[\p{L}\p{M}&&[^A-Za-z]]+"),
    ("upper", "[A-Z]+"),
    ("sentence marks", "[.,;:!?'\"()-]+"),
    ("digits", "[0-9]+"),
]
# Words that are counted for a language that has no list.
COUNTED_WORDS = 22
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
# Texts with fewer words than this are not compared with languages.
COMPARED_WORDS = 50
MOST_CHARACTER_DISTANCE = 0.25
MOST_WORD_DISTANCE = 0.45


def common_words() -> list[str]:
    return sorted({w for line in COMMON_WORDS.values() for w in line.split()})


def all_words(docs: DataFrame) -> list[str]:
    """The listed common words, and the most frequent words of each label that has no list.

    They are counted in the texts that references are learned from; words that are as frequent go by name.
    """
    if "lang" not in docs.columns:
        return common_words()
    lang = name("lang").cast("string")
    other = docs.select(lang.alias("lang"), words_of(text_of(docs)).alias("words"))
    other = other.filter(F.col("lang").isNotNull() & ~F.col("lang").isin(*COMMON_WORDS) & (F.size("words") >= COMPARED_WORDS))
    usable = other.withColumn("n_words", F.size("words")).withColumn("n_repeat_words", repeated_words(F.col("words")))
    counted = usable.filter(~failed()).select("lang", F.explode("words").alias("word")).groupBy("lang", "word").count()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    found = counted.withColumn("place", place).filter(F.col("place") <= COUNTED_WORDS).select("word").distinct()
    return sorted({*common_words(), *(r["word"] for r in found.collect())})


def length_without(text: Column, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(text, pattern, ""))


def repeated_words(words: Column) -> Column:
    """Words in windows of ``WINDOW`` words that occur twice or more (compared by 64-bit hashes)."""

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - F.lit(WINDOW))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    def twice(grams: Column) -> Column:
        placed = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = F.filter(
                s,
                lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)),
            )
            return F.sort_array(F.transform(same, lambda x: x["i"]))

        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        covered = F.aggregate(
            let(placed, places),
            start,
            lambda acc, p: F.struct(
                (acc["n"] + p + F.lit(WINDOW) - F.greatest(acc["end"], p)).alias("n"),
                (p + F.lit(WINDOW)).alias("end"),
            ),
            lambda acc: acc["n"],
        )
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(covered)

    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(let(words, windows), twice))


def word_histogram(words: Column, listed: Sequence[str]) -> Column:
    """How often each listed word occurs, in order, and how many other words there are."""
    chosen = F.filter(words, lambda w: w.isin(*listed))
    joined = F.concat(F.lit(" "), F.array_join(chosen, "  "), F.lit(" "))

    def counts(s: Column) -> Column:
        size = F.char_length(s)
        each = [
            F.floor((size - F.char_length(F.replace(s, F.lit(f" {w} "), F.lit("")))) / F.lit(len(w) + 2)).cast("long")
            for w in listed
        ]
        return F.array(*each)

    found = let(joined, counts)
    total = F.size(words).cast("long")
    return let(found, lambda c: F.array_append(c, total - F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)))


def character_histogram(text: Column) -> Column:
    """Code points by class. Each pass reads only what earlier passes have left."""

    def from_(k: int, rest: Column, size: Column, counts: list[Column]) -> Column:
        if k == len(CHARACTER_CLASSES):
            return F.array(*counts, size)
        shorter = F.regexp_replace(rest, CHARACTER_CLASSES[k][1], "")
        return let_all(
            {"rest": shorter, "size": F.char_length(shorter).cast("long")},
            lambda v: from_(k + 1, v["rest"], v["size"], [*counts, size - v["size"]]),
        )

    return from_(0, text, F.char_length(text).cast("long"), [])


def measured(docs: DataFrame, listed: Sequence[str] | None = None) -> DataFrame:
    """``doc_id``, ``lang`` (null without such a column) and the counts and histograms of each text."""
    text = text_of(docs)
    label = name("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = let_all(
        {"words": words_of(text), "lines": lines},
        lambda v: F.struct(
            F.size(v["words"]).cast("long").alias("n_words"),
            F.char_length(F.array_join(v["words"], "")).cast("long").alias("word_chars"),
            (F.size(v["lines"]) - F.size(F.array_distinct(v["lines"]))).cast("long").alias("n_dup_lines"),
            repeated_words(v["words"]).cast("long").alias("n_repeat_words"),
            word_histogram(v["words"], common_words() if listed is None else listed).alias("words"),
        ),
    )
    symbols = F.char_length(text) - length_without(text, r"[#*$%&|<>]+")
    return docs.select(
        name("doc_id").cast("long").alias("doc_id"),
        label.alias("lang"),
        counted.alias("c"),
        symbols.cast("long").alias("n_symbols"),
        character_histogram(text).alias("characters"),
    ).select(
        "doc_id", "lang", "n_symbols", "characters",
        *[F.col("c").getField(k).alias(k) for k in ("n_words", "word_chars", "n_dup_lines", "n_repeat_words", "words")],
    )


def failed() -> Column:
    """The base rules on the counts: too few words, or too many in repeated windows."""
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    )


def references(counted: DataFrame, listed: Sequence[str] | None = None) -> dict[str, tuple[list[float], list[float]]]:
    """Pooled character and word shares of each language, from its texts that pass the base rules.

    Sums before the shuffle, then one row per label.
    """
    usable = counted.filter(F.col("lang").isNotNull() & ~failed() & (F.col("n_words") >= COMPARED_WORDS))
    n_chars, n_words = len(CHARACTER_CLASSES) + 1, len(common_words() if listed is None else listed) + 1
    sums = [F.sum(F.get("characters", F.lit(k))).alias(f"c{k}") for k in range(n_chars)]
    sums += [F.sum(F.get("words", F.lit(k))).alias(f"w{k}") for k in range(n_words)]
    found = {}
    for row in usable.groupBy("lang").agg(*sums).collect():
        chars, words = ([row[f"{p}{k}"] for k in range(n)] for p, n in (("c", n_chars), ("w", n_words)))
        found[row["lang"]] = [x / sum(chars) for x in chars], [x / sum(words) for x in words]
    return found


def distance(counts: Column, shares: Sequence[float]) -> Column:
    """Jensen-Shannon distance (the root of the divergence in bits, 0 to 1) of counts to shares."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)

    def part(x: Column, middle: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / middle)).otherwise(F.lit(0.0))

    def of(n: Column) -> Column:
        terms = F.zip_with(
            counts,
            F.array(*[F.lit(float(s)) for s in shares]),
            lambda c, q: let(c / n, lambda p: part(p, (p + q) / 2) + part(q, (p + q) / 2)),
        )
        return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))

    return F.when(total > 0, let(total, of)).otherwise(F.lit(1.0))


def judge(docs: DataFrame) -> DataFrame:
    """Counts and verdict per document.

    ``doc_id``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``base_failed``, ``kept``, and of the nearest language ``language``, ``character_distance`` and
    ``word_distance``. The nearest language is the one with the smallest sum of both distances, by name
    if equal. A text that passes the base rules and has at least ``COMPARED_WORDS`` words is dropped if a
    distance to it is above its bound; shorter texts, and all texts where no language could be learned,
    are kept by the base rules alone, with null for the three columns.

    A null text has no words, so it fails; repeated rows count once each in the references and get equal
    verdicts; an empty table gives an empty one. The label serves the references only.
    """
    listed = all_words(docs)
    counted = durable(measured(docs, listed))
    known = references(counted, listed)
    compared = (F.col("n_words") >= COMPARED_WORDS) & F.lit(bool(known))
    nothing = F.lit(None).cast("struct<total:double,language:string,chars:double,words:double>")
    nearest = nothing
    if known:
        def against(lang: str, chars: list[float], words: list[float]) -> Column:
            return let_all(
                {"chars": distance(F.col("characters"), chars), "words": distance(F.col("words"), words)},
                lambda v: F.struct(
                    (v["chars"] + v["words"]).alias("total"), F.lit(lang).alias("language"), v["chars"], v["words"]
                ),
            )

        each = [against(lang, *shares) for lang, shares in sorted(known.items())]
        nearest = F.when(compared, F.array_min(F.array(*each))).otherwise(nothing)
    judged = counted.withColumn("nearest", nearest)
    far = (F.col("nearest.chars") > MOST_CHARACTER_DISTANCE) | (F.col("nearest.words") > MOST_WORD_DISTANCE)
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed().alias("base_failed"),
        (~failed() & ~F.coalesce(far, F.lit(False))).alias("kept"),
        F.col("nearest.language").alias("language"),
        F.col("nearest.chars").alias("character_distance"),
        F.col("nearest.words").alias("word_distance"),
    )
