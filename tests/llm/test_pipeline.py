"""The pipeline's stages, each on its predecessor's rows, against plain Python."""

import hashlib
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.cases import frame, words
from tests.llm.test_likeness import plain_groups
from tests.llm.test_mixing_and_lines import plain_lines, plain_targets

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The documents before the first stage and after each."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / "rows")
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        found.append(docs)
    return found


def test_columns(steps):
    assert all(df.columns == steps[0].columns for df in steps[:-1])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "near copies", "mixture", "BPE"]


def test_language_keeps_texts_with_letters(steps):
    want = {r["doc_id"] for r in steps[0].collect() if any(c.isalpha() for c in r["text"] or "")}
    assert {r["doc_id"] for r in steps[1].collect()} == want


def test_lines(steps):
    rows = [tuple(r) for r in steps[1].collect()]
    want = {d: digest for d, _, _, digest in plain_lines(rows, 10)}
    gone = {d for d, _, removed, _ in plain_lines(rows, 10) if removed}
    got = {r["doc_id"]: r for r in steps[2].collect()}
    for d, r in got.items():
        assert hashlib.sha256(r["text"].encode()).hexdigest() == want[d] and r["n_chars"] == len(r["text"])
    assert {r[0] for r in rows} - set(got) <= gone


def test_near_copies(steps):
    rows = [tuple(r) for r in steps[2].collect()]
    want = {c for _, n, c in plain_groups(rows) if n} | {d for d, n, _ in plain_groups(rows) if not n}
    assert sorted(r["doc_id"] for r in steps[3].collect()) == sorted(want)


def test_mixture(steps):
    sizes, taken, most = Counter(), Counter(), Counter()
    for r in steps[3].collect():
        n = len(words(r["text"]))
        sizes[r["source"]] += n
        most[r["source"]] = max(most[r["source"]], n)
    rows = steps[4].collect()
    for r in rows:
        taken[r["source"]] += len(words(r["text"]))
    assert max(Counter(r["doc_id"] for r in rows).values()) <= 3
    assert all(abs(taken[s] - t) <= most[s] for s, t in plain_targets(sizes).items())


def test_tokens(steps):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in steps[4].collect()}
    rows = steps[5].collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in steps[4].collect())
    for r in rows:
        assert r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


@pytest.mark.parametrize("place", range(5))
def test_awkward_documents(spark, place):
    df = frame(spark)
    out = corpus_pipeline.STAGES[place][1](spark, df, FOLDER)
    assert place == 4 or out.columns == df.columns
    assert out.count() > 0
    assert corpus_pipeline.STAGES[place][1](spark, df.limit(0), FOLDER).count() == 0
