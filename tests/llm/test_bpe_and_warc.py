"""BPE against the tokenizers library, and WARC archives by round trips."""

import gzip
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkscour.llm import trie_bpe, warc
from tests.llm.cases import awkward, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as file:
        return trie_bpe.Encoder(file.read())


def ids_of(encoder, text):
    return list(memoryview(b"".join(encoder.encode(text))).cast("I"))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'abestT\x1c\x85　é中🙂0١<|>-"), st.characters(codec="utf-8"))))
def test_any_text_is_encoded_as_by_the_library(text):
    with open(PATH, encoding="utf-8") as file:
        encoder = trie_bpe.encoder_for(file.read())
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids if len(text) < 3 else None
    got = ids_of(encoder, text)
    assert want is None or got == want
    assert encoder.decode(b"".join(encoder.encode(text))).decode() == text


def test_random_texts(encoder, library):
    rnd = random.Random(2)
    pieces = [" ", "  ", "\n", " \n ", "the", "Token", "ing", "'s", "123", "é", "中文", "🙂", "<|endoftext|>", "<|endo", "==", "\t", " ", "\x1c"]
    for _ in range(3000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randrange(12)))
        assert ids_of(encoder, text) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_texts_in_parts(encoder, library, monkeypatch):
    monkeypatch.setattr(trie_bpe, "LONG_TEXT", 500)
    monkeypatch.setattr(trie_bpe, "CHUNK_WORDS", 7)
    monkeypatch.setattr(trie_bpe, "CACHED_WORDS", 40)
    monkeypatch.setattr(trie_bpe, "CACHED_PIECES", 60)
    rnd = random.Random(3)
    for odd in ("", "  x \n \n"):
        text = " ".join("".join(rnd.choice("abcdeé\n") for _ in range(rnd.randrange(1, 9))) for _ in range(4000)) + odd
        assert ids_of(encoder, text) == library.encode(text, add_special_tokens=False).ids
    assert ids_of(encoder, "ab" * 20_000) == library.encode("ab" * 20_000, add_special_tokens=False).ids


def test_every_token_that_is_reached_encodes_to_itself(encoder, library):
    for i in range(0, 50_256, 97):
        text = encoder.vocabulary.bytes_of[i].decode("utf-8", "ignore")
        if text.encode() == encoder.vocabulary.bytes_of[i]:
            assert ids_of(encoder, text) == library.encode(text, add_special_tokens=False).ids


def test_a_step_for_each_byte_finds_the_tokens_that_end_there(encoder, library, monkeypatch):
    vocabulary, rnd = encoder.vocabulary, random.Random(5)
    known = {vocabulary.bytes_of[i] for i in vocabulary.shorter}
    for _ in range(300):
        raw = "".join(rnd.choice(["the", "ing", " ", "e", "é", "中", "🙂", "==", "Tok", "0"]) for _ in range(rnd.randrange(1, 9))).encode()
        node = 0
        for end in range(1, len(raw) + 1):
            node = vocabulary.step(node, raw[end - 1])
            token, found = vocabulary.ending[node], []
            while token >= 0:
                found.append(vocabulary.bytes_of[token])
                token = vocabulary.shorter[token]
            assert found == [raw[k:end] for k in range(end) if raw[k:end] in known]
    monkeypatch.setattr(trie_bpe, "CACHED_MOVES", 5)
    monkeypatch.setattr(trie_bpe, "CACHED_PAIRS", 5)
    texts = ["".join(rnd.choice("abcdeé中 ") for _ in range(60)) for _ in range(50)]
    for text in texts:
        assert ids_of(encoder, text) == library.encode(text, add_special_tokens=False).ids
    assert len(vocabulary.moves) <= 5


def test_awkward_documents(spark, library):
    got = trie_bpe.encode(frame(spark), PATH, with_ids=True).collect()
    want = []
    for row in awkward():
        text = row[1] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((row[0], len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), ids))
    key = lambda r: (str(r[0]), r[2])
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    back = trie_bpe.decode(trie_bpe.encode(frame(spark), PATH, with_ids=True), PATH).collect()
    assert sorted((str(r[0]), r[1]) for r in back) == sorted((str(r[0]), r[1] or "") for r in awkward())
    assert trie_bpe.encode(frame(spark, []), PATH).count() == 0


PAGES = "page_id long, url string, html string, row string, digest string, owner long"


def pages(spark):
    big, other = "<p>é</p>" * 300, "x" * 1000
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (2, "http://a/2", big), (3, None, other), (None, "u", other),
            (4, "b\r\nWARC-Type: revisit", "short"), (5, "c", "short"), (6, "d", None), (7, "e", ""), (None, "f", "y" * 2000),
            (None, "g", "y" * 2000), (8, "h", "\r\n\r\nWARC/1.1\r\n" * 200), (9, "i", "é" * 500), (10, "j", "é" * 500)]
    return rows, spark.createDataFrame([(*r, "r", "d", 1) for r in rows], PAGES)


def test_ids_of_few_texts_are_held_at_once(encoder, library):
    texts = [f"text {k} of many" * (k % 3) for k in range(700)]
    whole = pa.RecordBatch.from_arrays([pa.array(range(700), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    parts = list(trie_bpe._encoded(iter([whole.slice(0, 0), whole]), encoder, True))
    assert max(x.num_rows for x in parts) <= trie_bpe.ROWS_AT_ONCE < 700
    made = pa.Table.from_batches(parts)
    assert made["doc_id"].to_pylist() == list(range(700))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert made["ids"].to_pylist() == want and made["n_tokens"].to_pylist() == [len(x) for x in want]


def test_round_trip(spark, tmp_path):
    rows, df = pages(spark)
    got = warc.round_trip(df, str(tmp_path / "warc")).collect()
    assert all(r["whole"] and r["fault"] is None for r in got)
    want = []
    for page, _, html in rows:
        payload = (html or "").encode()
        equal = [p for p, _, h in rows if (h or "").encode() == payload and p is not None]
        top = max(equal) if equal and len(payload) >= 1000 and sum((h or "").encode() == payload for _, _, h in rows) > 1 else page
        again = top != page
        want.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", top if again else None))
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    urls = {r["page_id"]: r["target_uri"] for r in got}
    assert urls[4] == "b%0D%0AWARC-Type: revisit" and urls[1] == "http://a/1"
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "warc").glob("part-*")))
    assert raw.count(b"WARC/1.1\r\nWARC-Type: response") + raw.count(b"WARC/1.1\r\nWARC-Type: revisit") == len(rows)


def test_empty_table(spark, tmp_path):
    _, df = pages(spark)
    assert warc.round_trip(df.limit(0), str(tmp_path / "warc")).count() == 0


def record(page, payload, kind="response"):
    return warc.member(page, "u", payload, hashlib.sha1(payload).hexdigest(), len(payload), kind, 1, "2024-01-01T00:00:00Z")


def test_damaged_records_are_reported_and_reading_goes_on():
    good = [record(i, bytes([65 + i]) * 3000) for i in range(4)]
    broken = bytearray(good[1])
    broken[len(broken) // 2] ^= 255
    found = list(warc.read_records(good[0] + bytes(broken) + good[2] + good[3][:-9]))
    fine = [r for r in found if r["whole"]]
    assert [warc.page_of(r["record_id"]) for r in fine] == [0, 2] and len(found) > 2
    assert all(r["fault"] for r in found if not r["whole"])


def test_digest_and_length_are_verified():
    data = gzip.decompress(record(1, b"z" * 2000))
    swapped = gzip.compress(data.replace(b"zzzz\r\n\r\n", b"zzzy\r\n\r\n"))
    assert [r["fault"] for r in warc.read_records(swapped)] == ["digest differs"]
    longer = gzip.compress(data.replace(b"zz\r\n\r\n", b"zzzzz\r\n\r\n"))
    assert "content length" in next(iter(warc.read_records(longer)))["fault"]


def test_a_payload_above_16_mib(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "0123456789abcdef" * (1 << 20) + "!"), (2, "v", "w")], "page_id long, url string, html string")
    got = {r["page_id"]: r["payload_bytes"] for r in warc.round_trip(df, str(tmp_path / "big")).collect()}
    assert got == {1: (1 << 24) + 1, 2: 1}
