"""Aligned tokenizers against whole texts encoded by the libraries and plain counts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as vocabularies
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cases import awkward, document, frame
from sparkscour.llm import token_alignment
from sparkscour.llm.token_alignment import Aligner, Spill, align, merged, packed, unpacked
from sparkscour.llm.trie_bpe import byte_characters

A, B = vocabularies.path("byte_bpe_50k.json"), vocabularies.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), byte_characters()


def groups_of(text, libraries):
    """Groups as lists of ids, by walking along the bytes."""
    a, b, to_byte = libraries
    if not text:
        return []
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    a_raw = [bytes(to_byte[c] for c in a.id_to_token(i)) for i in a_ids]
    b_raw = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode() for i in b_ids]
    whole = (" " + text).encode()
    if b"".join(a_raw) != whole or b"".join(b_raw) != whole:
        return []
    a_ends = dict(zip(np.cumsum([len(x) for x in a_raw]).tolist(), range(len(a_raw))))
    b_ends = dict(zip(np.cumsum([len(x) for x in b_raw]).tolist(), range(len(b_raw))))
    out, i, j = [], 0, 0
    for end in sorted(a_ends.keys() & b_ends.keys()):
        out.append((a_ids[i : a_ends[end] + 1], b_ids[j : b_ends[end] + 1]))
        i, j = a_ends[end] + 1, b_ends[end] + 1
    return out


def plain(rows, libraries):
    docs = [(r[0], groups_of(r[1], libraries)) for r in rows]
    count = Counter((x[-1], y[-1]) for _, groups in docs for x, y in groups)
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    out = []
    for doc_id, groups in docs:
        links = [(x[-1], y[-1]) for x, y in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append(
            (doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
             sum(count[k] == top[k[1]] for k in links), sum(count[k] for k in links),
             hashlib.sha256(text.encode()).hexdigest() if groups else "")
        )
    return sorted(out, key=str)


def found(spark, rows, **options):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(map(tuple, align(frame(spark, rows), A, B, **options).select(columns).collect()), key=str)


def odd_texts():
    rng = random.Random(1)
    white = [" ", " ", " ", "  ", "\n", "\t", " \n ", "\u00a0", "\x1f", "\u3000", "\r\n"]
    words = ["the", "don't", "caf\u00e9", "1234", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "\u2581", "\ufb01x", "\u4e2d\u6587",
             "\U0001f642", "word-by-word", "...", "\u0301", "x" * 40, "I'll", "\x00", "A\u030a"]
    rows = [document(1000 + k, "".join(rng.choice(words) + rng.choice(white) for _ in range(rng.randrange(1, 30)))) for k in range(150)]
    rows += [document(2000 + k, " ".join(rng.choices(words[:2] + words[3:9] + words[11:], k=20))) for k in range(50)]
    edges = [" ", "  ", "a ", " a", "a\n ", "\n a", "a \n b", "x\n \ny", "\u2581", " \u2581a", "a\n", "\n"]
    return rows + [document(3000 + k, t) for k, t in enumerate(edges)]


def test_equals_plain_counts(spark, libraries):
    rows = awkward() + odd_texts()
    want = plain(rows, libraries)
    got = found(spark, rows)
    assert [g for g in got if g not in want] == [] and got == want
    assert sum(r[3] > 0 for r in got) > 100


def test_many_small_runs_and_merge_rounds(spark, libraries, monkeypatch):
    rows = awkward() + odd_texts() + [document(9, "the same words again and again")] * 100
    want = plain(rows, libraries)
    assert found(spark, rows, radix=3, fan_in=2) == want
    assert found(spark, rows, radix=1, fan_in=1000) == want


def test_runs_are_cut_by_links_and_documents(libraries, monkeypatch):
    monkeypatch.setattr(token_alignment, "RUN_LINKS", 50)
    monkeypatch.setattr(token_alignment, "RUN_DOCUMENTS", 7)
    with open(A) as a, open(B, "rb") as b:
        aligner = Aligner(a.read(), b.read())
    spill, batches, texts = Spill(4, 5), [], [r[1] or "" for r in odd_texts()]
    for k, one in enumerate(aligner.texts(texts)):
        if spill.add(k, *one):
            batches.append(spill.flush())
    batches.append(spill.flush())
    assert len(batches) > 20 and spill.flush() is None
    rows = [r for b in batches for r in b.to_pylist()]
    assert [r["doc_id"] for r in rows if r["radix"] is None] == list(range(len(texts)))
    heads = [r["heads"] for r in rows if r["radix"] is not None]
    pairs, n = merged(heads)
    count = Counter(y[-1] << 16 | x[-1] for t in texts for x, y in groups_of(t, libraries))
    assert dict(zip(pairs.tolist(), n.tolist())) == count and (np.diff(pairs) > 0).all()


def test_cache_that_forgets_changes_nothing(libraries, monkeypatch):
    monkeypatch.setattr(token_alignment, "CACHE_BYTES", 1000)
    monkeypatch.setattr(token_alignment, "CHUNK_CHARACTERS", 40)
    with open(A) as a, open(B, "rb") as b:
        aligner = Aligner(a.read(), b.read())
    texts = [r[1] for r in odd_texts()]
    assert [len(one[2]) // 4 for one in aligner.texts(texts)] == [len(groups_of(t, libraries)) for t in texts]


def test_packing():
    x, y = np.array([0, 5, (1 << 32) - 1]), np.array([7, 0, 1])
    assert [c.tolist() for c in unpacked(packed(x, y), 2)] == [x.tolist(), y.tolist()]
    assert [c.tolist() for c in unpacked(packed(x[:0], y[:0]), 2)] == [[], []]


def test_empty_table(spark):
    assert found(spark, []) == []
    assert found(spark, [document(1, None), document(None, "")]) == [(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")]
