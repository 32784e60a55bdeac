"""Awkward documents that every operator must bear, with columns whose names could clash."""

from __future__ import annotations

import re

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, row string, _text string, "
    "spans string, key long, node long, `a.b` string, _row string, n long"
)
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def document(doc_id, text, lang="en", source="s0"):
    return (doc_id, text, lang, source, None if text is None else len(text), "r", "t", "x", 1, 2, "d", "w", 3)


def awkward():
    long_text = " ".join(f"word{i % 977}" for i in range(30_000))
    same = "one and the same text of more than five words"
    return [
        document(1, None),
        document(2, ""),
        document(3, " \n\t\r\n "),
        document(4, long_text),
        document(5, same),
        document(5, same),
        document(6, same, None, None),
        document(None, same),
        document(None, None, None, None),
        document(7, "a b"),
        document(8, "é ß 中文 🙂 <|endoftext|> token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\""),
        document(9, "x" * 5000),
    ]


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def words(text):
    return WORDS.findall(text or "")
