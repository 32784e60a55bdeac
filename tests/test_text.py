"""Text functions against plain Python."""

import random
import re

from pyspark.sql import functions as F

from sparkscour.functions import text as T

JS_SPACE = "[" + re.escape(T.SPACE_CHARS) + "]"


def py_clean(text):
    if not text:
        return text
    text = re.sub(JS_SPACE + "+", " ", text).strip(" ")
    for char, spelling in T.ASCII_SPELLING.items():
        text = text.replace(char, spelling)
    text = re.sub('"{2,}', '"', text)
    text = re.sub("'{2,}", "'", text)
    return re.sub(r"[^\x20-\x7E]", "", text)


def py_fields(line):
    """A comma separates fields if the quotes before it are even in number; then quoting is undone."""
    commas = [i for i, c in enumerate(line) if c == "," and line[:i].count('"') % 2 == 0]
    bounds = [-1, *commas, len(line)]
    raw = [line[a + 1 : b] for a, b in zip(bounds, bounds[1:])]
    return [
        "".join(part.replace('""', '"') if k % 2 else part for k, part in enumerate(re.split(r'"((?:[^"]|"")*)(?:"|$)', f)))
        for f in raw
    ]


def py_norm(text):
    text = re.sub(r"[^A-Za-z0-9_'\s-]", " ", (text or "").lower(), flags=re.ASCII)
    return re.sub(r"\s+", " ", text, flags=re.ASCII).strip()


def values(spark, texts, fn):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["v"] for r in df.select("i", fn("t").alias("v")).orderBy("i").collect()]


def random_texts(alphabet, n, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_every_mapped_character(spark):
    assert len(T.ASCII_SPELLING) == 48
    chars = list(T.ASCII_SPELLING)
    assert values(spark, [f"a{c}b" for c in chars], T.clean_text) == [
        f"a{T.ASCII_SPELLING[c]}b" for c in chars
    ]


def test_clean_text_matches_the_steps(spark):
    texts = random_texts(list("aB \t\n\r\x0b\x01\x7f'\"`é") + [" ", "﻿", "½", "«", "°"], 3000)
    got = values(spark, [*texts, None], T.clean_text)
    assert got == [*[py_clean(t) for t in texts], None]
    assert all(re.fullmatch(r"[\x20-\x7E]*", g) for g in got[:-1])


def test_order_of_steps_lets_blanks_reappear(spark):
    assert values(spark, ["20°", "a é b", " ° "], T.clean_text) == ["20 degrees", "a  b", " degrees"]


def test_normalize_key(spark):
    texts = random_texts(list("aB9_-' \t,.;") + ["é", " ", "\n"], 2000)
    assert values(spark, [*texts, None], T.normalize_key) == [py_norm(t) for t in [*texts, None]]


def test_comparison_key_leaves_out_empty_columns(spark):
    df = spark.createDataFrame([("A,b", None, "  "), ("!!", "x", "Y")], "a string, b string, c string")
    keys = [r[0] for r in df.select(T.comparison_key("a", "b", "c")).collect()]
    assert keys == ["a b", "x y"]


def test_csv_fields_match_the_character_loop(spark):
    lines = random_texts(list('ab,"" '), 5000)
    assert values(spark, lines, lambda c: T.csv_fields(F.col(c))) == [py_fields(x) for x in lines]


def test_csv_fields_of_a_long_line(spark):
    line = ",".join(['"' + 'x""y' * 5000 + '"'] * 20)
    assert values(spark, [line], lambda c: T.csv_fields(F.col(c))) == [py_fields(line)]


def test_csv_quote_and_unquote(spark):
    texts = ["plain", "a,b", 'say "x"', "two\nlines", None, '"', '"a""b"']
    quoted = ["plain", '"a,b"', '"say ""x"""', '"two\nlines"', "", '""""', '"""a""""b"""']
    assert values(spark, texts, T.csv_quote) == quoted
    assert values(spark, ['"a ""b"""', "x", '"', '"open'], T.unquote) == ['a "b"', "x", "", '"open']


def test_token_estimate(spark):
    assert values(spark, ["", "abcd", "abcde"], T.token_estimate) == [0, 1, 2]
