"""License labels against plain loops over all words."""

import random
import re
from collections import Counter

import duckdb
import pyarrow as pa

from cases import awkward, document, frame
from sparkscour.llm import license_index
from sparkscour.llm.license_index import BASE, BASE_SCORE, BETWEEN, LOOKED_UP, AGREEING, TEMPLATES, scan, vocabulary

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(text):
    return [w for w in re.split(BETWEEN, (text or "").translate(UPPER)) if w]


def places(words, phrase):
    phrase = phrase.split()
    return [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]


def plain(rows):
    texts = [words_of(r[1]) for r in rows]
    known = vocabulary(TEMPLATES)
    df = {w: sum(w in set(t) for t in texts) for w in known}
    out = []
    for row, words in zip(rows, texts):
        starts = [(i, label) for phrase, label in BASE for i in places(words, phrase)]
        found = {}
        for t in TEMPLATES:
            if not all(places(words, p) for p in t.phrases):
                continue
            rare = sorted(set(t.words) & set(words), key=lambda w: (df[w], w))[:LOOKED_UP]
            votes = Counter(i - j for i, w in enumerate(words) if w in rare for j, x in enumerate(t.words) if x == w)
            for start, n in votes.items():
                if n >= AGREEING:
                    same = sum(0 <= start + j < len(words) and words[start + j] == w for j, w in enumerate(t.words))
                    found[t.label] = max(found.get(t.label, 0.0), same / len(t.words))
        base = {label for _, label in starts}
        where = [i for i, _ in starts]
        score = max([0.0, *found.values(), *([BASE_SCORE] if base else [])])
        out.append(
            (row[0], len(words), len(starts), min(where, default=None), max(where, default=None),
             ",".join(sorted(base)), ",".join(sorted(base | set(found))), score)
        )
    return sorted(out, key=str)


def found(spark, rows):
    return sorted(map(tuple, scan(frame(spark, rows)).collect()), key=str)


def licensed():
    rng = random.Random(4)
    prose = [f"w{i}" for i in range(300)] + ["the", "of", "in", "software", "license", "mit", "is", "copy"]
    rows = []
    for k, t in enumerate(TEMPLATES * 2):
        before, after = rng.choices(prose, k=rng.randrange(40)), rng.choices(prose, k=rng.randrange(40))
        text = t.text
        if k >= len(TEMPLATES):  # a name put in
            parts = text.split(" ")
            parts.insert(len(parts) - 2, "ACME")
            text = "\n * ".join(parts)
        rows.append(document(100 + k, " ".join(before) + " // " + text.upper() + " -- " + " ".join(after)))
    rows += [document(200 + k, " ".join(rng.choices(prose, k=120))) for k in range(30)]
    both = TEMPLATES[0].text + " or " + TEMPLATES[9].text
    rows += [
        document(300, both),
        document(301, "MIT-License mit license MIT/LICENSE, the apache  license: General\tPublic\nLicense"),
        document(302, "general public general public license license mit"),
        document(303, "m\u0130t license; \u212amit license; mit \u00e9license"),
        document(304, (TEMPLATES[0].text + " ") * 40),
        document(305, "mit license " * 2000),
        document(306, "redistribution and use in source and binary forms are permitted provided that the following conditions"),
    ]
    return rows


def test_equals_plain_loops(spark):
    rows = awkward() + licensed()
    got = found(spark, rows)
    assert got == plain(rows)
    labels = {r[0]: r[6] for r in got}
    for k, t in enumerate(TEMPLATES * 2):
        if k >= len(TEMPLATES) and (len(t.words) < 30 or t.label == "cc0"):
            continue  # the name stands in a mandatory phrase
        assert t.label in labels[100 + k].split(","), (k, t.label)
    assert labels[300] == "bsd,mit"
    assert all(labels[200 + k] in ("", "mit") for k in range(30))
    assert labels[304] == "mit"


def test_sql_gives_the_same(spark):
    rows = awkward() + licensed()
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": pa.array([r[1] for r in rows], pa.string())}))
    assert sorted(con.execute(license_index.scan_sql()).fetchall(), key=str) == found(spark, rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_plan_has_no_python_and_no_join(spark):
    plan = scan(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Join|Exchange", plan)
