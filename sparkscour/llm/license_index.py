"""License scans through a positional index of rare words.

The index lists the places of every word in the license templates, rare words first, by the number of
documents of the corpus that hold them. A text looks up only its rarest license words. Each place of such
a word votes for the place where the template would begin; where several words agree, the template stands
there, if its mandatory phrases are in the text too. Column functions only.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscour.llm.common import let, name, text_of

# Characters between words, fixed by the contract: all of ASCII but digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rarest words of a template that a text looks up, and how many of their places must agree.
LOOKED_UP = 8
AGREEING = 3
# The score of a text in which only a base phrase stands.
BASE_SCORE = 0.5

# Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class Template:
    """A passage of a license, with phrases that must stand in a text that carries it."""

    label: str
    text: str
    phrases: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return [w for w in re.split(BETWEEN, self.text.lower()) if w]


# Passages of public licenses and short notices of them.
TEMPLATES = (
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template("mit", "Licensed under the MIT License", ("mit license",)),
    Template(
        "apache",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at",
        ("apache license", "except in compliance with the license"),
    ),
    Template("apache", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version",
        ("terms of the gnu general public license",),
    ),
    Template(
        "gpl",
        "This work is licensed under the GNU General Public License, version",
        ("under the gnu general public license",),
    ),
    Template(
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "Lesser General Public License as published by the Free Software Foundation",
        ("gnu lesser general public license",),
    ),
    Template(
        "agpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "Affero General Public License as published by the Free Software Foundation",
        ("gnu affero general public license",),
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met: Redistributions of source code must retain the above "
        "copyright notice, this list of conditions and the following disclaimer",
        ("redistribution and use in source and binary forms", "are permitted provided that the following conditions"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
        "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        ("for any purpose with or without fee is hereby granted",),
    ),
    Template(
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
        "MPL was not distributed with this file, You can obtain one at",
        ("mozilla public license",),
    ),
    Template(
        "epl",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License",
        ("eclipse public license",),
    ),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software",
        ("free and unencumbered software released into the public domain",),
    ),
    Template(
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the "
        "authors be held liable for any damages arising from the use of this software. Permission is granted to "
        "anyone to use this software for any purpose",
        ("in no event will the authors be held liable", "permission is granted to anyone to use this software"),
    ),
    Template("boost", "Distributed under the Boost Software License, Version 1.0", ("boost software license",)),
    Template("cc-by", "Licensed under CC BY 4.0", ("under cc by 4 0",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("under cc by nc 4 0",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", ("under cc by sa 4 0",)),
    Template(
        "cc-by",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        ("creative commons attribution 4 0 international license",),
    ),
    Template(
        "cc0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        ("waived all copyright and related or neighboring rights",),
    ),
)


def license_words(text: Column) -> Column:
    """The words of a text, with A to Z in lower case."""
    # The one character outside ASCII that becomes an ASCII letter by itself must not.
    lower = F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u0138")))
    return F.array_remove(F.split(lower, BETWEEN), "")


def vocabulary(templates: Sequence[Template]) -> list[str]:
    return sorted({w for t in templates for w in t.words} | {w for p, _ in BASE for w in p.split()})


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def document_counts(docs: DataFrame, words: Sequence[str], text: str = "text") -> dict[str, int]:
    """In how many rows each of ``words`` stands; as many numbers as there are words."""
    present = F.array_intersect(_strings(words), license_words(text_of(docs, text)))
    counted = docs.select(F.explode(present).alias("word")).groupBy("word").count().collect()
    return {w: 0 for w in words} | {r["word"]: r["count"] for r in counted}


def index_of(templates: Sequence[Template], rare_first: Sequence[str]) -> Column:
    """The index as a constant: per template its words, its distinct words by rarity, and its phrases."""
    rank = {w: k for k, w in enumerate(rare_first)}
    entries = []
    for t in templates:
        phrases = [f" {p} " for p in t.phrases]
        keys = sorted({w for p in t.phrases for w in p.split()})
        entries.append(
            F.struct(
                F.lit(t.label).alias("label"),
                _strings(t.words).alias("words"),
                _strings(sorted(set(t.words), key=rank.__getitem__)).alias("ranked"),
                _strings(phrases).alias("phrases"),
                _strings(keys).alias("keys"),
            )
        )
    return F.array(*entries)


def _base_places(words: Column) -> Column:
    """Start and label of every place of a base phrase."""

    def at(word: Column, i: Column) -> Column:
        found = F.lit(None).cast("struct<start:long,label:string>")
        for phrase, label in BASE:
            first, *rest = phrase.split()
            here = word == first
            for k, other in enumerate(rest, 1):
                here = here & F.coalesce(F.get(words, i + k) == other, F.lit(False))
            found = F.when(here, F.struct(i.cast("long").alias("start"), F.lit(label).alias("label"))).otherwise(found)
        return found

    return F.filter(F.transform(words, at), lambda p: p.isNotNull())


def _starts(words: Column, present: Column, template: Column) -> Column:
    """Where a template begins, by the places of the text's rarest words of it."""

    def votes(looked_up: Column) -> Column:
        at = F.transform(words, lambda w, i: F.when(F.array_contains(looked_up, w), F.struct(w.alias("w"), i.alias("i"))))
        listed = F.transform(template["words"], lambda w, j: F.when(F.array_contains(looked_up, w), F.struct(w.alias("w"), j.alias("j"))))

        def meet(postings: Column) -> Column:
            return F.array_sort(
                F.flatten(
                    F.transform(
                        F.filter(at, lambda s: s.isNotNull()),
                        lambda s: F.transform(F.filter(postings, lambda p: p["w"] == s["w"]), lambda p: s["i"] - p["j"]),
                    )
                )
            )

        return let(F.filter(listed, lambda p: p.isNotNull()), meet)

    def agreed(sorted_votes: Column) -> Column:
        # Equal votes stand side by side.
        return F.array_distinct(F.filter(sorted_votes, lambda v, x: F.coalesce(F.get(sorted_votes, x + (AGREEING - 1)) == v, F.lit(False))))

    looked_up = F.slice(F.array_intersect(template["ranked"], present), 1, LOOKED_UP)
    return let(let(looked_up, votes), agreed)


def _found(words: Column, present: Column, index: Column) -> Column:
    """Labels and shares of the templates that stand in a text."""
    likely = F.filter(index, lambda t: F.size(F.array_except(t["keys"], present)) == 0)

    def share(template: Column) -> Column:
        def at(start: Column) -> Column:
            same = F.filter(template["words"], lambda w, j: F.coalesce(F.get(words, start + j) == w, F.lit(False)))
            return F.size(same) / F.size(template["words"])

        return F.array_max(F.transform(_starts(words, present, template), at))

    def look(templates: Column) -> Column:
        def verify(joined: Column) -> Column:
            kept = F.filter(templates, lambda t: F.forall(t["phrases"], lambda p: F.contains(joined, p)))
            return F.transform(kept, lambda t: F.struct(t["label"].alias("label"), share(t).alias("share")))

        joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        scored = F.filter(let(joined, verify), lambda f: f["share"].isNotNull())
        return F.when(F.size(templates) > 0, scored).otherwise(F.array().cast("array<struct<label:string,share:double>>"))

    return let(likely, look)


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, base phrases, ``labels`` and ``score``.

    ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` are of the base phrases alone; labels of
    verified templates are added in ``labels``. ``score`` is the largest share of a template's words that
    stand at their places, at least ``BASE_SCORE`` with a base phrase, and 0 without any label.

    A null text is the empty text: no words, no labels, score 0. Rows are handled one by one, so repeated
    rows and null ids need nothing special; other columns are dropped; an empty table gives an empty one.
    Words are ordered by the number of rows that hold them, then by code point, so ties are settled too.
    """
    known = vocabulary(templates)
    counts = document_counts(docs, known, text)
    rare_first = sorted(known, key=lambda w: (counts[w], w))
    index, listed = index_of(templates, rare_first), _strings(rare_first)
    nowhere = F.array().cast("array<struct<start:long,label:string>>")

    def judge(words: Column) -> Column:
        def with_present(present: Column) -> Column:
            likely = F.lit(False)
            for phrase, _ in BASE:
                likely = likely | (F.size(F.array_intersect(present, _strings(phrase.split()))) == len(phrase.split()))
            return F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.when(likely, _base_places(words)).otherwise(nowhere).alias("base"),
                _found(words, present, index).alias("found"),
            )

        return let(F.array_intersect(listed, words), with_present)

    rows = docs.select(
        name("doc_id").cast("long").alias("doc_id"), let(license_words(text_of(docs, text)), judge).alias("s")
    )
    base, found = F.col("s")["base"], F.col("s")["found"]
    base_labels = F.array_sort(F.array_distinct(base["label"]))
    labels = F.array_sort(F.array_union(base["label"], found["label"]))
    least = F.when(F.size(base) > 0, F.lit(BASE_SCORE)).otherwise(F.lit(0.0))
    return rows.select(
        "doc_id",
        F.col("s")["n_words"].alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base["start"]).alias("first_word"),
        F.array_max(base["start"]).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(least, F.coalesce(F.array_max(found["share"]), F.lit(0.0))).alias("score"),
    )


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def scan_sql(templates: Sequence[Template] = TEMPLATES) -> str:
    """The same rows for DuckDB, by joins of all words with the index."""
    words = ", ".join(f"({t}, {at}, {_quoted(w)})" for t, one in enumerate(templates) for at, w in enumerate(one.words))
    phrases = ", ".join(f"({t}, {_quoted(p)})" for t, one in enumerate(templates) for p in one.phrases)
    names = ", ".join(f"({t}, {_quoted(one.label)}, {len(one.words)})" for t, one in enumerate(templates))
    base = " UNION ALL ".join(
        f"SELECT r, i, {_quoted(label)} AS label FROM spot JOIN d USING (r) WHERE "
        + " AND ".join(f"w[i + {k + 1}] = {_quoted(word)}" for k, word in enumerate(phrase.split()))
        for phrase, label in BASE
    )
    others = ", ".join(f"({_quoted(w)})" for w in vocabulary(templates))
    return rf"""
    WITH d AS (
      SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BETWEEN}'), lambda x: x <> '') AS w FROM documents
    ), tw(t, place, word) AS (VALUES {words}), phrase(t, phrase) AS (VALUES {phrases}), template(t, label, size) AS (VALUES {names}),
    known(word) AS (VALUES {others}),
    spot AS (
      SELECT r, i, word FROM (SELECT r, unnest(w) AS word, unnest(generate_series(0, len(w) - 1)) AS i FROM d)
      WHERE word IN (SELECT word FROM known)
    ), df AS (SELECT word, count(DISTINCT r) AS n FROM spot GROUP BY word),
    base AS ({base}),
    top AS (
      SELECT r, t, word FROM (SELECT DISTINCT r, t, word FROM spot JOIN tw USING (word)) JOIN df USING (word)
      QUALIFY row_number() OVER (PARTITION BY r, t ORDER BY n, word) <= {LOOKED_UP}
    ), start AS (
      SELECT r, t, i - place AS o FROM spot JOIN top USING (r, word) JOIN tw USING (t, word)
      GROUP BY ALL HAVING count(*) >= {AGREEING}
    ), verified AS (
      SELECT r, t, o, w FROM start JOIN d USING (r) WHERE NOT EXISTS (
        SELECT 1 FROM phrase p WHERE p.t = start.t
          AND NOT contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || p.phrase || ' '))
    ), share AS (
      SELECT r, t, label, o, CAST(count(*) FILTER (o + place >= 0 AND w[o + place + 1] = word) AS DOUBLE) / any_value(size) AS share
      FROM verified JOIN tw USING (t) JOIN template USING (t) GROUP BY r, t, label, o
    ), b AS (
      SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r
    ), l AS (
      SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
      FROM (SELECT r, label FROM base UNION SELECT r, label FROM share) GROUP BY r
    ), s AS (SELECT r, max(share) AS score FROM share GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word,
           CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
           greatest(CASE WHEN n_base > 0 THEN {BASE_SCORE} ELSE 0 END::DOUBLE, coalesce(score, 0)) AS score
    FROM d LEFT JOIN b USING (r) LEFT JOIN l USING (r) LEFT JOIN s USING (r)
    """
