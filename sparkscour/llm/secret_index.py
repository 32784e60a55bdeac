"""Secret scans through a trigram index.

From each rule's regular expression follow strings that any match must contain, and from these a
Boolean query over trigrams. The index lists, for each trigram that the queries name, the documents
that contain it. A rule is run only on documents whose postings satisfy its query; a rule that
needs no particular trigram is run on all.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscour.llm.common import let, let_all, name, packed, text_of

# Strings that are followed at once through a pattern, and characters of a class that are spelt out.
MOST_STRINGS = 32
MOST_CHARACTERS = 8
# Matches of a text that are placed one after the other.
BLOCK = 256


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern for Java and DuckDB alike, and how long a group must be."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def any_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


# The three base kinds, in the order in which equal starts are listed.
BASE = (
    Rule(
        "assign",
        "(" + "|".join(any_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + any_case("api") + "_?" + any_case("key") + ")"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    # A run that is too short never hides a longer one, so the length is in the pattern.
    Rule("access", "AKIA[A-Z0-9]{12,}"),
    Rule("hex", "[0-9a-f]{32,}"),
)
ADDED = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", "[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("login", r"[a-z][a-z0-9+.-]{1,20}://[^\x20\x09-\x0D/:@]{1,100}:[^\x20\x09-\x0D/@]{3,100}@"),
)
RULES = BASE + ADDED


def needed(pattern: str) -> list[frozenset[str]]:
    """Sets of lower-cased strings of 3 or more characters: a match contains one of each set."""
    found: list[frozenset[str]] = []
    rest = _follow(re._parser.parse(pattern), {""}, found)  # noqa: SLF001
    _close(rest, found)
    return found


def _close(run: set[str], found: list[frozenset[str]]) -> None:
    # A string that contains another of the set adds nothing.
    least = {s for s in run if not any(o != s and o in s for o in run)}
    if least and all(len(s) >= 3 for s in least):
        found.append(frozenset(least))


def _follow(items, run: set[str], found: list[frozenset[str]]) -> set[str]:
    """Extend the strings of ``run`` by what must come next; where that is open, close them."""
    for op, value in items:
        kind = str(op)
        more: set[str] | None = None
        if kind == "LITERAL":
            more = {chr(value).lower()}
        elif kind == "IN":
            more = _class(value)
        elif kind == "AT":
            more = {""}
        elif kind == "SUBPATTERN":
            run = _follow(value[3], run, found)
            continue
        elif kind == "BRANCH":
            more = _branches(value[1], found)
        elif kind == "MAX_REPEAT":
            low, high, inner = value
            once = _exact(inner)
            if once is not None and low == 0 and int(high) == 1:
                more = once | {""}
            elif once is not None and low >= 1 and len(once) ** min(low, 3) <= MOST_STRINGS:
                more = {"".join(p) for p in product(once, repeat=min(low, 3))}
                if int(high) != low or low > 3:
                    run = {a + b for a, b in product(run, more)}
                    _close(run, found)
                    run = {""}
                    continue
        if more is None or len(run) * len(more) > MOST_STRINGS:
            _close(run, found)
            run = more if more is not None and len(more) <= MOST_STRINGS else {""}
        else:
            run = {a + b for a, b in product(run, more)}
    return run


def _class(items) -> set[str] | None:
    chars: set[str] = set()
    for op, value in items:
        if str(op) == "LITERAL":
            chars.add(chr(value).lower())
        elif str(op) == "RANGE" and value[1] - value[0] < MOST_CHARACTERS:
            chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return chars if len(chars) <= MOST_CHARACTERS else None


def _exact(items) -> set[str] | None:
    """All strings that the items match, or None if they are not spelt out."""
    if not _spelt_out(items):
        return None
    closed = _Closed()
    run = _follow(items, {""}, closed)
    return None if closed.any else run


class _Closed(list):
    """Notes whether anything was closed, so that a part isn't taken for exact."""

    any = False

    def append(self, item) -> None:
        self.any = True


def _branches(branches, found: list[frozenset[str]]) -> set[str] | None:
    exact = [_exact(branch) for branch in branches]
    if all(e is not None for e in exact):
        return set().union(*exact)
    # The run ends here; a match still contains something that its branch needs.
    together: set[str] = set()
    for branch in branches:
        options: list[frozenset[str]] = []
        _close(_follow(branch, {""}, options), options)
        if not options:
            return None
        together |= max(options, key=lambda s: min(map(len, s)))
    _close(together, found)
    return None


def _spelt_out(items) -> bool:
    for op, value in items:
        kind = str(op)
        if kind in ("LITERAL", "AT"):
            continue
        if kind == "IN" and _class(value) is not None:
            continue
        if kind == "SUBPATTERN" and _spelt_out(value[3]):
            continue
        if kind == "BRANCH" and all(_spelt_out(b) for b in value[1]):
            continue
        if kind == "MAX_REPEAT" and int(value[1]) <= 3 and (value[0] == int(value[1]) or (value[0], int(value[1])) == (0, 1)):
            if _spelt_out(value[2]):
                continue
        return False
    return True


def trigrams(text: str) -> list[str]:
    return sorted({text[i : i + 3] for i in range(len(text) - 2)})


def queries(rules: Sequence[Rule]) -> dict[str, list[list[list[str]]]]:
    """Per kind, an AND of ORs of ANDs of trigrams; empty if the rule needs a full scan."""
    return {r.kind: [[trigrams(s) for s in sorted(options)] for options in needed(r.pattern)] for r in rules}


def postings(docs: DataFrame, wanted: Sequence[str], text: str = "text") -> DataFrame:
    """The index: a row (``_doc``, ``_trigram``) per document and wanted trigram in its text.

    ``_trigram`` is the place in ``wanted``. Case is folded. Rows without id are left out.
    """

    def present(low: Column) -> Column:
        return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(k)) for k, t in enumerate(wanted)]))

    found = let(F.lower(text_of(docs, text)), present)
    doc = name("doc_id").cast("long")
    return docs.filter(doc.isNotNull()).select(doc.alias("_doc"), F.explode(found).alias("_trigram"))


def candidates(docs: DataFrame, rules: Sequence[Rule], text: str = "text") -> DataFrame:
    """Documents (``_doc``) with the kinds (``_kinds``) whose trigram queries their postings satisfy."""
    asked = {k: q for k, q in queries(rules).items() if q}
    wanted = sorted({t for q in asked.values() for options in q for one in options for t in one})
    if not wanted:
        kinds = F.array().cast("array<string>")
        return docs.select(name("doc_id").cast("long").alias("_doc"), kinds.alias("_kinds")).limit(0)
    place = {t: k for k, t in enumerate(wanted)}
    # Postings of one document meet; there are no more of them than wanted trigrams.
    merged = postings(docs, wanted, text).groupBy("_doc").agg(F.collect_set("_trigram").alias("_has"))

    def every(one: list[str]) -> Column:
        return F.size(F.array_intersect("_has", F.array(*[F.lit(place[t]) for t in one]))) == len(one)

    def satisfied(query: list[list[list[str]]]) -> Column:
        out = F.lit(True)
        for options in query:
            some = F.lit(False)
            for one in options:
                some = some | every(one)
            out = out & some
        return out

    kinds = F.array_compact(F.array(*[F.when(satisfied(q), F.lit(k)) for k, q in asked.items()]))
    return merged.select("_doc", kinds.alias("_kinds")).filter(F.size("_kinds") > 0)


SPAN = "struct<start:long,place:int,kind:string,end:long>"


def spans_of(text: Column, rule: Rule, place: int) -> Column:
    """The matches of a rule, leftmost and not overlapping, as spans in code points."""
    empty = F.array().cast(f"array<{SPAN}>")

    def located(found: Column) -> Column:
        def along(v: Column) -> Column:
            def step(acc: Column, i: Column) -> Column:
                start = acc["end"] + F.char_length(F.get(v["between"], i))
                end = start + F.char_length(F.get(found, i))
                long_enough = F.char_length(F.get(v["values"], i)) >= rule.least
                span = F.struct(start.alias("start"), F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"), end.alias("end"))
                return F.struct(
                    end.alias("end"),
                    F.when(long_enough, F.array_append(acc["spans"], span.cast(SPAN))).otherwise(acc["spans"]).alias("spans"),
                )

            def block(k: Column) -> Column:
                """The spans of a block of matches, from the end of the match before it, and the block's length."""
                begin = F.struct(F.lit(0).cast("long").alias("end"), empty.alias("spans"))
                last = F.least((k + 1) * BLOCK, F.size(found)) - 1
                return F.aggregate(
                    F.sequence(k * BLOCK, last),
                    begin,
                    lambda acc, i: let(step(acc, i), lambda s: F.struct(s["end"].cast("long").alias("end"), s["spans"].alias("spans"))),
                )

            def placed(blocks: Column) -> Column:
                begin = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<bigint>").alias("starts"))
                starts = F.aggregate(
                    blocks,
                    begin,
                    lambda acc, b: F.struct((acc["end"] + b["end"]).alias("end"), F.array_append(acc["starts"], acc["end"]).alias("starts")),
                    lambda acc: acc["starts"],
                )

                def moved(s: Column, by: Column) -> Column:
                    return F.struct((s["start"] + by).alias("start"), s["place"].alias("place"), s["kind"].alias("kind"), (s["end"] + by).alias("end"))

                def shifted(at: Column) -> Column:
                    return F.transform(blocks, lambda b, k: F.transform(b["spans"], lambda s: moved(s, F.get(at, k))))

                return F.flatten(let(starts, shifted))

            # Appending to an array copies it, so matches are placed in blocks, and blocks among each other.
            count = F.floor((F.size(found) - 1) / BLOCK).cast("int")
            return let(F.transform(F.sequence(F.lit(0), count), block), placed)

        between = F.split(text, rule.pattern, -1)
        values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
        return F.when(F.size(found) > 0, let_all({"between": between, "values": values}, along)).otherwise(empty)

    return let(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), located)


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """Every row (``row``) with its ``spans``: start, place and kind of the rule, end.

    Spans are in order of start, then of the rules; each rule's own spans don't overlap. A null text is
    empty and has none. Rows that share an id are looked up in the index together and searched each by
    itself; rows without id are searched by all rules. An empty table gives an empty one.
    """
    asked = queries(rules)
    known = candidates(docs, rules, text)
    doc = name("doc_id").cast("long")
    rows = docs.select(doc.alias("_doc"), text_of(docs, text).alias("_text"), packed(docs).alias("row"))
    joined = rows.join(known, "_doc", "left")
    empty = F.array().cast(f"array<{SPAN}>")
    each = []
    for place, rule in enumerate(rules):
        found = spans_of(F.col("_text"), rule, place)
        if asked[rule.kind]:
            likely = F.coalesce(F.array_contains("_kinds", rule.kind), F.lit(False)) | F.col("_doc").isNull()
            found = F.when(likely, found).otherwise(empty)
        each.append(found)
    return joined.select("row", F.sort_array(F.concat(*each)).alias("spans"))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def report(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per row: ``doc_id``, counts and digest of the base kinds, and all spans as text."""
    base = F.filter("spans", lambda s: s["place"] < len(BASE))
    counts = [
        F.size(F.filter("spans", lambda s: s["place"] == F.lit(k))).cast("long").alias(f"n_{rule.kind}")
        for k, rule in enumerate(BASE)
    ]
    return scan(docs, rules).select(
        F.col("row").getField("doc_id").cast("long").alias("doc_id"),
        *counts,
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def report_sql(rules: Sequence[Rule] = RULES) -> str:
    """The same report for DuckDB, by plain search of every text."""
    parts = []
    for place, rule in enumerate(rules):
        pattern = rule.pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {place} AS place, '{rule.kind}' AS kind, {rule.least} AS least, "
            f"regexp_extract_all(t, '{pattern}', 0) AS found, regexp_extract_all(t, '{pattern}', {rule.group}) AS vals, "
            f"regexp_split_to_array(t, '{pattern}') AS between FROM d"
        )
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    item = "kind || ':' || s || ':' || e"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({" UNION ALL ".join(parts)}),
    n AS (SELECT *, unnest(generate_series(1, len(found))) AS i FROM m WHERE len(found) > 0),
    p AS (
      SELECT doc_id, place, kind, least, length(vals[i]) AS size, length(found[i]) AS width,
             list_sum(list_transform(between[1:i], lambda x: length(x)))
             + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0) AS start FROM n
    ),
    q AS (SELECT doc_id, place, kind, CAST(start AS BIGINT) AS s, CAST(start + width AS BIGINT) AS e FROM p WHERE size >= least),
    g AS (
      SELECT doc_id, {counts},
             sha256(coalesce(string_agg({item}, ',' ORDER BY s, place) FILTER (place < {len(BASE)}), '')) AS base_sha256,
             string_agg({item}, ',' ORDER BY s, place) AS spans FROM q GROUP BY doc_id
    )
    SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)},
           coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN g USING (doc_id)
    """
