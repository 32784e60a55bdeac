"""The same semantics as DuckDB SQL, written from the specification of each step."""

from __future__ import annotations

from checks.inputs import MESSY, MESSY_SQL, RULES
from sparkscour.functions.text import ASCII_SPELLING, SPACE_CHARS

SPACE = (
    r"[\s\x0b\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"trim({x}, {lit(SPACE_CHARS)})"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


def spell(x: str) -> str:
    for char, spelling in ASCII_SPELLING.items():
        x = f"replace({x}, {lit(char)}, {lit(spelling)})"
    return x


def quotes(x: str) -> str:
    return f"""regexp_replace(regexp_replace({x}, '"{{2,}}', '"', 'g'), '''{{2,}}', '''', 'g')"""


def ascii_only(x: str) -> str:
    return rf"regexp_replace({x}, '[^\x20-\x7E]', '', 'g')"


def clean(x: str) -> str:
    return ascii_only(quotes(spell(collapse(x))))


def norm(x: str) -> str:
    spaced = rf"regexp_replace(trim(lower({x})), '[^A-Za-z0-9_\s''-]', ' ', 'g')"
    return rf"trim(regexp_replace({spaced}, '\s+', ' ', 'g'))"


def key(*cols: str) -> str:
    return "concat_ws(' ', " + ", ".join(f"nullif({norm(c)}, '')" for c in cols) + ")"


def empty(x: str, mode: str = "validator") -> str:
    words = "'NaN', 'nan', 'undefined'" + ("" if mode == "validator" else ", 'null', 'NULL'")
    return f"({x} IS NULL OR {trim(x)} = '' OR {x} IN ({words}))"


def csv(x: str) -> str:
    x = f"coalesce(CAST({x} AS VARCHAR), '')"
    return (
        f"""CASE WHEN contains({x}, ',') OR contains({x}, '"') OR contains({x}, chr(10)) """
        f"""THEN '"' || replace({x}, '"', '""') || '"' ELSE {x} END"""
    )


def pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} = 0 THEN 0.0 ELSE round(CAST({part} AS DOUBLE) / {whole} * 100, 2) END"


def words(x: str) -> str:
    return rf"list_distinct(list_filter(regexp_split_to_array({x}, '{SPACE}+'), lambda w: w <> ''))"


def lev_sim(a: str, b: str) -> str:
    longest = f"greatest(length({a}), length({b}))"
    return (
        f"CASE WHEN {longest} = 0 THEN 1.0::DOUBLE "
        f"ELSE 1 - CAST(levenshtein({a}, {b}) AS DOUBLE) / {longest} END"
    )


def jac_sim(a_words: str, b_words: str) -> str:
    shared = f"len(list_intersect({a_words}, {b_words}))"
    total = f"(len({a_words}) + len({b_words}) - {shared})"
    return f"CASE WHEN {total} = 0 THEN 0.0::DOUBLE ELSE CAST({shared} AS DOUBLE) / {total} END"


HEADERS = [name for name in MESSY if name != "row_id"]

# Messy customers after text cleaning, under their contract names.
CLEANED = (
    f"messy AS ({MESSY_SQL}), named AS (SELECT row_id, "
    + ", ".join(f'{clean(chr(34) + h + chr(34))} AS "{r.name}"' for h, r in zip(HEADERS, RULES))
    + " FROM messy)"
)


def bad(x: str, regex: str, mode: str = "validator") -> str:
    if regex in ("", "^.*$"):
        return "FALSE"
    return f"(NOT {empty(x, mode)} AND NOT regexp_matches({x}, {lit(regex)}))"


CHECKED = [r for r in RULES if not r.is_excluded and r.regex != "^.*$"]


def stats_sql(source: str, mode: str = "validator") -> str:
    parts = []
    for r in CHECKED:
        x = f'"{r.name}"'
        n_bad = f"count(*) FILTER ({bad(x, r.regex, mode)})"
        n_good = f"(count(*) - {n_bad})"
        parts.append(
            f"SELECT {lit(r.name)} AS \"column\", {lit(r.original_name)} AS original_name, "
            f"{lit(r.regex)} AS regex, count(*) AS total_count, {n_good} AS valid_count, "
            f"{n_bad} AS invalid_count, count(*) FILTER ({empty(x, mode)}) AS empty_count, "
            f"{pct(n_good, 'count(*)')} AS valid_pct, {pct(n_bad, 'count(*)')} AS invalid_pct "
            f"FROM {source}"
        )
    return " UNION ALL ".join(parts)


def invalid_sql(source: str, mode: str = "validator") -> str:
    return " UNION ALL ".join(
        f"SELECT row_id, {lit(r.name)} AS \"column\", \"{r.name}\" AS value FROM {source} "
        f"WHERE {bad(chr(34) + r.name + chr(34), r.regex, mode)}"
        for r in CHECKED
    )


def forest(source: str, columns: list[str], seed: int = 42, trees: int = 100, sample: int = 256) -> str:
    """CTEs that draw, grow and walk an isolation forest over ``source``; the last is ``scored``.

    ``source`` has ``row_id`` and the numeric columns; ``scored`` adds ``score`` to them.
    """
    cols, k = ", ".join(columns), len(columns)
    bits, mask = 2**48, 2**48 - 1

    def hexes(text: str, first: int) -> str:
        return f"CAST('0x' || substr({text}, {first}, 12) AS BIGINT)"

    def pick(place: str, names: list[str]) -> str:
        return f"CASE {place} " + " ".join(f"WHEN {i} THEN {n}" for i, n in enumerate(names)) + " END"

    depth = 8
    while 2**depth < sample:
        depth += 1
    parts = [
        f"f_size AS (SELECT least({sample}, count(*)) AS n, {bits} * least(1, {3 * sample} / greatest(count(*), 1)) AS cut FROM {source})",
        f"f_draw AS (SELECT *, {hexes('h', 1)} AS a, {hexes('h', 13)} AS b FROM (SELECT *, md5(concat('{seed}:', row_id)) AS h FROM {source}))",
        f"""f_s0 AS (SELECT tree, row_id, {cols}, CAST(1 AS BIGINT) AS node FROM (
            SELECT *, row_number() OVER (PARTITION BY tree ORDER BY draw, row_id) AS r FROM (
              SELECT f_draw.*, tree, (a + tree * b) & {mask} AS draw FROM f_draw, range(0, {trees}) t(tree))
            WHERE draw <= (SELECT cut FROM f_size)) WHERE r <= {sample})""",
    ]
    lows, highs = [f"lo{i}" for i in range(k)], [f"hi{i}" for i in range(k)]
    bounds = ", ".join(f"min({c}) AS lo{i}, max({c}) AS hi{i}" for i, c in enumerate(columns))
    varying = " || ".join(f"CASE WHEN hi{i} > lo{i} THEN [{i}] ELSE [] END" for i in range(k))
    for d in range(depth + 1):
        parts.append(
            f"""f_n{d} AS (SELECT tree, node, c, f, CASE WHEN cut >= hi THEN lo ELSE cut END AS split FROM (
              SELECT *, lo + u2 * (hi - lo) AS cut FROM (
              SELECT *, {pick('f', lows)} AS lo, {pick('f', highs)} AS hi FROM (
                SELECT *, CASE WHEN c > 1 AND len(v) > 0 AND {d} < (SELECT ceil(log2(greatest(n, 2))) FROM f_size)
                    THEN v[1 + CAST(floor(u1 * len(v)) AS INT)] END AS f FROM (
                  SELECT *, {varying} AS v, {hexes('h', 1)} / {bits}::DOUBLE AS u1, {hexes('h', 13)} / {bits}::DOUBLE AS u2 FROM (
                    SELECT tree, node, count(*) AS c, {bounds}, md5(concat('{seed}:', tree, ':', node)) AS h
                    FROM f_s{d} GROUP BY tree, node))))))"""
        )
        if d < depth:
            parts.append(
                f"""f_s{d + 1} AS (SELECT s.tree, row_id, {cols}, node * 2 + CAST({pick('f', columns)} > split AS INT) AS node
                FROM f_s{d} s JOIN f_n{d} USING (tree, node) WHERE f IS NOT NULL)"""
            )
    leaf = "CASE WHEN c <= 1 THEN 0 WHEN c = 2 THEN 1 ELSE 2 * (ln(c - 1) + 0.5772156649015329) - 2 * (c - 1) / c::DOUBLE END"
    every = " UNION ALL ".join(f"SELECT tree, node, f, split, {d} + {leaf} AS path FROM f_n{d}" for d in range(depth + 1))
    parts.append(f"f_nodes AS ({every})")
    parts.append(f"f_w0 AS (SELECT row_id, {cols}, tree, CAST(1 AS BIGINT) AS node FROM {source}, range(0, {trees}) t(tree))")
    for d in range(depth):
        parts.append(
            f"""f_w{d + 1} AS (SELECT row_id, {cols}, w.tree, node * 2 + CAST({pick('f', columns)} > split AS INT) AS node
            FROM f_w{d} w JOIN f_nodes USING (tree, node) WHERE f IS NOT NULL)"""
        )
    ends = " UNION ALL ".join(
        f"SELECT row_id, path FROM f_w{d} w JOIN f_nodes USING (tree, node) WHERE f IS NULL" for d in range(depth + 1)
    )
    norm = leaf.replace("c ", "n ").replace("(c - 1)", "(n - 1)").replace("/ c::", "/ n::")
    parts.append(
        f"""scored AS (SELECT s.*, score FROM {source} s JOIN (
          SELECT row_id, pow(2.0::DOUBLE, -(sum(path) / {trees} / (SELECT greatest({norm}, 1e-12) FROM f_size))) AS score
          FROM ({ends}) GROUP BY row_id) USING (row_id))"""
    )
    return ", ".join(parts)


def patterns(source: str, columns: list[str], most_shapes: int = 8) -> str:
    """CTEs of learned patterns of the columns of ``source``; the last is ``learned``."""
    cells = " UNION ALL ".join(
        f"SELECT {lit(c)} AS original_name, CAST(\"{c}\" AS VARCHAR) AS v FROM {source} WHERE NOT {empty(f'CAST(\"{c}\" AS VARCHAR)', 'unified')}" for c in columns
    )
    shape = "v"
    for chars, sign in (("[0-9]", "0"), ("[A-Z]", "A"), ("[a-z]", "a")):
        shape = f"regexp_replace({shape}, '{chars}+', '{sign}', 'g')"
    kind = "CASE WHEN regexp_matches(first, '^[0-9]') THEN '[0-9]' WHEN regexp_matches(first, '^[A-Z]') THEN '[A-Z]' WHEN regexp_matches(first, '^[a-z]') THEN '[a-z]' END"
    size = "CASE WHEN regexp_matches(first, '^[0-9]') THEN log2(10.0::DOUBLE) WHEN regexp_matches(first, '^[A-Za-z]') THEN log2(26.0::DOUBLE) ELSE 0 END"
    times = "CASE WHEN longest = 1 THEN '' WHEN shortest = longest THEN '{' || shortest || '}' ELSE '{' || shortest || ',' || longest || '}' END"
    escaped = r"regexp_replace(first, '([!-/:-@\[-`{-~])', '\\\1', 'g')"
    return f"""p_cells AS ({cells}),
    p_runs AS (SELECT original_name, shape, unnest(runs) AS run, unnest(generate_series(1, len(runs))) AS place FROM (
      SELECT original_name, {shape} AS shape, regexp_extract_all(v, '[0-9]+|[A-Z]+|[a-z]+|[^0-9A-Za-z]') AS runs FROM p_cells)),
    p_seen AS (SELECT original_name, shape, place, count(*) AS n, min(length(run)) AS shortest, max(length(run)) AS longest,
      sum(length(run)) AS chars, min(run) AS first, max(run) AS last FROM p_runs GROUP BY ALL),
    p_pieces AS (SELECT *, CASE WHEN first = last THEN {escaped} ELSE {kind} || {times} END AS piece,
      CASE WHEN first = last THEN 0 ELSE n * log2((longest - shortest + 1)::DOUBLE) + chars * {size} END AS bits FROM p_seen),
    p_branches AS (SELECT original_name, shape, max(n) AS n, sum(chars) AS chars, sum(bits) AS bits,
      string_agg(piece, '' ORDER BY place) AS branch FROM p_pieces GROUP BY ALL),
    p_known AS (SELECT original_name, count(*) AS shapes, CAST(sum(n) AS BIGINT) AS filled_count FROM p_branches GROUP BY ALL),
    p_found AS (SELECT original_name, shapes, filled_count, string_agg(branch, '|' ORDER BY n DESC, shape) AS branches,
      sum(bits + n * log2(filled_count / n::DOUBLE)) AS bits, sum(chars) AS chars
      FROM p_branches JOIN p_known USING (original_name) WHERE shapes <= {most_shapes} GROUP BY ALL),
    learned AS (SELECT original_name, regex, shapes, filled_count FROM (
      SELECT *, CASE WHEN shapes > 1 THEN '^(?:' || branches || ')$' ELSE '^' || branches || '$' END AS regex FROM p_found)
      WHERE 8 * length(regex) + bits < chars * log2(95.0::DOUBLE))"""
