"""Similarity, near-duplicate pairs and groups, survivors, requests and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import duck, query, table
from checks.inputs import NEAR_SQL, near_duplicates
from sparkscour.functions import similarity as sim
from sparkscour.functions.text import comparison_key, normalize_key
from sparkscour.operators.batches import decide_groups
from sparkscour.operators.groups import (
    group_members,
    group_requests,
    group_sizes,
    leader_groups,
)
from sparkscour.operators.pairs import row_pairs
from sparkscour.operators.reply_text import parse_decisions, parse_removal_list
from sparkscour.operators.survivors import (
    decide_survivors,
    dedupe_stats,
    invalid_decisions,
    keep_policy,
    remove_rows,
    removals_from_replies,
)
from sparkscour.plans.dedupe import dedupe
from sparkscour.sources.contracts import ColumnRule

RULES = [ColumnRule("name", "name", is_unique=True, index=1), ColumnRule("note", "note", index=2)]

# Similarity functions, on each part and on the part after it.
_PART_SQL = """p AS (SELECT a.p_partkey, a.p_name AS x, a.p_type AS y, b.p_name AS z
FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey + 1)"""


def _parts(spark, d) -> DataFrame:
    part = table(spark, d, "part")
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("z"))
    here = part.select("p_partkey", F.col("p_name").alias("x"), F.col("p_type").alias("y"))
    return here.join(after, "p_partkey", "left")


@query(
    "sim_levenshtein",
    f"""WITH {_PART_SQL} SELECT p_partkey, levenshtein(x, z) AS distance_next,
    {duck.lev_sim('x', 'y')} AS to_type, {duck.lev_sim('x', 'z')} AS to_next FROM p""",
)
def sim_levenshtein(spark, d):
    return _parts(spark, d).select(
        "p_partkey",
        sim.levenshtein_distance("x", "z").cast("long").alias("distance_next"),
        sim.levenshtein_similarity("x", "y").alias("to_type"),
        sim.similarity("x", "z", "unknown").alias("to_next"),
    )


@query(
    "sim_jaccard",
    f"""WITH {_PART_SQL} SELECT p_partkey, {duck.jac_sim(duck.words('x'), duck.words('y'))} AS to_type,
    {duck.jac_sim(duck.words('x'), duck.words("coalesce(z, '')"))} AS to_next FROM p""",
)
def sim_jaccard(spark, d):
    return _parts(spark, d).fillna("", ["z"]).select(
        "p_partkey",
        sim.jaccard_similarity("x", "y").alias("to_type"),
        sim.similarity("x", "z", "jaccard").alias("to_next"),
    )


@query(
    "sim_combined",
    f"""WITH {_PART_SQL} SELECT p_partkey, ({duck.lev_sim('x', "coalesce(z, '')")}) * 0.7::DOUBLE
    + ({duck.jac_sim(duck.words('x'), duck.words("coalesce(z, '')"))}) * 0.3::DOUBLE AS to_next
    FROM p""",
)
def sim_combined(spark, d):
    return _parts(spark, d).fillna("", ["z"]).select(
        "p_partkey", sim.similarity("x", "z", "combined").alias("to_next")
    )


# Near duplicates of customers, by edit distance and combined similarity.
_NEAR_KEYS = (
    f"near AS ({NEAR_SQL}), keyed AS (SELECT row_id, {duck.key('name')} AS k FROM near), "
    "named AS (SELECT * FROM keyed WHERE k <> '')"
)
_LEV = duck.lev_sim("a.k", "b.k")
_JAC = duck.jac_sim(duck.words("a.k"), duck.words("b.k"))
_COMBINED = f"({_LEV}) * 0.7::DOUBLE + ({_JAC}) * 0.3::DOUBLE"


def _near_pairs(score: str, t: float, lev_bound: float) -> str:
    return f"""SELECT * FROM (SELECT a.row_id AS left_id, b.row_id AS right_id, {score} AS similarity
    FROM named a JOIN named b ON a.row_id < b.row_id
      AND least(length(a.k), length(b.k)) >= {lev_bound} * greatest(length(a.k), length(b.k)) - 1e-6)
    WHERE similarity >= {t}"""


# Word overlap of whole documents; the shared words are counted per pair.
_DOC_KEYS = f"keyed AS (SELECT doc_id AS row_id, {duck.norm('text')} AS k FROM documents)"
_DOC_PAIRS = f"""word AS (SELECT row_id, unnest({duck.words('k')}) AS w FROM keyed),
size AS (SELECT row_id, count(*) AS n FROM word GROUP BY row_id),
shared AS (SELECT a.row_id AS l, b.row_id AS r, count(*) AS c
  FROM word a JOIN word b ON a.w = b.w AND a.row_id < b.row_id GROUP BY ALL),
docs AS (SELECT l AS left_id, r AS right_id,
  CAST(c AS DOUBLE) / (x.n + y.n - c) AS similarity
  FROM shared JOIN size x ON x.row_id = l JOIN size y ON y.row_id = r
  WHERE CAST(c AS DOUBLE) / (x.n + y.n - c) >= 0.85)"""


def _first_of_key(pairs: str) -> str:
    """Pairs between the first rows of distinct keys only."""
    return f"""firsts AS (SELECT min(row_id) AS id FROM keyed WHERE k <> '' GROUP BY k)
    SELECT left_id, right_id, similarity FROM {pairs}
    WHERE left_id IN (SELECT id FROM firsts) AND right_id IN (SELECT id FROM firsts)"""


def _keyed(spark, d) -> DataFrame:
    near = near_duplicates(spark, d)
    return near.select("row_id", comparison_key("name").alias("comparison_value"))


def _documents(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("row_id"), normalize_key("text").alias("comparison_value")
    )


@query(
    "dup_pairs_levenshtein",
    f"WITH {_NEAR_KEYS}, pairs AS ({_near_pairs(_LEV, 0.85, 0.85)}), {_first_of_key('pairs')}",
)
def dup_pairs_levenshtein(spark, d):
    return row_pairs(_keyed(spark, d))


@query(
    "dup_pairs_combined",
    f"WITH {_NEAR_KEYS}, pairs AS ({_near_pairs(_COMBINED, 0.8, 0.71)}), {_first_of_key('pairs')}",
)
def dup_pairs_combined(spark, d):
    return row_pairs(_keyed(spark, d), strategy="combined", threshold=0.8)


@query("dup_pairs_jaccard", f"WITH {_DOC_KEYS}, {_DOC_PAIRS}, {_first_of_key('docs')}")
def dup_pairs_jaccard(spark, d):
    return row_pairs(_documents(spark, d), strategy="jaccard")


def _groups_sql(pairs: str) -> str:
    """The sequential loop over all rows: walk the rows in order and carry the claimed ones."""
    return f"""steps AS (SELECT row_number() OVER (ORDER BY left_id) AS n, left_id,
      list(right_id) AS claims FROM {pairs} GROUP BY left_id),
    walk(n, left_id, leads, used) AS (
      SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), FALSE, CAST([] AS BIGINT[])
      UNION ALL
      SELECT s.n, s.left_id, NOT list_contains(w.used, s.left_id),
        CASE WHEN list_contains(w.used, s.left_id) THEN w.used
          ELSE list_concat(w.used, s.claims) END
      FROM walk w JOIN steps s ON s.n = w.n + 1),
    claimed AS (SELECT right_id AS row_id, min(left_id) AS leader_id,
        arg_min(similarity, left_id) AS similarity
      FROM {pairs} WHERE left_id IN (SELECT left_id FROM walk WHERE leads) GROUP BY right_id),
    groups AS (
      SELECT c.leader_id, c.row_id, 'duplicate' AS role, c.similarity, k AS comparison_value
      FROM claimed c JOIN keyed USING (row_id)
      UNION ALL
      SELECT l.leader_id, l.leader_id, 'leader', 1.0::DOUBLE, k
      FROM (SELECT DISTINCT leader_id FROM claimed) l JOIN keyed ON keyed.row_id = l.leader_id)"""


GROUPS_SQL = (
    f"WITH RECURSIVE {_NEAR_KEYS}, pairs AS ({_near_pairs(_LEV, 0.85, 0.85)}), "
    f"{_groups_sql('pairs')}"
)


def _groups(spark, d) -> DataFrame:
    from sparkscour.session import durable

    return durable(leader_groups(_keyed(spark, d)))


@query("dup_groups", f"{GROUPS_SQL} SELECT * FROM groups")
def dup_groups(spark, d):
    return leader_groups(_keyed(spark, d))


@query(
    "dup_groups_documents",
    f"""WITH RECURSIVE {_DOC_KEYS}, {_DOC_PAIRS}, {_groups_sql('docs')}
    SELECT leader_id, row_id, role, similarity FROM groups""",
)
def dup_groups_documents(spark, d):
    return leader_groups(_documents(spark, d), "jaccard").drop("comparison_value")


@query(
    "group_members",
    f"""{GROUPS_SQL} SELECT leader_id, row_id, role, round(similarity * 100, 2) AS similarity_pct,
    comparison_value FROM groups""",
)
def members(spark, d):
    return group_members(leader_groups(_keyed(spark, d)))


@query(
    "group_sizes",
    f"""{GROUPS_SQL} SELECT leader_id, count(*) AS members,
    round(min(similarity) FILTER (role = 'duplicate') * 100, 2) AS lowest_pct,
    round(max(similarity) FILTER (role = 'duplicate') * 100, 2) AS highest_pct
    FROM groups GROUP BY leader_id""",
)
def sizes(spark, d):
    return group_sizes(leader_groups(_keyed(spark, d)))


# Survivors.
_EMPTY_NOTE = duck.empty("note")
_KEEPS = {
    "leader": "SELECT DISTINCT leader_id, leader_id AS keep_id FROM groups",
    "most_complete": f"""SELECT leader_id, row_id AS keep_id FROM groups JOIN near USING (row_id)
      QUALIFY row_number() OVER (PARTITION BY leader_id ORDER BY
        CAST({_EMPTY_NOTE} AS INT) + CAST({duck.empty('near.name')} AS INT), row_id) = 1""",
    "longest": """SELECT leader_id, row_id AS keep_id FROM groups
      QUALIFY row_number() OVER (PARTITION BY leader_id ORDER BY
        length(comparison_value) DESC, row_id) = 1""",
}
_WITHOUT = (
    "SELECT near.* FROM near WHERE row_id NOT IN (SELECT row_id FROM groups g JOIN keeps k "
    "ON k.leader_id = g.leader_id WHERE g.row_id <> k.keep_id)"
)


def _keep_query(policy: str) -> None:
    @query(f"dedupe_keep_{policy}", f"{GROUPS_SQL}, keeps AS ({_KEEPS[policy]}) {_WITHOUT}")
    def build(spark, d):
        return dedupe(near_duplicates(spark, d), RULES, policy=policy).table


for _policy in _KEEPS:
    _keep_query(_policy)

# Decisions for every customer id: the leader itself, a claimed row, or a row outside the group.
DECISIONS_SQL = """SELECT c_custkey AS leader_id, CASE c_custkey % 4 WHEN 0 THEN c_custkey
WHEN 1 THEN c_custkey + 5000000 ELSE c_custkey + 1 END AS keep_id FROM customer WHERE c_custkey % 4 <> 3"""
_VALID = f"""decisions AS ({DECISIONS_SQL}),
keeps AS (SELECT leader_id, keep_id FROM decisions d SEMI JOIN groups g
  ON g.leader_id = d.leader_id AND g.row_id = d.keep_id)"""


def _decisions(spark, d) -> DataFrame:
    return spark.sql(
        DECISIONS_SQL.replace("FROM customer", "FROM {customer}"),
        customer=table(spark, d, "customer"),
    )


@query("dedupe_decisions", f"{GROUPS_SQL}, {_VALID} {_WITHOUT}")
def dedupe_decisions(spark, d):
    return dedupe(near_duplicates(spark, d), RULES, decisions=_decisions(spark, d)).table


@query(
    "decisions_invalid",
    f"""{GROUPS_SQL}, {_VALID} SELECT leader_id, keep_id FROM decisions
    EXCEPT SELECT leader_id, keep_id FROM keeps""",
)
def decisions_invalid(spark, d):
    return invalid_decisions(_groups(spark, d), _decisions(spark, d))


@query(
    "removals",
    f"""{GROUPS_SQL}, {_VALID} SELECT DISTINCT g.row_id FROM groups g JOIN keeps k
    ON k.leader_id = g.leader_id WHERE g.row_id <> k.keep_id""",
)
def removals(spark, d):
    return decide_survivors(_groups(spark, d), _decisions(spark, d))


@query(
    "dedupe_stats",
    f"""{GROUPS_SQL}, keeps AS ({_KEEPS['longest']}), removed AS (SELECT g.row_id FROM groups g
    JOIN keeps k ON k.leader_id = g.leader_id WHERE g.row_id <> k.keep_id),
    c AS (SELECT (SELECT count(*) FROM near) AS original_count,
      (SELECT count(DISTINCT leader_id) FROM groups) AS duplicate_groups,
      (SELECT count(*) FROM removed) AS duplicates_removed)
    SELECT *, original_count - duplicates_removed AS final_count,
      {duck.pct('duplicates_removed', 'original_count')} AS rate_pct FROM c""",
)
def stats(spark, d):
    near = near_duplicates(spark, d)
    groups = _groups(spark, d)
    removed = decide_survivors(groups, keep_policy(groups, "longest"))
    return dedupe_stats(near, groups, removed)


_LINE = f"concat_ws(',', row_id, {duck.csv('near.name')}, {duck.csv('note')})"
_REQUESTS = f"""lined AS (SELECT leader_id, row_id, {_LINE} AS line FROM groups JOIN near USING (row_id)),
requests AS (SELECT leader_id, CAST(1 AS BIGINT) AS part, concat('ID,name,note', chr(10), '<group_', leader_id, '>', chr(10),
  string_agg(line, chr(10) ORDER BY row_id <> leader_id, row_id), chr(10), '</group_', leader_id, '>')
  AS text FROM lined GROUP BY leader_id)"""


@query("group_requests", f"{GROUPS_SQL}, {_REQUESTS} SELECT * FROM requests")
def requests(spark, d):
    return group_requests(_groups(spark, d), near_duplicates(spark, d))


def _keep_second():
    """A decider that keeps the first duplicate; a closure, so executors need no module."""

    def keep_second(request: str) -> str:
        lines = request.split("\n")
        return f"{lines[1]}\n{lines[3]}\n{lines[-1]}"

    return keep_second


@query(
    "decide_groups",
    f"""{GROUPS_SQL}, {_REQUESTS} SELECT leader_id, part, concat('<group_', leader_id, '>', chr(10),
    string_split(text, chr(10))[4], chr(10), '</group_', leader_id, '>') AS text FROM requests""",
)
def decided(spark, d):
    asked = group_requests(_groups(spark, d), near_duplicates(spark, d))
    return decide_groups(asked, _keep_second())


@query(
    "dedupe_decider",
    f"""{GROUPS_SQL}, keeps AS (SELECT leader_id, min(row_id) AS keep_id FROM groups
    WHERE role = 'duplicate' GROUP BY leader_id) {_WITHOUT}""",
)
def dedupe_decider(spark, d):
    return dedupe(near_duplicates(spark, d), RULES, decider=_keep_second()).table


# Replies with decisions: one per supplier.
def _replies(spark, d) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    blocks = F.concat(
        F.lit("ok <group_"), key, F.lit(">\n  "), key, F.lit(",a,b\n7,c\n</group_"), key,
        F.lit("> <group_9000000>\n</group_9000000>\n<group_8000000>none</group_8000000>"),
        F.lit(" <group_1>5,x</group_2> remove [3, "), key, F.lit(" ] or [1]"),
    )
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("reply_id"), blocks.alias("text"))


@query("decisions_parse", "SELECT s_suppkey AS reply_id, s_suppkey AS leader_id, s_suppkey AS keep_id FROM supplier")
def decisions_parse(spark, d):
    return parse_decisions(_replies(spark, d))


@query(
    "removal_list_parse",
    """SELECT s_suppkey AS reply_id, CAST(3 AS BIGINT) AS row_id FROM supplier
    UNION SELECT s_suppkey, s_suppkey FROM supplier WHERE s_suppkey >= 1""",
)
def removal_list_parse(spark, d):
    return parse_removal_list(_replies(spark, d))


@query(
    "removals_from_list",
    "SELECT n.* FROM ({}) n WHERE row_id <> 3 AND row_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey >= 1)".format(
        NEAR_SQL
    ),
)
def removals_from_list(spark, d):
    near = near_duplicates(spark, d)
    no_blocks = _replies(spark, d).select(F.regexp_replace("text", "group_", "none_").alias("text"))
    groups = spark.createDataFrame([], "leader_id long, row_id long")
    return remove_rows(near, removals_from_replies(groups, no_blocks))
