"""Briefs of all seats, their sections, and proposals from inbox to decision."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import briefs, proposals, temporal
from tidemark.plans.curation_queries import PROMOTE, propose_promotions
from tidemark.sources.views import NODE, nodes, table

SECTIONS = {"BUILDING": "conventions", "AUTOMOBILE": "decisions", "MACHINERY": "lessons", "ECONOMY": "patterns"}


def seats(spark, d):
    """A seat for each nation, its region is the cluster."""
    return table(spark, d, "nation").select(F.concat(F.lit("project_"), F.col("n_nationkey").cast("string")).alias("seat"), F.concat(F.lit("cluster_"), F.col("n_regionkey").cast("string")).alias("cluster"))


def entities(spark, d):
    """Customers as entities of their nation's scope, parts as shared ones."""
    c, p = table(spark, d, "customer"), table(spark, d, "part")
    none = F.lit(None).cast("string")
    day = lambda k: F.date_add(F.lit("2020-01-01").cast("date"), (F.col(k) % 365).cast("int"))
    b = F.col("c_acctbal")
    severity = F.when(b < 0, "critical").when(b < 2500, "High").when(b < 5000, "medium").when(b < 7500, "low")
    own = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("uuid"), F.concat(F.lit("project_"), F.col("c_nationkey").cast("string")).alias("scope"), F.col("c_mktsegment").alias("label"), F.col("c_name").alias("name"), none.alias("summary"), F.concat(F.lit("balance  of "), F.floor(b).cast("string")).alias("why"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("rejected"), severity.alias("severity"), day("c_custkey").alias("created_at"))
    scope = F.when(F.col("p_size") < 3, "global").otherwise(F.concat(F.lit("cluster_"), (F.col("p_size") % 5).cast("string")))
    return own.unionAll(p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")), scope, F.col("p_type"), F.col("p_name"), F.concat(F.lit(" the "), F.col("p_name")), none, F.when(F.col("p_size") % 2 == 0, F.repeat(F.concat(F.col("p_brand"), F.lit(" ")), F.lit(40))), none, day("p_partkey")))


_ENTITIES = """ent AS (SELECT 'c' || c_custkey AS uuid, 'project_' || c_nationkey AS scope, c_mktsegment AS label, c_name AS line0, 'balance of ' || floor(c_acctbal)::BIGINT AS why, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS rejected,
  CASE WHEN c_acctbal < 0 THEN 1 WHEN c_acctbal < 2500 THEN 2 WHEN c_acctbal < 5000 THEN 3 WHEN c_acctbal < 7500 THEN 4 ELSE 5 END AS severity, DATE '2020-01-01' + (c_custkey % 365)::INTEGER AS created_at FROM customer
  UNION ALL SELECT 'p' || p_partkey, CASE WHEN p_size < 3 THEN 'global' ELSE 'cluster_' || (p_size % 5) END, p_type, 'the ' || p_name, NULL, CASE WHEN p_size % 2 = 0 THEN trim(repeat(p_brand || ' ', 40)) END, 5, DATE '2020-01-01' + (p_partkey % 365)::INTEGER FROM part),
lines AS (SELECT *, line0 || CASE WHEN why IS NULL AND rejected IS NULL THEN '' ELSE ' — ' || concat_ws('; ', 'why: ' || why, 'rejected: ' || CASE WHEN length(rejected) > 180 THEN rtrim(left(rejected, 179)) || '…' ELSE rejected END) END AS line,
  CASE label WHEN 'BUILDING' THEN 'conventions' WHEN 'AUTOMOBILE' THEN 'decisions' WHEN 'MACHINERY' THEN 'lessons' WHEN 'ECONOMY' THEN 'patterns' END AS section FROM ent),
seen AS (SELECT 'project_' || n_nationkey AS seat, unnest(['global', 'cluster_' || n_regionkey, 'project_' || n_nationkey]) AS scope FROM nation),
top AS (SELECT seat, section, severity, line, row_number() OVER (PARTITION BY seat, section ORDER BY created_at DESC, uuid DESC) AS pos FROM lines JOIN seen USING (scope) WHERE section IS NOT NULL QUALIFY pos <= 7)"""
_BOOKS = """books AS (SELECT conv_id AS uuid, max(conv_id) AS created_at, 'runbook ' || conv_id || ' of ' || count(*) || ' steps' AS name, CASE WHEN conv_id % 10 = 0 THEN 'global' WHEN conv_id % 10 = 1 THEN 'cluster_' || (conv_id % 5) ELSE 'project_' || (conv_id % 25) END AS scope FROM conversations GROUP BY conv_id),
shelf AS (SELECT seat, name, row_number() OVER (PARTITION BY seat ORDER BY created_at DESC, uuid DESC) AS pos FROM books JOIN seen USING (scope) QUALIFY pos <= 5)"""


def runbooks(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    k = F.col("conv_id")
    scope = F.when(k % 10 == 0, "global").when(k % 10 == 1, F.concat(F.lit("cluster_"), (k % 5).cast("string"))).otherwise(F.concat(F.lit("project_"), (k % 25).cast("string")))
    return c.select(k.alias("uuid"), k.alias("created_at"), F.concat(F.lit("runbook "), k.cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" steps")).alias("name"), scope.alias("scope"))


def newest_entities(spark, d):
    """The newest seven entities of each label that each seat sees."""
    return briefs.newest_seen(entities(spark, d), briefs.visible(seats(spark, d)), 7, ["label"]).select("seat", "label", "uuid", "pos")


NEWEST = f"WITH {_ENTITIES} SELECT seat, label, uuid, row_number() OVER (PARTITION BY seat, label ORDER BY created_at DESC, uuid DESC)::INTEGER AS pos FROM ent JOIN seen USING (scope) QUALIFY pos <= 7"


def severity_order(spark, d):
    """The newest lessons of each seat, the gravest first."""
    own = briefs.newest_seen(entities(spark, d).filter("label = 'MACHINERY'"), briefs.visible(seats(spark, d)), 7)
    rank = briefs.severity_rank(F.col("severity"))
    return own.select("seat", "uuid", F.when(rank == 0, 5).otherwise(rank).alias("severity"), "pos")


SEVERE = f"WITH {_ENTITIES} SELECT seat, uuid, severity, row_number() OVER (PARTITION BY seat ORDER BY created_at DESC, uuid DESC)::INTEGER AS pos FROM ent JOIN seen USING (scope) WHERE label = 'MACHINERY' QUALIFY pos <= 7"


def brief_lines(spark, d):
    """Each entity's brief line."""
    return entities(spark, d).select("uuid", briefs.line(F.col("summary"), F.col("name"), F.col("why"), F.col("rejected")).alias("line"))


def seat_runbooks(spark, d):
    """The newest runbooks that each seat sees."""
    return briefs.newest_seen(runbooks(spark, d), briefs.visible(seats(spark, d)), briefs.RUNBOOKS).select("seat", "name", "pos")


def seat_briefs(spark, d):
    """The briefs of all seats in one job."""
    return briefs.briefs(seats(spark, d), entities(spark, d), runbooks(spark, d), SECTIONS)


BRIEFS = f"""WITH {_ENTITIES}, {_BOOKS}, parts AS (SELECT seat, section, CASE WHEN section = 'lessons' THEN severity ELSE 0 END AS rank, pos, line FROM top UNION ALL SELECT seat, 'runbooks', 0, pos, name FROM shelf),
g AS (SELECT seat, section, count(*) AS n, string_agg(line, chr(10) ORDER BY rank, pos) AS t FROM parts GROUP BY 1, 2), s AS (SELECT DISTINCT seat FROM seen),
w AS (SELECT s.seat, {', '.join(f"coalesce(max(t) FILTER (section = '{x}'), '') AS {x}, coalesce(max(n) FILTER (section = '{x}'), 0) AS n_{x}" for x in [*SECTIONS.values(), 'runbooks'])} FROM s LEFT JOIN g USING (seat) GROUP BY 1)
SELECT seat, seat || ': ' || {" || ', ' || ".join(f"n_{x} || ' {x}'" for x in SECTIONS.values())} || ' on record.' AS summary, {', '.join([*SECTIONS.values(), 'runbooks'])} FROM w"""


def name_mentions(spark, d):
    """Entity names that occur as whole words, in any case, in statements; the first word finds candidates by a join.

    Names are the words and pairs of part names; a statement names a part and the size class of its neighbour.
    """
    p = table(spark, d, "part")
    said = p.select("p_partkey", F.concat(F.lit("The "), F.upper("p_name"), F.lit("-like "), F.col("p_type"), F.lit(" of "), F.col("p_brand")).alias("text"))
    names = p.select(F.col("p_name").alias("name")).union(p.select(F.substring_index("p_name", " ", -1))).union(p.select(F.lower("p_type"))).distinct()
    words = said.select("p_partkey", F.lower("text").alias("t"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1))).alias("word"))
    # the planner takes the words for as small as their texts, and would send them all to the driver
    met = words.join(names.withColumn("word", F.regexp_extract("name", "[a-z0-9]+", 0)).hint("merge"), "word")
    whole = F.contains(F.concat(F.lit(" "), F.regexp_replace("t", "[^a-z0-9]+", " "), F.lit(" ")), F.concat(F.lit(" "), "name", F.lit(" ")))
    return met.filter(whole).groupBy("name").agg(F.count_distinct("p_partkey").alias("mentions"))


MENTIONS = r"""WITH said AS (SELECT p_partkey, lower('The ' || p_name || '-like ' || p_type || ' of ' || p_brand) AS t FROM part), names AS (SELECT p_name AS name FROM part UNION SELECT split_part(p_name, ' ', -1) FROM part UNION SELECT lower(p_type) FROM part)
SELECT name, count(DISTINCT p_partkey) AS mentions FROM said JOIN names ON regexp_matches(t, '\b' || name || '\b') GROUP BY 1"""


def promotions(spark, d):
    own = nodes(spark, d).groupBy("name", "label").agg(F.array_sort(F.collect_set("group_id")).alias("scopes"))
    return propose_promotions(spark, d).drop("scopes").join(own, ["name", "label"]).withColumns({"kind": F.lit("promote"), "status": F.when(F.length("name") % 5 == 0, "DISMISSED").otherwise("OPEN")})


def settled_proposals(spark, d):
    """Every proposal gets a decision; statements name up to five of its scopes, some are known already."""
    p = promotions(spark, d)
    statement = F.when(F.size("scopes") % 7 == 0, None).otherwise(F.concat(F.col("name"), F.lit(" serves "), F.array_join(F.slice("scopes", 1, (F.size("scopes") % 5 + 1)), " and ")))
    decisions = p.select("proposal_key", F.when(F.length("label") % 2 == 0, "apply").otherwise("dismiss").alias("action"), statement.alias("statement"))
    known = p.filter(F.length("name") % 3 == 0).select(F.col("target").alias("scope"), statement.alias("statement"))
    return proposals.settle(p, decisions, known)


SETTLED = f"""WITH p0 AS ({PROMOTE}), own AS (SELECT name, label, list_sort(list(DISTINCT group_id)) AS groups FROM ({f'WITH {NODE} SELECT * FROM v_node'}) GROUP BY 1, 2),
p AS (SELECT p0.*, groups, CASE WHEN length(name) % 5 = 0 THEN 'DISMISSED' ELSE 'OPEN' END AS status, CASE WHEN len(groups) % 7 = 0 THEN NULL ELSE name || ' serves ' || array_to_string(groups[1:len(groups) % 5 + 1], ' and ') END AS statement FROM p0 JOIN own USING (name, label)),
k AS (SELECT DISTINCT target AS scope, lower(statement) AS s FROM p WHERE length(name) % 3 = 0 AND statement IS NOT NULL),
r AS (SELECT p.*, CASE WHEN length(label) % 2 = 1 THEN NULL WHEN statement IS NULL THEN 'no statement' WHEN len(list_filter(groups, lambda g: contains(lower(statement), lower(g)))) >= 3 THEN 'names its projects' WHEN EXISTS (SELECT 1 FROM k WHERE k.s = lower(p.statement) AND k.scope IN (p.target, 'global')) THEN 'known there' END AS reason FROM p WHERE status = 'OPEN')
SELECT proposal_key, CASE WHEN length(label) % 2 = 1 THEN 'DISMISSED' WHEN reason IS NULL THEN 'APPLIED' ELSE 'OPEN' END AS status, reason FROM r"""


def proposal_inbox(spark, d):
    """Of each status and kind the newest proposals; the widest count as newest here."""
    p = promotions(spark, d).withColumn("wide", F.size("scopes"))
    return temporal.newest(p, ["status", "kind"], [F.desc("wide"), F.asc("proposal_key")], 10).select("status", "kind", "proposal_key")


INBOX = f"WITH p AS ({PROMOTE}) SELECT CASE WHEN length(name) % 5 = 0 THEN 'DISMISSED' ELSE 'OPEN' END AS status, 'promote' AS kind, proposal_key FROM p QUALIFY row_number() OVER (PARTITION BY status ORDER BY scopes DESC, proposal_key) <= 10"

PAIRS = {
    "newest_entities": (newest_entities, NEWEST),
    "severity_order": (severity_order, SEVERE),
    "brief_lines": (brief_lines, f"WITH {_ENTITIES} SELECT uuid, line FROM lines"),
    "seat_runbooks": (seat_runbooks, f"WITH {_ENTITIES}, {_BOOKS} SELECT seat, name, pos::INTEGER AS pos FROM shelf"),
    "seat_briefs": (seat_briefs, BRIEFS),
    "name_mentions": (name_mentions, MENTIONS),
    "settled_proposals": (settled_proposals, SETTLED),
    "proposal_inbox": (proposal_inbox, INBOX),
}
