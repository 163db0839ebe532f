"""Snapshots, views and state changes of the fact graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import graph, temporal
from tidemark.sources.views import EDGE, NODE, edges, log, nodes, table

NOW = "1998-01-01"


def now():
    return F.lit(NOW).cast("date")


#: Log rows that are kept of each tool.
KEPT = 20_000


def as_of_snapshot(spark, d):
    e = edges(spark, d)
    top, links = graph.snapshot(e, temporal.as_of(e, now()), 2000)
    ends = graph.degrees(links).withColumnRenamed("degree", "links")
    return top.join(ends, "uuid", "left").select("uuid", "degree", F.coalesce("links", F.lit(0)).alias("links"))


DEG = "deg AS (SELECT uuid, count(*) AS degree FROM (SELECT source AS uuid FROM v_edge UNION ALL SELECT target FROM v_edge WHERE target <> source) GROUP BY 1)"
AS_OF_SNAPSHOT = f"""WITH {EDGE}, {DEG}, top AS (SELECT * FROM deg ORDER BY degree DESC, uuid LIMIT 2000),
l AS (SELECT * FROM v_edge WHERE (valid_at IS NULL OR valid_at <= DATE '{NOW}') AND (invalid_at IS NULL OR invalid_at > DATE '{NOW}') AND source IN (SELECT uuid FROM top) AND target IN (SELECT uuid FROM top)),
k AS (SELECT uuid, count(*) AS links FROM (SELECT source AS uuid FROM l UNION ALL SELECT target FROM l) GROUP BY 1)
SELECT uuid, degree, coalesce(links, 0) AS links FROM top LEFT JOIN k USING (uuid)"""


def node_degrees(spark, d):
    return graph.degrees(edges(spark, d), nodes(spark, d))


NODE_DEGREES = f"WITH {EDGE}, {NODE}, {DEG} SELECT uuid, coalesce(degree, 0) AS degree FROM v_node LEFT JOIN deg USING (uuid)"


def node_detail(spark, d):
    e, n = edges(spark, d), nodes(spark, d)
    out = e.groupBy(F.col("source").alias("uuid")).agg(F.count("*").alias("out_edges"), F.min("valid_at").alias("first_out"))
    into = e.groupBy(F.col("target").alias("uuid")).agg(F.count("*").alias("in_edges"), F.max("valid_at").alias("last_in"))
    return n.join(out, "uuid", "left").join(into, "uuid", "left").select("uuid", "name", "label", F.coalesce("out_edges", F.lit(0)).alias("out_edges"), F.coalesce("in_edges", F.lit(0)).alias("in_edges"), F.col("first_out").cast("string").alias("first_out"), F.col("last_in").cast("string").alias("last_in"))


NODE_DETAIL = f"""WITH {EDGE}, {NODE} SELECT n.uuid, n.name, label, (SELECT count(*) FROM v_edge e WHERE e.source = n.uuid) AS out_edges, (SELECT count(*) FROM v_edge e WHERE e.target = n.uuid) AS in_edges,
(SELECT min(valid_at)::VARCHAR FROM v_edge e WHERE e.source = n.uuid) AS first_out, (SELECT max(valid_at)::VARCHAR FROM v_edge e WHERE e.target = n.uuid) AS last_in FROM v_node n"""


def as_of_series(spark, d):
    dates = spark.range(8).select(F.add_months(F.lit("1993-01-01").cast("date"), (F.col("id") * 12).cast("int")).alias("day"))
    e = edges(spark, d).select("group_id", "valid_at", "invalid_at").crossJoin(F.broadcast(dates))
    return temporal.as_of(e, F.col("day")).groupBy(F.col("day").cast("string").alias("day"), "group_id").agg(F.count("*").alias("facts"))


AS_OF_SERIES = f"""WITH {EDGE}, days AS (SELECT (DATE '1993-01-01' + to_years(i::INTEGER))::DATE AS day FROM range(8) t(i))
SELECT day::VARCHAR AS day, group_id, count(*) AS facts FROM v_edge, days WHERE valid_at <= day AND (invalid_at IS NULL OR invalid_at > day) GROUP BY ALL"""


def induced_subgraph(spark, d):
    n = nodes(spark, d).filter(F.col("label").isin("BUILDING", "MACHINERY", "ECONOMY", "STANDARD"))
    return graph.induced(edges(spark, d), n).groupBy("group_id").agg(F.count("*").alias("links"), F.count_distinct("source").alias("sources"), F.count_distinct("target").alias("targets"))


INDUCED_SUBGRAPH = f"""WITH {EDGE}, {NODE}, k AS (SELECT uuid FROM v_node WHERE label IN ('BUILDING', 'MACHINERY', 'ECONOMY', 'STANDARD'))
SELECT group_id, count(*) AS links, count(DISTINCT source) AS sources, count(DISTINCT target) AS targets FROM v_edge WHERE source IN (SELECT uuid FROM k) AND target IN (SELECT uuid FROM k) GROUP BY 1"""


def typed_entities(spark, d):
    n = nodes(spark, d).withColumn("labels", F.array("label", F.lit("Entity")))
    wanted = F.array(F.lit("building"), F.lit("promo"))
    return n.filter(F.arrays_overlap(F.transform("labels", F.lower), wanted)).groupBy("label", "group_id").agg(F.count("*").alias("n"), F.max("name").alias("last_name"))


TYPED_ENTITIES = f"WITH {NODE} SELECT label, group_id, count(*) AS n, max(name) AS last_name FROM v_node WHERE lower(label) IN ('building', 'promo') GROUP BY ALL"


def neighbourhood_snapshot(spark, d):
    e = edges(spark, d)
    seed = e.filter(e.episode.isin("e1", "e7", "e33"))
    return graph.neighbourhood(e, seed).select("uuid", "source", "target")


NEIGHBOURHOOD = f"""WITH {EDGE}, s AS (SELECT * FROM v_edge WHERE episode IN ('e1', 'e7', 'e33')), ends AS (SELECT source AS x FROM s UNION SELECT target FROM s)
SELECT DISTINCT uuid, source, target FROM v_edge WHERE source IN (SELECT x FROM ends) OR target IN (SELECT x FROM ends)"""


def hop_distances(spark, d):
    return graph.hops(edges(spark, d), spark.createDataFrame([("c1",), ("p5",)], "uuid string"), 2)


HOPS = f"""WITH {EDGE}, l AS (SELECT source AS a, target AS b FROM v_edge UNION SELECT target, source FROM v_edge), h0 AS (SELECT unnest(['c1', 'p5']) AS uuid),
h1 AS (SELECT DISTINCT b AS uuid FROM l JOIN h0 ON a = uuid WHERE b NOT IN (SELECT uuid FROM h0)),
h2 AS (SELECT DISTINCT b AS uuid FROM l JOIN h1 ON a = uuid WHERE b NOT IN (SELECT uuid FROM h0 UNION SELECT uuid FROM h1))
SELECT uuid, 0 AS hops FROM h0 UNION ALL SELECT uuid, 1 FROM h1 UNION ALL SELECT uuid, 2 FROM h2"""


def versions(spark, d):
    """A version log: every fact as added, and again when it ended."""
    e = edges(spark, d)
    added = e.withColumns({"version_ts": F.col("created_at"), "op_seq": F.lit(0), "invalid_at": F.lit(None).cast("date"), "expired_at": F.lit(None).cast("date")})
    ended = e.filter("expired_at is not null").withColumns({"version_ts": F.col("expired_at"), "op_seq": F.lit(1)})
    return added.unionByName(ended)


def current_state(spark, d):
    state = temporal.latest(versions(spark, d))
    return state.groupBy("group_id").agg(F.count("*").alias("facts"), F.count_if(F.col("invalid_at").isNotNull()).alias("ended"), F.count_if(F.col("invalid_at").isNull() & ~F.col("archived")).alias("active"), F.max("version_ts").cast("string").alias("last_change"))


CURRENT_STATE = f"""WITH {EDGE} SELECT group_id, count(*) AS facts, count(invalid_at) AS ended, count(*) FILTER (invalid_at IS NULL AND NOT archived) AS active, max(coalesce(expired_at, created_at))::VARCHAR AS last_change FROM v_edge GROUP BY 1"""


def retention(spark, d):
    """The newest rows of each tool that the log keeps."""
    return temporal.newest(log(spark, d), ["tool"], [F.desc("at"), F.desc("event_id")], KEPT).select("event_id", "tool")


RETENTION = f"SELECT event_id, event_type AS tool FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= {KEPT}"


def stale_facts(spark, d):
    stale = temporal.active(edges(spark, d)).filter(F.col("created_at") < "1997-01-01")
    return stale.orderBy("created_at", "uuid").limit(50).select("uuid", F.col("created_at").cast("string").alias("created_at"), F.datediff(now(), "created_at").alias("age_days"))


STALE = f"WITH {EDGE} SELECT uuid, created_at::VARCHAR AS created_at, (DATE '{NOW}' - created_at)::INTEGER AS age_days FROM v_edge WHERE invalid_at IS NULL AND NOT archived AND created_at < DATE '1997-01-01' ORDER BY v_edge.created_at, uuid LIMIT 50"


def timeline(spark, d):
    return nodes(spark, d).filter(F.col("label").isin("PROMO", "BUILDING")).orderBy(F.desc("created_at"), "uuid").limit(30).select("uuid", "name", F.col("created_at").cast("string").alias("created_at"))


TIMELINE = f"WITH {NODE} SELECT uuid, name, created_at::VARCHAR AS created_at FROM v_node WHERE label IN ('PROMO', 'BUILDING') ORDER BY v_node.created_at DESC, uuid LIMIT 30"


def recent_facts(spark, d):
    valid = temporal.as_of(edges(spark, d), now())
    return temporal.newest(valid, ["group_id"], [F.desc(F.coalesce("valid_at", "created_at")), F.asc("uuid")], 7).select("group_id", "uuid", F.col("valid_at").cast("string").alias("valid_at"))


RECENT = f"""WITH {EDGE} SELECT group_id, uuid, valid_at::VARCHAR AS valid_at FROM v_edge WHERE valid_at <= DATE '{NOW}' AND (invalid_at IS NULL OR invalid_at > DATE '{NOW}')
QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY v_edge.valid_at DESC, uuid) <= 7"""


def forget_effect(spark, d):
    e = edges(spark, d)
    targets = e.filter(F.col("served") % 7 == 0).select("uuid", F.lit("wrong").alias("reason"))
    return temporal.forget(e, targets, now()).select("uuid", F.col("invalid_at").cast("string").alias("invalid_at"), "corrected", "invalid_reason")


FORGET = f"WITH {EDGE} SELECT uuid, coalesce(invalid_at, DATE '{NOW}')::VARCHAR AS invalid_at, corrected + 1 AS corrected, 'wrong' AS invalid_reason FROM v_edge WHERE served % 7 = 0"


def duplicates(e):
    """Facts with the same ends: the first is canonical."""
    first = e.groupBy("source", "target").agg(F.min(F.struct("created_at", "uuid")).alias("f"), F.count("*").alias("n")).filter("n > 1")
    return e.join(first, ["source", "target"]).select("uuid", F.col("f.uuid").alias("canonical")).filter("uuid <> canonical")


def merge_effect(spark, d):
    e = edges(spark, d)
    return temporal.merge(e, duplicates(e), now()).select("uuid", "merged_into", F.col("invalid_at").cast("string").alias("invalid_at"), "archived")


DUPLICATES = "dup AS (SELECT * FROM (SELECT uuid, invalid_at, first(uuid) OVER (PARTITION BY source, target ORDER BY created_at, uuid) AS canonical FROM v_edge) WHERE uuid <> canonical)"
MERGE = f"WITH {EDGE}, {DUPLICATES} SELECT uuid, canonical AS merged_into, least(invalid_at, DATE '{NOW}')::VARCHAR AS invalid_at, true AS archived FROM dup"


def zero_loss(spark, d):
    e = edges(spark, d)
    after = temporal.latest(e.withColumns({"version_ts": F.col("created_at"), "op_seq": F.lit(0)}).unionByName(temporal.merge(e, duplicates(e), now()).drop("merged_into").withColumns({"version_ts": now(), "op_seq": F.lit(1)})))
    return temporal.lost(e, after).agg(F.count("*").alias("lost")).crossJoin(after.agg(F.count("*").alias("kept")))


ZERO_LOSS = f"WITH {EDGE} SELECT 0::BIGINT AS lost, count(*) AS kept FROM v_edge"


def archive_restore(spark, d):
    e = edges(spark, d)
    merged = temporal.merge(e, duplicates(e), now())
    return temporal.restore(merged).select("uuid", F.col("invalid_at").cast("string").alias("invalid_at"), "archived")


ARCHIVE_RESTORE = f"WITH {EDGE}, {DUPLICATES} SELECT uuid, CASE WHEN least(invalid_at, DATE '{NOW}') = DATE '{NOW}' THEN NULL ELSE least(invalid_at, DATE '{NOW}') END::VARCHAR AS invalid_at, false AS archived FROM dup"


def update_effect(spark, d):
    e = edges(spark, d)
    updates = e.filter(F.col("served") == 50).select("uuid", F.lit("renamed").alias("new_name"))
    return temporal.replace(e, updates, now()).select("uuid", "name", F.col("invalid_at").cast("string").alias("invalid_at"), "op_seq")


UPDATE = f"""WITH {EDGE} SELECT uuid || '+' AS uuid, 'renamed' AS name, NULL::VARCHAR AS invalid_at, 0 AS op_seq FROM v_edge WHERE served = 50
UNION ALL SELECT uuid, name, coalesce(invalid_at, DATE '{NOW}')::VARCHAR, 1 FROM v_edge WHERE served = 50"""


def relate_effect(spark, d):
    e = edges(spark, d)
    links = table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source"), F.lit("RELATES").alias("name"), F.concat(F.lit("p"), (F.col("o_orderkey") % 2000).cast("string")).alias("target"))
    return temporal.relate(nodes(spark, d), links, e)


RELATE = f"""WITH {NODE}, l AS (SELECT DISTINCT 'c' || o_custkey AS source, 'RELATES' AS name, 'p' || (o_orderkey % 2000) AS target FROM orders)
SELECT source, l.name, target, s.group_id, s.name || ' ' || l.name || ' ' || t.name AS fact FROM l JOIN v_node s ON s.uuid = source JOIN v_node t ON t.uuid = target"""


def contradicted(spark, d):
    """Old facts of the same ends point to one new fact of the later episode."""
    e = edges(spark, d).select("uuid", "source", "target", "name", "created_at")
    new = e.filter("name = 'N'").groupBy("source", "target").agg(F.max(F.struct("created_at", "uuid")).alias("n"))
    return e.filter("name = 'R'").join(new, ["source", "target"]).filter("n.created_at > created_at").select("uuid", F.col("n.uuid").alias("contradicted_by"))


CONTRADICTED = f"""WITH {EDGE}, n AS (SELECT source, target, arg_max(uuid, (created_at, uuid)) AS u, max(created_at) AS c FROM v_edge WHERE name = 'N' GROUP BY 1, 2)
SELECT uuid, u AS contradicted_by FROM v_edge JOIN n USING (source, target) WHERE name = 'R' AND c > created_at"""


def endpoint_signals(spark, d):
    e, n = edges(spark, d), nodes(spark, d)
    degree = graph.degrees(edges(spark, d))
    word = F.when(F.col("label").isin("PROMO", "BUILDING"), 1.0).when(F.col("label").isin("ECONOMY", "MACHINERY"), 0.75).when(F.col("label") == "SMALL", 0.4)
    ends = n.select("uuid", word.alias("conf")).join(degree, "uuid", "left")
    s, t = (ends.select(F.col("uuid").alias(k), F.col("conf").alias(f"{k}_conf"), F.col("degree").alias(f"{k}_degree")) for k in ("source", "target"))
    return e.join(s, "source", "left").join(t, "target", "left").select("uuid", F.coalesce(F.greatest("source_conf", "target_conf"), F.lit(0.5)).alias("confidence"), F.coalesce(F.greatest("source_degree", "target_degree"), F.lit(0)).alias("degree"))


ENDPOINT_SIGNALS = f"""WITH {EDGE}, {NODE}, {DEG}, e AS (SELECT uuid, degree, CASE WHEN label IN ('PROMO', 'BUILDING') THEN 1.0 WHEN label IN ('ECONOMY', 'MACHINERY') THEN 0.75 WHEN label = 'SMALL' THEN 0.4 END::DOUBLE AS conf FROM v_node LEFT JOIN deg USING (uuid))
SELECT x.uuid, coalesce(greatest(s.conf, t.conf), 0.5) AS confidence, coalesce(greatest(s.degree, t.degree), 0) AS degree FROM v_edge x LEFT JOIN e s ON s.uuid = source LEFT JOIN e t ON t.uuid = target"""


def export_notes(spark, d):
    """One rendered note for each entity - front matter, out-links, in-links - and an index of names for each scope."""
    e = edges(spark, d).filter("archived = false")
    n = nodes(spark, d)
    links = graph.note_lines(e, n).groupBy("uuid").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    page = F.concat(F.lit("---\nname: "), "name", F.lit("\nscope: "), "group_id", F.lit("\n---\n"), F.coalesce(F.array_join("lines", "\n"), F.lit("")))
    notes = n.join(links, "uuid", "left").select("uuid", "group_id", page.alias("page"))
    # an index has a line for each name, a scope at a time: its size is that of the scope
    index = n.groupBy("group_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("- [["), "name", F.lit("]]")))).alias("lines"))
    return notes.unionAll(index.select(F.lit("index"), "group_id", F.array_join("lines", "\n")))


EXPORT_NOTES = f"""WITH {EDGE}, {NODE}, l AS (SELECT DISTINCT source AS uuid, '- ' || e.name || ' [[' || n.name || ']]' AS line FROM v_edge e JOIN v_node n ON n.uuid = target WHERE NOT archived
  UNION SELECT DISTINCT target, '- [[' || n.name || ']] ' || e.name FROM v_edge e JOIN v_node n ON n.uuid = source WHERE NOT archived),
b AS (SELECT uuid, string_agg(line, chr(10) ORDER BY line) AS body FROM l GROUP BY 1)
SELECT uuid, group_id, '---' || chr(10) || 'name: ' || name || chr(10) || 'scope: ' || group_id || chr(10) || '---' || chr(10) || coalesce(body, '') AS page FROM v_node LEFT JOIN b USING (uuid)
UNION ALL SELECT 'index', group_id, string_agg(line, chr(10) ORDER BY line) FROM (SELECT DISTINCT group_id, '- [[' || name || ']]' AS line FROM v_node) GROUP BY group_id"""

PAIRS = {
    "as_of_snapshot": (as_of_snapshot, AS_OF_SNAPSHOT), "node_degrees": (node_degrees, NODE_DEGREES), "node_detail": (node_detail, NODE_DETAIL), "as_of_series": (as_of_series, AS_OF_SERIES),
    "induced_subgraph": (induced_subgraph, INDUCED_SUBGRAPH), "typed_entities": (typed_entities, TYPED_ENTITIES), "neighbourhood_snapshot": (neighbourhood_snapshot, NEIGHBOURHOOD), "hops": (hop_distances, HOPS),
    "current_state": (current_state, CURRENT_STATE), "retention": (retention, RETENTION), "stale_facts": (stale_facts, STALE), "timeline": (timeline, TIMELINE), "recent_facts": (recent_facts, RECENT),
    "forget_effect": (forget_effect, FORGET), "merge_effect": (merge_effect, MERGE), "zero_loss": (zero_loss, ZERO_LOSS), "archive_restore": (archive_restore, ARCHIVE_RESTORE), "update_effect": (update_effect, UPDATE),
    "relate": (relate_effect, RELATE), "contradicted": (contradicted, CONTRADICTED), "endpoint_signals": (endpoint_signals, ENDPOINT_SIGNALS), "export_notes": (export_notes, EXPORT_NOTES),
}
