"""Scopes told by the names in texts, and the whole detail of entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import graph, scopes
from tidemark.sources.views import EDGE, edges, table

#: Sources whose global writes stay global.
TRUSTED = ["assistant"]


def registry(spark, d):
    """Projects, named by the first words of benchmark items (one, and two); short items of one line have a cluster by their length."""
    b = table(spark, d, "benchmark")
    names = F.array(F.regexp_extract("text", "^([A-Za-z]{4,})", 1), F.regexp_extract("text", "^([A-Za-z]+ [A-Za-z]+)", 1))
    cluster = F.when(~F.contains(F.col("text"), F.lit("\n")), F.concat(F.lit("size_"), F.floor(F.length("text") / 200).cast("string")))
    return b.select(F.explode(names).alias("name"), cluster.alias("cluster")).filter("name <> ''")


_REGISTRY = r"""registry AS (SELECT name, min(cluster) AS cluster FROM (SELECT unnest([regexp_extract(text, '^([A-Za-z]{4,})', 1), regexp_extract(text, '^([A-Za-z]+ [A-Za-z]+)', 1)]) AS name,
  CASE WHEN NOT contains(text, chr(10)) THEN 'size_' || (length(text) // 200) END AS cluster FROM benchmark) WHERE name <> '' GROUP BY 1)"""
# of the texts ``said`` (uuid, text) and the registry: the pairs of which the text names the project, and the scope that follows
_BETTER = _REGISTRY + r""", words AS (SELECT DISTINCT uuid, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')) AS word FROM said),
named AS (SELECT DISTINCT uuid, name FROM (SELECT uuid, name FROM words JOIN registry ON word = lower(name) UNION ALL
  SELECT s.uuid, name FROM words w JOIN registry ON word = split_part(lower(name), ' ', 1) AND contains(name, ' ') JOIN said s ON s.uuid = w.uuid WHERE regexp_matches(s.text, '(?i)(^|[^\p{L}\p{M}\p{N}_])' || name || '($|[^\p{L}\p{M}\p{N}_])'))),
better AS (SELECT uuid, CASE WHEN count(*) = 1 THEN 'project_' || min(name) WHEN count(cluster) = count(*) AND min(cluster) = max(cluster) THEN 'cluster_' || min(cluster) END AS target, count(*) AS named FROM named JOIN registry USING (name) GROUP BY 1)"""


def statements(spark, d):
    """Documents as global facts; those that a label calls toxic are archived."""
    toxic = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return table(spark, d, "documents").join(toxic, "doc_id", "left").select(F.col("doc_id").alias("uuid"), F.col("text").alias("fact"), F.lit(scopes.GLOBAL).alias("group_id"), F.lit(None).cast("date").alias("invalid_at"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("archived"))


def project_mentions(spark, d):
    """J11 on whole documents: how many of them name each project."""
    said = table(spark, d, "documents").select(F.col("doc_id").alias("uuid"), "text")
    return scopes.mentions(said, registry(spark, d)).groupBy("name").agg(F.count("*").alias("texts"))


def refile_by_names(spark, d):
    """The better scope of each global fact that names projects."""
    return scopes.better_scope(statements(spark, d).filter("not archived"), registry(spark, d), "fact").select("uuid", "target", "named")


_ACTIVE = "WITH said AS (SELECT doc_id AS uuid, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)), "


def refile_versions(spark, d):
    """M8: that plan carried out, as versions of the facts that move."""
    return scopes.refiled(statements(spark, d), registry(spark, d)).select("uuid", "group_id", "scope_refiled_from", F.length("fact").alias("chars"))


def redirected_writes(spark, d):
    """Turns as writes, by their scope and what the gate makes of it; long ones ask for their role's project."""
    c = table(spark, d, "conversations")
    none = F.lit(None).cast("string")
    asked = scopes.requested(none, none, F.when(F.length("text") > 400, F.col("role")))
    writes = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("uuid"), "text", F.col("role").alias("source"), asked.alias("group_id"))
    return scopes.redirected(writes, registry(spark, d), TRUSTED).select("uuid", "group_id", "redirected_from")


REDIRECTED = "WITH writes AS (SELECT conv_id * 1000 + turn AS uuid, text, role, CASE WHEN length(text) > 400 AND role <> '' THEN 'project_' || role ELSE 'global' END AS g FROM conversations), said AS (SELECT uuid, text FROM writes WHERE g = 'global' AND role IS DISTINCT FROM 'assistant'), " + _BETTER + """
SELECT w.uuid, coalesce(target, g) AS group_id, CASE WHEN target IS NOT NULL THEN 'global' END AS redirected_from FROM writes w LEFT JOIN better b ON b.uuid = w.uuid"""

#: Facts of an entity that its detail lists.
SHOWN = 5


def node_records(spark, d):
    """Customers with their attributes (all but core properties and embeddings), degree and newest facts; the lists as text."""
    c = table(spark, d, "customer")
    props = {"uuid": F.col("c_custkey").cast("string"), "name": F.col("c_name"), "balance": F.floor("c_acctbal").cast("string"), "nation": F.col("c_nationkey").cast("string"), "name_embedding": F.lit("0.1"), "segment": F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment"))}
    entity = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("uuid"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("summary"), F.concat(F.lit("project_"), F.col("c_nationkey").cast("string")).alias("group_id"), F.array(F.lit("Entity")).alias("labels"), F.create_map(*(x for k, v in props.items() for x in (F.lit(k), v))).alias("props"))
    told = graph.details(entity, edges(spark, d), SHOWN)
    return told.select("uuid", F.array_join(F.transform(F.array_sort(F.map_keys("attributes")), lambda k: F.concat(k, F.lit("="), F.col("attributes")[k])), ";").alias("attributes"), "degree", "n_out", "n_in", F.array_join(F.transform("edges_out", lambda e: F.concat_ws(" ", e["valid_at"].cast("string"), e["name"], e["other"])), ";").alias("newest"))


RECORDS = f"""WITH {EDGE}, top AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY valid_at DESC, uuid) AS r FROM v_edge QUALIFY r <= {SHOWN}), l AS (SELECT source, string_agg(valid_at || ' ' || name || ' ' || target, ';' ORDER BY r) AS newest FROM top GROUP BY 1), n AS (SELECT source, count(*) AS n FROM v_edge GROUP BY 1)
SELECT 'c' || c_custkey AS uuid, 'balance=' || floor(c_acctbal)::BIGINT || ';nation=' || c_nationkey || CASE WHEN c_acctbal > 0 THEN ';segment=' || c_mktsegment ELSE '' END AS attributes, coalesce(n, 0) AS degree, coalesce(n, 0) AS n_out, 0::BIGINT AS n_in, coalesce(newest, '') AS newest
FROM customer LEFT JOIN l ON l.source = 'c' || c_custkey LEFT JOIN n ON n.source = 'c' || c_custkey"""


def node_links(spark, d):
    """All facts of the customers in debt, as rows."""
    asked = table(spark, d, "customer").filter("c_acctbal < 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("uuid"))
    return graph.links_of(asked, edges(spark, d))


LINKS = f"WITH {EDGE} SELECT source AS uuid, 'out' AS direction, target AS other, name, v_edge.uuid AS fact FROM v_edge JOIN customer ON source = 'c' || c_custkey WHERE c_acctbal < 0"

PAIRS = {
    "project_mentions": (project_mentions, "WITH said AS (SELECT doc_id AS uuid, text FROM documents), " + _BETTER + " SELECT name, count(*) AS texts FROM named GROUP BY 1"),
    "refile_by_names": (refile_by_names, _ACTIVE + _BETTER + " SELECT uuid, target, named FROM better WHERE target IS NOT NULL"),
    "refile_versions": (refile_versions, _ACTIVE + _BETTER + " SELECT uuid, target AS group_id, 'global' AS scope_refiled_from, length(text)::INTEGER AS chars FROM better JOIN said USING (uuid) WHERE target IS NOT NULL"),
    "redirected_writes": (redirected_writes, REDIRECTED),
    "node_records": (node_records, RECORDS),
    "node_links": (node_links, LINKS),
}
