"""Admission with vectors and a judge, the guard of writes and its variants, re-embedding."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import admission
from tidemark.plans.report_queries import _HASH, content_hash
from tidemark.sources.views import FACT, table
from tidemark.sources.views import vectors as v_fact

DUPLICATE, RELATED = 0.35, 0.25
EVERY = 5


def hashed_facts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    n = docs.agg(F.count("*").alias("n"))
    f = v_fact(spark, d).crossJoin(F.broadcast(n)).withColumn("doc_id", F.pmod("uuid", "n"))
    return f.join(docs, "doc_id").select("uuid", "group_id", "embedding", "text", content_hash("text").alias("hash"))


def admission_verdicts(spark, d):
    """Every fifth fact comes in against the others; the judge's word depends on the pair."""
    facts = hashed_facts(spark, d)
    batch, known = facts.filter(F.col("uuid") % EVERY == 0), facts.filter(F.col("uuid") % EVERY != 0)
    near = admission.vectors.nearest(known, batch, admission.JUDGED).select("query", "uuid")
    word = F.when((F.col("query") + F.col("uuid")) % 3 == 0, "duplicate").when((F.col("query") + F.col("uuid")) % 3 == 1, "contradiction").otherwise("related")
    return admission.admit(batch, known, near.withColumn("relation", word), DUPLICATE, RELATED)


ADMIT = f"""WITH {FACT}, n AS (SELECT count(*) AS n FROM documents), f AS (SELECT v.*, {_HASH.replace('content', 'text')} AS h FROM v_fact v CROSS JOIN n JOIN documents ON doc_id = uuid % n),
b AS (SELECT *, min(uuid) OVER (PARTITION BY group_id, h) AS first FROM f WHERE uuid % {EVERY} = 0), o AS (SELECT group_id, h, min(uuid) AS known FROM f WHERE uuid % {EVERY} <> 0 GROUP BY 1, 2),
s AS (SELECT a.uuid AS query, c.uuid, round(list_cosine_similarity(a.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS sim FROM b a JOIN f c ON c.group_id = a.group_id AND c.uuid % {EVERY} <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, uuid) AS k FROM s QUALIFY k <= 3),
g AS (SELECT query, min(uuid) FILTER (k = 1 AND sim >= {DUPLICATE}) AS close, arg_min(uuid, k) FILTER (sim >= {RELATED} AND sim < {DUPLICATE} AND (query + uuid) % 3 = 0) AS same, arg_min(uuid, k) FILTER (sim >= {RELATED} AND sim < {DUPLICATE} AND (query + uuid) % 3 = 1) AS against FROM r GROUP BY 1)
SELECT b.uuid, CASE WHEN known IS NOT NULL OR first <> b.uuid OR close IS NOT NULL OR same IS NOT NULL THEN 'duplicate' ELSE 'distinct' END AS verdict,
  CASE WHEN known IS NOT NULL THEN known WHEN first <> b.uuid THEN first ELSE coalesce(close, same, against) END AS other,
  CASE WHEN known IS NOT NULL THEN 'hash' WHEN first <> b.uuid THEN 'hash in batch' WHEN close IS NOT NULL THEN 'vector' WHEN same IS NOT NULL THEN 'judge' WHEN against IS NOT NULL THEN 'contradiction' END AS why
FROM b LEFT JOIN o USING (group_id, h) LEFT JOIN g ON g.query = b.uuid"""


def line_facts(spark, d):
    """Order lines as facts of one write each: returned ones are what the write retires, the rest is what it writes."""
    l, o, p = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "part")
    fact = F.concat_ws(" ", F.lit("The"), "p_name", F.lit("part of"), "p_brand", F.lit("costs"), F.col("l_extendedprice").cast("decimal(12,2)").cast("string"), F.lit("USD"))
    rows = l.join(o, l.l_orderkey == o.o_orderkey).join(p, l.l_partkey == p.p_partkey)
    return rows.select(F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))).alias("uuid"), F.col("l_orderkey").alias("episode"), F.col("o_custkey").alias("source"), F.col("l_partkey").alias("target"), F.col("p_type").alias("name"), fact.alias("fact"), "l_returnflag", (F.col("l_discount") > 0.05).alias("right"))


def write_guard(spark, d):
    """M6: each retirement of each write, whether it stands, by both halves, and why the others are undone; those of writes without new facts stand unjudged."""
    f = line_facts(spark, d)
    verdicts = admission.guard(f.filter("l_returnflag = 'R'"), f.filter("l_returnflag <> 'R'"), "episode", whole=True)
    return verdicts.select("episode", "uuid", "structural", "lexical", F.coalesce(F.col("structural") & F.col("lexical"), F.lit(True)).alias("stands"), "reason")


def guard_variants(spark, d):
    """Silent losses and stale facts under six rules; a discount stands for the label."""
    f = line_facts(spark, d)
    retired = f.filter("l_returnflag = 'R'")
    return admission.variants(admission.guard(retired, f.filter("l_returnflag <> 'R'"), "episode"), retired.select("uuid", "right"))


PAIRS = {"admission_verdicts": (admission_verdicts, ADMIT), "write_guard": (write_guard, None), "guard_variants": (guard_variants, None)}
