"""Indexed similarity with its measured recall, and re-embedding."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import index, reembed, vectors
from tidemark.sources.shared import remove, saved, shared_dir
from tidemark.sources.views import FACT, table
from tidemark.sources.views import vectors as v_fact

#: Similarity of the pairs, bits of a bucket, neighbours, and about the similarity of the last of them.
FLOOR, BITS, K, LAST = 0.30, 3, 8, 0.15
#: Recall that the tables are chosen for, and the least that is accepted.
SOUGHT, LEAST_RECALL, EVERY = 0.98, 0.9, 100
SIZE = 64


def similar_pairs_indexed(spark, d):
    """J4 by the index: pairs that share a bucket, compared exactly."""
    found = index.similar_pairs(v_fact(spark, d), FLOOR, BITS, index.tables_for(BITS, FLOOR, SOUGHT))
    return found.select("group_id", "a", "b", F.round("sim", 6).alias("sim"))


def with_recall(got):
    """Exact rows by scope, and whether the index has at least nine in ten of all."""
    got = saved(got)
    whole = got.agg((F.sum("found") >= LEAST_RECALL * F.sum("exact")).alias("reached"))
    return got.select("group_id", "exact").crossJoin(F.broadcast(whole))


def index_recall(spark, d):
    """Of each scope the exact number of similar pairs, and the recall of the index."""
    facts = v_fact(spark, d)
    found = index.similar_pairs(facts, FLOOR, BITS, index.tables_for(BITS, FLOOR, SOUGHT))
    return with_recall(index.recall_of(vectors.similar_pairs(facts, FLOOR), found, ["group_id", "a", "b"]))


_SIMS = f"WITH {FACT}, sims AS (SELECT a.group_id, a.uuid AS a, b.uuid AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM v_fact a JOIN v_fact b ON a.group_id = b.group_id AND a.uuid < b.uuid)"
RECALL = f"{_SIMS} SELECT group_id, count(*) AS exact, true AS reached FROM sims WHERE sim >= {FLOOR} GROUP BY 1"


def neighbour_recall(spark, d):
    """Exact neighbours of every hundredth fact, by scope, and the recall of the index."""
    facts = v_fact(spark, d)
    asked = facts.filter(F.col("uuid") % EVERY == 0)
    found = index.nearest(facts, asked, K, BITS, index.tables_for(BITS, LAST, SOUGHT))
    return with_recall(index.recall_of(vectors.nearest(facts, asked, K), found, ["query", "uuid"]))


NEIGHBOURS = f"WITH {FACT}, n AS (SELECT group_id, count(*) - 1 AS n FROM v_fact GROUP BY 1) SELECT group_id, sum(least(n, {K}))::BIGINT AS exact, true AS reached FROM v_fact JOIN n USING (group_id) WHERE uuid % {EVERY} = 0 GROUP BY 1"


def reembed_coverage(spark, d):
    """Rows that lack a whole vector before and after a run, and whether a sample of the new ones is what the embedder gives again."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    n = docs.agg(F.count("*").alias("n"))
    e = table(spark, d, "embeddings").crossJoin(F.broadcast(n)).withColumn("doc_id", F.pmod("vec_id", "n")).join(docs, "doc_id")
    broken = F.when(F.col("vec_id") % 11 == 0, None).when(F.col("vec_id") % 13 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    facts = e.select(F.col("vec_id").alias("uuid"), "label", F.coalesce("text", F.lit("")).alias("text"), broken.alias("embedding"))
    path, embed = shared_dir(spark), reembed.hashing_embedder(SIZE)
    reembed.apply(facts, path, embed, SIZE)
    made = spark.read.schema("uuid long, embedding array<float>").parquet(path)
    after = reembed.with_new(facts.drop("text"), made, SIZE)
    same = reembed.verified(facts, made, embed, SIZE).agg(F.bool_and("same").alias("verified"))
    gap = F.count_if(reembed.lacking("embedding", SIZE))
    both = facts.groupBy("label").agg(F.count("*").alias("rows"), gap.alias("before")).join(after.groupBy("label").agg(gap.alias("after")), "label")
    out = saved(both.crossJoin(F.broadcast(same)).select("label", "rows", "before", "after", "verified"))
    remove(spark, path)
    return out


COVERAGE = "SELECT label, count(*) AS rows, count(*) FILTER (vec_id % 11 = 0 OR vec_id % 13 = 0) AS before, 0::BIGINT AS after, true AS verified FROM embeddings GROUP BY 1"

PAIRS = {
    "similar_pairs_indexed": (similar_pairs_indexed, None),
    "index_recall": (index_recall, RECALL),
    "neighbour_recall": (neighbour_recall, NEIGHBOURS),
    "reembed_coverage": (reembed_coverage, COVERAGE),
}
