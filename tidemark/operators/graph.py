"""Degrees, views and neighbourhoods of the fact graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.shared import Scratch, saved


def degrees(facts: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """(uuid, degree) over all facts, undirected; a self-loop counts once; isolated entities have 0."""
    ends = facts.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("uuid")).groupBy("uuid").agg(F.count("*").alias("degree"))
    if entities is None:
        return ends
    return entities.select("uuid").join(ends, "uuid", "left").select("uuid", F.coalesce("degree", F.lit(0)).alias("degree"))


def induced(facts: DataFrame, kept: DataFrame) -> DataFrame:
    """Facts whose two ends are in ``kept`` (uuid)."""
    return facts.join(kept.select(F.col("uuid").alias("source")), "source", "left_semi").join(kept.select(F.col("uuid").alias("target")), "target", "left_semi")


def snapshot(facts: DataFrame, valid: DataFrame, top_nodes: int) -> tuple[DataFrame, DataFrame]:
    """The nodes of highest degree over all facts, and the valid facts among them."""
    top = degrees(facts).orderBy(F.desc("degree"), "uuid").limit(top_nodes)
    return top, induced(valid, top)


def neighbourhood(facts: DataFrame, seed: DataFrame) -> DataFrame:
    """Facts that touch an end of the seed facts (uuid)."""
    ends = facts.join(seed.select("uuid"), "uuid", "left_semi").select(F.explode(F.array("source", "target")).alias("end")).distinct()
    near = facts.join(ends.select(F.col("end").alias("source")), "source", "left_semi").unionByName(facts.join(ends.select(F.col("end").alias("target")), "target", "left_semi"))
    return near.dropDuplicates(["uuid"])


def hops(facts: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(uuid, hops) of what ``start`` (uuid) reaches over undirected facts in up to ``depth`` steps."""
    links = facts.select(F.col("source").alias("a"), F.col("target").alias("b")).unionAll(facts.select(F.col("target"), F.col("source"))).distinct()
    seen = frontier = start.select("uuid", F.lit(0).alias("hops"))
    for step in range(1, depth + 1):
        frontier = frontier.join(links, F.col("uuid") == F.col("a")).select(F.col("b").alias("uuid")).distinct().join(seen.select("uuid"), "uuid", "left_anti").withColumn("hops", F.lit(step))
        seen = seen.unionAll(frontier)
    return seen


def hops_from(facts: DataFrame, centres: DataFrame, depth: int, scratch: Scratch | None = None) -> DataFrame:
    """(query, uuid, hops) of what each query's centres (query, uuid) reach over undirected facts in up to ``depth`` steps.

    Many searches run as one: each has its own frontier and its own visited nodes, as rows keyed by query. Every step is written, so a step
    neither repeats the ones before nor hangs on a lost executor's blocks. Facts are neither turned round nor made distinct, since that would
    shuffle all of them: a step goes along them once each way. Null ends of facts and null centres lead nowhere.
    """
    with Scratch(facts.sparkSession) as own:
        links = own.saved(facts.select("source", "target").filter("source is not null and target is not null and source <> target"))
        frontier = own.saved(centres.filter("query is not null and uuid is not null").select("query", "uuid").distinct().withColumn("hops", F.lit(0)))
        seen = frontier
        for step in range(1, depth + 1):
            at = frontier.select("query", F.col("uuid").alias("_at"))
            there, back = (at.join(links, F.col("_at") == F.col(a)).select("query", F.col(b).alias("uuid")) for a, b in (("source", "target"), ("target", "source")))
            near = there.unionAll(back).distinct()
            frontier = own.saved(near.join(seen.select("query", "uuid"), ["query", "uuid"], "left_anti").withColumn("hops", F.lit(step)))
            seen = seen.unionAll(frontier)
        return scratch.saved(seen) if scratch else saved(seen)


# Properties of an entity that are shown by themselves and not among its attributes; embeddings are no attributes either.
CORE = ("uuid", "name", "summary", "group_id", "created_at", "labels")


def attributes(props: Column) -> Column:
    """A map of properties without the core ones, embeddings, and nulls; null becomes empty."""
    empty = F.create_map().cast("map<string,string>")
    return F.map_filter(F.coalesce(props, empty), lambda k, v: ~k.isin(*CORE) & ~F.endswith(k, F.lit("_embedding")) & v.isNotNull())


def details(entities: DataFrame, facts: DataFrame, shown: int = 50) -> DataFrame:
    """Each entity (uuid, name, summary, group_id, labels, props) with attributes, degree, numbers of facts out and in, and the newest ``shown`` of both.

    Facts count whatever their time. ``edges_out`` and ``edges_in`` are arrays of (valid_at, uuid, other, name), newest first; the limit runs before
    the shuffle, so an entity with a third of all facts is no large group, and ``links_of`` has all of them as rows. A self-loop
    is in both lists and counts once in the degree; facts without an end are not listed at that end. Rows of entities come back as given.
    """

    def side(end: str, other: str, name: str) -> tuple[DataFrame, DataFrame]:
        own = facts.filter(F.col(end).isNotNull())
        order = [F.desc_nulls_last("valid_at"), F.asc("uuid")]
        top = own.withColumn("_rank", F.row_number().over(W.partitionBy(end).orderBy(*order))).filter(F.col("_rank") <= shown)
        fact = F.struct("valid_at", "uuid", F.col(other).alias("other"), "name")
        lists = top.groupBy(end).agg(F.array_sort(F.collect_list(F.struct("_rank", fact.alias("fact")))).alias("_l")).select(F.col(end).alias("uuid"), F.transform("_l", lambda x: x["fact"]).alias(f"edges_{name}"))
        return own.groupBy(F.col(end).alias("uuid")).agg(F.count("*").alias(f"n_{name}"), F.count_if(F.col("source") == F.col("target")).alias(f"_loops_{name}")), lists

    whole = entities
    for end, other, name in (("source", "target", "out"), ("target", "source", "in")):
        for part in side(end, other, name):
            whole = whole.join(part, "uuid", "left")
    n = {name: F.coalesce(f"n_{name}", F.lit(0)) for name in ("out", "in")}
    degree = n["out"] + n["in"] - F.coalesce("_loops_out", F.lit(0))
    none = "array<struct<valid_at:date,uuid:string,other:string,name:string>>"
    lists = [F.coalesce(f"edges_{x}", F.array().cast(none)).alias(f"edges_{x}") for x in ("out", "in")]
    return whole.select("uuid", "name", "summary", "group_id", "labels", attributes(F.col("props")).alias("attributes"), degree.alias("degree"), n["out"].alias("n_out"), n["in"].alias("n_in"), *lists)


def links_of(ids: DataFrame, facts: DataFrame) -> DataFrame:
    """(uuid, direction, other, name, fact): all facts of the asked entities (uuid), one row for each end that is asked for."""
    asked = ids.select("uuid").distinct()
    listed = facts.select(F.col("uuid").alias("fact"), "name", F.explode(F.array(F.struct(F.col("source").alias("uuid"), F.lit("out").alias("direction"), F.col("target").alias("other")), F.struct(F.col("target").alias("uuid"), F.lit("in").alias("direction"), F.col("source").alias("other")))).alias("e"))
    return listed.select("e.uuid", "e.direction", "e.other", "name", "fact").join(asked, "uuid", "left_semi")


def note_lines(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """(uuid, line): the distinct out-links and in-links of each entity, as lines of its note."""
    names = entities.select(F.col("uuid").alias("_id"), F.col("name").alias("_to"))
    out = facts.join(names, F.col("target") == F.col("_id")).select(F.col("source").alias("uuid"), F.concat(F.lit("- "), "name", F.lit(" [["), "_to", F.lit("]]")).alias("line"))
    into = facts.join(names, F.col("source") == F.col("_id")).select(F.col("target").alias("uuid"), F.concat(F.lit("- [["), "_to", F.lit("]] "), "name").alias("line"))
    return out.unionAll(into).distinct()
