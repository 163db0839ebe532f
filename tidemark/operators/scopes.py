"""Scopes by the names that texts mention: mentions, the better scope than global, redirected writes, refiled facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.temporal import active

GLOBAL = "global"
#: A word: letters, digits, marks and underscores of any script.
WORD = r"(?U)\w+"


def mentions(texts: DataFrame, names: DataFrame, text: str = "text", key: str = "uuid") -> DataFrame:
    """(key, name): the names (name, ...) that occur in each text as whole words, in any case; each pair once.

    A join on the first word of a name finds candidates, without the texts; names of one word are settled by it, others are looked for in
    the text. Null and empty texts mention nothing, nor is a name without a word ever mentioned. Rows of one key count as one text; rows
    without a key are left out.
    """
    known = names.select("name").distinct().withColumn("word", F.lower(F.regexp_extract("name", f"({WORD})", 1))).filter("word <> ''")
    plain = F.lower("name") == F.col("word")
    words = texts.filter(F.col(key).isNotNull()).select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1))).alias("word"))
    # the planner takes the words for as small as their texts, and would send them all to the driver
    met = words.join(known.withColumn("plain", plain).hint("merge"), "word").select(key, "name", "plain")
    longer = met.filter(~F.col("plain")).select(key, "name").distinct().join(texts.select(key, F.col(text).alias("_text")), key)
    # the name stands for itself, between word boundaries
    pattern = F.concat(F.lit(r"(?iU)\b\Q"), F.replace("name", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))
    return met.filter("plain").select(key, "name").unionAll(longer.filter(F.regexp_like("_text", pattern)).select(key, "name")).distinct()


def better_scope(texts: DataFrame, registry: DataFrame, text: str = "text", key: str = "uuid") -> DataFrame:
    """(key, target, named) of the texts that belong to a narrower scope than global, told by the projects that they name.

    ``registry``: (name, cluster), of which a repeated name keeps its least cluster. One name: that project. Several of one cluster: the cluster. Several of more
    clusters, or any without one beside others: the text stays global and has no row, as texts that name nothing have none. What is
    gathered for a text are a count and extremes, however many projects it names.
    """
    projects = registry.filter("name is not null").groupBy("name").agg(F.min("cluster").alias("cluster"))
    named = mentions(texts, projects, text, key).join(projects, "name").groupBy(key).agg(
        F.count("*").alias("named"), F.min("name").alias("_one"), F.min("cluster").alias("_low"), F.max("cluster").alias("_high"), F.count("cluster").alias("_with"),
    )
    alone = (F.col("_low") == F.col("_high")) & (F.col("_with") == F.col("named"))
    target = F.when(F.col("named") == 1, F.concat(F.lit("project_"), "_one")).when(alone, F.concat(F.lit("cluster_"), "_low"))
    return named.select(key, target.alias("target"), "named").filter("target is not null")


def requested(agent: Column, cluster: Column, project: Column) -> Column:
    """The scope that a write asks for: its agent's, else its cluster's, else its project's, else global. Empty strings count as null."""
    first = [F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f"{kind}_"), x)) for kind, x in (("agent", agent), ("cluster", cluster), ("project", project))]
    return F.coalesce(*first, F.lit(GLOBAL))


def redirected(writes: DataFrame, registry: DataFrame, trusted: list[str], text: str = "text", key: str = "uuid") -> DataFrame:
    """The writes (key, text, group_id, source, ...) with global ones of untrusted sources sent to their better scope.

    Adds ``redirected_from``, null where the scope stays. A null source is not trusted; a null scope stays.
    """
    doubtful = writes.filter((F.col("group_id") == GLOBAL) & ~F.coalesce(F.col("source").isin(trusted), F.lit(False)))
    plan = better_scope(doubtful, registry, text, key).select(key, F.col("target").alias("_to"))
    joined = writes.join(plan, key, "left")
    moves = F.col("_to").isNotNull() & (F.col("group_id") == GLOBAL) & ~F.coalesce(F.col("source").isin(trusted), F.lit(False))
    return joined.withColumns({"redirected_from": F.when(moves, F.lit(GLOBAL)), "group_id": F.when(moves, F.col("_to")).otherwise(F.col("group_id"))}).drop("_to")


def refiled(facts: DataFrame, registry: DataFrame, text: str = "fact") -> DataFrame:
    """Versions of the active global facts that have a better scope, under it and with ``scope_refiled_from``; entities stay where they are.

    What is refiled is global no more, so refiling again gives no rows. It is the rule of the writes, so a write gate lets none of them back.
    """
    live = active(facts).filter(F.col("group_id") == GLOBAL)
    plan = better_scope(live, registry, text).select("uuid", F.col("target").alias("_to"))
    return live.join(plan, "uuid").withColumns({"group_id": F.col("_to"), "scope_refiled_from": F.lit(GLOBAL)}).drop("_to")
