"""Facts and the episodes they came from: containment in lists, and who wrote what."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WRITER = ["agent", "session", "model", "host"]


def _mentions(facts: DataFrame) -> DataFrame:
    """(fact, fact_scope, _episode): a row of each entry of each list, once a list."""
    return facts.select(F.col("uuid").alias("fact"), F.col("group_id").alias("fact_scope"), F.explode(F.array_distinct("episodes")).alias("_episode")).filter("_episode is not null")


def derived(episodes: DataFrame, facts: DataFrame) -> DataFrame:
    """Each episode with every fact whose list ``episodes`` holds it, once; episodes without facts stay with a null ``fact``.

    ``episodes``: (uuid, ...); ``facts``: (uuid, group_id, episodes: array). An equi join on the exploded lists, so it shuffles one row of each
    mention. Null lists, null entries and entries that name no episode give nothing.
    """
    named = _mentions(facts).distinct()
    return episodes.join(named, episodes["uuid"] == named["_episode"], "left").drop("_episode")


def written(episodes: DataFrame, facts: DataFrame) -> DataFrame:
    """For each writer (agent, session, model, host; nulls are a group): distinct episodes and facts, scopes, first and last write.

    ``episodes``: (uuid, agent, session, model, host, at). A fact of several episodes counts for each of their writers.
    """
    own = episodes.groupBy(*WRITER).agg(F.count_distinct("uuid").alias("episodes"), F.min("at").alias("first_write"), F.max("at").alias("last_write"))
    # a mention is shuffled to its episode and to its writer's fact; two distinct counts at once would make three rows of each
    named = _mentions(facts)
    found = episodes.select("uuid", *WRITER).join(named, episodes["uuid"] == named["_episode"])
    facts_of = found.groupBy(*WRITER, "fact").agg(F.collect_set("fact_scope").alias("_scopes"))
    theirs = facts_of.groupBy(*WRITER).agg(F.count("fact").alias("facts"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_scopes")))).alias("scopes"))
    theirs = theirs.select(*(F.col(c).alias(f"_{c}") for c in WRITER), "facts", "scopes")
    both = own.join(theirs, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in WRITER)), "left")
    return both.select(*WRITER, "episodes", F.coalesce("facts", F.lit(0).cast("long")).alias("facts"), F.coalesce("scopes", F.array().cast("array<string>")).alias("scopes"), "first_write", "last_write")
