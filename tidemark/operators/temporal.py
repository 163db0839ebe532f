"""Validity predicates, the version log, and state changes that append versions and never delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of(facts: DataFrame, at: Column) -> DataFrame:
    """Facts valid at ``at`` (a literal, or a column so that many dates run in one job); open bounds always hold."""
    return facts.filter((F.col("valid_at").isNull() | (F.col("valid_at") <= at)) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > at)))


def active(facts: DataFrame) -> DataFrame:
    """Facts without an end, not archived."""
    return facts.filter(F.col("invalid_at").isNull() & ~F.coalesce(F.col("archived"), F.lit(False)))


def latest(log: DataFrame, key: str = "uuid", version: str = "version_ts", seq: str = "op_seq") -> DataFrame:
    """Current state of a version log: the last version of each key. All but a task's last version of a key go before the shuffle."""
    order = W.partitionBy(key).orderBy(F.desc(version), F.desc(seq))
    return log.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") == 1).drop("_rank")


def compact(log: DataFrame, path: str) -> None:
    """Write the current state, one folder for each scope."""
    latest(log).repartition("group_id", F.pmod(F.xxhash64("uuid"), F.lit(16))).write.partitionBy("group_id").parquet(path)


def newest(df: DataFrame, per: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each group; the limit runs before the shuffle as well."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*per).orderBy(*order))).filter(F.col("_rank") <= limit).drop("_rank")


def forget(facts: DataFrame, targets: DataFrame, now: Column) -> DataFrame:
    """Versions that end the targeted facts (uuid, reason): the first end and reason win, each call counts a correction."""
    return facts.join(targets.groupBy("uuid").agg(F.min("reason").alias("_why"), F.count("*").alias("_times")), "uuid").withColumns({
        "invalid_reason": F.coalesce(F.col("invalid_reason"), F.col("_why")) if "invalid_reason" in facts.columns else F.col("_why"),
        "invalid_at": F.coalesce("invalid_at", now),
        "expired_at": F.coalesce("expired_at", now),
        "corrected": F.coalesce("corrected", F.lit(0)) + F.col("_times"),
    }).drop("_why", "_times")


def merge(facts: DataFrame, pairs: DataFrame, now: Column) -> DataFrame:
    """Versions that retire duplicates (uuid, canonical): an earlier end is kept, the transaction ends now."""
    return facts.drop("merged_into").join(pairs.select("uuid", F.col("canonical").alias("merged_into")), "uuid").withColumns({"invalid_at": F.least("invalid_at", now), "expired_at": now, "archived": F.lit(True)})


def archive(facts: DataFrame, ids: DataFrame) -> DataFrame:
    return facts.join(ids, "uuid", "left_semi").withColumn("archived", F.lit(True))


def restore(merged: DataFrame) -> DataFrame:
    """Undo archive and merge marks; an end that the merge itself set goes too, one that was there before stays."""
    own = F.col("invalid_at") == F.col("expired_at")
    return merged.withColumns({"archived": F.lit(False), "merged_into": F.lit(None).cast("string"), "invalid_at": F.when(F.col("merged_into").isNotNull() & own, None).otherwise(F.col("invalid_at"))})


def replace(facts: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """Update: new versions first (op_seq 0), then the ends of the old ones (op_seq 1), as one append."""
    old = facts.join(updates.select("uuid"), "uuid", "left_semi").withColumns({"invalid_at": F.coalesce("invalid_at", now), "expired_at": F.coalesce("expired_at", now), "op_seq": F.lit(1)})
    new = facts.join(updates.select("uuid", F.col("new_name").alias("_name")), "uuid").withColumns({"uuid": F.concat("uuid", F.lit("+")), "name": F.col("_name"), "valid_at": now, "created_at": now, "invalid_at": F.lit(None).cast("date"), "expired_at": F.lit(None).cast("date"), "op_seq": F.lit(0)}).drop("_name")
    return new.select(old.columns).unionAll(old)


def lost(before: DataFrame, after: DataFrame, key: str = "uuid") -> DataFrame:
    """Keys that a change has lost; must be empty."""
    return before.select(key).join(after.select(key), key, "left_anti")


def relate(entities: DataFrame, links: DataFrame, existing: DataFrame) -> DataFrame:
    """New manual links (source, name, target) that don't exist yet; scope is the source's, text is made of the names."""
    new = links.dropDuplicates(["source", "name", "target"]).join(existing.select("source", "name", "target"), ["source", "name", "target"], "left_anti")
    ends = entities.select("uuid", F.col("name").alias("_n"), F.col("group_id").alias("_g"))
    return new.join(ends.select(F.col("uuid").alias("source"), F.col("_n").alias("_s"), F.col("_g").alias("group_id")), "source").join(ends.select(F.col("uuid").alias("target"), F.col("_n").alias("_t")), "target").select("source", "name", "target", "group_id", F.concat_ws(" ", "_s", "name", "_t").alias("fact"))
