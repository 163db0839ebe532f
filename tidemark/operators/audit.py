"""Audit of automatic retirements: what else was written around each, and whether that justifies it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.stats import wilson


def _keys(source: str, target: str, name: str) -> Column:
    """What makes a fact alike another of its scope: both ends either way, or one end and the name."""
    s, t, n, g = F.col(source), F.col(target), F.lower(name), F.col("group_id")
    mark = F.lit("\x01")
    made = [F.concat(F.lit("1"), g, mark, F.least(s, t), mark, F.greatest(s, t)), F.concat(F.lit("2"), g, mark, s, mark, n), F.concat(F.lit("3"), g, mark, t, mark, n)]
    # an unknown end or name is shared with nothing
    known = [s.isNotNull() & t.isNotNull(), F.lit(True), F.lit(True)]
    return F.array_compact(F.array(*(F.when(k, m) for k, m in zip(known, made, strict=True))))


def cohorts(retired: DataFrame, written: DataFrame, windows: list[int]) -> DataFrame:
    """(uuid, window, cohort, justified) of each retired fact, a row of ``written``: facts of its scope written within ``window`` days.

    ``justified``: one has the same ends, or the same end in the same place and the same name. A fact's own row is
    taken off. Cohorts are counts by scope and day, added up over the windows before they meet the retired facts.
    Alike facts are counted by key and day; a retired fact meets those of the one or two spans of days that its
    widest window touches, and only the least gap is kept.
    """
    widest = max(windows)
    width = 8 * (2 * widest + 1)
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    span = lambda c: F.floor(c / width)
    days = written.select("group_id", "source", "target", "name", day("created_at").alias("day")).filter("day is not null")
    old = retired.select("uuid", "group_id", "source", "target", "name", day("expired_at").alias("d"), day("created_at").alias("_own"))

    held = days.groupBy("group_id", "day").agg(F.count("*").alias("n"))
    near = held.withColumn("off", F.explode(F.sequence(F.lit(-widest), F.lit(widest)))).withColumn("d", F.col("day") + F.col("off"))
    sizes = near.groupBy("group_id", "d").agg(*(F.sum(F.when(F.abs("off") <= w, F.col("n")).otherwise(0)).alias(f"c{w}") for w in windows))
    own = F.coalesce(F.abs(F.col("d") - F.col("_own")), F.lit(widest + 1))
    sized = old.join(sizes, ["group_id", "d"]).select("uuid", F.lit(None).cast("int").alias("gap"), *((F.col(f"c{w}") - F.when(own <= w, 1).otherwise(0)).alias(f"c{w}") for w in windows))

    # spread by key and span before they are counted, as the join needs them
    new = days.select(F.explode(_keys("source", "target", "name")).alias("key"), "day", span(F.col("day")).alias("span")).repartition("key", "span").groupBy("key", "span", "day").agg(F.count("*").alias("n"))
    asked = old.select("uuid", "d", "_own", F.explode(_keys("source", "target", "name")).alias("key")).withColumn("span", F.explode(F.sequence(span(F.col("d") - widest), span(F.col("d") + widest))))
    gap = F.abs(F.col("day") - F.col("d"))
    other = (F.col("n") > 1) | ~F.col("day").eqNullSafe(F.col("_own"))
    alike = asked.join(new, ["key", "span"]).filter((gap <= widest) & other).select("uuid", gap.alias("gap"), *(F.lit(None).cast("long").alias(f"c{w}") for w in windows))

    wide = sized.unionAll(alike).groupBy("uuid").agg(F.min("gap").alias("gap"), *(F.sum(f"c{w}").alias(f"c{w}") for w in windows))
    stacked = ", ".join(f"{w}, c{w}, coalesce(gap <= {w}, false)" for w in windows)
    return wide.select("uuid", F.expr(f"stack({len(windows)}, {stacked}) as (window, cohort, justified)")).filter("cohort > 0")


def rates(audited: DataFrame, by: list[str]) -> DataFrame:
    """Decidable, allowed and blocked retirements, and the share blocked with its Wilson interval."""
    g = audited.groupBy(*by).agg(F.count("*").alias("decidable"), F.count_if("justified").alias("allowed"))
    blocked = F.col("decidable") - F.col("allowed")
    low, high = wilson(blocked, F.col("decidable"))
    return g.select(*by, "decidable", "allowed", blocked.alias("blocked"), F.round(blocked / F.col("decidable"), 6).alias("share"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))
