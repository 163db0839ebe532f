"""Briefs of all seats at once: what each seat sees, newest first, by section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.temporal import newest

#: Entries of a section, runbooks of a brief, characters of an extra.
SECTION, RUNBOOKS, EXTRA = 7, 5, 180
# Severities in order; any other comes after them.
SEVERITIES = ["critical", "high", "medium", "low"]


def trimmed(value: Column, limit: int = EXTRA) -> Column:
    """One line without outer space; a longer one is cut and marked. Null and blank give null."""
    line = F.trim(F.regexp_replace(value, r"\s+", " "))
    return F.when(line != "", F.when(F.length(line) <= limit, line).otherwise(F.concat(F.rtrim(F.left(line, F.lit(limit - 1))), F.lit("…"))))


def line(summary: Column, name: Column, why: Column, rejected: Column) -> Column:
    """A brief line: the summary, or the name without one; then why, and what was rejected."""
    base = F.when(F.coalesce(summary, F.lit("")) != "", F.trim(summary)).otherwise(name)
    extras = F.concat_ws("; ", F.concat(F.lit("why: "), trimmed(why)), F.concat(F.lit("rejected: "), trimmed(rejected)))
    return F.when(extras != "", F.concat(base, F.lit(" — "), extras)).otherwise(base)


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.lower(severity)), F.lit(0)).cast("int")


def visible(seats: DataFrame) -> DataFrame:
    """(seat, scope): global, the seat's cluster if it has one, and its own scope."""
    scopes = F.array_compact(F.array(F.lit("global"), F.col("cluster"), F.col("seat")))
    return seats.select("seat", F.explode(scopes).alias("scope"))


def newest_seen(rows: DataFrame, seen: DataFrame, limit: int, per: list[str] | None = None) -> DataFrame:
    """Of ``rows`` (scope, created_at, uuid, ...) the newest ``limit`` that each seat sees, with ``pos`` from 1.

    Each scope is cut to its own newest first, so a scope that all seats see is not multiplied by them.
    """
    per = per or []
    order = [F.desc("created_at"), F.desc("uuid")]
    joined = newest(rows, ["scope", *per], order, limit).join(seen, "scope")
    ranked = joined.withColumn("pos", F.row_number().over(W.partitionBy("seat", *per).orderBy(*order)))
    return ranked.filter(F.col("pos") <= limit)


def briefs(seats: DataFrame, entities: DataFrame, runbooks: DataFrame, sections: dict[str, str]) -> DataFrame:
    """One row for each seat: a line with the counts, and the lines of each section as one text.

    ``sections``: label -> section. Entities: (uuid, scope, label, name, summary, why, rejected, severity,
    created_at); the section ``lessons`` goes by severity, then as the others by age. A seat that sees nothing has
    empty sections.
    """
    seen = visible(seats)
    named = entities.withColumn("section", F.coalesce(*(F.when(F.col("label") == k, F.lit(v)) for k, v in sections.items()))).filter("section is not null")
    own = newest_seen(named, seen, SECTION, ["section"])
    text = line(F.col("summary"), F.col("name"), F.col("why"), F.col("rejected"))
    rank = F.when(F.col("section") == "lessons", F.when(severity_rank(F.col("severity")) == 0, 5).otherwise(severity_rank(F.col("severity")))).otherwise(0)
    rows = own.select("seat", "section", rank.alias("rank"), "pos", text.alias("line"))
    books = newest_seen(runbooks, seen, RUNBOOKS).select("seat", F.lit("runbooks").alias("section"), F.lit(0).alias("rank"), "pos", F.col("name").alias("line"))
    listed = rows.unionByName(books).groupBy("seat").pivot("section", [*sections.values(), "runbooks"]).agg(F.array_sort(F.collect_list(F.struct("rank", "pos", "line"))))
    joined = seats.select("seat").join(listed, "seat", "left")
    texts = {s: F.coalesce(F.array_join(F.transform(s, lambda x: x["line"]), "\n"), F.lit("")) for s in [*sections.values(), "runbooks"]}
    counts = [F.concat(F.coalesce(F.size(s), F.lit(0)).cast("string"), F.lit(f" {s}")) for s in sections.values()]
    summary = F.concat(F.col("seat"), F.lit(": "), F.concat_ws(", ", *counts), F.lit(" on record."))
    return joined.select("seat", summary.alias("summary"), *(t.alias(s) for s, t in texts.items()))
