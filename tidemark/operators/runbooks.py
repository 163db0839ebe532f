"""Runbooks: one of each name and scope, whose steps are superseded and never lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Steps of a runbook and characters of a step.
MOST_STEPS, STEP_CHARS = 60, 600


def one_line(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s+", " "))


def upsert(existing: DataFrame, given: DataFrame, now: Column) -> DataFrame:
    """Versions of the runbooks that ``given`` (name, scope, steps, purpose, at) states: (outcome, uuid, name, scope, steps, purpose, previous_steps, superseded_at, verified_at).

    ``existing``: (uuid, name, scope, steps, archived). An entity of the same name and scope is taken over, whether it has steps
    (``updated``, or ``verified`` if they are the same) or none yet (``adopted``); archived ones are not; of several the least uuid. Else it is ``created``, under an
    id that follows from name and scope, so a repeated job gives the same. Previous steps are kept only where steps changed. Names and steps are single
    lines; repeated steps stay, empty ones go. Of several statements of one runbook the latest counts. ``rejected``: without
    a name, without steps, with too many of them, or a too long one; those change nothing and have no uuid.
    """
    steps = F.filter(F.transform(F.coalesce("steps", F.array().cast("array<string>")), one_line), lambda s: s != "")
    stated = given.select(one_line(F.col("name")).alias("name"), F.coalesce("scope", F.lit("global")).alias("scope"), steps.alias("steps"), "purpose", "at")
    last = stated.groupBy("name", "scope").agg(F.max(F.struct("at", "steps", "purpose")).alias("l")).select("name", "scope", "l.steps", "l.purpose", "l.at")
    old = existing.filter(~F.coalesce("archived", F.lit(False))).groupBy("name", "scope").agg(F.min_by(F.struct("uuid", "steps"), "uuid").alias("_old"))
    both = last.join(old, ["name", "scope"], "left")
    before = F.coalesce("_old.steps", F.array().cast("array<string>"))
    bad = (F.col("name") == "") | (F.size("steps") == 0) | (F.size("steps") > MOST_STEPS) | F.exists("steps", lambda s: F.length(s) > STEP_CHARS)
    changed = (F.size(before) > 0) & (before != F.col("steps"))
    outcome = F.when(bad, "rejected").when(F.col("_old").isNull(), "created").when(changed, "updated").when(F.size(before) == 0, "adopted").otherwise("verified")
    made = F.sha2(F.concat_ws("|", F.lit("runbook"), "name", "scope").cast("binary"), 256)
    return both.select(
        outcome.alias("outcome"), F.when(~bad, F.coalesce("_old.uuid", made)).alias("uuid"), "name", "scope", "steps", "purpose",
        F.when(~bad & changed, before).otherwise(F.array().cast("array<string>")).alias("previous_steps"), F.when(~bad & changed, now).alias("superseded_at"), F.when(~bad, F.col("at")).alias("verified_at"),
    )
