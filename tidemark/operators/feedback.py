"""Counters of facts from what was served and corrected, and captures that wait for a decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_feedback(facts: DataFrame, served: DataFrame, corrections: DataFrame) -> DataFrame:
    """The facts with their counters raised: recalled_n and last_recalled_at by ``served``, corrected_n and last_corrected_at by ``corrections``.

    ``served``: (uuid, at, opted_in), of which only those that asked to be counted do; ``corrections``: (uuid, at). Events are summed before they
    meet the facts, so a fact that is served all the time is one row there. Counters and times that ``facts`` has are added to and only go up; what is
    missing counts as 0. Events of unknown facts change nothing, and events without a time count without one.
    """
    raised = facts
    for name, events in (("recalled", served.filter(F.coalesce("opted_in", F.lit(False)))), ("corrected", corrections)):
        own = events.filter(F.col("uuid").isNotNull()).groupBy("uuid").agg(F.count("*").alias("_n"), F.max("at").alias("_at"))
        n, at = f"{name}_n", f"last_{name}_at"
        raised = raised.join(own, "uuid", "left").withColumns({
            n: F.coalesce(F.col(n) if n in facts.columns else F.lit(0), F.lit(0)).cast("long") + F.coalesce("_n", F.lit(0)),
            at: F.greatest(F.col(at), F.col("_at")) if at in facts.columns else F.col("_at"),
        }).drop("_n", "_at")
    return raised


def settle_pending(pending: DataFrame, decisions: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(statuses, facts): what becomes of waiting captures (uuid, group_id, text, hash) by ``decisions`` (uuid, action).

    Approved ones are admitted whatever the triage had said: a fact each, with an id that follows from the capture's, so approving twice stores once; a capture whose
    hash its scope already has in ``known`` (group_id, hash), or that repeats an earlier one of this run, is ``approved`` as well and stores nothing. Dismissed ones leave the queue;
    of two decisions the dismissal counts. A status is an appended version: nothing is deleted. Captures without a decision have no row.
    """
    one = decisions.filter(F.col("action").isin("approve", "dismiss")).groupBy("uuid").agg(F.max("action").alias("action"))
    told = pending.join(one, "uuid")
    statuses = told.select("uuid", F.when(F.col("action") == "approve", "approved").otherwise("dismissed").alias("status"))
    fresh = told.filter("action = 'approve'").join(known.select("group_id", "hash"), ["group_id", "hash"], "left_anti")
    first = fresh.groupBy("group_id", "hash").agg(F.min_by(F.struct("uuid", "text"), "uuid").alias("f"))
    facts = first.select(F.sha2(F.concat_ws("|", F.lit("capture"), F.col("f.uuid").cast("string")).cast("binary"), 256).alias("uuid"), "group_id", F.col("f.text").alias("fact"), "hash", F.lit("capture").alias("source"))
    return statuses, facts
