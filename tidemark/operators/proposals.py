"""Proposals: decisions that move open ones, and the inbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.temporal import active, merge
from tidemark.sources.shared import saved

#: A statement that names so many of a promotion's scopes is about them, and not fit for the wider scope.
MOST_NAMED = 3


def settle(proposals: DataFrame, decisions: DataFrame, known: DataFrame) -> DataFrame:
    """Versions (proposal_key, status, reason) of the open proposals that a decision moves; each moves once.

    ``proposals``: (proposal_key, kind, status, scopes, target); ``decisions``: (proposal_key, action, statement);
    ``known``: (scope, statement) that exist. Dismissed ones are dismissed. To apply: a contradiction never is by
    itself; a promotion needs a statement that names fewer than MOST_NAMED of its scopes, in any case, and that
    neither its target nor the global scope has; merges need nothing. Of two decisions on one proposal the
    dismissal counts.
    """
    one = decisions.groupBy("proposal_key").agg(F.max("action").alias("action"), F.max_by("statement", "action").alias("statement"))
    open_ones = proposals.filter("status = 'OPEN'").join(one, "proposal_key")
    said = F.lower(F.trim(F.coalesce("statement", F.lit(""))))
    old = known.select(F.col("scope").alias("_scope"), F.lower(F.trim("statement")).alias("_said")).distinct()
    own = open_ones.withColumn("_said", said).join(old.groupBy("_said").agg(F.collect_set("_scope").alias("_has")), "_said", "left")
    named = F.size(F.filter("scopes", lambda s: F.contains(F.col("_said"), F.lower(s))))
    promotion = F.col("kind") == "promote"
    reason = (
        F.when(F.col("action") == "dismiss", None)
        .when(F.col("kind") == "contradiction", "needs a person")
        .when(promotion & (F.col("_said") == ""), "no statement")
        .when(promotion & (named >= MOST_NAMED), "names its projects")
        .when(promotion & F.coalesce(F.arrays_overlap("_has", F.array(F.col("target"), F.lit("global"))), F.lit(False)), "known there")
    )
    status = F.when(F.col("action") == "dismiss", "DISMISSED").when(reason.isNull(), "APPLIED").otherwise("OPEN")
    return own.select("proposal_key", status.alias("status"), reason.alias("reason"))


def apply(proposals: DataFrame, decisions: DataFrame, known: DataFrame, facts: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(statuses, versions): what ``settle`` decides, carried out on ``facts`` as appended versions; a proposal takes effect as a whole or not at all.

    ``proposals`` also has ``canonical`` and ``duplicate`` (merges) and ``statement`` comes with the decision (promotions). A merge needs both of its
    facts, which must be active and not the same one; else it stays open ("fact missing"). Of several merges of one duplicate the one with
    the least key counts, the others stay open ("merged already"). A promotion is a new fact of the target scope, whose id follows from the
    proposal's key, so that carrying it out again gives the same fact. Of the facts only those that merges name are moved; their ids are
    written to the shared folder when this is called.
    """
    told = settle(proposals, decisions, known)
    live = active(facts)
    merges = told.filter("status = 'APPLIED'").join(proposals.filter("kind = 'merge'").select("proposal_key", "canonical", "duplicate"), "proposal_key")
    pairs = merges.filter("canonical <> duplicate")
    # a table of its own, so that its size is known: if it is small, the facts stay where they are
    ends = saved(pairs.select(F.explode(F.array("canonical", "duplicate")).alias("uuid")).distinct())
    live = live.join(ends, "uuid", "left_semi")
    there = live.select("uuid").distinct()
    both = pairs.join(there.withColumnRenamed("uuid", "canonical"), "canonical", "left_semi").join(there.withColumnRenamed("uuid", "duplicate"), "duplicate", "left_semi")
    first = both.groupBy("duplicate").agg(F.min_by(F.struct("proposal_key", "canonical"), "proposal_key").alias("_m")).select("duplicate", "_m.proposal_key", "_m.canonical")
    failed = merges.select("proposal_key").join(first.select("proposal_key"), "proposal_key", "left_anti").join(both.select("proposal_key", F.lit("merged already").alias("_why")), "proposal_key", "left")
    failed = failed.select("proposal_key", F.coalesce("_why", F.lit("fact missing")).alias("_why"))
    statuses = told.join(failed, "proposal_key", "left").select("proposal_key", F.when(F.col("_why").isNull(), F.col("status")).otherwise("OPEN").alias("status"), F.coalesce("_why", "reason").alias("reason"))
    merged = merge(live, first.select(F.col("duplicate").alias("uuid"), "canonical"), now)
    stated = decisions.filter("action = 'apply'").groupBy("proposal_key").agg(F.max("statement").alias("_said"))
    raised = told.filter("status = 'APPLIED'").join(proposals.filter("kind = 'promote'").select("proposal_key", "target"), "proposal_key").join(stated, "proposal_key")
    text = "fact" if "fact" in facts.columns else "name"
    new = raised.select(F.sha2(F.col("proposal_key").cast("binary"), 256).alias("uuid"), F.col("target").alias("group_id"), F.trim("_said").alias(text), now.alias("created_at"), now.alias("valid_at"), F.lit(False).alias("archived"))
    return statuses, merged.unionByName(new, allowMissingColumns=True)


def moved(proposals: DataFrame, statuses: DataFrame) -> DataFrame:
    """The proposals with their new statuses; others keep theirs."""
    new = statuses.select("proposal_key", F.col("status").alias("_status"))
    return proposals.join(new, "proposal_key", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")


def carried_out(facts: DataFrame, versions: DataFrame) -> DataFrame:
    """The facts after the versions: new ones are added, changed ones replaced."""
    kept = facts.join(versions.select("uuid"), "uuid", "left_anti")
    return kept.unionByName(versions, allowMissingColumns=True)
