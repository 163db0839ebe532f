"""Proposals from similar facts: merges behind a lexical gate and a judge, and contradictions. The judge's verdicts come as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import compare

#: Proposals of one run; others are counted as waiting and come with a later run.
MOST = 50
#: Differing tokens that a proposal shows.
SHOWN = 12


def _stated(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs (canonical, duplicate) with both statements; stems are made once for each fact. Pairs of a fact that is missing go."""
    said = facts.select("uuid", F.coalesce("fact", F.lit("")).alias("fact")).withColumn("stems", F.array_sort(compare.content(F.col("fact"))))
    for end, c in (("canonical", "a"), ("duplicate", "b")):
        pairs = pairs.join(said.select(F.col("uuid").alias(end), F.col("fact").alias(f"fact_{c}"), F.col("stems").alias(f"stems_{c}")), end)
    return pairs


def _judged(pairs: DataFrame, verdicts: DataFrame | None) -> DataFrame:
    """Pairs with ``relation``; of several verdicts on a pair the last by name counts, none is null."""
    if verdicts is None:
        return pairs.withColumn("relation", F.lit(None).cast("string"))
    return pairs.join(verdicts.groupBy("canonical", "duplicate").agg(F.max("relation").alias("relation")), ["canonical", "duplicate"], "left")


def _limited(rows: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` of the proposed rows stay so, the others wait."""
    first = rows.filter("outcome = 'proposed'").orderBy(F.desc("similarity"), "canonical", "duplicate").limit(limit).select("proposal_key", F.lit(True).alias("_first"))
    outcome = F.when((F.col("outcome") == "proposed") & F.col("_first").isNull(), "waiting").otherwise(F.col("outcome"))
    return rows.join(first, "proposal_key", "left").withColumn("outcome", outcome).drop("_first")


def _key(kind: str):
    return F.sha2(F.concat_ws("|", F.lit(kind), F.col("canonical").cast("string"), F.col("duplicate").cast("string")).cast("binary"), 256)


def merge_proposals(pairs: DataFrame, facts: DataFrame, verdicts: DataFrame | None = None, limit: int = MOST) -> DataFrame:
    """One row for each pair: (proposal_key, kind, scope, canonical, duplicate, similarity, relation, outcome, differs).

    ``pairs``: (scope, canonical, duplicate, similarity), each once; ``facts``: (uuid, fact), ids once; ``verdicts``: (canonical, duplicate,
    relation). A pair whose content words differ is ``withheld``. With verdicts, one that the judge calls other than duplicate, or on
    which it failed or said nothing, is ``rejected``; without any, the words decide. Of the rest the most similar ``limit`` are
    ``proposed`` and the others ``waiting``. Nothing is lost: every pair has its outcome. ``differs``: the first SHOWN tokens of one statement only.
    """
    p = _judged(_stated(pairs, facts), verdicts)
    same = F.col("stems_a") == F.col("stems_b")
    refused = F.coalesce(F.col("relation") != "duplicate", F.lit(True)) if verdicts is not None else F.lit(False)
    outcome = F.when(~same, "withheld").when(refused, "rejected").otherwise("proposed")
    rows = p.select(_key("merge").alias("proposal_key"), F.lit("merge").alias("kind"), "scope", "canonical", "duplicate", "similarity", "relation", outcome.alias("outcome"), F.slice(compare.differing(F.col("fact_a"), F.col("fact_b")), 1, SHOWN).alias("differs"))
    return _limited(rows, limit)


def contradiction_proposals(pairs: DataFrame, facts: DataFrame, verdicts: DataFrame | None = None, limit: int = MOST) -> DataFrame:
    """(proposal_key, kind, scope, canonical, duplicate, similarity, relation, outcome, differs) of the pairs that state other values.

    Inputs and columns as for merges. Only pairs with a value in one statement alone come in question; of those the judge must say
    contradiction (``proposed``, beyond ``limit`` ``waiting``), else they are ``rejected``. Without verdicts there are no rows: nobody has judged.
    """
    p = _judged(_stated(pairs, facts), verdicts).filter(compare.values_differ(F.col("fact_a"), F.col("fact_b")))
    if verdicts is None:
        p = p.filter(F.lit(False))
    outcome = F.when(F.col("relation") == "contradiction", "proposed").otherwise("rejected")
    rows = p.select(_key("contradiction").alias("proposal_key"), F.lit("contradiction").alias("kind"), "scope", "canonical", "duplicate", "similarity", "relation", outcome.alias("outcome"), F.slice(compare.differing(F.col("fact_a"), F.col("fact_b")), 1, SHOWN).alias("differs"))
    return _limited(rows, limit)


def canonical_pairs(pairs: DataFrame, parts: DataFrame, facts: DataFrame) -> DataFrame:
    """(scope, canonical, duplicate, similarity): each member of a component with its earliest one; the similarity is the component's best.

    ``pairs``: (scope, a, b, sim); ``parts``: (node, component); ``facts``: (uuid, created_at). Members are joined to their canonical, so a large
    component is no group in one task.
    """
    best = pairs.join(parts.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.max("sim").alias("similarity"), F.first("scope").alias("scope"))
    dated = parts.join(facts.select(F.col("uuid").alias("node"), "created_at"), "node")
    first = dated.groupBy("component").agg(F.min_by("node", F.struct("created_at", "node")).alias("canonical"))
    return parts.join(first, "component").filter("node <> canonical").join(best, "component").select("scope", "canonical", F.col("node").alias("duplicate"), "similarity")
