"""Relation names: canonical ones, synonyms, and what may link which types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The canonical relation names.
CANONICAL = "Supersedes AppliesTo DerivedFrom DiscoveredIn Informed UsedIn HasGotcha Contradicts RelatedTo References SharesPattern Uses Implements DefinedIn PartOf Contains Causes CausedBy Fixes Enforces Affects ContributesTo Calls".split()
# Normalised synonyms of the same direction.
SYNONYMS = {
    "appliedto": "AppliesTo", "appliedin": "AppliesTo", "applicableto": "AppliesTo", "isusedin": "UsedIn", "derivesfrom": "DerivedFrom", "derivedfor": "DerivedFrom", "referenced": "References", "cites": "References",
    "conflictswith": "Contradicts", "conflicts": "Contradicts", "informs": "Informed", "sharedpattern": "SharesPattern", "hasgotchas": "HasGotcha", "usestool": "Uses", "builtwith": "Uses", "builton": "Uses",
    "implemented": "Implements", "implementedin": "DefinedIn", "locatedin": "DefinedIn", "belongsto": "PartOf", "isimplementedserviceof": "PartOf", "includes": "Contains", "gates": "Enforces", "caused": "Causes", "affected": "Affects", "contributedto": "ContributesTo",
}


def folded(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"[^\p{Alnum}]", ""))


def vocabulary(spark: SparkSession) -> DataFrame:
    """(folded, canonical): a fixed table of the names above."""
    return spark.createDataFrame([*((c.lower(), c) for c in CANONICAL), *SYNONYMS.items()], "folded string, canonical string")


def canonicalise(facts: DataFrame, name: str = "name") -> DataFrame:
    """``name`` folded onto its canonical form, the old one in ``renamed_from``; unknown names stay."""
    known = F.broadcast(vocabulary(facts.sparkSession))
    joined = facts.withColumn("folded", folded(F.col(name))).join(known, "folded", "left")
    changed = F.col("canonical").isNotNull() & (F.col("canonical") != F.col(name))
    return joined.withColumn("renamed_from", F.when(changed, F.col(name))).withColumn(name, F.coalesce("canonical", name)).drop("folded", "canonical")


def report(facts: DataFrame, name: str = "name") -> DataFrame:
    """(old, new, n): how many facts each name has and what it becomes."""
    counts = facts.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n"))
    return canonicalise(counts).select(F.coalesce("renamed_from", "name").alias("old"), F.col("name").alias("new"), "n")


def conformity(facts: DataFrame, allowed: DataFrame) -> DataFrame:
    """Facts (source_type, target_type, name) counted where ``allowed`` has no such triple, nor one for any types."""
    anywhere = allowed.filter("source_type = 'Entity' and target_type = 'Entity'").select("name")
    odd = facts.join(F.broadcast(allowed), ["source_type", "target_type", "name"], "left_anti").join(F.broadcast(anywhere), "name", "left_anti")
    return odd.groupBy("source_type", "target_type", "name").agg(F.count("*").alias("n"))


def vocabulary_report(facts: DataFrame, name: str = "name") -> DataFrame:
    """(kind, old, new, n) of every relation name: a ``rename`` onto its canonical form, ``canonical`` itself, ``residual``, or ``one-off`` on a single fact.

    Residual names and one-offs carry meaning that the vocabulary lacks: they keep their names. Null and empty names are no names.
    """
    told = report(facts.filter(F.col(name).isNotNull() & (F.col(name) != "")), name)
    kind = F.when(F.col("old") != F.col("new"), "rename").when(F.col("old").isin(CANONICAL), "canonical").when(F.col("n") == 1, "one-off").otherwise("residual")
    return told.select(kind.alias("kind"), "old", "new", "n")
