"""Admission of incoming statements, and the guard on what a write retires."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import compare, screening
from tidemark.operators import vectors
from tidemark.operators.stats import wilson

#: Candidates that a judge sees of each statement; content words that two statements must share to be about one subject.
JUDGED, SUBJECT = 3, 0.70
RULES = ["unguarded", "structural", "lexical", "either", "shipped", "disabled"]


def admit(batch: DataFrame, known: DataFrame, judge: DataFrame, duplicate: float, related: float) -> DataFrame:
    """(uuid, verdict, other, why) of each statement of ``batch``; the first rule that holds decides.

    Rejected: it reads as an instruction. Duplicate: its hash is known in its scope, or an earlier row of the batch
    has it; or the nearest known vector of its scope is at ``duplicate`` or more; or the judge calls one of the
    JUDGED nearest from ``related`` on a duplicate. Else distinct, with the nearest one that the judge calls a
    contradiction, if any. Batch and known: (uuid, group_id, hash, text, embedding); judge: (query, uuid, relation).
    Null vectors have no neighbours; null texts are no instructions.
    """
    kinds = batch.select("uuid", "group_id", "hash", (F.size(screening.instructions("text")) > 0).alias("rejected"))
    old = known.groupBy("group_id", "hash").agg(F.min("uuid").alias("known"))
    first = batch.groupBy("group_id", "hash").agg(F.min("uuid").alias("first"))
    near = vectors.nearest(known.select("uuid", "group_id", "embedding"), batch.select("uuid", "group_id", "embedding"), JUDGED)
    judged = near.join(judge, ["query", "uuid"], "left").withColumn("band", (F.col("sim") >= related) & (F.col("sim") < duplicate))

    def nearest_of(which):
        return F.min(F.when(which, F.struct("rank", "uuid")))["uuid"]

    found = judged.groupBy(F.col("query").alias("uuid")).agg(
        nearest_of((F.col("rank") == 1) & (F.col("sim") >= duplicate)).alias("close"), nearest_of(F.col("band") & (F.col("relation") == "duplicate")).alias("same"), nearest_of(F.col("band") & (F.col("relation") == "contradiction")).alias("against")
    )
    rows = kinds.join(old, ["group_id", "hash"], "left").join(first, ["group_id", "hash"]).join(found, "uuid", "left")
    cases = [
        ("rejected", F.col("rejected"), F.lit(None).cast("long"), "instruction"),
        ("duplicate", F.col("known").isNotNull(), F.col("known"), "hash"),
        ("duplicate", F.col("first") != F.col("uuid"), F.col("first"), "hash in batch"),
        ("duplicate", F.col("close").isNotNull(), F.col("close"), "vector"),
        ("duplicate", F.col("same").isNotNull(), F.col("same"), "judge"),
        ("distinct", F.col("against").isNotNull(), F.col("against"), "contradiction"),
    ]
    picked = F.lit(None).cast("struct<verdict:string,other:bigint,why:string>")
    for verdict, holds, other, why in reversed(cases):
        picked = F.when(holds, F.struct(F.lit(verdict).alias("verdict"), other.alias("other"), F.lit(why).alias("why"))).otherwise(picked)
    return rows.select("uuid", picked.alias("p")).select("uuid", F.coalesce("p.verdict", F.lit("distinct")).alias("verdict"), F.col("p.other").alias("other"), F.col("p.why").alias("why"))


def guard(retired: DataFrame, written: DataFrame, write: str, whole: bool = False) -> DataFrame:
    """(write, uuid, structural, lexical, reason) of each retired fact, against what the same ``write`` has written.

    Structural: a new fact has the same ends either way, or the same end in the same place and the same name in any
    case; unknown ends of the retired fact abstain. Lexical: a new fact shares SUBJECT of its content words and
    differs by a value. A retirement stands if both hold; writes without new facts retire as they like: what they
    retire has no row, or with ``whole`` one without verdicts.
    """
    # words and values once for each fact: a fact meets all those of its write
    told = lambda facts: facts.select("*", compare.content(F.col("fact")).alias("_c")).withColumns({"_x": compare.numbered(F.col("_c")), "_u": compare.values(F.col("fact"))})
    new = told(written).select(F.col(write).alias("_w"), F.col("source").alias("_s"), F.col("target").alias("_t"), F.lower("name").alias("_n"), F.col("_x").alias("_y"), F.col("_u").alias("_v"), F.lit(True).alias("_new"))
    met = told(retired).select("uuid", F.col(write).alias("_w"), "source", "target", F.lower("name").alias("name"), "_x", "_u").join(new, "_w", "left" if whole else "inner")
    s, t = F.col("source"), F.col("target")
    pair = ((s == F.col("_s")) & (t == F.col("_t"))) | ((s == F.col("_t")) & (t == F.col("_s")))
    same = F.coalesce(pair | (((s == F.col("_s")) | (t == F.col("_t"))) & (F.col("name") == F.col("_n"))), F.lit(False))
    shared = F.when(F.col("_new"), compare.numbered_overlap(F.col("_x"), F.col("_y")))
    rows = met.select("_w", "uuid", F.when(F.col("_new"), same | s.isNull() | t.isNull()).alias("same"), shared.alias("shared"), (F.col("_u") != F.col("_v")).alias("differ"))
    # by write and fact, so that the rows stay where they have met
    g = rows.groupBy("_w", "uuid").agg(F.bool_or("same").alias("structural"), F.bool_or((F.col("shared") >= SUBJECT) & F.col("differ")).alias("lexical"), F.max("shared").alias("closest"))
    reason = F.when(~F.col("structural"), "nothing written could replace it").when(~F.col("lexical"), F.concat(F.lit("no subject in common, best overlap "), F.format_number("closest", 2)))
    return g.select(F.col("_w").alias(write), "uuid", "structural", "lexical", reason.alias("reason"))


def variants(verdicts: DataFrame, labels: DataFrame) -> DataFrame:
    """Of each rule: labelled retirements, silent losses (wrong ones it upholds), stale facts (right ones it reverts), with intervals.

    ``labels``: (uuid, right). Rules: none, either half, both (shipped), one of them, and no retirement at all.
    """
    s, x = F.col("structural"), F.col("lexical")
    upheld = {"unguarded": F.lit(True), "structural": s, "lexical": x, "either": s | x, "shipped": s & x, "disabled": F.lit(False)}
    rows = verdicts.join(labels, "uuid").select("right", F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), upheld[k].alias("upheld")) for k in RULES))).alias("v"))
    g = rows.groupBy("v.rule").agg(F.count("*").alias("n"), F.count_if(F.col("v.upheld") & ~F.col("right")).alias("lost"), F.count_if(~F.col("v.upheld") & F.col("right")).alias("stale"), F.count_if("right").alias("right"))
    lost, stale = wilson(F.col("lost"), F.col("n")), wilson(F.col("stale"), F.col("n"))
    rounded = {"lost_low": lost[0], "lost_high": lost[1], "stale_low": stale[0], "stale_high": stale[1], "missed_damage": F.try_divide("lost", F.col("n") - F.col("right")), "wrong_blocks": F.try_divide("stale", F.col("right"))}
    return g.select("rule", "n", "lost", "stale", *(F.round(v, 6).alias(k) for k, v in rounded.items()))
