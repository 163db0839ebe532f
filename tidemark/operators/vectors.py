"""Similar pairs and nearest neighbours within a scope, by blocks of unit vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Vectors of one block; a scope of n blocks is compared as n (n + 1) / 2 pairs of blocks.
BLOCK = 1024


def unit(rows: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in rows])
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def block_pairs(facts: DataFrame, by: list[str], key: str, vector: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """Each fact once for each pair of blocks of its group ``by`` that it takes part in; null vectors stay out, and groups of one."""
    facts = facts.filter(F.col(vector).isNotNull())
    blocks = facts.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1").select(*by, F.ceil(F.col("n") / BLOCK).alias("blocks"))
    own = facts.join(blocks, by).withColumn("b", F.pmod(F.xxhash64(key), F.col("blocks")))
    return own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(key, *by, vector, *carried, "b", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"))


def similar_pairs(facts: DataFrame, floor: float, scope: str = "group_id", key: str = "uuid", vector: str = "embedding") -> DataFrame:
    """(scope, a, b, sim): all pairs a < b of a scope with cosine of ``floor`` or more."""

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = rows["i"].iloc[0], rows["j"].iloc[0]
        left, right = rows[rows["b"] == i], rows[rows["b"] == j]
        if not len(left) or not len(right):
            return pd.DataFrame({scope: pd.Series([], dtype=object), "a": [], "b": [], "sim": []})
        sims = unit(left[vector]) @ unit(right[vector]).T
        r, c = np.nonzero(sims >= floor)
        a, b = left[key].to_numpy()[r], right[key].to_numpy()[c]
        keep = a < b if i == j else a != b
        a, b = a[keep], b[keep]
        return pd.DataFrame({scope: pd.Series([rows[scope].iloc[0]] * len(a), dtype=object), "a": np.minimum(a, b), "b": np.maximum(a, b), "sim": sims[r[keep], c[keep]]})

    dealt = block_pairs(facts, [scope], key, vector)
    return dealt.groupBy(scope, "i", "j").applyInPandas(pairs, f"{scope} string, a long, b long, sim double")


def best_of_block(rows: pd.DataFrame, scope: str, k: int) -> pd.DataFrame:
    """Of the asked rows of a block the ``k`` most similar of its others; ties go to lower ids."""
    q, f = rows[rows["asked"]], rows[~rows["asked"]].sort_values("id")
    out = {"query": [], scope: [], "uuid": [], "sim": []}
    if len(q) and len(f):
        sims = np.round(unit(q["v"]) @ unit(f["v"]).T, 9)
        ids = f["id"].to_numpy()
        for query, row in zip(q["id"].tolist(), sims, strict=True):
            for x in [i for i in np.argsort(-row, kind="stable")[: k + 1].tolist() if ids[i] != query][:k]:
                out["query"].append(query)
                out[scope].append(rows[scope].iloc[0])
                out["uuid"].append(int(ids[x]))
                out["sim"].append(float(row[x]))
    return pd.DataFrame(out | {scope: pd.Series(out[scope], dtype=object)})


def met_blocks(facts: DataFrame, queries: DataFrame, by: list[str], key: str, vector: str, size: int | None = None) -> DataFrame:
    """(by, b, q, id, v, asked): blocks of facts (``size``, or BLOCK) and blocks of queries of each group ``by``, each pair of them together once."""

    def dealt(df: DataFrame, mine: str, own: str, other: str, asked: bool) -> DataFrame:
        n = F.xxhash64(key, F.lit(mine))
        return df.join(sizes, by).select(*by, F.pmod(n, F.col(own)).alias(mine), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("q" if mine == "b" else "b"), F.col(key).alias("id"), F.col(vector).alias("v"), F.lit(asked).alias("asked")).select(*by, "b", "q", "id", "v", "asked")

    facts, queries = facts.filter(F.col(vector).isNotNull()), queries.filter(F.col(vector).isNotNull())
    blocks = facts.groupBy(*by).agg(F.ceil(F.count("*") / (size or BLOCK)).alias("blocks"))
    sizes = blocks.join(queries.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK).alias("asking")), by)
    return dealt(facts, "b", "blocks", "asking", False).unionAll(dealt(queries, "q", "asking", "blocks", True))


def nearest(facts: DataFrame, queries: DataFrame, k: int, scope: str = "group_id", key: str = "uuid", vector: str = "embedding") -> DataFrame:
    """(query, scope, uuid, sim, rank): the ``k`` most similar other facts of each query's scope, exact.

    Facts and queries are dealt in blocks; each pair of blocks of a scope meets in one task, which returns its best ``k`` of each query.
    """
    met = met_blocks(facts, queries, [scope], key, vector)
    found = met.groupBy(scope, "b", "q").applyInPandas(lambda rows: best_of_block(rows, scope, k), f"query long, {scope} string, uuid long, sim double")
    return ranked(found, k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("sim"), "uuid"))).filter(F.col("rank") <= k)
