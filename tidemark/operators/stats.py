"""Statistics on counts and grades."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """95 % Wilson interval of k out of n; (0, 0) for n = 0."""
    p = k / F.nullif(n, F.lit(0))
    scale = 1 + Z95 * Z95 / n
    middle, half = (p + Z95 * Z95 / (2 * n)) / scale, Z95 * F.sqrt(p * (1 - p) / n + Z95 * Z95 / (4 * n * n)) / scale
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), middle - half)), F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), middle + half))


def kappa(grades: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Cohen's kappa of two columns of grades; rows with a null or -1 (abstained) are left out; under two rows: null."""
    cells = grades.filter(F.coalesce(F.col(a), F.lit(-1)) >= 0).filter(F.coalesce(F.col(b), F.lit(-1)) >= 0).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left, right = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    by_chance = left.join(right, left.a == right.b).agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("chance"))
    observed, expected = F.col("same") / F.col("n"), F.col("chance") / (F.col("n") * F.col("n"))
    value = F.when(F.coalesce(F.col("n"), F.lit(0)) < 2, None).when(expected >= 1, F.when(observed >= 1, 1.0).otherwise(0.0)).otherwise((observed - expected) / (1 - expected))
    return total.crossJoin(by_chance).select(F.coalesce("n", F.lit(0)).alias("n"), observed.alias("agreement"), value.alias("kappa"))


def bootstrap(outcomes: DataFrame, value: str, key: str, by: str | None = None, resamples: int = 10_000, seed: int = 11) -> DataFrame:
    """Nearest-rank 95 % interval of the mean of ``value`` over resamples of the rows, for each ``by``; none under ten rows.

    Poisson bootstrap: each row's weights in all resamples are drawn from a seed of its key. A task adds its rows
    up to one array of ``resamples`` sums for each category, so rows never meet in one place.
    """
    outcomes = outcomes.select(F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value"), (F.col(by) if by else F.lit("OVERALL")).cast("string").alias("category"))

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for rows in parts:
            for k, v, category in rows.dropna(subset=["value"]).itertuples(index=False):
                weights = np.random.default_rng([seed, zlib.crc32(str(k).encode())]).poisson(1.0, resamples)
                held = sums.setdefault(category, np.zeros((2, resamples)))
                held += [weights * v, weights]
        for category, (s, w) in sums.items():
            yield pd.DataFrame({"category": category, "resample": np.arange(resamples), "s": s, "w": w})

    drawn = outcomes.mapInPandas(draw, "category string, resample long, s double, w double").groupBy("category", "resample").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))
    means = drawn.filter("w > 0").select("category", "resample", (F.col("s") / F.col("w")).alias("m"))
    ranked = means.withColumn("r", F.row_number().over(W.partitionBy("category").orderBy("m", "resample")) - 1)
    n = outcomes.groupBy("category").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    ends = ranked.groupBy("category").agg(F.max(F.when(F.col("r") == int(0.025 * resamples), F.col("m"))).alias("low"), F.max(F.when(F.col("r") == int(0.975 * resamples), F.col("m"))).alias("high"))
    return n.join(ends, "category").select("category", "n", "mean", F.when(F.col("n") >= 10, F.col("low")).alias("low"), F.when(F.col("n") >= 10, F.col("high")).alias("high"))
