"""Re-embedding: what lacks a vector of the right size gets one from a function of the caller, and can go on after a stop."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH = 128
#: Rows of one append: what a stop can lose.
SLICE_ROWS = 100_000
SAMPLE, SAME = 200, 0.999

Embedder = Callable[[list[str]], list[list[float]]]


def lacking(vector: str, size: int) -> Column:
    """Whether a vector is missing or of another size."""
    return F.col(vector).isNull() | (F.size(vector) != size)


def plan(facts: DataFrame, size: int, key: str = "uuid", text: str = "text", vector: str = "embedding") -> DataFrame:
    """(key, text) of the rows to embed: one of each key, those without a text are left as they are."""
    return facts.filter(lacking(vector, size) & F.col(text).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(text).alias(text))


def embedded(rows: DataFrame, embed: Embedder, size: int, key: str = "uuid", text: str = "text", batch: int = BATCH) -> DataFrame:
    """(key, embedding) by ``embed``, which gets up to ``batch`` texts at a time. A vector of another size stops the job."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), batch):
                some = part.iloc[at : at + batch]
                made = embed(some[text].tolist())
                if len(made) != len(some) or any(len(v) != size for v in made):
                    raise ValueError(f"the embedder must return {len(some)} vectors of {size} numbers")
                yield pd.DataFrame({key: some[key].to_numpy(), "embedding": [[float(x) for x in v] for v in made]})

    return rows.select(key, text).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, embedding array<float>")


def apply(facts: DataFrame, path: str, embed: Embedder, size: int, key: str = "uuid", text: str = "text", vector: str = "embedding", slice_rows: int = SLICE_ROWS) -> int:
    """Append the vectors of all lacking rows to the table at ``path``, slice by slice; returns how many slices ran.

    The plan is what lacks a vector and is not at ``path`` yet, so a job that was stopped goes on where its last whole slice ended, and one that is
    done does nothing. Slices are chosen by a hash of the key; each is one append.
    """
    spark = facts.sparkSession
    schema = f"{key} {facts.schema[key].dataType.simpleString()}, embedding array<float>"
    todo = plan(facts, size, key, text, vector)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        todo = todo.join(spark.read.schema(schema).parquet(path).select(key), key, "left_anti")
    slices = -(-todo.count() // slice_rows)
    for i in range(slices):
        embedded(todo.filter(F.pmod(F.xxhash64(key), F.lit(slices)) == i), embed, size, key, text).write.mode("append").parquet(path)
    return slices


def with_new(facts: DataFrame, made: DataFrame, size: int, key: str = "uuid", vector: str = "embedding") -> DataFrame:
    """``facts`` with the vectors ``made`` where theirs is lacking; others stay as they are."""
    new = made.dropDuplicates([key]).select(key, F.col("embedding").alias("_new"))
    chosen = F.when(lacking(vector, size) & F.col("_new").isNotNull(), F.col("_new").cast(facts.schema[vector].dataType)).otherwise(F.col(vector))
    return facts.join(new, key, "left").withColumn(vector, chosen).select(facts.columns)


def verified(facts: DataFrame, made: DataFrame, embed: Embedder, size: int, key: str = "uuid", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(key, cosine, same): of ``sample`` vectors chosen by hash the likeness to those that ``embed`` gives their texts now."""
    chosen = made.dropDuplicates([key]).withColumn("_h", F.xxhash64(key)).orderBy("_h").limit(sample).select(key, F.col("embedding").alias("_old"))
    texts = facts.groupBy(key).agg(F.min(text).alias(text)).join(F.broadcast(chosen.select(key)), key, "left_semi")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
    both = embedded(texts, embed, size, key, text).join(chosen, key)
    cosine = dot("embedding", "_old") / F.nullif(F.sqrt(dot("embedding", "embedding") * dot("_old", "_old")), F.lit(0.0))
    return both.select(key, cosine.alias("cosine"), F.coalesce(cosine > SAME, F.lit(False)).alias("same"))


def hashing_embedder(size: int) -> Embedder:
    """A stand-in for a model: words hashed to signed places, of unit length; a text without words is the first axis."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(size)
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[(h >> 1) % size] += 1 if h & 1 else -1
            norm = np.linalg.norm(v)
            out.append((v / norm if norm else np.eye(1, size)[0]).tolist())
        return out

    return embed
