"""Helpers shared by the corpus operators: text batches in Python tasks, word hashes, shared-folder tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.shared import Scratch, saved  # noqa: F401  the operators take them from here

#: Odd base of the polynomial byte hash and its inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Documents are hashed in runs of about so many bytes, to keep the arrays in cache.
RUN_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(parts: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that what is made of one stays small."""
    for part in parts:
        for at in range(0, part.num_rows, rows):
            yield part.slice(at, rows)


def unused(name: str, df: DataFrame) -> str:
    """``name``, with underscores before it until no column of ``df`` has it, whatever the case and a trailing underscore."""
    taken = {c.lower().rstrip("_") for c in df.columns}
    while name.lower().rstrip("_") in taken:
        name = f"_{name}"
    return name


def map_texts(df: DataFrame, run: Callable[[list[str]], list], kind: T.DataType, arrow: pa.DataType, out: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df``'s columns ``keep`` (all by default) and ``out``: what ``run`` makes of each batch of whole texts.

    A null text counts as empty. A column that is called ``out`` already is replaced.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c != out]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, kind)])
    carried = [*dict.fromkeys([*keep, text])]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 2000):
                b = part.slice(at, 2000)
                made = run([x or "" for x in b.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(made, arrow)], names=[*keep, out])

    return df.select(*carried).mapInArrow(batches, schema)


def span_text(spans: str) -> F.Column:
    """``kind:start:end`` of an array of spans in its order, comma-joined."""
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType()), T.StructField("via", T.StringType())]))
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("via", pa.string())]))


def span_report(found: DataFrame, kinds: tuple[str, ...], spans: str = "spans") -> DataFrame:
    """The digest columns of the span queries: counts and hash of the base spans, text of all."""
    base = found.withColumn("_base", F.filter(F.col(spans), lambda s: s["base"]))

    def count(kind: str) -> F.Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in kinds]
    return base.select("doc_id", *counts, F.sha2(span_text("_base").cast("binary"), 256).alias("base_sha256"), span_text(spans).alias("spans"))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column without copying, and the n + 1 offsets of its rows."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), offsets


def runs(offsets: np.ndarray, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes each; one long row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit hashes."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, RUN_BYTES + 4096)
        for k, base in enumerate((BASE, UNBASE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def piece_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each slice ``values[start:end]``, by prefix sums of a polynomial."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_slices(word: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes, also cut at the positions ``cuts`` (starts of rows)."""
    n = len(word)
    new = np.zeros(n + 1, bool)
    new[cuts[cuts < n]] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | new[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | new[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


#: ASCII letters to lower case, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
