"""Quality classifier: hashed word and character n-gram vectors averaged per document, softmax output."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, mix, piece_hashes, read, runs, text_bytes, word_slices

#: Rows of the embedding table, its width.
TABLE, WIDTH = 1 << 18, 8
#: Labelled documents (the smallest hashes of their ids) that training sees at most.
SAMPLE_ROWS = 3000
#: Bytes of their texts together; in the order of the hashes, a text that does not fit in what is left is passed over, whole.
SAMPLE_BYTES = 64 << 20
EPOCHS, RATE, SEED = 6, 0.5, 7
#: A step moves a document's average by this share of the rate, however many features it has.
STEP = 0.2
#: Folds of crc32(doc_id as text); the held-out one is never learned from.
FOLDS, HELD_OUT = 3, 1
#: Bytes of one text, about, that are turned into features at a time.
PART = 1 << 20


def features(text: np.ndarray) -> Iterator[np.ndarray]:
    """Table rows of one text's bytes, in parts that end at white space: words, word pairs, byte 3- and 4-grams.

    What crosses the end of a part - a pair, a gram - is carried over, so the parts make no difference.
    """
    space = (text == 32) | ((text >= 9) & (text <= 13))
    last, tail, at = np.empty(0, np.uint64), np.empty(0, np.uint32), 0
    top = np.uint32(32 - 18)
    while at < len(text):
        end = at + PART
        while end < len(text) and not (found := np.flatnonzero(space[end : end + PART])).size:
            end += PART
        end = end + int(found[0]) if end < len(text) else len(text)
        part, gap = text[at:end], space[at:end]
        words = piece_hashes(part, *word_slices(~gap, np.zeros(1, np.int64)))
        row = np.concatenate([last, words])
        pairs = mix(row[:-1] * np.uint64(3) + row[1:] * np.uint64(5))
        own = part.astype(np.uint32)
        own[gap] = 32
        three, four = np.concatenate([tail[-2:], own]), np.concatenate([tail, own])
        three = (three[:-2] | three[1:-1] << np.uint32(8) | three[2:] << np.uint32(16)) if len(three) > 2 else three[:0]
        four = (four[:-3] | four[1:-2] << np.uint32(8) | four[2:-1] << np.uint32(16) | four[3:] << np.uint32(24)) if len(four) > 3 else four[:0]
        yield np.concatenate([words >> np.uint64(46), pairs >> np.uint64(46), (three * np.uint32(0x9E3779B1)) >> top, (four * np.uint32(0x85EBCA77) ^ (four >> np.uint32(15))) * np.uint32(0xC2B2AE3D) >> top]).astype(np.int64)
        last, tail, at = row[-1:], np.concatenate([tail, own])[-3:], end


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a text and their shares."""
    rows = np.concatenate([np.empty(0, np.int64), *features(np.frombuffer(text, np.uint8))])
    distinct, counts = np.unique(rows, return_counts=True)
    return distinct.astype(np.int32), (counts / max(1, len(rows))).astype(np.float32)


class Model:
    """``table``: an embedding for each hashed feature; ``out``: softmax weights of the average; ``bias``."""

    def __init__(self, table: np.ndarray, out: np.ndarray, bias: np.ndarray):
        self.table, self.out, self.bias = table, out, bias

    def line(self) -> tuple[np.ndarray, float]:
        """The logit of label 1 is linear in the average, so each feature's share of it is one number."""
        return self.table @ (self.out[:, 1] - self.out[:, 0]), float(self.bias[1] - self.bias[0])


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Stochastic gradient descent on cross entropy; classes weigh alike, so a rare label is learned too."""
    random = np.random.default_rng(seed)
    table = random.uniform(-1 / WIDTH, 1 / WIDTH, (TABLE, WIDTH)).astype(np.float32)
    out, bias = np.zeros((WIDTH, 2), np.float32), np.zeros(2, np.float32)
    share = np.bincount(labels, minlength=2) / max(1, len(labels))
    weight = 0.5 / np.maximum(share, 0.05)
    bags = [bag(t) for t in texts]
    steps, at = max(1, epochs * len(bags)), 0
    for _ in range(epochs):
        for i in random.permutation(len(bags)):
            rows, shares = bags[i]
            now = rate * (1 - at / steps)
            at += 1
            vectors = table[rows]
            mean = shares @ vectors
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= weight[labels[i]]
            back = out @ p
            out -= now * np.outer(mean, p)
            bias -= now * p
            if len(rows):
                table[rows] = vectors - now * STEP * np.outer(shares / float(shares @ shares), back)
    return Model(table, out, bias)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS, text: str = "text", key: str = "doc_id", label: str = "quality", budget: int = SAMPLE_BYTES) -> Model:
    """Train on at most ``sample`` labelled documents outside the held-out fold, of ``budget`` bytes together. Repeated labels of a key: the largest; repeated texts: the least."""
    fold = F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).filter(fold != HELD_OUT).groupBy(key).agg(F.max(label).cast("int").alias("_label"))
    chosen = known.orderBy(F.xxhash64(F.col(key).cast("string")), key).limit(sample)
    # one text of each key, so that a key of many rows does not fill the driver
    one = docs.select(key, text).join(F.broadcast(chosen), key).groupBy(key).agg(F.min(F.coalesce(F.col(text), F.lit(""))).cast("binary").alias("t"), F.first("_label").alias("_label"))
    with Scratch(docs.sparkSession) as scratch:
        table = scratch.saved(one.select(key, "t", "_label", F.octet_length("t").alias("size"), F.xxhash64(F.col(key).cast("string")).alias("h")))
        taken = within(sorted((r["h"], int(r[key]), r["size"]) for r in table.select("h", key, "size").collect()), budget)
        rows = sorted((int(r[key]), bytes(r["t"]), int(r["_label"])) for r in table.filter(F.col(key).isin(taken)).select(key, "t", "_label").collect())
    return train([r[1] for r in rows], [r[2] for r in rows])


def within(sizes: list[tuple[int, int, int]], budget: int) -> list[int]:
    """Of (hash, key, size) in order the keys whose sizes fit in ``budget`` together."""
    taken = []
    for _, key, size in sizes:
        if size <= budget:
            taken.append(key)
            budget -= size
    return taken


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Add ``out``: the probability of label 1 for each whole text.

    Null and empty texts score the model's bias; equal texts score alike; a column called ``out`` is
    replaced, other columns pass through. Model: a fixed number of floats, whatever the data.
    """
    line, bias = model.line()
    keep = [c for c in (df.columns if keep is None else keep) if c != out]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(line.astype(np.float32))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for b in parts:
            data, offsets = text_bytes(b.column(text))
            logits = np.full(b.num_rows, bias)
            for i in range(b.num_rows):
                total, n = 0.0, 0
                for rows in features(data[offsets[i] : offsets[i + 1]]):
                    total += float(weights[rows].sum(dtype=np.float64))
                    n += len(rows)
                logits[i] += total / max(1, n)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(1 / (1 + np.exp(-np.clip(logits, -500, 500))))], names=[*keep, out])

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(batches, schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, read(spark, sf_dir, "labels")), keep=["doc_id"])
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
