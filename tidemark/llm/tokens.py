"""Token counts from distinct pre-tokens, and packing of documents into sequences of fixed length."""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Scratch, read, saved

VOCABULARY = "byte_bpe_50k.json"
#: The string that the vocabulary treats as one special token inside texts, and its id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
CONTEXT = 2048
#: Id put after each packed document.
END_ID = 1
LIMIT = 1024
#: Documents of one block of pre-token frequencies.
BLOCK_DOCS = 10_000
#: Pieces packed together in one group.
GROUP_PIECES = 4096

PRETOKEN = regex.compile(public_tokenizers.PATTERN)
#: Characters outside these ranges may be of another class in the library's Unicode tables; texts that have one are split by the library.
UNSURE = re.compile(r"[^\u0000-\u0557\u1e00-\u206f\u20a0-\ua7cd\uabf0-\uffff]")

#: A space that no other character follows, or that white space follows.
LONE_SPACE = re.compile(r" (?=\s|\Z)")


def byte_letters() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    odd = iter(range(256, 512))
    return [chr(b if b in plain else next(odd)) for b in range(256)]


class Vocabulary:
    """Ids as little-endian uint32 bytes; remembers up to twice ``keep`` pre-tokens and as many stretches between spaces."""

    def __init__(self, path: str, keep: int = 250_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = str.maketrans(dict(enumerate(byte_letters())))
        self.space = self.letters[32]
        # of each, the entries since the last turnover and those before it; what is used again is moved
        self.keep, self.ids, self.old_ids, self.stretches, self.old_stretches = keep, {}, {}, {}, {}

    def pretokens(self, text: str) -> list[str]:
        if UNSURE.search(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return PRETOKEN.findall(text)

    def encode(self, pretoken: str) -> bytes:
        """Ids of one pre-token, by the library's model on its byte letters."""
        if pretoken.isascii() and pretoken.isprintable():
            letters = pretoken.replace(" ", self.space)
        else:
            letters = pretoken.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.model.tokenize(letters)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def of_pretokens(self, pretokens: list[str]) -> bytes:
        ids = self.ids
        for t in pretokens:
            if t not in ids:
                ids[t] = self.old_ids.get(t) or self.encode(t)
        return b"".join([ids[t] for t in pretokens])

    def of_plain(self, text: str) -> bytes:
        """Ids of a text without special strings.

        A space before another character always starts a pre-token, so a text can be cut there and its
        stretches looked up; texts with other spaces are cut by rule.
        """
        if not text:
            return b""
        if UNSURE.search(text) or LONE_SPACE.search(text):
            return self.of_pretokens(self.pretokens(text))
        first, *rest = text.split(" ")
        known = self.stretches
        for s in rest:
            if s not in known:
                known[s] = self.old_stretches.get(s) or self.of_pretokens(PRETOKEN.findall(" " + s))
        return b"".join([self.of_pretokens(PRETOKEN.findall(first)), *map(known.__getitem__, rest)])

    def of_text(self, text: str) -> bytes:
        """All ids of a text."""
        if len(self.ids) > self.keep:
            self.ids, self.old_ids = {}, self.ids
        if len(self.stretches) > self.keep:
            self.stretches, self.old_stretches = {}, self.stretches
        mark = np.array([SPECIAL_ID], "<u4").tobytes()
        return mark.join([self.of_plain(x) for x in text.split(SPECIAL)])


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One per Python worker and path."""
    if path not in _LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


FREQUENCIES = "block string, bucket int, tokens binary, ids array<long>, n_bytes array<long>, extra array<long>, ends binary, places binary, counts binary"
ARROW_FREQUENCIES = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("tokens", pa.binary()), ("ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("extra", pa.list_(pa.int64())), ("ends", pa.binary()), ("places", pa.binary()), ("counts", pa.binary())])


def packed_ints(x: np.ndarray) -> bytes:
    """Small integers, compressed by byte planes."""
    return zlib.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked_ints(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(x), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def packed_strings(x: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, x), "<u4", len(x))
    return np.array([len(x)], "<u4").tobytes() + zlib.compress(lengths.tobytes() + b"".join(x), 1)


def unpacked_strings(x: bytes) -> list[str]:
    n, raw = int(np.frombuffer(x[:4], "<u4")[0]), zlib.decompress(x[4:])
    ends = (4 * n + np.cumsum(np.frombuffer(raw[: 4 * n], "<u4"))).tolist()
    return [raw[a:b].decode() for a, b in zip([4 * n, *ends], ends, strict=False)]


def frequencies(df: DataFrame, path: str, buckets: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per-document pre-token frequencies, by blocks of documents.

    A block has one row with bucket -1: ids, bytes, special tokens, and per document the places (as steps) and
    counts of its pre-tokens; and a row for each bucket (hash of the pre-token) with the block's distinct
    pre-tokens of it. Places number the block's pre-tokens in order of bucket.
    """

    def block(name: str, vocab: Vocabulary, keys: list, texts: list[str]) -> pa.RecordBatch:
        seen: dict[str, int] = {}
        specials, sizes, ends, places, counts = [], [], [0], [], []
        for x in texts:
            first, *rest = x.split(SPECIAL)
            count = Counter(vocab.pretokens(first))
            for p in rest:
                count.update(vocab.pretokens(p))
            specials.append(len(rest))
            sizes.append(len(x.encode()))
            ends.append(ends[-1] + len(count))
            places.append(np.fromiter((seen.setdefault(t, len(seen)) for t in count), np.int32, len(count)))
            counts.append(np.fromiter(count.values(), np.int32, len(count)))
        strings = [t.encode() for t in seen]
        bucket = np.fromiter((zlib.crc32(t) % buckets for t in strings), np.int32, len(strings))
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        docs = np.repeat(np.arange(len(texts)), np.diff(ends))
        flat = place[np.concatenate(places)]
        by_doc = np.lexsort((flat, docs))
        flat = flat[by_doc]
        steps = np.diff(flat, prepend=0)
        firsts = np.array(ends[:-1])[np.diff(ends) > 0]
        steps[firsts] = flat[firsts]
        rows = [{"block": name, "bucket": -1, "ids": keys, "n_bytes": sizes, "extra": specials, "ends": np.array(ends, "<i8").tobytes(), "places": packed_ints(steps), "counts": packed_ints(np.concatenate(counts)[by_doc])}]
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist()
        for lo, hi in zip(cuts, [*cuts[1:], len(order)], strict=False):
            rows.append({"block": name, "bucket": int(bucket[order[lo]]), "tokens": packed_strings([strings[i] for i in order[lo:hi].tolist()])})
        return pa.RecordBatch.from_pylist(rows, schema=ARROW_FREQUENCIES)

    def blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, partition, made = vocabulary(path), TaskContext.get().partitionId(), 0
        for part in parts:
            for at in range(0, part.num_rows, BLOCK_DOCS):
                b = part.slice(at, BLOCK_DOCS)
                # a name of its own for each block, whatever its documents are
                yield block(f"{partition}-{made}", vocab, b.column(key).to_pylist(), [x or "" for x in b.column(text).to_pylist()])
                made += 1

    return df.select(F.col(key).cast("long").alias(key), text).mapInArrow(blocks, FREQUENCIES)


def piece_counts(frequency: DataFrame, path: str, buckets: int) -> DataFrame:
    """Number of pieces of each pre-token of each (block, bucket); each distinct pre-token of a bucket is encoded once.

    A task reads its buckets row by row and holds the distinct pre-tokens of one bucket.
    """

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pieces, name = vocabulary(path).encode, {}, None
        for b in parts:
            for i in range(b.num_rows):
                block, bucket, packed = (c[i].as_py() for c in b.columns)
                if bucket != name:
                    pieces, name = {}, bucket
                tokens = unpacked_strings(packed)
                pieces.update((t, len(encode(t)) // 4) for t in tokens if t not in pieces)
                counts = packed_ints(np.fromiter(map(pieces.__getitem__, tokens), np.int64, len(tokens)))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([bucket], pa.int32()), pa.array([counts], pa.binary())], names=["block", "bucket", "pieces"])

    dealt = frequency.filter("bucket >= 0").select("block", "bucket", "tokens").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(count, "block string, bucket int, pieces binary")


def count_tokens(df: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id", buckets: int | None = None) -> DataFrame:
    """(key, n_bytes, n_tokens) of every row; no ids are made for documents.

    A null or empty text has 0 bytes and 0 tokens; repeated rows give repeated results; a null key stays
    null; other columns are ignored. The result is a table in the shared folder.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    buckets = buckets or max(16, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = f"{key} long, n_bytes long, n_tokens long"

    def total(docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("bucket")
        weights = np.concatenate([np.zeros(0, np.int64), *(unpacked_ints(x) for x in found["pieces"])])
        out = [pd.DataFrame({key: pd.array([], dtype="Int64"), "n_bytes": [], "n_tokens": []})]
        for d in docs.itertuples():
            ends = np.frombuffer(d.ends, "<i8")
            steps = unpacked_ints(d.places)
            places = np.cumsum(steps)
            firsts = ends[:-1][np.diff(ends) > 0]
            before = np.zeros(len(steps), np.int64)
            before[firsts] = np.diff(places[firsts] - steps[firsts], prepend=0)
            places -= np.cumsum(before)
            sums = np.concatenate([[0], np.cumsum(weights[places] * unpacked_ints(d.counts))])
            out.append(pd.DataFrame({key: pd.array(list(d.ids), dtype="Int64"), "n_bytes": d.n_bytes, "n_tokens": np.diff(sums[ends]) + np.asarray(d.extra)}))
        return pd.concat(out[1:] or out)

    with Scratch(df.sparkSession) as scratch:
        frequency = scratch.saved(frequencies(df, path, buckets, text, key))
        pieces = piece_counts(frequency, path, buckets)
        docs = frequency.filter("bucket < 0").select("block", "ids", "n_bytes", "extra", "ends", "places", "counts")
        return saved(docs.groupBy("block").cogroup(pieces.groupBy("block")).applyInPandas(total, schema))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(read(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(df: DataFrame, path: str, context: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pieces of the documents: full windows of ``context`` ids, then the rest; ids end with END_ID."""
    schema = PIECES.replace("doc_id", key)
    names = [x.split()[0] for x in schema.split(", ")]

    def pieces(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        end = np.array([END_ID], "<u4").tobytes()
        for part in parts:
            for at in range(0, part.num_rows, 500):
                b = part.slice(at, 500)
                rows = []
                for k, x in zip(b.column(key).to_pylist(), b.column(text).to_pylist(), strict=True):
                    ids = vocab.of_text(x or "") + end
                    for s in range(0, len(ids), 4 * context):
                        piece = ids[s : s + 4 * context]
                        rows.append((k, s // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=names)

    return df.select(F.col(key).cast("long").alias(key), text).mapInArrow(pieces, schema)


class Windows:
    """Open windows by remaining capacity, over a segment tree: finds the smallest capacity that is large enough."""

    def __init__(self, context: int):
        self.leaves = 1 << context.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(context + 1)]

    def _add(self, capacity: int, by: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, window: int, capacity: int) -> None:
        if capacity:
            self.open[capacity].append(window)
            self._add(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """The window with the least capacity of ``least`` or more, and that capacity."""
        i, count = least + self.leaves, self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        self._add(capacity, -1)
        return self.open[capacity].pop(), capacity


def best_fit(lengths: list[int], context: int) -> list[tuple[int, int]]:
    """(window, offset) of each length, which come in descending order."""
    windows, out, made = Windows(context), [], 0
    for n in lengths:
        if (found := windows.take(n)) is None:
            found, made = (made, context), made + 1
        window, capacity = found
        out.append((window, context - capacity))
        windows.put(window, capacity - n)
    return out


def pack(df: DataFrame, path: str | None = None, context: int = CONTEXT, text: str = "text", key: str = "doc_id", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Place every document's ids into sequences of at most ``context``, best fit by decreasing length.

    Pieces are dealt by a hash of what they are and their place in the table into groups of about ``group_pieces``, each packed on its
    own: what one group pads is less than one sequence more than the whole would. A null or empty text has
    the end id alone; repeated rows are placed as often as they come; other columns are ignored.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    pieces = saved(cut(df, path, context, text, key))
    groups = max(1, round(pieces.count() / group_pieces))
    schema = f"{PIECES.replace('doc_id', key)}, sequence_id long, offset long, padding long"

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", key, "start"], ascending=[False, True, True], kind="stable", ignore_index=True)
        placed = np.array(best_fit(rows["length"].tolist(), context), np.int64)
        used = np.bincount(placed[:, 0], rows["length"]).astype(np.int64)[placed[:, 0]]
        padding = np.where(used & (used - 1), context - used, 0)
        return rows.drop(columns="_g").assign(**{key: rows[key].astype("Int64"), "sequence_id": (rows["_g"].to_numpy(np.int64) << 32) + placed[:, 0], "offset": placed[:, 1], "padding": padding})

    dealt = pieces.withColumn("_g", F.pmod(F.xxhash64(key, "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("_g").applyInPandas(place, schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
