"""Byte-level BPE: new pre-tokens of many texts are merged together as rows of padded matrices; ids decode by a table of bytes."""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, runs, slices, text_bytes

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Rank of a pair that no token holds.
NONE = np.int32(np.iinfo(np.int32).max)
#: Bytes of the longest pre-token that is a matrix row. A row takes the square of its length, so longer ones are merged by a heap.
ROW_BYTES = 1024
#: Cells of one matrix at most.
CELLS = 1 << 20
#: Texts are encoded in runs of about so many bytes.
RUN_BYTES = 1 << 20

PRETOKEN = regex.compile(public_tokenizers.PATTERN)
#: Characters outside these ranges may be of another class in the library's Unicode tables.
UNSURE = re.compile(r"[^\u0000-\u0557\u1e00-\u206f\u20a0-\ua7cd\uabf0-\uffff]")
#: A space that no other character follows, or that white space follows.
LONE_SPACE = re.compile(r" (?=\s|\Z)")


class Classes(dict):
    """For ``str.translate``: characters that the library puts into another class than ``regex`` become one of that class."""

    def __init__(self) -> None:
        single = {bytes([i]): i for i in range(256)}
        self.tests = [(tiktoken.Encoding(f"class{i}", pat_str=p, mergeable_ranks=single, special_tokens={}), regex.compile(p), like) for i, (p, like) in enumerate(((r"\p{L}", "é"), (r"\p{N}", "1"), (r"[^\s\p{L}\p{N}]", "#")))]

    def __missing__(self, code: int) -> int:
        c = chr(code)
        self[code] = code
        if UNSURE.match(c):
            for library, own, like in self.tests:
                if library.encode_ordinary(c) and not own.match(c):
                    self[code] = ord(like)
        return self[code]


class Pairs:
    """Rank of the token that two adjacent tokens make: open addressing over arrays, looked up for whole arrays."""

    def __init__(self, rank: dict[bytes, int]):
        made = [(rank[t[:i]] << 32 | rank[t[i:]], r) for t, r in rank.items() for i in range(1, len(t)) if t[:i] in rank and t[i:] in rank]
        pairs = np.array(made, np.int64).reshape(-1, 2)
        self.bits = max(4, 2 + len(pairs).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        left, slot = np.arange(len(pairs)), self.slot(pairs[:, 0])
        while len(left):
            # of those that meet at an empty slot the first stays, the others go on to the next one
            _, first = np.unique(slot, return_index=True)
            first = first[self.keys[slot[first]] == -1]
            self.keys[slot[first]], self.ranks[slot[first]] = pairs[left[first]].T
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, slot = left[rest], (slot[rest] + 1) & (len(self.keys) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 32 | b
        slot = self.slot(keys)
        found, out = self.keys[slot], self.ranks[slot]
        at = np.flatnonzero((found != keys) & (found != -1))
        while len(at):
            slot = (slot[at] + 1 if len(slot) != len(at) else slot + 1) & (len(self.keys) - 1)
            out[at] = self.ranks[slot]
            on = (self.keys[slot] != keys[at]) & (self.keys[slot] != -1)
            at, slot = at[on], slot[on]
        return out


class Codec:
    """Encoder and decoder of one file of ranks; remembers up to twice ``keep`` pre-tokens and as many stretches between spaces."""

    def __init__(self, path: str, keep: int = 120_000):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.size = max(self.rank.values(), default=-1) + 1
        tokens = [b""] * self.size
        for token, rank in self.rank.items():
            tokens[rank] = token
        self.tokens = tokens
        self.known = np.array([bool(t) for t in tokens], bool)
        self.lengths = np.array([*map(len, tokens)], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.single = np.array([self.rank[bytes([i])] for i in range(256)], np.int32)
        self.pairs, self.classes = Pairs(self.rank), Classes()
        self.keep, self.ids, self.old_ids, self.stretches, self.old_stretches = keep, {}, {}, {}, {}

    def pretokens(self, text: str) -> list[str]:
        """Matches of the library's pattern, by its Unicode tables."""
        if UNSURE.search(text) and (like := text.translate(self.classes)) != text:
            return [text[m.start() : m.end()] for m in PRETOKEN.finditer(like)]
        return PRETOKEN.findall(text)

    def merged(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian uint32 bytes; words of a matrix have alike lengths."""
        out: list[bytes] = [b""] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        lo = 0
        while lo < len(order):
            shortest = int(size[order[lo]])
            if shortest > ROW_BYTES:
                for i in order[lo:].tolist():
                    out[i] = self.by_heap(words[i])
                break
            # a bucket: lengths up to a quarter more than its shortest, as many rows as CELLS allow
            widest = min(ROW_BYTES, shortest + shortest // 4)
            hi = min(int(np.searchsorted(size[order], widest, "right")), lo + max(1, CELLS // max(1, widest)))
            self.bucket([words[i] for i in order[lo:hi].tolist()], order[lo:hi], out)
            lo = hi
        return out

    def bucket(self, words: list[bytes], places: np.ndarray, out: list[bytes]) -> None:
        """Merge one bucket: a round joins the leftmost pair of least rank of every row, then closes the gaps; rows without a pair leave."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        width = int(length.max())
        inside = np.arange(width) < length[:, None]
        ids = np.zeros(inside.shape, np.int32)
        ids[inside] = self.single[np.frombuffer(b"".join(words), np.uint8)]
        ranks = np.full((len(words), width), NONE, np.int32)  # of each cell and its right neighbour
        pair = inside[:, 1:]
        ranks[:, :-1][pair] = self.pairs.of(ids[:, :-1][pair], ids[:, 1:][pair])
        while len(ids):
            at = ranks.argmin(axis=1)
            row = np.arange(len(ids))
            least = ranks[row, at]
            done = least == NONE
            if done.any():
                raw, step = ids[done].astype("<u4").tobytes(), 4 * ids.shape[1]
                for k, (place, n) in enumerate(zip(places[done].tolist(), length[done].tolist(), strict=True)):
                    out[place] = raw[k * step : k * step + 4 * n]
                on = ~done
                ids, ranks, length, places, at, least = ids[on], ranks[on], length[on], places[on], at[on], least[on]
                row = np.arange(len(ids))
                if not len(ids):
                    return
            ids[row, at] = least
            stay = np.arange(ids.shape[1]) != at[:, None] + 1
            ids, ranks = ids[stay].reshape(len(ids), -1), ranks[stay].reshape(len(ids), -1)
            length = length - 1
            ranks[row, at] = NONE
            right = np.flatnonzero(at + 1 < length)
            ranks[right, at[right]] = self.pairs.of(ids[right, at[right]], ids[right, at[right] + 1])
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.pairs.of(ids[left, at[left] - 1], ids[left, at[left]])

    def by_heap(self, word: bytes) -> bytes:
        """The same merges of one very long word: its pairs wait in a heap by rank and place."""
        n, rank, tokens = len(word), self.rank, self.tokens
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]

        def of(i: int) -> int | None:
            j = after[i]
            return rank.get(tokens[ids[i]] + tokens[ids[j]]) if j < n else None

        heap = [r << 40 | i for i in range(n) if (r := of(i)) is not None]
        heapq.heapify(heap)
        while heap:
            x = heapq.heappop(heap)
            r, i = x >> 40, x & ((1 << 40) - 1)
            if ids[i] < 0 or of(i) != r:
                continue
            j = after[i]
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (made := of(k)) is not None:
                    heapq.heappush(heap, made << 40 | k)
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def learn(self, pretokens: Iterable[str]) -> None:
        """Encode those that are not known yet: whole tokens by their rank, the others in matrices."""
        rank, ids, new = self.rank, self.ids, {}
        for t in pretokens:
            if t not in ids:
                if (old := self.old_ids.get(t)) is not None:
                    ids[t] = old
                else:
                    new[t] = t.encode()
        apart = {}
        for t, b in new.items():
            if (whole := rank.get(b)) is not None:
                ids[t] = whole.to_bytes(4, "little")
            else:
                apart[t] = b
        ids.update(zip(apart, self.merged([*apart.values()]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes.

        A space before another character always starts a pre-token, so a text is cut there and its stretches
        are looked up; texts with other spaces or odd characters are cut by the pattern as wholes.
        """
        if len(self.ids) > self.keep:
            self.ids, self.old_ids = {}, self.ids
        if len(self.stretches) > self.keep:
            self.stretches, self.old_stretches = {}, self.stretches
        known, whole, new, cut = self.stretches, {}, {}, []
        for i, text in enumerate(texts):
            if UNSURE.search(text) or LONE_SPACE.search(text):
                whole[i] = self.pretokens(text)
                cut.append(None)
                continue
            first, *rest = text.split(" ")
            whole[i] = PRETOKEN.findall(first)
            cut.append(rest)
            for s in rest:
                if s not in known:
                    if (old := self.old_stretches.get(s)) is not None:
                        known[s] = old
                    else:
                        new[s] = None
        for s in new:
            new[s] = PRETOKEN.findall(" " + s)
        self.learn(t for found in (*whole.values(), *new.values()) for t in found)
        ids = self.ids
        for s, found in new.items():
            known[s] = b"".join([ids[t] for t in found])
        return [b"".join([*map(ids.__getitem__, whole[i]), *map(known.__getitem__, rest or ())]) for i, rest in enumerate(cut)]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids in a row, and the ends in them of the rows that end at ``ends`` in the ids. Ids must be of the vocabulary."""
        size = self.lengths[ids]
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        places = np.repeat(self.starts[ids] - upto[:-1], size) + np.arange(upto[-1])
        return self.flat[places], upto[ends]


_LOADED: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One per Python worker and path."""
    if path not in _LOADED:
        _LOADED[path] = Codec(path)
    return _LOADED[path]


def mapped(df: DataFrame, source: str, out: str, make) -> DataFrame:
    """``df`` with the binary column ``out`` that ``make`` makes of batches of ``source``; a column of that name is replaced."""
    keep = [c for c in df.columns if c != out]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.BinaryType())])
    carried = [*dict.fromkeys([*keep, source])]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            for b, made in make(part, source):
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), made], names=[*keep, out])

    return df.select(*carried).mapInArrow(batches, schema)


def encode(df: DataFrame, path: str | None = None, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``: the ids of every whole text, as little-endian unsigned 32-bit integers.

    Each match of the pattern is merged by itself and no string is special. A null or empty text has no ids; repeated rows give
    repeated results; other columns stay as they are. Work is linear in the texts, whatever their words: a pre-token of more than
    ROW_BYTES bytes is merged by a heap. Texts are taken in runs of about RUN_BYTES, one long text by itself.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def make(part: pa.RecordBatch, source: str) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
        own = codec(path)
        for lo, hi in runs(text_bytes(part.column(source))[1], RUN_BYTES):
            b = part.slice(lo, hi - lo)
            yield b, pa.array(own.encode([x or "" for x in b.column(source).to_pylist()]), pa.binary())

    return mapped(df, text, out, make)


def decode(df: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the bytes of the ids in ``ids``, which are little-endian unsigned 32-bit integers.

    Null ids, ids outside the vocabulary and bytes that are no whole integers give null; no ids give no bytes.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def make(part: pa.RecordBatch, source: str) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
        own = codec(path)
        column = part.column(source).cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        for lo, hi in runs(offsets, RUN_BYTES):
            rows = [x if x is not None and len(x) % 4 == 0 else None for x in column.slice(lo, hi - lo).to_pylist()]
            found = np.frombuffer(b"".join(x or b"" for x in rows), "<u4").astype(np.int64)
            ends = np.cumsum([len(x or b"") // 4 for x in rows])
            odd = found >= own.size
            odd[~odd] = ~own.known[found[~odd]]
            whole, upto = own.decode(np.where(odd, 0, found), ends)
            raw, starts, wrong = whole.tobytes(), [0, *upto.tolist()], np.concatenate([[0], np.cumsum(odd)])[np.concatenate([[0], ends])]
            made = [None if x is None or wrong[i + 1] > wrong[i] else raw[starts[i] : starts[i + 1]] for i, x in enumerate(rows)]
            yield part.slice(lo, hi - lo), pa.array(made, pa.binary())

    return mapped(df, ids, out, make)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = decode(encode(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    return coded.select("doc_id", F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
