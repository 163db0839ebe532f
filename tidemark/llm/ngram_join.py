"""Exact Jaccard join of documents on word n-grams by T-occurrence search over inverted lists (DivideSkip).

1. Each distinct set of shingles is a class; its 64-bit hash is its node.
2. Prefix filter: in one order of all shingles (common ones last), linked sets share at least k of their first
   ``n - ceil(share * n) + k`` shingles. Classes that share one after ``keys`` are in one candidate component.
3. Candidate components of up to BLOCK classes are searched whole, over inverted lists of what sets differ in;
   those of up to PAIRED blocks by pairs of blocks. Larger ones are searched in blocks, each with the same few
   pilots, which joins almost all near copies of a large group without pairing them.
4. What that leaves open - classes of a large component with enough prefix shingles in common with other joined
   parts - is searched shingle by shingle, in blocks: every class outside the shingle's largest part against all.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.components import components

from .common import LOWER, Scratch, mix, piece_hashes, read, runs, saved, slices, text_bytes, unused, word_slices

WORDS, SHARE = 4, 85
#: Common shingles that the order of the prefix filter knows; any list gives the same result.
COMMON = 16_384
#: A shingle is counted if so many documents of one batch have it.
BATCH_COUNT = 4
#: A prefix has 1/SLACK of its set more than one shared shingle needs; linked prefixes then share about so many.
SLACK = 20
#: Classes searched together, their shingles (8 bytes each), and the classes of a large component that each of its blocks gets.
BLOCK, BLOCK_GRAMS, PILOTS = 4096, 2_000_000, 8
#: A component of up to so many blocks is searched by pairs of blocks: each set goes to one task for each other block.
PAIRED = 16
#: Entries that are merged by a heap; more are merged as sorted runs.
HEAP = 256
#: Up to so many rows of ids (32 bytes each) are broadcast to texts and sets; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Cost of a step of the merge against a probe, from the DivideSkip paper; sets the number of long lists.
MU = 0.0085


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word n-grams; fewer words than n are one, no words none."""
    data, offsets = text_bytes(texts)
    out = []
    for i, j in runs(offsets):
        raw = LOWER[data[offsets[i] : offsets[j]]]
        cuts = offsets[i:j] - offsets[i]
        starts, ends = word_slices(~((raw == 32) | ((raw >= 9) & (raw <= 13))), cuts)
        h = piece_hashes(raw, starts, ends)
        grams = np.zeros(max(0, len(h) - words + 1), np.uint64)
        for k in range(words):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(grams)]
        grams = mix(grams)
        bounds = np.append(np.searchsorted(starts, cuts), len(starts))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if hi - lo >= words:
                out.append(np.unique(grams[lo : hi - words + 1]))
            elif hi > lo:
                whole = np.array([hi - lo], np.uint64)
                for x in range(lo, hi):
                    whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) + h[x])
                out.append(whole)
            else:
                out.append(np.empty(0, np.uint64))
    return out


def common_shingles(df: DataFrame, words: int, text: str) -> np.ndarray:
    """Up to COMMON shingles of the most documents, by descending count: a proven bound for what is sent to tasks."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            sets = shingle_sets(b.column(0), words)
            grams, n = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_counts=True)
            often = n >= BATCH_COUNT
            yield pa.RecordBatch.from_arrays([pa.array(grams[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["g", "n"])

    counts = df.select(text).mapInArrow(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "g").limit(COMMON).collect()
    return np.array([r["g"] for r in rows], np.int64).view(np.uint64)


class Order:
    """Position of shingles: unknown ones first, by hash; then the common ones, least common first."""

    def __init__(self, common: np.ndarray):
        self.sorted = np.sort(common)
        self.rank = np.arange(len(common), 0, -1)[np.argsort(common)]

    def prefix(self, grams: np.ndarray, share: int) -> np.ndarray:
        n = len(grams) - -(-share * len(grams) // 100) + max(1, len(grams) // SLACK)
        if len(self.sorted):
            at = np.searchsorted(self.sorted, grams)
            at[at == len(self.sorted)] = 0
            rank = np.where(self.sorted[at] == grams, self.rank[at], 0)
            if rank.any():
                return grams[np.argsort(rank, kind="stable")[:n]]
        return grams[:n]


def node_of(grams: np.ndarray) -> int:
    """Hash of a set; 63 bits, so that all nodes are positive."""
    x = mix(grams.sum(dtype=np.uint64, keepdims=True) + np.array([len(grams)], np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return int(x[0] ^ np.bitwise_xor.reduce(mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)))) >> 1


def signatures(df: DataFrame, common: np.ndarray, words: int, share: int, text: str, key: str) -> DataFrame:
    """A row for each document: key, set size, node (null without words) and, once per batch and node, the prefix."""
    order = df.sparkSession.sparkContext.broadcast(Order(common))

    def sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(parts):
            seen, nodes, sizes, prefixes = set(), [], [], []
            for grams in shingle_sets(b.column(text), words):
                node = node_of(grams) if len(grams) else None
                nodes.append(node)
                sizes.append(len(grams))
                prefixes.append(order.value.prefix(grams, share) if node is not None and node not in seen else grams[:0])
                seen.add(node)
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*prefixes, np.empty(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("_row"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), lists], names=[key, "_row", "n_shingles", "node", "prefix"])

    return with_row(df, text, key).mapInArrow(sign, f"{key} long, _row long, n_shingles long, node long, prefix array<long>")


def with_row(df: DataFrame, text: str, key: str) -> DataFrame:
    """``_row`` finds a document again: a hash of its key and text."""
    return df.select(F.col(key).cast("long").alias(key), F.xxhash64(F.col(key).cast("long"), text).alias("_row"), text)


def sets_of(df: DataFrame, wanted: DataFrame, words: int, text: str, key: str) -> DataFrame:
    """(node, grams) of the nodes in ``wanted`` (_row, node)."""

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(parts):
            found = [(n, s.tobytes()) for n, s in zip(b.column("node").to_pylist(), shingle_sets(b.column(text), words), strict=True) if len(s) and node_of(s) == n]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], names=["node", "grams"])

    return with_row(df, text, key).select("_row", text).join(wanted, "_row").select("node", text).mapInArrow(make, "node long, grams binary")


def linked(a: int, b: int, both: int, share: int) -> bool:
    return 100 * both >= share * (a + b - both)


class Search:
    """Inverted lists over the sets of one block, and the parts that are joined so far.

    Lists hold what each set differs in from the shingles that most sets of the block have: a set that lacks one of
    those stands in its list, one that has it does not. So no list is longer than half the block, and a large group
    of near copies leaves short lists. Differences of two sets are the same in both forms, so overlaps are exact.
    """

    def __init__(self, sets: list[np.ndarray], parts: list[int], share: int):
        self.share, n = share, len(sets)
        self.sizes = np.array([len(s) for s in sets])
        names = {p: i for i, p in enumerate(dict.fromkeys(parts))}
        self.part = np.array([names[p] for p in parts])
        owners = np.repeat(np.arange(n), self.sizes)
        grams, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        usual = np.flatnonzero(2 * counts > n)
        place = np.full(len(grams), -1)
        place[usual] = np.arange(len(usual))
        lacks = np.ones((len(usual), n), bool)
        own = place[inverse] >= 0
        lacks[place[inverse[own]], owners[own]] = False
        which, absent = np.nonzero(lacks)
        owners, inverse = np.concatenate([owners[~own], absent]), np.concatenate([inverse[~own], usual[which]])
        self.rows = np.bincount(owners, minlength=n)
        by_owner = np.argsort(owners, kind="stable")
        self.differs = np.split(inverse[by_owner], np.cumsum(self.rows)[:-1])
        order = np.lexsort((owners, inverse))
        self.lists = owners[order]
        self.ends = np.cumsum(np.bincount(inverse, minlength=len(grams)))

    def common(self, q: int, allowed: np.ndarray) -> np.ndarray:
        """Shingles that the sets ``allowed`` must share with set q to be linked."""
        return -(-self.share * (self.sizes[q] + self.sizes[allowed]) // (100 + self.share))

    def candidates(self, q: int) -> np.ndarray:
        """Sets of other parts whose size allows a link."""
        n = self.sizes[q]
        return np.flatnonzero((self.part != self.part[q]) & (100 * self.sizes >= self.share * n) & (self.share * self.sizes <= 100 * n))

    def find(self, q: int) -> list[int]:
        """Linked sets of other parts: merge the short lists of what q differs in, probe the long ones (DivideSkip)."""
        allowed = self.candidates(q)
        # sets with T differences in common have enough shingles in common; without any, T is 0 or less
        least = self.common(q, allowed) - (self.sizes[q] + self.sizes[allowed] - self.rows[q] - self.rows[allowed]) // 2
        out = allowed[least <= 0].tolist()
        rest = (least > 0) & (least <= np.minimum(self.rows[q], self.rows[allowed]))
        if not rest.any():
            return out
        wanted = np.full(len(self.sizes), np.iinfo(np.int64).max)
        wanted[allowed[rest]] = least[rest]
        at = self.differs[q]
        ends = self.ends[at]
        starts = np.where(at > 0, self.ends[at - 1], 0)
        order = np.argsort(ends - starts, kind="stable")
        need, longest = int(least[rest].min()), int((ends - starts).max())
        n_long = min(need - 1, int(need / (MU * np.log2(max(2, longest)) + 1)))
        short, long = order[: len(order) - n_long], order[len(order) - n_long :]
        found, counts = merged([self.lists[starts[i] : ends[i]] for i in short])
        near = counts >= need - n_long
        found, counts = found[near], counts[near].copy()
        for i in long:
            other = self.lists[starts[i] : ends[i]]
            counts += other[np.minimum(np.searchsorted(other, found), len(other) - 1)] == found
        return out + found[counts >= wanted[found]].tolist()

    def join(self) -> Iterator[tuple[int, int]]:
        """Links that join all parts of the block that links can join; no pair inside a part is looked at."""
        tried = set()
        while True:
            sizes = np.bincount(self.part)
            largest = int(sizes.argmax())
            # one try from inside the largest part while it grows that way, then each set outside of it
            q = int(np.flatnonzero(self.part == largest)[0])
            if q in tried:
                break
            tried.add(q)
            yield from self._take(q)
        # another part may become the largest meanwhile: of any two parts, the sets of one have all been tried in the end
        while left := [q for q in np.flatnonzero(self.part != np.bincount(self.part).argmax()).tolist() if q not in tried]:
            for q in left:
                if self.part[q] != np.bincount(self.part).argmax():
                    tried.add(q)
                    yield from self._take(q)

    def _take(self, q: int) -> Iterator[tuple[int, int]]:
        for c in self.find(q):
            if self.part[c] != self.part[q]:
                self.part[self.part == self.part[c]] = self.part[q]
                yield q, c


def merged(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct entries of sorted lists and how many lists have each: a heap merge, or of many entries a merge of sorted runs."""
    if sum(map(len, lists)) <= HEAP:
        pairs = [(c, sum(1 for _ in group)) for c, group in groupby(heapq.merge(*(x.tolist() for x in lists)))]
        return np.array([c for c, _ in pairs], np.int64), np.array([n for _, n in pairs], np.int64)
    flat = np.sort(np.concatenate(lists), kind="stable")
    first = np.flatnonzero(np.diff(flat, prepend=-1))
    return flat[first], np.diff(first, append=len(flat))


class Overlap(Search):
    """The same search for an absolute overlap: the greater of two sets' ``least``."""

    def __init__(self, sets: list[np.ndarray], parts: list[int], least: list[int]):
        super().__init__(sets, parts, 0)
        self.least = np.array(least)

    def candidates(self, q: int) -> np.ndarray:
        return np.flatnonzero((self.part != self.part[q]) & (self.sizes >= max(1, self.least[q])) & (self.least <= self.sizes[q]))

    def common(self, q: int, allowed: np.ndarray) -> np.ndarray:
        return np.maximum(1, np.maximum(self.least[q], self.least[allowed]))


def by_block(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict]]:
    """Rows of one block after the other, by node: (part, least, set)."""
    held, name = {}, None
    for b in parts:
        grams = b.column("grams")
        if pa.types.is_list(grams.type):
            values, ends = grams.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *pc.list_value_length(grams).to_pylist()])
            sets = [values[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]
        else:
            sets = [np.frombuffer(x, np.uint64) for x in grams.to_pylist()]
        for block, node, part, least, grams in zip(*(b.column(c).to_pylist() for c in ("block", "node", "part", "least")), sets, strict=True):
            if block != name and held:
                yield name, held
                held = {}
            name = block
            held[node] = (part, least, grams)
    if held:
        yield name, held


def per_block(rows: DataFrame, run, schema: str) -> DataFrame:
    """``rows`` (block, node, part, least, grams) dealt by block to ``run``."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("block", "node", "part", "least", "grams").repartition(parts, "block").sortWithinPartitions("block").mapInArrow(run, schema)


def search(rows: DataFrame, share: int) -> DataFrame:
    """(a, b): links within each block of ``rows``; sets of one part aren't compared."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in by_block(parts):
            nodes = sorted(held)
            if len(nodes) < 2:
                continue
            if len(nodes) == 2:
                (p, _, x), (r, _, y) = held[nodes[0]], held[nodes[1]]
                links = [(0, 1)] if p != r and linked(len(x), len(y), len(np.intersect1d(x, y, True)), share) else []
            else:
                links = list(Search([held[n][2] for n in nodes], [held[n][0] for n in nodes], share).join())
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([nodes[x[k]] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return per_block(rows, run, "a long, b long")


def possible(rows: DataFrame) -> DataFrame:
    """(a, b): what joins the classes of each block that have ``least`` of their few shingles in common."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in by_block(parts):
            nodes = sorted(held)
            links = list(Overlap([held[n][2] for n in nodes], [held[n][0] for n in nodes], [held[n][1] for n in nodes]).join())
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([nodes[x[k]] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return per_block(rows, run, "a long, b long")


def shared_grams(signed: DataFrame, share: int) -> DataFrame:
    """(gram, node, least): prefix shingles that several classes have. Linked classes share ``least`` of them or more."""
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n_shingles") * share / 100) / SLACK)).cast("int")
    # dealt once, by shingle: the count and the join then need no shuffle of their own
    parts = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tokens = signed.select("node", least.alias("least"), F.explode("prefix").alias("gram")).repartition(parts, "gram")
    shared = tokens.groupBy("gram").agg(F.min("node").alias("_a"), F.max("node").alias("_z")).filter("_a < _z").select("gram")
    return tokens.join(shared, "gram").distinct()


def keys(rows: DataFrame) -> DataFrame:
    """(gram, node): the shingles under which classes are looked up; linked classes have one in common.

    A class with fewer than ``least`` shingles that others have has no link. Of the others the last ``least - 1``
    may go, in any common order: the most frequent ones.
    """
    alive = rows.groupBy("node", "least").agg(F.count("*").alias("n")).filter("n >= least").select("node")
    left = rows.join(alive, "node", "left_semi")
    often = left.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = left.join(often, "gram").groupBy("node", "least").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("grams")).filter("size(grams) >= least")
    return ranked.select("node", F.explode(F.slice("grams", 1, F.size("grams") - F.col("least") + 1)).alias("g")).select("node", "g.gram")


def across(scratch: Scratch, rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Those of ``rows`` whose shingle occurs in several parts, and whose class has ``least`` such shingles."""
    placed = scratch.saved(rows.join(parts.select("node", "part"), "node"))
    mixed = placed.groupBy("gram").agg(F.min("part").alias("_a"), F.max("part").alias("_z")).filter("_a < _z").select("gram")
    left = scratch.saved(placed.join(mixed, "gram", "left_semi"))
    scratch.drop(placed)
    alive = left.groupBy("node", "least").agg(F.count("*").alias("n")).filter("n >= least").select("node")
    return left.join(alive, "node", "left_semi").select("gram", "node", "least")


def paired(rows: DataFrame) -> DataFrame:
    """(node, block, part) of ``rows`` (node, component, blocks, part): one block, or one for each pair of the component's blocks."""
    own = rows.withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")))
    other = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: (j != F.col("i")) | (F.col("blocks") == 1))
    return own.withColumn("j", F.explode(other)).select("node", F.xxhash64("component", F.least("i", "j"), F.greatest("i", "j")).alias("block"), "part")


def bounded(df: DataFrame) -> DataFrame:
    """``df`` (a few numbers in each row) to broadcast if it has BROADCAST_ROWS at most."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def blocks_of() -> Column:
    """Blocks that a group's classes need."""
    return F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("grams") / BLOCK_GRAMS))


def links(scratch: Scratch, df: DataFrame, signed: DataFrame, words: int, share: int, text: str, key: str) -> DataFrame:
    """(a, b): links between nodes; their components are those of all links."""
    rows = scratch.saved(shared_grams(signed, share))
    kept = scratch.saved(keys(rows))
    pairs = kept.groupBy("gram").agg(F.min("node").alias("first"), F.max("node").alias("_z")).filter("first < _z").drop("_z")
    held = scratch.saved(kept.join(pairs, "gram"))
    scratch.drop(kept)
    candidate = components(held.select(F.col("node").alias("a"), F.col("first").alias("b")), scratch)
    chosen = signed.select("node", "_row", "n_shingles").join(candidate, "node").groupBy("node", "component").agg(F.min("_row").alias("_row"), F.first("n_shingles").alias("grams"))
    chosen = scratch.saved(chosen)
    wanted = bounded(chosen.select("_row", "node"))
    sets = scratch.saved(sets_of(df, wanted, words, text, key))
    placed = scratch.saved(chosen.join(chosen.groupBy("component").agg(blocks_of().alias("blocks")), "component").drop("_row"))

    first = paired(placed.filter(F.col("blocks") <= PAIRED).withColumn("part", F.col("node"))).withColumn("least", F.lit(0))
    found = scratch.saved(search(sets.join(bounded(first), "node"), share))
    large = placed.filter(F.col("blocks") > PAIRED).drop("blocks")
    if not large.limit(1).count():
        return found
    return found.unionAll(links_of_large(scratch, rows, held, large, sets, share))


def links_of_large(scratch: Scratch, rows: DataFrame, held: DataFrame, large: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """(a, b): links within the components ``large`` (node, component, grams), which have more than PAIRED blocks."""
    # classes with the same least key are likely near copies
    alike = held.join(large.select("node"), "node", "left_semi").groupBy("node").agg(F.min("gram").alias("m"))
    keyed = scratch.saved(large.join(alike, "node"))
    placed = scratch.saved(keyed.join(keyed.groupBy("component", "m").agg(F.count("*").alias("n"), blocks_of().alias("blocks")), ["component", "m"]))
    own = placed.select("node", "component", "m", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("part_of"))
    # a class of each of a component's largest groups goes into all its blocks of some size
    groups = placed.groupBy("component", "m", "n", "blocks").agg(F.min("node").alias("pilot"))
    ranked = groups.withColumn("_r", F.row_number().over(W.partitionBy("component").orderBy(F.desc("n"), "m"))).filter(F.col("_r") <= PILOTS)
    into = groups.filter(F.col("n") >= PILOTS).drop("pilot").join(ranked.select("component", "pilot"), "component")
    pilots = into.select(F.col("pilot").alias("node"), "component", "m", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part_of"))
    first = own.unionAll(pilots).select("node", F.xxhash64("component", "m", "part_of").alias("block"), F.col("node").alias("part"), F.lit(0).alias("least"))
    found = scratch.saved(search(sets.join(bounded(first), "node"), share))

    parts = scratch.saved(large.join(components(found, scratch).withColumnRenamed("component", "part"), "node", "left").select("node", F.coalesce("part", "node").alias("part"), "grams"))
    once = scratch.saved(across(scratch, rows, parts))
    left = scratch.saved(across(scratch, once, parts))
    scratch.drop(once)
    open_rows = scratch.saved(keys(left).join(parts, "node"))
    by_part = open_rows.groupBy("gram", "part").agg(F.count("*").alias("n"), F.sum("grams").alias("grams"), F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y"))
    grams = by_part.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("grams").alias("grams"), F.count("*").alias("parts"), F.max_by("part", F.struct("n", "part")).alias("largest"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).filter("parts > 1")
    # shingles of the same classes ask the same question once
    grams = grams.groupBy("n", "grams", "x", "y").agg(F.min("gram").alias("gram"), F.min_by("largest", "gram").alias("largest"))
    grams = grams.select("gram", "largest", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("grams") / BLOCK_GRAMS)).alias("blocks"))
    rest = scratch.saved(open_rows.join(grams, "gram"))
    scratch.drop(open_rows)
    own = rest.select("node", "part", "gram", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("part_of"))
    asked = rest.filter("part <> largest and blocks > 1").select("node", "part", "gram", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part_of"))
    second = own.unionAll(asked).select("node", F.xxhash64("gram", "part_of").alias("block"), "part")
    # what the few shingles alone leave possible falls into components again; only the largest are searched by shingle
    few = left.groupBy("node", "least").agg(F.array_sort(F.collect_list("gram")).alias("grams"))
    maybe = scratch.saved(possible(second.join(few, "node")))
    asked = few.select("node").join(parts, "node")
    strong = components(maybe.unionAll(asked.select(F.col("node").alias("a"), F.col("part").alias("b"))), scratch)
    whole = scratch.saved(asked.join(strong, "node"))
    sizes = whole.groupBy("component").agg(blocks_of().alias("blocks"), F.min("part").alias("_a"), F.max("part").alias("_z")).filter("_a < _z")
    whole = scratch.saved(whole.join(sizes.select("component", "blocks"), "component"))
    rest = second.join(whole.filter(F.col("blocks") > PAIRED).select("node"), "node", "left_semi").select("node", "block", "part")
    third = paired(whole.filter(F.col("blocks") <= PAIRED)).unionAll(rest).withColumn("least", F.lit(0))
    return found.unionAll(scratch.saved(search(sets.join(bounded(third), "node"), share)))


def classes_of(scratch: Scratch, df: DataFrame, words: int, share: int, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows (key, _row, n_shingles, node), and (node, component) of all linked nodes."""
    signed = scratch.saved(signatures(df, common_shingles(df, words, text), words, share, text, key))
    return signed.drop("prefix"), components(links(scratch, df, signed, words, share, text, key), scratch)


def near_duplicates(df: DataFrame, words: int = WORDS, share: int = SHARE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id) of every row: sets link when 100 * common >= share * union.

    component_id is the least key reachable by links. Words end at ASCII white space; A-Z are lower-cased.
    Null, empty and blank texts have size 0, stand alone and keep their own key; equal sets are one class, so
    copies cost no pairs; null keys stay null and never name a component; other columns are ignored.
    Sets are compared by 64-bit hashes of their shingles. The result is a table in the shared folder.
    """
    with Scratch(df.sparkSession) as scratch:
        signed, joined = classes_of(scratch, df, words, share, text, key)
        classes = signed.filter("node is not null").groupBy("node").agg(F.min(key).alias("_least"))
        least = joined.join(classes, "node").groupBy("component").agg(F.min("_least").alias("_named"))
        named = joined.join(least, "component").select("node", "_named")
        final = classes.join(named, "node", "left").select("node", F.coalesce("_named", "_least").alias("component_id"))
        return saved(signed.select(key, "n_shingles", "node").join(final, "node", "left").select(key, "n_shingles", F.coalesce("component_id", key).alias("component_id")))


def one_of_each(df: DataFrame, words: int = WORDS, share: int = SHARE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``df`` with one row of each group of linked rows: that of the least key, nulls last, and of its texts the least by hash.

    Rows without words stay, all of them. Rows are told apart by key and text, so another text under the same key is judged
    on its own; of rows equal in both one stays. Columns stay as they are.
    """
    with Scratch(df.sparkSession) as scratch:
        signed, joined = classes_of(scratch, df, words, share, text, key)
        named = signed.filter("node is not null").join(joined, "node", "left").withColumn("_group", F.coalesce("component", "node"))
        best = named.groupBy("_group").agg(F.min(F.struct(F.col(key).isNull().alias("_none"), F.col(key).alias("_key"), F.col("_row").alias("_best"))).alias("_b"))
        told = named.join(best, "_group").select(key, "_row", (F.col(key).eqNullSafe(F.col("_b._key")) & (F.col("_row") == F.col("_b._best"))).alias("_stays"))
        told = told.groupBy(key, "_row").agg(F.max("_stays").alias("_stays"), F.count("*").alias("_n")).filter("not _stays or _n > 1")
        k, row, stays = (unused(c, df) for c in ("_key", "_row", "_stays"))
        told = saved(told.select(F.col(key).alias(f"{k}_"), F.col("_row").alias(f"{row}_"), F.col("_stays").alias(stays)))
    told = bounded(told)
    rows = df.withColumns({k: F.col(key).cast("long"), row: F.xxhash64(F.col(key).cast("long"), text)})
    same = F.col(f"{k}_").eqNullSafe(F.col(k)) & (F.col(f"{row}_") == F.col(row))
    kept = rows.join(told.filter(f"not {stays}"), same, "left_anti")
    twins = told.filter(stays)
    if twins.limit(1).count():
        kept = kept.join(twins, same, "left_anti").unionByName(kept.join(twins, same, "left_semi").dropDuplicates([k, row]))
    return kept.select(*df.columns)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
