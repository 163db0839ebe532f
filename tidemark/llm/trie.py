"""Trie of shared conversation prefixes: nodes by hashes of prefixes, subtree totals by time-forward processing."""

from __future__ import annotations

import hashlib
import heapq
import os
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, read, saved

#: Turns at most that a conversation takes over from the first one of its block, and conversations of a block.
HEAD, BLOCK = 4, 20
#: A subtree of so many turn rows, or of a SHARE-th of all if that is more, is one shard at most; nodes over it are left to the last pass.
SHARD_ROWS, SHARE = 1000, 1000
#: Rows of a broadcast table at most (about 24 bytes each); larger ones are joined by shuffling.
BROADCAST_ROWS = 500_000
#: Messages that a queue holds in memory; more go to sorted runs on disk.
QUEUE_ROWS = 200_000
#: Characters of a row of joined conversation ids.
CHUNK_CHARS = 1 << 16
EMPTY_HASH = hashlib.sha256(b"").hexdigest()


def words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")).cast("long")


def lanes(position: Column, content: str) -> list[Column]:
    """Two 64-bit hashes of a turn at its position; a prefix has the exclusive or of those of its turns."""
    return [F.xxhash64(F.lit(salt), position, F.col(content)) for salt in (1, 2)]


def numbered(df: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, slice, pos, content, words) of every turn: its number from 1 in its conversation, a hash of role and text, the text's words.

    A conversation may lie across several sorted slices of the table, whatever its length; what precedes a slice is
    added from the counts of slices. Slices are cut by the starts of roles and texts, so that no long text is a sample of the sort.
    """
    told = df.select(F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).filter("conv is not null")
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = told.repartitionByRange(parts, "conv", order[0], F.substring("role", 1, 16), F.substring("text", 1, 16)).select("conv", F.spark_partition_id().alias("slice"), "turn", "role", "text")
    local = F.row_number().over(Window.partitionBy("conv", "slice").orderBy(*order)).cast("long")
    content = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    sliced = scratch.saved(sliced)
    rows = scratch.saved(sliced.select("conv", "slice", local.alias("at"), content.alias("content"), words(F.col("text")).alias("words")))
    scratch.drop(sliced)
    counts = rows.groupBy("conv", "slice").agg(F.max("at").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    turns = scratch.saved(rows.join(before.select("conv", "slice", "before"), ["conv", "slice"]).select("conv", "slice", (F.col("at") + F.col("before")).alias("pos"), "content", "words"))
    scratch.drop(rows)
    return turns


def rebuilt(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows of the rebuilt turns (conv, slice, pos, content, words) and (conv, len) of all conversations.

    A conversation takes crc32 % HEAD turns over from the one that starts its block (fewer if that has fewer, none if it is
    absent) and goes on with its own after that number. Of a block's start at most HEAD - 1 turns are passed on, BLOCK times.
    """
    starts = F.col("conv") - F.col("conv") % BLOCK
    heads = turns.filter((F.col("pos") < HEAD) & (F.col("conv") % BLOCK == 0)).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("pos", "content", "words"))).alias("head")).withColumnRenamed("conv", "start")
    convs = turns.groupBy("conv").agg(F.max("pos").alias("n")).withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % HEAD).withColumn("start", starts)
    known = convs.join(heads, "start", "left").withColumn("head", F.when(F.col("h") > 0, F.slice("head", 1, F.greatest(F.col("h").cast("int"), F.lit(1)))))
    known = scratch.saved(known.withColumn("head", F.coalesce("head", F.array().cast("array<struct<pos:bigint,content:string,words:bigint>>"))).select("conv", "n", "h", "head"))
    taken = F.size("head").cast("long")
    lengths = known.select("conv", (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"))
    own = turns.join(known.select("conv", "h", taken.alias("taken")), "conv").filter("pos > h").select("conv", "slice", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "content", "words")
    passed = known.select("conv", F.lit(-1).alias("slice"), F.explode("head").alias("t")).select("conv", "slice", "t.pos", "t.content", "t.words")
    return own.unionByName(passed), lengths


def prefixes(rows: DataFrame, lengths: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, depth, a, b, up_a, up_b, words, len) of every prefix of every conversation: its hash, that of the one before it."""
    a, b = lanes(F.col("pos"), "content")
    tagged = rows.select("conv", "slice", "pos", "words", a.alias("a"), b.alias("b"))
    run = Window.partitionBy("conv", "slice").orderBy("pos")
    local = scratch.saved(tagged.select("conv", "slice", "pos", "words", F.col("a").alias("own_a"), F.col("b").alias("own_b"), F.bit_xor("a").over(run).alias("a"), F.bit_xor("b").over(run).alias("b")))
    ends = local.groupBy("conv", "slice").agg(F.bit_xor("own_a").alias("all_a"), F.bit_xor("own_b").alias("all_b"))
    earlier = Window.partitionBy("conv").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("conv", "slice", *(F.coalesce(F.bit_xor(f"all_{x}").over(earlier), F.lit(0)).alias(f"before_{x}") for x in "ab"))
    whole = local.join(before, ["conv", "slice"]).select("conv", F.col("pos").alias("depth"), *(F.col(x).bitwiseXOR(F.col(f"before_{x}")).alias(x) for x in "ab"), "own_a", "own_b", "words")
    named = whole.join(lengths, "conv").select("conv", "depth", "a", "b", F.col("a").bitwiseXOR(F.col("own_a")).alias("up_a"), F.col("b").bitwiseXOR(F.col("own_b")).alias("up_b"), "words", "len")
    zero = F.lit(0).cast("long")
    tops = lengths.select("conv", zero.alias("depth"), zero.alias("a"), zero.alias("b"), F.lit(None).cast("long").alias("up_a"), F.lit(None).cast("long").alias("up_b"), zero.alias("words"), "len")
    out = scratch.saved(named.unionByName(tops))
    scratch.drop(local)
    return out


def end_hashes(rows: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of the nodes where conversations end: hash of their ids, ascending, comma-joined.

    Ids are sorted and joined to chunks across all tasks, also those of one node; only the chunks of a node meet in one task, which
    reads them one by one, since the hash of a text can't be split.
    """

    def chunks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
        node, ids, size, out = None, [], 0, []

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal ids, size, out
            if ids:
                out.append((*node, ids[0], ",".join(map(str, ids))))
                ids, size = [], 0

        for part in parts:
            for *key, conv in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if key != node or size > CHUNK_CHARS:
                    flushed()
                    node = key
                ids.append(conv)
                size += len(str(conv)) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        flushed()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["depth", "a", "b", "ends_sha256"]
        node, state = None, None
        for part in parts:
            out = []
            for *key, ids in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if key != node:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=names)
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], names=names)

    key = ["depth", "a", "b"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = rows.filter("depth = len").select(*key, "conv")
    joined = ends.repartitionByRange(parts, *key, "conv").sortWithinPartitions(*key, "conv").mapInArrow(chunks, "depth long, a long, b long, first long, ids string")
    return joined.repartition(parts, *key).sortWithinPartitions(*key, "first").select(*key, "ids").mapInArrow(hashed, "depth long, a long, b long, ends_sha256 string")


class SpillingQueue:
    """Priority queue of messages to nodes, ordered by (-depth, conv); more than ``limit`` waiting ones go to sorted runs on disk.

    The runs lie in the task's own Spark scratch folder and go with the task, as the runs of Spark's sorts do.
    """

    ROW = struct.Struct("<5q")

    def __init__(self, limit: int = QUEUE_ROWS):
        self.limit, self.heap, self.heads, self.runs = limit, [], [], []

    def push(self, message: tuple[int, int, int, int, int]) -> None:
        """(-depth, conv, children, leaves, tokens)"""
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.limit:
            self.spill()

    def spill(self) -> None:
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        run = tempfile.TemporaryFile(dir=folder)
        last = None
        for message in sorted(self.heap):
            if last is not None and message[:2] == last[:2]:
                last = (*last[:2], *(x + y for x, y in zip(last[2:], message[2:], strict=True)))
                continue
            if last is not None:
                self.write(run, last)
            last = message
        self.write(run, last)
        run.seek(0)
        self.heap = []
        self.runs.append(run)
        self.advance(len(self.runs) - 1)

    def write(self, run, message: tuple[int, ...]) -> None:
        run.write(self.ROW.pack(*message))

    def advance(self, i: int) -> None:
        raw = self.runs[i].read(self.ROW.size)
        if raw:
            heapq.heappush(self.heads, (*self.ROW.unpack(raw), i))
        else:
            self.runs[i].close()

    def take(self, key: tuple[int, int]) -> tuple[int, int, int]:
        """Sums of all messages to ``key``, which must not come before one asked for earlier."""
        children = leaves = tokens = 0
        while self.heap and self.heap[0][:2] == key:
            _, _, c, n, t = heapq.heappop(self.heap)
            children, leaves, tokens = children + c, leaves + n, tokens + t
        while self.heads and self.heads[0][:2] == key:
            _, _, c, n, t, i = heapq.heappop(self.heads)
            children, leaves, tokens = children + c, leaves + n, tokens + t
            self.advance(i)
        return children, leaves, tokens


TOTALS = "conv long, depth long, up long, n_children long, n_leaves long, saved_tokens long, crossing boolean"


def forward(nodes: DataFrame, parts: int, limit: int = QUEUE_ROWS) -> DataFrame:
    """Totals of the nodes of each shard: (conv, depth, up, shard, own, crossing, children, leaves, tokens) to TOTALS.

    A task sorts its shards' nodes by falling depth and conversation (Spark's sort spills), and sends each node's totals to its parent
    through a spilling queue. A node that is ``crossing`` has its parent elsewhere and sends nothing. ``children``, ``leaves`` and
    ``tokens`` are what came from elsewhere already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, names = SpillingQueue(limit), [x.split()[0] for x in TOTALS.split(", ")]
        for part in batches:
            for b in (part.slice(at, 10_000) for at in range(0, part.num_rows, 10_000)):
                counts, leaf_counts, sums = [], [], []
                columns = [c.to_pylist() for c in b.columns]
                for conv, depth, up, own, crossing, children, leaves, tokens in zip(*columns, strict=True):
                    c, n, t = queue.take((-depth, conv))
                    c, t = c + children, t + tokens + own
                    n = n + leaves or 1  # a node without children is a leaf itself
                    if not crossing:
                        queue.push((1 - depth, up, 1, n, t))
                    counts.append(c)
                    leaf_counts.append(n)
                    sums.append(t)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(counts, pa.int64()), pa.array(leaf_counts, pa.int64()), pa.array(sums, pa.int64()), b.column(4)], names=names)

    dealt = nodes.repartition(parts, "shard").sortWithinPartitions(F.col("depth").desc(), "conv")
    return dealt.select("conv", "depth", "up", "own", "crossing", "children", "leaves", "tokens").mapInArrow(run, TOTALS)


def prefix_trie(df: DataFrame, shard_rows: int | None = None, queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """One row of each node of the trie of the rebuilt conversations of ``df`` (conv_id, turn, role, text), as the contract has it.

    Turns come by turn, nulls first, then role and text; null roles and texts are empty, so a null text is the same turn as an
    empty one. Repeated rows are turns of their own. Rows without a conv_id belong to no conversation and make none. Other columns are
    ignored. A remainder has its dividend's sign, so the blocks of negative ids end at a multiple of 20. A table without conversations has no node.

    Prefixes are told apart by 128 bits of hashes. A shard is a subtree of at most ``shard_rows`` turn rows under a node that has more;
    shards are dealt to tasks by their roots. The nodes with more, a few of each depth, take the sums of the shards' roots and are passed
    through by one task that holds one queue. The result is a table in the shared folder.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = ["depth", "a", "b"]
    with Scratch(spark) as scratch:
        turns = numbered(df, scratch)
        built, lengths = rebuilt(turns, scratch)
        rows = prefixes(built, lengths, scratch)
        scratch.drop(turns)
        total = rows.count()
        most = shard_rows or max(SHARD_ROWS, total // SHARE)
        below = F.col("len") - F.col("depth") + 1
        found = scratch.saved(rows.groupBy(*key).agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv"), F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"), F.min("words").alias("words"), F.sum(below).alias("weight")))
        crown = found.filter(F.col("weight") > most).select(*key)
        small = crown.count() <= BROADCAST_ROWS
        # where each conversation's path leaves the large nodes
        light = rows.select("conv", *key).join(F.broadcast(crown) if small else crown, key, "left_anti")
        roots = light.groupBy("conv").agg(F.min(F.struct(*key)).alias("root"))
        parents = found.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv").alias("up"), (F.col("weight") > most).alias("up_large"))
        nodes = found.join(parents, ["depth", "up_a", "up_b"], "left").join(roots, "conv", "left")
        large = F.col("weight") > most
        nodes = scratch.saved(nodes.select("conv", *key, "up", "n_convs", (F.col("words") * (F.col("n_convs") - 1)).alias("own"), large.alias("large"), F.when(~large, F.xxhash64("root")).alias("shard"), (F.col("up").isNull() | (F.col("up_large") & ~large)).alias("crossing")))
        ends = end_hashes(rows)
        nothing = F.lit(0).cast("long")
        shards = nodes.filter("not large").select("conv", "depth", "up", "shard", "own", "crossing", *(nothing.alias(x) for x in ("children", "leaves", "tokens")))
        within = scratch.saved(forward(shards, max(parts, total // most), queue_rows))
        sent = within.filter("crossing and up is not null").groupBy(F.col("up").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("tokens"))
        top = nodes.filter("large").join(sent, ["conv", "depth"], "left").select("conv", "depth", "up", F.lit(0).alias("shard"), "own", "crossing", *(F.coalesce(x, nothing).alias(x) for x in ("children", "leaves", "tokens")))
        totals = within.unionByName(forward(top, 1, queue_rows)).select("conv", "depth", "n_children", "n_leaves", "saved_tokens")
        named = nodes.join(totals, ["conv", "depth"]).join(ends, key, "left")
        return saved(named.select(F.col("conv").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_HASH)).alias("ends_sha256")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"))


OP11_SQL = """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
steps AS (SELECT c, n, flatten([[ord(x), -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(c::VARCHAR, '')]) AS s
  FROM (SELECT c, count(*) AS n FROM t GROUP BY c)),
convs AS (SELECT c, n, xor(list_reduce(list_prepend(4294967295::BIGINT, s::BIGINT[]),
    lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc >> 1, (acc & 1) * 3988292384) END), 4294967295) % 4 AS h FROM steps),
lead AS (SELECT v.c, t.p, t.role, t.text FROM convs v JOIN t ON t.c = v.c - v.c % 20 AND t.p <= v.h),
taken AS (SELECT v.c, v.h, count(l.p) AS b FROM convs v LEFT JOIN lead l ON l.c = v.c GROUP BY v.c, v.h),
built AS (SELECT * FROM lead UNION ALL SELECT t.c, t.p - k.h + k.b, t.role, t.text FROM t JOIN taken k ON k.c = t.c WHERE t.p > k.h),
chained AS (SELECT c, p AS depth, sha256(string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY p)) AS k, text FROM built
  UNION ALL SELECT c, 0, '', '' FROM convs),
sized AS (SELECT *, max(depth) OVER (PARTITION BY c) AS len, lag(k) OVER (PARTITION BY c ORDER BY depth) AS up,
    len(list_filter(regexp_split_to_array(text, '[ \\t-\\r]+'), lambda w: w <> '')) AS words FROM chained),
nodes AS (SELECT depth, k, min(up) AS up, count(*) AS n_convs, min(c) AS c, min(words) AS words,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (depth = len), '')) AS ends FROM sized GROUP BY depth, k),
kids AS (SELECT up AS k, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
whole AS (SELECT n.*, coalesce(kids.n, 0) AS n_children FROM nodes n LEFT JOIN kids USING (k, depth)),
sums AS (SELECT s.depth, s.k, sum(w.words * (w.n_convs - 1)) AS saved, count(*) FILTER (w.n_children = 0) AS leaves
  FROM whole w JOIN sized s ON s.c = w.c AND s.depth <= w.depth GROUP BY s.depth, s.k)
SELECT w.c AS conv_id, w.depth::BIGINT AS depth, u.c AS parent_conv_id, w.n_convs::BIGINT AS n_convs, w.n_children::BIGINT AS n_children,
  s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, w.ends AS ends_sha256
FROM whole w JOIN sums s USING (depth, k) LEFT JOIN nodes u ON u.k = w.up AND u.depth = w.depth - 1
"""
