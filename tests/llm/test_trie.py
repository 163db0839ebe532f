"""The prefix trie against a brute-force one and its SQL twin."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from tidemark.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, up long, len string"


def brute(rows):
    """rows: (conv_id, turn, role, text)"""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, turns in own.items():
        h, sign = zlib.crc32(str(c).encode()) % 4, -1 if c < 0 else 1
        built[c] = own.get(c - sign * (abs(c) % 20), [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = []
    totals = {}
    for p in sorted(members, key=len, reverse=True):
        below = [totals[x] for x in children.get(p, [])]
        n_words = len([w for w in re.split(r"[\x20\x09-\x0D]+", p[-1][1]) if w]) if p else 0
        totals[p] = (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(members[p]) - 1) * n_words)
        ends = sorted(c for c in members[p] if len(built[c]) == len(p))
        up = min(members[p[:-1]]) if p else None
        out.append((min(members[p]), len(p), up, len(members[p]), len(children.get(p, [])), *totals[p], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def found(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns == names
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


def made(seed, convs):
    rng, rows = random.Random(seed), []
    for c in convs:
        for turn in range(rng.choice([1, 1, 2, 3, 4, 6])):
            rows.append((c, rng.choice([turn, turn, turn, 1, None]), rng.choice(["user", "user", "assistant", None]), rng.choice(["", None, "hi there", "a b  c", "x\ty", "long " * 300])))
    return rows


@pytest.mark.parametrize(("seed", "most", "queue"), [(1, 8, 3), (2, 1, 1)])
def test_trie_equals_brute_force(spark, seed, most, queue):
    rows = made(seed, [*range(-45, 90), 1000, 10**12])
    rows += [(c, 0, "user", "the same start of many") for c in range(2000, 2060)]
    rows += [(None, 1, "user", "of no conversation"), *rows[:20]]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert found(trie.prefix_trie(df, shard_rows=most, queue_rows=queue)) == brute(rows)


def test_one_long_conversation_lies_across_slices(spark):
    rows = [(20, i, "user", f"t{i} {'w ' * (i % 3)}") for i in range(3000)] + [(c, i, "user", f"t{i} {'w ' * (i % 3)}") for c in (21, 22, 23) for i in range(8)]
    assert found(trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), shard_rows=500)) == brute(rows)


def test_empty_and_turnless(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert found(trie.prefix_trie(empty)) == []
    short = [c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4][:3]
    rows = [(c, 0, "user", "gone") for c in short]
    got = found(trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert got == brute(rows) and len(got) == 1 and got[0][:6] == (short[0], 0, None, 3, 0, 1)


def test_queue_spills_and_sums(tmp_path, monkeypatch):
    monkeypatch.setenv("SPARK_LOCAL_DIRS", str(tmp_path))
    rng, queue, sums = random.Random(5), trie.SpillingQueue(7), {}
    for _ in range(500):
        key, message = (-rng.randrange(4), rng.randrange(30)), (1, rng.randrange(9), rng.randrange(9))
        queue.push((*key, *message))
        sums[key] = tuple(x + y for x, y in zip(sums.get(key, (0, 0, 0)), message, strict=True))
    assert len(queue.runs) > 10
    assert all(queue.take(k) == sums[k] for k in sorted(sums)) and queue.take((1, 0)) == (0, 0, 0)


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_query_equals_sql_and_brute_force(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet'")
    expected = brute(rows)
    assert found(trie.op11_prefix_trie(spark, path)) == expected
    assert sorted(con.sql(trie.OP11_SQL).fetchall(), key=lambda r: r[:2]) == expected
