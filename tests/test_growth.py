"""The vector index, re-embedding, and streams over many files."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import index, reembed, vectors
from tidemark.sources.shared import shared_dir
from tidemark.streaming import retry, streams

START = dt.datetime(2024, 1, 1)


def facts_of(spark, rows):
    return spark.createDataFrame(rows, "group_id string, uuid long, embedding array<float>")


def near_copies(n, copies, seed=0):
    rng, rows = np.random.default_rng(seed), []
    for i in range(n):
        v = rng.standard_normal(32)
        for c in range(copies):
            rows.append(("p" if i % 3 else "q", i * copies + c, (v + 0.05 * c * rng.standard_normal(32)).tolist()))
    return [*rows, ("p", 10**6, None), ("p", 10**6 + 1, [0.0] * 32)]


def test_index_finds_near_copies(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    facts = facts_of(spark, near_copies(150, 3))
    exact = {(r.a, r.b) for r in vectors.similar_pairs(facts, 0.9).collect()}
    bits = 8
    rows = index.similar_pairs(facts, 0.9, bits, index.tables_for(bits, 0.9, 0.99)).collect()
    found = {(r.a, r.b) for r in rows}
    assert len(rows) == len(found) and found <= exact and len(found) >= 0.95 * len(exact) > 300


def test_one_bucket_of_copies_is_split_and_whole(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 8)
    facts = facts_of(spark, [("p", i, [1.0, 2.0, 3.0]) for i in range(40)])
    assert index.similar_pairs(facts, 0.99, 4, 3).count() == 40 * 39 // 2
    assert index.similar_pairs(facts.limit(0), 0.99, 4, 3).count() == 0


def test_indexed_neighbours(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 32)
    facts = facts_of(spark, near_copies(120, 4, 1))
    asked = facts.filter("uuid % 10 = 0")
    exact = vectors.nearest(facts, asked, 3)
    found = index.nearest(facts, asked, 3, 6, index.tables_for(6, 0.9, 0.99))
    got = index.recall_of(exact, found, ["query", "uuid"]).agg(F.sum("found") / F.sum("exact")).first()[0]
    assert got >= 0.9 and found.groupBy("query").count().agg(F.max("count")).first()[0] <= 3


def test_blocked_queries_are_exact(spark, monkeypatch):
    rows = near_copies(60, 3, 2)
    whole = [tuple(r) for r in vectors.nearest(facts_of(spark, rows), facts_of(spark, rows), 4).orderBy("query", "rank").collect()]
    monkeypatch.setattr(vectors, "BLOCK", 10)
    assert [tuple(r) for r in vectors.nearest(facts_of(spark, rows), facts_of(spark, rows), 4).orderBy("query", "rank").collect()] == whole


def test_plan_takes_the_index_only_where_it_is_less_work():
    assert index.plan(2_000, 0.3) is None
    bits, tables = index.plan(10_000_000, 0.97)
    assert tables * 10_000_000 / 2**bits < 1_000_000
    assert index.tables_for(4, 1.0) == 1


def test_reembedding_goes_on_after_a_stop(spark):
    size, rows = 16, [(i, f"text number {i}", None if i % 3 == 0 else [1.0] * (16 if i % 3 == 1 else 8)) for i in range(120)] + [(500, None, None), (None, "no key", None)]
    facts = spark.createDataFrame(rows, "uuid long, text string, embedding array<float>")
    path, embed = shared_dir(spark), reembed.hashing_embedder(size)
    good = facts.filter("uuid < 40")
    assert reembed.apply(good, path, embed, size, slice_rows=10) == 3

    def broken(texts):
        raise ValueError("Stops")

    with pytest.raises(Exception, match="Stops"):
        reembed.apply(facts, path, broken, size, slice_rows=10)
    read = spark.read.schema("uuid long, embedding array<float>").parquet(path)
    before = read.count()
    assert before == 27
    # 40 and 39 of 120 lack one of the right size
    assert reembed.apply(facts, path, embed, size, slice_rows=1000) == 1 and reembed.apply(facts, path, embed, size) == 0
    made = spark.read.schema("uuid long, embedding array<float>").parquet(path)
    assert made.count() == made.select("uuid").distinct().count() == 80
    after = reembed.with_new(facts, made, size)
    assert after.filter(reembed.lacking("embedding", size) & F.col("text").isNotNull() & F.col("uuid").isNotNull()).count() == 0
    assert after.filter("uuid % 3 = 1").select("embedding").distinct().count() == 1 and after.count() == len(rows)
    checked = reembed.verified(facts, made, embed, size, sample=20).collect()
    assert len(checked) == 20 and all(r.same for r in checked)
    assert not any(r.same for r in reembed.verified(facts, made, lambda texts: [[1.0] * size for _ in texts], size, sample=5).collect())


def test_an_embedder_of_another_size_stops_the_job(spark):
    facts = spark.createDataFrame([(1, "a", None)], "uuid long, text string, embedding array<float>")
    with pytest.raises(Exception, match="must return 1 vectors of 4"):
        reembed.apply(facts, shared_dir(spark), lambda texts: [[0.0] * 3 for _ in texts], 4)


CALLS = "queue string, item long, at timestamp, fails int"


def files(spark, path, schema, *parts):
    """Each part as one file, in order of time."""
    import os
    import time

    os.makedirs(path, exist_ok=True)
    for i, rows in enumerate(parts):
        before = set(os.listdir(path))
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        for name in set(os.listdir(path)) - before:
            stamp = time.time() - 1000 + i * 10
            os.utime(f"{path}/{name}", (stamp, stamp))


def as_stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def brute_queue(rows, per_run, until, step=600):
    out = {}
    for queue in {r[0] for r in rows}:
        waiting = {item: [at.timestamp(), 0, fails] for q, item, at, fails in rows if q == queue}
        beat = START.replace(tzinfo=dt.UTC).timestamp() + step
        while beat <= until.timestamp():
            for _, item in sorted((at, item) for item, (at, _, _) in waiting.items() if at < beat)[:per_run]:
                waiting[item][1] += 1
                if waiting[item][1] > waiting[item][2] or waiting[item][1] >= 5:
                    out[item] = (waiting[item][1], "replayed" if waiting[item][1] > waiting[item][2] else "replay_failed")
                    del waiting[item]
            beat += step
    return out


def test_retry_queue_restarts_and_takes_the_oldest_first(spark, tmp_path):
    rng = random.Random(1)
    rows = sorted([(rng.choice("ab"), i, START.replace(tzinfo=dt.UTC) + dt.timedelta(seconds=rng.randrange(20_000)), rng.randrange(8)) for i in range(120)], key=lambda r: r[2])
    parts = rows[:50], rows[50:90], rows[90:]
    last = rows[-1][2] - dt.timedelta(hours=1)
    expected = brute_queue(rows, 3, last)
    source, state, path = str(tmp_path / "in"), shared_dir(spark), shared_dir(spark)
    files(spark, source, CALLS, *parts[:1])
    limits = {"per_run": 3}
    retry.settled(as_stream(spark, source, CALLS), path, state, **limits)
    files(spark, source, CALLS, *parts[1:])
    again = {r.item: (r.retry_count, r.status) for r in retry.settled(as_stream(spark, source, CALLS), path, state, **limits).collect()}
    once = {r.item: (r.retry_count, r.status) for r in retry.settle_all(as_stream(spark, source, CALLS), **limits).collect()}
    assert again == once == expected and len(expected) == 41


EVENTS = "ts timestamp, event_type string, value double, user_id long"


def test_state_is_evicted_and_late_rows_are_dropped(spark, tmp_path):
    day = lambda n, hour=1: START.replace(tzinfo=dt.UTC) + dt.timedelta(days=n, hours=hour)
    parts = [[(day(n, h), "view", 1.0, u) for h in (1, 2, 3) for u in range(5)] for n in range(8)]
    parts.append([(day(1, 5), "view", 100.0, 1), (day(7, 5), "view", 1.0, 1)])  # the first is a week late
    source = str(tmp_path / "in")
    files(spark, source, EVENTS, *parts)
    events = as_stream(spark, source, EVENTS).withColumn("at", F.col("ts")).withWatermark("at", streams.LATE)
    path, state = shared_dir(spark), shared_dir(spark)
    made = streams.by_day(events)
    query = streams.ended(made, "update", path, state)
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(kept) <= 3
    rows = {r.day: (r.calls, r.value) for r in streams.upserted(spark, path, made.schema, ["day", "tool"]).collect()}
    assert len(rows) == 8 and rows["2024-01-02"] == (15, 15.0) and rows["2024-01-08"] == (16, 16.0)
    closed = streams.run(streams.closed_sessions(as_stream(spark, source, EVENTS).withColumn("at", F.col("ts")).withWatermark("at", streams.LATE)))
    assert closed.count() == closed.distinct().count() == 5 * 3 * 6 + 5 * 3


def test_change_feed_goes_on_from_earlier_batches(spark, tmp_path):
    schema = "l_suppkey long, l_shipdate date, l_orderkey long, l_linenumber long, l_partkey long, l_extendedprice double, l_returnflag string"
    row = lambda i, n: (i % 2, (START + dt.timedelta(days=n)).date(), i, 1, 1, 1.0, "R" if i % 3 == 0 else "N")
    source = str(tmp_path / "in")
    files(spark, source, schema, [row(i, i) for i in range(6)], [row(i, i) for i in range(6, 10)])
    path, state = shared_dir(spark), shared_dir(spark)
    streams.feed(as_stream(spark, source, schema), path, state)
    got = spark.read.schema(streams.FEED).parquet(f"{path}/rows").orderBy("scope", "day", "op").collect()
    assert len(got) == 14
    for scope in (0, 1):
        mine = [r for r in got if r.scope == scope]
        assert [(r.additions, r.retirements) for r in mine] == [(sum(x.op == "added" for x in mine[: i + 1]), sum(x.op == "retired" for x in mine[: i + 1])) for i in range(len(mine))]


def test_hops_of_many_queries_have_their_own_visited_nodes(spark):
    from tidemark.operators import graph

    rng = random.Random(3)
    links = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(40)] + [(None, "n1"), ("n2", "n2")]
    centres = [(1, "n0"), (2, "n5"), (2, "n6"), (3, "nowhere"), (4, None)]
    near = {}
    for a, b in links:
        if a and b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    expected = set()
    for query in (1, 2, 3):
        seen = {n: 0 for q, n in centres if q == query}
        for step in range(1, 4):
            for n in [n for n, h in seen.items() if h == step - 1]:
                for other in near.get(n, ()):
                    seen.setdefault(other, step)
        expected |= {(query, n, h) for n, h in seen.items()}
    facts = spark.createDataFrame(links, "source string, target string")
    got = graph.hops_from(facts, spark.createDataFrame(centres, "query long, uuid string"), 3).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_pair_overlap_cuts_each_text_once(spark):
    from tidemark.functions import compare
    from tidemark.plans.registry import QUERIES

    plan = QUERIES["pair_overlap"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # no text is cut in what stands above the joins
    assert plan.count("regexp_extract_all") == 3 and "regexp" not in plan[: plan.index("Join")]
    texts = spark.createDataFrame([("The USA orders 17", "the big rings, A1 17 rings."), ("ones 2", ""), ("", "x"), ("One of", "the cities")], "a string, b string")
    halves = compare.cut(compare.cut(texts, "a").withColumn("_a", F.struct(*compare.CUT)), "b").select("a", "b", "_a", F.struct(*compare.CUT).alias("_b"))
    got = halves.select("a", "b", *compare.stated(*([F.col(x)[c] for c in compare.CUT] for x in ("_a", "_b"))))
    whole = F.concat_ws(" ", "a", "b")
    wrong = got.filter((F.col("_words") != compare.tokens(whole)) | (F.col("_values") != compare.values(whole)) | (F.col("_stems") != compare.content(whole)))
    assert got.count() == 4 and wrong.count() == 0


class Counted:
    """A state handle that counts what goes to the store."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        raise AssertionError("one trip to the store for each item")

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


def test_retry_queue_reads_its_state_once_a_call():
    from types import SimpleNamespace as Names

    handle, queue = Counted(), retry.Queue(5, 3, 600_000)
    queue.init(handle)
    base = int(START.replace(tzinfo=dt.UTC).timestamp() * 1000)
    rows = [Names(item=i, ms=base + i * 60_000, fails=i % 7) for i in range(500)]
    assert not list(queue.handleInputRows(("a",), iter(rows), None))
    assert len(handle.timers) == 1 and handle.calls == 3
    until, out = base + 500 * 60_000, {}
    while handle.timers and min(handle.timers) <= until:
        beat = min(handle.timers)
        handle.timers.discard(beat)
        done = queue.handleExpiredTimer(("a",), Names(getCurrentWatermarkInMs=lambda: until), Names(getExpiryTimeInMs=lambda beat=beat: beat))
        out |= {r.item: (r.retry_count, r.status) for r in done}
    start = dt.datetime.fromtimestamp(0, dt.UTC)
    expected = brute_queue([("a", r.item, start + dt.timedelta(milliseconds=r.ms), r.fails) for r in rows], 3, start + dt.timedelta(milliseconds=until))
    assert out == expected and out and handle.calls == 6
