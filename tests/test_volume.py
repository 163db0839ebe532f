"""What jobs move, counted in rows, and their results against brute force."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.functions import compare, screening
from tidemark.operators import admission, audit, evaluate, graph, scopes, vectors, words
from tidemark.plans import admission_queries, brief_queries, grid_queries, recall_queries
from tidemark.streaming import streams


def stages(spark):
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return {found.apply(i).stageId(): found.apply(i) for i in range(found.size())}


def moved(spark, run):
    """Rows that the stages of ``run`` have written to shuffles, as with tables too large to broadcast."""
    before, name = set(stages(spark)), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(name, "-1")
    try:
        run()
    finally:
        spark.conf.unset(name)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(x.shuffleWriteRecords() for i, x in stages(spark).items() if i not in before)


def facts_of(n, seed):
    rng = random.Random(seed)
    day = lambda: dt.date(1969, 10, 1) + dt.timedelta(days=rng.randrange(200))
    some = lambda xs: rng.choice([*xs, None])
    return [(f"u{i}", some("abcd"), some("abcd"), rng.choice(["Uses", "uses", "Likes", None]), some("pq"), rng.choice([day(), None]), rng.choice([day(), None])) for i in range(n)]


FACTS = "uuid string, source string, target string, name string, group_id string, created_at date, expired_at date"


def by_hand(rows, windows):
    out = {}
    low = lambda x: x and x.lower()
    for u, s, t, n, g, own, d in rows:
        for w in windows:
            near = [r for r in rows if r[0] != u and g and r[4] == g and d and r[5] and abs((r[5] - d).days) <= w]
            ends = lambda r: s and t and (r[1], r[2]) in ((s, t), (t, s))
            name = lambda r: n and low(r[3]) == low(n) and ((s and r[1] == s) or (t and r[2] == t))
            if near:
                out[u, w] = (len(near), any(bool(ends(r) or name(r)) for r in near))
    return out


def test_cohorts_by_hand(spark):
    rows = facts_of(300, 1)
    df = spark.createDataFrame(rows, FACTS)
    got = audit.cohorts(df.filter("expired_at is not null"), df, [0, 1, 3]).collect()
    assert {(r["uuid"], r["window"]): (r["cohort"], r["justified"]) for r in got} == by_hand(rows, [0, 1, 3])


def test_cohorts_move_few_rows_of_each_fact(spark):
    start = dt.date(2024, 1, 1)
    rows = [(f"u{i}", f"s{i}", f"t{i}", "uses", f"g{i % 5}", start + dt.timedelta(days=i % 300), start + dt.timedelta(days=i % 290)) for i in range(2000)]
    df = spark.createDataFrame(rows, FACTS)
    # 3 keys of each written and of each retired fact, some of them in two spans; an offset's row of each key was 28
    assert moved(spark, lambda: audit.cohorts(df, df, [0, 1, 3]).count()) < 12 * 2000


def test_a_fact_is_cut_into_words_once(spark):
    """The guard's plan has the words of a fact below the join with what its write has written, not above."""
    rows = spark.createDataFrame([("a", 1, 1, 2, "N", "The red bolt costs 3.00 USD")], "uuid string, episode long, source long, target long, name string, fact string")
    plan = admission.guard(rows, rows, "episode")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan and "regexp_extract_all" not in plan[: plan.index("Join Inner")]


def test_repeats_count_in_overlaps(spark):
    rows = spark.createDataFrame([("red red bolt 3", "red red red nut 4"), ("The DB costs 3", "the DB cost 3"), (None, "a bolt"), ("AB x", "x CD")], "a string, b string")
    got = rows.select(F.round(compare.overlap(compare.content(F.col("a")), compare.content(F.col("b"))), 4).alias("o"), compare.values_differ(F.col("a"), F.col("b")).alias("d")).collect()
    assert [tuple(r) for r in got] == [(0.4, True), (1.0, False), (0.0, False), (0.5, True)]


def test_sessions_of_all_files(spark, tmp_path):
    """Open sessions, late events and a session that two files share are in the result."""
    at = lambda d, h, m: dt.datetime(2024, 1, d, h, m)
    files = [[(1, at(1, 0, 0)), (1, at(1, 0, 40)), (2, at(9, 0, 0))], [(1, at(1, 0, 20)), (1, at(1, 1, 10)), (None, at(1, 0, 0)), (2, at(9, 0, 10))]]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, "user_id long, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    events = spark.readStream.schema("user_id long, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    got = {(r.user_id, r.start, r.calls) for r in streams.all_sessions(events).collect()}
    assert got == {(1, "2024-01-01 00:00:00", 3), (1, "2024-01-01 01:10:00", 1), (None, "2024-01-01 00:00:00", 1), (2, "2024-01-09 00:00:00", 2)}


def test_words_of_texts_are_not_sent_to_the_driver(spark):
    parts = spark.createDataFrame([("a", "red bolt"), ("b", "blue nut")], "uuid string, text string")
    plan = scopes.mentions(parts, spark.createDataFrame([("red",)], "name string"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [word" in plan
    assert "SortMergeJoin [word" in brief_queries.name_mentions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_hops_move_no_links(spark):
    links = spark.range(3000).select(F.concat(F.lit("a"), F.col("id") % 1500).alias("source"), F.concat(F.lit("b"), F.col("id")).alias("target"))
    centres = spark.createDataFrame([(1, "a1"), (2, "b7"), (3, None)], "query long, uuid string")
    before = set(stages(spark))
    got = {tuple(r) for r in graph.hops_from(links, centres, 2).collect()}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert got == {(1, "a1", 0), (1, "b1", 1), (1, "b1501", 1), (2, "b7", 0), (2, "a7", 1), (2, "b1507", 2)}
    # small frontiers go to the links; both ways of all links were shuffled before
    assert sum(x.shuffleWriteRecords() for i, x in stages(spark).items() if i not in before) < 3000


def test_kinds_of_unchanged_texts(spark):
    """Marks are counted only where a text has changed; texts that bring marks of their own, and nulls, have no kinds."""
    rows = spark.createDataFrame([("plain [REDACTED:jwt]",), (None,), ("password = hunter22",)], "text string")
    df = screening.redact(rows, "text")
    assert [r.kinds for r in df.collect()] == [[], [], ["assigned_secret"]]
    plan = df._jdf.queryExecution().analyzed().toString()
    assert "CASE WHEN (_c" in plan


def test_write_guard_tells_of_each_retirement(spark):
    """Each returned line has a row: judged with a reason where it is undone, or unjudged where its write has written nothing."""
    sf = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    wrote = {r[0] for r in lines.filter("l_returnflag <> 'R'").select("l_orderkey").distinct().collect()}
    rows = admission_queries.write_guard(spark, sf).collect()
    assert len(rows) == len({r.uuid for r in rows}) == lines.filter("l_returnflag = 'R'").count()
    assert {r.episode in wrote for r in rows} == {True, False}
    for r in rows:
        assert (r.structural is None) == (r.lexical is None) == (r.episode not in wrote)
        assert r.stands == (r.episode not in wrote or (r.structural and r.lexical)) and (r.reason is None) == r.stands


def words_by_hand(facts, queries, k):
    out = set()
    for q, scope, asked, weights in queries:
        scores = [(-round(sum(w for t, w in zip(asked, weights, strict=True) if t in own) * weight, 9), u) for u, g, own, weight in facts if g == scope and u != q]
        out |= {(q, u, -s) for s, u in sorted(x for x in scores if x[0] < 0)[:k]}
    return out


def test_words_lens_by_hand(spark, monkeypatch):
    """Blocks, common and rare terms, ties, slices and rows without words give the best facts of each query."""
    rng = random.Random(5)
    some = lambda n: [w for w in (f"w{int(200 * rng.random() ** 3)}" for _ in range(n))]
    facts = [(u, rng.choice("pq"), sorted(set(some(rng.randrange(12)))), rng.choice([0.5, 1.0, 1.25])) for u in range(150)]
    queries = [(u, g, w, [rng.choice([0.25, 1.5, 3.0]) for _ in w]) for u, g, w, _ in facts[::4]] + [(999, "r", ["w1"], [1.0])]
    df, asked = spark.createDataFrame(facts, "uuid long, group_id string, words array<string>, weight double"), spark.createDataFrame(queries, "uuid long, group_id string, words array<string>, weights array<double>")
    for block, size, common, matches in ((1024, 4096, 768, 2_000_000), (10, 16, 3, 7), (10, 16, 0, 50)):
        monkeypatch.setattr(vectors, "BLOCK", block)
        for name, value in (("FACTS", size), ("COMMON", common), ("MATCHES", matches)):
            monkeypatch.setattr(words, name, value)
        got = [tuple(r) for r in words.nearest(df, asked, 5).collect()]
        assert len(got) == len(set(got)) and set(got) == words_by_hand(facts, queries, 5)


def test_words_lens_moves_no_row_for_each_shared_term(spark):
    """400 facts and 16 queries of one scope share 20 terms each: a row for each of those was 128,000."""
    rows = [(u, "p", [f"w{i}" for i in range(20)]) for u in range(400)]
    facts = spark.createDataFrame(rows, "uuid long, group_id string, words array<string>")
    assert moved(spark, lambda: recall_queries.lexical(facts).count()) < 8000


def test_grid_judges_a_text_once_for_its_query(spark, monkeypatch):
    """Texts and words go to a query once, not once for each configuration that has the fact among its best."""
    seen, judged = [], evaluate.judged
    monkeypatch.setattr(evaluate, "judged", lambda results, *args, **how: seen.append(results) or judged(results, *args, **how))
    grid_queries.grid_outcomes(spark, "/root/testdata/sf0.001", [{}, {"pool": 16}, {"cap": 1}])
    rows = [tuple(r) for r in seen[0].select("query", "uuid").collect()]
    assert len(rows) == len(set(rows)) >= 20
