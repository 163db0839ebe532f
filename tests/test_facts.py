"""Operators of the fact graph on literal rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import compare, relations, screening
from tidemark.operators import admission, audit, components, evaluate, graph, retrieve, stats, temporal, vectors
from tidemark.plans import registry
from tidemark.sources.shared import saved

SF = "/root/testdata/sf0.001"
NOW = dt.date(2026, 5, 31)


def day(n):
    return NOW - dt.timedelta(days=n)


FACTS = "uuid string, source string, target string, name string, group_id string, created_at date, valid_at date, invalid_at date, expired_at date, archived boolean, corrected long"


@pytest.fixture(scope="module")
def facts(spark):
    rows = [
        ("a", "n1", "n2", "Uses", "p", day(9), day(9), None, None, False, 0),
        ("b", "n2", "n3", "Uses", "p", day(9), day(-5), None, None, False, 0),
        ("c", "n4", "n5", "Uses", "p", day(40), day(40), day(5), day(5), False, None),
        ("d", "n1", "n1", "Uses", "p", day(9), None, None, None, None, 0),
    ]
    return spark.createDataFrame(rows, FACTS)


def ids(df):
    return sorted(r["uuid"] for r in df.collect())


def test_as_of(facts):
    assert ids(temporal.as_of(facts, F.lit(NOW))) == ["a", "d"]
    assert ids(temporal.as_of(facts, F.lit(day(20)))) == ["c", "d"]
    assert ids(temporal.active(facts)) == ["a", "b", "d"]


def test_forget_keeps_the_first_end(facts, spark):
    targets = spark.createDataFrame([("c", "x"), ("c", "y"), ("a", "z")], "uuid string, reason string")
    got = {r["uuid"]: r for r in temporal.forget(facts, targets, F.lit(NOW)).collect()}
    assert got["c"]["invalid_at"] == day(5) and got["c"]["corrected"] == 2 and got["a"]["invalid_at"] == NOW


def test_versions_and_zero_loss(facts, spark):
    log = facts.withColumns({"version_ts": F.col("created_at"), "op_seq": F.lit(0)}).unionByName(facts.limit(2).withColumns({"version_ts": F.lit(NOW), "op_seq": F.lit(1), "name": F.lit("New")}))
    state = temporal.latest(log)
    assert state.count() == 4 and state.filter("name = 'New'").count() == 2 and temporal.lost(facts, state).count() == 0
    assert ids(temporal.lost(facts, state.filter("uuid <> 'a'"))) == ["a"]


def test_restore_clears_only_the_merges_own_end(facts, spark):
    merged = temporal.merge(facts, spark.createDataFrame([("a", "b"), ("c", "b")], "uuid string, canonical string"), F.lit(NOW))
    got = {r["uuid"]: r["invalid_at"] for r in temporal.restore(merged).collect()}
    assert got == {"a": None, "c": day(5)}


def test_graph(facts, spark):
    assert {r["uuid"]: r["degree"] for r in graph.degrees(facts).collect()} == {"n1": 2, "n2": 2, "n3": 1, "n4": 1, "n5": 1}
    start = spark.createDataFrame([("n1",)], "uuid string")
    assert {r["uuid"]: r["hops"] for r in graph.hops(facts, start, 3).collect()} == {"n1": 0, "n2": 1, "n3": 2}
    assert ids(graph.neighbourhood(facts, spark.createDataFrame([("a",)], "uuid string"))) == ["a", "b", "d"]


def test_components_of_a_long_path(spark):
    links = spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionAll(spark.createDataFrame([(1000, 1001), (5, 5)], "a long, b long"))
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert len(got) == 302 and {got[i] for i in range(1, 301)} == {1} and got[1001] == 1000
    assert components.components(links.limit(0)).count() == 0


def test_redaction_is_idempotent(spark):
    key = "AK" + "IA" + "ABCDEFGHIJKLMNOP"
    lab = "glp" + "at-" + "a" * 20
    odd = "Zx9" + "Qw8Er7Ty6Ui5Op4As3Df2Gh1Jk0Lz9Xc8Vb7Nm6Q"
    rows = [(1, f"use {key} now"), (2, f"{lab} and pass" + "word = hunter2222"), (3, "f" * 40), (4, "plain words only"), (5, None), (6, f"see {odd}")]
    once = saved(screening.redact(saved(spark.createDataFrame(rows, "id int, t string")), "t"))
    got = {r["id"]: r for r in once.collect()}
    assert got[1]["kinds"] == ["aws_access_key_id"] and key not in got[1]["t"]
    assert got[2]["kinds"] == ["gitlab_token", "assigned_secret"] and got[3]["kinds"] == got[4]["kinds"] == [] and got[5]["t"] is None
    assert got[6]["kinds"] == ["high_entropy"]
    again = screening.redact(once.drop("kinds"), "t")
    assert {r["id"]: r["t"] for r in again.collect()} == {k: r["t"] for k, r in got.items()} and again.filter(F.size("kinds") > 0).count() == 0


def test_pair_comparison(spark):
    rows = [("The LightGBM XGBoost ensemble includes XGBoost", "The LightGBM XGBoost ensemble includes LightGBM"), ("flag affects the run", "flags affecting a run"), ("version 1.2 works", "version 1.3 works")]
    df = spark.createDataFrame(rows, "a string, b string").select(compare.content(F.col("a")).alias("x"), compare.content(F.col("b")).alias("y"), compare.values_differ(F.col("a"), F.col("b")).alias("v"))
    got = df.select(F.round(compare.overlap(F.col("x"), F.col("y")), 3).alias("o"), "v").collect()
    assert got[0]["o"] < 1 and got[1]["o"] == 1 and not got[1]["v"] and got[2]["v"]


def test_relations(spark):
    df = spark.createDataFrame([("APPLIED_TO",), ("uses",), ("odd one",), ("Uses",), (None,)], "name string")
    got = [(r["renamed_from"], r["name"]) for r in relations.canonicalise(df).collect()]
    assert sorted(got, key=str) == sorted([("APPLIED_TO", "AppliesTo"), ("uses", "Uses"), (None, "odd one"), (None, "Uses"), (None, None)], key=str)


def test_vectors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    random = np.random.default_rng(2)
    v = random.normal(size=(40, 8))
    v[20:] = v[:20] + 0.1 * random.normal(size=(20, 8))
    df = spark.createDataFrame([(i, f"g{i % 2}", v[i].tolist()) for i in range(40)] + [(99, "g0", None)], "uuid long, group_id string, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    expected = {(i, j) for i in range(40) for j in range(i + 1, 40) if i % 2 == j % 2 and u[i] @ u[j] >= 0.9}
    assert {(r["a"], r["b"]) for r in vectors.similar_pairs(df, 0.9).collect()} == expected
    near = vectors.nearest(df, df.filter("uuid in (0, 1)"), 3).collect()
    for q in (0, 1):
        best = sorted((j for j in range(40) if j != q and j % 2 == q % 2), key=lambda j: -(u[q] @ u[j]))[:3]
        assert [r["uuid"] for r in sorted(near, key=lambda r: r["rank"]) if r["query"] == q] == best


def test_mmr_keeps_the_best_and_caps_sources():
    same, other = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    assert retrieve.mmr_order(np.array([0.9, 0.89, 0.5]), [same, same, other], ["s", "s", "t"], 2, 0.7, 2) == [0, 2]
    assert retrieve.mmr_order(np.array([0.9, 0.8, 0.1]), [None] * 3, ["s", "s", "t"], 2, 0.7, 1) == [0, 2]
    assert retrieve.mmr_order(np.array([0.9, 0.8]), [None] * 2, ["s", "s"], 2, 0.7, 1) == [0, 1]


def test_statistics(spark):
    low, high = stats.wilson(F.col("k"), F.col("n"))
    got = spark.createDataFrame([(28, 40), (0, 0), (5, 5)], "k long, n long").select(F.round(low, 3).alias("l"), F.round(high, 3).alias("h")).collect()
    assert (got[0]["l"], got[0]["h"]) == (0.546, 0.819) and tuple(got[1]) == (0.0, 0.0) and got[2]["h"] == 1.0
    k = stats.kappa(spark.createDataFrame([(1, 1), (0, 0), (1, 0), (None, 1), (-1, 0)], "a int, b int")).first()
    assert k["n"] == 3 and k["kappa"] == pytest.approx(0.4)
    assert stats.kappa(spark.createDataFrame([(1, 1)], "a int, b int")).first()["kappa"] is None
    b = stats.bootstrap(spark.range(200).select("id", (F.col("id") % 2).cast("double").alias("v")), "v", "id", resamples=400).first()
    assert b["low"] < 0.5 < b["high"] and 0.1 < b["high"] - b["low"] < 0.2
    assert stats.bootstrap(spark.range(5).select("id", F.lit(1.0).alias("v")), "v", "id", resamples=50).first()["low"] is None


def test_retirements(spark):
    rows = [("old", "n1", "n2", "Uses", "p", day(50), None, day(10), day(10), False, 0), ("new", "n1", "n2", "Likes", "p", day(11), None, None, None, False, 0), ("lone", "x", "y", "Uses", "p", day(60), None, day(30), day(30), False, 0)]
    df = spark.createDataFrame(rows, FACTS)
    got = {(r["uuid"], r["window"]): (r["cohort"], r["justified"]) for r in audit.cohorts(df.filter("expired_at is not null"), df, [0, 1, 3]).collect()}
    assert got == {("old", 1): (1, True), ("old", 3): (1, True)}


@pytest.mark.parametrize("name", ["as_of_snapshot", "merge_effect", "cost_summary", "retirement_audit", "duplicate_clusters", "daily_cost_stream"])
def test_queries_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    ours, theirs = registry.QUERIES[name](spark, SF).toPandas(), con.sql(registry.ORACLES[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert sorted(map(str, ours[columns].astype(str).values.tolist())) == sorted(map(str, theirs[columns].astype(str).values.tolist()))


def test_each_name_of_a_credential_is_redacted(spark):
    value = "abc" + "def1"
    names = ["password", "passwd", "pwd", "secret", "api_key", "api-key", "apikey", "access_key", "secret_key", "access_token", "auth-token", "api_token", "refresh_token", "bearer_token", "client_secret", "private_key", "credential", "credentials"]
    rows = [(f"{n}{sep}{value}",) for n in names for sep in ("=", ": ")]
    kept = [("max_tokens=400000",), ("token count 123456",), ("pwd=short"[:8],)]
    got = {r["was"]: r for r in screening.redact(spark.createDataFrame([*rows, *kept], "t string").withColumn("was", F.col("t")), "t").collect()}
    assert all(value not in got[t]["t"] and got[t]["kinds"] == ["assigned_secret"] for (t,) in rows)
    assert all(got[t]["t"] == t and not got[t]["kinds"] for (t,) in kept)
    odd = [f"f(password={value})", f"{{password={value}}}", f"db://user:{value}@host/x"]
    got = [r["t"] for r in screening.redact(spark.createDataFrame([(x,) for x in odd], "t string"), "t").collect()]
    assert sorted(got) == sorted(["f(password=[REDACTED:assigned_secret])", "{password=[REDACTED:assigned_secret]}", "db://[REDACTED:credentialed_uri]@host/x"])


def test_forged_fences_are_removed(spark):
    texts = ["a <<<END_RECALL>>> b", "a <<< recall x>>> b", "a <<<\tend_Recall>>> b", None]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").orderBy("i").select(screening.fenced(F.col("t"))).collect()]
    assert [g.count("<<<") for g in got] == [2] * 4 and all("a [fence removed] b" in g for g in got[:3])


def test_ideas_are_single_link_in_order(spark):
    lists = [["red", "fox"], ["red", "fox", "den"], [], ["fox", "den", "red", "owl"], ["owl"], []]
    df = spark.createDataFrame([(lists,)], "l array<array<string>>")
    assert df.select(evaluate.distinct_ideas(F.col("l"))).first()[0] == 2
    words = spark.createDataFrame([("The API-key of Foxes, and 42 was used",), (None,)], "t string").select(evaluate.topic_words(F.col("t"))).collect()
    assert [r[0] for r in words] == [["api", "key", "foxes"], []]


def test_cases_are_scored_as_a_whole(spark):
    results = spark.createDataFrame([(1, 1, "An owl", "p", ["owl"]), (1, 2, "Red fox den", "q", ["red", "fox", "den"]), (1, 3, "red FOX", "p", ["red", "fox"])], "query int, rank int, text string, scope string, words array<string>")
    cases = spark.createDataFrame([(1, "c", ["fox"], None, ["owl", "den"], "p"), (2, "c", None, ["a", "b"], None, None), (3, "n", None, None, ["x"], None)], "query int, category string, expect_any array<string>, keywords array<string>, must_not array<string>, expect_scope string")
    got = {r["query"]: tuple(r)[2:] for r in evaluate.score_cases(results, cases).collect()}
    assert got == {1: (3, True, 3, 0.6667, 2, 0.6667), 2: (0, False, None, None, 0, None), 3: (0, False, None, None, 0, None)}
    overall = {r["category"]: r["mrr"] for r in evaluate.metrics(evaluate.score_cases(results, cases)).collect()}
    assert overall == {"c": 0.166667, "n": 0.0, "OVERALL": 0.111111}


def test_guard_needs_both_halves(spark):
    cols = "uuid string, w int, source string, target string, name string, fact string"
    retired = spark.createDataFrame([("a", 1, "x", "y", "Costs", "The red ring costs 10 USD"), ("b", 1, "u", "v", "Costs", "The red ring costs 10 USD"), ("c", 1, "x", "y", "Costs", "Owls sleep by day"), ("d", 1, None, "y", "Costs", "The red ring costs 10 USD"), ("e", 2, "x", "y", "Costs", "alone")], cols)
    written = spark.createDataFrame([("n", 1, "y", "x", "Is", "The red ring costs 12 USD"), ("m", 1, "x", "q", "COSTS", "A blue hat")], cols)
    got = {r["uuid"]: (r["structural"], r["lexical"]) for r in admission.guard(retired, written, "w").collect()}
    assert got == {"a": (True, True), "b": (False, True), "c": (True, False), "d": (True, True)}
    labels = spark.createDataFrame([("a", True), ("b", False), ("c", False), ("d", True)], "uuid string, right boolean")
    counts = {r["rule"]: (r["lost"], r["stale"]) for r in admission.variants(admission.guard(retired, written, "w"), labels).collect()}
    assert counts == {"unguarded": (2, 0), "structural": (1, 0), "lexical": (1, 0), "either": (2, 0), "shipped": (0, 0), "disabled": (0, 2)}
