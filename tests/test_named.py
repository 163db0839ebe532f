"""Scopes by names, details of entities, grids of configurations and judged proposals."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import compare
from tidemark.operators import evaluate, graph, grids, judged, retrieve, scopes
from tidemark.plans import grid_queries, registry

SF = "/root/testdata/sf0.001"
NAMES = ["atlas", "Blue Whale", "c++", "my-app", "Éclair", "the", "a.b", "zz\\E", "...", ""]
TEXTS = ["ATLAS runs on c++x", "the blue whale and The Blue  Whale", "blue whale", "myapp my app my-APP", "éclair; atlases", "a.b axb", "", None, "zz\\E1 c++", "atlas_1 atlas", "blue-whale the"]


def rule(text, names):
    return {n for n in names if re.search(r"\w", n) and re.search(rf"\b{re.escape(n)}\b", text or "", re.IGNORECASE)}


def test_mentions_equal_the_rule(spark):
    texts = spark.createDataFrame([*enumerate(TEXTS), (0, TEXTS[0]), (None, "atlas")], "uuid long, text string")
    got = {(r["uuid"], r["name"]) for r in scopes.mentions(texts, spark.createDataFrame([(n,) for n in [*NAMES, "atlas", None]], "name string")).collect()}
    assert got == {(i, n) for i, t in enumerate(TEXTS) for n in rule(t, NAMES)}
    assert {(0, "atlas"), (0, "c++"), (1, "Blue Whale"), (3, "my-app"), (4, "Éclair"), (5, "a.b")} <= got and (9, "atlas") in got and (10, "Blue Whale") not in got
    assert scopes.mentions(texts.limit(0), spark.createDataFrame([("atlas",)], "name string")).count() == 0


REGISTRY = [("ants", "x"), ("bees", "x"), ("cats", "y"), ("dogs", None), ("eels", None)]
SAID = {1: ("ants only", "project_ants"), 2: ("ants and BEES", "cluster_x"), 3: ("ants, cats", None), 4: ("dogs and ants", None), 5: ("dogs", "project_dogs"), 6: ("nothing", None), 7: (None, None), 8: ("dogs eels", None), 9: ("ants bees cats", None)}


def test_better_scope_and_the_gate_of_writes(spark):
    known = spark.createDataFrame(REGISTRY, "name string, cluster string")
    texts = spark.createDataFrame([(k, t) for k, (t, _) in SAID.items()], "uuid long, text string")
    assert {r["uuid"]: r["target"] for r in scopes.better_scope(texts, known).collect()} == {k: s for k, (_, s) in SAID.items() if s}
    rows = [(1, "ants only", "global", "hook", 0), (2, "ants only", "global", "person", 0), (3, "ants only", "project_z", "hook", 0), (4, None, "global", None, 0), (5, "bees", "global", None, 0), (6, "bees", None, "hook", 0)]
    writes = spark.createDataFrame(rows, "uuid long, text string, group_id string, source string, named long")
    got = {r["uuid"]: (r["group_id"], r["redirected_from"]) for r in scopes.redirected(writes, known, ["person"]).collect()}
    assert got == {1: ("project_ants", "global"), 2: ("global", None), 3: ("project_z", None), 4: ("global", None), 5: ("project_bees", "global"), 6: (None, None)}
    asked = spark.createDataFrame([("a", "c", "p"), (None, "c", "p"), ("", "", "p"), (None, None, None)], "a string, c string, p string")
    assert [r[0] for r in asked.select(scopes.requested(F.col("a"), F.col("c"), F.col("p"))).collect()] == ["agent_a", "cluster_c", "project_p", "global"]


def test_refiling_moves_active_global_facts_once(spark):
    known = spark.createDataFrame(REGISTRY, "name string, cluster string")
    day = dt.date(2026, 1, 1)
    rows = [("a", "ants", "global", None, False), ("b", "ants", "global", day, False), ("c", "ants", "global", None, True), ("d", "ants", "project_q", None, False), ("e", "quiet", "global", None, None), ("f", "bees ants", "global", None, None)]
    facts = spark.createDataFrame(rows, "uuid string, fact string, group_id string, invalid_at date, archived boolean")
    moved = scopes.refiled(facts, known)
    assert {(r["uuid"], r["group_id"], r["scope_refiled_from"]) for r in moved.collect()} == {("a", "project_ants", "global"), ("f", "cluster_x", "global")}
    after = facts.join(moved.select("uuid"), "uuid", "left_anti").unionByName(moved, allowMissingColumns=True)
    assert after.count() == facts.count() and scopes.refiled(after.drop("scope_refiled_from"), known).count() == 0


def test_details_of_a_hub_a_loop_and_an_isolated_entity(spark):
    props = {"color": "red", "name": "x", "fact_embedding": "1", "note": None, "summary": "s"}
    entities = spark.createDataFrame([("h", "hub", None, "p", ["Entity"], props), ("i", "alone", "s", "p", None, None)], "uuid string, name string, summary string, group_id string, labels array<string>, props map<string,string>")
    day = dt.date(2026, 1, 1)
    links = [(f"e{n:02}", "h", f"t{n}", "Uses", day + dt.timedelta(days=n), n) for n in range(20)] + [("loop", "h", "h", "Is", None, 0), ("in", "z", "h", "Has", day, 0), ("bad", "h", None, "Uses", None, 0)]
    facts = spark.createDataFrame(links, "uuid string, source string, target string, name string, valid_at date, degree long")
    got = {r["uuid"]: r for r in graph.details(entities, facts, 3).collect()}
    h, i = got["h"], got["i"]
    assert h["attributes"] == {"color": "red"} and i["attributes"] == {} and i["degree"] == i["n_out"] == 0 and i["edges_out"] == []
    assert (h["n_out"], h["n_in"], h["degree"]) == (22, 2, 23) and [e["uuid"] for e in h["edges_out"]] == ["e19", "e18", "e17"] and [e["uuid"] for e in h["edges_in"]] == ["in", "loop"]
    whole = graph.links_of(spark.createDataFrame([("h",), ("h",), (None,)], "uuid string"), facts).collect()
    assert len(whole) == 24 and sum(r["direction"] == "in" for r in whole) == 2
    assert all(not r["edges_out"] for r in graph.details(entities, facts.limit(0), 3).collect())


def test_each_configuration_is_a_run_of_its_own(spark):
    words = [f"w{i}" for i in range(12)]
    day = dt.datetime(2024, 1, 1)
    rows = [(u, [words[u % 12], words[(u * 5) % 12], "shared"], f"p{u % 2}", day + dt.timedelta(days=u), u % 4, f"c{u % 3}", [1.0, float(u % 7), float(u % 3)]) for u in range(40)]
    facts = spark.createDataFrame(rows, "uuid long, words array<string>, group_id string, created_at timestamp, doc long, source string, embedding array<double>")
    pairs = [(q, u, None if u % 13 == 0 else round(((u * 37 + q * 11) % 97) / 97 - 0.1, 4), ((u * 7 + q) % 10) / 10 if u % 3 else None, u % 3 if u % 4 else None) for q in (0, 7, 9) for u in range(40) if u != q]
    cands = spark.createDataFrame(pairs, "query long, uuid long, sim double, bm25 double, hops int")
    degree = spark.createDataFrame([("c0", 5), ("c1", 2)], "source string, degree long")
    configs = [{}, {"pool": 5}, {"floor": 0.5, "rescue": 0.2}, {"rescue": None}, {"floor": 0.0}, {"relevance": 0.9, "connectivity": 0.8}, {"pool": 9, "balance": 0.5, "cap": 1}, {"balance": 0.3, "cap": None}]
    now = F.lit("2024-02-20").cast("timestamp")
    default = {"pool": 40, "floor": 0.3, "rescue": 0.1, "balance": 0.7, "cap": 2} | retrieve.WEIGHTS

    def ranked(scored, **how):
        return retrieve.diversify(scored.withColumn("source", F.col("doc")).join(facts.select("uuid", "embedding"), "uuid"), 6, **how)

    got = ranked(grids.score_grid(cands, facts, degree, grids.grid(spark, configs, default), 0.25, now), config="config").collect()
    for i, own in enumerate(configs):
        c = default | own
        by_hand = {}
        for q in (0, 7, 9):
            seen = [p for p in pairs if p[0] == q]
            best = {name: {p[1] for p in sorted((p for p in seen if p[j] is not None), key=lambda p: (sign * p[j], p[1]))[: c["pool"]]} for name, j, sign in (("sim", 2, -1), ("bm25", 3, -1), ("hops", 4, 1))}
            by_hand |= {(q, p[1]): (q, p[1], p[2], p[3] if p[1] in best["bm25"] else None, p[4] if p[1] in best["hops"] else None) for p in seen if any(p[1] in b for b in best.values())}
        pool = spark.createDataFrame(list(by_hand.values()), cands.schema)
        kept = grids.banded(grids.with_common(pool, facts), F.lit(c["floor"]), F.lit(c["rescue"]).cast("double"), 0.25).join(degree, "source", "left").drop("source")
        fused = retrieve.fuse(kept.withColumn("confidence", F.lit(None).cast("double")), grids.lenses())
        base = 0.0 if c["floor"] <= 0 else min(c["floor"], c["floor"] if c["rescue"] is None else c["rescue"])
        single = retrieve.composite(fused, base, now, {w: c[w] for w in retrieve.WEIGHTS}).withColumn("score", F.round("score", 6))
        want = {(r["query"], r["rank"], r["uuid"], r["score"]) for r in ranked(single, balance=c["balance"], cap=2**31 - 1 if c["cap"] is None else c["cap"]).collect()}
        assert {(r["query"], r["rank"], r["uuid"], r["score"]) for r in got if r["config"] == i} == want, c
    assert len({tuple(sorted((r["query"], r["rank"], r["uuid"]) for r in got if r["config"] == i)) for i in range(len(configs))}) > 4
    with pytest.raises(ValueError, match="unknown"):
        grids.grid(spark, [{"flor": 1}], default)
    with pytest.raises(ValueError, match="at most"):
        grids.grid(spark, [{}] * (grids.MOST + 1), default)


def test_the_grids_first_configuration_is_the_plain_run(spark):
    whole = {tuple(r) for r in registry.QUERIES["case_metrics"](spark, SF).collect()}
    first = evaluate.metrics(grid_queries.grid_outcomes(spark, SF, [{}]), ("config",))
    assert {tuple(r)[1:] for r in first.collect()} == whole


METRICS = "config int, category string, hit_rate double, mrr double, violations long"


def test_gate_on_what_got_worse(spark, tmp_path):
    before = spark.createDataFrame([(0, "OVERALL", 0.8, 0.0, 3), (0, "x", 0.1, 0.1, 0)], METRICS)
    rows = [(1, "OVERALL", 0.77, 0.0, 0), (2, "OVERALL", 0.75, 0.5, 0), (3, "OVERALL", 0.9, 0.5, 1), (4, "OVERALL", None, 0.0, 0), (4, "x", 0.0, 0.0, 9)]
    got = evaluate.regressions(spark.createDataFrame(rows, METRICS), before, ("config",)).collect()
    assert {(r["config"], r["metric"], r["before"], r["now"]) for r in got} == {(2, "hit_rate", 0.8, 0.75), (3, "violations", 3.0, 1.0)}
    path = str(tmp_path / "baseline")
    with pytest.raises(ValueError, match="3 violations"):
        evaluate.save_baseline(before, path)
    evaluate.save_baseline(spark.createDataFrame(rows, METRICS).filter("config = 1"), path)
    assert evaluate.regressions(spark.createDataFrame(rows, METRICS).filter("config = 2"), spark.read.parquet(path)).count() == 0


STATED = {1: "The port is 8080", 2: "the ports are 8080", 3: "The port is 9090", 4: "8080 port", 5: None, 6: "Sun shines", 7: "Rain falls"}


def test_merges_go_through_both_gates_and_lose_no_pair(spark):
    facts = spark.createDataFrame(list(STATED.items()), "uuid long, fact string")
    pairs = spark.createDataFrame([("p", 1, 2, 0.9), ("p", 1, 3, 0.99), ("p", 1, 4, 0.8), ("p", 1, 5, 0.7), ("p", 2, 4, 0.95), ("p", 1, 77, 0.9)], "scope string, canonical long, duplicate long, similarity double")
    told = lambda df: {(r["canonical"], r["duplicate"]): r["outcome"] for r in df.collect()}
    assert told(judged.merge_proposals(pairs, facts, limit=2)) == {(1, 2): "proposed", (1, 3): "withheld", (1, 4): "waiting", (1, 5): "withheld", (2, 4): "proposed"}
    verdicts = spark.createDataFrame([(1, 2, "duplicate"), (1, 3, "duplicate"), (1, 4, None), (2, 4, "distinct")], "canonical long, duplicate long, relation string")
    rows = judged.merge_proposals(pairs, facts, verdicts)
    assert told(rows) == {(1, 2): "proposed", (1, 3): "withheld", (1, 4): "rejected", (1, 5): "withheld", (2, 4): "rejected"}
    assert next(r for r in rows.collect() if r["duplicate"] == 3)["differs"] == ["8080", "9090"] and len({r["proposal_key"] for r in rows.collect()}) == 5
    assert judged.merge_proposals(pairs.limit(0), facts, verdicts).count() == 0


def test_contradictions_need_a_value_and_a_judge(spark):
    facts = spark.createDataFrame(list(STATED.items()), "uuid long, fact string")
    pairs = spark.createDataFrame([("p", 1, 2, 0.9), ("p", 1, 3, 0.99), ("p", 2, 3, 0.8), ("p", 3, 4, 0.7), ("p", 6, 7, 0.9)], "scope string, canonical long, duplicate long, similarity double")
    verdicts = spark.createDataFrame([(1, 2, "contradiction"), (1, 3, "contradiction"), (2, 3, "contradiction"), (6, 7, "contradiction")], "canonical long, duplicate long, relation string")
    got = {(r["canonical"], r["duplicate"]): r["outcome"] for r in judged.contradiction_proposals(pairs, facts, verdicts, 1).collect()}
    assert got == {(1, 3): "proposed", (2, 3): "waiting", (3, 4): "rejected"}
    assert judged.contradiction_proposals(pairs, facts).count() == 0
    assert spark.range(1).select(compare.values_differ(F.lit("a 1"), F.lit("a 2"))).head()[0]
