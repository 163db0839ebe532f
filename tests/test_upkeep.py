"""Vocabulary, chunks, runbook versions, counters, settled captures and recent facts on literal rows."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from tidemark.functions import relations
from tidemark.operators import evaluate, feedback, retrieve, runbooks
from tidemark.sources.chunks import chunk_corpus

DAY = dt.date(2026, 1, 1)


def test_vocabulary_report_keeps_what_has_no_canonical_form(spark):
    names = ["Uses"] * 3 + ["uses", "built_with", "Haunts", "Haunts", "Glows", "", None, "RelatedTo"]
    got = {tuple(r) for r in relations.vocabulary_report(spark.createDataFrame([(n,) for n in names], "name string")).select("kind", "old", "new", "n").collect()}
    assert got == {("canonical", "Uses", "Uses", 3), ("rename", "uses", "Uses", 1), ("rename", "built_with", "Uses", 1), ("residual", "Haunts", "Haunts", 2), ("one-off", "Glows", "Glows", 1), ("canonical", "RelatedTo", "RelatedTo", 1)}


def test_chunks_of_projects(spark):
    long = lambda c: (c + " ") * 50
    own = "<!-- own -->" + long("mine") + "\n\n" + long("mine too") + "<!-- /own -->"
    docs = [
        ("p", "a.md", f"# {long('a')}\n \n- {long('list')}\n\nshort\n\n{long('b')}\n{long('c')}"), ("p", "README.md", own + f"\n\n{long('r')}\n\n```\n{long('code')}\n\n{long('code')}```\n\n| {long('t')}"),
        ("p", "LICENSE.md", long("law")), ("p", "b.md", None), ("p", "c.md", f"```{long('open')}"), ("q", "x.md", "\n\n".join(long(f"n{i}") for i in range(60))), ("r", "e.md", ""),
    ]
    got = chunk_corpus(spark.createDataFrame(docs, "project string, name string, text string"), ("<!-- own -->", "<!-- /own -->")).collect()
    p = [(r["name"], r["chunk"].split()[0]) for r in sorted((r for r in got if r["project"] == "p"), key=lambda r: (r["name"] != "README.md", r["name"], r["pos"]))]
    assert p == [("README.md", "r"), ("a.md", "a"), ("a.md", "b"), ("c.md", "```open")] and not any("code" in r["chunk"] or "mine" in r["chunk"] or "law" in r["chunk"] for r in got)
    assert sorted(r["pos"] for r in got if r["project"] == "q") == list(range(40)) and "\n" not in got[0]["chunk"]
    first = chunk_corpus(spark.createDataFrame(docs, "project string, name string, text string").filter("project = 'p'"), most=1, priority=["c.md"]).collect()
    assert [r["name"] for r in first] == ["c.md"]


def test_runbooks_are_adopted_superseded_or_verified(spark):
    old = [("u1", "deploy", "p", ["a", "b"], False), ("u2", "test", "p", None, None), ("u3", "gone", "p", ["x"], True), ("u4", "same", "p", ["s", "s"], False), ("u6", "twin", "p", ["t"], False), ("u5", "twin", "p", ["u"], False)]
    existing = spark.createDataFrame(old, "uuid string, name string, scope string, steps array<string>, archived boolean")
    rows = [(" deploy ", "p", ["a", " c d "], 1), ("deploy", "p", ["a"], 0), ("test", "p", ["go"], 1), ("gone", "p", ["y"], 1), ("same", "p", ["s ", "", "s"], 1), ("twin", "p", ["u"], 1), ("deploy", None, ["z"], 1)]
    bad = [(None, "p", ["a"], 1), ("none", "p", [" "], 1), ("many", "p", ["s"] * 61, 1), ("wide", "p", ["s" * 601], 1), ("null", "p", None, 1)]
    given = spark.createDataFrame([(*r[:3], None, r[3]) for r in rows + bad], "name string, scope string, steps array<string>, purpose string, at int")
    told = runbooks.upsert(existing, given, F.lit(DAY))
    got = {(r["name"], r["scope"]): r for r in told.collect()}
    assert {k[0]: r["outcome"] for k, r in got.items() if k[1] == "p"} == {"deploy": "updated", "test": "adopted", "gone": "created", "same": "verified", "twin": "verified"} | {k: "rejected" for k in ("", "none", "many", "wide", "null")}
    d = got["deploy", "p"]
    assert (d["uuid"], d["steps"], d["previous_steps"], d["superseded_at"]) == ("u1", ["a", "c d"], ["a", "b"], DAY) and got["twin", "p"]["uuid"] == "u5" and got["deploy", "global"]["outcome"] == "created"
    assert got["same", "p"]["previous_steps"] == [] and got["same", "p"]["superseded_at"] is None and got["many", "p"]["uuid"] is None
    after = told.filter("uuid is not null").select("uuid", "name", "scope", "steps", F.lit(False).alias("archived"))
    again = runbooks.upsert(after, given, F.lit(DAY)).filter("outcome <> 'rejected'").collect()
    assert {r["outcome"] for r in again} == {"verified"} and {r["uuid"] for r in again} == {r["uuid"] for r in after.collect()}


def test_counters_only_go_up(spark):
    at = lambda n: dt.datetime(2026, 1, n)
    facts = spark.createDataFrame([("a", 2, at(9)), ("b", None, None), ("c", 1, at(1))], "uuid string, recalled_n long, last_recalled_at timestamp")
    served = spark.createDataFrame([("a", at(3), True), ("a", at(4), True), ("a", at(12), False), ("b", at(5), True), ("b", None, True), ("c", at(7), None), ("z", at(1), True), (None, at(1), True)], "uuid string, at timestamp, opted_in boolean")
    wrong = spark.createDataFrame([("c", at(2)), ("c", at(6))], "uuid string, at timestamp")
    got = {r["uuid"]: (r["recalled_n"], r["last_recalled_at"], r["corrected_n"], r["last_corrected_at"]) for r in feedback.apply_feedback(facts, served, wrong).collect()}
    assert got == {"a": (4, at(9), 0, None), "b": (2, at(5), 0, None), "c": (1, at(1), 2, at(6))}


def test_captures_are_settled_once(spark):
    pending = spark.createDataFrame([(1, "p", "one", "h1"), (2, "p", "one", "h1"), (3, "p", "two", "h2"), (4, "q", "one", "h1"), (5, "p", "five", "h5"), (6, "p", "six", "h6")], "uuid long, group_id string, text string, hash string")
    decisions = spark.createDataFrame([(1, "approve"), (2, "approve"), (3, "approve"), (3, "approve"), (4, "approve"), (5, "approve"), (5, "dismiss"), (9, "approve"), (6, "wait")], "uuid long, action string")
    known = spark.createDataFrame([("p", "h2"), (None, None)], "group_id string, hash string")
    statuses, facts = feedback.settle_pending(pending, decisions, known)
    assert {(r["uuid"], r["status"]) for r in statuses.collect()} == {(1, "approved"), (2, "approved"), (3, "approved"), (4, "approved"), (5, "dismissed")}
    made = facts.collect()
    assert {(r["group_id"], r["fact"]) for r in made} == {("p", "one"), ("q", "one")} and len({r["uuid"] for r in made}) == 2
    assert feedback.settle_pending(pending, decisions, known.unionByName(facts.select("group_id", "hash")))[1].count() == 0


def words(text):
    return {w for w in re.findall("[a-z0-9]+", text.lower()) if len(w) > 2 and w not in evaluate.STOPWORDS}


def test_recent_facts_say_what_the_sections_do_not(spark):
    rng = random.Random(5)
    said = lambda: " ".join(rng.choice(["pump", "valve", "rotor", "gasket", "boiler", "crank", "piston", "flange", "gauge", "sensor", "relay", "motor"]) for _ in range(rng.randint(1, 5)))
    scopes = ["global", "cluster_1", "project_a", "project_b"]
    facts = [(i, rng.choice(scopes), DAY + dt.timedelta(days=rng.randint(0, 50)), rng.choice([said(), said(), " ", None, "x" * 250 + f" {i}"])) for i in range(400)]
    entities = [(f"n{i}", rng.choice(scopes), "Lesson", said(), None, None, None, None, DAY + dt.timedelta(days=i)) for i in range(4)]
    seats = spark.createDataFrame([("project_a", "cluster_1"), ("project_b", None), ("project_c", None)], "seat string, cluster string")
    frame = spark.createDataFrame(facts, "uuid long, scope string, created_at date, fact string")
    told = retrieve.recent(seats, spark.createDataFrame(entities, "uuid string, scope string, label string, name string, summary string, why string, rejected string, severity string, created_at date"), frame, {"Lesson": "lessons"})
    got = {}
    for r in sorted(told.collect(), key=lambda r: r["pos"]):
        got.setdefault(r["seat"], []).append(r["line"])
    for seat, cluster in (("project_a", "cluster_1"), ("project_b", None), ("project_c", None)):
        sees = {"global", cluster, seat}
        pool = sorted((f for f in facts if f[1] in sees and f[3] is not None), key=lambda f: (f[2], f[0]), reverse=True)[:84]
        seen, want = [words(e[3]) for e in entities if e[1] in sees], []
        for f in pool:
            line = " ".join(f[3].split())
            line = line if len(line) <= 200 else line[:199].rstrip() + "…"
            w = words(line)
            if w and len(want) < 7 and all(len(w & s) / len(w | s) < 0.18 for s in seen if s):
                want.append(line)
                seen.append(w)
        assert got.get(seat, []) == want and want
