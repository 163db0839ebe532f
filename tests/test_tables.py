"""The fact table, transcripts, lineage, proposals that are carried out, and novel lines, on small rows."""

import datetime as dt
import json
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import screening
from tidemark.operators import evaluate, lineage, proposals, retrieve, temporal
from tidemark.plans import table_queries
from tidemark.sources.facttable import FactTable
from tidemark.sources.shared import saved, shared_dir
from tidemark.streaming import transcripts

SCHEMA = "uuid string, group_id string, name string, version_ts long, op_seq int"


def versions(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def table_with_two_batches(spark):
    rng = random.Random(4)
    first = [(f"u{i}", f"s{i % 5}", f"n{i}", 1, 0) for i in range(60)]
    second = [(f"u{i}", f"s{i % 5}", rng.choice("xyz"), rng.choice([0, 2]), 1) for i in range(0, 60, 5)]  # scope s0 only
    facts = FactTable(spark, shared_dir(spark), versions(spark, first).schema)
    facts.append(versions(spark, first))
    assert facts.compact() == 0 and facts.compact() is None
    facts.append(versions(spark, second))
    return facts, rows_of(temporal.latest(versions(spark, first + second)).select(*versions(spark, first).columns))


def test_fact_table_reads_and_compacts_touched_scopes(spark):
    facts, expected = table_with_two_batches(spark)
    assert rows_of(facts.read()) == expected
    assert facts.compact() == 1
    assert rows_of(facts.read()) == expected
    runs = {r.group_id: r.run for r in facts._manifest()[0].collect()}
    assert runs == {"s0": 1, "s1": 0, "s2": 0, "s3": 0, "s4": 0}
    facts.vacuum()
    assert rows_of(facts.read(["s0", "s3"])) == [r for r in expected if r[1] in ("s0", "s3")]
    assert facts.read(["none"]).count() == 0
    plan = facts.read(["s3"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*group_id", plan)


def test_a_compaction_that_stopped_is_not_seen(spark):
    facts, expected = table_with_two_batches(spark)
    # the state was written, the manifest was not
    versions(spark, [("bad", "s0", "n", 9, 9)]).write.partitionBy("group_id").parquet(f"{facts.path}/state/run=1")
    os.makedirs(f"{facts.path}/manifest/run=1")
    # and an append that was stopped
    os.makedirs(f"{facts.path}/log/batch=2/group_id=s0")
    assert rows_of(facts.read()) == expected
    assert facts.compact() == 2 and rows_of(facts.read()) == expected
    facts.append(versions(spark, [("new", "s9", "n", 1, 0)]))
    assert facts.read(["s9"]).count() == 1
    facts.vacuum()
    assert rows_of(facts.read()) == sorted([*expected, ("new", "s9", "n", 1, 0)])


def test_an_empty_fact_table(spark):
    facts = FactTable(spark, shared_dir(spark), versions(spark, []).schema)
    assert facts.read().count() == 0 and facts.compact() is None
    facts.vacuum()


LINES = [
    {"type": "user", "message": {"role": "user", "content": " hello "}},
    {"type": "assistant", "message": {"content": [{"type": "text", "text": "a"}, "odd", {"type": "tool", "text": "no"}, {"type": "text"}, {"type": "text", "text": "b"}]}},
    {"role": "user", "content": "[1, 2]"},
    {"role": "system", "content": "no"},
    {"role": "user", "content": "  "},
    {"role": "user", "content": 5},
    {"role": "user"},
]


def test_transcripts_take_new_files_once_and_set_bad_lines_aside(spark, tmp_path):
    source, path, state = tmp_path / "in", shared_dir(spark), shared_dir(spark)
    source.mkdir()
    (source / "one").write_text("\n".join([*map(json.dumps, LINES), "not json {", "", "[1]", "7"]) + "\n")

    def run():
        transcripts.ingest(spark.readStream.text(str(source)), path, state)
        return spark.read.schema(transcripts.TURNS).parquet(f"{path}/turns")

    assert run().count() == 3
    (source / "two").write_text(json.dumps({"sessionId": "s", "type": "user", "content": "later"}) + "\n")
    turns = run()
    assert turns.count() == 4 and run().count() == 4
    got = {r.session.rsplit("/", 1)[-1]: (r.turns, r.text) for r in transcripts.sessions(turns).collect()}
    assert got == {"one": (3, "user: hello\nassistant: a  b\nuser: [1, 2]"), "s": (1, "user: later")}
    assert sorted(r.line for r in spark.read.schema(transcripts.BAD).parquet(f"{path}/bad").collect()) == ["7", "[1]", "not json {"]
    cut = {r.session.rsplit("/", 1)[-1]: r.text for r in transcripts.sessions(turns, 20).collect()}
    assert cut["one"] == "user: hello\nassistant: a  b\nuser: [1, 2]"[:20]


def test_a_fact_of_two_episodes_counts_in_both(spark):
    episodes = spark.createDataFrame([("e1", "a", None, "m", None, 1), ("e2", "b", "s", None, "h", 2), ("e3", "a", None, "m", None, 3), ("e4", None, None, None, None, 4)], "uuid string, agent string, session string, model string, host string, at long")
    facts = spark.createDataFrame([("f1", "p", ["e1", "e2"]), ("f2", "q", ["e1", "e1", None, "gone"]), ("f3", "q", None), ("f4", "p", [])], "uuid string, group_id string, episodes array<string>")
    got = {(r.agent, r.session, r.model, r.host): (r.episodes, r.facts, r.scopes, r.first_write, r.last_write) for r in lineage.written(episodes, facts).collect()}
    assert got == {("a", None, "m", None): (2, 2, ["p", "q"], 1, 3), ("b", "s", None, "h"): (1, 1, ["p"], 2, 2), (None, None, None, None): (1, 0, [], 4, 4)}


def test_proposals_are_carried_out_whole_and_once(spark):
    day = dt.date(2026, 1, 1)
    facts = spark.createDataFrame([(u, "p", u, day, None, None, False) for u in "abcd"] + [("z", "p", "z", day, day, day, False)], "uuid string, group_id string, name string, created_at date, invalid_at date, expired_at date, archived boolean")
    proposed = spark.createDataFrame(
        [
            ("m1", "merge", "OPEN", [], None, "a", "b"),
            ("m2", "merge", "OPEN", [], None, "c", "b"),
            ("m3", "merge", "OPEN", [], None, "gone", "c"),
            ("m4", "merge", "OPEN", [], None, "a", "z"),
            ("m5", "merge", "APPLIED", [], None, "a", "d"),
            ("c1", "contradiction", "OPEN", [], None, "a", "d"),
            ("p1", "promote", "OPEN", ["p", "q"], "cluster_x", None, None),
            ("p2", "promote", "OPEN", ["one", "two", "three"], "global", None, None),
        ],
        "proposal_key string, kind string, status string, scopes array<string>, target string, canonical string, duplicate string",
    )
    decisions = spark.createDataFrame([(k, "apply", {"p1": " a thing is shared ", "p2": "One, two and Three"}.get(k)) for k in ("m1", "m2", "m3", "m4", "m5", "c1", "p1", "p2")], "proposal_key string, action string, statement string")
    known = spark.createDataFrame([], "scope string, statement string")
    now = F.lit(dt.date(2026, 5, 1))
    statuses, made = proposals.apply(proposed, decisions, known, facts, now)
    assert {r.proposal_key: (r.status, r.reason) for r in statuses.collect()} == {
        "m1": ("APPLIED", None), "m2": ("OPEN", "merged already"), "m3": ("OPEN", "fact missing"), "m4": ("OPEN", "fact missing"),
        "c1": ("OPEN", "needs a person"), "p1": ("APPLIED", None), "p2": ("OPEN", "names its projects"),
    }
    after = proposals.carried_out(facts, made)
    assert temporal.lost(facts, after).count() == 0 and after.count() == 6
    changed = {r.uuid: r for r in made.collect()}
    assert changed["b"].merged_into == "a" and changed["b"].archived and len(changed) == 2
    new = next(r for r in changed.values() if r.uuid != "b")
    assert (new.group_id, new.name, new.archived, new.invalid_at) == ("cluster_x", "a thing is shared", False, None)
    assert proposals.apply(proposals.moved(proposed, statuses), decisions, known, after, now)[1].count() == 0


def picked(candidates, existing, cap=7, overlap=0.18):
    stop = set(evaluate.STOPWORDS)
    words = lambda x: {w for w in re.findall(r"[a-z0-9]+", x.lower()) if len(w) > 2 and w not in stop}
    seen, out = [words(x) for x in existing], []
    for pos, line in candidates:
        w = words(line)
        if not w or any(s and len(w & s) / len(w | s) >= overlap for s in seen) or len(out) >= cap:
            continue
        out.append(pos)
        seen.append(w)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_novel_lines_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    say = lambda: " ".join(rng.choice("alpha beta gamma the of, delta; EPSILON zeta eta theta iota kappa x".split()) for _ in range(rng.randrange(0, 9)))
    lines = [(seat, pos, say()) for seat in ("a", "b", "c") for pos in range(40)] + [("a", 99, None)]
    existing = [("a", say()), ("a", ""), ("b", "the of"), ("d", say())]
    got = {}
    for r in retrieve.novel(spark.createDataFrame(lines, "seat string, pos int, line string"), spark.createDataFrame(existing, "seat string, line string")).orderBy("pos").collect():
        got.setdefault(r.seat, []).append(r.pos)
    for seat in ("a", "b", "c"):
        assert got.get(seat, []) == picked([(p, x or "") for s, p, x in lines if s == seat], [x for s, x in existing if s == seat])


def test_all_white_space_is_one_space(spark):
    df = spark.createDataFrame([("a   b　\n\x1fc ",), ("a b c",), (None,)], "t string")
    assert [r[0] for r in df.select(screening.spaced("t")).collect()] == ["a b c", "a b c", None]


def test_writers_are_counted_without_three_rows_of_each_mention(spark):
    episodes = spark.createDataFrame([("e1", "a", None, None, None, 3), ("e1", "a", None, None, None, 1), ("e2", "a", None, None, None, 2), ("e3", "b", "s", None, None, 5)], "uuid string, agent string, session string, model string, host string, at long")
    facts = spark.createDataFrame([("f1", "y", ["e1", "e1", "e2", None]), ("f1", "x", ["e2"]), ("f2", None, ["e2", "gone"]), (None, "z", ["e1"]), ("f3", "x", None)], "uuid string, group_id string, episodes array<string>")
    found = lineage.written(episodes, facts)
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == [("a", None, None, None, 2, 2, ["x", "y", "z"], 1, 3), ("b", "s", None, None, 1, 0, [], 5, 5)]


def shuffled_rows(spark, group, run):
    """Rows that ``run`` writes to shuffles."""
    spark.sparkContext.setJobGroup(group, group)
    run()
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    return sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)


def test_appends_shuffle_nothing_and_compactions_each_row_once(spark):
    rows = versions(spark, [(f"u{i}", f"s{i % 2}", "n", 1, 0) for i in range(1000)])
    facts = FactTable(spark, shared_dir(spark), rows.schema)
    assert shuffled_rows(spark, "append", lambda: facts.append(rows)) == 0
    assert 1000 <= shuffled_rows(spark, "compact", facts.compact) < 1100
    assert facts.read().count() == 1000


def test_few_merges_move_few_facts(spark):
    rows = [(f"u{i}", "p", "n", dt.date(2026, 1, 1), None, None, False) for i in range(3000)]
    facts = saved(spark.createDataFrame(rows, "uuid string, group_id string, name string, created_at date, invalid_at date, expired_at date, archived boolean"))
    proposed = saved(spark.createDataFrame([("m1", "merge", "OPEN", [], None, "u1", "u2"), ("m2", "merge", "OPEN", [], None, "u1", "gone")], "proposal_key string, kind string, status string, scopes array<string>, target string, canonical string, duplicate string"))
    decisions = proposed.select("proposal_key", F.lit("apply").alias("action"), F.lit(None).cast("string").alias("statement"))
    got = []

    def run():
        statuses, made = proposals.apply(proposed, decisions, spark.createDataFrame([], "scope string, statement string"), facts, F.lit(dt.date(2026, 5, 1)))
        got.extend([rows_of(statuses.select("proposal_key", "status")), rows_of(made.select("uuid", "merged_into"))])

    assert shuffled_rows(spark, "merges", run) < 500
    assert got == [[("m1", "APPLIED"), ("m2", "OPEN")], [("u2", "u1")]]


def test_applied_merges_of_many_copies_equal_sql(spark, tmp_path):
    rng, con = random.Random(7), duckdb.connect()
    day = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(rng.randrange(90))
    orders = [(i, rng.randrange(50), day()) for i in range(300)]
    # half of the links lead to one part, so that they are copies; the others are mostly single
    lines = [(rng.randrange(300), n % 7 + 1, rng.choice([1, rng.randrange(10**6)]), n, 1.0, 2.5, 0.1, rng.choice(["R", "N", "A", None]), day()) for n in range(1500)]
    for name, rows, schema in (("orders", orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"), ("lineitem", lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_shipdate timestamp_ntz")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    query, sql = table_queries.PAIRS["applied_merges"]
    wanted = con.sql(f"SELECT group_id, active, merged, lost, again FROM ({sql})").fetchall()
    assert sum(r[2] for r in wanted) > 100
    assert rows_of(query(spark, str(tmp_path))) == sorted(wanted)
