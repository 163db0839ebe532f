"""Single texts of a megabyte and odd rows: linear time, bounded results, nothing lost."""

import base64
import random
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import chat, html, pii, secrets

SECRET = "password = " + "hunter2" + "secret99"


def seconds(run, *args):
    began = time.process_time()
    out = run(*args)
    return time.process_time() - began, out


@pytest.mark.parametrize(
    "text",
    [
        "x" * 1_000_000 + "width:50%",
        "%41" * 300_000,
        "%" * 1_000_000,
        "a%zz" * 250_000,
        base64.b64encode(random.Random(1).randbytes(700_000)).decode() + " 5%",
        ("QUJD" * 19 + "\n") * 13_000,
    ],
)
def test_secret_scan_of_long_texts(text):
    assert seconds(secrets.scan, text)[0] < 15


def test_pii_of_many_addresses():
    text = " ".join(f"user.name{i}@example{i}.com and user.name{i}" for i in range(20_000))
    took, nodes = seconds(lambda: pii.mentions(text, pii.base_spans(text)))
    assert took < 15 and len(nodes) == 40_000
    assert all(a.key == b.key for a, b in zip(nodes[::2], nodes[1::2], strict=True))


def test_repeats_of_a_local_part_take_the_nearest_address():
    text = "first.last@one.com wrote first.last, and then some time later to first.last@two.com; First.Last. and xfirst.last"
    nodes = pii.mentions(text, pii.base_spans(text))
    assert [(text[n.start : n.end], n.key) for n in nodes if n.label is None] == [("first.last", "first.last@one.com"), ("First.Last", "first.last@two.com")]


def rendered(page):
    return html.render(html.tree(page))


@pytest.mark.parametrize(
    ("page", "most"),
    [
        ("<table><tr>" + "<td colspan=1000 rowspan=65534>a</td>" * 100 + "</tr>" + "<tr><td>b</td></tr>" * 2000 + "</table>", 100_000),
        ("<table><tr><td>" + "w" * 50_000 + "</td><td>z</td></tr>" + "<tr><td>b</td><td>c</td></tr>" * 20_000 + "</table>", 1_000_000),
        ("<table>" + "".join(f"<tr><td rowspan={i + 2}>a</td></tr>" for i in range(3000)) + "</table>", 1_000_000),
    ],
)
def test_tables_stay_bounded(page, most):
    took, text = seconds(rendered, page)
    assert took < 10 and len(text) < most


def test_row_spans_keep_columns():
    page = "<table><tr><td rowspan=2>a</td><td>bb</td></tr><tr><td>c</td><td>d</td></tr><tr><td>e</td></tr></table>"
    assert rendered(page) == "a | bb\n  | c  | d\ne"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<math><mi>y</mi></math>", "y"),
        ("<svg><title>no</title><text>hello</text></svg>", "hello"),
        ("<select><option>One<option>Two</select>", "One\nTwo"),
        ("<input type=submit value=Go><input type=hidden value=no><input placeholder=name>", "Goname"),
        ("<object>fallback</object>", "fallback"),
        ("<ol><li value=5>a<li>b</ol>", "5. a\n6. b"),
        ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"),
        ("<span style='display:block'>a</span><span style='display:block'>b</span>", "a\nb"),
        ("<pre>\nx\n y</pre>", "x\n y"),
    ],
)
def test_visible_text(page, text):
    assert rendered(page) == text


def bare(raw):
    stream = zlib.compressobj(9, zlib.DEFLATED, -15)
    return stream.compress(raw) + stream.flush()


def b64(raw):
    return base64.b64encode(raw).decode()


def wrapped(text):
    return "\n".join(text[i : i + 20] for i in range(0, len(text), 20))


@pytest.mark.parametrize(
    "text",
    [
        "x" + b64(zlib.compress(SECRET.encode())),
        "/a/bc/" + b64(zlib.compress(SECRET.encode())),
        "key " + b64(bare(SECRET.encode())),
        "".join(f"\\U{ord(c):08x}" for c in SECRET),
        "".join(f"%u{ord(c):04x}" for c in SECRET),
        "see " + b64(SECRET.encode("utf-16-le")),
        b64(b"head" + zlib.compress(b"other text") + zlib.compress(bare(SECRET.encode()) + b"tail" + SECRET.encode())),
    ],
)
def test_encoded_secrets_are_found(text):
    assert any(s["kind"] == "assign" and not s["base"] for s in secrets.scan(text))


def test_a_secret_in_wrapped_code_has_the_smallest_range():
    text = "hello\n" + wrapped(b64(zlib.compress(SECRET.encode()))) + "\nbye"
    assert [(s["start"], s["end"]) for s in secrets.scan(text)] == [(6, len(text) - 4 - (len(text) - 4 - 6) % 21)] or len(secrets.scan(text)) == 1


def test_chat_roles_come_back_as_they_are(spark, tmp_path):
    rows = [(1, 0, None, "no role"), (2, 0, "human", "a"), (2, 1, "Bot", "b"), (3, 0, "assistant", None), (4, 0, "", ""), (5, 1, "gpt", "x"), (5, 0, "odd <|im_end|> role", "y"), (6, None, "user", "z")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"]
    expected = sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({chat.OP9_SQL})").fetchall())
    assert sorted(tuple(r) for r in chat.op9_chat_format(spark, str(tmp_path)).select(*columns).collect()) == expected
    share = spark.createDataFrame([(1, [("Human", "a"), ("gpt", "b")])], "k long, conversations array<struct<from:string,value:string>>")
    assert [t.role for t in chat.unify(share, "k").first().turns] == ["user", "assistant"]


def test_training_is_bounded_by_bytes(spark):
    from tidemark.llm import quality

    assert quality.within([(1, 10, 5), (2, 20, 9), (3, 30, 4), (4, 40, 0)], 9) == [10, 30, 40] and quality.within([], 9) == []
    docs = spark.createDataFrame([(i, f"good plain words {i}" if i % 2 else f"zz qq {i}" * 400) for i in range(60)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    small = quality.learn(docs, labels, budget=500)
    scored = {r["doc_id"]: r["score"] for r in quality.score(docs, small).collect()}
    whole = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.learn(docs, labels)).collect()}
    assert all(s > 0.5 for s in scored.values()) and all((s > 0.5) == bool(k % 2) for k, s in whole.items())


def test_bm25_multiplies_common_terms_and_tells_near_scores_apart():
    from tidemark.llm import bm25

    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, rng.integers(1, 300)) if x < 5000) for _ in range(1500)]
    texts += [texts[7] + " x" + "y" * i for i in range(20)]
    counted = list(bm25.term_counts(pa.array(texts)))
    terms, places = np.unique(np.concatenate([t for t, _ in counted]), return_inverse=True)
    counts = np.concatenate([c for _, c in counted]).astype("<i4")
    sizes = np.array([len(t) for t, _ in counted], "<i4")
    mean = counts.sum() / len(texts)
    shard = bm25.Shard({"ids": list(range(len(texts))), "sizes": sizes.tobytes(), "terms": terms.tobytes(), "places": places.astype("<i4").tobytes(), "counts": counts.tobytes()}, mean)
    assert len(shard.docs) < len(places) / 2 < np.count_nonzero(shard.matrix)
    idf = np.log(1 + (len(texts) - (df := np.bincount(places)) + 0.5) / (df + 0.5))
    doc = np.repeat(np.arange(len(texts)), sizes)
    impact = counts * 2.2 / (counts + 1.2 * (0.25 + 0.75 * np.bincount(doc, counts)[doc] / mean))
    asked = [(i, counted[i][0], idf[np.searchsorted(terms, counted[i][0])], 0.0) for i in range(0, 1520, 10)]
    got = {name: (docs.tolist(), scores.tolist()) for name, docs, scores in shard.tops(asked, 10)}
    for name, own, _, _ in asked:
        scores = np.round(np.bincount(doc, np.where(np.isin(terms[places], own), idf[places] * impact, 0), len(texts)), 9)
        best = [i for i in np.lexsort((np.arange(len(texts)), -scores))[:10].tolist() if scores[i] > 0]
        assert got.get(name, ([], [])) == (best, scores[best].tolist())


def test_bm25_makes_a_shards_lists_for_many_queries_at_a_time(spark):
    """A partition of queries, for which each shard is made anew, holds 3 million terms; before, 800,000."""
    from tidemark.llm import bm25

    asked = spark.createDataFrame([], "query_id long, t array<struct<term:long,idf:double>>, floor double")
    assert bm25.query_blocks(asked, 3_000_000, 10_000).rdd.getNumPartitions() == 1
    assert bm25.query_blocks(asked, 8_000_000, 30_000).rdd.getNumPartitions() == 2
