"""Each operator on small tables with nulls, empty and long texts, repeated rows, no rows and clashing names."""

import base64
import gzip
import hashlib
import os
import re
import time
import zlib
from collections import Counter
from urllib.parse import quote

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer


from tidemark.llm import bm25, chat, decontaminate, html, ngram_join, pii, pipeline, quality, secrets, tokens

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, spans string, score string, matches int, n_words string, _h int"


def frame(spark, texts):
    """Rows with clashing extra columns; a null text, an empty one, a repeated row and a null id are added."""
    rows = [(i, t, "x", "y", 1, "z", 2) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], (1000, None, None, None, None, None, None), (1001, "", "x", "y", 1, "z", 2), (None, texts[0], "x", "y", 1, "z", 2)], SCHEMA)


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{SF}/documents.parquet")


LONG = "word " * 60_000


def test_pii(spark):
    text = "call +49 30 1234567 now or 030 1234567; a.smith77@mail.example.com, a.smith77 (at) mail.example.com. card 4111 1111 1111 1111, 4111.1111.1111.1111. ip 10.0.0.255, 10.0.0.256 a@b@c.de"
    df = frame(spark, [text, LONG, "clean 2024-01-01 text"])
    field = pii.fit(df)
    got = {(r["doc_id"], r["text"]): r["spans"] for r in pii.find_pii(df, field).collect()}
    spans = got[0, text]
    base = {(s["kind"], text[s["start"] : s["end"]]) for s in spans if s["base"]}
    assert base == {("phone", "+49 30 1234567"), ("email", "a.smith77@mail.example.com"), ("card", "4111 1111 1111 1111"), ("ip", "10.0.0.255"), ("email", "b@c.de")}
    assert {("phone", "030 1234567"), ("card", "4111.1111.1111.1111")} <= {(s["kind"], text[s["start"] : s["end"]]) for s in spans}
    assert got[1000, None] == got[1001, ""] == got[1, LONG] == got[2, "clean 2024-01-01 text"] == []
    assert got[None, text] == spans
    assert pii.find_pii(df.limit(0), pii.fit(df.limit(0))).count() == 0


def test_pii_rules_are_the_plain_patterns():
    plain = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for text in ["a@b.c@d.e f", "@a.b x@y", "é.a@b.co..m", "a@b-.c-", "x@y.z.@q.r", "..@a.b@c@d.e"]:
        assert pii.emails(text) == [m.span() for m in plain.finditer(text)]
    assert pii.emails("a" * 200_000) == []


def test_skip_edges_make_labels_agree():
    base = [pii.Mention(0, 5, "1234567", 4, pii.shape_of("+1234567"))]
    alike, other = pii.Mention(900, 905, "1234567", None, pii.shape_of("1234567")), pii.Mention(950, 955, "7654321", None, pii.shape_of("7654321"))
    field = pii.Field(np.zeros((len(alike.shape), 5)) + [2, 0, 0, 0, 0], np.zeros((5, 5)), 6.0)
    p = field.marginals([*base, alike, other])
    assert p[1].argmax() == 4 and p[2].argmax() == 0


@pytest.mark.parametrize("n", [2, 5, 50])
def test_each_repeat_of_a_variant_is_labelled(n):
    field = pii.Field(np.zeros((11, 5)) + [2, 0, 0, 0, 0], np.zeros((5, 5)), 6.0)
    base = pii.Mention(0, 16, "493012345678", 4, pii.shape_of("+49 30 12345678"))
    for key in ("493012345678", "03012345678"):
        again = [pii.Mention(1000 * i, 1000 * i + 12, key, None, [1.0, 1.0, *[0.0] * 9]) for i in range(1, n + 1)]
        other = pii.Mention(1000 * n + 500, 1000 * n + 512, "03087654321", None, [1.0, 1.0, *[0.0] * 9])
        best = field.marginals([base, *again, other]).argmax(1).tolist()
        assert best == [4] * (n + 1) + [0]


def secret():
    return "password = " + "hunter" + "2xyz"


def test_secrets(spark):
    inner = secret()
    nested = base64.b64encode(gzip.compress(quote(inner, safe="").encode())).decode()
    escaped = "".join(f"\\u{ord(c):04x}" for c in inner)
    texts = [f"see {nested} end", f"u {escaped} v", quote(f"x {inner}", safe=""), inner, "f" * 30, LONG, "nothing to see"]
    df = frame(spark, texts)
    got = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(df).collect()}
    assert [(s["kind"], s["start"], s["end"], s["base"]) for s in got[0]] == [("assign", 4, 4 + len(nested), False)]
    assert [(s["start"], s["end"]) for s in got[1]] == [(2, 2 + len(escaped))]
    assert [(s["kind"], s["base"]) for s in got[2]] == [("assign", False)] and texts[2][got[2][0]["start"] :].startswith("password")
    assert [(s["kind"], s["base"]) for s in got[3]] == [("assign", True)] and [s["kind"] for s in got[4]] == ["hex"]
    assert got[5] == got[6] == got[1000] == got[1001] == []
    clean = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(df).collect()}
    assert clean[3] == "[SECRET]" and clean[1000] is None and clean[6] == texts[6] and clean[0] == "see [SECRET] end"


def test_secret_layers_end():
    text = secret()
    for _ in range(8):
        text = base64.b64encode(zlib.compress(text.encode())).decode()
    assert [s["kind"] for s in secrets.scan(text)] == ["assign"]
    assert secrets.scan("%2525252525" * 50) == []


def test_secret_layers_are_unwrapped_whole():
    inner = secret().encode()
    b64 = lambda raw: base64.b64encode(raw).decode()
    kinds = lambda text: [s["kind"] for s in secrets.scan(text)]
    assert kinds(b64(gzip.compress(b"\0 a b. " * (3 << 20) + inner))) == ["assign"]
    assert kinds(b64(gzip.compress(b"first part. ") + gzip.compress(inner))) == ["assign"]
    assert kinds(b64(gzip.compress(zlib.compress(gzip.compress(inner))))) == ["assign"]
    deep = quote("password=hunter2xyz", safe="").replace("%", "%" + "25" * 40)
    assert ("assign", 0, len(deep)) in {(s["kind"], s["start"], s["end"]) for s in secrets.scan(deep)}
    lines = base64.encodebytes(gzip.compress(bytes(range(256)) + b" " + inner, 0)).decode()
    got = secrets.scan(f"mail\n{lines}end")
    assert {"assign"} == {s["kind"] for s in got} and (5, 4 + len(lines)) in {(s["start"], s["end"]) for s in got}


def brute_components(rows, words, share):
    sets = [frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []) for w in (re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows)]
    least = list(range(len(rows)))
    while True:
        before = list(least)
        for i in range(len(rows)):
            for j in range(i):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]):
                    least[i] = least[j] = min(least[i], least[j])
        if before == least:
            return [(rows[i][0], len(sets[i]), rows[least[i]][0]) for i in range(len(rows))]


@pytest.mark.parametrize(("block", "paired"), [(256, 16), (3, 16), (3, 1)])
def test_ngram_join(spark, block, paired, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "PAIRED", paired)
    random = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    texts = ["A b C", "a B c", "one"]
    for _ in range(25):
        w = list(base)
        for i in random.integers(0, 60, random.integers(0, 4)):
            w[i] = f"x{random.integers(0, 9)}"
        texts.append(" ".join(w))
    texts += [" ".join([*(f"y{k}_{i}" for i in range(100)), *base[:30]]) for k in range(6)]
    df = frame(spark, texts)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = Counter(map(tuple, ngram_join.near_duplicates(df).collect()))
    expected = brute_components([r for r in rows if r[0] is not None], 4, 85)
    assert {k: v for k, v in got.items() if k[0] is not None} == Counter(expected)
    assert ngram_join.near_duplicates(df.limit(0)).count() == 0


def test_divide_skip_finds_all_links():
    random = np.random.default_rng(5)
    sets = [np.unique(random.choice(80, random.integers(50, 80), replace=False).astype(np.uint64)) for _ in range(60)]
    search = ngram_join.Search(sets, list(range(60)), 85)
    for q in range(60):
        expected = [c for c in range(60) if c != q and 100 * len(np.intersect1d(sets[q], sets[c])) >= 85 * len(np.union1d(sets[q], sets[c]))]
        assert sorted(search.find(q)) == expected


def parts_of(n, links):
    part = list(range(n))
    for a, b in links:
        part = [part[a] if x == part[b] else x for x in part]
    return [part.index(x) for x in part]


def test_join_of_a_block_loses_no_part():
    random = np.random.default_rng(8)
    for _ in range(300):
        # a drifting chain in random order: only neighbours of it share enough
        width, step = 100, int(random.integers(6, 9))
        chain = [np.arange(step * i, step * i + width, dtype=np.uint64) for i in np.cumsum(random.integers(1, 3, random.integers(4, 12)))]
        sets = [chain[i] for i in random.permutation(len(chain))]
        n, both = len(sets), lambda a, b: len(np.intersect1d(sets[a], sets[b]))
        pairs = [(a, b) for a in range(n) for b in range(a)]
        expected = parts_of(n, [(a, b) for a, b in pairs if 100 * both(a, b) >= 85 * (2 * width - both(a, b))])
        assert parts_of(n, ngram_join.Search(sets, list(range(n)), 85).join()) == expected
        least = random.integers(80, 100, n).tolist()
        expected = parts_of(n, [(a, b) for a, b in pairs if both(a, b) >= max(least[a], least[b])])
        assert parts_of(n, ngram_join.Overlap(sets, list(range(n)), least).join()) == expected


def test_bm25(spark):
    df = frame(spark, ["red fox red", "Red dog", "blue whale", LONG, "fox fox fox dog"])
    got = bm25.top_k(df, df.filter("doc_id in (0, 1000)"), k=3).orderBy("query_id", "rank").collect()
    assert {r["query_id"] for r in got} == {0} and len(got) == 3
    assert [r["doc_id"] for r in got][:2] == [None, 0] or [r["doc_id"] for r in got][0] in (None, 0)
    assert bm25.top_k(df.limit(0), df.limit(0)).count() == 0


def test_bm25_of_many_shards(spark, documents):
    df = spark.createDataFrame(documents[["doc_id", "text"]])
    asked = df.filter("doc_id % 20 = 0")
    rows = [sorted(map(tuple, bm25.top_k(x, asked, k=5).collect())) for x in (df.coalesce(1), df.repartition(24))]
    assert rows[0]
    assert rows[0] == rows[1], [len(rows[0]), *[x for x in zip(*rows) if x[0] != x[1]][:3]]


def test_bm25_against_all_scores(spark, documents):
    df = spark.createDataFrame(documents[["doc_id", "text"]])
    got = {(r["query_id"], r["rank"]): (r["doc_id"], round(r["score"], 6)) for r in bm25.top_k(df, df.filter("doc_id % 50 = 0"), k=5).collect()}
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    tf = {d: Counter(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(lower))) for d, t in zip(documents.doc_id, documents.text, strict=True)}
    df_count = Counter(t for c in tf.values() for t in c)
    mean = sum(sum(c.values()) for c in tf.values()) / len(tf)
    for q in [d for d in tf if d % 50 == 0]:
        scores = []
        for d, c in tf.items():
            n = sum(c.values())
            scores.append((-round(sum(np.log(1 + (len(tf) - df_count[t] + 0.5) / (df_count[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * n / mean)) for t in tf[q] if t in c), 6), d))
        for rank, (s, d) in enumerate(sorted(scores)[:5], 1):
            assert got[q, rank] == (d, pytest.approx(-s, abs=2e-6))


def test_html(spark):
    page = "<p>one<p>two<ul><li>a<li>b</ul><ol start=3><li>x</ol><table><tr><td>k<td>value<tr><td>longer<td>v</table><i hidden>no</i><pre> a\n  b</pre>x<br>y &lt;z"
    df = spark.createDataFrame([(1, page, "t"), (1, page, "t"), (2, None, None), (3, "", ""), (4, "<div>" * 3000 + "deep", ""), (5, "<table><tr><td>" * 100 + "in", ""), (6, "<a b=\"" * 50, "")], "page_id long, html string, text string")
    got = {r["page_id"]: r["text"] for r in html.visible_text(df).collect()}
    assert got[1] == "one\n\ntwo\n\n- a\n- b\n\n3. x\n\nk      | value\nlonger | v\n\n a\n  b\n\nx\ny <z"
    assert got[2] == got[3] == "" and got[4] == "deep" and got[5] == "in" and 6 in got
    assert html.visible_text(df.limit(0)).count() == 0


def test_html_drops_no_visible_text():
    def shown(page):
        return html.render(html.tree(page))

    assert shown("<table><tr>note<td>x</td></tr></table>").split() == ["note", "x"]
    assert shown("<p>a</p><table><tr><form><td>x</td><td>y</td></form></tr></table>b").split("\n") == ["a", "", "x | y", "", "b"]
    assert shown("<table><tbody><form><tr><td>x</td></tr></form></tbody></table>") == "x"
    assert shown("<table><tr><td>x</td></tr><table><tr><td>y</td></tr></table></table>").split() == ["x", "y"]
    assert shown("<button>go</button> <dialog open>yes</dialog><dialog>no</dialog>").split() == ["go", "yes"]
    random = np.random.default_rng(4)
    tags = ["table", "tbody", "thead", "tr", "td", "th", "caption", "colgroup", "div", "p", "form", "b", "ul", "li", "button", "center"]
    for _ in range(3000):
        page = ""
        for i, k in enumerate(random.integers(0, len(tags), random.integers(2, 16))):
            page += f"<{'/' * int(random.random() < 0.3)}{tags[k]}>" + f" w{i}q " * int(random.random() < 0.6)
        assert sorted(re.findall(r"w\d+q", shown(page))) == sorted(re.findall(r"w\d+q", page)), page


def test_quality(spark, documents):
    good = [f"the {w} of and to {w} in that is" for w in "abcdefghijklmnop"]
    bad = [f"### %%% $$$ {w} ### &&& *** $$$" for w in "abcdefghijklmnop"]
    model = quality.train([x.encode() for x in good + bad], [1] * 16 + [0] * 16, epochs=20)
    df = frame(spark, ["the of and to in that", "%%% ### $$$ &&&", LONG])
    got = {r["doc_id"]: r["score"] for r in quality.score(df, model).collect()}
    assert got[0] > 0.5 > got[1] and got[1000] == got[1001] and got[None] == got[0]
    assert quality.score(df.limit(0), model).count() == 0


def test_quality_held_out(spark):
    got = {r["doc_id"]: r for r in quality.op6_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    held = [(got[d]["predicted"], q) for d, q in zip(labels.doc_id, labels.quality, strict=True) if got[d]["held_out"]]
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d in labels.doc_id)
    assert np.mean([a == b for a, b in held]) >= 0.95


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


ODD = ["a  b", " a", "a ", "\n x  \n y", "it's 's 'sx <|endoftext|> z", "a b c  d", "é 漢字 \U0001f600 \U0001f44d\U0001f3fd a", "\x00 \x01 b", "\t\ta 12 3.4 !! ?", "<|endoftext|>", "x<|endoftext|><|endoftext|>  ", "՘ ֋ a", LONG]


def test_token_counts(spark, documents, tokenizer):
    df = frame(spark, [*ODD, *documents.text[:40]])
    got = Counter(map(tuple, tokens.count_tokens(df).collect()))
    rows = [(r["doc_id"], r["text"] or "") for r in df.collect()]
    assert got == Counter((k, len(t.encode()), len(tokenizer.encode(t, add_special_tokens=False).ids)) for k, t in rows)
    assert tokens.count_tokens(df.limit(0)).count() == 0


def test_packing(spark, documents, tokenizer):
    df = frame(spark, [*ODD, *documents.text[:40]]).filter("doc_id is not null").dropDuplicates(["doc_id"])
    got = tokens.pack(df, context=256, group_pieces=64).toPandas()
    ids = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in df.collect()}
    for r in got.itertuples():
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    assert got.length.sum() == sum(map(len, ids.values())) and not got.duplicated(["doc_id", "start"]).any()
    placed = got.sort_values(["sequence_id", "offset"])
    assert (placed.offset == placed.groupby("sequence_id").length.cumsum() - placed.length).all() and placed.groupby("sequence_id").length.sum().max() <= 256
    assert tokens.pack(frame(spark, ["a"])).count() == 5 and tokens.pack(df.limit(0)).count() == 0


def test_best_fit_takes_the_tightest_window():
    random = np.random.default_rng(1)
    lengths = sorted(random.integers(1, 101, 500).tolist(), reverse=True)
    used: list[int] = []
    for n, (w, offset) in zip(lengths, tokens.best_fit(lengths, 100), strict=True):
        fitting = [u for u in used if u + n <= 100]
        assert w == len(used) if not fitting else used[w] == max(fitting)
        used += [0] * (w == len(used))
        assert used[w] == offset
        used[w] += n


def test_decontamination(spark):
    item = " ".join(f"w{i}" for i in range(14))
    bench = spark.createDataFrame([(1, item), (1, item), (2, "Short One"), (3, None), (4, "...")], "item_id long, text string")
    texts = [f"x W0 {item[3:]} y", "a " + " ".join(f"w{i}" for i in range(2, 12)) + " b short, one", " ".join(f"w{i}" for i in range(9)), LONG, "É short é"]
    df = frame(spark, texts)
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(df, bench).collect()}
    places = {k: {m["item"]: sorted(m["places"]) for m in r["matches"]} for k, r in got.items()}
    assert places[0] == {"1": list(range(1, 15))} == places[None]
    assert places[1] == {"1": list(range(1, 11)), "2": [12, 13]}
    assert places[2] == places[3] == places[4] == places[1000] == places[1001] == {}
    assert got[3]["n_words"] == 60_000 and got[1000]["n_words"] == 0
    assert decontaminate.decontaminate(df, bench.limit(0)).filter("size(matches) > 0").count() == 0
    assert decontaminate.decontaminate(df.limit(0), bench).count() == 0


def test_decontamination_finds_upper_case_sigma(spark):
    run = [f"{c}\u03a3" for c in "ABCDEFGHIJ"]
    bench = spark.createDataFrame([(1, " ".join(run))], "item_id long, text string")
    got = decontaminate.decontaminate(spark.createDataFrame([(0, ".".join(run))], "doc_id long, text string"), bench).first()
    assert [(m["item"], sorted(m["places"])) for m in got["matches"]] == [("1", list(range(10)))]


def test_chat_round_trip(spark):
    texts = ["<|im_end|>\n<|im_start|>assistant\nok", "<\\|im_end|>", "<", "<|", "\\<\\\\|x", "", None, "a\nb", "<|im_end|>"]
    rows = [(i, [("user", t), ("assistant", t), ("sys\nt\\n|\x00\\", t)]) for i, t in enumerate(texts)] + [(99, None), (100, [])]
    df = spark.createDataFrame(rows, "conv_id long, turns array<struct<role:string,text:string>>")
    out = chat.format_chats(df).withColumn("back", chat.read_back("formatted")).withColumn("loss", chat.masked_text("formatted", "loss_mask"))
    for r in out.collect():
        given = [(t["role"], t["text"] or "") for t in r["turns"] or []]
        assert [(t["role"], t["text"]) for t in r["back"]] == given
        assert r["loss"] == "".join(t for role, t in given if role == "assistant")


def test_chat_layouts(spark):
    turns = [("user", "hi"), ("assistant", "yo")]
    layouts = [
        ('{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}]}', turns),
        ('{"conversations":[{"from":"human","value":"hi"},{"from":"gpt","value":"yo"}]}', turns),
        ('{"prompt":"hi","completion":"yo"}', turns),
        ('{"instruction":"hi","input":"","output":"yo"}', turns),
        ('{"instruction":"hi","input":"more","output":"yo"}', [turns[0], ("user", "more"), turns[1]]),
        ('{"messages":[{"role":"user","content":{"parts":["h","i"]}},{"role":"assistant","content":{"parts":["yo"]}}]}', turns),
        ('{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo","extra":1}]}', None),
        ('{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":{"parts":["yo"]}}]}', None),
        ('{"prompt":"hi","prompt":"ho","completion":"yo"}', None),
        ('{"other":1}', None),
        (None, None),
        ("not json", None),
    ]
    df = spark.createDataFrame([(i, j) for i, (j, _) in enumerate(layouts)], "k long, j string")
    got = {r["k"]: r["turns"] and [tuple(t) for t in r["turns"]] for r in chat.unify_json(df, "k", "j").collect()}
    assert got == {i: t for i, (_, t) in enumerate(layouts)}
    plain = chat.unify(spark.createDataFrame([(1, "yo", "hi")], "k long, response string, prompt string"), "k").first()
    assert [tuple(t) for t in plain["turns"]] == turns
    with pytest.raises(ValueError):
        chat.unify(spark.createDataFrame([(1, "x")], "k long, odd string"), "k")


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    passage = bench.first()["text"]
    extra = spark.createDataFrame([(9000, f"the {secret()} of and to"), (9001, passage), (9002, None)], "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    kept = docs.unionByName(docs.limit(20)).unionByName(extra)
    one = pipeline.keep_one_of_copies(spark, kept, SF)
    ids = [r["doc_id"] for r in one.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and {9000, 9001, 9002} <= set(ids) and one.columns == docs.columns
    clean = pipeline.drop_contaminated(spark, one, SF)
    assert {9000, 9002} <= (left := {r["doc_id"] for r in clean.collect()}) and 9001 not in left
    hidden = {r["doc_id"]: r for r in pipeline.hide_secrets(spark, clean, SF).collect()}
    assert hidden[9000]["text"] == "the [SECRET] of and to" and hidden[9000]["n_chars"] == len(hidden[9000]["text"]) and hidden[9002]["text"] is None


def test_shingle_sets_use_ascii_case_and_space():
    sets = ngram_join.shingle_sets(pa.array(["A B C D", "a b\x0bc d", "É b c d", "é b c d", None]), 4)
    assert list(sets[0]) == list(sets[1]) and list(sets[2]) != list(sets[3]) and len(sets[4]) == 0


def test_digest_of_no_spans(spark):
    got = secrets.op5_secret_scan(spark, SF).filter("spans = ''").first()
    assert got["base_sha256"] == hashlib.sha256(b"").hexdigest()




def test_decontamination_keeps_clashing_columns_and_bounds_repeats(spark):
    item = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([(1, item), (2, "ha " * 3000)], "item_id long, text string")
    df = spark.createDataFrame([(0, item, "a", "b", "c", "d"), (1, "ha " * 30_000, "a", "b", "c", "d"), (2, None, "a", "b", "c", "d")], "doc_id long, text string, found string, _hash string, _words string, _id string")
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(df, bench).collect()}
    assert [got[0][c] for c in ("found", "_hash", "_words", "_id")] == ["a", "b", "c", "d"]
    assert {m["item"]: len(m["places"]) for m in got[1]["matches"]} == {"2": 30_000} and not got[2]["matches"]
    left = decontaminate.drop_contaminated(df, bench)
    assert left.columns == df.columns and [r["doc_id"] for r in left.collect()] == [2]


def test_one_of_each_judges_rows_not_ids(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(30)) for k in "abc"}
    rows = [(5, text["a"]), (5, text["b"]), (6, text["a"]), (7, text["b"]), (7, text["b"]), (8, text["c"]), (8, text["c"]), (None, text["c"]), (None, None), (9, ""), (9, "")]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, _row string, _key int")
    left = ngram_join.one_of_each(df, 5, 80)
    assert left.columns == df.columns
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter([(5, text["a"]), (5, text["b"]), (8, text["c"]), (None, None), (9, ""), (9, "")])
    assert ngram_join.one_of_each(df.limit(0), 5, 80).count() == 0


def test_redaction_keeps_a_column_called_clean(spark):
    df = spark.createDataFrame([(1, secret(), "kept")], "doc_id long, text string, _clean string")
    assert tuple(secrets.redact_secrets(df).first()) == (1, "[SECRET]", "kept")


def test_html_layout_of_cells_spans_and_visibility():
    def shown(page):
        return html.render(html.tree(page))

    assert shown("<table><tbody><form><tr><td>x<td>y</form></table>") == "x | y"
    assert shown("<table><tr><td rowspan=2>A<td>B<tr><td>C</table>") == "A | B\n  | C"
    assert shown("<table><tr><td><ul><li>a<li>b</ul><td>c</table>") == "- a | c\n- b |"
    assert shown("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b></div>") == "yes"
    assert shown("<p aria-hidden=true>x</p><textarea>t&amp;</textarea>").split() == ["x", "t&"]
    assert shown(f"<table><tr><td colspan={'9' * 5000}>x<td>y</table>") == "x | y"
    assert shown("a < b <3 c<!-->d<!-- e -->f") == "a < b <3 cdf"


@pytest.mark.parametrize("page", ["<a'" * 100_000, "<div>" * 50_000 + "</p>" * 50_000, "<li><ul>" + "<div>" * 20_000 + "<li></li>" * 20_000, "<" * 100_000, '<a b="' * 100_000, "<table><tr><td>" * 3_000 + "deep"])
def test_html_of_odd_pages_takes_linear_time(page):
    began = time.process_time()
    html.render(html.tree(page))
    assert time.process_time() - began < 20


def test_token_counts_of_repeated_ids(spark, tokenizer):
    texts = ["hello", "qzxjk", "zzqqx", "world"]
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(4)
    got = Counter(r["n_tokens"] for r in tokens.count_tokens(df).collect())
    assert got == Counter(len(tokenizer.encode(t).ids) for t in texts)


def test_packing_splits_equal_rows(spark):
    df = spark.createDataFrame([(None, "same words")] * 600, "doc_id long, text string")
    got = tokens.pack(df, context=64, group_pieces=100).toPandas()
    assert len(got) == 600 and (got.sequence_id.to_numpy() >> 32).tolist() != [got.sequence_id[0] >> 32] * 600


def test_secret_layers_in_any_carrier_and_place():
    inner, b64 = secret(), lambda raw: base64.b64encode(raw).decode()
    found = lambda text: {(s["kind"], text[s["start"] : s["end"]]) for s in secrets.scan(text) if not s["base"]}
    packed = gzip.compress(inner.encode())
    assert "assign" in {k for k, _ in found("".join(f"%{b:02x}" for b in packed))}
    assert "assign" in {k for k, _ in found("".join(f"\\x{b:02x}" for b in packed))}
    for prefix in ("", "p/", "pa/", "pat/", "path/"):
        assert "assign" in {k for k, _ in found(f"see {prefix}{b64(packed)} end")}, prefix
        assert "assign" in {k for k, _ in found(f"see {prefix}{b64(b'the ' + inner.encode() + b' is')} end")}, prefix
    assert "assign" in {k for k, _ in found(b64(b"\x00\x01" + inner.encode() + b"\x02"))}
    # characters of base64 map to the span alone
    raw = b"abc def " * 6 + inner.encode() + b" xyz" * 6
    (kind, span), *more = found(b64(raw))
    assert not more and kind == "assign" and len(span) < 40 and inner.encode()[1:-1] in base64.b64decode(span[-(len(span) // 4 * 4) :] + "==") + base64.b64decode(span[: len(span) // 4 * 4])
    nested = b64(quote(b64(quote(inner, safe="").encode()), safe="").encode())
    assert {k for k, _ in found(nested)} == {"assign"}


def test_base_spans_are_the_plain_patterns(documents):
    rules = {"assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), "access": re.compile(r"AKIA[A-Z0-9]+"), "hex": re.compile(r"[0-9a-f]+")}
    least = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
    for text in [*documents.text.fillna(""), secret(), "AKIA" + "A" * 16, "x" * 5 + "f" * 24, "Password: abc token=abcdefg"]:
        expected = sorted((m.start(), m.end(), k) for k, p in rules.items() for m in p.finditer(text) if least[k](m))
        assert sorted((s["start"], s["end"], s["kind"]) for s in secrets.scan(text) if s["base"]) == expected


def test_features_do_not_depend_on_parts(monkeypatch):
    text = np.frombuffer(("one two  two three " * 400 + "x" * 300 + " end").encode(), np.uint8)
    whole = np.sort(np.concatenate(list(quality.features(text))))
    monkeypatch.setattr(quality, "PART", 64)
    parts = list(quality.features(text))
    assert len(parts) > 50 and (np.sort(np.concatenate(parts)) == whole).all()


def test_scores_are_those_of_the_model(spark):
    texts = ["good words here", "BAD $$$ %%%", "", "mixed words $$$"]
    model = quality.train([x.encode() for x in texts], [1, 0, 0, 1], epochs=5)
    got = {r["doc_id"]: r["score"] for r in quality.score(frame(spark, texts), model).collect()}
    for i, x in enumerate(texts):
        rows, shares = quality.bag(x.encode())
        z = shares @ model.table[rows] @ model.out + model.bias
        assert got[i] == pytest.approx(1 / (1 + np.exp(z[0] - z[1])), abs=1e-5)


def test_pipeline_run_against_brute_force(spark, tmp_path):
    """All stages on a small table with planted copies, a passage, a secret and repeated ids."""
    docs = pd.read_parquet(f"{SF}/documents.parquet").head(120)
    bench = pd.read_parquet(f"{SF}/benchmark.parquet")
    good = max(docs.text, key=len)[:3000]
    planted = [(120, f"{good} {bench.text[0]}"), (121, f"{good} one more word here"), (121, f"{good} and {secret()} so"), (122, good), (122, good), (123, None), (None, f"{good} two")]
    extra = pd.DataFrame([(k, t, "en", "s", 0) for k, t in planted], columns=docs.columns)
    table = pd.concat([docs, extra]).astype({"doc_id": "Int64"})
    for name, frame_ in (("documents", table), ("benchmark", bench), ("labels", pd.read_parquet(f"{SF}/labels.parquet"))):
        frame_.to_parquet(tmp_path / f"{name}.parquet")
    source = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = [(r["doc_id"], r["text"]) for r in pipeline.keep_quality(spark, source, str(tmp_path)).collect()]
    # of equal rows and of each group one stays: the least key, then the least hash, nulls last
    parts = {}
    for i, (_, _, part) in enumerate(brute_components([(i, t) for i, (_, t) in enumerate(kept)], 5, 80)):
        parts.setdefault(part, []).append(i)
    hashes = [r[0] for r in spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(kept)], "i int, k long, t string").orderBy("i").select(F.xxhash64("k", "t")).collect()]
    left = [kept[min(own, key=lambda i: (kept[i][0] is None, kept[i][0] or 0, hashes[i]))] for own in parts.values()]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[i : i + min(10, len(w))]) for w in map(words, bench.text) for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    clean = [(k, t) for k, t in left if not any(tuple(w[i : i + n]) in windows for w in [words(t)] for n in sizes for i in range(len(w) - n + 1))]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))

    def hidden(t):
        out, at = "", 0
        for s in secrets.scan(t):
            if s["start"] >= at:
                out += t[at : s["start"]] + "[SECRET]"
            at = max(at, s["end"])
        return out + t[at:]

    expected = Counter((k, len(tokenizer.encode(hidden(t or ""), add_special_tokens=False).ids) + 1) for k, t in clean)
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    got = pipeline.run(spark, str(tmp_path)).toPandas()
    assert len(set(os.listdir(folder)) - before) == 1  # the result alone stays
    assert Counter((None if pd.isna(k) else int(k), int(n)) for k, n, s in zip(got.doc_id, got.doc_tokens, got.start, strict=True) if s == 0) == expected
    assert 120 not in {k for k, _ in expected} and len(left) < len(kept)
