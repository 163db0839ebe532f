"""Personal data: base rules, and a skip-chain conditional random field that adds mentions consistent with them."""

from __future__ import annotations

import re
import zlib
from bisect import bisect
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ARROW_SPANS, SPANS, map_texts, read, span_report

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Documents (the smallest hashes of their ids) from which the field's weights are learned.
SAMPLE_DOCS = 4000
#: Mentions that it takes from one of them at most.
SAMPLE_MENTIONS = 200
#: Prior mean and deviation of the skip weight (log odds that equal mentions share a label).
SKIP_PRIOR, SKIP_SD = 4.5, 1.0
#: Share of the weak labels that is spread over all labels, so that no unary potential is decisive alone.
SMOOTHING = 0.2
#: Chain log potentials stay within this: neighbours hint, they don't decide.
CHAIN_LIMIT = 0.4
ROUNDS, DAMPING, TOLERANCE = 1000, 0.3, 1e-4
#: Consecutive mentions further apart than this many characters have no chain edge.
NEAR = 80

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NUMBER = re.compile(r"\+?\(?[0-9](?:[ ()._/-]{0,2}[0-9]){6,}")
SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]+)\s?[\[({<]?\s?(?:at|AT)\s?[\])}>]?\s([A-Za-z0-9-]+(?:(?:\.|\s?[\[({<]?\s?(?:dot|DOT)\s?[\])}>]?\s)[A-Za-z0-9-]+)+)")

MENTIONS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("key", T.StringType()), T.StructField("label", T.IntegerType()), T.StructField("shape", T.ArrayType(T.DoubleType()))]))
ARROW_MENTIONS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("key", pa.string()), ("label", pa.int32()), ("shape", pa.list_(pa.float64()))]))


def digits(x: str) -> str:
    return "".join(DIGIT.findall(x))


def luhn(x: str) -> bool:
    total = sum(map(int, x[-1::-2])) + sum(sum(divmod(2 * int(c), 10)) for c in x[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the address rule, found from each ``@`` so that long runs cost no more than their length."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > done and text[s - 1] in LOCAL:
            s -= 1
        if s < at and (m := DOMAIN.match(text, at + 1)):
            out.append((s, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The plain rules: leftmost, not overlapping within a kind; matches that fail a test are dropped."""
    found = [("email", *x) for x in emails(text)]
    if DIGIT.search(text):
        found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
        found += [("card", *m.span()) for m in CARD.finditer(text) if 12 <= len(d := digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return found


#: A run of the characters of local parts; one may end in it before a dot.
LOCAL_RUN, DOT = re.compile(r"[\w.@%+-]+"), re.compile(r"\.")


class Mention:
    """A node of the field. key: equal for mentions of the same thing; label: None, or the base rule's."""

    __slots__ = ("start", "end", "key", "label", "shape")

    def __init__(self, start: int, end: int, key: str, label: int | None, shape: list[float]):
        self.start, self.end, self.key, self.label, self.shape = start, end, key, label, shape


def shape_of(x: str) -> list[float]:
    """Features of a mention: length in digits by bucket, separators, check sum."""
    d = digits(x)
    n = len(d)
    return [1.0, float("@" in x), float(n == 0), float(7 <= n <= 8), float(9 <= n <= 11), float(12 <= n <= 15), float(16 <= n <= 19), float(n > 19), float(x[:1] == "+"), float(x.count(".") == 3), float(12 <= n <= 19 and luhn(d))]


def mentions(text: str, base: list[tuple[str, int, int]]) -> list[Mention]:
    """The nodes of a document: its base spans, other long numbers, and spelt-out or repeated parts of its addresses.

    Tokens that are none of these can't share a potential with a base span; they are held at ``none`` and cut
    the chain, so they need no node.
    """
    out, taken = [], sorted((s, e) for _, s, e in base)
    for kind, s, e in base:
        x = text[s:e]
        out.append(Mention(s, e, x.lower() if kind == "email" else x if kind == "ip" else digits(x), LABELS.index(kind), shape_of(x)))
    starts = np.array([s for s, _ in taken])
    highest = np.maximum.accumulate([e for _, e in taken]) if taken else []

    def free(s: int, e: int) -> bool:
        i = int(np.searchsorted(starts, e)) - 1
        return i < 0 or highest[i] <= s

    for m in NUMBER.finditer(text):
        if free(*m.span()):
            x = m[0]
            dotted = re.sub(r"[ ()_-]+", ".", x).strip(".+")
            out.append(Mention(*m.span(), dotted if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", dotted) else digits(x), None, shape_of(x)))
    known = {text[s:e].lower() for k, s, e in base if k == "email"}
    if known:
        for m in SPELT.finditer(text):
            domain = re.sub(r"\s?[\[({<]?\s?(?:dot|DOT)\s?[\])}>]?\s", ".", m[2])
            if (key := f"{m[1]}@{domain}".lower()) in known and free(*m.span()):
                out.append(Mention(*m.span(), key, None, shape_of("x")))
        # local parts of the addresses where they stand alone: one pass over the runs of their characters
        places: dict[str, list[tuple[int, str]]] = {}
        for k, s, e in sorted(base, key=lambda x: x[1]):
            if k == "email" and len(name := (key := text[s:e].lower()).partition("@")[0]) >= 6:
                places.setdefault(name, []).append((s, key))
        sizes = {*map(len, places)}
        for m in LOCAL_RUN.finditer(text) if places else ():
            s, e = m.span()
            ends = [x for x in (*(d.start() for d in DOT.finditer(text, s, e)), e) if x - s in sizes]
            for end in ends:
                if (near := places.get(text[s:end].lower())) and free(s, end):
                    at = bisect(near, (s, ""))
                    out.append(Mention(s, end, min(near[max(at - 1, 0) : at + 1], key=lambda x: abs(x[0] - s))[1], None, shape_of("x")))
    return sorted(out, key=lambda x: (x.start, x.end))


def similar(nodes: list[Mention]) -> list[tuple[int, int]]:
    """Skip edges: each mention to the next one with its key, or with a number that ends in the same 8 digits.

    A mention without a label is also linked to the nearest base mention of its key, or else of its 8 digits: one
    edge each, so that the support of a base span doesn't fade along the chain of its repeats.
    """
    last: dict[str, int] = {}
    tails: dict[str, int] = {}
    edges = []
    for i, x in enumerate(nodes):
        if x.key in last:
            edges.append((last[x.key], i))
        last[x.key] = i
        if x.key.isdigit() and len(x.key) >= 8:
            j = tails.get(x.key[-8:])
            if j is not None and nodes[j].key != x.key and max(len(nodes[j].key), len(x.key)) < 16:
                edges.append((j, i))
            tails[x.key[-8:]] = i
    base: dict[str, list[int]] = {}
    for i, x in enumerate(nodes):
        if x.label is not None:
            base.setdefault(x.key, []).append(i)
            if x.key.isdigit() and 8 <= len(x.key) < 16:
                base.setdefault(f"*{x.key[-8:]}", []).append(i)
    known = set(edges)
    for i, x in enumerate(nodes):
        if x.label is None:
            near = base.get(x.key) or (base.get(f"*{x.key[-8:]}") if x.key.isdigit() and 8 <= len(x.key) < 16 else None)
            if near:
                at = bisect(near, i)
                j = min(near[max(at - 1, 0) : at + 1], key=lambda k: abs(nodes[k].start - x.start))
                if (edge := (min(i, j), max(i, j))) not in known:
                    edges.append(edge)
    return edges


class Field:
    """Weights: ``unary`` (features x labels), ``chain`` (labels x labels), ``skip``."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: float):
        self.unary, self.chain, self.skip = unary, chain, skip

    def marginals(self, nodes: list[Mention]) -> np.ndarray:
        """Loopy sum-product over chain and skip edges; base mentions are held at their labels."""
        k = len(LABELS)
        log = np.array([x.shape for x in nodes]) @ self.unary
        for i, x in enumerate(nodes):
            if x.label is not None:
                log[i] = -1e6  # no number of mentions may outweigh a base rule
                log[i, x.label] = 0.0
        near = [(i, i + 1) for i, (a, b) in enumerate(pairwise(nodes)) if b.start - a.end <= NEAR]
        skips = similar(nodes)
        edges = np.array(near + skips, int).reshape(-1, 2)
        if len(edges):
            pair = np.concatenate([np.broadcast_to(self.chain, (len(near), k, k)), np.broadcast_to(self.skip * np.eye(k), (len(skips), k, k))])
            source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
            table = np.exp(np.concatenate([pair, pair.transpose(0, 2, 1)]))
            back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
            messages = np.zeros((2 * len(edges), k))
            for _ in range(ROUNDS):
                belief = log.copy()
                np.add.at(belief, target, messages)
                out = belief[source] - messages[back]
                out = np.log(np.einsum("ei,eij->ej", np.exp(out - out.max(1, keepdims=True)), table))
                out -= out.max(1, keepdims=True)
                change = np.abs(out - messages).max()
                messages = DAMPING * messages + (1 - DAMPING) * out
                if change < TOLERANCE:
                    break
            np.add.at(log, target, messages)
        p = np.exp(log - log.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def learn(docs: list[list[Mention]]) -> Field:
    """Piecewise training: unary softmax on smoothed base labels, chain by counts, skip by one-dimensional search.

    For the skip weight every repeated base mention is hidden in turn, and has to be recovered from its twin.
    """
    k = len(LABELS)
    nodes = [x for d in docs for x in d]
    f = len(shape_of(""))
    unary = np.zeros((f, k))
    chain = np.zeros((k, k))
    if nodes:
        x = np.array([n.shape for n in nodes])
        y = np.full((len(nodes), k), SMOOTHING / k)
        y[np.arange(len(nodes)), [n.label or 0 for n in nodes]] += 1 - SMOOTHING
        for step in range(400):
            p = np.exp(x @ unary)
            p /= p.sum(1, keepdims=True)
            unary -= 0.8 / (1 + step / 100) * (x.T @ (p - y) / len(nodes) + 1e-3 * unary)
        counts = np.ones((k, k))
        for d in docs:
            for a, b in pairwise(d):
                if b.start - a.end <= NEAR:
                    counts[a.label or 0, b.label or 0] += 1
        chain = np.log(counts * counts.sum() / (counts.sum(1, keepdims=True) * counts.sum(0, keepdims=True)))
        chain = np.clip(chain, -CHAIN_LIMIT, CHAIN_LIMIT)
    twins = [(d[i], d[j]) for d in docs for i, j in similar(d) if d[i].label is not None and d[j].label is not None]

    def score(w: float) -> float:
        total = -((w - SKIP_PRIOR) ** 2) / (2 * SKIP_SD**2)
        for a, b in twins:
            z = np.array(a.shape) @ unary
            z[b.label] += w
            total += z[a.label] - np.log(np.exp(z).sum())
        return total

    return Field(unary, chain, max(np.arange(2.0, 8.01, 0.25), key=score))


def fit(df: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE_DOCS) -> Field:
    """Learn the field from at most ``sample`` documents, those whose keys hash lowest."""
    ids = df.select(key, F.xxhash64(F.col(key).cast("string")).alias("_h")).orderBy("_h", key).limit(sample).select(key)
    texts = df.join(F.broadcast(ids), key, "left_semi").filter(F.col(text).rlike("[@0-9]"))
    found = map_texts(texts, lambda xs: [base_mentions(x) for x in xs], MENTIONS, ARROW_MENTIONS, "_m", text, [])
    # an id may have many rows
    rows = found.filter(F.size("_m") > 0).limit(sample).collect()
    return learn([[Mention(m["start"], m["end"], m["key"], m["label"], list(m["shape"])) for m in r["_m"]] for r in sorted(rows, key=str)])


def base_mentions(text: str) -> list[dict]:
    """Mentions of one sampled document, for learning only: SAMPLE_MENTIONS at most, those of the lowest hashes, in order."""
    base = base_spans(text)
    found = mentions(text, base) if base else []
    lowest = set(sorted(range(len(found)), key=lambda i: zlib.crc32(f"{found[i].start} {found[i].key}".encode()))[:SAMPLE_MENTIONS])
    return [{s: getattr(m, s) for s in Mention.__slots__} for i, m in enumerate(found) if i in lowest]


def spans(text: str, field: Field) -> list[dict]:
    """Base spans, and the mentions that the field labels, in code points."""
    base = base_spans(text)
    out = {k: (True, "") for k in base}
    if base:
        nodes = mentions(text, base)
        if any(x.label is None for x in nodes):
            for x, p in zip(nodes, field.marginals(nodes), strict=True):
                if x.label is None and (best := int(p.argmax())):
                    out.setdefault((LABELS[best], x.start, x.end), (False, "field"))
    order = sorted(out, key=lambda k: (k[1], KINDS.index(k[0]), k[2]))
    return [{"kind": k, "start": s, "end": e, "base": out[k, s, e][0], "via": out[k, s, e][1]} for k, s, e in order]


def find_pii(df: DataFrame, field: Field, text: str = "text", out: str = "spans", keep: list[str] | None = None) -> DataFrame:
    """Add the array ``out`` of personal data in the whole text.

    Base spans come from rules; mentions that repeat or resemble them (the same number written differently, an
    address spelt out or cut to its name) join by skip edges, and loopy message passing decides their labels.
    Null and empty texts have no spans; a document without a base span has no evidence and gets none; equal
    rows give equal results; other columns pass through.
    """
    return map_texts(df, lambda texts: [spans(x, field) for x in texts], SPANS, ARROW_SPANS, out, text, keep)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return span_report(find_pii(docs, fit(docs), keep=["doc_id"]), KINDS)
