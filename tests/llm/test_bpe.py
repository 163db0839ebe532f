"""Byte-level BPE against the library."""

import base64
import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tidemark.llm import bpe

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(library, text):
    return np.array(library.encode_ordinary(text), "<u4").tobytes()


def test_encoding_equals_the_library(library):
    rng = random.Random(1)
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(chr(rng.choice(points)) for _ in range(100)) for _ in range(100)]
    texts += ["".join(rng.choice("aab'st 1.\n\t éüсло漢字՘₏\U000107bb") for _ in range(rng.choice([0, 1, 5, 50, 2000]))) for _ in range(200)]
    texts += ["a" * 3000, "x" * 1023 + "y", "y" * 1025, "hello" * 900, "漢字" * 1500, "-=" * 700, "", " ", "\n\n  ", "<|endoftext|>"]
    own = bpe.codec(public_tokenizers.path(bpe.VOCABULARY))
    assert own.encode(texts) == [ids_of(library, x) for x in texts]


def test_bucket_and_heap_merge_alike():
    own, rng = bpe.codec(public_tokenizers.path(bpe.VOCABULARY)), random.Random(2)
    words = ["".join(rng.choice("abeilnrst") for _ in range(rng.randrange(1, 90))).encode() for _ in range(500)]
    assert own.merged(words) == [own.by_heap(w) for w in words]


def test_one_long_word_takes_linear_time():
    own, rng = bpe.codec(public_tokenizers.path(bpe.VOCABULARY)), random.Random(3)
    began = time.process_time()
    own.encode(["k" * 250_000 + "".join(rng.choice("abcdefghij") for _ in range(250_000))])
    assert time.process_time() - began < 30


def test_round_trip_of_odd_rows(spark, library):
    texts = [None, "", "a", "a", "é\n漢字 <|endoftext|>", "z" * 5000]
    df = spark.createDataFrame([(i, x, "k") for i, x in enumerate(texts)], "doc_id long, text string, ids string")
    coded = bpe.decode(bpe.encode(df, out="coded"), ids="coded").orderBy("doc_id").collect()
    assert coded[0].ids == "k"
    for row, text in zip(coded, texts, strict=True):
        assert bytes(row.coded) == ids_of(library, text or "") and bytes(row.decoded).decode() == (text or "")
    assert bpe.decode(bpe.encode(df.filter("false"))).count() == 0
    odd = spark.createDataFrame([(None,), (b"abc",), (b"\xff\xff\xff\x7f",), (b"",)], "ids binary")
    assert [r.decoded for r in bpe.decode(odd).collect()] == [None, None, None, b""]


def test_query(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = bpe.op13_byte_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = ids_of(library, texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
