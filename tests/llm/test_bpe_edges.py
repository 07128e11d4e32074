"""Stitching at every kind of edge: white space, letters newer than some libraries know, apostrophes, real and small chunks."""

import base64
import random

import pytest
from pyspark.sql import functions as F

from taskloom.llm import bpe

SPACES = [chr(c) for c in (0x20, 0x20, 0x20, 0x09, 0x0A, 0x0D, 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x3000, 0x1C)]
OTHERS = [*"abcXYZ019.,!'-", "'s", "'ll", "₏", "՘", "౜", "é", "漢", "。", "😀", "\U00011de0", "́"]


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers as tokenizers
    import tiktoken

    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, tokenizers.PATTERN, tiktoken.Encoding("edges", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def drawn(rng, n):
    return "".join(rng.choice(SPACES if rng.random() < 0.4 else OTHERS) for _ in range(n))


def wrong(spark, texts, tokenizer, **sizes):
    path, pattern, encode = tokenizer
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("k", F.lit("clash")).withColumn("at", F.lit(1))
    return [r.doc_id for r in bpe.encode(docs, path, pattern, **sizes).collect() if list(r.ids) != encode(texts[r.doc_id] or "")]


@pytest.mark.parametrize("chunk,overlap", [(16, 8), (37, 16), (64, 32)])
def test_small_chunks(spark, tokenizer, chunk, overlap):
    rng = random.Random(chunk)
    texts = [drawn(rng, rng.randint(0, 200)) for _ in range(7000)]
    assert wrong(spark, texts, tokenizer, chunk=chunk, overlap=overlap) == []


def test_real_chunks(spark, tokenizer):
    rng = random.Random(1)
    n = bpe.CHUNK
    texts = ["a" * (n - 4) + "    " + "word and word " * 200, "one two  " * (n // 3), "x" * (3 * n), " " * (2 * n), "\n \n" * n, "漢字。" * n, drawn(rng, 3 * n), None]
    assert wrong(spark, texts, tokenizer) == []
