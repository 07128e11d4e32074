"""The pipeline's stages against brute force on small tables with nulls, empties, long texts, ties, repeated rows and clashing columns."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, items = make(14), [(1, make(12)), (2, "tiny item"), (3, None), (4, "")]
    texts = [None, "", " \n ", "one", make(60), make(80)]
    base = texts[5].split()
    texts += [" ".join([*base[:40], "changed", *base[41:]]), texts[5], " ".join([*base[:30], *(make(50).split())])]
    texts += [f"{make(9)}\n{passage}\n{make(8)}", f"{make(7)}\n{passage}", f"{make(20)} {items[0][1]} {make(20)}", f"{make(30)} Tiny ITEM {make(5)}", make(30_000)]
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in enumerate(texts)]
    return rows, [(None, "lost", "en", "s", 1), rows[4], (4, "zz later text", "en", "s", 1)], items


@pytest.fixture
def docs(spark, corpus):
    rows, odd, _ = corpus
    df = spark.createDataFrame(rows + odd, DOCS).repartition(3)
    return df.withColumns({c: F.lit("x") for c in ("line", "words", "cell", "a", "component", "item_id", "toxic")})


@pytest.fixture
def tables(spark, corpus, tmp_path):
    labels = [(i, i % 2, 0) for i in range(10)]
    spark.createDataFrame(corpus[2], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_near_duplicates(spark, corpus, docs, tables):
    import corpus_pipeline

    sets = {}
    for i, t, *_ in corpus[0]:
        w = lower(t).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    parent[a] = parent[b] = min(parent[a], parent[b])
    got = corpus_pipeline.near_duplicates(spark, docs, tables)
    assert got.columns == corpus_pipeline.COLUMNS
    assert {r.doc_id: r.text for r in got.collect()} == {i: t or "" for i, t, *_ in corpus[0] if parent[i] == i}


def test_decontamination(spark, corpus, docs, tables):
    import re

    import corpus_pipeline

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = set()
    for _, t in corpus[2]:
        w = split(t)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    clean = {i: t or "" for i, t, *_ in corpus[0] if not any(tuple(w[k : k + n]) in windows for w in [split(t)] for n in {len(x) for x in windows} for k in range(len(w) - n + 1))}
    assert set(range(len(corpus[0]))) - set(clean) == {11, 12}
    got = corpus_pipeline.decontamination(spark, docs, tables)
    assert got.columns == corpus_pipeline.COLUMNS and {r.doc_id: r.text for r in got.collect()} == clean


def test_line_dedup(spark, corpus, docs, tables):
    import corpus_pipeline

    seen, want = set(), {}
    for i, t, *_ in corpus[0]:
        parts = (t or "").split("\n")
        own = [p for p in parts if not (len(p.split()) >= 3 and p in seen)]
        seen |= {p for p in parts if len(p.split()) >= 3}
        want[i] = "\n".join(own)
    got = corpus_pipeline.line_dedup(spark, docs, tables)
    assert got.columns == corpus_pipeline.COLUMNS
    assert {r.doc_id: (r.text, r.n_chars) for r in got.collect()} == {i: (t, len(t)) for i, t in want.items()}


def test_tokens_come_back(spark, corpus, docs, tables):
    import corpus_pipeline

    got = {r.doc_id: (r.n_tokens, len(r.ids), r.decoded_sha256) for r in corpus_pipeline.tokens(spark, docs, tables).collect()}
    assert set(got) == {i for i, *_ in corpus[0]}
    for i, t, *_ in corpus[0]:
        assert got[i][0] == got[i][1] and got[i][2] == hashlib.sha256((t or "").encode()).hexdigest()


def test_toxicity_keeps_all_where_nothing_is_labelled_toxic(spark, corpus, docs, tables):
    import corpus_pipeline

    got = corpus_pipeline.toxicity(spark, docs, tables)
    assert got.columns == corpus_pipeline.COLUMNS and {r.doc_id for r in got.collect()} == {i for i, *_ in corpus[0]}


def test_stages_on_an_empty_table(spark, docs, tables):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), tables).count() == 0
