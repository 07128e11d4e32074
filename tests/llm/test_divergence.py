"""The audit against plain integers, on tables with nulls, empties, repeated rows and further columns."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from taskloom.llm import divergence

DOCS = "doc_id long, text string, lang string, source string"


def plain(rows, least=3, top=200):
    counts, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for _, text, lang, source in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        counts[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        groups = [g for g in counts if g[0] == lang]
        whole = {t: sum(counts[g][t] for g in groups) for t in kept}
        p = {}
        for key, c in [*((g, counts[g]) for g in groups), (None, whole)]:
            total = sum(c[t] for t in kept) + len(kept)
            p[key] = {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}
        f = lambda a, b: (a - b) * (a - b) // b
        for g in groups:
            pairs = [(o[1], sum(f(p[g][t], p[o][t]) for t in kept)) for o in groups if o != g]
            terms = [(t, f(p[g][t], p[None][t])) for t in kept if counts[g][t] and p[g][t] > p[None][t]]
            for part, found, cut in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, g[1], part, item, value, i + 1) for i, (item, value) in enumerate(found[:cut])]
    return sorted(out)


@pytest.mark.parametrize("sources,most,tile,wide", [(3, 64, 1024, 256), (23, 64, 16, 5), (23, 3, 7, 4), (40, 1000, 1024, 16)])
def test_audit(spark, sources, most, tile, wide):
    rng = random.Random(sources + most)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(150)] + ["É", "日本", "Ab", "aB"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(i, rng.choice([" ", "-", "\n"]).join(rng.choices(words, weights, k=rng.randint(0, 25))), rng.choice(["en", "en", "de", None, ""]), f"s{rng.randrange(sources)}") for i in range(300)]
    rows += [(None, None, "en", None), rows[0], rows[0], (900, "", "xx", "only"), (901, "rare once", "yy", "b"), (902, "rare once", "yy", "a"), (903, "common " * 5000 + "Z" * 100_000, "en", "s1"), (904, None, "en", "noterms")]
    df = spark.createDataFrame(rows, DOCS).repartition(3).withColumn("n", F.lit(1)).withColumn("part", F.lit("x")).withColumn("block", F.lit(0)).withColumn("term", F.lit("t"))
    got = divergence.audit(df, top=20, most=most, terms_a_tile=tile, wide=wide)
    assert sorted(map(tuple, got.collect())) == plain(rows, top=20)


def test_an_empty_audit(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0


def test_shares_are_exact_for_large_totals(spark):
    rows = [(c, n, v) for n in (0, 7, 10**12, 8 * 10**15) for v in (1, 99, 10**9) for c in {0, n // 3, n}]
    want = [1 + 10**9 * (c + 1) // (n + v) for c, n, v in rows]
    c, n, v = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    assert divergence.share(c, n, v).tolist() == want
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c long, n long, v long")
    assert [r.p for r in df.select("i", divergence.shared(F.col("c"), F.col("n"), F.col("v")).alias("p")).orderBy("i").collect()] == want
