"""The manifest against a plain tree, on tables with nulls, empties, repeated rows and further columns."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from taskloom.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, lower=False):
    doc, text, lang, source, n = row
    text = text.translate(str.maketrans(merkle.UPPER, merkle.LOWER)) if lower and text is not None else text
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))


def climb(nodes):
    """Root of a list of nodes, and for each the (left, right) siblings on the way."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for p, i in zip(paths, at, strict=True):
            a = i // 8 * 8
            p.append(("".join(level[a:i]), "".join(level[i + 1 : a + 8])))
        level, at = [h("".join(level[a : a + 8])) for a in range(0, len(level), 8)], [i // 8 for i in at]
    return level[0], paths


def plain(rows):
    trees = collections.defaultdict(list)
    for r in rows:
        trees[r[2]].append(r)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    first = lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))
    tops = {g: climb([leaf_of(r) for r in sorted(trees[g], key=first)]) for g in langs}
    root, over = climb([tops[g][0] for g in langs])
    out = []
    for g, above in zip(langs, over, strict=True):
        for r, path in zip(sorted(trees[g], key=first), tops[g][1], strict=True):
            odd = r[0] is not None and __import__("zlib").crc32(str(r[0]).encode()) % 3 == 0
            now = leaf_of(r, odd)
            for a, b in path + above:
                now = h(a + now + b)
            out.append((r[0], leaf_of(r), tops[g][0], root, h("".join(a + b for a, b in path + above)), now, now == root))
    return sorted(out, key=repr)


def shown(found):
    return sorted((tuple(r) for r in found.select("key", "leaf", "subroot", "root", F.sha2("proof", 256), "folded_root", "verified").collect()), key=repr)


def lowered():
    return {"text": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", merkle.UPPER, merkle.LOWER))}


@pytest.mark.parametrize("n,depth,langs", [(1, 4, 1), (9, 4, 1), (70, 1, 3), (330, 1, 12), (150, 2, 2)])
def test_manifest(spark, n, depth, langs):
    rng = random.Random(n)
    names = [None, "", "en", "de", "é", *(f"l{i}" for i in range(20))][:langs]
    words = ["A", "bC", "d", "É", "日本", ""]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), rng.choice(names), rng.choice(["s", None, ""]), i % 4 or None) for i in range(n)]
    if n > 9:
        rows += [(None, None, "en" if langs > 2 else None, None, None), rows[3], rows[3], (3, "Other TEXT", rows[3][2], "s", 1), (n + 5, "X" * 300_000, names[-1], "s", 7)]
    df = spark.createDataFrame(rows, DOCS).repartition(3).withColumn("place", F.lit(1)).withColumn("tree", F.lit("x")).withColumn("leaf", F.lit(0))
    found = merkle.manifest(df, instead=lowered(), depth=depth)
    assert shown(found) == plain(rows)
    again = found.select("folded_root", merkle.folded(F.col("leaf"), F.col("proof"), F.col("turns")).alias("own"), "root", "verified")
    assert all(r.own == r.root for r in again.collect())


def test_an_empty_manifest(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0
