"""Each operator against brute force on small tables with nulls, empties, ties, repeated rows and further columns."""

import base64
import collections
import hashlib
import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from taskloom.llm import bpe, components, decontamination, jaccard, lines, perplexity, pii, sharding, substring, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, extra=True):
    rows = [(i, t, "en" if i % 3 else None, "s", len(t or "")) for i, t in enumerate(texts)]
    if extra:
        rows += [(None, "no id", "en", "s", 5), rows[0]]  # a null id and a repeated row
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumn("h", F.lit(1)).withColumn("cell", F.lit("x")).withColumn("n", F.lit(2)).withColumn("start", F.lit(3))


def near_copies(seed, n=60, words=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = [None, "", " ", "one", "one two", "A b C", "a B c"]
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, words))]
        for _ in range(rng.randint(1, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(rng.choice([" ", "\n", "\t "]).join(copy))
    return out


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert pii.spans_by_document(none, pii.detect(none)).count() == 0
    assert substring.deduplicated(none).count() == 0
    assert topk.top_k(vectors, vectors).count() == 0
    assert decontamination.contamination(none, bench).count() == 0
    assert sharding.shard(none).count() == 0
    assert jaccard.similar(none).count() == 0
    assert toxicity.scored(none, labels).count() == 0
    assert perplexity.judged(none, labels.select("doc_id")).count() == 0
    assert lines.without_repeats(none).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings(spark, seed):
    rng = random.Random(seed)
    texts = [*near_copies(seed, 30, 90), "a b " * 40, "a " * 60, " ".join(rng.choice("ab") for _ in range(300))]
    seen, want = {}, {}
    for i, t in enumerate(texts):
        w = (t or "").split()
        gone = set()
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone |= set(range(s, s + 20))
            seen.setdefault(k, i)
        want[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring.deduplicated(table(spark, texts)).collect()}
    assert got == want


def shingle_set(text, size):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = low.split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


@pytest.mark.parametrize("size,percent,tile", [(4, 85, 1024), (5, 80, 1024), (4, 85, 4)])
def test_jaccard(spark, monkeypatch, size, percent, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    texts = near_copies(3, 60, 200)
    held = [shingle_set(t, size) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if held[i] and held[j] and 100 * len(held[i] & held[j]) >= percent * len(held[i] | held[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    want = {i: (len(held[i]), find(i)) for i in range(len(texts))}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar(table(spark, texts), size, percent).collect()} == want


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r.doc_id: r.component for r in components.components(links).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_top_k(spark):
    rng = np.random.RandomState(4)
    vectors = [(i, [float(x) for x in rng.randn(8) * rng.choice([0.1, 1, 3])]) for i in range(300)]
    vectors += [(300, vectors[0][1]), (301, None), (302, [1.0, None] + [0.0] * 6), (303, [float("nan")] * 8), (304, [1.0, 2.0]), (5, vectors[5][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("norm", F.lit("x"))
    whole = {i: np.floor(1024 * np.array(v + [0.0] * (8 - len(v)))).astype(np.int64) for i, v in vectors if v and None not in v and np.isfinite(v).all()}
    want = []
    for q in (i for i in whole if i % 10 == 0):
        best = sorted(((-int(whole[q] @ v), i) for i, v in whole.items() if i != q))[:10]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    got = topk.top_k(df, df.where("vec_id % 10 = 0"), block=32, query_block=7)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("partitions", [1, 4])
def test_top_k_of_large_numbers_ties_and_zeros(spark, partitions):
    rng = random.Random(partitions)
    vectors = [[rng.choice([0, 1, -1, 0.5]) * 10.0 ** rng.choice([0, 1, 6, 9, 15, 30, 160, 300]) for _ in range(3)] for _ in range(150)]
    vectors += [[1.0, 0.0, 0.0]] * 20 + [[0.0, 0.0, 0.0]] * 5 + [[3e6, 0.0, 0.0], [1.5e308, 1.0, 2.0], [-1.5e308, 1.0, 2.0]]
    limit = int(topk.LARGEST)
    whole = [[max(-limit, min(limit, (int(x) * 1024 if abs(x) > 2**42 else int(np.floor(1024 * x))))) for x in v] for v in vectors]
    want = []
    for q in range(0, len(vectors), 7):
        scores = {i: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(whole[q], v)))) for i, v in enumerate(whole) if i != q}
        best = sorted(((-s, i) for i, s in scores.items()))[:10]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 7 = 0"), block=16, query_block=5).collect())
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == sorted(want)


def test_contamination(spark):
    rng = random.Random(7)
    items = [" ".join(rng.choice("abcdefg") + str(rng.randrange(4)) for _ in range(rng.choice([3, 9, 10, 25]))) for _ in range(12)]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(1, "other text"), (99, None), (98, "--"), (None, "x")], "item_id long, text string").withColumn("off", F.lit(1))
    texts = [None, "", "nothing here", *(f"intro, {t.upper()}! end" for t in items), items[3][:40] + " cut", " ".join(items), "other   text"]
    words = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c if c.isalnum() or ord(c) > 127 else " " for c in t or "").split()
    every = [(i, words(t)) for i, t in enumerate(items)] + [(1, ["other", "text"])]
    want = {}
    for d, t in enumerate(texts):
        w, hit, ids = words(t), set(), set()
        for i, item in every:
            size = min(10, len(item))
            windows = {tuple(item[k : k + size]) for k in range(len(item) - size + 1)}
            for s in range(len(w) - size + 1):
                if tuple(w[s : s + size]) in windows:
                    hit |= set(range(s, s + size))
                    ids.add(str(i))
        want[d] = (len(w), len(hit), sorted(ids))
    got = decontamination.contamination(table(spark, texts), bench).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids)) for r in got} == want
    assert decontamination.proximity(table(spark, texts), spark.createDataFrame([(0, "here nothing")], "item_id long, text string"), 2).count() == 1


def test_shards(spark):
    texts = [None, "", *(random.Random(i % 40).choice("ab") * (i % 40 * 7) for i in range(400))]
    rows = sharding.shard(table(spark, texts), 4).collect()
    assert len(rows) == len(texts)
    by_text, load, slots = collections.defaultdict(set), collections.Counter(), collections.defaultdict(list)
    for r in rows:
        t = texts[r.doc_id] or ""
        by_text[t].add(r.shard)
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        assert r["size"] == len(t) + 1
    assert all(len(s) == 1 for s in by_text.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = collections.Counter()
    for t in texts:
        groups[t or ""] += len(t or "") + 1
    assert sorted(load.values()) == sorted(longest_first(groups.values(), 4))


def longest_first(sizes, shards):
    heap = [(0, s) for s in range(shards)]
    for size in sorted(sizes, reverse=True):
        load, s = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, s))
    return [load for load, _ in sorted(heap, key=lambda x: x[1])]


@pytest.mark.parametrize("seed", range(200))
def test_schedule_is_that_of_the_heap(seed):
    rng = random.Random(seed)
    shards = rng.choice([1, 2, 3, 16])
    sizes = {rng.choice([rng.randint(1, 30), rng.randint(1, 10**9)]): rng.choice([1, 2, 5, rng.randint(1, 300)]) for _ in range(rng.randint(0, 30))}
    heap, want = [(0, s) for s in range(shards)], {}
    for size in sorted(sizes, reverse=True):
        for rank in range(sizes[size]):
            load, s = heapq.heappop(heap)
            want[size, rank] = s
            heapq.heappush(heap, (load + size, s))
    got = {}
    for size, first, n, turns in sharding.schedule([(k, sizes[k]) for k in sorted(sizes, reverse=True)], shards):
        got |= {(size, first + i): turns[i % len(turns)] for i in range(n)}
    assert got == want


def test_bpe_round_trip(spark):
    import public_tokenizers as tokenizers
    import tiktoken

    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rng = random.Random(5)
    texts = [None, "", "a", "x" * 500, *("".join(rng.choice("ab é ß'  \n\t12!?,.漢字😀'rest'llx") for _ in range(rng.randint(1, 300))) for _ in range(120))]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = bpe.decode(bpe.encode(table(spark, texts), path, tokenizers.PATTERN, chunk=37, overlap=16), path, tokenizers.PATTERN).collect()
    assert len(found) == len(texts)
    for r in found:
        t = texts[r.doc_id] or ""
        assert list(r.ids) == encoding.encode_ordinary(t) and bytes(r.bytes) == t.encode()


def test_base_spans():
    import re

    patterns = {k: re.compile(v.split("  ")[0]) for k, v in pii.BASE_RULES.items()}
    rng = random.Random(1)
    for _ in range(5000):
        t = "".join(rng.choice("a1@.._-+% ()é2b") for _ in range(rng.randint(0, 40)))
        want = []
        for kind, p in patterns.items():
            for m in p.finditer(t):
                d = "".join(c for c in m[0] if c in "0123456789")
                fine = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]
                want += [(kind, *m.span())] if fine else []
        assert pii.base_spans(t) == want


def test_pii_keeps_base_spans_and_adds_sure_ones(spark):
    texts = [None, "", "mail a.b@c.org or call +1 (743) 555-3824", "card 4111 1111 1111 1111 and 10.0.0.1", *(f"call phone 743-555-38{i:02d}, x{i}@mail.com" for i in range(30))]
    df = table(spark, texts)
    rows = {r.doc_id: r for r in pii.spans_by_document(df, pii.detect(df)).collect()}
    assert len(rows) == len(texts) and rows[0].spans == "" and rows[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[2].spans.startswith("email:5:14,phone:23:40") and (rows[3].n_card, rows[3].n_ip) == (1, 1)


def test_pii_adds_secrets_and_leaves_plain_words(spark):
    rng = random.Random(4)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts = [f'words before token = "{key(40)}" and after' for _ in range(30)] + [f"password: {key(16)} here" for _ in range(10)]
    texts += ["a plain sentence about a token of thanks, and the secret of section 12345" for _ in range(40)] + ["x" * 300_000 + f' token = "{key(40)}"', None]
    df = table(spark, texts)
    rows = {r.doc_id: r for r in pii.spans_by_document(df, pii.detect(df)).collect()}
    assert all(rows[i].n_secret == 1 for i in range(40)) and rows[80].n_secret == 1 and not any(rows[i].n_spans for i in [*range(40, 80), 81])
    at = texts[0].index('"') + 1
    assert rows[0].spans == f"secret:{at}:{at + 40}"


def test_reliabilities_follow_the_better_labelers():
    """Votes drawn with known reliabilities: the estimates order the patterns as the true posterior does."""
    rng = np.random.RandomState(1)
    right, counts = [0.95, 0.9, 0.6, 0.85, 0.8], collections.Counter()
    truth = rng.rand(20000) < 0.3
    for t in truth:
        counts["".join("+" if (rng.rand() < r) == bool(t) else "-" for r in right)] += 1
    soft = pii.reliabilities([("secret", v, n) for v, n in counts.items()])
    score = lambda v: np.log(0.3 / 0.7) + sum((1 if c == "+" else -1) * np.log(r / (1 - r)) for c, r in zip(v, right, strict=True))
    agree = sum(n for v, n in counts.items() if (soft["secret", v] > 0.5) == (score(v) > 0))
    assert agree > 0.97 * len(truth)


@pytest.mark.parametrize("seed,floor", [(1, 3), (2, 8), (3, 20)])
def test_whole_runs_of_lines(spark, seed, floor):
    rng = random.Random(seed)
    pool = ["", " \t", *(" ".join(rng.choice(["aa", "bb", "cc"]) for _ in range(rng.choice([1, 1, 2, 3, 8, 25]))) for _ in range(12))]
    texts = [None, "", "\n\n", *("\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(80))]
    texts += ["short head line\nv\nx1", "short head line\nw", "short head line\nv\n\nend"]
    split, full, seen, want = {}, {}, set(), {}
    for i, t in enumerate(texts):
        split[i] = (t or "").split("\n")
        full[i] = [k for k, x in enumerate(split[i]) if x.split()]
    for i, at in full.items():
        gone, n = set(), [len(split[i][k].split()) for k in at]
        for s in range(len(at)):
            for e in range(s + 1, len(at) + 1):
                run = tuple(split[i][k] for k in at[s:e])
                if sum(n[s:e]) >= floor:
                    gone |= set(range(s, e)) if run in seen else set()
                    seen.add(run)
        lost = {at[k] for k in gone} | {x for k in gone if k + 1 in gone for x in range(at[k], at[k + 1])}
        want[i] = (len(split[i]), len(lost), "\n".join(x for k, x in enumerate(split[i]) if k not in lost))
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in lines.without_repeats(table(spark, texts), floor).collect()}
    assert got == want


def test_the_pipeline_deletes_short_repeats_and_whole_runs(spark):
    import corpus_pipeline

    passage = "\n".join([" ".join(f"w{k}x{i}" for i in range(12)) for k in range(4)] + ["its last line"])
    docs = spark.createDataFrame([(1, f"one\n{passage}", "en", "s", 0), (2, f"{passage}\ntwo", "en", "s", 0), (3, "its last line\nthree", "en", "s", 0)], DOCS)
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()} == {1: f"one\n{passage}", 2: "two", 3: "three"}


def test_toxicity_is_learnt(spark):
    rng = random.Random(2)
    plain = [f"w{i}x" for i in range(300)]
    make = lambda bad: " ".join([rng.choice(plain) for _ in range(40)] + ([rng.choice(["vilewort", "grimling"])] * 2 if bad else []))
    texts = [None, "", *(make(i % 5 == 0) for i in range(2, 602))]
    labels = spark.createDataFrame([(i, int(i % 5 == 2)) for i in range(2, 400)] + [(3, None)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    real = {i: "vilewort" in (t or "") or "grimling" in (t or "") for i, t in enumerate(texts)}
    labels = spark.createDataFrame([(i, int(real[i])) for i in range(2, 400)] + [(3, None)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    got = {r.doc_id: r.score for r in toxicity.scored(table(spark, texts), labels).collect()}
    assert len(got) == len(texts) and all(0 <= s <= 1 for s in got.values())
    assert sum((got[i] >= 0.5) == real[i] for i in range(400, 602)) > 195


@pytest.mark.parametrize("seed,ties", [(3, False), (4, True)])
def test_nearest_is_exact(seed, ties):
    rng = np.random.RandomState(seed)
    examples = []
    for i in range(700):
        ids = np.sort(rng.choice(90, rng.randint(1, 6), replace=False) if i % 3 else rng.choice(8, 2, replace=False))
        w = np.ones(len(ids)) if ties else rng.rand(len(ids))
        examples.append((i, i % 2, ids, w / np.linalg.norm(w)))
    index = toxicity.Index(examples, 90)
    assert 0 < (index.column >= 0).sum() < 90
    for _ in range(200):
        ids = np.sort(rng.choice(90, 6, replace=False))
        w = np.ones(6) if ties else rng.rand(6)
        w /= np.linalg.norm(w)
        rows, sims = index.nearest(ids, w, 7)
        q, of = dict(zip(ids, w, strict=True)), {e[0]: e for e in examples}
        every = [(-round(sum(q.get(t, 0) * x for t, x in zip(*of[d][2:], strict=True)), 12), r) for r, d in enumerate(index.doc_ids)]
        every = sorted((s, r) for s, r in every if s < 0)[:7]
        assert np.allclose(sims, [-s for s, _ in every]) and (rows.tolist() == [r for _, r in every] or not ties)


def test_toxicity_against_a_plain_model(spark):
    """Vectors, document frequencies, z, votes and calibration, each once more in plain Python; equal texts with different labels, ties."""
    rng = random.Random(8)
    pool = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    texts = [None, "", "zzz yyy", *(" ".join(rng.choice(pool[:10] if rng.random() < 0.3 else pool) for _ in range(rng.randint(1, 25))) for _ in range(300))]
    texts[250:260] = texts[50:60]
    labels = [(i, int(rng.random() < (0.9 if texts[i] and pool[3] in texts[i] else 0.1))) for i in range(1, 260)]
    docs, labelled = table(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")
    ready = toxicity.documents(docs)
    rows = [r for r in toxicity.sampled(ready, labelled).collect()]
    assert len({r.text for r in rows}) == len(rows) and all(r.toxic == max(t for i, t in labels if (texts[i] or "") == r.text) for r in rows)
    count = lambda t: collections.Counter((t or "").split())
    index = sorted((r for r in rows if r.in_index), key=lambda r: r.doc_id)
    terms = sorted({w for r in index for w in count(r.text)})
    sample = [r for r in rows if r.in_sample]
    n1, n0, df = sum(r.toxic for r in sample), sum(1 - r.toxic for r in sample), collections.Counter(w for t in texts for w in count(t))
    df = {w: sum(w in count(t) for t in texts) for w in terms}
    weight = {}
    for w in terms:
        a, b, p, z = sum(w in count(r.text) and r.toxic for r in sample), sum(w in count(r.text) and 1 - r.toxic for r in sample), n1 / (n1 + n0), 0.0
        if a > p * (a + b):
            z = np.sqrt(max(0.0, 2 * (a * np.log(a / (p * (a + b))) + (b * np.log(b / ((1 - p) * (a + b))) if b else 0))))
        weight[w] = (np.log((1 + len(texts)) / (1 + df[w])) + 1) * (1 + toxicity.LEAN * z)

    def vector(t):
        c = count(t)
        v = {w: np.sqrt(n) * weight[w] for w, n in c.items() if w in weight}
        size = np.sqrt(sum(x * x for x in v.values()) + sum(n for w, n in c.items() if w not in weight)) or 1.0
        return {w: x / size for w, x in v.items()}

    model = toxicity.trained(ready, labelled)
    examples = {r.doc_id: (vector(r.text), r.toxic) for r in index}
    order = {int(d): i for i, d in enumerate(model.index.doc_ids)}

    def share(t):
        v = vector(t)
        found = sorted((-round(sum(x * e.get(w, 0) for w, x in v.items()), 12), order[d]) for d, (e, _) in examples.items() if d in order)
        found = [(-s, examples[int(model.index.doc_ids[r])][1]) for s, r in found[:7] if s < 0]
        return sum(s * y for s, y in found) / sum(s for s, _ in found) if found else -1

    known = sorted((share(r.text), r.toxic) for r in rows if r.in_calibration)
    for t in texts:
        assert model.index.share(*model.vector(t or ""), 7)[0] == pytest.approx(share(t), abs=1e-6)
    scores = [{r.doc_id: r.score for r in toxicity.scored(docs, labelled).collect()} for _ in range(2)]
    assert scores[0] == scores[1] and scores[0][0] == scores[0][1] == pytest.approx(model.prior)


@pytest.mark.parametrize("seed", range(20))
def test_isotonic_steps(seed):
    """The least-squares increasing fit is max over lower ends of min over upper ends of the means between; means lean to a half by a row."""
    rng = np.random.RandomState(seed)
    x, y, w = rng.randint(0, 12, 40) / 12, rng.randint(0, 2, 40).astype(float), rng.randint(1, 4, 40).astype(float)
    at, means = toxicity.isotonic(x, y, w)
    own = sorted(set(x.tolist()))
    between = lambda lo, hi: (x >= lo) & (x <= hi)
    for v in own:
        best = max((min(((y * w)[between(lo, hi)].sum() / w[between(lo, hi)].sum(), hi) for hi in own if hi >= v)[0] for lo in own if lo <= v))
        step = int(np.searchsorted(at, v, "right")) - 1
        total = w[(x >= at[step]) & (x < (at[step + 1] if step + 1 < len(at) else np.inf))].sum()
        assert (means[step] * (total + 1) - 0.5) / total == pytest.approx(best)


def kneser_ney(trusted, order):
    """p(symbol | context) in plain Python: symbols are bytes, 256 starts and 257 ends a text."""
    counts = {order: collections.Counter()}
    for t in trusted:
        w = [256] * (order - 1) + list(t.encode()) + [257]
        counts[order].update(tuple(w[i : i + order]) for i in range(len(w) - order + 1) if t)
    for n in range(order - 1, 0, -1):
        counts[n] = collections.Counter()
        for g, c in counts[n + 1].items():
            counts[n][g[1:]] += c if g[1] == 256 else 1
    discounts, sums, rest = {}, {}, {}
    for n, held in counts.items():
        n1, n2, n3, n4 = (sum(c == k for c in held.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.0
        d = [min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) if a else 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        discounts[n], sums[n], rest[n] = d, collections.Counter(), collections.Counter()
        for g, c in held.items():
            sums[n][g[:-1]] += c
            rest[n][g[:-1]] += d[min(c, 3) - 1]

    def p(g):
        lower = p(g[1:]) if len(g) > 1 else 1 / 257
        n, total = len(g), sums[len(g)][g[:-1]]
        if not total:
            return lower
        c = counts[n][g]
        return (c - discounts[n][min(c, 3) - 1] if c else 0) / total + rest[n][g[:-1]] / total * lower

    return p


def test_perplexity_against_a_plain_model(spark):
    rng = random.Random(6)
    texts = [None, "", "é漢😀", "\u0f00\u1f00", *("".join(rng.choice("abc deé漢") for _ in range(rng.randint(1, 80))) for _ in range(60)), "ab c" * 5000]
    docs, trusted = table(spark, texts), range(3, 40)
    ready = perplexity.once_each(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", "text")
    p = kneser_ney([texts[i] for i in trusted], perplexity.ORDER)
    ids = spark.createDataFrame([(i,) for i in trusted], "doc_id long")
    for rows in (perplexity.TABLE_ROWS, 0):  # the table broadcast, and met by blocks
        got = {r.doc_id: r for r in perplexity.perplexities(ready, ids, rows).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            w = [256] * (perplexity.ORDER - 1) + list((t or "").encode()) + [257]
            grams = [tuple(w[k : k + perplexity.ORDER]) for k in range(len(w) - perplexity.ORDER + 1)]
            want = float(np.exp(-np.mean([np.log(p(g)) for g in grams]))) if t else None
            assert got[i].n_chars == len(t or "") and (got[i].perplexity == pytest.approx(want) if t else got[i].perplexity is None)
    context = tuple(b"abc d"[: perplexity.ORDER - 1])
    for c in (context, (256,) * (perplexity.ORDER - 1)):
        assert sum(p((*c, x)) for x in [*range(256), 257]) == pytest.approx(1)


def test_quality_limits(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["stone", "river", "cloud", "green", "walks", "under"])
    texts = [" ".join(word() for _ in range(30)) for _ in range(450)] + ["x9#" * 40, "stone " * 60, None, ""]
    docs = table(spark, texts)
    trusted = spark.createDataFrame([(i,) for i in [*range(400), None, 7, 999]], "doc_id long")
    rows = {r.doc_id: r for r in perplexity.judged(docs, trusted).collect()}
    assert len(rows) == len(texts) and not any(rows[i].keep for i in range(450, 454)) and sum(rows[i].keep for i in range(400, 450)) > 40
    held = [i for i in range(400) if spark.range(1).selectExpr(f"pmod(xxhash64({i}L), {perplexity.HELD})").first()[0] == 0][:3]
    assert all(rows[i].perplexity is not None for i in held)


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = corpus_pipeline.written(stage(spark, docs, sf), name)
        after = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(after) <= before and len(after) == len(set(after)) > 0.5 * len(before)
        if name != "bpe":
            assert docs.columns == corpus_pipeline.COLUMNS
