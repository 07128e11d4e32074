"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

1. A sample of labelled rows is the index.  Every word (lower-cased run of letters) of its whole texts is a term; a text's words that no example has
   share one coordinate, which only counts towards its length.
2. Document frequencies of the terms are counted over all documents.  A term's weight in a text is the root of its frequency, times its
   inverse document frequency, times 1 + ``LEAN`` z, where z is the signed root of the likelihood ratio by which the term speaks for
   toxicity among labelled rows, 0 for all terms that don't.  So no term is left out, and telling ones count for more.
3. Terms of few examples have postings.  The weights of the others are held by blocks of ``BLOCK`` examples, with the largest
   weight of each term in each block.  Examples are ordered by their heaviest term, so that blocks hold like examples.
4. A document adds up its postings, and adds to the highest sum in each block what the block's maxima allow at most.  Blocks are
   visited in descending order of that bound until it is below the k-th similarity so far: the k nearest are exact.  Ties go
   to the earlier example.
5. The neighbours vote with their similarities.  The shares are calibrated by isotonic regression over labelled rows that are neither
   in the index nor counted in z, each label weighted as it is among all labelled rows.

Which labelled rows are sampled is drawn by a hash of their ids.  The samples' sizes are bounded (``SAMPLE``, ``EXAMPLES``, ``CALIBRATION`` rows of either
label), so the model is a few MB for any input and is broadcast; all documents are scored whole.

Cases: null and empty texts, and texts that share no word with any example, get the share of toxic rows; a label that is null does not
count, and of several labels of a row, or of rows with equal texts, the largest counts; without labels every score is ``NO_MODEL``; an
empty table gives an empty result; repeated and null ``doc_id`` as in ``common``; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.llm.common import documents, once_each, table, written

BLOCK, NEIGHBOURS = 64, 7
#: Vectors that are compared together.
TOGETHER = 64
#: Blocks that are visited before the others are tested.
FIRST = 3
#: How much more a term that speaks for toxicity weighs.
LEAN = 2.0
#: Terms in more than this part of the examples are held by blocks, others have postings.
COMMON = 0.05
#: Labelled rows of either label, at most about, for z, the index and the calibration.
SAMPLE, EXAMPLES, CALIBRATION = 16_384, 1_024, 8_192
#: Of few rows so many go to the index, the others to the calibration.
INDEX_SHARE = 0.6
#: The score of all documents if there are no labels to learn from.
NO_MODEL = 0.499
_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0


def word_counts(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


def sampled(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """``doc_id, text, toxic, weight`` of the labelled rows in any sample, one for equal texts, and whether each is ``in_sample``,
    ``in_index`` or ``in_calibration``.  Of either label each sample has about its bound, or all; ``weight`` is how many rows
    of its label a row of the calibration stands for."""
    n = {r.toxic: r.n for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}

    def below(most: int, share: float) -> Column:
        return F.when(F.col("toxic") == 1, min(share, most / n.get(1, 1))).otherwise(min(share, most / n.get(0, 1)))

    u, v = (F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1 << 30)) / (1 << 30) for salt in "ab")
    calibration = below(CALIBRATION, 1 - INDEX_SHARE)
    flags = ((v < below(SAMPLE, 1.0)) & (1 - u > calibration)).alias("in_sample"), (u < below(EXAMPLES, INDEX_SHARE)).alias("in_index"), (1 - u <= calibration).alias("in_calibration")
    ids = labelled.select("doc_id", "toxic", (1 / calibration).alias("weight"), *flags)
    ids = ids.where("in_sample or in_index or in_calibration")  # bounded by the samples' sizes: some 51,000 rows
    row = F.struct("doc_id", "toxic", "weight", "in_sample", "in_index", "in_calibration")
    rows = docs.join(F.broadcast(ids), "doc_id").groupBy("text").agg(F.min(row).alias("row"), F.max("toxic").alias("label"))
    return written(rows.select("text", "row.*", "label").drop("toxic").withColumnRenamed("label", "toxic"), "labelled")


class Terms:
    """The words of the examples, numbered."""

    def __init__(self, words: list[str]):
        self.ids = {w: i for i, w in enumerate(words)}

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Terms of a text and how often each occurs, and how many of its words are none."""
        found = word_counts(text)
        ids, n = np.fromiter(map(self.ids.get, found, repeat(-1)), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))
        return ids[ids >= 0], n[ids >= 0], int(n[ids < 0].sum())


def words_in(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def texts_with(rows: DataFrame, terms: Broadcast, by: str) -> np.ndarray:
    """In how many texts of ``rows`` each term occurs, for ``by`` (a 0/1 column) 0 and 1; counted within tasks before the shuffle."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, seen = terms.value.ids, np.zeros((2, len(terms.value.ids)), np.int64)
        for frame in frames:
            for text, side in zip(frame.text, frame[by], strict=True):
                seen[int(side), [ids[w] for w in words_in(text) & ids.keys()]] += 1
        for side in (0, 1):
            some = np.flatnonzero(seen[side])
            for at in range(0, len(some), 50_000):
                i = some[at : at + 50_000]
                yield pd.DataFrame({"side": side, "i": i, "n": seen[side, i]})

    out = np.zeros((2, len(terms.value.ids)))
    found = rows.select("text", by).mapInPandas(count, "side int, i long, n long").groupBy("side", "i").agg(F.sum("n").alias("n")).toPandas()  # a row for each term
    out[found.side, found.i] = found.n
    return out


def leaning(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """z of terms that stand in so many of the toxic and of the other rows, 0 for those that don't speak for toxicity."""
    share, rows = n_toxic / max(1, n_toxic + n_other), toxic + other
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = toxic * np.log(toxic / (share * rows)) + np.where(other > 0, other * np.log(other / ((1 - share) * rows)), 0.0)
    return np.sqrt(np.where(toxic > share * rows, np.maximum(0.0, 2 * ratio), 0.0))


class Index:
    """Examples (doc_id, label, terms, weights of length one) in blocks: postings of rare terms, and by block the weights and the
    largest weight of each common one."""

    def __init__(self, examples: list[tuple[int, int, np.ndarray, np.ndarray]], terms: int):
        examples = sorted((e for e in examples if len(e[2])), key=lambda e: (int(e[2][np.argmax(e[3])]), e[0]))
        self.doc_ids, self.labels = np.array([e[0] for e in examples], np.int64), np.array([e[1] for e in examples], float)
        row = np.repeat(np.arange(len(examples)), [len(e[2]) for e in examples])
        term, weight = (np.concatenate([e[i] for e in examples]) if examples else np.zeros(0, kind) for i, kind in ((2, np.int64), (3, float)))
        order = np.lexsort((row, term))
        self.rows, self.weights, self.first = row[order], weight[order], np.searchsorted(term[order], np.arange(terms + 1))
        held = np.diff(self.first)
        self.column = np.full(terms, -1)
        common = np.flatnonzero(held > COMMON * len(examples))
        self.column[common] = np.arange(len(common))
        self.blocks = -(-len(examples) // BLOCK)
        self.dense = None

    def _by_block(self) -> None:
        self.dense = np.zeros((self.blocks * BLOCK, int(self.column.max(initial=-1)) + 1))
        for i in np.flatnonzero(self.column >= 0):
            own = slice(self.first[i], self.first[i + 1])
            self.dense[self.rows[own], self.column[i]] = self.weights[own]
        self.dense = self.dense.reshape(self.blocks, BLOCK, -1)
        self.highest = self.dense.max(1) if self.blocks else np.zeros((0, self.dense.shape[2]))

    def nearest(self, ids: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest_of([(ids, weights)], k)[0]

    def nearest_of(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each vector (terms, weights), rows and similarities of the k nearest examples with a similarity above zero.  Vectors that visit a block do so together."""
        if not self.blocks:
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(vectors)
        if self.dense is None:
            self._by_block()
        return [found for at in range(0, len(vectors), TOGETHER) for found in self._nearest(vectors[at : at + TOGETHER], k)]

    def _nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n, width = len(vectors), self.blocks * BLOCK
        who, ids, weights = np.repeat(np.arange(n), [len(i) for i, _ in vectors]), np.concatenate([i for i, _ in vectors]), np.concatenate([w for _, w in vectors])
        column = self.column[ids]
        held = column >= 0
        query = np.zeros((n, self.dense.shape[2]))
        query[who[held], column[held]] = weights[held]
        rare, own, mine = ids[~held], weights[~held], who[~held] * width
        m = self.first[rare + 1] - self.first[rare]
        at = np.repeat(self.first[rare] - np.cumsum(m) + m, m) + np.arange(m.sum())
        partial = np.bincount(self.rows[at] + np.repeat(mine, m), np.repeat(own, m) * self.weights[at], n * width).reshape(n, self.blocks, BLOCK)
        bound = partial.max(2) + query @ self.highest.T
        best = np.zeros(bound.shape, bool)
        np.put_along_axis(best, np.argsort(-bound, 1, kind="stable")[:, :FIRST], True, 1)
        sims, least = np.zeros(partial.shape), np.zeros((n, 1))
        for visit in (best, ~best):  # the best blocks give a k-th similarity, which rules most others out
            visit &= (bound > 0) & (bound >= least)
            for b in np.flatnonzero(visit.any(0)):
                by = np.flatnonzero(visit[:, b])
                sims[by, b] = np.round(partial[by, b] + query[by] @ self.dense[b].T, 12)
            flat = sims.reshape(n, width)
            kth = np.partition(flat, width - k, 1)[:, width - k] if width > k else np.zeros(n)
            least = np.where(kth > 0, kth - 1e-12, 0.0)[:, None]
        for row, low in zip(flat, kth, strict=True):
            rows = np.flatnonzero(row >= max(low, 1e-300))
            rows = rows[np.argsort(-row[rows], kind="stable")[:k]]
            yield rows, row[rows]

    def share(self, ids: np.ndarray, weights: np.ndarray, k: int) -> tuple[float, np.ndarray, np.ndarray]:
        return self.shares([(ids, weights)], k)[0]

    def shares(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """The share of the votes for toxicity, each as heavy as its similarity; -1 without a neighbour."""
        return [((float(sims @ self.labels[rows] / sims.sum()) if len(rows) else -1.0), rows, sims) for rows, sims in self.nearest_of(vectors, k)]


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Increasing steps fitted to y by pooling neighbours that violate the order; each step's mean leans
    to a half by one row."""
    own, at = np.unique(x, return_inverse=True)  # rows with equal x are one
    pools: list[list[float]] = []
    for a, b, w in zip(own.tolist(), np.bincount(at, y * weight).tolist(), np.bincount(at, weight).tolist(), strict=True):
        pools.append([a, b, w])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            _, b, n = pools.pop()
            pools[-1][1] += b
            pools[-1][2] += n
    return np.array([p[0] for p in pools]), np.array([(p[1] + 0.5) / (p[2] + 1) for p in pools])


class Model:
    """``known`` holds shares of votes, -1 for none, labels and weights of rows that are not in the index."""

    def __init__(self, terms: Terms, weights: np.ndarray, index: Index):
        self.terms, self.weights, self.index = terms, weights, index
        self.at = self.means = np.zeros(0)
        self.prior = NO_MODEL

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of a text's vector of length one."""
        ids, n, other = self.terms.counts(text)
        w = np.sqrt(n) * self.weights[ids]
        return ids, w / math.sqrt(float(w @ w) + other or 1.0)

    def calibrate(self, known: pd.DataFrame) -> None:
        if len(known):
            self.prior = min(NO_MODEL, (float(known.toxic @ known.weight) + 0.5) / (float(known.weight.sum()) + 1))
        known = known[known.share >= 0]
        self.at, self.means = isotonic(*(known[c].to_numpy(float) for c in ("share", "toxic", "weight")))

    def votes(self, texts: Sequence[str]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        return self.index.shares([self.vector(text) for text in texts], NEIGHBOURS)

    def scores(self, texts: Sequence[str]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        for share, rows, sims in self.votes(texts):
            if share < 0 or not len(self.at):
                yield self.prior, rows, sims
                continue
            step = self.means[max(0, int(np.searchsorted(self.at, share, "right")) - 1)]
            yield float(min(1.0, max(0.0, step * 0.999 + share * 0.001))), rows, sims


def trained(docs: DataFrame, labelled: DataFrame) -> Model:
    """``docs`` has doc_id and text; ``labelled`` has doc_id and toxic."""
    sc = docs.sparkSession.sparkContext
    rows = sampled(docs, labelled)
    chosen = rows.where("in_index").select("doc_id", "text", "toxic").toPandas().sort_values("doc_id")  # bounded
    terms = Terms(sorted({w for text in chosen.text for w in words_in(text)}))
    held = sc.broadcast(terms)
    other, toxic = texts_with(rows.where("in_sample"), held, "toxic")
    n_other, n_toxic = (rows.where("in_sample").where(F.col("toxic") == t).count() for t in (0, 1))
    frequency = texts_with(docs.withColumn("all_", F.lit(0)), held, "all_")[0]
    weights = (np.log((1 + docs.count()) / (1 + frequency)) + 1) * (1 + LEAN * leaning(toxic, other, n_toxic, n_other))
    model = Model(terms, weights, Index([], len(weights)))
    model.index = Index([(i, t, *model.vector(text)) for i, text, t in zip(chosen.doc_id, chosen.text, chosen.toxic, strict=True)], len(weights))
    ready = sc.broadcast(model)

    def shares(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"share": [v[0] for v in ready.value.votes(frame.text)], "toxic": frame.toxic, "weight": frame.weight})

    apart = rows.where("in_calibration").select("text", "toxic", "weight")
    model.calibrate(apart.mapInPandas(shares, "share double, toxic int, weight double").toPandas())  # bounded
    return model


def scored(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """``doc_id, score, evidence`` for every document, learnt from ``labelled`` (doc_id, toxic); the evidence is
    the nearest examples: doc_id, similarity and label."""
    docs = documents(docs)
    labelled = once_each(labelled.where(F.col("toxic").isNotNull()).select("doc_id", (-F.col("toxic")).alias("t")), "doc_id", "t")
    labelled = labelled.select("doc_id", F.when(F.col("t") < 0, 1).otherwise(0).alias("toxic"))
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labelled))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for frame in frames:
            scores, evidence = [], []
            for s, rows, sims in m.scores(frame.text):
                scores.append(s)
                evidence.append([{"doc_id": int(m.index.doc_ids[r]), "similarity": float(x), "label": int(m.index.labels[r])} for r, x in zip(rows[:3], sims[:3], strict=True)])
            yield pd.DataFrame({"doc_id": frame.doc_id, "score": scores, "evidence": evidence})

    return docs.mapInPandas(score, "doc_id long, score double, evidence array<struct<doc_id:long,similarity:double,label:int>>")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    found = scored(table(spark, sf_dir, "documents"), labels)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
