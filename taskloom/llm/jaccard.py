"""N-gram Jaccard join: documents whose shingle sets have a Jaccard similarity of at least ``percent``/100.

A document's set holds the distinct sequences of ``size`` words (lower-cased A-Z) of its whole text; a text of fewer
words, but not none, is one sequence.  The join is a count-vector R-tree over groups of shingles.

1. Documents with equal sets are one point; its *representative* is the smallest doc_id.
2. Shingles are hashed into groups, a half to a quarter as many as there are shingles (below 84 percent, all to a half).  Two sets of that similarity differ
   in at most ``gap`` shingles, hence in at most that many groups: of the first ``gap`` + 1 non-empty groups, in hash
   order of their contents, some group is the same in both sets.  So (group, contents) is a *cell* of the index
   space, and points are only compared with those of their cells.  The number of groups goes with the set's size,
   in powers of two; a point near such a power from below is also filed under the next.  Sets of fewer than
   ``FEW`` shingles are filed by single shingles, to the same effect.
3. Every point is joined to the least point of each of its cells.  Verified links are connected into classes.
4. In cells that still hold several classes, points are packed into an R-tree (size and coarse group counts are
   the coordinates), and its leaves are joined across classes: two leaves, then two points, can only hold a link if the
   summed coordinate minima (of the leaves' upper corners) reach the overlap needed.  Surviving pairs are
   verified on the exact sets.  Pairs within one class need no comparison: they cannot change the classes.

Large cells are dealt out in blocks of ``TILE`` points, so no task holds a whole cell: blocks of the points outside the cell's
largest class meet each other and the blocks of that class.  A cell of near copies is one class after step 3, or nearly.

Cases: null and empty texts have no shingles and link with nothing; repeated and null ``doc_id`` as in ``common``; ties
of equal sets go to the smallest doc_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.llm.common import STEP_BYTES, among, compressed, documents, expanded, lower_ascii, mixed, raw, released, signed, span_hashes, steps, table, word_hashes, words, written
from taskloom.llm.components import components

SIZE, PERCENT = 4, 85
#: Sets below this are filed by single shingles.
FEW = 64
#: Coordinates of a point, points of a leaf, points of a block of a large cell.
COORDINATES, LEAF, TILE = 256, 16, 1024
_U = np.uint64


def shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct shingles of each text, in that order."""
    data, offsets = raw(column)
    data = lower_ascii(data)
    start, end, row = words(data, offsets)
    hashes = word_hashes(data, start, end)
    n = np.bincount(row, minlength=len(column))
    first = np.cumsum(n) - n
    at = np.flatnonzero(row[: max(0, len(row) - size + 1)] == row[size - 1 :]) if len(row) >= size else np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < size))
    a, b = np.r_[at, first[short]], np.r_[at + size, first[short] + n[short]]
    found, own = span_hashes(hashes, a, b), np.r_[row[at], short]
    order = np.lexsort((found, own))
    found, own = found[order], own[order]
    new = np.r_[True, (found[1:] != found[:-1]) | (own[1:] != own[:-1])] if len(found) else np.zeros(0, bool)
    return own[new], found[new]


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first) if len(first) else np.zeros(0, values.dtype)


def cells_of(row: np.ndarray, found: np.ndarray, rows: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and cell of every point: enough cells that linked sets share one.

    That takes more non-empty groups than ``gap``.  Of m groups, m (1 - exp(-n / m)) hold shingles: 0.24 n at
    four shingles a group and 0.43 n at two, while ``gap`` is 0.18 n at 85 percent and 0.33 n at 75; a set of 64
    shingles or more misses that by ten standard deviations or more, which is hash-collision rare.
    """
    if percent < 75:
        raise ValueError("sets less than 75 percent similar need more groups than this files them under")
    n = np.bincount(row, minlength=rows)
    out_row, out_cell = [], []
    # few shingles: A without B has at most (100 - percent) |A| / 100 elements
    few = (n > 0) & (n < FEW)
    level_of = lambda k: np.floor(np.log2(np.maximum(k, 1))).astype(np.int64)
    keep = few[row]
    r, f = row[keep], mixed(found[keep] ^ _U(0x2545F4914F6CDD1D))
    order = np.lexsort((f, r))
    r, f = r[order], f[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    pick = rank <= n[r] * (100 - percent) // 100
    out_row.append(r[pick])
    out_cell.append(f[pick])
    # more: a set that may be linked to a larger one is filed under that one's level, too
    reach = (n * 100) // percent
    low, high = level_of(n), level_of(reach)
    for level, members in ((low, n >= FEW), (high, (reach >= FEW) & (n > 0) & ((high > low) | (n < FEW)))):
        keep = members[row]
        r, f = row[keep], found[keep]
        if not len(r):
            continue
        groups = (_U(1) << level[r].astype(np.uint64)) >> _U(percent >= 84)
        g = mixed(f ^ _U(0x9FB21C651E98DF25)) % groups
        order = np.lexsort((g, r))
        r, f, g = r[order], f[order], g[order]
        first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (r[1:] != r[:-1])])
        held = sums(mixed(f ^ _U(0xD1B54A32D192ED03)), first)
        r, g = r[first], g[first]
        cell = mixed(held ^ mixed(g ^ (level[r].astype(np.uint64) << _U(40))))
        order = np.lexsort((cell, r))
        r, cell = r[order], cell[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        pick = rank <= n[r] * (100 - percent) // percent
        out_row.append(r[pick])
        out_cell.append(cell[pick])
    return np.concatenate(out_row), np.concatenate(out_cell)


def digests(row: np.ndarray, found: np.ndarray, rows: int) -> list[np.ndarray]:
    """Two 64-bit digests of each set."""
    some = np.unique(row)
    first, out = np.searchsorted(row, some), []
    for salt in (_U(0x51ED270B0A1F39C1), _U(0xB492B66FBE98F273)):
        total = np.zeros(rows, np.uint64)
        total[some] = sums(mixed(found ^ salt), first)
        out.append(total)
    return out


def profiles(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``doc_id, n, s1, s2, cells, counts``: the size of each set, digests of it, its cells, and its coordinates
    as bytes, or as 4 bytes each if any needs more."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            rows = batch.num_rows
            row, found = shingles(batch.column("text"), size)
            n = np.bincount(row, minlength=rows).astype(np.int64)
            own, cell = cells_of(row, found, rows, percent)
            order = np.argsort(own, kind="stable")
            cuts = pa.array(np.searchsorted(own[order], np.arange(rows + 1)).astype(np.int32))
            cells = pa.ListArray.from_arrays(cuts, pa.array(signed(cell[order])))
            place = row * COORDINATES + (found >> _U(17)).astype(np.int64) % COORDINATES
            counts = np.bincount(place, minlength=rows * COORDINATES).astype(np.uint32).reshape(rows, COORDINATES)
            packed = pa.array([(c.astype(np.uint8) if high < 256 else c).tobytes() for c, high in zip(counts, counts.max(1, initial=0), strict=True)], pa.binary())
            two = [pa.array(signed(x)) for x in digests(row, found, rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *two, cells, packed], names=["doc_id", "n", "s1", "s2", "cells", "counts"])

    return docs.mapInArrow(describe, "doc_id long, n long, s1 long, s2 long, cells array<long>, counts binary")


def unpacked(counts: list[bytes]) -> np.ndarray:
    """The coordinates of points, a row each."""
    wide = [np.frombuffer(c, np.uint8 if len(c) == COORDINATES else np.uint32) for c in counts]
    return np.array(wide, np.int32).reshape(-1, COORDINATES)


def possible(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``a, b`` whose summed coordinate minima allow a link."""
    left, right = (points.select(F.col("doc_id").alias(x), F.col("counts").alias(f"counts_{x}")) for x in "ab")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ca, cb = (unpacked(batch.column(c).to_pylist()) for c in ("counts_a", "counts_b"))
            bound = np.minimum(ca, cb).sum(1)
            keep = pa.array(100 * bound >= percent * (ca.sum(1) + cb.sum(1) - bound))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])
        released()

    return pairs.join(left, "a").join(right, "b").mapInArrow(test, "a long, b long")


def verified(pairs: DataFrame, held: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the pairs ``a, b`` whose sets are similar enough, by counting; ``held`` has compressed texts."""
    left, right = (held.select(F.col("doc_id").alias(x), F.col("z").alias(f"z_{x}")) for x in "ab")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_length(batch):
                keep = pa.array(alike(expanded(part.column("z_a")), expanded(part.column("z_b"))))
                yield pa.RecordBatch.from_arrays([part.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])
        released()

    def by_length(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Cut so that the two texts of all pairs have about ``STEP_BYTES``, or a part is one pair."""
        size = [sum(zstandard.frame_content_size(batch.column(c)[i].as_buffer()) for c in ("z_a", "z_b")) for i in range(batch.num_rows)]
        part = np.cumsum(size, dtype=np.int64) // STEP_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        return (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if a < b)

    def alike(a: pa.Array, b: pa.Array) -> np.ndarray:
        (row_a, a_found), (row_b, b_found) = shingles(a, size), shingles(b, size)
        n = np.bincount(row_a, minlength=len(a)) + np.bincount(row_b, minlength=len(a))
        row, found = np.r_[row_a, row_b], np.r_[a_found, b_found]
        order = np.lexsort((found, row))
        row, found = row[order], found[order]
        both = np.bincount(row[1:][(row[1:] == row[:-1]) & (found[1:] == found[:-1])], minlength=len(a))
        return (n > 0) & (100 * both >= percent * (n - both))

    return pairs.join(left, "a").join(right, "b").mapInArrow(test, "a long, b long")


def leaves(counts: np.ndarray, depth: int = 0) -> list[np.ndarray]:
    """Sort-tile packing: halves along the coordinate of the widest spread until a leaf is full."""
    stack, out = [np.arange(len(counts))], []
    while stack:
        own = stack.pop()
        if len(own) <= LEAF:
            out.append(own)
            continue
        widest = int(np.argmax(counts[own].max(0) - counts[own].min(0)))
        order = own[np.argsort(counts[own, widest], kind="stable")]
        stack += [order[: len(own) // 2], order[len(own) // 2 :]]
    return out


def tree_pairs(ids: np.ndarray, classes: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of ids of different classes whose summed coordinate minima allow a link."""
    n = counts.sum(1)
    boxes = leaves(counts)
    top = np.array([counts[x].max(0) for x in boxes])
    least = np.array([n[x].min() for x in boxes])
    out = []
    for i, own in enumerate(boxes):
        bound = np.minimum(top[i], top[i:]).sum(1)
        for j in i + np.flatnonzero(100 * bound >= percent * (least[i] + least[i:] - bound)):
            other = boxes[j]
            bound = np.minimum(counts[own][:, None], counts[other][None]).sum(2)
            fits = (100 * bound >= percent * (n[own][:, None] + n[other][None] - bound)) & (classes[own][:, None] != classes[other][None])
            x, y = np.nonzero(fits)
            out.append(np.sort(np.stack([ids[own[x]], ids[other[y]]], 1), 1))
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)


def remaining(cells: DataFrame, classes: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """``a, b``: pairs in the cells that hold several classes, through their R-trees."""
    mine = cells.join(classes, "doc_id")
    several = mine.groupBy("cell").agg(F.min("class").alias("x"), F.max("class").alias("y"), F.count(F.lit(1)).alias("n")).where("x < y")
    mine = written(mine.join(several.select("cell", "n"), "cell").withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int")), "several")
    small = mine.where("tiles = 1").groupBy("cell").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    # cells with the same points are one
    small = small.groupBy("ids").agg(F.min("cell").alias("cell")).select("cell", F.lit(0).alias("i"), F.lit(0).alias("j"), F.explode("ids").alias("doc_id"))
    # of a large cell, each block of points outside its largest class meets all points, that class included
    count = mine.where("tiles > 1").groupBy("cell", "class").agg(F.count(F.lit(1)).alias("k"))
    major = count.groupBy("cell").agg(F.max_by("class", F.struct("k", "class")).alias("major"), (F.sum("k") - F.max("k")).alias("minor"))
    large = mine.where("tiles > 1").drop("tiles").join(major, "cell")
    large = large.withColumn("tiles", F.greatest(F.lit(1), F.ceil(F.col("minor") / TILE)).cast("int"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int")
    spread = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.ceil(F.col("n") / TILE)).cast("int")
    blocks = F.sequence(F.lit(0), F.col("tiles") - 1)
    is_major = F.col("class") == F.col("major")
    # key (i, j): block i of the others with block j of the others, or with block -1 - j of the largest class
    keys = F.when(is_major, F.transform(blocks, lambda i: F.struct(i.alias("i"), (-1 - spread).alias("j"))))
    with_others = F.transform(blocks, lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    with_major = F.transform(F.sequence(F.lit(0), F.ceil(F.col("n") / TILE).cast("int") - 1), lambda t: F.struct(own.alias("i"), (-1 - t).alias("j")))
    large = large.select("cell", "doc_id", F.explode(keys.otherwise(F.concat(with_others, with_major))).alias("key")).select("cell", "key.i", "key.j", "doc_id")
    rows = small.unionByName(large).join(classes, "doc_id").join(points.select("doc_id", "counts"), "doc_id")
    tree = ["cell", "i", "j"]
    trees = rows.select(*tree, "doc_id", "class", "counts").repartition(*tree).sortWithinPartitions(*tree)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in one_by_one(batches):
            pairs = tree_pairs(whole.column("doc_id").to_numpy(), whole.column("class").to_numpy(), unpacked(whole.column("counts").to_pylist()), percent)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
        released()

    def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """The rows of each tree, some 2 ``TILE`` points at most, as they follow each other; no more is held than those and a batch."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in tree])
            cuts = [0, *(np.flatnonzero((np.diff(key) != 0).any(0)) + 1).tolist(), batch.num_rows]
            same = bool(held) and all(held[-1].column(c)[-1] == batch.column(c)[0] for c in tree)
            if held and not same:
                yield pa.Table.from_batches(held)
                held = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                held.append(batch.slice(a, b - a))
                if b < batch.num_rows:
                    yield pa.Table.from_batches(held)
                    held = []
        if held:
            yield pa.Table.from_batches(held)

    return trees.mapInArrow(search, "a long, b long").distinct()


def similar(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every document."""
    docs = documents(docs)
    profile = written(profiles(docs, size, percent), "profiles")
    same = profile.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("point"))
    point_of = profile.select("doc_id", "n", "s1", "s2").join(same, ["n", "s1", "s2"], "left")
    point_of = written(point_of.select("doc_id", "n", F.coalesce("point", "doc_id").alias("point")), "points")
    points = point_of.where("doc_id = point and n > 0").select("doc_id")
    # copies are filed, too: the least of a cell is a point, as a copy's point is less and in the same cells
    filed = profile.select("doc_id", F.explode("cells").alias("cell"))
    least = filed.groupBy("cell").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("cell", "least")
    cells = written(filed.join(least, "cell"), "cells")
    star = cells.where("doc_id <> least").select("least", "doc_id").distinct().join(points, "doc_id", "left_semi")
    star = written(star.select(F.col("least").alias("a"), F.col("doc_id").alias("b")), "star")
    ids = written(star.select(F.col("a").alias("doc_id")).union(star.select("b")).distinct(), "ids")
    held = written(compressed(among(docs, ids)), "held")
    # written in between, so that no task runs two Python workers
    links = written(verified(written(possible(star, profile, percent), "possible"), held, size, percent), "links")
    classes = written(ids.join(components(links), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("class")), "classes")
    more = verified(written(remaining(cells.drop("least"), classes, profile, percent), "remaining"), held, size, percent)
    joined = components(written(links.unionByName(more), "links")).withColumnRenamed("doc_id", "point")
    return point_of.join(joined, "point", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "point").alias("component_id"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL
), s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 3], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), few AS (
  SELECT h FROM s GROUP BY h HAVING count(*) > 1
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM (SELECT * FROM s SEMI JOIN few USING (h)) a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 85 * (nx.n + ny.n - shared)
), both_ways AS (
  SELECT x, y FROM e UNION SELECT y, x FROM e
), reach AS (
  SELECT x AS doc_id, x AS c FROM both_ways UNION SELECT b.y, r.c FROM reach r JOIN both_ways b ON b.x = r.doc_id
), least AS (
  SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""
