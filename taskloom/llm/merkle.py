"""A Merkle manifest of a dataset: a tree of digests over the rows of each group, a root over the groups, and a proof for every row.

1. Leaves are SHA-256 digests of a row's columns, each with its length in front, computed in the JVM.  All digests are lowercase hex text.
2. Leaves are put in order by a range partitioning, and get their places from the sizes of the partitions; no group has to fit a task.
3. Each tree's leaves are cut into aligned blocks of ``FANOUT ** DEPTH`` nodes.  A block is a contiguous numpy matrix, 64 bytes a row; it is
   reshaped by the fanout and its rows are hashed, level by level.  In a tree of several blocks each block gives one node, ``DEPTH`` levels
   up, and these are cut into blocks again, until every tree has one; a tree of one block ends when one node is left.
4. The same is done with the groups' roots.
5. Going down again, a node's siblings at each level follow from its index alone: at level l the node is ``i >> 3 l``, its run ``i >> 3 (l + 1)``.
   A proof is all siblings from the leaf to the root.  Each row's root is recomputed from its leaf, or a leaf that is given instead, and the proof.

Cases: null columns are hashed as ``-``, which no value is; a null key sorts first; rows whose key is repeated are leaves each, in order of their
digests; equal rows have equal leaves and places of their own; a null group is a group, the first; an empty table gives an empty result; further columns
are ignored.  Every row is a leaf; none is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskloom.llm.common import partitions, raw, table, written

FANOUT, DEPTH = 8, 4
HEX = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: For each place in a run the places of its siblings.
OTHERS = np.array([[j for j in range(FANOUT) if j != i] for i in range(FANOUT)])
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = "array<struct<at:int,others:binary>>"


def digest_of(*columns: Column) -> Column:
    """The digest of a row: each column as its length in bytes, a colon and its text; a null one is ``-``."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``place``, counted from 0 in that order over the whole table; only a number for each partition meets in one task."""
    rows = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    rows = written(rows.withColumn("at_", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumn("part_", F.shiftright("at_", 33))
    sizes = rows.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("part_", before.alias("before_")))  # a row for each partition
    return rows.join(starts, "part_").withColumn("place", F.col("before_") + F.col("at_").bitwiseAND((1 << 33) - 1)).drop("at_", "part_", "before_")


def hashed(runs: np.ndarray, last: int = FANOUT) -> np.ndarray:
    """Digests of runs (rows of ``FANOUT`` digests each); the last one has only ``last``."""
    found = [sha256(r).hexdigest() for r in runs[:-1]]
    if len(runs):
        found.append(sha256(runs[-1][: last * HEX]).hexdigest())
    return np.frombuffer("".join(found).encode(), np.uint8).reshape(-1, HEX)


def in_runs(level: np.ndarray) -> np.ndarray:
    """A level as a matrix of runs; the last run is padded with zeros."""
    short = -len(level) % FANOUT
    if short:
        level = np.concatenate([level, np.zeros((short, HEX), np.uint8)])
    return level.reshape(-1, FANOUT * HEX)


def levels(leaves: np.ndarray, n: int, depth: int) -> list[np.ndarray]:
    """The levels of a block from its leaves up to one node: until one is left if it is the only block of a tree of ``n`` nodes, else ``depth`` of them."""
    alone = n <= FANOUT**depth
    out = [np.ascontiguousarray(leaves)]
    while len(out[-1]) > 1 if alone else len(out) <= depth:
        out.append(hashed(in_runs(out[-1]), (len(out[-1]) - 1) % FANOUT + 1))
    return out


def siblings(level: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The other nodes of each node's run (n, 7, 64), and which of them there are."""
    run, at = node // FANOUT, node % FANOUT
    size = np.minimum(FANOUT, len(level) - run * FANOUT)
    return in_runs(level).reshape(-1, FANOUT, HEX)[run[:, None], OTHERS[at]], np.arange(FANOUT - 1) < (size - 1)[:, None]


def packed(nodes: DataFrame, depth: int) -> DataFrame:
    """``tree, block, n, keys, leaves, forged, top`` of nodes ``tree, place, n`` (nodes of the tree), ``key, leaf, forged``: a row for each block,
    ``top`` being its uppermost node."""
    size = FANOUT**depth

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by("place")
        n, place = rows.column("n")[0].as_py(), rows.column("place")[0].as_py()
        leaves = raw(rows.column("leaf").combine_chunks())[0].reshape(-1, HEX)
        top = levels(leaves, n, depth)[-1].tobytes().decode()
        held = {"tree": [rows.column("tree")[0].as_py()], "block": [place // size], "n": [n], "leaves": [leaves.tobytes()], "top": [top]}
        lists = {c: pa.ListArray.from_arrays([0, rows.num_rows], rows.column(c).combine_chunks()) for c in ("key", "forged")}
        return pa.table({"tree": held["tree"], "block": held["block"], "n": held["n"], "keys": lists["key"], "leaves": held["leaves"], "forged": lists["forged"], "top": held["top"]})

    schema = "tree long, block long, n long, keys array<long>, leaves binary, forged array<string>, top string"
    cut = nodes.select("tree", "place", "n", "key", "leaf", "forged", F.expr(f"place div {size}").alias("block"))
    return written(cut.groupBy("tree", "block").applyInArrow(pack, schema), "blocks")


def above(packs: DataFrame, depth: int) -> DataFrame:
    """``tree, block, path, root`` of every block: the steps from its uppermost node to the tree's root, and that root."""
    size = FANOUT**depth
    if (packs.agg(F.max("n")).first()[0] or 0) <= size:
        return packs.select("tree", "block", F.array().cast(STEP).alias("path"), F.col("top").alias("root"))
    n = F.expr(f"(n + {size - 1}) div {size}")
    nodes = packs.select("tree", F.col("block").alias("place"), n.alias("n"), F.lit(None).cast("long").alias("key"), F.col("top").alias("leaf"), F.lit(None).cast("string").alias("forged"))
    higher = packed(nodes, depth)

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                level = levels(np.frombuffer(row["leaves"], np.uint8).reshape(-1, HEX), row["n"], depth)
                node = np.arange(len(level[0]))
                steps: list[list[dict]] = [[] for _ in node]
                for k, below in enumerate(level[:-1]):
                    at = node >> 3 * k
                    digests, there = siblings(below, at)
                    for i, step in enumerate(steps):
                        step.append({"at": int(at[i] % FANOUT), "others": digests[i][there[i]].tobytes()})
                paths = [[*step, *row["path"]] for step in steps]
                k = len(node)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["tree"]] * k, pa.int64()), pa.array(node + row["block"] * size, pa.int64()), pa.array(paths, PATH), pa.array([row["root"]] * k)], names=["tree", "block", "path", "root"]
                )

    return higher.join(above(higher, depth), ["tree", "block"]).select("tree", "block", "n", "leaves", "path", "root").mapInArrow(climb, f"tree long, block long, path {STEP}, root string")


PATH = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.binary())]))


def stepped(digest: bytes, path: list[dict]) -> bytes:
    """The node that a digest leads to along a path."""
    for step in path:
        cut = step["at"] * HEX
        digest = sha256(step["others"][:cut] + digest + step["others"][cut:]).hexdigest().encode()
    return digest


def refolded(level: list[np.ndarray], start: np.ndarray) -> np.ndarray:
    """The block's uppermost node as it comes from each leaf of ``start`` and the original siblings."""
    node, now = np.arange(len(start)), start
    for below in level[:-1]:
        run, at = node // FANOUT, node % FANOUT
        runs = in_runs(below).reshape(-1, FANOUT, HEX)[run]
        runs[np.arange(len(node)), at] = now
        short = (len(below) - 1) % FANOUT + 1 if len(below) % FANOUT else FANOUT
        cut = int((run < len(below) // FANOUT).sum())  # nodes of the last run, if that is short, come last
        flat = runs.reshape(len(node), -1)
        now = np.concatenate([hashed(flat[:cut]), np.frombuffer("".join(sha256(r[: short * HEX]).hexdigest() for r in flat[cut:]).encode(), np.uint8).reshape(-1, HEX)])
        node = run
    return now


TURNS = "array<struct<at:int,others:int>>"


def proofs(packs: DataFrame, depth: int) -> DataFrame:
    """``tree, key, leaf, proof, turns, folded`` of blocks with ``path`` to the uppermost root."""

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield block(batch.slice(i, 1))

    def block(one: pa.RecordBatch) -> pa.RecordBatch:
        path, n = one.column("path")[0].as_py(), one.column("n")[0].as_py()
        leaves = np.frombuffer(one.column("leaves")[0].as_py(), np.uint8).reshape(-1, HEX)
        level, node = levels(leaves, n, depth), np.arange(len(leaves))
        found, there, at, others = [], [], [], []
        for k, below in enumerate(level[:-1]):
            digests, known = siblings(below, node >> 3 * k)
            found.append(digests)
            there.append(known)
            at.append((node >> 3 * k) % FANOUT)
            others.append(known.sum(1))
        for step in path:
            digests = np.frombuffer(step["others"], np.uint8).reshape(1, -1, HEX)
            found.append(np.broadcast_to(digests, (len(node), *digests.shape[1:])))
            there.append(np.ones(found[-1].shape[:2], bool))
            at.append(np.full(len(node), step["at"]))
            others.append(np.full(len(node), digests.shape[1]))
        if not found:  # a lone leaf of a lone tree
            found, there = [np.zeros((len(node), 0, HEX), np.uint8)], [np.zeros((len(node), 0), bool)]
        known = np.concatenate(there, axis=1)
        data = np.concatenate(found, axis=1)[known]
        ends = np.r_[0, np.cumsum(known.sum(1) * HEX)].astype(np.int32)
        proof = pa.Array.from_buffers(pa.binary(), len(node), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
        steps = len(at)
        fields = [pa.array(np.array(x, np.int32).reshape(steps, len(node)).T.ravel(), pa.int32()) for x in (at, others)]
        turns = pa.ListArray.from_arrays(pa.array(np.arange(len(node) + 1, dtype=np.int32) * steps), pa.StructArray.from_arrays(fields, ["at", "others"]))
        forged = one.column("forged").flatten()
        start = leaves.copy()
        changed = np.flatnonzero(forged.is_valid().to_numpy(zero_copy_only=False))
        if len(changed):
            start[changed] = raw(forged.drop_null())[0].reshape(-1, HEX)
        tops, which = np.unique(refolded(level, start).view(f"S{HEX}").ravel(), return_inverse=True)
        roots = pa.array([stepped(bytes(t), path).decode() for t in tops]).take(pa.array(which.ravel()))
        text = pa.Array.from_buffers(pa.string(), len(node), [None, pa.py_buffer(np.arange(len(node) + 1, dtype=np.int32) * HEX), pa.py_buffer(leaves.tobytes())])
        trees = pa.array(np.full(len(node), one.column("tree")[0].as_py()), pa.int64())
        same = [pa.array([one.column(c)[0].as_py()] * len(node), pa.string()) for c in ("subroot", "root")]
        return pa.RecordBatch.from_arrays([trees, one.column("keys").flatten(), text, *same, proof, turns, roots], names=["tree", "key", "leaf", "subroot", "root", "proof", "turns", "folded"])

    return packs.select("tree", "n", "keys", "leaves", "forged", "path", "subroot", "root").mapInArrow(
        prove, f"tree long, key long, leaf string, subroot string, root string, proof binary, turns {TURNS}, folded string"
    )


def manifest(rows: DataFrame, columns: tuple[str, ...] = COLUMNS, tree: str = "lang", key: str = "doc_id", instead: dict[str, Column] | None = None, depth: int = DEPTH) -> DataFrame:
    """``key, leaf, subroot, root, proof, turns, folded_root, verified`` of every row.  Leaves are digests of ``columns``; rows with an equal ``tree`` form one, in
    order of the integer ``key``.  ``proof`` holds the siblings from the leaf to the root as one text; ``turns`` has, for each level, the node's place in its run
    and how many siblings it has there.  ``instead`` gives other values for some columns, null to keep the row as it is: ``folded_root`` is then
    computed from the leaf that they lead to."""
    own = digest_of(*(F.col(c) for c in columns))
    forged = F.lit(None).cast("string")
    if instead:
        changed = F.greatest(F.lit(0), *(v.isNotNull().cast("int") for v in instead.values()))
        forged = F.when(changed > 0, digest_of(*(F.coalesce(instead[c], F.col(c)) if c in instead else F.col(c) for c in columns)))
    leaves = rows.select(F.col(tree).cast("string").alias("group_"), F.col(key).cast("long").alias("key"), own.alias("leaf"), forged.alias("forged"), F.monotonically_increasing_id().alias("tie_"))
    order = [F.col("group_").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf"), F.col("tie_")]
    leaves = placed(written(leaves, "leaves"), order).drop("tie_")
    groups = leaves.groupBy("group_").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n"))
    groups = placed(groups, [F.col("start")]).withColumnRenamed("place", "tree")  # as many rows as groups
    lone = groups.count()
    joined = leaves.join(groups, leaves["group_"].eqNullSafe(groups["group_"]))
    nodes = joined.select("tree", (F.col("place") - F.col("start")).alias("place"), "n", "key", "leaf", "forged")
    packs = packed(nodes, depth)
    within = written(above(packs, depth), "paths")
    tops = within.where("block = 0").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(lone).cast("long").alias("n"), F.col("tree").alias("key"), F.col("root").alias("leaf"), F.lit(None).cast("string").alias("forged"))
    crown = packed(tops, depth)
    crown = proofs(crown.join(above(crown, depth), ["tree", "block"]).withColumn("subroot", F.col("root")), depth)
    over = written(crown.select(F.col("key").alias("tree"), "root", "proof", "turns"), "crown")
    whole = packs.join(within.withColumnRenamed("root", "subroot"), ["tree", "block"]).join(over, "tree")
    # the steps from the group's root on, as those below are
    start = F.aggregate(F.col("turns"), F.array(F.lit(1)), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + t["others"] * HEX)))
    rest = F.transform(F.arrays_zip(F.col("turns").alias("t"), F.slice(start, 1, F.size("turns")).alias("s")), lambda x: F.struct(x["t"]["at"].alias("at"), F.substring(F.col("proof"), x["s"], x["t"]["others"] * HEX).alias("others")))
    whole = whole.withColumn("path", F.concat("path", rest.cast(STEP)))
    found = proofs(whole, depth)
    return found.select("key", "leaf", "subroot", "root", "proof", "turns", F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def folded(leaf: Column, proof: Column, turns: Column) -> Column:
    """The root that a leaf and its proof lead to, for checking single rows."""
    zero = F.struct(leaf.alias("d"), F.lit(1).alias("at"))

    def step(a: Column, t: Column) -> Column:
        text, cut = proof.cast("string"), t["at"] * HEX
        run = F.concat(F.substring(text, a["at"], cut), a["d"], F.substring(text, a["at"] + cut, t["others"] * HEX - cut))
        return F.struct(F.sha2(run, 256).alias("d"), (a["at"] + t["others"] * HEX).alias("at"))

    return F.aggregate(turns, zero, step, lambda a: a["d"])


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lower = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", UPPER, LOWER))
    found = manifest(table(spark, sf_dir, "documents"), instead={"text": lower})
    return found.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


OP11_SQL = r"""
WITH RECURSIVE leaf AS (
  SELECT *, sha256(a || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n,
    sha256(a || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END) AS low
  FROM (SELECT doc_id, lang, text, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
    || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS a FROM documents)
), crc AS (
  SELECT doc_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b:
    list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) AS crc FROM documents
), t AS (
  SELECT lang, 0 AS lvl, pos AS i, n, leaf AS d FROM leaf
  UNION ALL SELECT lang, lvl + 1, i // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY lang, lvl, i // 8, n
), sub AS (
  SELECT lang, d, lvl, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS k, count(*) OVER () AS n FROM t WHERE n = 1
), r AS (
  SELECT 0 AS lvl, k AS i, n, d FROM sub UNION ALL SELECT lvl + 1, i // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY i)) FROM r WHERE n > 1 GROUP BY lvl, i // 8, n
), every AS (
  SELECT k, t.lvl AS lvl, i, t.d FROM t JOIN sub ON sub.lang IS NOT DISTINCT FROM t.lang WHERE t.n > 1 UNION ALL SELECT k, 1000 + r.lvl, r.i, r.d FROM r CROSS JOIN (SELECT k FROM sub) s WHERE r.n > 1
), lvls AS (
  SELECT DISTINCT k, lvl FROM every
), own AS (
  SELECT l.doc_id, l.leaf, s.k, s.d AS subroot, v.lvl, CASE WHEN v.lvl < 1000 THEN l.pos // CAST(8 ** v.lvl AS BIGINT) ELSE s.k // CAST(8 ** (v.lvl - 1000) AS BIGINT) END AS here FROM leaf l JOIN sub s ON s.lang IS NOT DISTINCT FROM l.lang JOIN lvls v ON v.k = s.k
), step AS (
  SELECT o.doc_id, o.lvl, coalesce(string_agg(CASE WHEN e.i < here THEN e.d END, '' ORDER BY e.i), '') AS l, coalesce(string_agg(CASE WHEN e.i > here THEN e.d END, '' ORDER BY e.i), '') AS r
  FROM own o JOIN every e ON e.k = o.k AND e.lvl = o.lvl AND e.i // 8 = o.here // 8 GROUP BY o.doc_id, o.lvl
), path AS (
  SELECT doc_id, list(l || '|' || r ORDER BY lvl) AS path, string_agg(l || r, '' ORDER BY lvl) AS proof FROM step GROUP BY doc_id
), whole AS (
  SELECT l.doc_id, l.leaf, s.d AS subroot, (SELECT d FROM r WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_prepend(CASE WHEN crc % 3 = 0 THEN l.low ELSE l.leaf END, coalesce(path, [])), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root
  FROM leaf l JOIN sub s ON s.lang IS NOT DISTINCT FROM l.lang JOIN crc c ON c.doc_id = l.doc_id LEFT JOIN path p ON p.doc_id = l.doc_id
)
SELECT *, folded_root = root AS verified FROM whole
"""
