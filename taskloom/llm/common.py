"""Shared pieces of the training-data operators: tables, checkpoints, Arrow text batches, hashes.

Rules that hold for every operator of this subpackage:

* ``doc_id`` is the key of ``documents``.  Rows whose ``doc_id`` is null take no part.  Where a
  ``doc_id`` is repeated, one row stands for it: the one with the smallest text (null counts as
  the empty text).  ``documents`` below applies both rules.
* A null text is an empty text.
* Columns other than those an operator names are ignored by it, whatever they are called.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; a single longer text is a step of its own.
STEP_BYTES = 1 << 19
#: Rows of texts that are handed to Python at once.
BATCH_ROWS = 1000
#: Ids up to which a set of documents is broadcast, some 20 MB; larger sets are joined by a shuffle.
FEW_IDS = 500_000
#: A key with more than this part of all rows is dealt to many tasks.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder, as queries and stages read it; as texts are long, they have few of them in a batch for Python.  Operators
    called with other tables leave the session's settings alone.  A table of fewer splits than cores is dealt to all cores."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where none is named and all tasks run in this process, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="spark-taskloom-"))
        named = _OWN[0]
    return named.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: the rows as a Parquet table in the shared folder, read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/taskloom/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once_each(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row for each non-null key, with the smallest value where a key is repeated.

    Only the key column is shuffled to find out whether any is repeated; the rows are aggregated
    only then.
    """
    df = df.select(key, value).where(F.col(key).isNotNull())
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)
    if repeated.count():
        df = df.groupBy(key).agg(F.min(value).alias(value))
    return df


def documents(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` by the rules above."""
    return once_each(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", "text")


def among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids``, distinct and written; texts stay where they are if those are few."""
    return docs.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, "doc_id", "left_semi")


def dealt_join(rows: DataFrame, values: DataFrame, key: list[str], n: str, by: str, ways: int = 64) -> DataFrame:
    """``rows`` joined with ``values``, which has each key once and in ``n`` how many rows it has; ``n`` is dropped.

    Keys with more than a ``HOT``-th of all those rows, hence fewer than ``HOT`` of them, are hot: their rows are dealt to ``ways`` tasks by a
    hash of ``by`` and their values go to all of these, so no task gets all the rows of a key.
    """
    most = (values.agg(F.sum(n)).first()[0] or 0) // HOT + 1000
    hot = values.where(F.col(n) > most)
    if not hot.take(1):
        return rows.join(values.drop(n), key)
    salt = F.pmod(F.xxhash64(F.col(by)), F.lit(ways)).cast("int")
    rows = rows.join(F.broadcast(hot.select(*key, F.lit(True).alias("hot_"))), key, "left").withColumn("salt_", F.when(F.col("hot_"), salt).otherwise(0)).drop("hot_")
    values = values.withColumn("salt_", F.explode(F.when(F.col(n) > most, F.sequence(F.lit(0), F.lit(ways - 1))).otherwise(F.array(F.lit(0)))))
    return rows.join(values.drop(n), [*key, "salt_"]).drop("salt_")


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about ``limit`` bytes of text, or one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)
    released()


def released() -> None:
    """Gives back what a task's arrays took.  Spark keeps a Python worker for the next task, and one that waits while the JVM works would hold all of it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def compressed(docs: DataFrame) -> DataFrame:
    """``doc_id, z``: the texts as Zstandard frames, for shuffles that carry whole texts."""

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in steps(batches):
            z = [press.compress(t.as_buffer()) for t in batch.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(z, pa.binary())], names=["doc_id", "z"])

    return docs.mapInArrow(press, "doc_id long, z binary")


def expanded(column: pa.Array) -> pa.Array:
    """The texts of Zstandard frames."""
    press = zstandard.ZstdDecompressor()
    return pa.array([press.decompress(z.as_buffer()) for z in column], pa.large_binary()).cast(pa.large_string())


_U = np.uint64
#: The Mersenne prime of the hashes, and their two bases.
PRIME = _U((1 << 61) - 1)
BASES = (1_370_184_502_914_865_337, 2_097_332_180_651_476_019)
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo ``PRIME`` of numbers below it, from halves of 31 bits."""
    a1, a0, b1, b0 = a >> _U(31), a & _U(0x7FFFFFFF), b >> _U(31), b & _U(0x7FFFFFFF)
    middle = a1 * b0 + a0 * b1
    return reduced((a1 * b1 << _U(1)) + (middle >> _U(30)) + ((middle & _U(0x3FFFFFFF)) << _U(31)) + a0 * b0)


def reduced(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> _U(61))
    return np.where(x >= PRIME, x - PRIME, x)


def _powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of a base, or of its inverse."""
    have = _POWERS.get((base, inverse))
    if have is None or len(have) < n:
        step = pow(BASES[base], -1, int(PRIME)) if inverse else BASES[base]
        have = np.ones(1, np.uint64)
        while len(have) < max(n, 1 << 16):
            have = np.concatenate([have, times(have, _U(pow(step, len(have), int(PRIME))))])
        if n <= STEP_BYTES * 4:
            _POWERS[base, inverse] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = 0, size: np.ndarray | None = None) -> np.ndarray:
    """Hashes of values[start:end] for all the spans at once, from prefix sums: polynomials modulo a prime, so that two spans of n values that differ
    collide for at most n of 2^61 bases.  Hashes of one base and those of the other collide independently.  ``size`` goes in place of the number of values."""
    term = times(reduced(values), _powers(base, len(values)))
    sums = np.zeros((2, len(values) + 1), np.uint64)  # of both halves, as the whole would overflow
    np.cumsum(term & _U(0xFFFFFFFF), out=sums[0, 1:])
    np.cumsum(term >> _U(32), out=sums[1, 1:])
    low, high = sums[:, end] - sums[:, start]
    there = reduced(((high & _U(0x1FFFFFFF)) << _U(32)) + (high >> _U(29)) + reduced(low))
    there = times(there, _powers(base, len(values) + 1, True)[start])
    return mixed(there ^ (end - start if size is None else size).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


#: Space and the control characters 9 to 13.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes other than white space, row by row."""
    return runs(~WHITE[data], offsets)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes inside, row by row."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(inside))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = 0) -> np.ndarray:
    """Hashes of the bytes of spans, taken as numbers of seven bytes, which are below the prime."""
    size = end - start
    n = -(-size // 7)
    last = np.cumsum(n)
    number = np.arange(last[-1] if len(n) else 0) - np.repeat(last - n, n)
    at, left = np.repeat(start, n) + number * 7, np.repeat(size, n) - number * 7
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))[at]
    seven = eight & ((_U(1) << (np.minimum(left, 7) * 8).astype(np.uint64)) - _U(1))
    return span_hashes(seven, last - n, last, base, size)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A to Z become a to z; all other bytes stay."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)
