"""Runs, gaps, hysteresis and nearest lookups over frames; all keyed, so recordings run side by side."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def over(keys: list[str], order: str = "frame_idx"):
    return Window.partitionBy(*keys).orderBy(order)


def backwards(keys: list[str], *order: str):
    return Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))


def gap_filled(df: DataFrame, keys: list[str], columns: list[str], max_gap: int, order: str = "frame_idx") -> DataFrame:
    """Linear interpolation of runs of nulls of at most ``max_gap`` frames between two values; ``filled`` marks them.
    The columns are null together."""
    # frames that grow with the rows are summed up once; one that ends at the last row would be read anew for each row, so the way back is descending
    before, after = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (over(keys, order), backwards(keys, order)))
    there = F.when(F.col(columns[0]).isNotNull(), F.struct(F.col(order).alias("i"), *columns))
    df = df.withColumn("p_", F.last(there, True).over(before)).withColumn("n_", F.last(there, True).over(after))
    fill = F.col(columns[0]).isNull() & F.col("p_").isNotNull() & F.col("n_").isNotNull() & (F.col("n_.i") - F.col("p_.i") - 1 <= max_gap)
    share = (F.col(order) - F.col("p_.i")) / (F.col("n_.i") - F.col("p_.i"))
    df = df.withColumn("filled", F.coalesce(fill, F.lit(False)))
    for c in columns:
        df = df.withColumn(c, F.when(F.col("filled"), F.col(f"p_.{c}") + (F.col(f"n_.{c}") - F.col(f"p_.{c}")) * share).otherwise(F.col(c)))
    return df.drop("p_", "n_")


def islands(df: DataFrame, keys: list[str], order: str = "frame_idx") -> DataFrame:
    """``frame_start, frame_end, n`` of the maximal runs of adjacent frames."""
    run = F.col(order) - F.row_number().over(over(keys, order))
    return df.withColumn("run_", run).groupBy(*keys, "run_").agg(F.min(order).alias("frame_start"), F.max(order).alias("frame_end"), F.count(F.lit(1)).alias("n")).drop("run_")


def hysteresis(df: DataFrame, keys: list[str], flag: Column, on: int, off: int, name: str, order: str = "frame_idx") -> DataFrame:
    """``name`` turns true after ``on`` rows in a row with the flag and false after ``off`` without; false at first.
    Only rows that are there count."""
    in_order = over(keys, order)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)  # all in one order, so the rows are sorted once
    df = df.withColumn("flag_", flag).withColumn("i_", F.row_number().over(in_order))
    df = df.withColumn("turn_", F.when(~F.lag("flag_").over(in_order).eqNullSafe(F.col("flag_")), F.col("i_")))
    df = df.withColumn("long_", F.col("i_") - F.max("turn_").over(so_far) + 1)
    signal = F.when(F.col("flag_") & (F.col("long_") >= on), True).when(~F.col("flag_") & (F.col("long_") >= off), False)
    state = F.coalesce(F.last(signal, True).over(so_far), F.lit(False))
    return df.withColumn(name, state).drop("flag_", "i_", "turn_", "long_")


def neighbours(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """For each row of ``left`` the last row of ``right`` at or before its time and the first one after it, as ``p_`` and ``n_``
    (time and value), in one pass over the union of both."""
    a = left.select(*keys, at, F.lit(None).cast(right.schema[value].dataType).alias(value), F.lit(1).alias("mine_"), F.struct(*left.columns).alias("row_"))
    b = right.select(*keys, at, value, F.lit(0).alias("mine_"), F.lit(None).cast(a.schema["row_"].dataType).alias("row_"))
    in_order = Window.partitionBy(*keys).orderBy(at, "mine_")
    there = F.when(F.col("mine_") == 0, F.struct(F.col(at).alias("t"), F.col(value).alias("v")))
    both = a.unionByName(b).withColumn("p_", F.last(there, True).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("n_", F.last(there, True).over(backwards(keys, at, "mine_").rowsBetween(Window.unboundedPreceding, 0)))
    return both.where("mine_ = 1").select("row_.*", "p_", "n_")


def overlapping(a_start: str, a_end: str, b_start: str, b_end: str) -> Column:
    return (F.col(a_end) >= F.col(b_start)) & (F.col(a_start) <= F.col(b_end))


def meeting(a: DataFrame, b: DataFrame, keys: list[str], a_span: tuple[str, str], b_span: tuple[str, str], width: int = 128) -> DataFrame:
    """Rows of both with equal keys whose spans of frames overlap, each pair once.  Spans are cut at multiples of ``width`` frames and only meet in
    a cut that both reach, so the work goes with the frames and not with the pairs of a recording."""

    def cut(rows: DataFrame, span: tuple[str, str]) -> DataFrame:
        return rows.withColumn("bin_", F.explode(F.expr(f"sequence({span[0]} div {width}, greatest({span[0]}, {span[1]}) div {width})")))

    first = F.expr(f"greatest({a_span[0]}, {b_span[0]}) div {width}")  # the cut in which the overlap begins
    both = cut(a, a_span).join(cut(b, b_span), [*keys, "bin_"])
    return both.where((F.col("bin_") == first) & overlapping(*a_span, *b_span)).drop("bin_")


def folded(rows: DataFrame, keys: list[str], order: list[str], step: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """An ordered left fold for each key: ``step`` takes a key's rows in order, batch by batch, and yields what comes of them.  Rows are
    sorted by Spark, which spills; a task holds one batch and the step's own state, however long the recording."""

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, pd.DataFrame]]:
        for frame in frames:
            frame = frame.drop(columns="place_")
            columns = [frame[k].to_numpy() for k in keys]
            starts = [*np.flatnonzero(turns(columns, len(frame)))]
            for a, b in zip(starts, [*starts[1:], len(frame)], strict=True):
                yield tuple(c[a] for c in columns), frame.iloc[a:b]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for _, group in groupby(parts(frames), key=lambda p: p[0]):
            for part in step(part for _, part in group):  # what short recordings give goes on together
                held, size = [*held, part], size + len(part)
                if size >= 10_000 or len(held) >= 500:
                    yield pd.concat(held, ignore_index=True)
                    held, size = [], 0
        if held:
            yield pd.concat(held, ignore_index=True)

    # Where rows lie in buckets of the keys Spark leaves out the shuffle, and then, as no operator asks for the buckets, reads files in any tasks, so a key would be folded in parts: the window asks for them
    rows = rows.withColumn("place_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def turns(columns: list[np.ndarray], n: int) -> np.ndarray:
    """Where a key begins among rows sorted by it; the first row counts."""
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


@cache
def _record(names: tuple[str, ...]) -> type:
    return namedtuple("Row", names)


def records(part: pd.DataFrame) -> Iterator[tuple]:
    """Rows as named tuples, whose type is made once and not for each part."""
    return map(_record(tuple(part.columns))._make, zip(*(part[c].tolist() for c in part.columns), strict=True))


def by_frame(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list]]:
    """A recording's batches as (frame, rows of that frame), also where a frame's rows lie in two batches."""
    rows = (r for part in parts for r in records(part))
    for frame, group in groupby(rows, key=lambda r: r.frame_idx):
        yield int(frame), list(group)


def batched(rows: Iterator[tuple], columns: list[str], size: int = 10_000) -> Iterator[pd.DataFrame]:
    out = []
    for row in rows:
        out.append(row)
        if len(out) == size:
            yield pd.DataFrame(out, columns=columns)
            out = []
    if out:
        yield pd.DataFrame(out, columns=columns)


def fold(values: Column, start: Column, step) -> Column:
    """An ordered left fold over an array; ``step`` takes the accumulator and an element."""
    return F.aggregate(values, start, step)
