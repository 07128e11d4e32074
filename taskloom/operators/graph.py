"""Conditions of segments, their order, and the task graph."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taskloom.functions.lineage import kept
from taskloom.functions.temporal import batched, folded, over
from taskloom.operators.states import DIMENSIONS


def preconditions(segment: DataFrame, states: DataFrame, lookback: int = 1) -> DataFrame:
    """States of a segment's objects just before it begins."""
    each = segment.select("video_id", "seg_id", F.explode("objects").alias("object_id"), F.greatest(F.lit(0).cast("long"), F.col("frame_start") - lookback).alias("frame_idx"))
    return each.withColumnRenamed("frame_idx", "at_").join(_states_at(states, "at_"), ["video_id", "object_id", "at_"]).select("video_id", "seg_id", "object_id", *(F.col(f"{d}_at_").alias(d) for d in DIMENSIONS))


def _states_at(states: DataFrame, name: str) -> DataFrame:
    """The states with the frame and the dimensions named anew; always the same columns, so that joins of one job share a shuffle of them."""
    return states.select("video_id", "object_id", F.col("frame_idx").alias(name), *(F.col(d).alias(f"{d}_{name}") for d in DIMENSIONS))


def postconditions(segment: DataFrame, states: DataFrame, totals: DataFrame, lookahead: int = 1) -> DataFrame:
    """States of a segment's objects just after it ends, and which dimensions differ from its first frame."""
    last = F.least(F.col("frame_end") + lookahead, F.col("num_frames") - 1)
    each = segment.join(totals, "video_id").select("video_id", "seg_id", F.explode("objects").alias("object_id"), F.greatest(F.lit(0).cast("long"), "frame_start").alias("a"), last.alias("b"))
    for c in ("a", "b"):
        each = each.join(_states_at(states, c), ["video_id", "object_id", c])
    order = ["support_relation", "motion_state", "interaction_state", "containment"]
    moved = F.array(*(F.when(F.col(f"{d}_a") != F.col(f"{d}_b"), F.struct(F.lit(d).alias("dimension"), F.col(f"{d}_a").alias("from"), F.col(f"{d}_b").alias("to"))) for d in order))
    return each.select("video_id", "seg_id", "object_id", *(F.col(f"{d}_b").alias(d) for d in DIMENSIONS), F.filter(moved, lambda x: x.isNotNull()).alias("changes"))


def shared_objects(segment: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """A row for each object that two segments share, the first ending before the second begins: ``source, target, object_id`` and the columns of ``left`` (as of
    the first segment) and ``right`` (of the second), both keyed by video_id, seg_id and object_id."""
    key = ["video_id", "seg_id", "object_id"]
    each = segment.select("video_id", "seg_id", "frame_start", "frame_end", F.explode("objects").alias("object_id"))
    a = each.join(left, key, "left").drop("frame_start").withColumnRenamed("seg_id", "source")
    b = each.join(right, key, "left").drop("frame_end").withColumnRenamed("seg_id", "target")
    return a.join(b, ["video_id", "object_id"]).where("frame_end < frame_start").drop("frame_end", "frame_start")


def candidate_pairs(segment: DataFrame) -> DataFrame:
    """Segments that share objects, the first ending before the second begins.  They meet by object, so only such pairs are formed."""
    none = segment.select("video_id", "seg_id", F.explode("objects").alias("object_id")).distinct()
    rows = shared_objects(segment, none, none)
    return rows.groupBy("video_id", "source", "target").agg(F.array_sort(F.collect_set("object_id")).alias("shared"))


def causal_edges(segment: DataFrame, pre: DataFrame, post: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs where what the first leaves behind is what the second needs: 0.8 for each shared object in the same state, 0.1 more if the
    first changed it, over the number of shared objects.  Pairs without a shared object have nothing that matches, hence never an edge.  ``matched_objects`` and
    ``shared_objects`` are the evidence."""
    key = ["video_id", "seg_id", "object_id"]
    left = post.select(*key, F.struct(*DIMENSIONS).alias("left"), (F.size("changes") > 0).alias("changed"))
    right = pre.select(*key, F.struct(*DIMENSIONS).alias("right"))
    same = F.expr("left is not null and right is not null and " + " and ".join(f"coalesce(left.{d} = right.{d}, true)" for d in DIMENSIONS))
    rows = shared_objects(segment, left, right).withColumn("same", same)
    per = rows.groupBy("video_id", "source", "target").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("same"), 1)).alias("matched"), F.count(F.when(F.col("same") & F.col("changed"), 1)).alias("changed"),
        F.array_sort(F.collect_set(F.when(F.col("same"), F.col("object_id")))).alias("matched_objects"), F.array_sort(F.collect_set("object_id")).alias("shared_objects"))
    conf = F.least(F.lit(1.0), (F.col("matched") * 0.8 + F.col("changed") * 0.1) / F.greatest(F.lit(1), F.col("n")))
    return per.where("matched > 0").withColumn("confidence", conf).where(F.col("confidence") >= least).select("video_id", "source", "target", F.lit("causal").alias("edge_type"), "confidence", "matched_objects", "shared_objects")


def temporal_edges(segment: DataFrame, causal: DataFrame) -> DataFrame:
    """Neighbours in time without a causal edge."""
    w = over(["video_id"], "frame_start").orderBy("frame_start", "seg_id")
    next_ = segment.select("video_id", F.col("seg_id").alias("source"), F.lead("seg_id").over(w).alias("target"), (F.lead("frame_start").over(w) - F.col("frame_end")).alias("gap_frames")).where("target is not null")
    return next_.join(causal, ["video_id", "source", "target"], "left_anti").select("video_id", "source", "target", F.lit("temporal").alias("edge_type"), F.lit(0.5).alias("confidence"), "gap_frames")


def edges(causal: DataFrame, temporal: DataFrame) -> DataFrame:
    """All edges; of several between the same two the last stays, temporal after causal."""
    every = causal.withColumn("gap_frames", F.lit(None).cast("long")).unionByName(temporal, allowMissingColumns=True)
    last = Window.partitionBy("video_id", "source", "target").orderBy(F.col("edge_type").desc())
    return every.withColumn("r", F.row_number().over(last)).where("r = 1").drop("r")


def roots(nodes: DataFrame, edge: DataFrame) -> DataFrame:
    return nodes.select("video_id", "seg_id").join(edge.select("video_id", F.col("target").alias("seg_id")).distinct(), ["video_id", "seg_id"], "left_anti")


def leaves(nodes: DataFrame, edge: DataFrame) -> DataFrame:
    return nodes.select("video_id", "seg_id").join(edge.select("video_id", F.col("source").alias("seg_id")).distinct(), ["video_id", "seg_id"], "left_anti")


def metadata(nodes: DataFrame, edge: DataFrame) -> DataFrame:
    """Counts per video, and whether its graph is free of cycles."""
    n = nodes.groupBy("video_id").agg(F.count(F.lit(1)).alias("num_nodes"))
    e = edge.groupBy("video_id").agg(F.count(F.lit(1)).alias("num_edges"), F.count(F.when(F.col("edge_type") == "causal", 1)).alias("num_causal"), F.count(F.when(F.col("edge_type") == "temporal", 1)).alias("num_temporal"))
    cyclic = core(edge).select("video_id").distinct().withColumn("is_dag", F.lit(False))
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("num_edges", "num_causal", "num_temporal")}
    return n.join(e, "video_id", "left").join(cyclic, "video_id", "left").withColumns(counts).withColumn("is_dag", F.coalesce("is_dag", F.lit(True)))


def validated(nodes: DataFrame, graph_nodes: DataFrame, edge: DataFrame | None = None) -> DataFrame:
    """``video_id, seg_id, problem``: segments without a node (missing), nodes without a segment (extra) and, if edges are given, nodes on a cycle."""
    key = ["video_id", "seg_id"]
    found = nodes.select(*key).join(graph_nodes.select(*key), key, "left_anti").withColumn("problem", F.lit("missing")).unionByName(graph_nodes.select(*key).join(nodes.select(*key), key, "left_anti").withColumn("problem", F.lit("extra")))
    return found if edge is None else found.unionByName(cycles(edge).select(*key, F.lit("cycle").alias("problem")))


ENDS = ["video_id", "source", "target"]


def core(edge: DataFrame) -> DataFrame:
    """The edges that are left when nodes without an edge to them or from them are trimmed until there are none: empty exactly for graphs without cycles.

    A video all of whose edges lead from a smaller to a larger number has none, and is not looked at; so segments in order of time cost one pass.  Of the others
    all are trimmed together, a round for both ends."""
    edge = edge.select(*ENDS).distinct()
    back = edge.where("source >= target").select("video_id").distinct()
    rest = kept(edge.join(back, "video_id", "left_semi"))
    while True:
        ins, outs = (rest.select("video_id", F.col(c).alias(o)).distinct() for c, o in (("target", "source"), ("source", "target")))
        new = kept(rest.join(ins, ["video_id", "source"], "left_semi").join(outs, ["video_id", "target"], "left_semi"))
        if new.count() == rest.count():
            return new
        rest = new


def spread(labels: DataFrame, edge: DataFrame) -> DataFrame:
    """``labels`` (video_id, seg_id, label) carried along the edges until none changes: each node gets the least of its own and of those before it."""
    while True:
        ahead = labels.withColumnRenamed("seg_id", "source").join(edge, ["video_id", "source"]).groupBy("video_id", F.col("target").alias("seg_id")).agg(F.min("label").alias("near"))
        new = kept(labels.join(ahead, ["video_id", "seg_id"], "left").select("video_id", "seg_id", F.col("label").alias("before"), F.least("label", "near").alias("label")))
        labels = new.select("video_id", "seg_id", "label")
        if not new.where("label < before").take(1):
            return labels


def cycles(edge: DataFrame) -> DataFrame:
    """``video_id, seg_id, component``: the nodes on cycles, by strongly connected component, named by its smallest node.

    What trimming leaves is coloured forward: a node's colour is the least node that leads to it.  The nodes of a colour that lead back to the node it is named for are
    that node's component; they go, what is left is trimmed, and so on."""
    rest, out = core(edge), None
    while rest.take(1):
        nodes = rest.select("video_id", F.col("source").alias("seg_id")).distinct()
        colour = spread(nodes.withColumn("label", F.col("seg_id")), rest)
        of = lambda c: colour.select("video_id", F.col("seg_id").alias(c), F.col("label").alias(f"{c}_colour"))
        within = rest.join(of("source"), ["video_id", "source"]).join(of("target"), ["video_id", "target"]).where("source_colour = target_colour")
        back = within.select("video_id", F.col("target").alias("source"), F.col("source").alias("target"))
        far = F.when(F.col("seg_id") == F.col("label"), 0).otherwise(1)  # 0 spreads to those that lead back
        reached = spread(colour.select("video_id", "seg_id", far.alias("label")), kept(back))
        found = kept(colour.join(reached.where("label = 0").select("video_id", "seg_id"), ["video_id", "seg_id"], "left_semi").withColumnRenamed("label", "component"))
        out = found if out is None else out.unionByName(found)
        gone = [found.select("video_id", F.col("seg_id").alias(c)) for c in ("source", "target")]
        rest = core(rest.join(gone[0], ["video_id", "source"], "left_anti").join(gone[1], ["video_id", "target"], "left_anti"))
    if out is None:
        return edge.select("video_id", F.col("source").alias("seg_id"), F.col("source").alias("component")).limit(0)
    several = out.groupBy("video_id", "component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("video_id", "component")
    loops = edge.where("source = target").select("video_id", F.col("source").alias("component")).distinct()
    return out.join(several.unionByName(loops).distinct(), ["video_id", "component"], "left_semi").select("video_id", "seg_id", "component")


def streamed(edge: DataFrame, by: list[str], step: Callable[[Iterator[Any]], Iterator[tuple]], schema: str, extra: list[str] = []) -> DataFrame:  # noqa: B006
    """A fold over each video's edges, sorted by Spark: ``step`` takes them one by one and yields rows."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from batched(step(r for part in parts for r in part.itertuples(index=False)), names)

    return folded(edge.select(*ENDS, *extra), ["video_id"], by, run, schema)


def peeled(edge: DataFrame) -> DataFrame:
    """``video_id, seg_id, level`` of the nodes of edges: the longest path to each, null on or behind a cycle; peeled off level by level, all videos at once."""
    ends = edge.select("video_id", F.col("source").alias("seg_id")).union(edge.select("video_id", "target")).distinct()
    level, left, open_, done = 0, ends, edge.select(*ENDS), None
    while True:
        free = kept(left.join(open_.select("video_id", F.col("target").alias("seg_id")).distinct(), ["video_id", "seg_id"], "left_anti"))
        if not free.take(1):
            rest = left.withColumn("level", F.lit(None).cast("long"))
            return rest if done is None else done.unionByName(rest)
        now = free.withColumn("level", F.lit(level).cast("long"))
        done = now if done is None else done.unionByName(now)
        left = kept(left.join(free, ["video_id", "seg_id"], "left_anti"))
        open_ = kept(open_.join(free.withColumnRenamed("seg_id", "source"), ["video_id", "source"], "left_anti"))
        level += 1


def levels(edge: DataFrame) -> DataFrame:
    """``video_id, seg_id, level`` of the nodes of edges: the longest path to each, null on or behind a cycle.  Where all edges of a video lead from smaller to
    larger numbers one pass over them in order of their targets does it; only the other videos are peeled."""
    back = kept(edge.where("source >= target").select("video_id").distinct())

    def walk(edges: Iterator[Any]) -> Iterator[tuple]:
        level: dict[int, int] = {}
        video = None
        for e in edges:
            video = e.video_id
            level[e.target] = max(level.get(e.target, 0), level.setdefault(e.source, 0) + 1)
        yield from ((video, node, n) for node, n in level.items())

    ahead = streamed(edge.join(back, "video_id", "left_anti"), ["target", "source"], walk, "video_id long, seg_id long, level long")
    return ahead.unionByName(peeled(kept(edge.join(back, "video_id", "left_semi").select(*ENDS)))) if back.take(1) else ahead


def topological(nodes: DataFrame, edge: DataFrame) -> DataFrame:
    """``level`` of each node: the longest path to it, null on or behind a cycle."""
    found = nodes.select("video_id", "seg_id").join(levels(edge), ["video_id", "seg_id"], "left")
    tied = edge.select("video_id", F.col("target").alias("seg_id")).distinct().withColumn("tied", F.lit(True))
    found = found.join(tied, ["video_id", "seg_id"], "left")
    return found.select("video_id", "seg_id", F.when(F.col("tied").isNull(), F.coalesce("level", F.lit(0).cast("long"))).otherwise(F.col("level")).cast("int").alias("level"))


def ordered(nodes: DataFrame, edge: DataFrame) -> DataFrame:
    """``video_id, seg_id, position``: a topological order of each video's nodes, by level and then by number; where there is a cycle, the order of the numbers."""
    cyclic = core(edge).select("video_id").distinct().withColumn("cyclic", F.lit(True))
    rows = topological(nodes, edge).join(F.broadcast(cyclic) if cyclic.count() <= 100_000 else cyclic, "video_id", "left")
    at = F.when(F.col("cyclic").isNull(), F.col("level")).otherwise(F.lit(0))
    place = F.row_number().over(Window.partitionBy("video_id").orderBy(at, "seg_id")) - 1
    return rows.select("video_id", "seg_id", place.cast("long").alias("position"))


def in_levels(causal: DataFrame) -> DataFrame:
    """Distinct causal edges with ``a`` and ``b``, numbers of their ends that rise along every edge: those of the nodes, or their levels.  A cycle is an error."""
    edge = kept(causal.select(*ENDS).distinct())
    if not edge.where("source >= target").take(1):
        return edge.withColumn("a", F.col("source")).withColumn("b", F.col("target"))
    level = kept(levels(edge))
    if level.where("level is null").take(1):
        raise ValueError("the causal graph has a cycle")
    of = lambda c, n: level.select("video_id", F.col("seg_id").alias(c), F.col("level").alias(n))
    return kept(edge.join(of("source", "a"), ["video_id", "source"]).join(of("target", "b"), ["video_id", "target"]))


def chain_counts(causal: DataFrame) -> DataFrame:
    """``video_id, path_length, num_paths``: how many causal paths from roots to leaves have so many nodes, for all lengths.  One pass over each
    video's edges, in order of their targets: the paths to a node are counted by length, not listed.  Counts are exact up to 38 digits; beyond, Spark's ANSI mode fails."""

    def walk(edges: Iterator[Any]) -> Iterator[tuple]:
        ways: dict[int, dict[int, int]] = {}
        inner, video = set(), None
        for e in edges:
            video = e.video_id
            inner.add(e.source)
            mine = ways.setdefault(e.target, {})
            for length, n in ways.setdefault(e.source, {1: 1}).items():
                mine[length + 1] = mine.get(length + 1, 0) + n
        total: dict[int, int] = {}
        for node in ways.keys() - inner:
            for length, n in ways[node].items():
                total[length] = total.get(length, 0) + n
        yield from ((video, length, str(n)) for length, n in total.items())

    found = streamed(in_levels(causal), ["b", "target", "source"], walk, "video_id long, path_length long, num_paths string", ["a", "b"])
    return found.withColumn("num_paths", F.col("num_paths").cast("decimal(38,0)"))


def completions(causal: DataFrame) -> DataFrame:
    """``video_id, source, target, ways``: causal edges, and as decimal text how many paths lead on from the target to a leaf.  Counted from the leaves back, in one pass over
    each video's edges in descending order of their sources.  A row with a null source for each root."""

    def walk(edges: Iterator[Any]) -> Iterator[tuple]:
        ways: dict[int, int] = {}
        video, inner, sources = None, set(), set()
        for e in edges:
            video = e.video_id
            n = ways.get(e.target, 1)  # a leaf
            ways[e.source] = ways.get(e.source, 0) + n
            inner.add(e.target)
            sources.add(e.source)
            yield video, float(e.source), e.target, str(n)
        yield from ((video, None, root, str(ways[root])) for root in sources - inner)

    rows = in_levels(causal).withColumn("down", -F.col("a"))
    found = streamed(rows, ["down", "source", "target"], walk, "video_id long, source double, target long, ways string", ["a", "down"])
    return found.withColumn("source", F.col("source").cast("long"))


def chains(causal: DataFrame, first: int = 0, last: int | None = None, size: int = 20_000) -> DataFrame:
    """``video_id, rank, path``: all causal paths from roots to leaves, of any length, as arrays of nodes, in lexical order of the nodes.

    Paths are not searched for but decoded from their ranks: the paths through each edge are counted backwards, the ranks of each video are cut into spans of
    ``size``, and a task turns the ranks of a span into paths by descending through the counts.  So the spans, also those of one video, are spread over all tasks, and
    any slice of ranks (``first`` to ``last``, exclusive) can be asked for, however many paths there are.  A task holds the edges of a video, and one batch of paths."""
    edge = kept(completions(causal))
    arcs = F.collect_list(F.struct("source", "target", "ways"))
    graphs = edge.groupBy("video_id").agg(F.array_sort(arcs).alias("arcs"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for video, ways in zip(frame.video_id, frame.ways, strict=True):
                end = sum(map(int, ways))
                end = end if last is None else min(end, last)
                if end - first > 1 << 62:
                    raise ValueError(f"video {video} has {end} causal paths: ask for a slice of them")
                yield from batched(((video, str(at), min(size, end - at)) for at in range(first, end, size)), ["video_id", "at", "n"])

    roots_ = edge.where("source is null").groupBy("video_id").agg(F.collect_list("ways").alias("ways"))
    spans = roots_.mapInPandas(cut, "video_id long, at string, n long")
    spans = spans.repartition(int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions")), "video_id", "at")

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, below = None, {}
        for frame in frames:
            for row in frame.itertuples(index=False):
                if known != row.video_id:
                    known, below = row.video_id, {}
                    for arc in row.arcs:
                        targets, upto = below.setdefault(arc["source"], ([], []))
                        targets.append(arc["target"])
                        upto.append((upto[-1] if upto else 0) + int(arc["ways"]))

                def paths(at: int, n: int) -> Iterator[tuple]:
                    for rank in range(at, at + n):
                        path, left, node = [], rank, None
                        while node in below:  # noqa: B023
                            targets, upto = below[node]  # noqa: B023
                            i = bisect_right(upto, left)
                            left, node = left - (upto[i - 1] if i else 0), targets[i]
                            path.append(node)
                        yield row.video_id, str(rank), path  # noqa: B023

                yield from batched(paths(int(row.at), row.n), ["video_id", "rank", "path"])

    found = spans.join(graphs, "video_id").sortWithinPartitions("video_id").mapInPandas(decode, "video_id long, rank string, path array<long>")
    return found.withColumn("rank", F.col("rank").cast("decimal(38,0)"))


def predecessors(edge: DataFrame, edge_type: str | None = None) -> DataFrame:
    """``video_id, seg_id, predecessors``: the sorted segments with an edge to each one, of one type or of all."""
    some = edge.where(F.col("edge_type") == edge_type) if edge_type else edge
    return some.groupBy("video_id", F.col("target").alias("seg_id")).agg(F.array_sort(F.collect_list("source")).alias("predecessors"))


def successors(edge: DataFrame, edge_type: str | None = None) -> DataFrame:
    some = edge.where(F.col("edge_type") == edge_type) if edge_type else edge
    return some.groupBy("video_id", F.col("source").alias("seg_id")).agg(F.array_sort(F.collect_list("target")).alias("successors"))
