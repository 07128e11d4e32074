"""Files: one JSON document or GraphML file for each recording, and reading graphs back."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1.0"
GRAPHML = "http://graphml.graphdrawing.org/xmlns"


def as_json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def listed(rows: DataFrame, name: str, order: list[str], keys: tuple[str, ...] = ("video_id",), order_only: bool = False) -> DataFrame:
    """``name``: each key's rows as an array of structs, in order of the given columns; ``order_only`` if the others can't be compared (maps)."""
    rest = [c for c in rows.columns if c not in keys]
    first = [*order, *(c for c in rest if c not in order)]
    if not order_only:
        return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*first))).alias(name))
    at = lambda s: F.struct(*(s[c] for c in order))
    before = lambda a, b: F.when(at(a) < at(b), -1).when(at(a) > at(b), 1).otherwise(0)
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*first)), before).alias(name))


def documents(head: DataFrame, **parts: DataFrame) -> DataFrame:
    """``video_id, json``: the head's columns and each part's array, as one object for each video; videos without rows get nulls."""
    out = head
    for name, part in parts.items():
        out = out.join(part.select("video_id", name), "video_id", "left")
    body = F.struct(F.lit(VERSION).alias("schema_version"), *(F.col(c) for c in out.columns))
    return out.select("video_id", as_json(body).alias("json"))


def timeline_json(totals: DataFrame, frames: DataFrame) -> DataFrame:
    return documents(totals, frames=listed(frames.select("video_id", "frame_idx", "t"), "frames", ["frame_idx"]))


def pose_json(totals: DataFrame, joints: DataFrame) -> DataFrame:
    """Joints nested by frame, and the mean of confidences above 0."""
    per = listed(joints.select("video_id", "frame_idx", "joint", "x", "y", "conf", "x3", "y3", "z3"), "joints", ["joint"], ("video_id", "frame_idx"))
    mean = joints.groupBy("video_id").agg(F.avg(F.when(F.col("conf") > 0, F.col("conf"))).alias("overall_pose_conf"))
    return documents(totals.join(mean, "video_id", "left"), frames=listed(per, "frames", ["frame_idx"]))


def objects_json(totals: DataFrame, states: DataFrame) -> DataFrame:
    keys = ("video_id", "object_id", "class_name")
    per = listed(states, "states", ["frame_idx"], keys)
    return documents(totals, objects=listed(per, "objects", ["object_id"]))


def contacts_json(totals: DataFrame, events: DataFrame) -> DataFrame:
    return documents(totals.withColumn("event_scope", F.lit("contact_events_only_v1")), events=listed(events, "events", ["event_id"]))


def actions_json(totals: DataFrame, segments: DataFrame) -> DataFrame:
    return documents(totals, segments=listed(segments, "segments", ["seg_id"]))


def graph_json(metadata: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return documents(metadata, nodes=listed(nodes, "nodes", ["seg_id"]), edges=listed(edges, "edges", ["source", "target"]))


def write_json(found: DataFrame, path: str, folders: bool = False) -> None:
    """A line for each video, many to a file; or a folder with one file for each video, for few videos that other tools read."""
    rows = found.select("video_id", F.col("json").alias("value"))
    if folders:
        rows.repartition("video_id").write.mode("overwrite").partitionBy("video_id").text(path)
    else:
        rows.select("value").write.mode("overwrite").text(path)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of graphs written as JSON."""
    edge = "array<struct<source:long,target:long,edge_type:string,confidence:double,gap_frames:long>>"
    node = "array<struct<seg_id:long,frame_start:long,frame_end:long,label:string>>"
    rows = spark.read.text(path).select(F.from_json("value", f"struct<video_id:long,nodes:{node},edges:{edge}>").alias("g")).select("g.*")
    return rows.select("video_id", F.explode("nodes").alias("n")).select("video_id", "n.*"), rows.select("video_id", F.explode("edges").alias("e")).select("video_id", "e.*")


def graphml(graphs: DataFrame) -> DataFrame:
    """``video_id, xml`` of graphs as JSON of any shape; attributes that are lists or objects are written as JSON.  ``graphml_of`` writes tables, with types."""

    def one(text: str) -> str:
        import json

        data = json.loads(text)
        root = ElementTree.Element("graphml", xmlns=GRAPHML)
        graph = ElementTree.SubElement(root, "graph", edgedefault="directed")
        for kind, rows in (("node", data.get("nodes") or []), ("edge", data.get("edges") or [])):
            for row in rows:
                named = {"id": str(row.pop("seg_id"))} if kind == "node" else {"source": str(row.pop("source")), "target": str(row.pop("target"))}
                item = ElementTree.SubElement(graph, kind, named)
                for key, value in row.items():
                    if value is not None:
                        ElementTree.SubElement(item, "data", key=key).text = json.dumps(value) if isinstance(value, (list, dict)) else str(value)
        return ElementTree.tostring(root, encoding="unicode")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"video_id": frame.video_id, "xml": [one(t) for t in frame.json]})

    return graphs.select("video_id", "json").mapInPandas(write, "video_id long, xml string")


#: Types of attributes by those of columns; lists and objects are JSON texts, marked in the key's name.
TYPES = {"boolean": "boolean", "tinyint": "int", "smallint": "int", "int": "int", "bigint": "long", "float": "float", "double": "double", "string": "string"}
PARTS = {"node": {"seg_id": "_id"}, "edge": {"source": "_source", "target": "_target"}}


def graphml_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``video_id, xml`` of nodes and edges, made by Spark's XML functions.  Each further column is an attribute with a typed key; nulls are left out; lists and objects
    are JSON texts, with ``.json`` behind the key's id."""
    keys, out = [], nodes.select("video_id").distinct()
    for kind, rows in (("node", nodes), ("edge", edges)):
        data = []
        for f in rows.schema:
            if f.name == "video_id" or f.name in PARTS[kind]:
                continue
            name = f.dataType.simpleString()
            key = f"{kind}.{f.name}" + ("" if name in TYPES else ".json")
            keys.append(F.struct(F.lit(key).alias("_id"), F.lit(kind).alias("_for"), F.lit(f.name).alias("_attr.name"), F.lit(TYPES.get(name, "string")).alias("_attr.type")))
            text = F.col(f.name).cast("string") if name in TYPES else as_json(F.col(f.name))
            data.append(F.when(F.col(f.name).isNotNull(), F.struct(F.lit(key).alias("_key"), text.alias("_VALUE"))))
        given = F.filter(F.array(*data), lambda d: d.isNotNull()) if data else F.array().cast("array<struct<_key:string,_VALUE:string>>")
        ends = [F.col(c).cast("string").alias(n) for c, n in PARTS[kind].items()]
        item = F.struct(*(F.col(c).alias(f"o_{c}") for c in PARTS[kind]), F.struct(*ends, given.alias("data")).alias("item"))
        per = rows.groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"]).alias(kind))
        out = out.join(per, "video_id", "left")
    graph = F.struct(F.lit("directed").alias("_edgedefault"), "node", "edge")
    return out.select("video_id", F.to_xml(F.struct(F.lit(GRAPHML).alias("_xmlns"), F.array(*keys).alias("key"), graph.alias("graph")), {"rowTag": "graphml"}).alias("xml"))


def from_graphml(files: DataFrame) -> DataFrame:
    """``video_id, kind, a, b, attributes, types``: nodes (a) and edges (a to b) of GraphML texts, read by Spark's XML functions; attributes as texts by name, and the types of
    their keys (``json`` for lists and objects), where the file has a table of keys.  ``attribute`` gives a value of a type."""
    data = "data:array<struct<_VALUE:string,_key:string>>"
    schema = f"key array<struct<_id:string,`_attr.name`:string,`_attr.type`:string>>, graph struct<node:array<struct<_id:string,{data}>>,edge:array<struct<_source:string,_target:string,{data}>>>"
    none = F.create_map().cast("map<string,struct<name:string,type:string>>")
    # a text, which a type of the reader could turn into another, is read as it stands
    g = files.select("video_id", F.from_xml("xml", schema, {"rowTag": "graphml", "ignoreSurroundingSpaces": "false"}).alias("g"))
    kind = lambda k: F.when(k["_id"].endswith(".json"), "json").otherwise(k["_attr.type"])
    known = F.map_from_entries(F.transform("g.key", lambda k: F.struct(k["_id"], F.struct(k["_attr.name"].alias("name"), kind(k).alias("type")))))
    g = g.withColumn("known", F.coalesce(known, none))
    one = "array<struct<_VALUE:string,_key:string>>"
    node = F.transform("g.graph.node", lambda n: F.struct(F.lit("node").alias("kind"), n["_id"].cast("long").alias("a"), F.lit(None).cast("long").alias("b"), n["data"].cast(one).alias("data")))
    edge = F.transform("g.graph.edge", lambda e: F.struct(F.lit("edge").alias("kind"), e["_source"].cast("long").alias("a"), e["_target"].cast("long").alias("b"), e["data"].cast(one).alias("data")))
    both = F.concat(F.coalesce(node, F.array().cast(f"array<struct<kind:string,a:long,b:long,data:{one}>>")), F.coalesce(edge, F.array().cast(f"array<struct<kind:string,a:long,b:long,data:{one}>>")))
    rows = g.select("video_id", "known", F.explode(both).alias("x")).select("video_id", "known", "x.*").withColumn("data", F.coalesce("data", F.array().cast(one)))
    named = lambda d: F.coalesce(F.try_element_at("known", d["_key"])["name"], d["_key"])
    texts = F.map_from_entries(F.transform("data", lambda d: F.struct(named(d), F.coalesce(d["_VALUE"], F.lit("")))))
    kinds = F.map_from_entries(F.transform(F.filter("data", lambda d: F.try_element_at("known", d["_key"]).isNotNull()), lambda d: F.struct(named(d), F.try_element_at("known", d["_key"])["type"])))
    return rows.select("video_id", "kind", "a", "b", texts.alias("attributes"), kinds.alias("types"))


def attribute(name: str, kind: str) -> Column:
    """An attribute's value as a type, lists and objects included; null where there is none."""
    text = F.try_element_at("attributes", F.lit(name))
    return F.from_json(text, kind) if "<" in kind else text.cast(kind)


def action_dataset(segments: DataFrame, trajectory: DataFrame, objects: DataFrame) -> DataFrame:
    """Rows of each labelled segment, its last frame left out: the right hand if it is there, else the left, else zeros; and the place of the segment's
    first object, null without one (an object numbered 0 counts as none), zeros where it isn't seen.  ``trajectory`` has video_id, frame_idx, side, ex, ey, ez."""
    hand = trajectory.groupBy("video_id", "frame_idx").agg(F.max_by(F.struct("ex", "ey", "ez"), "side").alias("h"))
    inside = segments.select("video_id", "seg_id", "label", F.try_element_at("objects", F.lit(1)).alias("o"), "frame_start", "frame_end").where("frame_end > frame_start")
    inside = inside.withColumn("frame_idx", F.explode(F.sequence(F.col("frame_start"), F.col("frame_end") - 1))).withColumn("o", F.when(F.col("o") != 0, F.col("o")))
    rows = inside.join(hand, ["video_id", "frame_idx"], "left").join(objects.select("video_id", F.col("object_id").alias("o"), "frame_idx", F.struct("ex", "ey", "ez").alias("p")), ["video_id", "o", "frame_idx"], "left")
    zero = {c: F.coalesce(f"h.e{c}", F.lit(0.0)).alias(f"hand_{c}") for c in "xyz"}
    place = {c: F.when(F.col("o").isNotNull(), F.coalesce(f"p.e{c}", F.lit(0.0))).alias(f"object_{c}") for c in "xyz"}
    return rows.select("video_id", "seg_id", "label", "frame_idx", F.col("o").alias("object_id"), *zero.values(), *place.values())


def bare_graph_json(totals: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Graphs as nodes (``id``) and edges alone, without metadata; empty lists for videos without segments."""
    none = F.array()
    out = totals.select("video_id").join(listed(nodes.withColumnRenamed("seg_id", "id"), "nodes", ["id"]), "video_id", "left").join(listed(edges, "edges", ["source", "target"]), "video_id", "left")
    kept = [F.coalesce(F.col(c), none.cast(out.schema[c].dataType)).alias(c) for c in ("nodes", "edges")]
    return out.select("video_id", as_json(F.struct(*kept)).alias("json"))


def ego_json(frames: DataFrame, heads: DataFrame, hands: DataFrame, pinches: DataFrame, arms: DataFrame, objects: DataFrame, labels: DataFrame) -> DataFrame:
    """The first-person view of each video, frame by frame: head, hands (landmarks, pinch), arms, objects, and its labelled segments.
    ``hands`` has side, landmark, ex, ey, ez; ``pinches`` side, pinch_distance, pinching; ``arms`` side, part, ex, ey, ez; ``objects`` object_id, ex, ey, ez."""
    key = ["video_id", "frame_idx"]
    place = F.array("ex", "ey", "ez")

    def points(rows: DataFrame, order: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct(order, place.alias("p"))))
        return rows.groupBy(*key, "side").agg(F.transform(ordered, lambda s: s["p"]).alias("points"))

    def by_side(rows: DataFrame, value, name: str) -> DataFrame:
        return rows.groupBy(*key).agg(*(F.max(F.when(F.col("side") == s, value)).alias(f"{s}_{name}") for s in ("left", "right")))

    hand = by_side(points(hands, "landmark").join(pinches, [*key, "side"], "left"), F.struct(F.col("points").alias("landmarks_3d"), "pinching", "pinch_distance"), "hand")
    arm = by_side(points(arms, "part"), F.struct(F.col("points").alias("keypoints_3d")), "arm")
    thing = objects.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("object_id").cast("string").alias("k"), F.struct(place.alias("position_3d")).alias("v"))))).alias("objects"))
    vector = lambda name: F.array(*(f"{name}_{c}" for c in "xyz"))
    head = heads.select(*key, F.struct(vector("eye").alias("position"), *(vector(v).alias(v) for v in ("forward", "up", "right")), "confidence").alias("head"))
    rows = frames.select(*key, F.col("t").alias("timestamp")).join(head, key, "left")
    for part in (hand, arm, thing):
        rows = rows.join(part, key, "left")
    rows = rows.withColumn("objects", F.coalesce("objects", F.create_map().cast(rows.schema["objects"].dataType)))
    totals = frames.groupBy("video_id").agg(F.lit("1.0").alias("format_version"), F.lit("egocentric_trajectory").alias("type"), F.count(F.lit(1)).alias("num_frames"))
    return documents(totals, frames=listed(rows, "frames", ["frame_idx"], order_only=True), action_labels=listed(labels, "action_labels", ["seg_id"]))


def write_all(tables: dict[str, DataFrame], path: str) -> dict[str, str]:
    """Writes each table of ``video_id, json`` to a folder of its name; gives the folders."""
    paths = {name: f"{path.rstrip('/')}/{name}" for name in tables}
    for name, found in tables.items():
        write_json(found, paths[name])
    return paths
