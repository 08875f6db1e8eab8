"""The append-only edit log: replay into a layer, change feed, sync by offset.

A row is one edit: ``(offs, form, valu, code, name, sub, text, tmin, tmax)``. By code,
``name`` is a property, tag, data key or verb; ``sub`` a tag property or the other end's
form; ``text`` the value or the other end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import TAGPROPS, TAGS
from graphloom.plans.layers import COLUMNS, Layer

SCHEMA = "offs bigint, form string, valu string, code int, name string, sub string, text string, tmin bigint, tmax bigint"
# Edit codes.
NODE_ADD, NODE_DEL, PROP_SET, PROP_DEL, TAG_SET, TAG_DEL = 0, 1, 2, 3, 4, 5
TAGPROP_SET, TAGPROP_DEL, NODEDATA_SET, NODEDATA_DEL, EDGE_ADD, EDGE_DEL = 6, 7, 8, 9, 10, 11

NODE = ["form", "valu"]


def alive(edits: DataFrame) -> DataFrame:
    """Edits after the last deletion of their node (deletions of edges aside)."""
    dead = edits.where(F.col("code") == NODE_DEL).groupBy(*NODE).agg(F.max("offs").alias("_dead"))
    return edits.join(dead, NODE, "left").where(F.col("_dead").isNull() | (F.col("offs") > F.col("_dead"))).drop("_dead")


def _kind(code: Column) -> Column:
    return F.floor(code / 2)


def replay(edits: DataFrame, name: str = "replayed") -> Layer:
    """The layer that a log builds. The last set or deletion of each item counts; intervals
    of a tag that was set again unite since its last deletion. Two shuffles: by item, by node."""
    live = alive(edits).where(F.col("code") != NODE_DEL)
    items = live.where(F.col("code").isin(NODE_ADD, PROP_SET, PROP_DEL, TAG_SET, TAG_DEL, TAGPROP_SET, TAGPROP_DEL, NODEDATA_SET, NODEDATA_DEL))
    gone = items.where((F.col("code") % 2 == 1)).groupBy(*NODE, _kind(F.col("code")).alias("kind"), "name", "sub").agg(F.max("offs").alias("_gone"))
    sets = items.where(F.col("code") % 2 == 0).withColumn("kind", _kind(F.col("code")))
    on = [sets[c].eqNullSafe(gone[c]) for c in (*NODE, "kind", "name", "sub")]
    last = sets.join(gone.select(*[gone[c] for c in (*NODE, "kind", "name", "sub")], "_gone"), on, "left")
    last = last.where(gone["_gone"].isNull() | (sets["offs"] > gone["_gone"])).select(*[sets[c] for c in sets.columns])
    items = last.groupBy(*NODE, "kind", "name", "sub").agg(
        F.max_by("text", "offs").alias("text"), F.min("tmin").alias("tmin"), F.max("tmax").alias("tmax")
    )
    entry = F.struct("kind", "name", "sub", "text", "tmin", "tmax")
    nodes = items.groupBy(*NODE).agg(F.collect_list(entry).alias("_e"))  # the items of one node
    of = lambda k: F.filter("_e", lambda e: e["kind"] == k)
    pair = lambda k: F.map_from_entries(F.transform(of(k), lambda e: F.struct(e["name"].alias("key"), e["text"].alias("value"))))
    iv = lambda e: F.when(e["tmin"].isNotNull(), F.struct(e["tmin"].alias("min"), e["tmax"].alias("max")))
    tags = F.map_from_entries(F.transform(of(2), lambda e: F.struct(e["name"].alias("key"), iv(e).alias("value"))))
    tp = of(3)
    inner = lambda t: F.map_from_entries(F.transform(F.filter(tp, lambda e: e["name"] == t), lambda e: F.struct(e["sub"].alias("key"), e["text"].alias("value"))))
    tagprops = F.map_from_entries(F.transform(F.array_distinct(F.transform(tp, lambda e: e["name"])), lambda t: F.struct(t.alias("key"), inner(t).alias("value"))))
    rows = nodes.select(
        *NODE, F.exists("_e", lambda e: e["kind"] == 0).alias("has_valu"), pair(1).alias("props"), tags.cast(TAGS).alias("tags"),
        tagprops.cast(TAGPROPS).alias("tagprops"), pair(4).alias("nodedata"),
    ).select(*COLUMNS)
    e = live.where(F.col("code").isin(EDGE_ADD, EDGE_DEL)).groupBy(*NODE, "name", "sub", "text").agg(F.max_by("code", "offs").alias("code"))
    edges = e.where(F.col("code") == EDGE_ADD).select(
        F.col("form").alias("n1form"), F.col("valu").alias("n1"), F.col("name").alias("verb"), F.col("sub").alias("n2form"), F.col("text").alias("n2")
    )
    return Layer(name, rows, edges)


def to_edits(layer: Layer, start: int = 0) -> DataFrame:
    """A layer as the edits that build it; offsets grow, but have gaps."""
    n = layer.nodes
    col = lambda code, name=None, sub=None, text=None, tmin=None, tmax=None: F.struct(
        F.lit(code).alias("code"), (F.lit(None).cast("string") if name is None else name).alias("name"), (F.lit(None).cast("string") if sub is None else sub).alias("sub"),
        (F.lit(None).cast("string") if text is None else text).alias("text"), (F.lit(None).cast("bigint") if tmin is None else tmin).alias("tmin"),
        (F.lit(None).cast("bigint") if tmax is None else tmax).alias("tmax"),
    )
    nested = F.flatten(F.transform(F.map_entries("tagprops"), lambda t: F.transform(F.map_entries(t["value"]), lambda p: col(TAGPROP_SET, t["key"], p["key"], p["value"]))))
    every = F.concat(
        F.when(F.col("has_valu"), F.array(col(NODE_ADD))).otherwise(F.filter(F.array(col(NODE_ADD)), lambda _: F.lit(False))),
        F.transform(F.map_entries("props"), lambda e: col(PROP_SET, e["key"], None, e["value"])),
        F.transform(F.map_entries("tags"), lambda e: col(TAG_SET, e["key"], None, None, e["value"]["min"], e["value"]["max"])), nested,
        F.transform(F.map_entries("nodedata"), lambda e: col(NODEDATA_SET, e["key"], None, e["value"])),
    )
    rows = n.select(*NODE, F.explode(every).alias("e")).select(*NODE, "e.*")
    edges = layer.edges.select(F.col("n1form").alias("form"), F.col("n1").alias("valu"), F.lit(EDGE_ADD).alias("code"), F.col("verb").alias("name"), F.col("n2form").alias("sub"), F.col("n2").alias("text"), F.lit(None).cast("bigint").alias("tmin"), F.lit(None).cast("bigint").alias("tmax"))
    both = rows.unionByName(edges)
    return both.withColumn("offs", F.monotonically_increasing_id() + F.lit(start)).select(*[c.split()[0] for c in SCHEMA.split(", ")])


def append(edits: DataFrame, path: str) -> None:
    edits.write.mode("append").parquet(path)


def slice_(edits: DataFrame, offs: int = 0, size: int | None = None, reverse: bool = False) -> DataFrame:
    """Edits from an offset on (or back from it), in order, at most ``size``."""
    rows = edits.where(F.col("offs") <= offs if reverse else F.col("offs") >= offs).orderBy(F.desc("offs") if reverse else F.asc("offs"))
    return rows.limit(size) if size is not None else rows


def feed(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """The log as a stream; the query's checkpoint holds the offset."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(path)


def index_events(edits: DataFrame, forms: list[str] = (), props: list[str] = (), tags: list[str] = (), tagprops: list[str] = ()) -> DataFrame:
    """Edits that touch any of the named forms, properties (``form:prop``), tags or tag properties."""
    code, name = F.col("code"), F.col("name")
    c = F.lit(False)
    if forms:
        c |= code.isin(NODE_ADD, NODE_DEL) & F.col("form").isin(list(forms))
    if props:
        c |= code.isin(PROP_SET, PROP_DEL) & F.concat("form", F.lit(":"), "name").isin(list(props))
    if tags:
        c |= code.isin(TAG_SET, TAG_DEL) & name.isin(list(tags))
    if tagprops:
        c |= code.isin(TAGPROP_SET, TAGPROP_DEL) & F.concat("name", F.lit(":"), "sub").isin(list(tagprops))
    return edits.where(c)
