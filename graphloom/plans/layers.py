"""Layers and views. A layer is a storage frame of partial nodes with ``has_valu`` (the node
itself lies in this layer) plus an edge frame; a view is an ordered list of layers, top
first. Masking comes before filtering: resolve, then lift.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import TAGPROPS, TAGS, union_all
from graphloom.operators.edits import EDGE, merged_interval
from graphloom.types import unwild

NODE = ["form", "valu"]
COLUMNS = ["form", "valu", "has_valu", "props", "tags", "tagprops", "nodedata"]
SCHEMA = f"form string, valu string, has_valu boolean, props map<string,string>, tags {TAGS}, tagprops {TAGPROPS}, nodedata map<string,string>"


@dataclass(frozen=True)
class Layer:
    name: str
    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession, name: str) -> Layer:
        return cls(name, spark.createDataFrame([], SCHEMA), spark.createDataFrame([], ", ".join(f"{c} string" for c in EDGE)))

    @classmethod
    def of(cls, name: str, nodes: DataFrame, edges: DataFrame | None = None) -> Layer:
        spark = nodes.sparkSession
        nodes = nodes if "has_valu" in nodes.columns else nodes.withColumn("has_valu", F.lit(True))
        return cls(name, nodes.select(*COLUMNS), edges if edges is not None else cls.empty(spark, name).edges)

    def form_counts(self) -> DataFrame:
        return self.nodes.where("has_valu").groupBy("form").agg(F.count("*").alias("count"))

    def prop_count(self, form: str, prop: str) -> DataFrame:
        return self.nodes.where((F.col("form") == form) & F.map_contains_key("props", prop)).agg(F.count("*").alias("count"))

    def tag_count(self, tag: str, form: str | None = None) -> DataFrame:
        rows = self.nodes.where(F.map_contains_key("tags", tag))
        return (rows.where(F.col("form") == form) if form else rows).agg(F.count("*").alias("count"))


def over(low: Column, high: Column) -> Column:
    """Entries of ``high`` before those of ``low``."""
    return F.map_zip_with(low, high, lambda _, a, b: F.coalesce(b, a))


def stack(part: Column) -> Column:
    """Partial nodes of one node, bottom first: one entry per layer."""
    return F.array_sort(F.collect_list(part), lambda a, b: a["_prio"] - b["_prio"])


def fold(layers: Column) -> Column:
    """An array of partial nodes, bottom first, as one struct. There are at most as many as
    the view has layers."""
    first = lambda field: F.aggregate(layers, F.expr(f"cast(map() as {_KIND[field]})"), lambda acc, x: _JOIN[field](acc, x[field]))
    return F.struct(
        F.exists(layers, lambda x: x["has_valu"]).alias("has_valu"), *[first(f).alias(f) for f in ("props", "tags", "tagprops", "nodedata")]
    )


_KIND = {"props": "map<string,string>", "tags": TAGS, "tagprops": TAGPROPS, "nodedata": "map<string,string>"}
_JOIN = {
    "props": over,
    # a tag that the top layer has without a time still hides the lower one's time
    "tags": lambda low, high: F.map_zip_with(low, high, lambda k, a, b: F.when(F.map_contains_key(high, k), b).otherwise(a)),
    "tagprops": lambda low, high: F.map_zip_with(low, high, lambda _, a, b: F.when(a.isNull() | b.isNull(), F.coalesce(b, a)).otherwise(over(a, b))),
    "nodedata": over,
}


@dataclass(frozen=True)
class View:
    """Layers, top first."""

    layers: tuple[Layer, ...]

    @property
    def top(self) -> Layer:
        return self.layers[0]

    def fork(self, name: str) -> View:
        """A view with a new empty layer on top."""
        return View((Layer.empty(self.top.nodes.sparkSession, name), *self.layers))

    def stacked(self) -> DataFrame:
        return union_all(x.nodes.withColumn("_prio", F.lit(-i)) for i, x in enumerate(self.layers))

    def nodes(self) -> DataFrame:
        """Resolved nodes: one shuffle by ``(form, valu)``; a single layer needs none."""
        if len(self.layers) == 1:
            return self.top.nodes.where("has_valu").drop("has_valu")
        parts = F.struct("_prio", "has_valu", "props", "tags", "tagprops", "nodedata")
        rows = self.stacked().groupBy(*NODE).agg(stack(parts).alias("_l"))  # one entry per layer
        return rows.select(*NODE, fold(F.col("_l")).alias("_r")).where("_r.has_valu").select(*NODE, "_r.props", "_r.tags", "_r.tagprops", "_r.nodedata")

    def edges(self, verb: str | None = None) -> DataFrame:
        rows = union_all(x.edges for x in self.layers)
        return (rows.where(F.col("verb") == verb) if verb else rows).distinct()

    def diff(self, tag: str | None = None, prop: tuple[str, str] | None = None) -> DataFrame:
        """Resolved nodes that the top layer touches, all or by tag or by (form, prop)."""
        rows = self.top.nodes
        if tag:
            rows = rows.where(F.exists(F.map_keys("tags"), lambda k: (k == tag) | k.startswith(tag + ".")))
        if prop:
            rows = rows.where((F.col("form") == prop[0]) & F.map_contains_key("props", prop[1]))
        return self.nodes().join(rows.select(*NODE).distinct(), NODE, "left_semi")

    def merge(
        self, apply: bool = False, only: DataFrame | None = None, include_tags: list[str] | None = None, exclude_tags: list[str] | None = None,
        include_props: list[str] | None = None, exclude_props: list[str] | None = None, only_tags: bool = False, wipe: bool = False,
    ) -> View | DataFrame:
        """Pushes the top layer's edits into the one below. Without ``apply`` it returns what
        would move. Globs choose tags (``a.*``) and properties (``form:prop``); what isn't
        chosen stays on top."""
        top = self.top.nodes
        chosen = top if only is None else top.join(only.select(*NODE).distinct(), NODE, "left_semi")
        pick = lambda key, inc, exc: _globbed(key, inc, True) & ~_globbed(key, exc, False)
        tag_ok = lambda k: pick(k, include_tags, exclude_tags)
        prop_ok = lambda form, k: F.lit(not only_tags) & pick(F.concat(form, F.lit(":"), k), include_props, exclude_props)
        moving = chosen.select(
            *NODE, (F.col("has_valu") & F.lit(not only_tags)).alias("has_valu"),
            F.map_filter("props", lambda k, _: prop_ok(F.col("form"), k)).alias("props"), F.map_filter("tags", lambda k, _: tag_ok(k)).alias("tags"),
            F.map_filter("tagprops", lambda k, _: tag_ok(k)).alias("tagprops"),
            F.map_filter("nodedata", lambda k, _: F.lit(not only_tags)).alias("nodedata"),
        )
        if not apply:
            return moving
        if wipe:
            staying = Layer.empty(top.sparkSession, self.top.name).nodes
        else:
            m = moving.select(*NODE, *[F.col(c).alias(f"_{c}") for c in COLUMNS[2:]])
            kept = top.join(m, NODE, "left")
            gone = lambda c: F.map_filter(c, lambda k, _: ~F.coalesce(F.map_contains_key(F.col(f"_{c}"), k), F.lit(False)))
            staying = kept.select(
                *NODE, (F.col("has_valu") & ~F.coalesce("_has_valu", F.lit(False))).alias("has_valu"), *[gone(c).alias(c) for c in COLUMNS[3:]]
            ).where(F.col("has_valu") | (F.size("props") + F.size("tags") + F.size("tagprops") + F.size("nodedata") > 0))
        below, rest = self.layers[1], self.layers[2:]
        merged = overlay(below.nodes, moving)
        edges = union_all([below.edges, self.top.edges]).distinct()
        kept_edges = Layer.empty(top.sparkSession, "").edges
        return View((Layer(self.top.name, staying, kept_edges), Layer(below.name, merged, edges), *rest))

    def copy_to(self, nodes: DataFrame, target: View) -> View:
        """``copyto``: resolved nodes go into the top layer of another view, with the edges
        whose other end the target has."""
        rows = self.nodes().join(nodes.select(*NODE).distinct(), NODE, "left_semi").withColumn("has_valu", F.lit(True))
        there = target.nodes().select(*NODE).union(rows.select(*NODE)).distinct()
        ends = rows.select(*NODE)
        e = self.edges()
        mine = e.join(ends.toDF("n1form", "n1"), ["n1form", "n1"], "left_semi").unionByName(e.join(ends.toDF("n2form", "n2"), ["n2form", "n2"], "left_semi")).distinct()
        mine = mine.join(there.toDF("n1form", "n1"), ["n1form", "n1"], "left_semi").join(there.toDF("n2form", "n2"), ["n2form", "n2"], "left_semi")
        top = target.top
        new = Layer(top.name, overlay(top.nodes, rows.select(*COLUMNS)), top.edges.unionByName(mine.select(*EDGE)).distinct())
        return View((new, *target.layers[1:]))

    def move(self, nodes: DataFrame, dest: int, order: list[int] | None = None) -> View:
        """``movenodes``: all parts of these nodes go to layer ``dest``; where several layers
        have a value the first in ``order`` (by default top first) wins."""
        order = list(range(len(self.layers))) if order is None else order
        chosen = nodes.select(*NODE).distinct()
        parts = union_all(self.layers[i].nodes.join(chosen, NODE, "left_semi").withColumn("_prio", F.lit(-n)) for n, i in enumerate(order))
        body = F.struct("_prio", "has_valu", "props", "tags", "tagprops", "nodedata")
        whole = parts.groupBy(*NODE).agg(stack(body).alias("_l")).select(*NODE, fold(F.col("_l")).alias("_r")).select(*NODE, "_r.*")
        out = []
        for i, x in enumerate(self.layers):
            left = x.nodes.join(chosen, NODE, "left_anti")
            out.append(Layer(x.name, left.unionByName(whole) if i == dest else left, x.edges))
        return View(tuple(out))

    def prop_values(self, form: str, prop: str) -> DataFrame:
        return self.nodes().where(F.col("form") == form).select(F.try_element_at("props", F.lit(prop)).alias("valu")).where("valu IS NOT NULL").distinct()

    def prop_count(self, form: str, prop: str) -> DataFrame:
        """The sum over layers, without masking: a value that a fork overrides counts twice."""
        return union_all(x.prop_count(form, prop) for x in self.layers).agg(F.sum("count").alias("count"))

    def form_counts(self) -> DataFrame:
        return union_all(x.form_counts() for x in self.layers).groupBy("form").agg(F.sum("count").alias("count"))


def _globbed(key: Column, globs: list[str] | None, none: bool) -> Column:
    return F.lit(none) if globs is None else F.coalesce(F.array_contains(F.array(*[key.rlike(unwild(g)) for g in globs]), True), F.lit(False)) if globs else F.lit(False)


def overlay(low: DataFrame, high: DataFrame) -> DataFrame:
    """One layer's nodes with another's laid over them; tag times unite."""
    h = high.select(*NODE, *[F.col(c).alias(f"_{c}") for c in COLUMNS[2:]])
    j = low.join(h, NODE, "full_outer")
    none = {c: F.expr(f"cast(map() as {k})") for c, k in _KIND.items()}
    a = {c: F.coalesce(F.col(c), none[c]) for c in _KIND}
    b = {c: F.coalesce(F.col(f"_{c}"), none[c]) for c in _KIND}
    tags = F.map_zip_with(a["tags"], b["tags"], lambda _, x, y: merged_interval(x, y))
    return j.select(
        *NODE, (F.coalesce("has_valu", F.lit(False)) | F.coalesce("_has_valu", F.lit(False))).alias("has_valu"), over(a["props"], b["props"]).alias("props"),
        tags.alias("tags"), _JOIN["tagprops"](a["tagprops"], b["tagprops"]).alias("tagprops"), over(a["nodedata"], b["nodedata"]).alias("nodedata"),
    )
