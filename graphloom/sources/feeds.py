"""Feeds in and out: packed nodes as JSON lines, CSV, layer dumps, exports, blobs."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import TAGPROPS, TAGS
from graphloom.plans.layers import Layer, View
from graphloom.streaming import editlog

#: A packed node, one per line: ``[[form, valu], {props, tags, tagprops, nodedata, edges}]``.
BODY = "struct<props:map<string,string>,tags:map<string,array<bigint>>,tagprops:map<string,map<string,string>>,nodedata:map<string,string>,edges:array<array<string>>>"


def read_nodes(spark: SparkSession, path: str, columns: bool = False) -> Layer:
    """A feed as a layer. Lines that aren't packed nodes are dropped; edges name their
    target by form and value: ``[verb, form, valu]``."""
    line = F.col("value")
    part = lambda p: F.get_json_object(line, p)
    body = F.from_json(part("$[1]"), BODY)
    rows = spark.read.text(path).select(part("$[0][0]").alias("form"), part("$[0][1]").alias("valu"), body.alias("b")).where("form IS NOT NULL AND valu IS NOT NULL")
    none = lambda kind: F.expr(f"cast(map() as {kind})")
    iv = F.transform_values(F.coalesce("b.tags", none("map<string,array<bigint>>")), lambda _, t: F.when(F.get(t, F.lit(0)).isNotNull(), F.struct(F.get(t, F.lit(0)).alias("min"), F.get(t, F.lit(1)).alias("max"))))
    text = "map<string,string>"
    nodes = rows.select(
        "form", "valu", F.lit(True).alias("has_valu"), F.coalesce("b.props", none(text)).alias("props"), iv.cast(TAGS).alias("tags"),
        F.coalesce("b.tagprops", none(TAGPROPS)).alias("tagprops"), F.coalesce("b.nodedata", none(text)).alias("nodedata"),
    )
    e = rows.select("form", "valu", F.explode("b.edges").alias("e")).where(F.size("e") == 3)
    edges = e.select(F.col("form").alias("n1form"), F.col("valu").alias("n1"), F.col("e")[0].alias("verb"), F.col("e")[1].alias("n2form"), F.col("e")[2].alias("n2")).distinct()
    return Layer("feed", nodes, edges)


def pack(nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Nodes as JSON lines in ``value``; edges only with both ends among them."""
    tags = F.transform_values("tags", lambda _, t: F.array(t["min"], t["max"]))
    rows = nodes
    if edges is not None:
        ends = nodes.select("form", "valu")
        inner = edges.join(ends.toDF("n1form", "n1"), ["n1form", "n1"], "left_semi").join(ends.toDF("n2form", "n2"), ["n2form", "n2"], "left_semi")
        # one line holds the edges of one node, as the format has it
        own = inner.groupBy(F.col("n1form").alias("form"), F.col("n1").alias("valu")).agg(F.sort_array(F.collect_set(F.array("verb", "n2form", "n2"))).alias("edges"))
        rows = nodes.join(own, ["form", "valu"], "left")
    else:
        rows = nodes.withColumn("edges", F.lit(None).cast("array<array<string>>"))
    body = F.struct("props", tags.alias("tags"), "tagprops", "nodedata", "edges")
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    return rows.select(F.concat(F.lit("[["), quoted(F.col("form")), F.lit(","), quoted(F.col("valu")), F.lit("],"), F.to_json(body), F.lit("]")).alias("value"))


def export(view: View, nodes: DataFrame, path: str) -> None:
    """Two passes: the nodes, then the edges between them."""
    pack(nodes, view.edges()).write.mode("overwrite").text(path)


def read_csv(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    return spark.read.option("header", header).option("multiLine", True).option("escape", '"').csv(path)


def csv_nodes(rows: DataFrame, form: str, valu: str, props: dict[str, str]) -> DataFrame:
    """CSV columns as nodes of a form: ``props`` maps property to column."""
    entries = F.map_filter(F.create_map(*[x for p, c in props.items() for x in (F.lit(p), F.col(c).cast("string"))]), lambda _, v: v.isNotNull())
    none = lambda kind: F.expr(f"cast(map() as {kind})")
    return rows.where(F.col(valu).isNotNull()).select(
        F.lit(form).alias("form"), F.col(valu).cast("string").alias("valu"), F.lit(True).alias("has_valu"), entries.alias("props"),
        none(TAGS).alias("tags"), none(TAGPROPS).alias("tagprops"), none("map<string,string>").alias("nodedata"),
    )


def write_csv(rows: DataFrame, path: str, header: bool = True) -> None:
    rows.write.mode("overwrite").option("header", header).option("escape", '"').csv(path)


def dump_layer(layer: Layer, path: str) -> None:
    editlog.to_edits(layer).write.mode("overwrite").parquet(path)


def load_layer(spark: SparkSession, path: str) -> Layer:
    return editlog.replay(spark.read.schema(editlog.SCHEMA).parquet(path))


class Blobs:
    """Bytes by their SHA-256, in a table ``(sha256, size, bytes)``."""

    SCHEMA = "sha256 string, size bigint, bytes binary"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def put(self, rows: DataFrame, column: str = "bytes") -> DataFrame:
        """Adds blobs that aren't there yet; ``(sha256, size)`` of all given."""
        b = F.col(column).cast("binary")
        new = rows.where(b.isNotNull()).select(F.sha2(b, 256).alias("sha256"), F.octet_length(b).cast("bigint").alias("size"), b.alias("bytes"))
        try:
            have = self.rows().select("sha256")
            fresh = new.dropDuplicates(["sha256"]).join(have, "sha256", "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            fresh = new.dropDuplicates(["sha256"])
        fresh.write.mode("append").parquet(self.path)
        return new.select("sha256", "size")

    def put_files(self, glob: str) -> DataFrame:
        return self.put(self.spark.read.format("binaryFile").load(glob).select("content"), "content")

    def has(self, sha256: str) -> bool:
        return not self.rows().where(F.col("sha256") == sha256).isEmpty()

    def size(self, sha256: str) -> int | None:
        r = self.rows().where(F.col("sha256") == sha256).select("size").first()
        return r["size"] if r else None

    def read(self, sha256: str, offs: int = 0, size: int = 1 << 20) -> bytes | None:
        part = F.substring("bytes", F.lit(offs + 1), F.lit(size))
        r = self.rows().where(F.col("sha256") == sha256).select(part).first()
        return bytes(r[0]) if r else None

    def metrics(self) -> DataFrame:
        return self.rows().agg(F.count("*").alias("file_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("size_bytes"))

    def _text(self, sha256: str) -> DataFrame:
        return self.rows().where(F.col("sha256") == sha256).select(F.decode("bytes", "UTF-8").alias("t"))

    def readlines(self, sha256: str) -> DataFrame:
        rows = self._text(sha256).select(F.posexplode(F.split(F.regexp_replace("t", r"\r?\n$", ""), r"\r?\n")).alias("line_no", "line"))
        return rows.orderBy("line_no")

    def jsonlines(self, sha256: str) -> DataFrame:
        return self.readlines(sha256).select("line_no", F.try_parse_json("line").alias("item")).where("item IS NOT NULL")

    def csvrows(self, sha256: str, width: int) -> DataFrame:
        schema = ", ".join(f"c{i} string" for i in range(width))
        return self.readlines(sha256).select("line_no", F.from_csv("line", schema).alias("r")).select("line_no", "r.*")


def stix_bundle(nodes: DataFrame, kinds: dict[str, str], ident: Callable[[Column], Column] | None = None) -> DataFrame:
    """Nodes as STIX 2.1 objects, one JSON text per row; ``kinds`` maps form to object type."""
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("form")]
    digest = F.md5(F.concat_ws("\x00", "form", "valu"))
    uuid = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    body = F.struct(kind.alias("type"), F.lit("2.1").alias("spec_version"), F.concat(kind, F.lit("--"), uuid).alias("id"), F.col("valu").alias("value"), F.map_keys("tags").alias("labels"))
    return nodes.where(F.col("form").isin(list(kinds))).select(F.to_json(body).alias("object"))


def stix_objects(spark: SparkSession, path: str) -> DataFrame:
    """The objects of STIX bundle files: ``(type, id, object)``."""
    docs = spark.read.option("wholetext", True).text(path)
    objs = docs.select(F.explode(F.from_json(F.get_json_object("value", "$.objects"), "array<string>")).alias("object"))
    return objs.select(F.get_json_object("object", "$.type").alias("type"), F.get_json_object("object", "$.id").alias("id"), "object")


def node_json(form: str, valu: str, **body) -> str:
    """One packed node as a feed line."""
    return json.dumps([[form, valu], body])
