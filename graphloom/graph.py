"""Graphs and streams.

A :class:`Stream` is what flows between operators: one typed DataFrame per form, so
that a stream of many forms keeps its types, prunes columns and pushes filters down
form by form. Columns named ``$x`` are the variables of a row and travel along
pivots. Streams are multisets: nothing removes duplicates unless it says so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import Form, Model, bare_tags

TAGS = "map<string,struct<min:bigint,max:bigint>>"
TAGPROPS = "map<string,map<string,string>>"


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


class Graph:
    """A model over tables. ``tables`` gives the DataFrame of a table name."""

    def __init__(self, spark: SparkSession, model: Model, tables: Callable[[str], DataFrame]):
        self.spark, self.model, self.tables = spark, model, tables
        self.macros: dict[str, Callable[[Stream], Stream]] = {}
        self.functions: dict[str, Callable[..., Column]] = {}

    @classmethod
    def of_parquet(cls, spark: SparkSession, folder: str, model: Model) -> Graph:
        return cls(spark, model, lambda name: spark.read.parquet(f"{folder}/{name}.parquet"))

    def frame(self, form: Form) -> DataFrame:
        return self.tables(form.table)

    def empty(self) -> Stream:
        return Stream(self, {})

    def stream(self, frames: dict[str, DataFrame]) -> Stream:
        return Stream(self, frames)

    def tags(self, form: Form, df: DataFrame) -> Column:
        """The tag map of a row: its ``tags`` column, else the form's rule, else empty."""
        if "tags" in df.columns:
            return F.coalesce(F.col("tags"), F.create_map().cast(TAGS))
        return bare_tags(*form.tags()) if form.tags else F.create_map().cast(TAGS)

    def has_tag(self, form: Form, df: DataFrame, tag: str) -> Column:
        """Whether a row has a tag. Derived tags are compared as they are, without a map."""
        if "tags" in df.columns or not form.tags:
            return F.coalesce(F.map_contains_key(self.tags(form, df), tag), F.lit(False))
        out = F.lit(False)
        for leaf in form.tags():
            out |= F.coalesce((leaf == tag) | leaf.startswith(tag + "."), F.lit(False))
        return out

    def tagprops(self, df: DataFrame) -> Column:
        if "tagprops" in df.columns:
            return F.coalesce(F.col("tagprops"), F.create_map().cast(TAGPROPS))
        return F.create_map().cast(TAGPROPS)

    def nodedata(self, df: DataFrame) -> Column:
        if "nodedata" in df.columns:
            return F.coalesce(F.col("nodedata"), F.create_map().cast("map<string,string>"))
        return F.create_map().cast("map<string,string>")


def variables(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("$")]


def q(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass(frozen=True)
class Stream:
    graph: Graph
    frames: dict[str, DataFrame]

    def pipe(self, op: Callable[..., Stream], *args, **kwargs) -> Stream:
        return op(self, *args, **kwargs)

    def map(self, fn: Callable[[Form, DataFrame], DataFrame | None]) -> Stream:
        """``fn`` on each form's frame; None drops the form."""
        out = {name: fn(self.graph.model.form(name), df) for name, df in self.frames.items()}
        return replace(self, frames={k: v for k, v in out.items() if v is not None})

    def union(self, other: Stream) -> Stream:
        out = dict(self.frames)
        for name, df in other.frames.items():
            out[name] = out[name].unionByName(df, allowMissingColumns=True) if name in out else df
        return replace(self, frames=out)

    def forms(self) -> list[str]:
        return list(self.frames)

    def df(self, form: str | None = None) -> DataFrame:
        """The frame of one form; the only one if none is named."""
        if form is None:
            (form,) = self.frames
        return self.frames[form]

    def ndefs(self, *more: str) -> DataFrame:
        """All rows as ``(form, valu)`` text, and the named columns that a frame has."""
        if not self.frames:
            return self.graph.spark.createDataFrame([], "form string, valu string")
        return union_all(
            df.select(F.lit(n).alias("form"), valu_text(self.graph.model.form(n)).alias("valu"), *[q(c) for c in more if c in df.columns])
            for n, df in self.frames.items()
        )

    def idens(self) -> DataFrame:
        """``(form, valu, iden)``; the iden is a digest of form and value."""
        return self.ndefs().withColumn("iden", iden(F.col("form"), F.col("valu")))

    def let(self, **exprs: Column | Callable[[Form], Column]) -> Stream:
        """Set row variables: ``let(x=F.col("o_totalprice"))`` adds ``$x``."""
        return self.map(lambda form, df: df.withColumns({f"${k}": v(form) if callable(v) else v for k, v in exprs.items()}))


def valu_text(form: Form) -> Column:
    """A primary value as text; several columns are joined by commas."""
    return F.concat_ws(",", *[F.col(k).cast("string") for k in form.key]) if len(form.key) > 1 else F.col(form.key[0]).cast("string")


def iden(form: Column, valu: Column) -> Column:
    return F.sha2(F.concat(form, F.lit("\x00"), valu), 256)
