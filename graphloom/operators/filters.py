"""Filters: conditions are small objects that attach to a typed frame.

Logic is two-valued: a comparison with a missing value is false, so ``-cond`` keeps
the row. A condition either is a column, or (subqueries) joins a flag to the frame first.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import timing
from graphloom.errors import BadArg, NoSuchProp
from graphloom.graph import Graph, Stream, q, union_all
from graphloom.model import Form
from graphloom.types import Array, Ival, Str, Type, overlap, unwild

_fresh = itertools.count()


class Cond:
    def attach(self, graph: Graph, form: Form, df: DataFrame) -> tuple[DataFrame, Column]:
        """The frame, perhaps with helper columns ``_f*``, and a column that is never null."""
        return df, F.coalesce(self.column(graph, form, df), F.lit(False))

    def column(self, graph: Graph, form: Form, df: DataFrame) -> Column:
        raise NotImplementedError

    def __and__(self, other: Cond) -> Cond:
        return Both(self, other, all=True)

    def __or__(self, other: Cond) -> Cond:
        return Both(self, other, all=False)

    def __invert__(self) -> Cond:
        return Not(self)


@dataclass(frozen=True)
class Both(Cond):
    a: Cond
    b: Cond
    all: bool

    def attach(self, graph, form, df):
        df, x = self.a.attach(graph, form, df)
        df, y = self.b.attach(graph, form, df)
        return df, (x & y if self.all else x | y)


@dataclass(frozen=True)
class Not(Cond):
    a: Cond

    def attach(self, graph, form, df):
        df, x = self.a.attach(graph, form, df)
        return df, ~x


@dataclass(frozen=True)
class Prop(Cond):
    """``:prop``, ``:prop<op>v``, ``:a::b<op>v``; forms without the property don't match."""

    path: str
    op: str | None = None
    valu: object = None

    def attach(self, graph, form, df):
        from graphloom.operators.lifts import embed

        head, *rest = self.path.split("::")
        if head not in form.props:
            return df, F.lit(False)
        if not rest:
            p = form.props[head]
            c = q(p.column).isNotNull() if self.op is None else p.type.compare(q(p.column), self.op, self.valu)
            return df, F.coalesce(c, F.lit(False))
        name = f"_f{next(_fresh)}"
        df, kind = embed(graph, form, df, [head, *rest], name)
        c = q(name).isNotNull() if self.op is None else kind.compare(q(name), self.op, self.valu)
        return df, F.coalesce(c, F.lit(False))


@dataclass(frozen=True)
class IsForm(Cond):
    """``form``, ``form:prop``, ``form:prop<op>v``, globs and interfaces."""

    target: str
    op: str | None = None
    valu: object = None

    def attach(self, graph, form, df):
        try:
            forms, prop = graph.model.split(self.target)
        except NoSuchProp:
            raise
        if form.name not in {f.name for f in forms}:
            return df, F.lit(False)
        if prop:
            return Prop(prop, self.op, self.valu).attach(graph, form, df)
        if self.op is None:
            return df, F.lit(True)
        return df, F.coalesce(form.type.compare(form.valu(), self.op, self.valu), F.lit(False))


@dataclass(frozen=True)
class ArrayHas(Cond):
    """``:prop*[<op> v]``: any element matches."""

    prop: str
    op: str
    valu: object

    def column(self, graph, form, df):
        p = form.props.get(self.prop)
        if p is None:
            return F.lit(False)
        if not isinstance(p.type, Array):
            raise BadArg(f"{form.name}:{self.prop} is no array")
        return p.type.any(q(p.column), self.op, self.valu)


def tag_overlaps(interval: Column, valu) -> Column:
    lo, hi = timing.interval(valu)
    return overlap(interval, F.lit(lo), F.lit(hi))


@dataclass(frozen=True)
class Tag(Cond):
    """``#tag``, ``#a.*``, ``#*``, ``#tag@=ival``, ``#tag=ival``, ``#tag!=ival``.

    ``!=`` is true for rows without the tag, unlike that of properties.
    """

    tag: str
    op: str | None = None
    valu: object = None

    def column(self, graph, form, df):
        tags = graph.tags(form, df)
        if self.op is None:
            if self.tag == "*":
                return F.size(tags) > 0
            if "*" in self.tag:
                return F.exists(F.map_keys(tags), lambda t: t.rlike(unwild(self.tag)))
            return graph.has_tag(form, df, self.tag)
        got = F.try_element_at(tags, F.lit(self.tag))
        if self.op == "@=":
            return tag_overlaps(got, self.valu)
        same = F.coalesce(Ival().compare(got, "=", self.valu), F.lit(False))
        if self.op not in ("=", "!="):
            raise BadArg(f"tags have no comparator {self.op}")
        return same if self.op == "=" else ~same


@dataclass(frozen=True)
class TagProp(Cond):
    """``#tag:prop`` (the tag may be a glob) and ``#tag:prop<op>v`` (it may not)."""

    tag: str
    prop: str
    op: str | None = None
    valu: object = None
    kind: Type = Str()

    def column(self, graph, form, df):
        tp = graph.tagprops(df)
        if self.op is None:
            if "*" in self.tag:
                return F.exists(F.map_entries(tp), lambda e: e["key"].rlike(unwild(self.tag)) & F.map_contains_key(e["value"], self.prop))
            return F.map_contains_key(F.try_element_at(tp, F.lit(self.tag)), self.prop)
        if "*" in self.tag:
            raise BadArg("a tag property is compared on one tag")
        got = self.kind.norm_col(F.try_element_at(F.try_element_at(tp, F.lit(self.tag)), F.lit(self.prop)))
        return self.kind.compare(got, self.op, self.valu)


@dataclass(frozen=True)
class Expr(Cond):
    """A column over the row, by name or through the form; its truth as a bool."""

    fn: Callable[[Form], Column] | Column

    def column(self, graph, form, df):
        return (self.fn(form) if callable(self.fn) and not isinstance(self.fn, Column) else self.fn).cast("boolean")


COUNTS: dict[str, Callable[[Column, int], Column]] = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
}


@dataclass(frozen=True)
class Subq(Cond):
    """``{ q }`` and ``{ q }>=3``: rows that the subquery gives for this row.

    The subquery runs once over the distinct keys of all rows; each carries its key in a
    variable, so counting is one aggregation by key and the flag one equi-join.
    """

    query: Callable[[Stream], Stream]
    op: str | None = None
    n: int = 0

    def matches(self, graph: Graph, form: Form, df: DataFrame) -> tuple[DataFrame, list[str]]:
        """``(key columns _k*, n)`` of rows with a result."""
        names = [f"_k{i}" for i in range(len(form.key))]
        var = f"$_src{next(_fresh)}"
        seeds = df.dropDuplicates(list(form.key)).withColumn(var, F.struct(*form.key))
        out = self.query(graph.stream({form.name: seeds}))
        got = [f.select(q(var).alias("_s")) for f in out.frames.values()]
        if not got:
            return graph.spark.createDataFrame([], df.select(*form.key).schema).toDF(*names).withColumn("n", F.lit(0)), names
        found = union_all(got).groupBy("_s").agg(F.count("*").alias("n"))
        return found.select(*[F.col("_s")[k].alias(n) for k, n in zip(form.key, names)], "n"), names

    def attach(self, graph, form, df):
        found, names = self.matches(graph, form, df)
        flag = f"_f{next(_fresh)}"
        on = [q(k) == F.col(n) for k, n in zip(form.key, names)]
        out = df.join(found.withColumnRenamed("n", flag), on, "left").drop(*names)
        n = F.coalesce(q(flag), F.lit(0))
        return out, n > 0 if self.op is None else COUNTS[self.op](n, self.n)


def where(stream: Stream, cond: Cond, keep: bool = True) -> Stream:
    """``+cond`` (``keep``) or ``-cond``.

    A bare subquery is a semi or anti join; a count that no row without results can
    meet is a semi join with the keys that meet it.
    """
    graph = stream.graph

    def one(form: Form, df: DataFrame) -> DataFrame:
        if isinstance(cond, Subq) and (cond.op is None or cond.op in (">=", ">", "=") and cond.n >= (cond.op != ">")):
            found, names = cond.matches(graph, form, df)
            if cond.op:
                found = found.where(COUNTS[cond.op](F.col("n"), cond.n))
            on = [q(k) == F.col(n) for k, n in zip(form.key, names)]
            return df.join(found.drop("n"), on, "left_semi" if keep else "left_anti")
        out, c = cond.attach(graph, form, df)
        out = out.where(c if keep else ~c)
        return out.drop(*[x for x in out.columns if x.startswith("_f") and x not in df.columns])

    return stream.map(one)
