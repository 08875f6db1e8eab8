"""Lifts: scans of forms, properties, tags, tag properties and node data.

In mid-pipeline a lift appends its rows to those that come in: ``stream.union(lift(...))``.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.errors import BadArg, NoSuchProp
from graphloom.graph import Graph, Stream, iden, q, union_all, valu_text, variables
from graphloom.model import Form
from graphloom.plans.scratch import cut
from graphloom.types import Array, Type, overlap, unwild


def lift(graph: Graph, target: str, op: str | None = None, valu=None) -> Stream:
    """``form``, ``form:prop``, a glob or an interface, or those compared with a value.

    ``form:a::b`` compares through references, see :func:`lift_embed`. With ``in=`` a value
    that is listed twice gives its rows twice.
    """
    if "::" in target:
        return lift_embed(graph, target, op, valu)
    forms, prop = graph.model.split(target)
    out = {}
    for f in forms:
        df = graph.frame(f)
        col, kind = column_of(f, prop)
        if op is None:
            out[f.name] = df.where(col.isNotNull()) if prop else df
        elif op.lstrip("*") == "in=" and len(vals := [kind.norm(v) for v in valu]) > len(set(vals)):
            listed = union_all(df.where(kind.compare(col, "=", v)) for v in vals)
            out[f.name] = listed
        else:
            out[f.name] = df.where(kind.compare(col, op, valu))
    return graph.stream(out)


def column_of(form: Form, prop: str | None) -> tuple[Column, Type]:
    if prop is None:
        return form.valu(), form.type
    p = form.prop(prop)
    return q(p.column), p.type


def embed(graph: Graph, form: Form, df: DataFrame, path: list[str], out: str) -> tuple[DataFrame, Type]:
    """Adds column ``out``: the property at the end of ``a::b::c``, null where a step is missing."""
    name, *rest = path
    p = form.prop(name)
    if not rest:
        return df.withColumn(out, q(p.column)), p.type
    if not p.ref:
        raise NoSuchProp(f"{form.name}:{name} refers to no form")
    target = graph.model.form(p.ref)
    right, kind = embed(graph, target, graph.frame(target), rest, out)
    right = right.select(target.valu().alias("_k"), q(out))
    return df.join(right, q(p.column) == F.col("_k"), "left").drop("_k"), kind


def lift_embed(graph: Graph, target: str, op: str | None, valu=None) -> Stream:
    """``form:a::b=v``: an equi-join per step, the comparison at the far end."""
    head, *rest = target.split("::")
    forms, prop = graph.model.split(head)

    def one(f: Form) -> DataFrame:
        df, kind = embed(graph, f, graph.frame(f), [prop, *rest], "_e")
        return df.where(kind.compare(F.col("_e"), op, valu) if op else F.col("_e").isNotNull()).drop("_e")

    return graph.stream({f.name: one(f) for f in forms})


def lift_array(graph: Graph, target: str, op: str, valu) -> Stream:
    """``form:prop*[op valu]``: a row for each element that matches."""
    forms, prop = graph.model.split(target)

    def one(f: Form) -> DataFrame:
        p = f.prop(prop)
        if not isinstance(p.type, Array):
            raise BadArg(f"{target} is no array")
        return graph.frame(f).withColumn("_e", F.explode(p.column)).where(p.type.elem.compare(F.col("_e"), op, valu)).drop("_e")

    return graph.stream({f.name: one(f) for f in forms})


def lift_tag(graph: Graph, tag: str, form: str = "*", at=None) -> Stream:
    """``#tag`` and ``form#tag``, with ``@=`` an interval that the tag's must meet."""
    from graphloom.operators.filters import tag_overlaps

    def one(f: Form) -> DataFrame:
        df = graph.frame(f)
        return df.where(graph.has_tag(f, df, tag) if at is None else tag_overlaps(F.try_element_at(graph.tags(f, df), F.lit(tag)), at))

    return graph.stream({f.name: one(f) for f in tagged_forms(graph, form)})


def tagged_forms(graph: Graph, form: str) -> list[Form]:
    """Forms that can have tags at all; the others needn't be scanned."""
    return [f for f in graph.model.resolve(form) if f.tags or "tags" in graph.frame(f).columns]


def lift_tags(graph: Graph, tags: list[str], form: str = "*") -> Stream:
    """Rows with any of the tags, each once."""
    def one(f: Form) -> DataFrame:
        df = graph.frame(f)
        return df.where(reduce(or_, [graph.has_tag(f, df, t) for t in tags]))

    return graph.stream({f.name: one(f) for f in tagged_forms(graph, form)})


def lift_tagprop(graph: Graph, tag: str | None, prop: str, kind: Type, op: str | None = None, valu=None, form: str = "*") -> Stream:
    """``#tag:prop`` and ``form#tag:prop``, compared or not; without a tag any tag's property counts."""
    def one(f: Form) -> DataFrame:
        df = graph.frame(f)
        tp = graph.tagprops(df)
        if tag is None:
            return df.where(F.exists(F.map_values(tp), lambda m: F.map_contains_key(m, prop)))
        col = F.try_element_at(F.try_element_at(tp, F.lit(tag)), F.lit(prop))
        return df.where(col.isNotNull() if op is None else kind.compare(kind.norm_col(col), op, valu))

    return graph.stream({f.name: one(f) for f in graph.model.resolve(form) if "tagprops" in graph.frame(f).columns})


def lift_tag_tag(tagtags: DataFrame, tag: str, depth: int = 64) -> DataFrame:
    """``##tag``: the tag and all tags that carry it, directly or through others.

    ``tagtags(tag, on)``: tag ``on`` carries ``tag``. A frontier of new names alone is
    joined in each round, so cycles end.
    """
    spark = tagtags.sparkSession
    seen = frontier = spark.createDataFrame([(tag,)], "tag string")
    for _ in range(depth):
        frontier = cut(tagtags.join(frontier, "tag").select(F.col("on").alias("tag")).distinct().join(seen, "tag", "left_anti"), "tags")
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier)
    raise BadArg(f"tags nest deeper than {depth}")


def lift_nodedata(graph: Graph, name: str, form: str = "*") -> Stream:
    fs = [f for f in graph.model.resolve(form) if "nodedata" in graph.frame(f).columns]
    return graph.stream({f.name: graph.frame(f).where(F.map_contains_key("nodedata", name)) for f in fs})


def lift_idens(graph: Graph, idens: list[str], form: str = "*") -> Stream:
    """Nodes by iden, over all forms; idens that aren't 64 hex digits are ignored."""
    good = [i for i in idens if len(i) == 64 and all(c in "0123456789abcdef" for c in i)]
    return graph.stream({
        f.name: graph.frame(f).where(iden(F.lit(f.name), valu_text(f)).isin(good)) for f in graph.model.resolve(form)
    })


def yield_values(stream: Stream, var: str, form: str) -> Stream:
    """``yield $x``: nodes of ``form`` whose primary value is in array or scalar ``$x``,
    together with the rows that came in."""
    f = stream.graph.model.form(form)
    right = stream.graph.frame(f)

    def seeds(df: DataFrame) -> DataFrame:
        kind = dict(df.dtypes)[f"${var}"]
        return df.select(F.explode(q(f"${var}")).alias("_k") if kind.startswith("array") else q(f"${var}").alias("_k"))

    keys = union_all(seeds(df) for df in stream.frames.values())
    found = right.join(keys, f.valu() == F.col("_k")).drop("_k")
    return stream.graph.stream({form: found}).union(stream)


def lift_by_row(stream: Stream, form: str, prop: str | None, op: str, expr: Column) -> Stream:
    """``form:prop<op>$x``: a lift for each row; comes after the row itself.

    ``expr`` is over the incoming row. An equality is a hash join; ``<``, ``>`` and the
    rest are range conditions, see :func:`graphloom.plans.joins.range_join` for a way that
    scales with large sides on both ends.
    """
    f = stream.graph.model.form(form)
    col, kind = column_of(f, prop)
    right = stream.graph.frame(f).withColumn("_v", col)

    def one(df: DataFrame) -> DataFrame:
        left = df.select(expr.alias("_x"), *[q(v) for v in variables(df)])
        return left.join(right, kind.compare(F.col("_v"), op, F.col("_x"))).drop("_v", "_x")

    found = union_all(one(df) for df in stream.frames.values())
    return stream.union(stream.graph.stream({form: found}))


def lift_type(graph: Graph, kind: type[Type], valu) -> Stream:
    """``type=v``: nodes with the value as primary value, property or array element of a type."""
    out = graph.empty()
    for f in graph.model.forms.values():
        df = graph.frame(f)
        conds = [c.type.compare(q(c.column), "=", valu) for c in f.props.values() if type(c.type) is kind]
        conds += [p.type.any(q(p.column), "=", valu) for p in f.props.values() if isinstance(p.type, Array) and type(p.type.elem) is kind]
        if type(f.type) is kind:
            conds.append(f.type.compare(f.valu(), "=", valu))
        for c in conds:
            out = out.union(graph.stream({f.name: df.where(c)}))
    return out


def prop_values(graph: Graph, target: str) -> DataFrame:
    """Distinct values of a property: ``(valu)``."""
    forms, prop = graph.model.split(target)
    return union_all(graph.frame(f).select(column_of(f, prop)[0].alias("valu")) for f in forms).where("valu IS NOT NULL").distinct()


def tags_by_prefix(graph: Graph, prefix: str, depth: int = 0) -> DataFrame:
    """Distinct tag names at or below ``prefix``, at most ``depth`` levels below if not 0."""
    names = union_all(graph.frame(f).select(F.explode(F.map_keys(graph.tags(f, graph.frame(f)))).alias("tag")) for f in tagged_forms(graph, "*"))
    out = names.where((F.col("tag") == prefix) | F.col("tag").startswith(prefix + ".")).distinct()
    return out.where(F.size(F.split("tag", "[.]")) <= prefix.count(".") + 1 + depth) if depth else out


def glob_tags(tags: Column, glob: str) -> Column:
    return F.filter(F.map_keys(tags), lambda t: t.rlike(unwild(glob)))


def search(providers: list[DataFrame]) -> DataFrame:
    """Providers' ``(prio, iden, ...)`` merged by priority, the best of each iden."""
    hits = union_all(providers)
    best = hits.groupBy("iden").agg(F.min_by(F.struct("*"), F.struct("prio", F.xxhash64(*hits.columns))).alias("r")).select("r.*")
    return best.orderBy("prio", "iden")


def in_interval(c: Column, lo: int, hi: int) -> Column:
    return overlap(c, F.lit(lo), F.lit(hi))
