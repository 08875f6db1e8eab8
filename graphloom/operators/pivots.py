"""Pivots: equi-joins along references, resolved from the model while the plan is built.

Duplicates stay: each match gives a row. With ``join=True`` the rows that came in stay
in the stream beside what they lead to (a union, not a pairing).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.errors import NoSuchPivot
from graphloom.graph import Graph, Stream, q, variables
from graphloom.model import Form, Prop, with_parents
from graphloom.operators.filters import Cond, where
from graphloom.types import unwild


def hop(src: DataFrame, src_key: Column, dst: DataFrame, dst_key: Column) -> DataFrame:
    """Rows of ``dst`` for each row of ``src`` with the same key; variables come along."""
    left = src.select(src_key.alias("_j"), *[q(v) for v in variables(src)])
    right = dst.withColumn("_k", dst_key)
    return left.join(right, F.col("_j") == F.col("_k")).drop("_j", "_k")


def _each(c: Column, prop: Prop) -> Column:
    return F.explode(c) if prop.is_array else c


def out_of(graph: Graph, form: Form, df: DataFrame, prop: Prop, target: Form) -> DataFrame:
    """Along one reference, to its target form."""
    return hop(df, _each(q(prop.column), prop), graph.frame(target), target.valu())


def into(graph: Graph, form: Form, df: DataFrame, source: Form, prop: Prop) -> DataFrame:
    """Against one reference: rows of ``source`` whose property holds this node's value."""
    return hop(df, form.valu(), graph.frame(source), _each(q(prop.column), prop))


def _finish(stream: Stream, found: Stream, join: bool) -> Stream:
    return stream.union(found) if join else found


def pivot_out(stream: Stream, join: bool = False, edges: bool = False) -> Stream:
    """``-> *``: all references of all forms; with ``edges`` light edges too (``--> *``)."""
    from graphloom.operators.walks import walk

    graph, found = stream.graph, stream.graph.empty()
    for name, df in stream.frames.items():
        form = graph.model.form(name)
        for _, p, target in graph.model.refs(form):
            src = df
            if target.name == name and not p.is_array:
                src = df.where(q(p.column) != form.valu())  # a node that refers to itself doesn't lead to itself
            found = found.union(graph.stream({target.name: out_of(graph, form, src, p, target)}))
    if edges:
        found = found.union(walk(stream, ["*"]))
    return _finish(stream, found, join)


def pivot_in(stream: Stream, join: bool = False, edges: bool = False) -> Stream:
    """``<- *``: all nodes with a reference to these; with ``edges`` light edges too (``<-- *``)."""
    from graphloom.operators.walks import walk

    graph, found = stream.graph, stream.graph.empty()
    for name, df in stream.frames.items():
        form = graph.model.form(name)
        for source in graph.model.forms.values():
            for _, p, _ in graph.model.refs(source, form):
                found = found.union(graph.stream({source.name: into(graph, form, df, source, p)}))
    if edges:
        found = found.union(walk(stream, ["*"], reverse=True))
    return _finish(stream, found, join)


def pivot(stream: Stream, dest: str | list[str], join: bool = False) -> Stream:
    """``-> form``, ``-> form:prop``, a glob, an interface or a list of those.

    To a form: along all references to it; if there are none, against all references
    from it. To a property: rows where it equals the primary value.
    """
    graph, found = stream.graph, stream.graph.empty()
    for d in [dest] if isinstance(dest, str) else dest:
        targets, prop = graph.model.split(d)
        any_way = False
        for name, df in stream.frames.items():
            form = graph.model.form(name)
            for target in targets:
                if prop:
                    p = target.prop(prop)
                    got = [hop(df, form.valu(), graph.frame(target), _each(q(p.column), p))]
                else:
                    got = [out_of(graph, form, df, p, t) for _, p, t in graph.model.refs(form, target)]
                    if not got:
                        got = [into(graph, form, df, target, p) for _, p, _ in graph.model.refs(target, form)]
                any_way |= bool(got)
                for g in got:
                    found = found.union(graph.stream({target.name: g}))
        if stream.frames and not any_way:
            raise NoSuchPivot(f"{', '.join(stream.frames)} -> {d}")
    return _finish(stream, found, join)


def prop_pivot(stream: Stream, prop: str, dest: str = "*", join: bool = False) -> Stream:
    """``:prop -> *``, ``:prop -> form``, ``:prop -> form:prop``. Arrays on either side
    are exploded; where types differ the source is normalised to the target's type."""
    graph, found = stream.graph, stream.graph.empty()
    for name, df in stream.frames.items():
        form = graph.model.form(name)
        if prop not in form.props:
            continue
        p = form.props[prop]
        if dest == "*":
            for _, _, target in [r for r in graph.model.refs(form) if r[0] == prop]:
                found = found.union(graph.stream({target.name: out_of(graph, form, df, p, target)}))
            continue
        targets, tprop = graph.model.split(dest)
        for target in targets:
            tp = target.prop(tprop) if tprop else None
            kind = tp.type if tp else target.type
            left = _each(q(p.column), p)
            src_kind, dst_kind = (p.type.elem if p.is_array else p.type), (kind.elem if tp and tp.is_array else kind)
            src = df
            if type(src_kind) is not type(dst_kind):
                src = df.withColumn("_v", left)
                left = dst_kind.norm_col(src_kind.repr_col(F.col("_v")))
            right = _each(q(tp.column), tp) if tp else target.valu()
            found = found.union(graph.stream({target.name: hop(src, left, graph.frame(target), right)}))
    return _finish(stream, found, join)


def to_tags(stream: Stream, glob: str | None = None) -> DataFrame:
    """``-> #`` (leaves alone), ``-> #*`` (all), ``-> #a.*``, ``-> #a.b``: ``(tag, base, depth)``,
    a row for each tag of each row."""
    from graphloom.graph import union_all

    def names(name: str, df: DataFrame) -> DataFrame:
        form = stream.graph.model.form(name)
        if form.tags and "tags" not in df.columns:
            tags = F.array_distinct(F.filter(F.array(*form.tags()), lambda t: t.isNotNull()))
            if glob is not None:
                tags = F.array_distinct(F.flatten(F.transform(tags, with_parents)))
        else:
            tags = F.map_keys(stream.graph.tags(form, df))
        df, tags = df.select(tags.alias("_t")), F.col("_t")  # worked out once a row, not for each of its tags
        if glob is None:
            got = F.filter(tags, lambda t: ~F.exists(tags, lambda o: F.startswith(o, F.concat(t, F.lit(".")))))
        elif glob == "*":
            got = tags
        elif "*" in glob:
            got = F.filter(tags, lambda t: t.rlike(unwild(glob)))
        else:
            got = F.filter(tags, lambda t: t == glob)
        return df.select(F.explode(got).alias("tag"))

    return union_all(names(n, df) for n, df in stream.frames.items()).select(
        "tag", F.element_at(F.split("tag", "[.]"), -1).alias("base"), (F.size(F.split("tag", "[.]")) - 1).alias("depth")
    )


def from_tags(graph: Graph, tags: DataFrame, dest: str) -> Stream:
    """``syn:tag -> form``: nodes that have any of ``tags(tag)``, a row for each."""
    out = {}
    for f in graph.model.resolve(dest):
        df = graph.frame(f)
        if f.tags or "tags" in df.columns:
            out[f.name] = df.withColumn("_t", F.explode(F.map_keys(graph.tags(f, df)))).join(tags.select(F.col("tag").alias("_t")), "_t").drop("_t")
    return graph.stream(out)


def raw_pivot(stream: Stream, query: Callable[[Stream], Stream]) -> Stream:
    """``-> { q }``: what the subquery gives replaces the stream; variables come along."""
    return query(stream)


def pivot_where(stream: Stream, dest: str, cond: Cond, join: bool = False) -> Stream:
    """A pivot whose targets are filtered."""
    found = where(pivot(stream, dest), cond)
    return _finish(stream, found, join)
