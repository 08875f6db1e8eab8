"""Graph projection: all nodes within some degrees of the seeds, and the edges between them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph, Stream, union_all
from graphloom.operators import walks
from graphloom.operators.filters import Cond, where
from graphloom.operators.pivots import pivot_in, pivot_out
from graphloom.plans.scratch import cut


@dataclass(frozen=True)
class Rules:
    """What a projection follows. A node that a filter drops is omitted and leads nowhere.

    ``maxsize`` is the most nodes a projection shows, ``edgelimit`` the most edges of a node
    that is still expanded; both only where asked for: without them a projection is whole.
    """

    degrees: int = 1
    refs: bool = True
    edges: bool = True
    inbound: bool = False
    filters: tuple[Cond, ...] = ()
    filterinput: bool = True
    pivots: tuple[Callable[[Stream], Stream], ...] = ()
    form_pivots: dict[str, tuple[Callable[[Stream], Stream], ...]] = field(default_factory=dict)
    form_filters: dict[str, tuple[Cond, ...]] = field(default_factory=dict)
    maxsize: int | None = None
    edgelimit: int | None = None


def keys(stream: Stream) -> Stream:
    """Distinct nodes with their full rows."""
    return stream.map(lambda form, df: df.dropDuplicates(list(form.key)))


def _filtered(stream: Stream, rules: Rules) -> Stream:
    for c in rules.filters:
        stream = where(stream, c)
    for name, conds in rules.form_filters.items():
        if name in stream.frames:
            one = stream.graph.stream({name: stream.frames[name]})
            for c in conds:
                one = where(one, c)
            stream = stream.graph.stream({**stream.frames, name: one.frames[name]})
    return stream


def _step(stream: Stream, rules: Rules) -> Stream:
    out = stream.graph.empty()
    if rules.refs:
        out = out.union(pivot_out(stream))
    if rules.edges:
        out = out.union(walks.walk(stream, ["*"]))
    if rules.inbound:
        out = out.union(pivot_in(stream, edges=rules.edges))
    for p in rules.pivots:
        out = out.union(p(stream))
    for name, ps in rules.form_pivots.items():
        if name in stream.frames:
            for p in ps:
                out = out.union(p(stream.graph.stream({name: stream.frames[name]})))
    return out


def _without_stars(stream: Stream, rules: Rules) -> Stream:
    """Rows with at most ``edgelimit`` outbound light edges."""
    if rules.edgelimit is None or not rules.edges or not stream.graph.model.verbs:
        return stream

    def one(form, df):
        own = [v for v in stream.graph.model.verbs if v.n1 == form.name]
        if not own:
            return df
        ends = union_all(v.frame(stream.graph.tables).select("n1") for v in own)
        stars = ends.groupBy("n1").agg(F.count("*").alias("n")).where(F.col("n") > rules.edgelimit)
        return df.join(stars, form.valu() == F.col("n1"), "left_anti")

    return stream.map(one)


def project(seeds: Stream, rules: Rules) -> tuple[Stream, DataFrame]:
    """``(nodes, edges)``; the nodes carry ``$degree``.

    One round of joins per degree; only nodes not seen before go on, and each round is
    written to the shared folder, so the plan stays flat.
    """
    graph = seeds.graph
    level = keys(_filtered(seeds, rules) if rules.filterinput else seeds)
    level = level.map(lambda form, df: cut(df.withColumn("$degree", F.lit(0)), "graph"))
    seen = level
    for d in range(1, rules.degrees + 1):
        found = _filtered(_step(_without_stars(level, rules), rules), rules)

        def fresh(form, df, d=d):
            new = df.drop("$degree").dropDuplicates(list(form.key))
            if form.name in seen.frames:
                new = new.join(seen.frames[form.name].select(*form.key), list(form.key), "left_anti")
            return cut(new.withColumn("$degree", F.lit(d)), "graph")

        level = found.map(fresh)
        level = level.map(lambda form, df: None if df.isEmpty() else df)
        if not level.frames:
            break
        seen = seen.union(level)
    if rules.maxsize is not None:
        seen = _first(seen, rules.maxsize)
    return seen, edges_within(graph, seen, rules)


def _first(nodes: Stream, most: int) -> Stream:
    if nodes.ndefs().count() <= most:
        return nodes
    first = nodes.idens().join(nodes.ndefs("$degree"), ["form", "valu"]).orderBy("$degree", "form", "iden").limit(most)
    from graphloom.graph import valu_text

    kept = cut(first.select("form", F.col("valu").alias("_v")), "graph")
    return nodes.map(lambda form, df: df.join(kept.where(F.col("form") == form.name).select("_v"), valu_text(form) == F.col("_v"), "left_semi"))


def edges_within(graph: Graph, nodes: Stream, rules: Rules) -> DataFrame:
    """Edges (and references) with both ends among the nodes."""
    parts = [walks.edges(graph)] if rules.edges and graph.model.verbs else []
    refs = walks.references(graph, nodes.forms()) if rules.refs else None
    parts += [] if refs is None else [refs]
    if not parts:
        return graph.spark.createDataFrame([], "n1form string, n1 string, verb string, n2form string, n2 string")
    ends = nodes.ndefs()
    n1 = ends.select(F.col("form").alias("n1form"), F.col("valu").alias("n1"))
    n2 = ends.select(F.col("form").alias("n2form"), F.col("valu").alias("n2"))
    return union_all(parts).join(n1, ["n1form", "n1"], "left_semi").join(n2, ["n2form", "n2"], "left_semi").select("n1form", "n1", "verb", "n2form", "n2")
