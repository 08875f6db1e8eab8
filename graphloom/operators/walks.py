"""Light edges: untyped links ``(n1)-(verb)>(n2)`` between primary values.

A verb matches exactly. Each :class:`~graphloom.model.Verb` is a frame of its own, so a
walk reads only those that its verbs and forms allow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.errors import BadArg
from graphloom.graph import Graph, Stream, union_all
from graphloom.model import Verb
from graphloom.operators.filters import Cond, where
from graphloom.operators.pivots import hop


def verbs_of(graph: Graph, verbs: list[str]) -> list[Verb]:
    return [v for v in graph.model.verbs if "*" in verbs or v.verb in verbs]


def walk(
    stream: Stream, verbs: list[str], dest: str | list[str] = "*", op: str | None = None, valu=None,
    cond: Cond | None = None, reverse: bool = False, join: bool = False,
) -> Stream:
    """``-(verb)> dest [op valu]`` and ``<(verb)- dest``; ``dest`` is a form, ``form:prop``,
    a list of forms or ``*``, which takes no comparison."""
    from graphloom.operators.filters import IsForm

    graph, found = stream.graph, stream.graph.empty()
    if dest == "*" and op is not None:
        raise BadArg("a walk to any form takes no comparison")
    dests = [dest] if isinstance(dest, str) else dest
    allowed = None if dests == ["*"] else {f.name for d in dests for f in graph.model.split(d)[0]}
    for v in verbs_of(graph, verbs):
        here, there = (v.n2, v.n1) if reverse else (v.n1, v.n2)
        if here not in stream.frames or allowed is not None and there not in allowed:
            continue
        edges = v.frame(graph.tables)
        a, b = ("n2", "n1") if reverse else ("n1", "n2")
        form, target = graph.model.form(here), graph.model.form(there)
        near = hop(stream.frames[here], form.valu(), edges.select(F.col(a).alias("_a"), F.col(b).alias("_b")), F.col("_a"))
        rows = hop(near, F.col("_b"), graph.frame(target), target.valu())
        found = found.union(graph.stream({there: rows}))
    if op is not None:
        found = where(found, IsForm(dests[0], op, valu))
    elif isinstance(dest, str) and dest != "*" and graph.model.split(dest)[1]:
        found = where(found, IsForm(dest))
    if cond is not None:
        found = where(found, cond)
    return stream.union(found) if join else found


def lift_byverb(graph: Graph, verb: str, n2: bool = False) -> Stream:
    """Distinct nodes that an edge of the verb leaves (or, ``n2``, enters)."""
    out = graph.empty()
    for v in verbs_of(graph, [verb]):
        form = graph.model.form(v.n2 if n2 else v.n1)
        keys = v.frame(graph.tables).select(F.col("n2" if n2 else "n1").alias("_k"))
        out = out.union(graph.stream({form.name: graph.frame(form).join(keys, form.valu() == F.col("_k"), "left_semi")}))
    return out


def edges(graph: Graph, verbs: list[str] = ("*",)) -> DataFrame:
    """All light edges as text: ``(n1form, n1, verb, n2form, n2)``."""
    return union_all(
        v.frame(graph.tables).select(
            F.lit(v.n1).alias("n1form"), F.col("n1").cast("string").alias("n1"), F.lit(v.verb).alias("verb"),
            F.lit(v.n2).alias("n2form"), F.col("n2").cast("string").alias("n2"),
        )
        for v in verbs_of(graph, list(verbs))
    )


def edge_verbs(graph: Graph) -> DataFrame:
    return edges(graph).select("verb").distinct()


def references(graph: Graph, among: list[str] | None = None) -> DataFrame | None:
    """All references as edges named by property: the same columns as :func:`edges`. With
    ``among`` those between such forms, other tables unread; None if there can't be any."""
    from graphloom.graph import valu_text

    parts = []
    for f in graph.model.forms.values():
        for name, p, target in graph.model.refs(f):
            if among is not None and not {f.name, target.name} <= set(among):
                continue
            valu = F.explode(p.column) if p.is_array else F.col(p.column)
            parts.append(
                graph.frame(f).select(valu_text(f).alias("n1"), valu.alias("_v")).where("_v IS NOT NULL").select(
                    F.lit(f.name).alias("n1form"), "n1", F.lit(name).alias("verb"), F.lit(target.name).alias("n2form"), F.col("_v").cast("string").alias("n2")
                )
            )
    return union_all(parts) if parts else None
