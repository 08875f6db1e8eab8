"""Control flow: branches split a stream and join it again; loops build the plan."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.errors import BadArg
from graphloom.graph import Graph, Stream, q
from graphloom.model import Form
from graphloom.operators.filters import Cond, where

Query = Callable[[Stream], Stream]


def if_(stream: Stream, branches: list[tuple[Cond, Query]], otherwise: Query | None = None) -> Stream:
    """``if/elif/else``: each row takes the first branch whose condition holds; without
    ``else`` the others pass."""
    rest, out = stream, stream.graph.empty()
    for cond, query in branches:
        out = out.union(query(where(rest, cond)))
        rest = where(rest, cond, keep=False)
    return out.union(otherwise(rest) if otherwise else rest)


def switch(stream: Stream, value: Callable[[Form], Column] | str, cases: dict[str, Query], default: Query | None = None) -> Stream:
    """Rows go to the case of their value as text; others to ``default`` or through."""
    def text(form: Form) -> Column:
        return (q(form.prop(value).column) if isinstance(value, str) else value(form)).cast("string")

    out = stream.graph.empty()
    for case, query in cases.items():
        out = out.union(query(stream.map(lambda form, df, case=case: df.where(text(form) == case))))
    rest = stream.map(lambda form, df: df.where(~F.coalesce(text(form).isin(list(cases)), F.lit(False))))
    return out.union(default(rest) if default else rest)


def for_each(stream: Stream, items: Iterable, body: Callable[[Stream, object], Stream]) -> Stream:
    """A list known to the driver: the body's rows for each item."""
    out = stream.graph.empty()
    for item in items or ():
        out = out.union(body(stream, item))
    return out


def for_rows(stream: Stream, names: list[str], items: Callable[[Form], Column], body: Query) -> Stream:
    """An array of each row: one copy of the row per item, in ``$name``. With several names
    items are arrays of exactly so many values; null and empty arrays give no rows."""
    def one(form: Form, df: DataFrame) -> DataFrame:
        rows = df.withColumn("_it", F.explode(items(form)))
        if len(names) == 1:
            return rows.withColumn(f"${names[0]}", F.col("_it")).drop("_it")
        bad = F.size("_it") != len(names)
        checked = F.when(bad, F.raise_error(F.lit(f"expected {len(names)} items"))).otherwise(F.lit(0))
        rows = rows.withColumn("_ok", checked)
        return rows.withColumns({f"${n}": F.when(F.col("_ok") == 0, F.get("_it", F.lit(i))) for i, n in enumerate(names)}).drop("_it", "_ok")

    return body(stream.map(one))


def while_(state, cond: Callable[[object], bool], body: Callable[[object], object], rounds: int = 10_000):
    """A loop on the driver over any state; ``rounds`` ends runaways."""
    for _ in range(rounds):
        if not cond(state):
            return state
        state = body(state)
    raise BadArg(f"the loop ran {rounds} times")


def subquery(stream: Stream, query: Query, yield_rows: bool = False) -> Stream:
    """``{ q }`` keeps the row that came in (edits of the query happen elsewhere);
    ``yield { q }`` adds the query's rows."""
    return query(stream).union(stream) if yield_rows else stream


def subquery_value(stream: Stream, query: Query, var: str, array: bool = False, most: int = 128) -> Stream:
    """``$x = { q }``: the primary value of the one node that the query gives for a row
    (more is an error, none is null), or the array of up to ``most``."""
    def one(form: Form, df: DataFrame) -> DataFrame:
        keys = [f"_k{i}" for i in range(len(form.key))]
        seeds = df.dropDuplicates(list(form.key)).withColumn("$_row", F.struct(*form.key))
        out = query(stream.graph.stream({form.name: seeds}))
        rows = None
        for name, frame in out.frames.items():
            part = frame.select(q("$_row").alias("_s"), stream.graph.model.form(name).valu().alias("_v"))
            rows = part if rows is None else rows.union(part)
        bound = most if array else 1
        few = rows.groupBy("_s").agg(F.count("*").alias("_n"))  # only rows within the bound are collected
        many = few.where(F.col("_n") > bound).select("_s", F.raise_error(F.lit(f"subquery gave more than {bound} rows")).cast("string").alias("_e"))
        got = rows.join(few.where(F.col("_n") <= bound), "_s").groupBy("_s").agg(F.array_sort(F.collect_list("_v")).alias("_vs"))
        got = got.join(many, "_s", "full_outer").withColumn("_vs", F.when(F.col("_e").isNull(), F.col("_vs")))
        right = got.select(*[F.col("_s")[k].alias(n) for k, n in zip(form.key, keys)], (F.col("_vs") if array else F.get("_vs", F.lit(0))).alias(f"${var}"))
        return df.join(right, [q(k) == F.col(n) for k, n in zip(form.key, keys)], "left").drop(*keys)

    return stream.map(one)


def init(graph: Graph, stream: Stream, body: Callable[[Graph], Stream | None]) -> Stream:
    """Runs once before the rows; what it yields comes along."""
    got = body(graph)
    return got.union(stream) if got is not None else stream


def fini(stream: Stream, body: Callable[[Stream], Stream | None]) -> Stream:
    """Runs once with the whole stream at hand, for aggregates; what it yields comes along."""
    got = body(stream)
    return stream.union(got) if got is not None else stream


def empty(stream: Stream, body: Callable[[Graph], Stream | None]) -> Stream:
    """Runs only if no row came in."""
    if any(not df.isEmpty() for df in stream.frames.values()):
        return stream
    got = body(stream.graph)
    return got if got is not None else stream


def try_(run: Callable[[], object], catches: dict[str, Callable[[Exception], object]]):
    """Runs once; an error goes to the catch of its class name, or to ``*``."""
    try:
        return run()
    except Exception as e:
        for name in (type(e).__name__, "*"):
            if name in catches:
                return catches[name](e)
        raise
