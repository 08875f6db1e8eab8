"""Commands: limits, distinct rows, top-k, counts, set operations, recursion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.errors import BadArg
from graphloom.graph import Graph, Stream, q, union_all, valu_text, variables
from graphloom.model import Form
from graphloom.plans.scratch import cut

Query = Callable[[Stream], Stream]
#: The most rows ``max`` and ``min`` keep.
MAX_SIZE = 100


def limit(stream: Stream, n: int) -> Stream:
    """The first ``n`` rows by form and primary value. ``limit 0`` still gives one row, as
    the check follows the row."""
    n = max(1, n)
    if len(stream.frames) == 1:
        return stream.map(lambda form, df: df.orderBy(*form.key).limit(n))
    heads = stream.map(lambda form, df: df.orderBy(*form.key).limit(n))
    marked = union_all(
        df.select(F.lit(name).alias("form"), F.row_number().over(Window.orderBy(*stream.graph.model.form(name).key)).alias("i"))
        for name, df in heads.frames.items()
    )
    quota = {r["form"]: r["n"] for r in marked.orderBy("form", "i").limit(n).groupBy("form").agg(F.count("*").alias("n")).collect()}
    return heads.map(lambda form, df: df.orderBy(*form.key).limit(quota[form.name]) if form.name in quota else None)


def uniq(stream: Stream, by: Callable[[Form], Column] | str | None = None) -> Stream:
    """One row per node, or (``by`` a property or column) per value: that of the smallest key."""
    def one(form: Form, df: DataFrame) -> DataFrame:
        if by is None:
            return df.dropDuplicates(list(form.key))
        c = q(form.prop(by).column) if isinstance(by, str) else by(form)
        rows = df.withColumn("_u", c).where("_u IS NOT NULL")
        return rows.groupBy("_u").agg(F.min_by(F.struct(*[q(x) for x in df.columns]), F.struct(*form.key)).alias("_r")).select("_r.*")

    return stream.map(one)


def _ranked(form: Form, df: DataFrame, by: str | Column | Callable, end: str) -> Column:
    c = q(form.prop(by.lstrip(":")).column) if isinstance(by, str) else by(form) if callable(by) and not isinstance(by, Column) else by
    kind = df.select(c.alias("_")).schema[0].dataType.simpleString()
    return c[end] if kind.startswith("struct<min:") else c


def top(stream: Stream, by: str | Column | Callable[[Form], Column], size: int = 1, largest: bool = True) -> Stream:
    """``max`` and ``min``: rows of the largest or smallest values; nulls are skipped,
    intervals count by their end or start, ties go by primary value. Each task keeps
    ``size`` rows at most. Only streams of one form."""
    if not 0 < size <= MAX_SIZE:
        raise BadArg(f"size must be from 1 to {MAX_SIZE}")

    def one(form: Form, df: DataFrame) -> DataFrame:
        v = df.withColumn("_v", _ranked(form, df, by, "max" if largest else "min")).where("_v IS NOT NULL")
        return v.orderBy(F.desc("_v") if largest else F.asc("_v"), *form.key).limit(size).drop("_v")

    if len(stream.frames) > 1:
        raise BadArg("max and min rank rows of one form")
    return stream.map(one)


def count(stream: Stream) -> DataFrame:
    """One row: ``count``."""
    return stream.ndefs().agg(F.count("*").alias("count"))


def spin(stream: Stream) -> Stream:
    """No rows; whatever feeds the stream isn't run."""
    return stream.map(lambda form, df: df.limit(0))


def countby(
    stream: Stream, by: str | Callable[[Form], Column], by_name: bool = False, reverse: bool = False, size: int | None = None, percent: bool = False
) -> DataFrame:
    """``stats.countby``: ``(valu, count)`` of values as text, by count (largest first) or
    name; ``percent`` adds the share of all counted rows; null values don't count."""
    def values(name: str, df: DataFrame) -> DataFrame:
        form = stream.graph.model.form(name)
        if isinstance(by, str):
            p = form.prop(by.lstrip(":"))
            c = p.type.repr_col(q(p.column))
        else:
            c = by(form).cast("string")
        return df.select(c.alias("valu"))

    out = union_all(values(n, df) for n, df in stream.frames.items()).where("valu IS NOT NULL").groupBy("valu").agg(F.count("*").alias("count"))
    if percent:
        out = out.crossJoin(out.agg(F.sum("count").alias("_t"))).withColumn("percent", F.col("count") * 100.0 / F.col("_t")).drop("_t")  # one row on the right
    order = [F.asc("valu")] if by_name else [F.desc("count"), F.asc("valu")]
    if reverse:
        order = [F.desc("valu")] if by_name else [F.asc("count"), F.asc("valu")]
    return out.orderBy(*order).limit(size) if size else out.orderBy(*order)


def chart(rows: DataFrame, width: int = 40, char: str = "#") -> str:
    """The bars that a printed ``countby`` shows, at most 1000 values."""
    got = rows.limit(1000).collect()
    most = max((r["count"] for r in got), default=1)
    left = max((len(r["valu"]) for r in got), default=0)
    return "\n".join(f"{r['valu']:>{left}} | {r['count']} | {char * (r['count'] * width // most)}" for r in got)


def tally(stream: Stream, name: str, valu: str | None = None) -> DataFrame:
    """``$tally.inc(name, valu)`` over all rows: ``(name, total)``."""
    def one(n: str, df: DataFrame) -> DataFrame:
        form = stream.graph.model.form(n)
        v = q(form.prop(valu).column) if valu else F.lit(1)
        return df.select(q(form.prop(name).column).cast("string").alias("name"), v.alias("v"))

    return union_all(one(n, df) for n, df in stream.frames.items()).groupBy("name").agg(F.sum("v").alias("total"))


def tee(stream: Stream, queries: list[Query], join: bool = False) -> Stream:
    """Each query's rows one after another; ``join`` adds those that came in."""
    out = stream.graph.empty()
    for query in queries:
        out = out.union(query(stream))
    return out.union(stream) if join else out


def intersect(stream: Stream, query: Query) -> Stream:
    """Nodes that the query gives for every row that came in. Emissions count, so a row that
    leads to a node twice counts twice."""
    total = count(stream).withColumnRenamed("count", "_n")

    def one(form: Form, df: DataFrame) -> DataFrame:
        met = df.groupBy(*form.key).agg(F.count("*").alias("_c"))
        full = met.join(F.broadcast(total), F.col("_c") == F.col("_n")).select(*form.key)  # one row
        return df.dropDuplicates(list(form.key)).join(full, list(form.key), "left_semi")

    return query(stream).map(one)


def tree(stream: Stream, query: Query, depth: int = 64) -> Stream:
    """Roots and all that repeated use of the query leads to, each as often as it is reached.
    A tree deeper than ``depth`` is an error (so are cycles)."""
    out = frontier = stream
    for _ in range(depth):
        frontier = query(frontier).map(lambda form, df: cut(df, "tree"))
        frontier = frontier.map(lambda form, df: None if df.isEmpty() else df)
        if not frontier.frames:
            return out
        out = out.union(frontier)
    raise BadArg(f"the tree is deeper than {depth}")


def once(stream: Stream, name: str, state: DataFrame, now: int, asof: int | None = None) -> tuple[Stream, DataFrame]:
    """Rows that haven't passed under ``name`` yet (or not since ``asof``), and the new state.

    ``state(name, iden, ts)`` holds one row for each node that passed.
    """
    done = state.where((F.col("name") == name) & (F.lit(True) if asof is None else F.col("ts") >= asof)).select(F.col("iden").alias("_i"))

    def one(form: Form, df: DataFrame) -> DataFrame:
        from graphloom.graph import iden

        return df.withColumn("_i", iden(F.lit(form.name), valu_text(form))).join(done, "_i", "left_anti").drop("_i")

    passed = stream.map(one)
    fresh = passed.idens().select(F.lit(name).alias("name"), "iden", F.lit(now).alias("ts")).distinct()
    kept = state.join(fresh.select("name", "iden"), ["name", "iden"], "left_anti")
    return passed, kept.unionByName(fresh)


def batch(stream: Stream, size: int, fn: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """``(form, valu, batch)``: rows in batches of at most ``size`` (up to 10000).

    Batches are filled within partitions, so no row moves; all but the last of a partition
    are full. ``fn`` may work on the batched rows.
    """
    if not 0 < size <= 10_000:
        raise BadArg("batches hold 1 to 10000 rows")
    rows = stream.ndefs().withColumn("_i", F.monotonically_increasing_id())
    part, at = F.shiftright("_i", 33), F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))
    out = rows.withColumn("batch", F.shiftleft(part, 33) + F.floor(at / size).cast("long")).drop("_i")
    return fn(out, size) if fn else out


def divert(cond: bool, stream: Stream, query: Query) -> Stream:
    """The query's rows if ``cond``, else those that came in (the query isn't run)."""
    return query(stream) if cond else stream


def parallel(stream: Stream, query: Query, size: int = 8) -> Stream:
    """The query over ``size`` partitions; for queries that wait for other services."""
    return query(stream.map(lambda form, df: df.repartition(size)))


def colorize(stream: Stream, color: str) -> Stream:
    import re

    if not re.fullmatch(r"#[0-9a-fA-F]{6}|[a-z]+", color):
        raise BadArg(f"not a colour: {color}")
    return stream.map(lambda form, df: df.withColumn("$_color", F.lit(color)))


def view_exec(stream: Stream, other: Graph, query: Callable[[Graph], object]) -> Stream:
    """Runs a query in another view for its effect; the rows pass through."""
    query(other)
    return stream


def macro_set(graph: Graph, name: str, query: Query) -> None:
    graph.macros[name] = query


def macro_exec(stream: Stream, name: str) -> Stream:
    if name not in stream.graph.macros:
        raise BadArg(f"no macro {name}")
    return stream.graph.macros[name](stream)


def background(graph: Graph, query: Callable[[Graph], object]):
    """Starts a query in a thread of its own and returns that thread."""
    import threading

    t = threading.Thread(target=lambda: query(graph), daemon=True)
    t.start()
    return t


def node_repr(stream: Stream) -> DataFrame:
    """``(form, valu, repr)`` with the value as it is shown."""
    return union_all(
        df.select(F.lit(n).alias("form"), valu_text(f := stream.graph.model.form(n)).alias("valu"), f.type.repr_col(f.valu()).alias("repr") if len(f.key) == 1 else valu_text(f).alias("repr"))
        for n, df in stream.frames.items()
    )


def keep_variables(df: DataFrame) -> list[str]:
    return variables(df)
