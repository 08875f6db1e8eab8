"""Mixing sources to target weights by entropy balancing.

Targets: sources take part by code point (null last) with repeating weights; all
sizes together are shared by weight; a target stops at ``cap`` times its source's
size, and the excess is shared again by weight until none is above.

Rates: each document gets the rate ``min(cap, exp(lambda_s * x))`` with ``x = size /
(size + mean size of its source)``. That is the solution of the convex problem

    minimise  sum_i v_i (r_i log r_i - r_i + 1)   with  sum_i size_i r_i = target_s,
    0 <= r_i <= cap,  v_i = size_i + mean_s

whose dual has one multiplier for each source. Newton steps solve the dual; each
one is a distributed aggregation over a histogram of (source, size), with a bracket
that catches steps going astray. The weights ``v_i`` bound the tilt, so that neither
short nor long documents die out.

Copies: rates become whole copies within chunks of about ``chunk`` documents of one
source, dealt by hash. In a chunk documents come by descending size and each takes
the whole copies that leave the least words over or short of the rates so far, at
most one above or below its own rate and never more than ``cap``; thus each chunk
ends within about half its smallest document of its aim.

Defined cases: null, empty and blank texts have size 0 and no words taken; a null
source is a source of its own; sources without words have target 0; repeated rows
and null ids are rows like others (ties in a chunk go by hash of id and text); an
empty table gives an empty result; extra columns are ignored by :func:`mix` and
returned by :func:`apply_mix`.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import column, discard, materialise, maybe_broadcast, row_key, text_column

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
CHUNK = 4096
TOLERANCE = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``sizes(source, size)`` -> ``(key, source, docs, source_size, target)``, one row for
    each source; ``key`` stands for the source, null included."""
    by = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row for each source
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    by = materialise(by.select(source_key(F.col("source")).alias("key"), "source", "docs", "source_size", weight.alias("weight")), "sources")
    total = by.agg(F.sum("source_size")).first()[0] or 0
    share = 0.0
    while True:
        full = F.col("source_size") * cap <= F.col("weight") * share
        taken, rest = by.agg(F.sum(F.when(full, F.col("source_size") * cap)), F.sum(F.when(~full, F.col("weight")))).first()
        if not rest or not total:
            break
        new = (total - float(taken or 0)) / rest
        if new <= share * (1 + 1e-15):
            break
        share = new
    return by.select("key", "source", "docs", "source_size", F.least(F.col("source_size") * F.lit(float(cap)), F.col("weight") * F.lit(share)).alias("target"))


def source_key(source: Column) -> Column:
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source))


def multipliers(sizes: DataFrame, aims: DataFrame, cap: float = CAP) -> DataFrame:
    """Newton's method on the dual: ``aims`` with ``mean`` and ``lam`` added."""
    counts = materialise(sizes.where("size > 0").groupBy("key", "size").agg(F.count("*").cast("double").alias("n")), "histogram")
    mean = F.greatest(F.col("source_size") / F.col("docs"), F.lit(1.0))
    ratio = F.col("target") / F.col("source_size")
    live = (F.col("source_size") > 0) & (F.col("target") > 0)
    top = math.log(cap)
    state = aims.select(
        "*", mean.alias("mean"),
        F.when(~live, 0.0).when(ratio >= cap * (1 - 1e-12), top * (1 + mean)).otherwise(2 * F.log(F.when(live, ratio).otherwise(1.0))).alias("lam"),
        F.when(live, F.least(F.lit(0.0), F.log(F.when(live, ratio).otherwise(1.0))) * (1 + mean)).otherwise(0.0).alias("lo"),
        (top * (1 + mean)).alias("hi"),
        (live & (ratio < cap * (1 - 1e-12))).alias("open"),
    )
    state = materialise(state, "dual")
    x = F.col("size") / (F.col("size") + F.col("mean"))
    while True:  # ends: a bracket that no double lies in is closed, and each step halves it or Newton's hits
        tilt = F.exp(F.least(F.col("lam") * x, F.lit(top)))
        sums = (
            counts.join(maybe_broadcast(state.where("open"), 128), "key")
            .groupBy("key")
            .agg(
                F.sum(F.col("n") * F.col("size") * tilt).alias("g"),
                F.sum(F.when(F.col("lam") * x < top, F.col("n") * F.col("size") * x * tilt)).alias("dg"),
            )
        )
        off = F.col("g") - F.col("target")
        narrow = F.col("hi") - F.col("lo") <= (F.abs("hi") + F.abs("lo")) * 1e-15 + 1e-12
        good = F.coalesce((F.abs(off) <= F.col("target") * TOLERANCE) | narrow, ~F.col("open"))
        lo = F.when(off < 0, F.greatest("lo", "lam")).otherwise(F.col("lo"))
        hi = F.when(off > 0, F.least("hi", "lam")).otherwise(F.col("hi"))
        step = F.col("lam") - off / F.when(F.col("dg") > 0, F.col("dg"))
        within = F.when((step > F.col("_lo")) & (step < F.col("_hi")), step).otherwise((F.col("_lo") + F.col("_hi")) / 2)
        old, state = state, materialise(
            state.join(sums, "key", "left")
            .select("*", good.alias("_good"), lo.alias("_lo"), hi.alias("_hi"))
            .select(
                *aims.columns, "mean", F.when(F.col("_good"), F.col("lam")).otherwise(within).alias("lam"),
                F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), (F.col("open") & ~F.col("_good")).alias("open"),
            ),
            "dual",
        )
        discard(old)
        if state.where("open").isEmpty():
            break
    discard(counts)
    return state.select(*aims.columns, "mean", "lam")


def round_chunk(rows: pd.DataFrame, cap: int = CAP) -> pd.DataFrame:
    """Whole copies for one chunk's rates, carrying what is over or short."""
    rows = rows.sort_values(["size", "_k1", "_k2"], ascending=[False, True, True], kind="stable")
    copies, short = [], 0.0
    for size, rate in zip(rows["size"].tolist(), rows["rate"].tolist()):
        c = 0
        if size:
            short += rate * size
            low = math.floor(rate)
            c = min(max(round(short / size), max(0, low - 1)), min(cap, low + 2 if rate > low else low + 1))
            short -= c * size
        copies.append(c)
    return rows.assign(copies=copies)


def _allocate(sizes: DataFrame, weights: tuple[float, ...], cap: int, chunk: int) -> DataFrame:
    """``sizes(_id, source, key, size, _k1, _k2, _r1, _r2)`` -> with ``source_size, target, rate, copies``."""
    aims = materialise(targets(sizes, weights, cap), "aims")
    solved = materialise(multipliers(sizes, aims, cap), "solved")
    x = F.col("size") / (F.col("size") + F.col("mean"))
    rate = F.when(F.col("size") > 0, F.exp(F.least(F.col("lam") * x, F.lit(math.log(cap))))).otherwise(0.0)
    # Rows that repeat share a hash: each of them is dealt by its place in the table besides, or
    # all copies of a row would meet in one chunk. They are alike, so it is all one which copy goes where.
    twice = materialise(sizes.groupBy("_k1", "_k2").agg(F.count("*").alias("n")).where("n > 1").select("_k1", "_k2", F.lit(True).alias("_twice")), "twice")
    dealt = sizes.withColumn("_place", F.monotonically_increasing_id()).join(maybe_broadcast(twice, 32), ["_k1", "_k2"], "left")
    chunks = F.ceil(F.col("docs") / F.lit(chunk)).cast("long")
    rated = dealt.drop("source").join(maybe_broadcast(solved.drop("source"), 160), "key").select(
        "_id", "_k1", "_k2", "_r1", "_r2", "key", "size", "source_size", "target", rate.alias("rate"),
        F.pmod(F.when(F.col("_twice"), F.xxhash64("_k1", "_place")).otherwise(F.col("_k1")), chunks).alias("chunk"),
    )
    kind = dict(sizes.dtypes)["_id"]
    return rated.groupBy("key", "chunk").applyInPandas(
        lambda pdf: round_chunk(pdf, cap)[["_id", "_r1", "_r2", "size", "source_size", "target", "rate", "copies"]],
        f"_id {kind}, _r1 long, _r2 long, size long, source_size long, target double, rate double, copies long",
    )


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    k1, k2 = row_key(docs, [id_col, text_col])
    r1, r2 = row_key(docs)
    source = column(source_col).cast("string")
    return materialise(
        docs.select(
            column(id_col).alias("_id"), source.alias("source"), source_key(source).alias("key"),
            word_count(text_column(text_col)).alias("size"), k1.alias("_k1"), k2.alias("_k2"), r1.alias("_r1"), r2.alias("_r2"),
        ),
        "sizes",
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, chunk: int = CHUNK,
) -> DataFrame:
    """``(id_col, size, source_size, target, taken, rate, copies)`` for each row of ``docs``."""
    return _allocate(_sizes(docs, id_col, text_col, source_col), weights, cap, chunk).select(
        F.col("_id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies"
    )


def apply_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, chunk: int = CHUNK,
) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. Rows of no words, which
    no share of words can take, are left out."""
    r1, r2 = row_key(docs)  # all columns: rows that differ in any are rows of their own
    taken = _allocate(_sizes(docs, id_col, text_col, source_col), weights, cap, chunk)
    taken = materialise(taken.groupBy("_r1", "_r2").agg(F.sum("copies").alias("copies")).where("copies > 0"), "copies")
    keyed = docs.select(F.struct("*").alias("_row"), r1.alias("_r1"), r2.alias("_r2")).dropDuplicates(["_r1", "_r2"])
    return keyed.join(taken, ["_r1", "_r2"]).select("_row", F.explode(F.expr("sequence(1L, copies)"))).select("_row.*")
