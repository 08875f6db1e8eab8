"""Shared plumbing: scratch tables, row keys and checked broadcasts.

Lineage is cut by writing a table below ``spark.checkpoint.dir`` (the shared
folder of the cluster) and reading it back, so losing an executor never loses
an intermediate result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.scratch import cut as materialise
from graphloom.plans.scratch import discard
from graphloom.plans.scratch import fresh as scratch_path

__all__ = ["BROADCAST_BYTES", "column", "deal", "discard", "materialise", "maybe_broadcast", "row_key", "scratch_path", "text_column"]

#: A side is broadcast only if its counted rows times its row width stay below this.
BROADCAST_BYTES = 32 << 20
#: The setting that names :func:`deal`'s number of partitions.
DEAL = "graphloom.deal"


def maybe_broadcast(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """Hint a broadcast if the counted size is within bounds, else leave ``df`` as it is.

    ``df`` should be a materialised table, so that counting it reads footers only.
    """
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def column(name: str) -> Column:
    """The column of that very name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_key(df: DataFrame, columns: list[str] | None = None) -> tuple[Column, Column]:
    """128 bits that stand for a row's content; nulls count, equal rows share them."""
    cols = [column(c) for c in (columns or df.columns)]
    marks = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in cols])
    return F.xxhash64(marks, *cols), F.xxhash64(F.lit(0x9E37), marks, *cols)


def text_column(name: str) -> Column:
    return column(name).cast("string")


def deal(docs: DataFrame) -> DataFrame:
    """``docs`` in as many partitions as the session's ``graphloom.deal`` says.

    Unset, as it should be for inputs of many files, rows are read as they lie. Set it
    where few large files would leave cores idle; it acts alike on tables of all sizes
    and costs one shuffle of the texts.
    """
    n = docs.sparkSession.conf.get(DEAL, None)
    return docs.repartition(int(n)) if n else docs
