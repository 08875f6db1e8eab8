"""Triggers: rules over the edit log, run for each micro-batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.errors import BadArg
from graphloom.streaming import editlog as e
from graphloom.types import unwild

# Conditions and the edit codes they watch.
CONDITIONS = {
    "node:add": e.NODE_ADD, "node:del": e.NODE_DEL, "prop:set": e.PROP_SET, "tag:add": e.TAG_SET, "tag:del": e.TAG_DEL,
    "edge:add": e.EDGE_ADD, "edge:del": e.EDGE_DEL,
}


@dataclass(frozen=True)
class Trigger:
    """``form`` and ``n2form`` narrow; ``tag`` and ``verb`` may be globs."""

    name: str
    cond: str
    form: str | None = None
    prop: str | None = None
    tag: str | None = None
    verb: str | None = None
    n2form: str | None = None
    enabled: bool = True

    def matches(self) -> Column:
        if self.cond not in CONDITIONS:
            raise BadArg(f"no trigger condition {self.cond}")
        c = F.col("code") == CONDITIONS[self.cond]
        if self.form:
            c &= F.col("form") == self.form
        if self.cond.startswith("prop") and self.prop:
            c &= F.col("name") == self.prop
        if self.cond.startswith("tag") and self.tag:
            c &= F.col("name").rlike(unwild(self.tag))
        if self.cond.startswith("edge"):
            c &= F.col("name").rlike(unwild(self.verb)) if self.verb else F.lit(True)
            c &= F.col("sub") == self.n2form if self.n2form else F.lit(True)
        return c & F.lit(self.enabled)


def fired(edits: DataFrame, triggers: list[Trigger]) -> DataFrame:
    """Edits with the names of the triggers that they set off, a row for each."""
    hits = F.filter(F.array(*[F.when(t.matches(), F.lit(t.name)) for t in triggers]), lambda x: x.isNotNull())
    return edits.withColumn("trigger", F.explode(hits))


def run(stream: DataFrame, triggers: dict[str, tuple[Trigger, Callable[[DataFrame], None]]], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each batch's matching edits go to the trigger's action. At least once: actions should
    be idempotent, as edits are."""
    def each(batch: DataFrame, _: int) -> None:
        batch.persist()
        for t, action in triggers.values():
            rows = batch.where(t.matches())
            if not rows.isEmpty():
                action(rows)
        batch.unpersist()

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
