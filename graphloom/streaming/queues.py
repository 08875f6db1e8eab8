"""Durable queues, consumer offsets, keyed once and layer sync."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "offs bigint, item string"


class Queue:
    """An append-only table of ``(offs, item)`` in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _next(self) -> int:
        rows = self.rows()
        top = rows.agg(F.max("offs")).first()[0] if rows is not None else None
        return 0 if top is None else top + 1

    def rows(self) -> DataFrame | None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return None
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def puts(self, items: list[str]) -> int:
        """Appends items known to the driver; returns the first offset."""
        at = self._next()
        self.spark.createDataFrame([(at + i, x) for i, x in enumerate(items)], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        return at

    def gets(self, offs: int = 0, size: int | None = None) -> DataFrame:
        rows = self.rows()
        rows = self.spark.createDataFrame([], SCHEMA) if rows is None else rows.where(F.col("offs") >= offs)
        return rows.orderBy("offs").limit(size) if size is not None else rows.orderBy("offs")

    def cull(self, offs: int) -> None:
        """Forgets items up to an offset."""
        kept = self.gets(offs + 1)
        side = self.path.rstrip("/") + ".kept"
        kept.write.mode("overwrite").parquet(side)
        self.spark.read.schema(SCHEMA).parquet(side).write.mode("overwrite").parquet(self.path)

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(SCHEMA).parquet(self.path)


def once_stream(rows: DataFrame, key: list[str], time: str, ttl: str) -> DataFrame:
    """Each key passes once within ``ttl`` of event time; state older than that is dropped."""
    return rows.withWatermark(time, ttl).dropDuplicatesWithinWatermark(key)


def push(edits: DataFrame, sink: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Sends an edit stream to another layer, batch by batch; the checkpoint is the offset."""
    return edits.writeStream.foreachBatch(lambda df, _: sink(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windows(events: DataFrame, time: str, size: str, slide: str | None = None, late: str = "10 minutes", by: list[str] = ()) -> DataFrame:
    """Counts by event-time window, late rows bounded by a watermark."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, late).groupBy(w, *by).agg(F.count("*").alias("n"))
