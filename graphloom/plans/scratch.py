"""Cutting lineage by tables in the cluster's shared folder.

``spark.checkpoint.dir`` names the folder. Only a plain ``local[...]`` session without
the setting gets a temporary one; any other session must have it, as a folder of the
driver's own machine would be out of its executors' sight. A lost executor loses
nothing that is written here. :func:`discard` removes a table that later ones replace,
so that rounds don't pile up on disk.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        if "dir" not in _own:
            _own["dir"] = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        return _own["dir"]
    raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def fresh(spark: SparkSession, name: str) -> str:
    """A new path below the scratch folder, removed when the session's JVM ends."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    fs, where = _hadoop(spark, path)
    fs.deleteOnExit(where)
    return path


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once and return the written table."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that :func:`cut` wrote and nothing will read again."""
    for t in tables:
        path = None if t is None else t.__dict__.pop("_scratch", None)
        if path:
            fs, where = _hadoop(t.sparkSession, path)
            fs.delete(where, True)
            fs.cancelDeleteOnExit(where)
