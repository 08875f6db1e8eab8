"""Line dedup: boilerplate lines by the number of distinct sites they spread over.

1. Lines are hashed to 128 bits and counted by hash (partial sums before the
   shuffle). A line seen fewer than ``min_sites`` times can't be on as many sites.
2. The occurrences of the rest feed one HyperLogLog sketch per line hash; sketches
   merge by aggregation.
3. Lines whose estimate lies within ``band`` of the threshold get an exact count of
   distinct sites; the others are decided by their estimate.
4. A boilerplate line stays in the document of smallest id that has it and goes
   from all others; the text is joined again from the lines left.

Defined cases: a null text stays null (no lines), an empty one stays empty; blank
lines are never boilerplate; a null site counts as no site; a null id never is the
smallest unless all ids of a line are null; repeated rows are treated alike (in
step 4 they share the id); an empty table gives an empty table. Other columns,
whatever their names, come back untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import column, materialise, maybe_broadcast, row_key, text_column


def boilerplate(lines: DataFrame, min_sites: int, band: float, lg_k: int) -> DataFrame:
    """``lines(h1, h2, site, first)`` of lines seen often enough -> ``(h1, h2)`` of
    those that are on at least ``min_sites`` distinct sites."""
    sketched = materialise(
        lines.where(F.col("site").isNotNull())
        .groupBy("h1", "h2")
        .agg(F.hll_sketch_agg("site", lg_k).alias("sketch"))
        .select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites")),
        "sketched",
    )
    low, high = min_sites * (1 - band) - 1, min_sites * (1 + band) + 1
    near = sketched.where(F.col("sites").between(low, high)).select("h1", "h2")
    exact = (
        lines.join(maybe_broadcast(near, 40), ["h1", "h2"])
        .select("h1", "h2", "site")
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.count("site").alias("sites"))
        .where(F.col("sites") >= min_sites)
    )
    return sketched.where(F.col("sites") > high).select("h1", "h2").union(exact.select("h1", "h2"))


def removals(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_sites: int, band: float, lg_k: int) -> DataFrame:
    """``(_k1, _k2, _drop)``: for each row key of ``docs``, the positions of lines to drop."""
    k1, k2 = row_key(docs, [id_col, text_col])
    line = F.col("line")
    exploded = (
        docs.select(
            k1.alias("_k1"), k2.alias("_k2"), column(id_col).alias("id"), column(site_col).cast("string").alias("site"),
            F.posexplode(F.split(text_column(text_col), "\n", -1)).alias("pos", "line"),
        )
        .where(line.rlike(r"[^\x09-\x0D\x20]"))
        .select("_k1", "_k2", "id", "site", "pos", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2"))
    )
    often = materialise(
        exploded.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("id").alias("first")).where(F.col("n") >= min_sites).drop("n"),
        "often",
    )
    seen = materialise(exploded.join(maybe_broadcast(often, 48), ["h1", "h2"]), "seen")
    bad = materialise(boilerplate(seen, min_sites, band, lg_k), "boilerplate")
    return (
        seen.where(~F.col("id").eqNullSafe(F.col("first")))
        .join(maybe_broadcast(bad, 40), ["h1", "h2"], "left_semi")
        .groupBy("_k1", "_k2")
        .agg(F.collect_set("pos").alias("_drop"))  # at most the lines of one document
    )


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
    min_sites: int = 5, band: float = 0.2, lg_k: int = 12, counts: bool = False,
) -> DataFrame:
    """``docs`` with boilerplate lines gone from ``text_col``.

    ``counts`` adds ``n_lines`` and ``n_removed`` instead of returning the columns of
    ``docs``: ``(id_col, text_col, n_lines, n_removed)``.
    """
    k1, k2 = row_key(docs, [id_col, text_col])
    drop = materialise(removals(docs, id_col, text_col, site_col, min_sites, band, lg_k), "drop")
    keyed = docs.select(F.struct("*").alias("_row"), k1.alias("_k1"), k2.alias("_k2"))
    joined = keyed.join(drop, ["_k1", "_k2"], "left")
    old = F.col(f"_row.`{text_col}`").cast("string")
    gone = F.col("_drop")
    # In time by the lines of a document, not by their square: a difference of position sets.
    places = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    kept = F.transform(F.array(F.split(old, "\n", -1)), lambda lines: F.array_join(F.transform(places(lines), lambda i: F.get(lines, i)), "\n"))
    new = F.when(gone.isNull(), old).otherwise(F.get(kept, F.lit(0)))
    if not counts:
        return joined.select(F.col("_row").withField(f"`{text_col}`", new).alias("_row")).select("_row.*")
    return joined.select(
        F.col(f"_row.`{id_col}`").alias(id_col), new.alias(text_col),
        F.when(old.isNull(), 0).otherwise(F.size(F.split(old, "\n", -1))).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"),
    )
