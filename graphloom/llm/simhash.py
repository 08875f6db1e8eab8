"""SimHash near-duplicates: pigeonhole blocks, then verified Hamming distance.

A 64-bit fingerprint is cut into five blocks. Two fingerprints that differ in at
most two bits agree on at least three whole blocks, so they meet in one of the
ten tables keyed by three blocks (38 or 39 bits; random fingerprints hardly ever
meet there). Distinct fingerprints are joined on (table, key) and kept where the
Hamming distance is within bounds.

A key that more than ``pair_limit`` distinct fingerprints share is not paired
off. There the fingerprints differ only in the two free blocks, so within the
key each one visits itself and its one-bit neighbours in those blocks: two
fingerprints meet at such a point exactly if they differ in two bits or fewer.
Each point holds as many visitors as there are free bits plus one, and linking
them to the smallest gives the same components without all pairs.

Nulls and edge cases: a null, empty or blank text has fingerprint zero and links
like any other; a text of one or two words is one shingle; repeated rows and
exact copies share a fingerprint and hence a component; a null id takes part,
but can't name a component unless no other id is in it; an empty table gives an
empty result. Extra columns, whatever their names, are ignored by
:func:`components` and returned untouched by :func:`dedup`.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import column, deal, materialise, maybe_broadcast, row_key, text_column
from graphloom.llm.components import connected_components

WIDTHS = (13, 13, 13, 13, 12)
MAX_BITS = 2

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, repeats included."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only ASCII space splits
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        return digest(joined, 42)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size)
    start = (end - size)[:n].tolist()
    stop = (end - 1)[len(words) - n :].tolist()
    h = np.fromiter([digest(joined[a:b], 42) for a, b in zip(start, stop)], np.uint64, n)
    if n < 512:
        ones = np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        octets = h.view(np.uint8).reshape(n, 8)
        ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def signed_fingerprint(text: str | None, shingle: int = 3) -> int:
    return _signed(fingerprint(text, shingle))


def _fingerprints(shingle: int):
    def run(batches):
        for b in batches:
            out = [signed_fingerprint(t, shingle) for t in b.column("_text").to_pylist()]
            keep = [i for i, name in enumerate(b.schema.names) if name != "_text"]
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in keep] + [pa.array(out, pa.int64())], names=[b.schema.names[i] for i in keep] + ["fp"]
            )

    return run


def _masks() -> list[tuple[int, list[int]]]:
    """For each table, the mask of its three key blocks (signed) and the free bits."""
    ends = np.cumsum((0, *WIDTHS)).tolist()
    bits = [list(range(a, b)) for a, b in zip(ends, ends[1:])]
    out = []
    for kept in combinations(range(len(WIDTHS)), len(WIDTHS) - MAX_BITS):
        mask = sum(1 << i for k in kept for i in bits[k])
        out.append((_signed(mask), [i for k in range(len(WIDTHS)) if k not in kept for i in bits[k]]))
    return out


def links(fps: DataFrame, pair_limit: int = 64) -> DataFrame:
    """Distinct ``fp`` values (signed 64-bit) -> edges ``(a, b)`` that connect as
    all pairs within two bits do. Keys shared by at most ``pair_limit`` values give
    every pair; the rest give verified star edges."""
    masks = _masks()
    tables = F.array(*[F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for c, (m, _) in enumerate(masks)])
    blocks = fps.select("fp", F.inline(tables))
    shared = blocks.groupBy("c", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = materialise(blocks.join(shared, ["c", "key"]), "blocks")
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MAX_BITS

    few = met.where(F.col("n") <= pair_limit)
    pairs = (
        few.select("c", "key", F.col("fp").alias("a"))
        .join(few.select("c", "key", F.col("fp").alias("b")), ["c", "key"])
        .where((F.col("a") > F.col("b")) & near("a", "b"))
        .select("a", "b")
    )
    free = F.element_at(F.array(*[F.array(*[F.lit(_signed(1 << i)) for i in bits]) for _, bits in masks]), F.col("c") + 1)
    visits = (
        met.where(F.col("n") > pair_limit)
        .select("c", "key", "fp", F.explode(F.concat(F.array(F.lit(0).cast("long")), free)).alias("flip"))
        .select("c", "key", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"), "fp")
    )
    stars = (
        visits.groupBy("c", "key", "point")
        .agg(F.collect_list("fp").alias("all"))  # at most one visitor for each free bit, and the point itself
        .where(F.size("all") > 1)
        .select(F.explode("all").alias("a"), F.array_min("all").alias("b"))
        .where((F.col("a") != F.col("b")) & near("a", "b"))
    )
    return pairs.union(stars).distinct()


def _rooted(prints: DataFrame, pair_limit: int) -> DataFrame:
    """``prints(..., fp)`` -> the distinct ``fp`` with the smallest linked one, ``root``."""
    fps = materialise(prints.select("fp").distinct(), "fps")
    roots = connected_components(links(fps, pair_limit))
    return fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, pair_limit: int = 64) -> DataFrame:
    """One row per row of ``docs``: ``(id_col, fingerprint, component_id)``."""
    schema = f"_id {dict(docs.dtypes)[id_col]}, fp long"
    prints = materialise(
        deal(docs.select(column(id_col).alias("_id"), text_column(text_col).alias("_text"))).mapInArrow(_fingerprints(shingle), schema), "prints"
    )
    classes = prints.groupBy("fp").agg(F.min("_id").alias("low"))
    rooted = classes.join(_rooted(prints, pair_limit), "fp")
    named = materialise(
        rooted.join(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "component_id"), "named"
    )
    return prints.join(maybe_broadcast(named, 32), "fp").select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, pair_limit: int = 64) -> DataFrame:
    """The rows of ``docs``, one of each component: that of the smallest id (null ids
    last; ties go to the smaller hash of the whole row; of repeated rows one stays)."""
    k1, k2 = row_key(docs)
    keyed = docs.select(F.struct("*").alias("_row"), k1.alias("_k1"), k2.alias("_k2"))
    prints = materialise(
        deal(docs.select(column(id_col).alias("_id"), k1.alias("_k1"), k2.alias("_k2"), text_column(text_col).alias("_text"))).mapInArrow(
            _fingerprints(shingle), f"_id {dict(docs.dtypes)[id_col]}, _k1 long, _k2 long, fp long"
        ),
        "prints",
    )
    best = F.min(F.struct(F.col("_id").isNull().alias("n"), "_id", "_k1", "_k2"))
    low = prints.groupBy("fp").agg(best.alias("low"))
    kept = low.join(_rooted(prints, pair_limit), "fp").groupBy("root").agg(F.min("low").alias("low"))
    kept = materialise(kept.select("low._k1", "low._k2"), "kept")
    return keyed.join(kept, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).select("_row.*")
