"""Document fingerprints: wide xxhash of the canonical text, checked byte by byte.

The canonical text is NFKC-normalised, case-folded, normalised again, and has its
white space folded to single spaces; the fingerprint is its XXH3-128 in hex.
Equal fingerprints form a bucket; :func:`exact_groups` compares the canonical bytes
of a bucket's rows with those of its first row, so that a hash collision can't join
different texts. The rows of a hot bucket meet one representative in a join that
Spark can split.

Defined cases: a null text counts as empty; empty and blank texts share a
fingerprint; rows of equal ids order by their text; null ids come last and can't
name a group unless all its ids are null; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from graphloom.llm.common import column, materialise, maybe_broadcast, text_column


def canonical(text: str | None) -> str:
    t = text or ""
    if not t.isascii():
        t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    else:
        t = t.lower()
    return " ".join(t.split())


def fingerprint(text: str | None) -> str:
    return xxhash.xxh3_128_hexdigest(canonical(text).encode())


def likeness(a: str, b: str) -> float:
    """Of two exact fingerprints: one if equal, else zero."""
    return 1.0 if a == b else 0.0


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by as much of ``following``'s start."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def exact_groups(docs: DataFrame, prints: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``prints(_id, fp)`` of ``docs`` -> ``(fp, same_as, _id)`` for rows in buckets of
    more than one: the smallest id of those whose canonical bytes are the same."""
    shared = materialise(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("_id").alias("low")).where("n > 1").select("fp", "low"), "shared")

    def canon(batches):
        for b in batches:
            texts = [canonical(t) for t in b.column(1).to_pylist()]
            fps = [xxhash.xxh3_128_hexdigest(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(fps, pa.string())], names=["_id", "canon", "fp"])

    kind = dict(docs.dtypes)[id_col]
    full = docs.select(column(id_col).alias("_id"), text_column(text_col).alias("_text")).mapInArrow(canon, f"_id {kind}, canon string, fp string")
    members = materialise(full.join(maybe_broadcast(shared, 64), "fp"), "members")
    first = members.where(F.col("_id").eqNullSafe(F.col("low"))).groupBy("fp").agg(F.min("canon").alias("first_canon"))
    first = materialise(first, "first")  # a table of its own, so that Spark can split a hot bucket's side of the join
    judged = members.join(first, "fp").select("fp", "_id", "low", "canon", (F.col("canon") == F.col("first_canon")).alias("same"))
    same = judged.where("same").select("fp", F.col("low").alias("same_as"), "_id")
    other = judged.where("NOT same")
    other_low = other.groupBy("fp", "canon").agg(F.min("_id").alias("same_as"))
    return same.union(other.join(other_low, ["fp", "canon"]).select("fp", "same_as", "_id"))


def _row(row: tuple, following: tuple | None) -> tuple:
    """(id, text, fp) and the next one -> the columns of :data:`_OUT` after the id."""
    _, text, fp = row
    e = edited(text, following[1])
    efp = fingerprint(e)
    return len(text), hashlib.sha256(e.encode()).hexdigest(), fp, efp, likeness(fp, efp), likeness(fp, following[2]), None, None


_OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edge string, _text string"


def _walk(kind: pa.DataType):
    """Rows of one range, descending; the last waits for the first of the next range."""
    names = ["_id"] + [c.split()[0] for c in _OUT.split(", ")]
    types = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.string()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    def run(batches):
        last = None
        for b in batches:
            out = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                row = (i, text or "", fingerprint(text))
                if last is None:
                    out.append((i, None, None, row[2], None, None, None, "head", row[1]))
                else:
                    out.append((last[0], *_row(last, row)))
                last = row
            yield batch(out)
        if last is not None:
            yield batch([(last[0], None, None, last[2], None, None, None, "tail", last[1])])

    return run


def edit_trial(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its text edited with the next document's (by
    descending id; after the last comes the first), and the group of equal texts.

    The texts are shuffled once, into ranges of ids. Each range is walked in order;
    only its first and last rows wait for their neighbours from other ranges.
    """
    kind = dict(docs.dtypes)[id_col]
    base = docs.select(column(id_col).alias("_id"), text_column(text_col).alias("_text"))
    arrow = to_arrow_type(docs.schema[id_col].dataType)
    ordered = base.repartitionByRange(F.col("_id").desc_nulls_last()).sortWithinPartitions(F.col("_id").desc_nulls_last(), "_text")
    walked = materialise(
        ordered.mapInArrow(_walk(arrow), f"_id {kind}, {_OUT}").withColumn("part", F.spark_partition_id()), "walked"
    )
    done = walked.where("edge IS NULL")
    # Two rows for each range: who follows whom is settled by ids and range numbers alone.
    heads = walked.where("edge = 'head'").select("part", "_id", "fingerprint", "_text")
    order = heads.select("part", F.lead("part").over(Window.orderBy("part")).alias("next"), F.min("part").over(Window.partitionBy(F.lit(1))).alias("first"))
    tails = walked.where("edge = 'tail'").select("part", "_id", "fingerprint", "_text")
    meet = (
        tails.join(order, "part")
        .select("_id", F.col("_text").alias("a"), "fingerprint", F.coalesce("next", "first").alias("to"))
        .join(heads.select(F.col("part").alias("to"), F.col("_text").alias("b"), F.col("fingerprint").alias("fb")), "to")
        .select("_id", "a", "fingerprint", "b", "fb")
    )

    def join_ends(batches):
        for b in batches:
            c = [b.column(i).to_pylist() for i in range(5)]
            rows = [(i, *_row((i, a, fa), (None, t, ft))[:6]) for i, a, fa, t, ft in zip(*c)]
            types = [arrow, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            names = ["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    ends = meet.mapInArrow(join_ends, f"_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    cols = ["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    rows = done.select(cols).union(ends)
    groups = exact_groups(docs, walked.where("edge IS NULL OR edge = 'tail'").select("_id", F.col("fingerprint").alias("fp")), id_col, text_col)
    groups = materialise(groups.groupBy("fp", "_id").agg(F.min("same_as").alias("same_as")), "groups")
    own = groups.select(F.col("fp").alias("_fp"), F.col("_id").alias("_gid"), "same_as")
    return rows.join(own, (F.col("fingerprint") == F.col("_fp")) & F.col("_id").eqNullSafe(F.col("_gid")), "left").select(
        F.col("_id").alias(id_col), *cols[1:], F.coalesce("same_as", "_id").alias("same_as")
    )
