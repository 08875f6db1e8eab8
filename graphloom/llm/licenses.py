"""License scans: canonical digests of whole texts, hash-joined to known ones.

The canonical form lower-cases, drops copyright lines, turns everything but
letters and digits into single spaces and folds equivalent spellings; its SHA-256
is the digest. Everything is DataFrame functions.

Two kinds of text are looked up: each document as a whole, and each of its lines
as a text of its own (a notice such as "Released under the MIT License." stands on
one line). A line is folded and hashed only if its first word is one that a text of the
given register can begin with, in any spelling, or it begins with a copyright mark; so
no match is lost, whatever the register. Of a line with a copyright mark, what follows
the holder's sentence is looked up.

Defined cases: a null or empty text has the digest of the empty text and no
licence; known texts whose canonical form is empty are ignored; several names for
one digest give the first by name; repeated rows each get their row; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import column, materialise, maybe_broadcast, row_key, text_column
from graphloom.llm.license_texts import LICENSES

#: (spelling, the one it is folded to), whole words after punctuation is gone.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"), ("non commercial", "noncommercial"),
    ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("organisation", "organization"), ("merchantibility", "merchantability"),
    ("per cent", "percent"), ("copyright owner", "copyright holder"), ("https", "http"), ("v2", "version 2"), ("v3", "version 3"),
)
#: A line that begins with a copyright mark and goes on with a year, a name or a mark;
#: not one that a wrapped sentence about copyright holders happens to begin.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n(©]*(copyright *(\(c\)|©|<|\[|:|[0-9]{4}|by )|\(c\) |© ?)[^\n]*$"
#: On a line looked up by itself, all up to the last sentence goes if it begins with a
#: copyright mark: "Copyright 2020 A. Holder. All rights reserved." is looked up as its notice.
COPYRIGHT_START = COPYRIGHT_LINE.replace(r"[^\n]*$", r"[^\n]*\.[ \t]+")
#: First words that may go with a copyright mark.
MARKS = ("copyright", "c")


def _fold(text: Column, mark: str) -> Column:
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), mark, " ")
    # Two spaces between words, so that neighbours don't share one and each can be folded.
    t = F.concat(F.lit(" "), F.regexp_replace(t, r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit("  ".join(["", *old.split(), ""])[1:-1]), F.lit("  ".join(["", *new.split(), ""])[1:-1]))
    return F.btrim(F.replace(t, F.lit("  "), F.lit(" ")))


def canonical(text: Column) -> Column:
    return _fold(text, COPYRIGHT_LINE)


def canonical_line(line: Column) -> Column:
    """Of a line looked up by itself: what follows a copyright mark and its holder stays."""
    return _fold(line, COPYRIGHT_START)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def _first_word(text: Column) -> Column:
    return F.regexp_extract(F.lower(text), r"[\p{L}\p{N}]+", 0)


def _first_words(known: DataFrame) -> DataFrame:
    """``known(c)`` of canonical texts -> ``(first)``: what a line that folds to one of them
    can begin with, spelled in any way."""
    first = F.split_part("c", F.lit(" "), F.lit(1))
    before = F.array(*[F.when(first == new.split()[0], F.lit(old.split()[0])) for old, new in SPELLINGS])
    return known.select(F.explode(F.concat(F.array(first), before)).alias("first")).where("first IS NOT NULL").distinct()


def known_licenses(spark: SparkSession) -> DataFrame:
    """``(license_id, text)`` of the built-in register; it doesn't grow with the data."""
    return spark.createDataFrame(sorted(LICENSES.items()), "license_id string, text string")


def scan(docs: DataFrame, licenses: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, digest, license_id, notices)`` for each row of ``docs``: the licence
    that the whole text is, and the sorted, comma-joined ones that single lines are
    (null if none)."""
    texts = licenses.select("license_id", canonical(F.col("text")).alias("c")).where("c != ''")
    known = texts.groupBy(F.sha2("c", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))
    known = materialise(known, "known")
    firsts = materialise(_first_words(texts), "firsts")
    k1, k2 = row_key(docs, [id_col, text_col])
    base = docs.select(column(id_col).alias("_id"), text_column(text_col).alias("_text"), k1.alias("_k1"), k2.alias("_k2"))
    whole = base.select("_id", "_k1", "_k2", digest(F.col("_text")).alias("digest")).join(maybe_broadcast(known, 120), "digest", "left")
    first, line = _first_word(F.col("line")), canonical_line(F.col("line"))
    lines = base.select("_k1", "_k2", F.explode(F.split("_text", "\n", -1)).alias("line")).withColumn("first", first)
    marked = F.col("first").isin(*MARKS) | F.col("line").contains("©")
    listed = lines.join(maybe_broadcast(firsts.withColumn("_listed", F.lit(True)), 40), "first", "left").where(F.col("_listed") | marked)
    notices = (
        listed.select("_k1", "_k2", F.sha2(line, 256).alias("digest"))
        .join(maybe_broadcast(known, 120), "digest")
        .groupBy("_k1", "_k2")
        .agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"))
    )
    return whole.join(notices, ["_k1", "_k2"], "left").select(F.col("_id").alias(id_col), "digest", "license_id", "notices")
