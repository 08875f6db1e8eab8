"""URL filters: a blocked Bloom filter, then an exact join on what passes.

Listed canonical URLs set one bit in each of the eight 32-bit words of one
256-bit block, chosen by hash. The filter is a table of blocks, built by ``bit_or``
aggregation; it grows with the list, so its share of false hits is the same for any
list. Its counted size decides whether it is broadcast or joined by block. Pages whose
bits are all set go on to an exact hash join on the canonical URL itself, which
removes false hits; pages that the filter has cleared carry a key of their own there
that no URL has, spread by hash.

Rules come first: a rule fits its host and all subdomains if the path starts with
the rule's; the longest rule decides. Only pages without a rule get the list's
verdict.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits
no rule, is on no list and is allowed; the list ignores such entries, nulls and
repeats; an empty list allows all; repeated pages each get their row; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import column, materialise, maybe_broadcast

WORDS = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
#: Query parameters that don't change the page.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without a trailing slash or index page, and sorted
    query without tracking parameters; null without a host."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"(/index\.html?)?/*$", "")
    params = F.filter(F.split(F.regexp_extract(url, _URL, 3), "&", -1), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.array_sort(params), "&")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _masks(key: str) -> list[Column]:
    """One bit of 32 for each word, from five bits of the hash each."""
    return [F.expr(f"shiftleft(1L, cast(shiftright(xxhash64({key}), {5 * i}) & 31 AS INT))") for i in range(WORDS)]


def _block(key: str, blocks: int) -> Column:
    return F.expr(f"pmod(xxhash64(17, {key}), {blocks}L)")


def build_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """``listed(canon)`` -> ``(block, w0 ... w7)``, at most ``blocks`` rows."""
    masks = [m.alias(f"m{i}") for i, m in enumerate(_masks("canon"))]
    return (
        listed.select(_block("canon", blocks).alias("block"), *masks)
        .groupBy("block")
        .agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)])
    )


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict; null if none fits."""
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def judge(
    pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url",
    bits_per_url: int = 16,
) -> DataFrame:
    """``(id_col, host, path, rule, verdict, canonical_url, listed)`` for each page.

    ``listed`` has blocked URLs in a column ``url``; ``rules`` are (host, path,
    "allow" or "block").
    """
    list_ = materialise(listed.select(canonical(F.col("url").cast("string")).alias("canon")).where("canon IS NOT NULL").distinct(), "listed")
    n = list_.count()
    blocks = max(1, math.ceil(n * bits_per_url / (32 * WORDS)))
    bloom = materialise(build_filter(list_, blocks), "bloom")
    url = column(url_col).cast("string")
    host, path = host_of(url), path_of(url)
    rule, ruled = rule_for(F.col("host"), F.col("path"), rules)
    base = pages.select(column(id_col).alias("_id"), host.alias("host"), path.alias("path"), canonical(url).alias("canonical_url"))
    base = base.select("*", rule.alias("rule"), ruled.alias("_ruled"), *[m.alias(f"_m{i}") for i, m in enumerate(_masks("canonical_url"))])
    hit = F.lit(True)
    for i in range(WORDS):
        hit = hit & (F.col(f"w{i}").bitwiseAND(F.col(f"_m{i}")) == F.col(f"_m{i}"))
    probed = (
        base.withColumn("block", _block("canonical_url", blocks))
        .join(maybe_broadcast(bloom, 88), "block", "left")
        .select("_id", "host", "path", "rule", "_ruled", "canonical_url", (F.col("canonical_url").isNotNull() & F.coalesce(hit, F.lit(False))).alias("_maybe"))
    )
    exact = maybe_broadcast(list_.select("canon", F.lit(True).alias("_in")), 160, n)
    # No canonical URL begins with a slash.
    key = F.when(F.col("_maybe"), F.col("canonical_url")).otherwise(F.concat(F.lit("/"), F.pmod(F.xxhash64("_id", "path"), F.lit(1 << 20)).cast("string")))
    out = probed.withColumn("_key", key).join(exact, F.col("_key") == F.col("canon"), "left").withColumn("listed", F.coalesce("_in", F.lit(False)))
    verdict = F.coalesce("_ruled", F.when(F.col("listed"), "block").otherwise("allow"))
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "canonical_url", "listed")
