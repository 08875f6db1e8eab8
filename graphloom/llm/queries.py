"""The ``opN_*`` queries over whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import fingerprints, langid, licenses, line_dedup, mixing, packing, quality, simhash, token_output, url_filter

#: (host, path, verdict)
URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]
#: Pages that stand for the list of blocked URLs: every id divisible by this.
LISTED = 20
VOCABULARY = "word_bpe_49k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), counts=True)
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("clean_chars"), F.sha2("text", 256).alias("clean_sha256"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_trial(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, pages.where(F.col("page_id") % LISTED == 0).select("url"), URL_RULES)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(langid.learnable(docs)))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_line_dedup, op2_license_scan, op3_simhash, op4_fingerprints, op5_url_filter, op6_mixing, op7_packing, op8_quality, op9_language,
            op10_token_output,
        )
    }


_LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), bad AS (
  SELECT line, min(doc_id) AS first_id FROM lines WHERE regexp_matches(line, '[^\x09-\x0D\x20]') GROUP BY line HAVING count(DISTINCT source) >= 5
), marked AS (
  SELECT l.doc_id, l.line, l.pos, coalesce(l.doc_id <> b.first_id, false) AS gone FROM lines l LEFT JOIN bad b ON l.line = b.line
), clean AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed, length(c.text) AS clean_chars, sha256(c.text) AS clean_sha256
FROM documents d LEFT JOIN clean c ON d.doc_id = c.doc_id
"""

_CANONICAL_PATH = r"regexp_replace(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '(/index\.html?)?/*$', '')"
_URL_FILTER = rf"""
WITH cut AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))), '&') AS query
  FROM pages
), canon AS (
  SELECT page_id, host, path, CASE WHEN regexp_replace(host, '^www\.', '') <> '' THEN
    regexp_replace(host, '^www\.', '') || {_CANONICAL_PATH} || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical_url
  FROM cut
), rules(rhost, rpath, rverdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), best AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS ruled
  FROM canon JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
), hits AS (
  SELECT DISTINCT canonical_url FROM canon WHERE page_id % {LISTED} = 0 AND canonical_url IS NOT NULL
)
SELECT c.page_id, host, path, rule, coalesce(ruled, CASE WHEN h.canonical_url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  c.canonical_url, h.canonical_url IS NOT NULL AS listed
FROM canon c LEFT JOIN best b ON c.page_id = b.page_id LEFT JOIN hits h ON c.canonical_url = h.canonical_url
"""


def _license_sql() -> str:
    from graphloom.llm.license_texts import LICENSES

    quote = lambda s: "'" + s.replace("'", "''") + "'"
    # Single words by a lookup for each; pairs of words afterwards, each word between spaces of its own.
    single = {old: new for old, new in licenses.SPELLINGS if " " not in old}
    word = "CASE w " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in single.items()) + " ELSE w END"
    folded = f"'  ' || array_to_string(list_transform(string_split(trim(t), ' '), lambda w: {word}), '  ') || '  '"
    for old, new in licenses.SPELLINGS:
        if " " in old:
            folded = f"replace({folded}, ' {old.replace(' ', '  ')} ', ' {new.replace(' ', '  ')} ')"
    folded = f"trim(regexp_replace({folded}, ' +', ' ', 'g'))"

    def canon(source: str, pattern: str = licenses.COPYRIGHT_LINE) -> str:
        clean = rf"regexp_replace(regexp_replace(lower(coalesce(x, '')), {quote(pattern)}, ' ', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')"
        return f"SELECT *, sha256(folded) AS digest FROM (SELECT *, {folded} AS folded FROM (SELECT *, {clean} AS t FROM ({source})))"

    values = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in sorted(LICENSES.items()))
    lines = "SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents"
    return f"""
WITH known AS (
  SELECT digest, min(license_id) AS license_id FROM ({canon(f"SELECT * FROM (VALUES {values}) v(license_id, x)")}) WHERE folded <> '' GROUP BY digest
), whole AS ({canon("SELECT doc_id, text AS x FROM documents")}),
found AS (
  SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
  FROM ({canon(lines, licenses.COPYRIGHT_START)}) JOIN known USING (digest) GROUP BY doc_id
)
SELECT w.doc_id, w.digest, k.license_id, f.notices FROM whole w LEFT JOIN known k ON w.digest = k.digest LEFT JOIN found f ON w.doc_id = f.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": _LINE_DEDUP, "op2_license_scan": _license_sql(), "op5_url_filter": _URL_FILTER}
