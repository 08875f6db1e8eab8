"""Scraping indicators from text, text of HTML, tags of names, CVSS scores.

Everything is Spark patterns, so texts never leave the JVM.
"""

from __future__ import annotations

from functools import partial
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.types import bounding_box

# How indicators are written so that they aren't links.
FANGS = (("hxxps", "https"), ("hxxp", "http"), ("[.]", "."), ("[:]", ":"), ("(.)", "."), ("[dot]", "."), ("[at]", "@"), ("[://]", "://"))
_TLDS = "com|net|org|edu|gov|mil|int|info|io|co|de|fr|uk|us|ru|cn|jp|example|test"
#: (form, pattern, group)
PATTERNS = (
    ("inet:url", r"(?i)\b((?:https?|ftp|tcp)://[^\s<>\"'\]\[]+[^\s<>\"'\]\[.,;:!?)])", 1),
    ("inet:email", r"(?i)(?<![\w.+-])([\w.+-]+@(?:[a-z0-9-]+\.)+[a-z]{2,})\b", 1),
    ("inet:server", r"(?<![\d.])((?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d):\d{1,5})\b", 1),
    ("inet:ipv4", r"(?<![\d.])((?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?![\d:]|\.\d)", 1),
    ("inet:ipv6", r"(?i)(?<![0-9a-f:.])((?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?:[0-9a-f]{1,4}:){1,6}(?::[0-9a-f]{1,4}){1,6})(?![0-9a-f:])", 1),
    ("inet:fqdn", r"(?i)(?<![\w@.-])((?:[a-z0-9_](?:[a-z0-9_-]*[a-z0-9])?\.)+(?:" + _TLDS + r"))(?![\w-]|\.\w)", 1),
    ("hash:md5", r"(?<![A-Za-z0-9])([A-Fa-f0-9]{32})(?![A-Za-z0-9])", 1),
    ("hash:sha1", r"(?<![A-Za-z0-9])([A-Fa-f0-9]{40})(?![A-Za-z0-9])", 1),
    ("hash:sha256", r"(?<![A-Za-z0-9])([A-Fa-f0-9]{64})(?![A-Za-z0-9])", 1),
    ("it:sec:cve", r"(?i)(?<![a-z0-9])(CVE-\d{4}-\d{4,})(?![a-z0-9])", 1),
    ("it:sec:cwe", r"(CWE-\d{1,8})(?!\d)", 1),
    ("it:sec:cpe", r"(cpe:2\.3:[aho*-](?::[^\s:]+){10})", 1),
    ("crypto:currency:address", r"(?<![A-Za-z0-9])((?:bc1[a-z0-9]{25,62}|0x[A-Fa-f0-9]{40}|[13][1-9A-HJ-NP-Za-km-z]{25,34}))(?![A-Za-z0-9])", 1),
)

_HEX = "[A-Fa-f0-9]{32}"
#: What any match of a form's pattern holds: quick to look for, so that few texts meet the pattern itself.
NEEDS = {
    "inet:url": "://", "inet:email": "@", "inet:server": r"\d\.\d{1,3}\.\d{1,3}\.\d{1,3}:\d", "inet:ipv4": r"\d\.\d{1,3}\.\d{1,3}\.\d",
    "inet:ipv6": r":(?::|[0-9A-Fa-f]{1,4}:)", "inet:fqdn": rf"(?i)\.(?:{_TLDS})", "hash:md5": _HEX, "hash:sha1": _HEX, "hash:sha256": _HEX,
    "it:sec:cve": "(?i)cve-", "it:sec:cwe": "CWE-", "it:sec:cpe": r"cpe:2\.3:", "crypto:currency:address": "[b013][c1-9A-HJ-NP-Za-km-zx][A-Za-z0-9]{24}",
}


def refang(s: Column) -> Column:
    out = s
    for old, new in FANGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.when(s.rlike(r"hxxp|\[|\(\.\)"), out).otherwise(s)


def _named(form: str, v: Column) -> Column:
    return F.struct(F.lit(form).alias("form"), v.alias("valu"))


def ndefs(s: Column, forms: list[str] | None = None, defanged: bool = True) -> Column:
    """An array of ``(form, valu)`` found in a text, each once."""
    none = F.array().cast("array<struct<form:string,valu:string>>")

    def matches(text: Column, form: str, rx: str, group: int) -> Column:
        got = F.regexp_extract_all(text, F.lit(rx), F.lit(group))
        if form in ("inet:email", "inet:fqdn", "hash:md5", "hash:sha1", "hash:sha256", "it:sec:cve", "inet:ipv6"):
            got = F.transform(got, F.lower)
        return F.transform(got, partial(_named, form))

    def found(text: Column) -> Column:
        wanted = [p for p in PATTERNS if forms is None or p[0] in forms]
        parts = [F.when(text.rlike(need), F.concat(*[matches(text, *p) for p in same])).otherwise(none) for need, same in groupby(wanted, lambda p: NEEDS[p[0]])]
        return F.when(text.isNotNull(), F.array_distinct(F.concat(*parts)))

    # a lambda's argument: the text is refanged once, not for each pattern
    return F.transform(F.array(refang(s) if defanged else s), found)[0]


def context(s: Column, width: int = 20, forms: list[str] | None = None) -> Column:
    """What was found, with its offset and the text around it."""
    text = refang(s)
    return F.transform(
        ndefs(s, forms),
        lambda n: F.struct(
            n["form"].alias("form"), n["valu"].alias("valu"), (F.instr(F.lower(text), F.lower(n["valu"])) - 1).alias("offset"),
            F.substring(text, F.greatest(F.lit(1), F.instr(F.lower(text), F.lower(n["valu"])) - width), F.length(n["valu"]) + 2 * width).alias("around"),
        ),
    )


def gen_matches(s: Column, rx: str, group: int = 0) -> Column:
    return F.regexp_extract_all(s, F.lit("(?i)" + rx), F.lit(group))


def scrape(df: DataFrame, id_col: str, text_col: str, forms: list[str] | None = None) -> DataFrame:
    """``(id_col, form, valu)``: a row for each indicator of each row."""
    return df.select(F.col(id_col), F.explode(ndefs(F.col(text_col), forms)).alias("n")).select(id_col, "n.form", "n.valu")


def lookup(spark, text: str) -> DataFrame:
    """Tokens of a lookup query: ``(pos, token, form, valu)``, the first indicator of each,
    null where there is none."""
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(text.split())], "pos int, token string")
    first = F.get(ndefs(F.col("token")), F.lit(0))
    return rows.select("pos", "token", first["form"].alias("form"), first["valu"].alias("valu"))


def html_text(s: Column, separator: str = "\n") -> Column:
    """Text of HTML: scripts, styles and comments gone, tags as separators, the usual
    entities decoded, blank pieces dropped."""
    t = F.regexp_replace(s, r"(?is)<(script|style|template)\b.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>", "\u0000")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", "\u0000")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    parts = F.transform(F.split(t, "\u0000"), lambda p: F.btrim(p, F.lit(" \t\r\n")))
    return F.array_join(F.filter(parts, lambda p: p != ""), separator)


def tags_prefix(names: Column, prefix: str, ispart: bool = False) -> Column:
    """Names as tags below a prefix; ``ispart`` takes dots out of them."""
    clean = lambda n: F.regexp_replace(F.lower(F.trim(n)), r"[^\w]+" if ispart else r"[^\w.]+", "_")
    return F.transform(names, lambda n: F.concat(F.lit(prefix + "."), clean(n)))


def bbox(lon: float, lat: float, dist_mm: float) -> tuple[float, float, float, float]:
    """``(lon min, lon max, lat min, lat max)``."""
    a, b, west, east = bounding_box(lat, lon, dist_mm)
    return west, east, a, b


# CVSS

# Weights of the metrics of CVSS 3.x base scores.
V3 = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}, "AC": {"L": 0.77, "H": 0.44}, "UI": {"N": 0.85, "R": 0.62},
    "C": {"H": 0.56, "L": 0.22, "N": 0.0}, "I": {"H": 0.56, "L": 0.22, "N": 0.0}, "A": {"H": 0.56, "L": 0.22, "N": 0.0},
}
V3_PR = {"U": {"N": 0.85, "L": 0.62, "H": 0.27}, "C": {"N": 0.85, "L": 0.68, "H": 0.5}}
# Weights of the metrics of CVSS 2 base scores.
V2 = {
    "AV": {"L": 0.395, "A": 0.646, "N": 1.0}, "AC": {"H": 0.35, "M": 0.61, "L": 0.71}, "Au": {"M": 0.45, "S": 0.56, "N": 0.704},
    "C": {"N": 0.0, "P": 0.275, "C": 0.66}, "I": {"N": 0.0, "P": 0.275, "C": 0.66}, "A": {"N": 0.0, "P": 0.275, "C": 0.66},
}


def cvss_props(vector: Column) -> Column:
    """A vector such as ``AV:N/AC:L/...`` as a map of its metrics."""
    body = F.regexp_replace(F.regexp_replace(vector, r"^CVSS:[\d.]+/", ""), r"[()]", "")
    pairs = F.transform(F.split(body, "/"), lambda p: F.struct(F.split(p, ":")[0].alias("key"), F.get(F.split(p, ":"), F.lit(1)).alias("value")))
    return F.map_from_entries(pairs)


def _weight(table: dict[str, float], got: Column) -> Column:
    out = F.lit(None).cast("double")
    for k, v in table.items():
        out = F.when(got == k, F.lit(v)).otherwise(out)
    return out


def _roundup(x: Column, minor: str) -> Column:
    """Up to one decimal; 3.1 does it on whole hundred-thousandths."""
    if minor == "3.0":
        return F.ceil(x * 10) / 10
    n = F.round(x * 100000).cast("bigint")
    return F.when(n % 10000 == 0, n / 100000.0).otherwise((F.floor(n / 10000) + 1) / 10.0)


def cvss3(vector: Column, version: str = "3.1") -> Column:
    """The base score; null where a base metric is missing."""
    m = cvss_props(vector)
    get = lambda k: F.try_element_at(m, F.lit(k))
    w = {k: _weight(t, get(k)) for k, t in V3.items()}
    changed = get("S") == "C"
    pr = F.when(changed, _weight(V3_PR["C"], get("PR"))).otherwise(_weight(V3_PR["U"], get("PR")))
    iss = 1 - (1 - w["C"]) * (1 - w["I"]) * (1 - w["A"])
    impact = F.when(changed, 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, F.lit(15))).otherwise(6.42 * iss)
    ease = 8.22 * w["AV"] * w["AC"] * pr * w["UI"]
    raw = F.when(changed, F.least(F.lit(10.0), 1.08 * (impact + ease))).otherwise(F.least(F.lit(10.0), impact + ease))
    return F.when(iss.isNull() | ease.isNull() | get("S").isNull(), None).when(impact <= 0, 0.0).otherwise(_roundup(raw, version))


def cvss2(vector: Column) -> Column:
    m = cvss_props(vector)
    w = {k: _weight(t, F.try_element_at(m, F.lit(k))) for k, t in V2.items()}
    impact = 10.41 * (1 - (1 - w["C"]) * (1 - w["I"]) * (1 - w["A"]))
    ease = 20 * w["AV"] * w["AC"] * w["Au"]
    return F.round((0.6 * impact + 0.4 * ease - 1.5) * F.when(impact == 0, 0.0).otherwise(1.176), 1)
