import bz2
import gzip
import zlib
from datetime import UTC, datetime
from functools import partial

import hypothesis.strategies as st
from hypothesis import given, settings
from pyspark.sql import functions as F

from graphloom.functions import binary as b
from graphloom.functions import extract as x
from graphloom.functions import text as t
from graphloom.functions import times


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_strings(spark):
    v = lambda c: one(spark, c)
    s = F.lit("a.b.c")
    assert v(t.split(s, ".")) == ["a", "b", "c"] and v(t.split(s, ".", 1)) == ["a", "b.c"]
    assert v(t.rsplit(s, ".", 1)) == ["a.b", "c"] and v(t.rsplit(s, ".")) == ["a", "b", "c"]
    assert v(t.ljust(F.lit("abc"), 2)) == "abc" and v(t.ljust(F.lit("a"), 3, "x")) == "axx" and v(t.rjust(F.lit("a"), 3)) == "  a"
    assert v(t.replace(s, ".", "-", 1)) == "a-b.c" and v(t.strip(F.lit("  x\n"))) == "x" and v(t.lstrip(F.lit("xxy"), "x")) == "y"
    assert v(t.title(F.lit("it's 3d world"))) == "it's 3d world".title()
    assert v(t.find(F.lit("hello"), "l")) == 2 and v(t.find(F.lit("hello"), "z")) is None
    assert v(t.format_("{a}-{b}{c}", a=F.lit(1), b="x")) == "1-x{c}"
    assert v(t.join(",", F.array(F.lit("a"), F.lit("b")))) == "a,b" and v(t.concat("a", F.lit(1))) == "a1"


@given(st.text("ab", max_size=6), st.integers(-8, 8), st.one_of(st.none(), st.integers(-8, 8)))
@settings(max_examples=40, deadline=None)
def test_slices(spark, s, a, z):
    r = spark.createDataFrame([(s, list(s), s.encode())], "s string, l array<string>, b binary").select(t.slice_(F.col("s"), a, z), t.list_slice(F.col("l"), a, z), b.slice_(F.col("b"), a, z)).first()
    assert r[0] == s[a:z] and r[1] == list(s)[a:z] and bytes(r[2]) == s.encode()[a:z]


@given(st.integers(-50, 50), st.integers(-9, 9).filter(bool))
@settings(max_examples=40, deadline=None)
def test_integer_arithmetic(spark, a, d):
    r = spark.createDataFrame([(a, d)], "a bigint, d bigint").select(t.floordiv(F.col("a"), F.col("d")), t.pymod(F.col("a"), F.col("d"))).first()
    assert tuple(r) == (a // d, a % d)


def test_patterns(spark):
    v = lambda c: one(spark, c)
    s = F.lit("key=Value, k2=v2")
    assert v(t.regex_search(r"(\w+)=(\w+)", s)) == ["key", "Value"] and v(t.regex_search("z(.)", s)) is None and v(t.regex_search("=", s)) == []
    assert v(t.regex_findall(r"\w+=", s)) == ["key=", "k2="] and v(t.regex_findall(r"(\w+)=(\w+)", s)) == [["key", "Value"], ["k2", "v2"]]
    assert v(t.regex_matches("key", s)) and not v(t.regex_matches("Value", s)) and not v(t.regex_matches("KEY", s)) and v(t.regex_matches("KEY", s, "i"))
    assert v(t.regex_replace(r"(\w+)=", r"\1:$", s)) == "key:$Value, k2:$v2"


def test_lists_and_maps(spark):
    v = lambda c: one(spark, c)
    a = F.array(F.lit(3), F.lit(1), F.lit(3))
    assert v(t.list_has(a, 1)) and v(t.list_index(a, -1)) == 3 and v(t.list_index(a, 9)) is None
    item, rest = t.list_pop(a)
    assert v(item) == 3 and v(rest) == [3, 1]
    assert v(t.list_rem(a, 3)) == [1, 3] and v(t.list_rem(a, 3, all=True)) == [1] and v(t.list_sort(a, True)) == [3, 3, 1]
    assert v(t.range_(3)) == [0, 1, 2] and v(t.range_(3, 3)) == [] and v(t.range_(0, 4, -2)) == [4, 2] and v(t.range_(0)) == []
    assert [tuple(r) for r in v(t.zip_(a, F.array(F.lit("x"), F.lit("y"))))] == [(3, "x"), (1, "y")]
    assert [tuple(r) for r in v(t.enum(F.array(F.lit("x"))))] == [(0, "x")]
    m = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))
    got, left = t.dict_pop(m, "a")
    assert v(got) == 1 and v(left) == {"b": 2} and v(t.dict_update(m, F.create_map(F.lit("b"), F.lit(9)))) == {"a": 1, "b": 9}
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(n).alias("value")) for k, n in (("a", 1), ("b", 2), ("a", 3))])
    assert v(t.dict_fromlist(pairs)) == {"a": 3, "b": 2}
    assert v(t.json_get(F.lit('{"a": [1, 2]}'), "$.a[1]", "int")) == 2 and v(t.json_get(F.lit("bad{"), "$.a")) is None
    assert v(t.toint(F.lit(-1.5))) == -1 and v(t.toint(F.lit(2.5), "ROUND_HALF_EVEN")) == 2 and v(t.toint(F.lit(-1.2), "ROUND_FLOOR")) == -2


def test_times(spark):
    v = lambda c: one(spark, c)
    ms = F.lit(int(datetime(2024, 2, 5, 3, 4, 6, tzinfo=UTC).timestamp() * 1000))
    assert [v(f(ms)) for f in (times.year, times.month, times.day, times.hour, times.minute, times.second)] == [2024, 2, 5, 3, 4, 6]
    assert v(times.dayofweek(ms)) == 0 and v(times.dayofmonth(ms)) == 4 and v(times.dayofyear(ms)) == 35 and v(times.monthofyear(ms)) == 1
    assert v(times.format_(ms, times.ISO8601)) == "2024-02-05T03:04:06Z" and v(times.format_(ms, times.PLAIN)) == "2024/02/05 03:04:06.000000"
    assert v(times.parse(F.lit("05/02/2024 03:04:06"), "%d/%m/%Y %H:%M:%S")) == v(ms) and v(times.parse(F.lit("x"), "%Y")) is None
    assert v(times.to_utc(ms, "Europe/Berlin")) == v(ms) - 3_600_000


def test_binary(spark):
    v = lambda c: one(spark, c)
    d = F.lit(bytearray(b"hello \x00\xff"))
    raw = b"hello \x00\xff"
    assert gzip.decompress(v(b.gzip_en(d))) == raw and bz2.decompress(v(b.bzip2_en(d))) == raw and zlib.decompress(v(b.zlib_en(d))) == raw
    for en, un in ((b.gzip_en, b.gzip_un), (b.bzip2_en, b.bzip2_un), (b.zlib_en, b.zlib_un)):
        assert bytes(v(un(en(d)))) == raw and v(un(d)) is None
    assert bytes(v(b.xor(b.xor(d, b"key"), b"key"))) == raw and v(b.unpack(d, "<BB", 6)) == [0, 255]
    for alg in b.BLOCK:
        assert v(b.hmac_digest(b"k" * 200, d, alg)) == b.hmac_reference(b"k" * 200, raw, alg)
    assert v(b.hex_encode(d)) == raw.hex() and bytes(v(b.hex_decode(F.lit(raw.hex())))) == raw and v(b.hex_decode(F.lit("abc"))) is None
    assert v(b.hex_toint(F.lit("ff"))) == 255 and v(b.hex_toint(F.lit("ff"), True)) == -1 and v(b.hex_fromint(F.lit(-1), 2, True)) == "ffff"
    assert v(b.hex_trimext(F.lit("00ff"))) == "00ff" and v(b.hex_trimext(F.lit("0011"))) == "11" and v(b.hex_signext(F.lit("f1"), 4)) == "fff1"
    assert bytes(v(b.base64_decode(b.base64_encode(d)))) == raw and v(b.base64_decode(F.lit("!"))) is None
    b58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
    z = F.lit(bytearray(b"\x00\x00hi"))
    assert v(b.basex_encode(z, b58)) == "118wr" and bytes(v(b.basex_decode(b.basex_encode(z, b58), b58))) == b"\x00\x00hi"
    assert v(b.ipv6_expand(F.lit("::1"))) == "0000:0000:0000:0000:0000:0000:0000:0001"


def test_extract(spark):
    v = lambda c: one(spark, c)
    s = F.lit("see hxxps://evil[.]com/a?b and 1.2.3[.]4 or bob@x.org, CVE-2021-1234 " + "a" * 32 + " 10.0.0.1:80 2001:db8::1")
    got = {(r["form"], r["valu"]) for r in v(x.ndefs(s))}
    assert {("inet:url", "https://evil.com/a?b"), ("inet:ipv4", "1.2.3.4"), ("inet:email", "bob@x.org"), ("it:sec:cve", "cve-2021-1234"), ("hash:md5", "a" * 32), ("inet:server", "10.0.0.1:80"), ("inet:ipv6", "2001:db8::1")} <= got
    assert not [g for g in got if g == ("inet:ipv4", "10.0.0.1")] and v(x.ndefs(F.lit("plain words, 1.2.3 and 999.1.1.1"))) == []
    look = x.lookup(spark, "1.2.3.4 nothing example.com").orderBy("pos").collect()
    assert [r.form for r in look] == ["inet:ipv4", None, "inet:fqdn"]
    assert v(x.html_text(F.lit("<html><style>x{}</style><p>A &amp; B</p><script>no</script><!-- no --><b> C </b></html>"))) == "A & B\nC"
    assert v(x.tags_prefix(F.array(F.lit("Foo Bar"), F.lit("a.b")), "p")) == ["p.foo_bar", "p.a.b"] and v(x.tags_prefix(F.array(F.lit("a.b")), "p", True)) == ["p.a_b"]
    assert v(x.cvss3(F.lit("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"))) == 9.8 and v(x.cvss3(F.lit("AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N"))) == 6.1
    assert v(x.cvss3(F.lit("AV:N/AC:L"))) is None and v(x.cvss3(F.lit("AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N"))) == 0.0
    assert v(x.cvss2(F.lit("AV:N/AC:L/Au:N/C:N/I:N/A:C"))) == 7.8 and v(x.cvss2(F.lit("(AV:L/AC:H/Au:N/C:C/I:C/A:C)"))) == 6.2


def test_scrape_looks_first_for_what_a_match_needs(spark):
    hits = [
        "hxxp://a.example/x", "tcp[:]//h", "a[at]b.org", "see 1[.]2.3.4:80 now", "255.255.0.1", "1:2:3:4:5:6:7:8", "FE80::1", "a::b:c", "::1", "WWW.Foo.CO", "x(.)y[dot]de",
        "d41d8cd98f00b204e9800998ecf8427e", "A" * 40, "0123456789abcdef" * 4, "cVe-2020-12345", "CWE-79", "cwe-79", "cpe:2.3:a:b:c:1:*:*:*:*:*:*:*", "bc1" + "q" * 25, "0x" + "aB" * 20,
        "1" + "A" * 25, "3" + "z" * 34, "2" + "A" * 25, "", "plain words, none. Nothing:here", None,
    ]
    texts = hits + [f"{a} {b}," for a in hits for b in hits[::3] if a and b] + [f"x{a}" for a in hits if a]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    text = F.col("t")
    for old, new in x.FANGS:
        text = F.replace(text, F.lit(old), F.lit(new))
    parts = []
    for form, rx, group in x.PATTERNS:
        low = form in ("inet:email", "inet:fqdn", "hash:md5", "hash:sha1", "hash:sha256", "it:sec:cve", "inet:ipv6")
        got = F.regexp_extract_all(text, F.lit(rx), F.lit(group))
        parts.append(F.transform(F.transform(got, F.lower) if low else got, partial(x._named, form)))
    rows = df.select(x.ndefs(F.col("t")).alias("got"), F.array_distinct(F.concat(*parts)).alias("want")).collect()
    assert all(r.got == r.want for r in rows) and {n.form for r in rows for n in r.want or ()} == {p[0] for p in x.PATTERNS}
    plan = x.scrape(df, "i", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("replace(") <= 2 * len(x.FANGS)  # refanged once, not for each pattern
