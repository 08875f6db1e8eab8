import hypothesis.strategies as st
import pytest
from hypothesis import given, settings
from pyspark.sql import functions as F

from graphloom import timing
from graphloom import types as t
from graphloom.errors import BadTypeValu, NoSuchCmpr


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_time_texts():
    y2021 = timing.parse("2021")
    assert timing.represent(y2021) == "2021/01/01 00:00:00.000"
    assert timing.parse("2021-01-01T00:00:00Z") == y2021
    assert timing.parse("2021/01/01 02:00:00 +02:00") == y2021
    assert timing.parse("20210101000000123") == y2021 + 123
    assert timing.parse("?") == timing.FUTURE and timing.represent(timing.FUTURE) == "?"
    assert timing.parse("-3 days", now=10 * 86_400_000) == 7 * 86_400_000
    assert timing.wild("2020*") == (timing.parse("2020"), timing.parse("2021"))
    assert timing.wild("202012*")[1] == timing.parse("2021")
    assert timing.interval(("2020", "+1 day")) == (timing.parse("2020"), timing.parse("20200102"))
    for bad in ("", "20", "20211301", "five", "-3 moons"):
        with pytest.raises(BadTypeValu):
            timing.parse(bad)


def test_norms(spark):
    assert t.Int().norm("0x10") == 16
    assert t.Int(min=1, max=3).norm(3) == 3
    with pytest.raises(BadTypeValu):
        t.Int(size=1, signed=False).norm(256)
    assert t.Int(enums={1: "one"}).norm("one") == 1
    assert t.Str(lower=True, onespace=True).norm(" A  b ") == "a b"
    assert t.Fqdn().norm("EXAMPLE.Link.") == "example.link"
    assert t.Hex(zeropad=6).norm("0xAB") == "0000ab"
    assert t.Guid().norm(["a", 1]) == t.Guid().norm(["a", 1])
    assert t.Array(t.Int(), uniq=True, sorted=True).norm([3, 1, 3]) == [1, 3]
    assert t.SemVer().norm("v1.2.3") == 1 << 40 | 2 << 20 | 3
    assert t.Dist().norm("2.5 km") == 2_500_000
    assert t.FilePath().norm(r"C:\Windows\..\x\.\Y") == "c:/x/y"
    assert t.Url().norm("HTTP://U:P@Host.COM/Path?Q") == "http://U:P@host.com/Path?Q"
    assert t.HugeNum().norm("1,000.5") == 1000.5
    assert t.Taxonomy().norm("Foo.Bar baz") == "foo.bar_baz."
    assert t.Tag().norm("#Foo. Bar") == "foo.bar"
    with pytest.raises(NoSuchCmpr):
        t.Str().compare(F.lit("a"), ">", "b")
    with pytest.raises(NoSuchCmpr):
        t.Ival().compare(F.lit(None), "range=", (1, 2))


@given(st.integers(0, 2**32 - 1))
@settings(max_examples=20, deadline=None)
def test_ipv4_round_trip(spark, n):
    assert one(spark, t.ipv4_int(t.ipv4_text(F.lit(n)))) == n


def test_ip_columns(spark):
    rows = spark.createDataFrame([("1.2.3.4",), ("256.1.1.1",), ("x",), (None,)], "s string")
    assert [r[0] for r in rows.select(t.IPv4().norm_col(F.col("s"))).collect()] == [0x01020304, None, None, None]
    import ipaddress

    for text in ("::1", "fe80::1:2", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "2001:db8::"):
        assert one(spark, t.IPv6.packed(F.lit(text))) == f"{int(ipaddress.IPv6Address(text)):032x}"
    assert one(spark, t.IPv6().compare(F.lit("2001:db8::7"), "=", "2001:db8::/32"))
    assert one(spark, t.IPv6().compare(F.lit("::2"), "<", "::10"))
    sub = t.Cidr4().subs(F.lit("1.2.3.77/30"))
    assert one(spark, sub["network"]) == 0x0102034C and one(spark, sub["broadcast"]) == 0x0102034F


def test_comparators(spark):
    c = lambda kind, v, op, x: one(spark, kind.compare(F.lit(v), op, x))
    assert c(t.Loc(), "us.va", "^=", "us") and not c(t.Loc(), "us.va", "^=", "us.v") and c(t.Loc(), "us.va", "=", "us.*")
    assert c(t.Str(), "Hello", "~=", "ELL") and c(t.Str(), "Hello", "^=", "He") and not c(t.Str(), "Hello", "^=", "he")
    assert c(t.Int(), 5, "range=", (5, 6)) and c(t.Int(), 5, "in=", [1, 5]) and not c(t.Int(), 5, "?=", "junk")
    assert c(t.Fqdn(), "www.example.link", "=", "*.link") and c(t.Guid(), "ab" * 16, "=", "abab*")
    assert c(t.IPv4(), 0x01020305, "=", "1.2.3.0/24") and not c(t.IPv4(), 0x01020305, "=", "1.2.3.0-1.2.3.4") and c(t.IPv4(), 0x01020305, "^=", "1.2.3.")
    y = timing.parse("2021")
    assert c(t.Time(), y, "=", "2021*") and not c(t.Time(), timing.parse("2022"), "=", "2021*")
    assert not c(t.Time(), y, "range=", ("2022", "2020")) and c(t.Time(), y, "@=", ("2020", "20210102")) and not c(t.Time(), y, "@=", ("2020", "2021"))


def test_interval_overlap_is_half_open(spark):
    iv = lambda a, b: F.struct(F.lit(a).alias("min"), F.lit(b).alias("max"))
    at = lambda a, b: one(spark, t.Ival().compare(iv(*a), "@=", iv(*b)))
    assert not at((10, 20), (20, 30)) and at((10, 20), (15, 16)) and at((10, 21), (20, 30))
    m = one(spark, t.Ival().merge(iv(10, 20), iv(5, 7)))
    assert (m["min"], m["max"]) == (5, 20)


def test_near(spark):
    p = F.struct(F.lit(48.8583).alias("lat"), F.lit(2.2923).alias("lon"))
    assert one(spark, t.LatLong().compare(p, "near=", ("48.8738,2.2950", "2km")))
    assert not one(spark, t.LatLong().compare(p, "near=", ("48.8738,2.2950", "1km")))


def test_subs(spark):
    u = spark.range(1).select(*[v.alias(k) for k, v in t.Url().subs(F.lit("https://u:p@example.link:8443/a/b?c=d")).items()]).first()
    assert (u.proto, u.user, u.passwd, u.fqdn, u.port, u.path, u.params) == ("https", "u", "p", "example.link", 8443, "/a/b", "?c=d")
    e = spark.range(1).select(*[v.alias(k) for k, v in t.Email().subs(F.lit("user+tag@example.link")).items()]).first()
    assert (e.user, e.fqdn, e.plus, e.base) == ("user+tag", "example.link", "tag", "user@example.link")
    assert one(spark, t.luhn_digit(F.lit("7992739871"))) == 3
    assert one(spark, t.FilePath().norm_col(F.lit(r"C:\Windows\..\x\.\Y"))) == "c:/x/y"
    assert one(spark, t.Cpe22.to23(F.lit("cpe:/a:microsoft:office:2010"))).startswith("cpe:2.3:a:microsoft:office:2010:*")
