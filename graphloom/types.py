"""Types of properties: how a literal is normalised on the driver, how a column is
normalised, shown and compared. Everything but IPv6 parsing is built from Spark functions, so
comparisons with literals reach the Parquet scan as pushed filters."""

from __future__ import annotations

import ipaddress
import json
import math
import re
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom import timing
from graphloom.errors import BadTypeValu, NoSuchCmpr


def unwild(text: str) -> str:
    """A glob of ``*`` within a name and ``**`` over names, as an anchored pattern."""
    return "^" + re.escape(text).replace(r"\*\*", ".+").replace(r"\*", "[^.]*") + "$"


class Type:
    """A text-like type; the base of all others."""

    name = "str"
    spark = "string"
    ordered = False

    def norm(self, valu):
        return str(valu)

    def norm_col(self, c: Column) -> Column:
        """A raw column in the form of this type, null where it doesn't fit."""
        return c.try_cast(self.spark)

    def repr_col(self, c: Column) -> Column:
        return c.cast("string")

    def value(self, valu) -> Column:
        return valu if isinstance(valu, Column) else F.lit(self.norm(valu))

    def comparators(self) -> dict[str, Callable[[Column, object], Column]]:
        out = {
            "=": self.eq, "!=": lambda c, v: c != self.value(v), "?=": self.try_eq, "~=": self.regex, "^=": self.prefix,
            "in=": self.isin, "range=": self.between,
        }
        if self.ordered:
            out |= {
                "<": lambda c, v: c < self.value(v), ">": lambda c, v: c > self.value(v),
                "<=": lambda c, v: c <= self.value(v), ">=": lambda c, v: c >= self.value(v),
            }
        return out

    def compare(self, c: Column, op: str, valu) -> Column:
        """A boolean column, null where the property is null."""
        fn = self.comparators().get(op.lstrip("*") if op != "*" else op)
        if fn is None:
            raise NoSuchCmpr(f"{self.name} has no comparator {op}")
        return fn(c, valu)

    def eq(self, c, v):
        return c == self.value(v)

    def try_eq(self, c, v):
        try:
            return self.eq(c, v)
        except BadTypeValu:
            return F.lit(False)

    def regex(self, c, v):
        """Search, ignoring case, in what the value is shown as."""
        return self.repr_col(c).rlike("(?i)" + v)

    def prefix(self, c, v):
        return F.startswith(self.repr_col(c), v if isinstance(v, Column) else F.lit(str(v)))

    def isin(self, c, v):
        return c.isin([self.norm(x) for x in v])

    def between(self, c, v):
        lo, hi = v
        return c.between(self.value(lo), self.value(hi))

    def merge(self, old: Column, new: Column) -> Column:
        """The value after a set over an old one."""
        return F.coalesce(new, old)


class Str(Type):
    def __init__(self, lower=False, strip=False, onespace=False, regex=None, enums=None, globsuffix=False, replace=()):
        self.lower, self.strip, self.onespace, self.pattern, self.enums = lower, strip, onespace, regex, enums
        self.globsuffix, self.replace = globsuffix, replace

    def norm(self, valu):
        text = str(valu)
        if self.lower:
            text = text.lower()
        for a, b in self.replace:
            text = text.replace(a, b)
        if self.strip:
            text = text.strip()
        if self.onespace:
            text = " ".join(text.split())
        if self.enums and text not in self.enums or self.pattern and not re.search(self.pattern, text):
            raise BadTypeValu(f"{valu!r} is not allowed")
        return text

    def norm_col(self, c):
        c = c.cast("string")
        if self.lower:
            c = F.lower(c)
        for a, b in self.replace:
            c = F.replace(c, F.lit(a), F.lit(b))
        if self.strip:
            c = F.trim(c)
        if self.onespace:
            c = F.trim(F.regexp_replace(c, r"\s+", " "))
        if self.enums:
            c = F.when(c.isin(list(self.enums)), c)
        return F.when(c.rlike(self.pattern), c) if self.pattern else c

    def eq(self, c, v):
        if self.globsuffix and isinstance(v, str) and v.endswith("*"):
            return self.prefix(c, v[:-1])
        return super().eq(c, v)

    def prefix(self, c, v):
        if isinstance(v, Column):
            return F.startswith(c, v)
        return c.startswith(Str(self.lower, onespace=self.onespace, replace=self.replace).norm(v))


class Bool(Type):
    name, spark = "bool", "boolean"

    def norm(self, valu):
        text = str(valu).strip().lower()
        if text in ("true", "t", "yes", "y", "on", "1"):
            return True
        if text in ("false", "f", "no", "n", "off", "0"):
            return False
        raise BadTypeValu(f"not a bool: {valu}")

    def repr_col(self, c):
        return c.cast("string")


class Int(Type):
    name, spark, ordered = "int", "bigint", True

    def __init__(self, min=None, max=None, size=8, signed=True, enums=None, ismin=False, ismax=False):
        bits = size * 8
        self.low = min if min is not None else -(1 << bits - 1) if signed else 0
        self.high = max if max is not None else (1 << bits - signed) - 1
        self.enums = dict(enums or {})
        self.ismin, self.ismax = ismin, ismax
        self.spark = "decimal(38,0)" if size > 8 else "bigint" if signed or size < 8 else "decimal(20,0)"

    def norm(self, valu):
        if isinstance(valu, str):
            if valu in self.enums.values():
                return next(k for k, v in self.enums.items() if v == valu)
            try:
                valu = int(valu.strip(), 0)
            except ValueError as e:
                raise BadTypeValu(f"not an int: {valu}") from e
        valu = int(valu)
        if not self.low <= valu <= self.high or self.enums and valu not in self.enums:
            raise BadTypeValu(f"out of bounds: {valu}")
        return valu

    def norm_col(self, c):
        c = c.try_cast(self.spark)
        return F.when(c.between(F.lit(self.low), F.lit(self.high)), c)

    def repr_col(self, c):
        if not self.enums:
            return c.cast("string")
        out = c.cast("string")
        for k, v in self.enums.items():
            out = F.when(c == k, F.lit(v)).otherwise(out)
        return out

    def merge(self, old, new):
        return F.least(old, new) if self.ismin else F.greatest(old, new) if self.ismax else F.coalesce(new, old)


class Float(Type):
    name, spark, ordered = "float", "double", True

    def __init__(self, min=None, max=None, minisvalid=True, maxisvalid=True):
        self.low, self.high, self.lowok, self.highok = min, max, minisvalid, maxisvalid

    def norm(self, valu):
        try:
            x = float(valu)
        except (TypeError, ValueError) as e:
            raise BadTypeValu(f"not a float: {valu}") from e
        if self.low is not None and (x < self.low or x == self.low and not self.lowok):
            raise BadTypeValu(f"out of bounds: {valu}")
        if self.high is not None and (x > self.high or x == self.high and not self.highok):
            raise BadTypeValu(f"out of bounds: {valu}")
        return x

    def norm_col(self, c):
        c, ok = c.try_cast("double"), F.lit(True)
        if self.low is not None:
            ok &= c >= self.low if self.lowok else c > self.low
        if self.high is not None:
            ok &= c <= self.high if self.highok else c < self.high
        return F.when(ok, c)


class HugeNum(Type):
    """DECIMAL(38,18): 20 digits before the point and 18 after it."""

    name, spark, ordered = "hugenum", "decimal(38,18)", True

    def __init__(self, units=None):
        self.units = units or {}

    def norm(self, valu):
        from decimal import Decimal, InvalidOperation

        text, mult = str(valu).strip().replace(",", ""), Decimal(1)
        m = re.fullmatch(r"([^a-zA-Z]+)\s*([a-zA-Z]+)", text)
        if m and m[2] in self.units:
            text, mult = m[1].strip(), Decimal(str(self.units[m[2]]))
        try:
            return Decimal(int(text, 16)) if text.lower().startswith("0x") else Decimal(text) * mult
        except (InvalidOperation, ValueError) as e:
            raise BadTypeValu(f"not a number: {valu}") from e

    def value(self, valu):
        return valu if isinstance(valu, Column) else F.lit(str(self.norm(valu))).cast(self.spark)

    def isin(self, c, v):
        return c.isin([self.norm(x) for x in v])


class Time(Type):
    """Epoch milliseconds (``ms=True``) or a Spark timestamp column."""

    name, ordered = "time", True

    def __init__(self, ms=True, ismin=False, ismax=False):
        self.ms, self.ismin, self.ismax = ms, ismin, ismax
        self.spark = "bigint" if ms else "timestamp"

    def norm(self, valu):
        return timing.parse(valu)

    def literal(self, ms: int) -> Column:
        if self.ms:
            return F.lit(ms)
        top = 253402300799999  # the last millisecond of year 9999
        return F.lit(datetime.fromtimestamp(min(ms, top) / 1000, UTC)).cast("timestamp")

    def value(self, valu):
        return valu if isinstance(valu, Column) else self.literal(self.norm(valu))

    def norm_col(self, c):
        return c.try_cast("bigint") if self.ms else c.try_cast("timestamp")

    def repr_col(self, c):
        t = F.timestamp_millis(c) if self.ms else c
        shown = F.date_format(t, "yyyy/MM/dd HH:mm:ss.SSS")
        return F.when(c == timing.FUTURE, F.lit("?")).otherwise(shown) if self.ms else shown

    def eq(self, c, v):
        if isinstance(v, str) and v.endswith("*"):
            lo, hi = timing.wild(v)
            return (c >= self.literal(lo)) & (c < self.literal(hi))
        return super().eq(c, v)

    def between(self, c, v):
        if isinstance(v, tuple | list) and not any(isinstance(x, Column) for x in v):
            lo, hi = timing.interval(v)
            return (c >= self.literal(lo)) & (c <= self.literal(hi)) if lo <= hi else F.lit(False)
        return super().between(c, v)

    def isin(self, c, v):
        return c.isin([self.value(x) for x in v])

    def comparators(self):
        def bound(op):
            def run(c, v):
                if isinstance(v, str) and v.endswith("*"):
                    lo, hi = map(self.literal, timing.wild(v))
                    return {"<": c < lo, "<=": c <= hi, ">": c >= hi, ">=": c >= lo}[op]
                return {"<": c < self.value(v), "<=": c <= self.value(v), ">": c > self.value(v), ">=": c >= self.value(v)}[op]

            return run

        def at(c, v):
            lo, hi = timing.interval(v)
            return (c >= self.literal(lo)) & (c < self.literal(hi))

        return super().comparators() | {op: bound(op) for op in ("<", "<=", ">", ">=")} | {"@=": at}

    def merge(self, old, new):
        return F.least(old, new) if self.ismin else F.greatest(old, new) if self.ismax else F.coalesce(new, old)


def overlap(a: Column, lo, hi) -> Column:
    """Half-open overlap of an interval struct with ``[lo, hi)``."""
    return (a["min"] < hi) & (a["max"] > lo)


class Ival(Type):
    name, spark = "ival", "struct<min:bigint,max:bigint>"

    def norm(self, valu):
        return timing.interval(valu)

    def value(self, valu):
        if isinstance(valu, Column):
            return valu
        lo, hi = self.norm(valu)
        return F.struct(F.lit(lo).alias("min"), F.lit(hi).alias("max"))

    def repr_col(self, c):
        t = Time()
        return F.concat(F.lit("("), t.repr_col(c["min"]), F.lit(", "), t.repr_col(c["max"]), F.lit(")"))

    def comparators(self):
        out = super().comparators()
        del out["range="]

        def at(c, v):
            v = self.value(v)
            return overlap(c, v["min"], v["max"])

        return out | {"@=": at}

    def merge(self, old, new):
        return F.coalesce(
            F.when(old.isNull() | new.isNull(), F.coalesce(new, old)),
            F.struct(F.least(old["min"], new["min"]).alias("min"), F.greatest(old["max"], new["max"]).alias("max")),
        )


class Loc(Type):
    """A dotted place such as ``us.va``; prefixes stop at dots."""

    name = "loc"

    def norm(self, valu):
        return ".".join(p.strip() for p in str(valu).lower().strip().split("."))

    def norm_col(self, c):
        return F.array_join(F.transform(F.split(F.lower(F.trim(c)), "[.]"), F.trim), ".")

    def eq(self, c, v):
        if isinstance(v, str) and v.endswith(".*"):
            return self.prefix(c, v[:-2])
        return super().eq(c, v)

    def prefix(self, c, v):
        v = self.value(v)
        return (c == v) | F.startswith(c, F.concat(v, F.lit(".")))


class Tag(Loc):
    name = "syn:tag"

    def norm(self, valu):
        parts = [re.sub(r"\s+", "_", p.strip().lstrip("#")) for p in str(valu).lower().strip().lstrip("#").split(".")]
        if not all(parts):
            raise BadTypeValu(f"not a tag: {valu}")
        return ".".join(parts)


class Taxonomy(Loc):
    name = "taxonomy"

    def norm(self, valu):
        parts = valu if isinstance(valu, list | tuple) else str(valu).strip().strip(".").split(".")
        return ".".join(re.sub(r"\W+", "_", str(p).strip().lower()) for p in parts) + "."

    def prefix(self, c, v):
        return c.startswith(self.norm(v) if not isinstance(v, Column) else v)


class Fqdn(Type):
    name = "inet:fqdn"

    def norm(self, valu):
        text = str(valu).strip().lower().strip(".")
        if not text or "/" in text or " " in text:
            raise BadTypeValu(f"not a domain name: {valu}")
        return text if text.isascii() else text.encode("idna").decode()

    def norm_col(self, c):
        c = F.btrim(F.lower(F.trim(c)), F.lit("."))
        return F.when(c.rlike(r"^[a-z0-9_*-]+([.][a-z0-9_-]+)*$"), c)

    def eq(self, c, v):
        if isinstance(v, str) and v.startswith("*"):
            return c.endswith(v.lstrip("*").lower()) if v != "*" else c.isNotNull()
        return super().eq(c, v)

    def subs(self, c: Column) -> dict[str, Column]:
        return {"host": F.element_at(F.split(c, "[.]"), 1), "domain": F.nullif(F.regexp_replace(c, r"^[^.]*[.]?", ""), F.lit(""))}


def ipv4_int(c: Column) -> Column:
    """Dotted quad text -> number; null where it isn't one."""
    parts = F.transform(F.split(F.trim(c), "[.]"), lambda x: x.try_cast("bigint"))
    ok = F.trim(c).rlike(r"^\d{1,3}([.]\d{1,3}){3}$") & F.forall(parts, lambda x: x <= 255)
    return F.when(ok, F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a * 256 + x))


def ipv4_text(c: Column) -> Column:
    n = c.cast("bigint")
    return F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])


class IPv4(Type):
    name, spark, ordered = "inet:ipv4", "bigint", True

    def norm(self, valu):
        try:
            return int(ipaddress.IPv4Address(valu if isinstance(valu, int) else str(valu).strip().replace("[.]", ".")))
        except ValueError as e:
            raise BadTypeValu(f"not an IPv4 address: {valu}") from e

    def norm_col(self, c):
        return ipv4_int(c.cast("string"))

    def repr_col(self, c):
        return ipv4_text(c)

    @staticmethod
    def span(valu) -> tuple[int, int] | None:
        """Bounds (both included) of a CIDR or dash range."""
        try:
            if isinstance(valu, str) and "/" in valu:
                net = ipaddress.IPv4Network(valu.strip(), strict=False)
                return int(net[0]), int(net[-1])
            if isinstance(valu, str) and "-" in valu:
                a, b = valu.split("-", 1)
                return int(ipaddress.IPv4Address(a.strip())), int(ipaddress.IPv4Address(b.strip()))
        except ValueError as e:
            raise BadTypeValu(f"not an IPv4 range: {valu}") from e
        return None

    def eq(self, c, v):
        span = self.span(v)
        return c.between(*span) if span else super().eq(c, v)

    def prefix(self, c, v):
        """A dotted prefix is a number range, which the scan can use."""
        parts = str(v).strip().rstrip(".").split(".")
        if str(v).endswith(".") and all(p.isdigit() for p in parts) and len(parts) < 4:
            lo = int(ipaddress.IPv4Address(".".join(parts + ["0"] * (4 - len(parts)))))
            return c.between(lo, lo + (1 << 8 * (4 - len(parts))) - 1)
        return super().prefix(c, v)


class IPv6(Type):
    """Compressed text; order and ranges go by :meth:`packed`, 32 hex digits."""

    name, ordered = "inet:ipv6", True

    def norm(self, valu):
        text = str(valu).strip()
        try:
            if ":" not in text:
                text = "::ffff:" + str(ipaddress.IPv4Address(text))
            ip = ipaddress.IPv6Address(text)
            return f"::ffff:{ip.ipv4_mapped}" if ip.ipv4_mapped else str(ip)
        except ValueError as e:
            raise BadTypeValu(f"not an IPv6 address: {valu}") from e

    @staticmethod
    def packed(c: Column) -> Column:
        """Fixed-width hex of compressed text, by splitting at ``::``."""
        v4 = F.regexp_extract(c, r"(\d+[.]\d+[.]\d+[.]\d+)$", 1)
        n = ipv4_int(v4)
        tail = F.concat(F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(F.lit(65535)))))
        text = F.when(v4 != "", F.concat(F.regexp_replace(c, r"\d+[.]\d+[.]\d+[.]\d+$", ""), tail)).otherwise(c)
        halves = F.split(text, "::", 2)
        groups = lambda h: F.filter(F.split(h, ":"), lambda x: x != "")
        left, right = groups(halves[0]), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
        zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(8) - F.size(left) - F.size(right)))
        return F.array_join(F.transform(F.concat(left, zeros, right), lambda x: F.lpad(x, 4, "0")), "")

    def _hex(self, v) -> Column:
        return self.packed(v) if isinstance(v, Column) else F.lit(f"{int(ipaddress.IPv6Address(self.norm(v))):032x}")

    def eq(self, c, v):
        if isinstance(v, str) and "/" in v:
            net = ipaddress.IPv6Network(v.strip(), strict=False)
            return self.packed(c).between(f"{int(net[0]):032x}", f"{int(net[-1]):032x}")
        if isinstance(v, str) and "-" in v:
            return self.between(c, v.split("-", 1))
        return super().eq(c, v)

    def between(self, c, v):
        return self.packed(c).between(self._hex(v[0]), self._hex(v[1]))

    def comparators(self):
        p = self.packed
        return super().comparators() | {
            "<": lambda c, v: p(c) < self._hex(v), ">": lambda c, v: p(c) > self._hex(v),
            "<=": lambda c, v: p(c) <= self._hex(v), ">=": lambda c, v: p(c) >= self._hex(v),
        }


class Cidr4(Type):
    name = "inet:cidr4"

    def norm(self, valu):
        try:
            return str(ipaddress.IPv4Network(str(valu).strip(), strict=False))
        except ValueError as e:
            raise BadTypeValu(f"not a CIDR block: {valu}") from e

    def subs(self, c: Column) -> dict[str, Column]:
        base, mask = ipv4_int(F.split(c, "/")[0]), F.split(c, "/")[1].cast("int")
        width = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(32) - mask)
        low = base - F.pmod(base, width)
        return {"network": low, "mask": mask, "broadcast": low + width - 1}


class Guid(Type):
    """32 hex digits; a list gives a deterministic one."""

    name = "guid"

    def norm(self, valu):
        if isinstance(valu, list | tuple):
            import hashlib

            return hashlib.md5(json.dumps(valu, separators=(",", ":")).encode()).hexdigest()
        text = str(valu).strip().lower().replace("-", "")
        if not re.fullmatch(r"[0-9a-f]{32}", text):
            raise BadTypeValu(f"not a guid: {valu}")
        return text

    def norm_col(self, c):
        c = F.replace(F.lower(F.trim(c)), F.lit("-"), F.lit(""))
        return F.when(c.rlike("^[0-9a-f]{32}$"), c)

    def eq(self, c, v):
        if isinstance(v, str) and v.endswith("*"):
            return c.startswith(v[:-1].lower())
        return super().eq(c, v)

    @staticmethod
    def of(*cols: Column) -> Column:
        """The guid of several columns."""
        return F.md5(F.to_json(F.array(*[c.cast("string") for c in cols])))


class Hex(Guid):
    name = "hex"

    def __init__(self, size=0, zeropad=0):
        self.size, self.zeropad = size, zeropad

    def norm(self, valu):
        text = f"{valu:x}" if isinstance(valu, int) else re.sub(r"[\s:]", "", str(valu).strip().lower().removeprefix("0x"))
        if self.zeropad:
            text = text.rjust(self.zeropad, "0")
        if not re.fullmatch("[0-9a-f]+", text) or self.size and len(text) != self.size:
            raise BadTypeValu(f"not hex: {valu}")
        return text

    def norm_col(self, c):
        c = F.regexp_replace(F.lower(F.trim(c.cast("string"))), r"^0x|[\s:]", "")
        if self.zeropad:
            c = F.when(F.length(c) < self.zeropad, F.lpad(c, self.zeropad, "0")).otherwise(c)
        return F.when(c.rlike("^[0-9a-f]+$") & (F.length(c) == self.size if self.size else F.lit(True)), c)


class Array(Type):
    name = "array"

    def __init__(self, elem: Type, uniq=False, sorted=False, split=None):
        self.elem, self.uniq, self.sorted, self.split = elem, uniq, sorted, split
        self.spark = f"array<{elem.spark}>"

    def norm(self, valu):
        if isinstance(valu, str):
            valu = [p.strip() for p in valu.split(self.split)] if self.split else [valu]
        out = [self.elem.norm(x) for x in valu]
        if self.uniq:
            out = list(dict.fromkeys(out))
        return sorted(out) if self.sorted else out

    def value(self, valu):
        return valu if isinstance(valu, Column) else F.array(*[self.elem.value(x) for x in self.norm(valu)]).cast(self.spark)

    def norm_col(self, c):
        if self.split:
            c = F.transform(F.split(c, re.escape(self.split)), F.trim)
        c = F.transform(c, self.elem.norm_col)
        c = F.array_distinct(c) if self.uniq else c
        return F.array_sort(c) if self.sorted else c

    def repr_col(self, c):
        return F.concat(F.lit("("), F.array_join(F.transform(c, self.elem.repr_col), ", "), F.lit(")"))

    def any(self, c: Column, op: str, valu) -> Column:
        return F.exists(c, lambda x: F.coalesce(self.elem.compare(x, op, valu), F.lit(False)))


class Comp(Type):
    name = "comp"

    def __init__(self, fields: dict[str, Type]):
        self.fields = fields
        self.spark = "struct<" + ",".join(f"{k}:{t.spark}" for k, t in fields.items()) + ">"

    def norm(self, valu):
        if len(valu) != len(self.fields):
            raise BadTypeValu(f"wrong number of fields: {valu}")
        return tuple(t.norm(v) for t, v in zip(self.fields.values(), valu))

    def value(self, valu):
        if isinstance(valu, Column):
            return valu
        return F.struct(*[t.value(v).alias(k) for (k, t), v in zip(self.fields.items(), valu)])

    def repr_col(self, c):
        return F.concat(F.lit("("), F.concat_ws(", ", *[t.repr_col(c[k]) for k, t in self.fields.items()]), F.lit(")"))


class Ndef(Comp):
    name = "ndef"

    def __init__(self, forms=None):
        super().__init__({"form": Str(), "valu": Str()})
        self.forms = forms

    def norm(self, valu):
        form, v = valu
        if self.forms and form not in self.forms:
            raise BadTypeValu(f"{form} may not be referenced here")
        return str(form), str(v)


class NodeProp(Comp):
    name = "nodeprop"

    def __init__(self):
        super().__init__({"prop": Str(), "valu": Str()})


class Edge(Comp):
    name = "edge"

    def __init__(self):
        super().__init__({"n1": Ndef(), "n2": Ndef()})


class TimeEdge(Comp):
    name = "timeedge"

    def __init__(self):
        super().__init__({"n1": Ndef(), "n2": Ndef(), "time": Time()})


class Range(Comp):
    name = "range"

    def __init__(self, elem: Type):
        super().__init__({"min": elem, "max": elem})
        self.elem = elem

    def norm(self, valu):
        lo, hi = super().norm(valu.split("-", 1) if isinstance(valu, str) else valu)
        if lo > hi:
            raise BadTypeValu(f"min is above max: {valu}")
        return lo, hi


class Data(Type):
    """JSON text; :meth:`get` reads a path through VARIANT."""

    name = "data"

    def norm(self, valu):
        return json.dumps(valu)

    @staticmethod
    def get(c: Column, path: str, kind: str = "string") -> Column:
        return F.try_variant_get(F.try_parse_json(c), path, kind)


EARTH_MM = 6_371_008_800.0


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in millimetres; degrees in."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_MM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def bounding_box(lat: float, lon: float, dist: float) -> tuple[float, float, float, float]:
    """``(lat min, lat max, lon min, lon max)`` around a point."""
    r = dist / EARTH_MM
    a, o = math.radians(lat), math.radians(lon)
    lo, hi = a - r, a + r
    if lo > -math.pi / 2 and hi < math.pi / 2:
        d = math.asin(min(1.0, math.sin(r) / math.cos(a)))
        west, east = o - d, o + d
    else:
        lo, hi, west, east = max(lo, -math.pi / 2), min(hi, math.pi / 2), -math.pi, math.pi
    return math.degrees(lo), math.degrees(hi), math.degrees(west), math.degrees(east)


class Dist(Int):
    """Millimetres."""

    name = "geo:dist"
    # Units of distance in millimetres.
    UNITS = {
        "mm": 1, "millimeter": 1, "millimeters": 1, "cm": 10, "centimeter": 10, "centimeters": 10,
        "foot": 304.8, "feet": 304.8, "yard": 914.4, "yards": 914.4, "mile": 1609344, "miles": 1609344,
        "m": 1000, "meter": 1000, "meters": 1000, "km": 1000000, "kilometer": 1000000, "kilometers": 1000000,
    }

    def norm(self, valu):
        if isinstance(valu, str) and (m := re.fullmatch(r"\s*([\d.,]+)\s*([a-z]+)\s*", valu.lower())):
            if m[2] not in self.UNITS:
                raise BadTypeValu(f"unknown unit: {valu}")
            return int(float(m[1].replace(",", "")) * self.UNITS[m[2]])
        return super().norm(valu)


class LatLong(Comp):
    name = "geo:latlong"

    def __init__(self):
        super().__init__({"lat": Float(-90.0, 90.0), "lon": Float(-180.0, 180.0)})

    def norm(self, valu):
        return super().norm(valu.split(",") if isinstance(valu, str) else valu)

    def value(self, valu):
        return super().value(valu.split(",") if isinstance(valu, str) else valu)

    def comparators(self):
        def near(c, v):
            (lat, lon), dist = self.norm(v[0]), Dist().norm(v[1])
            a, b, west, east = bounding_box(lat, lon, dist)
            box = c["lat"].between(a, b)
            if west >= -180 and east <= 180:
                box &= c["lon"].between(west, east)
            return box & (haversine(F.lit(lat), F.lit(lon), c["lat"], c["lon"]) <= dist)

        return super().comparators() | {"near=": near}


class Email(Str):
    name = "inet:email"

    def __init__(self):
        super().__init__(lower=True, strip=True, regex=r"^[^@\s]+@[^@\s]+$")

    def subs(self, c: Column) -> dict[str, Column]:
        user, fqdn = F.split(c, "@")[0], F.split(c, "@")[1]
        plus = F.nullif(F.regexp_extract(user, r"^[^+]*\+(.*)$", 1), F.lit(""))
        base = F.when(plus.isNotNull(), F.concat(F.split(user, r"\+")[0], F.lit("@"), fqdn))
        return {"user": user, "fqdn": fqdn, "plus": plus, "base": base}


class Url(Str):
    name = "inet:url"

    def __init__(self):
        super().__init__(strip=True, regex=r"^[A-Za-z][A-Za-z0-9+.-]*://")

    def norm(self, valu):
        m = re.fullmatch(r"(?s)\s*([A-Za-z][\w+.-]*)://([^/?#]*)(.*?)\s*", str(valu))
        if not m:
            raise BadTypeValu(f"not a URL: {valu}")
        auth, at, host = m[2].rpartition("@")
        return f"{m[1].lower()}://{auth}{at}{host.lower()}{m[3]}"

    def norm_col(self, c):
        rx = r"(?s)^\s*([A-Za-z][\w+.-]*)://([^/?#]*@)?([^/?#]*)(.*?)\s*$"
        part = lambda i: F.regexp_extract(c, rx, i)
        return F.when(c.rlike(rx), F.concat(F.lower(part(1)), F.lit("://"), part(2), F.lower(part(3)), part(4)))

    def subs(self, c: Column) -> dict[str, Column]:
        rx = r"(?s)^([^:]+)://(?:([^:@/?#]*)(?::([^@/?#]*))?@)?(\[[^\]]*\]|[^:/?#]*)(?::(\d+))?([^?#]*)(\?[^#]*)?"
        part = lambda i: F.nullif(F.regexp_extract(c, rx, i), F.lit(""))
        proto = part(1)
        usual = F.create_map(*[F.lit(x) for kv in {"http": 80, "https": 443, "ftp": 21, "ssh": 22}.items() for x in kv])
        host = part(4)
        is4 = host.rlike(r"^\d+[.]\d+[.]\d+[.]\d+$")
        return {
            "proto": proto, "user": part(2), "passwd": part(3), "host": host, "fqdn": F.when(~is4 & ~host.startswith("["), host),
            "ipv4": F.when(is4, ipv4_int(host)), "ipv6": F.when(host.startswith("["), F.btrim(host, F.lit("[]"))),
            "port": F.coalesce(part(5).try_cast("int"), F.try_element_at(usual, proto)), "path": F.coalesce(part(6), F.lit("")), "params": F.coalesce(part(7), F.lit("")),
        }


class SemVer(Type):
    """Major, minor and patch packed into 20 bits each."""

    name, spark, ordered = "it:semver", "bigint", True

    def norm(self, valu):
        if isinstance(valu, int):
            return valu
        m = re.match(r"\s*v?(\d+)(?:\.(\d+))?(?:\.(\d+))?", str(valu))
        if not m:
            raise BadTypeValu(f"not a version: {valu}")
        a, b, c = (int(x or 0) for x in m.groups())
        if max(a, b, c) >= 1 << 20:
            raise BadTypeValu(f"version part too large: {valu}")
        return a << 40 | b << 20 | c

    def norm_col(self, c):
        part = lambda i: F.coalesce(F.regexp_extract(c, r"^\s*v?(\d+)(?:\.(\d+))?(?:\.(\d+))?", i).try_cast("bigint"), F.lit(0))
        return F.when(c.rlike(r"^\s*v?\d"), F.shiftleft(part(1), 40) + F.shiftleft(part(2), 20) + part(3))

    def repr_col(self, c):
        return F.concat_ws(".", *[F.shiftright(c, s).bitwiseAND(F.lit((1 << 20) - 1)).cast("string") for s in (40, 20, 0)])


class Phone(Type):
    name = "tel:phone"

    def norm(self, valu):
        text = re.sub(r"\D", "", str(valu))
        if not text:
            raise BadTypeValu(f"not a phone number: {valu}")
        return text

    def norm_col(self, c):
        return F.nullif(F.regexp_replace(c.cast("string"), r"\D", ""), F.lit(""))


def luhn_digit(c: Column) -> Column:
    """Check digit of a text of digits."""
    n = F.length(c)
    at = F.sequence(F.lit(1), n)
    each = F.transform(at, lambda i: F.substring(c, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1))
    total = F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    return F.pmod(-total, F.lit(10))


class Imei(Int):
    name = "tel:mob:imei"

    def subs(self, c: Column) -> dict[str, Column]:
        text = F.lpad(c.cast("string"), 15, "0")
        return {"tac": F.substring(text, 1, 8).cast("bigint"), "serial": F.substring(text, 9, 6).cast("bigint")}


class FileBase(Str):
    name = "file:base"

    def __init__(self):
        super().__init__(lower=True, strip=True, regex=r"^[^/\\]+$")

    def subs(self, c: Column) -> dict[str, Column]:
        return {"ext": F.nullif(F.regexp_extract(c, r"[.]([^.]+)$", 1), F.lit(""))}


class FilePath(Str):
    name = "file:path"

    def norm(self, valu):
        text = str(valu).strip().lower().replace("\\", "/")
        lead = "/" if text.startswith("/") else ""
        parts: list[str] = []
        for p in text.split("/"):
            if p == "..":
                parts = parts[:-1]
            elif p not in ("", "."):
                parts.append(p)
        return lead + "/".join(parts)

    def norm_col(self, c):
        text = F.replace(F.lower(F.trim(c)), F.lit("\\"), F.lit("/"))
        parts = F.filter(F.split(text, "/"), lambda p: ~p.isin("", "."))
        none = F.array().cast("array<string>")
        # dropping the last of none leaves none
        kept = F.aggregate(parts, none, lambda a, p: F.when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p)))
        return F.concat(F.when(text.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(kept, "/"))

    def subs(self, c: Column) -> dict[str, Column]:
        base = F.regexp_extract(c, r"([^/]+)$", 1)
        return {"dir": F.nullif(F.regexp_replace(c, r"/?[^/]+$", ""), F.lit("")), "base": base} | FileBase().subs(base)


class Cpe23(Str):
    name = "it:sec:cpe"
    PARTS = ("part", "vendor", "product", "version", "update", "edition", "language", "sw_edition", "target_sw", "target_hw", "other")

    def __init__(self):
        super().__init__(strip=True, lower=True, regex=r"^cpe:2\.3:[aho*-](:[^:]*|\\:){1,10}$")

    def subs(self, c: Column) -> dict[str, Column]:
        parts = F.split(c, r"(?<!\\):")
        return {name: F.get(parts, F.lit(i + 2)) for i, name in enumerate(self.PARTS)}


class Cpe22(Str):
    name = "it:sec:cpe:v2_2"

    def __init__(self):
        super().__init__(strip=True, lower=True, regex=r"^cpe:/[aho]?(:[^:]*)*$")

    @staticmethod
    def to23(c: Column) -> Column:
        parts = F.split(F.regexp_replace(c, "^cpe:/", ""), ":")
        pad = F.concat(F.transform(parts, lambda x: F.when(x == "", "*").otherwise(x)), F.array_repeat(F.lit("*"), 11))
        return F.concat(F.lit("cpe:2.3:"), F.array_join(F.slice(pad, 1, 11), ":"))


#: Types by name, with their default options.
TYPES: dict[str, Callable[..., Type]] = {
    "str": Str, "bool": Bool, "int": Int, "float": Float, "hugenum": HugeNum, "time": Time, "ival": Ival, "loc": Loc, "syn:tag": Tag,
    "taxonomy": Taxonomy, "inet:fqdn": Fqdn, "inet:ipv4": IPv4, "inet:ipv6": IPv6, "inet:cidr4": Cidr4, "guid": Guid, "hex": Hex,
    "array": Array, "comp": Comp, "ndef": Ndef, "nodeprop": NodeProp, "edge": Edge, "timeedge": TimeEdge, "range": Range, "data": Data,
    "geo:dist": Dist, "geo:latlong": LatLong, "inet:email": Email, "inet:url": Url, "it:semver": SemVer, "tel:phone": Phone,
    "tel:mob:imei": Imei, "file:base": FileBase, "file:path": FilePath, "it:sec:cpe": Cpe23, "it:sec:cpe:v2_2": Cpe22,
}
