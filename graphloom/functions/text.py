"""Strings, patterns, numbers, lists, sets, maps, JSON."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# strings


def join(sep: str, items: Column) -> Column:
    return F.array_join(items, sep)


def concat(*args) -> Column:
    return F.concat(*[lit(a).cast("string") for a in args])


def format_(text: str, **kwargs) -> Column:
    """``{name}`` in a text replaced by columns; unknown names stay."""
    parts = re.split(r"(\{\w+\})", text)
    return F.concat(*[lit(kwargs[p[1:-1]]).cast("string") if p[:1] == "{" and p[1:-1] in kwargs else F.lit(p) for p in parts if p])


def split(s: Column, sep: str, maxsplit: int = -1) -> Column:
    return F.split(s, re.escape(sep), maxsplit + 1 if maxsplit >= 0 else -1)


def rsplit(s: Column, sep: str, maxsplit: int = -1) -> Column:
    if maxsplit < 0:
        return split(s, sep)
    back = F.split(F.reverse(s), re.escape(sep[::-1]), maxsplit + 1)
    return F.reverse(F.transform(back, F.reverse))


def startswith(s: Column, x) -> Column:
    return F.startswith(s, lit(x))


def endswith(s: Column, x) -> Column:
    return F.endswith(s, lit(x))


def ljust(s: Column, size: int, fill: str = " ") -> Column:
    return F.when(F.length(s) >= size, s).otherwise(F.rpad(s, size, fill))


def rjust(s: Column, size: int, fill: str = " ") -> Column:
    return F.when(F.length(s) >= size, s).otherwise(F.lpad(s, size, fill))


def encode(s: Column, charset: str = "UTF-8") -> Column:
    return F.encode(s, charset)


def replace(s: Column, old: str, new: str, maxv: int | None = None) -> Column:
    """The first ``maxv`` occurrences, or all."""
    if maxv is None:
        return F.replace(s, F.lit(old), F.lit(new))
    parts = F.split(s, re.escape(old), maxv + 1)
    return F.array_join(parts, new)


def strip(s: Column, chars: str = " \t\n\r\x0b\x0c") -> Column:
    return F.btrim(s, F.lit(chars))


def lstrip(s: Column, chars: str = " \t\n\r\x0b\x0c") -> Column:
    return F.ltrim(s, F.lit(chars))


def rstrip(s: Column, chars: str = " \t\n\r\x0b\x0c") -> Column:
    return F.rtrim(s, F.lit(chars))


def title(s: Column) -> Column:
    """Each run of letters begins with a capital, also after digits and apostrophes."""
    runs = F.regexp_extract_all(F.lower(s), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, F.lit(2), F.length(r)))), "")


def _bounds(n: Column, start: int, end: int | None) -> tuple[Column, Column]:
    a = F.least(n, F.lit(start)) if start >= 0 else F.greatest(F.lit(0), n + start)
    b = n if end is None else F.least(n, F.lit(end)) if end >= 0 else F.greatest(F.lit(0), n + end)
    return a, F.greatest(F.lit(0), b - a)


def slice_(s: Column, start: int, end: int | None = None) -> Column:
    """Half-open, negative offsets count from the end."""
    a, n = _bounds(F.length(s), start, end)
    return F.substring(s, a + 1, n)


def find(s: Column, x) -> Column:
    """Offset from 0, null where absent."""
    return F.nullif(F.instr(s, lit(x)), F.lit(0)) - 1


# patterns (case-sensitive unless flags say otherwise)


def pattern(p: str, flags: str = "") -> str:
    return f"(?{flags}){p}" if flags else p


def regex_search(p: str, s: Column, flags: str = "") -> Column:
    """The groups of the first match (empty without groups); null where there is none."""
    groups = re.compile(p).groups
    got = F.array(*[F.regexp_extract(s, pattern(p, flags), i + 1) for i in range(groups)]).cast("array<string>")
    return F.when(s.rlike(pattern(p, flags)), got)


def regex_findall(p: str, s: Column, flags: str = "") -> Column:
    """Whole matches, those of the one group, or (several groups) arrays of groups."""
    groups = re.compile(p).groups
    if groups <= 1:
        return F.regexp_extract_all(s, F.lit(pattern(p, flags)), F.lit(groups))
    each = [F.regexp_extract_all(s, F.lit(pattern(p, flags)), F.lit(i + 1)) for i in range(groups)]
    return F.transform(F.arrays_zip(*[e.alias(f"g{i}") for i, e in enumerate(each)]), lambda z: F.array(*[z[f"g{i}"] for i in range(groups)]))


def regex_matches(p: str, s: Column, flags: str = "") -> Column:
    """Anchored at the start, as a match is."""
    return s.rlike(f"(?{flags})^(?:{p})" if flags else f"^(?:{p})")


def regex_replace(p: str, new: str, s: Column, flags: str = "") -> Column:
    return F.regexp_replace(s, pattern(p, flags), re.sub(r"\\(\d)", r"$\1", new.replace("$", r"\$")))


def regex_escape(text: str) -> str:
    return re.escape(text)


# numbers


def number(c: Column) -> Column:
    return c.try_cast("decimal(38,18)")


def scaleb(c: Column, n: int) -> Column:
    return (c * F.lit(str(10**n if n >= 0 else f"1e{n}")).cast("decimal(38,18)")).cast("decimal(38,18)")


def toint(c: Column, rounding: str | None = None) -> Column:
    """Cut toward zero, or by a rounding mode of decimal arithmetic."""
    modes = {
        None: c, "ROUND_DOWN": c, "ROUND_CEILING": F.ceil(c), "ROUND_FLOOR": F.floor(c), "ROUND_HALF_UP": F.round(c), "ROUND_HALF_EVEN": F.bround(c),
        "ROUND_UP": F.when(c < 0, F.floor(c)).otherwise(F.ceil(c)), "ROUND_HALF_DOWN": F.when(F.abs(c % 1) == 0.5, c).otherwise(F.round(c)),
    }
    return modes[rounding].cast("bigint")


def floordiv(a: Column, b: Column) -> Column:
    """Integer division that floors; Spark's cuts toward zero."""
    whole = F.call_function("div", a, b)
    return F.when(((a < 0) != (b < 0)) & (a % b != 0), whole - 1).otherwise(whole)


def pymod(a: Column, b: Column) -> Column:
    """A remainder with the sign of the divisor."""
    return ((a % b) + b) % b


def to_bool(c: Column, kind: str) -> Column:
    """Truth of a value: nonzero, non-empty, not null."""
    if kind == "boolean":
        t = c
    elif kind == "string":
        t = c != ""
    elif kind.startswith(("array", "map")):
        t = F.size(c) > 0
    else:
        t = c != 0
    return F.coalesce(t, F.lit(False))


def least_int(*cols: Column) -> Column:
    return F.least(*[c.cast("bigint") for c in cols])


def greatest_int(*cols: Column) -> Column:
    return F.greatest(*[c.cast("bigint") for c in cols])


def range_(stop, start=None, step: int = 1) -> Column:
    """Half-open, as an array; empty where nothing lies between."""
    a, b = (F.lit(0), lit(stop)) if start is None else (lit(start), lit(stop))
    last = b - (1 if step > 0 else -1)
    some = a <= last if step > 0 else a >= last
    return F.when(some, F.sequence(a, F.when(some, last).otherwise(a), F.lit(step))).otherwise(F.array().cast("array<int>"))


# lists and sets


def list_has(a: Column, x) -> Column:
    return F.coalesce(F.array_contains(a, lit(x)), F.lit(False))


def list_index(a: Column, i: int) -> Column:
    return F.try_element_at(a, F.lit(i + 1 if i >= 0 else i))


def list_pop(a: Column, i: int = -1) -> tuple[Column, Column]:
    """The item and the rest."""
    n = F.size(a)
    at = F.lit(i) if i >= 0 else n + i
    rest = F.filter(a, lambda _, k: k != at)
    return list_index(a, i), rest


def list_slice(a: Column, start: int, end: int | None = None) -> Column:
    x, n = _bounds(F.size(a), start, end)
    return F.slice(a, x + 1, n)


def list_rem(a: Column, x, all: bool = False) -> Column:
    from graphloom.operators.edits import remove_first

    return F.array_remove(a, lit(x)) if all else remove_first(a, lit(x))


def list_sort(a: Column, reverse: bool = False) -> Column:
    return F.sort_array(a, not reverse)


def enum(a: Column) -> Column:
    return F.transform(a, lambda x, i: F.struct(i.alias("index"), x.alias("item")))


def zip_(*arrays: Column) -> Column:
    """As long as the shortest."""
    z = F.arrays_zip(*[a.alias(f"c{i}") for i, a in enumerate(arrays)])
    return F.slice(z, F.lit(1), F.least(*[F.size(a) for a in arrays]) if len(arrays) > 1 else F.size(arrays[0]))


def set_add(a: Column, *items) -> Column:
    return F.array_union(a, F.array(*map(lit, items)))


def set_rem(a: Column, *items) -> Column:
    return F.array_except(a, F.array(*map(lit, items)))


# maps


def dict_has(m: Column, key) -> Column:
    return F.map_contains_key(m, lit(key))


def dict_keys(m: Column) -> Column:
    return F.map_keys(m)


def dict_values(m: Column) -> Column:
    return F.map_values(m)


def dict_pop(m: Column, key: str, default=None) -> tuple[Column, Column]:
    return F.coalesce(F.try_element_at(m, F.lit(key)), lit(default)), F.map_filter(m, lambda k, _: k != key)


def dict_update(m: Column, other: Column) -> Column:
    """Entries of ``other`` win."""
    return F.map_concat(F.map_filter(m, lambda k, _: ~F.map_contains_key(other, k)), other)


def dict_fromlist(a: Column) -> Column:
    """An array of structs (key, value); the last of a key wins."""
    rev = F.reverse(a)
    firsts = F.filter(rev, lambda e, i: F.array_position(F.transform(rev, lambda x: x["key"]), e["key"]) == i + 1)
    return F.map_from_entries(F.reverse(firsts))


# JSON


def json_load(s: Column) -> Column:
    return F.try_parse_json(s)


def json_get(s: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.try_parse_json(s), path, kind)


def json_save(c: Column) -> Column:
    return F.to_json(c)


def json_schema(s: Column, ddl: str) -> Column:
    """Whether a text parses under a schema given as DDL, with no field missing."""
    return F.from_json(s, ddl, {"mode": "PERMISSIVE"}).isNotNull()
