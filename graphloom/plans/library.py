"""What expressions of the query language can call: library functions and methods.

Functions build Columns. A call whose arguments are all constants is worked out once on
the driver from a one-row relation; otherwise it stays part of the rows' projection.
Lists and dicts of constants are plain Python values, changed in place by their methods.
"""

from __future__ import annotations

import copy
import uuid
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.errors import BadArg, GraphError
from graphloom.functions import binary, extract, text, times


class Undefined:
    """The value of a name that isn't set."""

    def __repr__(self) -> str:
        return "undef"

    def __bool__(self) -> bool:
        return False


UNDEF = Undefined()


class Raised(GraphError):
    """An error that a query raised by name."""

    def __init__(self, name: str, mesg: str, **info):
        super().__init__(f"{name}: {mesg}")
        self.name, self.mesg, self.info = name, mesg, info


class Exited(Exception):
    """A query ended itself."""


def as_column(x) -> Column:
    """A constant as a literal: lists as arrays, dicts as maps."""
    if isinstance(x, Column):
        return x
    if isinstance(x, list | tuple | set):
        return F.array(*map(as_column, sorted(x, key=str) if isinstance(x, set) else x)) if x else F.array().cast("array<string>")
    if isinstance(x, dict):
        return F.create_map(*[as_column(v) for kv in x.items() for v in kv]) if x else F.create_map().cast("map<string,string>")
    return F.lit(None if x is UNDEF else x)


_c = as_column
#: Constants by name.
CONSTANTS = {
    "null": None, "true": True, "false": False, "undef": UNDEF, "regex.flags.i": "i", "regex.flags.m": "m",
    "time.formats.iso8601": times.ISO8601, "time.formats.iso8601us": times.ISO8601US, "time.formats.rfc2822": times.RFC2822,
    "time.formats.plain": times.PLAIN,
}

#: Functions over Columns: the first are turned into Columns, as many as the number says; further ones stay constants.
FUNCTIONS: dict[str, tuple[int, Callable]] = {
    "str.join": (0, lambda sep, items: text.join(sep, _c(items))),
    "str.concat": (0, lambda *a: text.concat(*[_c(x) for x in a])),
    "str.format": (0, lambda t, **kw: text.format_(t, **{k: _c(v) for k, v in kw.items()})),
    "regex.search": (0, lambda p, s, flags="": text.regex_search(p, _c(s), flags)),
    "regex.findall": (0, lambda p, s, flags="": text.regex_findall(p, _c(s), flags)),
    "regex.matches": (0, lambda p, s, flags="": text.regex_matches(p, _c(s), flags)),
    "regex.replace": (0, lambda p, new, s, flags="": text.regex_replace(p, new, _c(s), flags)),
    "regex.escape": (0, lambda s: F.lit(text.regex_escape(s))),
    "time.now": (0, lambda: times.now()),
    "time.fromunix": (1, times.fromunix),
    "time.parse": (1, lambda s, fmt, errok=True: times.parse(s, fmt)),
    "time.format": (1, times.format_),
    **{f"time.{k}": (1, getattr(times, k)) for k in ("year", "month", "day", "hour", "minute", "second", "dayofweek", "dayofyear", "dayofmonth", "monthofyear")},
    "time.toUTC": (1, times.to_utc),
    "math.number": (1, text.number),
    "min": (9, lambda *a: text.least_int(*a)),
    "max": (9, lambda *a: text.greatest_int(*a)),
    "range": (0, lambda stop, start=None, step=1: text.range_(_c(stop), None if start is None else _c(start), step)),
    "sorted": (1, lambda a, reverse=False: text.list_sort(a, reverse)),
    "iters.enum": (1, text.enum),
    "iters.zip": (9, text.zip_),
    "dict.has": (1, text.dict_has), "dict.keys": (1, text.dict_keys), "dict.values": (1, text.dict_values), "dict.update": (2, text.dict_update),
    "dict.fromlist": (1, lambda a: F.map_from_entries(F.transform(a, lambda e: F.struct(e[0].alias("key"), e[1].alias("value"))))),
    "json.load": (1, text.json_load),
    "json.save": (1, lambda c, indent=False: text.json_save(c)),
    "basex.encode": (1, binary.basex_encode), "basex.decode": (1, binary.basex_decode),
    "hex.encode": (1, binary.hex_encode), "hex.decode": (1, binary.hex_decode), "hex.toint": (1, binary.hex_toint),
    "hex.fromint": (1, binary.hex_fromint), "hex.trimext": (1, binary.hex_trimext), "hex.signext": (1, binary.hex_signext),
    "base64.encode": (1, binary.base64_encode), "base64.decode": (1, binary.base64_decode),
    **{f"crypto.hashes.{k}": (1, getattr(binary, k)) for k in ("md5", "sha1", "sha256", "sha512")},
    "crypto.hmac.digest": (0, lambda key, mesg, alg="sha256": binary.hmac_digest(key, _c(mesg), alg)),
    **{f"compression.{k}.{d}": (1, getattr(binary, f"{f}_{d}")) for k, f in (("gzip", "gzip"), ("bzip2", "bzip2"), ("zlib", "zlib")) for d in ("en", "un") if hasattr(binary, f"{f}_{d}")},
    "inet.ipv6.expand": (1, binary.ipv6_expand),
    "tags.prefix": (1, extract.tags_prefix),
    "mime.html.totext": (1, lambda s, separator="\n", strip=True: extract.html_text(s, separator)),
    "scrape.ndefs": (1, extract.ndefs), "scrape.context": (1, extract.context),
    "scrape.genMatches": (1, lambda s, pattern, **_: extract.gen_matches(s, pattern)),
    "infosec.cvss.vectToProps": (1, extract.cvss_props),
    "infosec.cvss.vectToScore": (1, lambda v, vers="3.1": extract.cvss2(v) if str(vers).startswith("2") else extract.cvss3(v, vers)),
    "guid": (9, lambda *a: F.md5(F.to_json(F.array(*[x.cast("string") for x in a]))) if a else F.lit(uuid.uuid4().hex)),
    "random.int": (0, lambda maxval, minval=0: F.floor(F.rand() * (maxval - minval + 1)).cast("bigint") + minval),
}


def _raise(name, mesg, **info):
    raise Raised(name, mesg, **info)


def _exit(mesg=None, **kw):
    raise Exited(mesg.format(**kw) if mesg else "")


def _say(env, kind: str, mesg, kw: dict):
    env.messages.append((kind, str(mesg).format(**kw) if kw else show(mesg)))


def show(x) -> str:
    """A constant as text."""
    if isinstance(x, bool):
        return "true" if x else "false"
    return "null" if x is None else x if isinstance(x, str) else str(x)


#: Functions of constants that act on the driver: ``fn(env, *args, **kwargs)``.
ACTIONS: dict[str, Callable] = {
    "print": lambda env, mesg="", **kw: _say(env, "print", mesg, kw),
    "warn": lambda env, mesg="", **kw: _say(env, "warn", mesg, kw),
    "fire": lambda env, name, **info: env.messages.append((name, info)),
    "pprint": lambda env, item, prefix="", clamp=None: _say(env, "print", prefix + show(item)[:clamp], {}),
    "raise": lambda env, name, mesg, **info: _raise(name, mesg, **info),
    "exit": lambda env, mesg=None, **kw: _exit(mesg, **kw),
    "list": lambda env, *a: list(a),
    "set": lambda env, *a: set(a),
    "dict": lambda env, **kw: dict(kw),
    "text": lambda env, *a: list(a),
    "copy": lambda env, x: copy.deepcopy(x),
    "gis.bbox": lambda env, lon, lat, dist: list(extract.bbox(lon, lat, dist)),
    "dict.pop": lambda env, d, key, default=UNDEF: d.pop(key) if default is UNDEF else d.pop(key, default),
    "stats.tally": lambda env: {},
    "vars.get": lambda env, name, default=None: env.vars.get(name, default),
    "vars.set": lambda env, name, valu: env.vars.__setitem__(name, valu),
    "vars.del": lambda env, name: env.vars.pop(name, None),
    "vars.list": lambda env: sorted(env.vars.items()),
}

#: Methods of texts, as ``fn(Column, *constants)``.
TEXT: dict[str, Callable] = {
    "split": text.split, "rsplit": text.rsplit, "startswith": text.startswith, "endswith": text.endswith, "ljust": text.ljust, "rjust": text.rjust,
    "encode": text.encode, "replace": text.replace, "strip": text.strip, "lstrip": text.lstrip, "rstrip": text.rstrip, "title": text.title,
    "slice": text.slice_, "find": text.find, "lower": F.lower, "upper": F.upper, "reverse": F.reverse, "size": F.length, "length": F.length,
    "tostr": lambda s: s.cast("string"), "tofloat": lambda s: s.cast("double"), "json": text.json_load, "join": lambda s, items: F.array_join(as_column(items), s),
}
ARRAY: dict[str, Callable] = {
    "has": text.list_has, "index": text.list_index, "size": F.size, "length": F.size, "slice": text.list_slice, "sort": text.list_sort, "reverse": F.reverse,
    "unique": F.array_distinct, "rem": text.list_rem, "append": lambda a, x: F.array_append(a, as_column(x)), "extend": lambda a, x: F.concat(a, as_column(x)),
    "pop": lambda a, i=-1: text.list_pop(a, i)[0], "list": lambda a: a, "add": text.set_add, "adds": lambda a, xs: F.array_union(a, as_column(xs)),
    "rems": lambda a, xs: F.array_except(a, as_column(xs)),
}
BYTES: dict[str, Callable] = {
    "decode": binary.decode, "gzip": binary.gzip_en, "gunzip": binary.gzip_un, "slice": binary.slice_, "unpack": binary.unpack, "xor": binary.xor, "size": F.length,
    "json": lambda b, encoding="UTF-8": text.json_load(binary.decode(b, encoding)),
    **{k: getattr(binary, f) for k, f in (("bzip", "bzip2_en"), ("bunzip", "bzip2_un")) if hasattr(binary, f)},
}
NUMBER: dict[str, Callable] = {
    "scaleb": text.scaleb, "toint": text.toint, "tostr": lambda c: c.cast("string"), "tofloat": lambda c: c.cast("double"),
}
MAP: dict[str, Callable] = {"has": text.dict_has, "keys": text.dict_keys, "values": text.dict_values, "size": F.size, "get": lambda m, k, d=None: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(d))}


def methods_for(kind: T.DataType) -> dict[str, Callable]:
    if isinstance(kind, T.ArrayType):
        return ARRAY
    if isinstance(kind, T.MapType):
        return MAP
    if isinstance(kind, T.BinaryType):
        return BYTES
    return NUMBER if isinstance(kind, T.NumericType) else TEXT


def _index(a: list, i: int):
    if not -len(a) <= i < len(a):
        raise BadArg(f"index {i} is beyond a list of {len(a)}")
    return a[i]


def _rem(a: list, x, all_=False) -> bool:
    had = x in a
    while x in a:
        a.remove(x)
        if not all_:
            break
    return had


def _in_place(fn: Callable) -> Callable:
    def run(x, *a, **kw):
        fn(x, *a, **kw)

    return run


#: Methods of lists, sets and dicts of constants.
LISTS: dict[str, Callable] = {
    "has": lambda a, x: x in a, "pop": lambda a, index=-1: a.pop(index), "size": len, "length": len, "index": _index, "sort": _in_place(lambda a, reverse=False: a.sort(reverse=reverse)),
    "append": _in_place(lambda a, x: a.append(x)), "reverse": _in_place(lambda a: a.reverse()), "extend": _in_place(lambda a, x: a.extend(x)),
    "slice": lambda a, start, end=None: a[start:end], "unique": lambda a: [x for i, x in enumerate(a) if x not in a[:i]], "rem": lambda a, item, all=False: _rem(a, item, all),
}
SETS: dict[str, Callable] = {
    "add": _in_place(lambda s, *a: s.update(a)), "has": lambda s, x: x in s, "rem": _in_place(lambda s, *a: s.difference_update(a)), "adds": _in_place(lambda s, *a: s.update(*a)),
    "rems": _in_place(lambda s, *a: s.difference_update(*a)), "list": lambda s: sorted(s, key=str), "size": len,
}
DICTS: dict[str, Callable] = {
    "has": lambda d, k: k in d, "size": len, "keys": lambda d: list(d), "values": lambda d: list(d.values()),
    "inc": _in_place(lambda d, name, valu=1: d.__setitem__(name, d.get(name, 0) + valu)), "get": lambda d, k, default=None: d.get(k, default),
    "sorted": lambda d, byname=False, reverse=False: sorted(map(list, d.items()), key=lambda kv: kv[0 if byname else 1], reverse=reverse),
}
