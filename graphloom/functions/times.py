"""Times in epoch milliseconds, UTC."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: strftime letters as Spark's patterns.
_LETTERS = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "j": "DDD", "p": "a", "z": "xx",
    "Z": "z", "a": "EEE", "A": "EEEE", "b": "MMM", "B": "MMMM", "%": "%",
}
# Formats by name.
ISO8601, ISO8601US = "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S.%fZ"
RFC2822, PLAIN = "%a, %d %b %Y %H:%M:%S UT", "%Y/%m/%d %H:%M:%S.%f"


def java(fmt: str) -> str:
    """A strftime format as a Spark pattern; other letters are quoted."""
    out = []
    for m in re.finditer(r"%(.)|([A-Za-z]+)|(')|([^%A-Za-z']+)", fmt):
        out.append(_LETTERS[m[1]] if m[1] else f"'{m[2]}'" if m[2] else "''" if m[3] else m[4])
    return "".join(out)


def stamp(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def now() -> Column:
    return F.unix_millis(F.current_timestamp())


def fromunix(secs: Column) -> Column:
    return (secs * 1000).cast("bigint")


def parse(s: Column, fmt: str) -> Column:
    """Null where the text doesn't fit."""
    return F.unix_millis(F.try_to_timestamp(s, F.lit(java(fmt))))


def format_(ms: Column, fmt: str) -> Column:
    """``strftime``; names of days, which patterns only print, come out as well."""
    return F.date_format(stamp(ms), java(fmt))


def year(ms: Column) -> Column:
    return F.year(stamp(ms))


def month(ms: Column) -> Column:
    return F.month(stamp(ms))


def day(ms: Column) -> Column:
    return F.day(stamp(ms))


def hour(ms: Column) -> Column:
    return F.hour(stamp(ms))


def minute(ms: Column) -> Column:
    return F.minute(stamp(ms))


def second(ms: Column) -> Column:
    return F.second(stamp(ms))


def dayofweek(ms: Column) -> Column:
    """Monday is 0."""
    return F.weekday(stamp(ms))


def dayofyear(ms: Column) -> Column:
    """From 0, as are the next two."""
    return F.dayofyear(stamp(ms)) - 1


def dayofmonth(ms: Column) -> Column:
    return F.day(stamp(ms)) - 1


def monthofyear(ms: Column) -> Column:
    return F.month(stamp(ms)) - 1


def to_utc(ms: Column, zone: str) -> Column:
    return F.unix_millis(F.to_utc_timestamp(stamp(ms), zone))


def ticker(spark, per_second: int = 1):
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
