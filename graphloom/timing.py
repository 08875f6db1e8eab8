"""Time literals, parsed once on the driver: epoch milliseconds, UTC."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from graphloom.errors import BadTypeValu

#: The time of ``?``, an open end.
FUTURE = (1 << 63) - 1
# Milliseconds of the units that relative times may name.
UNITS = {
    "sec": 1000, "secs": 1000, "seconds": 1000,
    "min": 60_000, "mins": 60_000, "minute": 60_000, "minutes": 60_000,
    "hour": 3_600_000, "hours": 3_600_000,
    "day": 86_400_000, "days": 86_400_000,
}

_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
_DELTA = re.compile(r"(now)?\s*([+-])\s*(\d+(?:\.\d+)?)\s*([a-z]+)")
_ZONE = re.compile(r"(?<=\d)\s*([+-])(\d\d):?(\d\d)$")
_PARTS = (4, 2, 2, 2, 2, 2)


def to_ms(t: datetime) -> int:
    return (t - _EPOCH) // timedelta(milliseconds=1)


def now_ms() -> int:
    return to_ms(datetime.now(UTC))


def delta(text: str) -> int | None:
    """``-3 days`` in milliseconds; None if the text isn't a relative time."""
    m = _DELTA.fullmatch(text.strip().lower())
    if not m:
        return None
    if m[4] not in UNITS:
        raise BadTypeValu(f"unknown unit of time: {text}")
    return int(float(m[3]) * UNITS[m[4]]) * (-1 if m[2] == "-" else 1)


def _fields(text: str) -> list[int]:
    digits, out, at = re.sub(r"\D", "", text), [], 0
    for n in _PARTS:
        if at == len(digits):
            break
        if len(digits) < at + n:
            raise BadTypeValu(f"not a time: {text}")
        out.append(int(digits[at : at + n]))
        at += n
    if not out or len(digits) > at + 6:
        raise BadTypeValu(f"not a time: {text}")
    return [*out, *[1, 1, 1, 0, 0, 0][len(out) :], int(digits[at:].ljust(6, "0"))]


def parse(valu: int | str | datetime, now: int | None = None) -> int:
    """Epoch milliseconds of a number, datetime, date text, ``now``, ``?`` or relative time."""
    if isinstance(valu, datetime):
        return to_ms(valu if valu.tzinfo else valu.replace(tzinfo=UTC))
    if isinstance(valu, bool):
        raise BadTypeValu(f"not a time: {valu}")
    if isinstance(valu, int | float):
        return int(valu)
    text = valu.strip().lower()
    if text == "?":
        return FUTURE
    if text == "now":
        return now_ms() if now is None else now
    if (d := delta(text)) is not None:
        return (now_ms() if now is None else now) + d
    shift = 0
    if len(re.sub(r"\D", "", text)) > 8 and (m := _ZONE.search(text)):
        shift = (int(m[2]) * 60 + int(m[3])) * 60_000 * (-1 if m[1] == "-" else 1)
        text = text[: m.start()]
    try:
        return to_ms(datetime(*_fields(text.removesuffix("z")), tzinfo=UTC)) - shift
    except ValueError as e:
        raise BadTypeValu(f"not a time: {valu}") from e


def wild(text: str) -> tuple[int, int]:
    """First millisecond of ``2021*``, and the first after it."""
    digits = re.sub(r"\D", "", text)
    start = _EPOCH + timedelta(milliseconds=parse(digits))
    n = len(digits)
    if n == 4:
        end = start.replace(year=start.year + 1)
    elif n == 6:
        end = start.replace(year=start.year + start.month // 12, month=start.month % 12 + 1)
    elif n in (8, 10, 12, 14):
        end = start + {8: timedelta(days=1), 10: timedelta(hours=1), 12: timedelta(minutes=1), 14: timedelta(seconds=1)}[n]
    else:
        raise BadTypeValu(f"not a time with a wildcard: {text}")
    return to_ms(start), to_ms(end)


def interval(valu) -> tuple[int, int]:
    """``(min, max)`` of a pair, or of a single time, which lasts a millisecond.

    A relative text in a pair counts from the other end: ``(2020, "+3 days")``.
    """
    if isinstance(valu, str) and valu.endswith("*"):
        return wild(valu)
    if isinstance(valu, list | tuple):
        a, b = valu
        da = delta(a) if isinstance(a, str) and not a.strip().lower().startswith("now") else None
        db = delta(b) if isinstance(b, str) and not b.strip().lower().startswith("now") else None
        lo = parse(a) if da is None else parse(b) + da if db is None else now_ms() + da
        hi = lo + db if db is not None and da is None else parse(b)
        return lo, hi
    t = parse(valu)
    return t, t + 1


def represent(ms: int) -> str:
    if ms == FUTURE:
        return "?"
    t = _EPOCH + timedelta(milliseconds=ms)
    return t.strftime("%Y/%m/%d %H:%M:%S.") + f"{t.microsecond // 1000:03d}"
