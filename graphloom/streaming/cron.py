"""Cron recurrences: the next time of required fields stepped by a unit."""

from __future__ import annotations

import calendar
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from itertools import product

from graphloom.errors import BadArg

FIELDS = ("year", "month", "dayofmonth", "dayofweek", "hour", "minute")
UNITS = ("year", "month", "dayofmonth", "dayofweek", "day", "hour", "minute")


def shift(t: datetime, unit: str, n: int) -> datetime:
    if unit in ("year", "month"):
        months = t.year * 12 + t.month - 1 + n * (12 if unit == "year" else 1)
        y, m = divmod(months, 12)
        return t.replace(year=y, month=m + 1, day=min(t.day, calendar.monthrange(y, m + 1)[1]))
    return t + timedelta(**{{"day": "days", "dayofmonth": "days", "dayofweek": "weeks", "hour": "hours", "minute": "minutes"}[unit]: n})


@dataclass(frozen=True)
class Recurrence:
    """``required`` fixes fields to one or several values; ``unit`` and ``every`` repeat.

    Without a unit the job runs once per combination. ``dayofmonth`` may be negative and
    counts from the month's end; Monday is 0.
    """

    required: dict[str, int | tuple[int, ...]] = field(default_factory=dict)
    unit: str | None = None
    every: int = 1

    def combinations(self) -> Iterator[dict[str, int]]:
        for k in self.required:
            if k not in FIELDS:
                raise BadArg(f"no such field: {k}")
        if self.unit is not None and self.unit not in UNITS:
            raise BadArg(f"no such unit: {self.unit}")
        many = {k: v if isinstance(v, tuple) else (v,) for k, v in self.required.items()}
        for values in product(*many.values()):
            yield dict(zip(many, values))

    def next(self, last: datetime) -> datetime | None:
        """The first time after ``last``; None if none follows."""
        found = [t for c in self.combinations() if (t := _next(c, self.unit, self.every, last))]
        return min(found, default=None)


def _place(t: datetime, c: dict[str, int]) -> datetime | None:
    t = t.replace(second=0, microsecond=0)
    y, m = c.get("year", t.year), c.get("month", t.month)
    if not 1 <= m <= 12:
        raise BadArg(f"no such month: {m}")
    days = calendar.monthrange(y, m)[1]
    d = c.get("dayofmonth", min(t.day, days))
    d = d if d > 0 else days + 1 + d
    if not 1 <= d <= days:
        return None
    t = t.replace(year=y, month=m, day=d, hour=c.get("hour", t.hour), minute=c.get("minute", t.minute))
    return t + timedelta(days=c["dayofweek"] - t.weekday()) if "dayofweek" in c else t


def _next(c: dict[str, int], unit: str | None, every: int, last: datetime) -> datetime | None:
    at = _place(last, c)
    if unit is None:
        return at if at and at > last else None
    if at and at > last and _fits(at, c):
        return at
    base = last.replace(day=1) if unit in ("year", "month") and "dayofmonth" in c else last
    for n in range(1, 500):
        at = _place(shift(base, unit, every * n), c)
        if at and at > last and _fits(at, c):
            return at
    return None


def _fits(t: datetime, c: dict[str, int]) -> bool:
    got = {"year": t.year, "month": t.month, "dayofweek": t.weekday(), "hour": t.hour, "minute": t.minute}
    return all(got[k] == v for k, v in c.items() if k in got)
