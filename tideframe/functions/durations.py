"""Duration strings: signed counts of ns, us, ms, s, m, h, d, w, mo and y in any order, such as "2y1mo-3d5h"."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microseconds of a unit; months count apart, as their length varies.
MICROS = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}
MONTHS = {"mo": 1, "y": 12}
_PART = re.compile(r"\s*([+-]?)(\d+)(ns|us|ms|mo|s|m|h|d|w|y)")


@dataclass(frozen=True)
class Duration:
    months: int = 0
    micros: int = 0

    @property
    def interval(self) -> Column:
        """A calendar interval; days stay days of 24 hours, as timestamps have no zone."""
        days, rest = divmod(abs(self.micros), MICROS["d"])
        sign = -1 if self.micros < 0 else 1
        return F.make_interval(months=F.lit(self.months), days=F.lit(sign * days), secs=F.lit(sign * rest / 1e6).cast("decimal(18,6)"))

    def __neg__(self) -> Duration:
        return Duration(-self.months, -self.micros)

    def __add__(self, other: Duration) -> Duration:
        return Duration(self.months + other.months, self.micros + other.micros)

    def __sub__(self, other: Duration) -> Duration:
        return self + -other

    def __mul__(self, n: int) -> Duration:
        return Duration(self.months * n, self.micros * n)


def duration(text: str | Duration) -> Duration:
    """Parse a duration string. A sign holds for its own part; nanoseconds are cut to whole microseconds."""
    if isinstance(text, Duration):
        return text
    at, months, micros = 0, 0, 0
    while at < len(text):
        m = _PART.match(text, at)
        if not m:
            raise ValueError(f"not a duration: {text!r}")
        n = int(m[2]) * (-1 if m[1] == "-" else 1)
        if m[3] in MONTHS:
            months += n * MONTHS[m[3]]
        else:
            micros += n // 1000 if m[3] == "ns" else n * MICROS[m[3]]
        at = m.end()
    if not text.strip():
        raise ValueError("an empty duration")
    return Duration(months, micros)


def bucket_start(ts: Column, every: Duration) -> Column:
    """Start of the calendar bucket that holds ts: multiples of every since 1970-01-01, or of whole months."""
    if every.months and every.micros or every.months < 0 or every.micros < 0 or not (every.months or every.micros):
        raise ValueError("a bucket takes a positive duration of either months or exact time")
    if every.months:
        months = F.year(ts) * 12 + F.month(ts) - 1
        first = F.floor(months / every.months) * every.months
        return F.make_date(F.floor(first / 12).cast("int"), (first % 12 + 1).cast("int"), F.lit(1)).cast("timestamp_ntz")
    micros = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(every.micros))).cast("timestamp_ntz")
