"""General rolling: fixed rows, durations, expanding calendar buckets; rows picked by lags or places are in joins.

A duration d at time t takes rows with time + d > t, up to the row itself in the order of rows, so later rows of the same
time stay out. Every such frame is a RANGE frame of numbers, whose rows Spark keeps one window at a time:

* exact time: microseconds; where times can tie, two for each, with the place among equal times behind the point.
* n months: days of a calendar in which every month has 31, so that a month later is 31 days later. Adding months stops at
  the last day of a month; the rows that this moves are seen only from the last days of months of 28, 29 and 30 days, which
  take the same frame over days that stop at 28, 29 or 30.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tideframe.functions.durations import bucket_start, duration
from tideframe.functions.registry import OPS, Scope
from tideframe.plans.expr import Expr

_DAY = 86_400_000_000


def _calendar(t: Column, last: int = 31) -> Column:
    """Microseconds in a calendar of months of 31 days, no day after last."""
    days = (F.year(t) * 12 + F.month(t) - 1).cast("long") * 31 + F.least(F.dayofmonth(t), F.lit(last)) - 1
    return days * _DAY + F.pmod(F.unix_micros(t.cast("timestamp")), F.lit(_DAY))


class Rolling:
    """expr.rolling(window, time=None, start_by="full" | "duration_start"): window is a number of rows or a duration of time.

    Times are taken to be unique in a partition if the frame is ordered by them alone, or unique_times says so.
    """

    def __init__(self, expr: Expr, window, time: str | None = None, start_by: str = "full", unique_times: bool | None = None):
        if start_by not in ("full", "duration_start"):
            raise ValueError(f"no such start: {start_by}")
        self.expr, self.time, self.start_by, self.unique = expr, time, start_by, unique_times
        self.window = window if isinstance(window, int) else duration(window)
        if not isinstance(window, int) and time is None:
            raise ValueError("a duration needs the time column")

    def _ranged(self, s: Scope, at: Column, span: int) -> Scope:
        """The frame of span numbers up to the row, over a whole number at that time gives."""
        unique = tuple(s.order) == (self.time,) if self.unique is None else self.unique
        parts = Window.partitionBy(*s.part)
        if unique:
            return Scope(s.part, s.order, "frame", parts.orderBy(at).rangeBetween(-(span - 1), Window.currentRow))
        peer = F.row_number().over(parts.orderBy(self.time, *s.order)) - F.rank().over(parts.orderBy(self.time))
        # odd steps back end between two whole numbers, so the place among equal times decides at the row's own end alone
        behind = (peer.cast("decimal(18,0)") * F.lit(Decimal("0.000000000001"))).cast("decimal(32,12)")
        key = (at * 2).cast("decimal(20,0)").cast("decimal(32,12)") + behind
        return Scope(s.part, s.order, "frame", parts.orderBy(key).rangeBetween(-(2 * span - 1), Window.currentRow))

    def scopes(self, s: Scope) -> list[tuple[Column | None, Scope]]:
        """(condition, scope) pairs: a row takes the frame of the first condition that holds for it, None for all others."""
        if isinstance(self.window, int):
            return [(None, Scope(s.part, s.order, "frame", s.trailing(self.window), s.specs))]
        t = F.col(self.time)
        if self.start_by == "duration_start":
            spec = Window.partitionBy(*s.part, bucket_start(t, self.window)).orderBy(*s.order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
            return [(None, Scope(s.part, s.order, "frame", spec))]
        s.need_order()
        if not self.window.months:
            return [(None, self._ranged(s, F.unix_micros(t.cast("timestamp")), self.window.micros))]
        if self.window.micros:
            raise ValueError("a rolling duration is of months or of exact time")
        span, end = 31 * _DAY * self.window.months, F.dayofmonth(F.last_day(t))
        short = [((F.dayofmonth(t) == d) & (end == d), self._ranged(s, _calendar(t, d), span)) for d in (28, 29, 30)]
        return [*short, (None, self._ranged(s, _calendar(t), span))]

    def taken(self, s: Scope, value) -> Column:
        """value(scope) in the scope of each row's frame."""
        *special, (_, usual) = self.scopes(s)
        out = None
        for holds, scope in special:
            out = F.when(holds, value(scope)) if out is None else out.when(holds, value(scope))
        return value(usual) if out is None else out.otherwise(value(usual))

    def __getattr__(self, kind: str):
        if kind.startswith("_") or kind not in OPS:
            raise AttributeError(kind)

        def make(*args, **kw) -> Expr:
            return Expr("rolled", (_Rolled(self, kind, args, kw),), name=self.expr.name)

        return make

    def apply(self, agg):
        """Any expression of aggregates, or a list of them: each aggregate in it is taken over this window."""
        if isinstance(agg, (list, tuple)):
            return [self.apply(a) for a in agg]
        return Expr("rolled", (_Applied(self, agg),), name=agg.name)


class _Rolled:
    def __init__(self, rolling: Rolling, kind: str, args: tuple, kw: dict):
        self.rolling, self.kind, self.args, self.kw = rolling, kind, args, kw
        self.name = rolling.expr.name

    def columns(self) -> set[str]:
        return self.rolling.expr.columns()

    def lower(self, s: Scope) -> Column:
        r = self.rolling
        return r.taken(s, Expr(self.kind, (r.expr, *self.args), self.kw).lower)


class _Applied:
    def __init__(self, rolling: Rolling, agg: Expr):
        self.rolling, self.agg, self.name = rolling, agg, agg.name

    def columns(self) -> set[str]:
        return self.agg.columns()

    def lower(self, s: Scope) -> Column:
        return self.rolling.taken(s, self.agg.lower)
