"""Operations that depend on the order of rows or on a whole partition, but give a value for each row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideframe.functions.aggregates import average_rank
from tideframe.functions.registry import Scope, op
from tideframe.functions.scalar import clip


@op("shift")
def shift(s: Scope, x: Column, n: int = 1, fill=None) -> Column:
    if n == 0:
        return x
    return F.lag(x, n, fill).over(s.ordered) if n > 0 else F.lead(x, -n, fill).over(s.ordered)


@op("diff")
def diff(s: Scope, x: Column, n: int = 1, fill=None) -> Column:
    before = shift(s, x, n)
    if fill is None or n == 0:
        return x - before
    place = F.row_number().over(s.ordered)
    edge = place <= n if n > 0 else F.count(F.lit(1)).over(s.whole) - place < -n
    return F.when(edge, F.lit(fill)).otherwise(x - before)


@op("pct_change")
def pct_change(s: Scope, x: Column, n: int = 1) -> Column:
    return F.try_divide(x.cast("double"), shift(s, x, n).cast("double")) - 1


@op("cumsum")
def cumsum(s: Scope, x: Column) -> Column:
    return F.when(x.isNotNull(), F.sum(x).over(s.upto))


@op("cumprod")
def cumprod(s: Scope, x: Column) -> Column:
    return F.when(x.isNotNull(), F.product(x).over(s.upto))


@op("fillna")
def fillna(s: Scope, x: Column, method: str | None = None, value=None) -> Column:
    method = method or "vfill"
    if method == "vfill":
        out = x
    elif method == "ffill":
        out = F.last(x, ignorenulls=True).over(s.upto)
    elif method == "bfill":
        out = F.first(x, ignorenulls=True).over(s.onward)
    else:
        raise ValueError(f"no such fill method: {method}")
    return out if value is None else F.coalesce(out, F.lit(value) if not isinstance(value, Column) else value)


op("ffill")(lambda s, x, value=None: fillna(s, x, "ffill", value))
op("bfill")(lambda s, x, value=None: fillna(s, x, "bfill", value))


@op("zscore")
def zscore(s: Scope, x: Column, min_periods: int = 3) -> Column:
    spread = s.agg(F.stddev_samp(x))
    value = F.when(spread == 0, 0.0).otherwise(F.try_divide(x - s.agg(F.avg(x)), spread))
    return F.when(s.agg(F.count(x)) >= min_periods, F.when(x.isNotNull(), value))


@op("winsorize")
def winsorize(s: Scope, x: Column, method: str = "quantile", method_params: float | None = None) -> Column:
    """Clip to quantiles q and 1 - q (default 0.01), to the median +- 3 absolute deviations, or to the mean +- 3 deviations."""
    p = method_params if method_params is not None else {"quantile": 0.01}.get(method, 3.0)
    if method == "quantile":
        both = s.agg(F.percentile(x, F.array(F.lit(p), F.lit(1 - p))))
        lo, hi = F.get(both, F.lit(0)), F.get(both, F.lit(1))
        return F.when(lo != hi, clip(s, x, lo, hi)).otherwise(x)
    if method == "median":
        mid = s.agg(F.percentile(x, F.lit(0.5)))
        around = s.agg(F.percentile(F.abs(x - mid), F.lit(0.5))) * p
    elif method == "sigma":
        mid, around = s.agg(F.avg(x)), s.agg(F.stddev_samp(x)) * p
    else:
        raise ValueError(f"no such method: {method}")
    return F.when(around > 0, clip(s, x, mid - around, mid + around)).otherwise(x)


def ranked(s: Scope, x: Column, r: Column, pct: bool = False) -> Column:
    return r / s.agg(F.count(x)) if pct else r


def grouped(s: Scope, x: Column, r: Column, group: int = 10) -> Column:
    return F.coalesce(F.ceil(F.try_divide(r * group, s.agg(F.count(x)).cast("double"))).cast("long"), F.lit(0))


@op("rank")
def rank(s: Scope, x: Column, pct: bool = False, rev: bool = False) -> Column:
    return ranked(s, x, average_rank(s, x, rev), pct)


@op("split_group")
def split_group(s: Scope, x: Column, group: int = 10, rev: bool = False) -> Column:
    """Group 1..group by rank; 0 for missing values."""
    return grouped(s, x, average_rank(s, x, rev), group)


@op("argsort")
def argsort(s: Scope, x: Column, rev: bool = False) -> Column:
    """Place in the sorted order, missing values last; ties keep the order of rows."""
    s.need_order()
    return (F.row_number().over(s.by(x.desc_nulls_last() if rev else x.asc_nulls_last(), *[F.col(o) if isinstance(o, str) else o for o in s.order])) - 1).cast("long")


@op("set_at")
def set_at(s: Scope, x: Column, place, value) -> Column:
    """x with the value at a place of the partition (from the end if negative), a slice or a list of places replaced."""
    at = F.row_number().over(s.ordered) - 1
    n = s.agg(F.count(F.lit(1)))
    if isinstance(place, slice):
        step = place.step or 1
        if step < 1:
            raise ValueError("a slice runs forward")
        edge = lambda v, default: default if v is None else F.lit(v) if v >= 0 else n + v
        lo = F.greatest(edge(place.start, F.lit(0)), F.lit(0))
        hit = (at >= lo) & (at < edge(place.stop, n)) & ((at - lo) % step == 0)
    else:
        hit = F.lit(False)
        for p in place if isinstance(place, (list, tuple)) else [place]:
            hit = hit | (at == (F.lit(p) if p >= 0 else n + p))
    return F.when(hit, F.lit(value) if not isinstance(value, Column) else value).otherwise(x)


@op("put_packed")
def put_packed(s: Scope, x: Column, mask: Column, packed: Column) -> Column:
    """x with the k-th place where mask holds replaced by the k-th element of the array packed."""
    held = F.coalesce(mask, F.lit(False))
    k = F.sum(held.cast("int")).over(s.upto)
    return F.when(held, F.get(packed, (k - 1).cast("int"))).otherwise(x)
