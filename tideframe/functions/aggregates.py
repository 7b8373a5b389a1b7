"""Aggregates that skip missing values, usable over groups, frames and whole partitions alike."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tideframe.functions.registry import Scope, op

#: Variances up to this count as none when correlations are taken.
TINY = 1e-14


def gate(s: Scope, x: Column, at_least: int, value: Column) -> Column:
    return F.when(s.agg(F.count(x)) >= at_least, value)


op("sum")(lambda s, x: F.coalesce(s.agg(F.sum(x)), F.lit(0)))
op("prod")(lambda s, x: F.coalesce(s.agg(F.product(x)), F.lit(1.0)))
op("mean")(lambda s, x, min_periods=1: gate(s, x, min_periods, s.agg(F.avg(x))))
op("var")(lambda s, x, min_periods=1: gate(s, x, min_periods, s.agg(F.var_samp(x))))
op("std")(lambda s, x, min_periods=2: gate(s, x, min_periods, s.agg(F.stddev_samp(x))))
op("min", "umin")(lambda s, x: s.agg(F.min(x)))
op("max", "umax")(lambda s, x: s.agg(F.max(x)))
op("count_valid", "count_notnan")(lambda s, x: s.agg(F.count(x)))
op("count_none", "count_nan")(lambda s, x: s.agg(F.count(F.when(x.isNull(), 1))))
op("count_value")(lambda s, x, value: s.agg(F.count(F.when(x == value, 1))))
op("len")(lambda s, x: s.agg(F.count(F.lit(1))))
op("any")(lambda s, x: F.coalesce(s.agg(F.bool_or(x.cast("boolean"))), F.lit(False)))
op("all")(lambda s, x: F.coalesce(s.agg(F.bool_and(x.cast("boolean"))), F.lit(True)))
op("first")(lambda s, x: s.agg(F.min_by(x, s.key)))
op("last")(lambda s, x: s.agg(F.max_by(x, s.key)))
op("valid_first")(lambda s, x: s.agg(F.min_by(x, F.when(x.isNotNull(), s.key))))
op("valid_last")(lambda s, x: s.agg(F.max_by(x, F.when(x.isNotNull(), s.key))))


@op("skew")
def skew(s: Scope, x: Column, min_periods: int = 3) -> Column:
    """Sample skewness with the usual correction of bias."""
    n = s.agg(F.count(x)).cast("double")
    return F.when(n >= max(3, min_periods), F.sqrt(n * (n - 1)) * F.try_divide(s.agg(F.skewness(x)), n - 2))


@op("kurt")
def kurt(s: Scope, x: Column, min_periods: int = 4) -> Column:
    """Sample excess kurtosis with the usual correction of bias."""
    n = s.agg(F.count(x)).cast("double")
    return F.when(n >= max(4, min_periods), F.try_divide((n - 1) * ((n + 1) * s.agg(F.kurtosis(x)) + 6), (n - 2) * (n - 3)))


@op("quantile")
def quantile(s: Scope, x: Column, q: float, method: str = "linear", levels: tuple = ()) -> Column:
    """levels: all linear quantiles that are asked of x here, taken in one pass over its values."""
    if method == "linear":
        if len(levels) > 1:
            return F.get(s.agg(F.percentile(x, F.array(*[F.lit(v) for v in levels]))), F.lit(levels.index(float(q))))
        return s.agg(F.percentile(x, F.lit(float(q))))
    if s.mode == "rows" and s.part:
        return placed_quantile(s, x, F.row_number().over(s.by(x.asc_nulls_last())), F.count(x).over(s.whole), q, method)
    values = F.array_sort(s.agg(F.collect_list(x)))  # of a frame's rows
    place = F.lit(float(q)) * (F.size(values) - 1)
    low, high = F.get(values, F.floor(place).cast("int")), F.get(values, F.ceil(place).cast("int"))
    return F.when(F.size(values) > 0, _between(low, high, method))


def _between(low: Column, high: Column, method: str) -> Column:
    out = {"lower": low, "higher": high, "midpoint": (low + high) / 2}
    if method not in out:
        raise ValueError(f"no such quantile method: {method}")
    return out[method]


def placed_quantile(s: Scope, x: Column, place: Column, n: Column, q: float, method: str) -> Column:
    """The quantile of x, given each row's place from 1 among the n valid values in order."""
    at = F.lit(float(q)) * (n - 1) + 1
    pick = lambda to: s.agg(F.max(F.when(x.isNotNull() & (place == to(at)), x)))
    return _between(pick(F.floor), pick(F.ceil), method)


def linear_quantile(low: Column, high: Column, n: Column, q: float) -> Column:
    """The quantile of n values, as F.percentile takes it, from those at the places around (n - 1) * q in order."""
    place = (n - 1) * F.lit(float(q))
    between = (F.ceil(place) - place) * low + (place - F.floor(place)) * high
    return F.when(n > 0, F.when(low == high, low).otherwise(between))


op("median")(lambda s, x, levels=(): quantile(s, x, 0.5, levels=levels))


def paired(x: Column, y: Column) -> tuple[Column, Column]:
    """Both with NULL where either is missing."""
    return F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)


@op("cov")
def cov(s: Scope, x: Column, other: Column, min_periods: int = 3) -> Column:
    x, y = paired(x, other)
    return gate(s, x, max(2, min_periods), s.agg(F.covar_samp(x, y)))


def safe_corr(s: Scope, x: Column, y: Column, min_periods: int = 1) -> Column:
    """Pearson correlation over pairs; NULL where either side hardly varies (F.corr fails there)."""
    x, y = paired(x.cast("double"), y.cast("double"))
    vx, vy = s.agg(F.var_pop(x)), s.agg(F.var_pop(y))
    value = F.try_divide(s.agg(F.covar_pop(x, y)), F.sqrt(vx) * F.sqrt(vy))
    return F.when((vx > TINY) & (vy > TINY) & (s.agg(F.count(x)) >= min_periods), value)


def average_rank(s: Scope, x: Column, rev: bool = False) -> Column:
    """Rank from 1 with ties averaged; NULL for missing values, which are ranked after all others."""
    first = F.rank().over(s.by(x.desc_nulls_last() if rev else x.asc_nulls_last()))
    ties = F.count(F.lit(1)).over(s.by(F.lit(1), within=(x,)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.when(x.isNotNull(), first + (ties - 1) / 2)


@op("corr")
def corr(s: Scope, x: Column, other: Column, method: str = "pearson", min_periods: int = 3) -> Column:
    if method == "pearson":
        return safe_corr(s, x, other, min_periods)
    if method != "spearman" or s.mode == "frame":
        raise ValueError(f"no such correlation here: {method}")
    x, y = paired(x, other)
    return safe_corr(s, average_rank(s, x), average_rank(s, y), min_periods)


@op("weight_mean")
def weight_mean(s: Scope, x: Column, weight: Column, min_periods: int = 1) -> Column:
    """Sum of x times weight over the sum of all valid weights."""
    return gate(s, F.when(weight.isNotNull(), x), min_periods, F.try_divide(s.agg(F.sum(x * weight)).cast("double"), s.agg(F.sum(weight)).cast("double")))


@op("cut_mean")
def cut_mean(s: Scope, x: Column, mask: Column, min_periods: int = 1) -> Column:
    x = F.when(mask, x)
    return gate(s, x, min_periods, s.agg(F.avg(x)))


@op("cut_sum")
def cut_sum(s: Scope, x: Column, mask: Column) -> Column:
    return F.coalesce(s.agg(F.sum(F.when(mask, x))), F.lit(0))


def _place(s: Scope) -> Column:
    """Row number from 0: place among the rows of the partition."""
    return (F.row_number().over(s.ordered) - 1).cast("long")


def least_at(s: Scope, x: Column, place: Column) -> Column:
    return F.coalesce(s.agg(F.min(F.when(x.isNotNull(), F.struct(x.alias("v"), place.alias("i"))))).getField("i"), F.lit(-1).cast("long"))


def most_at(s: Scope, x: Column, place: Column) -> Column:
    return F.coalesce(-s.agg(F.max(F.when(x.isNotNull(), F.struct(x.alias("v"), (-place).alias("i"))))).getField("i"), F.lit(-1).cast("long"))


@op("argmin")
def argmin(s: Scope, x: Column) -> Column:
    """Place of the first least value among the rows of the group or partition, -1 if all are missing."""
    return least_at(s, x, _place(s))


@op("argmax")
def argmax(s: Scope, x: Column) -> Column:
    return most_at(s, x, _place(s))
