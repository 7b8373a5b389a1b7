"""Statistics over trailing windows of n rows. The value is missing where fewer than min_periods values are valid.

Those without a Catalyst aggregate work on one collected array of the window's valid values, which all of them share;
it holds n values at most, so it suits windows up to some hundreds of rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideframe.functions import aggregates
from tideframe.functions.registry import Scope, op


def over(s: Scope, window: int) -> Scope:
    return Scope(s.part, s.order, "frame", s.trailing(window), s.specs)


def _from_aggregate(name: str, base, least: int = 1) -> None:
    @op(name)
    def run(s: Scope, x: Column, window: int, min_periods: int | None = None) -> Column:
        f = over(s, window)
        return aggregates.gate(f, x, max(least, min_periods or 1), base(f, x))


_from_aggregate("ts_sum", lambda f, x: f.agg(F.sum(x)))
_from_aggregate("ts_mean", lambda f, x: f.agg(F.avg(x)))
_from_aggregate("ts_sma", lambda f, x: f.agg(F.avg(x)))
_from_aggregate("ts_std", lambda f, x: f.agg(F.stddev_samp(x)))
_from_aggregate("ts_var", lambda f, x: f.agg(F.var_samp(x)))
_from_aggregate("ts_min", lambda f, x: f.agg(F.min(x)))
_from_aggregate("ts_max", lambda f, x: f.agg(F.max(x)))
_from_aggregate("ts_prod", lambda f, x: f.agg(F.product(x)))
_from_aggregate("ts_skew", lambda f, x: aggregates.skew(f, x), 3)
_from_aggregate("ts_kurt", lambda f, x: aggregates.kurt(f, x), 4)
_from_aggregate("ts_zscore", lambda f, x: F.try_divide(x - f.agg(F.avg(x)), F.when(f.agg(F.stddev_samp(x)) > 0, f.agg(F.stddev_samp(x)))))
_from_aggregate("ts_minmaxnorm", lambda f, x: F.try_divide((x - f.agg(F.min(x))).cast("double"), (f.agg(F.max(x)) - f.agg(F.min(x))).cast("double")))


def _from_values(name: str, value, least: int = 1) -> None:
    """value(values, number of values, current x, window) over the array of valid values, oldest first."""

    @op(name)
    def run(s: Scope, x: Column, window: int, min_periods: int | None = None, **kw) -> Column:
        values = over(s, window).agg(F.collect_list(x.cast("double")))
        return F.when(F.size(values) >= max(least, min_periods or 1), value(values, F.size(values).cast("double"), x.cast("double"), window, **kw))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def weighted(values: Column) -> Column:
    """The sum of k times the k-th value, k from 1."""
    return total(F.transform(values, lambda v, i: v * (i + 1)))


def ewm(values: Column, n: Column, x: Column, window: int) -> Column:
    keep = 1.0 - 2.0 / window
    start = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("w"))
    return F.aggregate(values, start, lambda a, v: F.struct((a["v"] * keep + v).alias("v"), (a["w"] * keep + 1.0).alias("w")), lambda a: F.try_divide(a["v"], a["w"]))


def slope(values: Column, n: Column) -> Column:
    return F.try_divide(12 * weighted(values) - 6 * (n + 1) * total(values), n * (n * n - 1))


def intercept(values: Column, n: Column) -> Column:
    return F.try_divide(total(values), n) - slope(values, n) * (n + 1) / 2


def place_in(values: Column, n: Column, x: Column, window: int, pct: bool = False, rev: bool = False) -> Column:
    ahead = F.size(F.filter(values, lambda v: v > x if rev else v < x))
    r = F.when(x.isNotNull(), ahead + (F.size(F.filter(values, lambda v: v == x)) + 1) / 2)
    return r / n if pct else r


for _name in ("ts_ewm", "ts_ema"):
    _from_values(_name, ewm)
for _name in ("ts_wma", "ts_decay_linear"):
    _from_values(_name, lambda a, n, x, w: F.try_divide(weighted(a), n * (n + 1) / 2))
_from_values("ts_rank", place_in)
_from_values("ts_reg", lambda a, n, x, w: intercept(a, n) + slope(a, n) * n, 2)
_from_values("ts_tsf", lambda a, n, x, w: intercept(a, n) + slope(a, n) * (n + 1), 2)
_from_values("ts_reg_slope", lambda a, n, x, w: slope(a, n), 2)
_from_values("ts_reg_intercept", lambda a, n, x, w: intercept(a, n), 2)
_from_values("ts_reg_resid_mean", lambda a, n, x, w: F.try_divide(total(a) - intercept(a, n) * n - slope(a, n) * n * (n + 1) / 2, n), 2)


def _arg(name: str, sign: int) -> None:
    @op(name)
    def run(s: Scope, x: Column, window: int, min_periods: int | None = None) -> Column:
        """Place in the window from 1; of ties the last."""
        f, at = over(s, window), F.row_number().over(s.ordered)
        pick = F.max if sign > 0 else F.min
        best = f.agg(pick(F.when(x.isNotNull(), F.struct(x.alias("v"), (at * sign).alias("i"))))).getField("i") * sign
        return aggregates.gate(f, x, min_periods or 1, (best - f.agg(F.min(at)) + 1).cast("long"))


_arg("ts_argmax", 1)
_arg("ts_argmin", -1)


def _pair(name: str, value, least: int = 2) -> None:
    @op(name)
    def run(s: Scope, x: Column, other: Column, window: int, min_periods: int | None = None) -> Column:
        f = over(s, window)
        a, b = aggregates.paired(x.cast("double"), other.cast("double"))
        return aggregates.gate(f, a, max(least, min_periods or 1), value(f, a, b))


_pair("ts_cov", lambda f, a, b: f.agg(F.covar_samp(a, b)))
_pair("ts_corr", lambda f, a, b: aggregates.safe_corr(f, a, b))
_pair("ts_regx_beta", lambda f, a, b: f.agg(F.regr_slope(a, b)))
_pair("ts_regx_alpha", lambda f, a, b: f.agg(F.regr_intercept(a, b)))
_pair("ts_regx_resid_mean", lambda f, a, b: f.agg(F.avg(a)) - f.agg(F.regr_intercept(a, b)) - f.agg(F.regr_slope(a, b)) * f.agg(F.avg(b)))


def _resid_var(f: Scope, a: Column, b: Column) -> Column:
    rest = f.agg(F.regr_syy(a, b)) - f.agg(F.regr_slope(a, b)) * f.agg(F.regr_sxy(a, b))
    return F.when(rest.isNotNull(), F.try_divide(F.greatest(rest, F.lit(0.0)), f.agg(F.count(a)).cast("double") - 1))


_pair("ts_regx_resid_std", lambda f, a, b: F.sqrt(_resid_var(f, a, b)))


def _resid_skew(f: Scope, a: Column, b: Column) -> Column:
    pairs = f.agg(F.collect_list(F.when(a.isNotNull(), F.struct(a.alias("a"), b.alias("b")))))
    alpha, beta, n = f.agg(F.regr_intercept(a, b)), f.agg(F.regr_slope(a, b)), F.size(pairs).cast("double")
    moment = lambda p: F.aggregate(pairs, F.lit(0.0), lambda t, e: t + F.pow(e["a"] - alpha - beta * e["b"], F.lit(float(p)))) / n
    m2 = moment(2)
    return F.when((n >= 3) & (m2 > aggregates.TINY), F.sqrt(n * (n - 1)) / (n - 2) * moment(3) / F.pow(m2, F.lit(1.5)))


_pair("ts_regx_resid_skew", _resid_skew, 3)
