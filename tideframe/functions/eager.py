"""Module functions: eager.sum(x), eager.ts_mean(x, 5) and so on.

Of an expression they give an expression. Of a list, an array, a series or a table of columns they run at once on the
active session and give a number (aggregates), an array, or one of these for each column of a table.
"""

from __future__ import annotations

import numpy as np

_AGGREGATES = ("sum", "prod", "min", "max", "mean", "median", "quantile", "std", "var", "skew", "kurt", "count_nan", "count_notnan", "cov", "corr")
_ROWS = ("cumsum", "cumprod", "argsort", "rank", "clip", "split_group", "fillna", "zscore", "winsorize", "shift")
_WINDOWS = (
    "ts_sum", "ts_mean", "ts_ewm", "ts_wma", "ts_std", "ts_var", "ts_skew", "ts_kurt", "ts_max", "ts_min", "ts_argmax", "ts_argmin", "ts_minmaxnorm", "ts_zscore",
    "ts_reg", "ts_tsf", "ts_reg_slope", "ts_reg_intercept", "ts_decay_linear", "ts_ema", "ts_cov", "ts_corr", "ts_rank",
)
_PAIRS = ("cov", "corr", "ts_cov", "ts_corr")
__all__ = [*_AGGREGATES, *_ROWS, *_WINDOWS, "dropna"]


def _frame(columns: dict):
    from pyspark.sql import SparkSession

    from tideframe.sources import io

    spark = SparkSession.active()
    return io.frame(spark, {**{k: np.asarray(x, dtype=float) for k, x in columns.items()}, "__g": np.zeros(len(next(iter(columns.values()))), int)})


def _call(name: str, x, args: tuple, kw: dict):
    from tideframe.functions.registry import HINTS
    from tideframe.operators.frame import TideFrame
    from tideframe.plans.expr import Expr, col

    kw = {k: v for k, v in kw.items() if k not in HINTS}
    if isinstance(x, Expr):
        return getattr(x, name)(*args, **kw)
    if hasattr(x, "columns") and hasattr(x, "items"):
        return {c: _call(name, x[c], args, kw) for c in x.columns}
    if getattr(x, "ndim", 1) == 2:
        found = [_call(name, x[:, k], args, kw) for k in range(x.shape[1])]
        return np.array(found) if name in _AGGREGATES else np.column_stack(found)
    columns = {"x": x}
    if name in _PAIRS:
        columns["y"], args = args[0], (col("y"), *args[1:])
    f = _frame(columns)
    e = getattr(col("x"), name)(*args, **kw)
    if name in _AGGREGATES:
        return f.groupby("__g").agg(r=e).first().r
    out = TideFrame(f.df, f.order, "__g").with_columns(r=e).df.orderBy(*f.order).select("r")
    return np.array([np.nan if r.r is None else r.r for r in out.collect()])


def _make(name: str):
    def run(x, *args, **kw):
        return _call(name, x, args, kw)

    run.__name__ = run.__qualname__ = name
    run.__doc__ = f"{name} of an expression, or at once of local values."
    return run


for _name in (*_AGGREGATES, *_ROWS, *_WINDOWS):
    globals()[_name] = _make(_name)


def dropna(x, how: str = "any"):
    """The values that are not missing; of a table's rows (two dimensions) those without any, or all, values missing."""
    from tideframe.plans.expr import Expr

    if isinstance(x, Expr):
        return x.dropna()
    a = np.asarray(x, dtype=float)
    bad = np.isnan(a)
    return a[~bad] if a.ndim == 1 else a[~(bad.any(1) if how == "any" else bad.all(1))]
