"""Cumulative distributions over Arrow batches, in numpy: the normal one by the incomplete gamma function (Spark has no
erf), t and F by the continued fraction of the regularised incomplete beta function."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tideframe.functions.registry import op

_TINY = 1e-300


def on_column(name: str):
    """Register a function of a column as an operation that needs nothing of its scope."""

    def put(fn):
        op(name)(lambda scope, x, *args, **kw: fn(x, *args, **kw))
        return fn

    return put


def _lentz(first: np.ndarray, step, most: int = 500) -> np.ndarray:
    """The continued fraction 1 / (first + a1 / (b1 + ...)) by Lentz's method; step(m) gives the pairs (a, b) of round m."""
    away = lambda v: np.where(np.abs(v) > _TINY, v, _TINY)
    d = 1 / away(first)
    c, h = np.full_like(first, 1 / _TINY), d.copy()
    for m in range(1, most):
        turn = np.ones_like(h)
        for a, b in step(m):
            d, c = 1 / away(b + a * d), away(b + a / c)
            turn = turn * (d * c)
        h = h * turn
        if np.all(np.abs(turn - 1) < 1e-15):
            break
    return h


def erfc(x: np.ndarray) -> np.ndarray:
    """1 - erf(x): a series about 0, a continued fraction further out."""
    z = np.abs(x)
    near = np.minimum(z, 2.5)
    term, total = near.copy(), near.copy()
    for k in range(1, 80):
        term = term * (2 * near * near) / (2 * k + 1)
        total = total + term
    inner = 1 - 2 / math.sqrt(math.pi) * np.exp(-near * near) * total
    far = np.maximum(z, 2.5)
    outer = np.exp(-far * far) * far / math.sqrt(math.pi) * _lentz(far * far + 0.5, lambda m: [(-m * (m - 0.5), far * far + 2 * m + 0.5)])
    out = np.where(z < 2.5, inner, outer)
    return np.where(x < 0, 2 - out, out)


def beta_inc(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """I_x(a, b), on the side where the fraction converges fast."""
    x = np.clip(x, 0.0, 1.0)
    turned = x > (a + 1) / (a + b + 2)
    y, p, q = np.where(turned, 1 - x, x), np.where(turned, b, a), np.where(turned, a, b)
    inside = np.clip(y, 1e-290, 1 - 1e-16)
    front = np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + p * np.log(inside) + q * np.log1p(-inside)) / p

    def step(m: int):
        one = np.ones_like(inside)
        k = m - 1
        yield -(p + k) * (p + q + k) * inside / ((p + 2 * k) * (p + 2 * k + 1)), one
        yield m * (q - m) * inside / ((p + 2 * m - 1) * (p + 2 * m)), one

    value = front * _lentz(np.ones_like(inside), step, 2000)
    value = np.where(y <= 0, 0.0, value)
    return np.where(turned, 1 - value, value)


def norm_cdf_values(x: np.ndarray, mean: float = 0.0, std: float = 1.0) -> np.ndarray:
    return 0.5 * erfc(-(x - mean) / (std * math.sqrt(2)))


def t_cdf_values(x: np.ndarray, df: float, loc: float = 0.0, scale: float = 1.0) -> np.ndarray:
    t = (x - loc) / scale
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return np.where(t > 0, 1 - tail, tail)


def f_cdf_values(x: np.ndarray, df1: float, df2: float) -> np.ndarray:
    far = np.isinf(x)
    y = np.where(far | (x <= 0), 0.0, x)
    return np.where(far & (x > 0), 1.0, beta_inc(df1 / 2, df2 / 2, df1 * y / (df1 * y + df2)))


def _one(values):
    """A function of arrays as one of a number."""
    return lambda x, *args, **kw: float(values(np.array([float(x)]), *args, **kw)[0])


norm_cdf_value, t_cdf_value, f_cdf_value = _one(norm_cdf_values), _one(t_cdf_values), _one(f_cdf_values)


def _vector(fn):
    """fn of an array as an Arrow-batched function of a column; NULL stays NULL."""

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        values, good = x.to_numpy(dtype=float, na_value=np.nan), x.notna().to_numpy()
        out = np.full(len(values), np.nan)
        if good.any():
            out[good] = fn(values[good])
        return pd.Series(out).where(good, None).astype("Float64")

    return run


@on_column("norm_cdf")
def norm_cdf(x: Column, mean: float = 0.0, std: float = 1.0) -> Column:
    return _vector(lambda v: norm_cdf_values(v, mean, std))(x.cast("double"))


@on_column("t_cdf")
def t_cdf(x: Column, df: float, loc: float = 0.0, scale: float = 1.0) -> Column:
    return _vector(lambda v: t_cdf_values(v, df, loc, scale))(x.cast("double"))


@on_column("f_cdf")
def f_cdf(x: Column, df1: float, df2: float) -> Column:
    return _vector(lambda v: f_cdf_values(v, df1, df2))(x.cast("double"))
