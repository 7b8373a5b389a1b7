"""Elementwise operations. Missing is NULL: a result that would be NaN is NULL, so that later aggregates skip it."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideframe.functions.durations import Duration, duration
from tideframe.functions.registry import Scope, op

CASTS = {
    "float": "double", "f64": "double", "f32": "float", "int": "int", "i32": "int", "i64": "bigint", "usize": "bigint", "u64": "bigint", "opt<usize>": "bigint",
    "bool": "boolean", "str": "string", "datetime": "timestamp_ntz", "datetime(us)": "timestamp_ntz", "datetime(ms)": "timestamp_ntz", "datetime(ns)": "timestamp_ntz", "timedelta": "interval day to second",
}
INF = float("inf")


def known(c: Column) -> Column:
    """c with NaN made NULL."""
    return F.when(~F.isnan(c), c)


def double(c: Column) -> Column:
    return c.cast("double")


def _unary(name: str, fn) -> None:
    op(name)(lambda s, x: known(fn(double(x))))


_unary("sqrt", F.sqrt)
_unary("cbrt", F.cbrt)
_unary("ln", lambda x: F.when(x == 0, -INF).otherwise(F.log(x)))
_unary("ln_1p", lambda x: F.when(x == -1, -INF).otherwise(F.log1p(x)))
_unary("log2", lambda x: F.when(x == 0, -INF).otherwise(F.log2(x)))
_unary("log10", lambda x: F.when(x == 0, -INF).otherwise(F.log10(x)))
_unary("exp", F.exp)
_unary("exp2", lambda x: F.pow(F.lit(2.0), x))
_unary("exp_m1", F.expm1)
for _name in ("sin", "cos", "tan", "asin", "acos", "atan"):
    _unary(_name, getattr(F, _name))


def whole(x: Column, fn) -> Column:
    """fn (ceil or floor) as a double; numbers of 2^53 and more are whole already."""
    return F.when(F.abs(x) >= 2.0**53, x).otherwise(fn(F.when(F.abs(x) < 2.0**53, x)).cast("double"))


_unary("ceil", lambda x: whole(x, F.ceil))
_unary("floor", lambda x: whole(x, F.floor))
_unary("trunc", lambda x: F.when(x < 0, whole(x, F.ceil)).otherwise(whole(x, F.floor)))
_unary("fract", lambda x: x - F.when(x < 0, whole(x, F.ceil)).otherwise(whole(x, F.floor)))
op("sign")(lambda s, x: F.signum(x))
op("abs")(lambda s, x: F.abs(x))
op("neg")(lambda s, x: -x)
op("invert")(lambda s, x: ~x)
op("round")(lambda s, x, precision=0: F.round(x, precision))
_ln = lambda x: F.when(x == 0, -INF).otherwise(F.log(x))
op("log")(lambda s, x, base: known(_ln(double(x)) / F.log(F.lit(float(base)))))
op("kept")(lambda s, x, mask: F.when(mask, x))
op("pow")(lambda s, x, y: known(F.pow(double(x), double(y) if isinstance(y, Column) else F.lit(float(y)))))
op("add")(lambda s, x, y: x + (y.interval if isinstance(y, Duration) else y))
op("radd")(lambda s, x, y: y + x)
op("sub")(lambda s, x, y: x - (y.interval if isinstance(y, Duration) else y))
op("rsub")(lambda s, x, y: y - x)
op("mul")(lambda s, x, y: x * y)
op("rmul")(lambda s, x, y: y * x)
op("div")(lambda s, x, y: F.try_divide(double(x), double(y) if isinstance(y, Column) else F.lit(float(y))))
op("rdiv")(lambda s, x, y: F.try_divide(F.lit(float(y)), double(x)))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, b: a + b)


def transposed(x: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(F.get(x, F.lit(0))) - 1), lambda j: F.transform(x, lambda r: F.get(r, j)))


def depth(s: Scope, x: Column) -> int:
    """2 for a matrix (an array of rows), else 1."""
    kind = s.kind(x)
    return 2 if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType) else 1


@op("matmul", "dot")
def matmul(s: Scope, x: Column, y: Column) -> Column:
    """Products of vectors and matrices, the last axis of x with the first of y."""
    nx, ny = depth(s, x), depth(s, y)
    if (nx, ny) == (1, 1):
        return dot(x, y)
    if ny == 1:
        return F.transform(x, lambda r: dot(r, y))
    columns = transposed(y)
    if nx == 1:
        return F.transform(columns, lambda c: dot(x, c))
    return F.transform(x, lambda r: F.transform(columns, lambda c: dot(r, c)))


op("eq")(lambda s, x, y: x == y)
op("ne")(lambda s, x, y: x != y)
op("lt")(lambda s, x, y: x < y)
op("le")(lambda s, x, y: x <= y)
op("gt")(lambda s, x, y: x > y)
op("ge")(lambda s, x, y: x >= y)
op("and")(lambda s, x, y: x & y)
op("or")(lambda s, x, y: x | y)
op("is_in")(lambda s, x, values: x.isin(list(values)))
op("is_nan", "is_none")(lambda s, x: x.isNull())
op("not_nan", "not_none")(lambda s, x: x.isNotNull())
op("is_finite")(lambda s, x: F.coalesce(F.abs(double(x)) < INF, F.lit(False)))
op("is_inf")(lambda s, x: F.coalesce(F.abs(double(x)) == INF, F.lit(False)))


@op("clip")
def clip(s: Scope, x: Column, min=None, max=None) -> Column:
    out = F.when(F.lit(False), x)
    if max is not None:
        out = F.when(x > max, F.lit(max))
    if min is not None:
        out = out.when(x < min, F.lit(min)) if max is not None else F.when(x < min, F.lit(min))
    return out.otherwise(x)


@op("where_")
def where_(s: Scope, x: Column, mask: Column, other) -> Column:
    """x where mask holds, else other."""
    return F.when(mask, x).otherwise(other)


@op("put_mask")
def put_mask(s: Scope, x: Column, mask: Column, value) -> Column:
    return F.when(mask, value).otherwise(x)


@op("if_then")
def if_then(s: Scope, x: Column, con: Column, then) -> Column:
    """then for the whole column if con, a scalar, holds; else x."""
    return F.when(con, then).otherwise(x)


def as_interval(x: Column) -> Column:
    """Microseconds as a duration."""
    return F.make_dt_interval(secs=(x.cast("decimal(24,6)") / 1_000_000).cast("decimal(18,6)"))


def micros(x: Column) -> Column:
    """A duration in whole microseconds."""
    part = lambda unit: F.extract(F.lit(unit), x)
    return ((part("DAY").cast("long") * 24 + part("HOUR")) * 60 + part("MINUTE")) * 60_000_000 + (part("SECOND") * 1_000_000).cast("long")


op("micros")(lambda s, x: micros(x))


@op("cast")
def cast(s: Scope, x: Column, ty: str) -> Column:
    kind = CASTS.get(ty.lower().replace("[", "(").replace("]", ")"))
    if kind is None:
        raise ValueError(f"no such type: {ty}")
    if kind.startswith("interval") and isinstance(s.kind(x), T.NumericType):
        return as_interval(x)
    if isinstance(s.kind(x), T.DayTimeIntervalType) and kind in ("int", "bigint", "double"):
        return micros(x).cast(kind)
    out = x.try_cast(kind)
    return F.date_trunc("millisecond", out).cast("timestamp_ntz") if "(ms)" in ty.lower().replace("[", "(").replace("]", ")") else out


#: strftime codes and their Spark patterns (fixed values of both formats).
TIME_CODES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%j": "DDD", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%p": "a", "%I": "hh", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss", "%%": "%"}


def spark_pattern(fmt: str) -> str:
    out = []
    for code, text in re.findall(r"(%.)|([^%]+)", fmt):
        if code and code not in TIME_CODES:
            raise ValueError(f"no such time code: {code}")
        out.append(TIME_CODES[code] if code else re.sub(r"([A-Za-z]+)", r"'\1'", text.replace("'", "''")))
    return "".join(out)


@op("strptime")
def strptime(s: Scope, x: Column, fmt: str) -> Column:
    return F.try_to_timestamp(x, F.lit(spark_pattern(fmt))).cast("timestamp_ntz")


@op("strftime")
def strftime(s: Scope, x: Column, fmt: str) -> Column:
    return F.coalesce(F.date_format(x, spark_pattern(fmt)), F.lit("NaT"))


@op("offset_by")
def offset_by(s: Scope, x: Column, delta: str) -> Column:
    return x + duration(delta).interval


for _name in ("year", "month", "hour", "minute", "second"):
    op(_name)(lambda s, x, f=getattr(F, _name): f(x))
op("day")(lambda s, x: F.dayofmonth(x))


# arrays as rows of a matrix, and matrices as arrays of rows
op("insert_axis")(lambda s, x, position=0: F.array(x))
op("remove_axis")(lambda s, x, position=0: F.get(x, F.lit(0)))
op("diag")(lambda s, x: F.transform(F.sequence(F.lit(0), F.least(F.size(x), F.size(F.get(x, F.lit(0)))) - 1), lambda i: F.get(F.get(x, i), i)))
op("t", "swap_axes", "permuted_axes", "conjugate")(lambda s, x, *axes: transposed(x))  # numbers are real
op("shape")(lambda s, x: F.array(F.size(x), F.size(F.get(x, F.lit(0)))) if depth(s, x) == 2 else F.array(F.size(x)))
op("flatten")(lambda s, x: F.flatten(x))
op("broadcast", "broadcast_with")(lambda s, x, n: F.array_repeat(x, n))
op("reshape")(lambda s, x, cols: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / cols).cast("int")), lambda i: F.slice(x, i * cols + 1, cols)))
op("stack")(lambda s, x, *others: F.array(x, *others))
op("get", "at")(lambda s, x, i: F.element_at(x, i + 1 if i >= 0 else i))
op("array_filter")(lambda s, x, mask: F.transform(F.filter(F.arrays_zip(x.alias("v"), mask.alias("m")), lambda p: p["m"]), lambda p: p["v"]))
for _name, _fn in (("min", F.array_min), ("max", F.array_max)):
    op(f"array_{_name}")(lambda s, x, f=_fn: f(x))
op("array_sum")(lambda s, x: F.aggregate(F.filter(x, lambda v: v.isNotNull()), F.lit(0.0), lambda a, v: a + v))
op("array_count")(lambda s, x: F.size(F.filter(x, lambda v: v.isNotNull())).cast("long"))


def array_mean(x: Column) -> Column:
    kept = F.filter(x, lambda v: v.isNotNull())
    return F.try_divide(F.aggregate(kept, F.lit(0.0), lambda a, v: a + v), F.size(kept))


op("array_mean")(lambda s, x: array_mean(x))


@op("array_std")
def array_std(s: Scope, x: Column, min_periods: int = 2) -> Column:
    kept, mean = F.filter(x, lambda v: v.isNotNull()), array_mean(x)
    squares = F.aggregate(kept, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
    return F.when(F.size(kept) >= max(2, min_periods), F.sqrt(F.try_divide(squares, F.size(kept) - 1)))
