"""Group-by on keys and on time buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.functions.durations import bucket_start, duration
from tideframe.functions.registry import Scope
from tideframe.plans.expr import Expr, asexpr, col
from tideframe.plans.prepare import prepared, with_quantiles

#: Aggregates that a string names.
SHORT = {"sum", "mean", "var", "std", "min", "max", "umin", "umax", "first", "last", "valid_first", "valid_last", "median", "prod", "skew", "kurt", "count_valid", "count_none", "any", "all", "len", "argmin", "argmax"}


class Grouped:
    """groupby("g", ...) or groupby("12h", time="ts", closed="left" | "right"), with further keys.

    sort gives groups in the order in which their first rows come. Time buckets are labelled by their start; closed on
    the right, a bucket holds (start, start + d].
    """

    def __init__(self, frame, *by, time: str | None = None, closed: str = "left", sort: bool = False, name: str | None = None):
        self.frame, self.sort, self.df = frame, sort, frame.df
        self.keys = [k for b in by for k in (b if isinstance(b, (list, tuple)) else [b])]
        if time is not None:
            if closed not in ("left", "right"):
                raise ValueError("closed is left or right")
            every, *self.keys = self.keys
            t = F.col(time) if closed == "left" else F.col(time) - duration("1us").interval
            label = name or time
            self.df = self.df.withColumn("__bucket", bucket_start(t, duration(every)))
            self.keys = [("__bucket", label), *self.keys]
        self.keys = [k if isinstance(k, tuple) else (k, k) for k in self.keys]

    def agg(self, *exprs, **named) -> DataFrame:
        wanted: dict[str, Expr] = {e.name: e for e in exprs}
        for name, how in named.items():
            if isinstance(how, str):
                if how not in SHORT:
                    raise ValueError(f"no such aggregate: {how}")
                how = getattr(col(name), how)()
            wanted[name] = asexpr(how)
        df, wanted = with_quantiles(self.df, [k for k, _ in self.keys], wanted)
        scope = prepared(df, Scope(tuple(F.col(k) for k, _ in self.keys), self.frame.order, "group"), list(wanted.values()))
        cols = [e.lower(scope).alias(n) for n, e in wanted.items()]
        if self.sort:
            cols.append(F.min(scope.key).alias("__first"))
        out = scope.df.groupBy(*[k for k, _ in self.keys]).agg(*cols)
        if self.sort:
            out = out.orderBy("__first")
        return out.select(*[F.col(k).alias(n) for k, n in self.keys], *wanted)

    def __getattr__(self, kind: str):
        if kind not in SHORT | {"quantile", "cov", "corr"}:
            raise AttributeError(kind)
        return lambda name, *args, **kw: self.agg(Expr(kind, (col(name), *[col(a) if isinstance(a, str) else a for a in args]), kw, name))

    def apply(self, fn, schema) -> DataFrame:
        """fn(pandas frame of a group) -> pandas frame: for what has no expression; a group must fit in a task."""
        return self.df.groupBy(*[k for k, _ in self.keys]).applyInPandas(fn, schema)
