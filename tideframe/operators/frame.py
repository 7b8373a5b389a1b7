"""TideFrame: a DataFrame with an order of rows and a partition, and the operations on named columns.

Spark has no implicit row order, so operations that depend on one take it from here; the order should be total within
the partition. NaN is made NULL once, when a frame is made, so that every aggregate skips missing values.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideframe.functions.aggregates import paired, safe_corr
from tideframe.functions.registry import Scope
from tideframe.operators.ranges import distributed_rank, numbered, ranked_counts, spread  # noqa: F401
from tideframe.plans.expr import Expr, asexpr, col, horizontal
from tideframe.plans.prepare import nodes, prepared, ranged, with_quantiles

_RN = "__place"
#: Comparisons with a constant that a scan can take, and the same with its sides changed.
_SCANNED = {"gt": "lt", "lt": "gt", "ge": "le", "le": "ge", "eq": "eq"}


class TideFrame:
    def __init__(self, df: DataFrame, order=(), part=(), normalise: bool = True):
        one = lambda x: (x,) if isinstance(x, str) else tuple(x)
        self.order, self.part = one(order), one(part)
        self.raw = df if normalise else None
        if normalise:
            floats = {f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
            df = df.withColumns(floats) if floats else df
        self.df = df

    def _with(self, df: DataFrame, order=None, part=None) -> TideFrame:
        return TideFrame(df, self.order if order is None else order, self.part if part is None else part, normalise=False)

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def scope(self) -> Scope:
        return Scope(tuple(F.col(p) for p in self.part), self.order)

    def _exprs(self, exprs, named) -> dict[str, Expr]:
        out = {}
        for e in exprs:
            for x in e if isinstance(e, (list, tuple)) else [e]:
                x = col(x) if isinstance(x, str) else asexpr(x)
                for y in self._expand(x):
                    out[y.name] = y
        return out | {k: asexpr(v) for k, v in named.items()}

    def _expand(self, e: Expr) -> list[Expr]:
        """A column named by ^a regular expression$ stands for all columns that match it."""
        if e.kind == "col" and e.args[0].startswith("^"):
            return [col(c) for c in self.resolve(e.args[0])]
        return [e]

    def resolve(self, key) -> list[str]:
        """Names of an index (from the end if negative), a name, a ^pattern$ or a list of these."""
        if isinstance(key, int):
            return [self.columns[key]]
        if isinstance(key, (list, tuple)):
            return [n for k in key for n in self.resolve(k)]
        if key.startswith("^") and key.endswith("$"):
            return [c for c in self.columns if re.match(key, c)]
        if key not in self.columns:
            raise KeyError(key)
        return [key]

    # results
    def to_pandas(self):
        """All rows in order, on the driver."""
        return (self.df.orderBy(*self.order) if self.order else self.df).toPandas()

    def to_arrow(self):
        return (self.df.orderBy(*self.order) if self.order else self.df).toArrow()

    def to_dict(self) -> dict[str, list]:
        return self.to_arrow().to_pydict()

    def eval(self) -> TideFrame:
        """Computed once and kept by the executors for what follows."""
        return self._with(self.df.cache())

    def value(self, expr):
        """The values of an expression in the order of rows, as an array on the driver."""
        import numpy as np

        out = self.with_columns(__value=asexpr(col(expr) if isinstance(expr, str) else expr))
        rows = out.df.orderBy(*self.order) if self.order else out.df
        return np.array(rows.select("__value").toArrow().column(0).to_pylist())

    def simplify(self) -> TideFrame:
        """The frame itself: Catalyst simplifies plans."""
        return self

    def to_pl(self):
        """All rows in order as a polars frame, where polars is installed."""
        import polars

        return polars.from_arrow(self.to_arrow())

    @property
    def shape(self) -> tuple[int, int]:
        return self.df.count(), len(self.columns)

    @property
    def ndim(self) -> int:
        return 2

    # projection and shape
    def select(self, *exprs, **named) -> TideFrame:
        """The expressions as columns. Filtered ones (of one mask) drop the other rows, grouped ones give a row for each group."""
        wanted = self._exprs(exprs, named)
        if any(e.kind == "grouped" for e in wanted.values()):
            return self._grouped(wanted)
        masks = {repr(e.args[1]): e.args[1] for e in wanted.values() if e.kind == "kept"}
        if masks:
            if len(masks) > 1 or any(e.kind != "kept" for e in wanted.values()):
                raise ValueError("columns of different rows: filter the frame instead")
            (mask,) = masks.values()
            return self.filter(mask).select(**{n: e.args[0] for n, e in wanted.items()})
        df = spread(self.df, self.part) if any(ranged(n) for e in wanted.values() for n in nodes(e)) else self.df
        s = prepared(df, self.scope, list(wanted.values()))
        return self._with(s.df.select(*[e.lower(s).alias(n) for n, e in wanted.items()]))

    def _grouped(self, wanted: dict[str, Expr]) -> TideFrame:
        how = {repr((e.kw["by"], sorted(e.kw["how"].items()))) if e.kind == "grouped" else None for e in wanted.values()}
        if len(how) > 1:
            raise ValueError("groups of different keys cannot stand in one frame")
        first = next(iter(wanted.values()))
        out = self.groupby(*first.kw["by"], **first.kw["how"]).agg(**{n: e.args[0] for n, e in wanted.items()})
        return self._with(out, order=(), part=())

    def with_columns(self, *exprs, **named) -> TideFrame:
        wanted = self._exprs(exprs, named)
        df = spread(self.df, self.part) if any(ranged(n) for e in wanted.values() for n in nodes(e)) else self.df
        s = prepared(df, self.scope, list(wanted.values()))
        out = s.df.withColumns({n: e.lower(s) for n, e in wanted.items()})
        return self._with(out.drop(*[c for c in s.df.columns if c not in self.columns]) if s.helpers else out)

    def __getitem__(self, key):
        names = self.resolve(key)
        return self._with(self.df.select(*names))

    def __setitem__(self, key, value) -> None:
        """Put or add a column, or one value for each of several."""
        names = self.resolve(key) if not isinstance(key, str) or key.startswith("^") else [key]
        values = [value] if isinstance(key, (int, str)) and not (isinstance(key, str) and key.startswith("^")) else list(value)
        self.df, self.raw = self.with_columns(**dict(zip(names, values, strict=True))).df, None

    def __delitem__(self, key) -> None:
        self.df, self.raw = self.drop(key).df, None

    def __len__(self) -> int:
        return len(self.columns)

    def drop(self, *keys) -> TideFrame:
        return self._with(self.df.drop(*[n for k in keys for n in self.resolve(k)]))

    exclude = drop

    def rename(self, names) -> TideFrame:
        return self._with(self.df.withColumnsRenamed(names) if isinstance(names, dict) else self.df.toDF(*names))

    def apply(self, fn, exclude=()) -> TideFrame:
        return self.with_columns(**{c: fn(col(c)) for c in self.columns if c not in exclude})

    def filter(self, mask: Expr) -> TideFrame:
        """Rows where mask holds. Comparisons of stored columns with constants also go to the scan as they are: they hold
        for all rows that the mask takes, as a missing value passes none and NaN none that its stead would not."""
        mask = asexpr(mask)
        if self.raw is not None and (simple := self._for_scan(mask)):
            raw = self.raw
            for c in simple:
                raw = raw.filter(c)
            out = TideFrame(raw, self.order, self.part)._filtered(mask)
            out.raw = raw
            return out
        return self._filtered(mask)

    def _for_scan(self, mask: Expr) -> list:
        if mask.kind == "and":
            return self._for_scan(mask.args[0]) + self._for_scan(mask.args[1])
        if mask.kind not in _SCANNED:
            return []
        x, y = mask.args
        plain = lambda e: not isinstance(e, Expr) or e.kind == "lit"
        value = lambda e: e.args[0] if isinstance(e, Expr) else e
        if isinstance(x, Expr) and x.kind == "col" and plain(y):
            name, v, op = x.args[0], value(y), mask.kind
        elif isinstance(y, Expr) and y.kind == "col" and plain(x):
            name, v, op = y.args[0], value(x), _SCANNED[mask.kind]
        else:
            return []
        if name not in self.raw.columns or isinstance(v, (str, bool)) or not isinstance(v, (int, float)):
            return []
        c = F.col(name)
        return [{"gt": c > v, "lt": c < v, "ge": c >= v, "le": c <= v, "eq": c == v}[op]]

    def _filtered(self, mask: Expr) -> TideFrame:
        s = prepared(self.df, self.scope, [mask])
        c = mask.lower(s)
        try:
            out = s.df.filter(c)
        except Exception as error:  # window functions cannot stand in a filter: take the mask as a column first
            if "window" not in str(error).lower():
                raise
            out = s.df.withColumn("__mask", c).filter("__mask").drop("__mask")
        return self._with(out.select(*self.columns) if s.helpers else out)

    def dropna(self, subset=None, how: str = "all") -> TideFrame:
        """Whole rows where all (or any) of the columns are missing."""
        return self._with(self.df.dropna(how, subset=self.resolve(list(subset)) if subset else None))

    def concat(self, *others: TideFrame, source: str | None = None) -> TideFrame:
        frames = [self, *others]
        dfs = [f.df.withColumn(source, F.lit(i)) for i, f in enumerate(frames)] if source else [f.df for f in frames]
        out = dfs[0]
        for d in dfs[1:]:
            out = out.unionByName(d, allowMissingColumns=True)
        return self._with(out)

    # order
    def sort(self, by, rev: bool = False) -> TideFrame:
        """Stable, missing values last either way."""
        exprs = [asexpr(col(b) if isinstance(b, str) else b) for b in (by if isinstance(by, (list, tuple)) else [by])]
        s = prepared(self.df, self.scope, exprs)
        keys = [e.lower(s) for e in exprs]
        return self._with(s.df.select(*self.columns, *[c for c in s.df.columns if c not in self.columns]).orderBy(*[k.desc_nulls_last() if rev else k.asc_nulls_last() for k in keys], *self.order))

    def top(self, n: int, by: str, rev: bool = True) -> TideFrame:
        """The n largest rows (or smallest) of the whole frame, by a bounded heap in each task."""
        c = F.col(by)
        return self._with(self.df.orderBy(c.desc_nulls_last() if rev else c.asc_nulls_last(), *self.order).limit(n))

    def partition_top(self, kth: int, by: str, rev: bool = False, rank: str | None = None) -> TideFrame:
        """The kth + 1 smallest (or largest) rows of each partition; missing values do not count."""
        c = F.col(by)
        w = self.scope.by(c.desc_nulls_last() if rev else c.asc_nulls_last(), *[F.col(o) for o in self.order])
        name = rank or _RN
        out = self.df.where(c.isNotNull()).withColumn(name, F.row_number().over(w).cast("long")).where(F.col(name) <= kth + 1)
        return self._with(out if rank else out.drop(name))

    def _smallest(self, kth: int, by: str, rev: bool, value):
        """(part, array) of value over the kth + 1 smallest (or largest) rows of each partition by rank; fewer if it has fewer."""
        c, s = F.col(by), self.scope
        s.need_order()
        rank = F.row_number().over(s.by(c.desc_nulls_last() if rev else c.asc_nulls_last(), *[F.col(o) for o in self.order]))
        placed = self.df.withColumn("__i", (F.row_number().over(s.ordered) - 1).cast("long")).withColumn("__r", rank)
        some = F.when(c.isNotNull() & (F.col("__r") <= kth + 1), F.struct("__r", value.alias("v")))
        return placed.groupBy(*self.part).agg(F.transform(F.array_sort(F.collect_list(some)), lambda x: x["v"]).alias("a"))

    def partition(self, kth: int, by: str, rev: bool = False, name: str | None = None):
        """A row for each partition: its kth + 1 smallest (or largest) values in order, missing ones at the end to that length."""
        found = self._smallest(kth, by, rev, F.col(by))
        return found.select(*self.part, F.transform(F.sequence(F.lit(0), F.lit(kth)), lambda i: F.get("a", i)).alias(name or by))

    def arg_partition(self, kth: int, by: str, rev: bool = False, name: str | None = None):
        """As partition, with the places of the values in the partition, -1 where there are fewer."""
        found = self._smallest(kth, by, rev, F.col("__i"))
        return found.select(*self.part, F.transform(F.sequence(F.lit(0), F.lit(kth)), lambda i: F.coalesce(F.get("a", i), F.lit(-1).cast("long"))).alias(name or by))

    def unique(self, subset, keep: str = "first") -> TideFrame:
        """One row for each key, the first or last in the order of rows."""
        keys = self.resolve([subset] if isinstance(subset, str) else list(subset))
        self.scope.need_order()
        order = [F.col(o).desc() if keep == "last" else F.col(o).asc() for o in self.order]
        w = Window.partitionBy(*self.part, *keys).orderBy(*order)
        return self._with(self.df.withColumn(_RN, F.row_number().over(w)).where(F.col(_RN) == 1).drop(_RN))

    def sorted_unique(self, by: str, keep: str = "first") -> TideFrame:
        """Rows where by changes, of each run of equal values the first or last."""
        s = self.scope
        near = F.lag(by).over(s.ordered) if keep == "first" else F.lead(by).over(s.ordered)
        place = F.row_number().over(s.ordered) if keep == "first" else F.count(F.lit(1)).over(s.onward)
        return self._with(self.df.withColumn("__same", near.eqNullSafe(F.col(by)) & (place > 1)).where("not __same").drop("__same"))

    def take(self, index, missing: bool = False) -> TideFrame:
        """Rows by place (from the end if negative), by slice, or by a list of places; with missing, None gives an empty row."""
        s = self.scope
        s.need_order()
        if s.part:
            placed = self.df.withColumn(_RN, F.row_number().over(s.ordered) - 1).withColumn("__n", F.count(F.lit(1)).over(s.whole))
        else:
            placed = numbered(self.df, [F.col(o) if isinstance(o, str) else o for o in self.order], _RN).withColumn("__n", self.df.agg(F.count(F.lit(1))).scalar())
        if isinstance(index, slice):
            lo, hi, step = index.start, index.stop, index.step or 1
            if step < 0:  # the same rows as forward from the other end; a frame's rows stay in their order
                placed = placed.withColumn(_RN, F.col("__n") - 1 - F.col(_RN))
                lo, hi, step = None if lo is None else -1 - lo, None if hi is None else -1 - hi, -step
            edge = lambda v, default: default if v is None else F.lit(v) if v >= 0 else F.col("__n") + v
            start = F.greatest(edge(lo, F.lit(0)), F.lit(0))
            out = placed.where((F.col(_RN) >= start) & (F.col(_RN) < edge(hi, F.col("__n"))) & ((F.col(_RN) - start) % step == 0))
            return self._with(out.drop(_RN, "__n"))
        wanted = [(i, p) for i, p in enumerate([index] if isinstance(index, int) else index)]
        if not all(p is None or isinstance(p, int) for _, p in wanted):
            raise TypeError("places are integers or None")
        picks = self.df.sparkSession.createDataFrame(wanted, "__at long, __pick long")
        hit = F.when(F.col("__pick") < 0, F.col("__n") + F.col("__pick")).otherwise(F.col("__pick")) == F.col(_RN)
        out = F.broadcast(picks).join(placed, hit, "left") if missing and not self.part else placed.join(F.broadcast(picks), hit)
        return TideFrame(out.drop(_RN, "__n", "__pick"), ("__at",), self.part, normalise=False)

    # statistics over columns
    def hsum(self, *columns) -> Expr:
        return horizontal("sum", *[col(c) for c in columns or self.columns])

    def hmean(self, *columns) -> Expr:
        return horizontal("mean", *[col(c) for c in columns or self.columns])

    def hmin(self, *columns) -> Expr:
        return horizontal("min", *[col(c) for c in columns or self.columns])

    def hmax(self, *columns) -> Expr:
        return horizontal("max", *[col(c) for c in columns or self.columns])

    def hstd(self, *columns, min_periods: int = 3) -> Expr:
        e = horizontal("std", *[col(c) for c in columns or self.columns])
        return Expr(e.kind, e.args, {"min_periods": min_periods}, e.name)

    def aggregate(self, kind: str, *columns) -> DataFrame:
        """One row with an aggregate of each column."""
        names = list(columns or self.columns)
        exprs = {c: getattr(col(c), kind)() for c in names}
        df, exprs = with_quantiles(self.df, [], exprs)
        s = prepared(df, Scope((), self.order), list(exprs.values()))
        s = Scope((), self.order, "group", specs=s.specs, df=s.df, helpers=s.helpers)
        return s.df.agg(*[e.lower(s).alias(c) for c, e in exprs.items()])

    def rolling(self, window=None, time: str | None = None, offset=None, idx=None):
        """Rolling whose rows are picked by sampled lags (offset), or by places in a column idx, a start or a list of them:
        .agg(name=aggregate, ...) adds a column for each."""
        from tideframe.operators.joins import Picked

        return Picked(self, window, time, offset, idx)

    def corr(self, *columns, method: str = "pearson") -> DataFrame:
        """The correlation matrix as rows (x, y, corr): all pairs in one aggregation, each with its own valid rows."""
        names = list(columns or self.columns)
        df = self.df
        if method == "spearman":
            return self._spearman(names)
        group = Scope(mode="group")
        pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
        row = df.agg(*[safe_corr(group, F.col(a), F.col(b)).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
        cells = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"{i}").alias("corr")) for i, p in enumerate(pairs) for a, b in (p, p[::-1])]
        cells += [F.struct(F.lit(a).alias("x"), F.lit(a).alias("y"), F.lit(1.0).alias("corr")) for a in names]
        return row.select(F.inline(F.array(*cells)))

    def _spearman(self, names: list[str]) -> DataFrame:
        """Pearson correlations of ranks, from the counts of distinct pairs of values: what is ranked is one row a value."""
        out = None
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                x, y = paired(F.col(a), F.col(b))
                pairs = self.df.select(x.alias("x"), y.alias("y")).dropna().groupBy("x", "y").agg(F.count(F.lit(1)).alias("__c"))
                sides = [ranked_counts(pairs.groupBy(v).agg(F.sum("__c").alias("__c")), v, f"r{v}").select(v, f"r{v}") for v in ("x", "y")]
                c, u, w = F.col("__c"), F.col("rx"), F.col("ry")
                both = pairs.join(sides[0], "x").join(sides[1], "y").select("__c", "rx", "ry")
                # ranks average to half of n + 1
                n = F.sum("__c")
                sums = both.agg(n.alias("n"), F.sum(c * u * w).alias("uw"), F.sum(c * u * u).alias("uu"), F.sum(c * w * w).alias("ww"))
                mid = F.col("n") * ((F.col("n") + 1) / 2) ** 2
                cov, vu, vw = F.col("uw") - mid, F.col("uu") - mid, F.col("ww") - mid
                corr = F.when((vu > 0) & (vw > 0), F.try_divide(cov, F.sqrt(vu) * F.sqrt(vw)))
                one = sums.select(corr.alias("corr")).select(F.inline(F.array(*[F.struct(F.lit(p).alias("x"), F.lit(q).alias("y"), F.col("corr")) for p, q in ((a, b), (b, a))])))
                out = one if out is None else out.union(one)
        same = self.df.sparkSession.createDataFrame([(a, a, 1.0) for a in names], "x string, y string, corr double")
        return same if out is None else out.union(same)

    def groupby(self, *by, **kw):
        from tideframe.operators.groupby import Grouped

        return Grouped(self, *by, **kw)

    def join(self, right: TideFrame, **kw) -> TideFrame:
        from tideframe.operators.joins import join

        return join(self, right, **kw)
