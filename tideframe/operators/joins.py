"""Joins that keep rows, joins on distinct keys, as-of lookups, and alignment of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideframe.functions.aggregates import linear_quantile
from tideframe.functions.durations import duration
from tideframe.functions.registry import Scope
from tideframe.operators.ranges import numbered
from tideframe.plans.expr import Expr, asexpr, col
from tideframe.plans.prepare import linear_level, nodes, prepared, swapped


def _same(left: DataFrame, right: DataFrame, pairs) -> Column:
    cond = None
    for a, b in pairs:
        c = left[a].eqNullSafe(right[b])
        cond = c if cond is None else cond & c
    return cond


def _names(on, left_on, right_on) -> list[tuple[str, str]]:
    one = lambda x: [x] if isinstance(x, str) else list(x)
    return [(k, k) for k in one(on)] if on is not None else list(zip(one(left_on), one(right_on), strict=True))


def left_join(left, right, pairs, unique: bool = False, suffix: str = "_right"):
    """Each left row once. Of several right rows with its key, the first left row gets the last, the next the one before
    it, and so on; the first right row serves all further ones. unique: right keys are known not to repeat."""
    keys = [b for _, b in pairs]
    take = {c: c + suffix if c in left.columns else c for c in right.columns if c not in keys}
    r = right.df.select(*[F.col(b).alias(f"__k{i}") for i, b in enumerate(keys)], *[F.col(c).alias(n) for c, n in take.items()], *[F.col(o).alias(f"__o{i}") for i, o in enumerate(right.order)])
    links = [(a, f"__k{i}") for i, (a, _) in enumerate(pairs)]
    if unique:
        out = left.df.join(r, _same(left.df, r, links), "left")
    else:
        left.scope.need_order()
        right.scope.need_order()
        rk = [f"__k{i}" for i in range(len(keys))]
        r = r.withColumn("__rr", F.row_number().over(Window.partitionBy(*rk).orderBy(*[F.col(f"__o{i}").desc() for i in range(len(right.order))])))
        r = r.withColumn("__c", F.count(F.lit(1)).over(Window.partitionBy(*rk)))
        n = r.where("__rr = 1").select(*[F.col(k).alias(f"__n{i}") for i, k in enumerate(rk)], F.col("__c").alias("__m"))
        turn = F.row_number().over(Window.partitionBy(*[a for a, _ in pairs]).orderBy(*left.order))
        l = left.df.withColumn("__rn", turn)
        l = l.join(n, _same(l, n, [(a, f"__n{i}") for i, (a, _) in enumerate(pairs)]), "left").withColumn("__turn", F.least("__rn", "__m"))
        out = l.join(r.drop("__c"), _same(l, r, links) & (l["__turn"] == r["__rr"]), "left")
    return left._with(out.select(*left.columns, *take.values()))


def outer_join(left, right, pairs, sort: bool = True, rev: bool = False, suffix: str = "_right"):
    """One row for each key of either side: the first left row and the last right row of the key, keys merged."""
    l = left.unique([a for a, _ in pairs], "first").df
    r = right.unique([b for _, b in pairs], "last").df
    keys = [b for _, b in pairs]
    take = {c: c + suffix if c in left.columns else c for c in right.columns if c not in keys}
    r = r.select(*[F.col(b).alias(f"__k{i}") for i, b in enumerate(keys)], *[F.col(c).alias(n) for c, n in take.items()])
    out = l.join(r, _same(l, r, [(a, f"__k{i}") for i, (a, _) in enumerate(pairs)]), "full")
    own = [a for a, _ in pairs]
    out = out.select(*[F.coalesce(F.col(a), F.col(f"__k{i}")).alias(a) for i, a in enumerate(own)], *[c for c in left.columns if c not in own], *take.values())
    if sort:
        out = out.orderBy(*[F.col(a).desc_nulls_last() if rev else F.col(a).asc_nulls_last() for a in own])
    return left._with(out, order=tuple(own))


def join(left, right, on=None, left_on=None, right_on=None, how: str = "left", unique: bool = False, sort: bool = True, rev: bool = False, suffix: str = "_right"):
    pairs = _names(on, left_on, right_on)
    if how == "left":
        return left_join(left, right, pairs, unique, suffix)
    if how == "right":
        return left_join(right, left, [(b, a) for a, b in pairs], unique, suffix)
    if how == "outer":
        return outer_join(left, right, pairs, sort, rev, suffix)
    if how in ("inner", "semi", "anti"):
        keys = [b for _, b in pairs]
        take = {c: c + suffix if c in left.columns else c for c in right.columns if c not in keys} if how == "inner" else {}
        r = right.df.select(*[F.col(b).alias(f"__k{i}") for i, b in enumerate(keys)], *[F.col(c).alias(n) for c, n in take.items()])
        cond = None
        for i, (a, _) in enumerate(pairs):
            c = left.df[a] == r[f"__k{i}"]
            cond = c if cond is None else cond & c
        out = left.df.join(r, cond, {"inner": "inner", "semi": "left_semi", "anti": "left_anti"}[how])
        return left._with(out.select(*left.columns, *take.values()))
    raise ValueError(f"no such join: {how}")


def asof_join(left, right, time: str, values: list[str]):
    """Each left row with the latest right values at or before its time, within the partition: one union and one window."""
    part = list(left.part)
    l = left.df.select("*", F.lit(1).alias("__side"), *[F.lit(None).cast(right.df.schema[v].dataType).alias(f"__{v}") for v in values])
    r = right.df.select(*part, time, F.lit(0).alias("__side"), *[F.col(v).alias(f"__{v}") for v in values])
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*part).orderBy(time, "__side", *left.order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.select("*", *[F.last(f"__{v}", ignorenulls=True).over(w).alias(f"{v}_asof") for v in values]).where("__side = 1")
    return left._with(out.select(*left.columns, *[f"{v}_asof" for v in values]))


class Picked:
    """frame.rolling(window, time=, offset=) or frame.rolling(idx=): each row aggregates rows that an equi-join picks.

    With offset, the rows of its partition whose times lie k offsets before it, k = 0 to window over offset; of rows of
    one time the first counts. With idx, the rows at places of the partition: a column of starts takes all from there to
    the row itself (see _since), a column of arrays those at its places (no place, missing and out-of-range ones pick nothing).
    """

    def __init__(self, frame, window=None, time: str | None = None, offset=None, idx: str | None = None):
        if (idx is None) == (window is None) or (idx is None and (time is None or offset is None)):
            raise ValueError("give a window with time and offset, or idx")
        self.frame, self.window, self.time, self.offset, self.idx = frame, window, time, offset, idx

    def _lagged(self):
        """(rows with the picked time in __at, rows to pick from by __t)"""
        w, by = duration(self.window), duration(self.offset)
        if w.months or by.months or by.micros <= 0:
            raise ValueError("sampled lags take exact durations")
        left = self.frame.df.select("*", F.explode(F.sequence(F.lit(0), F.lit(w.micros // by.micros))).alias("__k"))
        picked = self.frame.unique([*self.frame.part, self.time], "first").df
        return left.withColumn("__at", F.col(self.time) - by.interval * F.col("__k")).drop("__k"), picked.withColumn("__t", F.col(self.time))

    def _starts(self) -> bool:
        return self.idx is not None and self.frame.df.schema[self.idx].dataType.typeName() != "array"

    def _placed(self):
        placed = self.frame.df.withColumn("__t", F.row_number().over(self.frame.scope.ordered) - 1)
        here = F.greatest(F.col(self.idx), F.lit(0)).cast("long")
        picks = F.when(here <= F.col("__t"), F.sequence(here, F.col("__t").cast("long"))) if self._starts() else F.col(self.idx).cast("array<long>")
        return placed.withColumn("__at", F.explode_outer(picks)).drop("__t"), placed

    def _since(self, wanted: dict[str, Expr]):
        """agg from starts, inside partitions: only the frame's rows are dealt, each partition to one task, where the pairs
        of a row and what it picks come in the order of rows and are aggregated as they come, so none is kept.

        Linear quantiles would keep the pairs; they are read from the sorted slice of the partition's values.
        """
        frame = self.frame
        part = F.struct(*[F.col(p) for p in frame.part])  # one key, equal where values are missing too
        rows = frame.df.withColumn("__part", part)
        window = Window.partitionBy("__part").orderBy(*frame.order)
        rows = rows.withColumn("__t", (F.row_number().over(window) - 1).cast("long"))
        own = {c: f"__l{i}" for i, c in enumerate(frame.columns)}
        left = rows.withColumn("__from", F.greatest(F.col(self.idx), F.lit(0)).cast("long"))
        taken, slices = {}, {}
        for node in (n for e in wanted.values() for n in nodes(e)):
            if linear_level(node) is not None and repr(node) not in taken:
                values = slices.setdefault(repr(node.args[0]), (f"__s{len(slices)}", node.args[0]))[0]
                taken[repr(node)] = (f"__q{len(taken)}", values, linear_level(node))
        whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        for name, x in slices.values():
            missing = F.lit(float("nan"))  # sorts last
            left = left.withColumn(name, F.collect_list(F.coalesce(x.lower(frame.scope).cast("double"), missing)).over(whole))
            left = left.withColumn(name, F.sort_array(F.slice(name, (F.col("__from") + 1).cast("int"), F.greatest(F.col("__t") - F.col("__from") + 1, F.lit(0)).cast("int"))))
            left = left.withColumn(f"{name}_n", F.coalesce(F.nullif(F.array_position(name, missing), F.lit(0)) - 1, F.size(name)))
        near = lambda s, q, to: F.get(s, to((F.col(f"{s}_n") - 1) * F.lit(q)).cast("int"))
        left = left.withColumns({name: linear_quantile(near(s, q, F.floor), near(s, q, F.ceil), F.col(f"{s}_n"), q) for name, s, q in taken.values()})
        keys = ["__lpart", *[own[o] for o in frame.order]]
        left = left.select(F.col("__part").alias("__lpart"), *[F.col(c).alias(n) for c, n in own.items()], "__from", F.col("__t").alias("__to"), *[name for name, _, _ in taken.values()])
        right = rows.withColumn("__o", F.struct(*frame.order)).hint("shuffle_hash")
        cond = (left["__lpart"] == right["__part"]) & (right["__t"] >= left["__from"]) & (right["__t"] <= left["__to"])
        wanted = {n: swapped(e, {text: Expr("column", (F.first(name),)) for text, (name, _, _) in taken.items()}) for n, e in wanted.items()}
        scope = prepared(left.join(right, cond, "left"), Scope(tuple(F.col(k) for k in keys), (F.col("__o"),), "group"), list(wanted.values()))
        # a struct in the aggregation makes it go by the order that the rows have
        out = scope.df.groupBy(*keys).agg(F.first(F.struct(*own.values())).alias("__own"), *[e.lower(scope).alias(n) for n, e in wanted.items()])
        return frame._with(out.select(*[F.col(f"__own.{n}").alias(c) for c, n in own.items() if c not in wanted], *wanted))

    def agg(self, **named):
        """The frame with a column for each aggregate of what its rows pick."""
        frame = self.frame
        frame.scope.need_order()
        if frame.part and self._starts():
            return self._since({n: asexpr(e) for n, e in named.items()})
        left, right = self._lagged() if self.idx is None else self._placed()
        own = {c: f"__l{i}" for i, c in enumerate(frame.columns)}
        left = left.select(*[F.col(c).alias(n) for c, n in own.items()], "__at")
        cond = left["__at"] == right["__t"]
        for p in frame.part:
            cond = cond & left[own[p]].eqNullSafe(right[p])
        # a row is known by its partition and order; the other columns go along with the aggregation
        keys = list(dict.fromkeys([*frame.part, *frame.order]))
        rest = [c for c in frame.columns if c not in keys]
        # what no row was picked for has no place in the order, so that it is neither first nor last
        joined = left.join(right.withColumn("__o", F.struct(*frame.order)), cond, "left")
        wanted = {n: e if isinstance(e, Expr) else asexpr(e) for n, e in named.items()}
        scope = prepared(joined, Scope(tuple(F.col(own[k]) for k in keys), (F.col("__o"),), "group"), list(wanted.values()))
        out = scope.df.groupBy(*[own[k] for k in keys]).agg(*[F.first(own[c]).alias(own[c]) for c in rest], *[e.lower(scope).alias(n) for n, e in wanted.items()])
        return frame._with(out.select(*[F.col(n).alias(c) for c, n in own.items() if c not in wanted], *wanted))


def rolling_offset(frame, value: str, time: str, window: str, step: str, name: str = "sum"):
    """frame with the sum of value over sampled lags."""
    return Picked(frame, window, time, step).agg(**{name: col(value).sum()})


def _keys_and_rows(frames, by: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """All keys of any frame, and each frame's row of a key: the first of the first frame, the last of the others."""
    keys = None
    for f in frames:
        own = f.df.select(*[F.col(b).alias(f"__k{i}") for i, b in enumerate(by)]).distinct()
        keys = own if keys is None else keys.union(own)
    rows = [f.unique(by, "last" if i else "first").df for i, f in enumerate(frames)]
    return keys.distinct(), rows


def _aligned(keys: DataFrame, rows: DataFrame, by: list[str], take: dict[str, str]) -> DataFrame:
    """keys with the columns take (name -> new name) of rows, whose keys are in by."""
    r = rows.select(*[F.col(b).alias(f"__r{i}") for i, b in enumerate(by)], *[F.col(c).alias(n) for c, n in take.items()])
    cond = None
    for i in range(len(by)):
        c = keys[f"__k{i}"].eqNullSafe(r[f"__r{i}"])
        cond = c if cond is None else cond & c
    return keys.join(r, cond, "left").drop(*[f"__r{i}" for i in range(len(by))])


def align_frames(frames, by, sort: bool = True, rev: bool = False, outer_df: bool = False, with_by: bool = True):
    """The frames on one index, as outer joins one after the other leave them: all keys of any, for each the first row of
    the first frame and the last of every other, missing where a frame has none.

    outer_df: one frame, the columns of frame i named with the suffix __align_by{i}. Without with_by the keys are left out
    (and returned first, as a frame, beside a list of frames).
    """
    frames, by = list(frames), [by] if isinstance(by, str) else list(by)
    if len(frames) < 2:
        return frames
    keys, rows = _keys_and_rows(frames, by)

    def shown(df: DataFrame, f, columns: list[str], keep: bool = with_by):
        if sort:
            df = df.orderBy(*[F.col(f"__k{i}").desc_nulls_last() if rev else F.col(f"__k{i}").asc_nulls_last() for i in range(len(by))])
        names = [F.col(f"__k{i}").alias(b) for i, b in enumerate(by)] if keep else []
        return f._with(df.select(*names, *columns), order=tuple(by) if keep else (), part=())

    if outer_df:
        out, columns = keys, []
        for i, (f, r) in enumerate(zip(frames, rows, strict=True)):
            take = {c: f"{c}__align_by{i}" for c in f.columns if c not in by}
            out, columns = _aligned(out, r, by, take), [*columns, *take.values()]
        return shown(out, frames[0], columns)
    each = [shown(_aligned(keys, r, by, {c: c for c in f.columns if c not in by}), f, [c for c in f.columns if c not in by]) for f, r in zip(frames, rows, strict=True)]
    return each if with_by else (shown(keys, frames[0], [], keep=True), each)


def get_align_frames_idx(frames, by, sort: bool = True, rev: bool = False, return_by: bool = False):
    """A frame with a column idx{i} for each frame: the place in it, from 0, of the row that align_frames takes for a key,
    missing where it has none; with return_by, the keys too. Rows are in the order of align_frames."""
    frames, by = list(frames), [by] if isinstance(by, str) else list(by)
    if len(frames) < 2:
        return frames
    placed = [f._with(numbered(f.df, [F.col(o) for o in f.order], f"idx{i}").select(*by, *[o for o in f.order if o not in by], f"idx{i}"), part=()) for i, f in enumerate(frames)]
    keys, rows = _keys_and_rows(placed, by)
    out = keys
    for i, r in enumerate(rows):
        out = _aligned(out, r, by, {f"idx{i}": f"idx{i}"})
    if sort:
        out = out.orderBy(*[F.col(f"__k{i}").desc_nulls_last() if rev else F.col(f"__k{i}").asc_nulls_last() for i in range(len(by))])
    names = [F.col(f"__k{i}").alias(b) for i, b in enumerate(by)] if return_by else []
    return frames[0]._with(out.select(*names, *[f"idx{i}" for i in range(len(frames))]), order=tuple(by) if return_by else (), part=())
