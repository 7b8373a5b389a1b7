"""Columns that some operations need beside their own before they can be lowered.

Inside groupBy().agg() no window can stand, so places and ranks within a group are columns of the frame first; they are
dealt by the group's keys, so the aggregation needs no second shuffle. Over a frame without a partition, ranks and places
come from ranges of values, as a window would put all rows in one task.
"""

from __future__ import annotations

from dataclasses import replace
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.functions import aggregates, ordered
from tideframe.functions.registry import PREPARED, Scope
from tideframe.operators.ranges import distributed_rank, located_quantiles, numbered


def _alone(s: Scope) -> bool:
    return s.mode == "rows" and not s.part


def _in_group(s: Scope) -> Scope:
    """The same partition, with windows over it."""
    return Scope(s.part, s.order, "rows")


def _placed(df: DataFrame, base: DataFrame, s: Scope, args: list, name: str) -> DataFrame:
    s.need_order()
    if s.part:
        return df.withColumn(name, (F.row_number().over(_in_group(s).ordered) - 1).cast("long"))
    return numbered(df, [F.col(o) if isinstance(o, str) else o for o in s.order], name, base)


def _rank_of(df: DataFrame, base: DataFrame, s: Scope, x: Column, name: str, rev: bool = False) -> DataFrame:
    if s.part:
        return df.withColumn(name, aggregates.average_rank(_in_group(s), x, rev))
    return distributed_rank(df.withColumn("__x", x), "__x", name, rev, base.select(x.alias("__x"))).drop("__x")


def _ranked(df: DataFrame, base: DataFrame, s: Scope, args: list, name: str, rev: bool = False, **kw) -> DataFrame:
    return _rank_of(df, base, s, args[0], name, rev)


def _both_ranked(df: DataFrame, base: DataFrame, s: Scope, args: list, name: str, **kw) -> DataFrame:
    x, y = aggregates.paired(*args[:2])
    return _rank_of(_rank_of(df, base, s, x, name), base, s, y, name + "_y")


def _sorted(df: DataFrame, base: DataFrame, s: Scope, args: list, name: str, rev: bool = False) -> DataFrame:
    s.need_order()
    x = -args[0].cast("double") if rev else args[0]
    return numbered(df, [x, *[F.col(o) if isinstance(o, str) else o for o in s.order]], name, base)


def _counted(df: DataFrame, base: DataFrame, s: Scope, args: list, name: str, *_, **kw) -> DataFrame:
    x = args[0]
    if s.part:
        w = _in_group(s)
        return df.withColumn(name, F.row_number().over(w.by(x.asc_nulls_last()))).withColumn(name + "_n", F.count(x).over(w.whole))
    return numbered(df, [x], name, base).withColumn(name, F.col(name) + 1).withColumn(name + "_n", base.agg(F.count(x)).scalar())


def _method(args: tuple, kw: dict) -> str:
    return kw.get("method") or (args[2] if len(args) > 2 else "linear")


def _corr_method(args: tuple, kw: dict) -> str:
    return kw.get("method") or (args[2] if len(args) > 2 else "pearson")


# finish(scope, name of the prepared column, lowered arguments)
PREPARED["argmin"] = (lambda s, a, k: s.mode == "group" or _alone(s), _placed, lambda s, name, x: aggregates.least_at(s, x, F.col(name)))
PREPARED["argmax"] = (lambda s, a, k: s.mode == "group" or _alone(s), _placed, lambda s, name, x: aggregates.most_at(s, x, F.col(name)))
PREPARED["rank"] = (lambda s, a, k: _alone(s), _ranked, lambda s, name, x, pct=False, rev=False: ordered.ranked(s, x, F.col(name), pct))
PREPARED["split_group"] = (lambda s, a, k: _alone(s), _ranked, lambda s, name, x, group=10, rev=False: ordered.grouped(s, x, F.col(name), group))
PREPARED["argsort"] = (lambda s, a, k: _alone(s), _sorted, lambda s, name, x, rev=False: F.col(name))
PREPARED["corr"] = (
    lambda s, a, k: _corr_method(a, k) == "spearman" and (s.mode == "group" or _alone(s)),
    _both_ranked,
    lambda s, name, x, y, method="spearman", min_periods=3: aggregates.safe_corr(s, F.col(name), F.col(name + "_y"), min_periods),
)
PREPARED["quantile"] = (
    lambda s, a, k: _method(a, k) != "linear" and (s.mode == "group" or _alone(s)),
    _counted,
    lambda s, name, x, q, method="linear", levels=(): aggregates.placed_quantile(s, x, F.col(name), F.col(name + "_n"), q, method),
)


def nodes(e):
    """All expressions inside e, itself too; what a rolling window aggregates is not among them."""
    from tideframe.plans.expr import Expr

    yield e
    if e.kind != "rolled":
        for a in (*e.args, *e.kw.values()):
            if isinstance(a, Expr):
                yield from nodes(a)


def ranged(e) -> bool:
    """Whether e is rolled by time, which takes a sorted window for each kind of frame."""
    return e.kind == "rolled" and e.args[0].rolling.time is not None


def linear_level(e) -> float | None:
    """The level of a linear quantile; None for other expressions."""
    if e.kind not in ("quantile", "median") or _method(e.args, e.kw) != "linear":
        return None
    return 0.5 if e.kind == "median" else float(e.kw.get("q", e.args[1] if len(e.args) > 1 else 0.5))


def swapped(e, by: dict):
    """e with the expressions by[text] for what has that text."""
    from tideframe.plans.expr import Expr

    if not isinstance(e, Expr) or e.kind in ("col", "lit", "column", "values", "rolled"):
        return e
    if repr(e) in by:
        return by[repr(e)]
    return Expr(e.kind, tuple(swapped(a, by) for a in e.args), {k: swapped(a, by) for k, a in e.kw.items()}, e._name)


def with_quantiles(df: DataFrame, keys: list[str], wanted: dict) -> tuple[DataFrame, dict]:
    """df with the linear quantiles of its large groups as columns, and the expressions with these in their stead."""
    from tideframe.plans.expr import Expr

    asked: dict[str, dict] = {}
    for node in (n for e in wanted.values() for n in nodes(e)):
        if linear_level(node) is not None:
            asked.setdefault(repr(node.args[0]), {})[repr(node)] = node
    by, out = {}, df
    for j, some in enumerate(asked.values()):
        levels = sorted({linear_level(n) for n in some.values()})
        found = located_quantiles(df, keys, next(iter(some.values())).args[0].lower(Scope(mode="group")), levels)
        if found is None:
            continue
        found = found.toDF(*[f"__j{j}{c}" for c in found.columns])
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & out[k].eqNullSafe(found[f"__j{j}__k{i}"])
        out = out.join(found, same, "left")
        by |= {text: Expr("column", (F.first(f"__j{j}__q{levels.index(linear_level(n))}"),)) for text, n in some.items()}
    return out, {n: swapped(e, by).alias(e.name) for n, e in wanted.items()} if by else wanted


def prepared(df: DataFrame, s: Scope, exprs: list) -> Scope:
    """The scope in which exprs can be lowered over its df, which has what they need beside the columns of df."""
    s = replace(s, df=df, base=df, helpers={})
    base = df  # its rows are those of the frame however many columns come to it
    levels: dict[str, set] = {}
    for e in exprs:
        for node in nodes(e):
            if (level := linear_level(node)) is not None:
                levels.setdefault(repr(node.args[0]), set()).add(level)
            text = repr(node)
            if node.kind in PREPARED and text not in s.helpers and PREPARED[node.kind][0](s, node.args, node.kw):
                name = f"__{node.kind}_{crc32(text.encode()):08x}"
                args = [a.lower(s) if hasattr(a, "lower") and hasattr(a, "kind") else a for a in node.args]
                kw = {k: v for k, v in node.kw.items() if k in ("rev",)}
                inner = any(repr(n) in s.helpers for a in node.args if isinstance(a, type(node)) for n in nodes(a))
                s = replace(s, df=PREPARED[node.kind][1](s.df, s.df if inner else base, s, args, name, **kw))
                s.helpers[text] = name
    s.specs["levels"] = {x: tuple(sorted(v)) for x, v in levels.items()}
    return s
