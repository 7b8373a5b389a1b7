"""Inspectable expressions: trees of columns, literals and calls, turned into Catalyst columns by a scope.

An expression knows nothing of rows; the scope says where it stands. So the same tree is an aggregate in a group, is
taken over a frame in a rolling apply, or over the whole partition in a projection: each aggregate in it gets its window
from the scope, whatever is built around it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

import tideframe.functions.aggregates
import tideframe.functions.distributions
import tideframe.functions.ordered
import tideframe.functions.rolling
import tideframe.functions.scalar  # noqa: F401
from tideframe.functions.durations import Duration, duration
from tideframe.functions.registry import HINTS, OPS, PREPARED, Scope
from tideframe.functions.scalar import spark_pattern


class Expr:
    """A node: kind "col", "lit", "column" (a Catalyst column as it is), "values" (a value for each place in the order of rows)
    or the name of an operation."""

    def __init__(self, kind: str, args: tuple = (), kw: dict | None = None, name: str | None = None):
        self.kind, self.args, self.kw, self._name = kind, args, kw or {}, name

    def __repr__(self) -> str:
        if self.kind in ("col", "lit", "column", "values"):
            return f"{self.kind}({self.args[0]!r})"
        return f"{self.args[0]!r}.{self.kind}({', '.join([*map(repr, self.args[1:]), *[f'{k}={v!r}' for k, v in self.kw.items()]])})"

    def __getattr__(self, attr: str):
        if attr.startswith("_") or attr not in OPS:
            raise AttributeError(attr)
        return lambda *args, **kw: Expr(attr, (self, *args), {k: v for k, v in kw.items() if k not in HINTS})

    @property
    def name(self) -> str:
        if self._name:
            return self._name
        if self.kind == "col":
            return self.args[0]
        return self.args[0].name if self.args and isinstance(self.args[0], Expr) else self.kind

    def alias(self, name: str) -> Expr:
        return Expr(self.kind, self.args, self.kw, name)

    def suffix(self, text: str) -> Expr:
        return self.alias(self.name + text)

    def prefix(self, text: str) -> Expr:
        return self.alias(text + self.name)

    def rolling(self, window, **kw):
        from tideframe.operators.rolling import Rolling

        return Rolling(self, window, **kw)

    def filter(self, mask) -> Expr:
        """Where mask holds: aggregates skip the rest, and a projection of it alone drops those rows."""
        return Expr("kept", (self, asexpr(mask)))

    def dropna(self) -> Expr:
        return self.filter(self.not_nan())

    def groupby(self, *by, **kw) -> GroupedExpr:
        """Grouped by keys or time buckets as a frame is; select() of an aggregate of it gives a row for each group."""
        return GroupedExpr(self, by, kw)

    @property
    def ndim(self) -> int:
        """1: an expression is a column; its values may be arrays."""
        return 1

    def columns(self) -> set[str]:
        """Names of the columns the tree reads."""
        if self.kind == "col":
            return {self.args[0]}
        return set().union(*[a.columns() for a in (*self.args, *self.kw.values()) if isinstance(a, Expr)])

    def lower(self, scope: Scope) -> Column:
        if self.kind == "col":
            return F.col(self.args[0])
        if self.kind == "lit":
            return F.lit(self.args[0])
        if self.kind == "column":
            return self.args[0]
        if self.kind == "values":
            return F.get(F.array(*[F.lit(v) for v in self.args[0]]), F.row_number().over(scope.ordered) - 1)
        if self.kind == "rolled":
            return self.args[0].lower(scope)
        down = lambda v: v.lower(scope) if isinstance(v, Expr) else v
        args, kw = list(map(down, self.args)), {k: down(v) for k, v in self.kw.items()}
        if scope.helpers and (name := scope.helpers.get(repr(self))):
            return PREPARED[self.kind][2](scope, name, *args, **kw)
        if self.kind in ("quantile", "median") and scope.mode == "group":
            kw["levels"] = scope.specs.get("levels", {}).get(repr(self.args[0]), ())
        return OPS[self.kind](scope, *args, **kw)

    __hash__ = None

    def __bool__(self) -> bool:
        raise TypeError("an expression has no truth value; use & | ~")


def _operator(name: str, op: str) -> None:
    setattr(Expr, name, lambda self, *other: Expr(op, (self, *other)))


for _n, _o in {
    "add": "add", "radd": "radd", "sub": "sub", "rsub": "rsub", "mul": "mul", "rmul": "rmul", "truediv": "div", "rtruediv": "rdiv", "pow": "pow", "matmul": "matmul",
    "eq": "eq", "ne": "ne", "lt": "lt", "le": "le", "gt": "gt", "ge": "ge", "and": "and", "rand": "and", "or": "or", "ror": "or", "invert": "invert", "neg": "neg", "abs": "abs", "round": "round",
}.items():
    _operator(f"__{_n}__", _o)


def col(name: str) -> Expr:
    return Expr("col", (name,))


def lit(value) -> Expr:
    return Expr("lit", (value,))


def asexpr(value) -> Expr:
    """An expression of an expression, a Catalyst column, a scalar, or a list, array or series with a value for each row."""
    if isinstance(value, Expr):
        return value
    if isinstance(value, Column):
        return Expr("column", (value,))
    if hasattr(value, "tolist") and getattr(value, "ndim", 0) == 1:
        name = getattr(value, "name", None)
        return Expr("values", (tuple(None if v != v else v for v in value.tolist()),), name=name if isinstance(name, str) else None)
    if isinstance(value, (list, tuple)):
        return Expr("values", (tuple(value),))
    return lit(value)


def asexprs(values) -> list[Expr]:
    """Expressions of a list of what asexpr() takes, or of the columns of a frame."""
    return [col(c) for c in values.columns] if hasattr(values, "columns") and not isinstance(values, Expr) else [asexpr(v) for v in values]


def datetime(text: str, fmt: str | None = None) -> Expr:
    """A literal time without a zone; fmt as strptime takes it, ISO 8601 by default."""
    return Expr("column", (F.to_timestamp_ntz(F.lit(text), F.lit(spark_pattern(fmt))) if fmt else F.to_timestamp_ntz(F.lit(text)),), name="datetime")


class GroupedExpr:
    """expr.groupby(...): its aggregates, and agg() of expressions, are expressions that select() of a frame runs by group."""

    def __init__(self, expr: Expr, by: tuple, kw: dict):
        self.expr, self.by, self.kw = expr, by, kw

    def __getattr__(self, kind: str):
        if kind.startswith("_") or kind not in OPS:
            raise AttributeError(kind)
        return lambda *args, **kw: self.agg(Expr(kind, (self.expr, *args), kw))

    def agg(self, agg):
        """A grouped expression of an aggregate, or a list of them."""
        if isinstance(agg, (list, tuple)):
            return [self.agg(a) for a in agg]
        return Expr("grouped", (agg,), {"by": self.by, "how": self.kw}, agg.name)


def where(mask: Expr, x, other) -> Expr:
    return asexpr(x).where_(mask, other)


def timedelta(text: str) -> Duration:
    return duration(text)


def register(fn):
    """Make fn(expr, ...) -> expr a method of expressions, under its own name."""
    setattr(Expr, fn.__name__, fn)
    return fn


def horizontal(kind: str, *exprs) -> Expr:
    """Across columns in a row, skipping missing values: sum, mean, std, min, max or count."""
    first, *rest = [asexpr(e) for e in exprs]
    return Expr(f"array_{kind}", (Expr("stack", (first, *rest)),), name=kind)
