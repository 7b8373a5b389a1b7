"""Operations of the expression layer: name -> how it becomes a Catalyst column in a scope."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPS: dict = {}
#: Operations that need columns of their own before they are lowered: name -> (applies(scope, kw), prepare, finish).
PREPARED: dict = {}
#: Execution hints that other array libraries take; Spark decides these itself.
HINTS = {"axis", "par", "stable", "inplace", "freeze", "check", "_warning"}


def op(*names: str):
    def put(fn):
        for n in names:
            OPS[n] = fn
        return fn

    return put


@dataclass(frozen=True)
class Scope:
    """Where an expression stands: its partition and order, and how an aggregate in it is taken.

    mode "rows": over the whole partition; "frame": over the given window; "group": inside groupBy().agg().
    Window specs are made once for each scope, so that operations over one frame share a single Window node. df is the
    frame's DataFrame, base the same without helpers: without a partition, an aggregate over all of it is a scalar subquery, not a window in one task.
    helpers names the columns that PREPARED operations have added, by the operation's text.
    """

    part: tuple = ()
    order: tuple = ()
    mode: str = "rows"
    frame: WindowSpec | None = None
    specs: dict = field(default_factory=dict, compare=False)
    df: DataFrame | None = field(default=None, compare=False)
    base: DataFrame | None = field(default=None, compare=False)
    helpers: dict = field(default_factory=dict, compare=False)

    def _base(self) -> WindowSpec:
        return Window.partitionBy(*self.part)

    def _spec(self, key, make):
        if key not in self.specs:
            self.specs[key] = make()
        return self.specs[key]

    def need_order(self) -> None:
        if not self.order:
            raise ValueError("this operation depends on the order of rows: give the frame an order")

    @property
    def whole(self) -> WindowSpec:
        return self._spec("whole", self._base)

    @property
    def ordered(self) -> WindowSpec:
        self.need_order()
        if not self.part:
            warnings.warn("an ordered window without a partition runs in one task: give the frame a partition", stacklevel=3)
        return self._spec("ordered", lambda: self._base().orderBy(*self.order))

    @property
    def upto(self) -> WindowSpec:
        return self._spec("upto", lambda: self.ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))

    @property
    def onward(self) -> WindowSpec:
        return self._spec("onward", lambda: self.ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing))

    def trailing(self, n: int) -> WindowSpec:
        if n < 1:
            raise ValueError("a window has one row at least")
        return self._spec(("trailing", n), lambda: self.ordered.rowsBetween(-(n - 1), Window.currentRow))

    def by(self, *order: Column, within: tuple = ()) -> WindowSpec:
        return Window.partitionBy(*self.part, *within).orderBy(*order)

    def agg(self, c: Column) -> Column:
        if self.mode == "group":
            return c
        if self.mode == "rows" and not self.part and self.df is not None:
            try:
                return (self.base or self.df).agg(c).scalar()
            except AnalysisException:  # of a helper's column
                return self.df.agg(c).scalar()
        return c.over(self.frame if self.mode == "frame" else self.whole)

    @property
    def key(self) -> Column:
        """The order as one comparable value; a single column that is given as one is that value, and may be missing."""
        self.need_order()
        if len(self.order) == 1 and isinstance(self.order[0], Column):
            return self.order[0]
        return F.struct(*[F.col(o) if isinstance(o, str) else o for o in self.order])

    def kind(self, c: Column) -> T.DataType | None:
        """The type of a column, where the frame is known."""
        return None if self.df is None else self.df.select(c).schema[0].dataType
