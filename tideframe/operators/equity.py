"""Position to equity: a ledger that walks each symbol's bars in order.

The state of a bar is (cash, position, lots, close) of the one before, so a symbol is walked row by row; symbols run in
parallel, each in an Arrow-backed grouped function.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def walk(pos, opening, closing, roll, spread, cash: float, multiplier: float, leverage: float, ticksize: float, slippage: float, c_rate: float, blowup: bool, fixed: bool) -> np.ndarray:
    """Equity after each bar.

    At the open the held lots earn the move since the last close, unless the contract rolls, in which case the gap is not
    earned. A changed position is then traded at the open: lots are the whole number of contracts that cash times
    leverage times the position pays for (rounded down, so an account below zero holds against its position). A roll pays for
    the new lots twice, out of the old contract and into the new. Costs are a rate on the amount traded, or a
    fixed sum a lot (fixed), and slippage. The lots then earn the move from open to close. With blowup, an account that
    falls to zero stays there.
    """
    out = np.empty(len(pos))
    last_pos = last_lots = 0.0
    last_close = math.nan
    for i in range(len(pos)):
        p, o, c = pos[i], opening[i], closing[i]
        if blowup and cash <= 0:
            out[i] = cash = 0.0
            continue
        if math.isnan(p) or math.isnan(o) or math.isnan(c):
            out[i] = cash
            continue
        rolled = bool(roll[i])
        if last_lots and not rolled and not math.isnan(last_close):
            cash += last_lots * (o - last_close) * multiplier
        if p != last_pos or rolled:
            lots = math.floor(cash * leverage * abs(p) / (multiplier * o)) * math.copysign(1.0, p) if p else 0.0
            traded = 2 * abs(lots) if rolled else abs(lots - last_lots)
            slip = traded * (slippage * ticksize + spread[i]) * multiplier
            cash -= (traded * c_rate if fixed else traded * multiplier * o * c_rate) + slip
            last_pos, last_lots = p, lots
        cash += last_lots * (c - o) * multiplier
        last_close = c
        out[i] = cash
    return out


def backtest(df: DataFrame, by: list[str], order: list[str], pos: str, opening: str, closing: str, roll: str | None = None, spread: str | None = None, init_cash: float = 1e6, multiplier: float = 1.0, leverage: float = 1.0, slippage: float = 0.0, ticksize: float = 0.0, c_rate: float = 3e-4, blowup: bool = False, commission_type: str = "percent") -> DataFrame:
    """(by, order, equity) of every bar; spread is half a quoted spread a row, in price."""
    if commission_type not in ("percent", "absolute"):
        raise ValueError(f"no such commission: {commission_type}")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    keep = [*by, *order]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order, kind="stable")
        zero = np.zeros(len(g))
        arr = lambda c: g[c].to_numpy(float) if c else zero
        g["equity"] = walk(arr(pos), arr(opening), arr(closing), np.nan_to_num(arr(roll)), arr(spread), init_cash, multiplier, leverage, ticksize, slippage, c_rate, blowup, commission_type == "absolute")
        return g[[*keep, "equity"]]

    cols = list(dict.fromkeys([*keep, pos, opening, closing, *[c for c in (roll, spread) if c]]))
    return df.select(*cols).groupBy(*by).applyInPandas(run, ", ".join([f"{k} {kinds[k]}" for k in keep] + ["equity double"]))
