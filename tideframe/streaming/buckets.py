"""Streams: time buckets with a watermark, and an exponentially weighted mean kept as state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.functions.durations import duration
from tideframe.functions.registry import Scope
from tideframe.plans.expr import Expr


def bucket_stream(stream: DataFrame, time: str, every: str, aggs: dict[str, Expr], late: str = "1h", by: tuple = (), order: tuple = ()) -> DataFrame:
    """The aggregates of a grouped frame over a stream's time buckets; rows later than late behind the newest are dropped."""
    d = duration(every)
    if d.months:
        raise ValueError("a stream's buckets are of exact time")
    window = F.window(time, f"{d.micros} microseconds")
    scope = Scope((), order, "group")
    marked = stream.withWatermark(time, f"{duration(late).micros} microseconds")
    out = marked.groupBy(window.alias("w"), *by).agg(*[e.lower(scope).alias(n) for n, e in aggs.items()])
    return out.select(F.col("w.start").alias(time), *by, *aggs)


def ewm_stream(stream: DataFrame, key: str, order: str, value: str, window: int) -> DataFrame:
    """(key, order, ewm) of every row of a stream whose rows come in order for each key: the state is two numbers a key."""
    keep = 1.0 - 2.0 / window
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}

    def run(k, frames, state):
        top, weight = state.get if state.exists else (0.0, 0.0)
        for f in frames:
            f, out = f.sort_values(order), []
            for v in f[value]:
                if v == v:
                    top, weight = top * keep + v, weight * keep + 1.0
                out.append(top / weight if weight else None)
            yield pd.DataFrame({key: k[0], order: f[order], "ewm": pd.Series(out, index=f.index, dtype="float64")})
        state.update((top, weight))

    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, ewm double"
    return stream.groupBy(key).applyInPandasWithState(run, schema, "top double, weight double", "append", "NoTimeout")
