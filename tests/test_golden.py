"""Worked examples and properties of the frame, the joins, rolling, regressions and the ledger."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideframe.functions import distributions as dist
from tideframe.functions.durations import duration
from tideframe.operators import equity, joins, linalg
from tideframe.operators.frame import TideFrame, distributed_rank
from tideframe.plans.expr import Expr, col, lit, register, timedelta, where
from tideframe.sources import io
from tideframe.streaming import buckets

nan = math.nan


def values(frame, name, order=None):
    df = frame.df.orderBy(*(order or frame.order))
    return [r[0] for r in df.select(name).collect()]


def close(a, b, tol=1e-6):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        if y is None or (isinstance(y, float) and math.isnan(y)):
            assert x is None
        else:
            assert x == pytest.approx(y, rel=tol, abs=tol)


TS = pd.date_range("2020-01-01 04:00", "2020-01-05 00:00", freq="4h")
V = [5, 5, 9, 5, 8, 8, 2, 7, 3, 3, 8, 6, 4, 7, 8, 3, 1, 5, 3, 4, 4, 7, 9, 3]


@pytest.fixture(scope="module")
def times(spark):
    return io.frame(spark, {"ts": TS, "v": [float(x) for x in V]})


def test_rolling_by_duration(spark, times):
    full = [5, 5, 5, 5, 5, 5, 2, 2, 2, 3, 3, 3, 4, 4, 4, 3, 1, 1, 1, 3, 3, 4, 4, 3]
    for unique in (True, False):
        close(values(times.with_columns(r=col("v").rolling("12h", time="ts", unique_times=unique).min()), "r"), full)
    start = [5, 5, 9, 5, 5, 8, 2, 2, 3, 3, 3, 6, 4, 4, 8, 3, 1, 5, 3, 3, 4, 4, 4, 3]
    close(values(times.with_columns(r=col("v").rolling("12h", time="ts", start_by="duration_start").min()), "r"), start)


def test_rolling_by_month(spark):
    v = [1.0, 9, 3, 1, 5, 4, 3, 8, 1, 1, 5, 2, 6, 8, 7, 9]
    f = io.frame(spark, {"ts": pd.date_range("2020-01-01", periods=16, freq="8D"), "v": v})
    close(values(f.with_columns(r=col("v").rolling("1mo", time="ts").min()), "r"), [1, 1, 1, 1, 1, 1, 1, 3, 1, 1, 1, 1, 1, 2, 2, 6])
    close(values(f.with_columns(r=col("v").rolling("1mo", time="ts", start_by="duration_start").max()), "r"), [1, 9, 9, 9, 5, 5, 5, 8, 1, 1, 5, 5, 6, 8, 8, 9])


def test_rolling_sampled_lags(spark):
    ts = pd.date_range("2020-01-01 04:00", "2020-01-03", freq="4h").append(pd.date_range("2020-01-05 08:00", "2020-01-07", freq="4h"))
    v = [5, 5, 9, 5, 8, 8, 2, 7, 3, 3, 8, 6, 4, 7, 8, 3, 1, 5, 3, 4, 4, 2, 4]
    f = io.frame(spark, {"ts": ts, "v": [float(x) for x in v]})
    close(values(joins.rolling_offset(f, "v", "ts", "3d", "1d", "r"), "r"), [5, 5, 9, 5, 8, 8, 7, 12, 12, 8, 16, 14, 11, 10, 11, 11, 7, 5, 7, 11, 12, 5, 5])


def test_time_buckets_like_pandas(spark, times):
    s = pd.Series([float(x) for x in V], index=TS)
    for closed in ("left", "right"):
        got = times.groupby("12h", time="ts", closed=closed).agg(r=col("v").sum()).orderBy("ts").collect()
        want = s.resample("12h", closed=closed, label="left").sum()
        assert [(r.ts, r.r) for r in got] == list(zip(want.index.to_pydatetime(), want, strict=True))


def test_trailing_windows_and_apply(spark):
    f = io.frame(spark, {"b": [4.0, 3, 1]})
    close(values(f.with_columns(r=col("b").ts_sum(2)), "r"), [4, 7, 4])
    f = io.frame(spark, {"x": [1.0, 2, 3, 4, 5], "y": [2.0, 3, 4, 5, 6]})
    close(values(f.with_columns(r=col("x").rolling(2).apply(col("x").sum())), "r"), [1, 3, 5, 7, 9])
    close(values(f.with_columns(r=col("x").rolling(2).apply(-col("x").sum() + col("y").sum())), "r"), [1, 2, 2, 2, 2])
    f = io.frame(spark, {"a": [1.0, 2, 3, 4]})
    close(values(f.with_columns(r=col("a").ts_sum(3), s=col("a").ts_mean(2)), "r"), [1, 3, 6, 9])


def test_unique_and_sorted_unique(spark):
    f = io.frame(spark, {"x": [1, 3, 2, 1, 2]})
    assert values(f.unique("x"), "x") == [1, 3, 2]
    f = io.frame(spark, {"x": [2, 2, 3, 3, 4, 5, 5]})
    assert values(f.sorted_unique("x"), "i") == [0, 2, 4, 5] and values(f.sorted_unique("x", "last"), "i") == [1, 3, 4, 6]
    f = io.frame(spark, {"a": [1, 1, 3, 4, 5, 3], "b": list("abbcdb"), "v": [1, 2, 3, 4, 5, 6]})
    assert values(f.unique(["a", "b"], "last"), "v") == [1, 2, 4, 5, 6] and values(f.unique(["a", "b"]), "v") == [1, 2, 3, 4, 5]


def test_joins(spark):
    left = io.frame(spark, {"left_on": list("abac"), "va": [1, 2, 3, 4]})
    right = io.frame(spark, {"right_on": list("bac"), "vb": [10, 20, 30]}, order="j")
    assert values(left.join(right, left_on="left_on", right_on="right_on"), "vb") == [20, 10, 20, 30]
    right = io.frame(spark, {"right_on": list("bbcb"), "vb": [10, 20, 30, 40]}, order="j")
    many = io.frame(spark, {"left_on": list("abcbbbb"), "va": range(7)})
    assert values(many.join(right, left_on="left_on", right_on="right_on"), "vb") == [None, 40, 30, 20, 10, 10, 10]
    a = io.frame(spark, {"on": list("abdc"), "va": [1, 2, 3, 4]})
    b = io.frame(spark, {"on": list("bae"), "vb": [10, 20, 30]}, order="j")
    got = a.join(b, on="on", how="outer").df.collect()
    assert [(r.on, r.va, r.vb) for r in got] == [("a", 1, 20), ("b", 2, 10), ("c", 4, None), ("d", 3, None), ("e", None, 30)]
    x, y = joins.align_frames([a, b], "on")
    assert [r.vb for r in y.df.collect()] == [20, 10, None, None, 30] and [r.va for r in x.df.collect()] == [1, 2, 4, 3, None]


def test_groups_sort_dropna_fill(spark):
    f = io.frame(spark, {"a": list("ababbc"), "b": [1, 2, 3, 4, 5, 6], "c": [6, 5, 4, 3, 2, 1]})
    got = f.groupby("a", sort=True).agg(s=col("c").sum(), c="max").collect()
    assert [(r.a, r.s, r.c) for r in got] == [("a", 10, 6), ("b", 10, 5), ("c", 1, 1)]
    f = io.frame(spark, {"a": [4.0, 2, nan, 1], "b": [1, 2, 3, 4]})
    assert [r.b for r in f.sort("a").df.collect()] == [4, 2, 1, 3] and [r.b for r in f.sort("a", rev=True).df.collect()] == [1, 2, 4, 3]
    f = io.frame(spark, {"a": [1, 2, nan, 3, 2, nan], "b": [nan, 3, nan, 4, nan, 5]})
    close(values(f.dropna(["a", "b"]), "b"), [nan, 3, 4, nan, 5])
    close(values(f.dropna(["a", "b"], how="any"), "a"), [2, 3])
    s = io.frame(spark, {"s": [nan, 5, 6, 733, nan, 34, nan, nan]})
    close(values(s.with_columns(r=col("s").fillna("ffill", 0.0)), "r"), [0, 5, 6, 733, 733, 34, 34, 34])
    close(values(s.with_columns(r=col("s").bfill(0.0)), "r"), [5, 5, 6, 733, 34, 34, 0, 0])


def test_partition_winsorize_horizontal(spark):
    f = io.frame(spark, {"x": [1, nan, 3, nan, nan]})
    assert values(f.partition_top(2, "x", rev=True, rank="k"), "i", ["k"]) == [2, 0]
    a = np.arange(12.0)
    f = io.frame(spark, {"x": a})
    med, mad = np.median(a), np.median(np.abs(a - np.median(a)))
    close(values(f.with_columns(r=col("x").winsorize("quantile", 0.05)), "r"), np.clip(a, np.quantile(a, 0.05), np.quantile(a, 0.95)))
    close(values(f.with_columns(r=col("x").winsorize("median", 1)), "r"), np.clip(a, med - mad, med + mad))
    close(values(f.with_columns(r=col("x").winsorize("sigma", 1.2)), "r"), np.clip(a, a.mean() - 1.2 * a.std(ddof=1), a.mean() + 1.2 * a.std(ddof=1)))
    close(values(f.with_columns(r=col("x").zscore()), "r"), (a - a.mean()) / a.std(ddof=1))
    f = io.frame(spark, {"a": [1.0, 2, 3, 4], "b": [3.0, 4, 5, 6]})
    close(values(f.with_columns(r=f.hmean("a", "b"), s=f.hsum("a", "b")), "r"), [2, 3, 4, 5])


@settings(max_examples=4, deadline=None)
@given(st.data())
def test_windows_like_pandas(spark, data):
    """Many random series at once, one for each series id."""
    n, window = 30, data.draw(st.integers(1, 6))
    seed = data.draw(st.integers(0, 1 << 16))
    rng = np.random.default_rng(seed)
    x = rng.permuted(np.tile(np.arange(n) * 0.37 - 4, (6, 1)), axis=1)
    x[rng.random(x.shape) < 0.05] = nan
    y = rng.normal(size=x.shape)
    pdf = pd.DataFrame({"s": np.repeat(range(6), n), "i": np.tile(range(n), 6), "x": x.ravel(), "y": y.ravel()})
    f = TideFrame(spark.createDataFrame(pdf), "i", "s")
    e, mp = col("x"), data.draw(st.integers(1, window))
    got = f.with_columns(mean=e.ts_mean(window, mp), std=e.ts_std(window), rank=e.ts_rank(window, min_periods=mp), skew=e.ts_skew(window), cov=e.ts_cov(col("y"), window), corr=e.ts_corr(col("y"), window), mx=e.ts_max(window, mp)).df.orderBy("s", "i").toPandas()
    for s, g in pdf.groupby("s"):
        have = got[got.s == s]
        r = g.x.rolling(window, min_periods=1)
        want = {"mean": g.x.rolling(window, min_periods=mp).mean(), "std": r.std(), "mx": g.x.rolling(window, min_periods=mp).max(), "skew": g.x.rolling(window, min_periods=1).apply(lambda v: pd.Series(v).skew()), "cov": r.cov(g.y), "rank": g.x.rolling(window, min_periods=mp).rank()}
        for k, w in want.items():
            np.testing.assert_allclose(have[k].to_numpy(float), w.to_numpy(float), rtol=1e-5, atol=1e-6, err_msg=k)


def test_ledger(spark):
    f = pd.DataFrame({"k": 1, "i": range(7), "o": [98.0, 100, 103, 105, 96, 220, 226], "c": [100.0, 102, 105, 96, 90, 226, 220], "roll": [0.0, 0, 0, 0, 0, 1, 0], "pos": [0, 1, 1, 0.5, -0.5, -0.5, 0]})
    out = equity.backtest(spark.createDataFrame(f), ["k"], ["i"], "pos", "o", "c", "roll", multiplier=10, leverage=2).orderBy("i").collect()
    close([r.equity for r in out], [1000000, 1039400, 1099400, 1004869.805, 1067027.021, 1037286.821, 1036957.991])


def test_regressions(spark):
    y = [1, 4, 6, 1, nan, 43]
    x = [[5, 7], [6, nan], [12, 7], [5, 1], [7, 4], [2, 8]]
    pdf = pd.DataFrame(x, columns=["a", "b"]).assign(y=y, g=1, i=range(6))
    df = TideFrame(spark.createDataFrame(pdf), "i").df
    good = ~(np.isnan(y) | np.isnan(x).any(axis=1))
    m = np.column_stack([np.ones(good.sum()), np.array(x)[good]])
    want = np.linalg.lstsq(m, np.array(y)[good], rcond=None)[0]
    close(linalg.ols_by(df, ["g"], "y", ["a", "b"]).first().params, want.tolist())
    close(linalg.ols_whole(df, "y", ["a", "b"])["params"], want.tolist(), 1e-5)
    robust = linalg.ols_by(df, ["g"], "y", ["a", "b"], robust=True, order=["i"], lag=1).first()
    r = np.array(y)[good] - m @ want
    u = m * r[:, None]
    meat = u.T @ u + 0.5 * (u[1:].T @ u[:-1] + u[:-1].T @ u[1:])
    bread = np.linalg.inv(m.T @ m)
    close(robust.tvalues, (want / np.sqrt(np.diag(bread @ meat @ bread))).tolist(), 1e-5)
    few = linalg.ols_by(df.where("i = 0"), ["g"], "y", ["a", "b"]).first()
    assert few.params == [None] * 3
    resid = linalg.residuals_by(df, ["g"], "y", ["a", "b"], ["i"]).orderBy("i").collect()
    assert resid[1].resid is None or math.isnan(resid[1].resid)
    pinv = linalg.matrix_by(df.where("b is not null"), ["g"], ["a", "b"], ["i"], "pinv").first()
    np.testing.assert_allclose(np.array(pinv.pinv), np.linalg.pinv(pdf.dropna(subset=["b"])[["a", "b"]].to_numpy()), atol=1e-9)
    stars = spark.range(1).select(linalg.mark_star(F.lit(1.23456), F.lit(0.03)).alias("s")).first().s
    assert stars == "1.235**"


def test_distributions():
    assert dist.norm_cdf_value(1.96) == pytest.approx(0.9750021048517795)
    assert dist.t_cdf_value(2.0, 10) == pytest.approx(0.9633059826146299)
    assert dist.f_cdf_value(3.0, 2, 10) == pytest.approx(0.9046325683594)
    for t in (0.3, 1.7, -2.2):
        assert dist.f_cdf_value(t * t, 1, 7) == pytest.approx(dist.t_cdf_value(abs(t), 7) - dist.t_cdf_value(-abs(t), 7))
        assert dist.t_cdf_value(t, 1e7) == pytest.approx(dist.norm_cdf_value(t), abs=1e-6)


def test_durations():
    d = duration("2y1mo-3d5h-2m3s")
    assert (d.months, d.micros) == (25, (-3 * 86400 + 5 * 3600 - 120 + 3) * 1_000_000)
    assert timedelta("1h") - timedelta("30m") == duration("30m")
    for bad in ("", "3", "1x"):
        with pytest.raises(ValueError):
            duration(bad)


def test_selection_and_errors(spark):
    f = io.frame(spark, {"a1": [1.0, nan, 3], "a2": [4, 5, 6], "b": ["x", "y", "z"]})
    assert f["^a.*$"].columns == ["a1", "a2"] and f[-2].columns == ["b"] and f.select("^a.*$").columns == ["a1", "a2"]
    assert f.drop("b").columns == ["a1", "a2", "i"] and f.rename({"b": "c"}).columns[2] == "c"
    assert values(f.take([-1, 0]), "b") == ["z", "x"] and values(f.take(slice(1, None)), "b") == ["y", "z"]
    close([r.a2 for r in f.take([1, None], missing=True).df.orderBy("__at").collect()], [5, None])
    close(values(f.with_columns(r=where(col("a1").is_nan(), lit(0.0), col("a1"))), "r"), [1, 0, 3])
    assert f.aggregate("sum", "a1", "a2").first() == (4.0, 15)
    with pytest.raises(ValueError):
        TideFrame(f.df).with_columns(r=col("a1").shift(1))
    with pytest.raises(AttributeError):
        col("a1").no_such_operation()

    @register
    def doubled(e):
        return e * 2

    close(values(f.with_columns(r=col("a2").doubled()), "r"), [8, 10, 12])
    assert "ts_mean" in repr(col("a").ts_mean(3)) and col("a").ts_cov(col("b"), 3).columns() == {"a", "b"}


def test_setting_places_and_results(spark):
    f = io.frame(spark, {"x": [1.0, 2, 3, 4]})
    out = f.with_columns(a=col("x").set_at(-1, 9.0), b=col("x").put_packed(col("x") > 2, Expr("column", (F.array(F.lit(7.0), F.lit(8.0)),))), c=col("x").norm_cdf(1.0, 2.0))
    d = out.to_dict()
    assert d["a"] == [1, 2, 3, 9] and d["b"] == [1, 2, 7, 8] and d["c"][0] == 0.5
    assert out.eval().to_pandas().shape == (4, 5)


def test_ipc_round_trip(spark, tmp_path):
    f = io.frame(spark, {"a": [1.5, nan, 2.5], "b": ["x", None, "z"], "ts": TS[:3]})
    io.write_ipc(f.df, str(tmp_path / "f.arrow"))
    back = io.scan_ipc(spark, str(tmp_path / "f.arrow"), ["a", 1, -1], order="i")
    assert back.columns == ["a", "b", "i"] and back.df.orderBy("i").collect()[1].a is None
    assert [r.value for r in io.arange(spark, 1, 3, 0.5).df.orderBy("i").collect()] == [1.0, 1.5, 2.0, 2.5] and io.full(spark, 3, 7).df.count() == 3


def test_distributed_rank(spark):
    x = [3, 1, 1, 2, 2, 2, 9, None]
    df = spark.createDataFrame([(v,) for v in x if v is not None], "x int")
    got = sorted((r.x, r.r) for r in distributed_rank(df, "x", "r").collect())
    want = pd.Series([v for v in x if v is not None]).rank()
    assert [r for _, r in got] == sorted(want)


def test_streams(spark, tmp_path):
    src = tmp_path / "src"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    stream = spark.readStream.schema(schema).parquet(str(src))
    out = buckets.bucket_stream(stream, "ts", "12h", {"s": col("value").sum(), "n": col("value").count_valid()}, late="40d")
    q = out.writeStream.format("memory").queryName("tide_buckets").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = TideFrame(spark.read.parquet(str(src)).withColumn("ts", F.col("ts").cast("timestamp_ntz")), "event_id").groupby("12h", time="ts").agg(n=col("value").count_valid()).collect()
    assert sorted(r.n for r in spark.sql("select n from tide_buckets").collect()) == sorted(r.n for r in batch)
    q = buckets.ewm_stream(stream.select("user_id", "event_id", "value"), "user_id", "event_id", "value", 10).writeStream.format("memory").queryName("tide_ewm").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(*) from tide_ewm where ewm is not null").first()[0] == 1000
