"""Edges of frames: ties, months, picked rows, alignment, plans without one-task windows, module functions."""

import datetime as dt
import math
import warnings

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideframe.functions import eager
from tideframe.functions import distributions as dist
from tideframe.operators import equity, joins, linalg
from tideframe.operators.frame import TideFrame
from tideframe.plans import queries
from tideframe.plans.expr import asexpr, asexprs, col, datetime, lit
from tideframe.sources import io

SF = "/root/testdata/sf0.01"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def column(df, name, *order):
    return [r[0] for r in df.orderBy(*order).select(name).collect()]


def test_later_rows_of_the_same_time_stay_out(spark):
    f = io.frame(spark, {"ts": pd.to_datetime(["2020-01-01", "2020-01-01", "2020-01-02"]), "v": [1.0, 2, 4]})
    assert column(f.with_columns(r=col("v").rolling("12h", time="ts").sum()).df, "r", "i") == [1, 3, 4]
    assert column(f.with_columns(r=col("v").rolling("1mo", time="ts").sum()).df, "r", "i") == [1, 3, 7]


def _add_months(t, n):
    return (pd.Timestamp(t) + pd.DateOffset(months=n)).to_pydatetime()


@settings(max_examples=5, deadline=None)
@given(st.data())
def test_months_at_their_ends(spark, data):
    """Every row against the rule: rows up to it whose time plus n months is later than its own."""
    days = data.draw(st.lists(st.integers(0, 130), min_size=10, max_size=40))
    hours, n = data.draw(st.lists(st.sampled_from([0, 0, 7, 23]), min_size=len(days), max_size=len(days))), data.draw(st.integers(1, 3))
    times = sorted(dt.datetime(2023, 12, 20) + dt.timedelta(days=d, hours=h) for d, h in zip(days, hours, strict=True))
    f = io.frame(spark, {"ts": pd.to_datetime(times), "v": [float(k * k % 17) for k in range(len(times))]})
    v = col("v").rolling(f"{n}mo", time="ts")
    got = f.with_columns(s=v.sum(), m=v.median(), a=v.first(), z=v.apply(col("v").max() - col("v").min())).df.orderBy("i").collect()
    for r in got:
        own = [x.v for x in got if x.i <= r.i and _add_months(x.ts, n) > r.ts]
        assert (r.s, r.m, r.a, r.z) == (sum(own), np.median(own), own[0], max(own) - min(own)), (r.ts, n)


def test_picked_rows(spark):
    f = io.frame(spark, {"x": [1.0, 2, 3, 4, 5], "start": [0, 0, 1, 3, 9]})
    assert column(f.rolling(idx="start").agg(s=col("x").sum(), n=col("x").count_valid()).df, "s", "i") == [1, 3, 5, 4, 0]
    for bad in ({}, {"window": "1d", "idx": "start"}, {"window": "1d"}):
        with pytest.raises(ValueError):
            f.rolling(**bad)
    with pytest.raises(ValueError):
        f.with_columns(r=col("x").rolling("1mo2d", time="x").sum())


def test_tasks_of_time_frames_grow_with_the_tables(spark, monkeypatch):
    f = queries.events(spark, SF)
    rolled = lambda: f.with_columns(r=col("v").rolling("1mo", time="ts").mean()).df
    few, want = plan(rolled()), sorted(rolled().select("event_id", "r").collect())
    monkeypatch.setattr("tideframe.operators.ranges.TASK_BYTES", 1 << 13)
    many, tasks = plan(rolled()), (220511 >> 13)
    assert "REPARTITION" not in few and "hashpartitioning(user_id" in many and f", {tasks}), REPARTITION_BY_NUM" in many and many.count("Exchange") == 1
    assert sorted(rolled().select("event_id", "r").collect()) == want


def test_quantiles_of_large_groups_are_found_in_ranges(spark, monkeypatch):
    """No task takes all values of a group; keys and values may be missing and repeat."""
    x = [float(k * k % 97) if k % 5 else math.nan for k in range(400)]
    f = io.frame(spark, {"g": [None if k % 3 == 0 else "b" if k % 3 == 1 else "none" for k in range(400)], "x": [v if k % 3 < 2 else math.nan for k, v in enumerate(x)]})
    v = col("x")
    run = lambda: f.groupby("g").agg(q=v.quantile(0.3), m=v.median(), d=v.max() - v.quantile(0.9), n=v.count_valid())
    whole = lambda: f.aggregate("median", "x")
    assert "percentile(" in plan(run()) and "percentile(" in plan(whole())
    want, middle = {r.g: r for r in run().collect()}, whole().first()
    monkeypatch.setattr("tideframe.operators.ranges.GROUP_ROWS", 50)
    assert "percentile(" not in plan(run()) and "percentile(" not in plan(whole())
    assert {r.g: r for r in run().collect()} == want and len(want) == 3 and whole().first() == middle


def test_rows_from_a_start_are_aggregated_as_they_come(spark):
    """Pairs of a row and what it picks are neither dealt nor sorted, and missing keys, starts and values count as they do."""
    f = io.frame(spark, {"g": [None, "a", None, "a", None, "a"], "x": [4.0, 1, math.nan, 3, 1, math.nan], "start": [0.0, 0, 0, 1, 1, 5]})
    x = col("x")
    out = TideFrame(f.df, "i", "g").rolling(idx="start").agg(s=x.sum(), n=x.count_valid(), first=x.first(), last=x.last(), q=x.quantile(0.25), both=x.max() - x.median()).df
    text = plan(out)
    above = text[: text.index("ShuffledHashJoin")]
    assert "Generate" not in text and not any(word in above for word in ("Exchange", "Sort [", "ObjectHash"))
    got = {r.i: (r.s, r.n, r.first, r.last, r.q, r.both) for r in out.collect()}
    assert got == {
        0: (4, 1, 4, 4, 4, 0), 2: (4, 1, 4, None, 4, 0), 4: (1, 1, None, 1, 1, 0),
        1: (1, 1, 1, 1, 1, 0), 3: (3, 1, 3, 3, 3, 0), 5: (0, 0, None, None, None, None),
    }


def test_argmin_in_groups_and_of_nothing(spark):
    f = io.frame(spark, {"g": list("aabba"), "x": [3.0, 1, math.nan, math.nan, 1]})
    got = {r.g: (r.a, r.b) for r in f.groupby("g").agg(a=col("x").argmin(), b=col("x").argmax()).collect()}
    assert got == {"a": (1, 0), "b": (-1, -1)}
    assert f.aggregate("argmin", "x").first()[0] == 1 and f.aggregate("median", "x").first()[0] == 1


def test_alignment(spark):
    a = io.frame(spark, {"k": [1, 1, 2], "x": [1.0, 2, 3]})
    b = io.frame(spark, {"k": [1, 1, 3], "y": [10.0, 20, 30]}, order="j")
    p, q = joins.align_frames([a, b], "k")
    assert p.df.select("x").collect() == [(1,), (3,), (None,)] and q.df.select("y").collect() == [(20,), (None,), (30,)]
    keys, (p, q) = joins.align_frames([a, b], ["k"], rev=True, with_by=False)
    assert [r.k for r in keys.df.collect()] == [3, 2, 1] and "k" not in p.columns
    assert joins.align_frames([a, b], "k", outer_df=True).columns == ["k", "x__align_by0", "i__align_by0", "y__align_by1", "j__align_by1"]
    assert joins.get_align_frames_idx([a, b], "k").df.collect() == [(0, 1), (2, None), (None, 2)]
    assert joins.align_frames([a], "k") == [a]


def test_no_window_over_all_rows_without_a_partition(spark):
    f = TideFrame(queries.events(spark, SF).df, ("ts", "event_id"))
    v = col("v")
    with warnings.catch_warnings():
        warnings.filterwarnings("error", message=".*one task.*")
        for e in (v.zscore(), v.winsorize("sigma"), v.rank(), v.split_group(5), v.argsort(), v.mean(), v - v.quantile(0.3, "higher")):
            assert "SinglePartition, ENSURE_REQUIREMENTS, [plan_id" not in "".join(x for x in plan(f.with_columns(r=e).df).split("\n") if "Window [" in x)
    with pytest.warns(UserWarning, match="one task"):
        f.with_columns(r=v.cumsum())


def test_filters_reach_the_scan_and_keep_their_rows(spark, tmp_path):
    df = queries.lineitem(spark, SF).filter((col("l_quantity") > 45) & (col("l_tax") <= 0.04)).select("l_orderkey").df
    assert "GreaterThan(l_quantity,45.0)" in plan(df) and "LessThanOrEqual(l_tax,0.04)" in plan(df)
    spark.createDataFrame([(1, math.nan), (2, 5.0), (3, None), (4, 1.0)], "i long, x double").write.parquet(str(tmp_path / "x"))
    f = TideFrame(spark.read.parquet(str(tmp_path / "x")), "i")
    rows = lambda m: sorted(r.i for r in f.filter(m).df.collect())
    assert rows(col("x") > 2) == [2] and rows(col("x") < 2) == [4] and rows(lit(2) < col("x")) == [2] and rows(col("x").is_nan()) == [1, 3]
    assert [r.i for r in f.filter(col("x") > 0).filter(col("x") < 3).df.collect()] == [4]


def test_regressions_run_without_gathering_groups(spark):
    df = queries.events(spark, SF).df
    for out in (linalg.ols_by(df, ["event_type"], "v", ["y"]), linalg.ols_by(df, ["user_id"], "v", ["y"], robust=True, order=["ts", "event_id"]), linalg.residuals_by(df, ["event_type"], "v", ["y"], ["event_id"])):
        assert "FlatMapGroupsInPandas" not in plan(out)
    u = np.random.default_rng(1).normal(size=(30, 2))
    few = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(u)], "g int, i int, a double, b double").withColumn("e", F.lit(1.0))
    for lag in (0, 1, 4):
        np.testing.assert_allclose(linalg.newey_west_by(few, ["g"], ["a", "b"], "e", lag, ["i"]).first().meat, linalg.newey_west_meat(u, np.ones(30), lag))
    one = spark.createDataFrame([(1, i, float(i), 2.0 * i, 1e9 + i % 3) for i in range(9)] + [(2, 0, 1.0, 1.0, 1.0), (3, 0, None, 1.0, 1.0)], "g int, i int, a double, b double, y double")
    fit = {r.g: r for r in linalg.ols_by(one, ["g"], "y", ["a", "b"]).collect()}
    assert fit[1].rank == 2 and fit[1].n == 9 and fit[2].params == [None] * 3 and fit[3].n == 0  # b is twice a
    m = np.column_stack([np.ones(9), np.arange(9.0)])
    straight = linalg.ols_by(one.where("g = 1"), ["g"], "y", ["a"]).first()
    np.testing.assert_allclose(straight.params, np.linalg.lstsq(m, np.arange(9) % 3, rcond=None)[0] + [1e9, 0], rtol=1e-9)
    np.testing.assert_allclose(straight.singular, np.linalg.svd(m)[1], rtol=1e-9)


def test_ledger_below_zero_holds_against_its_position():
    arr = np.array
    got = equity.walk(arr([1.0, 0.5]), arr([10.0, 5.0]), arr([1.0, 5.0]), arr([0.0, 0]), arr([0.0, 0]), 100.0, 1.0, 2.0, 0, 0, 0.0, False, False)
    # 20 lots lose 9 each, then gain 4 each: cash 0 and then nothing to trade with
    assert got.tolist() == [-80.0, 0.0]
    got = equity.walk(arr([1.0, 0.5]), arr([10.0, 2.0]), arr([1.0, 3.0]), arr([0.0, 0]), arr([0.0, 0]), 100.0, 1.0, 2.0, 0, 0, 0.0, False, False)
    assert got.tolist() == [-80.0, -60.0 - 30.0]


def test_expressions_of_values_and_casts(spark):
    f = io.frame(spark, {"x": [1.0, math.nan, 3]})
    assert column(f.with_columns(r=asexpr([5, 6, 7]) + col("x").fillna(value=0.0)).df, "r", "i") == [6, 6, 10]
    assert [e.name for e in asexprs(f)] == ["x", "i"] and f.shape == (3, 2)
    out = f.select(d=datetime("2024-02-29 10:00"), t=(col("i") * 1_500_000).cast("timedelta"), s=col("i").cast("str")).df.collect()
    assert out[1].d == dt.datetime(2024, 2, 29, 10) and out[1].t == dt.timedelta(seconds=1.5) and out[1].s == "1"
    assert f.select(a=col("x").ts_sum(2), b=col("i")).columns == ["a", "b"]
    with pytest.raises(ValueError):
        f.select(col("x").dropna(), col("i"))
    assert f.value(col("x").fillna(value=0.0)).tolist() == [1, 0, 3] and f.simplify() is f
    import pyarrow as pa

    class Table:  # what polars gives
        def to_arrow(self):
            return pa.table({"a": [1, 2]})

    assert io.frame(spark, Table()).to_dict() == {"a": [1, 2], "i": [0, 1]}


def test_module_functions(spark):
    x = [3.0, math.nan, 1, 2]
    assert eager.sum(x) == 6 and eager.mean(np.array(x)) == 2 and eager.count_nan(pd.Series(x)) == 1
    np.testing.assert_allclose(eager.ts_sum(x, 2), [3, 3, 1, 3])
    np.testing.assert_allclose(eager.rank(x), [3, math.nan, 1, 2])
    assert eager.cov([1.0, 2, 3], [2.0, 4, 7]) == pytest.approx(np.cov([1, 2, 3], [2, 4, 7])[0, 1])
    np.testing.assert_allclose(eager.max(np.array([[1.0, 5], [2, 4]])), [2, 5])
    assert eager.std(pd.DataFrame({"a": [1.0, 3]})) == {"a": pytest.approx(math.sqrt(2))}
    np.testing.assert_allclose(eager.dropna([[1, math.nan], [2, 3]]), [[2, 3]])
    assert repr(eager.ts_mean(col("v"), 3)) == repr(col("v").ts_mean(3)) and len(eager.__all__) == 49


def test_distributions_on_arrays():
    x = np.linspace(-8, 8, 101)
    np.testing.assert_allclose(dist.norm_cdf_values(x), [0.5 * math.erfc(-v / math.sqrt(2)) for v in x], rtol=1e-11)
    np.testing.assert_allclose(dist.t_cdf_values(x, 1.0), 0.5 + np.arctan(x) / math.pi, atol=1e-13)
    np.testing.assert_allclose(dist.f_cdf_values(np.abs(x), 2.0, 6.0), 1 - (1 + np.abs(x) / 3) ** -3.0, atol=1e-13)


def test_groups_of_expressions_and_items(spark):
    f = io.frame(spark, {"g": [1, 1, 2], "x": [1.0, 2, 4]})
    assert sorted(map(tuple, f.select(s=col("x").groupby("g").sum()).df.collect())) == [(1, 3.0), (2, 4.0)]
    f["y"] = col("x") * 2
    f[0] = col("g") + 1
    del f["x"]
    assert sorted(map(tuple, f.df.select("g", "y").collect())) == [(2, 2.0), (2, 4.0), (3, 8.0)] and len(f) == 3
    same = io.frame(spark, {"k": [1, 2], "x": [5, 6]})
    assert sorted(map(tuple, same.join(same.filter(col("k") > 1), on="k", how="inner").df.select("k", "x", "x_right").collect())) == [(2, 6, 6)]


def test_correlation_of_ranks_weighs_repeated_pairs(spark):
    a, b = [1, 1, 2, 3, 3, 3, None], [2, 2, 1, 5, 4, 5, 1]
    pdf = pd.DataFrame({"a": a, "b": b}, dtype="Int64")
    f = TideFrame(spark.createDataFrame(list(zip(a, b, strict=True)), "a int, b int"))
    got = {(r.x, r.y): r["corr"] for r in f.corr("a", "b", method="spearman").collect()}
    assert got["a", "b"] == pytest.approx(pdf.dropna().astype(float).rank().corr().loc["a", "b"])
    assert f.df.groupBy().agg(F.count("*")).first()[0] == 7


def test_quantiles_of_one_column_are_taken_together(spark):
    v = col("v")
    out = queries.events(spark, SF).groupby("event_type").agg(a=v.quantile(0.3), b=v.median(), c=v.quantile(0.9, "lower"))
    assert plan(out).count("partial_percentile(") == 1 and "collect_list" not in plan(out)
    got = {r.event_type: (r.a, r.b, r.c) for r in out.collect()}
    pdf = queries.events(spark, SF).df.select("event_type", "v").dropna().toPandas()
    for k, g in pdf.groupby("event_type"):
        np.testing.assert_allclose(got[k], [g.v.quantile(0.3), g.v.median(), g.v.quantile(0.9, "lower")])
