"""Further registered queries: frames edited, ties and months in rolling, picked rows, alignment, groups, sources."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.functions import eager
from tideframe.operators import joins, linalg
from tideframe.operators.frame import TideFrame
from tideframe.plans.catalog import register
from tideframe.plans.expr import asexpr, asexprs, col, datetime, lit, timedelta
from tideframe.plans.expr import register as expr_method
from tideframe.plans.queries import E_SQL, LI, events, lineitem, nudge, rounded, table, v, y
from tideframe.sources import io

# one set of aggregates for every kind of frame and group: name -> (expression, SQL over b, digits)
_KEY = "(b.t, b.id)"
_AGGS = {
    "s": (v.sum(), "coalesce(sum(b.v), 0)", 4), "m": (v.mean(), "avg(b.v)", 5), "sd": (v.std(), "stddev_samp(b.v)", 4), "vr": (v.var(), "var_samp(b.v)", 1), "lo": (v.min(), "min(b.v)", 5), "hi": (v.max(), "max(b.v)", 5),
    "ulo": (v.umin(), "min(b.v)", 5), "uhi": (v.umax(), "max(b.v)", 5), "fi": (v.first(), f"arg_min(struct_pack(x := b.v), {_KEY}).x", 5), "la": (v.last(), f"arg_max(struct_pack(x := b.v), {_KEY}).x", 5),
    "vf": (v.valid_first(), f"arg_min(b.v, {_KEY}) FILTER (WHERE b.v IS NOT NULL)", 5), "vl": (v.valid_last(), f"arg_max(b.v, {_KEY}) FILTER (WHERE b.v IS NOT NULL)", 5), "q": (v.quantile(0.25), "quantile_cont(b.v, 0.25)", 5), "md": (v.median(), "quantile_cont(b.v, 0.5)", 5),
    "cv": (v.cov(y), "CASE WHEN count(b.v + b.y) >= 3 THEN covar_samp(CASE WHEN b.y IS NOT NULL THEN b.v END, CASE WHEN b.v IS NOT NULL THEN b.y END) END", 3),
    "wm": (v.weight_mean(y), "CASE WHEN count(b.v + b.y) >= 1 THEN sum(b.v * b.y) / nullif(sum(b.y), 0) END", 4), "cm": (v.cut_mean(y > 50), "avg(b.v) FILTER (WHERE b.y > 50)", 5), "cs": (v.cut_sum(y > 50), "coalesce(sum(b.v) FILTER (WHERE b.y > 50), 0)", 4),
    "n": (v.count_valid(), "count(b.v)", None), "ap": (v.sum() / v.count_valid() + y.max(), "coalesce(sum(b.v), 0) / nullif(count(b.v), 0) + max(b.y)", 4),
}


def _sql(names, digits=None) -> str:
    return ", ".join(f"round({q} + {nudge(d):.10f}, {d}) + 0.0 AS {n}" if (d := digits or _AGGS[n][2]) is not None else f"{q} AS {n}" for n, (_, q, _) in ((n, _AGGS[n]) for n in names))


def _shown(df: DataFrame, names, *keep) -> DataFrame:
    return df.select(*keep, *[(F.round(F.col(n) + nudge(d), d) + 0.0).alias(n) if (d := _AGGS[n][2]) is not None else n for n in names])


_DAYS = f"(SELECT event_id AS id, user_id AS p, date_trunc('day', ts) AS t, v, y FROM {E_SQL})"
_ORDERS = "(SELECT o_orderkey AS id, o_custkey AS p, o_orderdate AS t, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS v, CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey * 37 % 101)::DOUBLE END AS y FROM orders)"
_UPTO = "a.p = b.p AND (b.t, b.id) <= (a.t, a.id)"


def _days(spark, sf_dir) -> TideFrame:
    """Events by the day, so that times tie."""
    df = events(spark, sf_dir).df.select(F.col("event_id").alias("id"), F.col("user_id").alias("p"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("t"), "v", "y")
    return TideFrame(df, ("t", "id"), "p")


def _orders(spark, sf_dir) -> TideFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    df = o.select(key.alias("id"), F.col("o_custkey").alias("p"), F.col("o_orderdate").alias("t"), F.when(key % 7 != 0, F.col("o_totalprice")).alias("v"), F.when(key % 11 != 0, (key * 37 % 101).cast("double")).alias("y"))
    return TideFrame(df, ("t", "id"), "p")


def _rolled(frame: TideFrame, window: str, names) -> DataFrame:
    agg = {n: v.rolling(window, time="t").apply(_AGGS[n][0]) for n in names}
    return _shown(frame.with_columns(**agg).df, names, "id")


_FRAMED = [n for n in _AGGS if n not in ("md", "uhi", "ulo", "cs")]
register("rolling_ties", f"SELECT a.id, {_sql(_FRAMED)} FROM {_DAYS} a JOIN {_DAYS} b ON {_UPTO} AND b.t + INTERVAL 60 HOUR > a.t GROUP BY a.id")(lambda spark, sf_dir: _rolled(_days(spark, sf_dir), "60h", _FRAMED))
register("rolling_month", f"SELECT a.id, {_sql(_FRAMED)} FROM {_ORDERS} a JOIN {_ORDERS} b ON {_UPTO} AND b.t + INTERVAL 1 MONTH > a.t GROUP BY a.id")(lambda spark, sf_dir: _rolled(_orders(spark, sf_dir), "1mo", _FRAMED))
register("rolling_year_ties", f"SELECT a.id, {_sql(['m', 'sd', 'fi', 'n'])} FROM {_ORDERS} a JOIN {_ORDERS} b ON {_UPTO} AND b.t + INTERVAL 14 MONTH > a.t GROUP BY a.id")(lambda spark, sf_dir: _rolled(_orders(spark, sf_dir), "1y2mo", ["m", "sd", "fi", "n"]))
register("rolling_named", f"SELECT a.id, {_sql(['m', 'ulo', 'uhi', 'vf', 'cm'])} FROM {_DAYS} a JOIN {_DAYS} b ON {_UPTO} AND b.t + INTERVAL 2 DAY > a.t GROUP BY a.id")(
    lambda spark, sf_dir: _shown(
        _days(spark, sf_dir).with_columns(m=(r := v.rolling("2d", time="t")).mean(), ulo=r.umin(), uhi=r.umax(), vf=r.valid_first(), cm=r.cut_mean(y > 50)).df, ["m", "ulo", "uhi", "vf", "cm"], "id"
    )
)

# picked rows: of one time the first row counts
_FIRST = f"(SELECT * FROM {_DAYS} QUALIFY row_number() OVER (PARTITION BY p, t ORDER BY id) = 1)"
_PICKED = ["s", "m", "sd", "lo", "hi", "fi", "la", "q", "ap"]
register("rolling_offset_all", f"SELECT a.id, {_sql(_PICKED)} FROM {_DAYS} a LEFT JOIN {_FIRST} b ON a.p = b.p AND date_diff('day', b.t, a.t) IN (0, 2, 4, 6) GROUP BY a.id")(
    lambda spark, sf_dir: _shown(_days(spark, sf_dir).rolling("6d", time="t", offset="2d").agg(**{n: _AGGS[n][0] for n in _PICKED}).df, _PICKED, "id")
)
_PLACED = f"(SELECT *, row_number() OVER (PARTITION BY p ORDER BY t, id) - 1 AS rn FROM {_DAYS})"
register("rolling_idx_start", f"SELECT a.id, {_sql(_PICKED)} FROM {_PLACED} a JOIN {_PLACED} b ON a.p = b.p AND b.rn BETWEEN a.rn // 2 AND a.rn GROUP BY a.id")(
    lambda spark, sf_dir: _shown(_places(spark, sf_dir, F.floor(F.col("rn") / 2)).rolling(idx="at").agg(**{n: _AGGS[n][0] for n in _PICKED}).df, _PICKED, "id")
)
register("rolling_idx_lists", f"SELECT a.id, {_sql(_PICKED)} FROM {_PLACED} a LEFT JOIN {_PLACED} b ON a.p = b.p AND b.rn IN (0, a.rn - 3, a.rn + 1) GROUP BY a.id")(
    lambda spark, sf_dir: _shown(_places(spark, sf_dir, F.array_distinct(F.array(F.lit(0).cast("long"), F.col("rn") - 3, F.col("rn") + 1))).rolling(idx="at").agg(**{n: _AGGS[n][0] for n in _PICKED}).df, _PICKED, "id")
)


def _places(spark, sf_dir, at) -> TideFrame:
    f = _days(spark, sf_dir)
    df = f.df.withColumn("rn", (F.row_number().over(f.scope.ordered) - 1).cast("long")).withColumn("at", at)
    return TideFrame(df.drop("rn"), f.order, f.part, normalise=False)


# groups
_ALL = list(_AGGS)
register("group_all", f"SELECT p, prod, {_sql(_ALL)} FROM {_DAYS} b JOIN (SELECT p AS pp, round(product(v / 50), 6) + 0.0 AS prod FROM {_DAYS} WHERE id % 5 = 0 GROUP BY 1) ON p = pp GROUP BY p, prod")(
    lambda spark, sf_dir: _shown(
        (f := TideFrame(_days(spark, sf_dir).df, ("t", "id"))).groupby("p").agg(**{n: _AGGS[n][0] for n in _ALL}).join(f.filter(asexpr(F.col("id") % 5 == 0)).groupby("p").agg(prod=(v / 50).prod()), "p"), _ALL, "p", rounded("prod")
    )
)
_BUCKET = "make_date(year(t)::BIGINT, month(t)::BIGINT, 1::BIGINT)::TIMESTAMP"
register("groupby_time_all", f"SELECT {_BUCKET} AS t, p % 5 AS k, {_sql(_ALL)} FROM {_ORDERS} b GROUP BY 1, 2")(
    lambda spark, sf_dir: _shown(TideFrame(_orders(spark, sf_dir).df.withColumn("k", F.col("p") % 5), ("t", "id")).groupby("1mo", "k", time="t").agg(**{n: _AGGS[n][0] for n in _ALL}), _ALL, "t", "k")
)
_RANKS = "rank() OVER (PARTITION BY event_type ORDER BY {0}) + (count(*) OVER (PARTITION BY event_type, {0}) - 1) / 2.0"
register("group_spearman", f"WITH r AS (SELECT event_type, {_RANKS.format('v')} AS a, {_RANKS.format('y')} AS b FROM {E_SQL} WHERE v IS NOT NULL AND y IS NOT NULL) SELECT event_type, round(corr(a, b), 6) + 0.0 AS r FROM r GROUP BY 1")(
    lambda spark, sf_dir: events(spark, sf_dir).groupby("event_type").agg(r=v.corr(y, method="spearman")).select("event_type", rounded("r"))
)
register("group_quantile_midpoint", f"SELECT event_type, round((list_sort(list(v) FILTER (WHERE v IS NOT NULL))[floor(0.3 * (count(v) - 1))::BIGINT + 1] + list_sort(list(v) FILTER (WHERE v IS NOT NULL))[ceil(0.3 * (count(v) - 1))::BIGINT + 1]) / 2, 6) AS r FROM {E_SQL} GROUP BY 1")(
    lambda spark, sf_dir: events(spark, sf_dir).groupby("event_type").agg(r=v.quantile(0.3, "midpoint")).select("event_type", rounded("r"))
)
register("group_shorthand", "SELECT l_returnflag, l_linestatus, l_linenumber, l_tax > 0.04 AS taxed, max(l_quantity) AS l_quantity, min(l_discount) AS l_discount, count(*) AS n FROM lineitem GROUP BY ALL")(
    lambda spark, sf_dir: lineitem(spark, sf_dir).with_columns(taxed=col("l_tax") > 0.04).groupby("l_returnflag", "l_linestatus", "l_linenumber", "taxed").agg(l_quantity="max", l_discount="min", n=col("l_tax").len())
)
register("expr_groupby", f"SELECT event_type, round(avg(v), 6) + 0.0 AS m, round(max(v) - min(v), 6) + 0.0 AS spread FROM {E_SQL} GROUP BY 1")(
    lambda spark, sf_dir: events(spark, sf_dir).select(m=(g := v.groupby("event_type")).mean(), spread=g.agg(v.max() - v.min())).df.select("event_type", rounded("m"), rounded("spread"))
)

# a frame without a partition: scalars and ranges of values instead of one window over all rows
_WHOLE = f"""SELECT event_id, round((v - avg(v) OVER ()) / stddev_samp(v) OVER (), 6) + 0.0 AS z, CASE WHEN v IS NOT NULL THEN rank() OVER (ORDER BY v NULLS LAST) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 END AS rk,
  round(CASE WHEN y IS NOT NULL THEN (rank() OVER (ORDER BY y DESC NULLS LAST) + (count(*) OVER (PARTITION BY y) - 1) / 2.0) / count(y) OVER () END, 8) + 0.0 AS rp, (row_number() OVER (ORDER BY y NULLS LAST, ts, event_id) - 1)::BIGINT AS place,
  coalesce(ceil((rank() OVER (ORDER BY y NULLS LAST) + (count(*) OVER (PARTITION BY y) - 1) / 2.0) * 7 / count(y) OVER () * CASE WHEN y IS NULL THEN NULL ELSE 1 END), 0)::BIGINT AS g,
  round(greatest(least(v, quantile_cont(v, 0.9) OVER ()), quantile_cont(v, 0.1) OVER ()), 6) + 0.0 AS w FROM {E_SQL}"""
register("whole_frame", _WHOLE.replace("AS w FROM", "AS w0, v FROM").replace("SELECT event_id", "SELECT event_id, z, rk, rp, place, g, CASE WHEN v IS NOT NULL THEN w0 END AS w FROM (SELECT event_id", 1) + ")")(
    lambda spark, sf_dir: (
        TideFrame(events(spark, sf_dir).df, ("ts", "event_id")).with_columns(z=v.zscore(), rk=v.rank(), rp=y.rank(pct=True, rev=True), place=y.argsort(), g=y.split_group(7), w=v.winsorize("quantile", 0.1)).df.select("event_id", rounded("z"), "rk", rounded("rp", 8), "place", "g", rounded("w"))
    )
)
register("whole_aggregates", f"WITH p AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS rn FROM {E_SQL}) SELECT arg_min(rn, (v, rn)) FILTER (WHERE v IS NOT NULL) AS lo, arg_max(rn, (v, -rn)) FILTER (WHERE v IS NOT NULL) AS hi FROM p")(
    lambda spark, sf_dir: (f := TideFrame(events(spark, sf_dir).df, ("ts", "event_id"))).aggregate("argmin", "v").select(F.col("v").alias("lo")).join(f.aggregate("argmax", "v").select(F.col("v").alias("hi")))
)
register("partition_values", f"WITH p AS (SELECT user_id, v, rn, row_number() OVER (PARTITION BY user_id ORDER BY v NULLS LAST, ts, event_id) AS k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM {E_SQL})), a AS (SELECT user_id, list(v ORDER BY k) FILTER (WHERE v IS NOT NULL) AS v, list(rn ORDER BY k) FILTER (WHERE v IS NOT NULL) AS i FROM p GROUP BY 1) SELECT user_id, list_transform(range(1, 81), lambda k: v[k]) AS v, list_transform(range(1, 81), lambda k: coalesce(i[k], -1)) AS i FROM a")(
    lambda spark, sf_dir: (f := events(spark, sf_dir)).partition(79, "v").join(f.arg_partition(79, "v", name="i"), "user_id")
)
register("take_backward", f"SELECT event_id FROM (SELECT *, row_number() OVER o - 1 AS rn, count(*) OVER p AS n FROM {E_SQL} WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id), p AS (PARTITION BY user_id)) WHERE rn <= n - 2 AND rn > 1 AND (n - 2 - rn) % 2 = 0")(
    lambda spark, sf_dir: events(spark, sf_dir).take(slice(-2, 1, -2)).df.select("event_id")
)
register("set_places", f"SELECT event_id, CASE WHEN rn IN (0, 2) OR rn = n - 1 THEN -1.0 ELSE v END AS a, CASE WHEN rn >= 1 AND rn < n - 2 AND (rn - 1) % 3 = 0 THEN 0.0 ELSE v END AS b FROM (SELECT *, row_number() OVER o - 1 AS rn, count(*) OVER p AS n FROM {E_SQL} WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id), p AS (PARTITION BY user_id))")(
    lambda spark, sf_dir: events(spark, sf_dir).with_columns(a=v.set_at([0, 2, -1], -1.0), b=v.set_at(slice(1, -2, 3), 0.0)).df.select("event_id", "a", "b")
)

# frames edited
register("frame_edit", f"SELECT event_id AS id, round(v * 2, 6) + 0.0 AS v_x, round(value + 1, 6) + 0.0 AS pre_value, v IS NULL AS miss, round(value, 2) AS value FROM {E_SQL}")(lambda spark, sf_dir: _edited(spark, sf_dir))


def _edited(spark, sf_dir) -> DataFrame:
    f = events(spark, sf_dir).drop("ts", "event_type").exclude("user_id").rename({"event_id": "id"})
    f = TideFrame(f.df, "id").with_columns((v * 2).suffix("_x"), (col("value") + 1).prefix("pre_"), v.is_nan().alias("miss"))
    f["value"] = col("value").round(2)
    f["gone"] = lit(1)
    del f["gone"]
    del f["^[vy]$"]
    return f.apply(lambda e: e.round(6) + 0.0, exclude=["id", "miss", "value"])["id", "v_x", "pre_value", "miss", "value"].df


register("expr_filter", f"SELECT event_id, v FROM {E_SQL} WHERE y > 50")(lambda spark, sf_dir: events(spark, sf_dir).select(col("event_id").filter(y > 50), v.filter(y > 50)).df)
register("expr_dropna", f"SELECT v FROM {E_SQL} WHERE v IS NOT NULL")(lambda spark, sf_dir: events(spark, sf_dir).select(v.dropna()).df)
register("filtered_aggregates", f"SELECT event_type, round(avg(v) FILTER (WHERE y > 50), 6) + 0.0 AS m, count(y) FILTER (WHERE v > 30) AS n FROM {E_SQL} GROUP BY 1")(
    lambda spark, sf_dir: events(spark, sf_dir).groupby("event_type").agg(m=v.filter(y > 50).mean(), n=y.filter(v > 30).count_valid()).select("event_type", rounded("m"), "n")
)
register("scan_filter", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount <= 0.05 AND l_tax >= 0.01")(
    lambda spark, sf_dir: lineitem(spark, sf_dir).filter((col("l_quantity") > 45) & (col("l_discount") <= 0.05)).filter(lit(0.01) <= col("l_tax")).select("l_orderkey", "l_quantity").df
)
register("is_inf_log", f"SELECT event_id, y = 50 AS inf, round(CASE WHEN y > 50 THEN ln(y - 50) / ln(3) WHEN y = 50 THEN '-inf'::DOUBLE END, 6) + 0.0 AS l FROM (SELECT event_id, coalesce(y, -1) AS y FROM {E_SQL})")(
    lambda spark, sf_dir: events(spark, sf_dir).with_columns(l=(y.fillna(value=-1.0) - 50).log(3)).with_columns(inf=col("l").is_inf()).df.select("event_id", "inf", rounded("l"))
)

# times
register("time_arithmetic", "SELECT event_id, ts + INTERVAL 90 MINUTE AS a, ts - INTERVAL 1 MONTH AS b, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 12:30:00') AS c, ts > TIMESTAMP '2024-01-15' AS d, (3600000000 - 60000000 * 2)::BIGINT AS e, date_trunc('millisecond', ts)::TIMESTAMP AS f, ts + to_microseconds(event_id * 1000) AS g FROM events")(
    lambda spark, sf_dir: (
        events(spark, sf_dir)
        .select(
            "event_id", a=col("ts") + timedelta("1h") + timedelta("30m"), b=col("ts") - timedelta("1mo"), c=(col("ts") - datetime("2024-01-01 12:30", "%Y-%m-%d %H:%M")).cast("i64"), d=col("ts") > datetime("2024-01-15"),
            e=((lit(3_600_000_000).cast("timedelta")) - (lit(120_000_000).cast("timedelta"))).cast("i64"), f=col("ts").cast("datetime(ms)"), g=col("ts") + (col("event_id") * 1000).cast("timedelta"),
        ).df
    )
)

# matrices
register("matrix_products", "WITH m AS (SELECT vec_id, list_transform(range(0, 4), lambda i: list_transform(range(0, 4), lambda j: embedding[i * 4 + j + 1]::DOUBLE)) AS m FROM embeddings) SELECT vec_id, list_transform(range(1, 5), lambda i: list_transform(range(1, 5), lambda j: round(list_sum(list_transform(range(1, 5), lambda k: m[i][k] * m[j][k])), 6) + 0.0)) AS mm, list_transform(range(1, 5), lambda i: round(list_sum(list_transform(range(1, 5), lambda k: m[i][k] * m[1][k])), 6) + 0.0) AS mv, [4, 4]::INTEGER[] AS shape FROM m")(
    lambda spark, sf_dir: _products(spark, sf_dir)
)


def _products(spark, sf_dir) -> DataFrame:
    f = TideFrame(table(spark, sf_dir, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 16).alias("e")), "vec_id").with_columns(m=col("e").reshape(4))
    m = col("m")
    out = f.with_columns(mm=m @ m.conjugate(), mv=m @ m.get(0), shape=m.shape()).df
    near = lambda a: F.transform(a, lambda x: F.round(x, 6) + 0.0)
    return out.select("vec_id", F.transform("mm", near).alias("mm"), near("mv").alias("mv"), "shape")


# regressions in full
register("ols_figures", f"""WITH g AS (SELECT event_type, count(*) AS n, regr_slope(v, y) AS b1, regr_intercept(v, y) AS b0, regr_syy(v, y) - regr_slope(v, y) * regr_sxy(v, y) AS sse, regr_sxx(v, y) AS sxx, avg(y) AS my, sum(y) AS sy, sum(y * y) AS syy FROM {E_SQL} WHERE v IS NOT NULL AND y IS NOT NULL GROUP BY 1),
  e AS (SELECT *, (n + syy + sqrt((n - syy) * (n - syy) + 4 * sy * sy)) / 2 AS top FROM g)
  SELECT event_type, n, round(b0, 6) + 0.0 AS b0, round(b1, 6) + 0.0 AS b1, round(sse, 2) AS sse, round(b0 / sqrt(sse / (n - 2) * (1.0 / n + my * my / sxx)), 5) + 0.0 AS t0, round(b1 / sqrt(sse / (n - 2) / sxx), 5) + 0.0 AS t1, 2::INTEGER AS rank, round(sqrt(top), 4) AS s0, round(sqrt((n * syy - sy * sy) / top), 4) AS s1 FROM e""")(
    lambda spark, sf_dir: (
        linalg.ols_by(events(spark, sf_dir).df, ["event_type"], "v", ["y"])
        .select("event_type", "n", *[F.round(F.col(c)[i], d).alias(f"{a}{i}") for c, a, d in (("params", "b", 6), ("tvalues", "t", 5), ("singular", "s", 4)) for i in (0, 1)], F.round("sse", 2).alias("sse"), "rank")
    )
)
register("ols_residuals", f"WITH f AS (SELECT event_type, regr_slope(v, y) AS b1, regr_intercept(v, y) AS b0 FROM {E_SQL} WHERE v IS NOT NULL AND y IS NOT NULL GROUP BY 1) SELECT event_id, round(b0 + b1 * y, 6) + 0.0 AS fitted, round(v - b0 - b1 * y, 6) + 0.0 AS resid FROM {E_SQL} JOIN f USING (event_type)")(
    lambda spark, sf_dir: linalg.residuals_by(events(spark, sf_dir).df, ["event_type"], "v", ["y"], ["event_id"]).select("event_id", rounded("fitted"), rounded("resid"))
)
register("newey_west", f"""WITH r AS (SELECT user_id, y, v - 40 AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM {E_SQL} WHERE v IS NOT NULL AND y IS NOT NULL)
  SELECT a.user_id, round(sum(w * a.e * b.e), 2) + 0.0 AS m00, round(sum(w * (a.e * b.e * b.y + a.e * a.y * b.e) / 2), 1) + 0.0 AS m01, round(sum(w * a.e * a.y * b.e * b.y), 0) + 0.0 AS m11
  FROM (SELECT a, b, CASE WHEN a.rn = b.rn THEN 1 ELSE 2 * (1 - (a.rn - b.rn) / 4) END AS w FROM r a JOIN r b ON a.user_id = b.user_id AND a.rn - b.rn BETWEEN 0 AND 3) GROUP BY 1""")(lambda spark, sf_dir: _newey_west(spark, sf_dir))  # fmt: skip


def _newey_west(spark, sf_dir) -> DataFrame:
    df = events(spark, sf_dir).with_columns(one=lit(1.0), e=v - 40).df
    m = linalg.newey_west_by(df, ["user_id"], ["one", "y"], "e", 3, ["ts", "event_id"])
    cell = lambda i, j, d: (F.round(F.get(F.get("meat", F.lit(i)), F.lit(j)), d) + 0.0).alias(f"m{i}{j}")
    return m.select("user_id", cell(0, 0, 2), cell(0, 1, 1), cell(1, 1, 0))


@expr_method
def spread_of(e, window: int):
    """Registered as a method of expressions: the range of a window."""
    return e.ts_max(window) - e.ts_min(window)


register("registered_method", f"SELECT event_id, round(max(v) OVER w - min(v) OVER w, 6) + 0.0 AS r FROM {E_SQL} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 6 PRECEDING)")(
    lambda spark, sf_dir: events(spark, sf_dir).with_columns(r=v.spread_of(7)).df.select("event_id", rounded("r"))
)
register("mark_star", "SELECT event_id, CASE WHEN p < 0 OR p > 1 THEN 'Invalid' ELSE printf('%.2f', x) || CASE WHEN p <= 0.01 THEN '***' WHEN p <= 0.05 THEN '**' WHEN p <= 0.1 THEN '*' ELSE '' END END || chr(13) || chr(10) || '(' || printf('%.2f', t) || ')' AS s FROM (SELECT event_id, (event_id % 1000) / 7 AS x, (event_id % 77) / 4 - 9 AS t, (event_id % 130 - 10) / 100 AS p FROM events)")(
    lambda spark, sf_dir: table(spark, sf_dir, "events").select("event_id", linalg.mark_star(F.col("event_id") % 1000 / 7, (F.col("event_id") % 130 - 10) / 100, 2, F.col("event_id") % 77 / 4 - 9).alias("s"))
)

# joins and alignment
register("inner_join", "SELECT a.o_orderkey, a.o_totalprice, b.o_totalprice AS o_totalprice_right FROM orders a JOIN (SELECT * FROM orders WHERE o_orderkey % 3 = 0) b ON a.o_orderkey = b.o_orderkey")(lambda spark, sf_dir: _inner(spark, sf_dir))


def _inner(spark, sf_dir) -> DataFrame:
    f = TideFrame(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    return f.join(f.filter(asexpr(F.col("o_orderkey") % 3 == 0)), on="o_orderkey", how="inner").df


def _pair(spark, sf_dir) -> tuple[TideFrame, TideFrame]:
    k = lambda c: (F.col(c) % 4).alias("j")
    a = TideFrame(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), k("c_custkey"), F.col("c_acctbal").alias("x")), "c_custkey")
    return a, TideFrame(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), k("s_suppkey"), F.col("s_acctbal").alias("x")), "s_suppkey")


_BOTH = """WITH a AS (SELECT c_nationkey AS k, c_custkey % 4 AS j, c_acctbal AS x, c_custkey AS c, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer), b AS (SELECT s_nationkey AS k, s_suppkey % 4 AS j, s_acctbal AS x, s_suppkey AS s, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier),
  u AS (SELECT k, j FROM a UNION SELECT k, j FROM b), p AS (SELECT k, j, arg_min(x, c) AS x, min(c) AS c, min(i) AS i FROM a GROUP BY ALL), q AS (SELECT k, j, arg_max(x, s) AS x, max(s) AS s, max(i) AS i FROM b GROUP BY ALL)"""
register("align_frames_keys", f"{_BOTH} SELECT k, j, p.c AS c_custkey__align_by0, p.x AS x__align_by0, q.s AS s_suppkey__align_by1, q.x AS x__align_by1 FROM u LEFT JOIN p USING (k, j) LEFT JOIN q USING (k, j)")(
    lambda spark, sf_dir: joins.align_frames(_pair(spark, sf_dir), ["k", "j"], outer_df=True).df
)
register("align_frames_idx", f"{_BOTH} SELECT k, j, p.i AS idx0, q.i AS idx1 FROM u LEFT JOIN p USING (k, j) LEFT JOIN q USING (k, j)")(lambda spark, sf_dir: joins.get_align_frames_idx(_pair(spark, sf_dir), ["k", "j"], return_by=True).df)

# sources
register("arange_full", "SELECT range AS i, 2 + range * 0.25 AS value, 7 AS seven, range % 3 + 0.5 AS listed FROM range(0, 12)")(lambda spark, sf_dir: _ranges(spark))


def _ranges(spark) -> DataFrame:
    f = io.arange(spark, 2, 5, 0.25).join(io.full(spark, 12, 7, "seven"), on="i", unique=True)
    (listed,) = asexprs([[k % 3 + 0.5 for k in range(12)]])
    return f.with_columns(listed=listed).df


register("scan_ipc", "SELECT c_custkey, c_name, c_mktsegment FROM customer")(lambda spark, sf_dir: _ipc(spark, sf_dir))


def _ipc(spark, sf_dir) -> DataFrame:
    """customer written as an Arrow IPC file and scanned by name, index and negative index."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}"
    path = f"{folder.rstrip('/')}/customer-{os.getpid()}-{uuid.uuid4().hex}.arrow"
    io.write_ipc(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), path)
    try:
        return spark.createDataFrame(io.scan_ipc(spark, path, ["c_custkey", 1, -1], order="c_custkey").df.toArrow())
    finally:
        fs, name = pa.fs.FileSystem.from_uri(path)
        fs.delete_file(name)


register("eager_functions", f"SELECT round(coalesce(sum(v), 0), 4) AS s, round(avg(v), 6) AS m, round(stddev_samp(v), 6) AS sd, round(quantile_cont(v, 0.5), 6) AS md, count(v) AS n FROM {LI}")(lambda spark, sf_dir: _eager(spark, sf_dir))


def _eager(spark, sf_dir) -> DataFrame:
    """The module functions on expressions, inside one aggregation."""
    f = lineitem(spark, sf_dir).with_columns(one=lit(1))
    row = f.groupby("one").agg(s=eager.sum(v), m=eager.mean(v), sd=eager.std(v), md=eager.median(v), n=eager.count_notnan(v))
    return row.select(rounded("s", 4), rounded("m"), rounded("sd"), rounded("md"), "n")
