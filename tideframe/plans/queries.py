"""The engine's registered queries, each with the SQL that must give the same rows.

Missing values are put in by rule in both (every seventh event's value), as the tables have none. Doubles are rounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.operators import equity, joins, linalg
from tideframe.operators.frame import TideFrame
from tideframe.plans.catalog import register
from tideframe.plans.expr import Expr, col, horizontal, lit, where

N = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> TideFrame:
    df = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    df = df.withColumn("v", F.when(F.col("event_id") % 7 != 0, F.col("value"))).withColumn("y", F.when(F.col("event_id") % 11 != 0, (F.col("event_id") * 37 % 101).cast("double")))
    return TideFrame(df, ("ts", "event_id"), "user_id")


E_SQL = "(SELECT event_id, ts, user_id, event_type, value, CASE WHEN event_id % 7 <> 0 THEN value END AS v, CASE WHEN event_id % 11 <> 0 THEN (event_id * 37 % 101)::DOUBLE END AS y FROM events)"
W = f"WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS {N - 1} PRECEDING), o AS (PARTITION BY user_id ORDER BY ts, event_id), p AS (PARTITION BY user_id), c AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def rounded(c: str, digits: int = 6):
    return (F.round(F.col(c), digits) + 0.0).alias(c)


def nudge(digits: int) -> float:
    """Added before rounding where values are short decimals, which would often lie half way between two results."""
    return 0.37 * 10.0**-digits


def _each_row(name: str, expr: Expr, sql: str, digits: int | None = 6) -> None:
    """A query that gives expr for every event beside a SQL expression over E_SQL."""
    out = f"round(({sql}) + {nudge(digits):.10f}, {digits}) + 0.0" if digits is not None else sql

    @register(name, f"SELECT event_id, {out} AS r FROM {E_SQL} {W}")
    def run(spark, sf_dir):
        df = events(spark, sf_dir).with_columns(r=expr).df
        return df.select("event_id", (F.round(F.col("r") + nudge(digits), digits) + 0.0).alias("r") if digits is not None else "r")


v, y = col("v"), col("y")
LIST = "list(v) FILTER (WHERE v IS NOT NULL) OVER w"
SUMK = f"list_sum(list_transform({LIST}, lambda x, i: x * i))"
CNT = "count(v) OVER w"
SLOPE = f"((12 * {SUMK} - 6 * ({CNT} + 1) * sum(v) OVER w) / nullif({CNT} * ({CNT} * {CNT} - 1.0), 0))"
ICPT = f"(sum(v) OVER w / nullif({CNT}, 0) - {SLOPE} * ({CNT} + 1) / 2)"
PX, PY = "(CASE WHEN y IS NOT NULL THEN v END)", "(CASE WHEN v IS NOT NULL THEN y END)"
nan = lambda x: f"(CASE WHEN NOT isnan({x}) THEN {x} END)"

for _name, _sql, _d in [
    ("ts_sum", "sum(v) OVER w", 6), ("ts_mean", "avg(v) OVER w", 6), ("ts_std", "stddev_samp(v) OVER w", 6), ("ts_var", "var_samp(v) OVER w", 5),
    ("ts_min", "min(v) OVER w", 6), ("ts_max", "max(v) OVER w", 6), ("ts_skew", "skewness(v) OVER w", 4), ("ts_kurt", "kurtosis(v) OVER w", 4),
    ("ts_zscore", "(v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0)", 5), ("ts_minmaxnorm", "(v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0)", 6),
    ("ts_wma", f"{SUMK} / ({CNT} * ({CNT} + 1) / 2.0)", 6),
    ("ts_ewm", f"list_sum(list_transform({LIST}, lambda x, i: x * pow(0.9, {CNT} - i))) / list_sum(list_transform({LIST}, lambda x, i: pow(0.9, {CNT} - i)))", 6),
    ("ts_rank", f"CASE WHEN v IS NOT NULL THEN len(list_filter({LIST}, lambda x: x < v)) + (len(list_filter({LIST}, lambda x: x = v)) + 1) / 2.0 END", 6),
    ("ts_reg", f"CASE WHEN {CNT} >= 2 THEN {ICPT} + {SLOPE} * {CNT} END", 4), ("ts_tsf", f"CASE WHEN {CNT} >= 2 THEN {ICPT} + {SLOPE} * ({CNT} + 1) END", 4),
    ("ts_reg_slope", f"CASE WHEN {CNT} >= 2 THEN {SLOPE} END", 5), ("ts_reg_intercept", f"CASE WHEN {CNT} >= 2 THEN {ICPT} END", 4),
]:
    _each_row(_name, getattr(v, _name)(N), _sql, _d)
_each_row("ts_rank_pct", v.ts_rank(N, pct=True, rev=True), f"CASE WHEN v IS NOT NULL THEN (len(list_filter({LIST}, lambda x: x > v)) + (len(list_filter({LIST}, lambda x: x = v)) + 1) / 2.0) / {CNT} END")
_each_row("ts_sum_min_periods", v.ts_sum(N, min_periods=5), f"CASE WHEN {CNT} >= 5 THEN sum(v) OVER w END")
_each_row("ts_prod", (v / 100).ts_prod(5), "product(v / 100) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING)", 4)
_each_row("ts_reg_resid_mean", v.ts_reg_resid_mean(N), f"CASE WHEN {CNT} >= 2 THEN 0.0 END", 4)
for _name, _pick, _sign in [("ts_argmax", "max", ""), ("ts_argmin", "min", "-")]:
    register(
        _name,
        f"""SELECT event_id, CASE WHEN count(v) OVER w >= 1 THEN ({_sign}({_pick}(CASE WHEN v IS NOT NULL THEN struct_pack(a := v, b := {_sign}rn) END) OVER w).b - min(rn) OVER w + 1)::BIGINT END AS r
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM {E_SQL}) {W}""",
    )(lambda spark, sf_dir, e=getattr(v, _name)(N): events(spark, sf_dir).with_columns(r=e).df.select("event_id", "r"))
for _name, _sql, _d in [
    ("ts_cov", f"covar_samp({PX}, {PY}) OVER w", 4),
    ("ts_corr", f"CASE WHEN var_pop({PX}) OVER w > 1e-14 AND var_pop({PY}) OVER w > 1e-14 THEN covar_pop({PX}, {PY}) OVER w / (sqrt(var_pop({PX}) OVER w) * sqrt(var_pop({PY}) OVER w)) END", 6),
    ("ts_regx_beta", nan(f"(regr_slope({PX}, {PY}) OVER w)"), 5), ("ts_regx_alpha", nan(f"(regr_intercept({PX}, {PY}) OVER w)"), 4),
    ("ts_regx_resid_std", nan(f"sqrt(greatest(regr_syy({PX}, {PY}) OVER w - (regr_slope({PX}, {PY}) OVER w) * (regr_sxy({PX}, {PY}) OVER w), 0) / nullif(count({PX}) OVER w - 1, 0))"), 4),
    ("ts_regx_resid_mean", "CASE WHEN isnan(regr_slope(%s, %s) OVER w) THEN NULL ELSE 0.0 END" % (PX, PY), 4),
]:
    _each_row(_name, getattr(v, _name)(y, N), f"CASE WHEN count({PX}) OVER w >= 2 THEN {_sql} END", _d)


@register("ts_regx_resid_skew", f"""WITH w AS (SELECT event_id, list({PX}) FILTER (WHERE {PX} IS NOT NULL) OVER w AS a, list({PY}) FILTER (WHERE {PX} IS NOT NULL) OVER w AS b FROM {E_SQL} {W}),
  m AS (SELECT event_id, a, b, len(a) AS n, list_avg(a) AS ma, list_avg(b) AS mb FROM w),
  f AS (SELECT *, list_sum(list_transform(a, lambda x, i: (x - ma) * (b[i] - mb))) / nullif(list_sum(list_transform(b, lambda x: (x - mb) * (x - mb))), 0) AS beta FROM m),
  r AS (SELECT event_id, n, list_transform(a, lambda x, i: x - ma - beta * (b[i] - mb)) AS e FROM f),
  s AS (SELECT event_id, n, list_sum(list_transform(e, lambda x: x * x)) / n AS m2, list_sum(list_transform(e, lambda x: x * x * x)) / n AS m3 FROM r)
  SELECT event_id, round(CASE WHEN n >= 3 AND m2 > 1e-14 THEN sqrt(n * (n - 1.0)) / (n - 2) * m3 / pow(m2, 1.5) END, 4) + 0.0 AS r FROM s""")  # fmt: skip
def ts_regx_resid_skew(spark, sf_dir):
    return events(spark, sf_dir).with_columns(r=v.ts_regx_resid_skew(y, N)).df.select("event_id", rounded("r", 4))


# general rolling
for _name, _expr, _sql, _d in [
    ("rolling_quantile", v.rolling(N).quantile(0.25), "quantile_cont(v, 0.25) OVER w", 6), ("rolling_median", v.rolling(N).median(), "quantile_cont(v, 0.5) OVER w", 6),
    ("rolling_weight_mean", v.rolling(N).weight_mean(y), "CASE WHEN count(CASE WHEN y IS NOT NULL THEN v END) OVER w >= 1 THEN sum(v * y) OVER w / nullif(sum(y) OVER w, 0) END", 5),
    ("rolling_cut_mean", v.rolling(N).cut_mean(y > 50), "avg(CASE WHEN y > 50 THEN v END) OVER w", 6),
    ("rolling_valid_first", v.rolling(N).valid_first(), "first_value(v IGNORE NULLS) OVER w", 6), ("rolling_valid_last", v.rolling(N).valid_last(), "last_value(v IGNORE NULLS) OVER w", 6),
    ("rolling_first", v.rolling(N).first(), "first_value(v) OVER w", 6), ("rolling_last", v.rolling(N).last(), "last_value(v) OVER w", 6),
    ("rolling_apply", v.rolling(N).apply(v.sum() / v.count_valid() + y.max()), f"coalesce(sum(v) OVER w, 0) / nullif({CNT}, 0) + max(y) OVER w", 6),
    ("rolling_12h_mean", v.rolling("12h", time="ts").mean(), "avg(v) OVER (PARTITION BY user_id ORDER BY ts RANGE INTERVAL '43199.999999' SECOND PRECEDING)", 6),
    ("rolling_12h_ties_max", v.rolling("12h", time="ts", unique_times=False).max(), "max(v) OVER (PARTITION BY user_id ORDER BY ts RANGE INTERVAL '43199.999999' SECOND PRECEDING)", 6),
    ("rolling_bucket_start_max", v.rolling("1d", time="ts", start_by="duration_start").max(), "max(v) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)", 6),
]:
    _each_row(_name, _expr, _sql, _d)


@register("rolling_1mo_min", """SELECT a.o_orderkey, min(b.o_totalprice) AS r FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate + INTERVAL 1 MONTH > a.o_orderdate
  AND (b.o_orderdate, b.o_orderkey) <= (a.o_orderdate, a.o_orderkey) GROUP BY a.o_orderkey""")  # fmt: skip
def rolling_1mo_min(spark, sf_dir):
    f = TideFrame(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"), ("o_orderdate", "o_orderkey"), "o_custkey")
    return f.with_columns(r=col("o_totalprice").rolling("1mo", time="o_orderdate", unique_times=False).min()).df.select("o_orderkey", "r")


@register("rolling_offset_sum", f"""WITH e AS (SELECT event_id, user_id, date_trunc('day', ts) AS d, value FROM events), u AS (SELECT user_id, d, arg_min(value, event_id) AS value FROM e GROUP BY ALL)
SELECT e.event_id, round(coalesce(sum(u.value), 0), 4) + 0.0 AS r FROM e LEFT JOIN u ON e.user_id = u.user_id AND date_diff('day', u.d, e.d) BETWEEN 0 AND 3 GROUP BY e.event_id""")  # fmt: skip
def rolling_offset_sum(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("d"), "value")
    return joins.rolling_offset(TideFrame(df, "event_id", "user_id"), "value", "d", "3d", "1d", "r").df.select("event_id", rounded("r", 4))


# order-dependent and whole-partition operations
for _name, _expr, _sql, _d in [
    ("shift", v.shift(2, fill=-1.0), "lag(v, 2, -1.0) OVER o", 6), ("shift_lead", v.shift(-1), "lead(v, 1) OVER o", 6), ("diff", v.diff(1), "v - lag(v) OVER o", 6),
    ("diff_fill", v.diff(2, fill=0.0), "CASE WHEN row_number() OVER o <= 2 THEN 0.0 ELSE v - lag(v, 2) OVER o END", 6), ("pct_change", v.pct_change(1), "v / nullif(lag(v) OVER o, 0) - 1", 5),
    ("cumsum", v.cumsum(), "CASE WHEN v IS NOT NULL THEN sum(v) OVER c END", 4), ("cumprod", (v / (v + 1)).cumprod(), "CASE WHEN v IS NOT NULL THEN product(v / nullif(v + 1, 0)) OVER c END", 6),
    ("ffill", v.fillna("ffill", 0.0), "coalesce(last_value(v IGNORE NULLS) OVER c, 0.0)", 6), ("bfill", v.fillna("bfill", 0.0), "coalesce(first_value(v IGNORE NULLS) OVER f, 0.0)", 6),
    ("fill_value", v.fillna(value=-9.0), "coalesce(v, -9.0)", 6), ("clip", v.clip(20.0, 80.0), "CASE WHEN v > 80 THEN 80.0 WHEN v < 20 THEN 20.0 ELSE v END", 6),
    ("zscore", v.zscore(), "CASE WHEN count(v) OVER p >= 3 THEN (v - avg(v) OVER p) / nullif(stddev_samp(v) OVER p, 0) END", 5),
    ("winsorize_quantile", v.winsorize("quantile", 0.05), "CASE WHEN v > quantile_cont(v, 0.95) OVER p THEN quantile_cont(v, 0.95) OVER p WHEN v < quantile_cont(v, 0.05) OVER p THEN quantile_cont(v, 0.05) OVER p ELSE v END", 5),
    ("winsorize_median", v.winsorize("median", 1.0), "CASE WHEN v > quantile_cont(v, 0.5) OVER p + mad(v) OVER p THEN quantile_cont(v, 0.5) OVER p + mad(v) OVER p WHEN v < quantile_cont(v, 0.5) OVER p - mad(v) OVER p THEN quantile_cont(v, 0.5) OVER p - mad(v) OVER p ELSE v END", 5),
    ("winsorize_sigma", v.winsorize("sigma", 1.2), "CASE WHEN v > avg(v) OVER p + 1.2 * stddev_samp(v) OVER p THEN avg(v) OVER p + 1.2 * stddev_samp(v) OVER p WHEN v < avg(v) OVER p - 1.2 * stddev_samp(v) OVER p THEN avg(v) OVER p - 1.2 * stddev_samp(v) OVER p ELSE v END", 5),
    ("rank", v.rank(), "CASE WHEN v IS NOT NULL THEN rank() OVER (PARTITION BY user_id ORDER BY v NULLS LAST) + (count(*) OVER (PARTITION BY user_id, v) - 1) / 2.0 END", 6),
    ("rank_rev_pct", v.rank(pct=True, rev=True), "CASE WHEN v IS NOT NULL THEN (rank() OVER (PARTITION BY user_id ORDER BY v DESC NULLS LAST) + (count(*) OVER (PARTITION BY user_id, v) - 1) / 2.0) / count(v) OVER p END", 6),
    ("split_group", v.split_group(10), "coalesce(ceil(((rank() OVER (PARTITION BY user_id ORDER BY v NULLS LAST) + (count(*) OVER (PARTITION BY user_id, v) - 1) / 2.0) * 10) / nullif(count(v) OVER p, 0) * CASE WHEN v IS NULL THEN NULL ELSE 1 END), 0)::BIGINT", None),
    ("argsort", v.argsort(), "row_number() OVER (PARTITION BY user_id ORDER BY v NULLS LAST, ts, event_id) - 1", None),
    ("where", where(v > 50, v, lit(0.0)), "CASE WHEN v > 50 THEN v ELSE 0.0 END", 6), ("put_mask", v.put_mask(y > 50, 1.0), "CASE WHEN y > 50 THEN 1.0 ELSE v END", 6),
    ("if_then", v.if_then(v.mean() > 50, y), "CASE WHEN avg(v) OVER p > 50 THEN y ELSE v END", 6), ("is_in", col("event_type").is_in(["click", "view"]), "event_type IN ('click', 'view')", None),
    ("is_nan", v.is_nan(), "v IS NULL", None), ("arithmetic", (v + y) * 2 / (y + 1) - v**2, "(v + y) * 2 / (y + 1) - v * v", 4), ("first_last", v.last() - v.first(), "first_value(v) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - first_value(v) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", 6),
    ("strftime", col("ts").strftime("%Y-%m-%d %H:%M"), "strftime(ts, '%Y-%m-%d %H:%M')", None), ("strptime", col("ts").strftime("%Y-%m-%d").strptime("%Y-%m-%d"), "date_trunc('day', ts)::TIMESTAMP", None),
    ("offset_by", col("ts").offset_by("1mo2d-3h"), "ts + INTERVAL 1 MONTH + INTERVAL 2 DAY - INTERVAL 3 HOUR", None),
]:
    _each_row(_name, _expr, _sql, _d)
_UNARY = {"sqrt": "sqrt(v)", "cbrt": "cbrt(v)", "ln": "ln(v)", "ln_1p": "ln(1 + v)", "log2": "log2(v)", "log10": "log10(v)", "sin": "sin(v)", "cos": "cos(v)", "tan": "tan(v)", "atan": "atan(v)", "ceil": "ceil(v)", "floor": "floor(v)", "trunc": "trunc(v)", "fract": "v - trunc(v)", "sign": "sign(v)", "abs": "abs(v)"}
# what is out of an operation's domain is missing, but for logarithms of nothing
_DOMAIN = {"sqrt": "v >= 0", "ln": "v > 0", "ln_1p": "v > -1", "log2": "v > 0", "log10": "v > 0"}
_LOWEST = {"ln": "v = 0", "ln_1p": "v = -1", "log2": "v = 0", "log10": "v = 0"}


def _guarded(name: str, sql: str) -> str:
    low = f" WHEN {_LOWEST[name]} THEN '-inf'::DOUBLE" if name in _LOWEST else ""
    return f"CASE WHEN {_DOMAIN.get(name, 'true')} THEN {sql}{low} END"


# of every event: its value, and a number of any sign, 0 and -1 among them, in u
@register("math_unary", f"""WITH e AS (SELECT event_id, v, y - 50 AS u FROM {E_SQL}), a AS (SELECT event_id, v, {', '.join(f'round({_guarded(n, q)}, 4) + 0.0 AS {n}' for n, q in _UNARY.items())},
  round(exp(v / 100), 6) AS exp, round(pow(2, v / 100), 6) AS exp2, round(exp(v / 100) - 1, 6) AS exp_m1, round(asin(v / 1000), 6) AS asin, round(acos(v / 1000), 6) AS acos FROM e),
  b AS (SELECT event_id, {', '.join(f'round({_guarded(n, q)}, 4) + 0.0 AS u_{n}' for n, q in _UNARY.items())}, round(CASE WHEN abs(v) <= 25 THEN asin(v / 25) END, 6) + 0.0 AS u_asin,
  round(CASE WHEN abs(v) <= 25 THEN acos(v / 25) END, 6) + 0.0 AS u_acos, round(CASE WHEN v > 0 THEN ln(v) / ln(7) WHEN v = 0 THEN '-inf'::DOUBLE END, 6) + 0.0 AS u_log FROM (SELECT event_id, u AS v FROM e))
  SELECT a.* EXCLUDE (v), b.* EXCLUDE (event_id) FROM a JOIN b USING (event_id)""")  # fmt: skip
def math_unary(spark, sf_dir):
    f, u = events(spark, sf_dir).with_columns(u=y - 50), col("u")
    small = {n: getattr(v / 100, n)() for n in ("exp", "exp2", "exp_m1")} | {n: getattr(v / 1000, n)() for n in ("asin", "acos")}
    signed = {f"u_{n}": getattr(u, n)() for n in _UNARY}
    narrow = {"u_asin": (u / 25).asin(), "u_acos": (u / 25).acos(), "u_log": u.log(7)}
    df = f.with_columns(**{n: getattr(v, n)() for n in _UNARY}, **small, **signed, **narrow).df
    return df.select("event_id", *[rounded(n, 4) for n in (*_UNARY, *signed)], *[rounded(n) for n in (*small, *narrow)])


@register("cast_round_finite", f"SELECT event_id, v::INTEGER::BIGINT AS a, round(v, 2) AS b, v IS NOT NULL AS c, event_id::VARCHAR AS d, round(pow(v, 0.5), 4) AS e FROM (SELECT event_id, trunc(v) + 0.25 AS v FROM {E_SQL})")
def cast_round_finite(spark, sf_dir):
    x = v.trunc() + 0.25
    return events(spark, sf_dir).select("event_id", a=x.cast("i64"), b=x.round(2), c=x.is_finite(), d=col("event_id").cast("str"), e=(x**0.5)).df.select("event_id", "a", rounded("b", 2), "c", "d", rounded("e", 4))


@register("datetime_diff", f"SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER o))::BIGINT AS r FROM {E_SQL} {W}")
def datetime_diff(spark, sf_dir):
    f = events(spark, sf_dir).with_columns(b=col("ts").shift(1))
    return f.select("event_id", r=(col("ts") - col("b")).cast("i64")).df


@register("ts_flagship", f"SELECT event_id, user_id, round(avg(value) OVER w, 6) AS mean, round(stddev_samp(value) OVER w, 6) AS std, round((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 5) + 0.0 AS z FROM events {W}")
def ts_flagship(spark, sf_dir):
    x = col("value")
    df = events(spark, sf_dir).with_columns(mean=x.ts_mean(N), std=x.ts_std(N), z=x.ts_zscore(N)).df
    return df.select("event_id", "user_id", rounded("mean"), rounded("std"), rounded("z", 5))


# aggregates and groups
LI = "(SELECT *, CASE WHEN l_partkey % 7 <> 0 THEN l_extendedprice END AS v FROM lineitem)"


def lineitem(spark, sf_dir) -> TideFrame:
    df = table(spark, sf_dir, "lineitem").withColumn("v", F.when(F.col("l_partkey") % 7 != 0, F.col("l_extendedprice")))
    return TideFrame(df, ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"))


@register("group_basic_stats", f"""SELECT l_returnflag, l_linenumber, round(sum(v), 2) AS s, round(avg(v), 4) AS m, round(stddev_samp(v), 4) AS sd, round(var_samp(v), 0) AS vr, min(v) AS lo, max(v) AS hi, count(v) AS n, count(*) - count(v) AS miss, count(*) AS rows,
  round(skewness(v), 4) AS sk, round(kurtosis(v), 4) AS ku, round(quantile_cont(v, 0.3), 4) AS q, round(median(v), 4) AS md, bool_or(l_quantity > 49) AS a, bool_and(l_quantity > 0) AS b, count(*) FILTER (WHERE l_linestatus = 'O') AS cv
  FROM {LI} GROUP BY ALL""")  # fmt: skip
def group_basic_stats(spark, sf_dir):
    out = lineitem(spark, sf_dir).groupby("l_returnflag", "l_linenumber").agg(
        s=v.sum(), m=v.mean(), sd=v.std(), vr=v.var(), lo=v.min(), hi=v.max(), n=v.count_valid(), miss=v.count_none(), rows=v.len(), sk=v.skew(), ku=v.kurt(), q=v.quantile(0.3), md=v.median(),
        a=(col("l_quantity") > 49).any(), b=(col("l_quantity") > 0).all(), cv=col("l_linestatus").count_value("O"))
    digits = {"s": 2, "m": 4, "sd": 4, "vr": 0, "sk": 4, "ku": 4, "q": 4, "md": 4}
    return out.select(*[rounded(c, digits[c]) if c in digits else c for c in out.columns])


@register("group_first_last", f"SELECT user_id, arg_min(value, event_id) AS a, arg_max(value, event_id) AS b, arg_min(v, event_id) FILTER (WHERE v IS NOT NULL) AS c, arg_max(v, event_id) FILTER (WHERE v IS NOT NULL) AS d FROM {E_SQL} GROUP BY user_id")
def group_first_last(spark, sf_dir):
    f = TideFrame(events(spark, sf_dir).df, "event_id")
    x = col("value")
    return f.groupby("user_id").agg(a=x.first(), b=x.last(), c=v.valid_first(), d=v.valid_last())


@register("group_corr_cov", f"SELECT event_type, round(covar_samp({PX}, {PY}), 4) + 0.0 AS c, round(corr({PX}, {PY}), 6) + 0.0 AS r, round(sum(v) / stddev_samp(y), 4) + 0.0 AS e, round(sum(v * y) / sum(y), 4) AS wm, round(avg(CASE WHEN y > 50 THEN v END), 4) AS cm FROM {E_SQL} GROUP BY event_type")
def group_corr_cov(spark, sf_dir):
    out = events(spark, sf_dir).groupby("event_type").agg(c=v.cov(y), r=v.corr(y), e=v.sum() / y.std(), wm=v.weight_mean(y), cm=v.cut_mean(y > 50))
    return out.select("event_type", rounded("c", 4), rounded("r"), rounded("e", 4), rounded("wm", 4), rounded("cm", 4))


for _m, _sql in [("lower", "floor"), ("higher", "ceil")]:
    register(f"group_quantile_{_m}", f"SELECT event_type, round(list_sort(list(v) FILTER (WHERE v IS NOT NULL))[{_sql}(0.3 * (count(v) - 1))::BIGINT + 1], 6) AS r FROM {E_SQL} GROUP BY event_type")(
        lambda spark, sf_dir, m=_m: events(spark, sf_dir).groupby("event_type").agg(r=v.quantile(0.3, m)).select("event_type", rounded("r"))
    )
for _closed, _t in [("left", "ts"), ("right", "ts - INTERVAL 1 MICROSECOND")]:
    register(f"groupby_time_{_closed}", f"SELECT time_bucket(INTERVAL 12 HOUR, {_t}, TIMESTAMP '1970-01-01') AS ts, user_id, round(coalesce(sum(v), 0), 4) AS s, round(avg(v), 6) AS m, count(v) AS n FROM {E_SQL} GROUP BY 1, 2")(
        lambda spark, sf_dir, c=_closed: events(spark, sf_dir).groupby("12h", "user_id", time="ts", closed=c).agg(s=v.sum(), m=v.mean(), n=v.count_valid()).select("ts", "user_id", rounded("s", 4), rounded("m"), "n")
    )


@register("groupby_month", "SELECT (make_date((((year(o_orderdate) * 12 + month(o_orderdate) - 1) // 3) * 3 // 12)::BIGINT, ((((year(o_orderdate) * 12 + month(o_orderdate) - 1) // 3) * 3) % 12 + 1)::BIGINT, 1::BIGINT))::TIMESTAMP AS o_orderdate, round(sum(o_totalprice), 2) AS s, count(*) AS n FROM orders GROUP BY 1")
def groupby_month(spark, sf_dir):
    f = TideFrame(table(spark, sf_dir, "orders"), "o_orderkey")
    out = f.groupby("3mo", time="o_orderdate").agg(s=col("o_totalprice").sum(), n=col("o_totalprice").count_valid())
    return out.select("o_orderdate", rounded("s", 2), "n")


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("corr_pearson_matrix", " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round({'1.0' if a == b else f'corr({a}, {b})'}, 6) + 0.0 AS corr FROM lineitem" + (" LIMIT 1" if False else " GROUP BY ()") for a in _NUM for b in _NUM))
def corr_pearson_matrix(spark, sf_dir):
    return lineitem(spark, sf_dir).corr(*_NUM).select("x", "y", rounded("corr"))


@register("corr_spearman", """WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS b FROM lineitem), c AS (SELECT round(corr(a, b), 6) + 0.0 AS corr FROM r)
SELECT 'l_quantity' AS x, 'l_discount' AS y, corr FROM c UNION ALL SELECT 'l_discount', 'l_quantity', corr FROM c UNION ALL SELECT 'l_quantity', 'l_quantity', 1.0 UNION ALL SELECT 'l_discount', 'l_discount', 1.0""")  # fmt: skip
def corr_spearman(spark, sf_dir):
    return lineitem(spark, sf_dir).corr("l_quantity", "l_discount", method="spearman").select("x", "y", rounded("corr"))


@register("h_sum_mean_std_min_max", f"""SELECT event_id, round(list_sum(l), 6) AS s, round(list_avg(l), 6) AS m, least(v, y, value) AS lo, greatest(v, y, value) AS hi, round(CASE WHEN len(l) >= 3 THEN list_stddev_samp(l) END, 5) AS sd FROM (SELECT *, list_filter([v, y, value], lambda x: x IS NOT NULL) AS l FROM {E_SQL})""")
def h_sum_mean_std_min_max(spark, sf_dir):
    c = [v, y, col("value")]
    std = horizontal("std", *c)
    out = events(spark, sf_dir).select("event_id", s=horizontal("sum", *c), m=horizontal("mean", *c), lo=horizontal("min", *c), hi=horizontal("max", *c), sd=Expr(std.kind, std.args, {"min_periods": 3}))
    return out.df.select("event_id", rounded("s"), rounded("m"), "lo", "hi", rounded("sd", 5))


@register("argmin_argmax", f"SELECT DISTINCT user_id, coalesce(arg_min(rn, (v, rn)) FILTER (WHERE v IS NOT NULL) OVER (PARTITION BY user_id), -1) AS a, coalesce(arg_max(rn, (v, -rn)) FILTER (WHERE v IS NOT NULL) OVER (PARTITION BY user_id), -1) AS b FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM {E_SQL})")
def argmin_argmax(spark, sf_dir):
    return events(spark, sf_dir).groupby("user_id").agg(a=v.argmin(), b=v.argmax())


# relational
@register("select_filter", "SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' AND l_quantity > 45")
def select_filter(spark, sf_dir):
    f = lineitem(spark, sf_dir).filter((col("l_shipdate") < lit("1996-01-01").cast("datetime")) & (col("l_quantity") > 45))
    return f.select("l_orderkey", net=col("l_extendedprice") * (lit(1) - col("l_discount"))).df


@register("dropna_any", f"SELECT event_id FROM {E_SQL} WHERE v IS NOT NULL AND y IS NOT NULL")
def dropna_any(spark, sf_dir):
    return events(spark, sf_dir).dropna(["v", "y"], how="any").df.select("event_id")


@register("dropna_all", f"SELECT event_id FROM {E_SQL} WHERE v IS NOT NULL OR y IS NOT NULL")
def dropna_all(spark, sf_dir):
    return events(spark, sf_dir).dropna(["v", "y"]).df.select("event_id")


@register("sort_desc", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC")
def sort_desc(spark, sf_dir):
    return TideFrame(table(spark, sf_dir, "customer"), "c_custkey").sort("c_acctbal", rev=True).df.select("c_custkey", "c_acctbal")


@register("top_n", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def top_n(spark, sf_dir):
    return TideFrame(table(spark, sf_dir, "customer"), "c_custkey").top(25, "c_acctbal").df.select("c_custkey", "c_acctbal")


@register("partition_topk", f"SELECT event_id, user_id, v FROM {E_SQL} WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY v, ts, event_id) <= 3")
def partition_topk(spark, sf_dir):
    return events(spark, sf_dir).partition_top(2, "v").df.select("event_id", "user_id", "v")


for _keep, _o in [("first", ""), ("last", " DESC")]:
    register(f"unique_{_keep}", f"SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id{_o}) = 1")(
        lambda spark, sf_dir, k=_keep: TideFrame(table(spark, sf_dir, "events"), "event_id").unique(["user_id", "event_type"], k).df.select("event_id", "user_id", "event_type")
    )


@register("sorted_unique", f"SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER o AS b, row_number() OVER o AS rn FROM {E_SQL} {W}) WHERE rn = 1 OR b IS DISTINCT FROM event_type")
def sorted_unique(spark, sf_dir):
    return events(spark, sf_dir).sorted_unique("event_type").df.select("event_id", "event_type")


@register("take_slice", f"SELECT event_id FROM (SELECT *, row_number() OVER o - 1 AS rn, count(*) OVER p AS n FROM {E_SQL} {W}) WHERE rn >= 2 AND rn < n - 1 AND (rn - 2) % 3 = 0")
def take_slice(spark, sf_dir):
    return events(spark, sf_dir).take(slice(2, -1, 3)).df.select("event_id")


@register("take_places", f"WITH p AS (SELECT event_id, row_number() OVER o - 1 AS rn, count(*) OVER p AS n FROM {E_SQL} {W}) SELECT event_id, 0::BIGINT AS at FROM p WHERE rn = 0 UNION ALL SELECT event_id, 1 FROM p WHERE rn = n - 1")
def take_places(spark, sf_dir):
    return events(spark, sf_dir).take([0, -1]).df.select("event_id", F.col("__at").alias("at"))


@register("concat", "SELECT c_custkey AS k, c_acctbal AS b, 0 AS src FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 1 FROM supplier")
def concat(spark, sf_dir):
    a = TideFrame(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("b")), "k")
    return a.concat(TideFrame(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("b")), "k"), source="src").df


_ORD = "(SELECT o_orderkey, o_custkey, o_totalprice FROM orders)"


@register("left_join_repeated_keys", """WITH l AS (SELECT event_id, user_id % 60 AS k, row_number() OVER (PARTITION BY user_id % 60 ORDER BY event_id) AS rn FROM events), r AS (SELECT c_custkey % 50 AS k, c_acctbal, row_number() OVER (PARTITION BY c_custkey % 50 ORDER BY c_custkey DESC) AS rr, count(*) OVER (PARTITION BY c_custkey % 50) AS c FROM customer)
SELECT l.event_id, r.c_acctbal FROM l LEFT JOIN r ON l.k = r.k AND least(l.rn, r.c) = r.rr""")  # fmt: skip
def left_join_repeated_keys(spark, sf_dir):
    a = TideFrame(table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 60).alias("k")), "event_id")
    b = TideFrame(table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 50).alias("k"), "c_acctbal"), "c_custkey")
    return a.join(b, on="k").df.select("event_id", "c_acctbal")


@register("join_unique_keys", "SELECT o_orderkey, c_name, c_acctbal FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def join_unique_keys(spark, sf_dir):
    a, b = TideFrame(table(spark, sf_dir, "orders"), "o_orderkey"), TideFrame(table(spark, sf_dir, "customer"), "c_custkey")
    return a.join(b, left_on="o_custkey", right_on="c_custkey", unique=True).df.select("o_orderkey", "c_name", "c_acctbal")


@register("right_join", "SELECT c_custkey, o_totalprice FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def right_join(spark, sf_dir):
    a, b = TideFrame(table(spark, sf_dir, "orders"), "o_orderkey"), TideFrame(table(spark, sf_dir, "customer"), "c_custkey")
    return a.join(b, left_on="o_custkey", right_on="c_custkey", how="right").df.select("c_custkey", "o_totalprice")


@register("outer_join_distinct", "SELECT coalesce(l.k, r.k) AS k, l.c_acctbal, r.s_acctbal FROM (SELECT c_custkey % 700 AS k, arg_min(c_acctbal, c_custkey) AS c_acctbal FROM customer GROUP BY 1) l FULL JOIN (SELECT s_suppkey % 30 + 690 AS k, arg_max(s_acctbal, s_suppkey) AS s_acctbal FROM supplier GROUP BY 1) r ON l.k = r.k")
def outer_join_distinct(spark, sf_dir):
    a = TideFrame(table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 700).alias("k"), "c_acctbal"), "c_custkey")
    b = TideFrame(table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 30 + 690).alias("k"), "s_acctbal"), "s_suppkey")
    return a.join(b, on="k", how="outer").df.select("k", "c_acctbal", "s_acctbal")


@register("align_frames", "WITH k AS (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) SELECT k.k, a.b AS x, b.b AS y FROM k LEFT JOIN (SELECT c_nationkey AS k, arg_min(c_acctbal, c_custkey) AS b FROM customer GROUP BY 1) a ON k.k = a.k LEFT JOIN (SELECT s_nationkey AS k, arg_max(s_acctbal, s_suppkey) AS b FROM supplier GROUP BY 1) b ON k.k = b.k")
def align_frames(spark, sf_dir):
    a = TideFrame(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("x")), "c_custkey")
    b = TideFrame(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("y")), "s_suppkey")
    p, q = joins.align_frames([a, b], "k", sort=False)
    return p.df.join(q.df, "k").select("k", "x", "y")


@register("semi_anti_join", "SELECT c_custkey, 'semi' AS side FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'anti' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def semi_anti_join(spark, sf_dir):
    a, b = TideFrame(table(spark, sf_dir, "customer"), "c_custkey"), TideFrame(table(spark, sf_dir, "orders"), "o_orderkey")
    side = lambda how: a.join(b, left_on="c_custkey", right_on="o_custkey", how=how).df.select("c_custkey", F.lit(how).alias("side"))
    return side("semi").union(side("anti"))


@register("asof_join", "SELECT a.event_id, arg_max(b.value, (b.ts, b.event_id)) AS value_asof FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND b.ts <= a.ts WHERE a.event_type <> 'purchase' GROUP BY a.event_id")
def asof_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    a = TideFrame(e.where("event_type <> 'purchase'").drop("value"), "event_id", "user_id")
    b = TideFrame(e.where("event_type = 'purchase'"), "event_id", "user_id")
    return joins.asof_join(a, b, "ts", ["value"]).df.select("event_id", "value_asof")


# arrays
@register("embedding_axis", "SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 5) + 0.0 AS s, round(list_avg(embedding::DOUBLE[]), 6) + 0.0 AS m, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi, round(list_stddev_samp(embedding::DOUBLE[]), 6) AS sd, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 5) AS d FROM embeddings")
def embedding_axis(spark, sf_dir):
    x = Expr("column", (F.col("embedding").cast("array<double>"),))
    out = TideFrame(table(spark, sf_dir, "embeddings"), "vec_id").select("vec_id", s=x.array_sum(), m=x.array_mean(), lo=x.array_min(), hi=x.array_max(), sd=x.array_std(), d=x @ x)
    return out.df.select("vec_id", rounded("s", 5), rounded("m"), "lo", "hi", rounded("sd"), rounded("d", 5))


@register("matrix_views", "SELECT vec_id, [embedding[i] for i in [1, 10, 19, 28, 37, 46, 55, 64]]::FLOAT[] AS diagonal, [embedding[i] for i in [2, 10, 18, 26, 34, 42, 50, 58]]::FLOAT[] AS second FROM embeddings")
def matrix_views(spark, sf_dir):
    m = col("embedding").reshape(8)
    return TideFrame(table(spark, sf_dir, "embeddings"), "vec_id").select("vec_id", diagonal=m.diag(), second=m.t().get(1)).df


# statistics and finance
@register("ols_simple", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem GROUP BY 1")
def ols_simple(spark, sf_dir):
    out = linalg.ols_by(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", ["l_quantity"])
    return out.select("l_returnflag", F.round(F.col("params")[1], 4).alias("slope"), F.round(F.col("params")[0], 2).alias("intercept"))


@register("ols_multi", """WITH m AS (SELECT l_returnflag, covar_pop(l_quantity, l_quantity) AS a, covar_pop(l_quantity, l_discount) AS b, covar_pop(l_discount, l_discount) AS d, covar_pop(l_quantity, l_extendedprice) AS p, covar_pop(l_discount, l_extendedprice) AS q FROM lineitem GROUP BY 1)
SELECT l_returnflag, round((d * p - b * q) / (a * d - b * b), 3) AS b1, round((a * q - b * p) / (a * d - b * b), 1) AS b2 FROM m""")  # fmt: skip
def ols_multi(spark, sf_dir):
    out = linalg.ols_by(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", ["l_quantity", "l_discount"])
    return out.select("l_returnflag", F.round(F.col("params")[1], 3).alias("b1"), F.round(F.col("params")[2], 1).alias("b2"))


def _normal_sql(z: str) -> str:
    """The normal distribution for z from -6 to 6 by its series; 0 or 1 to nine digits beyond."""
    series = f"list_sum(list_transform(range(0, 80), lambda k: pow({z}, 2 * k + 1) * pow(2.0, k) * gamma(k + 1) / gamma(2 * k + 2)))"
    return f"(CASE WHEN {z} > 6 THEN 1.0 WHEN {z} < -6 THEN 0.0 ELSE 0.5 + exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {series} END)"


_NW = ", ".join(f"round({x}, 6) + 0.0 AS {n}" for n, x in [("params0", "b0"), ("params1", "b1"), ("tvalues0", "t0"), ("tvalues1", "t1"), ("pvalues0", f"2 * (1 - {_normal_sql('abs(t0)')})"), ("pvalues1", f"2 * (1 - {_normal_sql('abs(t1)')})")])


@register("nw_ols", f"""WITH e AS (SELECT user_id, v, y, ts, event_id, count(*) OVER (PARTITION BY user_id) AS total FROM {E_SQL}),
  c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM e WHERE v IS NOT NULL AND y IS NOT NULL),
  s AS (SELECT user_id, count(*) AS n, regr_slope(v, y) AS b1, regr_intercept(v, y) AS b0, sum(y) AS sx, sum(y * y) AS sxx, ceil(4 * pow(max(total) / 100, 2 / 9)) AS lags FROM c GROUP BY 1),
  r AS (SELECT c.user_id, rn, v - b0 - b1 * y AS e0, y * (v - b0 - b1 * y) AS e1, lags FROM c JOIN s USING (user_id)),
  m AS (SELECT a.user_id, sum(w * a.e0 * b.e0) AS m00, sum(w * (a.e0 * b.e1 + a.e1 * b.e0) / 2) AS m01, sum(w * a.e1 * b.e1) AS m11 FROM (SELECT a, b, CASE WHEN a.rn = b.rn THEN 1 ELSE 2 * (1 - (a.rn - b.rn) / (a.lags + 1)) END AS w FROM r a JOIN r b ON a.user_id = b.user_id AND a.rn - b.rn BETWEEN 0 AND a.lags) GROUP BY 1),
  t AS (SELECT user_id, n, b0, b1, m00, m01, m11, sxx / (n * sxx - sx * sx) AS i00, -sx / (n * sxx - sx * sx) AS i01, n / (n * sxx - sx * sx) AS i11 FROM s JOIN m USING (user_id)),
  u AS (SELECT user_id, n, b0, b1, b0 / sqrt(i00 * i00 * m00 + 2 * i00 * i01 * m01 + i01 * i01 * m11) AS t0, b1 / sqrt(i01 * i01 * m00 + 2 * i01 * i11 * m01 + i11 * i11 * m11) AS t1 FROM t)
  SELECT user_id, n, {_NW} FROM u""")  # fmt: skip
def nw_ols(spark, sf_dir):
    out = linalg.ols_by(events(spark, sf_dir).df, ["user_id"], "v", ["y"], robust=True, order=["ts", "event_id"])
    return out.select("user_id", "n", *[(F.round(F.col(c)[i], 6) + 0.0).alias(f"{c}{i}") for c in ("params", "tvalues", "pvalues") for i in (0, 1)])


_SSE = "(regr_syy(v, y){0} - regr_slope(v, y){0} * regr_sxy(v, y){0})"


@register("chow_test", f"""WITH s AS (SELECT event_type, {_SSE.format('')} AS s, {_SSE.format(' FILTER (WHERE event_id % 2 = 0)')} AS s1, {_SSE.format(' FILTER (WHERE event_id % 2 = 1)')} AS s2, count(*) - 4 AS d FROM {E_SQL} WHERE v IS NOT NULL AND y IS NOT NULL GROUP BY 1),
  f AS (SELECT event_type, d, ((s - s1 - s2) / 2) / ((s1 + s2) / d) AS f FROM s)
  SELECT event_type, round(f, 6) + 0.0 AS f, round(pow(1 + 2 * f / d, -d / 2), 6) + 0.0 AS p FROM f""")  # fmt: skip
def chow_test(spark, sf_dir):
    df = events(spark, sf_dir).df.withColumn("early", F.col("event_id") % 2 == 0)
    return linalg.chow_test(df, ["event_type"], "early", "v", ["y"]).select("event_type", rounded("f"), rounded("p"))


@register("matrix_pinv", f"""WITH c AS (SELECT user_id, event_id, v, y FROM {E_SQL} WHERE v IS NOT NULL AND y IS NOT NULL), s AS (SELECT user_id, count(*) AS n, sum(v * v) AS a, sum(v * y) AS b, sum(y * y) AS d FROM c GROUP BY 1)
  SELECT user_id, [list(round(CASE WHEN n = 1 THEN v / (a + d) ELSE (d * v - b * y) / (a * d - b * b) END, 8) + 0.0 ORDER BY event_id), list(round(CASE WHEN n = 1 THEN y / (a + d) ELSE (a * y - b * v) / (a * d - b * b) END, 8) + 0.0 ORDER BY event_id)] AS pinv FROM c JOIN s USING (user_id) GROUP BY user_id""")  # fmt: skip
def matrix_pinv(spark, sf_dir):
    df = events(spark, sf_dir).df.where("v is not null and y is not null")
    return linalg.matrix_by(df, ["user_id"], ["v", "y"], ["event_id"], "pinv").select("user_id", F.transform("pinv", lambda r: F.transform(r, lambda x: F.round(x, 8) + 0.0)).alias("pinv"))


# singular values of two columns from the eigenvalues of their products; u s vt gives the matrix back
@register("matrix_svd", f"""WITH s AS (SELECT user_id, count(*) AS n, sum(v * v) AS a, sum(v * y) AS b, sum(y * y) AS d FROM {E_SQL} WHERE v IS NOT NULL AND y IS NOT NULL GROUP BY 1)
  SELECT user_id, round(sqrt((a + d + sqrt((a - d) * (a - d) + 4 * b * b)) / 2), 5) + 0.0 AS s0, round(CASE WHEN n > 1 THEN sqrt(greatest(a * d - b * b, 0) / ((a + d + sqrt((a - d) * (a - d) + 4 * b * b)) / 2)) END, 5) + 0.0 AS s1, 0.0 AS off FROM s""")  # fmt: skip
def matrix_svd(spark, sf_dir):
    df = events(spark, sf_dir).df.where("v is not null and y is not null")
    f = TideFrame(linalg.matrix_by(df, ["user_id"], ["v", "y"], ["event_id"], "svd"), "user_id")
    scaled = Expr("column", (F.transform("vt", lambda r, i: F.transform(r, lambda x: x * F.get("s", i))),))
    back = df.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "v", "y"))), lambda r: F.array(r["v"], r["y"])).alias("m"))
    out = f.with_columns(back=col("u") @ scaled).df.join(back, "user_id")
    off = F.aggregate(F.zip_with("m", "back", lambda r, q: F.array_max(F.zip_with(r, q, lambda x, z: F.abs(x - z)))), F.lit(0.0), lambda m, x: F.greatest(m, x))
    return out.select("user_id", F.round(F.get("s", F.lit(0)), 5).alias("s0"), F.round(F.get("s", F.lit(1)), 5).alias("s1"), F.round(off, 6).alias("off"))


_BETA = "gamma(1.5) * gamma({0}) / gamma(1.5 + {0})"


@register("distributions", f"""WITH e AS (SELECT event_id, (v - 50) / 25 AS z FROM {E_SQL}), x AS (SELECT event_id, z, atan(z / sqrt(5)) AS th, 3 * abs(z) / (3 * abs(z) + 9) AS x FROM e)
  SELECT event_id, round({_normal_sql('z')}, 8) + 0.0 AS n, round(0.5 + (th + sin(th) * cos(th) * (1 + 2 * cos(th) * cos(th) / 3)) / pi(), 8) + 0.0 AS t,
  round(2 / pi() * asin(sqrt(x)) - sqrt(x * (1 - x)) * 2 / pi() + {' + '.join(f'pow(x, 1.5) * pow(1 - x, {b}) / ({b} * {_BETA.format(b)})' for b in (0.5, 1.5, 2.5, 3.5))}, 8) + 0.0 AS f FROM x""")  # fmt: skip
def distributions_query(spark, sf_dir):
    z = (v - 50) / 25
    df = events(spark, sf_dir).select("event_id", n=z.norm_cdf(), t=z.t_cdf(5.0), f=abs(z).f_cdf(3.0, 9.0)).df
    return df.select("event_id", rounded("n", 8), rounded("t", 8), rounded("f", 8))


def _ledger_sql(multiplier: float, leverage: float = 1.0, blowup: bool = False, rolls: bool = False) -> str:
    """The ledger bar by bar: a step of the recursion takes every symbol's next bar."""
    roll, spread = ("(event_id % 13 = 0)", "0.01") if rolls else ("false", "0.0")
    return f"""WITH RECURSIVE b AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, (event_id % 5 - 2) / 2 AS p, value + 100 AS o, value + 100 + event_id % 7 - 3 AS c, {roll} AS rolled FROM events),
  w AS (SELECT user_id, 0::BIGINT AS rn, NULL::BIGINT AS event_id, 1e6::DOUBLE AS cash, 0.0::DOUBLE AS p, 0.0::DOUBLE AS lots, NULL::DOUBLE AS last FROM (SELECT DISTINCT user_id FROM events) UNION ALL
    SELECT user_id, rn, event_id, CASE WHEN dead THEN 0.0 ELSE now - (traded * {multiplier} * o * 3e-4 + traded * {spread} * {multiplier}) + held * (c - o) * {multiplier} END, CASE WHEN dead THEN was ELSE p END, CASE WHEN dead THEN lots ELSE held END, CASE WHEN dead THEN last ELSE c END
    FROM (SELECT *, CASE WHEN NOT changed THEN 0.0 WHEN rolled THEN 2 * abs(held) ELSE abs(held - lots) END AS traded
    FROM (SELECT *, CASE WHEN NOT changed THEN lots WHEN p = 0 THEN 0.0 ELSE sign(p) * floor(now * {leverage} * abs(p) / ({multiplier} * o)) END AS held
    FROM (SELECT b.user_id, b.rn, b.event_id, b.p, b.o, b.c, b.rolled, w.p AS was, w.lots, w.last, w.cash + CASE WHEN w.lots <> 0 AND NOT b.rolled AND w.last IS NOT NULL THEN w.lots * (b.o - w.last) * {multiplier} ELSE 0.0 END AS now, (b.p <> w.p OR b.rolled) AS changed, ({str(blowup).lower()} AND w.cash <= 0) AS dead
    FROM w JOIN b ON b.user_id = w.user_id AND b.rn = w.rn + 1))))
  SELECT user_id, event_id, round(cash + 0.0037123457, 2) + 0.0 AS equity FROM w WHERE rn > 0"""


@register("calc_ret_single", _ledger_sql(10.0, 2.0))
def calc_ret_single(spark, sf_dir):
    df = _bars(spark, sf_dir)
    return equity.backtest(df, ["user_id"], ["event_id"], "pos", "o", "c", multiplier=10, leverage=2).select("user_id", "event_id", _money())


@register("calc_ret_spread", _ledger_sql(10.0, blowup=True, rolls=True))
def calc_ret_spread(spark, sf_dir):
    return equity.backtest(_bars(spark, sf_dir), ["user_id"], ["event_id"], "pos", "o", "c", "roll", "spread", multiplier=10, blowup=True).select("user_id", "event_id", _money())


def _money():
    """Equity to two digits, moved off the halves that sums of short decimals often are."""
    return (F.round(F.col("equity") + 0.0037123457, 2) + 0.0).alias("equity")


def _bars(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "event_id", ((F.col("event_id") % 5 - 2) / 2).alias("pos"), (F.col("value") + 100).alias("o"), (F.col("value") + 100 + F.col("event_id") % 7 - 3).alias("c"), (F.col("event_id") % 13 == 0).cast("double").alias("roll"), F.lit(0.01).alias("spread"))


from tideframe.plans import frame_queries  # noqa: E402, F401
