"""Least squares and what builds on it.

Regressions, of a whole frame or of each group, are solved from sums of products, taken in one distributed aggregation:
with p columns that is p(p + 3) / 2 numbers a group, whatever the number of rows. Products are of differences from rough
means, so that large offsets cost no digits. Newey-West errors add sums of lagged products over a window of each group.
Matrix decompositions run in Arrow-backed grouped functions on groups that fit in a task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideframe.functions.distributions import f_cdf_value, norm_cdf_value, t_cdf_value
from tideframe.functions.workers import with_workers


def newey_west_lag(n: int) -> int:
    return math.ceil(4 * (n / 100) ** (2 / 9))


def newey_west_meat(x: np.ndarray, resid: np.ndarray, lag: int) -> np.ndarray:
    """The middle of the sandwich: lagged cross products with Bartlett weights."""
    u = x * resid[:, None]
    s = u.T @ u
    for k in range(1, min(lag, len(u) - 1) + 1):
        c = u[k:].T @ u[:-k]
        s += (1 - k / (lag + 1)) * (c + c.T)
    return s


def fit(y: np.ndarray, x: np.ndarray, constant: bool = True, lag: int | None = None, robust: bool = False) -> dict:
    """One least squares fit on complete rows; NULL parameters where there are fewer rows than parameters."""
    x = np.atleast_2d(x.T).T.astype(float)
    good = ~(np.isnan(y) | np.isnan(x).any(axis=1))
    design = np.column_stack([np.ones(len(y)), x]) if constant else x
    a, b = design[good], y[good].astype(float)
    n, p = a.shape
    out = {"params": [None] * p, "tvalues": [None] * p, "pvalues": [None] * p, "sse": None, "rank": 0, "n": n, "fitted": np.full(len(y), np.nan)}
    if n < p or n == 0:
        return out
    beta, _, rank, singular = np.linalg.lstsq(a, b, rcond=None)
    resid = b - a @ beta
    sse = float(resid @ resid)
    out |= {"params": beta.tolist(), "sse": sse, "rank": int(rank), "singular": singular.tolist()}
    out["fitted"] = design @ beta
    if n > p and rank == p:
        bread = np.linalg.pinv(a.T @ a)
        cov = bread @ newey_west_meat(a, resid, newey_west_lag(n) if lag is None else lag) @ bread if robust else bread * sse / (n - p)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = beta / np.sqrt(np.diag(cov))
        tail = (lambda v: 2 * (1 - norm_cdf_value(abs(v)))) if robust else (lambda v: 2 * (1 - t_cdf_value(abs(v), n - p)))
        out |= {"tvalues": [float(v) if np.isfinite(v) else None for v in t], "pvalues": [tail(v) if np.isfinite(v) else None for v in t]}
    return out


_FIT = "params array<double>, tvalues array<double>, pvalues array<double>, sse double, rank int, n long, singular array<double>"


def _complete(df: DataFrame, names: list[str]) -> Column:
    """Whether a row has all of the values."""
    good = F.lit(True)
    for c in names:
        good = good & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return good


def _solve(m: np.ndarray, n: int, constant: bool, shift: np.ndarray) -> tuple:
    """(params, sse, rank, singular values of the design, inverse of its products) from the products m of (1, x, y) less
    shift; the first of them counts rows if constant."""
    p = len(m) - 1
    gram, right = m[:p, :p], m[:p, p]
    values, vectors = np.linalg.eigh(gram)
    cut = max(values.max(initial=0.0), 0.0) * max(n, p) * np.finfo(float).eps
    good = values > cut
    inverse = (vectors * np.where(good, 1 / np.where(good, values, 1), 0.0)) @ vectors.T
    beta = inverse @ right
    sse = max(0.0, float(m[p, p] - 2 * beta @ right + beta @ gram @ beta))
    rank = int(good.sum())
    # back from the shifted columns: x = (x - shift) + shift
    back = np.eye(p)
    if constant:
        back[0, 1:] = -shift[:-1]
        beta = back @ beta
        beta[0] += shift[-1]
    inverse = back @ inverse @ back.T
    true = np.linalg.inv(back).T @ gram @ np.linalg.inv(back) if constant else gram
    singular = np.sqrt(np.maximum(np.linalg.eigvalsh(true)[::-1], 0.0))
    return beta, sse, rank, singular, inverse


def _row(beta, sse, rank, singular, n, p, spread, robust: bool) -> dict:
    """The figures of a fit; spread is the variance of each parameter."""
    out = {"params": beta.tolist(), "tvalues": [None] * p, "pvalues": [None] * p, "sse": sse, "rank": rank, "n": n, "singular": singular.tolist()}
    if n > p and rank == p:
        with np.errstate(divide="ignore", invalid="ignore"):
            t = beta / np.sqrt(spread)
        tail = (lambda v: 2 * (1 - norm_cdf_value(abs(v)))) if robust else (lambda v: 2 * (1 - t_cdf_value(abs(v), n - p)))
        out |= {"tvalues": [float(v) if np.isfinite(v) else None for v in t], "pvalues": [tail(v) if np.isfinite(v) else None for v in t]}
    return out


def ols_by(df: DataFrame, by: list[str], y: str, x: list[str], constant: bool = True, robust: bool = False, lag: int | None = None, order: list[str] | None = None) -> DataFrame:
    """A fit of y on x for each group, on its complete rows; NULL parameters where there are fewer rows than parameters.

    robust takes Newey-West errors (rows in order, lags by the number of all rows) and normal p-values.
    """
    with_workers(df.sparkSession)
    names, p = [*x, y], len(x) + constant
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    good = _complete(df, names)
    own = df.select(*by, *(order or []), good.alias("__good"), *[F.when(good, F.col(c).cast("double")).alias(f"__v{i}") for i, c in enumerate(names)])
    rough = own.agg(*[F.avg(f"__v{i}").alias(f"a{i}") for i in range(len(names))]).first() if constant else None
    shift = np.array([rough[f"a{i}"] or 0.0 for i in range(len(names))]) if constant else np.zeros(len(names))
    full = [F.when(F.col("__good"), 1.0)] * constant + [F.col(f"__v{i}") - float(shift[i]) for i in range(len(names))]
    at = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    sums = own.groupBy(*by).agg(F.count(F.when(F.col("__good"), 1)).alias("n"), F.count(F.lit(1)).alias("all"), F.array(*[F.coalesce(F.sum(full[i] * full[j]), F.lit(0.0)) for i, j in at]).alias("sums"))

    def products(flat) -> np.ndarray:
        m = np.zeros((p + 1, p + 1))
        for (i, j), s in zip(at, flat, strict=True):
            m[i, j] = m[j, i] = s
        return m

    if robust:
        sums = _lagged(sums, own, by, order or [], names, full, products, p, constant, shift, lag)
    none = {"params": [None] * p, "tvalues": [None] * p, "pvalues": [None] * p, "sse": None, "rank": 0, "singular": None}

    def run(batches):
        for g in batches:
            rows = []
            for _, r in g.iterrows():
                n = int(r["n"])
                if n < p or n == 0:
                    rows.append(none | {"n": n})
                    continue
                beta, sse, rank, singular, inverse = _solve(products(r["sums"]), n, constant, shift)
                if robust:
                    spread = np.diag(inverse @ np.array(r["meat"].tolist() if hasattr(r["meat"], "tolist") else r["meat"]).reshape(p, p) @ inverse)
                else:
                    spread = np.diag(inverse) * sse / max(n - p, 1)
                rows.append(_row(beta, sse, rank, singular, n, p, spread, robust))
            fits = pd.DataFrame(rows, columns=["params", "tvalues", "pvalues", "sse", "rank", "n", "singular"])
            yield pd.concat([g[by].reset_index(drop=True), fits], axis=1)

    return sums.mapInPandas(run, ", ".join([*[f"{k} {kinds[k]}" for k in by], _FIT]))


def _lagged(sums: DataFrame, own: DataFrame, by: list[str], order: list[str], names: list[str], full, products, p: int, constant: bool, shift, lag: int | None) -> DataFrame:
    """sums with meat: the lagged products of residuals and columns with Bartlett weights, flat, for each group."""
    kinds = {f.name: f.dataType.simpleString() for f in sums.schema}

    def fits(batches):
        for g in batches:
            beta = [_solve(products(r["sums"]), int(r["n"]), constant, shift)[0].tolist() if r["n"] >= p and r["n"] > 0 else None for _, r in g.iterrows()]
            lags = [newey_west_lag(int(a)) if lag is None else lag for a in g["all"]]
            yield g.assign(beta=beta, lags=lags)

    fitted = sums.mapInPandas(fits, ", ".join([f"{c} {k}" for c, k in kinds.items()] + ["beta array<double>", "lags int"]))
    most = fitted.agg(F.max("lags")).first()[0] or 0
    match = None
    marked = fitted.select(*[F.col(b).alias(f"__b{i}") for i, b in enumerate(by)], "beta", "lags")
    for i, b in enumerate(by):
        c = own[b].eqNullSafe(marked[f"__b{i}"])
        match = c if match is None else match & c
    columns = [F.lit(1.0)] * constant + [F.col(f"__v{i}") for i in range(len(names) - 1)]
    rows = own.where("__good").join(marked, match)
    resid = F.col(f"__v{len(names) - 1}") - sum((F.get("beta", F.lit(i)) * c for i, c in enumerate(columns)), F.lit(0.0))
    meat = _meat(rows.withColumn("__u", F.array(*[c * resid for c in columns])), by, order, p, most)
    meat = meat.select(*[F.col(b).alias(f"__m{i}") for i, b in enumerate(by)], "meat")
    same = None
    for i, b in enumerate(by):
        c = sums[b].eqNullSafe(meat[f"__m{i}"])
        same = c if same is None else same & c
    return sums.join(meat, same, "left").drop(*[f"__m{i}" for i in range(len(by))])


def _meat(rows: DataFrame, by: list[str], order: list[str], p: int, most: int) -> DataFrame:
    """(by, meat): sums of __u times itself and, by Bartlett weights, of __u times the __u of up to lags rows before, both
    ways; flat by rows of p. lags is at most most."""
    # each row against the weighted sum of the rows before it, nearest last
    before = F.collect_list("__u").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-max(most, 1), -1))
    rows = rows.withColumn("__before", before if most else F.array().cast("array<array<double>>"))

    def weighed(i: int) -> Column:
        weight = lambda k: F.greatest(F.lit(0.0), 1 - k / (F.col("lags") + 1))
        return F.aggregate(F.transform("__before", lambda u, k: F.get(u, F.lit(i)) * weight(F.size("__before") - k)), F.lit(0.0), lambda a, v: a + v)

    rows = rows.select(*by, "__u", F.array(*[weighed(i) for i in range(p)]).alias("__past"))
    cell = lambda i, j: F.get("__u", F.lit(i)) * F.get("__u", F.lit(j)) + F.get("__u", F.lit(i)) * F.get("__past", F.lit(j)) + F.get("__past", F.lit(i)) * F.get("__u", F.lit(j))
    return rows.groupBy(*by).agg(F.array(*[F.sum(cell(i, j)) for i in range(p) for j in range(p)]).alias("meat"))


def newey_west_by(df: DataFrame, by: list[str], x: list[str], resid: str, lag: int, order: list[str]) -> DataFrame:
    """(by, meat array of rows) for each group: the middle of the Newey-West sandwich of columns x and residuals, in order;
    incomplete rows are left out."""
    p = len(x)
    rows = df.where(_complete(df, [*x, resid])).select(*by, *order, F.lit(lag).alias("lags"), F.array(*[F.col(c).cast("double") * F.col(resid) for c in x]).alias("__u"))
    flat = _meat(rows, by, order, p, lag)
    return flat.select(*by, F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda i: F.slice("meat", i * p + 1, p)).alias("meat"))


def residuals_by(df: DataFrame, by: list[str], y: str, x: list[str], keep: list[str], constant: bool = True) -> DataFrame:
    """Each row of keep with its fitted value and residual, missing where the row is incomplete."""
    fits = ols_by(df, by, y, x, constant).select(*[F.col(b).alias(f"__b{i}") for i, b in enumerate(by)], "params")
    match = None
    for i, b in enumerate(by):
        c = df[b].eqNullSafe(fits[f"__b{i}"])
        match = c if match is None else match & c
    columns = [F.lit(1.0)] * constant + [F.col(c).cast("double") for c in x]
    fitted = sum((F.get("params", F.lit(i)) * c for i, c in enumerate(columns)), F.lit(0.0))
    value = F.when(_complete(df, x), fitted)
    rest = F.when(_complete(df, [*x, y]), F.col(y).cast("double") - fitted)
    return df.join(fits, match, "left").select(*dict.fromkeys([*by, *keep]), value.alias("fitted"), rest.alias("resid"))


def ols_whole(df: DataFrame, y: str, x: list[str], constant: bool = True) -> dict:
    """A fit over the whole frame from sums of products: rows never leave their partitions."""
    names = [*x, y]
    own = df.select(*[F.col(c).cast("double").alias(c) for c in names]).dropna("any")
    own = own.where(~sum((F.isnan(c).cast("int") for c in names), F.lit(0)).cast("boolean"))
    cols = [F.lit(1.0)] * constant + [F.col(c) for c in x]
    full = [*cols, F.col(y)]
    p = len(cols)
    at = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    row = own.agg(*[F.sum(full[i] * full[j]).alias(f"s{i}_{j}") for i, j in at], F.count(F.lit(1)).alias("n")).first()
    n = row["n"]
    if n < p or n == 0:
        return {"params": None, "sse": None, "n": n, "tvalues": None, "pvalues": None}
    m = np.zeros((p + 1, p + 1))
    for i, j in at:
        m[i, j] = m[j, i] = row[f"s{i}_{j}"]
    beta = np.linalg.lstsq(m[:p, :p], m[:p, p], rcond=None)[0]
    sse = max(0.0, float(m[p, p] - beta @ m[:p, p]))
    out = {"params": beta.tolist(), "sse": sse, "n": n, "tvalues": None, "pvalues": None}
    if n > p and sse > 0:
        t = beta / np.sqrt(np.diag(np.linalg.pinv(m[:p, :p])) * sse / (n - p))
        out |= {"tvalues": t.tolist(), "pvalues": [2 * (1 - t_cdf_value(abs(v), n - p)) for v in t]}
    return out


def chow(rss: Column, rss1: Column, rss2: Column, n1: Column, n2: Column, k: int) -> Column:
    """The F statistic of a structural break: one fit against two."""
    return F.try_divide((rss - rss1 - rss2) / k, (rss1 + rss2) / (n1 + n2 - 2 * k))


def chow_test(df: DataFrame, by: list[str], split: str, y: str, x: list[str]) -> DataFrame:
    """(by, f, p) of the Chow test for each group, its rows parted by the boolean split."""
    k = len(x) + 1
    whole = ols_by(df, by, y, x).select(*by, "sse")
    parts = ols_by(df.where(F.col(split).isNotNull()), [*by, split], y, x)
    side = lambda c, name: F.max(F.when(c, F.col(name)))
    two = parts.groupBy(*by).agg(*[side(c, name).alias(name + s) for c, s in ((F.col(split), "1"), (~F.col(split), "2")) for name in ("sse", "n")])
    two = two.select(*[F.col(b).alias(f"__b{i}") for i, b in enumerate(by)], "sse1", "n1", "sse2", "n2")
    match = None
    for i, b in enumerate(by):
        c = whole[b].eqNullSafe(two[f"__b{i}"])
        match = c if match is None else match & c
    dof = F.col("n1") + F.col("n2") - 2 * k
    stat = F.when((dof > 0) & (F.col("sse1") + F.col("sse2") > 0), chow(F.col("sse"), F.col("sse1"), F.col("sse2"), F.col("n1"), F.col("n2"), k))
    out = whole.join(two, match).select(*by, stat.alias("f"), dof.alias("dof"))
    # I of the F distribution with degrees of freedom that differ by group
    return out.select(*by, "f", (1 - f_cdf_of(F.col("f"), F.lit(float(k)), F.col("dof").cast("double"))).alias("p"))


def f_cdf_of(x: Column, df1: Column, df2: Column) -> Column:
    """The F distribution with degrees of freedom of each row's own (one call a row: rows are groups here)."""

    @F.pandas_udf("double")
    def run(x: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
        out = [f_cdf_value(v, a, b) if pd.notna(v) and b > 0 else None for v, a, b in zip(x, df1, df2, strict=True)]
        return pd.Series(out, dtype="Float64")

    return run(x, df1, df2)


def mark_star(value: Column, pvalue: Column, digits: int = 3, tvalue: Column | None = None, split: str = "\r\n") -> Column:
    """value with a star for each of p <= 0.1, 0.05 and 0.01, Invalid for a p outside 0 to 1; with tvalue, its text in
    brackets after split."""
    text = lambda c: F.format_string(f"%.{digits}f", c)
    stars = F.when(pvalue <= 0.01, "***").when(pvalue <= 0.05, "**").when(pvalue <= 0.1, "*").otherwise("")
    out = F.when((pvalue < 0) | (pvalue > 1), "Invalid").otherwise(F.concat(text(value), stars))
    return out if tvalue is None else F.concat(out, F.lit(f"{split}("), text(tvalue), F.lit(")"))


def matrix_by(df: DataFrame, by: list[str], x: list[str], order: list[str], kind: str, rcond: float | None = None, full: bool = False, calc_uvt: bool = True) -> DataFrame:
    """For each group's matrix (rows in order, columns x): kind "svd" gives (by, u, s, vt), all of u if full, s alone without
    calc_uvt; "pinv" (by, pinv array of rows, s inverted)."""
    if kind not in ("svd", "pinv"):
        raise ValueError(f"no such decomposition: {kind}")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    names = ["pinv", "s"] if kind == "pinv" else ["u", "s", "vt"] if calc_uvt else ["s"]

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        m = g.sort_values(order)[x].to_numpy(float)
        u, s, vt = np.linalg.svd(m, full_matrices=full and kind == "svd")
        out = {"u": u.tolist(), "s": s.tolist(), "vt": vt.tolist()}
        if kind == "pinv":
            cut = (np.finfo(float).eps * max(m.shape) if rcond is None else rcond) * s.max(initial=0.0)
            inverse = np.where(s > cut, 1 / np.where(s > cut, s, 1), 0.0)
            out = {"pinv": ((vt.T * inverse) @ u.T).tolist(), "s": inverse.tolist()}
        return pd.DataFrame([{**dict(zip(by, key, strict=True)), **{n: out[n] for n in names}}])

    out = [f"{n} array<double>" if n == "s" else f"{n} array<array<double>>" for n in names]
    return df.select(*dict.fromkeys([*by, *order, *x])).groupBy(*by).applyInPandas(run, ", ".join([*[f"{k} {kinds[k]}" for k in by], *out]))
