"""Ranks and places over all rows of a frame, without one task that sorts them all.

Values are dealt into ranges by split points that are read once, as plain numbers, so that each value's range is the same
however often a plan is run; one number a range is summed up over the ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideframe.functions.aggregates import linear_quantile

#: Ranges that rows are dealt into at most.
RANGES = 64
#: Bytes of the tables that a frame reads, as they are stored, for one task of several sorted windows.
TASK_BYTES = 1 << 20
#: Rows of a group whose values one task takes for exact quantiles.
GROUP_ROWS = 1_000_000


def _axis(df: DataFrame, c: Column) -> Column | None:
    """c as a number in the same order; None for types without one."""
    kind = df.select(c).schema[0].dataType
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return F.unix_date(c).cast("double") if isinstance(kind, T.DateType) else None


def split_points(df: DataFrame, c: Column) -> list[float]:
    """Numbers that part the values of c into ranges of about equal rows; none for types without an axis."""
    axis = _axis(df, c)
    if axis is None:
        return []
    return sorted(set(df.agg(F.percentile_approx(axis, [k / RANGES for k in range(1, RANGES)], 2000)).first()[0] or []))


def dealt(df: DataFrame, c: Column, points: list[float]) -> DataFrame:
    """df with the number of the range of c in __p, ascending; missing values last."""

    def among(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("__axis") < points[mid], among(lo, mid)).otherwise(among(mid + 1, hi))

    axis = _axis(df, c)
    # a column of its own, as the tree of comparisons names it once for each point
    marked = df.withColumn("__axis", F.when(c.isNull(), None).otherwise(F.lit(0.0) if axis is None else axis))
    return marked.withColumn("__p", F.when(F.col("__axis").isNull(), RANGES + 1).otherwise(among(0, len(points)))).drop("__axis")


def _before(counts: DataFrame, part: str, n: str) -> DataFrame:
    """(__q, __b): the sum of n over all lower ranges; one row a range."""
    totals = counts.groupBy(part).agg(F.sum(n).alias("__t"))
    running = F.sum("__t").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    return totals.select(F.col(part).alias("__q"), F.coalesce(running, F.lit(0)).alias("__b"))


def distributed_rank(df: DataFrame, by: str, name: str, rev: bool = False, base: DataFrame | None = None) -> DataFrame:
    """df with the tie-averaged rank of by over all rows; NULL for missing values, which are not ranked.

    Distinct values are counted first, so a value that many rows hold is one row of what is ranked. base has the same rows
    of by as df, and a shorter plan.
    """
    counts = (df if base is None else base).where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("__c"))
    ranks = ranked_counts(counts, by, name, rev).select(F.col(by).alias("__v"), name)
    return df.join(ranks, df[by] == ranks["__v"], "left").drop("__v")


def ranked_counts(counts: DataFrame, by: str, name: str, rev: bool = False) -> DataFrame:
    """counts (by, __c) of distinct values with the tie-averaged rank that each has among all counted rows."""
    parted = dealt(counts, F.col(by), split_points(counts, F.col(by)))
    within = F.sum("__c").over(Window.partitionBy("__p").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = parted.withColumn("__u", within).join(F.broadcast(_before(parted, "__p", "__c")), F.col("__p") == F.col("__q"))
    rank = F.col("__b") + F.col("__u") - (F.col("__c") - 1) / 2
    if rev:
        rank = counts.agg(F.sum("__c")).scalar() + 1 - rank
    return out.withColumn(name, rank).drop("__p", "__q", "__b", "__u")


def located_quantiles(df: DataFrame, keys: list[str], x: Column, levels: list[float]) -> DataFrame | None:
    """(__k0, ..., __q0, ...): linear quantiles of x in each group, from the counts of its distinct values in ranges, so that
    no task reads a group; None where the largest group is small enough for one."""
    ks = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, ks, strict=True)], x.cast("double").alias("__x")).where("__x IS NOT NULL")
    if (rows.groupBy(*ks).agg(F.count(F.lit(1)).alias("__c")).agg(F.max("__c")).first()[0] or 0) <= GROUP_ROWS:
        return None
    counts = rows.groupBy(*ks, "__x").agg(F.count(F.lit(1)).alias("__c"))
    parted = dealt(counts, F.col("__x"), split_points(counts, F.col("__x")))
    within = F.sum("__c").over(Window.partitionBy(*ks, "__p").orderBy("__x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    totals = parted.groupBy(*ks, "__p").agg(F.sum("__c").alias("__t"))
    lower = F.sum("__t").over(Window.partitionBy(*ks).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    before = totals.select(*[F.col(k).alias(f"{k}_b") for k in ks], F.col("__p").alias("__pb"), F.coalesce(lower, F.lit(0)).alias("__b"), F.sum("__t").over(Window.partitionBy(*ks)).alias("__n"))
    same = F.col("__p") == F.col("__pb")
    for k in ks:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_b"))
    placed = parted.withColumn("__u", within).join(before, same).withColumn("__end", F.col("__b") + F.col("__u"))
    at = lambda place: F.max(F.when((place < F.col("__end")) & (place >= F.col("__end") - F.col("__c")), F.col("__x")))
    place = [(F.col("__n") - 1) * F.lit(q) for q in levels]
    ends = placed.groupBy(*ks).agg(F.max("__n").alias("__n"), *[at(to(p)).alias(f"__{end}{i}") for i, p in enumerate(place) for end, to in (("lo", F.floor), ("hi", F.ceil))])
    between = [linear_quantile(F.col(f"__lo{i}"), F.col(f"__hi{i}"), F.col("__n"), q).alias(f"__q{i}") for i, q in enumerate(levels)]
    return ends.select(*ks, *between)


def spread(df: DataFrame, part: tuple) -> DataFrame:
    """df dealt by part into more tasks the larger the tables are that it reads, so that a task's memory does not grow with
    them; as it is where that is no more than the session's tasks. Adaptive execution leaves this number as it is."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    tasks = sum(n for n in sizes if n < 1 << 50) // TASK_BYTES  # a size that is not known counts as endless
    return df.repartition(tasks, *part) if part and tasks > df.sparkSession.sparkContext.defaultParallelism else df


def numbered(df: DataFrame, order: list[Column], name: str, base: DataFrame | None = None) -> DataFrame:
    """df with each row's place from 0 in the order; dealt into ranges by the first column. base as in distributed_rank."""
    first, base = order[0], df if base is None else base
    points = split_points(base, first)
    parted = dealt(df, first, points)
    within = F.row_number().over(Window.partitionBy("__p").orderBy(first.asc_nulls_last(), *order[1:]))
    before = _before(dealt(base.select(first.alias("__first")), F.col("__first"), points).groupBy("__p").agg(F.count(F.lit(1)).alias("__n")), "__p", "__n")
    out = parted.withColumn("__u", within).join(F.broadcast(before), F.col("__p") == F.col("__q"))
    return out.withColumn(name, (F.col("__b") + F.col("__u") - 1).cast("long")).drop("__p", "__q", "__b", "__u")
