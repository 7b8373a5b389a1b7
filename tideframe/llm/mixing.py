"""Mixing sources to target weights by entropy balancing, with DataFrame functions alone.

Each document gets a rate, the number of times the mix should take it. Of all rates between 0 and CAP that give every
source its target of words, those nearest to 1 in relative entropy are min(CAP, exp(lambda * size / scale)): documents
are tilted exponentially in their size, with one multiplier lambda for each source. The multipliers solve the convex
dual of the word constraints. Newton steps find them: each sums the constraint and its slope over all documents (as
counts of documents of equal source and size, which have equal rates) in one distributed aggregation; a bracket kept for
each source makes a step that leaves it a bisection. The sums are exact decimals, so reruns agree to the last bit.

Rates become copies without sampling error that grows: inside a source, cells of equal size, largest first, take whole
copies by cumulative rounding; what a source then lacks or has too much is made up by one cell of each power of two of
sizes, largest first. Documents of a cell differ by one copy at most; a hash of the key decides which take it, in
buckets of about BUCKET documents, so a cell with a third of all rows is no task of its own.

Defined results: null and empty texts have size 0 and are never taken; a null source is a source, after all others; null
keys and repeated rows are documents like others (equal ones may differ by a copy); a source of size 0 has target 0; an
empty table gives an empty result. Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideframe.llm import common

WEIGHTS = (5, 2, 1)
CAP = 3
#: Newton steps at most, and the share of a target that may be missed before rounding.
STEPS, CLOSE = 60, 1e-9
BUCKET = 200
EXACT = "decimal(38,9)"


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, size) of every row; size counts the words of the whole text."""
    return docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.regexp_count(common.text_or_empty(text), F.lit(common.WORD)).cast("long").alias("size"))


def numbered(own: DataFrame) -> DataFrame:
    """own (one row a source) with the place of each source, from 0, by code point, null last. Sources are dealt into ranges
    once, in a table, and only the ranges' counts are gathered, so many sources are no task of their own."""
    ranges = common.settle(own.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    counts = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    before = counts.select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return ranges.withColumn("place", place).join(F.broadcast(before), F.col("part") == F.col("of")).withColumn("place", F.col("place") + F.col("before")).drop("part", "of", "before")


def targets(cells: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, largest, target) from cells (source, size, n).

    Targets share all words by weight, at most cap times a source's own: they are min(cap * own, level * weight). What
    sources above their cap leave is shared again among the others, which raises the level, until no more of them are.
    """
    own = numbered(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.max("size").alias("largest")))
    own = own.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
    own = common.settle(own.withColumn("most", cap * F.col("source_size").cast("double")).drop("place"), "weights")
    total, level = None, None
    while True:
        full = F.lit(False) if level is None else F.col("most") < level * F.col("weight")
        row = own.agg(F.sum(F.col("source_size").cast("double")), F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        total, taken, open_ = (v or 0.0 for v in row)
        now = (total - taken) / open_ if open_ else level or 0.0
        if level is not None and now <= level:
            break
        level = now
    return own.select("source", "source_size", "largest", F.least("most", F.lit(level) * F.col("weight")).alias("target"))


def rate(multiplier: Column, size: Column, scale: Column, cap: int = CAP) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(F.lit(50.0), multiplier * size / scale)))


def multipliers(cells: DataFrame, goals: DataFrame, cap: int = CAP) -> DataFrame:
    """goals with lambda for every source, by distributed Newton steps on the dual."""
    scale = F.greatest(F.lit(1.0), F.try_divide(F.col("source_size"), F.col("documents")))
    state = goals.withColumn("scale", scale).withColumn("open", (F.col("source_size") > 0) & (F.col("target") < cap * F.col("source_size")))
    # at lambda = 2 * scale even documents of one word are at the cap, as they are in sources that need all of it
    state = state.withColumns({"lo": -50.0 * F.col("scale"), "hi": 2.0 * F.col("scale"), "lambda": F.when(F.col("open"), 0.0).otherwise(2.0 * F.col("scale"))})
    state = common.settle(state, "multipliers")
    for _ in range(STEPS):
        own = cells.where("size > 0").join(state.where("open"), cells["source"].eqNullSafe(state["source"])).select(state["source"], "size", "n", "lambda", "scale")
        w = rate(F.col("lambda"), F.col("size"), F.col("scale"), cap)
        words = F.col("n") * F.col("size") * w
        slope = F.when(w < cap, words * F.col("size") / F.col("scale")).otherwise(0.0)
        sums = own.groupBy("source").agg(F.sum(words.cast(EXACT)).cast("double").alias("words"), F.sum(slope.cast(EXACT)).cast("double").alias("slope")).withColumnRenamed("source", "at")
        joined = state.join(sums, state["source"].eqNullSafe(sums["at"]), "left").drop("at")
        miss = F.col("words") - F.col("target")
        done = F.abs(miss) <= CLOSE * F.greatest(F.lit(1.0), F.col("target"))
        lo, hi = F.when(miss < 0, F.col("lambda")).otherwise(F.col("lo")), F.when(miss > 0, F.col("lambda")).otherwise(F.col("hi"))
        step = F.col("lambda") - F.try_divide(miss, F.col("slope"))
        inside = F.coalesce((step > lo) & (step < hi), F.lit(False))
        going = F.col("open") & F.col("words").isNotNull()
        state = joined.select(
            "source", "source_size", "documents", "largest", "target", "scale",
            F.when(going & ~done, lo).otherwise(F.col("lo")).alias("lo"),
            F.when(going & ~done, hi).otherwise(F.col("hi")).alias("hi"),
            F.when(going & ~done, F.when(inside, step).otherwise((lo + hi) / 2)).otherwise(F.col("lambda")).alias("lambda"),
            (going & ~done).alias("open"),
        )
        state = common.settle(state, "multipliers")
        if state.where("open").isEmpty():
            break
    return state


def cell_copies(cells: DataFrame, state: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, size, n, copies) with copies whole, for all n documents of a cell together."""
    join = cells["source"].eqNullSafe(state["source"])
    own = cells.join(state.drop("documents", "largest"), join).select(cells["source"], "size", "n", "target", rate(F.col("lambda"), F.col("size"), F.col("scale"), cap).alias("rate"))
    own = own.withColumn("want", F.when(F.col("size") > 0, (F.col("n") * F.col("rate")).cast(EXACT)).otherwise(F.lit(0).cast(EXACT)))
    upto = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("want").over(upto)
    own = own.withColumn("copies", (F.round(total, 0) - F.round(total - F.col("want"), 0)).cast("long"))
    own = own.withColumn("copies", F.least(F.greatest("copies", F.lit(0)), cap * F.col("n"))).select("source", "size", "n", "target", "copies")
    # what is left over, by the fullest cell of each power of two of sizes, largest first: at most 64 of a source
    octave = F.floor(F.log2("size"))
    pick = own.where("size > 0").groupBy("source", octave.alias("octave")).agg(F.max(F.struct("n", (-F.col("size")).alias("less"), "copies")).alias("c"))
    picked = pick.groupBy("source").agg(F.sort_array(F.collect_list(F.struct((-F.col("c.less")).alias("size"), F.col("c.n").alias("n"), F.col("c.copies").alias("copies"))), asc=False).alias("picked"))
    miss = own.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).cast("long").alias("miss")).withColumnRenamed("source", "at")

    def fix(acc: Column, c: Column) -> Column:
        whole = (acc["miss"] / c["size"]).cast("long")
        more = F.greatest(-c["copies"], F.least(whole, cap * c["n"] - c["copies"]))
        return F.struct((acc["miss"] - more * c["size"]).alias("miss"), F.concat(acc["out"], F.array(F.struct(c["size"].alias("size"), more.alias("more")))).alias("out"))

    start = F.struct(F.col("miss"), F.array().cast("array<struct<size:bigint,more:bigint>>").alias("out"))
    fixes = picked.join(miss, picked["source"].eqNullSafe(miss["at"])).select("source", F.explode(F.aggregate("picked", start, fix, lambda acc: acc["out"])).alias("f")).select(F.col("source").alias("at"), F.col("f.size").alias("fsize"), F.col("f.more").alias("more"))
    return own.join(fixes, own["source"].eqNullSafe(fixes["at"]) & (F.col("size") == F.col("fsize")), "left").select("source", "size", "n", (F.col("copies") + F.coalesce("more", F.lit(0))).alias("copies"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(key, source, size, source_size, target, copies) of every row."""
    own = common.settle(sizes(docs, key, text, source), "sizes")
    cells = common.settle(own.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    counts = cells.groupBy("source").agg(F.sum("n").alias("documents")).withColumnRenamed("source", "at")
    goals = targets(cells, weights, cap)
    goals = goals.join(counts, goals["source"].eqNullSafe(counts["at"])).drop("at")
    state = multipliers(cells, goals, cap)
    of = common.settle(cell_copies(cells, state, cap), "cell-copies")
    facts = of.join(state.select(F.col("source").alias("at"), "source_size", "target"), of["source"].eqNullSafe(F.col("at"))).select(F.col("source").alias("cs"), F.col("size").alias("csize"), "n", "copies", "source_size", "target")
    rows = own.join(facts, own["source"].eqNullSafe(facts["cs"]) & (own["size"] == facts["csize"])).drop("cs", "csize")
    deal = F.xxhash64("key", F.lit(7))
    rows = rows.withColumn("deal", deal).withColumn("buckets", F.ceil(F.col("n") / BUCKET))
    rows = rows.withColumn("cell", F.struct("source", "size", F.pmod("deal", F.col("buckets")).alias("bucket")))
    base = F.when(F.col("n") > 0, F.floor(F.col("copies") / F.col("n"))).otherwise(0)
    in_cell = Window.partitionBy("cell")
    place, here = F.row_number().over(in_cell.orderBy("deal", "key")), F.count("*").over(in_cell)
    extra = F.col("copies") - base * F.col("n")
    # one bucket: exactly the extra copies; several: their share of this bucket, with a fraction that evens out over buckets
    share = here * (extra / F.col("n")) + F.pmod((F.col("cell.bucket") + 0.5) * 0.6180339887498949, F.lit(1.0))
    lucky = place <= F.when(F.col("buckets") <= 1, extra).otherwise(F.floor(share))
    return rows.select("key", "source", "size", "source_size", "target", (base + lucky.cast("long")).cast("long").alias("copies")).withColumnRenamed("key", key)


def apply_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with each row repeated as often as the mix takes it; rows that it takes 0 times go. Rows of one key share a count."""
    taken = mix(docs, key, text, source).groupBy(key).agg(F.max("copies").alias("__copies")).withColumnRenamed(key, "__key")
    rows = docs.join(taken, docs[key].eqNullSafe(taken["__key"])).where("__copies > 0")
    return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("__copy")).drop("__copy")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
