"""Embedding near-duplicates by an epsilon grid order join (Boehm, Braunmueller, Krebs, Kriegel 2001).

Cosine similarity of at least c is a distance of at most e = sqrt(2 - 2c) between unit vectors. Vectors are projected on
the leading principal dimensions, which cannot lengthen distances, and sorted by the grid cells of width e they fall in.
Consecutive vectors make blocks, and consecutive blocks of a label make runs; pairs of runs, then of blocks, whose boxes
lie more than e apart in any of these dimensions are provably distant and never meet. A pair of runs is a tile: a block is
sent once to each tile of its run, not once to each block it meets, so with runs of a length that makes about as many
tiles as tasks, the vectors moved grow as their number times the root of that of the tasks. Inside a pair of blocks the
two sequences are halved recursively, again skipping distant halves, down to small matrices whose products are computed
in double precision. Which axes the grid takes changes no result, only what is skipped, so they are fitted on a sample.

Equal vectors under one label are one class, so copies cost one row. A pair of blocks returns for each class the number
of vectors linked and the edges of a spanning forest, never the list of links, so output grows with rows alone.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those with a null label,
link with nothing; vectors of different lengths do not link; a null id has a null component and links with nothing;
repeated rows are vectors of their own; rows of one id with different vectors are one node of the components; an empty
table gives an empty result; only the three named columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.llm import common
from tideframe.llm.components import components

COSINE = 0.98
#: Leading principal dimensions of the grid, vectors of a block, rows of a matrix at the end of the recursion.
DIMENSIONS, BLOCK, LEAF = 8, 1024, 128
#: Vectors that the axes are fitted on, lengths of vectors that get axes of their own, bytes of a run that a task holds.
SAMPLE, LENGTHS, RUN_BYTES = 20_000, 16, 32 << 20
SLACK = 1e-9


def vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, label, sig, vec) of every row; sig and vec (64-bit floats) are null where the vector links with nothing."""
    common.with_workers(table.sparkSession)
    kinds = [table.schema[c].dataType.simpleString() for c in (key, label)]

    def packed(k, lab, x) -> bytes | None:
        if k is None or lab is None or not x or None in x:
            return None
        v = np.array(x, np.float64) + 0.0
        return v.tobytes() if np.isfinite(v).all() and v.any() else None

    def run(batches):
        for batch in batches:
            vecs = [packed(*r) for r in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True)]
            sigs = [None if v is None else xxhash.xxh3_128_digest(v) for v in vecs]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sigs, pa.binary()), pa.array(vecs, pa.binary())], names=["key", "label", "sig", "vec"])

    own = table.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("vec"))
    return own.mapInArrow(run, f"key {kinds[0]}, label {kinds[1]}, sig binary, vec binary")


def _units(vecs: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(vecs), np.float64).reshape(len(vecs), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares stay finite
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal(classes: DataFrame, n: int, count: int) -> dict[int, np.ndarray]:
    """Leading principal directions (length x count) of the unit vectors of each of the LENGTHS most frequent lengths, of
    about SAMPLE vectors of n, by the hash of their names; other lengths take their first coordinates."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for d, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(d, []).append(v)
        most = sorted(held, key=lambda d: (-len(held[d]), d))[:LENGTHS]
        axes = []
        for d in most:
            x = _units(held[d])
            axes.append(np.ascontiguousarray(np.linalg.eigh(x.T @ x)[1][:, ::-1][:, : min(d, count)]).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(most, pa.int32()), pa.array(axes, pa.binary())], names=["dim", "axes"])

    some = classes.where(F.pmod(F.xxhash64("sig"), F.lit(max(1, n // SAMPLE))) == 0).select("dim", "vec")
    found = some.repartition(1).mapInArrow(run, "dim int, axes binary").collect()
    return {r.dim: np.frombuffer(r.axes, np.float64).reshape(r.dim, -1) for r in found}


def blocks(classes: DataFrame, axes: dict[int, np.ndarray], epsilon: float, size: int = BLOCK, run: int = 1) -> DataFrame:
    """(block, run, label, dim, lo, hi, reps, sigs, ns, vecs): the classes in epsilon grid order, size to a block; run names
    as many blocks of a label and length in a row."""
    kinds = {c: classes.schema[c].dataType.simpleString() for c in ("label", "rep")}
    count = DIMENSIONS

    def place(batches):
        for batch in batches:
            dims, vecs = batch.column("dim").to_pylist(), batch.column("vec").to_pylist()
            spots = [np.zeros(count)] * len(vecs)
            for d in set(dims):
                at = [i for i, x in enumerate(dims) if x == d]
                cast = _units([vecs[i] for i in at]) @ (axes[d] if d in axes else np.eye(d, min(d, count)))
                for i, row in zip(at, cast, strict=True):
                    spots[i] = np.pad(row, (0, count - len(row)))
            cells = np.floor(np.array(spots).reshape(-1, count) / epsilon).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tolist() for c in cells], pa.list_(pa.int64())), pa.array([p.tolist() for p in spots], pa.list_(pa.float64()))], names=[*batch.schema.names, "cell", "spot"])

    def cut(batches):
        first, held, serial, in_run, last = TaskContext.get().partitionId() << 32, [], 0, (0, 0), None

        def block():
            nonlocal held, serial, in_run, last
            spots = np.array([r["spot"] for r in held])
            of = held[0]["label"], held[0]["dim"]
            in_run = (in_run[0], in_run[1] + 1) if of == last and in_run[1] + 1 < run else (serial, 0)
            last = of
            row = {"block": first + serial, "run": first + in_run[0], "label": held[0]["label"], "dim": held[0]["dim"], "lo": spots.min(0).tolist(), "hi": spots.max(0).tolist()}
            row |= {"reps": [r["rep"] for r in held], "sigs": [r["sig"] for r in held], "ns": [r["n"] for r in held], "spots": spots.tobytes(), "vecs": b"".join(r["vec"] for r in held)}
            held, serial = [], serial + 1
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            schema = pa.schema([("block", pa.int64()), ("run", pa.int64()), ("label", batch.schema.field("label").type), ("dim", pa.int32()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("reps", pa.list_(batch.schema.field("rep").type)), ("sigs", pa.list_(pa.binary())), ("ns", pa.list_(pa.int64())), ("spots", pa.binary()), ("vecs", pa.binary())])
            for r in batch.to_pylist():
                if held and (len(held) == size or (held[0]["label"], held[0]["dim"]) != (r["label"], r["dim"])):
                    yield block()
                held.append(r)
        if held:
            yield block()

    base = f"label {kinds['label']}, dim int, sig binary, rep {kinds['rep']}, n long, vec binary"
    placed = classes.select("label", "dim", "sig", "rep", "n", "vec").mapInArrow(place, f"{base}, cell array<long>, spot array<double>")
    keys = ["label", "dim", "cell", "sig"]
    ordered = placed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(cut, f"block long, run long, label {kinds['label']}, dim int, lo array<double>, hi array<double>, reps array<{kinds['rep']}>, sigs array<binary>, ns array<long>, spots binary, vecs binary")


class Side:
    """One block's arrays; slices keep their boxes."""

    def __init__(self, dim: int, n: int, spots: bytes, vecs: bytes):
        self.spots = np.frombuffer(spots, np.float64).reshape(n, -1)
        self.raw = np.frombuffer(vecs, np.float64).reshape(n, dim)
        self.units = _units([vecs[i * dim * 8 : (i + 1) * dim * 8] for i in range(n)])


def join_sequences(a: Side, b: Side, same: bool, epsilon: float, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all links between two sequences in grid order; of a sequence with itself those with i < j."""
    out_i, out_j = [], []

    def boxes(s: Side, at: slice):
        part = s.spots[at]
        return part.min(0), part.max(0)

    def go(x: slice, y: slice) -> None:
        if same and x.start >= y.stop:
            return
        (alo, ahi), (blo, bhi) = boxes(a, x), boxes(b, y)
        if np.maximum(alo - bhi, blo - ahi).max() > epsilon + SLACK:
            return
        nx, ny = x.stop - x.start, y.stop - y.start
        if nx <= LEAF and ny <= LEAF:
            sim = a.units[x] @ b.units[y].T
            i, j = np.nonzero(sim >= cosine - SLACK)
            near = np.flatnonzero(sim[i, j] < cosine + SLACK)  # too close to call from rounded unit vectors
            good = np.ones(len(i), bool)
            for k in near:
                p, q = a.raw[x][i[k]], b.raw[y][j[k]]
                good[k] = math.fsum(p * q) / (math.sqrt(math.fsum(p * p)) * math.sqrt(math.fsum(q * q))) >= cosine
            i, j = i[good] + x.start, j[good] + y.start
            if same:
                i, j = i[i < j], j[i < j]
            out_i.append(i)
            out_j.append(j)
            return
        halves = lambda s: [s] if s.stop - s.start <= LEAF else [slice(s.start, (s.start + s.stop) // 2), slice((s.start + s.stop) // 2, s.stop)]
        for p in halves(x):
            for q in halves(y):
                go(p, q)

    go(slice(0, len(a.raw)), slice(0, len(b.raw)))
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *out_i]), np.concatenate([empty, *out_j])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least place that each of n places reaches by the links i - j."""
    root = np.arange(n)
    while len(i):
        was = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == was).all():
            break
    return root


def tiles(cut: DataFrame, epsilon: float) -> DataFrame:
    """(a, b) of all pairs of runs, each with itself too, whose boxes are not more than epsilon apart: an equi-join on label,
    length and the grid cells of the first dimension, which order runs, then all dimensions."""
    edge = lambda fn, c: F.array(*[fn(F.get(c, F.lit(i))) for i in range(DIMENSIONS)]).alias(c)
    boxes = cut.groupBy("run", "label", "dim").agg(edge(F.min, "lo"), edge(F.max, "hi"))
    reach = lambda c, e: F.explode(F.sequence(F.floor((F.element_at("lo", 1) - e) / epsilon), F.floor((F.element_at("hi", 1) + e) / epsilon))).alias(c)
    left = boxes.select(F.col("run").alias("a"), "label", "dim", F.col("lo").alias("alo"), F.col("hi").alias("ahi"), reach("cell", epsilon + SLACK))
    right = boxes.select(F.col("run").alias("b"), "label", "dim", "lo", "hi", reach("cell", 0.0))
    apart = F.array_max(F.zip_with(F.zip_with("alo", "hi", lambda x, y: x - y), F.zip_with("lo", "ahi", lambda x, y: x - y), lambda x, y: F.greatest(x, y)))
    return left.join(right, ["label", "dim", "cell"]).where((F.col("a") <= F.col("b")) & (apart <= epsilon + SLACK)).select("a", "b").distinct()


def tile_links(cut: DataFrame, epsilon: float, cosine: float, kinds: dict[str, str]) -> DataFrame:
    """(label, sig, more, rep, root): for each class of a pair of blocks how many vectors of the other it is linked with, and
    the least class that it reaches by links between the two."""
    sides = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("run")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("run")), F.struct(F.lit(1).alias("side"), F.col("b").alias("run"))))
    sent = tiles(cut, epsilon).select("a", "b", F.inline(sides)).join(cut.select("run", "block", "label", "dim", "reps", "sigs", "ns", "spots", "vecs"), "run")
    # a tile's first run comes before its second, so one task reads the second past the first
    dealt = sent.repartition("a", "b").sortWithinPartitions("a", "b", "side", "block")

    def links(x: tuple, y: tuple, schema):
        (v, a), (w, b), same = x, y, x is y
        i, j = join_sequences(a, b, same, epsilon, cosine)
        if not len(i):
            return
        shift = 0 if same else len(v["reps"])
        reps, sigs = (v["reps"], v["sigs"]) if same else (v["reps"] + w["reps"], v["sigs"] + w["sigs"])
        ns = np.array(v["ns"] if same else v["ns"] + w["ns"], np.int64)
        more = np.zeros(len(reps), np.int64)
        np.add.at(more, i, ns[j + shift])
        np.add.at(more, j + shift, ns[i])
        root = forest(len(reps), i, j + shift)
        hit = np.flatnonzero(more)
        label, key = schema.field("label").type, schema.field("reps").type.value_type
        yield pa.RecordBatch.from_arrays(
            [pa.array([v["label"]] * len(hit), label), pa.array([sigs[k] for k in hit], pa.binary()), pa.array(more[hit], pa.int64()), pa.array([reps[k] for k in hit], key), pa.array([reps[root[k]] for k in hit], key)],
            names=["label", "sig", "more", "rep", "root"],
        )

    def run(batches):
        tile, held = None, []
        for batch in batches:
            for r in range(batch.num_rows):
                v = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                if (v["a"], v["b"]) != tile:
                    tile, held = (v["a"], v["b"]), []
                own = v, Side(v["dim"], len(v["reps"]), v.pop("spots"), v.pop("vecs"))
                for other in held:
                    if v["side"] or v["a"] == v["b"]:
                        yield from links(other, own, batch.schema)
                if not v["side"]:
                    held.append(own)
                if v["a"] == v["b"]:
                    yield from links(own, own, batch.schema)

    columns = ["a", "b", "side", "label", "dim", "reps", "sigs", "ns", "spots", "vecs"]
    return dealt.select(*columns).mapInArrow(run, f"label {kinds['label']}, sig binary, more long, rep {kinds['key']}, root {kinds['key']}")


def near_duplicates(table: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = BLOCK) -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    common.with_workers(table.sparkSession)
    epsilon = math.sqrt(2.0 - 2.0 * cosine)
    rows = common.settle(vectors(table, key, vector, label), "vectors")
    full = rows.where("sig is not null")
    classes = full.groupBy("label", "sig").agg(F.min("key").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    classes = common.settle(classes.withColumn("dim", (F.length("vec") / 8).cast("int")), "vector-classes")
    n, widest = classes.agg(F.count(F.lit(1)), F.max("dim")).first()
    tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run = max(1, min(math.ceil(n / block / math.sqrt(2 * tasks)), RUN_BYTES // (block * 8 * max(widest or 1, 1))))
    cut = common.settle(blocks(classes, principal(classes, n, DIMENSIONS), epsilon, block, run), "blocks")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("label", "key")}
    linked = common.settle(tile_links(cut, epsilon, cosine, kinds), "linked")
    repeated = common.held(full.groupBy("key").agg(F.min(F.struct("label", "sig")).alias("x"), F.max(F.struct("label", "sig")).alias("y")).where("x != y").select("key"))
    several = full.join(common.small_or_not(repeated), "key", "left_semi").select("key", "label", "sig").join(classes, ["label", "sig"]).select(F.col("key").alias("a"), F.col("rep").alias("b"))
    found = components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b")).union(several))
    repeated.unpersist()
    counts = linked.groupBy("label", "sig").agg(F.sum("more").alias("more"))
    facts = classes.select("label", "sig", "rep", "n").join(counts, ["label", "sig"], "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    facts = facts.select("label", "sig", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = rows.select("key", "label", "sig").join(facts, ["label", "sig"], "left")
    component = F.coalesce("component", "key")
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("key"), F.lit(True)).alias("kept"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, c.component_id = e.vec_id AS kept
FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
