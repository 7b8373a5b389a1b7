"""MinHash near-duplicate detection with SetSketch registers (Ertl 2021).

A register holds the least of exponentially distributed hash values over a document's set of word shingles, on an
exponentially spaced scale: K = floor(1 - log_b(min)), truncated to 0..Q+1. Registers merge by maximum and are
locality-sensitive: equal with a probability close to the sets' Jaccard similarity. Bands of registers make buckets;
pairs that meet in a bucket are kept if their similarity, estimated jointly from all registers by likelihood, may reach
the threshold, and are then confirmed on the full sets.

Documents with the same set are one class, so exact copies cost one row. A bucket's members are not expanded into
pairs: each is compared with one hub, and what is linked joins into components. Buckets that then still hold several
components (mostly documents that share a passage, far below the threshold) are completed exactly: over the documents
in them, shingles are ordered from rare to common, and two sets of the wanted similarity must share a shingle among the
first quarter of theirs (prefix filter of Chaudhuri, Ganti, Kaushik 2006), where a passage of many documents is not.
Only members of different components meet there, those of a shingle's main component on one side alone.
With 24 bands of 3 registers a pair at similarity 0.75 meets in a bucket with a probability of 0.999998.

Defined results: null or empty text has an empty set, linked with nothing; a null key is linked with nothing and has a
null component_id; rows with the same key are one document that holds each of their texts; repeated rows get a row each;
only the key and text columns are read, so others cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideframe.llm import common, shingles
from tideframe.llm.components import components
from tideframe.llm.shingles import packed, slices, unpacked

BANDS, ROWS = 24, 3
REGISTERS = BANDS * ROWS
#: SetSketch parameters: base of the scale, rate of the exponential values, largest register.
BASE, RATE, Q = 1.001, 20.0, (1 << 16) - 2
PERCENT = 75
#: A pair is dropped unverified only if its likelihood at the threshold is below the best by this many nats.
NATS = 14.0


@lru_cache(1)
def _seeds() -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    mixed = shingles.mix(at)
    return mixed[:REGISTERS], mixed[REGISTERS:] | np.uint64(1)


def sketch(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Registers (sets x REGISTERS, uint16) of consecutive non-empty sets that begin at starts."""
    xors, odds = _seeds()
    lowest = np.empty((REGISTERS, len(starts)), np.uint64)
    for i in range(REGISTERS):
        lowest[i] = np.minimum.reduceat((hashes ^ xors[i]) * odds[i], starts)
    least = -np.log1p(-(lowest.T.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1.0 - np.log(least) / np.log(BASE)), 0, Q + 1).astype(np.uint16)


def log_likelihood(j: np.ndarray, more: np.ndarray, less: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Joint likelihood of similarity j for registers above, below and equal, u being the first set's share of both sizes."""
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    v = 1.0 - u
    above, below = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
    return more * np.log(above) + less * np.log(below) + (REGISTERS - more - less) * np.log(np.maximum(1.0 - above - below, 1e-12))


def may_link(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether pairs of sketches (rows of uint16) with known set sizes may have a similarity of percent or more."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    u = na / (na + nb)
    top = np.minimum(na, nb) / np.maximum(na, nb)
    grid = np.linspace(0.0, 1.0, 101)[:, None]
    best = log_likelihood(grid * top, more, less, u)
    at = np.minimum(percent / 100, top)
    above = best[grid[:, 0] >= 0].max(0)
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (np.maximum(log_likelihood(at, more, less, u), np.where(grid * top >= at, best, -np.inf).max(0)) >= above - NATS)


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, sig, sketch) of every row; sig names the set, and both it and the sketch are null for an empty set."""
    common.with_workers(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for part in slices(batches, 256, 1):
            sets = [shingles.shingle_set(t) for t in part.column(1).to_pylist()]
            full = [s for s in sets if len(s)]
            rows = iter(sketch(np.concatenate(full), np.cumsum([0, *[len(s) for s in full[:-1]]])) if full else ())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(rows).astype(">u2").tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["key", "n_shingles", "sig", "sketch"],
            )

    own = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(run, f"key {kind}, n_shingles long, sig binary, sketch binary")


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of class representatives, those whose sketches allow the similarity."""
    side = lambda c: classes.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))

    def run(batches):
        for part in slices(batches, 1024):
            regs = [np.frombuffer(b"".join(part.column(c).to_pylist()), ">u2").reshape(-1, REGISTERS) for c in ("sa", "sb")]
            sizes = [part.column(c).to_numpy().astype(np.float64) for c in ("na", "nb")]
            yield part.select(["a", "b"]).filter(pa.array(may_link(*regs, *sizes, percent)))

    kind = classes.schema["rep"].dataType.simpleString()
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}")


def _verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of keys of docs (key, text), those whose full sets are similar enough."""
    texts = common.settle(packed(_texts(docs, pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct())), "packed-texts")
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches):
        last, first = None, None
        for part in slices(batches, 256):
            a, ta, tb = (part.column(c).to_pylist() for c in ("a", "ta", "tb"))
            keep = []
            for x, y, z in zip(a, ta, tb, strict=True):
                if (x, y) != last:
                    last, first = (x, y), shingles.shingle_set(unpacked(y))
                other = shingles.shingle_set(unpacked(z))
                both = np.concatenate([first, other])
                both.sort()
                common_n = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common_n >= percent * (len(both) - common_n))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    at_b = pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")
    rows = at_b.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
    return rows.mapInArrow(run, f"a {kind}, b {kind}")


def _texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of docs (key, text) with one of keys; keys go to every worker only if they are few."""
    return docs.join(common.small_or_not(common.settle(keys, "keys")), "key", "left_semi")


def _prefix_pairs(docs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members (rep, n, component) of different components whose sets may be similar enough: no such pair is left out."""
    common.with_workers(docs.sparkSession)
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches):
        for part in slices(batches, 256, 1):
            sets = [shingles.shingle_set(t) for t in part.column(1).to_pylist()]
            tokens = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
            rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            names = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(names[rows]), pa.array(tokens)], names=["rep", "set", "token"])

    texts = _texts(docs, members.select(F.col("rep").alias("key")))
    tokens = common.settle(texts.select("key", "text").mapInArrow(run, f"rep {kind}, set long, token long").distinct(), "tokens")  # a key may have several sets
    # kept before it is joined: a join of two plain shuffles can split a hot key, one of an aggregate cannot
    often = common.held(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"))
    shared = common.settle(tokens.join(often, "token"), "shared-tokens")
    often.unpersist()
    # a set's prefix: its size less the least overlap of a link, plus one; tokens of no other document come first
    size = tokens.groupBy("rep", "set").agg(F.count("*").alias("n"))
    room = size.join(shared.groupBy("rep", "set").agg(F.count("*").alias("held")), ["rep", "set"]).withColumn("alone", F.col("n") - F.col("held"))
    room = room.withColumn("prefix", F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).where("prefix > alone").select("rep", "set", "n", "alone", "prefix")
    rank = F.row_number().over(Window.partitionBy("rep", "set").orderBy("df", "token"))
    prefix = shared.join(room, ["rep", "set"]).withColumn("rank", F.col("alone") + rank).where("rank <= prefix").select("token", "rep", "n", "rank")
    prefix = common.settle(prefix.join(members.select("rep", "component"), "rep"), "prefixes")
    counts = prefix.groupBy("token", "component").agg(F.count("*").alias("c"))
    main = counts.groupBy("token").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("components")).where("components > 1").select("token", "main")
    # kept, so that the pairs of a hot shingle can be split too
    main = common.held(main)
    open_ = common.held(prefix.join(main, "token"))
    one = open_.where("component != main").select("token", F.col("rep").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"), F.col("rank").alias("rx"))
    other = open_.select("token", "main", F.col("rep").alias("y"), F.col("component").alias("cy"), F.col("n").alias("ny"), F.col("rank").alias("ry"))
    # a link of sizes nx and ny has this overlap at least, so its first common token leaves room for it on both sides
    overlap = F.ceil((F.col("nx") + F.col("ny")) * percent / (100 + percent))
    fits = (F.col("cx") != F.col("cy")) & (F.col("rx") <= F.col("nx") - overlap + 1) & (F.col("ry") <= F.col("ny") - overlap + 1)
    once = (F.col("cy") == F.col("main")) | (F.col("x") < F.col("y"))  # a pair of two minor members meets twice
    pairs = common.settle(one.join(other, "token").where(fits & once).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "prefix-pairs")
    main.unpersist()
    open_.unpersist()
    return pairs


def links_to_components(docs: DataFrame, sketched: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(sig, component) of every class of documents with the same set; docs has the columns key and text."""
    full = sketched.where("sig is not null and key is not null")
    classes = full.groupBy("sig").agg(F.min("key").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = common.settle(classes, "classes")
    # a key with several texts joins their classes
    repeated = common.held(full.groupBy("key").agg(F.min("sig").alias("x"), F.max("sig").alias("y")).where("x != y").select("key"))
    several = full.join(common.small_or_not(repeated), "key", "left_semi").select("key", "sig").join(classes, "sig").select(F.col("key").alias("a"), F.col("rep").alias("b"))
    step = 2 * ROWS
    cells = F.explode(F.array(*[F.xxhash64(F.lit(i), F.substring("sketch", 1 + i * step, step)) for i in range(BANDS)]))
    rows = classes.select(cells.alias("cell"), "rep", "n")
    crowded = rows.groupBy("cell").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo != hi").select("cell", F.col("lo").alias("hub"))
    members = common.settle(rows.join(crowded, "cell").select("cell", "rep", "n", "hub"), "buckets")
    pairs = members.where("rep != hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = common.settle(_estimated(pairs, classes, percent), "pairs")
    links = common.settle(several.union(_verified(pairs, docs, percent)), "links")
    repeated.unpersist()
    found = components(links)
    # buckets that still hold several components, completed exactly
    own = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    own = common.settle(own, "buckets")
    mixed = own.groupBy("cell").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("cell")
    own = common.settle(own.join(mixed, "cell", "left_semi").groupBy("rep").agg(F.first("n").alias("n"), F.first("component").alias("component")), "open-members")
    if not own.isEmpty():
        pairs = common.settle(_estimated(_prefix_pairs(docs, own, percent), classes, percent), "pairs")
        found = components(links.union(_verified(pairs, docs, percent)))
    return classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("sig", F.coalesce("component", "rep").alias("component"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row; component_id is the smallest key reachable by links."""
    own = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    sketched = common.settle(sketches(docs, key, text), "sketches")
    of = links_to_components(own, sketched, percent)
    out = sketched.select("key", "n_shingles", "sig").join(of, "sig", "left")
    component = F.when(F.col("key").isNotNull(), F.coalesce("component", "key"))
    return out.select(F.col("key").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("key"), F.lit(True)).alias("kept"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), link AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * shared >= 75 * (na.n + nb.n - shared)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
