"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents.

Each stage is a function of (spark, docs, sf_dir) that works on all its predecessor kept: documents found toxic go, one
document of each group of near-duplicates stays, secrets are replaced in the texts, sources are mixed to their target
weights (a document comes as often as the mix takes it), and what is left is encoded.

Defined results: a null text is an empty one to every stage, and stays null where it is returned; null keys are documents
of their own, which no near-duplicate removes; rows of one key with different texts or columns are one document and stay
or go together, exactly repeated rows are left once by the second stage and mixed as documents of their own by the
fourth; empty texts have no words, so the mix takes none of them; an empty table gives empty results. Columns besides
those of documents pass through all stages but the last as they are; no stage adds a column to theirs, so names cannot
clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.llm import bpe, common, mixing, neardup, secrets, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold, by a model trained on the labelled among them."""
    return toxicity.keep_clean(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates; of exactly repeated rows one."""
    found = neardup.near_duplicates(docs).select("doc_id", "kept")
    gone = common.settle(found.where("not kept").select("doc_id").distinct(), "dropped")
    left = docs.join(common.small_or_not(gone), "doc_id", "left_anti").select(*docs.columns)
    several = common.settle(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "repeated")
    if several.isEmpty():
        return left
    some = common.small_or_not(several)
    again = left.where("doc_id is null").unionByName(left.join(some, "doc_id", "left_semi").select(*docs.columns))
    return left.where("doc_id is not null").join(some, "doc_id", "left_anti").select(*docs.columns).unionByName(again.dropDuplicates())


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.apply_mix(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and digests of the ids and of what they decode to, for every row."""
    both = bpe.encode(docs, decoded=True)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_duplicates),
    ("secret scans", replace_secrets),
    ("mixing", mix_sources),
    ("byte-level bpe", encode_texts),
]

#: Training and iterated rounding have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
