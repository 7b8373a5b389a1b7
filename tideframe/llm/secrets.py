"""Secret scans over an incremental blob ledger, with DataFrame functions alone.

Each historical version of a path is addressed by the sha256 of its text (its blob). The ledger, a Parquet table that
update() appends to, records which rule versions have been run on which blob and what they found, so a scan takes each
distinct blob once, runs only the rule versions the ledger lacks for it, appends one row per blob, and joins findings back
to every path that holds the blob, with the commit, time or whatever other columns name its version.

Spans are found with two regular expression passes: the pieces between matches (split) and the matches themselves
(regexp_extract_all) come in the same order, so running sums of their lengths are the places, in code points.

Defined results: null text is the empty text, which has a blob like any other; null paths are kept; repeated rows each
get their findings; an empty table gives an empty result; only the named key and text columns are read, so other columns
cannot clash. Spans of different kinds may overlap; within a kind they cannot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.llm import common


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of pattern whose group has min_chars characters or more; base rules make the base digest."""

    kind: str
    pattern: str
    min_chars: int = 0
    group: int = 0
    version: int = 1
    base: bool = False

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


#: In hex and access a shorter run holds no longer match, so the least length stands in the pattern.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, base=True),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 18, base=True),
    Rule("hex", r"[0-9a-f]{16,}", 16, base=True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
#: Blobs with findings that redact() sends to every worker at most.
FEW_FINDINGS = 100_000
SPANS = "array<struct<start:int,kind:int,end:int>>"


def rule_spans(text: Column, rule: Rule, kind: int) -> Column:
    """Places of a rule's matches in text, as an array of (start, kind, end)."""
    hits, values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    lengths = F.zip_with(hits, values, lambda h, v: F.struct(F.length(h).alias("hit"), F.length(v).alias("value")))
    steps = F.zip_with(F.split(text, rule.pattern, -1), lengths, lambda gap, x: F.struct(F.length(gap).alias("gap"), x["hit"].alias("hit"), x["value"].alias("value")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["hit"], F.lit(0))
        found = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["value"] >= rule.min_chars, F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))
    return F.when(text.rlike(rule.pattern), F.aggregate(steps, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPANS))


def versions(docs: DataFrame, key: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """(path, *also, blob, text) of every row; also names columns that tell the versions of a path apart."""
    own = docs.select(F.col(key).alias("path"), *also, common.text_or_empty(text).alias("text"))
    return own.select("path", *also, F.sha2("text", 256).alias("blob"), "text")


def unseen(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ledger rows (blob, rules array<string>, spans) for the pairs of blob and rule version that ledger lacks."""
    blobs = versions(docs, key, text).groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is not None:
        known = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("known"))
        blobs = blobs.join(known, "blob", "left")
    known = F.coalesce(F.col("known"), F.array().cast("array<string>")) if ledger is not None else F.array().cast("array<string>")
    todo = F.array_except(F.array(*[F.lit(r.id) for r in rules]), known)
    found = [F.when(F.array_contains(known, r.id), F.array().cast(SPANS)).otherwise(rule_spans(F.col("text"), r, k)) for k, r in enumerate(rules)]
    return blobs.where(F.size(todo) > 0).select("blob", todo.alias("rules"), F.concat(*found).alias("spans"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that ledger lacks, settled in the shared folder."""
    return common.settle(unseen(docs, ledger, rules, key, text), "blob-ledger")


def open_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger table at path; None where there is none yet."""
    return spark.read.schema(f"blob string, rules array<string>, spans {SPANS}").parquet(path) if common.exists(spark, path) else None


def update(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Append to the ledger table at path what it lacks for docs, and return the table. A run that fails appends nothing."""
    spark = docs.sparkSession
    unseen(docs, open_ledger(spark, path), rules, key, text).write.mode("append").parquet(path)
    return open_ledger(spark, path)


def findings(docs: DataFrame, ledger: DataFrame, key: str = "doc_id", text: str = "text", once: bool = False, also: tuple[str, ...] = ()) -> DataFrame:
    """(path, *also, blob, spans) of every row, spans empty where nothing is found. once: ledger has at most one row per blob."""
    found = ledger.where(F.size("spans") > 0).select("blob", "spans")
    if not once:
        found = found.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    return versions(docs, key, text, also).select("path", *also, "blob").join(found, "blob", "left").select("path", *also, "blob", F.array_sort(F.coalesce("spans", F.array().cast(SPANS))).alias("spans"))


def spelled(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with each stretch that spans cover, overlaps taken together, replaced by mark. spans must be sorted."""

    def step(acc: Column, s: Column) -> Column:
        cut = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], cut).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with the secrets of each text replaced and n_chars, where there is one, counted anew; no row is dropped."""
    own = docs.withColumn("__blob", F.sha2(common.text_or_empty(text), 256))
    found = scan(docs, None, rules, docs.columns[0], text).where(F.size("spans") > 0).select(F.col("blob").alias("__blob"), F.array_sort("spans").alias("__spans"))
    out = own.join(common.small_or_not(found, FEW_FINDINGS), "__blob", "left").withColumn(text, F.when(F.col("__spans").isNull(), F.col(text)).otherwise(redacted(common.text_or_empty(text), F.col("__spans"))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base digest and all spans of every document."""
    docs = common.table(spark, sf_dir, "documents")
    rows = findings(docs, update(docs, common.temporary(spark, "blob-ledger")), once=True)

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    n = {r.kind: count(k).alias(f"n_{r.kind}") for k, r in enumerate(RULES) if r.base}
    base = F.filter("spans", lambda s: s["kind"] < len(n))
    return rows.select(F.col("path").alias("doc_id"), *n.values(), F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))


def _oracle() -> str:
    """DuckDB SQL: the same matches, with places from the pieces between them."""
    parts = []
    for k, r in enumerate(RULES):
        pattern = r.pattern.replace("(?i:password|passwd|secret|token|api_?key)", "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")).replace("'", "''")
        parts.append(f"""
  SELECT doc_id, {k} AS kind, '{r.kind}' AS name, i, len(gaps[i]) AS gap, len(hits[i]) AS hit, len(vals[i]) AS val, {r.min_chars} AS least FROM (
    SELECT doc_id, gaps, hits, vals, unnest(range(1, len(hits) + 1)) AS i FROM (
      SELECT doc_id, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS hits, regexp_extract_all(t, '{pattern}', {r.group}) AS vals FROM d))""")
    base = ", ".join(f"count(*) FILTER (WHERE kind = {k}) AS n_{r.kind}" for k, r in enumerate(RULES) if r.base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({" UNION ALL ".join(parts)}
), s AS (
  SELECT *, (sum(gap + hit) OVER (PARTITION BY doc_id, kind ORDER BY i))::BIGINT AS e FROM m
), k AS (
  SELECT doc_id, kind, e - hit AS s, name || ':' || (e - hit) || ':' || e AS span FROM s WHERE val >= least
), g AS (
  SELECT doc_id, {base}, string_agg(span, ',' ORDER BY s, kind) FILTER (WHERE kind < 3) AS base, string_agg(span, ',' ORDER BY s, kind) AS spans FROM k GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


OP1_SQL = _oracle()
