"""Quality rules as a short-circuit cascade.

A cascade of rules gives the verdict: each rule's cost (seconds a document) and rejection rate are measured on a bounded
sample of the whole table, the rules are sorted by rejections per second, and a document runs through them in that order
until one rejects it. The order changes only how soon a document leaves, never whether it is kept, so results do not
depend on the measured times. keep_good() filters by it; apply_rules() also returns base statistics of every document,
which its rules then read instead of computing them again.

Defined results: null and empty texts have no words, so the base rule rejects them; repeated rows are judged each; ties in
a rule's figures keep the listed order; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.llm import common

SPACES, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
#: Rows that the measuring sample holds at most.
SAMPLE_ROWS = 512


class Document:
    """One text with what several rules ask for, computed once when first asked: document[name of a figure]."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.data = self.text.encode()
        self.words = self.data.split()
        self.n_words = len(self.words)
        self.known: dict[str, int] = {"n_words": self.n_words}

    def __getitem__(self, name: str) -> int:
        if name not in self.known:
            self.known[name] = FIGURES[name](self)
        return self.known[name]


def word_chars(d: Document) -> int:
    return len(d.text) - (len(d.data) - len(d.data.translate(None, SPACES)))


def n_symbols(d: Document) -> int:
    return len(d.data) - len(d.data.translate(None, SYMBOLS))


def n_dup_lines(d: Document) -> int:
    if b"\n" not in d.data:
        return 0
    lines = [x for x in d.data.split(b"\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def n_repeat_words(d: Document, width: int = 5) -> int:
    """Words inside windows of width words whose words stand twice or more in the text, the first time included."""
    n = d.n_words - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter([ids.setdefault(w, len(ids)) for w in d.words], np.int64, d.n_words)
    window, bound = codes[:n], len(ids)
    for k in range(1, width):  # exact: numbers that could pass 63 bits are dealt anew
        if bound * len(ids) >= 1 << 62:
            window, bound = np.unique(window, return_inverse=True)[1], n
        window, bound = window * len(ids) + codes[k : k + n], bound * len(ids)
    _, which, count = np.unique(window, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(count[which] > 1)
    if not len(hit):
        return 0
    edge = np.zeros(d.n_words + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 10 or 100 * n_repeat > 20 * n_words


FIGURES = {"word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words, "n_distinct": lambda d: len(set(d.words)), "n_lines": lambda d: d.data.count(b"\n") + 1}
#: The figures that apply_rules() returns for every document.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The cascade's rules: name -> whether a document is rejected. Integer arithmetic, so that any engine agrees.
RULES = {
    "mean_word_length": lambda d: not 2 * d.n_words <= d["word_chars"] <= 20 * d.n_words,
    "symbol_ratio": lambda d: 10 * d["n_symbols"] > 3 * d.n_words,
    "duplicate_lines": lambda d: 10 * d["n_dup_lines"] > 3 * d["n_lines"],
    "few_distinct_words": lambda d: d.n_words >= 50 and d["n_distinct"] < 50 and 20 * d["n_distinct"] < d.n_words,
}
#: The base rule in two, for a cascade that returns no figures and so takes costly ones only where all else passes.
BASE_RULES = {"few_words": lambda d: d.n_words < 10, "repeated_words": lambda d: 100 * d["n_repeat_words"] > 20 * d.n_words}


def measure(docs: DataFrame, rules: dict = RULES, key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS, owed: tuple = ()) -> list[tuple[str, float, float]]:
    """(rule, seconds a document, share rejected) on a sample of at most rows rows, taken by the hash of the key from all
    of docs. owed: figures that each document has in any case, so that rules which read them cost no more than that.

    Texts are judged where they are; the driver takes a few numbers a row of the sample.
    """
    common.with_workers(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                out = []
                for t in batch.column(0).slice(start, 64).to_pylist():
                    figures = Document(t)
                    known = {c: figures[c] for c in owed}
                    for name, rejects in rules.items():
                        d = Document(t)
                        d.known |= known
                        began = time.perf_counter()
                        bad = bool(rejects(d))
                        out.append((name, time.perf_counter() - began, bad))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["rule", "s", "bad"])

    part = max(1, docs.count() // rows)
    some = docs.where(F.pmod(F.xxhash64(key), F.lit(part)) == 0).select(F.col(text).cast("string"))
    found = some.mapInArrow(run, "rule string, s double, bad boolean").limit(rows * len(rules)).collect()
    figures = []
    for name in rules:
        own = [r for r in found if r.rule == name]
        figures.append((name, sum(r.s for r in own) / max(len(own), 1), sum(r.bad for r in own) / max(len(own), 1)))
    return figures


def order(figures: list[tuple[str, float, float]], rules: dict = RULES) -> list[str]:
    """Rules by rejections per second, best first; ties, and rules without figures, keep the listed order."""
    rate = {r: share / max(cost, 1e-9) for r, cost, share in figures}
    return sorted(rules, key=lambda r: -rate.get(r, 0.0))


def apply_rules(docs: DataFrame, rules: dict = RULES, ordered: list[str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, base statistics, base_failed and kept. A map over the input, without a shuffle."""
    common.with_workers(docs.sparkSession)
    names = ordered if ordered is not None else order(measure(docs, rules, key, text, owed=COUNTS), rules)
    cascade = [rules[r] for r in names]
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                d = Document(t)
                failed = base_failed(d.n_words, d["n_repeat_words"])
                rows.append((*[d[c] for c in COUNTS], failed, not failed and not any(rejects(d) for rejects in cascade)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:5]], *[pa.array(c, pa.bool_()) for c in cols[5:]]], names=["key", *COUNTS, "base_failed", "kept"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean").withColumnRenamed("key", key)


def keep_good(docs: DataFrame, rules: dict | None = None, ordered: list[str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that no rule rejects, all columns as they are: a document leaves at its first rule, and a figure is
    computed only if a rule that is reached asks for it."""
    common.with_workers(docs.sparkSession)
    rules = BASE_RULES | RULES if rules is None else rules
    cascade = [rules[r] for r in (order(measure(docs, rules, key, text), rules) if ordered is None else ordered)]
    place = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            good = []
            for t in batch.column(place).to_pylist():
                d = Document(t)
                good.append(not any(rejects(d) for rejects in cascade))
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(common.table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM hit, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id
), f AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
           - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words, len(string_split(t, chr(10))) AS n_lines, len(list_distinct(w)) AS n_distinct
  FROM d LEFT JOIN rep USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 10 * n_symbols > 3 * n_words OR 10 * n_dup_lines > 3 * n_lines
            OR (n_words >= 50 AND 20 * n_distinct < n_words AND n_distinct < 50)) AS kept
FROM f
"""
