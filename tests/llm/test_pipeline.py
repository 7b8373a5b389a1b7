import collections

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tideframe.llm import bpe, mixing, neardup, secrets, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_against_their_operators_and_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    own = {r.doc_id: r for r in docs.collect()}
    steps = dict(corpus_pipeline.STAGES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash near-dedup", "secret scans", "mixing", "byte-level bpe"]

    clean = steps["toxicity"](spark, docs, SF)
    assert clean.columns == columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert {r.doc_id for r in clean.collect()} == {k for k, s in scores.items() if s < toxicity.THRESHOLD}

    first = steps["minhash near-dedup"](spark, clean, SF)
    assert first.columns == columns
    from test_neardup import brute

    groups = brute([(r.doc_id, r.text) for r in clean.collect()])
    assert {r.doc_id for r in first.collect()} == {k for k, _, c in groups if k == c}

    safe = steps["secret scans"](spark, first, SF)
    assert safe.columns == columns
    rows = {r.doc_id: r for r in safe.collect()}
    spans = {r.path: r.spans for r in secrets.findings(first, secrets.scan(first)).collect()}
    for k, found in spans.items():
        out, at, text = "", 0, own[k].text
        for s in sorted(found, key=lambda s: (s.start, s.kind, s.end)):
            if s.start >= at:
                out += text[at : s.start] + "[SECRET]"
            at = max(at, s.end)
        assert rows[k].text == out + text[at:]
        assert rows[k].n_chars == (len(rows[k].text) if found else own[k].n_chars)

    mixed = steps["mixing"](spark, safe, SF)
    assert mixed.columns == columns
    want = {r.doc_id: r.copies for r in mixing.mix(safe).collect() if r.copies}
    assert dict(collections.Counter(r.doc_id for r in mixed.collect())) == want

    ranks = {t: r for r, t in enumerate(bpe.read_ranks(bpe.RANKS))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    final = steps["byte-level bpe"](spark, mixed, SF)
    for r in final.collect():
        assert r.ids == enc.encode_ordinary(rows[r.doc_id].text) and r.n_tokens == len(r.ids)

    whole = corpus_pipeline.run(spark, SF)
    assert whole.agg(F.count("*")).first()[0] == sum(want.values())
    assert neardup.PERCENT == 75


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_edges_of_stages(spark):
    """Null and empty texts, null keys, repeated rows, one key with two texts, a further column with a name of the stages' own."""
    text = "some words that make up a text of more than five words " * 3
    rows = [(1, text, "en", "a", 9, "x"), (1, text, "en", "a", 9, "x"), (2, text + "end", "en", "b", 9, "y"), (3, None, "en", "a", None, "x"), (3, None, "en", "a", None, "x"), (4, "", None, None, 0, "x"), (None, text, "en", "a", 9, "x"), (None, text, "en", "a", 9, "x"), (5, "token=abcdefghijklmnop", "en", "a", 22, "x"), (5, "another text of the same key", "en", "a", 22, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    steps = dict(corpus_pipeline.STAGES)
    clean = steps["toxicity"](spark, docs, SF)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    first = steps["minhash near-dedup"](spark, docs, SF)
    left = collections.Counter((r.doc_id, r.text) for r in first.collect())
    assert left == {(1, text): 1, (3, None): 1, (4, ""): 1, (None, text): 1, (5, "token=abcdefghijklmnop"): 1, (5, "another text of the same key"): 1}
    safe = steps["secret scans"](spark, docs, SF)
    assert collections.Counter(r.text for r in safe.collect()) == collections.Counter(r[1] if r[0] != 5 or "token" not in r[1] else "[SECRET]" for r in rows)
    mixed = steps["mixing"](spark, docs, SF)
    assert mixed.columns == docs.columns and not mixed.where("text is null or text = ''").count() and mixed.where("doc_id is null").count()
    out = steps["byte-level bpe"](spark, docs, SF).collect()
    assert len(out) == len(rows) and sorted(r.n_tokens for r in out)[:3] == [0, 0, 0]
