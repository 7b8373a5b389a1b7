import hashlib

import public_tokenizers
import tiktoken

from tideframe.llm import bpe

TEXTS = ["", None, "Hello world's   end\n\n 12345 !!", "ünïcödé 漢字  \x1c\x85 \U0001f600", "a" * 5000, " \t ", "Hello world's   end\n\n 12345 !!", "▁▁ Ġx"]


def own():
    ranks = {t: r for r, t in enumerate(bpe.read_ranks(bpe.RANKS))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_matches_tiktoken_and_round_trips(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    enc = own()
    for row in bpe.encode(docs, decoded=True).collect():
        text = TEXTS[row.doc_id] or ""
        assert row.ids == enc.encode_ordinary(text)
        assert bytes(row.decoded) == text.encode()
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(TEXTS)}


def test_query_against_tiktoken(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    enc = own()
    want = {}
    for r in docs.collect():
        ids = enc.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op9_byte_bpe(spark, str(tmp_path)).collect()}
    assert got == want


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), decoded=True).count() == 0


def test_null_keys_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "one text"), (7, "one text"), (7, "one text"), (7, "other")], "doc_id long, text string")
    rows = bpe.encode(docs).collect()
    enc = own()
    assert sorted(((r.doc_id or 0), r.ids) for r in rows) == sorted([(0, enc.encode_ordinary("one text")), (7, enc.encode_ordinary("one text")), (7, enc.encode_ordinary("one text")), (7, enc.encode_ordinary("other"))])


def test_cache_keeps_only_what_recurs():
    c = bpe.Codec()
    for _ in range(2):
        assert c.encode("alpha beta") == c.encode("alpha beta")
    c.encode("once")
    assert "once" not in c.cache and "alpha" in c.cache
