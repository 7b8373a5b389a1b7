import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tideframe.llm import tokenfiles as tf


def test_levels_give_random_access():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 300, 3000), rng.integers(0, 1 << 32, 700), [0, 255, 256, 65535, 65536, (1 << 32) - 1]]).astype(np.uint32)
    rng.shuffle(ids)
    seg = tf.Segment(tf.encode_levels(ids), tf.WIDTHS)
    assert [seg[i] for i in range(len(ids))] == ids.tolist()
    for a, b in [(0, len(ids)), (511, 513), (1, 1), (700, 2900), (len(ids) - 1, len(ids))]:
        assert seg.slice(a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(ValueError):
        tf.encode_levels(np.array([1 << 20]), (8, 8))


def test_file_round_trip_over_segments():
    rng = random.Random(2)
    docs = [(k, np.array([rng.randrange(50_000) for _ in range(n)], np.uint32)) for k, n in ((None, 3), (-5, 0), (7, 250), (7, 1), (9, 90))]
    out = tf.Writer(segment=100)
    for k, ids in docs:
        out.add(k, ids)
    own = tf.Reader(out.finish())
    assert own.keys == [k for k, _ in docs] and len(own.meta["segments"]) > 2
    flat = np.concatenate([i for _, i in docs])
    assert [own.token(i) for i in range(len(own))] == flat.tolist()
    assert all((own.document(d) == ids).all() for d, (_, ids) in enumerate(docs))
    assert len(tf.Reader(tf.Writer().finish())) == 0


def test_word_by_word_equals_whole_texts():
    tok = Tokenizer.from_file(tf.TOKENIZER)
    rng = random.Random(3)
    pool = list("abcXYZ019 \t\n\r\x0b\x0c'.,!?-_<|>") + ["é", "É", "́", "Σ", "ς", "ß", "İ", "漢", "\U0001f600", "\xa0", " ", "\x1c", "\x85", "ﬁ", "'s", "'LL", " <|endoftext|> ", "‍", "가", "\x01", "\x01 "]
    pool += [". ", ", ", ".\n", "é. ", "×. ", "÷, ", "word, ", "!. ", "., ", "«. ", "…. "]
    own = tf.WordEncoder(tf.TOKENIZER)
    for _ in range(4000):
        text = "".join(rng.choices(pool, k=rng.randrange(0, 30)))
        assert own.encode(text).tolist() == tok.encode(text, add_special_tokens=False).ids, ascii(text)


def test_query_against_the_library(spark, tmp_path):
    base = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = base + [(5000, None), (5001, ""), (-3, "z " * 20_000)]
    spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, start int").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    tok, start = Tokenizer.from_file(tf.TOKENIZER), 0
    got = {r.doc_id: r for r in tf.op2_token_files(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for k, t in sorted(rows):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), tf.crc(ids))
        start += len(ids)


def test_ties_nulls_and_empty(spark, tmp_path):
    docs = spark.createDataFrame([(None, "b"), (1, "b"), (1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    rows = tf.read(tf.write(docs, f"file://{tmp_path}/a"), f"file://{tmp_path}/a").orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, 1, 1, 1] and [r.start for r in rows] == [0, 1, 3, 5, 7]
    assert tf.read(tf.write(docs.limit(0), f"file://{tmp_path}/b"), f"file://{tmp_path}/b").count() == 0
