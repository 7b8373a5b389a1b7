import zlib

import numpy as np

from tideframe.llm import toxicity


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in toxicity.op10_toxicity(spark, "/root/testdata/sf0.1").collect()}
    assert len(rows) == 10_000
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    test = [(rows[r.doc_id].predicted, r.toxic) for r in labels if rows[r.doc_id].held_out]
    hit = sum(p and t for p, t in test)
    assert hit / sum(t for _, t in test) > 0.8 and hit / sum(p for p, _ in test) > 0.9


def test_held_out_labels_never_train(spark):
    docs = spark.createDataFrame([(i, f"plain words {i}") for i in range(40)], "doc_id long, text string")
    out = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 == 2]
    labels = spark.createDataFrame([(i, 1) for i in out], "doc_id long, toxic int")
    assert toxicity.train(docs, labels).count() == 0


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "you idiot " * 3000, 0.5), (3, "you idiot " * 3000, 0.5), (None, "x", 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (2, 0), (3, 1), (3, 1), (None, 1), (9, 7)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert toxicity.score(docs, model).count() == 5
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert {r.score for r in toxicity.score(docs, model.limit(0)).collect()} == {0.0}


def test_ftrl_is_sparse_and_learns():
    model = toxicity.Ftrl(16, l1=1.0)
    for _ in range(50):
        model.learn(np.array([1, 2]), 1)
        model.learn(np.array([2, 3]), 0)
    w = model.weights(np.arange(17))
    assert w[1] > 0 > w[3] and not w[4:16].any()


def test_training_equals_a_plain_ftrl(spark):
    """The same weights and scores from dictionaries and loops, one coordinate at a time."""
    import math

    words = ["bad", "awful", "good", "fine", "text", "more", "words", "here"]
    rows = [(i, " ".join(words[(i * 7 + k * (i % 3 + 1)) % 8] for k in range(6)), int(i % 3 == 0)) for i in range(240)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    bits = 12
    got = {r.coordinate: r.weight for r in toxicity.train(docs, labels, bits=bits, epochs=2).collect()}
    order = [r.doc_id for r in docs.selectExpr("doc_id", "xxhash64(doc_id) h").orderBy("h", "doc_id").collect() if toxicity.crc32_text(r.doc_id) % 4 != 2]
    by = {k: (toxicity.features(t, bits).tolist(), y) for k, t, y in rows}
    z, n = {}, {}

    def weight(c):
        l1 = 0.0 if c == 1 << bits else toxicity.L1
        zc = z.get(c, 0.0)
        return 0.0 if abs(zc) <= l1 else -(zc - math.copysign(l1, zc)) / ((toxicity.BETA + math.sqrt(n.get(c, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for _ in range(2):
        for k in order:
            at, y = by[k]
            at = [*at, 1 << bits]
            w = {c: weight(c) for c in at}
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()))))) - y
            for c in at:
                was = n.get(c, 0.0)
                z[c] = z.get(c, 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / toxicity.ALPHA * w[c]
                n[c] = was + g * g
    want = {c: weight(c) for c in z if weight(c)}
    assert got.keys() == want.keys() and all(math.isclose(got[c], want[c], rel_tol=1e-9) for c in want)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels, bits=bits, epochs=2), bits=bits).collect()}
    for k, (at, _) in by.items():
        assert math.isclose(scores[k], 1 / (1 + math.exp(-sum(want.get(c, 0.0) for c in [*at, 1 << bits]))), rel_tol=1e-5)
