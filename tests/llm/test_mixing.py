import collections
import math

from tideframe.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    """Share all words by weight; what passes a cap is shared again among the others, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > cap * sizes[s]]
        if not full:
            out |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def check(rows, got, slack):
    size = lambda t: len((t or "").encode().split())
    total, taken = collections.Counter(), collections.Counter()
    for _, s, t in rows:
        total[s] += size(t)
    want = brute_targets(dict(total))
    assert len(got) == len(rows)
    by_key = {r.doc_id: r for r in got}
    source = {k: s for k, s, _ in rows}
    for k, s, t in rows:
        r = by_key[k]
        assert r.size == size(t) and r.source_size == total[s]
        assert math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-6)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[source[r.doc_id]] += r.taken
    for s in total:
        assert abs(taken[s] - want[s]) <= slack(s, want[s]), (s, taken[s], want[s])


def test_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    got = mixing.op5_mixing(spark, "/root/testdata/sf0.01").collect()
    check(rows, got, lambda s, t: max(0.01 * t, 40))
    assert sorted(got) == sorted(mixing.op5_mixing(spark, "/root/testdata/sf0.01").collect())


# source é is one document of 50,000 words: whole copies come no nearer than half of it
def test_edges_and_hot_cells(spark, tmp_path):
    rows = [(1, None, "a b c"), (2, "a", None), (3, "a", ""), (4, "é", "w " * 50_000), (5, "z", "x y")]
    rows += [(10 + i, "hot", "same text of six words here") for i in range(2000)]
    rows += [(5000 + i, "b", "word " * (i % 40 + 1)) for i in range(400)]
    spark.createDataFrame([(k, s, t, 1) for k, s, t in rows], "doc_id long, source string, text string, size int").write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.op5_mixing(spark, str(tmp_path)).collect()
    check(rows, got, lambda s, t: 25_000 if s == "é" else max(0.02 * t, 60))


def test_rates_solve_the_dual(spark):
    """The found multipliers meet the word constraints with exponentially tilted, capped rates."""
    cells = [("a", s, 10) for s in range(1, 60)] + [("b", s, 30) for s in (5, 500)]
    frame = spark.createDataFrame(cells, "source string, size long, n long")
    goals = spark.createDataFrame([("a", 17700, 590, 59, 25_000.0), ("b", 15150, 60, 500, 4_000.0)], "source string, source_size long, documents long, largest long, target double")
    for r in mixing.multipliers(frame, goals).collect():
        words = sum(n * s * min(3.0, math.exp(r["lambda"] * s / r.scale)) for c, s, n in cells if c == r.source)
        assert math.isclose(words, r.target, rel_tol=1e-6)


def test_apply_and_empty(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    want = {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}
    assert dict(collections.Counter(r.doc_id for r in out.collect())) == want
    assert mixing.mix(docs.limit(0)).count() == 0
