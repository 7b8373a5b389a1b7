import random

import numpy as np

from tideframe.llm import neardup, shingles
from tideframe.llm.components import components


def brute(rows, percent=75):
    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    sets = [(k, grams(t)) for k, t in rows]
    label = {k: k for k, _ in rows if k is not None}
    changed = True
    while changed:
        changed = False
        for i, (a, x) in enumerate(sets):
            for b, y in sets[:i]:
                if None not in (a, b) and x and y and 100 * len(x & y) >= percent * len(x | y) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {(k, len(s), label.get(k)) for k, s in sets}


def variants(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows = [(0, ""), (1, None), (2, "one two"), (3, "One  TWO\n"), (4, "one two three"), (None, "one two")]
    for base in range(6):
        text = [word() for _ in range(120)]
        for _ in range(9):
            copy = list(text)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows) + 100, " ".join(copy)))
        text[:60] = [word() for _ in range(60)]
        rows.append((len(rows) + 100, " ".join(text)))
    rows += [rows[10], (rows[12][0], "another text of the same key with words enough to count here")]
    return rows


def test_components_equal_brute_force(spark):
    rows = variants()
    docs = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id long, text string, kept string")
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_chain_inside_one_bucket_is_not_lost(spark):
    """Members far from the hub but near each other still meet: a chain of drifting copies."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 8 : i * 8 + 120])) for i in range(20)]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_likelihood_estimates_and_mergeability():
    rng = np.random.default_rng(5)
    base = shingles.mix(rng.integers(0, 1 << 62, 1200).astype(np.uint64))
    a, b = np.sort(base[:1000]), np.sort(base[120:])
    sa, sb = neardup.sketch(a, np.array([0])), neardup.sketch(b, np.array([0]))
    union = neardup.sketch(np.unique(np.concatenate([a, b])), np.array([0]))
    assert (np.maximum(sa, sb) == union).all()
    n = np.array([1000.0]), np.array([1080.0])
    assert neardup.may_link(sa, sb, *n).all()
    other = neardup.sketch(shingles.mix(np.arange(1000, dtype=np.uint64)), np.array([0]))
    assert not neardup.may_link(sa, other, np.array([1000.0]), np.array([1000.0])).any()


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(5, 5), (None, 3), (139, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in [*range(100, 140), 200]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
