import math

import numpy as np

from tideframe.llm import embeddings as em


def brute(rows, cosine=0.98):
    good = [k is not None and lab is not None and bool(v) and None not in v and all(map(math.isfinite, v)) and any(v) for k, v, lab in rows]
    links, comp = [0] * len(rows), {k: k for k, _, _ in rows if k is not None}
    near = []
    for i, (k, v, lab) in enumerate(rows):
        for j in range(i):
            k2, v2, lab2 = rows[j]
            if good[i] and good[j] and lab == lab2 and len(v) == len(v2):
                x, y = np.array(v, np.float64), np.array(v2, np.float64)
                if x @ y / (math.sqrt(x @ x) * math.sqrt(y @ y)) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    near.append((k, k2))
    for _ in rows:
        for a, b in near:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return sorted(((k, n, comp.get(k)) for (k, _, _), n in zip(rows, links, strict=True)), key=repr)


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows, base = [], rng.normal(size=(12, 16))
    for i in range(260):
        v = base[i % 12] + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.12, 0.2])
        rows.append((i, v.tolist(), int(i % 12 % 3)))
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 16, 1), (1003, [math.nan] * 16, 1), (1004, [math.inf] + [1.0] * 15, 1), (1005, rows[0][1], None), (None, rows[0][1], 0), (1006, [1.0, None], 0), (1007, [1.0, 2.0], 0), (1008, [2.0, 4.0], 0), (1009, [1e300] * 16, 0), (1010, [1e-300] * 16, 0)]
    rows += [rows[5], (7, rows[40][1], rows[40][2])]
    table = spark.createDataFrame([(k, v, lab, "x") for k, v, lab in rows], "vec_id long, embedding array<double>, label int, n_links string")
    got = em.near_duplicates(table, block=32).collect()
    usual = [r for r in rows if r[0] not in (1009, 1010)]
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id not in (1009, 1010)), key=repr) == brute(usual)
    assert {r.n_links for r in got if r.vec_id in (1009, 1010)} == {1}
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_recursion_skips_only_distant_blocks():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 8))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    x[350:] = u[:350] + rng.normal(size=(350, 8)) * 0.05
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    order = np.lexsort(np.floor(u[:, :3] / 0.2).T[::-1])
    x, u = x[order], u[order]
    side = em.Side(8, 700, np.ascontiguousarray(u[:, :3]).tobytes(), x.tobytes())
    i, j = em.join_sequences(side, side, True, 0.2, 0.98)
    want = np.argwhere(np.triu(u @ u.T >= 0.98, 1))
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(map(tuple, want.tolist()))


def test_empty_table(spark):
    assert em.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_runs_of_blocks_change_no_result(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(40, 12)) + 2.0
    rows = [(i, (base[i % 40] + rng.normal(size=12) * 0.06).tolist(), int(i % 2)) for i in range(700)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute(rows)
    for size in (1, 1 << 14, 1 << 30):  # bytes of a run: one block, some, all
        monkeypatch.setattr(em, "RUN_BYTES", size)
        spark.conf.set("spark.sql.shuffle.partitions", 1 if size > 1 << 20 else 4)
        got = em.near_duplicates(table, block=32).collect()
        assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == want
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_more_lengths_than_get_axes(spark, monkeypatch):
    monkeypatch.setattr(em, "LENGTHS", 2)
    rng = np.random.default_rng(2)
    rows = []
    for i in range(120):
        v = np.ones(2 + i % 9) + (rng.normal(size=2 + i % 9) * 0.2)
        rows.append((i, v.tolist(), 0))
    got = em.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=4).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == brute(rows)
