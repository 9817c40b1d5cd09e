import math

import numpy as np
import pytest

from plumbago.llm import pq
from plumbago.llm.entry import op6_near_vectors

SF = "/root/testdata/sf0.001"


def brute(rows, threshold=0.95):
    ok = {}
    for k, (_, v) in enumerate(rows):
        if v and None not in v and np.isfinite(v).all() and any(v):
            x = np.array(v, float)
            ok[k] = x / np.linalg.norm(x)
    links = {k: set() for k in range(len(rows))}
    keys = list(ok)
    x = np.array([ok[k] for k in keys])
    near = x @ x.T >= threshold - 1e-12
    for i, j in np.argwhere(near):
        if i != j:
            links[keys[i]].add(keys[j])
    root = {k: k for k in links}
    for k in sorted(links, key=lambda k: rows[k][0]):
        if root[k] == k and links[k]:
            todo, seen = [k], {k}
            while todo:
                for n in links[todo.pop()] - seen:
                    seen.add(n)
                    todo.append(n)
            least = min(seen, key=lambda n: rows[n][0])
            for n in seen:
                root[n] = least
    return sorted((rows[k][0], len(links[k]), rows[root[k]][0], rows[root[k]][0] == rows[k][0]) for k in links)


def test_query_equals_brute_force(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = sorted(map(tuple, op6_near_vectors(spark, SF).collect()))
    want = brute(rows)
    assert len(got) == len(want)
    pairs = lambda t: sum(r[1] for r in t)
    assert pairs(got) >= 0.9 * pairs(want) and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert got == want


def test_crowded_cell_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * 0.2).tolist()) for i in range(150)] + [(200 + i, rng.normal(size=16).tolist()) for i in range(50)] + [(300 + i, base.tolist()) for i in range(30)]
    monkeypatch.setattr(pq, "BLOCK", 32)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, pq.near_vectors(df, sigmas=50.0).collect())) == brute(rows)


def test_odd_vectors(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [math.nan, 1.0]), (6, [math.inf, 1.0]), (9, [1.0, 0.0]), (7, [2.0, 0.0]), (8, [1.0, 0.0]), (10, [1e300, 1e299]), (11, [1e-300, 0.0]), (12, [0.0, 1.0]), (13, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, node string")
    got = {r[0]: tuple(r[1:]) for r in pq.near_vectors(df).collect()}
    assert all(got[k] == (0, k, True) for k in (1, 2, 3, 4, 5, 6, 12, 13))
    assert {k: got[k] for k in (7, 8, 9, 10, 11)} == {k: (4, 7, k == 7) for k in (7, 8, 9, 10, 11)}
    empty = pq.near_vectors(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "n_links", "component_id", "kept"]


@pytest.mark.parametrize("ids", [[None, 1], [5, 5]])
def test_null_and_repeated_ids(spark, ids):
    df = spark.createDataFrame([(i, [1.0, 1.0]) for i in ids], "vec_id long, embedding array<float>")
    assert sorted((str(r[0]), r[1], str(r[2])) for r in pq.near_vectors(df).collect()) == sorted((str(i), 1, str(i)) for i in ids)


def test_vectors_of_several_lengths(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [1.0, 0.0]), (4, [2.0, 0.0]), (5, [0.0, 1.0]), (6, [3.0]), (7, [4.0]), (8, [-1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r[0]: (r[1], r[2]) for r in pq.near_vectors(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (1, 6), 7: (1, 6), 8: (0, 8)}


def test_many_cells():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(8000, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = pq.Index.fitted(x, 2000)
    assert 1500 < len(index.centers) < 2500
    cell = pq.nearest(x[:300], index.centers)
    probes = index.probes(x[:300], cell, 1e9)
    assert all(len(p) == len(index.centers) for p in probes)
    apart = np.linalg.norm(x[:300, None] - index.centers[None], axis=2) ** 2
    between = np.linalg.norm(index.centers[cell][:, None] - index.centers[None], axis=2)
    border = (apart - apart[np.arange(300), cell][:, None]) / (2 * np.maximum(between, 1e-15))
    want = [sorted({*np.flatnonzero(row <= 0.05), c}) for row, c in zip(border, cell, strict=True)]
    assert [p.tolist() for p in index.probes(x[:300], cell, 0.05)] == want
