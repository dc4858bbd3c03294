"""Top-k search and near-duplicate vectors by brute force."""

import math

import numpy as np
import pytest

from runloom.llm import caps, topk

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"


def vectors(n, d, seed, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(copies):
        y = x[i % 5] + 0.02 * rng.standard_normal(d)
        x[n - 1 - i] = y / np.linalg.norm(y)
    return x.astype(np.float32)


ODD = [(901, None, 1), (902, [], 1), (903, [1.0, None], 1), (904, [float("nan"), 1.0], 1),
       (905, [float("inf"), 1.0], 1), (None, [0.5, 0.5], 1)]


@pytest.mark.parametrize("block,rows_at_once", [(2048, 4096), (2, 16)])
def test_top_k(frame, few, monkeypatch, block, rows_at_once):
    monkeypatch.setattr(topk, "ROWS", rows_at_once)
    x = vectors(300, 20, 1)
    x[50:60] = x[40]  # ties
    data = [(i * 5, v.tolist(), 1) for i, v in enumerate(x)]
    data += [(1700, [0.3, 0.4], 1), (1701, [0.3, 0.4], 2), *ODD, (900, None, 1)]
    got = {}
    for r in topk.top_k(frame(data, SCHEMA), block=block).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    q = np.floor(x.astype(np.float64) * 1024).astype(np.int64)
    ids = np.arange(300) * 5
    want = {}
    for i in range(0, 300, 20):
        score = q @ q[i]
        best = [j for j in np.lexsort((ids, -score)) if j != i][:10]
        want[int(ids[i])] = [(k + 1, int(ids[j]), int(score[j])) for k, j in enumerate(best)]
    two = math.floor(np.float32(0.3) * 1024) ** 2 + math.floor(np.float32(0.4) * 1024) ** 2
    want[1700] = [(1, 1701, two)]
    assert {k: sorted(v) for k, v in got.items()} == want


def test_large_values_stay_exact():
    lists = topk.TopLists(np.array([1]), np.array([[2.0**30, 1.0]]), 2)
    lists.add(np.array([2, 3]), np.array([[2.0**30, 1.0], [2.0**30, 3.0]]))
    assert lists.best[0] == [(-(2**60) - 3, 3), (-(2**60) - 1, 2)]


def test_no_vectors(frame, few):
    assert topk.top_k(frame([], SCHEMA)).count() == 0
    assert caps.near_vectors(frame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("members", [1024, 16])
def test_near_vectors(frame, few, members):
    x = vectors(260, 64, 3, copies=120)
    data = [(i, v.tolist(), i % 2 if i < 130 else None if i == 140 else 0)
            for i, v in enumerate(x)]
    data += [(800, x[200].tolist(), 0), (801, x[200].tolist(), 0), (801, x[200].tolist(), 0),
             (802, [0.0] * 64, 0), *ODD, (803, [0.6, 0.8], 0), (804, [0.6, 0.8], 0)]
    got = caps.near_vectors(frame(data, SCHEMA), members=members).collect()
    assert len(got) == len(data)
    good = [(i, np.array(v, np.float64), lab) for i, v, lab in data
            if i is not None and v and lab is not None and None not in v
            and np.isfinite(np.array(v, float)).all() and np.any(v)]
    n = {}
    root = {i: i for i, _, _ in data if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, u, lu) in enumerate(good):
        for b, (j, v, lv) in enumerate(good):
            if a == b or lu != lv or len(u) != len(v):
                continue
            if u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.98:
                n[a] = n.get(a, 0) + 1
                x_, y_ = find(i), find(j)
                root[max(x_, y_)] = min(x_, y_)
    want = {}
    for a, (i, _, _) in enumerate(good):
        want.setdefault(i, []).append((n.get(a, 0), find(i)))
    seen = {}
    for r in got:
        seen.setdefault(r.vec_id, []).append((r.n_links, r.component_id))
        assert r.kept == (r.vec_id is None or r.vec_id == r.component_id)
    total = sum(k for v in want.values() for k, _ in v)
    assert sum(k for i in want for k, _ in seen[i]) >= 0.97 * total
    for i, v in want.items():
        assert all(k <= v[0][0] for k, _ in seen[i])
    same = sum(sorted(seen[i]) == sorted(v) for i, v in want.items())
    assert same >= 0.95 * len(want)
    for i in set(root) - set(want):
        assert seen[i] == [(0, i)]


def test_recall_of_filters():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = rng.standard_normal((300, 64))
    g -= (g * x).sum(1, keepdims=True) * x
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * g / np.linalg.norm(g, axis=1, keepdims=True)
    for rows in (500, 50_000):
        shape = caps.code_shape(rows)
        both = zip(caps.decode(x, *shape), caps.decode(y, *shape), strict=True)
        assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in both]) >= 0.97
