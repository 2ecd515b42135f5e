"""The fused grower against a brute-force numpy tree builder (shares no code).

Depth-wise Newton boosting: every cut of every feature of every node is
tried directly on the rows; ties resolve to the rounded gain, then the
lowest feature, then the lowest bin — the documented contract.
"""

import math

import numpy as np
import pytest


def _reference(bins, y, n_trees, lr, depth, lam=1.0, min_hess=1.0):
    n, d = bins.shape
    rate = y.mean()
    F = np.full(n, math.log(rate / (1 - rate)))
    trees = []
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-F))
        g, h = p - y, p * (1 - p)
        node = np.ones(n, dtype=np.int64)
        splits = {}
        for level in range(depth):
            for nd in sorted(set(node[node >= 2 ** level].tolist())):
                idx = node == nd
                G, H = g[idx].sum(), h[idx].sum()
                best, best_key = None, None
                for f in range(d):
                    for b in sorted(set(bins[idx, f].tolist())):
                        left, right = idx & (bins[:, f] <= b), idx & (bins[:, f] > b)
                        if left.sum() < 1 or right.sum() < 1:
                            continue
                        GL, HL, GR, HR = g[left].sum(), h[left].sum(), g[right].sum(), h[right].sum()
                        if HL < min_hess or HR < min_hess:
                            continue
                        gain = 0.5 * (GL * GL / (HL + lam) + GR * GR / (HR + lam) - G * G / (H + lam))
                        key = (round(gain, 9), -f, -b)
                        if gain > 1e-12 and (best_key is None or key > best_key):
                            best, best_key = (f, b), key
                if best is not None:
                    f, b = best
                    splits[nd] = best
                    node[idx & (bins[:, f] > b)] = 2 * nd + 1
                    node[idx & (bins[:, f] <= b)] = 2 * nd
        leaf = {}
        for nd in set(node.tolist()):
            m = node == nd
            leaf[nd] = -lr * g[m].sum() / (h[m].sum() + lam)
        F = F + np.array([leaf[v] for v in node])
        trees.append(splits)
    return trees, 1 / (1 + np.exp(-F))


@pytest.mark.parametrize("seed", [0, 1])
def test_newton_trees_equal_bruteforce(spark, seed):
    from metablend.operators.grow import TreeParams
    from metablend.operators.learners import BoostSlot, fit_boost
    rng = np.random.default_rng(seed)
    n, d = 240, 3
    bins = rng.integers(0, 8, size=(n, d))
    signal = bins[:, 0] + 0.5 * bins[:, 1] + rng.normal(0, 2, n)
    y = (signal > np.median(signal)).astype(float)
    rows = [(i, int(y[i]), "train", 0, [int(v) for v in bins[i]]) for i in range(n)]
    prep = spark.createDataFrame(rows, "row_id long, label int, split string, fold int, bins array<int>")
    fit = fit_boost(prep, "newton", [BoostSlot(-1, 3, 0.3, 3)],
                    params=TreeParams("newton", max_depth=3, lam=1.0, min_hess=1.0))
    ref_trees, ref_p = _reference(bins, y, 3, 0.3, 3)
    for t, splits in enumerate(ref_trees):
        got = {x[2]: (x[3], x[4]) for x in fit.trees if x[1] == t and x[3] is not None}
        assert got == splits
    got_p = {r.row_id: r.p for r in fit.scores.selectExpr("row_id", "P[0] AS p").collect()}
    assert [got_p[i] for i in range(n)] == pytest.approx(list(ref_p), abs=1e-9)
