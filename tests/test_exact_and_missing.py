"""Exact cuts over raw values, full quantile cuts and missing values, against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from metablend.operators import binning as B
from metablend.operators.grow import value_cells
from metablend.operators.learners import AdaSlot, BoostSlot, ForestSpec, fit_ada, fit_boost, fit_forest
from metablend.operators.grow import TreeParams
from metablend.operators.score import score_trees


# --- full quantile cuts -------------------------------------------------------------------
def brute_bins(values, weights, n_bins):
    """value -> bin, by the definition: capped weights, prefix divided by the level."""
    w = {}
    for v, x in zip(values, weights):
        if v is not None and not math.isnan(v):
            w[v] = w.get(v, 0) + x
    if len(w) <= n_bins:
        return {v: i for i, v in enumerate(sorted(w))}
    order = sorted(w.values(), reverse=True)
    h = next(h for h in range(n_bins) if order[h] * (n_bins - h) <= sum(order[h:]))
    light = sum(order[h:])
    out, big, small = {}, 0, 0
    for v in sorted(w):
        out[v] = big + small * (n_bins - h) // light
        if w[v] * (n_bins - h) > light:
            big += 1
        else:
            small += w[v]
    return out


def fit_and_bin(spark, values, n_bins):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").repartition(3)
    spec, = B.fit_bins(df, ["x"], [], n_bins)
    return spec, {r.x: r.b for r in df.select("x", spec.expr().alias("b")).collect()}


@pytest.mark.parametrize("n_bins,in_task", [(4, 50_000), (255, 50_000), (255, 0)])
def test_a_third_of_the_rows_on_one_value_costs_no_cuts(spark, monkeypatch, n_bins, in_task):
    monkeypatch.setattr(B, "VALUES_PER_TASK", in_task)
    rng = random.Random(n_bins)
    values = [7.0] * 2000 + [float(rng.randrange(2)) for _ in range(800)] + [rng.gauss(0, 9) for _ in range(3000)]
    rng.shuffle(values)
    spec, got = fit_and_bin(spark, values, n_bins)
    want = brute_bins(values, [1] * len(values), n_bins)
    assert got == want and set(want.values()) == set(range(n_bins)) and len(spec.cuts) == n_bins - 1


def test_few_values_have_a_bin_each(spark):
    values = [3.0] * 500 + [1.0, 2.0, None, float("nan"), -5.5] + [float(i) for i in range(100, 200)]
    spec, got = fit_and_bin(spark, values, 255)
    known = sorted({v for v in values if v is not None and not math.isnan(v)})
    assert {v: b for v, b in got.items() if v is not None and not math.isnan(v)} == {v: i for i, v in enumerate(known)}
    assert all(b is None for v, b in got.items() if v is None or math.isnan(v))
    assert fit_and_bin(spark, [None, None], 255)[0].cuts == [] and fit_and_bin(spark, [2.0] * 9, 255)[0].cuts == []


def test_weighted_cuts_follow_the_weight(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(900) / 1.0, rng.choice([0.0, 0.25, 0.5, 8.0])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "x double, h double")
    spec, = B.fit_bins(df, ["x"], [], 31, weight="h")
    got = {r.x: r.b for r in df.where("h > 0").select("x", spec.expr().alias("b")).collect()}
    kept = [(v, int(h * 4)) for v, h in rows if h > 0]
    assert got == brute_bins([v for v, _ in kept], [h for _, h in kept], 31)


def test_unseen_categories_and_missing_values_have_no_bin(spark):
    train = spark.createDataFrame([(0, 1.0), (2, 2.0), (1, None)], "c int, x double")
    specs = B.fit_bins(train, ["x"], ["c"], 255)
    rows = spark.createDataFrame([(0, 1.0), (3, 5.0), (-1, None), (None, float("nan"))], "c int, x double")
    assert [r.bins for r in B.apply_bins(rows, specs).collect()] == [[0, 0], [1, None], [None, None], [None, None]]
    assert [tuple(r) for r in B.bin_columns(rows, specs).select("b_x", "b_c").collect()] == [(0, 0), (1, 0), (0, 0), (0, 0)]


# --- one tree grown by brute force, over raw values or bins, with missing values -----------------
def brute_tree(rows, ys, gains, depth, leaf=1, raw=True):
    """rows: feature lists with None; ys: (g, h). Returns node -> (feature, cut, missing_left) and row -> node."""
    node = [1] * len(rows)
    splits = {}
    for level in range(depth):
        for n in sorted(set(node)):
            own = [i for i in range(len(rows)) if node[i] == n]
            if n.bit_length() - 1 != level:
                continue
            best = None
            for f in range(len(rows[0])):
                values = sorted({rows[i][f] for i in own if rows[i][f] is not None})
                gone = [i for i in own if rows[i][f] is None]
                for j, v in enumerate(values):
                    for left in ([True, False] if gone else [None]):
                        L = [i for i in own if (rows[i][f] is not None and rows[i][f] <= v) or (rows[i][f] is None and left)]
                        R = [i for i in own if i not in set(L)]
                        if len(L) < leaf or len(R) < leaf:
                            continue
                        gain = gains(sum(ys[i][0] for i in L), sum(ys[i][1] for i in L), len(L),
                                     sum(ys[i][0] for i in R), sum(ys[i][1] for i in R), len(R))
                        if gain is None or gain <= 1e-12:
                            continue
                        go = left if left is not None else len(L) >= len(R)
                        cut = v if j + 1 == len(values) else v / 2 + values[j + 1] / 2
                        key = (round(gain, 9), -f, -v, left is not True)
                        if best is None or key > best[0]:
                            best = (key, f, cut if raw else v, go)
            if best:
                _, f, cut, go = best
                splits[n] = (f, cut, go)
                for i in own:
                    x = rows[i][f]
                    node[i] = 2 * n + int((not go) if x is None else x > cut)
    return splits, node


def variance(GL, HL, CL, GR, HR, CR):
    return GL * GL / CL + GR * GR / CR - (GL + GR) ** 2 / (CL + CR)


def newton(GL, HL, CL, GR, HR, CR):
    if HL < 0.1 or HR < 0.1:
        return None
    return 0.5 * (GL * GL / (HL + 1) + GR * GR / (HR + 1) - (GL + GR) ** 2 / (HL + HR + 1))


def gini(GL, HL, CL, GR, HR, CR):
    i = lambda g, h: 2 * g * (h - g) / h
    return i(GL + GR, HL + HR) - i(GL, HL) - i(GR, HR) if HL > 0 and HR > 0 else None


def table(spark, rows, labels, raw):
    kind = "double" if raw else "int"
    data = [(i, y, "train", i % 3, [None if x is None else (float(x) if raw else int(x)) for x in r]) for i, (r, y) in enumerate(zip(rows, labels))]
    return spark.createDataFrame(data, f"row_id bigint, label int, split string, fold int, bins array<{kind}>").repartition(3)


def random_rows(seed, raw, missing=0.2, n=240):
    rng = random.Random(seed)
    rows, labels = [], []
    for _ in range(n):
        a, b, c = rng.gauss(0, 1), rng.randrange(4), rng.randrange(40)
        y = int((a > 0.3) != (b == 2) or (c > 30 and rng.random() < 0.7))
        row = [round(a, 2) if raw else int(20 + 5 * a), b, c]
        if rng.random() < missing:
            row[rng.randrange(3) if y else 0] = None   # being missing says something about the label
        rows.append(row)
        labels.append(y)
    return rows, labels


@pytest.mark.parametrize("raw,missing", [(True, 0.0), (True, 0.25), (False, 0.25)])
@pytest.mark.parametrize("kind", ["gbm", "newton"])
def test_first_boosted_tree_equals_brute_force(spark, kind, raw, missing):
    rows, labels = random_rows(5 + raw, raw, missing)
    rate = sum(labels) / len(labels)
    sign = 1 if kind == "newton" else -1
    ys = [(sign * (rate - y), rate * (1 - rate)) for y in labels]
    want, node = brute_tree(rows, ys, newton if kind == "newton" else variance, 3, raw=raw)
    p = TreeParams("newton", max_depth=3, lam=1.0, min_hess=0.1) if kind == "newton" else TreeParams("variance", max_depth=3)
    df = table(spark, rows, labels, raw)
    fit = fit_boost(df, kind, [BoostSlot(-1, 1, 0.3, 3)], params=p)
    got = {t[2]: (t[3], pytest.approx(t[4]), t[10]) for t in fit.trees if t[3] is not None}
    assert got == want and len(want) > 3
    scored = {r.row_id: r.p for r in fit.scores.select("row_id", F.element_at("P", 1).alias("p")).collect()}
    by_node = {}
    for i, n in enumerate(node):
        by_node.setdefault(n, set()).add(round(scored[i], 9))
    assert all(len(v) == 1 for v in by_node.values())
    again = score_trees(fit.scores.select("row_id", "bins"), fit.trees_df(spark, "m"), 0, "sum", fit.extra["init"][0])
    assert all(r.score == pytest.approx(scored[r.row_id]) for r in again.collect())


def test_exact_stumps_equal_brute_force(spark):
    """Three SAMME rounds over raw values: stump, error and weight of each."""
    rows, labels = random_rows(11, True, 0.1)
    fit = fit_ada(table(spark, rows, labels, True), [AdaSlot(-1, 3, 1.0)])
    w = [1.0] * len(rows)
    for t in range(3):
        ys = [(x * y, x) for x, y in zip(w, labels)]
        want, node = brute_tree(rows, ys, gini, 1)
        got = [(x[3], x[4], x[10], x[6]) for x in fit.trees if x[1] == t and x[3] is not None]
        (f, cut, go), = want.values()
        leaf = {n: sum(a for (a, _), m in zip(ys, node) if m == n) * 2 > sum(b for (_, b), m in zip(ys, node) if m == n) for n in (2, 3)}
        wrong = [leaf[n] != bool(y) for n, y in zip(node, labels)]
        err = sum(x for x, no in zip(w, wrong) if no) / sum(w)
        alpha = math.log((1 - err) / err)
        assert got == [(f, pytest.approx(cut), go, pytest.approx(alpha))]
        w = [x * math.exp(alpha) if no else x for x, no in zip(w, wrong)]  # shares matter, not the sum


def test_exact_search_does_not_depend_on_cells_or_partitions(spark, monkeypatch):
    rows, labels = random_rows(21, True, 0.15)
    spec = ForestSpec(n_trees=3, max_depth=4, feature_k=2)
    key = lambda t: tuple((x is not None, x if not isinstance(x, float) else round(x, 9)) for x in t)
    df = table(spark, rows, labels, True)
    one = sorted(map(key, fit_forest(df, [-1], spec, 3).trees))
    import metablend.operators.grow as grow
    monkeypatch.setattr(grow, "value_cells", lambda prep, f=value_cells: f(prep, 5))
    assert sorted(map(key, fit_forest(df.repartition(7), [-1], spec, 3).trees)) == one and len(one) > 20
