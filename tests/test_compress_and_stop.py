"""Counted rows against single rows; early stopping against shorter runs."""

import random

import pytest
from pyspark.sql import functions as F

from metablend.operators.compress import compress_rows, expand_scores
from metablend.operators.learners import AdaForestSpec, AdaSlot, BoostSlot, EarlyStop, ForestSpec, fit_ada, fit_ada_forest, fit_boost, fit_forest


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    data = []
    for i in range(3000):
        a, b = (3, 1) if i % 3 == 0 else (rng.randrange(6), rng.choice([0, 1, 2, None]))  # a third of the rows are equal
        y = int(rng.random() < (0.8 if (a > 2) != (b == 1) else 0.3))
        data.append((i, y, "train" if i % 5 else "test", i % 3 if i % 5 else None, [a, b]))
    return spark.createDataFrame(data, "row_id bigint, label int, split string, fold int, bins array<int>").repartition(4).persist()


def probabilities(df):
    return {r.row_id: r.P for r in df.select("row_id", "P").collect()}


FITS = {
    "gbm": lambda df: fit_boost(df, "gbm", [BoostSlot(0, 3, 0.3, 2), BoostSlot(-1, 3, 0.3, 2)]),
    "ada": lambda df: fit_ada(df, [AdaSlot(0, 3), AdaSlot(-1, 3)]),
    "forest": lambda df: fit_forest(df, [0, -1], ForestSpec(n_trees=1, max_depth=3, bootstrap=False, feature_k=2), 2),
    "ada_forest": lambda df: fit_ada_forest(df, [0, -1], AdaForestSpec(ForestSpec(n_trees=2, max_depth=2, bootstrap=False, feature_k=2), 2), 2),
}


@pytest.mark.parametrize("kind", FITS)
def test_counted_rows_give_the_same_models(spark, rows, kind):
    few = compress_rows(rows).persist()
    assert few.count() < 200 and few.agg(F.sum("copies")).first()[0] == 3000
    plain, counted = FITS[kind](rows), FITS[kind](few)
    assert probabilities(expand_scores(rows, counted.scores, ["P"])) == {k: pytest.approx(p) for k, p in probabilities(plain.scores).items()}
    assert sorted(t[:5] for t in counted.trees if t[3] is not None) == sorted(t[:5] for t in plain.trees if t[3] is not None)


def test_every_copy_is_drawn_by_itself(spark, rows):
    """Sub-sampling half of the copies and bootstrapping them takes about that many, of every combination."""
    few = compress_rows(rows, max_copies=64)
    assert few.agg(F.max("copies")).first()[0] == 64 and few.agg(F.sum("copies")).first()[0] == 3000
    sampled = fit_boost(few, "gbm", [BoostSlot(-1, 1, 0.3, 1, 0.5)])
    forest = fit_forest(few, [-1], ForestSpec(n_trees=8, max_depth=2, feature_k=2), 2)
    plain = fit_forest(rows, [-1], ForestSpec(n_trees=8, max_depth=2, feature_k=2), 2)
    a, b = (probabilities(expand_scores(rows, forest.scores, ["P"])), probabilities(plain.scores))
    assert max(abs(a[k][0] - b[k][0]) for k in b) < 0.08
    assert len(sampled.trees) == 3 and a.keys() == b.keys()


def test_retired_slots_equal_runs_of_that_length(spark, rows):
    early = EarlyStop(fraction=0.2, patience=2, tol=1e-4, min_rows=1700)
    slots = [BoostSlot(0, 12, 0.9, 2), BoostSlot(-1, 12, 0.2, 1)]   # fold model: 1,600 rows, too few to stop
    fit = fit_boost(rows, "gbm", slots, early=early, stages=[3, 12])
    n = fit.extra["rounds"]
    assert n[0] == 12 and 2 <= n[1] < 12
    shorter = fit_boost(rows, "gbm", [slots[0], BoostSlot(-1, n[1], 0.2, 1)], early=EarlyStop(0.2, 99, 1e-4, 1700))
    assert probabilities(fit.scores) == {k: pytest.approx(p) for k, p in probabilities(shorter.scores).items()}
    assert {t[1] for t in fit.trees if t[0] == 1} == set(range(n[1]))
    none = fit_boost(rows, "gbm", [BoostSlot(0, 3, 0.9, 2)], early=early)
    same = {k: [p[0]] for k, p in ((r.row_id, r.P_3) for r in fit.scores.select("row_id", "P_3").collect())}
    assert probabilities(none.scores) == {k: pytest.approx(p) for k, p in same.items()}


def test_the_rule_looks_back_by_its_patience():
    rule = EarlyStop(patience=3, tol=0.01)
    assert not rule.retires([0.7, 0.6, 0.5])
    assert not rule.retires([0.7, 0.6, 0.55, 0.58])
    assert rule.retires([0.7, 0.5, 0.495, 0.499, 0.6])
    assert not rule.retires([0.7, 0.5, 0.495, 0.48, 0.6])
