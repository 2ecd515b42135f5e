"""The registered stacks train what the study trains: every base and the meta-learner with all their trees."""

import pytest
from pyspark.sql import functions as F

from metablend.operators import meta as M
from metablend.operators.learners import Fitted
from metablend.plans import ensembles as E
from metablend.plans.model_queries import FULL, MODEL_QUERIES

WHOLE = {
    "stack_newton": "newton",
    "stack_hist": "hist",
    "stack_external_newton": "newton",
}


@pytest.mark.parametrize("name", WHOLE)
def test_the_stack_trains_all_trees(spark, monkeypatch, name):
    held = "eval" if "external" in name else "test"
    rows = [(i, int(i % 3 == 0), "train" if i % 4 else held, i % 5 if i % 4 else None, [i % 7, i % 2]) for i in range(40)]
    prep = spark.createDataFrame(rows, "row_id bigint, label int, split string, fold int, bins array<int>").coalesce(1)
    asked, rounds = [], []

    def fits(prep, specs, holdouts):
        """Stands in for the bases: scores without a fit, and a note of the settings asked for."""
        asked.extend(specs)
        scores = prep.withColumn("P", F.array_repeat((F.get("bins", F.lit(0)) + 1) / 9.0, len(holdouts)))
        return [Fitted(scores, len(holdouts), holdouts) for _ in specs]

    def boost(prep, kind, slots, **kw):
        assert kind == WHOLE[name]
        rounds.extend(s.n_trees for s in slots)
        return Fitted(prep.withColumn("P", F.array(F.lit(0.5))), len(slots), [-1])

    monkeypatch.setattr(E, "prepare_trees", lambda *_, **__: prep)
    monkeypatch.setattr(E, "fit_learners", fits)
    monkeypatch.setattr(M, "fit_boost", boost)
    got = MODEL_QUERIES[name](spark, "").select("model").distinct().collect()
    assert {r.model for r in got} == {*FULL, "meta"}
    assert {s.kind: (s.n_trees, s.forest_trees) for s in asked} == {
        "ada": (50, 100), "gbm": (100, 100), "xgb": (100, 100), "lgb": (100, 100), "rf": (100, 100), "sgb": (100, 100), "ada_rf": (50, 100)}
    assert {s.kind: s.max_depth for s in asked} == {"ada": 3, "gbm": 3, "xgb": 6, "lgb": None, "rf": None, "sgb": 3, "ada_rf": None}
    assert {s.kind: s.max_leaves for s in asked}["lgb"] == 31
    assert rounds == [100]
