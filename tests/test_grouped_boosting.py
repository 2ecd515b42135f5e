"""Boosting over groups of rows with equal bins against single rows; bins of odd values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from metablend.operators import learners as L
from metablend.operators.binning import BinSpec, apply_bins


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    data = []
    for i in range(4000):
        a, b = (3, 1) if i % 3 == 0 else (rng.randrange(9), rng.choice([0, 1, 2, None]))
        y = int(rng.random() < (0.8 if (a > 4) != (b == 1) else 0.3)) if i % 11 else None  # some labels are unknown
        data.append((i // 2, y, "train" if i % 5 else "test", i % 3 if i % 5 else None, [a, b]))  # keys come twice
    return spark.createDataFrame(data, "row_id bigint, label int, split string, fold int, bins array<int>").repartition(4).persist()


@pytest.mark.parametrize("kind", ["gbm", "newton", "leafwise"])
def test_groups_give_the_same_models_as_single_rows(spark, rows, kind, monkeypatch):
    slots = [L.BoostSlot(0, 3, 0.3, 2), L.BoostSlot(1, 2, 0.3, 2), L.BoostSlot(-1, 3, 0.1, 3)]
    seen = []
    grow = L.grow
    monkeypatch.setattr(L, "grow", lambda state, *a, **k: seen.append(state.count()) or grow(state, *a, **k))
    plain = L.fit_boost(rows, kind, slots, stages=[2])
    monkeypatch.setattr(L, "LEAST_ROWS_GROUPED", 1)
    few = L.fit_boost(rows, kind, slots, stages=[2])
    assert seen[0] == 4000 and seen[-1] < 50  # each level passes over the groups, not over the rows
    assert sorted(t[:5] for t in few.trees) == sorted(t[:5] for t in plain.trees)
    assert few.extra["init"] == pytest.approx(plain.extra["init"])

    def scores(fit):
        out = fit.scores.select("row_id", "label", "split", "fold", "bins", "P", "P_2").collect()
        return sorted((r.row_id, str(r[1:5]), [round(x, 9) for x in r.P + r.P_2]) for r in out)
    assert scores(few) == scores(plain)


def test_rows_that_are_drawn_stay_single(spark, rows, monkeypatch):
    monkeypatch.setattr(L, "LEAST_ROWS_GROUPED", 1)
    monkeypatch.setattr(L, "feature_groups", lambda *a: pytest.fail("rows drawn one by one were grouped"))
    L.fit_boost(rows, "gbm", [L.BoostSlot(-1, 1, 0.3, 1, subsample=0.5)])


def test_plan_of_a_level_does_not_grow_with_the_depth(spark, rows):
    _, nodes = L.grow(rows.where("label IS NOT NULL").withColumn("w", F.array(F.lit(1.0))), 1, {"hold": [-1]}, ["w"], lambda ex: ex.select(
        "*", F.col("label").cast("double").alias("g"), F.lit(1.0).alias("h"), F.lit(1.0).alias("c"), F.lit(True).alias("m")),
        L.TreeParams("gini", max_depth=None))
    state, again = L.grow(rows.where("label IS NOT NULL").withColumn("w", F.array(F.lit(1.0))), 1, {"hold": [-1]}, ["w"], lambda ex: ex.select(
        "*", F.col("label").cast("double").alias("g"), F.lit(1.0).alias("h"), F.lit(1.0).alias("c"), F.lit(True).alias("m")),
        L.TreeParams("gini", max_depth=None))
    assert max(n.depth for n in nodes) > 4 and [n.index for n in nodes] == [n.index for n in again]
    assert state._jdf.queryExecution().analyzed().toString().count("aggregate(sequence") == 1
    at = {n.index: n for n in again if n.feature is None}
    sizes = {r["n"]: r["count"] for r in state.select(F.get("_node", F.lit(0)).alias("n")).groupBy("n").count().collect()}
    assert sizes == {i: int(n.C) for i, n in at.items()}  # every row is in a leaf, and every leaf holds its rows


def test_bins_count_the_cuts_below(spark):
    cuts = [-2.5, 0.0, 1.0, 7.0]
    values = [None, math.nan, -math.inf, -3.0, -2.5, -2.4, -0.0, 0.0, 1e-300, 1.0, 6.9, 7.0, 7.1, math.inf]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    got = {r.i: r.bins for r in apply_bins(df, [BinSpec("x", "quantile", 5, cuts=cuts), BinSpec("i", "identity", 3)]).select("i", "bins").collect()}
    for i, v in enumerate(values):
        want = None if v is None or math.isnan(v) else sum(c < v for c in cuts)
        assert got[i] == [want, i if i < 3 else None]
