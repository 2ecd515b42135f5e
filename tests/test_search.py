"""Search engine: complete configs, the right learner, no leaks."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from metablend.plans import ensembles as E


@pytest.fixture(scope="module")
def prep(spark):
    from metablend.plans.ensembles import prepare_trees
    return prepare_trees(spark, SF_SMALL, k=2).persist()


def test_unknown_keys_and_learners_are_errors():
    from metablend.plans.search import spec_of
    with pytest.raises(ValueError):
        spec_of("gbm", {"num_leaves": 3})
    with pytest.raises(ValueError):
        spec_of("nope", {})
    assert spec_of("ada_rf", {"estimator__max_depth": 2, "n_estimators": 3}).max_depth == 2


@pytest.mark.parametrize("kind,grid", [
    ("gbm", {"subsample": [0.5, 1.0], "n_estimators": [2], "max_depth": [2]}),
    ("ada", {"learning_rate": [0.5, 1.0], "n_estimators": [1, 2]}),
    ("rf", {"max_depth": [1, 2], "n_estimators": [2], "min_samples_leaf": [1, 3]}),
    ("ada_rf", {"estimator__max_depth": [1], "estimator__n_estimators": [2], "n_estimators": [1]}),
    ("lgb", {"num_leaves": [3, 4], "n_estimators": [1, 2]}),
])
def test_a_row_per_config_equal_to_its_own_fit(spark, prep, kind, grid):
    """Every config is trained as such: the fused score equals the score of fitting it alone."""
    from metablend.functions.metrics import accuracy, threshold
    from metablend.plans import ensembles as E
    from metablend.plans.search import expand_grid, grid_search, spec_of
    rows = {r["config_ordinal"]: r for r in grid_search(prep, kind, grid, 2).collect()}
    configs = expand_grid(grid)
    assert sorted(rows) == list(range(len(configs)))
    for key in grid:
        assert [rows[i][key] for i in range(len(configs))] == [c[key] for c in configs]
    last = len(configs) - 1
    fit = E.fit_learner(prep, spec_of(kind, configs[last]), [0, 1])
    tr = fit.scores.where("split = 'train'").select("label", "fold", F.element_at("P", F.col("fold") + 1).alias("score"))
    alone = [r["accuracy"] for r in accuracy(tr.withColumn("pred", threshold("score")), by=["fold"]).collect()]
    assert rows[last]["mean_score"] == pytest.approx(sum(alone) / len(alone))


def test_inner_fold_labels_do_not_leak(spark, prep):
    """Flipping the labels of inner fold 1 leaves the models that hold it out unchanged."""
    from metablend.plans.search import add_inner_folds, fit_tasks, spec_of
    nested = add_inner_folds(prep, 2).persist()
    flipped = nested.withColumn("label", F.when(F.col("inner") == 1, 1 - F.col("label")).otherwise(F.col("label")))
    for kind, config in (("gbm", {"n_estimators": 1, "max_depth": 2}), ("ada", {"n_estimators": 1}),
                         ("rf", {"n_estimators": 2, "max_depth": 2})):
        tasks = [(spec_of(kind, config), (0, 1))]
        a, b = ({r.row_id: r.P[0] for r in fit_tasks(x, tasks).collect()} for x in (nested, flipped))
        assert a == pytest.approx(b)


def test_learning_curve_start_score_uses_its_own_rows(spark, prep):
    from metablend.operators.learners import BoostSlot, fit_boost, uniform
    fit = fit_boost(prep, "gbm", [BoostSlot(-1, 1, 0.1, 1, row_fraction=0.3)])
    import math
    rate = prep.where("split = 'train'").where(uniform(F.col("row_id"), "subset", 42) < 0.3).agg(F.avg("label")).first()[0]
    assert fit.extra["init"][0] == pytest.approx(math.log(rate / (1 - rate)))


def test_first_round_no_better_than_chance_is_an_error(spark):
    from metablend.operators.learners import AdaSlot, WorseThanChance, fit_ada
    rows = [(i, i % 2, "train", 0, [0]) for i in range(10)]
    df = spark.createDataFrame(rows, "row_id long, label int, split string, fold int, bins array<int>")
    with pytest.raises(WorseThanChance):
        fit_ada(df, [AdaSlot(-1, 2)])


def test_many_features_and_large_codes(spark):
    """70 features, and category codes above 65,536: the right column and cut are used."""
    from metablend.operators.learners import BoostSlot, ForestSpec, fit_boost, fit_forest
    rows = []
    for i in range(60):
        bins = [0] * 70
        bins[66] = 70_000 if i % 3 else 69_000
        rows.append((i, int(i % 3 > 0), "train", 0, bins))
    df = spark.createDataFrame(rows, "row_id long, label int, split string, fold int, bins array<int>")
    fit = fit_boost(df, "newton", [BoostSlot(-1, 1, 0.3, 2)])
    assert [(t[3], t[4]) for t in fit.trees if t[3] is not None] == [(66, 69_000)]
    forest = fit_forest(df, [-1], ForestSpec(2, None, feature_k=70), 70)
    p = {r.row_id: r.P[0] for r in forest.scores.collect()}
    assert all((p[i] > 0.5) == (i % 3 > 0) for i in range(60))


def test_boosted_forest_tree_table(spark, prep):
    from metablend.operators.score import score_trees
    from metablend.plans.ensembles import LearnerSpec, fit_learner
    fit = fit_learner(prep, LearnerSpec("ada_rf", n_trees=2, lr=1.0, max_depth=2, forest_trees=3), [0, -1])
    rows = fit.scores.select("row_id", "bins", F.element_at("P", 2).alias("in_fit"))
    for r in score_trees(rows, fit.trees_df(spark, "x"), 1, "samme_forest").collect():
        assert r.score == pytest.approx(r.in_fit)


def test_stack_reports_base_probabilities(spark, prep):
    """Scaling inside the meta-learner leaves the base columns as they are; resubstitution uses refitted bases."""
    from metablend.functions.metrics import accuracy, threshold
    from metablend.plans import ensembles as E
    base = E.LearnerSpec("gbm", n_trees=2, max_depth=1)
    got = {(r.model, r.metric): r.value for r in E.stack(prep, [base], 2, "logreg", rows="train", resubstitute=True).collect()}
    fit = E.fit_learner(prep, base, [-1])
    own = fit.scores.where("split = 'train'").select("label", F.element_at("P", 1).alias("score"))
    assert got["gbm", "accuracy"] == pytest.approx(accuracy(own.withColumn("pred", threshold("score"))).first()[0], abs=1e-6)


def test_learning_curves_follow_the_learner(spark, prep):
    """Each learner has its own curve; the whole fraction equals a plain fit; folds are held out."""
    from metablend.functions.metrics import accuracy
    from metablend.operators.learners import uniform
    from metablend.plans.search import learning_curve, learning_curve_cv
    specs = {k: E.QUERY_SPECS[k] for k in ("gbm", "xgb", "rf", "ada")}
    specs = {k: E.LearnerSpec(**{**s.__dict__, "n_trees": 2}) for k, s in specs.items()}
    curves = {k: learning_curve(prep, s, [0.5, 1.0]).orderBy("fraction").collect() for k, s in specs.items()}
    assert len({tuple(round(x, 6) for r in c for x in (r.accuracy, r.auc)) for c in curves.values()}) == 4
    for kind in ("xgb", "rf"):
        fit = E.fit_learner(prep, specs[kind], [-1])
        test = fit.scores.where("split = 'test'").select("label", (F.element_at("P", 1) >= 0.5).cast("int").alias("pred"))
        assert curves[kind][1].accuracy == pytest.approx(accuracy(test).first()["accuracy"])
        assert curves[kind][0].n_train < curves[kind][1].n_train == prep.where("split = 'train'").count()
    got = learning_curve_cv(prep, specs["ada"], [0.6, 1.0], 2).orderBy("fraction").collect()
    half = prep.withColumn("split", F.when((F.col("split") == "train") & (uniform(F.col("row_id"), "subset", 42) >= 0.6), "no").otherwise(F.col("split")))
    fit = E.fit_learner(half, specs["ada"], [0, 1])
    held = [fit.scores.where(f"split IN ('train', 'no') AND fold = {f}").select(
        F.avg((F.col("label") == (F.element_at("P", f + 1) >= 0.5).cast("int")).cast("double"))).first()[0] for f in (0, 1)]
    assert got[0].cv_mean == pytest.approx(sum(held) / 2) and got[0].cv_std == pytest.approx(abs(held[0] - held[1]) / 2)
    assert 0 < got[0].train_mean <= 1 and got[0].n_train < got[1].n_train


def brute_scores(prep, kind, configs, holdouts):
    """Each config fitted alone."""
    from metablend.plans.search import spec_of
    return [{r.row_id: r.P for r in E.fit_learner(prep, spec_of(kind, c), holdouts).scores.select("row_id", "P").collect()} for c in configs]


@pytest.mark.parametrize("kind,grid,runs", [
    ("rf", {"n_estimators": [1, 2], "max_depth": [1, 3], "min_samples_split": [2, 60], "min_samples_leaf": [1, 4]}, 2),
    ("ada", {"n_estimators": [1, 2], "learning_rate": [0.5, 1.0]}, 1),
    ("ada_rf", {"n_estimators": [1, 2], "estimator__n_estimators": [2], "estimator__max_depth": [2]}, 1),
])
def test_a_grid_costs_its_longest_members(spark, prep, monkeypatch, kind, grid, runs):
    """Staged sums, truncated trees and prefixes of forests equal separate fits; the number of runs is what it should be."""
    import metablend.plans.search as search
    made = []
    for name in ("fit_forest", "fit_ada", "fit_ada_forest"):
        monkeypatch.setattr(search, name, lambda *a, f=getattr(search, name), **k: made.append(1) or f(*a, **k))
    configs = search.expand_grid(grid)
    if kind == "rf":
        configs = configs[::5] + configs[-2:]
    got = {r.row_id: r.P for r in search.fit_tasks(prep, [(search.spec_of(kind, c), h) for c in configs for h in (0, -1)]).collect()}
    assert len(made) == runs
    for i, alone in enumerate(brute_scores(prep, kind, configs, [0, -1])):
        for row, p in alone.items():
            assert got[row][2 * i:2 * i + 2] == pytest.approx(p)
