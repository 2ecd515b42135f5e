"""Hyper-parameter search over every learner, CV summaries and learning curves.

A grid is fused: every (config, fold) pair of a learner is one slot of as few
training runs as its growth settings allow.  ``n_estimators`` values of configs that
agree otherwise come from one run (staged scores), of every learner; a forest grid needs one
run per least leaf size, whatever its depths and least sizes to split.  Configs are complete:
each key of a grid is a setting of that learner, and an unknown key is an error.
Selection is the best mean fold score; ties go to the first config in grid order
(keys sorted, last key varying fastest).
"""

from __future__ import annotations

import dataclasses
import itertools
import json
from functools import partial

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metablend.functions.metrics import accuracy, auc, threshold
from metablend.operators.grow import p_features
from metablend.operators.learners import (AdaForestSpec, AdaSlot, ForestVariant, fit_ada, fit_ada_forest, fit_boost_chunked, fit_forest,
                                         outer_inner, uniform)
from metablend.plans import ensembles as E
from metablend.session import side_by_side

_BOOST = {"n_estimators": "n_trees", "learning_rate": "lr", "max_depth": "max_depth", "subsample": "subsample"}
_SIZES = {"min_samples_split": "min_rows_split", "min_samples_leaf": "min_rows_leaf"}
#: per learner: grid key -> field of its spec
KEYS = {
    "ada": {"n_estimators": "n_trees", "learning_rate": "lr"},
    "gbm": {**_BOOST, **_SIZES},
    "sgb": {**_BOOST, **_SIZES},
    "xgb": _BOOST,
    "lgb": {**_BOOST, "num_leaves": "max_leaves", "min_child_samples": "min_rows_leaf"},
    "rf": {"n_estimators": "n_trees", "max_depth": "max_depth", **_SIZES},
    "ada_rf": {"n_estimators": "n_trees", "learning_rate": "lr", "estimator__n_estimators": "forest_trees",
               "estimator__max_depth": "max_depth",
               **{f"estimator__{k}": v for k, v in _SIZES.items()}},
}


def spec_of(kind: str, config: dict, base: E.LearnerSpec | None = None) -> E.LearnerSpec:
    """The learner's spec with a config's settings (others from ``base`` or the study's defaults)."""
    if kind not in KEYS:
        raise ValueError(f"unknown learner {kind}")
    unknown = sorted(set(config) - set(KEYS[kind]))
    if unknown:
        raise ValueError(f"{kind} has no settings {unknown}")
    values = {KEYS[kind][k]: v for k, v in config.items()}
    if values.get("max_depth", 1) is not None and values.get("max_depth", 1) < 0:
        values["max_depth"] = None
    return dataclasses.replace(base or E.DEFAULT_SPECS[kind], **values)


def fit_tasks(prep: DataFrame, tasks: list[tuple[E.LearnerSpec, object]], seed: int = 42,
              max_slots: int = 64) -> DataFrame:
    """Train every (spec, holdout) task; returns the rows with ``P``: one probability per task, in order.

    Tasks that can grow in one run do: boosting configs with equal growth settings (a task whose
    ``n_trees`` is smaller reads the staged score of the longer run), AdaBoost configs (likewise),
    forests with one least leaf size (fewer trees, less depth and a larger least size to split are
    read off the largest forest), and boosted forests that differ in their rounds."""
    n_features = p_features(prep)
    runs: dict[tuple, list[int]] = {}
    for i, (spec, _) in enumerate(tasks):
        if spec.kind in E.PRESET:
            p = E.tree_params(spec)
            key = (spec.kind, spec.split, *dataclasses.astuple(dataclasses.replace(p, max_depth=0 if p.max_leaves is None else p.max_depth)))
        elif spec.kind == "ada":
            key = ("ada", spec.split)
        elif spec.kind == "rf":
            key = ("rf", spec.split, spec.min_rows_leaf)
        else:
            key = (spec.kind, json.dumps(dataclasses.asdict(dataclasses.replace(spec, n_trees=0)), sort_keys=True))
        runs.setdefault(tuple(map(str, key)), []).append(i)

    def scored(own):
        """The rows scored by one run and the array of its tasks' probabilities."""
        specs, holds = [tasks[i][0] for i in own], [tasks[i][1] for i in own]
        if specs[0].kind in E.PRESET:
            stages = sorted({s.n_trees for s in specs})
            slots, place = [], {}
            for s, h in zip(specs, holds):
                key = (s.lr, s.max_depth, s.subsample, h)
                if key not in place:
                    place[key] = len(slots)
                    slots.append(E.boost_slot(dataclasses.replace(s, n_trees=stages[-1]), h))
            fit = fit_boost_chunked(E.features_of(prep, specs[0]), E.PRESET[specs[0].kind], slots, max_slots, seed=seed, stages=stages,
                                    params=E.tree_params(specs[0]))
            p = F.array(*[F.get(F.col(f"P_{s.n_trees}"), F.lit(place[s.lr, s.max_depth, s.subsample, h]))
                          for s, h in zip(specs, holds)])
            scores = fit.scores
        elif specs[0].kind == "rf":
            shapes = list(dict.fromkeys(ForestVariant(s.n_trees, s.max_depth, s.min_rows_split) for s in specs))
            models = list(dict.fromkeys(holds))
            scores = fit_forest(E.features_of(prep, specs[0]), models, E.forest_spec(specs[0], specs[0].n_trees), n_features, seed,
                                variants=shapes).scores
            p = F.array(*[F.get(F.col(f"P_{shapes.index(ForestVariant(s.n_trees, s.max_depth, s.min_rows_split))}"), F.lit(models.index(h)))
                          for s, h in zip(specs, holds)])
        else:
            # AdaBoost over stumps or forests: the longest run of each setting, read after as many rounds as asked for
            stages = sorted({s.n_trees for s in specs})
            places = list(dict.fromkeys((s.lr, h) for s, h in zip(specs, holds)))
            if specs[0].kind == "ada":
                slots = [AdaSlot(o, stages[-1], lr, i) for (lr, _), o, i in zip(places, *outer_inner([h for _, h in places]))]
                scores = fit_ada(E.features_of(prep, specs[0]), slots, stages=stages).scores
            else:
                scores = fit_ada_forest(E.features_of(prep, specs[0]), [h for _, h in places], AdaForestSpec(
                    E.forest_spec(specs[0], specs[0].forest_trees), stages[-1], specs[0].lr), n_features, seed, stages=stages).scores
            p = F.array(*[F.get(F.col(f"P_{s.n_trees}"), F.lit(places.index((s.lr, h)))) for s, h in zip(specs, holds)])
        return scores, p

    out, where = None, {}
    for g, (own, (scores, p)) in enumerate(zip(runs.values(), side_by_side(prep.sparkSession, [partial(scored, own) for own in runs.values()]))):
        cols = [c for c in ("label", "split", "fold", "inner") if c in prep.columns] if out is None else []
        part = scores.select("row_id", *cols, p.alias(f"_g{g}"))
        out = part if out is None else out.join(part, "row_id")
        where.update({i: (g, j) for j, i in enumerate(own)})
    P = F.array(*[F.get(F.col(f"_g{where[i][0]}"), F.lit(where[i][1])) for i in range(len(tasks))])
    return out.withColumn("P", P).drop(*[f"_g{g}" for g in range(len(runs))])


def _with_config(table: DataFrame, configs: list[dict]) -> DataFrame:
    """One column per grid key, read by ``config_ordinal``."""
    for key in sorted({k for c in configs for k in c}):
        vals = [c[key] for c in configs]
        whole = all(v is None or (isinstance(v, int) and not isinstance(v, bool)) for v in vals)
        lit = F.from_json(F.lit(json.dumps(vals)), "array<int>" if whole else "array<double>")
        table = table.withColumn(key, F.get(lit, F.col("config_ordinal")))
    return table


def expand_grid(grid: dict[str, list]) -> list[dict]:
    """Cross product in grid order: keys sorted, last key varies fastest."""
    keys = sorted(grid)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[grid[k] for k in keys])]


def select_best(scores: DataFrame, score: str = "mean_score", ordinal: str = "config_ordinal") -> DataFrame:
    """Rank configs by score (desc) then grid ordinal; flag the first."""
    w = Window.orderBy(F.col(score).desc(), F.col(ordinal).asc())
    # the score table has one row per config (bounded by the grid size)
    return scores.withColumn("rank", F.row_number().over(w)).withColumn("selected", F.col("rank") == 1)


def grid_search(prep: DataFrame, kind: str, grid: dict, k: int, scorer: str = "accuracy", seed: int = 42,
                max_slots: int = 64, base: E.LearnerSpec | None = None) -> DataFrame:
    """k-fold search of one learner over a grid: a row per config with its settings, ``mean_score``,
    ``std_score``, ``config_ordinal``, ``rank`` and ``selected``.  ``scorer``: accuracy (each of the
    learners' default scorer) or auc."""
    configs = expand_grid(grid)
    tasks = [(spec_of(kind, c, base), f) for c in configs for f in range(k)]
    rows = fit_tasks(prep, tasks, seed, max_slots).where(F.col("split") == "train")
    own = rows.select("label", "fold", F.posexplode("P").alias("s", "score")) \
        .where(F.col("s") % k == F.col("fold")).withColumn("config_ordinal", F.expr(f"int(s div {k})"))
    if scorer == "auc":
        per_fold = auc(own, by=["config_ordinal", "fold"]).withColumnRenamed("auc", "value")
    else:
        per_fold = accuracy(own.withColumn("pred", threshold("score")), by=["config_ordinal", "fold"]) \
            .withColumnRenamed("accuracy", "value")
    summary = per_fold.groupBy("config_ordinal").agg(F.avg("value").alias("mean_score"),
                                                     F.stddev_pop("value").alias("std_score"))
    return _with_config(select_best(summary), configs)


def best_spec(prep: DataFrame, kind: str, grid: dict, k: int, scorer: str = "accuracy", seed: int = 42,
              base: E.LearnerSpec | None = None) -> tuple[E.LearnerSpec, dict, float]:
    """The selected config's spec, its settings and its mean score (one row comes back)."""
    row = grid_search(prep, kind, grid, k, scorer, seed, base=base).where("selected").first()
    config = expand_grid(grid)[row["config_ordinal"]]
    return spec_of(kind, config, base), config, float(row["mean_score"])


def learner_search(prep: DataFrame, grids: dict[str, dict], k: int, rows: str = "test", scorer: str = "accuracy",
                   bases: dict[str, E.LearnerSpec] | None = None) -> tuple[DataFrame, dict[str, E.LearnerSpec]]:
    """Search each learner, refit its winner on all training rows, score the other rows.

    model, params, cv_score, accuracy, auc (of the refitted winner); and the winners' specs."""
    spark = prep.sparkSession

    def search(kind):
        spec, config, score = best_spec(prep, kind, grids[kind], k, scorer, base=(bases or {}).get(kind))
        fit = E.fit_learner(prep, spec, [-1])
        part = fit.scores.select("row_id", "label", "split", "fold", F.element_at("P", 1).alias(kind))
        return spec, (kind, json.dumps(config, sort_keys=True), score), part

    chosen, found, parts = {}, [], []
    for spec, row, part in side_by_side(spark, [partial(search, kind) for kind in grids]):
        chosen[row[0]] = spec
        found.append(row)
        parts.append(part)
    from metablend.operators.meta import base_table
    long = E.long_scores(base_table(parts), list(grids), rows)
    scored = accuracy(long, by=["model"]).join(auc(long, by=["model"]), "model")
    head = spark.createDataFrame(found, "model string, params string, cv_score double")  # one row per learner
    return head.join(scored, "model").select("model", "params", "cv_score", "accuracy", "auc"), chosen


def tree_grid_search(prep: DataFrame, k: int = 3, grid: dict | None = None, seed: int = 42,
                     max_slots: int = 64) -> DataFrame:
    """Search for gradient boosting (accuracy scorer)."""
    grid = grid or {"learning_rate": [0.1, 0.3], "max_depth": [2, 3], "n_estimators": [5, 10]}
    return grid_search(prep, "gbm", grid, k, "accuracy", seed, max_slots)


def _fit_fractions(prep: DataFrame, spec: E.LearnerSpec, fractions: list[float], holdouts: list[int], seed: int) -> DataFrame:
    """Scores of one model per (fraction, holdout), fraction first; each trains on the rows of its nested
    hashed fraction that are not held out.  Boosting fits all of them in one fused run; the other
    learners in one run per fraction."""
    if spec.kind in E.PRESET:
        slots = [dataclasses.replace(E.boost_slot(spec, h), row_fraction=float(f)) for f in fractions for h in holdouts]
        return fit_boost_chunked(E.features_of(prep, spec), E.PRESET[spec.kind], slots, seed=seed, params=E.tree_params(spec)).scores
    out = None
    u = uniform(F.col("row_id"), "subset", seed)
    for i, f in enumerate(fractions):
        part = prep.withColumn("split", F.when((F.col("split") == "train") & (u >= float(f)), "unused").otherwise(F.col("split")))
        scores = E.fit_learner(part, spec, holdouts, seed, p_features(prep)).scores
        if out is None:
            first = scores.select("row_id", "label", "fold", F.col("P").alias("_p0"), F.when(
                F.col("split") == "unused", "train").otherwise(F.col("split")).alias("split"))
            out = first
        else:
            out = out.join(scores.select("row_id", F.col("P").alias(f"_p{i}")), "row_id")
    return out.withColumn("P", F.concat(*[F.col(f"_p{i}") for i in range(len(fractions))]))


def _fraction_sizes(prep: DataFrame, fractions: list[float], seed: int, folds: int = 0) -> list[int]:
    """Training rows per (fraction, holdout), in the order of ``_fit_fractions`` (one aggregation)."""
    u = uniform(F.col("row_id"), "subset", seed)
    masks = [(u < float(f)) & ((F.lit(h) < 0) | (F.col("fold") != h)) for f in fractions for h in (range(folds) if folds else [-1])]
    row = prep.where(F.col("split") == "train").agg(*[F.sum(m.cast("long")).alias(f"n{i}") for i, m in enumerate(masks)]).first()
    return [int(row[f"n{i}"] or 0) for i in range(len(masks))]


def learning_curve(prep: DataFrame, spec: E.LearnerSpec, fractions: list[float], seed: int = 42) -> DataFrame:
    """Any learner trained on nested hashed fractions of the training rows and scored on the
    test rows: fraction, n_train, accuracy, auc."""
    scores = _fit_fractions(prep, spec, fractions, [-1], seed)
    tst = scores.where(F.col("split") == "test").select("label", F.posexplode("P").alias("s", "score")).withColumn("pred", threshold("score"))
    tst = tst.withColumn("fraction", F.element_at(F.lit([float(f) for f in fractions]), F.col("s") + 1))
    n_lit = F.lit(_fraction_sizes(prep, fractions, seed))
    res = accuracy(tst, by=["fraction", "s"]).join(auc(tst, by=["fraction", "s"]), ["fraction", "s"])
    return res.select("fraction", F.element_at(n_lit, F.col("s") + 1).alias("n_train"), "accuracy", "auc")


def learning_curve_cv(prep: DataFrame, spec: E.LearnerSpec, fractions: list[float], k: int, seed: int = 42) -> DataFrame:
    """The study's curve: per fraction, k models trained on the fraction's rows outside a fold; mean and
    (population) deviation over the folds of the accuracy on their own training rows and on the fold."""
    scores = _fit_fractions(prep, spec, fractions, list(range(k)), seed)
    u = uniform(F.col("row_id"), "subset", seed)
    one = scores.where(F.col("split") == "train").select("label", "fold", u.alias("u"), F.posexplode("P").alias("s", "score"))
    one = one.withColumn("held", F.pmod(F.col("s"), F.lit(k))).withColumn("i", F.floor(F.col("s") / k).cast("int"))
    fr = F.lit([float(f) for f in fractions])
    one = one.withColumn("fraction", F.element_at(fr, F.col("i") + 1)).withColumn(
        "part", F.when(F.col("fold") == F.col("held"), "cv").when(F.col("u") < F.col("fraction"), "train"))
    hit = (F.col("label") == threshold("score")).cast("double")
    by_fold = one.where(F.col("part").isNotNull()).groupBy("i", "fraction", "s", "part").agg(F.avg(hit).alias("acc"))
    sizes = F.lit(_fraction_sizes(prep, fractions, seed, k))
    stats = [f(F.when(F.col("part") == p, F.col("acc"))).alias(f"{p}_{n}") for p in ("train", "cv") for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return by_fold.groupBy("i", "fraction").agg(F.avg(F.when(F.col("part") == "cv", F.element_at(sizes, F.col("s") + 1))).alias("n_train"), *stats).drop("i")


def add_inner_folds(prep: DataFrame, k_inner: int = 3, seed: int = 43) -> DataFrame:
    """Inner folds for nested search: exact stratified folds of the training
    rows under a second seed (the outer folds stay untouched)."""
    from metablend.operators.keys import exact_split_folds
    tr = prep.where(F.col("split") == "train").withColumnRenamed("fold", "_outer")
    tr = exact_split_folds(tr.drop("split"), seed=seed, test_frac=None, k=k_inner) \
        .withColumnRenamed("fold", "inner").withColumnRenamed("_outer", "fold")
    rest = prep.where(F.col("split") != "train").withColumn("inner", F.lit(None).cast("int"))
    return tr.unionByName(rest, allowMissingColumns=True)


def nested_search(prep: DataFrame, kind: str, grid: dict, k: int, k_inner: int = 3,
                  seed: int = 42, max_slots: int = 64,
                  base: E.LearnerSpec | None = None, nested: DataFrame | None = None) -> tuple[DataFrame, dict[int, E.LearnerSpec]]:
    """Per outer fold, k_inner-fold AUC search over ``grid`` on that fold's
    training rows — all (outer, config, inner) fits fused, longer runs reused for
    smaller ``n_estimators``.  Returns the score table and the chosen spec per outer fold.
    ``nested``: the rows with their inner folds, where several searches share them."""
    configs = expand_grid(grid)
    nested = add_inner_folds(prep, k_inner) if nested is None else nested
    tasks, meta = [], []
    for o in range(k):
        for ci, c in enumerate(configs):
            for j in range(k_inner):
                tasks.append((spec_of(kind, c, base), (o, j)))
                meta.append((o, ci, j))
    rows = fit_tasks(nested, tasks, seed, max_slots).where(F.col("split") == "train")
    lo, lc, lj = (F.from_json(F.lit(json.dumps([m[x] for m in meta])), "array<int>") for x in range(3))
    own = rows.select("label", "fold", "inner", F.posexplode("P").alias("s", "score")).where(
        (F.get(lo, F.col("s")) != F.col("fold")) & (F.get(lj, F.col("s")) == F.col("inner"))).select(
        "label", "score", F.get(lo, F.col("s")).alias("outer_fold"), F.get(lc, F.col("s")).alias("config_ordinal"),
        F.get(lj, F.col("s")).alias("inner_fold"))
    per = auc(own, by=["outer_fold", "config_ordinal", "inner_fold"])
    mean = per.groupBy("outer_fold", "config_ordinal").agg(F.avg("auc").alias("mean_score"))
    w = Window.partitionBy("outer_fold").orderBy(F.col("mean_score").desc(), F.col("config_ordinal"))
    ranked = mean.withColumn("rank", F.row_number().over(w)).withColumn("selected", F.col("rank") == 1)
    chosen = {int(r["outer_fold"]): spec_of(kind, configs[int(r["config_ordinal"])], base)
              for r in ranked.where("selected").collect()}  # one row per outer fold
    return _with_config(ranked, configs), chosen


def tuned_fold_scores(prep: DataFrame, chosen: dict[int, E.LearnerSpec], k: int, name: str,
                      seed: int = 42) -> DataFrame:
    """Fold models with the spec chosen for each outer fold (no refit):
    out-of-fold on training rows, mean of the k fold models elsewhere."""
    rows = fit_tasks(prep, [(chosen[o], o) for o in range(k)], seed)
    P = F.col("P")
    oof = F.element_at(P, F.coalesce(F.col("fold"), F.lit(0)) + 1)
    other = F.aggregate(P, F.lit(0.0), lambda a, b: a + b) / float(k)
    return rows.select("row_id", "label", "split", "fold",
                       F.when(F.col("split") == "train", oof).otherwise(other).alias(name))


def blend_tuned(prep: DataFrame, grids: dict[str, dict], k: int, k_inner: int = 3, rows: str = "test",
                bases: dict[str, E.LearnerSpec] | None = None) -> DataFrame:
    """Blending whose every base is tuned by nested search per outer fold."""
    from metablend.operators.meta import base_table, meta_logistic
    nested = add_inner_folds(prep, k_inner).persist(StorageLevel.MEMORY_AND_DISK)

    def tuned(kind):
        _, chosen = nested_search(prep, kind, grids[kind], k, k_inner, base=(bases or {}).get(kind), nested=nested)
        return tuned_fold_scores(prep, chosen, k, kind)

    parts = side_by_side(prep.sparkSession, [partial(tuned, kind) for kind in grids])
    nested.unpersist()
    names = list(grids)
    scored = meta_logistic(base_table(parts), names).withColumnRenamed("score", "meta")
    return E.evaluate(scored, names + ["meta"], rows)
