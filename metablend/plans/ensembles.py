"""Study workflows on the fused learners: single-learner evaluation, k-fold
scores, blending, stacking and train-on-one-source / score-on-the-other.

Settings are parameters; the registered queries use small ones (≤ 10 trees,
depth ≤ 4, 3 folds) — the grids of the study are driver-side lists of the
same parameters.

The study's AdaBoost, gradient boosting and forests cut raw values (``split =
"exact"``); its Newton and histogram learners cut at most 255 bins.  Exact fits
read the prepared table's ``values``, the others its ``bins``; ``auto`` (the five
learners' default) cuts raw values wherever the prepared table has them.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from functools import partial

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metablend.functions.metrics import metric_table, threshold
from metablend.operators.binning import N_BINS, apply_bins, fit_bins, raw_values
from metablend.operators.compress import compress_rows, expand_scores
from metablend.operators.grow import TreeParams
from metablend.operators.keys import exact_split_folds
from metablend.operators.learners import (
    AdaForestSpec, AdaSlot, BoostSlot, Fitted, ForestSpec, fit_ada, fit_ada_forest,
    fit_boost, fit_forest, outer_inner,
)
from metablend.operators.meta import base_table, fold_columns, meta_logistic, meta_trees
from metablend.session import ensure_checkpoint_dir, side_by_side
from metablend.sources.carriers import DOC_CATEGORICAL, DOC_CONTINUOUS, doc_quality
from metablend.sources.tables import read_table

FEATURES = DOC_CONTINUOUS + DOC_CATEGORICAL


@dataclass
class LearnerSpec:
    kind: str                          # ada gbm sgb xgb lgb rf ada_rf
    n_trees: int = 100
    lr: float = 0.1
    max_depth: int | None = 3          # None: no limit
    subsample: float = 1.0
    max_leaves: int | None = None
    min_rows_leaf: int = 1
    min_rows_split: int = 2
    forest_trees: int = 100
    extra: dict = field(default_factory=dict)
    split: str = "hist"                # hist: bins; exact: raw values; auto: raw values if prepared


#: the study's settings of each learner, used where nothing else is asked for
DEFAULT_SPECS = {
    "ada": LearnerSpec("ada", n_trees=50, lr=1.0, split="auto"),
    "gbm": LearnerSpec("gbm", n_trees=100, lr=0.1, max_depth=3, split="auto"),
    "sgb": LearnerSpec("sgb", n_trees=100, lr=0.1, max_depth=3, subsample=0.8, split="auto"),
    "xgb": LearnerSpec("xgb", n_trees=100, lr=0.3, max_depth=6),
    "lgb": LearnerSpec("lgb", n_trees=100, lr=0.1, max_depth=None, max_leaves=31, min_rows_leaf=20),
    "rf": LearnerSpec("rf", n_trees=100, max_depth=None, split="auto"),
    "ada_rf": LearnerSpec("ada_rf", n_trees=50, lr=1.0, max_depth=None, forest_trees=100, split="auto"),
}


# small settings for the registered queries (kind → spec)
QUERY_SPECS = {
    "ada": LearnerSpec("ada", n_trees=10, lr=1.0),
    "gbm": LearnerSpec("gbm", n_trees=10, lr=0.1, max_depth=3),
    "sgb": LearnerSpec("sgb", n_trees=10, lr=0.1, max_depth=3, subsample=0.8),
    "xgb": LearnerSpec("xgb", n_trees=10, lr=0.3, max_depth=3),
    "lgb": LearnerSpec("lgb", n_trees=5, lr=0.1, max_depth=None, max_leaves=8, min_rows_leaf=20),
    "rf": LearnerSpec("rf", n_trees=10, max_depth=4),
    "ada_rf": LearnerSpec("ada_rf", n_trees=3, lr=1.0, max_depth=3, forest_trees=5),
}


# lighter settings for the bases of blends and stacks (5-7 learners per query)
ENSEMBLE_SPECS = {
    "ada": LearnerSpec("ada", n_trees=5, lr=1.0),
    "gbm": LearnerSpec("gbm", n_trees=5, lr=0.1, max_depth=3),
    "sgb": LearnerSpec("sgb", n_trees=5, lr=0.1, max_depth=3, subsample=0.8),
    "xgb": LearnerSpec("xgb", n_trees=5, lr=0.3, max_depth=3),
    "lgb": LearnerSpec("lgb", n_trees=3, lr=0.1, max_depth=None, max_leaves=8, min_rows_leaf=20),
    "rf": LearnerSpec("rf", n_trees=10, max_depth=3),
    "ada_rf": LearnerSpec("ada_rf", n_trees=2, lr=1.0, max_depth=2, forest_trees=3),
}


ROWS_PER_PARTITION = 2_000_000      # large tables: ~2M prepared rows (tens of MB) per partition
MIN_ROWS_PER_TASK = 20_000          # small tables: spread over the cores, never below this


def _partitions_for(spark: SparkSession, source: DataFrame) -> int:
    """Partition count of a prepared table, from the row count of the table it
    comes from (Parquet footers only, no pass over the prepared rows): every
    core busy for mid-size tables, ~2M rows per partition for large ones, and a
    single partition for tiny ones (task overhead would dominate)."""
    n = source.count()
    cores = spark.sparkContext.defaultParallelism
    return int(max(-(-n // ROWS_PER_PARTITION), min(cores, -(-n // MIN_ROWS_PER_TASK)), 1))


def prepare_trees(spark: SparkSession, sf_dir: str, k: int = 3, seed: int = 42,
                  n_bins: int = N_BINS, external: bool = False, values: bool = False) -> DataFrame:
    """row_id, label, split, fold, bins — hash partitioned by row_id, checkpointed.
    ``values``: the raw features, too, for learners with exact cuts.

    ``external``: origin 'a' rows are the training source (folds among them),
    origin 'b' rows are held out as split 'eval'."""
    dq = doc_quality(spark, sf_dir)
    if external:
        a = exact_split_folds(dq.where(F.col("origin") == "a"), seed=seed, test_frac=None, k=k)
        b = (dq.where(F.col("origin") == "b").withColumn("split", F.lit("eval"))
             .withColumn("fold", F.lit(None).cast("int")))
        df = a.unionByName(b)
    else:
        df = exact_split_folds(dq, seed=seed, test_frac=0.2, k=k)
    ensure_checkpoint_dir(spark)
    rows = read_table(spark, sf_dir, "labels")  # one prepared row per label at most
    df = df.repartition(_partitions_for(spark, rows), "row_id").checkpoint(eager=True)
    # every learner of a study reads the prepared rows in several passes
    return _with_features(df, DOC_CONTINUOUS, DOC_CATEGORICAL, n_bins, values).persist(StorageLevel.MEMORY_AND_DISK)


def _with_features(df: DataFrame, continuous: list[str], categorical: list[str], n_bins: int, values: bool) -> DataFrame:
    specs = fit_bins(df.where(F.col("split") == "train"), continuous, categorical, n_bins, "quantile")
    out = apply_bins(df, specs)
    if values:
        out = raw_values(out, continuous + categorical, "values")
    return out.select("row_id", "label", "split", "fold", "bins", *(["values"] if values else []))


def prepare_lineitem_trees(spark: SparkSession, sf_dir: str, k: int = 3, seed: int = 42,
                           n_bins: int = N_BINS, values: bool = False) -> DataFrame:
    """lineitem_return prepared like ``prepare_trees`` (scale carrier, no signal), but partitioned by the hash
    buckets of its split, so its rows are shuffled once."""
    from metablend.sources.carriers import LINE_CONTINUOUS, lineitem_return
    ensure_checkpoint_dir(spark)
    df = exact_split_folds(lineitem_return(spark, sf_dir).drop("origin"), seed=seed, test_frac=0.2, k=k,
                           keep=lambda rows: rows.checkpoint(eager=True),
                           partitions=_partitions_for(spark, read_table(spark, sf_dir, "lineitem")))
    return _with_features(df, LINE_CONTINUOUS, [], n_bins, values)


def tree_params(spec: LearnerSpec) -> TreeParams:
    """Growth settings of a boosting learner."""
    if spec.kind in ("gbm", "sgb"):
        return TreeParams("variance", max_depth=spec.max_depth, min_rows_leaf=spec.min_rows_leaf,
                          min_rows_split=spec.min_rows_split)
    xgb = spec.kind == "xgb"
    return TreeParams("newton", max_depth=spec.max_depth, lam=1.0 if xgb else 0.0, min_hess=1.0 if xgb else 1e-3,
                      min_rows_leaf=spec.min_rows_leaf, max_leaves=None if xgb else spec.max_leaves)


PRESET = {"gbm": "gbm", "sgb": "gbm", "xgb": "newton", "lgb": "leafwise", "hist": "leafwise"}


def boost_slot(spec: LearnerSpec, holdout) -> BoostSlot:
    (outer,), (inner,) = outer_inner([holdout])
    return BoostSlot(outer, spec.n_trees, spec.lr, spec.max_depth, spec.subsample, inner_holdout=inner)


def forest_spec(spec: LearnerSpec, n_trees: int) -> ForestSpec:
    return ForestSpec(n_trees, spec.max_depth, spec.min_rows_split, spec.min_rows_leaf)


def features_of(prep: DataFrame, spec: LearnerSpec) -> DataFrame:
    """The prepared table with the features that the learner cuts as ``bins``."""
    if spec.split not in ("hist", "exact", "auto"):
        raise ValueError(f"unknown split search {spec.split}")
    if spec.split == "exact" and "values" not in prep.columns:
        raise ValueError("exact cuts need the prepared table's raw values (values=True)")
    return prep if spec.split == "hist" or "values" not in prep.columns else prep.withColumn("bins", F.col("values"))


def fit_learner(prep: DataFrame, spec: LearnerSpec, holdouts: list, seed: int = 42,
                n_features: int = len(FEATURES)) -> Fitted:
    """One model per holdout: a fold, -1 (none) or (fold, inner fold)."""
    kind = spec.kind
    prep = features_of(prep, spec)
    if kind == "ada":
        return fit_ada(prep, [AdaSlot(o, spec.n_trees, spec.lr, i) for o, i in zip(*outer_inner(holdouts))])
    if kind in PRESET:
        return fit_boost(prep, PRESET[kind], [boost_slot(spec, h) for h in holdouts], seed=seed, params=tree_params(spec))
    if kind == "rf":
        return fit_forest(prep, holdouts, forest_spec(spec, spec.n_trees), n_features, seed)
    if kind == "ada_rf":
        return fit_ada_forest(prep, holdouts, AdaForestSpec(forest_spec(spec, spec.forest_trees), spec.n_trees, spec.lr),
                              n_features, seed)
    raise ValueError(f"unknown learner {kind}")


def fit_learners(prep: DataFrame, specs: list[LearnerSpec], holdouts: list) -> list[Fitted]:
    """``fit_learner`` of several learners, side by side."""
    return side_by_side(prep.sparkSession, [partial(fit_learner, prep, s, holdouts) for s in specs])


def learner_scores(prep: DataFrame, spec: LearnerSpec, k: int = 3) -> DataFrame:
    """Per-row probabilities of one learner: out-of-fold (train rows), fold
    average and refit model (other rows)."""
    return _columns_of(fit_learner(prep, spec, list(range(k)) + [-1]).scores, k)


def compressed_scores(prep: DataFrame, spec: LearnerSpec, k: int = 3, max_copies: int = 256, digits: int | None = None) -> DataFrame:
    """``learner_scores`` with the models trained on counted rows.  Learners that draw rows see at most
    ``max_copies`` copies per counted row (the others any number); their draws differ from those over single rows.
    Averages are made, and rounded to ``digits`` if given, before the scores come back to the rows, which join with
    one row per different ``bins`` where the fit ran over those."""
    own = features_of(prep, spec)
    draws = spec.kind in ("rf", "ada_rf") or spec.subsample < 1.0
    few = compress_rows(own, max_copies if draws else None)
    ensure_checkpoint_dir(prep.sparkSession)
    fit = fit_learner(few.checkpoint(eager=True), dataclasses.replace(spec, split="hist"), list(range(k)) + [-1])
    groups = fit.extra.get("groups")
    if groups is not None:
        scored = expand_scores(own, _model_columns(groups, k, digits), MODEL_COLUMNS, ["bins"])
    else:  # only learners that draw rows see a combination in parts
        scored = expand_scores(own, _model_columns(fit.scores if draws else fit.scores.drop("copies"), k, digits), MODEL_COLUMNS)
    return _own_columns(scored)


MODEL_COLUMNS = ["P", "p_avg", "p_full"]


def _model_columns(scores: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """``P``, the average of the fold models and the refit model's entry."""
    P = F.col("P")

    def cut(c):
        return c if digits is None else F.round(c, digits)

    avg = F.aggregate(F.slice(P, 1, k), F.lit(0.0), lambda a, b: a + b) / float(k)
    return scores.select(*[c for c in scores.columns if c != "P"], (P if digits is None else F.transform(P, cut)).alias("P"),
                         cut(avg).alias("p_avg"), cut(F.element_at(P, F.lit(k + 1))).alias("p_full"))


def _own_columns(scored: DataFrame) -> DataFrame:
    return scored.select(
        "row_id", "label", "split", "fold",
        F.when(F.col("split") == "train", F.element_at("P", F.coalesce(F.col("fold"), F.lit(0)) + 1)).alias("p_oof"),
        "p_avg", "p_full")


def _columns_of(scores: DataFrame, k: int) -> DataFrame:
    return _own_columns(_model_columns(scores, k))


def long_scores(table: DataFrame, models: list[str], rows: str) -> DataFrame:
    """(model, label, score, pred) over the evaluation rows for several score columns."""
    ev = table.where(F.col("split") == rows)
    st = F.expr("stack({}, {}) as (model, score)".format(
        len(models), ", ".join(f"'{m}', `{m}`" for m in models)))
    return ev.select("label", st).withColumn("pred", threshold("score"))


def evaluate(table: DataFrame, models: list[str], rows: str = "test") -> DataFrame:
    """model, metric, value for every score column on the evaluation rows."""
    return metric_table(long_scores(table, models, rows), by=["model"]).select(
        "model", "metric", F.round("value", 6).alias("value"))


def blend(prep: DataFrame, bases: list[LearnerSpec], k: int = 3, rows: str = "test",
          C: float = 1.0) -> DataFrame:
    """Blending: k fold models per base; training rows get out-of-fold
    probabilities, other rows the mean of the k fold models; a plain logistic
    meta-learner (no scaling, C = 1) is fitted on the training rows."""
    fits = fit_learners(prep, bases, list(range(k)))
    table = base_table([fold_columns(f, k, s.kind, "average") for f, s in zip(fits, bases)])
    names = [s.kind for s in bases]
    scored = meta_logistic(table, names, C=C, max_iter=100).withColumnRenamed("score", "meta")
    return evaluate(scored, names + ["meta"], rows)


def stack(prep: DataFrame, bases: list[LearnerSpec], k: int, meta: str, rows: str = "test",
          meta_trees_n: int = 100, resubstitute: bool = False) -> DataFrame:
    """Stacking: out-of-fold base probabilities train the meta-learner; bases
    refitted on all training rows feed it at scoring time.  ``meta``:
    ``logreg`` (standardised, C = 1 on the column pair, 500 iterations), ``hist``
    or ``newton``.  ``resubstitute``: training rows, too, are scored through the
    refitted bases (the meta-learner still trains on out-of-fold columns)."""
    fits = fit_learners(prep, bases, list(range(k)) + [-1])
    table = base_table([fold_columns(f, k, s.kind, "refit") for f, s in zip(fits, bases)])
    names = [s.kind for s in bases]
    at_scoring = None
    if resubstitute:
        at_scoring = base_table([fold_columns(f, k, s.kind, "refit_all") for f, s in zip(fits, bases)])
    if meta == "logreg":
        # the study feeds both class columns of each base; on the halved, standardised set its
        # penalty is half as strong
        scored = meta_logistic(table, names, C=2.0, max_iter=500, scale=True, score_on=at_scoring)
    else:
        kind = "hist" if meta == "hist" else "newton"
        fit_on = table if at_scoring is None else table.unionByName(
            at_scoring.where(F.col("split") == "train").withColumn("split", F.lit("again")))
        ms = meta_trees(fit_on, names, kind=kind, n_trees=meta_trees_n, lr=0.1 if kind == "hist" else 0.3,
                        max_depth=None if kind == "hist" else 6, keep_split=at_scoring is not None)
        if at_scoring is None:
            scored = table.join(ms, "row_id")
        else:
            again = ms.where(F.col("split") != "train").drop("split")
            scored = at_scoring.join(again, "row_id")
    return evaluate(scored.withColumnRenamed("score", "meta"), names + ["meta"], rows)


def kfold_scores(prep: DataFrame, spec: LearnerSpec, k: int = 3) -> DataFrame:
    """fold, accuracy, auc of the held-out fold of each fold model (D6/M5)."""
    from metablend.functions.metrics import accuracy, auc
    fit = fit_learner(prep, spec, list(range(k)))
    tr = fit.scores.where(F.col("split") == "train").select(
        "fold", "label", F.element_at("P", F.col("fold") + 1).alias("score"))
    tr = tr.withColumn("pred", threshold("score"))
    return accuracy(tr, by=["fold"]).join(auc(tr, by=["fold"]), "fold")
