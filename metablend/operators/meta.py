"""Meta-learning: out-of-fold tables, fold averages, stacking and blending.

A fused fit gives every row one probability per slot.  With slots
``0..k-1`` holding out fold ``s`` and (optionally) slot ``k`` trained on all
training rows:

* out-of-fold  (training rows)  ``P[fold]``      — scored by the model that never saw it,
* fold average (other rows)     ``mean(P[0..k-1])``,
* refit        (other rows)     ``P[k]``.

All three are narrow projections of the fitted state.  Base tables of
several learners are joined on ``row_id``; the prepared table is hash
partitioned by ``row_id`` once, every fitted state keeps that partitioning,
so those joins need no shuffle.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metablend.operators.binning import N_BINS, apply_bins, fit_bins
from metablend.operators.learners import BOOST_PRESETS, BoostSlot, EarlyStop, Fitted, fit_boost, keep_cols
from metablend.operators.scale import apply_scaler, fit_scaler
from metablend.session import ensure_checkpoint_dir


def fold_columns(fit: Fitted, k: int, name: str, test_mode: str = "average") -> DataFrame:
    """``row_id, label, split, fold, <name>``: out-of-fold on training rows,
    fold average (``average``) or refit model (``refit``) elsewhere;
    ``refit_all``: the refit model on every row."""
    P = F.col("P")
    if test_mode == "refit_all":
        return fit.scores.select("row_id", "label", "split", "fold", F.element_at(P, F.lit(k + 1)).alias(name))
    oof = F.element_at(P, F.coalesce(F.col("fold"), F.lit(0)) + 1)
    if test_mode == "refit":
        other = F.element_at(P, F.lit(k + 1))
    else:
        other = F.aggregate(F.slice(P, 1, k), F.lit(0.0), lambda a, b: a + b) / float(k)
    return fit.scores.select("row_id", "label", "split", "fold",
                             F.when(F.col("split") == "train", oof).otherwise(other).alias(name))


def base_table(parts: list[DataFrame]) -> DataFrame:
    """Join per-learner columns on the row key (co-partitioned: no shuffle).
    The meta-feature table is read by the meta fit, its scoring and the
    evaluation, so it is persisted (rows x learners doubles)."""
    n_part = parts[0].rdd.getNumPartitions()
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p.drop("label", "split", "fold"), "row_id")
    # Spark keeps the co-partitioning only when it has at least
    # spark.sql.shuffle.partitions partitions (the large-table case); a small
    # table is re-shuffled, so bring it back to its own size before the
    # meta-learner iterates over it.
    return out.coalesce(n_part).persist(StorageLevel.MEMORY_AND_DISK)


def logreg(train: DataFrame, cols: list[str], C: float = 1.0, max_iter: int = 100,
           label: str = "label") -> tuple:
    """L2 logistic regression with the study's objective ½‖w‖² + C·Σ loss:
    Spark minimises mean loss + regParam·½‖w‖², so regParam = 1 / (C·n)."""
    n = train.count()
    va = VectorAssembler(inputCols=cols, outputCol="_x", handleInvalid="keep")
    lr = LogisticRegression(featuresCol="_x", labelCol=label, regParam=1.0 / (C * max(n, 1)),
                            elasticNetParam=0.0, standardization=False, maxIter=max_iter,
                            fitIntercept=True, family="binomial")
    model = lr.fit(va.transform(train.withColumn(label, F.col(label).cast("double"))))
    return va, model


def logreg_scores(df: DataFrame, va, model, out: str = "score") -> DataFrame:
    scored = model.transform(va.transform(df))
    return scored.withColumn(out, vector_to_array("probability")[1]).drop("_x", "rawPrediction",
                                                                            "probability", "prediction")


def meta_logistic(table: DataFrame, cols: list[str], C: float = 1.0, max_iter: int = 100,
                  scale: bool = False, score_on: DataFrame | None = None) -> DataFrame:
    """Fit on training rows (out-of-fold features), score every row → ``score``
    (of ``score_on``, where other columns feed the model at scoring time)."""
    src, target, used = table, score_on if score_on is not None else table, cols
    if scale:
        # scaled copies: the base columns themselves stay probabilities
        used = [f"_z_{c}" for c in cols]
        copies = {z: F.col(c) for z, c in zip(used, cols)}
        src, target = src.withColumns(copies), target.withColumns(copies)
        params = fit_scaler(src, used, where=F.col("split") == "train")
        src, target = apply_scaler(src, params), apply_scaler(target, params)
    va, model = logreg(src.where(F.col("split") == "train"), used, C, max_iter)
    return logreg_scores(target, va, model).drop(*(used if scale else []))


def meta_trees(table: DataFrame, cols: list[str], kind: str = "hist", n_trees: int | None = None,
               lr: float | None = None, max_depth: int | None = None, n_bins: int = N_BINS,
               params=None, keep_split: bool = False) -> DataFrame:
    """Boosted-tree meta-learner over the meta-feature columns (bins fitted on
    the training rows); one slot trained on all training rows."""
    preset = BOOST_PRESETS[kind]
    specs = fit_bins(table.where(F.col("split") == "train"), cols, [], n_bins, "quantile")
    # the rounds' plans would carry those of all the bases: they end here
    ensure_checkpoint_dir(table.sparkSession)
    prep = apply_bins(table, specs)
    prep = prep.select(*keep_cols(prep)).checkpoint(eager=True)
    p = params or preset["params"]
    slot = BoostSlot(-1, n_trees or preset["n_trees"], lr if lr is not None else preset["lr"],
                     max_depth if max_depth is not None else p.max_depth)  # None: the preset's depth
    fit = fit_boost(prep, kind, [slot], params=p, early=EarlyStop() if kind == "hist" else None)
    return fit.scores.select("row_id", *(["split"] if keep_split else []), F.element_at("P", 1).alias("score"))
