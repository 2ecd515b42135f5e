"""One boosting round written out, checked against SQL.

These run the grower's own building blocks — slot rows with the learner's
gradient/hessian, the ``groupBy(slot, node, feature, bin)`` histogram and
the Spark-side split search — for the first tree's root over the training
rows of the labelled documents (width bins, one slot trained on all
training rows).  The SQL oracle recomputes bins, sums, prefix sums, gains
and the arg-max independently.
"""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metablend.operators.binning import apply_bins, bin_columns, fit_bins, raw_values
from metablend.operators.grow import TreeParams, _histogram, split_candidates, value_cells
from metablend.operators.learners import AdaSlot, BoostSlot, fit_ada, fit_boost
from metablend.plans.prepare import prepared_doc, split_doc, split_lineitem
from metablend.sources.carriers import DOC_CATEGORICAL, DOC_CONTINUOUS, LINE_CONTINUOUS

FEATURES = DOC_CONTINUOUS + DOC_CATEGORICAL

PARAMS = {
    "newton": TreeParams("newton", max_depth=6, lam=1.0, min_hess=1.0),
    "variance": TreeParams("variance", max_depth=3),
    "gini": TreeParams("gini", max_depth=1),
}


def _root_rows(spark: SparkSession, d: str, criterion: str) -> DataFrame:
    prep, _ = prepared_doc(spark, d, seed=42, test_frac=0.2, k=3, n_bins=16, kind="width", as_array=True)
    train = prep.where(F.col("split") == "train")
    y = F.col("label").cast("double")
    if criterion == "gini":                     # AdaBoost round 1: uniform weights
        g, h = y, F.lit(1.0)
    else:
        rate = train.agg(F.avg("label")).first()[0]
        f0 = math.log(rate / (1.0 - rate))      # the learners' initial score
        p0 = 1.0 / (1.0 + math.exp(-f0))
        g = (F.lit(p0) - y) if criterion == "newton" else (y - F.lit(p0))
        h = F.lit(p0 * (1.0 - p0))
    return train.select(F.lit(0).alias("slot"), F.lit(1).cast("long").alias("node"), "bins",
                        g.alias("g"), h.alias("h"), F.lit(1.0).alias("c"))


def root_histogram(spark: SparkSession, d: str, criterion: str) -> DataFrame:
    hist = _histogram(_root_rows(spark, d, criterion))
    return hist.select(F.col("f").alias("feature"), F.col("b").alias("bin"),
                       F.round("G", 6).alias("g_sum"), F.round("H", 6).alias("h_sum"),
                       F.col("C").cast("long").alias("rows"))


def root_split(spark: SparkSession, d: str, criterion: str) -> DataFrame:
    cand = split_candidates(_histogram(_root_rows(spark, d, criterion)), PARAMS[criterion])
    best = cand.groupBy("slot", "node").agg(F.max("best").alias("b")).select("b.*")
    out = best.select(
        (-F.col("nf")).alias("feature"), (-F.col("nb")).alias("cut"), F.round("gain", 6).alias("gain"),
        F.round("GL", 6).alias("g_left"), F.round("HL", 6).alias("h_left"), F.col("CL").cast("long").alias("n_left"),
        F.round("GR", 6).alias("g_right"), F.round("HR", 6).alias("h_right"), F.col("CR").cast("long").alias("n_right"))
    if criterion != "gini":
        return out
    # SAMME round 1: leaf = majority class, err = misclassified share, α = ln((1-err)/err)
    wrong = (F.least(F.col("g_left"), F.col("h_left") - F.col("g_left"))
             + F.least(F.col("g_right"), F.col("h_right") - F.col("g_right")))
    err = wrong / (F.col("h_left") + F.col("h_right"))
    return out.select("feature", "cut", "gain", "n_left", "n_right",
                      F.round(err, 6).alias("err"), F.round(F.log((1.0 - err) / err), 6).alias("alpha"))


def newton_tree_depth2(spark: SparkSession, d: str) -> DataFrame:
    """The first Newton tree grown to depth 2 by the fused grower itself
    (rows moved by look-ups of node numbers, leaf
    weights −lr·G/(H+λ)), as its tree table."""
    prep, _ = prepared_doc(spark, d, seed=42, test_frac=0.2, k=3, n_bins=16, kind="width", as_array=True)
    p = TreeParams("newton", max_depth=2, lam=1.0, min_hess=1.0)
    fit = fit_boost(prep.select("row_id", "label", "split", "fold", "bins"), "newton",
                    [BoostSlot(-1, 1, 0.3, 2)], params=p)
    return fit.trees_df(spark, "newton").select(
        "node", "feature", "cut", F.round("leaf", 6).alias("leaf"))


# --- whole rounds over raw values and over bins with missing values, replayed in SQL ----------------
def _train_values(spark: SparkSession, d: str) -> DataFrame:
    """Split documents with the raw features as ``bins``."""
    df = split_doc(spark, d, seed=42, test_frac=0.2, k=3)
    return raw_values(df, FEATURES).select("row_id", "label", "split", "fold", "bins")


def _tree_rows(fit) -> DataFrame:
    return fit.trees_df(SparkSession.getActiveSession(), "m").select(
        "tree", "node", "feature", F.round("cut", 6).alias("cut"), F.round("leaf", 6).alias("leaf"))


def gbm_rounds_exact(spark: SparkSession, d: str) -> DataFrame:
    """Two rounds of gradient boosting with depth-2 trees that cut raw values, as the tree table."""
    return _tree_rows(fit_boost(_train_values(spark, d), "gbm", [BoostSlot(-1, 2, 0.1, 2)], params=TreeParams("variance", max_depth=2)))


def gbm_round_exact(spark: SparkSession, d: str) -> DataFrame:
    """The first split of gradient boosting over raw values: feature, cut and rows on either side."""
    return _root_exact(spark, d, "variance")


def _root_exact(spark: SparkSession, d: str, criterion: str) -> DataFrame:
    train = _train_values(spark, d).where(F.col("split") == "train")
    y = F.col("label").cast("double")
    if criterion == "gini":
        g, h = y, F.lit(1.0)
    else:
        rate = F.lit(train.agg(F.avg("label")).first()[0])
        g, h = y - rate, rate * (1.0 - rate)
    rows = train.select(F.lit(0).alias("slot"), F.lit(1).cast("long").alias("node"), "bins", g.alias("g"), h.alias("h"), F.lit(1.0).alias("c"))
    cand = split_candidates(_histogram(rows), replace(PARAMS[criterion], cells=value_cells(train)))
    return cand.groupBy("slot", "node").agg(F.max("best").alias("b")).select("b.*").select(
        (-F.col("nf")).alias("feature"), F.round("cut", 6).alias("cut"), F.round("gain", 6).alias("gain"),
        F.round("GL", 6).alias("g_left"), F.col("CL").cast("long").alias("n_left"),
        F.round("GR", 6).alias("g_right"), F.col("CR").cast("long").alias("n_right"))


def ada_rounds_exact(spark: SparkSession, d: str) -> DataFrame:
    """Three SAMME rounds with stumps that cut raw values: the stumps and their weights."""
    fit = fit_ada(_train_values(spark, d), [AdaSlot(-1, 3, 1.0)])
    return fit.trees_df(spark, "m").select("tree", "node", "feature", F.round("cut", 6).alias("cut"), "leaf",
                                           F.round("tree_weight", 6).alias("alpha"))


#: the documents' features with values missing by rule (not at random)
HOLES = {"n_words": "CASE WHEN n_words % 5 <> 0 THEN n_words END", "uniq_ratio": "CASE WHEN toxic = 0 OR n_chars > 500 THEN uniq_ratio END"}


def newton_rounds_missing(spark: SparkSession, d: str) -> DataFrame:
    """Two Newton rounds (depth 2) over 255 quantile bins with missing values: the learned sides are part of the tree table."""
    df = split_doc(spark, d, seed=42, test_frac=0.2, k=3)
    df = df.select("row_id", "label", "split", "fold", *[F.expr(HOLES.get(c, c)).alias(c) for c in FEATURES])
    df = df.checkpoint(eager=True)
    specs = fit_bins(df.where(F.col("split") == "train"), DOC_CONTINUOUS, DOC_CATEGORICAL)
    prep = apply_bins(df, specs).select("row_id", "label", "split", "fold", "bins")
    fit = fit_boost(prep, "newton", [BoostSlot(-1, 2, 0.3, 2)], params=TreeParams("newton", max_depth=2, lam=1.0, min_hess=1.0))
    return fit.trees_df(spark, "m").select("tree", "node", "feature", "cut", F.round("leaf", 6).alias("leaf"), "missing_left")


def bin_quantile(spark: SparkSession, d: str) -> DataFrame:
    """255 quantile bins with full cuts, fitted on the training lines and applied to every line."""
    li = split_lineitem(spark, d, 42, checkpoint=True)
    specs = fit_bins(li.where(F.col("split") == "train"), LINE_CONTINUOUS)
    return bin_columns(li, specs).select("row_id", *[f"b_{c}" for c in LINE_CONTINUOUS])


ROUND_QUERIES = {
    "gbm_rounds_exact": gbm_rounds_exact,
    "gbm_round_exact": gbm_round_exact,
    "ada_stump_exact": lambda s, d: _root_exact(s, d, "gini"),
    "ada_rounds_exact": ada_rounds_exact,
    "newton_rounds_missing": newton_rounds_missing,
    "bin_quantile": bin_quantile,
    "newton_tree_depth2": newton_tree_depth2,
    "newton_hist": lambda s, d: root_histogram(s, d, "newton"),
    "newton_round": lambda s, d: root_split(s, d, "newton"),
    "gbm_round": lambda s, d: root_split(s, d, "variance"),
    "ada_stump_round": lambda s, d: root_split(s, d, "gini"),
}
