"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Parameters are fixed per query (seed 42, 20 % test, 3 folds on the labelled
documents, 5 folds on orders) so a SQL oracle can recompute the same result.
Float outputs are rounded to 6 decimals.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metablend.functions import fidelity as G
from metablend.functions import metrics as M
from metablend.functions.profile import preview, table_info
from metablend.operators.binning import bin_columns, fit_bins
from metablend.operators.closed_form import bin_rate_scores
from metablend.operators.groups import grouped_folds
from metablend.operators.keys import exact_split_folds, hash_split
from metablend.operators.scale import apply_scaler, fit_scaler
from metablend.plans.flagship import BASES, blend_metrics, blended_scores
from metablend.plans.prepare import prepared_doc, split_doc, split_lineitem
from metablend.session import ensure_checkpoint_dir
from metablend.sources.carriers import (
    DOC_CATEGORICAL, DOC_CONTINUOUS, DOC_FEATURES, LINE_CONTINUOUS, doc_quality,
    lineitem_return, orders_status,
)
from metablend.sources.metric_store import read_metrics, write_metrics
from metablend.sources.tables import read_table

SEED = 42
K_DOC = 3
K_ORDERS = 5


def rnd(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (both sides of the oracle compare do this)."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes])


def fixed_score(df: DataFrame) -> DataFrame:
    """Score with deliberate ties for metric checks: round(uniq_ratio, 3)."""
    s = F.round(F.col("uniq_ratio"), 3)
    return df.withColumn("score", s).withColumn("pred", M.threshold(s))


# ---------------------------------------------------------------- S, P
def q_scan_typed(spark, d):
    return rnd(doc_quality(spark, d))


def q_feature_projection(spark, d):
    return lineitem_return(spark, d).select("row_id", "label", *LINE_CONTINUOUS)


def q_rename_columns(spark, d):
    """S2: a source whose header uses spaces ('l quantity') gets identifier
    names ('l_quantity'), the same rule the typed CSV reader applies."""
    from metablend.sources.tables import normalise_names, read_table
    cols = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"]
    spaced = read_table(spark, d, "lineitem").select(*cols).toDF(*[c.replace("_", " ") for c in cols])
    return normalise_names(spaced)


def q_table_info(spark, d):
    roles = {c: "continuous" for c in DOC_CONTINUOUS}
    roles.update({c: "categorical" for c in DOC_CATEGORICAL})
    roles["label"] = "label"
    roles["row_id"] = "key"
    return table_info(doc_quality(spark, d), roles)


def q_preview_topk(spark, d):
    return rnd(preview(doc_quality(spark, d), ["row_id"], 5))


def q_split_counts(spark, d):
    s = split_doc(spark, d, SEED, 0.2, K_DOC, checkpoint=False)
    return s.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


def q_fold_filter(spark, d):
    s = split_doc(spark, d, SEED, 0.2, K_DOC, checkpoint=False)
    return s.where((F.col("split") == "train") & (F.col("fold") != 1)).select("row_id", "label", "fold")


def q_threshold_label(spark, d):
    return rnd(fixed_score(doc_quality(spark, d)).select("row_id", "score", "pred"))


# ---------------------------------------------------------------- D
def q_split_hash(spark, d):
    return hash_split(orders_status(spark, d), SEED, 20).select("row_id", "split")


def q_split_exact(spark, d):
    return exact_split_folds(orders_status(spark, d), SEED, 0.2, None, stratify=False) \
        .select("row_id", "split")


def q_split_stratified(spark, d):
    return exact_split_folds(orders_status(spark, d), SEED, 0.2, None, stratify=True) \
        .select("row_id", "label", "split")


def q_kfold_hash(spark, d):
    """D3 narrow mode: fold = h % k (stream-safe, approximately balanced)."""
    from metablend.operators.keys import hash_folds
    return hash_folds(orders_status(spark, d), K_ORDERS, SEED).select("row_id", "fold")


def q_kfold_assign(spark, d):
    return exact_split_folds(orders_status(spark, d), SEED, None, K_ORDERS, stratify=False) \
        .select("row_id", "fold")


def q_kfold_stratified(spark, d):
    return exact_split_folds(orders_status(spark, d), SEED, None, K_ORDERS, stratify=True) \
        .select("row_id", "label", "fold")


def q_fold_balance(spark, d):
    s = split_doc(spark, d, SEED, 0.2, K_DOC, checkpoint=False).where(F.col("split") == "train")
    return s.rollup("fold", "label").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- F, L0
def q_scale_fit_transform(spark, d):
    li = lineitem_return(spark, d)
    params = fit_scaler(li, LINE_CONTINUOUS)
    return rnd(apply_scaler(li, params).select("row_id", *LINE_CONTINUOUS))


def q_scale_train_apply_test(spark, d):
    li = split_lineitem(spark, d, SEED, checkpoint=True)
    params = fit_scaler(li, LINE_CONTINUOUS, where=F.col("split") == "train")
    return rnd(apply_scaler(li.where(F.col("split") == "test"), params)
               .select("row_id", *LINE_CONTINUOUS))


def q_bin_features(spark, d):
    li = split_lineitem(spark, d, SEED, checkpoint=True)
    specs = fit_bins(li.where(F.col("split") == "train"), LINE_CONTINUOUS, [], 16, "width")
    return bin_columns(li, specs).select("row_id", *[f"b_{c}" for c in LINE_CONTINUOUS])


# ---------------------------------------------------------------- K4, K5, flagship
def q_oof_table(spark, d):
    s = blended_scores(spark, d, k=K_DOC)
    return rnd(s.where(F.col("split") == "train").select("row_id", "label", "fold", *[n for n, _ in BASES]))


def q_fold_average(spark, d):
    s = blended_scores(spark, d, k=K_DOC)
    return rnd(s.where(F.col("split") == "test").select("row_id", "label", *[n for n, _ in BASES]))


def q_blend_metrics(spark, d):
    return blend_metrics(spark, d, k=K_DOC)


# ---------------------------------------------------------------- M, N
def q_metric_accuracy(spark, d):
    return rnd(M.accuracy(fixed_score(doc_quality(spark, d)), by=["origin"]))


def _line_scored(spark, d):
    li = lineitem_return(spark, d)
    return li.withColumn("score", F.round(F.col("l_extendedprice") / 105000.0, 3))


def q_metric_auc(spark, d):
    return rnd(M.auc(_line_scored(spark, d), by=["origin"]))


def q_metric_auc_doc(spark, d):
    return rnd(M.auc(fixed_score(doc_quality(spark, d))))


def q_metric_report(spark, d):
    return rnd(M.report(fixed_score(doc_quality(spark, d))))


def q_metric_prf(spark, d):
    return rnd(M.prf(fixed_score(doc_quality(spark, d)), by=["origin"]))


def q_confusion(spark, d):
    return M.confusion(fixed_score(doc_quality(spark, d)))


def q_roc_points(spark, d):
    return rnd(M.roc_points(fixed_score(doc_quality(spark, d))))


def q_pr_points(spark, d):
    return rnd(M.pr_points(fixed_score(doc_quality(spark, d))))


def q_metric_ap(spark, d):
    return rnd(M.average_precision(fixed_score(doc_quality(spark, d)), by=None))


# ---------------------------------------------------------------- G
DOC_RULES = {
    "n_chars": "n_chars >= 1",
    "n_words": "n_words >= 1",
    "uniq_ratio": "uniq_ratio > 0 AND uniq_ratio <= 1",
    "nonalpha_ratio": "nonalpha_ratio >= 0 AND nonalpha_ratio <= 1",
    "lang_code": "lang_code >= 0",
    "label": "label IN (0, 1)",
}
LINE_RULES = {
    "l_quantity": "l_quantity > 0",
    "l_extendedprice": "l_extendedprice > 0",
    "l_discount": "l_discount >= 0 AND l_discount <= 0.1",
    "l_tax": "l_tax >= 0 AND l_tax <= 0.08",
}
DUP_COLS = ["l_quantity", "l_discount", "l_tax", "l_returnflag"]


def q_describe_by_source(spark, d):
    return rnd(G.describe_by_source(doc_quality(spark, d), DOC_CONTINUOUS))


def q_describe_lineitem(spark, d):
    return rnd(G.describe_by_source(lineitem_return(spark, d), LINE_CONTINUOUS))


def q_quartiles_by_source(spark, d):
    """G1 exact quartiles by rank selection."""
    return rnd(G.quartiles_by_source(doc_quality(spark, d), DOC_CONTINUOUS))


def q_category_tvd(spark, d):
    return rnd(G.category_tvd(doc_quality(spark, d), DOC_CATEGORICAL + ["label"], "a", "b"))


def q_ks_two_sample(spark, d):
    return rnd(G.ks_two_sample(doc_quality(spark, d), DOC_CONTINUOUS, "a", "b"))


def q_ks_lineitem(spark, d):
    return rnd(G.ks_two_sample(lineitem_return(spark, d), LINE_CONTINUOUS, "F", "O"))


def q_psi_js(spark, d):
    return rnd(G.psi_js(doc_quality(spark, d), DOC_CONTINUOUS, "a", "b"))


def q_corr_delta(spark, d):
    return rnd(G.corr_delta(doc_quality(spark, d), DOC_CONTINUOUS + ["label"], "a", "b"))


def q_domain_violations(spark, d):
    return G.domain_violations(doc_quality(spark, d), DOC_RULES)


def q_domain_violations_lineitem(spark, d):
    return G.domain_violations(lineitem_return(spark, d), LINE_RULES)


def _line_raw(spark, d):
    from metablend.sources.tables import read_table
    return read_table(spark, d, "lineitem").select(*DUP_COLS, F.col("l_linestatus").alias("origin"))


def q_duplicate_rows(spark, d):
    return G.duplicate_rows(_line_raw(spark, d), DUP_COLS, by=["origin"])


def q_source_overlap(spark, d):
    return G.source_overlap(_line_raw(spark, d), DUP_COLS, "F", "O")


def q_label_association(spark, d):
    return rnd(G.label_association(doc_quality(spark, d), DOC_CATEGORICAL, DOC_CONTINUOUS))


# ---------------------------------------------------------------- H, M5, M7, S7 (closed form)
GRID_FEATURES = ["uniq_ratio", "nonalpha_ratio", "n_chars", "n_words"]
GRID_PRIORS = [1.0, 10.0]


def grid_configs():
    """Grid order: keys sorted (feature, prior), last key varies fastest."""
    return [(i, f, a) for i, (f, a) in enumerate((f, a) for f in GRID_FEATURES for a in GRID_PRIORS)]


def _grid_long(spark, d):
    prepared, _ = prepared_doc(spark, d, seed=SEED, k=K_DOC, n_bins=16, kind="width")
    out = prepared
    for prior in GRID_PRIORS:
        cfg = [(f"c{i}", f"b_{feat}") for i, feat, a in grid_configs() if a == prior]
        out = bin_rate_scores(prepared, cfg, K_DOC, prior, target=out)
    cfg = grid_configs()
    st = F.expr("stack({}, {}) as (config_id, feature, prior, score)".format(
        len(cfg), ", ".join(f"{i}, '{f}', CAST({a} AS DOUBLE), c{i}" for i, f, a in cfg)))
    return out.where(F.col("split") == "train").select("fold", "label", st) \
        .withColumn("pred", M.threshold("score"))


def q_grid_cv_scores(spark, d):
    return rnd(M.accuracy(_grid_long(spark, d), by=["config_id", "feature", "prior", "fold"]))


def q_grid_select(spark, d):
    from metablend.plans.search import select_best
    per = M.accuracy(_grid_long(spark, d), by=["config_id", "feature", "prior", "fold"])
    mean = per.groupBy("config_id", "feature", "prior").agg(F.round(F.avg("accuracy"), 9).alias("mean_score"))
    best = select_best(mean, "mean_score", "config_id").where(F.col("selected"))
    return rnd(best.select("config_id", "feature", "prior", F.col("mean_score").alias("mean_accuracy")))


def _oof_long(spark, d):
    s = blended_scores(spark, d, k=K_DOC).where(F.col("split") == "train")
    st = F.expr("stack(3, 'p_uniq', p_uniq, 'p_nonalpha', p_nonalpha, 'blend', score) as (model, p)")
    return s.select("fold", "label", st).withColumn("pred", M.threshold("p"))


def q_cv_summary(spark, d):
    per = M.accuracy(_oof_long(spark, d), by=["model", "fold"])
    return rnd(per.groupBy("model").agg(F.avg("accuracy").alias("mean_accuracy"),
                                        F.stddev_pop("accuracy").alias("std_accuracy"),
                                        F.count(F.lit(1)).alias("folds")))


def q_fold_metric_mean(spark, d):
    lg = _oof_long(spark, d).where(F.col("model") == "blend")
    per = M.accuracy(lg, by=["fold"]).join(M.auc(lg, label="label", score="p", by=["fold"]), "fold")
    return rnd(per.agg(F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("std_accuracy"),
                       F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc")))


def q_model_leaderboard(spark, d):
    from pyspark.sql import Window
    s = blended_scores(spark, d, k=K_DOC).where(F.col("split") == "test")
    st = F.expr("stack(3, 'p_uniq', p_uniq, 'p_nonalpha', p_nonalpha, 'blend', score) as (model, score)")
    lg = s.select("label", st).withColumn("pred", M.threshold("score"))
    a = M.auc(lg, by=["model"]).select("model", F.lit("auc").alias("metric"), F.round("auc", 6).alias("value"))
    c = M.accuracy(lg, by=["model"]).select("model", F.lit("accuracy").alias("metric"),
                                            F.round("accuracy", 6).alias("value"))
    w = Window.partitionBy("metric").orderBy(F.col("value").desc())
    return a.unionByName(c).withColumn("rank", F.rank().over(w))


def q_two_source_eval(spark, d):
    """Closed-form models fitted on source a, evaluated on source b."""
    from metablend.operators.closed_form import bin_rate_full
    dq = doc_quality(spark, d)
    specs = fit_bins(dq.where(F.col("origin") == "a"), ["uniq_ratio", "nonalpha_ratio"], [], 16, "width")
    b = bin_columns(dq, specs)
    tr, ev = b.where(F.col("origin") == "a"), b.where(F.col("origin") == "b")
    ev = bin_rate_full(tr, ev, "b_uniq_ratio", "p_uniq")
    ev = bin_rate_full(tr, ev, "b_nonalpha_ratio", "p_nonalpha")
    ev = ev.withColumn("blend", (F.col("p_uniq") + F.col("p_nonalpha")) / 2.0)
    st = F.expr("stack(3, 'p_uniq', p_uniq, 'p_nonalpha', p_nonalpha, 'blend', blend) as (model, score)")
    lg = ev.select("label", st).withColumn("pred", M.threshold("score"))
    return M.metric_table(lg, by=["model"]).select("model", "metric", F.round("value", 6).alias("value"))


def q_quartiles_lineitem(spark, d):
    """G1 over every line: exact quartiles of all numeric columns per line status."""
    return rnd(G.quartiles_by_source(lineitem_return(spark, d), LINE_CONTINUOUS))


def q_schema_match(spark, d):
    """G6: do two sources have one schema?  (Two tables that share a column name, one with another type.)"""
    return G.schema_match(read_table(spark, d, "documents").withColumn("doc_id", F.col("doc_id").cast("string")),
                          read_table(spark, d, "labels").withColumn("text", F.lit(None).cast("string")))


def q_metric_sink(spark, d):
    """S6: metric tables of two studies written by run, one run repeated, all read back."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/metrics-{uuid.uuid4().hex}"
    scored = fixed_score(doc_quality(spark, d))
    for origin in ("a", "b"):
        own = rnd(M.metric_table(scored.where(F.col("origin") == origin)))
        if origin == "a":  # an earlier attempt at this run, with other rows: replaced
            write_metrics(rnd(M.metric_table(scored)), path, f"source-{origin}", "fixed")
        write_metrics(own, path, f"source-{origin}", "fixed")
    write_metrics(rnd(M.metric_table(scored)), path, "source-a", "all")
    return read_metrics(spark, path)


def q_kfold_grouped(spark, d):
    """D1-D4 over groups: content keys and folds that no copy crosses (lines with equal quantity, discount and tax)."""
    li = lineitem_return(spark, d).select("l_quantity", "l_discount", "l_tax", "label")
    return grouped_folds(li, ["l_quantity", "l_discount", "l_tax"], K_ORDERS, SEED).select("row_id", "content", "label", "fold")


QUERIES = {
    "scan_typed": q_scan_typed,
    "feature_projection": q_feature_projection,
    "rename_columns": q_rename_columns,
    "table_info": q_table_info,
    "preview_topk": q_preview_topk,
    "split_counts": q_split_counts,
    "fold_filter": q_fold_filter,
    "threshold_label": q_threshold_label,
    "split_hash": q_split_hash,
    "split_exact": q_split_exact,
    "split_stratified": q_split_stratified,
    "kfold_hash": q_kfold_hash,
    "kfold_assign": q_kfold_assign,
    "kfold_stratified": q_kfold_stratified,
    "fold_balance": q_fold_balance,
    "scale_fit_transform": q_scale_fit_transform,
    "scale_train_apply_test": q_scale_train_apply_test,
    "bin_features": q_bin_features,
    "oof_table": q_oof_table,
    "fold_average": q_fold_average,
    "blend_metrics": q_blend_metrics,
    "metric_accuracy": q_metric_accuracy,
    "metric_auc": q_metric_auc,
    "metric_auc_doc": q_metric_auc_doc,
    "metric_report": q_metric_report,
    "metric_prf": q_metric_prf,
    "confusion": q_confusion,
    "roc_points": q_roc_points,
    "pr_points": q_pr_points,
    "metric_ap": q_metric_ap,
    "describe_by_source": q_describe_by_source,
    "describe_lineitem": q_describe_lineitem,
    "quartiles_by_source": q_quartiles_by_source,
    "category_tvd": q_category_tvd,
    "ks_two_sample": q_ks_two_sample,
    "ks_lineitem": q_ks_lineitem,
    "psi_js": q_psi_js,
    "corr_delta": q_corr_delta,
    "domain_violations": q_domain_violations,
    "domain_violations_lineitem": q_domain_violations_lineitem,
    "duplicate_rows": q_duplicate_rows,
    "source_overlap": q_source_overlap,
    "label_association": q_label_association,
    "grid_cv_scores": q_grid_cv_scores,
    "grid_select": q_grid_select,
    "cv_summary": q_cv_summary,
    "fold_metric_mean": q_fold_metric_mean,
    "model_leaderboard": q_model_leaderboard,
    "two_source_eval": q_two_source_eval,
    "quartiles_lineitem": q_quartiles_lineitem,
    "schema_match": q_schema_match,
    "metric_sink": q_metric_sink,
    "kfold_grouped": q_kfold_grouped,
}
