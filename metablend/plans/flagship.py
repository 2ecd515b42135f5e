"""Flagship: AUC / accuracy / precision / recall / F1 of a blended score.

documents ⋈ labels → text-shape features → stratified exact split → folds →
width bins fitted on train → two closed-form bin-rate bases (out-of-fold on
train rows, fold-averaged on test rows) → mean blend → metrics on test rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metablend.functions.metrics import metric_table, threshold
from metablend.operators.closed_form import bin_rate_scores
from metablend.plans.prepare import prepared_doc

BASES = [("p_uniq", "b_uniq_ratio"), ("p_nonalpha", "b_nonalpha_ratio")]


def blended_scores(spark: SparkSession, sf_dir: str, k: int = 3, n_bins: int = 16,
                   prior: float = 1.0, seed: int = 42) -> DataFrame:
    prepared, _ = prepared_doc(spark, sf_dir, seed=seed, k=k, n_bins=n_bins, kind="width")
    scored = bin_rate_scores(prepared, BASES, k, prior)
    blend = sum((F.col(n) for n, _ in BASES), F.lit(0.0)) / float(len(BASES))
    return scored.withColumn("score", blend).withColumn("pred", threshold("score"))


def blend_metrics(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    scored = blended_scores(spark, sf_dir, k=k).where(F.col("split") == "test")
    return metric_table(scored).select("metric", F.round("value", 6).alias("value"))
