"""Prepared training tables: key, split, fold and bins, materialised once.

The prepared table is checkpointed to the session's reliable checkpoint
folder: text features are computed once, lineage is cut, and a lost
executor re-reads the checkpoint instead of re-deriving it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metablend.operators.binning import BinSpec, apply_bins, bin_columns, fit_bins
from metablend.operators.keys import exact_split_folds
from metablend.session import ensure_checkpoint_dir
from metablend.sources.carriers import (
    DOC_CATEGORICAL, DOC_CONTINUOUS, LINE_CONTINUOUS, doc_quality, lineitem_return,
)


def split_doc(spark: SparkSession, sf_dir: str, seed: int = 42, test_frac: float | None = 0.2,
              k: int | None = 3, checkpoint: bool = True) -> DataFrame:
    df = exact_split_folds(doc_quality(spark, sf_dir), seed=seed, test_frac=test_frac, k=k)
    if checkpoint:
        ensure_checkpoint_dir(spark)
        df = df.checkpoint(eager=True)
    return df


def prepared_doc(spark: SparkSession, sf_dir: str, seed: int = 42, test_frac: float | None = 0.2,
                 k: int | None = 3, n_bins: int = 16, kind: str = "width",
                 as_array: bool = False) -> tuple[DataFrame, list[BinSpec]]:
    """doc_quality + split + fold + bins fitted on the training rows."""
    df = split_doc(spark, sf_dir, seed, test_frac, k)
    specs = fit_bins(df.where(F.col("split") == "train"), DOC_CONTINUOUS, DOC_CATEGORICAL, n_bins, kind)
    return (apply_bins(df, specs) if as_array else bin_columns(df, specs)), specs


def split_lineitem(spark: SparkSession, sf_dir: str, seed: int = 42, test_frac: float | None = 0.2,
                   k: int | None = 3, stratify: bool = True, checkpoint: bool = False) -> DataFrame:
    """lineitem_return + exact split/folds; ``checkpoint`` materialises it once
    when both a fit (scaler, bins) and an apply read it."""
    df = exact_split_folds(lineitem_return(spark, sf_dir), seed=seed, test_frac=test_frac,
                           k=k, stratify=stratify)
    if checkpoint:
        ensure_checkpoint_dir(spark)
        df = df.checkpoint(eager=True)
    return df


def prepared_lineitem(spark: SparkSession, sf_dir: str, n_bins: int = 16, kind: str = "width",
                      seed: int = 42) -> tuple[DataFrame, list[BinSpec]]:
    df = split_lineitem(spark, sf_dir, seed, checkpoint=True)
    specs = fit_bins(df.where(F.col("split") == "train"), LINE_CONTINUOUS, [], n_bins, kind)
    return bin_columns(df, specs), specs
