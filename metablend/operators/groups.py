"""Folds over groups of equal rows, with keys made of content.

A random split of the study may put copies of one record on both sides.  Here a
row's key is the hash of its content and of its number among its copies, so
the table needs no key column and no order, and a fold is a property of the
content: no copy crosses a fold.

* ``content`` = md5 of the feature columns; ``row_id`` = md5 of content, label
  and copy number (0, 1, ...).  Copies are equal, so which of them gets which
  number does not matter: the rows are counted first (partial sums, one row per
  distinct record) and written out again from the counts, ``COPIES_PER_TASK_ROW`` at
  a time, so a record that makes up a third of the table is spread over tasks.
* Folds are balanced by rows within the label (of a content with several labels:
  the commonest, the smaller on a tie).  Contents stand in hash order; each gets
  the fold that its capped prefix weight falls into (``quantile_cuts`` with k
  bins): a content larger than a fold counts as one fold, the others share the
  rest.  At most k - 1 cuts per label come back; assigning a fold is narrow.

Null features and labels are values of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metablend.operators.binning import bins_below, quantile_cuts

COPIES_PER_TASK_ROW = 10_000
NULL = "\\N"


def content_key(cols: list[str]) -> Column:
    """md5 over the columns' text, separated; null is a value."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit(NULL)) for c in cols]))


def content_place(content: Column, seed: int) -> Column:
    """Place in hash order: 52 bits (exact as a double).  Contents that share a place share a fold."""
    return F.conv(F.substring(F.md5(F.concat(content, F.lit(f"|{seed}"))), 1, 13), 16, 10).cast("bigint")


def grouped_folds(df: DataFrame, features: list[str], k: int, seed: int = 42, label: str = "label") -> DataFrame:
    """``row_id, content, *features, label, fold``: every row of ``df``, no content in two folds."""
    counts = df.groupBy(*features, label).agg(F.count(F.lit(1)).alias("_n")).withColumn("content", content_key(features))
    # one row per content: its rows and its label
    rank = Window.partitionBy("content").orderBy(F.col("_n").desc(), F.col(label).asc_nulls_first())  # at most one row per label
    groups = counts.withColumn("_r", F.row_number().over(rank)).groupBy("content").agg(
        F.sum("_n").alias("w"), F.max(F.when(F.col("_r") == 1, F.coalesce(F.col(label).cast("int"), F.lit(-1)))).alias("f"))
    groups = groups.withColumn("x", content_place(F.col("content"), seed))
    places = groups.groupBy("f", F.col("x").cast("double").alias("x")).agg(F.sum("w").alias("w"))
    cuts = quantile_cuts(places, k)
    fold = F.lit(None).cast("int")
    for f, own in cuts.items():
        fold = F.when(F.col("f") == f, bins_below(F.col("x").cast("double"), own)).otherwise(fold)
    folded = groups.select(F.col("content").alias("_content"), fold.cast("int").alias("fold"))
    one = counts.join(folded, counts["content"] == folded["_content"]).drop("_content")
    # write the copies out again: first in blocks, dealt anew, then row by row
    step = COPIES_PER_TASK_ROW
    blocks = one.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(step).cast("bigint"))))
    rows = blocks.repartition("content", label, "_from").withColumn(
        "_i", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + step, F.col("_n")) - 1)))
    row_id = F.md5(F.concat_ws("|", "content", F.coalesce(F.col(label).cast("string"), F.lit(NULL)), F.col("_i").cast("string")))
    return rows.select(row_id.alias("row_id"), "content", *features, label, "fold")
