"""Deterministic keys, splits and folds.

Spark has no row order, so every random choice of the study (shuffled split,
shuffled K-fold) becomes a function of the row key:

    h(row) = first 32 bits of md5(row_id || '|' || seed)      (0 <= h < 2^32)

*Hash mode* (``fold = h % k``, ``test = h % 100 < pct``) is a narrow map.
*Exact mode* ranks rows by ``(h, row_id)`` — within the label when
stratified — and takes ``test = rank < ceil(frac * n)``,
``fold = (rank - n_test) % k``, which gives exact sizes and folds that differ
by at most one row per label.  The rank is computed in two levels so no class
ever lands in one task: rows are bucketed by the top bits of ``h``, bucket
counts (at most labels x 2^bits rows) are prefix-summed and broadcast back,
and ``row_number`` runs only inside a (label, bucket) partition.  Where the rows
are materialised anyway (``keep``), that is done between the two levels: the
source is read, hashed and shuffled once, and the counts come from what was kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metablend.operators.prefix import attach


def key_hash(row_id: str | Column, seed: int) -> Column:
    """32-bit unsigned hash of the key, identical to DuckDB's
    ``cast('0x' || substr(md5(cast(row_id as varchar) || '|<seed>'), 1, 8) as bigint)``."""
    rid = F.col(row_id) if isinstance(row_id, str) else row_id
    digest = F.md5(F.concat(rid.cast("string"), F.lit(f"|{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_split(df: DataFrame, seed: int = 42, test_pct: int = 20,
               key: str = "row_id") -> DataFrame:
    """Narrow split: ``test`` when ``h % 100 < test_pct``."""
    h = key_hash(key, seed)
    return df.withColumn("split", F.when(h % 100 < test_pct, F.lit("test")).otherwise(F.lit("train")))


def hash_folds(df: DataFrame, k: int, seed: int = 42, key: str = "row_id") -> DataFrame:
    """Narrow, stream-safe, approximately balanced folds: ``fold = h % k``."""
    return df.withColumn("fold", (key_hash(key, seed) % k).cast("int"))


Keep = Callable[[DataFrame], DataFrame]


def two_level_rank(df: DataFrame, order_col: str, tie_col: str, partition_cols: list[str], bits: int = 16,
                   keep: Keep | None = None, partitions: int | None = None) -> DataFrame:
    """Adds ``_rank`` (0-based, ordered by ``order_col, tie_col`` within
    ``partition_cols``) and ``_n`` (partition size).  ``order_col`` must be a
    uniform 32-bit hash so the ``2^bits`` buckets are balanced.

    ``keep`` (a checkpoint) materialises the rows, in ``partitions`` partitions, and the bucket table."""
    shift = 32 - bits
    with_b = df.withColumn("_bucket", F.shiftright(F.col(order_col), shift).cast("int"))
    # the sort compares its first column by itself, so that is the bucket, of which there are many
    w_in = Window.partitionBy("_bucket", *partition_cols).orderBy(order_col, tie_col)
    place = F.row_number().over(w_in)
    if keep is not None:
        if partitions is not None:  # the partitions that the window asks for, too: one shuffle does for both
            with_b = with_b.repartition(partitions, "_bucket", *partition_cols)
        with_b, place = keep(with_b.withColumn("_place", place)), F.col("_place")
    counts = with_b.groupBy(*partition_cols, "_bucket").agg(F.count(F.lit(1)).alias("_cnt"))
    # the bucket table has at most (#labels) x 2^bits rows; a null label is a label of its own
    w_before = (Window.partitionBy(*partition_cols).orderBy("_bucket")
                .rowsBetween(Window.unboundedPreceding, -1))
    w_all = Window.partitionBy(*partition_cols)
    offsets = counts.select(
        *partition_cols, "_bucket",
        F.coalesce(F.sum("_cnt").over(w_before), F.lit(0)).alias("_offset"),
        F.sum("_cnt").over(w_all).alias("_n"),
    )
    joined = attach(with_b, offsets if keep is None else keep(offsets), [*partition_cols, "_bucket"], few=True)
    return (joined
            .withColumn("_rank", F.col("_offset") + place - 1)
            .drop("_bucket", "_offset", "_place"))


def exact_split_folds(df: DataFrame, seed: int = 42, test_frac: float | None = 0.2,
                      k: int | None = 5, stratify: bool = True, key: str = "row_id",
                      label: str = "label", bits: int = 16,
                      keep: Keep | None = None, partitions: int | None = None) -> DataFrame:
    """Exact split and/or folds (D1-D5).  ``keep``, ``partitions``: see ``two_level_rank``.

    ``split``: 'test' for the first ``ceil(test_frac * n)`` ranks (per label
    when stratified), else 'train'.  ``fold``: ``(rank - n_test) % k`` on
    train rows, null on test rows.  With ``test_frac=None`` every row is
    'train' and only folds are assigned; with ``k=None`` no fold column.
    """
    parts = [label] if stratify else []
    hashless = None if keep is None else lambda rows: keep(rows.drop("_h"))
    ranked = two_level_rank(df.withColumn("_h", key_hash(key, seed)), "_h", key, parts, bits, hashless, partitions)
    if test_frac is None:
        n_test = F.lit(0).cast("bigint")
    else:
        n_test = F.ceil(F.col("_n") * F.lit(float(test_frac))).cast("bigint")
    out = ranked.withColumn("_ntest", n_test).withColumn(
        "split", F.when(F.col("_rank") < F.col("_ntest"), F.lit("test")).otherwise(F.lit("train")))
    if k is not None:
        out = out.withColumn(
            "fold", F.when(F.col("split") == "train",
                           ((F.col("_rank") - F.col("_ntest")) % k).cast("int")))
    return out.drop("_h", "_rank", "_n", "_ntest")
