"""Equal prepared rows counted once.

Binned rows repeat: however many rows a table has, there are at most as many
different ones as combinations of bins, fold and label.  ``compress_rows``
counts them (partial sums before one shuffle, so a combination that holds a third
of all rows is one row per task there); the learners read ``copies`` as weights,
so every pass after it costs the number of combinations, not of rows.

Learners that draw rows (sub-sampling, bootstrap) draw each copy by a hash of its
number.  ``max_copies`` bounds the copies of one counted row for them, so that a
frequent combination is drawn by many tasks.

``expand_scores`` brings the scores back to the rows by the combination; a
hot key splits on the side of the rows (adaptive skew join), the other side has one
row per key.  Scores that depend on fewer keys (``bins``) are brought back by those.

``feature_groups`` goes further, for learners that draw no rows: rows with equal bins have
equal scores whatever their label and fold, so one row per combination of bins, with its
rows and positives per model, trains them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("label", "split", "fold", "inner", "bins")


def combination(df: DataFrame) -> Column:
    """Hash of everything that a learner sees of a row (nulls are values)."""
    return F.md5(F.to_json(F.struct(*[df[k] for k in KEYS if k in df.columns]), {"ignoreNullFields": "false"}))


def compress_rows(prep: DataFrame, max_copies: int | None = None) -> DataFrame:
    """``row_id, label, split, fold[, inner], bins, copies``; ``row_id`` is the combination's hash (and its part)."""
    keys = [k for k in KEYS if k in prep.columns]
    one = prep.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    one = one.withColumn("row_id", combination(one))
    if max_copies is not None:
        step = F.lit(max_copies).cast("bigint")
        one = one.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, step))).withColumn(
            "copies", F.least(step, F.col("copies") - F.col("_from"))).withColumn(
            "row_id", F.concat_ws("-", "row_id", "_from")).drop("_from")
    return one.select("row_id", *keys, "copies")


def expand_scores(prep: DataFrame, scores: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """The rows of ``prep`` with the score columns of their combination (of ``keys``: by default, of all).
    Without a column ``copies``, ``scores`` has one row per combination."""
    keys = keys or [k for k in KEYS if k in prep.columns]
    own = scores.select(*[F.col(k).alias(f"_{k}") for k in keys], *columns)
    if "copies" in scores.columns:
        own = own.dropDuplicates([f"_{k}" for k in keys])  # parts of one combination have equal scores
    return _joined(prep, own, keys)


def feature_groups(rows: DataFrame, masks: list[Column], copies: Column) -> DataFrame:
    """One row per different ``bins``.  ``N``, ``K``, ``Q`` (an entry per mask): the number of its rows in the
    mask, of those with a label, and of those with label 1."""
    sums: dict[str, tuple] = {}
    at = []
    for m in masks:  # equal masks (slots that differ in other settings) are summed once
        at.append(sums.setdefault(str(m), (len(sums), m))[0])
    y = F.col("label")
    one = rows.groupBy("bins").agg(*[F.sum(F.when(m & keep, value)).alias(f"{name}{i}") for i, m in sums.values() for name, keep, value in (
        ("N", F.lit(True), copies), ("K", y.isNotNull(), copies), ("Q", F.lit(True), y * copies))])
    return one.select("bins", *[F.array(*[F.coalesce(f"{name}{i}", F.lit(0.0)) for i in at]).alias(name) for name in "NKQ"])


def with_group_scores(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows with the columns of the group of their ``bins``."""
    return _joined(rows, groups.withColumnRenamed("bins", "_bins"), ["bins"])


def _joined(rows: DataFrame, own: DataFrame, keys: list[str]) -> DataFrame:
    """``own`` has one row per combination of the keys (there as ``_<key>``): hashed, so the rows need no sort."""
    on = [rows[k].eqNullSafe(own[f"_{k}"]) if k != "bins" else rows[k] == own[f"_{k}"] for k in keys]
    return rows.join(own.hint("shuffle_hash"), on).drop(*[f"_{k}" for k in keys])
