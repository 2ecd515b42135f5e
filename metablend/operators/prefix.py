"""Distributed 'sum of everything strictly below me' over an ordered column.

A plain ``sum(..) OVER (ORDER BY x)`` without PARTITION BY runs in a single
task.  Here the ordered values of a group are cut at approximate quantiles
(a mergeable sketch) into ``n_buckets`` buckets of about equally many values,
however skewed they are; per-bucket totals (at most groups x n_buckets rows)
are prefix-summed, and the running sum only runs inside one (group, bucket)
partition.  Callers pre-aggregate to one row per distinct value first, so a
value held by a third of all rows is still one row here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

N_BUCKETS = 1024


def count_below(bounds: Column, x: Column, n: int) -> Column:
    """How many of the (at most ``n``) ascending bounds are smaller than x: a binary search."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(n, 1).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(
        F.coalesce(F.get(bounds, at + step - 1) < x, F.lit(False)), step).otherwise(0))


def attach(df: DataFrame, small: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """Inner join of ``small`` (one row per group) on null-safe keys.  ``few``: the caller knows that
    the number of groups is bounded by a parameter, so the small side may be broadcast."""
    renamed = small.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    side = F.broadcast(renamed) if few or not keys else renamed
    on = F.lit(True)
    for k in keys:
        on = on & df[k].eqNullSafe(renamed[f"_k_{k}"])
    return df.join(side, on).drop(*[f"_k_{k}" for k in keys])


def below_sums(df: DataFrame, by: list[str], order_col: str, sum_cols: list[str],
               n_buckets: int = N_BUCKETS, few_groups: bool = False) -> DataFrame:
    """Adds ``<c>_below`` = sum of ``c`` over rows of the same group whose
    ``order_col`` is strictly smaller (``df`` has one row per distinct value;
    a null ``order_col`` has no place and its row is left out).

    ``few_groups``: the number of groups is bounded by a parameter (features,
    folds, configs), so tables of a row per group or bucket are broadcast."""
    df = df.where(F.col(order_col).isNotNull())
    cuts = [i / n_buckets for i in range(1, n_buckets)]
    bounds = df.groupBy(*by).agg(F.percentile_approx(F.col(order_col).cast("double"), cuts, 10 * n_buckets).alias("_cuts"))
    with_b = attach(df, bounds, by, few_groups).withColumn(
        "_bk", count_below(F.col("_cuts"), F.col(order_col).cast("double"), n_buckets)).drop("_cuts")
    btot = with_b.groupBy(*by, "_bk").agg(*[F.sum(c).alias(f"_bt_{c}") for c in sum_cols])
    w_prev = Window.partitionBy(*by).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offs = btot.select(*by, "_bk", *[F.coalesce(F.sum(f"_bt_{c}").over(w_prev), F.lit(0))
                                     .alias(f"_off_{c}") for c in sum_cols])
    joined = attach(with_b, offs, [*by, "_bk"], few_groups or not by)
    w_in = Window.partitionBy(*by, "_bk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    for c in sum_cols:
        joined = joined.withColumn(
            f"{c}_below", F.col(f"_off_{c}") + F.coalesce(F.sum(c).over(w_in), F.lit(0)))
    return joined.drop("_bk", *[f"_off_{c}" for c in sum_cols])
