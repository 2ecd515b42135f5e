"""Population standardisation: fit on some rows, apply to any rows.

One aggregation pass gives ``avg`` and ``stddev_pop`` per column (a
one-row result whose size is the column count).  The parameters are then
inlined as literals, so applying them is a narrow projection that also works
on streams and never joins.  ``sd = 0`` maps to 1 (the library convention).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fit_scaler(df: DataFrame, cols: list[str], where: Column | None = None) -> dict[str, tuple[float, float]]:
    src = df if where is None else df.where(where)
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    row = src.agg(*aggs).first()
    params = {}
    for c in cols:
        mean = row[f"m_{c}"]
        sd = row[f"s_{c}"]
        params[c] = (float(mean) if mean is not None else 0.0,
                     float(sd) if sd not in (None, 0.0) else 1.0)
    return params


def scale_expr(c: str, mean: float, sd: float) -> Column:
    return (F.col(c) - F.lit(mean)) / F.lit(sd)


def apply_scaler(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: scale_expr(c, m, s) for c, (m, s) in params.items()})


def params_table(spark: SparkSession, params: dict[str, tuple[float, float]]) -> DataFrame:
    """``column, mean, sd`` — the scaler as a table."""
    return spark.createDataFrame([(c, m, s) for c, (m, s) in params.items()],
                                 "column string, mean double, sd double")
