"""Table profiles: column/type/role/non-null summary and an ordered preview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_info(df: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    """One pass: ``col_name, type, role, non_null, rows`` (the ``info()`` view as a table)."""
    roles = roles or {}
    cols = df.columns
    counts = df.agg(F.count(F.lit(1)).alias("_rows"),
                    *[F.count(F.col(c)).alias(f"_nn{i}") for i, c in enumerate(cols)])
    types = dict(df.dtypes)
    entries = F.array(*[F.struct(F.lit(c).alias("col_name"), F.lit(types[c]).alias("type"),
                                 F.lit(roles.get(c, "other")).alias("role"),
                                 F.col(f"_nn{i}").alias("non_null"))
                        for i, c in enumerate(cols)])
    return counts.select(F.inline(entries), F.col("_rows").alias("rows"))


def preview(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    """Deterministic head: top-n by key (TakeOrderedAndProject, no global sort)."""
    return df.orderBy(*order_by).limit(n)
