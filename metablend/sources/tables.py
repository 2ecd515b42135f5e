"""Scans: Parquet tables of a scale-factor folder and typed CSV study tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table; projections and filters applied later reach the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def normalise_names(df: DataFrame) -> DataFrame:
    """Column names with spaces become identifiers: ``chest pain type`` → ``chest_pain_type``."""
    return df.toDF(*[re.sub(r"\s", "_", c.strip()) for c in df.columns])


def read_csv_typed(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Header CSV (CRLF or LF line ends) with a fixed schema, names normalised.

    With a schema no inference pass runs; without one Spark infers the numeric
    types (one extra scan) as the study notebooks do.
    """
    reader = spark.read.option("header", True).option("mode", "FAILFAST")
    if schema is not None:
        # header names are replaced by the schema's (normalised) names by position
        df = reader.schema(schema).csv(path)
    else:
        df = reader.option("inferSchema", True).csv(path)
    return normalise_names(df)
