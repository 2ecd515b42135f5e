"""Result tables of studies: a Parquet table partitioned by study and run.

A run's rows replace what the same run has written before (dynamic partition
overwrite), and no other run's: a study can be repeated, or its task retried,
without a trace.  Readers prune by study and run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "model string, metric string, value double, study string, run string"


def write_metrics(metrics: DataFrame, path: str, study: str, run: str) -> None:
    """Store a ``(metric, value)`` table, with ``model`` if it has one, as the result of one run.

    One file per run: a metric table has a row per model and metric."""
    model = F.col("model").cast("string") if "model" in metrics.columns else F.lit(None).cast("string")
    rows = metrics.select(model.alias("model"), F.col("metric").cast("string").alias("metric"), F.col("value").cast("double").alias("value"),
                          F.lit(study).alias("study"), F.lit(run).alias("run"))
    rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("study", "run").parquet(path)


def read_metrics(spark: SparkSession, path: str, study: str | None = None, run: str | None = None) -> DataFrame:
    """``study, run, model, metric, value`` of all runs, or of one study or run."""
    df = spark.read.schema(SCHEMA).parquet(path).select("study", "run", "model", "metric", "value")
    if study is not None:
        df = df.where(F.col("study") == study)
    return df if run is None else df.where(F.col("run") == run)
