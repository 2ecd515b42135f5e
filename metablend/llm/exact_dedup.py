"""Exact deduplication against a persistent digest index (DataFrame operations only).

The index is a Parquet table bucketed and sorted by the SHA-256 of the
normalised text (A-Z lower-cased, null as empty).  A batch is reduced to one row
per digest by a partial aggregation, so a group that holds a third of all rows
is one row before it meets the index; the digests the index lacks are found by
a sort-merge anti-join on the buckets and appended.

Edge cases: null and empty texts are one group (the empty text); of equal texts
the largest id stays, null ids last; rows that repeat the staying id all stay
(they are the same document); an empty batch appends nothing; only the id and
text columns are read, so other columns, whatever their names, do not matter.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_az

BUCKETS = 64


def text_digest(col):
    """Bare lower-case hex SHA-256 of the normalised text."""
    return F.sha2(lower_az(F.coalesce(col, F.lit(""))).cast("binary"), 256)


def open_index(spark: SparkSession, path: str, id_type: str = "bigint", buckets: int = BUCKETS) -> str:
    """Register the index stored at ``path`` (created empty if there is none); returns its table name.

    The files and their bucketing live at ``path`` on shared storage; any later
    session opens the same index by the same path.
    """
    name = "digest_index_" + hashlib.md5(path.encode()).hexdigest()
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (digest STRING, keep_id {id_type}, group_size BIGINT) "
        f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")
    return name


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(docs[id_col].alias("_id"), text_digest(docs[text_col]).alias("digest"))


def append_new(batch: DataFrame, index: str) -> None:
    """Append the digests of ``batch`` (``digests()``) that the index lacks: sort-merge anti-join, insert."""
    spark = batch.sparkSession
    new = batch.groupBy("digest").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    known = spark.table(index).select("digest")
    (new.join(known.hint("merge"), "digest", "left_anti")
        .select("digest", "keep_id", "group_size").write.insertInto(index))


def dedup(docs: DataFrame, index_path: str, id_col: str = "doc_id", text_col: str = "text",
          buckets: int = BUCKETS) -> DataFrame:
    """Deduplicate a batch against the index at ``index_path`` and add what is new to it.

    One row per document: ``_id, digest, keep_id, group_size, kept``.  A text
    that an earlier batch brought in stays with that batch's document.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    index = open_index(spark, index_path, id_type, buckets)
    rows = digests(docs, id_col, text_col)
    append_new(rows, index)
    spark.catalog.refreshTable(index)
    # a plain scan of the index for this join: both sides are then exchanged, and
    # Spark splits the partition of a hot digest
    seen = spark.read.schema(spark.table(index).schema).parquet(index_path)
    return rows.hint("merge").join(seen, "digest").select(
        "_id", "digest", "keep_id", "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"))
