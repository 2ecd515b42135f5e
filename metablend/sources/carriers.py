"""Labelled training tables derived from the driver's Parquet tables.

``doc_quality``: documents ⋈ labels, text-shape features, label = quality.
``lineitem_return``: lineitem, label = returned, numeric features (no signal,
used for scale and determinism).  Both carry ``row_id`` and ``origin`` so the
two-source operators (train on one origin, evaluate on the other) apply.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.ml.feature import StringIndexer

from metablend.sources.tables import read_table

DOC_CONTINUOUS = ["n_chars", "n_words", "uniq_ratio", "nonalpha_ratio"]
DOC_CATEGORICAL = ["lang_code", "toxic"]
DOC_FEATURES = DOC_CONTINUOUS + DOC_CATEGORICAL

LINE_CONTINUOUS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def doc_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, label, origin, n_chars, n_words, uniq_ratio, nonalpha_ratio, lang_code, toxic."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    words = F.split(F.col("text"), " ")
    joined = docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("row_id"),
        F.col("quality").cast("int").alias("label"),
        F.when(F.expr("substring(source, 4)").cast("int") % 2 == 0, F.lit("a"))
         .otherwise(F.lit("b")).alias("origin"),
        F.col("n_chars").cast("double").alias("n_chars"),
        F.size(words).cast("double").alias("n_words"),
        (F.size(F.array_distinct(words)) / F.size(words)).alias("uniq_ratio"),
        (F.length(F.regexp_replace("text", "[A-Za-z ]", ""))
         / F.greatest(F.length("text"), F.lit(1))).alias("nonalpha_ratio"),
        F.col("lang"),
        F.col("toxic").cast("int").alias("toxic"),
    )
    # categorical code = ordinal by name; the fitted vocabulary is the set of
    # distinct languages (bounded by the language count, not by rows)
    indexer = StringIndexer(inputCol="lang", outputCol="lang_idx",
                            stringOrderType="alphabetAsc", handleInvalid="keep").fit(joined)
    return (indexer.transform(joined)
            .withColumn("lang_code", F.col("lang_idx").cast("int"))
            .drop("lang_idx", "lang"))


def lineitem_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id (hash of the line's integer key columns), label = returned, origin = line status."""
    li = read_table(spark, sf_dir, "lineitem")
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in
                             ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")])
    return li.select(
        F.md5(key).alias("row_id"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.col("l_linestatus").alias("origin"),
        *[F.col(c).cast("double").alias(c) for c in LINE_CONTINUOUS],
    )


def orders_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id = o_orderkey (unique), label = fulfilled, for split/fold checks at size."""
    o = read_table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("row_id"),
                    (F.col("o_orderstatus") == "F").cast("int").alias("label"))
