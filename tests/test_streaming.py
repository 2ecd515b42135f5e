"""The tree scorer is narrow: the same function scores a stream."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL


def test_stream_scores_equal_batch_scores(spark, tmp_path):
    from metablend.operators.binning import fit_bins
    from metablend.plans.ensembles import LearnerSpec, fit_learner
    from metablend.sources.carriers import DOC_CATEGORICAL, DOC_CONTINUOUS, doc_quality
    from metablend.streaming import score_stream
    from metablend.operators.binning import apply_bins
    dq = doc_quality(spark, SF_SMALL)
    specs = fit_bins(dq, DOC_CONTINUOUS, DOC_CATEGORICAL, 16, "quantile")
    prep = apply_bins(dq, specs).withColumn("split", F.lit("train")).withColumn("fold", F.lit(0))
    fit = fit_learner(prep.select("row_id", "label", "split", "fold", "bins"),
                      LearnerSpec("gbm", n_trees=2, lr=0.1, max_depth=2), [-1])
    trees = fit.trees_df(spark, "gbm")
    src = tmp_path / "in"
    dq.drop("origin").write.parquet(str(src))
    stream = spark.readStream.schema(dq.drop("origin").schema).parquet(str(src))
    scored = score_stream(stream, specs, trees, 0, "sum", fit.extra["init"][0]).select("row_id", "score")
    q = (scored.writeStream.format("memory").queryName("scored_stream").outputMode("append")
         .trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start())
    q.awaitTermination(120)
    got = {r.row_id: r.score for r in spark.table("scored_stream").collect()}
    want = {r.row_id: r.p for r in fit.scores.select("row_id", F.element_at("P", 1).alias("p")).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
