"""The lineitem rows of a fit are hashed and shuffled once, and get their scores by one join with few rows."""

import random

import pytest
from pyspark.sql import functions as F

from metablend.operators import learners as L
from metablend.operators.keys import exact_split_folds
from metablend.plans import ensembles as E


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(f"k{i}", rng.choice([0, 1, None]), rng.randrange(5)) for i in range(900)]
    return spark.createDataFrame(data, "row_id string, label int, x int").repartition(5).persist()


@pytest.mark.parametrize("frac", [None, 0.2])
@pytest.mark.parametrize("stratify", [True, False])
def test_ranks_over_kept_rows_are_the_same(spark, rows, frac, stratify):
    kept = []
    keep = lambda df: kept.append(df) or df.checkpoint(eager=True)
    plain = exact_split_folds(rows, test_frac=frac, k=3, stratify=stratify, bits=4)
    once = exact_split_folds(rows, test_frac=frac, k=3, stratify=stratify, bits=4, keep=keep, partitions=3)
    assert once.columns == plain.columns and kept[0].rdd.getNumPartitions() == 3
    assert sorted(map(str, once.collect())) == sorted(map(str, plain.collect()))
    assert plan(kept[0]).count("Exchange hashpartitioning") == 1  # dealt and ranked by one shuffle
    assert "Scan" not in plan(once).replace("Scan ExistingRDD", "")  # the source is not read again


def test_prepared_lines_are_shuffled_once(spark, tmp_path, monkeypatch):
    spark.range(3000).select(
        F.col("id").alias("l_orderkey"), (F.col("id") % 7).alias("l_partkey"), (F.col("id") % 5).alias("l_suppkey"), F.lit(1).alias("l_linenumber"),
        (F.col("id") % 50).cast("double").alias("l_quantity"), (F.col("id") % 11).cast("double").alias("l_extendedprice"),
        F.lit(0.1).alias("l_discount"), F.lit(None).cast("double").alias("l_tax"),
        F.when(F.col("id") % 3 == 0, "R").otherwise("N").alias("l_returnflag"), F.lit("O").alias("l_linestatus")).write.parquet(f"{tmp_path}/lineitem.parquet")
    kept = []
    own = type(spark.range(1))
    checkpoint = own.checkpoint
    monkeypatch.setattr(own, "checkpoint", lambda df, eager=True: kept.append(plan(df)) or checkpoint(df, eager))
    prep = E.prepare_lineitem_trees(spark, str(tmp_path), k=3)
    assert kept[0].count("Exchange") == 1 and sum("FileScan" in p for p in kept) == 1
    assert {(r.label, r.split): r["count"] for r in prep.groupBy("label", "split").count().collect()} == {
        (0, "test"): 400, (0, "train"): 1600, (1, "test"): 200, (1, "train"): 800}
    assert all(r.bins[2] == 0 and r.bins[3] is None for r in prep.collect())


@pytest.fixture(scope="module")
def prep(spark):
    rng = random.Random(5)
    data = []
    for i in range(3000):
        a, b = rng.randrange(6), rng.choice([0, 1, 2, None])
        data.append((i, int(rng.random() < (0.8 if a > 2 else 0.3)) if i % 9 else None, "train" if i % 5 else "test", i % 3 if i % 5 else None, [a, b]))
    return spark.createDataFrame(data, "row_id bigint, label int, split string, fold int, bins array<int>").repartition(4).persist()


@pytest.mark.parametrize("spec", [E.LearnerSpec("gbm", 3, 0.3, 2), E.LearnerSpec("rf", 2, max_depth=2)], ids=["gbm", "rf"])
def test_rows_get_their_scores_from_one_row_per_bins(spark, prep, spec, monkeypatch):
    monkeypatch.setattr(L, "LEAST_ROWS_GROUPED", 1)
    joined = []
    expand = E.expand_scores
    monkeypatch.setattr(E, "expand_scores", lambda own, scores, *a: joined.append(scores) or expand(own, scores, *a))
    out = E.compressed_scores(prep, spec, 3, digits=6).collect()
    assert len(out) == 3000 and all((r.p_oof is None) == (r.split == "test") for r in out)
    assert all(round(p, 6) == p for r in out for p in (r.p_avg, r.p_full))
    if spec.kind == "gbm":  # no draws: equal to single rows
        assert joined[0].count() == 24
        whole = {r.row_id: r for r in E.learner_scores(prep, spec, 3).collect()}
        for r in out:
            assert r[:4] == whole[r.row_id][:4]
            assert r[4:] == tuple(None if p is None else pytest.approx(p, abs=1e-6) for p in whole[r.row_id][4:])
