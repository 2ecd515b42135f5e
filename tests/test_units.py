"""Hand-computed fixtures and brute-force checks on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from metablend.functions import fidelity as G
from metablend.functions import metrics as M
from metablend.operators.keys import exact_split_folds, key_hash, two_level_rank
from metablend.operators.scale import apply_scaler, fit_scaler


def test_scaler_population_sd(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "x double")
    params = fit_scaler(df, ["x"])
    assert params["x"][0] == pytest.approx(2.5)
    assert params["x"][1] == pytest.approx(1.118034, abs=1e-6)   # not the sample sd 1.290994
    vals = sorted(r.x for r in apply_scaler(df, params).collect())
    assert vals[0] == pytest.approx((1 - 2.5) / 1.1180339887)


def test_scaler_params_come_from_train_only(spark):
    df = spark.createDataFrame([(1.0, "train"), (3.0, "train"), (100.0, "test")], "x double, split string")
    p1 = fit_scaler(df, ["x"], where=F.col("split") == "train")
    df2 = spark.createDataFrame([(1.0, "train"), (3.0, "train"), (-7.0, "test")], "x double, split string")
    assert fit_scaler(df2, ["x"], where=F.col("split") == "train") == p1


@pytest.mark.parametrize("labels,scores,expected", [
    ([0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8], 0.75),
    ([0, 1, 0, 1], [0.5, 0.5, 0.5, 0.5], 0.5),
    ([1, 1, 1], [0.2, 0.4, 0.6], None),
])
def test_auc_fixtures(spark, labels, scores, expected):
    df = spark.createDataFrame(list(zip(labels, scores)), "label int, score double")
    got = M.auc(df).first()["auc"]
    if expected is None:
        assert got is None
    else:
        assert got == pytest.approx(expected)


def test_auc_matches_pairwise_bruteforce(spark):
    rng = random.Random(7)
    rows = [(rng.randint(0, 1), round(rng.random(), 2)) for _ in range(300)]
    pos = [s for l, s in rows if l == 1]
    neg = [s for l, s in rows if l == 0]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "label int, score double")
    assert M.auc(df, n_buckets=7).first()["auc"] == pytest.approx(brute, abs=1e-12)
    assert M.auc(df, n_buckets=3, few_groups=False).first()["auc"] == pytest.approx(brute, abs=1e-12)


def test_report_with_empty_predicted_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "label int, pred int")
    rep = {r["class"]: r for r in M.report(df).collect()}
    assert rep["1"]["precision"] == 0.0 and rep["1"]["recall"] == 0.0 and rep["1"]["f1"] == 0.0
    assert rep["1"]["support"] == 1
    assert rep["accuracy"]["f1"] == pytest.approx(2 / 3)
    assert rep["0"]["recall"] == 1.0


def test_confusion_is_dense(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, pred int")
    cells = {(r.label, r.pred): r.n for r in M.confusion(df).collect()}
    assert cells == {(0, 0): 2, (0, 1): 0, (1, 0): 0, (1, 1): 0}


def test_stratified_folds_balanced(spark):
    df = spark.createDataFrame([(i, 1 if i < 6 else 0) for i in range(10)], "row_id long, label int")
    out = exact_split_folds(df, seed=42, test_frac=None, k=5).collect()
    for lab in (0, 1):
        sizes = [sum(1 for r in out if r.label == lab and r.fold == f) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_two_level_rank_equals_plain_window(spark):
    from pyspark.sql import Window
    rng = random.Random(3)
    df = spark.createDataFrame([(i, rng.randint(0, 2)) for i in range(2000)], "row_id long, label int")
    df = df.withColumn("h", key_hash("row_id", 11))
    two = two_level_rank(df, "h", "row_id", ["label"], bits=4).select("row_id", "_rank")
    plain = df.select("row_id", (F.row_number().over(Window.partitionBy("label").orderBy("h", "row_id")) - 1)
                      .alias("_rank"))
    assert sorted(two.collect()) == sorted(plain.collect())


def test_split_is_partition_independent(spark):
    df = spark.createDataFrame([(i, i % 3 == 0) for i in range(500)], "row_id long, label boolean") \
        .withColumn("label", F.col("label").cast("int"))
    a = sorted(exact_split_folds(df.repartition(1), k=3).collect())
    b = sorted(exact_split_folds(df.repartition(7), k=3).collect())
    assert a == b


def test_ks_matches_numpy(spark):
    rng = np.random.default_rng(1)
    xa, xb = rng.integers(0, 20, 200), rng.integers(3, 25, 150)
    rows = [("a", float(x)) for x in xa] + [("b", float(x)) for x in xb]
    df = spark.createDataFrame(rows, "origin string, v double")
    got = G.ks_two_sample(df, ["v"], "a", "b", n_buckets=5).first()["ks"]
    grid = np.union1d(xa, xb)
    fa = np.searchsorted(np.sort(xa), grid, side="right") / len(xa)
    fb = np.searchsorted(np.sort(xb), grid, side="right") / len(xb)
    assert got == pytest.approx(np.max(np.abs(fa - fb)))


def test_source_overlap_and_duplicates(spark):
    rows = [("a", 1), ("a", 1), ("a", 2), ("b", 2), ("b", 3), ("b", 3), ("b", 3)]
    df = spark.createDataFrame(rows, "origin string, x int")
    ov = G.source_overlap(df, ["x"], "a", "b").first()
    assert (ov.distinct_a, ov.distinct_b, ov.shared) == (2, 2, 1)
    dup = {r.origin: r for r in G.duplicate_rows(df, ["x"], by=["origin"]).collect()}
    assert dup["a"].max_copies == 2 and dup["b"].extra_copies == 2


def test_csv_crlf_and_lf_with_names_normalised(spark, tmp_path):
    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType
    from metablend.sources.tables import read_csv_typed
    body = ["age,chest pain type,oldpeak,target", "50,2,1.5,1", "61,4,0.0,0"]
    (tmp_path / "crlf.csv").write_bytes("\r\n".join(body).encode())
    (tmp_path / "lf.csv").write_bytes("\n".join(body).encode())
    schema = StructType([StructField("age", IntegerType()), StructField("chest pain type", IntegerType()),
                         StructField("oldpeak", DoubleType()), StructField("target", IntegerType())])
    for name in ("crlf.csv", "lf.csv"):
        df = read_csv_typed(spark, str(tmp_path / name), schema)
        assert df.columns == ["age", "chest_pain_type", "oldpeak", "target"]
        assert sorted(tuple(r) for r in df.collect()) == [(50, 2, 1.5, 1), (61, 4, 0.0, 0)]
    inferred = read_csv_typed(spark, str(tmp_path / "lf.csv"))
    assert inferred.columns[1] == "chest_pain_type"


def test_newton_leaf_fixture():
    from metablend.operators.learners import newton_leaf
    p = 0.5
    labels = [1, 1, 1, 0]
    G_ = sum(p - y for y in labels)
    H_ = sum(p * (1 - p) for _ in labels)
    assert (G_, H_) == (-1.0, 1.0)
    assert newton_leaf(G_, H_, 1.0) == pytest.approx(0.5)


def test_samme_round_fixture(spark):
    from metablend.operators.learners import AdaSlot, fit_ada
    rows = [(i, y, "train", 0, [i]) for i, y in enumerate([0, 0, 1, 0])]
    prep = spark.createDataFrame(rows, "row_id long, label int, split string, fold int, bins array<int>")
    fit = fit_ada(prep, [AdaSlot(-1, 1, 1.0)])
    assert fit.extra["alpha_sum"][0] == pytest.approx(math.log(3))
    w = sorted(r.w[0] for r in fit.scores.select("w").collect())
    assert w == pytest.approx([1 / 6, 1 / 6, 1 / 6, 1 / 2])


def test_auc_leaves_out_rows_without_a_score(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, None)], "label int, score double")
    assert M.auc(df).first()["auc"] == pytest.approx(1.0)


def test_skewed_scores_spread_over_buckets(spark):
    """One outlier does not put all other values into one bucket."""
    from metablend.operators.prefix import N_BUCKETS, count_below
    df = spark.range(20000).select((F.col("id") / 1e9).alias("x")).union(spark.sql("select double(1e12)"))
    cuts = df.agg(F.percentile_approx("x", [i / 64 for i in range(1, 64)], 1000).alias("c"))
    sizes = df.crossJoin(F.broadcast(cuts)).groupBy(count_below(F.col("c"), F.col("x"), 64).alias("b")).count().collect()
    assert len(sizes) >= 60 and max(r["count"] for r in sizes) < 2000 and N_BUCKETS >= 64


def test_psi_ignores_nulls(spark):
    rows = [("a", float(i)) for i in range(10)] + [("b", float(i)) for i in range(10)] + [("b", None)] * 20
    df = spark.createDataFrame(rows, "origin string, v double")
    r = G.psi_js(df, ["v"], "a", "b").first()
    assert r["psi"] == pytest.approx(0.0) and r["js"] == pytest.approx(0.0)


def test_rows_with_a_null_label_are_kept(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "row_id long, label int")
    assert exact_split_folds(df, k=2, test_frac=None).count() == 3
