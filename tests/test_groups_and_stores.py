"""Exact quantiles, content-keyed folds, metric tables and schema match."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from metablend.functions.fidelity import exact_quantiles, schema_match
from metablend.operators import groups as G
from metablend.sources.metric_store import read_metrics, write_metrics


@pytest.mark.parametrize("buckets", [3, 1024])
def test_exact_quantiles_equal_numpy(spark, buckets):
    rng = random.Random(3)
    data = {"hot": [1.5] * 2000 + [rng.gauss(0, 3) for _ in range(1500)], "wide": [rng.uniform(-1e6, 1e6) for _ in range(3000)],
            "one": [4.0], "two": [1.0, 2.0], None: [float(rng.randrange(5)) for _ in range(777)]}
    rows = [(g, v) for g, vs in data.items() for v in vs] + [("hot", None), ("wide", float("nan")), ("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {r.g: (r.n, r.q) for r in exact_quantiles(df, ["g"], "v", probs, buckets).collect()}
    assert set(got) == set(data)
    for g, vs in data.items():
        assert got[g][0] == len(vs) and got[g][1] == pytest.approx(list(np.quantile(vs, probs)))


def brute_folds(rows, k, seed=42):
    """content -> fold: contents in hash order, capped prefix weights."""
    import hashlib
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    n = collections.Counter((md5("|".join("\\N" if x is None else str(x) for x in r[:-1])), r[-1]) for r in rows)
    label, weight = {}, collections.Counter()
    for (c, y), m in n.items():
        weight[c] += m
        key = (-m, y is not None, y or 0)
        if c not in label or key < label[c][0]:
            label[c] = (key, -1 if y is None else y)
    out = {}
    for f in {v[1] for v in label.values()}:
        own = sorted((int(md5(f"{c}|{seed}")[:13], 16), c) for c in label if label[c][1] == f)
        order = sorted((weight[c] for _, c in own), reverse=True)
        if len(order) <= k:
            out.update({c: i for i, (_, c) in enumerate(own)})
            continue
        h = next(h for h in range(k) if order[h] * (k - h) <= sum(order[h:]))
        light, big, small = sum(order[h:]), 0, 0
        for _, c in own:
            out[c] = big + small * (k - h) // light
            if weight[c] * (k - h) > light:
                big += 1
            else:
                small += weight[c]
    return out


def test_no_copy_crosses_a_fold(spark, monkeypatch):
    monkeypatch.setattr(G, "COPIES_PER_TASK_ROW", 64)
    rng = random.Random(8)
    rows = [(1, "hot", 1)] * 900 + [(1, "hot", 0)] * 50 + [(rng.randrange(40), rng.choice(["a", "b", None]), rng.randrange(2)) for _ in range(1500)]
    rows += [(None, None, None), (None, None, 1), (7, "x", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "a int, b string, label int")
    got = G.grouped_folds(df, ["a", "b"], 5).collect()
    assert collections.Counter((r.a, r.b, r.label) for r in got) == collections.Counter(rows)
    assert len({r.row_id for r in got}) == len(rows)
    folds = collections.defaultdict(set)
    for r in got:
        folds[r.content].add(r.fold)
    want = brute_folds(rows, 5)
    assert {c: f for c, (f,) in folds.items()} == want
    size = collections.Counter(r.fold for r in got if r.b != "hot")
    assert set(size) == set(range(5)) and max(size.values()) < 0.35 * sum(size.values())
    again = G.grouped_folds(df.repartition(7), ["a", "b"], 5).select("row_id", "fold").collect()
    assert {tuple(r) for r in again} == {(r.row_id, r.fold) for r in got}


def test_a_repeated_run_replaces_only_itself(spark, tmp_path):
    path = str(tmp_path / "metrics")
    table = lambda *rows: spark.createDataFrame(list(rows), "model string, metric string, value double")
    write_metrics(table(("gbm", "auc", 0.7), ("gbm", "f1", 0.6), ("ada", "auc", 0.5)), path, "s1", "r1")
    write_metrics(table(("gbm", "auc", 0.8)), path, "s1", "r2")
    write_metrics(table(("x", "auc", 0.1)).drop("model"), path, "s2", "r1")
    write_metrics(table(("gbm", "auc", 0.75)), path, "s1", "r1")
    got = sorted((tuple(r) for r in read_metrics(spark, path).collect()), key=str)
    assert got == [("s1", "r1", "gbm", "auc", 0.75), ("s1", "r2", "gbm", "auc", 0.8), ("s2", "r1", None, "auc", 0.1)]
    assert read_metrics(spark, path, "s1", "r2").count() == 1
    assert "PartitionFilters: [isnotnull(study" in read_metrics(spark, path, "s1")._jdf.queryExecution().toString()


def test_schema_match(spark):
    a = spark.createDataFrame([(1, "x", None), (2, None, None)], "id int, t string, v double")
    b = spark.createDataFrame([(1, 2.0)], "id bigint, v double")
    assert [tuple(r) for r in schema_match(a, b).orderBy("col_name").collect()] == [
        ("id", "int", "bigint", False, 2, 1), ("t", "string", None, False, 1, None), ("v", "double", "double", True, 0, 1)]
