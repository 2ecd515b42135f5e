"""Physical-plan checks: pruning reaches the scan, no global window over rows,
no Python evaluation anywhere in the registered queries' plans."""

import re

import pytest

from conftest import SF_SMALL

ROW_LEVEL = ["split_stratified", "kfold_stratified", "metric_auc", "ks_lineitem", "roc_points",
             "scale_train_apply_test"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ROW_LEVEL)
def test_no_unpartitioned_window_over_rows(spark, name):
    import __spark_entry__ as E
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    # a window without PARTITION BY prints its first spec item as an ordering
    # (`x#1 ASC`) or straight as the frame; such a window runs in one task.
    # The only allowed ones order the bucket-total tables (`_bk`, `_bucket`),
    # whose size is fixed by the bucket count, never by the rows.
    glob = re.compile(r"windowspecdefinition\((\w+#\d+L? (ASC|DESC)|specifiedwindowframe)")
    for line in plan.splitlines():
        if re.search(r"\bWindow \[", line):
            m = glob.search(line)
            assert m is None or m.group(1).startswith(("_bk#", "_bucket#")), line


def test_global_window_detector_works(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    plan = _plan(spark.range(10).select(F.row_number().over(Window.orderBy("id")).alias("r")))
    glob = re.compile(r"windowspecdefinition\((\w+#\d+L? (ASC|DESC)|specifiedwindowframe)")
    assert any(glob.search(ln) for ln in plan.splitlines() if "Window [" in ln)


@pytest.mark.parametrize("name", ["metric_auc", "feature_projection", "describe_lineitem"])
def test_scan_reads_only_needed_columns(spark, name):
    import __spark_entry__ as E
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    scans = [ln for ln in plan.splitlines() if "FileScan parquet" in ln]
    assert scans
    for ln in scans:
        assert "l_shipdate" not in ln and "l_comment" not in ln


def test_training_path_has_no_python_evaluation(spark):
    from pyspark.sql import functions as F
    from metablend.operators.learners import BoostSlot, fit_boost
    from metablend.plans.ensembles import prepare_trees
    prep = prepare_trees(spark, SF_SMALL, k=3)
    fit = fit_boost(prep, "newton", [BoostSlot(-1, 1, 0.3, 2)])
    plan = _plan(fit.scores.select("row_id", F.element_at("P", 1)))
    for marker in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas"):
        assert marker not in plan


@pytest.mark.parametrize("name", ["ks_lineitem", "category_tvd", "ks_two_sample"])
def test_no_window_keyed_by_the_group_alone(spark, name):
    """A window over a feature's values would bring all of them to one task; only bucket totals may."""
    import __spark_entry__ as E
    for line in _plan(E.queries()[name](spark, SF_SMALL)).splitlines():
        m = re.search(r"\bWindow \[.*\], \[([^\]]*)\], \[([^\]]*)\]", line)
        if m and re.fullmatch(r"feature#\d+", m.group(1)):
            assert m.group(2).startswith("_bk#"), line
