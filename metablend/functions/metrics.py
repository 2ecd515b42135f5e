"""Classification metrics as tables over ``(label, pred, score)`` rows.

Everything is aggregation: confusion counts come from a ``groupBy`` with at
most four rows per group; exact ROC AUC (ties counted half) and the
ROC / precision-recall curves come from one row per distinct score plus a
two-level 'sum below' (see ``operators.prefix``).  ``by`` columns give the
same metric per fold, per model or per config in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metablend.operators.prefix import N_BUCKETS, attach, below_sums


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null when b = 0 (valid with or without ANSI mode)."""
    return a / F.nullif(b, F.lit(0))


def threshold(score: str | Column, cut: float = 0.5) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return (s >= F.lit(cut)).cast("int")


def accuracy(scored: DataFrame, label: str = "label", pred: str = "pred",
             by: list[str] | None = None) -> DataFrame:
    by = by or []
    return scored.groupBy(*by).agg(
        F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def _score_counts(scored: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    """One row per distinct score; rows without a score are not ranked."""
    return scored.where(F.col(score).isNotNull()).groupBy(*by, score).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"),
        F.sum((F.col(label) != 1).cast("long")).alias("neg"))


def auc(scored: DataFrame, label: str = "label", score: str = "score",
        by: list[str] | None = None, n_buckets: int = N_BUCKETS, few_groups: bool = True) -> DataFrame:
    """Exact Mann-Whitney AUC; null when a group has only one class.  ``few_groups``: the groups
    are models, folds or configs, so a row per group is broadcast; say False for data-sized groups."""
    by = by or []
    g = _score_counts(scored, label, score, by)
    g = below_sums(g, by, score, ["neg"], n_buckets=n_buckets, few_groups=few_groups)
    return g.groupBy(*by).agg(
        safe_div(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)),
                 F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc"))


def curve_points(scored: DataFrame, label: str = "label", score: str = "score",
                 by: list[str] | None = None, n_buckets: int = N_BUCKETS, few_groups: bool = True) -> DataFrame:
    """One row per distinct score t: counts with score >= t (ROC and PR curves)."""
    by = by or []
    g = _score_counts(scored, label, score, by)
    tot = g.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    g = below_sums(g, by, score, ["pos", "neg"], n_buckets=n_buckets, few_groups=few_groups)
    g = attach(g, tot, by, few_groups)
    tp = F.col("P") - F.col("pos_below")
    fp = F.col("N") - F.col("neg_below")
    return g.select(
        *by, F.col(score).alias("threshold"), "pos", "neg",
        tp.alias("tp"), fp.alias("fp"), "P", "N",
        safe_div(fp.cast("double"), F.col("N").cast("double")).alias("fpr"),
        safe_div(tp.cast("double"), F.col("P").cast("double")).alias("tpr"),
        safe_div(tp.cast("double"), (tp + fp).cast("double")).alias("precision"),
    )


def roc_points(scored: DataFrame, **kw) -> DataFrame:
    by = kw.get("by") or []
    return curve_points(scored, **kw).select(*by, "threshold", "fpr", "tpr")


def pr_points(scored: DataFrame, **kw) -> DataFrame:
    by = kw.get("by") or []
    return curve_points(scored, **kw).select(
        *by, "threshold", "precision", safe_div(F.col("tp").cast("double"),
                                                F.col("P").cast("double")).alias("recall"))


def average_precision(scored: DataFrame, **kw) -> DataFrame:
    """AP = sum over thresholds of (recall step) x precision."""
    by = kw.get("by") or []
    pts = curve_points(scored, **kw)
    return pts.groupBy(*by).agg(
        safe_div(F.sum(F.col("pos") * F.col("precision")),
                 F.first("P").cast("double")).alias("average_precision"))


def confusion(scored: DataFrame, label: str = "label", pred: str = "pred",
              by: list[str] | None = None) -> DataFrame:
    """Dense 2x2 confusion table: label, pred, n (zero cells included)."""
    by = by or []
    cells = F.array(*[F.struct(F.lit(a).alias("l"), F.lit(b).alias("p"))
                      for a in (0, 1) for b in (0, 1)])
    counts = scored.groupBy(*by).agg(*[
        F.sum(((F.col(label) == a) & (F.col(pred) == b)).cast("long")).alias(f"c{a}{b}")
        for a in (0, 1) for b in (0, 1)])
    exploded = counts.select(*by, F.explode(cells).alias("cell"), *[f"c{a}{b}" for a in (0, 1) for b in (0, 1)])
    n = F.lit(0).cast("long")
    for a in (0, 1):
        for b in (0, 1):
            n = F.when((F.col("cell.l") == a) & (F.col("cell.p") == b), F.col(f"c{a}{b}")).otherwise(n)
    return exploded.select(*by, F.col("cell.l").alias("label"), F.col("cell.p").alias("pred"),
                           n.alias("n"))


def _class_stats(scored: DataFrame, label: str, pred: str, by: list[str]) -> DataFrame:
    counts = scored.groupBy(*by).agg(*[
        F.sum(((F.col(label) == a) & (F.col(pred) == b)).cast("long")).alias(f"c{a}{b}")
        for a in (0, 1) for b in (0, 1)])
    rows = []
    for c in (0, 1):
        o = 1 - c
        tp, fp, fn = F.col(f"c{c}{c}"), F.col(f"c{o}{c}"), F.col(f"c{c}{o}")
        rows.append(F.struct(
            F.lit(str(c)).alias("class"),
            F.coalesce(safe_div(tp.cast("double"), (tp + fp).cast("double")), F.lit(0.0)).alias("precision"),
            F.coalesce(safe_div(tp.cast("double"), (tp + fn).cast("double")), F.lit(0.0)).alias("recall"),
            F.coalesce(safe_div(2.0 * tp, (2 * tp + fp + fn).cast("double")), F.lit(0.0)).alias("f1"),
            (tp + fn).alias("support"),
        ))
    return counts.select(*by, F.inline(F.array(*rows)),
                         ((F.col("c00") + F.col("c11")) / (F.col("c00") + F.col("c01")
                                                            + F.col("c10") + F.col("c11"))).alias("_acc"))


def report(scored: DataFrame, label: str = "label", pred: str = "pred",
           by: list[str] | None = None) -> DataFrame:
    """Per-class precision/recall/F1/support plus accuracy, macro and weighted rows."""
    by = by or []
    per = _class_stats(scored, label, pred, by)
    classes = per.drop("_acc")
    summ = per.groupBy(*by).agg(
        F.first("_acc").alias("_acc"),
        F.sum("support").alias("n"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        safe_div(F.sum(F.col("precision") * F.col("support")), F.sum("support").cast("double")).alias("wp"),
        safe_div(F.sum(F.col("recall") * F.col("support")), F.sum("support").cast("double")).alias("wr"),
        safe_div(F.sum(F.col("f1") * F.col("support")), F.sum("support").cast("double")).alias("wf"),
    )
    null = F.lit(None).cast("double")
    summary = summ.select(*by, F.inline(F.array(
        F.struct(F.lit("accuracy").alias("class"), null.alias("precision"), null.alias("recall"),
                 F.col("_acc").alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"),
                 F.col("mr").alias("recall"), F.col("mf").alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"),
                 F.col("wr").alias("recall"), F.col("wf").alias("f1"), F.col("n").alias("support")),
    )))
    return classes.unionByName(summary)


def prf(scored: DataFrame, label: str = "label", pred: str = "pred",
        by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 of class 1 (0 when undefined) and accuracy."""
    by = by or []
    tp = F.sum(((F.col(label) == 1) & (F.col(pred) == 1)).cast("long"))
    fp = F.sum(((F.col(label) != 1) & (F.col(pred) == 1)).cast("long"))
    fn = F.sum(((F.col(label) == 1) & (F.col(pred) != 1)).cast("long"))
    return scored.groupBy(*by).agg(
        F.coalesce(safe_div(tp.cast("double"), (tp + fp).cast("double")), F.lit(0.0)).alias("precision"),
        F.coalesce(safe_div(tp.cast("double"), (tp + fn).cast("double")), F.lit(0.0)).alias("recall"),
        F.coalesce(safe_div(2.0 * tp, (2 * tp + fp + fn).cast("double")), F.lit(0.0)).alias("f1"),
        F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"),
    )


def metric_table(scored: DataFrame, label: str = "label", score: str = "score",
                 pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """Long table ``(*by, metric, value)``: auc, accuracy, precision, recall, f1."""
    by = by or []
    a = auc(scored, label, score, by)
    p = prf(scored, label, pred, by)
    wide = attach(p, a, by, few=True)
    return wide.select(*by, F.expr(
        "stack(5, 'auc', auc, 'accuracy', accuracy, 'precision', precision, "
        "'recall', recall, 'f1', f1) as (metric, value)"))
