"""Two-source fidelity tables: how alike are two tables of one schema?

The study compares machine-generated records against a real cohort by
distribution, relationship and structure.  Each statistic is an aggregation
over the union of both sources tagged with ``origin``; wide inputs are
unpivoted to ``(origin, feature, value)`` so one job covers every column.
Aggregations pre-combine map-side, so a hot value or a source holding most
rows never lands whole in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metablend.functions.metrics import safe_div
from metablend.operators.binning import width_bin
from metablend.operators.prefix import N_BUCKETS, attach, below_sums, count_below


def _long(df: DataFrame, cols: list[str], origin: str) -> DataFrame:
    wide = df.select(F.col(origin).alias("origin"), *[F.col(c).cast("double").alias(c) for c in cols])
    return wide.unpivot(["origin"], cols, "feature", "value")


def describe_by_source(df: DataFrame, cols: list[str], origin: str = "origin") -> DataFrame:
    """origin, feature, n, nulls, mean, sd (population), min, max, zeros."""
    lg = _long(df, cols, origin)
    return lg.groupBy("origin", "feature").agg(
        F.count("value").alias("n"),
        F.sum(F.col("value").isNull().cast("long")).alias("nulls"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("sd"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.sum((F.col("value") == 0).cast("long")).alias("zeros"),
    )


def quartiles_by_source(df: DataFrame, cols: list[str], origin: str = "origin") -> DataFrame:
    """Exact quartiles (linear interpolation) per source and column."""
    q = exact_quantiles(_long(df, cols, origin), ["origin", "feature"], "value", [0.25, 0.5, 0.75])
    return q.select("origin", "feature", *[F.col("q")[i].alias(n) for i, n in enumerate(("q25", "q50", "q75"))])


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: list[float], n_buckets: int = N_BUCKETS) -> DataFrame:
    """``*by, n, q``: exact quantiles of the known values of every group, linearly interpolated
    between the values ranked floor(p (n - 1)) and ceil(p (n - 1)).

    Rank selection in passes, none of which brings a group together: (1) approximate quantiles
    (a mergeable sketch) cut each group into ``n_buckets`` buckets; (2) bucket counts say which
    buckets hold the wanted ranks; (3) only the rows of those buckets are counted per distinct
    value and ranked within the bucket.  The sketch decides how even the buckets are, not the
    result; a value held by a third of all rows is one row after the count.  Groups are few
    (sources x columns), so tables of a row per group and bucket are broadcast.
    """
    x = F.col(value).cast("double")
    rows = df.select(*by, F.when(~F.isnan(x), x).alias("_x")).where(F.col("_x").isNotNull())
    cuts = [i / n_buckets for i in range(1, n_buckets)]
    bounds = rows.groupBy(*by).agg(F.percentile_approx("_x", cuts, 10 * n_buckets).alias("_cuts"))
    dealt = attach(rows, bounds, by, few=True).withColumn("_bk", count_below(F.col("_cuts"), F.col("_x"), n_buckets)).drop("_cuts")
    counts = dealt.groupBy(*by, "_bk").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*by).orderBy("_bk").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.select(*by, "_bk", (F.sum("_c").over(upto) - F.col("_c")).alias("_before"), "_c",
                           F.sum("_c").over(Window.partitionBy(*by)).alias("_n"))
    wanted = placed.withColumn("_p", F.explode(F.array(*[F.lit(float(p)) for p in probs]))).withColumn(
        "_h", F.col("_p") * (F.col("_n") - 1)).withColumn("_side", F.explode(F.array(F.floor("_h"), F.ceil("_h")))).where(
        (F.col("_side") >= F.col("_before")) & (F.col("_side") < F.col("_before") + F.col("_c"))).distinct()
    few = wanted.select(*by, "_bk").distinct()
    values = attach(dealt, few, [*by, "_bk"], few=True).groupBy(*by, "_bk", "_x").agg(F.count(F.lit(1)).alias("_w"))
    in_bucket = Window.partitionBy(*by, "_bk").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.withColumn("_to", F.sum("_w").over(in_bucket))
    found = attach(ranked, wanted, [*by, "_bk"], few=True).where(
        (F.col("_side") < F.col("_before") + F.col("_to")) & (F.col("_side") >= F.col("_before") + F.col("_to") - F.col("_w")))
    at = found.groupBy(*by, "_n", "_p", "_h").agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    one = at.withColumn("_q", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_h") - F.floor("_h")))
    return one.groupBy(*by, F.col("_n").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("_p", "_q"))).alias("_m")).select(
        *by, "n", F.array(*[F.element_at("_m", F.lit(float(p))) for p in probs]).alias("q"))


def schema_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row per column of either source: its types, whether both have it with one type, and known values."""
    types = {side: dict(df.dtypes) for side, df in (("a", a), ("b", b))}
    spark = a.sparkSession
    names = sorted(set(types["a"]) | set(types["b"]))
    head = spark.createDataFrame([(n, types["a"].get(n), types["b"].get(n), types["a"].get(n) == types["b"].get(n)) for n in names],
                                 "col_name string, type_a string, type_b string, matches boolean")
    for side, df in (("a", a), ("b", b)):
        counted = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])  # one pass, one row
        pairs = counted.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns]), F.array(*[F.col(c) for c in df.columns]))).alias(
            "col_name", f"known_{side}"))
        head = head.join(F.broadcast(pairs), "col_name", "left")
    return head


def _two_counts(lg: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    return lg.groupBy(*keys).agg(
        F.sum((F.col("origin") == a).cast("long")).alias("ca"),
        F.sum((F.col("origin") == b).cast("long")).alias("cb"))


def category_shares(df: DataFrame, cols: list[str], a: str, b: str,
                    origin: str = "origin") -> DataFrame:
    """feature, value, share_a, share_b (shares of non-null values per source)."""
    lg = _long(df, cols, origin).where(F.col("value").isNotNull())
    cnt = _two_counts(lg, ["feature", "value"], a, b)
    return _with_feature_totals(cnt).select(
        "feature", "value",
        F.coalesce(safe_div(F.col("ca").cast("double"), F.col("ta").cast("double")), F.lit(0.0)).alias("share_a"),
        F.coalesce(safe_div(F.col("cb").cast("double"), F.col("tb").cast("double")), F.lit(0.0)).alias("share_b"))


def _with_feature_totals(cnt: DataFrame) -> DataFrame:
    """Adds ``ta, tb``: totals per feature — a row per named feature, broadcast, so no task gets
    all values of a feature."""
    tot = cnt.groupBy("feature").agg(F.sum("ca").alias("ta"), F.sum("cb").alias("tb"))
    return attach(cnt, tot, ["feature"], few=True)


def category_tvd(df: DataFrame, cols: list[str], a: str, b: str, origin: str = "origin") -> DataFrame:
    """feature, tvd = ½ Σ |share_a − share_b|, n_values."""
    sh = category_shares(df, cols, a, b, origin)
    return sh.groupBy("feature").agg(
        (0.5 * F.sum(F.abs(F.col("share_a") - F.col("share_b")))).alias("tvd"),
        F.count(F.lit(1)).alias("n_values"))


def ks_two_sample(df: DataFrame, cols: list[str], a: str, b: str, origin: str = "origin",
                  n_buckets: int = N_BUCKETS) -> DataFrame:
    """feature, ks = max_x |F_a(x) − F_b(x)|, n_a, n_b (empirical CDFs)."""
    lg = _long(df, cols, origin).where(F.col("value").isNotNull())
    cnt = _two_counts(lg, ["feature", "value"], a, b)
    cum = _with_feature_totals(below_sums(cnt, ["feature"], "value", ["ca", "cb"], n_buckets=n_buckets, few_groups=True))
    fa = safe_div((F.col("ca_below") + F.col("ca")).cast("double"), F.col("ta").cast("double"))
    fb = safe_div((F.col("cb_below") + F.col("cb")).cast("double"), F.col("tb").cast("double"))
    return (cum.select("feature", F.abs(fa - fb).alias("d"), "ca", "cb")
            .groupBy("feature").agg(F.max("d").alias("ks"), F.sum("ca").alias("n_a"),
                                   F.sum("cb").alias("n_b")))


def psi_js(df: DataFrame, cols: list[str], a: str, b: str, origin: str = "origin",
           n_bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """feature, psi, js over width bins of the pooled range; empty shares floored to eps."""
    row = df.agg(*[F.min(c).alias(f"lo_{c}") for c in cols],
                 *[F.max(c).alias(f"hi_{c}") for c in cols]).first()
    binned = df.select(F.col(origin).alias("origin"), *[
        F.when(F.col(c).isNotNull(), width_bin(F.col(c).cast("double"), float(row[f"lo_{c}"] or 0.0),
                                               float(row[f"hi_{c}"] or 0.0), n_bins)).alias(c) for c in cols])
    lg = binned.unpivot(["origin"], cols, "feature", "bin").where(F.col("bin").isNotNull())
    cnt = _two_counts(lg, ["feature", "bin"], a, b)
    w = Window.partitionBy("feature")
    pa = F.col("ca").cast("double") / F.sum("ca").over(w)
    pb = F.col("cb").cast("double") / F.sum("cb").over(w)
    sh = cnt.select("feature", F.greatest(pa, F.lit(eps)).alias("pa"), F.greatest(pb, F.lit(eps)).alias("pb"))
    m = (F.col("pa") + F.col("pb")) / 2.0
    return sh.groupBy("feature").agg(
        F.sum((F.col("pa") - F.col("pb")) * F.log(F.col("pa") / F.col("pb"))).alias("psi"),
        (0.5 * F.sum(F.col("pa") * F.log(F.col("pa") / m))
         + 0.5 * F.sum(F.col("pb") * F.log(F.col("pb") / m))).alias("js"))


def corr_delta(df: DataFrame, cols: list[str], a: str, b: str, origin: str = "origin") -> DataFrame:
    """col_x, col_y, corr_a, corr_b, delta — every Pearson pair in one aggregation."""
    pairs = [(x, y) for i, x in enumerate(cols) for y in cols[i + 1:]]
    per = df.groupBy(F.col(origin).alias("origin")).agg(
        *[F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias(f"r{i}")
          for i, (x, y) in enumerate(pairs)])
    entries = F.array(*[F.struct(F.lit(x).alias("col_x"), F.lit(y).alias("col_y"),
                                 F.col(f"r{i}").alias("r")) for i, (x, y) in enumerate(pairs)])
    lg = per.select("origin", F.inline(entries))
    return lg.groupBy("col_x", "col_y").agg(
        F.max(F.when(F.col("origin") == a, F.col("r"))).alias("corr_a"),
        F.max(F.when(F.col("origin") == b, F.col("r"))).alias("corr_b"),
    ).withColumn("delta", F.col("corr_a") - F.col("corr_b"))


def domain_violations(df: DataFrame, rules: dict[str, str], origin: str = "origin") -> DataFrame:
    """origin, feature, rows, nulls, violations — ``rules`` maps a column to the
    SQL predicate its non-null values must satisfy."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, (c, pred) in enumerate(rules.items()):
        aggs.append(F.sum(F.col(c).isNull().cast("long")).alias(f"_n{i}"))
        aggs.append(F.sum((F.col(c).isNotNull() & ~F.expr(pred)).cast("long")).alias(f"_v{i}"))
    per = df.groupBy(F.col(origin).alias("origin")).agg(*aggs)
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_n{i}").alias("nulls"),
                                 F.col(f"_v{i}").alias("violations"))
                        for i, c in enumerate(rules)])
    return per.select("origin", F.col("_rows").alias("rows"), F.inline(entries))


def duplicate_rows(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """*by, dup_groups, dup_rows, extra_copies, max_copies over exact copies of ``cols``."""
    by = by or []
    groups = df.groupBy(*by, *cols).agg(F.count(F.lit(1)).alias("copies"))
    d = groups.where(F.col("copies") > 1)
    return d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("dup_groups"), F.sum("copies").alias("dup_rows"),
        F.sum(F.col("copies") - 1).alias("extra_copies"), F.max("copies").alias("max_copies"))


def source_overlap(df: DataFrame, cols: list[str], a: str, b: str, origin: str = "origin") -> DataFrame:
    """distinct_a, distinct_b, shared — one aggregation over distinct rows, no join."""
    d = df.groupBy(*cols).agg(F.max((F.col(origin) == a).cast("int")).alias("in_a"),
                              F.max((F.col(origin) == b).cast("int")).alias("in_b"))
    return d.agg(F.sum("in_a").cast("long").alias("distinct_a"),
                 F.sum("in_b").cast("long").alias("distinct_b"),
                 F.sum(F.col("in_a") * F.col("in_b")).cast("long").alias("shared"))


def label_association(df: DataFrame, categorical: list[str], continuous: list[str],
                      label: str = "label", origin: str = "origin") -> DataFrame:
    """origin, feature, measure, value: chi2 and Cramér's V for categorical
    features, point-biserial correlation for continuous ones."""
    lg = (df.select(F.col(origin).alias("origin"), F.col(label).alias("label"),
                    *[F.col(c).cast("double").alias(c) for c in categorical])
          .unpivot(["origin", "label"], categorical, "feature", "value")
          .where(F.col("value").isNotNull()))
    cell = lg.groupBy("origin", "feature", "value", "label").agg(F.count(F.lit(1)).alias("o"))
    # column totals: a row per (source, feature, label); row totals: windows of one value's labels
    ct = cell.groupBy("origin", "feature", "label").agg(F.sum("o").alias("ct"))
    nt = ct.groupBy("origin", "feature").agg(F.sum("ct").alias("n"), F.count(F.lit(1)).alias("labs"))
    wr = Window.partitionBy("origin", "feature", "value")
    e = cell.withColumn("rt", F.sum("o").over(wr)).withColumn(
        "one", F.when(F.row_number().over(wr.orderBy("label")) == 1, 1).otherwise(0))
    e = attach(attach(e, ct, ["origin", "feature", "label"], few=True), nt, ["origin", "feature"], few=True)
    expected = F.col("rt") * F.col("ct") / F.col("n")
    per_col = e.groupBy("origin", "feature").agg(
        F.first("n").alias("n"), F.sum("one").alias("vals"), F.first("labs").alias("labs"),
        F.sum(F.pow(F.col("o") - expected, 2) / expected).alias("chi_obs"), F.sum(expected).alias("e_obs"))
    # Σ over all cells of (O−E)²/E = Σ_obs (O−E)²/E + Σ_missing E, and Σ_all E = n
    chi2 = F.col("chi_obs") + (F.col("n") - F.col("e_obs"))
    k = F.least(F.col("vals"), F.col("labs")) - 1
    cat = per_col.select("origin", "feature", chi2.alias("chi2"),
                         F.sqrt(safe_div(chi2, F.col("n") * k)).alias("cramers_v"))
    cat_long = cat.select("origin", "feature", F.expr(
        "stack(2, 'chi2', chi2, 'cramers_v', cramers_v) as (measure, value)"))
    if not continuous:
        return cat_long
    pb = df.groupBy(F.col(origin).alias("origin")).agg(
        *[F.corr(F.col(c).cast("double"), F.col(label).cast("double")).alias(c) for c in continuous])
    pb_long = pb.unpivot(["origin"], continuous, "feature", "value").select(
        "origin", "feature", F.lit("point_biserial").alias("measure"), "value")
    return cat_long.unionByName(pb_long)
