"""Feature binning (the step hidden inside every histogram tree library).

Cuts are fitted on training rows and then inlined as literals; assigning a bin
is a narrow projection.

* ``width``    : ``floor((x - min) / (max - min) * B)`` clamped to [0, B-1].
* ``quantile`` : weighted quantile bins with *full* cuts (``quantile_cuts``):
                 always ``min(B, distinct values)`` non-empty bins, whatever
                 share of the rows one value holds.  B = 255 by default.
* ``identity`` : integer-coded categorical feature, used as its own bin.

Missing values (null, NaN) and category codes never seen in training have no
bin: their entry of ``bins ARRAY<INT>`` is null, and the grower learns on which
side of each split they go.  ``bin_columns`` (the tabular view, for learners
that look bins up as keys) puts them into bin 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metablend.operators.literals import arr
from metablend.operators.prefix import below_sums, count_below

N_BINS = 255
VALUES_PER_TASK = 50_000


@dataclass
class BinSpec:
    feature: str
    kind: str                      # width | quantile | identity
    n_bins: int
    lo: float = 0.0
    hi: float = 0.0
    cuts: list[float] = field(default_factory=list)

    def expr(self) -> Column:
        """The value's bin; null where it has none."""
        if self.kind == "identity":
            code = F.col(self.feature).cast("int")
            return F.when((code >= 0) & (code < self.n_bins), code)
        x = known(F.col(self.feature))
        if self.kind == "width":
            return F.when(x.isNotNull(), width_bin(x, self.lo, self.hi, self.n_bins))
        return F.when(x.isNotNull(), bins_below(x, self.cuts))


def known(x: Column) -> Column:
    """The value as a double; null if it is missing (null or NaN)."""
    x = x.cast("double")
    return F.when(~F.isnan(x), x)


def width_bin(x: Column, lo: float, hi: float, n_bins: int) -> Column:
    if hi <= lo:
        return F.lit(0)
    raw = F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(n_bins)).cast("int")
    return F.least(F.greatest(raw, F.lit(0)), F.lit(n_bins - 1))


def bins_below(x: Column, cuts: list[float]) -> Column:
    """Number of ascending cuts below x: a binary search in a literal array (a CASE per cut would outgrow
    what the JVM compiles)."""
    return count_below(arr(cuts), x, len(cuts)) if cuts else F.lit(0)


# --- weighted quantile cuts -----------------------------------------------------------
def distinct_weights(df: DataFrame, features: list[str], weight: str | None = None) -> DataFrame:
    """``f, x, w``: every distinct known value of every feature with its weight (rows, or the sum
    of a non-negative weight column); partial sums before the one shuffle, so a value held by a
    third of all rows is one row per task there."""
    one = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("double")
    long = df.select(one.alias("w"), F.posexplode(F.array(*[known(F.col(c)) for c in features])).alias("f", "x"))
    return long.where(F.col("x").isNotNull()).groupBy("f", "x").agg(F.sum("w").alias("w")).where("w > 0")


def quantile_cuts(values: DataFrame, n_bins: int = N_BINS) -> dict[int, list[float]]:
    """Ascending cuts per feature of a ``(f, x, w)`` table: the largest value of every bin but the last.

    A bin should weigh W / B.  Values heavier than that would swallow the cuts of
    several bins, so weights are capped at the level θ with θ = (the weight of the
    values below θ) / (B − number of values above θ): a heavy value counts as exactly
    one bin, the light ones share the rest.  A value's bin is the capped weight below
    it, divided by θ and rounded down.  As no step exceeds θ, no bin is skipped: there
    are B bins, or one per value if there are no more than B values.

    Spark: only the B heaviest values of a feature can be above θ, so the level comes
    from at most B rows per feature; the weights below each value come from two-level
    prefix sums; B rows per feature are brought back.
    """
    values = values.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        by_weight = Window.partitionBy("f").orderBy(F.col("w").desc(), F.col("x"))
        top = values.withColumn("r", F.row_number().over(by_weight)).where(F.col("r") <= n_bins)
        heaviest: dict[int, list[float]] = {}
        for r in top.select("f", "w").collect():
            heaviest.setdefault(r["f"], []).append(r["w"])
        levels, most = [], 0
        for r in values.groupBy("f").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")).collect():
            most = max(most, r["n"])
            levels.append((r["f"], *cap_level(sorted(heaviest[r["f"]], reverse=True), r["w"], r["n"], n_bins)))
        if not levels:
            return {}
        kind = "bigint" if values.schema["w"].dataType.simpleString() == "bigint" else "double"
        level = values.sparkSession.createDataFrame(levels, f"f int, heavy int, light {kind}")  # one row per feature
        # a value is heavy if w * (B - heavy) > light; where every value has a bin of its own, light is 0
        one = values.join(F.broadcast(level), "f").withColumn("big", (
            (F.col("light") == 0) | (F.col("w") * (n_bins - F.col("heavy")) > F.col("light"))).cast("bigint")).withColumn(
            "small", F.when(F.col("big") == 0, F.col("w")).otherwise(F.lit(0).cast(kind)))
        share = "small_below * (%d - heavy) %s light" % (n_bins, "div" if kind == "bigint" else "/")
        if most <= VALUES_PER_TASK:  # a feature's values fit one task: the plain running sums, with the same result
            below = Window.partitionBy("f").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
            sums = one.withColumns({f"{c}_below": F.coalesce(F.sum(c).over(below), F.lit(0).cast(t)) for c, t in (("big", "bigint"), ("small", kind))})
        else:
            sums = below_sums(one, ["f"], "x", ["big", "small"], few_groups=True)
        placed = sums.withColumn(
            "b", F.col("big_below") + F.expr(f"CASE WHEN light > 0 THEN CAST(floor({share}) AS BIGINT) ELSE 0 END"))
        ends: dict[int, list[float]] = {f: [] for f, *_ in levels}
        for r in placed.groupBy("f", "b").agg(F.max("x").alias("x")).collect():
            ends[r["f"]].append(r["x"])
        return {f: sorted(xs)[:-1] for f, xs in ends.items()}
    finally:
        values.unpersist()


def cap_level(heaviest: list, total, distinct: int, n_bins: int) -> tuple:
    """(number of heavy values, weight of the others); (number of values, 0) if each value has its own bin."""
    if distinct <= n_bins:
        return distinct, total * 0
    rest = total
    for h, w in enumerate(heaviest):
        if w * (n_bins - h) <= rest or h == n_bins - 1:  # the last of B is part of the rest
            break
        rest -= w
    return h, rest


def fit_bins(train: DataFrame, continuous: list[str], categorical: list[str] | None = None,
             n_bins: int = N_BINS, kind: str = "quantile", weight: str | None = None) -> list[BinSpec]:
    """Cuts of all features from the training rows (all continuous features at once)."""
    categorical = categorical or []
    specs: list[BinSpec] = []
    if continuous and kind == "width":
        aggs = []
        for c in continuous:
            aggs += [F.min(known(F.col(c))).alias(f"lo_{c}"), F.max(known(F.col(c))).alias(f"hi_{c}")]
        row = train.agg(*aggs).first()
        for c in continuous:
            lo, hi = row[f"lo_{c}"], row[f"hi_{c}"]
            specs.append(BinSpec(c, "width", n_bins, float(lo or 0.0), float(hi or 0.0)))
    elif continuous:
        cuts = quantile_cuts(distinct_weights(train, continuous, weight), n_bins)
        specs += [BinSpec(c, "quantile", n_bins, cuts=cuts.get(i, [])) for i, c in enumerate(continuous)]
    if categorical:
        row = train.agg(*[F.max(c).alias(f"mx_{c}") for c in categorical]).first()
        for c in categorical:
            mx = int(row[f"mx_{c}"] or 0)
            specs.append(BinSpec(c, "identity", max(mx + 1, 2)))
    return specs


def apply_bins(df: DataFrame, specs: list[BinSpec], out: str = "bins") -> DataFrame:
    """``out ARRAY<INT>``.  Quantile bins come from spark.ml's Bucketizer, a compiled search: its buckets [a, b) over
    the negated values and cuts are the numbers of cuts not below a value."""
    cut = {f"_c{i}": s for i, s in enumerate(specs) if s.kind == "quantile" and s.cuts and all(map(math.isfinite, s.cuts))}
    bins = {f"_c{i}": s.expr() for i, s in enumerate(specs) if f"_c{i}" not in cut}
    if cut:
        # 0 - x: no negative zeros; missing values take any bucket here and lose it below
        df = df.withColumns({f"{c}_x": F.lit(0.0) - F.coalesce(known(F.col(s.feature)), F.lit(0.0)) for c, s in cut.items()})
        df = Bucketizer(inputCols=[f"{c}_x" for c in cut], outputCols=list(cut), splitsArray=[
            [-math.inf, *sorted(0.0 - x for x in s.cuts), math.inf] for s in cut.values()]).transform(df)
        bins.update({c: F.when(known(F.col(s.feature)).isNotNull(), F.lit(len(s.cuts)) - F.col(c)) for c, s in cut.items()})
    return df.withColumn(out, F.array(*[bins[f"_c{i}"].cast("int") for i in range(len(specs))])).drop(*cut, *[f"{c}_x" for c in cut])


def raw_values(df: DataFrame, features: list[str], out: str = "bins") -> DataFrame:
    """The features themselves (doubles, missing = null) where the grower shall cut raw values."""
    return df.withColumn(out, F.array(*[known(F.col(c)) for c in features]))


def bin_columns(df: DataFrame, specs: list[BinSpec], prefix: str = "b_") -> DataFrame:
    """One INT column per feature (tabular view of the bins, used by SQL checks); no bin → 0."""
    return df.withColumns({f"{prefix}{s.feature}": F.coalesce(s.expr().cast("int"), F.lit(0)) for s in specs})
