"""Mixing sources to target token weights by entropy balancing.

Targets.  Sources in code-point order (null last) weigh 1, 2, 3, 1, ... and share all
tokens; a target stops at ``max_copies`` times its source's tokens and the excess is
shared again by weight among the others, round by round.

Rates.  Document rates r solve, per source, min sum r log r - r subject to
sum r*size = target and r <= max_copies.  The solution is an exponential tilt,
r = min(max_copies, exp(lam * size / scale)); lam minimises the convex dual, found by
safeguarded Newton steps.  Each step is one distributed aggregation over the table
(source, size, count) and updates every source at the same time; the multipliers stay
a table.

Copies.  All documents of one (source, size) have the same rate.  Rates become whole
copies by systematic rounding along the sizes of a source: the running sum of
rates is rounded, so a source's words differ from its target by less than its
largest document, and of ``PHASES`` starting points the one nearest to the target is taken.  Who gets the odd copy is decided by a hash of the id in two
levels (hash bucket, then place in the bucket), so no (source, size) group, however
large, is sorted in one task, and reruns agree.

Edge cases: null texts have size 0; size-0 documents keep one copy (they take no
words either way); a source without words has target 0; repeated rows are
separate documents; null ids hash alike and stay; an empty table gives an empty
result; only the id, text and source columns are read, and those named in ``keep``.  Newton steps that
do not come to the targets in ``steps`` steps are an error (``Unsolved``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, stored

MAX_COPIES = 3
HASH_BUCKETS = 64
PHASES = 32
STEPS = 60
TOLERANCE = 1e-7
WORD = r"[^\x20\x09-\x0D]+"


class Unsolved(RuntimeError):
    """The tilts of some sources have not come to their targets."""


def word_size(col):
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Places 1.. of rows in a global order, without one sorted task: range parts, then offsets of the parts."""
    parts = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    parts = stored(parts, "ranked")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row per range part
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy("_part").orderBy(*order)
    return (parts.withColumn("_in", F.row_number().over(inner)).join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_offset") + F.col("_in")).drop("_part", "_in", "_offset"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: int = MAX_COPIES) -> DataFrame:
    """``source, source_size, target`` from the table ``source, size, n``."""
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    per = checkpointed(ranked(per, [F.col("source").asc_nulls_last()]).withColumn("weight", weight).drop("rank"))
    total = per.agg(F.sum("source_size")).first()[0] or 0
    # level * weight below every cap's reach; each round raises the level by what the capped leave over
    level, capped = 0.0, -1
    cap = F.col("source_size") * F.lit(max_copies)
    while True:
        full = F.col("weight") * F.lit(level) >= cap if capped >= 0 else F.lit(False)
        row = per.agg(F.sum(F.when(full, cap).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))),
                      F.sum(full.cast("int"))).first()
        if not row[1] or row[2] == capped:
            break
        capped, level = row[2], (total - row[0]) / row[1]
    target = F.least(cap.cast("double"), F.col("weight") * F.lit(float(level)))
    return per.select("source", "source_size", target.alias("target"))


def tilts(sizes: DataFrame, targets: DataFrame, max_copies: int = MAX_COPIES, steps: int = STEPS,
          tolerance: float = TOLERANCE) -> DataFrame:
    """``source, lam, scale, all_in``: the dual solution of each source, by distributed Newton steps.

    ``all_in`` marks sources whose target is the cap: every rate is ``max_copies``.
    """
    scale = sizes.groupBy("source").agg(
        (F.sum(F.col("size") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1))).alias("mean_size"))
    scale = scale.withColumnRenamed("source", "_s")
    state = targets.join(scale, targets["source"].eqNullSafe(scale["_s"])).select(
        "source", "target", "source_size",
        F.greatest(F.col("mean_size"), F.lit(1.0)).alias("scale"),
        (F.col("target") >= F.col("source_size") * F.lit(max_copies) * (1 - 1e-12)).alias("all_in"),
        F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    state = checkpointed(state)
    data = sizes.where("size > 0").select(F.col("source").alias("_s"), "size", "n")
    for _ in range(steps):
        rate = F.least(F.lit(float(max_copies)), F.exp(F.col("lam") * F.col("size") / F.col("scale")))
        words = rate * F.col("size") * F.col("n")
        sums = (data.join(state.select(F.col("source").alias("_k"), "lam", "scale"), F.col("_s").eqNullSafe(F.col("_k")))
                .groupBy("_k").agg(
                    F.sum(words).alias("got"),
                    F.sum(F.when(rate < max_copies, words * F.col("size") / F.col("scale")).otherwise(0.0)).alias("slope")))
        gap = F.col("target") - F.coalesce(F.col("got"), F.lit(0.0))
        lo = F.when(gap > 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(gap <= 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") + gap / F.col("slope")
        wide = F.col("lam") + F.when(gap > 0, 1.0).otherwise(-1.0) * (1 + F.abs("lam"))
        safe = F.when(lo.isNotNull() & hi.isNotNull(), (lo + hi) / 2).otherwise(wide)
        inside = (F.coalesce(newton > lo, F.lit(True)) & F.coalesce(newton < hi, F.lit(True))
                  & (F.abs(newton - F.col("lam")) <= 2 * (1 + F.abs("lam"))))
        done = F.col("all_in") | (F.abs(gap) <= F.lit(tolerance) * F.greatest(F.col("target"), F.lit(1.0)))
        moved = F.when(done, F.col("lam")).when((F.col("slope") > 0) & inside, newton).otherwise(safe)
        state = checkpointed(state.join(sums, F.col("source").eqNullSafe(F.col("_k")), "left").select(
            "source", "target", "source_size", "scale", "all_in", moved.alias("lam"), lo.alias("lo"), hi.alias("hi"),
            (~done).alias("open")))
        if not state.where("open").limit(1).count():
            break
        state = state.drop("open")
    else:
        raise Unsolved(f"targets are not met to {tolerance} of their size after {steps} Newton steps")
    return state.select("source", "source_size", "target", "scale", "lam", "all_in")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (1, 2, 3), max_copies: int = MAX_COPIES, seed: int = 17,
        keep: list[str] | None = None) -> DataFrame:
    """Per document ``id, size, source, source_size, target, rate, copies, taken``, and ``kept``: a struct of the
    columns in ``keep``.  They are shuffled once, to their (source, size, bucket)."""
    carried = [F.struct(*[docs[c] for c in keep]).alias("kept")] if keep else []
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # never null: its window and join share a shuffle
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(HASH_BUCKETS))
    rows = stored(docs.select(docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"),
                              word_size(docs[text_col]).alias("size"), *carried), "sizes").withColumn("bucket", bucket)
    counts = rows.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts, "size-buckets")
    sizes = stored(counts.groupBy("source", "size").agg(F.sum("n").alias("n")), "size-counts")
    solved = tilts(sizes, source_targets(sizes, weights, max_copies), max_copies).withColumnRenamed("source", "_k")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("all_in"), F.lit(float(max_copies))).otherwise(
        F.least(F.lit(float(max_copies)), F.exp(F.col("lam") * F.col("size") / F.col("scale"))))
    rates = sizes.join(solved, F.col("source").eqNullSafe(F.col("_k"))).select(
        "source", "size", "n", "source_size", "target", rate.alias("rate"))
    # systematic rounding along the sizes of each source (rows: distinct sizes), at the phase
    # whose words come nearest to the target
    upto = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    rates = rates.withColumn("run", F.sum(F.when(F.col("size") > 0, F.col("rate") * F.col("n")).otherwise(0.0)).over(upto))
    before_run = F.lag("run", 1, 0.0).over(Window.partitionBy("source").orderBy("size"))
    rates = stored(rates.withColumn("run_before", before_run), "rates")

    def copies_at(phase):
        return (F.floor(F.col("run") + phase) - F.floor(F.col("run_before") + phase)).cast("long")

    tried = rates.withColumn("phase", F.explode(F.array(*[F.lit(k / PHASES) for k in range(PHASES)])))
    totals = tried.groupBy("source", "phase").agg(
        F.sum(copies_at(F.col("phase")) * F.col("size")).alias("words"), F.max("target").alias("target"))
    phases = totals.groupBy("source").agg(
        F.min(F.struct(F.abs(F.col("words") - F.col("target")).alias("miss"), "phase")).alias("best")).select(
        F.col("source").alias("_ps"), F.col("best.phase").alias("phase"))
    rates = rates.join(phases, F.col("source").eqNullSafe(F.col("_ps"))).withColumn(
        "copies_of_all", F.when(F.col("size") == 0, F.col("n")).otherwise(copies_at(F.col("phase"))))
    rates = rates.select(F.col("source").alias("_rs"), F.col("size").alias("_rz"), F.col("n").alias("group_n"),
                         "source_size", "target", "rate", "copies_of_all")
    # every document gets the whole part; the first places of its group get one more
    below = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key.alias("_ok"), F.col("source").alias("_os"), F.col("size").alias("_oz"), F.col("bucket").alias("_ob"),
                            F.coalesce(F.sum("n").over(below), F.lit(0)).alias("before"))
    groups = offsets.join(rates, F.col("_os").eqNullSafe(F.col("_rs")) & (F.col("_oz") == F.col("_rz")))
    place = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy(F.xxhash64(F.lit(seed + 1), F.col("id")), "id"))
    placed = rows.withColumn("key", key).withColumn("place", place)
    out = placed.join(groups, (F.col("key") == F.col("_ok")) & (F.col("size") == F.col("_oz"))
                      & (F.col("bucket") == F.col("_ob")))
    whole = F.floor(F.col("copies_of_all") / F.col("group_n"))
    odd = F.col("copies_of_all") - whole * F.col("group_n")
    copies = F.least(F.lit(max_copies), whole + (F.col("before") + F.col("place") <= odd).cast("int")).cast("long")
    return out.select("id", "size", "source", "source_size", "target", "rate", copies.alias("copies"),
                      (copies * F.col("size")).alias("taken"), *(["kept"] if keep else []))
