"""Closed-form base learner: smoothed label rate per bin of one feature.

For the model that holds out fold k:

    rate_k(b) = (pos(b) - pos_k(b) + a) / (n(b) - n_k(b) + 2a)

where ``pos_k, n_k`` are the counts of fold k.  One ``groupBy(base, fold, bin)``
over the training rows gives every fold model of every base at once (the
totals minus the held-out fold), so the whole out-of-fold chain is pure
aggregation and has an exact SQL form.  The model table has at most (k + 1) x n_bins rows — a proven
bound — and is broadcast to score rows:

* a training row is scored by the model of its own fold (out-of-fold),
* any other row by the mean of the k fold models (fold average, key -1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bin_rate_models(prepared: DataFrame, bin_col: str, k: int, prior: float = 1.0,
                    label: str = "label") -> DataFrame:
    """``fold, bin, rate`` for folds 0..k-1 plus the fold average under fold -1."""
    train = prepared.where(F.col("split") == "train")
    cnt = train.groupBy("fold", F.col(bin_col).alias("bin")).agg(
        F.sum(label).cast("double").alias("pos"), F.count(F.lit(1)).cast("double").alias("n"))
    tot = cnt.groupBy("bin").agg(F.sum("pos").alias("tpos"), F.sum("n").alias("tn"))
    per = (tot.select("bin", "tpos", "tn", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
           .join(cnt, ["fold", "bin"], "left"))
    rate = ((F.col("tpos") - F.coalesce(F.col("pos"), F.lit(0.0)) + F.lit(prior))
            / (F.col("tn") - F.coalesce(F.col("n"), F.lit(0.0)) + F.lit(2.0 * prior)))
    per = per.select("fold", "bin", rate.alias("rate"))
    avg = per.groupBy("bin").agg(F.avg("rate").alias("rate")).select(F.lit(-1).alias("fold"), "bin", "rate")
    return per.unionByName(avg)


def bin_rate_tables(prepared: DataFrame, bases: list[tuple[str, str]], k: int, prior: float = 1.0,
                    label: str = "label") -> dict[str, list[tuple[int, int, float]]]:
    """All fold models of all bases from ONE aggregation pass.

    ``groupBy(base, fold, bin)`` over the training rows returns at most
    bases x k x n_bins rows (a bound fixed by the parameters); the fold
    models (totals minus the held-out fold) and the fold average are derived
    from those counts.  Returns base -> [(fold or -1, bin, rate)]."""
    train = prepared.where(F.col("split") == "train")
    pairs = F.array(*[F.struct(F.lit(name).alias("base"), F.col(b).cast("int").alias("bin"))
                      for name, b in bases])
    counts = (train.select("fold", F.col(label).alias("_y"), F.inline(pairs))
              .groupBy("base", "fold", "bin")
              .agg(F.sum("_y").cast("double").alias("pos"), F.count(F.lit(1)).cast("double").alias("n"))
              .collect())
    out: dict[str, list] = {}
    for name, _ in bases:
        cnt = {(int(r["fold"]), int(r["bin"])): (float(r["pos"]), float(r["n"]))
               for r in counts if r["base"] == name}
        bins = sorted({b for _, b in cnt})
        rows = []
        for b in bins:
            tpos = sum(v[0] for (f, bb), v in cnt.items() if bb == b)
            tn = sum(v[1] for (f, bb), v in cnt.items() if bb == b)
            rates = []
            for f in range(k):
                pos, n = cnt.get((f, b), (0.0, 0.0))
                r = (tpos - pos + prior) / (tn - n + 2.0 * prior)
                rates.append(r)
                rows.append((f, b, r))
            rows.append((-1, b, sum(rates) / k))
        out[name] = rows
    return out


def bin_rate_scores(prepared: DataFrame, bases: list[tuple[str, str]], k: int,
                    prior: float = 1.0, label: str = "label",
                    target: DataFrame | None = None) -> DataFrame:
    """Adds one probability column per ``(name, bin_col)`` base to ``target``
    (default: ``prepared``): out-of-fold on training rows, fold average
    elsewhere.  One aggregation pass for all bases, then broadcast joins of
    the (k + 1) x n_bins model tables."""
    spark = prepared.sparkSession
    tables = bin_rate_tables(prepared, bases, k, prior, label)
    out = (prepared if target is None else target).withColumn("_mk", F.coalesce(F.col("fold"), F.lit(-1)))
    default = prior / (2.0 * prior)
    for name, bin_col in bases:
        model = spark.createDataFrame(tables[name], f"_mk int, {bin_col} int, {name} double")
        out = (out.join(F.broadcast(model), ["_mk", bin_col], "left")
               .withColumn(name, F.coalesce(F.col(name), F.lit(default))))
    return out.drop("_mk")


def bin_rate_full(train: DataFrame, score: DataFrame, bin_col: str, name: str,
                  prior: float = 1.0, label: str = "label") -> DataFrame:
    """One model fitted on all of ``train`` applied to ``score`` rows (train on
    one source, evaluate on another).  The model has at most n_bins rows."""
    model = (train.groupBy(bin_col).agg(F.sum(label).cast("double").alias("_pos"),
                                        F.count(F.lit(1)).cast("double").alias("_n"))
             .select(bin_col, ((F.col("_pos") + prior) / (F.col("_n") + 2.0 * prior)).alias(name)))
    return (score.join(F.broadcast(model), bin_col, "left")
            .withColumn(name, F.coalesce(F.col(name), F.lit(prior / (2.0 * prior)))))
