"""Apply a stored tree table to rows (L11).

The tree table ``(slot, tree, node, feature, cut, leaf, tree_weight, index, left, missing_left)``
is model-sized (trees x nodes), never data-sized.  Rows walk all trees at once:
``depth`` rounds of ``index = left + (bins[feature] > cut)`` (a missing value: by ``missing_left``) over an array with one
node number per tree, by look-ups in arrays indexed by (tree, node number) — the
same cost whatever the number of nodes.  The arrays travel as one broadcast row, so
no size is baked into the plan's text; no shuffle, so the same function scores a
batch table or a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metablend.operators.grow import is_raw, nested
from metablend.operators.literals import arr


def score_trees(df: DataFrame, trees: DataFrame, slot: int, combine: str = "sum",
                init: float = 0.0) -> DataFrame:
    """Adds ``score`` for the trees of one slot of a fitted ensemble.

    ``combine``: ``sum`` (boosting: sigmoid(init + Σ leaf)), ``mean`` (forest:
    mean class-1 share), ``samme`` (AdaBoost: 1 / (1 + exp(-2 Σ α(2h-1) / Σ α)))
    or ``samme_forest`` (boosted forest: ``tree`` numbers are round * forest size
    + member, ``tree_weight`` is the round's α on every member; h = mean share > 0.5)."""
    cols = [c if c in trees.columns else F.lit(None).alias(c) for c in
            ("tree", "index", "left", "feature", "cut", "leaf", "tree_weight", "missing_left")]
    rows = trees.where(F.col("slot") == slot).select(
        *cols, F.col("rounds" if "rounds" in trees.columns else "tree").alias("rounds")).collect()
    place = {t: i for i, t in enumerate(sorted({int(r["tree"]) for r in rows}))}
    T = len(place)
    size = [0] * T
    for r in rows:
        size[place[int(r["tree"])]] = max(size[place[int(r["tree"])]], int(r["index"]) + 1)
    feature, cut, left, leaf, missing = ([[None] * n for n in size] for _ in range(5))
    weights, rounds = [1.0] * T, [0] * T
    for r in rows:
        t, i = place[int(r["tree"])], int(r["index"])
        feature[t][i], cut[t][i], left[t][i], leaf[t][i] = r["feature"], r["cut"], r["left"], r["leaf"]
        missing[t][i] = bool(r["missing_left"])
        weights[t], rounds[t] = float(r["tree_weight"]), int(r["rounds"])
    depth = max((_depth(lf) for lf in left), default=0)
    fl, ll, vl, ml = nested(feature, "int"), nested(left, "int"), nested(leaf, "double"), nested(missing, "boolean")
    cl = nested(cut, "double" if is_raw(df) else "int")
    nodes = F.array_repeat(F.lit(0), T)
    for _ in range(depth):
        def step(n, t):
            f = F.get(F.get(fl, t), n)
            right = F.coalesce(F.get(F.col("bins"), f) > F.get(F.get(cl, t), n), ~F.get(F.get(ml, t), n)).cast("int")
            return F.when(f.isNull(), n).otherwise(F.get(F.get(ll, t), n) + right)
        nodes = F.transform(nodes, step)
    vals = F.transform(nodes, lambda n, t: F.coalesce(F.get(F.get(vl, t), n), F.lit(0.0)))
    total = F.aggregate(vals, F.lit(0.0), lambda a, b: a + b)
    if combine == "sum":
        score = 1.0 / (1.0 + F.exp(-(F.lit(init) + total)))
    elif combine == "mean":
        score = total / float(max(T, 1))
    elif combine == "samme":
        wl = arr(weights)
        d = F.aggregate(F.transform(vals, lambda v, t: F.get(wl, t) * (2.0 * v - 1.0)),
                        F.lit(0.0), lambda a, b: a + b) / float(sum(weights) or 1.0)
        score = 1.0 / (1.0 + F.exp(-2.0 * d))
    elif combine == "samme_forest":
        df = df.withColumn("_vals", vals)
        d, alphas = F.lit(0.0), 0.0
        for r in sorted(set(rounds)):
            own = [t for t in range(T) if rounds[t] == r]
            share = F.aggregate(F.slice("_vals", own[0] + 1, len(own)), F.lit(0.0), lambda a, b: a + b) / float(len(own))
            d = d + weights[own[0]] * F.when(share > 0.5, 1.0).otherwise(-1.0)
            alphas += weights[own[0]]
        return df.withColumn("score", 1.0 / (1.0 + F.exp(-2.0 * d / float(alphas or 1.0)))).drop("_vals")
    else:
        raise ValueError(f"unknown combination {combine}")
    return df.withColumn("score", score)


def _depth(left: list) -> int:
    """Depth of a tree given each node's left child."""
    depth = [0] * len(left)
    for i, child in enumerate(left):
        if child is not None and child < len(left):
            depth[child] = depth[i] + 1
            if child + 1 < len(left):
                depth[child + 1] = depth[i] + 1
    return max(depth, default=0)
