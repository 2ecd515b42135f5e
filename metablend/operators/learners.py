"""Tree-ensemble learners on the fused grower.

Every learner trains *slots* side by side over one prepared table
``(row_id, label, split, fold, bins)``: slot s trains on rows with
``split = 'train' AND fold <> holdout[s]`` (``holdout = -1``: all training
rows) and scores **every** row, so out-of-fold, fold-averaged and held-out
predictions fall out of the same run with no extra pass.

State between trees lives in per-row arrays (one entry per slot) and is
persisted after each tree; every ``checkpoint_every`` trees it is written to
the reliable checkpoint folder to cut lineage.  Per-tree randomness (row
subsampling, bootstrap counts, feature choice) is a hash of (row, tree,
seed), so results do not depend on partitioning and survive recomputation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metablend.operators.literals import arr
from metablend.session import ensure_checkpoint_dir
from metablend.operators.compress import feature_groups, with_group_scores
from metablend.operators.grow import Node, TreeParams, for_rows, grow, is_raw, leaf_values, row_facts

KEEP = ["row_id", "label", "split", "fold", "bins"]


def keep_cols(df: DataFrame) -> list[str]:
    """Row columns carried through a fit (``inner`` exists for nested search, ``copies`` where equal rows were counted)."""
    return KEEP + [c for c in ("inner", "copies") if c in df.columns]


def copies_of(df: DataFrame) -> Column:
    """How many equal rows a row stands for."""
    return F.col("copies").cast("double") if "copies" in df.columns else F.lit(1.0)


def over_copies(df: DataFrame, draw, *salt) -> Column:
    """Sum of ``draw(u)`` over the row's copies, each with a uniform of its own."""
    if "copies" not in df.columns:
        return draw(uniform(F.col("row_id"), *salt))
    return F.aggregate(F.sequence(F.lit(1), F.col("copies").cast("int")), F.lit(0.0),
                       lambda total, i: total + draw(uniform(F.col("row_id"), *salt, i)))


def uniform(row_id: Column, *salt) -> Column:
    """Deterministic U[0,1) from the row key and salts."""
    h = F.xxhash64(row_id.cast("string"), *[F.lit(s) if not isinstance(s, Column) else s for s in salt])
    return F.pmod(h, F.lit(2 ** 31)).cast("double") / float(2 ** 31)


def poisson1(u: Column) -> Column:
    """Poisson(1) draw by inverse CDF (bootstrap count of a row in one tree).

    ``u`` has 31 bits; the steps go on until the CDF passes its largest value,
    so every draw the uniform can produce is covered."""
    cdf, term, acc, k = [], math.exp(-1.0), 0.0, 0
    while acc <= 1.0 - 2.0 ** -31:
        acc += term
        cdf.append(acc)
        k += 1
        term /= k
    out = F.lit(0.0)
    for c in cdf:
        out = out + F.when(u > F.lit(c), 1.0).otherwise(0.0)
    return out


def train_mask(hold: Column, inner_hold: Column | None = None) -> Column:
    """Training rows of a slot: split = 'train' and neither in its held-out fold nor in its inner one."""
    m = (F.col("split") == "train") & ((hold < 0) | (F.coalesce(F.col("fold"), F.lit(-1)) != hold))
    if inner_hold is not None:
        m = m & ((inner_hold < 0) | (F.coalesce(F.col("inner"), F.lit(-1)) != inner_hold))
    return m


def outer_inner(holdouts: list) -> tuple[list[int], list[int]]:
    """Holdouts given as a fold or as (fold, inner fold) → two lists (-1: none)."""
    pairs = [h if isinstance(h, tuple) else (h, -1) for h in holdouts]
    return [int(o) for o, _ in pairs], [int(i) for _, i in pairs]


@dataclass
class Fitted:
    """Result of a fused fit: per-row probabilities per slot plus the trees.  ``extra['groups']``: the
    probabilities per different ``bins``, where the fit ran over those."""
    scores: DataFrame                 # KEEP columns + P ARRAY<DOUBLE> (one per slot)
    n_slots: int
    holdouts: list[int]
    trees: list[tuple] = field(default_factory=list)   # rows of tree_row()
    kind: str = ""
    extra: dict = field(default_factory=dict)

    def trees_df(self, spark: SparkSession, model: str) -> DataFrame:
        """The ensemble as a table.  ``index``/``left`` number the nodes of a tree and point to
        the left child (the right one is next); ``node`` is the heap number, null beyond depth 61."""
        return spark.createDataFrame(
            [(model, s, t, n if n < 1 << 62 else None, f, c, v, w, i, left, r, m)
             for (s, t, n, f, c, v, w, i, left, r, m) in self.trees],
            f"model string, slot int, tree int, node bigint, feature int, cut {'double' if is_raw(self.scores) else 'int'}, "
            "leaf double, tree_weight double, index int, left int, rounds int, missing_left boolean")


def tree_row(n: Node, tree: int, leaf: float, weight: float, slot: int | None = None,
             rounds: int | None = None) -> tuple:
    """(slot, tree, node, feature, cut, leaf value or None, tree weight, index, left child, boosting round,
    missing values go left)."""
    is_leaf = n.feature is None
    return (n.slot if slot is None else slot, tree, n.node, n.feature, n.cut, leaf if is_leaf else None, weight,
            n.index, None if is_leaf else n.left_index, tree if rounds is None else rounds, None if is_leaf else n.missing_left)


class _State:
    """Persisted state with lineage cut every few trees."""

    def __init__(self, df: DataFrame, checkpoint_every: int):
        ensure_checkpoint_dir(df.sparkSession)
        self.every = checkpoint_every
        self.n = 0
        self.df = df.persist(StorageLevel.MEMORY_AND_DISK)
        self.stale: list[DataFrame] = []

    def replace(self, new: DataFrame) -> DataFrame:
        """The new state is cached lazily by the next tree's first pass (no
        extra job); the previous one is released only after that, so a
        partition is never recomputed through a released parent."""
        new = new.persist(StorageLevel.MEMORY_AND_DISK)
        self.n += 1
        for old in self.stale:
            old.unpersist()
        self.stale = [self.df]
        if self.every and self.n % self.every == 0:
            cut = new.checkpoint(eager=True).persist(StorageLevel.MEMORY_AND_DISK)
            for old in self.stale + [new]:
                old.unpersist()
            self.stale, new = [], cut
        self.df = new
        return new


# ------------------------------------------------------------------ boosting
BOOST_PRESETS = {
    # first-order gradient boosting on residuals, Newton-step leaf values
    "gbm": dict(params=TreeParams("variance", max_depth=3, min_rows_leaf=1, min_rows_split=2),
                lr=0.1, n_trees=100),
    # second-order, depth-wise, lambda = 1, min child hessian 1
    "newton": dict(params=TreeParams("newton", max_depth=6, lam=1.0, min_hess=1.0),
                   lr=0.3, n_trees=100),
    # second-order, best-first with a 31-leaf budget, 20 rows per leaf
    "leafwise": dict(params=TreeParams("newton", max_depth=None, lam=0.0, min_hess=1e-3,
                                       min_rows_leaf=20, max_leaves=31), lr=0.1, n_trees=100),
    # histogram gradient boosting meta-learner defaults (31 leaves, 20 rows/leaf)
    # (and, as there, early stopping above 10,000 training rows)
    "hist": dict(params=TreeParams("newton", max_depth=None, lam=0.0, min_hess=1e-3,
                                   min_rows_leaf=20, max_leaves=31), lr=0.1, n_trees=100),
}


@dataclass
class BoostSlot:
    holdout: int = -1
    n_trees: int = 100
    lr: float = 0.1
    max_depth: int | None = 3
    subsample: float = 1.0
    row_fraction: float = 1.0      # fixed nested subset of the training rows (learning curves)
    inner_holdout: int = -1        # nested search: also hold out this inner fold


def newton_leaf(G: float, H: float, lam: float) -> float:
    """Second-order leaf weight −G / (H + λ) (before the learning rate)."""
    return -G / (H + lam) if (H + lam) > 0 else 0.0


def residual_leaf(G: float, H: float) -> float:
    """Log-loss gradient-boosting leaf: Σ residual / Σ p(1−p)."""
    return G / H if abs(H) > 1e-150 else 0.0


def _row_mask(hold: Column, inner_hold: Column | None, fraction: Column | None, seed: int) -> Column:
    """Training rows of a slot: not held out, not in its inner fold, inside its fixed fraction."""
    m = train_mask(hold, inner_hold)
    if fraction is not None:
        m = m & (uniform(F.col("row_id"), "subset", seed) < fraction)
    return m


#: boosting runs over groups of rows with equal bins from this many rows on, where they are so much fewer
LEAST_ROWS_GROUPED = 100_000
LEAST_COPIES = 2


def _rate(pos: float, n: float) -> float:
    return min(max(pos, 0.5), n - 0.5) / n if n > 1 else 0.5


def _group_rates(groups: DataFrame, n_slots: int) -> list[float]:
    """The start scores of ``_init_scores`` from the groups' sums."""
    row = groups.select(*[F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for i in range(n_slots) for c in ("N", "Q")]).first()
    rates = [_rate(float(row[f"Q{i}"] or 0), float(row[f"N{i}"] or 0)) for i in range(n_slots)]
    return [math.log(r / (1 - r)) for r in rates]


def _init_scores(prep: DataFrame, slots: list[BoostSlot], seed: int, early: EarlyStop | None = None) -> tuple[list[float], list[bool]]:
    """logit of the positive rate on each slot's own training rows, and whether the slot stops
    early (one aggregation for all slots).

    A slot whose rows have one class starts at a rate half a row away from 0 or 1, so its
    score stays finite whatever the number of rows."""
    inner = "inner" in prep.columns
    keys = sorted({(s.holdout, s.inner_holdout if inner else -1, float(s.row_fraction)) for s in slots})
    aggs = []
    for i, (h, ih, frac) in enumerate(keys):
        m = _row_mask(F.lit(h), F.lit(ih) if ih >= 0 else None, F.lit(frac) if frac < 1.0 else None, seed)
        for name, mask in (("", m), ("e", m & ~held_for_stopping(early, seed))):
            aggs += [F.sum(F.when(mask, F.col("label") * copies_of(prep))).alias(f"p{name}{i}"),
                     F.sum(F.when(mask, copies_of(prep))).alias(f"n{name}{i}")]
    row = prep.agg(*aggs).first()
    stops, rate = {}, {}
    for i, k in enumerate(keys):
        stops[k] = early is not None and float(row[f"n{i}"] or 0) > early.min_rows
        name = "e" if stops[k] else ""
        pos, n = float(row[f"p{name}{i}"] or 0), float(row[f"n{name}{i}"] or 0)
        rate[k] = _rate(pos, n)
    own = [(s.holdout, s.inner_holdout if inner else -1, float(s.row_fraction)) for s in slots]
    return [math.log(rate[k] / (1 - rate[k])) for k in own], [stops[k] for k in own]


@dataclass(frozen=True)
class EarlyStop:
    """The study library's rule for histogram boosting on more than ``min_rows`` training rows: a hashed
    ``fraction`` of them is held out; a slot retires once none of its last ``patience`` rounds has a
    held-out loss more than ``tol`` below that of the round before them."""
    fraction: float = 0.1
    patience: int = 10
    tol: float = 1e-7
    min_rows: int = 10_000

    def retires(self, losses: list[float]) -> bool:
        """``losses``: held-out loss of the start score and after each round."""
        if len(losses) <= self.patience:
            return False
        before, recent = losses[-self.patience - 1], losses[-self.patience:]
        return not any(x < before - self.tol for x in recent)


def held_for_stopping(early: EarlyStop | None, seed: int) -> Column:
    return F.lit(False) if early is None else uniform(F.col("row_id"), "early", seed) < early.fraction


def _held_losses(state: DataFrame, slots: list[BoostSlot], stops: list[bool], early: EarlyStop, nested: bool, subset: bool,
                 seed: int) -> dict[int, float]:
    """Mean held-out log-loss of the slots that may stop (one aggregation for all)."""
    aggs, y, n = [], F.col("label").cast("double"), copies_of(state)
    for i in [i for i, on in enumerate(stops) if on]:
        s = slots[i]
        m = _row_mask(F.lit(s.holdout), F.lit(s.inner_holdout) if nested else None, F.lit(float(s.row_fraction)) if subset else None, seed)
        m = m & held_for_stopping(early, seed)
        f = F.element_at("F", i + 1)
        loss = F.greatest(f, F.lit(0.0)) + F.log1p(F.exp(-F.abs(f))) - y * f
        aggs.append((F.sum(F.when(m, loss * n)) / F.sum(F.when(m, n))).alias(str(i)))
    row = state.agg(*aggs).first()
    return {int(k): float(v) if v is not None else 0.0 for k, v in row.asDict().items()}


def fit_boost(prep: DataFrame, kind: str, slots: list[BoostSlot], seed: int = 42,
              params: TreeParams | None = None, stages: list[int] | None = None,
              checkpoint_every: int = 10, early: EarlyStop | None = None) -> Fitted:
    """Gradient (``gbm``) or Newton (``newton``, ``leafwise``, ``hist``) boosting,
    one ensemble per slot.  ``stages``: also keep each slot's probability after
    that many trees (columns ``P_<n>``) — the staged-prefix reuse for grids
    whose ``n_estimators`` values are prefixes of each other.  ``early``: slots with
    enough rows retire one by one when their held-out loss no longer falls
    (``extra['rounds']``: trees per slot)."""
    facts = row_facts(prep)
    p = for_rows(params or BOOST_PRESETS[kind]["params"], prep, facts)
    S = len(slots)
    holds = [s.holdout for s in slots]
    d = facts.n_features
    nested = "inner" in prep.columns and any(s.inner_holdout >= 0 for s in slots)
    sampled = any(s.subsample < 1.0 for s in slots)
    subset = any(s.row_fraction < 1.0 for s in slots)
    grouped = not sampled and early is None and not is_raw(prep) and facts.rows >= LEAST_ROWS_GROUPED and (
        facts.different * LEAST_COPIES <= facts.rows)
    if grouped:
        # no row is drawn, so rows with equal bins have equal scores in every slot: one of them stands for all
        sums = [_row_mask(F.lit(s.holdout), F.lit(s.inner_holdout) if nested else None, F.lit(float(s.row_fraction)) if subset else None, seed)
                for s in slots]
        state = feature_groups(prep, sums, copies_of(prep)).persist(StorageLevel.MEMORY_AND_DISK)
        f0, stops = _group_rates(state, S), [False] * S
    else:
        f0, stops = _init_scores(prep, slots, seed, early)
        state = prep.select(*keep_cols(prep))
    stopping = any(stops)
    st = _State(state.withColumn("F", arr(f0)), checkpoint_every)
    static = {"hold": holds, "ss": [float(s.subsample) for s in slots],
              "rf": [float(s.row_fraction) for s in slots],
              "ihold": [int(s.inner_holdout) for s in slots], "es": stops}
    losses: list[list[float]] = [[] for _ in slots]
    retired: list[int | None] = [None] * S
    lrs = [float(s.lr) for s in slots]
    trees: list[tuple] = []
    newton = p.criterion == "newton"
    stages = sorted(set(stages or []))
    n_max = max(s.n_trees for s in slots)
    snaps: dict[int, Column] = {}
    for t in range(n_max):
        if stopping:
            for i, loss in _held_losses(st.df, slots, stops, early, nested, subset, seed).items():
                losses[i].append(loss)
                if retired[i] is None and early.retires(losses[i]):
                    retired[i] = t
        active = [t < s.n_trees and retired[i] is None for i, s in enumerate(slots)]
        if not any(active):
            break

        def row_sums(t=t):
            """The columns ``g, h, c, m``: unresolved, so made once and used for every level."""
            prob = 1.0 / (1.0 + F.exp(-F.col("F")))
            if grouped:
                n, g = F.col("N"), F.col("Q") - prob * F.col("K")
                return (-g if newton else g).alias("g"), (prob * (1.0 - prob) * n).alias("h"), n.alias("c"), (n > 0).alias("m")
            y = F.col("label").cast("double")
            m = _row_mask(F.col("hold"), F.col("ihold") if nested else None, F.col("rf") if subset else None, seed)
            if stopping:
                m = m & ~(F.col("es") & held_for_stopping(early, seed))
            n = copies_of(st.df)
            if sampled:                   # hash only when some slot subsamples
                n = over_copies(st.df, lambda u: (u < F.col("ss")).cast("double"), t, seed)
                m = m & (n > 0)
            g = (prob - y) if newton else (y - prob)
            return (g * n).alias("g"), (prob * (1.0 - prob) * n).alias("h"), n.alias("c"), m.alias("m")

        if t == 0 or sampled:             # only draws differ from tree to tree
            per_row = row_sums()
        grown, nodes = grow(st.df, S, static, ["F", "N", "K", "Q"] if grouped else ["F"], lambda ex: ex.select("*", *per_row), p, active, [s.max_depth for s in slots], d)

        def value(n: Node) -> float:
            return newton_leaf(n.G, n.H, p.lam) if newton else residual_leaf(n.G, n.H)

        for n in nodes:
            trees.append(tree_row(n, t, lrs[n.slot] * value(n), 1.0))
        lv = leaf_values(nodes, S, lambda n: lrs[n.slot] * value(n))
        new = grown.withColumn("_lv", lv).withColumn(
            "F", F.zip_with("F", "_lv", lambda a, b: a + b)).drop("_lv", "_node")
        if (t + 1) in stages:
            new = new.withColumn(f"F_{t + 1}", F.col("F"))
        st.replace(new)
    sig = lambda c: F.transform(c, lambda x: 1.0 / (1.0 + F.exp(-x)))
    out = st.df.drop("N", "K", "Q").withColumn("P", sig(F.col("F")))
    for n in stages:  # where all slots retired before a stage, their last scores are the stage's
        out = out.withColumn(f"P_{n}", sig(F.col(f"F_{n}" if f"F_{n}" in out.columns else "F")))
    extra = {"init": f0, "rounds": [s.n_trees if r is None else r for s, r in zip(slots, retired)]}
    if grouped:
        extra["groups"] = out
        out = with_group_scores(prep.select(*keep_cols(prep)), out)
    return Fitted(out, S, holds, trees, kind, extra)


def fit_boost_chunked(prep: DataFrame, kind: str, slots: list[BoostSlot], max_slots: int = 64,
                      **kw) -> Fitted:
    """``fit_boost`` over at most ``max_slots`` slots per run (bounded
    histogram map per task); chunks are joined on ``row_id`` — every fitted
    state keeps the prepared table's partitioning, so the join does not
    shuffle — and their probability arrays concatenated in slot order."""
    if len(slots) <= max_slots:
        return fit_boost(prep, kind, slots, **kw)
    fits = [fit_boost(prep, kind, slots[i:i + max_slots], **kw) for i in range(0, len(slots), max_slots)]
    pcols = [c for c in fits[0].scores.columns if c == "P" or c.startswith("P_")]
    base = fits[0].scores.select(*keep_cols(prep), *[F.col(c).alias(f"{c}__0") for c in pcols])
    for j, f in enumerate(fits[1:], start=1):
        base = base.join(f.scores.select("row_id", *[F.col(c).alias(f"{c}__{j}") for c in pcols]), "row_id")
    out = base.select(*keep_cols(prep), *[F.concat(*[F.col(f"{c}__{j}") for j in range(len(fits))]).alias(c)
                                          for c in pcols])
    trees, off = [], 0
    for f in fits:
        trees += [(t[0] + off,) + tuple(t[1:]) for t in f.trees]
        off += f.n_slots
    init = [v for f in fits for v in f.extra.get("init", [])]
    return Fitted(out, len(slots), [s.holdout for s in slots], trees, kind, {"init": init})


# ------------------------------------------------------------------ AdaBoost (SAMME)
class WorseThanChance(ValueError):
    """The first weak learner of a boosted ensemble has a weighted error of 0.5 or more."""


@dataclass
class AdaSlot:
    holdout: int = -1
    n_trees: int = 50
    lr: float = 1.0
    inner_holdout: int = -1


def _samme_probability(votes: Column, alpha_sum: list[float]) -> Column:
    """p₁ per slot from the votes Σ α(2h-1); 0.5 for a slot without a learner."""
    total, any_ = arr([a if a > 0 else 1.0 for a in alpha_sum]), arr([a > 0 for a in alpha_sum], "boolean")
    return F.transform(votes, lambda d, i: F.when(
        F.element_at(any_, i + 1), 1.0 / (1.0 + F.exp(-2.0 * (d / F.element_at(total, i + 1))))).otherwise(0.5))


def _samme_scores(state: DataFrame, alpha_sum: list[float], stages: list[int], sums: dict[int, list[float]]) -> DataFrame:
    """``P``, and ``P_<n>`` for every stage.  ``sums``: Σ α of the stages kept on the way (columns ``D_<n>``); where
    boosting ended before a stage, its votes are the last ones."""
    out = state.withColumn("P", _samme_probability(F.col("D"), alpha_sum))
    for n in stages:
        out = out.withColumn(f"P_{n}", _samme_probability(F.col(f"D_{n}" if n in sums else "D"), sums.get(n, alpha_sum)))
    return out


def fit_ada(prep: DataFrame, slots: list[AdaSlot], checkpoint_every: int = 10, stages: list[int] | None = None) -> Fitted:
    """Discrete SAMME with depth-1 stumps (weighted Gini), two classes.  ``stages``: also keep each
    slot's probability after that many stumps (``P_<n>``).

    err = misclassified weight / weight; α = lr·ln((1-err)/err);
    w ← w·exp(α·[y ≠ h]) / Z.  err = 0 keeps the stump with α = 1 and stops the
    slot; err ≥ 0.5 discards it and stops (in the first round that is an
    error: the learner is no better than chance).  d = Σ α(2h-1) / Σ α and
    p₁ = 1 / (1 + exp(-2d)).  The weighted errors and normalisers come from the
    stump's own leaf sums, so a round is a single pass.
    """
    S = len(slots)
    holds = [s.holdout for s in slots]
    inner = [int(s.inner_holdout) for s in slots]
    nested = "inner" in prep.columns and any(i >= 0 for i in inner)
    st = _State(prep.select(*keep_cols(prep))
                .withColumn("w", F.array_repeat(copies_of(prep), S))
                .withColumn("D", F.array_repeat(F.lit(0.0), S)), checkpoint_every)
    facts = row_facts(prep)
    p = for_rows(TreeParams("gini", max_depth=1), prep, facts)
    d = facts.n_features
    alive = [True] * S
    alpha_sum = [0.0] * S
    trees: list[tuple] = []
    stages = sorted(set(stages or []))
    sums: dict[int, list[float]] = {}
    w = F.col("w")
    per_row = ((w * F.col("label")).alias("g"), w.alias("h"), copies_of(prep).alias("c"),
               train_mask(F.col("hold"), F.col("ihold") if nested else None).alias("m"))
    for t in range(max(s.n_trees for s in slots)):
        active = [alive[i] and t < slots[i].n_trees for i in range(S)]
        if not any(active):
            break

        grown, nodes = grow(st.df, S, {"hold": holds, "ihold": inner}, ["w"], lambda ex: ex.select("*", *per_row), p, active, None, d)
        leaves = [n for n in nodes if n.feature is None]
        alpha = [0.0] * S
        z = [1.0] * S
        keep_slot = [False] * S
        for s in range(S):
            if not active[s]:
                continue
            ls = [n for n in leaves if n.slot == s]
            tot = sum(n.H for n in ls)
            if tot <= 0:
                alive[s] = False
                continue
            err = sum((n.H - n.G) if n.G > n.H - n.G else n.G for n in ls) / tot
            if err <= 0:
                alpha[s], keep_slot[s], alive[s] = 1.0, True, False
            elif err >= 0.5:
                if t == 0:
                    raise WorseThanChance(f"slot {s}: first-round error {err:.3f}")
                alive[s] = False
                continue
            else:
                alpha[s] = slots[s].lr * math.log((1 - err) / err)
                keep_slot[s] = True
            wrong = err * tot
            z[s] = (tot - wrong) + wrong * math.exp(alpha[s])
            alpha_sum[s] += alpha[s]
        kept = [n for n in leaves if keep_slot[n.slot]]
        for n in nodes:
            if keep_slot[n.slot]:
                trees.append(tree_row(n, t, 1.0 if n.G > n.H - n.G else 0.0, alpha[n.slot]))
        if not kept:
            continue
        hv = leaf_values(kept, S, lambda n: 1.0 if n.G > n.H - n.G else 0.0)
        al, zl = arr(alpha), arr(z)
        ks = arr(keep_slot, "boolean")
        upd = grown.withColumn("_h", hv)
        upd = upd.withColumn("D", F.transform("D", lambda d, i: d + F.element_at(al, i + 1)
                                              * (2.0 * F.element_at(F.col("_h"), i + 1) - 1.0)
                                              * F.when(F.element_at(ks, i + 1), 1.0).otherwise(0.0)))
        upd = upd.withColumn("w", F.transform("w", lambda w, i: F.when(
            F.element_at(ks, i + 1),
            w * F.exp(F.element_at(al, i + 1) * (F.element_at(F.col("_h"), i + 1)
                                                 != F.col("label").cast("double")).cast("double"))
            / F.element_at(zl, i + 1)).otherwise(w)))
        if t + 1 in stages:
            upd, sums[t + 1] = upd.withColumn(f"D_{t + 1}", F.col("D")), list(alpha_sum)
        st.replace(upd.drop("_h", "_node"))
    return Fitted(_samme_scores(st.df, alpha_sum, stages, sums), S, holds, trees, "ada", {"alpha_sum": alpha_sum})


# ------------------------------------------------------------------ forests
@dataclass
class ForestSpec:
    n_trees: int = 100
    max_depth: int | None = None        # None: no limit
    min_rows_split: int = 2
    min_rows_leaf: int = 1
    feature_k: int | None = None        # None → floor(sqrt(d))
    bootstrap: bool = True


def _forest_round(prep_state: DataFrame, holds: list[int], spec: ForestSpec, n_features: int,
                  seed: int, weight: str | None, round_id: int,
                  tree_ids: list[int] | None = None, of_rows: TreeParams | None = None) -> tuple[DataFrame, list[Node], Column]:
    """Grow the trees ``tree_ids`` of every model in one fused run; returns the
    grown state (``_lv`` = leaf value per slot) and per-model leaf-value sums.
    Bootstrap and feature choice hash (model, tree), never the slot number or the
    size of the forest, so a forest grown in chunks equals one grown at once and a
    smaller forest is the beginning of a larger one."""
    trees = tree_ids if tree_ids is not None else list(range(spec.n_trees))
    T = len(trees)
    S = len(holds) * T
    k = spec.feature_k or max(1, int(math.isqrt(n_features)))
    p = TreeParams("gini", max_depth=spec.max_depth, min_rows_leaf=spec.min_rows_leaf,
                   min_rows_split=spec.min_rows_split, feature_k=k if k < n_features else None,
                   seed=seed + 7919 * round_id,
                   slot_tags=[f"{s // T}|{trees[s % T]}" for s in range(S)],
                   **({"cells": of_rows.cells, "missing": of_rows.missing, "lone": of_rows.lone and S <= 64} if of_rows else {}))
    holds, inner = outer_inner(holds)
    nested = "inner" in prep_state.columns and any(i >= 0 for i in inner)
    static = {"hold": [holds[s // T] for s in range(S)], "ihold": [inner[s // T] for s in range(S)], "tree": [trees[s % T] for s in range(S)]}
    arrays = [weight] if weight else []

    salt = (F.lit(round_id), F.col("tree"), F.lit(seed))
    bw = over_copies(prep_state, poisson1, *salt) if spec.bootstrap else copies_of(prep_state)
    if spec.bootstrap and "copies" in prep_state.columns:
        c = over_copies(prep_state, lambda u: (poisson1(u) > 0).cast("double"), *salt)
    else:
        c = F.when(bw > 0, 1.0).otherwise(0.0) if spec.bootstrap else bw
    w = bw * (F.col(weight) / copies_of(prep_state) if weight else F.lit(1.0))
    per_row = ((w * F.col("label")).alias("g"), w.alias("h"), c.alias("c"),
               (train_mask(F.col("hold"), F.col("ihold") if nested else None) & (bw > 0)).alias("m"))

    if weight:
        # weights are per model; repeat them per tree so each slot sees its model's weight
        prep_state = prep_state.withColumn(weight, F.flatten(F.transform(
            F.col(weight), lambda x: F.array_repeat(x, T))))
    grown, nodes = grow(prep_state, S, static, arrays, lambda ex: ex.select("*", *per_row), p, None, None, n_features)
    lv = leaf_values(nodes, S, lambda n: n.G / n.H if n.H > 0 else 0.0)
    return grown.withColumn("_lv", lv), nodes, _model_sums("_lv", len(holds), T, T)


def _model_sums(values: str, models: int, trees: int, first: int) -> Column:
    """Per model, the sum over its first ``first`` trees; ``values`` holds models x trees entries.

    No lambda over the models: Spark would move the making of ``values`` (routing through all trees) into its body
    and do it anew for every model."""
    return F.array(*[F.aggregate(F.slice(F.col(values), m * trees + 1, first), F.lit(0.0), lambda a, b: a + b) for m in range(models)])


@dataclass(frozen=True)
class ForestVariant:
    """A forest contained in a larger run: fewer trees, less depth, a larger least size to split."""
    n_trees: int
    max_depth: int | None
    min_rows_split: int


def hull(spec: ForestSpec, variants: list[ForestVariant]) -> ForestSpec:
    """The run that contains all variants: most trees, greatest depth, least size to split."""
    deepest = None if any(v.max_depth is None for v in variants) else max(v.max_depth for v in variants)
    return replace(spec, n_trees=max(v.n_trees for v in variants), max_depth=deepest, min_rows_split=min(v.min_rows_split for v in variants))


def truncated(nodes: list[Node], max_depth: int | None, min_rows_split: int) -> list[Node]:
    """For every leaf, itself or the first node above it where growth would have stopped.

    A node's best split depends on its rows alone, so a tree grown with a smaller depth or a
    larger least size to split is the deeper tree cut off at such nodes."""
    by_index = {(n.slot, n.index): n for n in nodes}
    stop: dict[tuple, Node] = {}
    for n in sorted(nodes, key=lambda n: (n.slot, n.index)):  # parents come before their children
        own = stop.get((n.slot, n.index))
        if own is None and (n.feature is None or (max_depth is not None and n.depth >= max_depth) or n.C < min_rows_split):
            own = n
        if own is not None:
            stop[n.slot, n.index] = own
        if n.feature is not None and own is not None:
            for child in (n.left_index, n.left_index + 1):
                stop[n.slot, child] = own
    return [replace(by_index[key], G=n.G, H=n.H) for key, n in stop.items() if by_index[key].feature is None]


def fit_forest(prep: DataFrame, holdouts: list[int], spec: ForestSpec, n_features: int,
               seed: int = 42, max_slots: int = 256, variants: list[ForestVariant] | None = None) -> Fitted:
    """Random forest: trees of all fold models grow in the same passes, at most
    ``max_slots`` (model, tree) pairs per run so the per-task histogram map
    stays bounded; larger forests run in chunks and sum their leaf values.
    p₁ = mean over trees of the leaf's (bootstrap-weighted) class-1 share.

    ``variants``: forests to read off the same run (columns ``P_<i>``); the run grows
    their hull once.  Fewer trees are a prefix of the running sums, less depth or a larger
    least size to split are leaf values of the nodes where growth would have stopped."""
    if variants:
        spec = hull(spec, variants)
    own = [ForestVariant(spec.n_trees, spec.max_depth, spec.min_rows_split), *(variants or [])]
    M, T = len(holdouts), spec.n_trees
    per_run = max(1, max_slots // M)
    of_rows = for_rows(TreeParams("gini"), prep)
    ensure_checkpoint_dir(prep.sparkSession)
    accs = [f"_acc{v}" for v in range(len(own))]
    state = prep.select(*keep_cols(prep)).withColumns({a: F.array_repeat(F.lit(0.0), M) for a in accs})
    trees: list[tuple] = []
    held: list[DataFrame] = []
    for start in range(0, T, per_run):
        chunk = list(range(start, min(T, start + per_run)))
        C = len(chunk)
        grown, nodes, _ = _forest_round(state, holdouts, spec, n_features, seed, None, 0, chunk, of_rows)
        shapes: dict[tuple, str] = {}
        for v, variant in enumerate(own):
            taken = min(C, variant.n_trees - start)
            if taken <= 0:
                continue
            shape = (variant.max_depth, variant.min_rows_split)
            if shape not in shapes:
                shapes[shape] = f"_lv{len(shapes)}"
                values = leaf_values(truncated(nodes, *shape), M * C, lambda n: n.G / n.H if n.H > 0 else 0.0)
                grown = grown.withColumn(shapes[shape], values)
            sums = _model_sums(shapes[shape], M, C, taken)
            grown = grown.withColumn(accs[v], F.zip_with(accs[v], sums, lambda a, b: a + b))
        state = grown.drop("_lv", "_node", *shapes.values())
        if start + per_run < T:
            # lineage is cut between chunks; the chunk before is released once this one is written
            state = state.checkpoint(eager=True).persist(StorageLevel.MEMORY_AND_DISK)
            for old in held:
                old.unpersist()
            held = [state]
        trees += [tree_row(n, chunk[n.slot % C], n.G / n.H if n.H > 0 else 0.0, 1.0 / T, n.slot // C) for n in nodes]
    mean = lambda a, n: F.transform(a, lambda x: x / float(n))
    out = state.withColumn("P", mean(accs[0], T)).withColumns({f"P_{v}": mean(accs[v + 1], x.n_trees) for v, x in enumerate(variants or [])})
    return Fitted(out.drop(*accs), M, holdouts, trees, "forest")


@dataclass
class AdaForestSpec:
    forest: ForestSpec
    n_rounds: int = 50
    lr: float = 1.0


def fit_ada_forest(prep: DataFrame, holdouts: list[int], spec: AdaForestSpec, n_features: int,
                   seed: int = 42, checkpoint_every: int = 5, stages: list[int] | None = None) -> Fitted:
    """SAMME whose base learner is a weighted random forest (forest predict =
    mean class-1 share > 0.5).  One grower pass per level per round plus one
    aggregation for the weighted errors.  ``stages``: also keep the probability
    after that many rounds (``P_<n>``)."""
    M = len(holdouts)
    outer, inner = outer_inner(holdouts)
    nested = "inner" in prep.columns and any(i >= 0 for i in inner)
    st = _State(prep.select(*keep_cols(prep)).withColumn("w", F.array_repeat(copies_of(prep), M))
                .withColumn("D", F.array_repeat(F.lit(0.0), M)), checkpoint_every)
    alive = [True] * M
    alpha_sum = [0.0] * M
    trees: list[tuple] = []
    of_rows = for_rows(TreeParams("gini"), prep)
    stages = sorted(set(stages or []))
    sums: dict[int, list[float]] = {}
    for r in range(spec.n_rounds):
        if not any(alive):
            break
        grown, nodes, per_model = _forest_round(st.df, holdouts, spec.forest, n_features, seed, "w", r, of_rows=of_rows)
        # restore the per-model weight array (the round repeated it per tree)
        T = spec.forest.n_trees
        cur = grown.withColumn("_p", F.transform(per_model, lambda x: x / float(T))).withColumn(
            "w", F.array(*[F.element_at("w", m * T + 1) for m in range(M)]))
        cur = cur.withColumn("_h", F.transform("_p", lambda x: F.when(x > 0.5, 1.0).otherwise(0.0)))
        cur = cur.drop("_lv", "_node", "_p").persist(StorageLevel.MEMORY_AND_DISK)
        ex = cur.select("label", "split", "fold", *(["inner"] if nested else []),
                        F.posexplode(F.arrays_zip("w", "_h")).alias("m", "z"))
        hl, il = arr(outer, "int"), arr(inner, "int")
        errs = {int(x["m"]): (float(x["wrong"] or 0.0), float(x["tot"] or 0.0)) for x in
                ex.where(train_mask(F.get(hl, F.col("m")), F.get(il, F.col("m")) if nested else None))
                .groupBy("m").agg(F.sum(F.when(F.col("z._h") != F.col("label"), F.col("z.w"))).alias("wrong"),
                                  F.sum("z.w").alias("tot")).collect()}
        alpha, z, keep = [0.0] * M, [1.0] * M, [False] * M
        for m in range(M):
            if not alive[m] or m not in errs or errs[m][1] <= 0:
                alive[m] = False
                continue
            wrong, tot = errs[m]
            err = wrong / tot
            if err <= 0:
                alpha[m], keep[m], alive[m] = 1.0, True, False
            elif err >= 0.5:
                if r == 0:
                    raise WorseThanChance(f"model {m}: first-round error {err:.3f}")
                alive[m] = False
                continue
            else:
                alpha[m], keep[m] = spec.lr * math.log((1 - err) / err), True
            z[m] = (tot - wrong) + wrong * math.exp(alpha[m])
            alpha_sum[m] += alpha[m]
        trees += [tree_row(n, r * T + n.slot % T, n.G / n.H if n.H > 0 else 0.0, alpha[n.slot // T], n.slot // T, r)
                  for n in nodes if keep[n.slot // T]]
        al, zl, kl = arr(alpha), arr(z), arr(keep, "boolean")
        nxt = cur.withColumn("D", F.transform("D", lambda d, i: F.when(
            F.element_at(kl, i + 1), d + F.element_at(al, i + 1) * (2.0 * F.element_at(F.col("_h"), i + 1) - 1.0))
            .otherwise(d)))
        nxt = nxt.withColumn("w", F.transform("w", lambda w, i: F.when(
            F.element_at(kl, i + 1),
            w * F.exp(F.element_at(al, i + 1) * (F.element_at(F.col("_h"), i + 1)
                                                 != F.col("label").cast("double")).cast("double"))
            / F.element_at(zl, i + 1)).otherwise(w)))
        if r + 1 in stages:
            nxt, sums[r + 1] = nxt.withColumn(f"D_{r + 1}", F.col("D")), list(alpha_sum)
        st.replace(nxt.drop("_h"))
        cur.unpersist()
    return Fitted(_samme_scores(st.df, alpha_sum, stages, sums), M, holdouts, trees, "ada_forest", {"alpha_sum": alpha_sum})
