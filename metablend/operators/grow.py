"""Fused histogram tree grower.

Many trees ("slots": fold models, grid configs, forest members) grow in the
same Spark job.  Each row of the state table carries its features
(``bins ARRAY<INT>``: binned; or ``ARRAY<DOUBLE>``: the raw values, cut exactly)
and one node number per slot (``_node ARRAY<INT>``; nodes are numbered per slot
in the order they are made, the two children of a split next to each other).
One pass per tree level:

1. explode the slots (``inline(arrays_zip(...))``), keep the rows whose node is
   on the frontier, let the learner attach a gradient ``g``, hessian/weight
   ``h``, count ``c`` and a training mask,
2. explode the bins (forests: only the features a node may try) and sum
   g, h, c per (frontier node, feature, bin) — one packed key, partial
   aggregation map-side, so the shuffle carries at most nodes x features x bins
   rows per task whatever the row count,
3. prefix-sum the bins with a window over that small histogram, score every
   cut with the learner's gain, and keep the best per node (ties → rounded
   gain, then lowest feature, then lowest bin); all of it in Spark, whatever
   the size of the histogram.  Missing values (null entries of ``bins``) are
   tried on both sides of every cut (a two-way scan) and of the cut between all
   known values and them; the better side is part of the split,
4. bring back only the chosen splits (one row per node) and move rows to their
   children: the splits are literal arrays indexed by slot and node number,
   so a row costs the same whatever the number of nodes.

Raw values have no bins: the table of step 2 has a row per (node, feature,
distinct value), which may be as long as the data.  Its prefix sums run in two
levels: values are dealt to cells at approximate quantiles of the feature (fixed
for the fit; they only balance the work), cell totals are summed up over at most
``N_CELLS`` rows per (node, feature), and the running sum stays within a cell.
The cut lies halfway between the two values of the node that it parts.

Depth-wise growth splits every admissible node per level.  Best-first growth
(a leaf budget) is exact: children of every open candidate are evaluated, the
best-first order is replayed on the (model-sized) node table, and the number
of passes is the depth of the tree.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, replace
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metablend.operators.literals import arr_sql
from metablend.operators.prefix import count_below

EPS_GAIN = 1e-12
N_CELLS = 1024
#: up to so many rows, in one partition, a level runs without exchanges
FEW_ROWS = 20_000


@dataclass
class TreeParams:
    criterion: str                 # newton | variance | gini
    max_depth: int | None = 3      # None: no limit (pure or small nodes stop)
    lam: float = 0.0               # L2 on leaf weights (newton)
    min_hess: float = 0.0          # minimum hessian sum per child (newton)
    min_rows_leaf: int = 1
    min_rows_split: int = 2
    max_leaves: int | None = None  # best-first budget
    feature_k: int | None = None   # features tried per node (forests)
    seed: int = 42
    slot_tags: list | None = None  # stable per-slot ids for feature hashing (chunked forests)
    cells: list | None = None      # raw values: ascending cell bounds per feature (``value_cells``)
    missing: bool = True           # False: no value is missing, so there are no sides to learn (``has_missing``)
    lone: bool = False             # the rows are few and lie in one partition: a level is one task, without exchanges


@dataclass
class Node:
    slot: int
    node: int                      # heap number (children 2n, 2n + 1): identity for hashing and ties
    G: float = 0.0
    H: float = 0.0
    C: float = 0.0
    feature: int | None = None
    cut: float | None = None       # a bin, or a raw value; known values above it go right
    missing_left: bool = False
    gain: float = 0.0
    left: tuple | None = None      # (G, H, C) of the left child
    right: tuple | None = None
    index: int = 0                 # number within the slot
    left_index: int | None = None  # the left child's number; the right child's is one more
    known: bool = False            # its own best split has been searched

    @property
    def depth(self) -> int:
        return self.node.bit_length() - 1


def _gain(p: TreeParams, GL: str, HL: str, GR: str, HR: str, CL: str, CR: str) -> str:
    """The learner's gain of a cut of a node (totals ``Gt Ht Ct``), as SQL text."""
    if p.criterion == "newton":
        lam = f"{float(p.lam)!r}D"
        return f"(0.5D * ({GL} * {GL} / ({HL} + {lam}) + {GR} * {GR} / ({HR} + {lam}) - Gt * Gt / (Ht + {lam})))"
    if p.criterion == "variance":
        return f"({GL} * {GL} / {CL} + {GR} * {GR} / {CR} - Gt * Gt / Ct)"
    # weighted Gini impurity decrease with g = positive weight, h = total weight
    return (f"(2.0D * Gt * (Ht - Gt) / Ht - 2.0D * {GL} * ({HL} - {GL}) / {HL} - 2.0D * {GR} * ({HR} - {GR}) / {HR})")


def _typ(v: list) -> str:
    if all(isinstance(x, bool) for x in v):
        return "boolean"
    if all(isinstance(x, int) and not isinstance(x, bool) for x in v):
        return "int"
    return "double"


def p_features(state: DataFrame) -> int:
    """Number of binned features (length of the ``bins`` array, one row read)."""
    row = state.select(F.size("bins").alias("d")).first()
    return int(row["d"]) if row is not None else 0


def explode_slots(state: DataFrame, n_slots: int, static: dict[str, list],
                  arrays: list[str], keep: list[str]) -> DataFrame:
    """One row per (row, slot) with the slot's static parameters and state (one SQL text: a level is made of few gateway calls)."""
    cols = {"slot": arr_sql(range(n_slots), "int"), **{k: arr_sql(v, _typ(v)) for k, v in static.items()}, "node": "_node", **{a: a for a in arrays}}
    return state.selectExpr(*keep, f"inline(arrays_zip({', '.join(cols.values())})) AS ({', '.join(cols)})")


def tried_features(p: TreeParams, slot: int, node: int, n_features: int) -> list[int]:
    """The ``feature_k`` features a forest node may try — a fixed hash of
    (seed, slot, node, feature), so it is the same wherever and however often
    it is computed."""
    tag = p.slot_tags[slot] if p.slot_tags is not None else slot
    ranked = sorted(range(n_features), key=lambda f: hashlib.blake2b(
        f"{p.seed}|{tag}|{node}|{f}".encode(), digest_size=8).digest())
    return sorted(ranked[:p.feature_k])


def nested_sql(values: list[list], t: str) -> str:
    """Literal ``ARRAY<ARRAY<t>>`` as SQL text, parsed once from one string and folded to a constant."""
    return f"from_json('{json.dumps(values)}', 'array<array<{t}>>')"


def nested(values: list[list], t: str) -> Column:
    """The same as a column."""
    return F.expr(nested_sql(values, t))


def _histogram(rows: DataFrame) -> DataFrame:
    return (rows.select("slot", "node", F.posexplode("bins").alias("f", "b"), "g", "h", "c")
            .groupBy("slot", "node", "f", "b")
            .agg(F.sum("g").alias("G"), F.sum("h").alias("H"), F.sum("c").alias("C")))


def is_raw(state: DataFrame) -> bool:
    """Do the rows carry raw values (doubles) rather than bins?"""
    return state.schema["bins"].dataType.elementType.typeName() == "double"


@dataclass(frozen=True)
class RowFacts:
    """What a fit must know of its rows, from one pass over them."""
    n_features: int
    missing: bool                  # is any value missing?  (Where none is, every level's search is half as long.)
    rows: int
    different: int                 # different rows of features, by an approximate count
    lone: bool = False             # few rows, all in one partition


def row_facts(state: DataFrame) -> RowFacts:
    r = state.select("bins", F.spark_partition_id().alias("at")).agg(
        F.max(F.size("bins")).alias("d"), F.max(F.exists("bins", lambda x: x.isNull())).alias("m"), F.count(F.lit(1)).alias("n"),
        F.approx_count_distinct(F.xxhash64("bins")).alias("u"), F.min("at").alias("from"), F.max("at").alias("to")).first()
    return RowFacts(int(r["d"] or 0), bool(r["m"]), int(r["n"]), int(r["u"]), r["n"] <= FEW_ROWS and r["from"] == r["to"])


def has_missing(state: DataFrame) -> bool:
    return row_facts(state).missing


def for_rows(p: TreeParams, prep: DataFrame, facts: RowFacts | None = None) -> TreeParams:
    """Growth settings with what the search must know of the rows."""
    facts = facts or row_facts(prep)
    return replace(p, cells=value_cells(prep), missing=facts.missing, lone=facts.lone)


def value_cells(state: DataFrame, n_cells: int = N_CELLS) -> list[list[float]] | None:
    """Cell bounds per feature for the exact search (None for binned rows): approximate quantiles
    from a mergeable sketch, at most ``n_cells`` per feature.  They do not influence any result."""
    if not is_raw(state):
        return None
    probs = [i / n_cells for i in range(1, n_cells)]
    rows = state.select(F.posexplode("bins").alias("f", "x")).where(F.col("x").isNotNull()).groupBy("f").agg(
        F.percentile_approx("x", probs, 10 * n_cells).alias("q")).collect()
    bounds: list[list[float]] = [[] for _ in range(p_features(state))]
    for r in rows:
        bounds[r["f"]] = sorted(set(r["q"]))
    return bounds


SUMS = ("G", "H", "C")


def _prefix_binned(hist: DataFrame, keys: tuple, missing: bool) -> DataFrame:
    """Per bin: sums up to it (``GL HL CL``), of the missing values (``Gm Hm Cm``) and of all (``Gt Ht Ct``)."""
    all_ = f"OVER (PARTITION BY {', '.join(keys)}, f)"
    upto = f"{all_[:-1]} ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    totals = [f"sum({s}) {all_} AS {s}t" for s in SUMS]
    if not missing:
        return hist.selectExpr(*keys, "f", "b", "b AS cut", *[f"sum({s}) {upto} AS {s}L" for s in SUMS], *totals)
    return hist.selectExpr(
        *keys, "f", "b", "b AS cut", *[f"sum(CASE WHEN b IS NOT NULL THEN {s} END) {upto} AS {s}L" for s in SUMS],
        *[f"coalesce(sum(CASE WHEN b IS NULL THEN {s} END) {all_}, 0.0D) AS {s}m" for s in SUMS], *totals)


def _prefix_raw(hist: DataFrame, keys: tuple, cells: list[list[float]]) -> DataFrame:
    """The same per distinct raw value, in two levels; ``cut`` lies halfway to the node's next value."""
    group = [*keys, "f"]
    bounds = F.get(nested(cells, "double"), F.col("f"))
    dealt = hist.withColumn("cell", F.when(F.col("b").isNotNull(), count_below(bounds, F.col("b"), max(map(len, cells), default=1))))
    totals = dealt.groupBy(*group, "cell").agg(*[F.sum(s).alias(f"{s}c") for s in SUMS], F.min("b").alias("first"))
    by_cell = Window.partitionBy(*group).orderBy("cell")  # the missing values (null cell) come first
    before = by_cell.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(*group)
    has = F.col("cell").isNotNull()
    offsets = totals.select(
        *group, "cell", *[F.coalesce(F.sum(F.when(has, F.col(f"{s}c"))).over(before), F.lit(0.0)).alias(f"{s}o") for s in SUMS],
        *[F.coalesce(F.sum(F.when(~has, F.col(f"{s}c"))).over(all_), F.lit(0.0)).alias(f"{s}m") for s in SUMS],
        *[F.sum(f"{s}c").over(all_).alias(f"{s}t") for s in SUMS], F.lead("first").over(by_cell).alias("later"))
    in_cell = Window.partitionBy(*group, "cell").orderBy("b")
    upto = in_cell.rowsBetween(Window.unboundedPreceding, 0)
    # the missing values' own row only carries totals: a node whose known values are all in no cell still has them
    running = dealt.withColumns({f"{s}r": F.sum(s).over(upto) for s in SUMS}).withColumn("next", F.lead("b").over(in_cell))
    o = offsets.select(*[F.col(c).alias(f"o_{c}") for c in (*group, "cell")], *[c for c in offsets.columns if c not in (*group, "cell")])
    on = [F.col(c).eqNullSafe(F.col(f"o_{c}")) if c == "cell" else F.col(c) == F.col(f"o_{c}") for c in (*group, "cell")]
    nxt = F.coalesce("next", "later")
    half = F.col("b") / 2 + nxt / 2
    return running.join(o, on).select(
        *group, "b", F.when(nxt.isNull() | (half >= nxt), F.col("b")).otherwise(half).alias("cut"),
        *[F.when(F.col("b").isNotNull(), F.col(f"{s}o") + F.col(f"{s}r")).alias(f"{s}L") for s in SUMS],
        *[f"{s}m" for s in SUMS], *[f"{s}t" for s in SUMS])


def split_candidates(hist: DataFrame, p: TreeParams, keys: tuple = ("slot", "node")) -> DataFrame:
    """Split search over a histogram ``(*keys, f, b, G, H, C)`` (b: bin, or raw value if
    ``p.cells`` is given; null: missing): prefix sums per (node, feature), the learner's
    gain with the missing values on either side, and the best admissible cut per (node,
    feature) as a struct ``best`` (ties: rounded gain, then lowest feature, lowest bin,
    missing values to the right).  A split without missing values in its node sends them
    to the child with more rows (to the left if equal)."""
    h2 = _prefix_binned(hist, keys, p.missing) if p.cells is None else _prefix_raw(hist, keys, p.cells)

    def cand(GL: str, HL: str, CL: str, left: str) -> str:
        GR, HR, CR = f"(Gt - {GL})", f"(Ht - {HL})", f"(Ct - {CL})"
        valid = f"{CL} >= {p.min_rows_leaf} AND {CR} >= {p.min_rows_leaf} AND Ct >= {p.min_rows_split}"
        if p.criterion == "newton":
            valid += f" AND {HL} >= {float(p.min_hess)!r}D AND {HR} >= {float(p.min_hess)!r}D"
        if p.criterion == "gini":
            valid += f" AND {HL} > 0 AND {HR} > 0"
        gain = _gain(p, GL, HL, GR, HR, CL, CR)
        return (f"CASE WHEN {valid} AND {gain} > {EPS_GAIN!r}D THEN named_struct('rg', round({gain}, 9), 'nf', -f, 'nb', -b, "
                f"'to_right', NOT ({left}), 'cut', cut, 'missing_left', {left}, 'gain', {gain}, "
                f"'GL', {GL}, 'HL', {HL}, 'CL', {CL}, 'GR', {GR}, 'HR', {HR}, 'CR', {CR}) END")

    none = "Cm <= 0" if p.missing else "true"
    right = cand("GL", "HL", "CL", f"{none} AND CL * 2 >= Ct")
    totals = [F.expr(f"first({s}t) AS {s}") for s in SUMS]
    # grouping by the window's own partition keys adds no exchange
    if not p.missing:
        return h2.groupBy(*keys, "f").agg(*totals, F.expr(f"max({right}) AS best"))
    left = f"CASE WHEN NOT ({none}) THEN {cand('(GL + Gm)', '(HL + Hm)', '(CL + Cm)', 'true')} END"
    best = h2.groupBy(*keys, "f").agg(*totals, F.expr(f"max({right}) AS r"), F.expr(f"max({left}) AS l"))
    return best.select(*keys, "f", "G", "H", "C", F.greatest("l", "r").alias("best"))


def _search(rows: DataFrame, p: TreeParams, n_features: int, tried: list | None) -> list:
    """Best split of every frontier node; ``rows`` carry ``_base`` (what makes a slot's node numbers
    places on the whole frontier), ``node, bins, g, h, c``.  One row per node comes back."""
    lone = p.lone and p.cells is None
    if lone:
        rows = rows.coalesce(1)
    k = "_base + CAST(node AS BIGINT) AS k"
    if tried is None:
        one = rows.selectExpr(k, "posexplode(bins) AS (f, b)", "g", "h", "c")
    else:
        one = rows.selectExpr(k, "bins", "g", "h", "c").selectExpr(
            "k", "bins", "g", "h", "c", f"explode(get({nested_sql(tried, 'int')}, CAST(k AS INT))) AS f").selectExpr(
            "k", "f", "get(bins, f) AS b", "g", "h", "c")
    # node and feature in one long (exact: fewer than 2^63 pairs fit any table), the bin as it is
    hist = one.groupBy(F.expr(f"k * {n_features}L + f AS kf"), "b").agg(
        F.expr("sum(g) AS G"), F.expr("sum(h) AS H"), F.expr("sum(c) AS C")).selectExpr(
        f"kf div {n_features} AS k", f"CAST(kf % {n_features} AS INT) AS f", "b", "G", "H", "C")
    if p.cells is None and not lone:
        hist = hist.repartition("k")
    best = split_candidates(hist, p, keys=("k",)).groupBy("k").agg(
        F.expr("first(G) AS G"), F.expr("first(H) AS H"), F.expr("first(C) AS C"), F.expr("max(best) AS best"))
    return best.collect()


def _route(trees: list[list[Node]], split, state: DataFrame) -> Column:
    """Each row's node per slot: from the root through the nodes for which ``split`` holds, by look-ups in
    arrays indexed by slot and node number.  One expression, whose size does not grow with the depth."""
    tables: tuple = ([], [], [], [])
    steps = 0
    for own in trees:
        feature, cut, left, missing = [], [], [], []
        for n in own:
            on = split(n)
            steps = max(steps, n.depth + 1) if on else steps
            feature.append(n.feature if on else None)
            cut.append(n.cut if on else None)
            left.append(n.left_index if on else None)
            missing.append(n.missing_left if on else None)
        for table, values in zip(tables, (feature, cut, left, missing)):
            table.append(values)
    if not steps:
        return F.array_repeat(F.lit(0), len(trees))
    fl, cl, ll, ml = (f"get({nested_sql(t, k)}, i)" for t, k in zip(tables, ("int", "double" if is_raw(state) else "int", "int", "boolean")))
    step = (f"CASE WHEN get({fl}, n) IS NULL THEN n ELSE get({ll}, n) + "
            f"CAST(coalesce(get(bins, get({fl}, n)) > get({cl}, n), NOT get({ml}, n)) AS INT) END")
    return F.expr(f"transform(sequence(0, {len(trees) - 1}), i -> aggregate(sequence(1, {steps}), 0, (n, t) -> {step}))")


def grow(state: DataFrame, n_slots: int, static: dict[str, list], arrays: list[str],
         gh, p: TreeParams, active: list[bool] | None = None,
         max_depth: list[int | None] | None = None,
         n_features: int | None = None) -> tuple[DataFrame, list[Node]]:
    """Grow one tree per slot.

    ``gh(df)`` receives the exploded (row, slot) rows and must return them
    with ``g, h, c`` (doubles) and ``m`` (training mask).  Returns the state
    with ``_node`` = each row's leaf per slot, and every node of every slot
    (a node with ``feature is None`` is a leaf).
    """
    keep = [c for c in ("row_id", "label", "split", "fold", "inner", "copies", "bins") if c in state.columns]
    caps = max_depth or [p.max_depth] * n_slots
    act = active or [True] * n_slots
    rows = state
    n_features = n_features or p_features(state)
    trees: list[list[Node]] = [[Node(s, 1)] if act[s] else [] for s in range(n_slots)]

    def moved(split=lambda n: n.left_index is not None) -> DataFrame:
        """The rows with the nodes that the splits made so far send them to."""
        return rows.withColumn("_node", _route(trees, split, rows))

    state = moved()

    def may_split(n: Node) -> bool:
        return caps[n.slot] is None or n.depth < caps[n.slot]

    def search(frontier: list[list[Node]]) -> None:
        """Fill in totals and best splits of the frontier's nodes."""
        # a slot's frontier is a run of node numbers [_off, _end)
        off = [f[0].index if f else 0 for f in frontier]
        end = [o + len(f) for o, f in zip(off, frontier)]
        base = [b - o for b, o in zip(accumulate([0] + [len(f) for f in frontier]), off)]
        order = [n for f in frontier for n in f]
        tried = None
        if p.feature_k is not None:
            tried = [tried_features(p, n.slot, n.node, n_features) for n in order]
        ex = explode_slots(state, n_slots, {**static, "_off": off, "_end": end, "_base": base}, arrays, keep).where("node >= _off AND node < _end")
        for r in _search(gh(ex).where("m"), p, n_features, tried):
            n = order[int(r["k"])]
            n.G, n.H, n.C = float(r["G"]), float(r["H"]), float(r["C"])
            b = r["best"]
            if b is not None:
                n.feature, n.cut, n.gain = -int(b["nf"]), b["cut"], float(b["gain"])
                n.missing_left = bool(b["missing_left"])
                n.left = (float(b["GL"]), float(b["HL"]), float(b["CL"]))
                n.right = (float(b["GR"]), float(b["HR"]), float(b["CR"]))
        for n in order:
            n.known = True

    def split(nodes: list[Node]) -> list[list[Node]]:
        """Make the children; returns them by slot (numbered in a row)."""
        made: list[list[Node]] = [[] for _ in range(n_slots)]
        for n in sorted(nodes, key=lambda n: (n.slot, n.index)):
            own = trees[n.slot]
            n.left_index = len(own)
            for side, stats in ((0, n.left), (1, n.right)):
                child = Node(n.slot, 2 * n.node + side, *stats, index=len(own))
                own.append(child)
                made[n.slot].append(child)
        return made

    frontier = [list(t) for t in trees]
    if p.max_leaves is None:
        while any(frontier):
            search(frontier)
            splits = [n for f in frontier for n in f if n.feature is not None]
            children = split(splits)
            state = moved()
            # children at the depth cap are leaves; their totals are known from the split
            frontier = [c if c and may_split(c[0]) else [] for c in children]
        return state, [n for t in trees for n in t]

    chosen: list[set[int]] = [set() for _ in range(n_slots)]
    while any(frontier):
        search(frontier)
        for f in frontier:
            for n in f:
                if not may_split(n):
                    n.feature = None
        blocked = []
        for s in range(n_slots):
            chosen[s], wait = _replay(trees[s], p.max_leaves)
            blocked += wait
        children = split(blocked)
        state = moved()
        frontier = children
    out: list[Node] = []
    for s in range(n_slots):
        # splits made in advance of the best-first order are not part of the tree
        kept: set[int] = {0}
        for n in trees[s]:
            if n.index not in kept:
                continue
            if n.index in chosen[s]:
                kept |= {n.left_index, n.left_index + 1}
            else:
                n.feature = None
            out.append(n)
    return moved(lambda n: n.index in chosen[n.slot]), out


def _replay(tree: list[Node], budget: int) -> tuple[set[int], list[Node]]:
    """Best-first order over one slot's evaluated nodes: the splits chosen so far, and the
    candidates whose children must be evaluated before the order can go on."""
    open_ = [tree[0]] if tree else []
    chosen: set[int] = set()
    leaves = 1
    while leaves < budget:
        cands = [n for n in open_ if n.feature is not None]
        if not cands:
            break
        b = max(cands, key=lambda n: (round(n.gain, 9), -n.node))
        if b.left_index is None:
            return chosen, [n for n in cands if n.left_index is None]
        open_.remove(b)
        open_ += [tree[b.left_index], tree[b.left_index + 1]]
        chosen.add(b.index)
        leaves += 1
    return chosen, []


def leaf_values(nodes: list[Node], n_slots: int, value) -> Column:
    """Per-row array (one entry per slot) of the value of the row's leaf."""
    table: list[list] = [[] for _ in range(n_slots)]
    for n in sorted((n for n in nodes if n.feature is None), key=lambda n: n.index):
        own = table[n.slot]
        own += [None] * (n.index - len(own))
        own.append(float(value(n)))
    return F.expr(f"transform(_node, (n, i) -> coalesce(get(get({nested_sql(table, 'double')}, i), n), 0.0D))")
