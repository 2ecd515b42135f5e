"""Hard negatives by Fagin's threshold algorithm over blocks of vectors.

Every row is a point with integer components ``floor(256 * x)``; a row's score for an
anchor is their inner product.  An anchor's positives are its best ``n_positives`` other
rows of the same label.  For each positive, the negatives are the best ``n_negatives``
rows of another label whose score lies in the window ``low% .. high%`` of the positive's
score.  Higher scores come first, ties by smaller id (null ids last).

Method.  Rows are packed into blocks of a bounded size; a block holds, per dimension, its
rows sorted by that component.  For an anchor, sorted access walks all lists at once, from
the large end where the anchor's component is positive and from the small end where it is
negative; rows met for the first time are scored by random access.  The threshold is the
score that a row at the current depth of every list would have: no unseen row has more.
A window is closed once the threshold falls strictly below its kth score (rows that tie
with it may have smaller ids) or below its lower end; the block is left when all windows
are closed.  The best of the blocks already read in the task count as well.

Spark: the blocks are a stored table, read once per pass and pass kind; a pass takes a
bounded number of anchors, broadcast (``anchors_per_pass``, and ``PASS_COMPONENTS``
components).  A task sends on at most k rows per window, so the merge sees
tasks x windows x k rows, in a window keyed by (anchor, positive).  The anchors are a
stated query set against all rows; nothing is sampled, capped or approximated.

Edge cases.  Rows with a null label, a null vector or any null or non-finite component take
no part.  A row with a null id can be a positive or a negative, not an anchor by its id.
Vectors of different lengths: the shorter counts as padded with zeros; empty vectors score
0.  Repeated rows are rows of their own: a copy of the anchor can be its positive, a copy of
an anchor has results of its own.  Scores are exact as long as they fit the
result's 64 bits; beyond, they count as the nearest 64-bit integer.  Other columns are not
read.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, work_path

BLOCK_COMPONENTS = 1 << 20      # rows x dimensions of a block
ANCHORS_PER_PASS = 16_384
PASS_COMPONENTS = 1 << 24       # anchors x dimensions of a pass
FIRST_DEPTH = 16
LONG = 2 ** 63

BLOCK = "block bigint, n int, dim int, ids array<bigint>, labels array<bigint>, anchors array<boolean>, points binary, lists binary"
FOUND = "a_block bigint, a_row int, place int, score bigint, id bigint"


# --- blocks -----------------------------------------------------------------------------
def _block(number: int, rows: list[tuple]) -> dict:
    """One packed block: integer-valued components (float64) and per-dimension ascending lists of row numbers."""
    dim = max((len(v) for *_, v in rows), default=0)
    points = np.zeros((len(rows), dim))
    for i, (*_, v) in enumerate(rows):
        points[i, :len(v)] = v
    lists = np.argsort(points, axis=0, kind="stable").T.astype(np.int32)
    return {"block": number, "n": len(rows), "dim": dim, "ids": [r[0] for r in rows], "labels": [r[1] for r in rows],
            "anchors": [r[2] for r in rows], "points": points.tobytes(), "lists": np.ascontiguousarray(lists).tobytes()}


def pack_blocks(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, is_anchor: Column,
                block_components: int = BLOCK_COMPONENTS) -> DataFrame:
    """The stored table of blocks; narrow, and dealt anew by blocks so that passes use all cores."""
    v = vectors[vector_col]
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(vectors[label_col].isNotNull() & v.isNotNull() & usable).select(
        vectors[id_col].cast("bigint").alias("id"), vectors[label_col].cast("bigint").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"), v.cast("array<double>").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0
        schema = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("dim", pa.int32()), ("ids", pa.list_(pa.int64())),
                            ("labels", pa.list_(pa.int64())), ("anchors", pa.list_(pa.bool_())),
                            ("points", pa.binary()), ("lists", pa.binary())])
        for b in batches:
            column = b.column(3)
            flat = np.floor(256.0 * column.values.to_numpy(zero_copy_only=False))
            ends = column.offsets.to_numpy()
            for i, (key, label, anchor) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())):
                point = flat[ends[i]:ends[i + 1]]
                if held and (len(held) + 1) * max(size, len(point), 1) > block_components:
                    yield pa.RecordBatch.from_pylist([_block(number, held)], schema)
                    number, held, size = number + 1, [], 0
                held.append((key, label, anchor, point))
                size = max(size, len(point))
        if held:
            yield pa.RecordBatch.from_pylist([_block(number, held)], schema)

    packed = stored(rows.mapInArrow(run, BLOCK), "vector-blocks-raw")
    return stored(packed.repartition(max(packed.sparkSession.sparkContext.defaultParallelism, 2 * packed.rdd.getNumPartitions())),
                  "vector-blocks")


class Block:
    """A block in a task."""

    def __init__(self, row: dict):
        self.number, self.n, self.dim = row["block"], row["n"], row["dim"]
        self.null_id = np.array([i is None for i in row["ids"]], bool)
        self.ids = np.array([0 if i is None else i for i in row["ids"]], np.int64)
        self.labels = np.array(row["labels"], np.int64)
        self.points = np.frombuffer(row["points"]).reshape(self.n, self.dim)
        self.lists = np.frombuffer(row["lists"], np.int32).reshape(self.dim, self.n)
        self.norm = float(np.sqrt((self.points ** 2).sum(axis=1).max())) if self.n and self.dim else 0.0
        self.small = self.points.astype(np.float32) if self.norm < 2 ** 24 else None

    def scorer(self, anchor: np.ndarray):
        """rows -> exact scores: in float32 or float64 where no partial sum can leave their integers, else in Python's integers."""
        m = min(len(anchor), self.dim)
        bound = self.norm * float(np.sqrt((anchor ** 2).sum())) * 1.01  # of the sum of |a_d * x_d| too (Cauchy-Schwarz)
        if bound < 2 ** 24 and self.small is not None:
            a = anchor[:m].astype(np.float32)
            return lambda rows: (self.small[rows, :m] if m < self.dim else self.small[rows]) @ a
        if bound < 2 ** 53:
            return lambda rows: self.points[rows, :m] @ anchor[:m]
        whole = [int(x) for x in anchor[:m]]
        return lambda rows: np.array([sum(int(x) * y for x, y in zip(self.points[r, :m], whole)) for r in rows], object)


# --- the threshold algorithm ----------------------------------------------------------------
def first_k(scores: np.ndarray, ids: np.ndarray, null_id: np.ndarray, k: int) -> list[tuple]:
    """The best k as (score, id or None): score descending, id ascending, nulls last."""
    if len(scores) > 4 * k:
        at_least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= at_least
        scores, ids, null_id = scores[near], ids[near], null_id[near]
    rows = [(int(s), None if z else int(i)) for s, i, z in zip(scores.tolist(), ids.tolist(), null_id.tolist())]
    rows.sort(key=_order)
    return rows[:k]


def _order(row: tuple) -> tuple:
    return -row[0], row[1] is None, row[1] or 0


def search(block: Block, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple], best: list[list[tuple]], k: int,
           first_depth: int = FIRST_DEPTH) -> int:
    """Update ``best`` (one list of (score, id) per window) with the block's allowed rows; returns the rows scored.

    ``windows``: (lowest, highest) score, None for no bound.
    """
    m = min(len(anchor), block.dim)
    up = np.flatnonzero(anchor[:m] > 0)
    down = np.flatnonzero(anchor[:m] < 0)
    score = block.scorer(anchor)
    met = np.zeros(block.n, bool)
    scored = np.zeros(0, np.int64)
    values = None
    depth, at = 0, min(first_depth, block.n)
    while True:
        before = met.copy()
        if len(up) + len(down):
            met[block.lists[up, block.n - at:block.n - depth].ravel()] = True
            met[block.lists[down, depth:at].ravel()] = True
        if at == block.n:
            met[:] = True
        new = np.flatnonzero(met & ~before & allowed)
        if len(new):
            got = score(new)
            scored = np.concatenate([scored, new])
            values = got if values is None else np.concatenate([values, got])
        if at == block.n or bool(met.all()):
            break
        # no unseen row exceeds this (float64, rounded up where its integers end)
        edge = float(anchor[up] @ block.points[block.lists[up, block.n - at], up] + anchor[down] @ block.points[block.lists[down, at - 1], down])
        edge += abs(edge) * 1e-9 if abs(edge) >= 2 ** 52 else 0.0
        if all(_closed(edge, w, own, values, k) for w, own in zip(windows, best)):
            break
        depth, at = at, min(4 * at, block.n)
    if values is not None:
        for w, (low, high) in enumerate(windows):
            fits = np.ones(len(values), bool)
            if low is not None:
                fits &= (values >= low) & (values <= high)
            if len(best[w]) == k:
                fits &= values >= best[w][-1][0]
            if fits.any():
                rows = scored[fits]
                best[w] = sorted(best[w] + first_k(values[fits], block.ids[rows], block.null_id[rows], k), key=_order)[:k]
    return len(scored)


def _closed(edge: float, window: tuple, own: list[tuple], values, k: int) -> bool:
    """No unseen row of the block can enter the window's first k."""
    low, high = window
    if low is not None and (edge < low or low > high):
        return True
    held = np.array([s for s, _ in own], object if own and abs(own[0][0]) >= 2 ** 53 else np.float64)
    if values is not None:
        inside = values if low is None else values[(values >= low) & (values <= high)]
        held = np.concatenate([held, inside])
    return len(held) >= k and edge < np.partition(held, len(held) - k)[len(held) - k]


def score_window(positive_score: int, low: int, high: int) -> tuple[int, int]:
    """Integer scores s with low * p <= 100 * s <= high * p."""
    return -((-low * positive_score) // 100), (high * positive_score) // 100


# --- Spark --------------------------------------------------------------------------------
def _pass(blocks: DataFrame, anchors, windows, k: int, same_label: bool) -> DataFrame:
    """Every task's first k rows per (anchor, window).

    ``anchors``: broadcast (block numbers, row numbers, labels, points); ``windows``: broadcast lists of windows per anchor.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_block, a_row, a_label, points = anchors.value
        wanted = windows.value
        best: list[list[list]] = [[[] for _ in w] for w in wanted]
        for b in batches:
            for row in b.to_pylist():
                block = Block(row)
                of_label = {x: block.labels == x for x in np.unique(block.labels)}
                none = np.zeros(block.n, bool)
                for i, own in enumerate(wanted):
                    if not own:
                        continue
                    allowed = of_label.get(a_label[i], none)
                    if not same_label:
                        allowed = ~allowed
                    elif a_block[i] == block.number:
                        allowed = allowed.copy()
                        allowed[a_row[i]] = False
                    search(block, points[i], allowed, own, best[i], k)
        out = [(int(a_block[i]), int(a_row[i]), w, max(-LONG, min(LONG - 1, s)), key)
               for i, lists in enumerate(best) for w, rows in enumerate(lists) for s, key in rows]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (
                pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["a_block", "a_row", "place", "score", "id"])

    found = blocks.select("block", "n", "dim", "ids", "labels", "points", "lists").mapInArrow(run, FOUND)
    order = Window.partitionBy("a_block", "a_row", "place").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                        label_col: str = "label", n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90,
                        block_components: int = BLOCK_COMPONENTS, anchors_per_pass: int = ANCHORS_PER_PASS) -> DataFrame:
    """``anchor_id, positive_id, positive_place, rank, negative_id, positive_score, negative_score``."""
    spark = vectors.sparkSession
    blocks = pack_blocks(vectors, id_col, vector_col, label_col, is_anchor, block_components)
    anchors = blocks.select("block", "dim", F.posexplode("anchors").alias("row", "chosen"), "ids", "labels", "points").where("chosen").select(
        "block", "row", F.get("ids", F.col("row")).alias("id"), F.get("labels", F.col("row")).alias("label"),
        F.substring("points", F.col("row") * F.col("dim") * 8 + 1, F.col("dim") * 8).alias("point"))
    anchors = stored(anchors, "anchors")
    count = anchors.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("point")).alias("b")).first()
    per_pass = max(1, min(anchors_per_pass, PASS_COMPONENTS // max(1, (count["b"] or 0) // 8)))
    passes = math.ceil(count["n"] / per_pass)
    # an anchor's pass is a hash of its place, so the passes are about equal; each is collected alone
    anchors = anchors.withColumn("pass", F.pmod(F.xxhash64("block", "row"), F.lit(max(passes, 1))).cast("int"))
    out = work_path(spark, "hard-negatives")
    schema = ("anchor_id bigint, positive_id bigint, positive_place int, rank int, negative_id bigint, "
              "positive_score bigint, negative_score bigint")
    spark.createDataFrame([], schema).write.parquet(out)
    for number in range(passes):
        rows = anchors.where(F.col("pass") == number).select("block", "row", "id", "label", "point").collect()
        if not rows:
            continue
        dim = max(len(r["point"]) for r in rows) // 8
        points = np.zeros((len(rows), dim))
        for i, r in enumerate(rows):
            points[i, :len(r["point"]) // 8] = np.frombuffer(r["point"])
        place = {(r["block"], r["row"]): i for i, r in enumerate(rows)}
        held = spark.sparkContext.broadcast((np.array([r["block"] for r in rows]), np.array([r["row"] for r in rows]),
                                             np.array([r["label"] for r in rows]), points))
        open_ = spark.sparkContext.broadcast([[(None, None)]] * len(rows))
        positives = [[] for _ in rows]
        for r in _pass(blocks, held, open_, n_positives, True).collect():  # at most n_positives rows an anchor
            positives[place[r["a_block"], r["a_row"]]].append((r["rank"], r["score"], r["id"]))
        for own in positives:
            own.sort()
        windows = spark.sparkContext.broadcast([[score_window(s, low, high) for _, s, _ in own] for own in positives])
        names = spark.createDataFrame(
            [(r["block"], r["row"], w, r["id"], p, s) for r, own in zip(rows, positives) for w, (_, s, p) in enumerate(own)],
            "a_block bigint, a_row int, place int, anchor_id bigint, positive_id bigint, positive_score bigint")
        negatives = _pass(blocks, held, windows, n_negatives, False)
        negatives.join(F.broadcast(names), ["a_block", "a_row", "place"]).select(
            "anchor_id", "positive_id", (F.col("place") + 1).alias("positive_place"), "rank", F.col("id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(out)
        for b in (held, open_, windows):
            b.destroy()
    return spark.read.schema(schema).parquet(out)
