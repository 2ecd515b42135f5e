"""Near-duplicates by BagMinHash signatures over weighted word shingles.

A document is the multiset of its five-word shingles (a text of fewer words is one shingle).
Every unit of weight of a shingle carries Poisson points (value, register); register r of a
signature is the smallest value among the points up to the shingle's weight.  Weights are
discretised to whole counts and covered by doubling intervals [0,1), [1,2), [2,4), ...: one process
per interval, thinned where the weight ends inside it, so a shingle of weight w costs about log w
processes, and each process stops as soon as its value exceeds the document's largest register.
Equal registers have the probability of the weighted Jaccard similarity.

Steps: texts with equal word sequences are one node (128-bit key); bands of registers
give buckets; in a bucket all nodes are compared with a leader (the node that meets most others over
all its buckets, so the one nearest to what a family shares), not with each other.  Links are pairs whose
multiset overlap, recomputed from the shingles, is at least ``threshold``.  Connected nodes need no more
comparing; a leader that has met its bucket leaves it; buckets that still hold several components get another
one.  What is still apart after ``ROUNDS`` leaders is compared between components wherever a longer signature
(``FINE_REGISTERS``) agrees as often as a link's does less four standard deviations (a link fails that once
in 30,000 times).  Classes are the components.

Scale: passes over the texts are narrow; a task emits a node once, however many copies it
holds; what is shuffled are bands, and the shingles of nodes that share a bucket.  Tasks know those from a
bitmap of ``2**WANTED_BITS`` bits over hashes of nodes, so the shingles of all others are never shuffled;
a join drops the few that only share a bit.

Edge cases: null texts read as empty; texts without words are copies if their bytes are equal, and near no
other text; null ids are members of classes, and a class of null ids only has a null class id; rows that
repeat id and text are the same document; ties at exactly the threshold are links; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import checkpointed, stored
from .components import components
from .words import Words, mix64, range_hash, word_slices

SHINGLE = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 32, 5
ROUNDS = 2
FINE_REGISTERS = 640
POINTS_AT_ONCE = 1 << 18
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)
WANTED_BITS = 27  # log2 of the bits of the filter of nodes that share a bucket (16 MB, whatever the input)
CODE_BYTES = 5  # bytes of a shingle code kept for the overlap


def _row_bounds(part: Words) -> np.ndarray:
    return np.searchsorted(part.row, np.arange(part.n_rows + 1))


def _sum_by_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def shingles(part: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, 64-bit code, count) of the distinct shingles of each row, ordered by row and code."""
    bounds = _row_bounds(part)
    n_words = np.diff(bounds)
    h = part.hash
    starts = np.flatnonzero(np.arange(len(h)) + size <= bounds[part.row + 1]) if len(h) else np.zeros(0, np.int64)
    code = np.zeros(len(starts), np.uint64)
    for k in range(size):
        code += h[starts + k] * np.uint64((2 * k + 1) * int(_ODD) % (1 << 64))
    row = part.row[starts]
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(short):
        place = np.arange(len(h)) - bounds[part.row]
        whole = _sum_by_row(mix64(h + place.astype(np.uint64) * _GOLD), bounds)
        row, code = np.concatenate([row, short]), np.concatenate([code, whole[short] ^ _GOLD])
    code = mix64(code)
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    if not len(row):
        return row, code, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])]))
    return row[first], code[first], np.diff(np.concatenate([first, [len(row)]]))


def signatures(row: np.ndarray, code: np.ndarray, count: np.ndarray, n_rows: int,
               m: int = BANDS * BAND_ROWS) -> np.ndarray:
    """n_rows x m identifiers of the smallest point of each register (0 for rows without shingles)."""
    value = np.full(n_rows * m, np.inf)
    ident = np.zeros(n_rows * m, np.uint64)
    worst = np.full(n_rows, np.inf)
    start, level = 0, 0
    while True:
        width = 1 if start == 0 else start
        at = np.flatnonzero(count > start)
        if not len(at):
            break
        seed = mix64(code[at] + np.uint64(level * int(_ODD) % (1 << 64)))
        r, left = row[at], (count[at] - start).astype(np.float64)
        x, rate, done = np.zeros(len(at)), float(width * m), 0
        while len(r):
            block = int(np.clip(POINTS_AT_ONCE // len(r), 1, 128))
            rnd = mix64(seed[:, None] + (np.arange(done + 1, done + block + 1, dtype=np.uint64) * _GOLD)[None, :])
            gap = -np.log1p(-((rnd >> np.uint64(11)).astype(np.float64) * 2.0 ** -53)) / rate
            gap[:, 0] += x
            xs = np.cumsum(gap, axis=1)
            other = mix64(rnd ^ _ODD)
            good = xs < worst[r][:, None]
            if width > 1:  # the interval goes on beyond the weight: keep points below it
                height = np.floor((other >> np.uint64(32)).astype(np.float64) * 2.0 ** -32 * width)
                good &= height < left[:, None]
            i, j = np.nonzero(good)
            slot = r[i] * m + (other[i, j] & np.uint64(0xFFFFFFFF)).astype(np.int64) % m
            v = xs[i, j]
            np.minimum.at(value, slot, v)
            won = value[slot] == v
            ident[slot[won]] = rnd[i, j][won]
            rows = np.unique(r)
            worst[rows] = value.reshape(n_rows, m)[rows].max(axis=1)
            x = xs[:, -1]
            live = x < worst[r]
            seed, r, left, x = seed[live], r[live], left[live], x[live]
            done += block
        start, level = start + width, level + 1
    return ident.reshape(n_rows, m)


def band_keys(ident: np.ndarray, bands: int = BANDS, band_rows: int = BAND_ROWS) -> np.ndarray:
    """n_rows x bands keys of the register groups."""
    part = ident.reshape(len(ident), bands, band_rows)
    odd = (np.arange(band_rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * _ODD
    return mix64((part * odd).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)[None, :] * _GOLD)


def register_codes(ident: np.ndarray) -> np.ndarray:
    """4 bits of every register, 16 registers to a 64-bit number."""
    nibble = (ident >> np.uint64(40)) & np.uint64(15)
    shift = (np.arange(16, dtype=np.uint64) * np.uint64(4))[None, None, :]
    return (nibble.reshape(len(ident), -1, 16) << shift).sum(axis=2, dtype=np.uint64)


def alike(a: str, b: str, threshold: float, m: int) -> str:
    """SQL: whether the register codes of two nodes agree as often as those of a pair at the threshold
    do, less four standard deviations (chance agreement of 4 bits included)."""
    p = threshold + (1 - threshold) / 16
    least = m * p - 4 * (m * p * (1 - p)) ** 0.5
    differ = []
    for k in range(m // 16):
        x = f"({a}[{k}] ^ {b}[{k}])"
        spread = " | ".join([x, *(f"shiftrightunsigned({x}, {i})" for i in (1, 2, 3))])
        differ.append(f"bit_count(({spread}) & {0x1111111111111111}L)")
    return f"({' + '.join(differ)}) <= {int(m - least)}"


def node_keys(part: Words) -> np.ndarray:
    """16-byte keys, equal for equal word sequences; of the raw bytes for texts without words."""
    bounds = _row_bounds(part)
    n = np.diff(bounds)
    place = (np.arange(len(part.hash)) - bounds[part.row]).astype(np.uint64)
    a = mix64(_sum_by_row(mix64(part.hash + place * _GOLD), bounds) + n.astype(np.uint64))
    b = mix64(_sum_by_row(mix64((part.hash ^ _ODD) * (place * np.uint64(2) + np.uint64(1))), bounds) ^ _GOLD)
    none = np.flatnonzero(n == 0)
    if len(none):
        raw = range_hash(part.buf, part.offsets[none], part.offsets[none + 1])
        a[none], b[none] = mix64(raw ^ _ODD), mix64(raw + _GOLD)
    return np.stack([a, b], axis=1)


def _binary(rows: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(rows).tobytes()
    size = rows.dtype.itemsize * rows.shape[1]
    return pa.array([raw[k:k + size] for k in range(0, len(raw), size)], pa.binary())


def _lists(rows: np.ndarray, own: np.ndarray) -> pa.Array:
    """One list per row, empty where ``own`` is false."""
    offsets = np.concatenate([[0], np.cumsum(own * rows.shape[1])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows[own]).ravel().view(np.int64)))


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, th, node, bands`` of every document (bands empty for texts without words)."""
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("th"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in word_slices(batch.column(2)):
                ident = signatures(*shingles(part), part.n_rows)
                own = np.diff(_row_bounds(part)) > 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.row0, part.n_rows), batch.column(1).slice(part.row0, part.n_rows),
                     _binary(node_keys(part)), _lists(band_keys(ident), own)],
                    ["id", "th", "node", "bands"])

    return rows.mapInArrow(run, StructType([StructField("id", docs.schema[id_col].dataType), *StructType.fromDDL(
        "th bigint, node binary, bands array<bigint>").fields]))


def _bit_of(keys: np.ndarray) -> np.ndarray:
    """Place of each node in the bitmap: the first ``WANTED_BITS`` bits of its key."""
    return (np.ascontiguousarray(keys).view(">u4")[:, 0] >> np.uint32(32 - WANTED_BITS)).astype(np.int64)


def wanted_bitmap(wanted: DataFrame) -> np.ndarray:
    """Bitmap of the nodes in ``wanted``, made in Spark; at most 2**WANTED_BITS / 32768 rows of 4 KB come back."""
    place = F.shiftright(F.conv(F.hex(F.substring("node", 1, 4)), 16, 10).cast("long"), 32 - WANTED_BITS)
    parts = wanted.select(place.alias("p")).groupBy(F.expr("p div 32768").alias("block")).agg(
        F.bitmap_construct_agg(F.col("p") % 32768).alias("bits"))
    out = np.zeros(1 << WANTED_BITS - 3, np.uint8)
    for r in parts.toLocalIterator():
        out[r["block"] * 4096:(r["block"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def node_shingles(docs: DataFrame, text_col: str, bitmap) -> DataFrame:
    """``node, codes`` of the nodes in the broadcast ``bitmap``: the shingle multiset (occurrences told apart) as
    sorted 5-byte codes; once per task and node."""
    rows = docs.select(F.coalesce(docs[text_col], F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in word_slices(batch.column(0)):
                keys = node_keys(part)
                at = _bit_of(keys)
                asked = np.flatnonzero(bitmap.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                if not len(asked):
                    continue
                row, code, count = shingles(part)
                bounds = np.searchsorted(row, np.arange(part.n_rows + 1))
                keep, codes = [], []
                for k in asked:
                    a, b, node = bounds[k], bounds[k + 1], keys[k].tobytes()
                    if a == b or node in seen:
                        continue
                    seen.add(node)
                    keep.append(node)
                    codes.append(pack_codes(code[a:b], count[a:b]))
                if keep:
                    yield pa.RecordBatch.from_arrays([pa.array(keep, pa.binary()), pa.array(codes, pa.binary())],
                                                     ["node", "codes"])

    return rows.mapInArrow(run, "node binary, codes binary")


def pack_codes(code: np.ndarray, count: np.ndarray) -> bytes:
    which = np.repeat(np.arange(len(code)), count)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    each = mix64(code[which] + nth.astype(np.uint64) * _GOLD) & np.uint64((1 << (8 * CODE_BYTES)) - 1)
    each.sort()
    return each.view(np.uint8).reshape(-1, 8)[:, :CODE_BYTES].tobytes()


def unpack_codes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // CODE_BYTES, 8), np.uint8)
    out[:, :CODE_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, CODE_BYTES)
    return out.view(np.uint64).ravel()


def fine_signatures(codes: DataFrame) -> DataFrame:
    """``sn, sig``: register codes of a longer signature of each node, from its shingle codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                lists = [unpack_codes(x.as_py()) for x in part.column(1)]
                row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                code = mix64(np.concatenate(lists))  # occurrences are told apart, so every weight is 1
                ident = signatures(row, code, np.ones(len(code), np.int64), len(lists), FINE_REGISTERS)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(register_codes(ident), np.ones(len(lists), bool))],
                                                 ["sn", "sig"])

    return codes.select("node", "codes").mapInArrow(run, "sn binary, sig array<bigint>")


def overlap(a: bytes, b: bytes, threshold: float = THRESHOLD) -> float:
    """Weighted Jaccard similarity: shared over all occurrences of shingles (0 if the sizes alone keep it well below the threshold)."""
    x, y = unpack_codes(a), unpack_codes(b)
    if len(x) > len(y):
        x, y = y, x
    if len(x) < threshold / 2 * len(y):
        return 0.0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return both / (len(x) + len(y) - both)


def verified(pairs: DataFrame, codes: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs (a, b, ca, cb) the components (ca, cb) of those whose multiset overlap reaches the threshold."""
    left, right = codes.select(F.col("node").alias("na"), F.col("codes").alias("xa")), \
        codes.select(F.col("node").alias("nb"), F.col("codes").alias("xb"))
    both = pairs.join(right, pairs["b"] == right["nb"]).join(left, pairs["a"] == left["na"]).select("ca", "cb", "xa", "xb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([overlap(x.as_py(), y.as_py(), threshold) >= threshold for x, y in zip(batch.column(2), batch.column(3))],
                            pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(keep)

    return both.mapInArrow(run, "a binary, b binary")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           threshold: float = THRESHOLD, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: ``id, th, class_id, class_size``; ``class_id`` is the smallest id of the class.

    ``th`` is xxhash64 of the text: with the id it finds the row again.
    """
    rows = stored(sketch(docs, id_col, text_col), "sketches")
    # one row per (bucket, node); a node's copies have the same bands
    members = rows.select("node", F.posexplode("bands").alias("band", "key")).distinct()
    crowded = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.col("band").alias("cb"), F.col("key").alias("ck"), "n")
    members = stored(members.join(crowded, (F.col("band") == F.col("cb")) & (F.col("key") == F.col("ck")))
                     .select("band", "key", "node", "n"), "bucket-members")
    # centrality: how many others a node meets over all its buckets
    wanted = stored(members.groupBy("node").agg(F.sum("n").alias("met")), "bucket-nodes")
    members = members.join(wanted.withColumnRenamed("node", "in"), members["node"] == F.col("in")).select(
        "band", "key", "node", F.col("node").alias("comp"), "met")
    bitmap = docs.sparkSession.sparkContext.broadcast(wanted_bitmap(wanted))
    codes = node_shingles(docs, text_col, bitmap)
    wn = wanted.select(F.col("node").alias("wn"))
    codes = stored(codes.join(wn, codes["node"] == F.col("wn")).groupBy("node")
                   .agg(F.first("codes").alias("codes")), "shingle-codes")
    bitmap.unpersist()  # not destroyed: a lost executor may ask for it again
    labels = wn.select(F.col("wn").alias("node"), F.col("wn").alias("comp"))
    for r in range(rounds + 1):
        mark = F.struct("met", "node", "comp")
        leaders = members.groupBy("band", "key").agg(F.max(mark).alias("lead"), F.min("comp").alias("c0"),
                                                     F.max("comp").alias("c1")).where("c0 <> c1")
        leaders = leaders.select(F.col("band").alias("lb"), F.col("key").alias("lk"), "lead")
        met = members.join(leaders, (F.col("band") == F.col("lb")) & (F.col("key") == F.col("lk")))
        if r < rounds:
            # the leader meets all of its bucket now, so it leaves it; settled buckets are gone
            rest = stored(met.where(F.col("node") != F.col("lead.node")).select(
                "band", "key", "node", "comp", "met", F.col("lead.node").alias("ln"), F.col("lead.comp").alias("lc")), "bucket-rest")
            pairs = rest.where("comp <> lc").select(
                F.col("ln").alias("a"), F.col("node").alias("b"), F.col("lc").alias("ca"), F.col("comp").alias("cb")).distinct()
            members = rest.select("band", "key", "node", "comp", "met")
        else:
            met = stored(met.select("band", "key", "node", "comp"), "bucket-apart")
            left = met.select(F.col("node").alias("an")).distinct()
            fine = fine_signatures(codes.join(left, codes["node"] == F.col("an")))
            bands = rows.select(F.col("node").alias("bn"), "bands").join(left, F.col("bn") == F.col("an"), "left_semi") \
                .groupBy("bn").agg(F.first("bands").alias("bands"))
            info = stored(fine.join(bands, F.col("sn") == F.col("bn")).select("sn", "sig", "bands"), "fine-signatures")
            met = met.join(info, met["node"] == F.col("sn"))
            apart = met.select("band", "key", F.col("node").alias("a"), F.col("comp").alias("ca"), F.col("sig").alias("sa"),
                               F.col("bands").alias("ba"))
            other = met.select(F.col("band").alias("ob"), F.col("key").alias("ok"), F.col("node").alias("b"),
                               F.col("comp").alias("cb"), F.col("sig").alias("sb"), F.col("bands").alias("bb"))
            # only between components that are still apart (nodes of one component need no more links), where
            # the fine signatures leave a link possible, and in the first band that the two share
            pairs = apart.join(other, (F.col("band") == F.col("ob")) & (F.col("key") == F.col("ok"))
                               & (F.col("ca") < F.col("cb")) & F.expr(alike("sa", "sb", threshold, FINE_REGISTERS))
                               & F.expr("NOT exists(arrays_zip(slice(ba, 1, band), slice(bb, 1, band)), z -> z['0'] = z['1'])")) \
                .select("a", "b", "ca", "cb").distinct()
        links = stored(verified(pairs, codes, threshold).distinct(), "links")
        if not links.isEmpty():
            moved = components(links).select(F.col("node").alias("old"), F.col("comp").alias("new"))
            members = members.join(moved, members["comp"] == moved["old"], "left").select(
                "band", "key", "node", F.coalesce("new", "comp").alias("comp"), "met")
            labels = checkpointed(labels.join(moved, labels["comp"] == moved["old"], "left").select(
                "node", F.coalesce("new", "comp").alias("comp")))
        if r < rounds and members.isEmpty():
            break
    labels = labels.withColumnRenamed("node", "cn")
    named = rows.join(labels, rows["node"] == F.col("cn"), "left").select(
        "id", "th", F.coalesce("comp", "node").alias("comp"))
    classes = named.groupBy("comp").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return named.hint("merge").join(classes.withColumnRenamed("comp", "cc"), F.col("comp") == F.col("cc")).select(
        "id", "th", "class_id", "class_size")
