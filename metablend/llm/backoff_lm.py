"""Stupid-backoff scores: n-gram count tables partitioned by hash, joined to the documents' n-grams.

S(w | u v) = c(u v w) / c(u v)                if c(u v w) >= min_count
           = 0.4 * c(v w) / c(v)              else if c(v w) >= min_count
           = 0.16 * c(w) / N                  else
The second word of a text starts at the bigram level, the first at c(w) / N (no factor).  A document's
score is the sum of log S over its words.  Counts are over the whole table, the document itself included.

Rows are packed: a block is a few million words of whole documents, and all n-grams a block asks
one hash partition about are one row (sorted hashes of ``HASH_BITS`` bits as differences, with their counts in the block).

1. ``blocks``: documents as local word ids and a dictionary of word hashes, written once.
2. ``asked``: the distinct n-grams (n = 1, 2, 3) of a block, one row per block and hash partition.  An n-gram
   that holds a third of all positions is one entry per block.
3. Count tables: each hash partition adds up its n-grams and joins the sums back to what was asked.
   The number of partitions follows the number of n-grams, so one holds about ``PARTITION_NGRAMS``.
4. ``scores``: answers meet their block again; documents add up the logarithms.

Edge cases: null and empty texts have no words and score 0; null ids and repeated rows are kept as they
are; one very long text is one block; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType, DoubleType, LongType

from .common import stored
from .words import count_by_row, mix64, word_slices

BACKOFF = 0.4
MIN_COUNT = 2
BLOCK_WORDS = 2_000_000
PARTITION_NGRAMS = 1_500_000
HASH_BITS = 56  # of an n-gram: two of N distinct ones are equal about N^2 / 2^57 times (0.1 at 10^8)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes, zstd-compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw), dtype=np.uint64)


def grams(h: np.ndarray, lens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1, 2, 3: (hash of the n-gram ending at each place that has one, those places), one at a time."""
    place = np.arange(len(h)) - np.repeat(np.cumsum(lens) - lens, lens)
    cut = np.uint64(64 - HASH_BITS)
    yield h >> cut, np.arange(len(h))
    at = np.flatnonzero(place >= 1)
    yield mix64(h[at - 1] * _A + h[at] * _B) >> cut, at
    at = np.flatnonzero(place >= 2)
    yield mix64(h[at - 2] * _C + h[at - 1] * _A + h[at] * _B) >> cut, at


def partition_bounds(sorted_hash: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` equal hash ranges starts in a sorted list of hashes."""
    limits = np.array([(k << HASH_BITS) // n for k in range(1, n)], np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_hash, limits), [len(sorted_hash)]])


def make_blocks(docs: DataFrame, id_col: str, text_col: str, block_words: int) -> DataFrame:
    """``block, ids, lens, words, dictionary, n_words, n_grams``."""
    id_type = docs.schema[id_col].dataType
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    schema = StructType([StructField("block", LongType()), StructField("ids", ArrayType(id_type)),
                         StructField("lens", ArrayType(LongType())),
                         *StructType.fromDDL("words binary, dictionary binary, n_words bigint, n_grams bigint").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        ids: list[pa.Array] = []
        lens: list[np.ndarray] = []
        hashes: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            h = np.concatenate(hashes)
            n = np.concatenate(lens)
            uniq, inv, times = np.unique(h, return_inverse=True, return_counts=True)
            by = np.argsort(-times, kind="stable")       # frequent words get small local ids
            local = np.empty(len(by), np.int64)
            local[by] = np.arange(len(by))
            every = pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([base + made], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every),
                 pa.array([n.tolist()], pa.list_(pa.int64())), pa.array([pack(local[inv].astype(np.uint64))], pa.binary()),
                 pa.array([pack(uniq[by])], pa.binary()), pa.array([len(h)], pa.int64()),
                 pa.array([int(len(uniq) + np.maximum(n - 1, 0).sum() + np.maximum(n - 2, 0).sum())], pa.int64())],
                ["block", "ids", "lens", "words", "dictionary", "n_words", "n_grams"])

        for batch in batches:
            for part in word_slices(batch.column(1)):
                if held and held + len(part.hash) > block_words:
                    yield flush()
                    made, held = made + 1, 0
                    ids, lens, hashes = [], [], []
                ids.append(batch.column(0).slice(part.row0, part.n_rows))
                lens.append(count_by_row(part.row, part.n_rows))
                hashes.append(part.hash)
                held += len(part.hash)
        if ids:
            yield flush()

    return rows.mapInArrow(run, schema)


def _words(words: bytes, dictionary: bytes) -> np.ndarray:
    return unpack(dictionary)[unpack(words).astype(np.int64)]


def asked(blocks: DataFrame, partitions: int) -> DataFrame:
    """``p, block, n, grams, counts``: the distinct n-grams a block asks hash partition p about."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, dictionary, lens in zip(*batch.columns):
                h = _words(words.as_py(), dictionary.as_py())
                for n, (g, _) in enumerate(grams(h, lens.values.to_numpy()), 1):
                    uniq, count = np.unique(g, return_counts=True)
                    edge = partition_bounds(uniq, partitions)
                    full = np.flatnonzero(np.diff(edge))
                    for some in np.array_split(full, max(1, len(full) // 64)):
                        if not len(some):
                            continue
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(some.astype(np.int32)), pa.array([block.as_py()] * len(some), pa.int64()),
                             pa.array([n] * len(some), pa.int32()),
                             pa.array([pack_sorted(uniq[edge[p]:edge[p + 1]]) for p in some], pa.binary()),
                             pa.array([pack(count[edge[p]:edge[p + 1]]) for p in some], pa.binary())],
                            ["p", "block", "n", "grams", "counts"])

    return blocks.select("block", "words", "dictionary", "lens").mapInArrow(
        run, "p int, block bigint, n int, grams binary, counts binary")


def _answer(table: pa.Table) -> pa.Table:
    """One hash partition: its count table, joined back to every request."""
    out_block, out_p, out_n, out_total = [], [], [], []
    for n in (1, 2, 3):
        own = table.filter(pc.equal(table.column("n"), n))
        if not own.num_rows:
            continue
        lists = [unpack_sorted(x.as_py()) for x in own.column("grams")]
        every = np.concatenate(lists)
        counts = np.concatenate([unpack(x.as_py()) for x in own.column("counts")]).astype(np.int64)
        order = np.argsort(every, kind="stable")
        every, counts = every[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        gram, total = every[first], np.add.reduceat(counts, first)
        for block, asked_for in zip(own.column("block").to_pylist(), lists):
            out_block.append(block)
            out_n.append(n)
            out_total.append(pack(total[np.searchsorted(gram, asked_for)]))
        out_p += own.column("p").to_pylist()
    return pa.table({"block": pa.array(out_block, pa.int64()), "p": pa.array(out_p, pa.int32()),
                     "n": pa.array(out_n, pa.int32()), "totals": pa.array(out_total, pa.binary())})


def block_scores(h: np.ndarray, lens: np.ndarray, totals: dict[int, np.ndarray], n_all: int,
                 min_count: int, backoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Score and number of places scored at the trigram level, per document.  ``totals[n]``: counts in sorted n-gram order."""
    count = {}
    for n, (g, at) in enumerate(grams(h, lens), 1):
        c = np.zeros(len(h))
        if len(g):
            order = np.argsort(g)                        # one sort: the rank of a place's n-gram is the n-grams begun before it
            begins = g[order]
            begins = np.concatenate([[False], begins[1:] != begins[:-1]])
            c[at[order]] = totals.pop(n)[np.cumsum(begins)]
        count[n] = c
    place = np.arange(len(h)) - np.repeat(np.cumsum(lens) - lens, lens)
    before1 = np.concatenate([[1.0], count[1][:-1]]) if len(h) else count[1]
    before2 = np.concatenate([[1.0], count[2][:-1]]) if len(h) else count[2]
    one = np.log(np.maximum(count[1], 1)) - math.log(max(n_all, 1))
    two = np.log(np.maximum(count[2], 1)) - np.log(np.maximum(before1, 1))
    three = np.log(np.maximum(count[3], 1)) - np.log(np.maximum(before2, 1))
    cost = math.log(backoff)
    from_two = np.where(count[2] >= min_count, two, cost + one)
    used3 = (place >= 2) & (count[3] >= min_count)
    value = np.where(place == 0, one, np.where(place == 1, from_two, np.where(used3, three, cost + from_two)))
    doc = np.repeat(np.arange(len(lens)), lens)
    return np.bincount(doc, value, minlength=len(lens)), np.bincount(doc, used3, minlength=len(lens)).astype(np.int64)


def backoff_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT,
                   backoff: float = BACKOFF, block_words: int = BLOCK_WORDS,
                   partition_ngrams: int = PARTITION_NGRAMS) -> DataFrame:
    """Per document ``id, n_words, n_trigrams, score``."""
    blocks = stored(make_blocks(docs, id_col, text_col, block_words), "lm-blocks")
    total = blocks.agg(F.sum("n_words"), F.sum("n_grams")).first()
    n_all, partitions = total[0] or 0, max(1, -(-(total[1] or 0) // partition_ngrams))
    answers = asked(blocks, partitions).groupBy("p").applyInArrow(_answer, "block bigint, p int, n int, totals binary")
    schema = StructType([StructField("id", docs.schema[id_col].dataType), StructField("n_words", LongType()),
                         StructField("n_trigrams", LongType()), StructField("score", DoubleType())])

    def score(block: pa.Table, answer: pa.Table) -> pa.Table:
        answer = answer.sort_by([("n", "ascending"), ("p", "ascending")])
        ids = block.column("ids").combine_chunks().flatten()
        lens = block.column("lens").combine_chunks().flatten().to_numpy()
        h = _words(block.column("words")[0].as_py(), block.column("dictionary")[0].as_py())
        totals = {}
        for n in (1, 2, 3):
            own = answer.filter(pc.equal(answer.column("n"), n)).column("totals")
            totals[n] = np.concatenate([unpack(x.as_py()) for x in own] or [np.zeros(0, np.uint64)]).astype(float)
        value, tri = block_scores(h, lens, totals, n_all, min_count, backoff)
        return pa.table([ids, pa.array(lens), pa.array(tri), pa.array(value)], names=["id", "n_words", "n_trigrams", "score"])

    return blocks.drop("n_words", "n_grams").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)
