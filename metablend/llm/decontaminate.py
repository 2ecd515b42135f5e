"""Benchmark decontamination with one FM-index per shard of training texts.

Words are maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z.
A window is 13 consecutive words of a benchmark item (an item of fewer, but some,
words is one window).  Each shard (a few MB of whole documents inside a task)

1. maps its words to ids of the benchmark vocabulary; any other word cannot lie in
   an occurrence, so it ends a run, and runs shorter than the shortest window are
   left out of the index (no occurrence fits into them);
2. builds an FM-index of the runs (suffix array, Burrows-Wheeler text, wavelet matrix);
3. searches all windows backward through the wavelet ranks, locates their
   occurrences by sampled suffix positions, and merges them into removal spans.

The pass over the documents is narrow: nothing of them is shuffled.  Only the
windows travel to the tasks, in blocks of at most ``BLOCK_BYTES`` of benchmark text (a
stated query set against all rows); more text gives more blocks, each one pass.

Edge cases: null texts have no words; an item or document without words has no
windows and no hits; items with a null id still mark words, but have no id to
list; equal windows of several items list all of them; repeated rows are judged
alike; an empty benchmark or table gives clean or no rows; extra columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .fm_index import FMIndex
from .words import TO_LOWER, Words, count_by_row, word_slices

WINDOW = 13
BLOCK_BYTES = 64 << 20
SHARD_BYTES = 4 << 20
RESULT = "n_words bigint, n_hit bigint, item_ids array<string>, spans array<struct<start:bigint,end:bigint>>"


class Windows:
    """The windows of one block of benchmark items as rows of vocabulary ids, by length."""

    def __init__(self, items: pa.Table, window: int = WINDOW):
        """``items``: item_id (string, may be null) and text."""
        names = items.column("item_id").to_pylist()
        vocab: dict[bytes, int] = {}
        grams: dict[tuple[int, ...], set] = {}
        self.word_bytes: list[bytes] = [b""]
        self.hashes = [np.uint64(0)]
        for part in word_slices(items.column("text")):
            low = TO_LOWER[part.buf].tobytes()
            ids = []
            for s, e, h in zip(part.start.tolist(), part.end.tolist(), part.hash):
                w = low[s:e]
                k = vocab.get(w)
                if k is None:
                    k = vocab[w] = len(vocab) + 1
                    self.word_bytes.append(w)
                    self.hashes.append(h)
                ids.append(k)
            bounds = np.searchsorted(part.row, np.arange(part.n_rows + 1))
            for r in range(part.n_rows):
                words = tuple(ids[bounds[r]:bounds[r + 1]])
                size = min(window, len(words))
                for i in range(len(words) - size + 1 if size else 0):
                    grams.setdefault(words[i:i + size], set()).add(names[part.row0 + r])
        self.n_symbols = len(vocab) + 1
        h = np.array(self.hashes[1:], np.uint64)
        self.order = np.argsort(h)
        self.sorted_hash = h[self.order]
        if len(h) != len(np.unique(h)):
            raise ValueError("two benchmark words share a 64-bit hash")
        self._small_table(h)
        self.by_length: dict[int, tuple[np.ndarray, list[list[str]]]] = {}
        for size in sorted({len(g) for g in grams}):
            own = sorted(g for g in grams if len(g) == size)
            self.by_length[size] = (np.array(own, np.int64).reshape(-1, size),
                                    [sorted(x for x in grams[g] if x is not None) for g in own])
        self.shortest = min(self.by_length, default=0)

    def _small_table(self, h: np.ndarray) -> None:
        """A bit per high part of a hash: most words that are not in the vocabulary end here."""
        self.shift = np.uint64(64 - 20)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(h >> self.shift).astype(np.int64)] = True

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary id of each word, 0 if it has none."""
        out = np.zeros(len(hashes), np.int64)
        if self.n_symbols == 1:
            return out
        at = np.flatnonzero(self.maybe[(hashes >> self.shift).astype(np.int64)])
        own = hashes[at]
        k = np.searchsorted(self.sorted_hash, own)
        k[k == len(self.sorted_hash)] = 0
        good = self.sorted_hash[k] == own
        out[at[good]] = self.order[k[good]] + 1
        return out


def find_hits(part: Words, windows: Windows) -> tuple[np.ndarray, list[set[str]]]:
    """Per word of the shard whether an occurrence covers it; per row the ids of items that occur."""
    n = len(part.hash)
    hit = np.zeros(n, bool)
    items: list[set[str]] = [set() for _ in range(part.n_rows)]
    if not n or not windows.shortest:
        return hit, items
    ids = windows.ids(part.hash)
    # runs of vocabulary words inside one text
    known = ids > 0
    begins = known.copy()
    begins[1:] &= ~known[:-1] | (part.row[1:] != part.row[:-1])
    ends = known.copy()
    ends[:-1] &= ~known[1:] | (part.row[1:] != part.row[:-1])
    a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    long = b - a >= windows.shortest
    a, b = a[long], b[long]
    if not len(a):
        return hit, items
    # text of the index: each run, then an end mark; word number of each position
    size = b - a + 1
    first = np.cumsum(size) - size
    word = np.repeat(a - first, size) + np.arange(int(size.sum()))
    text = ids[np.minimum(word, n - 1)]
    text[first + size - 1] = 0
    index = FMIndex(text, windows.n_symbols)
    edge = np.zeros(n + 1, np.int64)
    for length, (patterns, names) in windows.by_length.items():
        lo, hi = index.search(patterns)
        found = np.flatnonzero(hi > lo)
        if not len(found):
            continue
        times = (hi - lo)[found]
        which = np.repeat(found, times)
        rows = np.repeat(lo[found] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        start = word[index.locate(rows)]
        if not _same_words(part, start, patterns[which], windows):
            raise ValueError("a 64-bit word hash is not unique")
        np.add.at(edge, start, 1)
        np.add.at(edge, start + length, -1)
        pair = np.unique(part.row[start] * len(patterns) + which)
        for r, k in zip((pair // len(patterns)).tolist(), (pair % len(patterns)).tolist()):
            items[r].update(names[k])
    return np.cumsum(edge[:-1]) > 0, items


def _same_words(part: Words, start: np.ndarray, patterns: np.ndarray, windows: Windows) -> bool:
    """Byte comparison of the distinct (document word, vocabulary word) pairs behind the hits."""
    word = (start[:, None] + np.arange(patterns.shape[1])[None, :]).ravel()
    uniq, at = np.unique(word, return_index=True)
    ids = patterns.ravel()[at]
    low = TO_LOWER[part.buf]
    return all(low[s:e].tobytes() == windows.word_bytes[k] for s, e, k in
               zip(part.start[uniq].tolist(), part.end[uniq].tolist(), ids.tolist()))


def _spans(part: Words, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged removal spans as (row, first byte, end byte) inside the row's text."""
    if not hit.any():
        z = np.zeros(0, np.int64)
        return z, z, z
    other = part.row[1:] != part.row[:-1]
    begin, end = hit.copy(), hit.copy()
    begin[1:] &= ~hit[:-1] | other
    end[:-1] &= ~hit[1:] | other
    a, b = np.flatnonzero(begin), np.flatnonzero(end)
    base = part.offsets[part.row[a]]
    return part.row[a], part.start[a] - base, part.end[b] - base


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[pa.Table]:
    """The benchmark in blocks of about ``block_bytes`` of text each."""
    items = benchmark.select(benchmark[id_col].cast("string").alias("item_id"),
                             F.coalesce(benchmark[text_col], F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))
    for k in range(n):
        yield items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).toArrow()


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document ``id, n_words, n_hit, item_ids, spans`` (byte ranges of the text to remove).

    The id may be of any type, also a struct of a whole row, which then comes back with its judgement.
    """
    spark = docs.sparkSession
    blocks = [spark.sparkContext.broadcast(Windows(t, window))
              for t in _blocks(benchmark, item_id_col, item_text_col, block_bytes)]
    result = StructType([StructField("id", docs.schema[id_col].dataType), *StructType.fromDDL(RESULT).fields])
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, items, spans = [], [], [], []
            for part in word_slices(batch.column(1), SHARD_BYTES):
                hit = np.zeros(len(part.hash), bool)
                names: list[set[str]] = [set() for _ in range(part.n_rows)]
                for block in blocks:
                    own, found = find_hits(part, block.value)
                    hit |= own
                    for a, b in zip(names, found):
                        a |= b
                n_words.append(count_by_row(part.row, part.n_rows))
                n_hit.append(count_by_row(part.row[hit], part.n_rows))
                items += [sorted(x) for x in names]
                own_spans: list[list[dict]] = [[] for _ in range(part.n_rows)]
                for r, a, b in zip(*(x.tolist() for x in _spans(part, hit))):
                    own_spans[r].append({"start": a, "end": b})
                spans += own_spans
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(n_words or [np.zeros(0, np.int64)])),
                 pa.array(np.concatenate(n_hit or [np.zeros(0, np.int64)])),
                 pa.array(items, pa.list_(pa.string())),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["id", "n_words", "n_hit", "item_ids", "spans"])

    return rows.mapInArrow(run, result)


def is_contaminated(n_words="n_words", n_hit="n_hit"):
    """At least one word in twenty is part of a benchmark window."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))
