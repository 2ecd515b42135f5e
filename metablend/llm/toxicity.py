"""Toxicity scores of restored text: a noisy-channel decoder, then sub-word evidence.

1. Character language model: trigram counts of byte classes over all documents (one Spark
   aggregation; the table is bounded by the number of classes cubed).
2. Restoration: spans that look disguised (tokens that mix letters and look-alikes in any place, three or more
   single letters or look-alikes in a row, a letter among them, with separators of any ASCII punctuation or
   blanks, letters repeated three times or more) become character lattices: each character may stand
   for itself or for look-alikes, repeats and separators may vanish.  A Viterbi search under the
   language model picks the likeliest letters; they replace the span.
3. Evidence: byte 4-grams and 6-grams inside the words of the restored text that are much more
   frequent in toxic documents (log-likelihood ratio, counted by Spark over the training rows).
4. Score: logistic regression (spark.ml) on the strongest and the summed evidence of a document.  The
   training rows' own evidence is counted without themselves.

Labels come only from rows whose crc32(id) mod 3 is not 1, and from at most
``MAX_TRAIN`` of them (those of smallest hash; a bounded sample of labelled rows).  Counts of the language
model, the restoration and the scores cover all documents and whole texts.  Inputs of a score are the text
alone.  The passes are narrow except for the counts: n-grams are counted per task before the exchange.

Edge cases: null and empty texts have no evidence and get the score of a text without any; null ids are
scored and never used for training; null labels are ignored; rows that share an id carry the larger label;
without labels of both kinds every score is the share of toxic labels (0 if there are none); an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import stored
from .words import IS_WORD, TO_LOWER, slices, text_buffers

MAX_TRAIN = 20_000
MAX_FEATURES = 20_000
MIN_RATIO = 3.0
THRESHOLD = 0.7

# --- byte classes of the language model -------------------------------------------------
DIGIT = 27
N_CLASSES = 28 + 128
CLASS = np.zeros(256, np.int32)
CLASS[ord("a"):ord("z") + 1] = np.arange(1, 27)
CLASS[ord("A"):ord("Z") + 1] = np.arange(1, 27)
CLASS[ord("0"):ord("9") + 1] = DIGIT
CLASS[0x80:] = 28 + np.arange(128)

# --- channel: what a disguised character may stand for, and costs in nats (fixed values) ---
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
         "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "*": "abcdefghijklmnopqrstuvwxyz"}
SUBSTITUTE, KEEP_DIGIT, DROP_REPEAT, DROP_MARK, WORD_BREAK = 1.0, 2.5, 0.3, 0.7, 2.0
#: what a byte costs at least, however it is read (language model costs are not negative), and states of the first search
LEAST = [0.0 if CLASS[c] and CLASS[c] != DIGIT else DROP_REPEAT if c != 42 and chr(c) in LOOKS else
         KEEP_DIGIT if CLASS[c] == DIGIT else DROP_MARK for c in range(256)]
BEAM = 12


class CharModel:
    """Smoothed trigram model over byte classes, 0 standing for a word boundary."""

    def __init__(self, index: np.ndarray, count: np.ndarray):
        self.tri = dict(zip(index.tolist(), count.tolist()))
        self.bi: dict[int, int] = {}
        self.uni: dict[int, int] = {}
        self.ctx3: dict[int, int] = {}
        self.ctx2: dict[int, int] = {}
        for k, n in self.tri.items():
            ab, c = divmod(k, N_CLASSES)
            b = ab % N_CLASSES
            self.ctx3[ab] = self.ctx3.get(ab, 0) + n
            self.bi[b * N_CLASSES + c] = self.bi.get(b * N_CLASSES + c, 0) + n
            self.ctx2[b] = self.ctx2.get(b, 0) + n
            self.uni[c] = self.uni.get(c, 0) + n
        self.total = sum(self.uni.values())
        self._cost: dict[int, float] = {}

    def cost(self, a: int, b: int, c: int) -> float:
        k = (a * N_CLASSES + b) * N_CLASSES + c
        got = self._cost.get(k)
        if got is None:
            p1 = (self.uni.get(c, 0) + 0.5) / (self.total + 0.5 * N_CLASSES)
            p2 = (self.bi.get(b * N_CLASSES + c, 0) + 2 * p1) / (self.ctx2.get(b, 0) + 2)
            p3 = (self.tri.get(k, 0) + 2 * p2) / (self.ctx3.get(a * N_CLASSES + b, 0) + 2)
            got = self._cost[k] = -math.log(p3)
        return got

    def restore(self, span: bytes) -> bytes:
        """The likeliest reading of a disguised span: Viterbi over (last two classes), ties to the first found.

        Wildcards in a row have hundreds of states, so a search over few states goes first: its cost bounds the best
        one, and as no step costs less than ``rest`` counts, states beyond that bound lead to no better reading."""
        limit, read, whole = self._search(span, math.inf, BEAM)
        return read if whole else self._search(span, limit + 1e-9, None)[1]

    def _search(self, span: bytes, limit: float, beam: int | None) -> tuple[float, bytes, bool]:
        """(cost, reading, whether no state was left out for the beam); states that must end above ``limit`` go."""
        span, whole = span.lower(), True
        rest = sum(map(LEAST.__getitem__, span))
        # state -> (cost, last input byte that was read as itself or dropped as its repeat, back pointer)
        states: dict[tuple[int, int], tuple[float, int, tuple | None]] = {(0, 0): (0.0, -1, None)}
        for ch in span:
            rest -= LEAST[ch]
            own = int(CLASS[ch])
            looks = LOOKS.get(chr(ch), "")
            out: dict[tuple[int, int], tuple[float, int, tuple | None]] = {}

            def put(key, cost, byte, back, out=out):
                have = out.get(key)
                if have is None or cost < have[0]:
                    out[key] = (cost, byte, back)

            for (a, b), (cost, byte, back) in states.items():
                if own:
                    put((b if a or b else 0, own), cost + self.cost(a, b, own) + KEEP_DIGIT * (own == DIGIT), ch, (ch, back))
                    if byte == ch and own != DIGIT:
                        put((a, b), cost + DROP_REPEAT, ch, back)
                else:
                    put((a, b), cost + DROP_MARK, byte, back)
                    if b:
                        put((0, 0), cost + WORD_BREAK + self.cost(a, b, 0), -1, (32, back))
                for x in looks:
                    c = ord(x)
                    put((b if a or b else 0, c - 96), cost + SUBSTITUTE + self.cost(a, b, c - 96), c, (c, back))
                    if byte == c and ch != 42:  # a wildcard repeats nothing
                        put((a, b), cost + DROP_REPEAT, c, back)
            if beam is not None and len(out) > beam:
                out, whole = dict(sorted(out.items(), key=lambda s: s[1][0])[:beam]), False
            elif limit < math.inf:
                out = {k: v for k, v in out.items() if v[0] + rest <= limit}
            states = out

        def total(s):
            return s[1][0] + (self.cost(*s[0], 0) if s[0][1] else 0.0)

        best = min(states.items(), key=total)
        back, letters = best[1][2], []
        while back is not None:
            letters.append(back[0])
            back = back[1]
        return total(best), bytes(reversed(letters)), whole


def _lm_counts(docs: DataFrame, text_col: str) -> CharModel:
    """Trigram counts of byte classes over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N_CLASSES ** 3, np.int64)
        for batch in batches:
            buf, offsets = text_buffers(batch.column(0))
            for a, b in slices(offsets):
                c = np.zeros(offsets[b] - offsets[a] + 3, np.int32)
                c[2:-1] = CLASS[buf[offsets[a]:offsets[b]]]  # texts of a slice touch only at their ends
                left = np.where(c[1:-1] == 0, 0, c[:-2])
                k = (left * N_CLASSES + c[1:-1]) * N_CLASSES + c[2:]
                uniq, n = np.unique(k, return_counts=True) if len(k) < 4096 else (None, None)
                if uniq is None:
                    total += np.bincount(k, minlength=len(total))
                else:
                    total[uniq] += n
        total[0] = 0  # between words
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "n"])

    counted = docs.select(F.coalesce(docs[text_col], F.lit("")).alias("text")).mapInArrow(run, "k bigint, n bigint")
    table = counted.groupBy("k").agg(F.sum("n").alias("n")).orderBy("k").toArrow()  # at most N_CLASSES^3 rows
    return CharModel(table.column("k").to_numpy(), table.column("n").to_numpy())


# --- disguised spans --------------------------------------------------------------------
_LETTER = np.zeros(256, bool)
_LETTER[ord("a"):ord("z") + 1] = _LETTER[ord("A"):ord("Z") + 1] = True
_HIGH = np.zeros(256, bool)
_HIGH[0x80:] = True
_LEET = np.zeros(256, bool)
_LEET[[ord(c) for c in LOOKS]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0"):ord("9") + 1] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def disguised_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merged byte ranges of spans to restore; none reaches over the end of a text."""
    n = len(buf)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pad = np.concatenate([buf, np.full(6, 10, np.uint8)])
    letter, low = _LETTER[pad], TO_LOWER[pad]
    spoken = letter | _HIGH[pad]
    triple = letter[:n] & (low[:n] == low[1:n + 1]) & (low[:n] == low[2:n + 2])
    blank = np.flatnonzero(_BLANK[buf])
    ends = np.union1d(blank, offsets[1:])            # a token ends at a blank or with its text
    starts = np.union1d(blank + 1, offsets[:-1])
    at = np.flatnonzero(_LEET[buf] | triple)
    a1 = starts[np.searchsorted(starts, at, side="right") - 1]
    b1 = ends[np.searchsorted(ends, at, side="right")] if len(at) else at
    spoken_before = np.concatenate([[0], np.cumsum(spoken[:n], dtype=np.int32)])
    mixed = spoken_before[b1] > spoken_before[a1]    # look-alikes alone are numbers or marks
    a1, b1 = a1[mixed], b1[mixed]
    # single letters and look-alikes: no letter, digit or high byte of the same text beside them
    word = spoken[:n] | _DIGIT[buf]
    left, right = np.concatenate([[False], word[:-1]]), np.concatenate([word[1:], [False]])
    inner = offsets[(offsets > 0) & (offsets < n)]
    left[inner] = right[inner - 1] = False
    single = (letter[:n] | _LEET[buf]) & ~left & ~right
    at = np.flatnonzero(single)
    other = np.cumsum(word & ~single, dtype=np.int32)[at]
    text = np.searchsorted(offsets, at, side="right")
    begin = np.flatnonzero(np.concatenate([[True], (other[1:] > other[:-1]) | (text[1:] > text[:-1])])) if len(at) else at
    last = np.concatenate([begin[1:], [len(at)]])[:len(begin)] - 1
    letters = np.concatenate([[0], np.cumsum(letter[at])])
    row = (last - begin >= 2) & (letters[last + 1] > letters[begin])
    a2, b2 = at[begin[row]], at[last[row]] + 1
    a, b = np.concatenate([a1, a2]), np.concatenate([b1, b2])
    if not len(a):
        return a, b
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate([[True], a[1:] > b[:-1]])
    new |= np.searchsorted(offsets, a, side="right") != np.concatenate([[-1], np.searchsorted(offsets, a[:-1], side="right")])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(a)]]) - 1
    return a[first], b[last]


class Restorer:
    """Restored sub-word n-grams of texts; one per Python worker, with a bounded store of decoded spans."""

    STORE = 200_000

    def __init__(self, model: CharModel):
        self.model = model
        self.known: dict[bytes, bytes] = {}

    def restore(self, span: bytes) -> bytes:
        got = self.known.get(span)
        if got is None:
            if len(self.known) >= self.STORE:
                self.known.clear()
            got = self.known[span] = self.model.restore(span)
        return got

    def restored(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slice with its disguised spans replaced."""
        a, b = disguised_spans(buf, offsets)
        if not len(a):
            return buf, offsets
        raw = buf.tobytes()
        parts, done, grown = [], 0, np.zeros(len(a), np.int64)
        for k, (s, e) in enumerate(zip(a.tolist(), b.tolist())):
            new = self.restore(raw[s:e])
            parts += [raw[done:s], new]
            grown[k] = len(new) - (e - s)
            done = e
        parts.append(raw[done:])
        shift = np.concatenate([[0], np.cumsum(grown)])
        return (np.frombuffer(b"".join(parts), np.uint8),
                offsets + shift[np.searchsorted(b, offsets, side="right")])

    def grams(self, buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, n-gram) of every 4-gram and 6-gram of bytes inside words; a 6-gram is marked by bit 56."""
        buf, offsets = self.restored(buf, offsets)
        low = TO_LOWER[buf].astype(np.uint64)
        word = IS_WORD[buf]
        # how many word bytes follow, cut at the end of a text: position of the next break
        for size, mark in ((4, 0), (6, 1 << 56)):
            n = len(buf) - size + 1
            if n <= 0:
                continue
            inside = word[:n].copy()
            for k in range(1, size):
                inside &= word[k:n + k]
            starts = offsets[1:-1]
            for k in range(1, size):  # no gram over the start of a text
                p = starts - k
                inside[p[(p >= 0) & (p < n)]] = False
            at = np.flatnonzero(inside)
            value = np.full(len(at), mark, np.uint64)
            for k in range(size):
                value |= low[at + k] << np.uint64(8 * k)
            yield np.searchsorted(offsets, at, side="right") - 1, value


class Evidence:
    """Known n-grams and their log-likelihood ratios."""

    def __init__(self, gram: np.ndarray, weight: np.ndarray):
        order = np.argsort(gram)
        self.gram, self.weight = gram[order], weight[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self._slot(self.gram)] = True

    @staticmethod
    def _slot(gram: np.ndarray) -> np.ndarray:
        return ((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def find(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of known n-grams, and their numbers."""
        if not len(self.gram):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.maybe[self._slot(gram)])
        k = np.searchsorted(self.gram, gram[at])
        k[k == len(self.gram)] = 0
        ok = self.gram[k] == gram[at]
        return at[ok], k[ok]


def _document_evidence(restorer: Restorer, evidence: Evidence, col: pa.Array,
                       weights: list[np.ndarray]) -> list[np.ndarray]:
    """For each weighting: per row (largest weight, log of 1 + sum, log of 1 + number) of its distinct n-grams."""
    buf, offsets = text_buffers(col)
    out = [np.zeros((len(col), 3)) for _ in weights]
    m = max(1, len(evidence.gram))
    for a, b in slices(offsets):
        found = []
        for row, gram in restorer.grams(buf[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]):
            at, k = evidence.find(gram)
            found.append(row[at] * m + k)
        pair = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        row, k = pair // m, pair % m
        for o, w in zip(out, weights):
            own = np.maximum(w[k], 0.0) if len(k) else np.zeros(0)
            top = np.zeros(b - a)
            np.maximum.at(top, row, own)
            o[a:b, 0] = top
            o[a:b, 1] = np.log1p(np.bincount(row, own, minlength=b - a))
            o[a:b, 2] = np.log1p(np.bincount(row, own > 0, minlength=b - a))
    return out


class ToxicityModel:
    """The fitted parts: character model, evidence, logistic weights.  All of bounded size."""

    def __init__(self, chars: CharModel, evidence: Evidence, coef: np.ndarray, intercept: float):
        self.chars, self.evidence, self.coef, self.intercept = chars, evidence, coef, intercept

    def scores(self, restorer: Restorer, col: pa.Array) -> np.ndarray:
        x = _document_evidence(restorer, self.evidence, col, [self.evidence.weight])[0]
        return 1.0 / (1.0 + np.exp(-(x @ self.coef + self.intercept)))


def is_held_out(id_col):
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_id_col: str = "doc_id", label_col: str = "toxic", max_train: int = MAX_TRAIN,
        max_features: int = MAX_FEATURES) -> ToxicityModel:
    spark = docs.sparkSession
    chars = _lm_counts(docs, text_col)
    marked = labels.select(labels[label_id_col].alias("lid"), labels[label_col].cast("int").alias("label")) \
        .where("lid IS NOT NULL AND label IS NOT NULL").where(~is_held_out(F.col("lid")))
    sample = (marked.groupBy("lid").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64("lid"), "lid").limit(max_train))  # at most max_train small rows
    train = stored(docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
                   .join(F.broadcast(sample), F.col("id") == F.col("lid")).select("text", "label"), "toxic-train")
    n_toxic, n_clean = (train.agg(F.sum((F.col("label") == 1).cast("long")), F.sum((F.col("label") != 1).cast("long"))).first())
    n_toxic, n_clean = n_toxic or 0, n_clean or 0
    if not n_toxic or not n_clean:
        p = min(max(n_toxic / max(1, n_toxic + n_clean), 1e-9), 1 - 1e-9)
        return ToxicityModel(chars, Evidence(np.zeros(0, np.uint64), np.zeros(0)), np.zeros(3), math.log(p / (1 - p)))
    shared = spark.sparkContext.broadcast(chars)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for batch in batches:
            toxic = batch.column(1).to_numpy() == 1
            buf, offsets = text_buffers(batch.column(0))
            for a, b in slices(offsets):
                for row, gram in restorer.grams(buf[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]):
                    if not len(gram):
                        continue
                    uniq, inv = np.unique(gram, return_inverse=True)
                    pair = np.unique(row * len(uniq) + inv)
                    k, t = pair % len(uniq), toxic[a + pair // len(uniq)]
                    pos = np.bincount(k[t], minlength=len(uniq))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(uniq.view(np.int64)), pa.array(pos.astype(np.int64)),
                         pa.array(np.bincount(k[~t], minlength=len(uniq)).astype(np.int64))], ["gram", "pos", "neg"])

    min_pos = max(3, math.ceil(0.01 * n_toxic))
    ratio = F.log((F.col("pos") + 0.5) / (n_toxic + 1)) - F.log((F.col("neg") + 0.5) / (n_clean + 1))
    best = (train.mapInArrow(count, "gram bigint, pos bigint, neg bigint").groupBy("gram")
            .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") >= min_pos)
            .withColumn("ratio", ratio).where(F.col("ratio") >= MIN_RATIO)
            .orderBy(F.desc(F.col("ratio") * F.col("pos")), "gram").limit(max_features).toArrow())
    gram = best.column("gram").to_numpy().view(np.uint64)
    order = np.argsort(gram)
    pos, neg = (best.column(c).to_numpy()[order].astype(float) for c in ("pos", "neg"))
    evidence = Evidence(gram, best.column("ratio").to_numpy())
    # what a training row would see were it not counted itself
    without = {1: np.where(pos - 1 >= min_pos, np.log((np.maximum(pos - 1, 0) + 0.5) / n_toxic)
                           - np.log((neg + 0.5) / (n_clean + 1)), 0.0),
               0: np.log((pos + 0.5) / (n_toxic + 1)) - np.log((np.maximum(neg - 1, 0) + 0.5) / n_clean)}
    tools = spark.sparkContext.broadcast((chars, evidence, without))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, weights = tools.value
        restorer = Restorer(model)
        for batch in batches:
            label = (batch.column(1).to_numpy() == 1).astype(int)
            clean, toxic = _document_evidence(restorer, known, batch.column(0), [weights[0], weights[1]])
            x = np.where(label[:, None] == 1, toxic, clean)
            yield pa.RecordBatch.from_arrays([pa.array(label.astype(float)), pa.array(list(x), pa.list_(pa.float64()))],
                                             ["label", "x"])

    rows = train.mapInArrow(features, "label double, x array<double>")
    rows = stored(rows, "toxic-evidence").select("label", array_to_vector("x").alias("features"))
    lr = LogisticRegression(regParam=1e-5, maxIter=100, standardization=True).fit(rows)
    return ToxicityModel(chars, evidence, lr.coefficients.toArray(), float(lr.intercept))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text",
          keep: list[str] | None = None, score_col: str = "score") -> DataFrame:
    """``id, score`` of every row (or the columns ``keep`` of ``docs`` and ``score_col``); narrow."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = keep or [id_col]
    rows = docs.select(F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(columns)]).alias("row"),
                       docs[text_col].alias("text"))
    result = StructType([rows.schema["row"], StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        restorer = Restorer(fitted.chars)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fitted.scores(restorer, batch.column(1)))],
                                             ["row", "score"])

    names = columns if keep else ["id"]
    return rows.mapInArrow(run, result).select(
        *[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(names)], F.col("score").alias(score_col))
