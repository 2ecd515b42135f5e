"""Exact token counts at every prefix of a text, for a SentencePiece BPE model.

``counts[i]`` is the number of tokens of ``text[:i]``.  Storing it answers
truncation ("the longest prefix of at most B tokens") and budget ("how many
tokens up to here") questions by look-up, without encoding again.

Method.  A BPE encoding has one last token, and the encoding of a prefix is the
encoding of the prefix before that token plus the token.  So a dynamic program
over prefix lengths finds, for each prefix, the only token t that ends there,
encodes to itself, and follows the last token p of the shorter prefix in a stable
pair (encoding p+t gives back p, t); its count is the shorter prefix's count plus
one.  Characters outside the vocabulary count their UTF-8 bytes (byte fallback).

No token spans two adjacent characters that stand side by side in no piece of the
vocabulary, so texts fall into pieces (a run of spaces with what follows, runs
of punctuation) that are encoded independently.  The program runs once per distinct piece
of a slice of texts, over all pieces at the same time; texts add the counts of
their pieces.  Whole texts are covered, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MODEL_NAME = "piece_bpe_32k.model"
SPACE = "▁"
TEXTS_PER_STEP_CHARS = 1 << 22
STORED_PIECES = 1_500_000


class PrefixCounter:
    """Prefix counts for one model file; one instance per Python worker."""

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb
        proto = pb.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if len(spec.precompiled_charsmap) or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models without text normalisation are supported")
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback are supported")
        self.dummy_prefix = spec.add_dummy_prefix
        pieces = [(i, p.piece) for i, p in enumerate(proto.pieces) if p.type == 1]
        spec.add_dummy_prefix = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.piece_text = {i: p for i, p in pieces}
        pairs = {(a, b) for _, p in pieces for a, b in zip(p, p[1:])}
        if any(b == SPACE and a != SPACE for a, b in pairs):
            raise ValueError("a piece has a space inside")
        self.splitter = self._splitter(pairs)
        self._build_trie(pieces)
        self._whole: dict[str, int] = {}
        self._known: np.ndarray = np.zeros(0, np.int64)      # sorted pair keys seen so far
        self._known_ok: np.ndarray = np.zeros(0, bool)

    @staticmethod
    def _splitter(pairs: set[tuple[str, str]]) -> re.Pattern:
        """Pieces of text that no token crosses: spaces with a run of characters, or a run of marks."""
        marks = set("\n\r\t.,;:!?()[]{}<>|\"'`*#/\\=+&%$@^~-_")
        while True:
            bad = {x for a, b in pairs for x, y in ((a, b), (b, a))
                   if x in marks and y not in marks and y != SPACE}
            # a space may begin a piece that goes on with a mark: keep such marks with their space
            bad |= {b for a, b in pairs if a == SPACE and b in marks}
            if not bad:
                break
            marks -= bad
        inside = "".join(map(re.escape, sorted(marks)))
        if not marks:
            return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        return re.compile(f"{SPACE}*[^{SPACE}{inside}]+|[{inside}]+|{SPACE}+")

    def _build_trie(self, pieces: list[tuple[int, str]]) -> None:
        chars = sorted({c for _, p in pieces for c in p})
        self.n_chars = len(chars) + 1
        self.char_id = np.zeros(0x110000, np.int32)  # 0: in no piece
        for k, c in enumerate(chars):
            self.char_id[ord(c)] = k + 1
        child: dict[tuple[int, int], int] = {}
        token = [-1]
        for i, p in pieces:
            node = 0
            for c in p:
                key = (node, int(self.char_id[ord(c)]))
                node = child.get(key)
                if node is None:
                    node = child[key] = len(token)
                    token.append(-1)
            token[node] = i
        keys = np.array([a * self.n_chars + b for a, b in child], np.int64)
        order = np.argsort(keys)
        self.trie_keys, self.trie_next = keys[order], np.array(list(child.values()), np.int64)[order]
        self.node_token = np.array(token, np.int64)
        # tokens that encode to themselves
        ids = [i for i, _ in pieces]
        enc = self.bare.encode([p for _, p in pieces], num_threads=1)
        self.reachable = np.zeros(max(ids) + 1, bool)
        for i, e in zip(ids, enc):
            self.reachable[i] = e == [i]

    def _step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Child nodes, -1 where there is none."""
        key = node * self.n_chars + char
        at = np.searchsorted(self.trie_keys, key)
        at[at == len(self.trie_keys)] = 0
        return np.where((char > 0) & (self.trie_keys[at] == key), self.trie_next[at], -1)

    def _pair_ok(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the encoding of both tokens' text is the two tokens; each pair is tried once per worker."""
        key = left * (1 << 20) + right
        uniq, inv = np.unique(key, return_inverse=True)
        at = np.searchsorted(self._known, uniq)
        at[at == len(self._known)] = 0
        new = uniq[self._known[at] != uniq] if len(self._known) else uniq
        if len(new):
            a, b = (new >> 20).tolist(), (new & ((1 << 20) - 1)).tolist()
            enc = self.bare.encode([self.piece_text[x] + self.piece_text[y] for x, y in zip(a, b)], num_threads=1)
            ok = np.fromiter((e == [x, y] for e, x, y in zip(enc, a, b)), bool, len(new))
            keys = np.concatenate([self._known, new])
            oks = np.concatenate([self._known_ok, ok])
            order = np.argsort(keys, kind="stable")
            self._known, self._known_ok = keys[order], oks[order]
            at = np.searchsorted(self._known, uniq)
        else:
            at = np.searchsorted(self._known, uniq)
        return self._known_ok[at][inv]

    def pieces_prefix_counts(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(counts, starts): ``counts[starts[k] + i]`` is the token count of the first i characters of piece k."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        code = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        char = self.char_id[code].astype(np.int64)
        nbytes = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        first = np.cumsum(lens) - lens
        starts = first + np.arange(len(pieces))          # each piece has len + 1 slots
        total = len(code) + len(pieces)
        count = np.full(total, -1, np.int64)
        last = np.full(total, -1, np.int64)              # -1: nothing or bytes before
        count[starts] = 0
        live = np.arange(len(pieces))
        # All candidate tokens by start offset: walking each start forward, a token
        # found from offset i to j is kept if it may follow the last token at i.
        # Offsets are taken in order, so count/last at i are final when i is reached.
        i = 0
        while len(live):
            live = live[lens[live] > i]
            if not len(live):
                break
            src = starts[live] + i
            char_at = first[live] + i
            c = char[char_at]
            out = c == 0
            if out.any():                                 # byte fallback
                k = src[out]
                count[k + 1] = count[k] + nbytes[char_at[out]]
                last[k + 1] = -1
            at, node, j, base = live[~out], np.zeros((~out).sum(), np.int64), 0, src[~out]
            while len(at):
                node = self._step(node, char[first[at] + i + j])
                keep = node >= 0
                at, node, base = at[keep], node[keep], base[keep]
                tok = self.node_token[node]
                cand = np.flatnonzero((tok >= 0) & self.reachable[np.maximum(tok, 0)])
                if len(cand):
                    left, right = last[base[cand]], tok[cand]
                    ok = left < 0
                    pair = np.flatnonzero(~ok)
                    if len(pair):
                        ok[pair] = self._pair_ok(left[pair], right[pair])
                    hit = cand[ok]
                    dst = base[hit] + j + 1
                    count[dst] = count[base[hit]] + 1
                    last[dst] = tok[hit]
                j += 1
                more = lens[at] > i + j
                at, node, base = at[more], node[more], base[more]
            i += 1
        return count, starts

    def text_pieces(self, text: str) -> list[str]:
        """The independent pieces of one text, spaces escaped and the model's first space added."""
        t = text.replace(" ", SPACE)
        return self.splitter.findall(SPACE + t if self.dummy_prefix and t else t)

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of ``text[:i]`` for i = 0 .. len(text) (the store for truncation and budget questions)."""
        if not text:
            return np.zeros(1, np.int64)
        pieces = self.text_pieces(text)
        count, starts = self.pieces_prefix_counts(pieces)
        out, done = [], 0
        for p, s in zip(pieces, starts):
            out.append(done + count[s + 1:s + len(p) + 1])
            done += count[s + len(p)]
        counts = np.concatenate(out)
        if self.dummy_prefix:
            counts[0] = 0  # the empty text has no tokens; with a first character the added space counts
            return counts
        return np.concatenate([[0], counts])

    def longest_prefix(self, text: str, budget: int) -> int:
        """Length of the longest prefix of at most ``budget`` tokens."""
        return int(np.flatnonzero(self.prefix_counts(text) <= budget)[-1])

    def totals(self, texts: list[str]) -> list[int]:
        """Token counts of whole texts: the last prefix count of each of its pieces, summed.

        Pieces already counted by this worker are looked up; the store starts
        anew beyond ``STORED_PIECES`` so its memory stays bounded.
        """
        split = [self.text_pieces(t) for t in texts]
        if len(self._whole) > STORED_PIECES:
            self._whole.clear()
        new = list(set().union(*split).difference(self._whole))
        if new:
            count, starts = self.pieces_prefix_counts(new)
            self._whole.update(zip(new, count[starts + np.fromiter(map(len, new), np.int64, len(new))].tolist()))
        return [sum(map(self._whole.__getitem__, s)) for s in split]


_counters: dict[str, PrefixCounter] = {}


def counter(model_file: str) -> PrefixCounter:
    if model_file not in _counters:
        _counters[model_file] = PrefixCounter(model_file)
    return _counters[model_file]


def tokenizer_path(name: str = MODEL_NAME) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _steps(texts: list[str]) -> Iterator[list[str]]:
    """Blocks of whole texts of a bounded size (one longer text alone)."""
    block, size = [], 0
    for t in texts:
        if block and size + len(t) > TEXTS_PER_STEP_CHARS:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t)
    if block:
        yield block


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 model: str = MODEL_NAME) -> DataFrame:
    """``id, n_bytes, n_tokens`` of every whole text; narrow, no shuffle.

    Null texts count as empty (0 tokens); repeated rows and null ids are kept as
    they are; an empty table gives an empty result; columns other than the id and
    the text are not read.
    """
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counter(tokenizer_path(model))  # the vocabulary file is part of the installation on every node
        for b in batches:
            texts = b.column(1).to_pylist()
            total = [n for block in _steps(texts) for n in table.totals(block)]
            nbytes = pc.binary_length(b.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), nbytes, pa.array(total, pa.int64())],
                                             ["id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, StructType([rows.schema["id"], *StructType.fromDDL("n_bytes bigint, n_tokens bigint").fields]))
