"""Fill-in-middle texts over seekable compressed frames.

A text is stored as independent zstandard frames of at most ``FRAME_UNITS`` code points,
with the cumulative number of units at the end of each frame.  A span of units is read by
look-up in these counts: only the frames that the span cuts are decompressed for selection;
frames inside it are passed on as they are.  So the rearranged text is built from the
frames of the original: sentinels and the cut pieces become new small frames, whole frames
are reused without being opened.  Digests stream the ordered frames, one at a time.

``frame_texts``  documents -> ``id, n, frames, ends``: the store (Parquet-ready)
``fill_middle``  store -> ``id, n, form, prefix_units, middle_units, frames, ends`` of the output
``restore``      output -> the original text's frames, found from output and form alone
``digests``      SHA-256 of the output and of the restored text

Cuts.  h1 to h4 are the first four 8-digit groups of the hex SHA-256 of ``<seed>:<id>``.
The prefix ends after min(h1 % (n + 1), h2 % (n + 1)) units, the middle after the larger.
``plain`` if the text is empty, holds a sentinel, or h3 % 100 >= rate; else ``spm`` if
h4 % 100 < spm_rate, else ``psm``.

Everything is narrow (no shuffle); a task holds one batch of rows and one open frame.

Edge cases.  A null text counts as empty; an empty text is plain, with no frames.  A null id
counts as the empty string in the hash.  Equal ids give equal hashes; repeated rows are kept
as they are.  Sentinels across frame borders are seen.  Other columns are not read.  An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FRAME_UNITS = 1 << 15
LEVEL = 1
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINEL = re.compile("<[PSM]>")

_pack = zstandard.ZstdCompressor(level=LEVEL).compress
_open = zstandard.ZstdDecompressor().decompress


class Frames:
    """A text as independent frames; ``ends[i]``: units up to the end of frame i."""

    __slots__ = ("frames", "ends")

    def __init__(self, frames: list[bytes] | None = None, ends: list[int] | None = None):
        self.frames, self.ends = frames if frames is not None else [], ends if ends is not None else []

    @classmethod
    def of(cls, text: str, frame_units: int = FRAME_UNITS) -> Frames:
        out = cls()
        for i in range(0, len(text), frame_units):
            out.add(text[i:i + frame_units])
        return out

    def __len__(self) -> int:
        return self.ends[-1] if self.ends else 0

    def add(self, piece: str) -> None:
        if piece:
            self.frames.append(_pack(piece.encode()))
            self.ends.append(len(self) + len(piece))

    def text(self, i: int) -> str:
        return _open(self.frames[i]).decode()

    def _parts(self, start: int, stop: int) -> Iterator[tuple[int, int, int]]:
        """(frame, first unit in it, last unit in it) for the units start..stop."""
        i = bisect_right(self.ends, start)
        while start < stop:
            base = self.ends[i - 1] if i else 0
            upto = min(stop, self.ends[i])
            yield i, start - base, upto - base
            start, i = upto, i + 1

    def copy_span(self, start: int, stop: int, to: Frames) -> None:
        """Append the units start..stop to ``to``: cut frames are opened, whole frames are passed on closed."""
        for i, a, b in self._parts(start, stop):
            base = self.ends[i - 1] if i else 0
            if a == 0 and base + b == self.ends[i]:
                to.frames.append(self.frames[i])
                to.ends.append(len(to) + b)
            else:
                to.add(self.text(i)[a:b])

    def stream(self) -> Iterator[bytes]:
        """The text's UTF-8 bytes, a frame at a time."""
        for f in self.frames:
            yield _open(f)

    def find(self, start: int = 0) -> tuple[int, str] | None:
        """Place and name of the first sentinel from unit ``start`` on, across frame borders too."""
        held, at = "", start
        for i, a, b in self._parts(start, len(self)):
            piece = self.text(i)
            held += piece if (a, b) == (0, len(piece)) else piece[a:b]
            m = SENTINEL.search(held)
            if m:
                return at + m.start(), m[0]
            cut = max(0, len(held) - 2)
            at, held = at + cut, held[cut:]
        return None

    def sha256(self) -> str:
        h = hashlib.sha256()
        for piece in self.stream():
            h.update(piece)
        return h.hexdigest()


def plan(text: Frames, key, seed: str = "1", rate: int = 90, spm_rate: int = 20) -> tuple[str, int, int]:
    """(form, end of the prefix, end of the middle)."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    if n == 0 or h3 % 100 >= rate or text.find() is not None:
        return "plain", 0, 0
    return "spm" if h4 % 100 < spm_rate else "psm", min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))


def rearrange(text: Frames, form: str, cut: int, until: int) -> Frames:
    """The output's frames."""
    if form == "plain":
        return text
    spans = {PREFIX: (0, cut), MIDDLE: (cut, until), SUFFIX: (until, len(text))}
    out = Frames()
    for mark in (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE):
        out.add(mark)
        text.copy_span(*spans[mark], out)
    return out


def restored(output: Frames, form: str) -> Frames:
    """The original text from output and form: parts lie between sentinels, which no part holds."""
    if form == "plain":
        return output
    at: dict[str, tuple[int, int]] = {}
    mark, start = output.find(0)[1], len(PREFIX)
    while True:
        following = output.find(start)
        at[mark] = (start, following[0] if following else len(output))
        if following is None:
            break
        mark, start = following[1], following[0] + len(PREFIX)
    text = Frames()
    for part in (PREFIX, MIDDLE, SUFFIX):
        output.copy_span(*at[part], text)
    return text


def frame_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frame_units: int = FRAME_UNITS) -> DataFrame:
    """The seekable store: ``id, n, frames, ends``."""
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [Frames.of(t, frame_units) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(m) for m in made], pa.int64()), pa.array([m.frames for m in made], pa.list_(pa.binary())),
                 pa.array([m.ends for m in made], pa.list_(pa.int64()))], ["id", "n", "frames", "ends"])

    return rows.mapInArrow(run, StructType([rows.schema["id"], *StructType.fromDDL(
        "n bigint, frames array<binary>, ends array<bigint>").fields]))


def read_span(store: DataFrame, start: int, length: int) -> DataFrame:
    """``id, piece``: units start..start+length of every stored text; only frames that overlap them are opened."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pieces = []
            for frames, ends in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                text = Frames(frames, ends)
                pieces.append("".join(text.text(i)[x:y] for i, x, y in text._parts(min(start, len(text)), min(start + length, len(text)))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pieces, pa.string())], ["id", "piece"])

    return store.select("id", "frames", "ends").mapInArrow(run, StructType([store.schema["id"], *StructType.fromDDL("piece string").fields]))


def fill_middle(store: DataFrame, seed: str = "1", rate: int = 90, spm_rate: int = 20) -> DataFrame:
    """``id, n, form, prefix_units, middle_units, frames, ends``: the outputs, as frames again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms, prefixes, middles, frames, ends = [], [], [], [], []
            for key, own, upto in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                text = Frames(own, upto)
                form, cut, until = plan(text, key, seed, rate, spm_rate)
                out = rearrange(text, form, cut, until)
                forms.append(form)
                prefixes.append(None if form == "plain" else cut)
                middles.append(None if form == "plain" else until - cut)
                frames.append(out.frames)
                ends.append(out.ends)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()),
                 pa.array(frames, pa.list_(pa.binary())), pa.array(ends, pa.list_(pa.int64()))],
                ["id", "n", "form", "prefix_units", "middle_units", "frames", "ends"])

    return store.select("id", "n", "frames", "ends").mapInArrow(run, StructType([store.schema["id"], *StructType.fromDDL(
        "n bigint, form string, prefix_units bigint, middle_units bigint, frames array<binary>, ends array<bigint>").fields]))


def restore(outputs: DataFrame) -> DataFrame:
    """``id, frames, ends`` of the original texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [restored(Frames(f, e), form) for form, f, e in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.frames for m in made], pa.list_(pa.binary())),
                                              pa.array([m.ends for m in made], pa.list_(pa.int64()))], ["id", "frames", "ends"])

    return outputs.select("id", "form", "frames", "ends").mapInArrow(run, StructType([outputs.schema["id"], *StructType.fromDDL(
        "frames array<binary>, ends array<bigint>").fields]))


def digests(outputs: DataFrame) -> DataFrame:
    """``id, n, form, prefix_units, middle_units, output_sha256, restored_sha256``; frames are streamed in order."""
    kept = ["id", "n", "form", "prefix_units", "middle_units"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of_output, of_text = [], []
            for form, f, e in zip(*(b.column(i).to_pylist() for i in (2, 5, 6))):
                output = Frames(f, e)
                of_output.append(output.sha256())
                of_text.append(restored(output, form).sha256())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(of_output, pa.string()), pa.array(of_text, pa.string())],
                                             [*kept, "output_sha256", "restored_sha256"])

    return outputs.select(*kept, "frames", "ends").mapInArrow(run, StructType([*(outputs.schema[c] for c in kept), *StructType.fromDDL(
        "output_sha256 string, restored_sha256 string").fields]))
