"""Secret scan with multipart credential linking.

Strong spans are reported wherever they stand (``assign``, ``access``, ``hex``; the leftmost
non-overlapping matches of each pattern that are long enough).  Weak parts alone mean
nothing: a user name, a mixed token, a host.  They are reported (``id``, ``key``,
``endpoint``) only where complementary parts stand within the same scope:

- a weak identifier, if a secret is there,
- a weak secret (key), if an identifier is there,
- an endpoint, if an identifier and a secret are there.

Strong spans are parts too: ``access`` is an identifier, ``assign`` and ``hex`` are secrets.
A part's scope is what lies within ``REACH`` code points of it in its own paragraph (lines
up to the next blank line); a complementary part must begin in it and not overlap the
candidate.  Weak parts that overlap strong ones, or weak parts named before them (endpoint,
id, key), are not candidates.

Spark.  Texts are scanned where they lie (Arrow batches, linear patterns, whole texts); the
rows are stored under a key made of task and place.  Only texts with an identifier and a
secret go on.  The interval join is relational: parts are grouped by (row, cell of
``CELL`` code points), so a group is bounded by the cell's length however long the text; a
candidate asks the few cells at either side of it that its scope touches, and ``exists``
over the cell's parts answers.  No pairs are emitted; a text with very many parts is spread
over its cells.

Edge cases.  A null text counts as empty: no spans, the digest of the empty string.  Null
and repeated ids stay separate rows.  Positions are code points, the end exclusive.  Letters
match in either case only within ASCII.  Other columns are not read.  An empty table gives
an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import stored

KINDS = ["assign", "access", "hex", "endpoint", "id", "key"]
ASSIGN, ACCESS, HEX, ENDPOINT, ID, KEY = range(6)
REACH = 200
CELL = 256

# fixed values: the strong patterns and their least lengths
ASSIGN_PATTERN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_VALUE = 6
ACCESS_PATTERN = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LENGTH = 20
HEX_PATTERN = re.compile(r"[0-9a-f]{24,}")  # a whole run of 24 or more: shorter runs fail

URL = re.compile(r"""(?<![a-z0-9+.-])[a-z][a-z0-9+.-]{1,15}://(?:([^\s"'<>:/@]{1,200}):([^\s"'<>:/@]{1,200})@)?([^\s"'<>@]+)""", re.I | re.A)
ADDRESS = re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?::\d{1,5})?(?![\d.])", re.A)
HOST = re.compile(r"""(?<![a-z0-9])(?:host|hostname|server|endpoint)["']?\x20*[:=]\x20*["']?([a-z0-9][a-z0-9.:/-]{3,})""", re.I | re.A)
NAME = re.compile(r"""(?<![a-z0-9])(?:user|username|login|account|client_?id|access_?key(?:_?id)?|key_?id)["']?\x20*[:=]\x20*"""
                  r"""["']?([a-z0-9@._+-]{3,})""", re.I | re.A)
SHORT_ACCESS = re.compile(r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{8,}")
PASS = re.compile(r"""(?<![a-z0-9])(?:pass|pwd|passphrase|credential|auth|private_?key|password|passwd|secret|token|api_?key)["']?"""
                  r"""\x20*[:=]\x20*["']?([^\s"',;]{3,})""", re.I | re.A)
MIXED = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
BLANK = re.compile(r"\n[\x20\t\r]*\n")

ROW = ("row bigint, n_assign bigint, n_access bigint, n_hex bigint, base array<struct<start:bigint,kind:int,end:bigint>>, "
       "parts array<struct<kind:int,start:bigint,end:bigint,low:bigint,high:bigint>>")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Strong spans as (start, kind, end), sorted."""
    out = [(m.start(), ASSIGN, m.end()) for m in ASSIGN_PATTERN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    out += [(m.start(), ACCESS, m.end()) for m in ACCESS_PATTERN.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    out += [(m.start(), HEX, m.end()) for m in HEX_PATTERN.finditer(text)]
    return sorted(out)


def is_mixed(token: str) -> bool:
    """Letters and digits, and at least eight different characters."""
    return any(c.isdigit() for c in token) and any(c.isalpha() for c in token) and len(set(token)) >= 8


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak candidates as (start, kind, end), sorted; those that overlap a strong span or one named earlier are left out."""
    found: list[tuple[int, int, int]] = []
    for m in URL.finditer(text):
        found.append((*m.span(3), ENDPOINT))
        if m[1]:
            found += [(*m.span(1), ID), (*m.span(2), KEY)]
    found += [(*m.span(), ENDPOINT) for m in ADDRESS.finditer(text)] + [(*m.span(1), ENDPOINT) for m in HOST.finditer(text)]
    found += [(*m.span(1), ID) for m in NAME.finditer(text)] + [(*m.span(), ID) for m in SHORT_ACCESS.finditer(text)]
    found += [(*m.span(1), KEY) for m in PASS.finditer(text)] + [(*m.span(), KEY) for m in MIXED.finditer(text) if is_mixed(m[0])]
    if not found:
        return []
    taken = _Taken([(s, e) for s, _, e in base])
    out = []
    for kind in (ENDPOINT, ID, KEY):
        own = []
        for start, end, k in sorted((x for x in found if x[2] == kind), key=lambda x: (x[0], -x[1])):
            if taken.free(start, end) and (not own or start >= own[-1][1]):
                own.append((start, end))
                out.append((start, kind, end))
        taken = _Taken(taken.spans + own)
    return sorted(out)


class _Taken:
    """Spans in order; is a stretch free of them?"""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans = sorted(spans)
        self.starts = [s for s, _ in self.spans]
        self.ends, last = [], 0
        for _, e in self.spans:  # the furthest end so far: strong spans of different kinds may overlap
            last = max(last, e)
            self.ends.append(last)

    def free(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return i == 0 or self.ends[i - 1] <= start


def parts(text: str, base: list[tuple[int, int, int]], reach: int = REACH) -> list[tuple[int, int, int, int, int]]:
    """All parts as (kind, start, end, scope from, scope to); none unless the text has an identifier and a secret."""
    weak = weak_spans(text, base)
    kinds = {k for _, k, _ in base} | {k for _, k, _ in weak}
    if not weak or not kinds & {ACCESS, ID} or not kinds & {ASSIGN, HEX, KEY}:
        return []
    borders = [0] + [m.end() for m in BLANK.finditer(text)] + [len(text)]
    out = []
    for start, kind, end in sorted(base + weak):
        i = bisect_right(borders, start, 0, len(borders) - 1)
        out.append((kind, start, end, max(borders[i - 1], start - reach), min(borders[i], end + reach)))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, row, n_assign, n_access, n_hex, base, parts`` of every whole text; narrow."""
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    of_base = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    of_part = pa.list_(pa.struct([("kind", pa.int32()), *((n, pa.int64()) for n in ("start", "end", "low", "high"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for b in batches:
            counts: list[list[int]] = [[], [], []]
            bases, own = [], []
            for text in b.column(1).to_pylist():
                base = base_spans(text)
                for kind, column in enumerate(counts):
                    column.append(sum(k == kind for _, k, _ in base))
                bases.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
                own.append([dict(zip(("kind", "start", "end", "low", "high"), p)) for p in parts(text, base)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(range(at, at + b.num_rows), pa.int64()), *(pa.array(c, pa.int64()) for c in counts),
                 pa.array(bases, of_base), pa.array(own, of_part)], ["id", "row", "n_assign", "n_access", "n_hex", "base", "parts"])
            at += b.num_rows

    return rows.mapInArrow(run, StructType([rows.schema["id"], *StructType.fromDDL(ROW).fields]))


def link_parts(scanned: DataFrame, cell: int = CELL) -> DataFrame:
    """``row, linked``: the weak spans of each row that stand with complementary parts."""
    one = scanned.where(F.size("parts") > 0).select("row", F.inline("parts"))
    cells = one.groupBy("row", F.floor(F.col("start") / cell).alias("cell")).agg(F.collect_list(F.struct("kind", "start", "end")).alias("own"))
    # a part begins before the candidate's start or at its end or later: cells from the scope's
    # begin to the candidate's start, and from its end to the scope's end
    at = lambda c: F.floor(F.col(c) / cell)
    asked = one.where(F.col("kind") >= ENDPOINT).withColumn("cell", F.explode(F.array_union(
        F.sequence(at("low"), at("start")), F.sequence(at("end"), F.greatest(at("end"), at("high"))))))
    def met(kinds):
        return F.exists("own", lambda p: p["kind"].isin(kinds) & (p["start"] >= F.col("low")) & (p["start"] < F.col("high"))
                        & ((p["end"] <= F.col("start")) | (p["start"] >= F.col("end"))))
    seen = asked.join(cells, ["row", "cell"]).select(
        "row", "kind", "start", "end", met([ACCESS, ID]).alias("with_id"), met([ASSIGN, HEX, KEY]).alias("with_key"))
    judged = seen.groupBy("row", "kind", "start", "end").agg(F.max("with_id").alias("with_id"), F.max("with_key").alias("with_key"))
    needed = F.when(F.col("kind") == ID, F.col("with_key")).when(F.col("kind") == KEY, F.col("with_id")) \
        .otherwise(F.col("with_id") & F.col("with_key"))
    return judged.where(needed).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_assign, n_access, n_hex, base, spans``: strong spans, and all spans, as sorted arrays of (start, kind, end)."""
    scanned = stored(scan(docs, id_col, text_col), "secret-parts")
    kept = ["id", "n_assign", "n_access", "n_hex", "base"]
    alone = scanned.where(F.size("parts") == 0).select(*kept, F.col("base").alias("spans"))
    linked = scanned.where(F.size("parts") > 0).drop("parts").join(link_parts(scanned), "row", "left").select(
        *kept, F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast(scanned.schema["base"].dataType)))).alias("spans"))
    return alone.unionByName(linked)


def spans_text(spans: str):
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
