"""Line deduplication by content-defined chunks (DataFrame operations only).

The lines of a document are hashed; a rolling hash over the last ``window`` line
hashes ends a chunk where it is 0 modulo ``divisor``, and a chunk also begins at a
line whose own hash is 0 modulo ``divisor``.  Boundaries depend on nearby content only, so
inserting or deleting lines shifts no boundary further off.  Several
(window, divisor) scales cut each text in several ways, so a passage of a few lines is
caught whatever stands before it.

A chunk of at least ``min_lines`` lines, or of one line of at least ``min_words`` words, that
occurs again anywhere is removed after its bytes are compared (through their SHA-256) with those of
its first occurrence (smallest id, then line).  The first occurrence stays, so every
removed line still exists in an earlier document.

Chunks alone miss passages whose ends are no boundaries.  With ``passages`` the shortest runs of lines that
reach ``min_words`` words, from every line onwards and from every line backwards, count as chunks too.  In a
passage of at least ``min_words`` words the last run onwards that still ends inside it is also the run backwards from its
end, so these runs cover every repeated passage from its first to its last line that is not blank, whatever its chunks.

Scale: the pass that finds repeats shuffles one small row (digest, id, line) per chunk,
summed up before the exchange; texts move once, to meet the lines to remove.  A chunk in a
third of all documents is one row in the aggregation and a splittable side in the join.

Edge cases: null texts stay null, empty texts stay empty, with nothing removed; a text with
nothing left becomes empty; a null id is smaller than any id; rows that repeat
id and text are the same document: each counts as the first occurrence of its own chunks, and both
get the same result; repeats inside one document are removed like others;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (window of line hashes, divisor)
SCALES = ((1, 2), (2, 2), (3, 2), (1, 3), (2, 3), (2, 4))
MIN_LINES = 2
MIN_WORDS = 50


def _chunk_ends(k: int, window: int, divisor: int) -> str:
    """SQL: the last line number (from 1) of every chunk, given line hashes ``h`` and their count ``n``."""
    rolling = " , ".join(f"get(h, i - {w + 1})" for w in range(window))
    return (f"filter(sequence(1, n), i -> i = n "
            f"OR pmod(xxhash64({k}, {rolling}), {divisor}) = 0 "
            f"OR pmod(xxhash64({k + 100}, get(h, i)), {divisor}) = 0)")


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, th, lines``: th (hash of the text) tells apart rows that share an id."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.select("id", F.xxhash64("text").alias("th"), F.split("text", "\n").alias("lines"))


def _pack(first: str, last: str) -> str:
    """SQL: a span as one bigint, so that array_distinct hashes it (structs are compared pair by pair)."""
    return f"shiftleft(CAST({first} AS BIGINT), 32) + {last}"


def _runs(min_words: int) -> list[str]:
    """SQL: for each line of ``full`` (numbers of lines with words) the shortest run onwards and backwards that
    reaches ``min_words``, given word counts ``w``; null where the text ends before.  Each line has a word
    at least, so ``min_words`` lines are enough."""
    def reach(lines: str, span: str) -> str:
        return (f"transform(full, (i, k) -> if(get(w, i - 1) >= {min_words}, {_pack('i', 'i')}, aggregate({lines}, "
                f"named_struct('s', 0, 'e', i), (a, j) -> if(a.s >= {min_words}, a, named_struct('s', a.s + get(w, j - 1), 'e', j)), "
                f"a -> if(a.s >= {min_words}, {span}, NULL))))")

    return [reach(f"slice(full, k + 1, {min_words})", _pack("i", "a.e")),
            reach(f"reverse(slice(full, greatest(k + 2 - {min_words}, 1), least(k + 1, {min_words})))", _pack("a.e", "i"))]


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scales=SCALES,
           min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, passages: bool = False) -> DataFrame:
    """``id, th, first, len, bytes`` of every chunk long enough to be removed, over all scales.

    ``bytes`` is the SHA-256 of all the chunk's bytes: bytes are compared through it, so texts
    of chunks need not travel.
    """
    rows = _lines(docs.where(docs[text_col].isNotNull()), id_col, text_col)
    rows = rows.select("id", "th", "lines", F.expr("transform(lines, x -> xxhash64(x))").alias("h"),
                       F.size("lines").alias("n"))
    rows = rows.withColumn("w", F.expr("transform(lines, x -> regexp_count(x, '\\\\S+'))"))
    rows = rows.withColumn("full", F.expr("filter(sequence(1, n), i -> get(w, i - 1) > 0)"))
    cut = rows.select("id", "th", "lines", "w", "full", *[F.expr(_chunk_ends(k, w, d)).alias(f"e{k}")
                                                          for k, (w, d) in enumerate(scales)])
    spans = [F.expr(f"transform(e{k}, (e, j) -> {_pack(f'if(j = 0, 1, get(e{k}, j - 1) + 1)', 'e')})")
             for k in range(len(scales))]
    if passages:
        spans += [F.expr(f"filter({runs}, c -> c IS NOT NULL)") for runs in _runs(min_words)]
    first, size = "CAST(shiftright(c, 32) AS INT)", "CAST((c & 4294967295) - shiftright(c, 32) + 1 AS INT)"
    text = f"array_join(slice(lines, {first}, {size}), '\n')"
    # digests are taken before the explosion, so a row carries a chunk's digest and never its document
    small = cut.select("id", "th", "lines", "w", F.array_distinct(F.flatten(F.array(*spans))).alias("cs")).select("id", "th", F.expr(
        f"transform(filter(cs, c -> {size} >= {min_lines} OR aggregate(slice(w, {first}, {size}), 0, (s, x) -> s + x) >= {min_words}), "
        f"c -> named_struct('first', {first}, 'len', {size}, 'bytes', unhex(sha2({text}, 256))))").alias("cs"))
    # inline_outer: from a plain inline Spark infers a filter on the array and evaluates its whole expression again
    return small.select("id", "th", F.inline_outer("cs")).where("first IS NOT NULL")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scales=SCALES,
            min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, passages: bool = False) -> DataFrame:
    """``id, th, first, len`` of the chunk occurrences to remove: equal bytes exist in an earlier place."""
    found = chunks(docs, id_col, text_col, scales, min_lines, min_words, passages)
    place = F.struct("id", "first", "th")
    heads = (found.groupBy("bytes", "len").agg(F.min(place).alias("head"), F.max(place).alias("last"))
             .where("head <> last").select(F.col("bytes").alias("hb"), F.col("len").alias("hl"), "head"))
    return (found.join(heads, (F.col("bytes") == F.col("hb")) & (F.col("len") == F.col("hl")))
            .where(~place.eqNullSafe(F.col("head"))).select("id", "th", "first", "len"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scales=SCALES,
                   min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, passages: bool = False) -> DataFrame:
    """Every row of ``docs`` with its text cleaned, plus ``n_lines`` and ``n_removed`` in a struct ``dedup``.

    Returned columns: all of ``docs`` (the text column replaced) as struct ``row``, and ``dedup``.
    """
    gone = repeats(docs, id_col, text_col, scales, min_lines, min_words, passages)
    gone = gone.groupBy("id", "th").agg(F.array_distinct(F.flatten(F.collect_set(
        F.expr("sequence(first, first + len - 1)")))).alias("lines_gone"))
    gone = gone.select(F.col("id").alias("gid"), F.col("th").alias("gth"), "lines_gone")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"),
                       docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("th"))
    joined = rows.join(gone, F.col("id").eqNullSafe(F.col("gid")) & (F.col("th") == F.col("gth")), "left")
    text = F.col("row")[text_col]
    # the lines are split once per row, before the look-ups
    joined = joined.select("row", "lines_gone", F.split(text, "\n").alias("ls"), F.size(F.split(text, "\n")).alias("n"))
    left = F.expr("transform(array_except(sequence(1, n), lines_gone), i -> get(ls, i - 1))")
    cleaned = F.when(F.col("lines_gone").isNull() | (F.size("ls") < 1), text).otherwise(F.array_join(left, "\n"))
    n_lines = F.when(text.isNull(), 0).otherwise(F.col("n"))
    return joined.select(F.col("row").withField(f"`{text_col}`", cleaned).alias("row"),
                         F.struct(n_lines.alias("n_lines"),
                                  F.coalesce(F.size("lines_gone"), F.lit(0)).alias("n_removed")).alias("dedup"))
