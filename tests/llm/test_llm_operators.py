"""Training-data operators against plain Python, exact round trips and held-out labels."""

import os
import random
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute as B  # noqa: E402

from metablend.llm import (backoff_lm, bagminhash, decontaminate, exact_dedup, line_chunks, mixing,  # noqa: E402
                           prefix_tokens, toxicity, url_graph, warc, words)
from metablend.llm.common import checkpointed, work_path  # noqa: E402

SMALL = "/root/testdata/sf0.001"
CLASH = ("doc_id bigint, text string, source string, lang string, n_chars bigint, id string, node string, bands int, "
         "row string, digest string, size int, th int, score string, block int, p int, comp string, rank int, keep_id int")


def table(spark, rows):
    """rows of (doc_id, text, source), with extra columns whose names clash with the operators' own."""
    data = [(i, t, s, "en", None if t is None else len(t), "x", "y", 1, "r", "d", 2, 3, "s", 4, 5, "c", 6, 7) for i, t, s in rows]
    return spark.createDataFrame(data, CLASH)


def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    long = " ".join(rng.choice(vocab) for _ in range(60_000))
    body = "\n".join(" ".join(rng.choice(vocab) for _ in range(30)) for _ in range(6))
    near = body.replace(body.split(" ")[40], "changed", 1)
    rows = [(1, None, "a"), (2, "", "b"), (3, None, None), (4, long, "a"), (5, body, "c"), (6, near, "c"), (7, body, None),
            (8, "Same Text", "a"), (9, "same text", "b"), (10, "same text", "b"), (10, "same text", "b"),
            (None, body, "a"), (11, "###", "a"), (12, "###", "a"), (13, "!!!", "a"), (14, "Größe 漢字\u2028x\n\n\n", "z"),
            (15, body + "\n" + long[:900], "a")]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, odd_rows()).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return table(spark, [])


@pytest.fixture(scope="module")
def small_docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


# --- op1 --------------------------------------------------------------------------------
def test_warc_round_trip(spark):
    big = "<p>" + "x" * 200 + "</p>"
    tricky = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\n" + "é" * 90
    rows = [(5, "http://a/1", big), (2, None, big), (9, "http://a b/\r\n", big), (1, "u", "tiny"), (3, "u", "tiny"), (4, "u", None),
            (6, "u", ""), (7, "u", tricky), (8, "u", tricky), (None, "u", big), (10, "u", big), (10, "u", big), (11, "u", "y" * 99),
            (12, "u", "y" * 99), (13, "u", "z" * 100), (14, "u", "z" * 100)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, payload string")
    a, b = work_path(spark, "t"), work_path(spark, "t")
    warc.write_archives(warc.page_records(pages), a, records_per_file=3)
    raw = warc.read_records(spark, a).collect()
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(((r.page_id, r.payload) for r in raw), key=key) == sorted(((r[0], r[2] or "") for r in rows), key=key)
    warc.deduplicate_archives(spark, a, b)
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, _, h in rows:
        h = h or ""
        again = h in first and first[h] != i
        want.append((i, len(h.encode()), B.sha(h), "revisit" if again else "response", first[h] if again else None))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
           for r in warc.read_records(spark, b, with_payload=False).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    # resolving deduplicated archives again changes nothing
    c = work_path(spark, "t")
    warc.deduplicate_archives(spark, b, c)
    again = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_records(spark, c).collect()]
    assert sorted(again, key=key) == sorted(want, key=key)


def test_warc_records_are_judged_by_their_bytes():
    def record(kind, block, *lines):
        head = "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", *lines, f"Content-Length: {len(block)}"])
        return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    archive = (record("warcinfo", b"software: x") + record("request", b"GET / HTTP/1.1\r\n\r\n")
               + record("response", http + b"hello", "WARC-Payload-Digest: sha256:0000", "X-Payload-Length: 99", "X-Page-ID: 7")
               + record("response", b"no http", "WARC-Target-URI:u") + record("response", http + "é".encode(), "WARC-Target-URI:u")
               + record("revisit", http, "WARC-Payload-Digest: sha1:ABC") + record("revisit", b"", "WARC-Payload-Digest: sha256:ab"))
    got = list(warc.parse_archive(archive))
    assert got == [(7, "response", None, None, B.sha("hello"), 5, "hello"), (None, "response", "u", None, B.sha("é"), 2, "é"),
                   (None, "revisit", None, None, None, None, None), (None, "revisit", None, None, "ab", None, None)]
    assert [r[:6] for r in warc.parse_archive(archive, with_payload=False)] == [r[:6] for r in got]


def test_warc_keeps_bare_revisits(spark):
    rows = [(1, "revisit", None, None, None, None, None), (2, "response", "u", None, B.sha("hello"), 5, "hello")]
    a, b = work_path(spark, "t"), work_path(spark, "t")
    warc.write_archives(spark.createDataFrame(rows, warc.RECORD), a)
    warc.deduplicate_archives(spark, a, b)
    assert sorted(map(tuple, warc.read_records(spark, b).collect())) == rows


def test_warc_of_an_empty_table(spark):
    path = work_path(spark, "t")
    warc.write_archives(warc.page_records(spark.createDataFrame([], "page_id bigint, url string, html string")), path)
    assert warc.read_records(spark, path).count() == 0


# --- op2 --------------------------------------------------------------------------------
def capped_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        free = {s: w for s, w in weight.items() if s not in full}
        rest = total - sum(full.values())
        share = {s: rest * w / sum(free.values()) for s, w in free.items()}
        over = {s: cap * sizes[s] for s in share if share[s] > cap * sizes[s]}
        if not over:
            return full | share
        full |= over
        if len(full) == len(weight):
            return full


def test_mix_targets_and_copies(spark, odd):
    rows = odd_rows()
    got = mixing.mix(odd).collect()
    assert len(got) == len(rows)
    import re
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = capped_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size <= 3 * r.size
    assert sorted((r.id, r.size) for r in got if r.id is not None) == sorted((i, size(t)) for i, t, _ in rows if i is not None)


def test_mix_comes_near_its_targets_and_reruns_agree(spark, small_docs):
    a = mixing.mix(small_docs).select("id", "source", "size", "target", "taken").toPandas()
    b = mixing.mix(small_docs.repartition(7)).select("id", "taken").toPandas()
    assert dict(zip(a.id, a.taken)) == dict(zip(b.id, b.taken))
    for _, g in a.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max()


def test_mix_carries_whole_rows(spark, odd):
    plain = mixing.mix(odd).collect()
    kept = mixing.mix(odd, keep=odd.columns).collect()
    key = lambda r: repr(tuple(r)[:8])
    assert sorted(map(key, plain)) == sorted(map(key, kept))
    assert sorted(repr(tuple(r.kept)) for r in kept) == sorted(repr(tuple(r)) for r in odd.collect())
    assert all(r.kept["doc_id"] == r.id for r in kept)


def test_mix_says_when_newton_has_not_arrived(spark, small_docs):
    sizes = small_docs.groupBy("source", mixing.word_size(F.col("text")).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    with pytest.raises(mixing.Unsolved):
        mixing.tilts(sizes, mixing.source_targets(sizes), steps=1)


def test_mix_of_nothing(nothing):
    assert mixing.mix(nothing).count() == 0


# --- op3 --------------------------------------------------------------------------------
def test_near_classes_match_all_pairs(spark, small_docs):
    docs = {r.doc_id: r.text for r in small_docs.collect()}
    got = {r.id: r.class_id for r in bagminhash.near_duplicate_classes(small_docs).collect()}
    assert got == B.near_classes(docs)


def test_bitmap_holds_the_wanted_nodes_and_few_others(spark):
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, (4000, 2)).astype(np.uint64)
    bitmap = bagminhash.wanted_bitmap(spark.createDataFrame([(bytearray(k.tobytes()),) for k in keys[:2000]], "node binary"))
    at = bagminhash._bit_of(keys)
    held = bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1
    assert held[:2000].all() and held[2000:].sum() <= 2 and int(np.unpackbits(bitmap).sum()) <= 2000


def test_near_classes_chain_without_common_leader(spark):
    """A family in which links form a chain: all in one class though few pairs are links."""
    rng = random.Random(2)
    text = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
    docs = {}
    for i in range(25):
        docs[i] = " ".join(text)
        for _ in range(3):
            text[rng.randrange(len(text))] = f"w{rng.randint(0, 10**6)}"
    want = B.near_classes(docs)
    got = {r.id: r.class_id for r in bagminhash.near_duplicate_classes(
        spark.createDataFrame(list(docs.items()), "doc_id int, text string")).collect()}
    assert got == want


def test_near_classes_of_odd_rows(spark, odd, nothing):
    rows = [(r.id, r.class_id, r.class_size) for r in bagminhash.near_duplicate_classes(odd).collect()]
    assert len(rows) == len(odd_rows())
    cls = {i: c for i, c, _ in rows if i is not None}
    assert cls[5] == cls[6] == cls[7] == 5 and cls[8] == cls[9] == cls[10] == 8
    assert cls[11] == cls[12] == 11 and cls[13] == 13
    assert cls[1] == cls[2] == cls[3] == 1
    assert [c for i, c, _ in rows if i is None] == [5]
    assert bagminhash.near_duplicate_classes(nothing).count() == 0


def test_signature_registers_are_unbiased():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 9, 60)
    b = np.maximum(0, a + rng.integers(-2, 3, 60))
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    same = []
    for s in range(40):
        code = bagminhash.mix64(np.arange(60, dtype=np.uint64) + np.uint64(1000 * s + 5))
        ra, rb = np.flatnonzero(a), np.flatnonzero(b)
        sig = bagminhash.signatures(np.r_[np.zeros(len(ra), int), np.ones(len(rb), int)],
                                    np.r_[code[ra], code[rb]], np.r_[a[ra], b[rb]], 2)
        same.append((sig[0] == sig[1]).mean())
    assert np.mean(same) == pytest.approx(true, abs=4 * np.std(same) / 40 ** 0.5 + 0.005)


# --- op4 --------------------------------------------------------------------------------
def test_backoff_scores(spark, odd, nothing):
    import collections
    import math
    rows = [(i, B.words(t)) for i, t, _ in odd_rows()]
    c = [collections.Counter(), collections.Counter(), collections.Counter()]
    for _, w in rows:
        for n in range(3):
            c[n].update(zip(*[w[k:] for k in range(n + 1)]))
    total = sum(len(w) for _, w in rows)

    def s(w):
        v = 0.0
        for k in range(len(w)):
            penalty, done = 0.0, False
            for n in (3, 2):
                if k + 1 >= n and not done:
                    g = tuple(w[k + 1 - n:k + 1])
                    if c[n - 1][g] >= 2:
                        v += penalty + math.log(c[n - 1][g] / c[n - 2][g[:-1]])
                        done = True
                    else:
                        penalty += math.log(0.4)
            if not done:
                v += penalty + math.log(c[0][(w[k],)] / total)
        return v

    key = lambda x: (x[0] is not None, x[0], x[1])
    for block_words, partition in ((3_000_000, 2_000_000), (50, 300)):
        got = backoff_lm.backoff_scores(odd, block_words=block_words, partition_ngrams=partition).collect()
        got = sorted(((r.id, r.n_words, r.score) for r in got), key=key)
        want = sorted(((i, len(w), s(w)) for i, w in rows), key=key)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert [x[2] for x in got] == pytest.approx([x[2] for x in want])
    assert backoff_lm.backoff_scores(nothing).count() == 0


# --- op5 --------------------------------------------------------------------------------
def test_prefix_counts_match_the_library():
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=prefix_tokens.tokenizer_path())
    table_ = prefix_tokens.counter(prefix_tokens.tokenizer_path())
    rng = random.Random(1)
    alphabet = list("ab cdeé\n\t.,▁  lloomm123漢字🙂\u0000") + ["<s>", "</s>", "<unk>", "<0x41>", " the", "tion"]
    for _ in range(300):
        x = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25)))
        want = [len(lib.encode(x[:i])) for i in range(len(x) + 1)]
        assert list(table_.prefix_counts(x)) == want
        for budget in (0, 1, 5, 1000):
            assert table_.longest_prefix(x, budget) == max(i for i, n in enumerate(want) if n <= budget)


def test_token_counts_match_the_library(spark, small_docs, odd, nothing):
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=prefix_tokens.tokenizer_path())
    for docs in (small_docs, odd):
        want = sorted((str(r.doc_id), len((r.text or "").encode()), len(lib.encode(r.text or ""))) for r in docs.collect())
        got = sorted((str(r.id), r.n_bytes, r.n_tokens) for r in prefix_tokens.count_tokens(docs).collect())
        assert got == want
    assert prefix_tokens.count_tokens(nothing).count() == 0


# --- op6 --------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def toxic_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return docs, toxicity.fit(docs, spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))


def test_held_out_toxicity(spark, toxic_model):
    docs, model = toxic_model
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = toxicity.score(docs, model).join(labels.withColumnRenamed("doc_id", "lid"), F.col("id") == F.col("lid")) \
        .where(toxicity.is_held_out(F.col("id"))).join(docs.select("doc_id", "lang"), F.col("id") == F.col("doc_id")).collect()
    flagged = [r for r in rows if r.score >= toxicity.THRESHOLD]
    assert sum(r.toxic == 1 for r in flagged) >= 0.95 * len(flagged)
    marked = [r for r in rows if r.toxic == 1 and r.lang == "en"]  # other languages carry few marks in this table
    assert sum(r.score >= toxicity.THRESHOLD for r in marked) >= 0.8 * len(marked)
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("seen,meant", [("1d10t", "idiot"), ("i d i o t", "idiot"), ("idiooooot", "idiot"), ("cl0wn", "clown"),
                                        ("tr@sh", "trash"), ("m.o.r.o.n", "moron"), ("st*pid", "stupid"), ("p4th3t1c", "pathetic")])
def test_restored_spans(toxic_model, seen, meant):
    assert toxic_model[1].chars.restore(seen.encode()) == meant.encode()


def test_disguised_words_count_like_plain_ones(spark, toxic_model):
    docs, model = toxic_model
    plain = "The thing is that he is an idiot and a clown and a moron and the others are stupid trash."
    hidden = "The thing is that he is an 1d10t and a c l o w n and a mooooron and the others are st*pid tr@sh."
    clean = "The thing is that he is in the thing and of the thing."
    rows = spark.createDataFrame([(1, plain), (2, hidden), (3, clean), (4, ""), (5, None)], "doc_id int, text string")
    s = {r.id: r.score for r in toxicity.score(rows, model).collect()}
    assert s[1] >= 0.7 and s[2] >= 0.7 and s[3] < 0.5 and s[4] == s[5] < 0.5


MIXED = {"idiot": ["1 d 1 0 t", "idi0+", "i  d  i  o  t", "i/d/i/o/t", "i\td,i - o\nt", "1_d_1_0_t", "idi000t", "1 d d 1 0 0 0 t"],
         "loser": ["l o $ e r", "l  0  s  e  r", "l;o;$;3;r", "l0ooo$er"]}


def test_mixed_disguises_are_scored_like_plain_words(spark, toxic_model):
    docs, model = toxic_model
    say = "The thing is that he is the {} of the things in the place."
    forms = [(plain, seen) for plain, all_seen in MIXED.items() for seen in [plain, "", *all_seen]]
    rows = spark.createDataFrame([(k, say.format(seen)) for k, (_, seen) in enumerate(forms)], "doc_id int, text string")
    got = {forms[r.id]: r.score for r in toxicity.score(rows, model).collect()}
    for plain, all_seen in MIXED.items():
        assert got[plain, plain] > got[plain, ""]
        assert {seen: got[plain, seen] for seen in all_seen} == {seen: pytest.approx(got[plain, plain]) for seen in all_seen}


def test_spans_stay_within_their_texts_and_leave_numbers_alone():
    texts = ["a b", "c d", "1 0 7 4", "* * *", "x", "", "call 4711 or 10.5 now", "i d", "i o t", "end!"]
    raw = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t) for t in texts])
    a, b = toxicity.disguised_spans(np.frombuffer(raw, np.uint8), offsets)
    assert [raw[x:y] for x, y in zip(a, b)] == [b"i o t", b"end!"]


def test_toxicity_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(4, 1), (5, 0), (8, None), (None, 1), (4, 0)], "doc_id bigint, toxic int")
    for lab in (labels, labels.limit(0)):
        got = toxicity.score(odd, toxicity.fit(odd, lab)).collect()
        assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(nothing, toxicity.fit(nothing, labels)).count() == 0


# --- op7 --------------------------------------------------------------------------------
def test_line_chunks_match_brute_force(spark, small_docs):
    rng = random.Random(4)
    docs = {r.doc_id: r.text for r in small_docs.collect()}
    passage = [" ".join(f"p{rng.randint(0, 999)}" for _ in range(40)) for _ in range(4)]
    for i in (1001, 1002, 1003):  # one passage at shifted places
        docs[i] = "\n".join([f"own line {i} {k}" for k in range(i - 999)] + passage + [f"end {i}"])
    docs[1004], docs[1005] = None, ""
    want = B.line_dedup(docs, line_chunks.SCALES, line_chunks.MIN_LINES, line_chunks.MIN_WORDS)
    got = line_chunks.remove_repeats(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")) \
        .select("row.doc_id", "row.text", "dedup.n_removed").collect()
    assert {r.doc_id: (r.text, r.n_removed) for r in got} == want
    assert sum(n for _, n in want.values()) > 0


def test_line_chunks_of_odd_rows(odd, nothing):
    got = line_chunks.remove_repeats(odd).select("row.*", "dedup.*").collect()
    assert len(got) == len(odd_rows())
    by = {r.doc_id: r for r in got}
    assert by[1].text is None and by[2].text == "" and by[1].n_lines == 0 and by[5].n_removed == 0 or by[5].text == ""
    assert [r.text for r in got if r.doc_id == 10] == ["same text", "same text"]
    assert line_chunks.remove_repeats(nothing).count() == 0


def repeated_passages(docs, min_words):
    """{id: line numbers} in later copies of any run of lines of min_words words or more, by comparing all pairs of lines."""
    at, gone = {}, {i: set() for i in docs}
    lines = {i: t.split("\n") for i, t in docs.items() if t is not None}
    for i in sorted(lines):
        for k, x in enumerate(lines[i]):
            for j, m in at.get(x, []):
                n, size = 0, 0  # the common run from here on
                while k + n < len(lines[i]) and m + n < len(lines[j]) and lines[i][k + n] == lines[j][m + n]:
                    size += len(lines[i][k + n].split())
                    n += 1
                while n and not lines[i][k + n - 1].strip():
                    n -= 1
                if size >= min_words and x.strip():
                    gone[i].update(range(k, k + n))
            at.setdefault(x, []).append((i, k))
    return gone


def test_repeated_passages_go_whatever_their_chunks(spark, small_docs):
    rng = random.Random(7)
    docs = {r.doc_id: r.text for r in small_docs.collect()}
    for p in range(40):  # runs of two to eight lines, some blank, between foreign lines
        sizes = [rng.choice((0, 1, 8, 20, 49)) for _ in range(rng.randint(2, 8))] + [26, 26]
        passage = [" ".join(f"q{rng.randint(0, 9999)}" for _ in range(n)) for n in sizes]
        for c in range(3):
            docs[2000 + 3 * p + c] = "\n".join([f"before {p} {c} {k}" for k in range(rng.randint(0, 3))] + passage
                                               + [f"after {p} {c} {k}" for k in range(rng.randint(0, 3))])
    docs[3000] = "\n".join(["one"] * 120)  # a passage that overlaps itself
    want = {i: n for i, n in repeated_passages(docs, line_chunks.MIN_WORDS).items() if n}
    table = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")

    def gone(**how):
        out = {}
        for r in line_chunks.repeats(table, **how).collect():
            out.setdefault(r.id, set()).update(range(r.first - 1, r.first - 1 + r.len))
        return out

    chunked, both = gone(), gone(passages=True)
    assert any(n - chunked.get(i, set()) for i, n in want.items())
    assert all(n <= both[i] for i, n in want.items())
    assert both == {i: chunked.get(i, set()) | want.get(i, set()) for i in chunked.keys() | want.keys()}


# --- op8 --------------------------------------------------------------------------------
def test_contamination_matches_brute_force(spark, small_docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    docs = {r.doc_id: r.text for r in small_docs.collect()}
    short = next(t for t in docs.values() if len(B.words(t)) > 60)
    items += [(900, " ".join(B.words(short)[5:9])), (901, "of"), (None, " ".join(B.words(short)[20:40])), (902, ""), (903, None),
              (904, " ".join(B.words(short)[20:40])), (900, "the")]
    docs[5001], docs[5002] = None, ""
    want = B.contamination(docs, items)
    table_ = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (64 << 20, 2000):
        got = decontaminate.find_contamination(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), table_,
                                               block_bytes=block)
        rows = got.collect()
        assert {r.id: (r.n_words, r.n_hit, sorted(r.item_ids)) for r in rows} == want
    for r in rows:  # the spans cover the hit words and nothing else
        raw = B.lower_az(docs[r.id] or "").encode()
        assert sum(len(B.words(raw[s.start:s.end].decode())) for s in r.spans) == r.n_hit


def test_contamination_of_odd_rows(spark, odd, nothing):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert {r.n_hit for r in decontaminate.find_contamination(odd, none).collect()} == {0}
    assert decontaminate.find_contamination(nothing, none).count() == 0


# --- op9 --------------------------------------------------------------------------------
def test_small_graphs_need_no_exchange_a_step(spark, monkeypatch):
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return checkpointed(df)

    edges = checkpointed(spark.createDataFrame(
        [(g, a, b, 1.0) for g in ("trust", "distrust") for a, b in (("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"))],
        "graph string, src string, dst string, w double"))
    seeds = checkpointed(spark.createDataFrame([("trust", "a", 1.0), ("distrust", "d", 1.0)], "graph string, host string, seed double"))
    monkeypatch.setattr(url_graph, "checkpointed", seen)
    together = {(r.graph, r.host): r.score for r in url_graph.pagerank(edges, seeds).collect()}
    steps = plans[1:]  # the first makes the table of moves
    assert steps and not any("Exchange hashpartitioning" in p for p in steps)
    plans.clear()
    monkeypatch.setattr(url_graph, "EDGES_PER_TASK", 3)
    apart = {(r.graph, r.host): r.score for r in url_graph.pagerank(edges, seeds).collect()}
    assert any("Exchange hashpartitioning" in p for p in plans[1:])
    assert together == pytest.approx(apart)


def test_url_graph(spark):
    link = lambda h: f'<a href="https://{h}/x?y">t</a> <img src=//img.net/i> <a href="/local">'
    rows = [(1, "http://a.org/x", link("b.net") * 2), (2, "https://B.net/y?q=1#z", link("spam.net")), (3, "http://spam.net", link("bad.com")),
            (4, "http://bad.com/de/1", None), (5, "http://www.example.org/es/9", ""), (6, "http://example.org/en/123", link("a.org")),
            (7, "http://example.org/en/2", link("A.ORG")), (8, None, "x"), (9, "no scheme", link("c.net")), (10, "http://notorg/es/", None),
            (11, "ftp://x.com/fr/#f", None), (11, "ftp://x.com/fr/#f", None), (None, "http://", None), (12, "a://b://c.org/d", None)]
    pages = spark.createDataFrame([(*r, 1.0, "v") for r in rows], "page_id bigint, url string, html string, score double, verdict string")
    got = url_graph.judge_urls(pages).collect()
    assert len(got) == len(rows)
    by = {r.id: r for r in got}
    assert (by[2].host, by[2].path, by[2].rule) == ("b.net", "/y", None)
    assert (by[8].host, by[8].path) == (by[9].host, by[9].path) == ("", "")
    assert (by[3].host, by[3].path) == ("spam.net", "")
    assert (by[12].host, by[12].path) == ("b:", "//c.org/d")
    assert (by[1].rule, by[1].verdict) == ("org/", "allow")
    assert (by[5].rule, by[5].verdict) == ("example.org/es/", "block")
    assert (by[6].rule, by[6].verdict) == ("example.org/en/1", "block")
    assert (by[7].rule, by[7].verdict) == ("org/", "allow")
    assert (by[4].rule, by[4].verdict) == ("com/de/", "block") and (by[11].rule, by[11].verdict) == ("com/fr/", "allow")
    assert by[10].rule is None
    # the same walk in plain Python
    edges = {}

    def add(a, b, w=1.0):
        if a and a != b:
            edges[a, b] = edges.get((a, b), 0.0) + w

    # an image by the scheme of its page is a link like others
    links = [(a, "img.net") for a in ("a.org", "a.org", "b.net", "spam.net", "example.org", "example.org")]
    links += [("a.org", "b.net")] * 2 + [("b.net", "spam.net"), ("spam.net", "bad.com"), ("example.org", "a.org"), ("example.org", "a.org")]
    hosts = {r.host for r in got} | {"b.net", "spam.net", "bad.com", "a.org", "img.net"}
    tree = set()
    for h in hosts - {""}:
        part = h.split(".")
        tree |= {".".join(part[k:]) for k in range(len(part))}
    for h in tree:
        up = h.partition(".")[2]
        if up:
            add(h, up)
            add(up, h)
    for a, b in links:
        add(a, b)
    allowed, blocked = {}, {}
    for r in got:
        if r.rule:
            kind = allowed if r.verdict == "allow" else blocked
            kind[r.host] = kind.get(r.host, 0) + 1
    norm = lambda d: {h: n / sum(d.values()) for h, n in d.items()}
    trust = B.pagerank(edges, norm(allowed), url_graph.DAMPING, 300)
    distrust = B.pagerank({(b, a): w for (a, b), w in edges.items()}, norm(blocked), url_graph.DAMPING, 300)
    for r in got:
        assert r.trust == pytest.approx(trust.get(r.host, 0.0), abs=url_graph.TOLERANCE)
        assert r.distrust == pytest.approx(distrust.get(r.host, 0.0), abs=url_graph.TOLERANCE)
        if r.rule is None:
            assert r.verdict == ("block" if r.distrust > r.trust else "allow")
    assert url_graph.judge_urls(pages.limit(0)).count() == 0


def test_distrust_reaches_the_far_end_of_a_chain(spark):
    # hosts that only link on, towards a blocked one: none is trusted, however long the way
    chain = [f"h{k}" for k in range(25)]
    rows = [(k, f"http://{h}/", f'<a href="http://{chain[k + 1]}/">' if k < 24 else f'<a href="http://com/de/">') for k, h in enumerate(chain)]
    rows.append((99, "http://com/de/x", None))
    got = url_graph.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r.id: r.verdict for r in got} == {r[0]: "block" for r in rows}


# --- op10 -------------------------------------------------------------------------------
def test_exact_dedup_across_batches(spark, odd, nothing):
    path = work_path(spark, "t")
    got = exact_dedup.dedup(odd, path).collect()
    rows = odd_rows()
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(B.lower_az(t or ""), []).append(i)
    key = lambda x: (x[0] is not None, x)
    want = []
    for i, t, _ in rows:
        g = groups[B.lower_az(t or "")]
        keep = max((x for x in g if x is not None), default=None)
        want.append((i, B.sha(B.lower_az(t or "")), keep, len(g), i == keep))
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    # a later batch: known texts stay with the first batch's documents, new ones are appended
    second = exact_dedup.dedup(table(spark, [(100, "SAME text", "q"), (101, "new", "q"), (102, "New", None)]), path)
    assert sorted((r._id, r.keep_id, r.kept) for r in second.collect()) == [(100, 10, False), (101, 102, False), (102, 102, True)]
    assert exact_dedup.dedup(nothing, work_path(spark, "t")).count() == 0


# --- word hashes ------------------------------------------------------------------------
def thue_morse(n):
    """Two words that differ everywhere and that polynomials modulo 2^64 cannot tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_word_hashes_tell_made_up_words_apart(spark):
    rng = random.Random(1)
    x, y = thue_morse(1024)
    vocabulary = [x, y] + ["".join(rng.choice("abcdefghij0é漢") for _ in range(n)) for n in [*range(1, 90), 500, 3000] for _ in range(3)]
    text = " ".join(rng.choice(vocabulary) for _ in range(4000)) + " " + " ".join(vocabulary)
    seen = {}
    for part in words.word_slices(pa.array([text, None, "", text.upper()]), 1 << 20):
        for r, a, b, h in zip(part.row, part.start, part.end, part.hash):
            seen.setdefault(bytes(part.buf[a:b]).decode().translate(str.maketrans("ABCDEFGHIJ", "abcdefghij")), set()).add(int(h))
    assert all(len(h) == 1 for w, h in seen.items() if "É" not in w) and len({min(h) for h in seen.values()}) == len(seen)
    docs = table(spark, [(1, f"{x} one two three four five", "a"), (2, f"{y} one two three four five", "a")])
    assert {r.id: r.class_id for r in bagminhash.near_duplicate_classes(docs).collect()} == {1: 1, 2: 2}
    assert sorted(r.n_trigrams for r in backoff_lm.backoff_scores(docs).collect()) == [3, 3]
    items = spark.createDataFrame([(7, f"{x} {y}")], "item_id bigint, text string")
    assert {r.id: r.n_hit for r in decontaminate.find_contamination(docs, items).collect()} == {1: 0, 2: 0}


def test_overlap_below_the_usual_threshold():
    codes = np.sort(np.random.default_rng(0).choice(1 << 40, 1000, replace=False).astype(np.uint64))
    pack = lambda c: c.view(np.uint8).reshape(-1, 8)[:, :bagminhash.CODE_BYTES].tobytes()
    assert bagminhash.overlap(pack(codes), pack(codes[:350]), 0.3) == pytest.approx(0.35)
    assert bagminhash.overlap(pack(codes), pack(codes[:350])) < 0.8


# --- pipeline ---------------------------------------------------------------------------
def test_pipeline_stages(spark):
    import corpus_pipeline as C
    from metablend.llm.common import stored
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    toxic_scores = {r.id: r.score for r in toxicity.score(docs, toxicity.fit(
        docs, spark.read.parquet(f"{SMALL}/labels.parquet"))).collect()}
    have = {r.doc_id: r.text for r in docs.collect()}
    out = stored(C.drop_toxic(spark, docs, SMALL), "t")
    assert out.columns == columns
    want = {i: t for i, t in have.items() if toxic_scores[i] < 0.7}
    assert {r.doc_id: r.text for r in out.collect()} == want

    chunked = B.line_dedup(want, line_chunks.SCALES, line_chunks.MIN_LINES, line_chunks.MIN_WORDS, numbers=True)
    passages = repeated_passages(want, line_chunks.MIN_WORDS)
    gone = {i: chunked.get(i, set()) | passages[i] for i in want}
    cleaned = {i: (t if t is None or not gone[i] else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]), len(gone[i]))
               for i, t in want.items()}
    out = stored(C.drop_repeated_lines(spark, out, SMALL), "t")
    assert out.columns == columns
    want = {i: t for i, (t, n) in cleaned.items() if not (n and t == "")}
    rows = out.collect()
    assert {r.doc_id: r.text for r in rows} == want
    assert all(r.n_chars == len(r.text) for r in rows if cleaned[r.doc_id][1])

    classes = B.near_classes(want)
    out = stored(C.drop_near_duplicates(spark, out, SMALL), "t")
    assert out.columns == columns
    want = {i: t for i, t in want.items() if classes[i] == i}
    assert {r.doc_id: r.text for r in out.collect()} == want

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    judged = B.contamination(want, items)
    out = stored(C.drop_contaminated(spark, out, SMALL), "t")
    assert out.columns == columns
    want = {i: t for i, t in want.items() if not (judged[i][1] and 20 * judged[i][1] >= judged[i][0])}
    assert {r.doc_id: r.text for r in out.collect()} == want

    mixed = C.mix_sources(spark, out, SMALL).collect()
    plan = {r.id: r for r in mixing.mix(out).collect()}
    assert set(plan) == set(want)
    assert {r.doc_id: (r.copies, r.text) for r in mixed} == {i: (r.copies, want[i]) for i, r in plan.items() if r.copies}
    assert all(r.taken <= 3 * r.size and r.taken == r.size * r.copies for r in mixed) and len(mixed) < len(want)
    full = C.run(spark, SMALL).collect()
    assert sorted(map(tuple, full)) == sorted(map(tuple, mixed))
