"""The registered training-data queries, one per operator, and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import (backoff_lm, bagminhash, decontaminate, exact_dedup, fill_middle, hard_negatives, line_chunks, mixing, prefix_tokens,
               secret_links, toxicity, url_graph, warc)
from .common import read_table, work_path


def op1_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    crawl, deduplicated = work_path(spark, "warc-crawl"), work_path(spark, "warc-dedup")
    warc.write_archives(warc.page_records(read_table(spark, sf_dir, "pages")), crawl)
    warc.deduplicate_archives(spark, crawl, deduplicated)
    return warc.read_records(spark, deduplicated, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies", "rate")


def op3_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = bagminhash.near_duplicate_classes(read_table(spark, sf_dir, "documents"))
    return classes.select(F.col("id").alias("doc_id"), "class_id", "class_size")


def op4_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = backoff_lm.backoff_scores(read_table(spark, sf_dir, "documents"))
    return scored.select(F.col("id").alias("doc_id"), "n_words", "n_trigrams", F.round("score", 4).alias("score"))


def op5_prefix_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = prefix_tokens.count_tokens(read_table(spark, sf_dir, "documents"))
    return counts.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens",
                         (F.col("n_tokens") > 4096).alias("over_limit"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), toxicity.is_held_out(F.col("id")).alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op7_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_chunks.remove_repeats(read_table(spark, sf_dir, "documents"), passages=True)
    return cleaned.select(F.col("row.doc_id").alias("doc_id"), "dedup.n_lines", "dedup.n_removed",
                          F.sha2(F.col("row.text").cast("binary"), 256).alias("text_sha256"))


def op8_fm_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(read_table(spark, sf_dir, "documents"),
                                             read_table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort("item_ids"), ",").cast("binary"), 256).alias("items_sha256"),
                        decontaminate.is_contaminated().alias("contaminated"))


def op9_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_graph.judge_urls(read_table(spark, sf_dir, "pages"))
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "trust", "distrust")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.dedup(read_table(spark, sf_dir, "documents"), work_path(spark, "digest-index"))
    return rows.select(F.col("_id").alias("doc_id"), "keep_id", "group_size", "kept",
                       F.col("digest").alias("text_sha256"))


def op11_threshold_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10)
                                                                 .otherwise(F.col("label")))
    return hard_negatives.mine_hard_negatives(vectors, F.col("vec_id") % 100 == 0).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_fim_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = fill_middle.fill_middle(fill_middle.frame_texts(read_table(spark, sf_dir, "documents")))
    return fill_middle.digests(outputs).select(
        F.col("id").alias("doc_id"), "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        "output_sha256", "restored_sha256")


def op13_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_links.find_secrets(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex",
                        F.sha2(secret_links.spans_text("base").cast("binary"), 256).alias("base_sha256"),
                        secret_links.spans_text("spans").alias("spans"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


LLM_QUERIES = {
    "pipeline": pipeline,
    "op1_warc_revisit": op1_warc_revisit,
    "op2_entropy_mix": op2_entropy_mix,
    "op3_bagminhash": op3_bagminhash,
    "op4_stupid_backoff": op4_stupid_backoff,
    "op5_prefix_tokens": op5_prefix_tokens,
    "op6_toxicity": op6_toxicity,
    "op7_line_chunks": op7_line_chunks,
    "op8_fm_decontaminate": op8_fm_decontaminate,
    "op9_url_graph": op9_url_graph,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_threshold_negatives": op11_threshold_negatives,
    "op12_fim_frames": op12_fim_frames,
    "op13_secret_links": op13_secret_links,
}

LLM_ORACLES = {
    "op1_warc_revisit": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
             d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest FROM p),
             f AS (SELECT payload_digest, min(page_id) AS first_page FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first_page IS NULL OR first_page IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first_page IS DISTINCT FROM page_id THEN first_page END AS refers_to
        FROM d LEFT JOIN f USING (payload_digest)""",
    "op4_stupid_backoff": """
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
             e AS (SELECT doc_id, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a
                   FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
             c1 AS (SELECT c, count(*) AS n FROM e GROUP BY c),
             c2 AS (SELECT b, c, count(*) AS n FROM e WHERE i > 1 GROUP BY b, c),
             c3 AS (SELECT a, b, c, count(*) AS n FROM e WHERE i > 2 GROUP BY a, b, c),
             s AS (SELECT e.doc_id, e.i, c3.n AS n3, x.n AS n2, y.n AS n2before, u.n AS n1, v.n AS n1before,
                          (SELECT count(*) FROM e) AS total
                   FROM e JOIN c1 u ON u.c = e.c LEFT JOIN c1 v ON v.c = e.b
                   LEFT JOIN c2 x ON x.b = e.b AND x.c = e.c LEFT JOIN c2 y ON y.b = e.a AND y.c = e.b
                   LEFT JOIN c3 ON c3.a = e.a AND c3.b = e.b AND c3.c = e.c),
             l AS (SELECT doc_id, CASE WHEN i > 2 AND n3 >= 2 THEN 1 ELSE 0 END AS tri,
                          CASE WHEN i > 2 AND n3 >= 2 THEN ln(n3 / n2before)
                               ELSE CASE WHEN i > 2 THEN ln(0.4) ELSE 0 END
                                    + CASE WHEN i > 1 AND n2 >= 2 THEN ln(n2 / n1before)
                                           ELSE CASE WHEN i > 1 THEN ln(0.4) ELSE 0 END + ln(n1 / total) END END AS v FROM s)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(tri, 0) AS BIGINT) AS n_trigrams,
               round(coalesce(v, 0.0), 4) AS score
        FROM d LEFT JOIN (SELECT doc_id, sum(tri) AS tri, sum(v) AS v FROM l GROUP BY doc_id) USING (doc_id)""",
    "op8_fm_decontaminate": """
        WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                        'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
             bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                        'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
             win AS (SELECT DISTINCT item_id, l, list_slice(w, i, i + l - 1) AS g
                     FROM (SELECT item_id, w, least(13, len(w)) AS l, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i
                           FROM bw WHERE len(w) > 0)),
             dg AS (SELECT doc_id, l, i, list_slice(w, i, i + l - 1) AS g
                    FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i
                          FROM dw, (SELECT DISTINCT l FROM win) WHERE len(w) >= l)),
             m AS (SELECT doc_id, dg.l, i, item_id FROM dg JOIN win ON dg.l = win.l AND dg.g = win.g),
             hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
                     FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM m) GROUP BY doc_id),
             it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
                    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op10_exact_dedup": """
        WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                   'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
             g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
        FROM t JOIN g USING (text_sha256)""",
    "op11_threshold_negatives": """
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id, a.label = b.label AS same,
                          CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
                   FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
             p AS (SELECT ar, anchor_id, br, vec_id AS positive_id, score AS positive_score FROM s WHERE same
                   QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id NULLS LAST, br) <= 5)
        SELECT p.anchor_id, positive_id,
               CAST(row_number() OVER (PARTITION BY p.ar, p.br ORDER BY score DESC, vec_id NULLS LAST, s.br) AS INTEGER) AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY rank <= 10""",
    "op12_fim_frames": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
             h AS (SELECT doc_id, x, len(x) AS n, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2,
                          CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4 FROM t),
             c AS (SELECT doc_id, x, n, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
                          CASE WHEN n = 0 OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                               WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN x
                           WHEN 'psm' THEN '<P>' || substring(x, 1, i) || '<S>' || substring(x, j + 1) || '<M>' || substring(x, i + 1, j - i)
                           ELSE '<S>' || substring(x, j + 1) || '<P>' || substring(x, 1, i) || '<M>' || substring(x, i + 1, j - i) END)
                   AS output_sha256,
               sha256(x) AS restored_sha256 FROM c""",
}
