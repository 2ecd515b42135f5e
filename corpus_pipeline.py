"""A training corpus from ``documents``: five stages, each a Spark job over all its predecessor kept.

Stages but the last return the columns of ``documents``; every stage works on whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metablend.llm import bagminhash, decontaminate, line_chunks, mixing, toxicity
from metablend.llm.common import read_table, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-channel toxicity score rejects go."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=docs.columns, score_col="_toxicity")
    return scored.where(F.col("_toxicity") < toxicity.THRESHOLD).drop("_toxicity")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated line chunks and passages go, each but its first occurrence; a document that loses all its lines goes too."""
    cleaned = line_chunks.remove_repeats(docs, passages=True)
    changed = F.col("dedup.n_removed") > 0
    row = F.when(changed, F.col("row").withField("n_chars", F.char_length("row.text").cast(docs.schema["n_chars"].dataType))) \
        .otherwise(F.col("row"))
    return cleaned.where(~(changed & (F.col("row.text") == ""))).select(row.alias("row")).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays."""
    classes = bagminhash.near_duplicate_classes(docs)
    staying = classes.where(F.col("id").eqNullSafe(F.col("class_id"))).select(
        F.col("id").alias("_id"), F.col("th").alias("_th")).distinct()
    return docs.join(staying, docs["doc_id"].eqNullSafe(staying["_id"]) & (F.xxhash64(docs["text"]) == staying["_th"]), "left_semi")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth of the words or more go."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].alias("text"))
    judged = decontaminate.find_contamination(rows, read_table(spark, sf_dir, "benchmark"), id_col="row")
    return judged.where(~decontaminate.is_contaminated()).select("id.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents with the number of copies that brings sources to their target shares of words.

    Documents of which the mix takes no copy go.  Rows carry the columns of ``documents`` and ``size, source_size,
    target, copies, taken`` (with ``mix_`` before a name that ``documents`` has itself).
    """
    own = {c.lower() for c in docs.columns}
    facts = [F.col(c).alias("mix_" + c if c in own else c) for c in ("size", "source_size", "target", "copies", "taken")]
    return mixing.mix(docs, keep=docs.columns).where("copies > 0").select("kept.*", *facts)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

ORACLE_SQL = None  # the stages are not expressible in SQL; tests compare them with brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
