"""A corpus pipeline: toxic texts go, then near copies, then repeated passages,
then contaminated texts; what is left is written as pieces.

Every stage takes (session, documents, folder of the tables) and works on all
rows that the stage before kept. All but the last return the columns of
`documents`. A stage's result is written as Parquet below the shared folder and
read back as the next stage's documents, so a lost executor never costs more
than a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vouchermill.llm import decontaminate, jaccard, pieces, suffixes, toxicity
from vouchermill.llm.queries import PIECES, tokenizer
from vouchermill.llm.words import table
from vouchermill.session import shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts whose highest window scores 0.5 or more go."""
    return toxicity.drop_toxic(docs, table(spark, folder, "labels"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each component of links (five words, 0.8) the least doc_id stays."""
    return jaccard.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Bytes under 200-byte strings that also start elsewhere are cut out of the texts.

    `n_chars` counts the characters of the text that is left."""
    return suffixes.remove_repeats(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts with at least a twentieth of their words in benchmark windows go."""
    return decontaminate.drop_contaminated(docs, table(spark, folder, "benchmark"))


def write_pieces(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Sampled pieces of every text, seeded by its id, and the text they decode to."""
    return pieces.piece_report(docs, tokenizer(PIECES))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", keep_one_of_near_copies),
    ("suffix_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("pieces", write_pieces),
]

#: a recurrent network, hashes and sampled pieces have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = shared_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
