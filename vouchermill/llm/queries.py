"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vouchermill.llm import centroids, chat, decontaminate, fixity, jaccard, pieces, quality, secret_scan, suffixes, syncmers, token_files, toxicity
from vouchermill.llm import turn_repair
from vouchermill.llm.words import table
from vouchermill.session import shared_folder

#: where the public tokenizers' files are looked up, and the id that ends a document
BYTE_BPE, END_ID = "byte_bpe_50k.json", 2
PIECES = "piece_bpe_32k.model"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return syncmers.compare_with_edits(table(spark, folder, "documents"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("key")


#: a conversation of control strings, added to the table: conv_id, turn, role, text
CONTROL = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op3_chat_windows(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(CONTROL, "conv_id bigint, turn bigint, role string, text string"))
    return chat.report(chat.format_windows(turns))


def op4_fixity(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    left, right = fixity.build_trees([pages, fixity.damaged(pages)])
    return fixity.report(left, right, spark).drop("n_extra")  # the statement's columns; the planted damage adds nothing


def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    out = shared_folder(spark, "token-files")
    token_files.write_token_files(table(spark, folder, "documents"), tokenizer(BYTE_BPE), END_ID, out)
    return token_files.token_report(spark, out)


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.piece_report(table(spark, folder, "documents"), tokenizer(PIECES))


def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.report_repeats(table(spark, folder, "documents"))


def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_classes(table(spark, folder, "documents")).drop("text_key", "first")


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.report(secret_scan.secret_spans(table(spark, folder, "documents")))


def op12_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    return turn_repair.report(turn_repair.damage(turn_repair.rows_of(table(spark, folder, "conversations"))))


def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.report(*centroids.cluster(table(spark, folder, "embeddings")))


QUERIES = (
    op1_fingerprints, op2_decontamination, op3_chat_windows, op4_fixity, op5_token_files, op6_quality, op7_pieces, op8_suffix_dedup,
    op9_jaccard_join, op10_toxicity, op11_secret_scan, op12_turn_repair, op13_centroids,
)


def registry():
    return {f.__name__: f for f in QUERIES}
