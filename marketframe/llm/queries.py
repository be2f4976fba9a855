"""One registered query per operator, each over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.llm import bpe, chat, hostrules, licences, mending, mixing, negatives, recompress, repair, simhash, suffixes, topk, zlang
from marketframe.llm.common import shared_folder, table

LEARN_REMAINDER = 2


def op1_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    kept = hostrules.host_quality(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_norm_buckets(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("long").alias("id"), topk.quantize(F.col("embedding")).alias("x"))
    return topk.top_k(vectors, vectors.where(F.col("id") % 20 == 0))


def op3_suffix_repeats(spark: SparkSession, folder: str) -> DataFrame:
    cut = suffixes.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "cut.n_bytes", "cut.n_removed", "cut.n_spans", "cut.kept_sha256")


def op4_target_weights(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    mixed = mixing.mixing_rates(docs, table(spark, folder, "labels"), keep=["doc_id"])
    share = [F.col("mix.p")[k].alias(f"p_{name}") for k, name in enumerate(mixing.DOMAINS)]
    return mixed.select("doc_id", F.col("mix.tokens").alias("n_tokens"), *share, F.col("mix.rate").alias("rate"))


def op5_chat_windows(spark: SparkSession, folder: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    given = table(spark, folder, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat.digests(chat.windows(given.unionByName(extra)))


def op6_bk_trees(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op7_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(bpe.encode_documents(table(spark, folder, "documents")))


def op8_repair_blocks(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/token-blocks-{uuid.uuid4().hex}"
    repair.write(table(spark, folder, "documents"), path)
    return repair.read(spark, path)


def op9_compression_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == LEARN_REMAINDER
    dictionaries = zlang.learn(docs.where(~held_out))
    predicted = docs.select("doc_id", held_out.alias("held_out"), zlang.predict(F.col("text"), dictionaries).alias("p"))
    return predicted.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")


def op10_recompression(spark: SparkSession, folder: str) -> DataFrame:
    cut = recompress.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "cut.n_words", "cut.n_removed", "cut.kept_sha256")


def op11_residue_negatives(spark: SparkSession, folder: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("long").alias("id"), shifted.alias("label"), topk.quantize(F.col("embedding"), 256).alias("x"))
    return negatives.hard_negatives(rows, rows.where(F.col("id") % 100 == 0))


def op12_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "documents").select("doc_id", licences.scan(F.col("text")).alias("found"))
    return found.select("doc_id", "found.n_words", "found.n_base", "found.first_word", "found.last_word",
                        F.array_join("found.base_labels", ",").alias("base_labels"), F.array_join("found.labels", ",").alias("labels"),
                        "found.score", "found.restriction", F.array_join("found.expressions", "; ").alias("expressions"))


def op13_grammar_repair(spark: SparkSession, folder: str) -> DataFrame:
    return mending.digests(*mending.repair(mending.damaged(table(spark, folder, "conversations"))))


QUERIES = {
    "op1_host_rules": op1_host_rules,
    "op2_norm_buckets": op2_norm_buckets,
    "op3_suffix_repeats": op3_suffix_repeats,
    "op4_target_weights": op4_target_weights,
    "op5_chat_windows": op5_chat_windows,
    "op6_bk_trees": op6_bk_trees,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op8_repair_blocks": op8_repair_blocks,
    "op9_compression_language": op9_compression_language,
    "op10_recompression": op10_recompression,
    "op11_residue_negatives": op11_residue_negatives,
    "op12_license_scan": op12_license_scan,
    "op13_grammar_repair": op13_grammar_repair,
}
