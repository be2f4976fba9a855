"""The corpus pipeline: five stages over ``documents``, each an operator of ``marketframe.llm``.

Every stage takes (spark, docs, sf_dir) and returns the columns of ``documents``, the last
one ids. A stage works on all that its predecessor kept, and its decisions take effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.llm import bpe, mixing, overlap, recompress, simhash, zlang
from marketframe.llm.common import settle, table

#: No SQL: compression sizes, XXH64 and byte-pair merges have no form in it. Tested against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language is rejected: no letter, or no margin between two languages."""
    dictionaries = zlang.learn(docs.select("doc_id", "text", "lang"))
    judged = docs.withColumn("__language", zlang.predict(F.col("text"), dictionaries))
    return judged.where(~F.col("__language.rejected")).drop("__language")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, the one with the smallest id.

    SimHash fingerprints of the five-word shingles are linked through BK-trees, and a link of
    0.8 or more joins; a prefix filter then finds the pairs of 0.8 that lie beyond the radius.
    """
    return overlap.keep_one(docs, radius=simhash.RADIUS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove words in runs of twenty or more that an earlier document or place has.

    A text that loses nothing stays as it is; of others the words left are joined by one
    space, and a document that loses all its words goes.
    """
    cut = recompress.remove_repeats(docs, into="__cut")
    text = F.when(F.col("__cut.n_removed") > 0, F.col("__cut.kept")).otherwise(F.col("text"))
    kept = cut.where((F.col("__cut.n_removed") == 0) | (F.col("__cut.n_removed") < F.col("__cut.n_words")))
    return kept.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents by their rates; good documents are never below one copy on average.

    The budget is the one at which the good domain's target is 1.15 times its present tokens,
    so the targets are met by fewer poor and toxic documents and not by fewer good ones.
    """
    mixed = mixing.mixing_rates(docs, table(spark, sf_dir, "labels"), protect="good", margin=1.15, into="__mix")
    times = mixing.copies(F.col("__mix.rate"), F.col("doc_id"), F.col("text"))
    return mixed.withColumn("__mix", F.explode(F.array_repeat(F.lit(1), times))).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, with digests of the ids and of the bytes decoded from them."""
    encoded = bpe.encode_documents(docs)
    return bpe.digests(encoded, "token_ids")


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", substrings),
    ("mixing to target weights", mixture),
    ("byte-level BPE", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other; each result is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = settle(docs, f"stage-{number}")
    return docs
