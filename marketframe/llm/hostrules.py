"""Quality rules of hosts: failures by host, shrunk by an empirical beta prior.

Each document is first judged alone (``base_failed``). The failures are counted by host, a
beta prior is fitted to the hosts' rates by the method of moments, and each host's rate is
shrunk towards the prior's mean: hosts with few documents follow the corpus, large hosts
their own documents. A host whose shrunk rate is above ``max_rate`` fails, and with it all
its documents.

* A null text has no words and fails on its own; very long texts are counted whole.
* A document with a null or empty host is judged alone and counts for no host.
* Repeated rows count once each. Ties cannot arise: every verdict is a comparison.
* An empty table gives an empty result. Columns other than the three named are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import settle

MIN_WORDS = 20
#: Percent of the words that may stand in repeated windows.
MAX_REPEATED = 30
WINDOW = 8
#: A host fails when its shrunk rate of failures is above this.
MAX_RATE = 0.5
#: The prior's weight in documents when all hosts fail at the same rate, and the most it can have.
MAX_STRENGTH = 1e6

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_BLANKS = re.compile(r"[\x20\x09-\x0D]+")
_COUNTS = "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long>"


def repeated_words(words: list, window: int = WINDOW) -> int:
    """Words inside windows whose sequence is found at two or more places."""
    if len(words) < window + 1:
        return 0
    places = list(zip(*(words[k:] for k in range(window))))
    often = Counter(places)
    if len(often) == len(places):
        return 0
    covered, reach = 0, 0
    for start, sequence in enumerate(places):
        if often[sequence] > 1:
            covered += start + window - max(reach, start)
            reach = start + window
    return covered


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0
    words = [w for w in _BLANKS.split(text) if w]
    seen: set[str] = set()
    doubled = 0
    for line in text.split("\n"):
        if _BLANKS.sub("", line):
            doubled += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(_SYMBOLS.findall(text)), doubled, repeated_words(words)


def counts(text: Column) -> Column:
    """A struct of the five counts of a text."""

    @F.pandas_udf(_COUNTS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(
                [text_counts(t) for t in texts],
                columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])

    return run(text)


def base_verdicts(docs: DataFrame, host: str = "source") -> DataFrame:
    """Counts of each document and whether it fails alone."""
    counted = docs.select("doc_id", F.nullif(F.col(host), F.lit("")).alias("host"), counts(F.col("text")).alias("c")).select("doc_id", "host", "c.*")
    return counted.withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))


def host_rates(judged: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """Per host: documents, failures, shrunk rate and verdict."""
    hosts = judged.where("host IS NOT NULL").groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    moments = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("spread")).withColumn(
        "strength", F.when(F.col("spread") > 0, F.least(F.lit(MAX_STRENGTH), F.greatest(
            F.lit(0.0), F.col("mean") * (1 - F.col("mean")) / F.col("spread") - 1))).otherwise(F.lit(MAX_STRENGTH)))
    mean, strength = moments.select("mean").scalar(), moments.select("strength").scalar()
    shrunk = (F.col("n_failed") + strength * mean) / (F.col("n_docs") + strength)
    return hosts.withColumn("host_rate", shrunk).withColumn("host_failed", F.col("host_rate") > max_rate)


def host_quality(docs: DataFrame, host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """Every document with its counts, its host's shrunk rate and whether it is kept.

    The join with the hosts is on the host name; a host with a third of the documents is one
    row on the other side, so the optimizer broadcasts or splits it by measured size.
    """
    judged = settle(base_verdicts(docs, host), "hostrules")
    hosts = host_rates(judged, max_rate).select("host", "n_docs", "host_rate", "host_failed")
    return judged.join(hosts, "host", "left").withColumn(
        "kept", ~F.col("base_failed") & ~F.coalesce(F.col("host_failed"), F.lit(False)))
