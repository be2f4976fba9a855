"""Language by compression: the language whose dictionary makes a text smallest.

A bounded sample of labelled texts (``docs_per_language`` of each language, the first
``chars_per_doc`` characters of each) is the raw content of a zstandard dictionary per
language. A text, in lower case, is cut into blocks of ``BLOCK`` bytes, each block is compressed with each
dictionary, and the smallest sum wins. The margin to the runner-up, as a share of the
runner-up's size, is the score; a narrower margin than ``min_margin`` is a rejection.

* Null texts and texts without a letter are ``und`` with score 0 and rejected.
* Ties go to the language that sorts first. With one learned language the score is 1.
* Texts of any length are compressed whole. Repeated rows are predicted each on its own.
* Without labelled rows, or for an empty table, every text is ``und``.
* Only ``doc_id`` (choice of the sample), ``text`` and ``lang`` of labelled rows are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketframe.llm.common import bounded_batches, gives_back

DOCS_PER_LANGUAGE = 800
CHARS_PER_DOC = 400
LEVEL = 6
BLOCK = 4096
#: Narrower margins are rejected.
MIN_MARGIN = 0.002
UNKNOWN = "und"


def learn(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, chars_per_doc: int = CHARS_PER_DOC) -> dict[str, bytes]:
    """Raw dictionary content per language, from a sample that no size of the input exceeds.

    The sample is the texts with the smallest hashes of (id, text) in each language.
    """
    bounded_batches(labelled.sparkSession)
    order = Window.partitionBy("lang").orderBy("h", "text")
    picked = (
        labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
        .select("lang", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("h"), F.substring("text", 1, chars_per_doc).alias("text"))
        .withColumn("n", F.row_number().over(order)).where(F.col("n") <= docs_per_language)
        .groupBy("lang").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda x: x.text), "\n").alias("content")))
    return {row.lang: row.content.lower().encode() for row in picked.collect()}


def compressors(dictionaries: dict[str, bytes], level: int = LEVEL) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for name in sorted(dictionaries):
        content = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=level)
        out.append((name, zstandard.ZstdCompressor(dict_data=content, write_content_size=False, write_checksum=False)))
    return out


def predict_one(text: str | None, own: list[tuple[str, zstandard.ZstdCompressor]]) -> tuple[str, float]:
    if not text or not own or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0
    if len(own) == 1:
        return own[0][0], 1.0
    data = text.lower().encode()
    blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
    sizes = sorted((sum(len(c.compress(b)) for b in blocks), name) for name, c in own)
    return sizes[0][1], 1 - sizes[0][0] / sizes[1][0]


def predict(text: Column, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> Column:
    """A struct of ``lang_pred``, ``score`` and ``rejected``."""

    @F.pandas_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    @gives_back
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = compressors(dictionaries)
        for texts in batches:
            found = [predict_one(t, own) for t in texts]
            yield pd.DataFrame({"lang_pred": [f[0] for f in found], "score": [f[1] for f in found],
                                "rejected": [f[0] == UNKNOWN or f[1] < min_margin for f in found]})

    return run(text)
