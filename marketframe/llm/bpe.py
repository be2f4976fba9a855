"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before they reach the encoder, at places where the splitting pattern
starts a new match whatever stands around: before a single space between two letters or
digits. The ids of the parts, one after the other, are the ids of the whole text.

* A null or empty text has no ids and decodes to no bytes.
* Texts of any length are encoded whole; a stretch without a safe place stays in one part.
* Strings that look like special tokens are ordinary text.
* Repeated rows are encoded each on its own; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import bounded_batches, gives_back

RANKS = "byte_bpe_50k.tiktoken"
#: Texts above this many characters are cut.
PART_CHARS = 16_384

_SAFE = regex.compile(r"(?<=[\p{L}\p{N}]) (?=[\p{L}\p{N}])")


def load(ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    """The encoder of a rank file (a name of the public set, or a path); a task has its own and drops it at its end."""
    path = ranks if "/" in ranks else public_tokenizers.path(ranks)
    with open(path, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(ranks, pat_str=pattern, mergeable_ranks=table, special_tokens={})


encoding = lru_cache(maxsize=4)(load)


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """The text in parts of at least ``size`` characters that end at safe places."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def ids_of(text: str | None, encoder: tiktoken.Encoding, size: int = PART_CHARS) -> bytes:
    """The ids as little-endian unsigned 32-bit integers."""
    if not text:
        return b""
    return b"".join(np.asarray(encoder.encode_ordinary(part), "<u4").tobytes() for part in parts(text, size))


def encode(text: Column, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN, size: int = PART_CHARS) -> Column:
    """The ids of a text as binary: four little-endian bytes an id."""

    @F.pandas_udf("binary")
    @gives_back
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load(ranks, pattern)
        for texts in batches:
            yield pd.Series([ids_of(t, encoder, size) for t in texts], dtype=object)

    return run(text)


def decode(ids: Column, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> Column:
    """The bytes behind ids that ``encode`` made; they need not be valid UTF-8 on their own."""

    @F.pandas_udf("binary")
    @gives_back
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load(ranks, pattern)
        for rows in batches:
            yield pd.Series([encoder.decode_bytes(np.frombuffer(r, "<u4").tolist()) if r else b"" for r in rows], dtype=object)

    return run(ids)


def round_trip(text: Column, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN, size: int = PART_CHARS) -> Column:
    """Struct of ``token_ids`` and of ``decoded``, the bytes worked out from these ids, in one worker a task."""

    @F.pandas_udf("struct<token_ids:binary,decoded:binary>")
    @gives_back
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = load(ranks, pattern)
        for texts in batches:
            ids = [ids_of(t, encoder, size) for t in texts]
            yield pd.DataFrame({"token_ids": ids, "decoded": [encoder.decode_bytes(np.frombuffer(r, "<u4").tolist()) for r in ids]})

    return run(text)


def encode_documents(docs: DataFrame, ranks: str = RANKS, text: str = "text") -> DataFrame:
    """``doc_id``, ``token_ids`` and ``decoded``, both binary, for each row of ``docs``."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", round_trip(F.col(text), ranks).alias("b")).select("doc_id", "b.token_ids", "b.decoded")


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """Per document the number of ids and the digests of ids and decoded bytes; ``more`` columns go along."""
    return encoded.select(
        "doc_id", *more,
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
