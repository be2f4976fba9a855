"""What the operators on repeated passages share: places in documents, and what they cover."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import gives_back, raw

#: Stands for a null ``doc_id``: after all others.
NULL_LAST = (1 << 63) - 1
#: Bytes of text that a task works on at once; a longer text is alone.
BATCH_BYTES = 1 << 18

_U = np.uint64


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finalizer: every bit of the result depends on every bit of ``x``."""
    x = x + _U((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class RangeHash:
    """Hashes of any ranges of a sequence of 64-bit symbols, from sums of powers."""

    STEP, BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        powers = np.cumprod(np.full(n, _U(self.STEP)), dtype=_U)
        self.inverse = np.cumprod(np.full(n + 1, _U(self.BACK)), dtype=_U)
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(symbols * powers, dtype=_U)])

    def of(self, start: np.ndarray, stop: np.ndarray, salt: int = 0) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.inverse[start], salt)


def digests(data: bytes, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """XXH3 of each range of bytes: decides where ``RangeHash`` only gathers, since that can be driven to collide."""
    of, view = xxhash.xxh3_64_intdigest, memoryview(data)
    return np.array([of(view[a:b]) for a, b in zip(start.tolist(), stop.tolist())], _U).view(np.int64)


def identified(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id`` (null last), ``th``, a hash of the text, and ``text`` as bytes (null: empty)."""
    data = raw(text)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_LAST)).alias("doc_id"), F.xxhash64(data).alias("th"), data.alias("text"))


def joined_batches(batches: Iterator[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[list[tuple]]:
    """The rows of Arrow batches in lists of about ``limit`` bytes of their last column."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*batch.columns):
            held.append(tuple(value.as_py() for value in row))
            size += len(held[-1][-1] or "")
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the keys of ``identified`` as ``__id`` and ``__th``."""
    return docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_LAST))).withColumn("__th", F.xxhash64(raw("text")))


def sent_back(docs: DataFrame, wanted: DataFrame, run: Callable, schema: str) -> DataFrame:
    """Give each document's text to ``run`` with its row of ``wanted`` (``doc_id``, ``th``, ``asked``).

    ``run`` takes lists of (doc_id, th, asked, text as bytes). The texts are dealt by key with
    all columns of ``docs``, as ``with_marks`` deals them: in one plan Spark shuffles them once.
    """
    met = keyed(docs).join(wanted.withColumnsRenamed({"doc_id": "__id", "th": "__th", "asked": "__asked"}), ["__id", "__th"])

    @gives_back
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = (b.select(["__id", "__th", "__asked", "text"]) for b in batches)
        for group in joined_batches(own):
            yield from run([(i, th, asked, (text or "").encode()) for i, th, asked, text in group])

    return met.mapInArrow(rows, schema)


def with_marks(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` and a column ``__marks``: start, n, start, n, … of each row's marked windows.

    ``found`` has ``doc_id``, ``th``, ``start`` and ``n``. A row's marks are no more than its
    text has places.
    """
    pairs = F.flatten(F.transform(F.collect_set(F.struct("start", "n")), lambda m: F.array(m.start, m.n)))
    marks = found.groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).agg(pairs.alias("__marks"))
    return keyed(docs).join(marks, ["__id", "__th"], "left").drop("__id", "__th")


def covered(marks: np.ndarray | None, n: int, window: int) -> np.ndarray | None:
    """Which of n places the marked windows cover; None if there are none."""
    if marks is None or not len(marks):
        return None
    pairs = np.asarray(marks, np.int64).reshape(-1, 2)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, pairs[:, 0], 1)
    np.add.at(edge, np.minimum(pairs[:, 0] + pairs[:, 1] + window - 1, n), -1)
    return np.cumsum(edge[:n]) > 0
