"""Token ids in grammar-compressed blocks (Re-Pair), with random access.

Documents are encoded with the tokenizers library, closed by an end id and dealt by ranges
of ``doc_id`` to shards. A shard writes blocks of about ``BLOCK_IDS`` ids. In a block,
frequent pairs of neighbouring symbols are replaced by nonterminals, again and again; a
round replaces the ``PAIRS_A_ROUND`` most frequent pairs at once where they do not overlap.
The block stores its rules, the expansion length of each nonterminal and the sequence that
is left, so any range of ids is found by a search in the running lengths and only the
symbols it touches are expanded.

The file format is a Parquet table that Spark writes and reads, a row per block:

    shard, block   place in the order of ids
    doc_ids        one per document: int64, little-endian; ``doc_nulls`` marks null ids
    lengths        ids per document: int64
    left, right    the rules: nonterminal ``base + i`` stands for left[i] right[i]; uint32
    spans          expansion length of each nonterminal: int64
    symbols        the sequence; uint32
    base, n_ids    first nonterminal, ids in the block

* Null and empty texts are the end id alone. Texts of any length are encoded whole; a
  document with more ids than a block has a block of its own.
* Order is by ``doc_id``, nulls first, ties by a hash of the text, then the text; repeated
  rows are documents of their own. An empty table writes a table without rows.
* Other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from marketframe.llm.common import gives_back

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
BLOCK_IDS = 1 << 20
PAIRS_A_ROUND, MIN_COUNT, ROUNDS = 4096, 8, 8
#: Words that a worker remembers, texts that it encodes at once, and the most texts and characters of one call of the library.
REMEMBERED, TOGETHER = 1 << 17, 64
CALL_TEXTS, CALL_CHARACTERS = 1 << 11, 1 << 16

SCHEMA = ("shard int, block int, doc_ids binary, doc_nulls binary, lengths binary, left binary, right binary, "
          "spans binary, symbols binary, base long, n_ids long")

#: Characters among which space and line end are the only blanks.
_PLAIN = re.compile(r"[\n\x20-\x7E¡-ɏ‐-‧€]*")


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str = VOCABULARY) -> Tokenizer:
    return Tokenizer.from_file(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))


class Encoder:
    """Ids of whole texts; the ids of a word are worked out by the library once.

    The library merges inside each match of its pattern alone, and a match always starts at
    a single space between two other characters. So where all blanks of a text are such
    spaces or line ends inside words, its ids are those of its words, each with the space
    before it. All other texts, and texts with an added token, go to the library whole.
    """

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        self.library = tokenizer(vocabulary)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        # bytes of each token; a byte-level vocabulary writes a character for a byte
        sizes = np.zeros(self.library.get_vocab_size(with_added_tokens=True), np.int64)
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            sizes[i] = len(token)
        self.sizes = sizes

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of every text; the library keeps several hundred bytes for each, so it gets a bounded part of them at a time."""
        out: list[bytes] = []
        first = held = 0
        for i, text in enumerate(texts):
            if i - first == CALL_TEXTS or (i > first and held + len(text) > CALL_CHARACTERS):
                out += self.call(texts[first:i])
                first, held = i, 0
            held += len(text)
        return out + self.call(texts[first:])

    def call(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each word with a space before it: a part of them goes as one text, which is cut where the words' bytes end."""
        out: list[bytes] = []
        for at in range(0, len(words), CALL_TEXTS):
            part = [" " + w for w in words[at : at + CALL_TEXTS]]
            text = "".join(part)
            ids = np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
            stops, ends = np.cumsum([len(w.encode()) for w in part]), np.cumsum(self.sizes[ids])
            cuts = np.searchsorted(ends, stops)
            if any(t in text for t in self.added) or cuts[-1] + 1 != len(ids) or (ends[cuts] != stops).any():
                out += self.whole(part)  # the words' ids are not side by side in the text's
            else:
                raw, cuts = ids.tobytes(), [0, *(4 * (cuts + 1)).tolist()]
                out += [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    def splits(self, text: str) -> bool:
        """Whether the text's words can be taken one by one."""
        if not _PLAIN.fullmatch(text) or text[0] in " \n" or text[-1] in " \n":
            return False
        return not ("  " in text or " \n" in text or "\n " in text or any(t in text for t in self.added))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        split = [t.split(" ") if t and self.splits(t) else None for t in texts]
        wanted: set[str] = set()
        for words in split:
            if words:
                wanted.update(words[1:])
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [w for w in wanted if w not in self.known]
        self.known.update(zip(new, self.words(new)))
        # what has no space before it, or goes whole
        rest = [i for i, t in enumerate(texts) if t]
        heads = dict(zip(rest, self.whole([split[i][0] if split[i] else texts[i] for i in rest])))
        known = self.known
        return [heads[i] + b"".join([known[w] for w in words[1:]]) if words else heads.get(i, b"") for i, words in enumerate(split)]


def compress(ids: np.ndarray, base: int, pairs: int = PAIRS_A_ROUND, min_count: int = MIN_COUNT, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """Rules (left, right), their expansion lengths and the sequence that is left."""
    symbols = ids.astype(np.uint64)
    lefts, rights, spans = [], [], [np.zeros(0, np.int64)]
    size_of = np.ones(0, np.int64)
    following = base
    for _ in range(rounds):
        if len(symbols) < 2:
            break
        keys = (symbols[:-1] << np.uint64(32)) | symbols[1:]
        ordered = np.sort(keys)
        edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        counts = np.diff(np.append(edges, len(ordered)))
        often = np.flatnonzero(counts >= min_count)
        if not len(often):
            break
        if len(often) > pairs:
            often = often[np.argsort(-counts[often], kind="stable")[:pairs]]
        chosen, weight = ordered[edges[often]], counts[often]
        by_key = np.argsort(chosen)
        chosen, weight = chosen[by_key], weight[by_key]
        rank = np.empty(len(chosen), np.int64)
        rank[np.argsort(-weight, kind="stable")] = np.arange(len(chosen))
        # a bitmap by hash spares most places the search
        slot = lambda k: ((k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        maybe = np.zeros(1 << 20, bool)
        maybe[slot(chosen)] = True
        places = np.flatnonzero(maybe[slot(keys)])
        found = np.searchsorted(chosen, keys[places])
        hit = (found < len(chosen)) & (chosen[np.minimum(found, len(chosen) - 1)] == keys[places])
        places, found = places[hit], found[hit]
        # of overlapping places the more frequent pair wins; in a run of one symbol every second place
        order = rank[found]
        before = np.full(len(places), len(chosen))
        after = before.copy()
        touch = np.diff(places) == 1
        before[1:][touch], after[:-1][touch] = order[:-1][touch], order[1:][touch]
        first = np.flatnonzero(np.concatenate([[True], ~touch | (order[1:] != order[:-1])])) if len(places) else places
        even = (np.arange(len(places)) - np.repeat(first, np.diff(np.append(first, len(places))))) % 2 == 0
        won = even & (order <= before) & (order <= after)
        places, found = places[won], found[won]
        used, names = np.unique(found, return_inverse=True)
        symbols[places] = following + names.astype(np.uint64)
        keep = np.ones(len(symbols), bool)
        keep[places + 1] = False
        symbols = symbols[keep]
        left, right = (chosen[used] >> np.uint64(32)).astype(np.int64), (chosen[used] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        length = lambda s: np.where(s < base, 1, size_of[np.maximum(s - base, 0)] if len(size_of) else 1)
        new = length(left) + length(right)
        lefts.append(left), rights.append(right), spans.append(new)
        size_of = np.concatenate([size_of, new])
        following += len(used)
    join = lambda parts: np.concatenate(parts).astype("<u4") if parts else np.zeros(0, "<u4")
    return join(lefts), join(rights), np.concatenate(spans).astype("<i8"), symbols.astype("<u4")


def expand(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """The ids behind a sequence: every round replaces all nonterminals by their two sides."""
    symbols = symbols.astype(np.int64)
    left, right = left.astype(np.int64), right.astype(np.int64)
    while True:
        inner = symbols >= base
        if not inner.any():
            return symbols
        out_at = np.arange(len(symbols)) + np.concatenate([[0], np.cumsum(inner)[:-1]])
        out = np.empty(len(symbols) + int(inner.sum()), np.int64)
        rule = symbols[inner] - base
        out[out_at[~inner]] = symbols[~inner]
        out[out_at[inner]] = left[rule]
        out[out_at[inner] + 1] = right[rule]
        symbols = out


class Block:
    """A block read back: any range of its ids without expanding the rest."""

    def __init__(self, row: dict) -> None:
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.left, self.right, self.base = read("left", "<u4"), read("right", "<u4"), row["base"]
        self.symbols, self.spans = read("symbols", "<u4"), read("spans", "<i8")
        self.lengths = read("lengths", "<i8")
        nulls = read("doc_nulls", np.uint8)
        self.doc_ids = [None if n else int(d) for d, n in zip(read("doc_ids", "<i8"), nulls)]
        symbols = self.symbols.astype(np.int64)
        inner = symbols >= self.base
        sizes = np.ones(len(symbols), np.int64)
        sizes[inner] = self.spans[symbols[inner] - self.base]
        self.ends = np.cumsum(sizes)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, "<u4")
        a = int(np.searchsorted(self.ends, start, "right"))
        b = int(np.searchsorted(self.ends, stop, "left")) + 1
        offset = int(self.ends[a - 1]) if a else 0
        return expand(self.symbols[a:b], self.left, self.right, self.base)[start - offset : stop - offset].astype("<u4")

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        stops = np.cumsum(self.lengths)
        step = 0
        while step < len(stops):
            # a run of documents at a time, so that no more than a part of the block is expanded
            start = int(stops[step] - self.lengths[step])
            last = max(step + 1, int(np.searchsorted(stops, start + (1 << 17), "right")))
            run = self.ids(start, int(stops[last - 1]))
            for k in range(step, last):
                yield self.doc_ids[k], run[int(stops[k] - self.lengths[k]) - start : int(stops[k]) - start]
            step = last


def block_row(shard: int, block: int, doc_ids: list, pieces: list[bytes], base: int) -> dict:
    ids = np.frombuffer(b"".join(pieces), "<u4")
    left, right, spans, symbols = compress(ids, base)
    return {
        "shard": shard, "block": block,
        "doc_ids": np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        "doc_nulls": np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        "lengths": np.array([len(p) // 4 for p in pieces], "<i8").tobytes(),
        "left": left.tobytes(), "right": right.tobytes(), "spans": spans.tobytes(), "symbols": symbols.tobytes(),
        "base": base, "n_ids": len(ids)}


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all documents in ascending order of ``doc_id`` to ``path``."""
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64()}
    schema = pa.schema([(n, kinds[k]) for n, k in (field.split() for field in SCHEMA.split(", "))])

    @gives_back
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's threads would each hold memory
        shard, encode = TaskContext.get().partitionId(), Encoder(vocabulary)
        base = max(encode.library.get_vocab_size(with_added_tokens=True), end_id + 1)
        end = np.array([end_id], "<u4").tobytes()
        block, doc_ids, pieces, held = 0, [], [], 0
        for batch in batches:
            for first in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(first, TOGETHER)
                for doc_id, ids in zip(some.column(0).to_pylist(), encode(some.column(1).to_pylist())):
                    piece = ids + end
                    if held and held + len(piece) // 4 > block_ids:
                        yield pa.RecordBatch.from_pylist([block_row(shard, block, doc_ids, pieces, base)], schema=schema)
                        block, doc_ids, pieces, held = block + 1, [], [], 0
                    doc_ids.append(doc_id)
                    pieces.append(piece)
                    held += len(piece) // 4
        if doc_ids:
            yield pa.RecordBatch.from_pylist([block_row(shard, block, doc_ids, pieces, base)], schema=schema)

    order = ["doc_id", "h", "text"]
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    dealt = placed.repartitionByRange(shards, "doc_id", "h").sortWithinPartitions(*order).select("doc_id", "text")
    dealt.mapInArrow(blocks, SCHEMA).write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of every document, from the files alone."""
    files = spark.read.schema(SCHEMA).parquet(path)
    sums = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))  # a row per shard
    inside = files.select("shard", "block", "n_ids").withColumn(
        "inside", F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids"))
    starts = inside.join(before, "shard").select("shard", "block", (F.col("before") + F.col("inside")).alias("start"))

    @gives_back
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                out, at = [], 0
                for doc_id, ids in Block(row).documents():
                    out.append((row["shard"], row["block"], doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
                    at += len(ids)
                yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=names).astype(kinds), schema=schema, preserve_index=False)

    names = ["shard", "block", "doc_id", "at", "n_tokens", "ids_crc32"]
    kinds = {"doc_id": "Int64"}
    schema = pa.schema([(n, pa.int32() if n in ("shard", "block") else pa.int64()) for n in names])
    found = files.mapInArrow(documents, "shard int, block int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["shard", "block"]).select(
        "doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
