"""SimHash near-duplicates with BK-trees.

Two 64-bit fingerprints within ``radius`` bits agree on all but ``radius`` of
``radius + agree`` blocks of bits, so each choice of ``agree`` blocks is a table and the
value of these blocks a shard: a linked pair meets in at least one shard. In a shard the
fingerprints form a BK-tree, children keyed by their integer Hamming distance to the
parent, and a search follows only the edges within the radius of the distance at hand.
Tree and searches go down together, a node at a time for all searches that reach it.
Shards are dealt by key, not broadcast whole: their number grows with the data.

Shards above ``SHARD_ROWS`` fingerprints are split: each part is a tree of its own, and each
pair of parts is a group of its own in which the later part searches the earlier one's tree,
so no task holds a whole hot shard and no link is lost. A shard returns a spanning star per
group, not all pairs.

* Fingerprints are taken over distinct values: copies cost nothing beyond the first.
* A null or empty text has fingerprint zero and links like any other.
* Repeated rows get the same result. A null id gets a fingerprint and its group's smallest
  id, and is never itself the smallest; a group of null ids only has a null component.
* An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import raw, settle
from marketframe.llm.graph import components
from marketframe.llm.passages import NULL_LAST

RADIUS = 4
#: Blocks that a table fixes; with six blocks of bits, fifteen tables of about 21 bits.
AGREE = 2
SHINGLE = 4
SEED = 42
#: Fingerprints in one tree.
SHARD_ROWS = 4096


def majority(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes."""
    ones, n = np.zeros(64, np.int64), len(hashes)
    for a in range(0, n, 65536):
        ones += np.unpackbits(hashes[a : a + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > n).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Bit i is 1 if it is set in over half of the hashes of the word shingles."""
    words = text.lower().split()  # bytes: only A-Z change, only the six ASCII blanks separate
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    last = min(size, len(words)) - 1
    hash64 = xxhash.xxh64_intdigest
    hashes = np.array([hash64(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[last : last + n].tolist())], "<u8")
    return majority(hashes)


def fingerprints(text: Column, size: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, size) for t in texts], dtype="int64")

    return run(raw(text))


def hex_digits(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def tables(radius: int = RADIUS, agree: int = AGREE) -> list[int]:
    """A mask of bits for each table, as signed integers."""
    count = radius + agree
    edges = [round(64 * i / count) for i in range(count + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(blocks, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def tree_links(tree: np.ndarray, searches: np.ndarray, radius: int) -> np.ndarray:
    """Group labels over tree then searches, joined by links within the radius.

    Goes down the BK-tree: a node takes the first of its values, its children are the rest
    by distance, and a search goes on to the children within ``radius`` of its own distance.
    """
    values = np.concatenate([tree, searches])
    labels = np.arange(len(values))
    same = searches is tree
    if same:
        values, labels = tree, np.arange(len(tree))
    first = 0 if same else len(tree)
    pending = [(np.arange(len(tree)), np.arange(first, len(values)))]
    while pending:
        nodes, asking = pending.pop()
        node, rest = nodes[0], nodes[1:]
        away = np.bitwise_count(values[asking] ^ values[node])
        hits = asking[away <= radius]
        if len(hits):
            found = np.unique(np.append(labels[hits], labels[node]))
            if len(found) > 1:
                labels[np.isin(labels, found[1:])] = found[0]
        if len(rest):
            keys = np.bitwise_count(values[rest] ^ values[node])
            for key in np.unique(keys):
                on = asking[np.abs(away.astype(int) - int(key)) <= radius]
                if len(on):
                    pending.append((rest[keys == key], on))
    return labels


def _stars(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of the shards in a sorted partition; a shard's rows come one after the other."""
    held: list[np.ndarray] = []
    key = None

    def close(rows: np.ndarray) -> list[np.ndarray]:
        tree, searches = rows[rows[:, 1] == 1, 0], rows[rows[:, 1] != 1, 0]
        tree = tree.view(np.uint64)
        searches = searches.view(np.uint64)
        out = []
        if len(tree) > 1 and not len(searches):
            labels = tree_links(tree, tree, radius)
            out.append(np.stack([tree, tree[labels]]))
        if len(tree) and len(searches):
            both = np.concatenate([tree, searches])
            labels = tree_links(tree, searches, radius)
            out.append(np.stack([both, both[labels]]))
        return [x[:, x[0] != x[1]] for x in out]

    def send(found: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.concatenate(found, axis=1).view(np.int64) if found else np.empty((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[0])), pa.array(np.ascontiguousarray(pairs[1]))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        rows = np.stack([columns[2], columns[3].astype(np.int64)], axis=1)
        change = np.flatnonzero((columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])) + 1
        cuts = [0, *change.tolist(), batch.num_rows]
        found: list[np.ndarray] = []
        for a, b in zip(cuts, cuts[1:]):
            here = (columns[0][a], columns[1][a])
            if here != key:
                if held:
                    found += close(np.concatenate(held))
                key, held = here, []
            held.append(rows[a:b])
        yield send(found)
    if held:
        yield send(close(np.concatenate(held)))


def links(values: DataFrame, radius: int = RADIUS, agree: int = AGREE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``a``, ``b``: stars that join the distinct fingerprints ``fp`` as their links do."""
    masks = tables(radius, agree)
    spread = values.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "bits"))
    shards = spread.groupBy("t", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / shard_rows).cast("int")
    met = spread.join(settle(shards, "shards"), ["t", "bits"]).withColumn("parts", parts)
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    met = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # a pair of two parts has searches, a part with itself has none; 64 bits stand for bits and parts
    dealt = met.select(
        F.xxhash64("t", "bits", F.least("own", "other"), F.greatest("own", "other")).alias("shard"), "t",
        "fp", (F.col("own") <= F.col("other")).cast("int").alias("is_tree"))
    return (dealt.repartition("shard").sortWithinPartitions("shard", "t")
            .mapInArrow(lambda batches: _stars(batches, radius), "a long, b long"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``th`` (a hash of the text), ``fp``, ``root`` and ``component_id`` of every row of ``docs``.

    ``root`` names the group by its smallest fingerprint, ``component_id`` by its smallest id.
    """
    prints = settle(docs.select("doc_id", F.xxhash64(raw("text")).alias("th"), fingerprints(F.col("text"), size).alias("fp")), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = settle(components(links(distinct, radius)), "roots").select(F.col("node").alias("fp"), "root")
    labelled = distinct.join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = settle(labelled.join(smallest, "root").select("fp", "root", "component_id"), "components")
    return prints.join(named, "fp").select("doc_id", "th", "fp", "root", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay when each group keeps its document with the smallest id.

    Ties between texts of one id go to the smaller hash; of repeated rows one stays.
    """
    key = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_LAST)).alias("__id"), F.col("th").alias("__th"))
    first = near_duplicates(docs, radius, size).groupBy("root").agg(F.min(key).alias("k")).select("k.*")
    keyed = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_LAST))).withColumn("__th", F.xxhash64(raw("text")))
    met = keyed.join(settle(first, "kept"), ["__id", "__th"], "left_semi")
    return met.dropDuplicates(["__id", "__th"]).select(*docs.columns)
