"""Exact top-k inner products by norm buckets.

Vectors are grouped by length into buckets (a bucket spans a factor of ``RATIO``), large
buckets are dealt into blocks of bounded bytes, and a block is one row: ids, squared lengths
and the matrix, sorted by falling length. Queries are packed the same way. A first look at
one bounded block gives each query a threshold, the k-th best score so far. A query visits
only buckets whose length could still reach its threshold. In a block, the query's local
cosine threshold chooses the pruning:

* low thresholds: length pruning, the prefix of vectors that are long enough;
* high thresholds: coordinate pruning, the vectors whose largest query coordinates lie in
  the range that the angle allows.

What is left is verified by integer products, and the k best of each block are merged.

* Null or empty vectors, vectors with a null or non-finite component and rows with a null
  id take no part. Vectors of different lengths of list never meet.
* Ties go to the smaller id. Rows with the query's own id are no candidates; other repeated
  rows count once each; a repeated query row has one set of answers.
* Scores beyond 64 bits stop at the ends of their range.
* A query with fewer than k candidates gets all of them. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketframe.llm.common import settle

#: Longest by shortest vector of a bucket.
RATIO = 1.1
#: Components in a block of vectors, and in one of queries.
BLOCK_CELLS, QUERY_CELLS = 1 << 18, 1 << 16
#: From this local cosine threshold on, coordinates prune better than lengths.
COORDINATE_FROM = 0.5
FOCUS = 3
#: Products of lengths below this are exact in double precision.
EXACT = float(1 << 53)

_PACKED = "dim int, bucket int, block int, ids binary, norms binary, matrix binary"
_FOUND = "query_id long, vec_id long, score long"


def quantize(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as long; null unless all components are finite."""
    fine = F.size(vector) > 0
    fine = fine & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def with_buckets(vectors: DataFrame) -> DataFrame:
    """``id``, ``x``, squared length, list length and bucket; bucket 0 holds the zero vectors."""
    norm = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    out = vectors.where(F.col("id").isNotNull() & F.col("x").isNotNull()).select("id", "x", F.size("x").alias("dim"), norm.alias("n2"))
    level = F.floor(F.log(F.col("n2")) / (2 * float(np.log(RATIO)))).cast("int") + 1
    return out.withColumn("bucket", F.when(F.col("n2") < 1, F.lit(0)).otherwise(level))


def pack(rows: DataFrame, cells: int, extra: str) -> DataFrame:
    """Blocks of about ``cells`` components: one row with ids, squared lengths and matrix as bytes.

    A bucket is dealt by hash into as many blocks as its count asks for, so a bucket with all
    vectors is as many tasks as it needs. ``extra`` salts the hash.
    """
    size = F.greatest(F.lit(1), F.floor(F.lit(cells) / F.col("dim")))
    counts = rows.groupBy("dim", "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / size).cast("int"))
    dealt = rows.join(F.broadcast(counts.drop("n")), ["dim", "bucket"])  # one row per power of RATIO and list length
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id", F.lit(extra)), F.col("blocks")).cast("int"))

    def gather(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n2", "id"], ascending=[False, True])
        matrix = np.array(group["x"].tolist(), np.int64)
        return pd.DataFrame([[key[0], key[1], key[2], group["id"].to_numpy(np.int64).tobytes(), group["n2"].to_numpy(float).tobytes(), matrix.tobytes()]],
                            columns=["dim", "bucket", "block", "ids", "norms", "matrix"])

    return dealt.groupBy("dim", "bucket", "block").applyInPandas(gather, _PACKED)


def unpack(dim: int, ids: bytes, norms: bytes, matrix: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.sqrt(np.frombuffer(norms, float)), np.frombuffer(matrix, np.int64).reshape(-1, dim)


def products(queries: np.ndarray, vectors: np.ndarray, bound: float) -> np.ndarray:
    """Exact integer inner products; ``bound`` is on the product of two lengths."""
    if bound < EXACT:
        return (queries.astype(float) @ vectors.astype(float).T).astype(np.int64)
    whole = queries.astype(object) @ vectors.astype(object).T
    return np.clip(whole, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= edge)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def angle_candidates(unit: np.ndarray, order: list, sorted_by: list, threshold: float, n: int) -> np.ndarray:
    """Places whose focus coordinates are within the angle of ``threshold`` from the query.

    ``unit`` is the query's direction; ``order[j]`` and ``sorted_by[j]`` are the block's
    directions sorted by coordinate j.
    """
    alpha = np.arccos(min(1.0, threshold))
    hits = np.zeros(n, np.int8)
    focus = np.argsort(-np.abs(unit))[:FOCUS]
    for j in focus:
        beta = np.arccos(np.clip(unit[j], -1, 1))
        low = np.cos(min(np.pi, beta + alpha)) - 1e-9
        high = np.cos(max(0.0, beta - alpha)) + 1e-9
        a, b = np.searchsorted(sorted_by[j], low, "left"), np.searchsorted(sorted_by[j], high, "right")
        hits[order[j][a:b]] += 1
    return np.flatnonzero(hits == len(focus))


def search_block(queries: tuple, thresholds: np.ndarray, block: tuple, k: int) -> Iterator[tuple[int, int, int]]:
    """The k best of one block for each query, among those that reach the query's threshold."""
    q_ids, q_len, q = queries
    ids, lengths, vectors = block
    bound = float(q_len.max(initial=0) * lengths.max(initial=0)) * (1 + 1e-9)
    longest = lengths[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(q_len * longest > 0, thresholds / (q_len * longest), np.where(thresholds <= 0, -1.0, 2.0))
    alive = local <= 1 + 1e-9
    steep = alive & (local >= COORDINATE_FROM) & (bound < EXACT)
    flat = np.flatnonzero(alive & ~steep)
    for start in range(0, len(flat), 256):
        part = flat[start : start + 256]
        scores = products(q[part], vectors, bound)
        for row, i in zip(scores, part):
            # lengths fall: only a prefix can reach the threshold
            cut = len(ids)
            if thresholds[i] > 0:
                cut = int(np.searchsorted(-lengths, -(thresholds[i] / q_len[i]) * (1 - 1e-9), "right"))
            keep = np.flatnonzero((row[:cut] >= thresholds[i]) & (ids[:cut] != q_ids[i]))
            for p in keep[best(row[keep], ids[keep], k)]:
                yield int(q_ids[i]), int(ids[p]), int(row[p])
    if steep.any():
        # the local threshold holds for the longest vector of the block and is only higher for the others
        units = vectors / np.where(lengths > 0, lengths, 1)[:, None]
        order, sorted_by = {}, {}
        exact = vectors.astype(float)
        for i in np.flatnonzero(steep):
            unit = q[i] / q_len[i]
            for j in np.argsort(-np.abs(unit))[:FOCUS]:
                if j not in order:
                    order[j] = np.argsort(units[:, j], kind="stable")
                    sorted_by[j] = units[order[j], j]
            near = angle_candidates(unit, order, sorted_by, float(local[i]), len(ids))
            scores = (exact[near] @ q[i].astype(float)).astype(np.int64)
            keep = np.flatnonzero((scores >= thresholds[i]) & (ids[near] != q_ids[i]))
            for p in keep[best(scores[keep], ids[near][keep], k)]:
                yield int(q_ids[i]), int(ids[near[p]]), int(scores[p])


def first_thresholds(queries: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Each block of queries with the k-th best score of each against one block (-inf if fewer)."""
    # one block of bounded bytes per list length: the largest, of equal ones the longest vectors
    order = Window.partitionBy("dim").orderBy(F.col("size").desc(), F.col("bucket").desc(), "block")
    sizes = blocks.select("dim", "bucket", "block", F.octet_length("ids").alias("size"))
    chosen = sizes.withColumn("n", F.row_number().over(order)).where("n = 1").select("dim", "bucket", "block")
    seeds = {r.dim: unpack(r.dim, r.ids, r.norms, r.matrix) for r in chosen.join(blocks, ["dim", "bucket", "block"]).toLocalIterator()}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                ids, lengths, matrix = unpack(row["dim"], row["ids"], row["norms"], row["matrix"])
                low = np.full(len(ids), -np.inf)
                if row["dim"] in seeds:
                    s_ids, s_len, s = seeds[row["dim"]]
                    bound = float(lengths.max() * s_len.max()) * (1 + 1e-9)
                    for a in range(0, len(ids), 256):
                        for i, scores in enumerate(products(matrix[a : a + 256], s, bound), a):
                            own = scores[s_ids != ids[i]]
                            if len(own) >= k:
                                low[i] = np.partition(own, len(own) - k)[len(own) - k]
                with np.errstate(divide="ignore", invalid="ignore"):
                    # the shortest length that can still reach a threshold
                    need = np.where(low > 0, low / np.where(lengths > 0, lengths, 1e-300), 0.0)
                out.append(row | {"low": low.tobytes(), "reach": float(need.min(initial=0.0))})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("dim", pa.int32()), ("bucket", pa.int32()), ("block", pa.int32()), ("ids", pa.binary()), ("norms", pa.binary()),
                        ("matrix", pa.binary()), ("low", pa.binary()), ("reach", pa.float64())])
    return queries.mapInArrow(look, _PACKED + ", low binary, reach double")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the k largest inner products of each query.

    Both tables have ``id`` and ``x`` (array of long, see ``quantize``).
    """
    blocks = settle(pack(with_buckets(vectors), BLOCK_CELLS, "v"), "topk-vectors")
    asked = settle(pack(with_buckets(queries.dropDuplicates(["id"])), QUERY_CELLS, "q"), "topk-queries")
    asked = first_thresholds(asked, blocks, k)
    # the longest length of each bucket: one row per power of RATIO, never more than a few hundred a list length
    shelves = blocks.groupBy("dim", "bucket").agg(F.max("block").alias("last"))
    longest = F.pow(F.lit(RATIO), F.col("v_bucket")) * (1 + 1e-9)
    plan = asked.select(F.col("dim"), F.col("ids").alias("q_ids"), F.col("norms").alias("q_norms"), F.col("matrix").alias("q_matrix"), "low", "reach").join(
        F.broadcast(shelves.select("dim", F.col("bucket").alias("v_bucket"), "last")), "dim")
    plan = plan.where((longest >= F.col("reach")) | (F.col("reach") <= 0)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("last"))))
    paired = plan.join(blocks.withColumnRenamed("bucket", "v_bucket"), ["dim", "v_bucket", "block"]).select(
        "dim", "q_ids", "q_norms", "q_matrix", "low", "ids", "norms", "matrix")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                asked_for = unpack(row["dim"], row["q_ids"], row["q_norms"], row["q_matrix"])
                found = list(search_block(asked_for, np.frombuffer(row["low"], float), unpack(row["dim"], row["ids"], row["norms"], row["matrix"]), k))
                columns = list(zip(*found)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    found = paired.mapInArrow(search, _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
