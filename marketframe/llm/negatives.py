"""Hard negatives by residue-number-system products.

Vectors are packed into blocks of bounded size, whatever their labels. A block of anchors
meets a block of vectors in a tile; the tiles cover all anchors against all vectors, so a
label that holds most rows is as many tasks as any other. Scores of two blocks are integer
inner products, and they are found without wide arithmetic:

* both matrices are reduced modulo several primes below 256, to the residues nearest zero;
* one float32 matrix product a prime (in runs of components so short that every sum stays
  below 2^24, where float32 is exact) gives the scores modulo that prime;
* mixed-radix Chinese remaindering puts the signed scores together again. There are as many
  primes as twice the product of the blocks' longest lengths asks for.

The first pass selects each anchor's best rows of its own label. The second pass computes
the scores of the other labels again, and selects the best rows of each positive's window of
scores. Both keep a few rows a block and merge them by rank; no list of scores is ever kept.

* Rows with a null id, label or vector, or a null or non-finite component, take no part.
  Vectors of different lengths of list never meet; empty vectors meet at score 0.
* Rows of one id count once: of different ones the least label, then the least vector.
* Ties go to the smaller id. A row with the anchor's id is neither positive nor negative.
* Scores beyond 64 bits stop at the ends of their range.
* An anchor without a row of its label, or a window without a row, gives no rows; nor does
  an empty table. Negative positives have empty windows, since the window's lower end would
  lie above its upper end.
* Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketframe.llm.common import settle

#: Components in a block, blocks on a tile's side, and anchors whose scores are held at a time.
BLOCK_CELLS, TILE, CHUNK = 1 << 17, 4, 128
#: Below this every sum of whole numbers is exact in float32.
EXACT = 1 << 24

_PACKED = "dim int, block int, blocks int, ids binary, labels binary, matrix binary"


@lru_cache(maxsize=1)
def primes() -> list[int]:
    """The primes below 256, largest first."""
    return [p for p in range(255, 2, -1) if all(p % q for q in range(2, int(p**0.5) + 1))]


def moduli(bound: float) -> list[int]:
    """So many primes that signed numbers up to ``bound`` differ in their residues."""
    chosen, product = [], 1
    for p in primes():
        if product > 2 * (int(bound) + 1):
            break
        chosen.append(p)
        product *= p
    return chosen


def residues(matrix: np.ndarray, p: int) -> np.ndarray:
    """Residues from -(p-1)/2 to (p-1)/2 as float32."""
    half = p // 2
    least = matrix % p
    return np.where(least > half, least - p, least).astype(np.float32)


def product_residues(left: np.ndarray, right: np.ndarray, p: int) -> np.ndarray:
    """left @ right.T modulo p, from 0 to p-1; both are residues of ``p``."""
    run = max(1, (EXACT - 1) // (p // 2) ** 2)
    total = np.zeros((len(left), len(right)), np.int64)
    for a in range(0, left.shape[1], run):
        total += (left[:, a : a + run] @ right[:, a : a + run].T).astype(np.int64)
    return total % p


def reconstruct(digits: list[np.ndarray], chosen: list[int]) -> np.ndarray:
    """The signed numbers that have these residues, by mixed-radix digits."""
    mixed: list[np.ndarray] = []
    for i, p in enumerate(chosen):
        value, weight = np.zeros_like(digits[i]), 1
        for digit, q in zip(mixed, chosen):
            value, weight = (value + digit * weight) % p, weight * q % p
        mixed.append((digits[i] - value) * pow(weight, -1, p) % p)
    whole = 1
    for p in chosen:
        whole *= p
    wide = whole >= 1 << 62
    value, weight = np.zeros(digits[0].shape, object if wide else np.int64), 1
    for digit, p in zip(mixed, chosen):
        value, weight = value + (digit.astype(object) if wide else digit) * weight, weight * p
    value = np.where(value > whole // 2, value - whole, value)
    return np.clip(value, -(1 << 63), (1 << 63) - 1).astype(np.int64) if wide else value


def longest(matrix: np.ndarray) -> float:
    return float(np.sqrt((matrix.astype(float) ** 2).sum(axis=1).max(initial=0.0))) * (1 + 1e-9)


def scores(anchors: np.ndarray, vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first anchor, inner products) for each run of anchors."""
    chosen = moduli(longest(anchors) * longest(vectors)) or primes()[:1]
    right = [residues(vectors, p) for p in chosen]
    for a in range(0, len(anchors), CHUNK):
        part = anchors[a : a + CHUNK]
        yield a, reconstruct([product_residues(residues(part, p), r, p) for p, r in zip(chosen, right)], chosen)


def first(row: np.ndarray, near: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Of the places ``near`` the k with the highest scores, ties to the smaller id."""
    if len(near) > k:
        got = row[near]
        near = near[got >= np.partition(got, len(near) - k)[len(near) - k]]
    return near[np.lexsort((ids[near], -row[near]))][:k]


def distinct_rows(rows: DataFrame) -> DataFrame:
    """``id``, ``label``, ``x``: one row an id."""
    usable = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull())
    least = usable.groupBy("id").agg(F.min(F.struct(F.col("label").cast("long").alias("label"), "x")).alias("row"))
    return least.select("id", "row.label", "row.x", F.size("row.x").alias("dim"))


def pack(rows: DataFrame) -> DataFrame:
    """Blocks of about ``BLOCK_CELLS`` components: ids, labels and matrix as bytes.

    Rows are dealt by a hash of their id, so no label, length or run of ids fills a block.
    The matrix has two bytes a component where they hold it, else eight.
    """
    size = F.floor(F.lit(BLOCK_CELLS) / F.greatest("dim", F.lit(1)))
    counts = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("dim", F.ceil(F.col("n") / F.greatest(size, F.lit(1))).cast("int").alias("blocks"))
    dealt = rows.join(counts, "dim").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def gather(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        matrix = np.array(group["x"].tolist(), np.int64).reshape(len(group), key[0])
        if matrix.size and -(1 << 15) <= matrix.min() and matrix.max() < 1 << 15:
            matrix = matrix.astype(np.int16)
        packed = [group["id"].to_numpy(np.int64).tobytes(), group["label"].to_numpy(np.int64).tobytes(), matrix.tobytes()]
        return pd.DataFrame([[key[0], key[1], key[2], *packed]], columns=["dim", "block", "blocks", "ids", "labels", "matrix"])

    return dealt.groupBy("dim", "block", "blocks").applyInPandas(gather, _PACKED)


def unpack(dim: int, ids: bytes, labels: bytes, matrix: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    known = np.frombuffer(ids, np.int64)
    kind = np.int16 if len(matrix) == 2 * dim * len(known) else np.int64
    return known, np.frombuffer(labels, np.int64), np.frombuffer(matrix, kind).reshape(len(known), dim).astype(np.int64)


def tiles(anchors: DataFrame, vectors: DataFrame) -> DataFrame:
    """Each block of anchors beside each block of vectors of its list length.

    A block goes to the tiles of its row or column: ``TILE`` blocks of the other side share
    one copy. Blocks count far less than the arithmetic on them.
    """
    def sides(rows: DataFrame, own: str) -> DataFrame:
        return rows.select("dim", F.floor((F.col("blocks") - 1) / TILE).alias(f"last_{own}")).distinct()

    a = anchors.withColumn("tile_a", F.floor(F.col("block") / TILE)).join(sides(vectors, "v"), "dim")
    a = a.withColumn("tile_v", F.explode(F.sequence(F.lit(0).cast("long"), "last_v"))).drop("last_v", "blocks")
    v = vectors.withColumn("tile_v", F.floor(F.col("block") / TILE)).join(sides(anchors, "a"), "dim")
    v = v.withColumn("tile_a", F.explode(F.sequence(F.lit(0).cast("long"), "last_a")))
    v = v.select("dim", "tile_a", "tile_v", *[F.col(c).alias(f"v_{c}") for c in ("ids", "labels", "matrix")])
    return a.join(v, ["dim", "tile_a", "tile_v"]).drop("tile_a", "tile_v")


def each_pair(pairs: DataFrame, visit, schema: str, arrow: pa.Schema) -> DataFrame:
    """``visit(row, anchors, vectors)`` yields tuples for one block of anchors and one of vectors."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                anchors = unpack(row["dim"], row["ids"], row["labels"], row["matrix"])
                vectors = unpack(row["dim"], row["v_ids"], row["v_labels"], row["v_matrix"])
                columns = list(zip(*visit(row, anchors, vectors))) or [()] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return pairs.mapInArrow(work, schema)


def positives(pairs: DataFrame, k: int) -> DataFrame:
    """``dim``, ``block``, ``anchor_id``, ``positive_id``, ``positive_score``: the k first rows of the anchor's label."""
    def visit(row: dict, anchors: tuple, vectors: tuple) -> Iterator[tuple]:
        (a_ids, a_labels, a), (ids, labels, v) = anchors, vectors
        for start, found in scores(a, v):
            for i, line in enumerate(found, start):
                near = np.flatnonzero((labels == a_labels[i]) & (ids != a_ids[i]))
                for p in first(line, near, ids, k):
                    yield row["dim"], row["block"], int(a_ids[i]), int(ids[p]), int(line[p])

    fields = [("dim", pa.int32()), ("block", pa.int32()), ("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())]
    found = each_pair(pairs, visit, "dim int, block int, anchor_id long, positive_id long, positive_score long", pa.schema(fields))
    order = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    return found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).drop("at")


def hard_negatives(rows: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``rows`` has ``id``, ``label`` and ``x`` (array of long, null for rows that take no part);
    ``anchors`` has the ``id`` of some of them. A negative's score is from ``low`` to ``high``
    hundredths of the positive's.
    """
    known = settle(distinct_rows(rows), "negatives-rows")  # packed twice, counted twice
    vectors = settle(pack(known), "negatives-vectors")
    asked = settle(pack(known.join(anchors.select("id").distinct(), "id", "left_semi")), "negatives-anchors")
    best = settle(positives(tiles(asked, vectors), n_positives), "negatives-positives")
    wanted = best.groupBy("dim", "block").agg(F.collect_list(F.struct("anchor_id", "positive_id", "positive_score")).alias("wanted"))

    def visit(row: dict, a_side: tuple, vectors: tuple) -> Iterator[tuple]:
        (a_ids, a_labels, a), (ids, labels, v) = a_side, vectors
        windows: dict[int, list[tuple[int, int]]] = {}
        for want in row["wanted"]:
            windows.setdefault(want["anchor_id"], []).append((want["positive_id"], want["positive_score"]))
        for start, found in scores(a, v):
            for i, line in enumerate(found, start):
                asked_for = [(p, s, -(-low * s // 100), high * s // 100) for p, s in windows.get(int(a_ids[i]), [])]
                if not asked_for:
                    continue
                other = np.flatnonzero((labels != a_labels[i]) & (line >= min(w[2] for w in asked_for)) & (line <= max(w[3] for w in asked_for)))
                got = line[other]
                for positive, score, least, most in asked_for:
                    for p in first(line, other[(got >= least) & (got <= most)], ids, n_negatives):
                        yield int(a_ids[i]), positive, int(ids[p]), score, int(line[p])

    fields = [(c, pa.int64()) for c in ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")]
    pairs = tiles(asked.join(wanted, ["dim", "block"]), vectors)
    found = each_pair(pairs, visit, ", ".join(f"{c} long" for c, _ in fields), pa.schema(fields))
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
