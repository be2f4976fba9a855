"""SimHash near-duplicates, checked by the Jaccard similarity of word shingles, without a missed pair.

Each set of shingles has a 64-bit SimHash. BK-trees link the fingerprints within a radius
(``simhash.links``), and a link whose sets reach ``SIMILARITY`` joins its texts. Fingerprints
of similar sets may lie further apart than any affordable radius, so a prefix filter then looks
for the pairs that SimHash has not joined.

Two sets of shingles with a similarity of ``SIMILARITY`` or more share one of the first
n - ceil(SIMILARITY * n) + 1 shingles of either, in any order that is the same for all texts
(prefix filter). The order is by hash, with the shingles last that a bounded sample of texts
shares, so a common line or passage seldom makes candidates; it decides on cost only.

Texts with equal sets are one node. Nodes that share a first shingle form a bucket. After the
links of SimHash, in a second round each node is compared with the smallest of its buckets, its
hubs. The nodes of a hub hold all members of its buckets, and in a third round they meet each
other: all pairs of close sizes that the links so far have not joined, in arrays within tasks.
No pair is a row. Large hubs are split, and each pair of parts is a group of its own, so the
rows of a hub grow with its size times its parts and no task holds more than two parts; the
comparisons inside still grow with the square where near copies stay unjoined.

Each node has a bitmap of its set, two to four bits a shingle. A bit that one side alone has
stands for a shingle that the other lacks, so two bitmaps bound what their sets share from
above. Only nodes of a pair whose bound reaches the similarity have their sets fetched, and the
whole sets (of 64-bit hashes) decide.

* A null, empty or blank text has an empty set; such texts are copies of each other.
* A text of fewer words than a shingle has one shingle, all its words.
* Repeated rows are one. A null id is never the smallest. An empty table gives an empty result.
* Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketframe.llm import simhash
from marketframe.llm.common import discard, gives_back, raw, settle
from marketframe.llm.graph import components
from marketframe.llm.passages import NULL_LAST

SHINGLE = 5
#: Least similarity of a link, as a fraction.
SIMILARITY = (4, 5)
SEED = 42
#: Shingles of a text that are hashed at a time.
CHUNK = 1 << 14
#: Texts that tell the common shingles, and how many of these are put last.
SAMPLE, COMMON = 10_000, 1 << 17
#: Slots of the map that tells which texts a join needs.
SLOTS = 1 << 20
#: Nodes and shingles of a hub that one part has, about; a task holds two parts.
MEMBERS, MEMBER_SHINGLES = 2048, 1 << 20


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the word shingles, sorted."""
    words = text.lower().split()  # bytes: only A-Z change, only the six ASCII blanks separate
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    last = min(size, len(words)) - 1
    hash64, stops = xxhash.xxh64_intdigest, ends[last : last + n]
    out = np.empty(n, np.uint64)
    for at in range(0, n, CHUNK):  # a long text has few Python numbers at a time
        part = slice(at, at + CHUNK)
        out[part] = [hash64(joined[a:b], SEED) for a, b in zip(starts[:n][part].tolist(), stops[part].tolist())]
    return np.unique(out)


def prefix(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The shingles of which a similar set must share one."""
    part, whole = SIMILARITY
    n = len(hashes)
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)  # common is sorted
    late = common[at] == hashes if len(common) else np.zeros(n, bool)
    return np.concatenate([hashes[~late], hashes[late]])[: n - -(-part * n // whole) + 1 if n else 0]


def similar(a: bytes, b: bytes) -> bool:
    """Whether two sorted sets of hashes reach the similarity."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return SIMILARITY[1] * both >= SIMILARITY[0] * (len(x) + len(y) - both)


def bitmap(hashes: np.ndarray) -> bytes:
    """A bit for each shingle, by the low bits of its hash, in a power of two of bits."""
    size = max(64, 1 << (2 * len(hashes) - 1).bit_length()) if len(hashes) else 64
    bits = np.zeros(size, bool)
    bits[(hashes & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_reach(a: bytes, n: int, b: bytes, m: int) -> bool:
    """Whether sets of ``n`` and ``m`` shingles with these bitmaps may reach the similarity; never false for a pair that does."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    both = min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))
    return SIMILARITY[1] * both >= SIMILARITY[0] * (n + m - both)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__id`` (null ids last) and ``__th``, a hash of the text."""
    return docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_LAST))).withColumn("__th", F.xxhash64(raw("text")))


def common_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """Shingles that several texts of a sample share, the most frequent ones."""
    step = max(1, docs.count() // SAMPLE)
    sample = keyed(docs).where(F.pmod(F.xxhash64("__id", "__th"), F.lit(step)) == 0).select("__th", raw("text").alias("text")).dropDuplicates(["__th"])

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py(), size).view(np.int64))], ["key"])

    seen = sample.select("text").mapInArrow(run, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    rows = seen.orderBy(F.col("n").desc(), "key").limit(COMMON).select("key").toArrow()
    return np.sort(rows.column("key").to_numpy().view(np.uint64))


def nodes(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Each distinct set: its hash ``sid``, SimHash ``fp``, size ``n``, ``bits``, first shingles ``keys`` and the smallest (id, text) that has it."""
    common = common_shingles(docs, size)

    @F.pandas_udf("struct<sid:long,fp:long,n:int,bits:binary,keys:array<long>>")
    @gives_back
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingles(t, size) for t in texts]
            yield pd.DataFrame({
                "sid": np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64),
                "fp": np.array([simhash.majority(s) for s in sets], np.int64), "n": [len(s) for s in sets],
                "bits": [bitmap(s) for s in sets],
                "keys": [prefix(s, common).view(np.int64) for s in sets]})

    sets = keyed(docs).select("__id", "__th", run(raw("text")).alias("s")).select("__id", "__th", "s.*")
    first = F.min(F.struct("__id", "__th")).alias("rep")
    return settle(sets.groupBy("sid").agg(first, *[F.first(c).alias(c) for c in ("fp", "n", "bits", "keys")]), "nodes")


def buckets(found: DataFrame) -> DataFrame:
    """Nodes ``sid`` that share a first shingle with a smaller one, for each smallest ``hub``; ``more`` if a third node shares it."""
    w = Window.partitionBy("key")
    rows = found.select("sid", "n", F.explode("keys").alias("key"))
    rows = rows.withColumns({"least": F.min(F.struct("sid", "n")).over(w), "more": F.count(F.lit(1)).over(w) > 2})
    rows = rows.where(F.col("sid") != F.col("least.sid")).groupBy("least", "sid", "n").agg(F.max("more").alias("more"))
    return settle(rows.select(F.col("least.sid").alias("hub"), F.col("least.n").alias("hub_n"), "sid", "n", "more"), "buckets")


def close_sizes(a: Column, b: Column) -> Column:
    return SIMILARITY[1] * F.least(a, b) >= SIMILARITY[0] * F.greatest(a, b)


def fingerprint_pairs(found: DataFrame, radius: int) -> DataFrame:
    """Pairs of nodes that SimHash links: of one fingerprint, or of two within ``radius`` bits; a star for each group of a tree."""
    heads = settle(found.groupBy("fp").agg(F.min(F.struct("sid", "n")).alias("head")), "fingerprints")
    links = simhash.links(heads.select("fp"), radius).distinct()
    far = links.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b")
    same = found.join(heads, "fp").where(F.col("sid") != F.col("head.sid")).select(F.col("head").alias("x"), F.struct("sid", "n").alias("y"))
    pairs = far.select("x", "y").unionByName(same).where(close_sizes(F.col("x.n"), F.col("y.n")))
    pairs = settle(pairs.select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b")).distinct(), "pairs")
    discard(heads)
    return pairs


def joined(links: DataFrame) -> DataFrame:
    """``sid`` and ``root`` of the nodes that have links."""
    return settle(components(links), "roots").select(F.col("node").alias("sid"), "root")


def whole_sets(named: DataFrame, docs: DataFrame, found: DataFrame, size: int, known: DataFrame | None = None) -> DataFrame:
    """``sid`` and ``set`` of the nodes in ``named`` and in ``known``. Only texts that one of the others names leave their files."""
    if known is not None:
        named = named.join(known.select("sid"), "sid", "left_anti")
    needed = settle(found.select("sid", "rep.*").join(named, "sid"), "needed")

    def slot() -> Column:
        return F.pmod(F.xxhash64("__id", "__th"), F.lit(SLOTS))

    full = np.zeros(SLOTS, bool)
    full[needed.select(slot().alias("s")).distinct().toArrow().column("s").to_numpy()] = True
    bits = np.packbits(full)

    @F.pandas_udf("boolean")
    @gives_back
    def wanted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        there = np.unpackbits(bits).view(bool)
        for slots in batches:
            yield pd.Series(there[slots.to_numpy()])

    @F.pandas_udf("binary")
    @gives_back
    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingles(t, size).tobytes() for t in texts])

    texts = keyed(docs).select("__id", "__th", raw("text").alias("text")).where(wanted(slot())).join(needed, ["__id", "__th"])
    sets = settle(texts.dropDuplicates(["sid"]).select("sid", hashes("text").alias("set")), "candidates")
    discard(needed)
    return sets if known is None else known.unionByName(sets)


def compared(pairs: DataFrame, docs: DataFrame, found: DataFrame, size: int, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of ``pairs`` (``a``, ``b``) whose sets are similar, and all sets at hand. Pairs that their bitmaps rule out go first."""

    @F.pandas_udf("boolean")
    @gives_back
    def room(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series([may_reach(*row) for row in zip(*columns)], dtype=bool)

    @F.pandas_udf("boolean")
    @gives_back
    def reach(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield pd.Series([similar(a, b) for a, b in zip(left, right)], dtype=bool)

    for side in ("a", "b"):
        pairs = pairs.join(found.select(F.col("sid").alias(side), F.col("bits").alias(f"bits_{side}"), F.col("n").alias(f"n_{side}")), side)
    pairs = settle(pairs.where(room("bits_a", "n_a", "bits_b", "n_b")).select("a", "b"), "pairs")
    sets = whole_sets(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), docs, found, size, known)
    met = pairs.join(sets.select(F.col("sid").alias("a"), F.col("set").alias("set_a")), "a")
    met = met.join(sets.select(F.col("sid").alias("b"), F.col("set").alias("set_b")), "b")
    links = settle(met.where(reach("set_a", "set_b")).select("a", "b"), "links")
    discard(pairs)
    return links, sets


def in_parts(rows: DataFrame) -> DataFrame:
    """The ``rows`` (``hub``, ``sid``, ``n``, ``root``, one value) of hubs with several roots, where their groups meet.

    A group is a pair of a hub's parts ``p`` and ``q``: the ``early`` rows are of ``p``, the others of ``q``; a part
    with itself has early rows alone.
    """
    held = rows.groupBy("hub").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("total"))
    parts = F.greatest(F.ceil(F.col("members") / MEMBERS), F.ceil(F.col("total") / MEMBER_SHINGLES)).cast("int")
    met = rows.join(held.where("lo < hi").select("hub", parts.alias("parts")), "hub")
    met = met.withColumn("own", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    group = {"p": F.least("own", "other"), "q": F.greatest("own", "other"), "early": F.col("own") <= F.col("other")}
    met = met.withColumns(group).drop("own", "other", "parts")
    return met.repartition("hub", "p", "q").sortWithinPartitions("hub", "p", "q")


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The groups of ``in_parts``, each by ascending ``n``; its rows come one after the other."""
    held, key = [], None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("hub", "p", "q")], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                if held and keys[a].tolist() != key:
                    yield pa.Table.from_batches(held).sort_by("n")
                    held = []
                key = keys[a].tolist()
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).sort_by("n")


def meeting(n: np.ndarray, early: np.ndarray, i: int) -> np.ndarray:
    """The later rows of a group, by ascending ``n``, that row ``i`` meets: those of close size, and of the other part if there are two."""
    part, whole = SIMILARITY
    js = np.arange(i + 1, np.searchsorted(n, whole * int(n[i]) // part, "right"))
    return js if early.all() else js[early[js] != early[i]]


def hopeful(group: pa.Table) -> np.ndarray:
    """Which rows of a group have a row of another root that their bitmaps do not rule out."""
    n, root, early = (group.column(c).to_numpy() for c in ("n", "root", "early"))
    words = [np.frombuffer(b, np.uint64) for b in group.column("bits").to_pylist()]
    sizes = np.array([len(w) for w in words])
    found = np.zeros(len(n), bool)
    # bitmaps grow with n, at most twofold between close sizes; the larger is folded to the smaller
    for width in np.unique(sizes).tolist():
        at, wider = np.flatnonzero(sizes == width), np.flatnonzero(sizes == 2 * width)
        maps = np.stack([words[j] for j in at] + [words[j][:width] | words[j][width:] for j in wider])
        ones = np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        for i in at.tolist():
            js = meeting(n, early, i)
            js = js[root[js] != root[i]]
            if len(js):
                both = np.bitwise_count(maps[js - at[0]] & words[i]).sum(axis=1, dtype=np.int64)
                most = np.minimum(n[i] - (ones[i - at[0]] - both), n[js] - (ones[js - at[0]] - both))
                may = js[SIMILARITY[1] * most >= SIMILARITY[0] * (n[i] + n[js] - most)]
                found[may] = True
                found[i] |= len(may) > 0
    return found


def spanning(group: pa.Table) -> list[tuple[int, int]]:
    """Pairs of rows of a group whose sets are similar, as many as join all that the similar pairs join."""
    n, root, early = (group.column(c).to_numpy() for c in ("n", "root", "early"))
    sets = [np.frombuffer(b, np.uint64) for b in group.column("set").to_pylist()]
    every, own = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(own, np.cumsum(n)[:-1])
    label, there, links = root.copy(), np.zeros(len(every), bool), []
    for i in range(len(n)):
        js = meeting(n, early, i)
        js = js[label[js] != label[i]]
        if not len(js):
            continue
        there[own[i]] = True
        both = np.add.reduceat(there[np.concatenate([own[j] for j in js])], np.cumsum(n[js]) - n[js], dtype=np.int64)
        there[own[i]] = False
        for j in js[SIMILARITY[1] * both >= SIMILARITY[0] * (n[i] + n[js] - both)].tolist():
            if label[i] != label[j]:
                links.append((i, j))
                label[label == label[j]] = label[i]
    return links


def met_at_hubs(rows: DataFrame, docs: DataFrame, found: DataFrame, size: int, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links ``a``, ``b`` that join all similar nodes of one hub with different roots, and all sets at hand; ``rows`` has ``hub``, ``sid``, ``n`` and ``root``."""
    names = rows.columns

    @gives_back
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in parts_of(batches):
            yield from group.filter(pa.array(hopeful(group))).select(names).combine_chunks().to_batches()

    @gives_back
    def similar_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in parts_of(batches):
            sid = group.column("sid").to_numpy()
            pairs = np.array(spanning(group), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(sid[pairs[:, 0]]), pa.array(sid[pairs[:, 1]])], ["a", "b"])

    left = in_parts(rows.join(found.select("sid", "bits"), "sid")).mapInArrow(near, rows.schema)
    left = settle(left.distinct(), "hopeful")
    sets = whole_sets(left.select("sid").distinct(), docs, found, size, known)
    links = settle(in_parts(left.join(sets, "sid")).mapInArrow(similar_ones, "a long, b long"), "links")
    discard(left)
    return links, sets


def groups(docs: DataFrame, size: int = SHINGLE, radius: int = simhash.RADIUS) -> DataFrame:
    """``root`` and the smallest (id, text) ``rep`` of each distinct set of ``docs``."""
    whole = nodes(docs, size)
    held = buckets(whole)
    found = settle(whole.select("sid", "fp", "n", "bits", "rep"), "found")
    discard(whole)
    close = fingerprint_pairs(found, radius)
    linked, sets = compared(close, docs, found, size)
    roots = joined(linked)
    star = held.where(close_sizes(F.col("n"), F.col("hub_n"))).select(F.col("hub").alias("a"), F.col("sid").alias("b")).join(close, ["a", "b"], "left_anti")
    star = star.join(roots.select(F.col("sid").alias("a"), F.col("root").alias("root_a")), "a", "left")
    star = star.join(roots.select(F.col("sid").alias("b"), F.col("root").alias("root_b")), "b", "left")
    star = star.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    star = settle(star, "pairs")
    near, sets = compared(star, docs, found, size, sets)
    near = linked.unionByName(near)
    roots = joined(near)
    rest = held.where("more").select("hub", "sid", "n").join(roots, "sid", "left").select("hub", "sid", "n", F.coalesce("root", "sid").alias("root"))
    rest = settle(rest, "open")
    discard(held, close, star)
    far, sets = met_at_hubs(rest, docs, found, size, sets)
    discard(rest, sets)
    roots = joined(near.unionByName(far))
    return found.select("sid", "rep").join(roots, "sid", "left").select(F.coalesce("root", "sid").alias("root"), "rep")


def keep_one(docs: DataFrame, size: int = SHINGLE, radius: int = simhash.RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay when each group keeps its document with the smallest id.

    Ties between texts of one id go to the smaller hash; of repeated rows one stays.
    """
    first = groups(docs, size, radius).groupBy("root").agg(F.min("rep").alias("k")).select("k.*")
    met = keyed(docs).join(settle(first, "kept"), ["__id", "__th"], "left_semi")
    return met.dropDuplicates(["__id", "__th"]).select(*docs.columns)
