"""Repeated byte strings by a sparse suffix array with deep-shallow sorting.

A suffix is sorted only at sampled places that equal strings share: in every stretch of
``window`` bytes, the substrings of ``GRAM`` bytes with the smallest hash. A repeat of
``window`` bytes holds such an anchor, and its other occurrence holds the same one at the
same offset. An anchor's context reaches ``window - GRAM`` bytes to the left and ``window``
bytes to the right of its start, clipped at the document's ends: all windows that hold it.

Spark counts the anchors' substrings; those met once hold no repeat. Equal contexts are a
class, counted by hash, and a class of two or more is covered in whole: copies never reach a
sort. Where classes share a substring but differ, one context of each goes to the task of
their substring. There the suffixes to the right of the anchors and the reversed texts to
their left are sorted: multikey quicksort on chunks of eight bytes to a shallow depth, then
a blind trie for each group that still agrees. Longest common prefixes of neighbours say
how far to each side any other occurrence goes along; a context whose two sides reach
``window`` bytes with one other occurrence is covered between the outermost such windows.

Substrings with more than ``PART`` classes are split into parts, and each pair of parts is a
group of its own: no task holds a whole hot group, and any two classes meet in one.

* Bytes are those of the text in UTF-8; a null text is empty. Windows never cross documents.
* Repeated rows are documents of their own, hence copies of each other.
* Ties of hashes select all tied places. Texts below one window lose nothing; very long
  ones are read whole. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import raw, settle
from marketframe.llm.passages import RangeHash, covered, digests, identified, joined_batches, mix, sent_back, with_marks

WINDOW = 200
GRAM = 64
#: Bytes beyond the known common start at which the quicksort hands over to blind tries.
SHALLOW = 32
#: Classes of one substring in a part.
PART = 4096

_U = np.uint64
_TOP = _U(0xFFFFFFFFFFFFFFFF)
#: Symbols of the bytes, for the anchors.
_ANCHOR = mix(np.arange(256, dtype=_U), 21)


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours, by doubling."""
    have, out = 1, values
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    return out if have == width else pick(out[: len(values) - width + 1], out[width - have : width - have + len(values) - width + 1])


def anchors(data: np.ndarray, doc: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the sampled substrings. ``doc`` numbers the document of each byte."""
    n, width = len(data), window - gram + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    hashes = RangeHash(_ANCHOR[data])
    at = np.arange(n - gram + 1)
    keys = np.maximum(hashes.of(at, at + gram, 22), _U(1))
    keys[doc[: n - gram + 1] != doc[gram - 1 :]] = _TOP
    least = _sliding(keys, width, np.minimum)
    least[doc[: n - window + 1] != doc[window - 1 :]] = 0
    padded = np.concatenate([np.zeros(width - 1, _U), least, np.zeros(width - 1, _U)])
    seen = _sliding(padded, width, np.maximum)  # largest of the minima of the windows that hold the place
    places = np.flatnonzero(seen == keys)
    return places, keys[places]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows, bytes, document numbers and document starts of a few texts at a time."""
    for rows in joined_batches(batches):
        texts = [r[-1] for r in rows]
        sizes = np.array([len(t) for t in texts], np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes)])
        yield rows, np.frombuffer(b"".join(texts), np.uint8), np.repeat(np.arange(len(texts)), sizes), begins


def anchor_keys(docs: DataFrame, window: int) -> DataFrame:
    """The hash ``x`` of every anchor's substring."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, doc, _ in _batches(batches):
            yield pa.RecordBatch.from_arrays([pa.array(anchors(data, doc, window)[1].view(np.int64))], ["x"])

    return identified(docs).select("text").mapInArrow(run, "x long")


def contexts(docs: DataFrame, window: int) -> DataFrame:
    """Per anchor ``x``, the hash ``a`` of its context, its place and the context's reach to both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, doc, begins in _batches(batches):
            place, key = anchors(data, doc, window)
            of = doc[place]
            left = np.minimum(place - begins[of], window - GRAM)
            right = np.minimum(begins[of + 1] - place, window)
            context = digests(data.tobytes(), place - left, place + right).view(_U)
            context = mix(context + left.astype(_U) * _U(1009) + right.astype(_U), 25)
            ids, ths = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (key.view(np.int64), context.view(np.int64), ids[of], ths[of], (place - begins[of]).astype(np.int32),
                                       left.astype(np.int16), right.astype(np.int16))], ["x", "a", "doc_id", "th", "pos", "l", "r"])

    return identified(docs).mapInArrow(run, "x long, a long, doc_id long, th long, pos int, l short, r short")


# deep-shallow sorting of byte strings -------------------------------------------------


def _blind_trie(strings: list[bytes], group: list[int], depth: int) -> list[int]:
    """Order of strings that agree up to ``depth``: leaves of a trie that stores only where it branches.

    A node is [skip, branches]; a branch goes by the byte at ``skip`` (-1: the string ends). A
    leaf is a list of equal strings' numbers. A new string goes down blindly, is compared
    once with the leaf it reaches, and is put in where the two part.
    """
    byte = lambda s, at: s[at] if at < len(s) else -1
    root: object = [group[0]]
    for number in group[1:]:
        text = strings[number]
        node = root
        while isinstance(node, tuple):
            skip, branches = node
            node = branches.get(byte(text, skip)) or next(iter(branches.values()))
        other = strings[node[0]]
        same = depth + common(text[depth:], other[depth:])
        if same == len(text) == len(other):
            node.append(number)
            continue
        above, node = None, root
        while isinstance(node, tuple) and node[0] < same:
            above, node = node, node[1][byte(text, node[0])]
        if isinstance(node, tuple) and node[0] == same:
            node[1][byte(text, same)] = [number]
            continue
        joint = (same, {byte(other, same): node, byte(text, same): [number]})
        if above is None:
            root = joint
        else:
            above[1][byte(text, above[0])] = joint
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            stack.extend(node[1][k] for k in sorted(node[1], reverse=True))
        else:
            out.extend(node)
    return out


def deep_shallow(strings: list[bytes], known: int = 0, shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Order of the strings and the common prefix of each with the one before (0 for the first).

    ``known`` bytes are common to all. Multikey quicksort partitions by eight bytes at a time
    and goes on with the equal part eight bytes deeper; from ``known + shallow`` on the
    groups that still agree are ordered by blind tries.
    """
    order: list[int] = []
    chunk = lambda i, at: (int.from_bytes(strings[i][at : at + 8].ljust(8, b"\0"), "big"), min(len(strings[i]), at + 8))
    pending = [(list(range(len(strings))), known)]
    while pending:
        group, depth = pending.pop()
        if len(group) == 1:
            order += group
        elif depth >= known + shallow:
            order += _blind_trie(strings, group, depth)
        else:
            keys = [chunk(i, depth) for i in group]
            pivot = keys[len(keys) // 2]
            less = [i for i, k in zip(group, keys) if k < pivot]
            equal = [i for i, k in zip(group, keys) if k == pivot]
            more = [i for i, k in zip(group, keys) if k > pivot]
            if more:
                pending.append((more, depth))
            if pivot[1] < depth + 8 or len(equal) == 1:  # the strings end here: they are equal
                pending.extend(([i], depth) for i in reversed(equal))
            else:
                pending.append((equal, depth + 8))
            if less:
                pending.append((less, depth))
    near = [0] + [known + common(strings[a][known:], strings[b][known:]) for a, b in zip(order, order[1:])]
    return order, near


def _outward(rank: int, order: list[int], near: list[int]) -> Iterator[tuple[int, int]]:
    """The others by falling common prefix with the one at ``rank``, with that prefix."""
    before, after, n = rank - 1, rank + 1, len(order)
    low = near[rank] if rank else -1
    high = near[after] if after < n else -1
    while low >= 0 or high >= 0:
        if low >= high:
            yield order[before], low
            low = min(low, near[before]) if before > 0 else -1
            before -= 1
        else:
            yield order[after], high
            after += 1
            high = min(high, near[after]) if after < n else -1


def reaches(group: list[tuple[bytes, int, bool]], window: int = WINDOW, gram: int = GRAM) -> list[tuple[int, int] | None]:
    """For each single context how far left and right repeats go that hold its anchor, or None.

    ``group`` has contexts that share the anchor's substring: bytes, the anchor's place in
    them, and whether the context is single. A window that starts d bytes before the anchor
    repeats if some other context agrees on d bytes to the left and window - d to the right.
    """
    rights = [text[at:] for text, at, _ in group]
    lefts = [text[:at][::-1] for text, at, _ in group]
    shared = gram if all(r[:gram] == rights[0][:gram] for r in rights) else 0  # 0 where two substrings share a hash
    by_right, near_right = deep_shallow(rights, shared)
    by_left, near_left = deep_shallow(lefts)
    rank_right, rank_left = [0] * len(group), [0] * len(group)
    for k, i in enumerate(by_right):
        rank_right[i] = k
    for k, i in enumerate(by_left):
        rank_left[i] = k
    out: list[tuple[int, int] | None] = []
    for i, (_, _, single) in enumerate(group):
        if not single:
            out.append(None)
            continue
        most_right = next(_outward(rank_right[i], by_right, near_right))[1]
        most_left = next(_outward(rank_left[i], by_left, near_left))[1]
        left = right = None
        for j, far in _outward(rank_left[i], by_left, near_left):
            if far + most_right < window:
                break
            if far + common(rights[i], rights[j]) >= window:
                left = far
                break
        if left is not None:
            for j, far in _outward(rank_right[i], by_right, near_right):
                if far + most_left < window:
                    break
                if far + common(lefts[i], lefts[j]) >= window:
                    right = far
                    break
        out.append(None if left is None else (left, right))
    return out


def _compared(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Marks from the groups of a partition sorted by group."""
    names = ["doc_id", "th", "start", "n"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    key, held, found = None, [], []

    def close() -> None:
        if len(held) > 1:
            for row, reach in zip(held, reaches([(r[6], r[5], r[2]) for r in held], window)):
                if reach is not None:
                    found.append((row[3], row[4], row[7] - reach[0], reach[0] + reach[1] - window + 1))

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:2] != key:
                close()
                key, held = row[:2], []
            held.append(row)
        if len(found) > 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)
            found.clear()
    close()
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)


def repeats(docs: DataFrame, window: int = WINDOW, part: int = PART) -> DataFrame:
    """``doc_id``, ``th``, ``start``, ``n``: runs of n windows whose union is repeated bytes."""
    often = settle(anchor_keys(docs, window).groupBy("x").agg(F.count(F.lit(1)).alias("met")).where("met > 1").select("x"), "grams")
    shared = settle(contexts(docs, window).join(often, "x"), "contexts")
    place = F.struct("doc_id", "th", "pos", "l", "r")
    classes = settle(shared.groupBy("x", "a").agg(F.count(F.lit(1)).alias("rows"), F.min(place).alias("first")), "context-classes")
    copied = classes.where("rows > 1").select("x", "a")
    whole = shared.where(F.col("l") + F.col("r") >= window).join(copied, ["x", "a"]).select(
        "doc_id", "th", (F.col("pos") - F.col("l")).alias("start"), (F.col("l") + F.col("r") - window + 1).cast("int").alias("n"))
    # classes that share a substring but differ
    several = settle(classes.groupBy("x").agg(F.count(F.lit(1)).alias("classes"), F.min("rows").alias("least")).where("classes > 1 AND least = 1"), "contested")
    parts = F.ceil(F.col("classes") / part).cast("int")
    asked = classes.join(several, "x").select(
        "x", parts.alias("parts"), F.pmod(F.xxhash64("a"), parts).cast("int").alias("own"), (F.col("rows") == 1).alias("single"), "first.*")
    per_doc = settle(asked.groupBy("doc_id", "th").agg(F.collect_list(F.struct("x", "parts", "own", "single", "pos", "l", "r")).alias("asked")), "asked")

    names = ["x", "parts", "own", "single", "doc_id", "th", "at", "text", "pos"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32()]

    def cut(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        out = [(c["x"], c["parts"], c["own"], c["single"], doc_id, th, c["l"], text[c["pos"] - c["l"] : c["pos"] + c["r"]], c["pos"])
               for doc_id, th, wanted, text in rows for c in wanted]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    sent = sent_back(docs, per_doc, cut, "x long, parts int, own int, single boolean, doc_id long, th long, at int, text binary, pos int")
    met = sent.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "x", F.hash(F.least("own", "other"), F.greatest("own", "other")).alias("pair"), "single", "doc_id", "th", "at", "text", "pos")
    dealt = met.repartition("x", "pair").sortWithinPartitions("x", "pair")
    found = dealt.mapInArrow(lambda batches: _compared(batches, window), "doc_id long, th long, start int, n int")
    return whole.unionByName(found)


def removal(text: Column, marks: Column, window: int = WINDOW) -> Column:
    """Struct of byte counts, the digest of the bytes left and the bytes themselves."""

    @F.pandas_udf("struct<n_bytes:long,n_removed:long,n_spans:long,kept_sha256:string,kept:binary>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, found in batches:
            out = []
            for data, own in zip(texts, found):
                gone = covered(own, len(data), window)
                left, removed, spans = data, 0, 0
                if gone is not None:
                    left = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    removed = int(gone.sum())
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(data), removed, spans, hashlib.sha256(left).hexdigest(), left))
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run(raw(text), marks)


def remove_repeats(docs: DataFrame, window: int = WINDOW, into: str = "cut") -> DataFrame:
    """``docs`` with a struct column ``into`` (in place of one of that name), see ``removal``."""
    marked = with_marks(docs, repeats(docs, window))
    return marked.withColumn(into, removal(F.col("text"), F.col("__marks"), window)).drop("__marks")
