"""Substring dedup by recompression.

Words are symbols. Rounds name runs of one symbol and pairs of neighbours: a symbol is left
or right by a bit of its name, and a left one followed by a right one becomes their pair. A
name is a hash of what it stands for, so it is the same in every document and every task
without a shared table. Each symbol carries the words its existence depends on: its own and
those of the neighbours that were looked at. A symbol that depends on nothing outside a
window stands at the same place in every equal window.

So each window of ``window`` words is owned by one such symbol, of the highest level that
has one, and equal windows have equal owners: the one with the smallest hash of all words it
depends on. A window without one, inside a long run, owns itself. Documents send a row per
owner: its hash, its place, and a hash of the words of all the windows it owns. Spark counts
the owners; those met once hold no repeat. Of the shared ones, rows with the same windows
are one class, whose first row is kept and whose others are repeats in whole. Where classes
share an owner but differ, one row of each is looked up in its text and its windows are
compared one by one. Names only bring rows together, since sums of powers can be driven to
collide; classes and windows are told apart by XXH3 digests of their words.

* Order is by ``doc_id`` (null last), then a hash of the text, then the place. Repeated rows
  (same id and text) are one document and get the same result.
* Null and empty texts have no words and nothing to remove. Very long texts are read whole;
  texts below one window lose nothing. An empty table gives an empty result.
* No window has an owner in two documents' texts at once: windows never cross documents.
* Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketframe.llm.common import gives_back, raw, settle
from marketframe.llm.passages import RangeHash, covered, digests, identified, joined_batches, mix, sent_back, with_marks

WINDOW = 20
#: Rounds of naming, and the levels that own windows, the highest first.
ROUNDS, OWNING = 5, (5, 4)

_U = np.uint64
_FAR = np.int64(1) << np.int64(40)
_BLANK = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_BYTES = mix(np.arange(256, dtype=_U), 31)


class Level:
    """Symbols of a round: names, the words [low, high) they depend on, and their document."""

    def __init__(self, names: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray) -> None:
        self.names, self.low, self.high, self.doc = names, low, high, doc

    def neighbours(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Dependence of the symbol before and of the one after; beyond every window at a document's end."""
        n = len(self.names)
        low_b, high_b = np.full(n, -_FAR), np.full(n, -_FAR)
        low_a, high_a = np.full(n, _FAR), np.full(n, _FAR)
        same = self.doc[1:] == self.doc[:-1]
        low_b[1:][same], high_b[1:][same] = self.low[:-1][same], self.high[:-1][same]
        low_a[:-1][same], high_a[:-1][same] = self.low[1:][same], self.high[1:][same]
        return low_b, high_b, low_a, high_a


def name_runs(level: Level) -> Level:
    """A run of one symbol becomes one symbol; every symbol now depends on both neighbours."""
    n = len(level.names)
    if not n:
        return level
    first = np.concatenate([[True], (level.names[1:] != level.names[:-1]) | (level.doc[1:] != level.doc[:-1])])
    at = np.flatnonzero(first)
    size = np.diff(np.append(at, n))
    last = at + size - 1
    low_b, high_b, low_a, high_a = level.neighbours()
    names = level.names[at]
    many = size > 1
    names[many] = mix(names[many] + mix(size[many].astype(_U), 11), 12)
    low = np.minimum(np.minimum.reduceat(level.low, at), np.minimum(low_b[at], low_a[last]))
    high = np.maximum(np.maximum.reduceat(level.high, at), np.maximum(high_b[at], high_a[last]))
    return Level(names, low, high, level.doc[at])


def name_pairs(level: Level, turn: int) -> Level:
    """A left symbol before a right one becomes their pair; others depend on the neighbour that ruled it out."""
    n = len(level.names)
    if n < 2:
        return level
    right = (mix(level.names, 100 + turn) & _U(1)).astype(bool)
    joined = np.zeros(n, bool)
    joined[:-1] = ~right[:-1] & right[1:] & (level.doc[1:] == level.doc[:-1])
    second = np.concatenate([[False], joined[:-1]])
    low_b, high_b, low_a, high_a = level.neighbours()
    low = np.where(right, np.minimum(level.low, low_b), np.minimum(level.low, low_a))
    high = np.where(right, np.maximum(level.high, high_b), np.maximum(level.high, high_a))
    j = np.flatnonzero(joined)
    names = level.names.copy()
    names[j] = mix(mix(level.names[j], 13) + _U(3) * level.names[j + 1], 14)
    low[j] = np.minimum(level.low[j], level.low[j + 1])
    high[j] = np.maximum(level.high[j], level.high[j + 1])
    keep = ~second
    return Level(names[keep], low[keep], high[keep], level.doc[keep])


def levels(words: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> list[Level]:
    """The words as level 0, then one level per round; runs of words are named before the first pairs.

    A run's name depends on both neighbours, so naming runs again in each round would soon
    depend on more than a window; runs of pairs are left to the pairs.
    """
    place = np.arange(len(words), dtype=np.int64)
    out = [Level(words, place, place + 1, doc)]
    for turn in range(rounds):
        now = out[-1]
        out.append(name_pairs(name_runs(now) if turn == 0 else now, turn))
    return out


def owners(words: np.ndarray, doc: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS, owning: tuple = OWNING) -> tuple[np.ndarray, np.ndarray]:
    """For each window start the owner's key and its number, -1 where no window starts."""
    n = len(words)
    number = np.full(n, -1, np.int64)
    key_of = np.zeros(n, _U)
    if n < window:
        return key_of, number
    pending = np.zeros(n, bool)
    pending[: n - window + 1] = doc[: n - window + 1] == doc[window - 1 :]
    every = levels(words, doc, rounds)
    ranges = RangeHash(mix(words, 7))
    base = 0
    for rank in owning:
        level = every[rank]
        waiting = np.concatenate([[0], np.cumsum(pending)])
        fits = np.flatnonzero((level.low >= 0) & (level.high <= n) & (level.high - level.low <= window))
        start, stop = np.maximum(level.high[fits] - window, 0), level.low[fits] + 1
        wanted = waiting[stop] > waiting[start]
        fits, start, stop = fits[wanted], start[wanted], stop[wanted]
        keys = ranges.of(level.low[fits], level.high[fits], 200 + rank)
        sizes = stop - start
        symbol = np.repeat(np.arange(len(fits)), sizes)
        at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(start, sizes)
        ok = pending[at]
        symbol, at = symbol[ok], at[ok]
        best = np.full(n, _U(0xFFFFFFFFFFFFFFFF))
        np.minimum.at(best, at, keys[symbol])
        least = keys[symbol] == best[at]
        symbol, at = symbol[least], at[least]
        leftmost = np.full(n, np.int64(1) << np.int64(62))
        np.minimum.at(leftmost, at, symbol)
        got = np.unique(at)
        key_of[got] = best[got]
        number[got] = leftmost[got] + base
        pending[got] = False
        base += len(fits)
    own = np.flatnonzero(pending)
    key_of[own] = ranges.of(own, own + window, 199)
    number[own] = base + own
    return key_of, number


class Words:
    """All words of the texts, one after the other: symbols, the number of their text, and their bytes."""

    def __init__(self, texts: list[bytes]) -> None:
        data, start, stop = _word_places(texts)
        self.symbols = RangeHash(_BYTES[data]).of(start, stop, 33)
        self.doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, "left").astype(np.int64)
        blank = _BLANK[data]
        keep = ~blank
        keep[stop] = True  # one separator after each word
        at = np.cumsum(keep) - 1
        self.start, self.stop = at[start], at[stop]
        self.data = np.where(blank, np.uint8(32), data)[keep].tobytes()

    def digests(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Digests of the words from ``first`` to ``last``, joined by one space."""
        return digests(self.data, self.start[first], self.stop[last])


def _word_places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts between blanks as bytes, and where their words start and stop."""
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    blank = _BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    return data, edge[::2], edge[1::2]


def owner_keys(docs: DataFrame, window: int) -> DataFrame:
    """The key ``x`` of every owner row."""
    return _owner_rows(docs, window, places=False)


def owner_rows(docs: DataFrame, window: int) -> DataFrame:
    """``x`` (owner), ``a`` (hash of its windows), ``doc_id``, ``th``, ``start`` and number ``n`` of the windows."""
    return _owner_rows(docs, window, places=True)


def _owner_rows(docs: DataFrame, window: int, places: bool) -> DataFrame:
    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in joined_batches(batches):
            words = Words([r[-1] for r in rows])
            doc = words.doc
            key_of, number = owners(words.symbols, doc, window)
            at = np.flatnonzero(number >= 0)
            if not len(at):
                continue
            first = np.flatnonzero(np.concatenate([[True], (number[at][1:] != number[at][:-1]) | (at[1:] != at[:-1] + 1)]))
            place, size = at[first], np.diff(np.append(first, len(at)))
            x = pa.array(key_of[place].view(np.int64))
            if not places:
                yield pa.RecordBatch.from_arrays([x], ["x"])
                continue
            a = words.digests(place, place + size + window - 2)
            of = doc[place]
            start = place - np.searchsorted(doc, np.arange(len(rows)))[of]
            ids, ths = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
            yield pa.RecordBatch.from_arrays(
                [x, pa.array(a), pa.array(ids[of]), pa.array(ths[of]), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))],
                ["x", "a", "doc_id", "th", "start", "n"])

    schema = "x long, a long, doc_id long, th long, start int, n int" if places else "x long"
    return identified(docs).mapInArrow(run, schema)


def _spread(window: int):
    """Turns (doc_id, th, asked, text) into a row per window, combined within the list of texts.

    Of equal windows in the list the first goes on; the others are repeats for ``sure`` and
    get a key of their own, so that they do not gather anywhere.
    """
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]

    def run(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        firsts: dict[tuple[int, int], tuple] = {}
        sure = []
        for doc_id, th, asked, text in rows:
            words = Words([text])
            for one in asked:
                at = np.arange(one["start"], one["start"] + one["n"])
                for h, start in zip(words.digests(at, at + window - 1).tolist(), at.tolist()):
                    key, place = (one["x"], h), (doc_id, th, start)
                    other = firsts.setdefault(key, place)
                    if other != place:
                        firsts[key] = min(place, other)
                        late = max(place, other)
                        sure.append((hash(late), len(sure), *late, True))
        out = [(*k, *p, False) for k, p in firsts.items()] + sure
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["x", "h", "doc_id", "th", "start", "sure"])

    return run


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``th``, ``start``, ``n``: runs of n window starts whose windows stand earlier too."""
    often = settle(owner_keys(docs, window).groupBy("x").agg(F.count(F.lit(1)).alias("met")).where("met > 1").select("x"), "owners")
    shared = settle(owner_rows(docs, window).join(often, "x"), "shared")
    place = F.struct("doc_id", "th", "start")
    classes = settle(shared.groupBy("x", "a").agg(F.min(place).alias("first"), F.first("n").alias("n"), F.count(F.lit(1)).alias("rows")), "classes")
    # rows of a class after its first are repeats in whole
    again = shared.join(classes.where("rows > 1").select("x", "a", F.col("first").alias("f")), ["x", "a"]).where(
        place > F.col("f")).select("doc_id", "th", "start", "n")
    # classes of one owner: the same window may stand in several of them
    several = classes.groupBy("x").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1").select("x")
    asked = classes.join(several, "x").select("first.*", "x", "n")
    per_doc = settle(asked.groupBy("doc_id", "th").agg(F.collect_list(F.struct("x", "start", "n")).alias("asked")), "asked")
    spread = sent_back(docs, per_doc, _spread(window), "x long, h long, doc_id long, th long, start int, sure boolean")
    earliest = F.min(place).over(Window.partitionBy("x", "h"))
    late = spread.withColumn("f", earliest).where(F.col("sure") | (place > F.col("f"))).select("doc_id", "th", "start", F.lit(1).alias("n"))
    return again.unionByName(late)


def removal(text: Column, marks: Column, window: int = WINDOW) -> Column:
    """Struct of word counts, the digest of the words left and the words left, joined by one space."""

    @F.pandas_udf("struct<n_words:long,n_removed:long,kept_sha256:string,kept:string>")
    @gives_back
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, found in batches:
            out = []
            for text, own in zip(texts, found):
                words = text.split()
                gone = covered(own, len(words), window)
                left = words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g]
                joined = b" ".join(left)
                out.append((len(words), len(words) - len(left), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "replace")))
            yield pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256", "kept"])

    return run(raw(text), marks)


def remove_repeats(docs: DataFrame, window: int = WINDOW, into: str = "cut") -> DataFrame:
    """``docs`` with a struct column ``into`` (in place of one of that name), see ``removal``."""
    marked = with_marks(docs, repeats(docs, window))
    return marked.withColumn(into, removal(F.col("text"), F.col("__marks"), window)).drop("__marks")
