"""Repeated bytes and words, near-duplicates: against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_tables import LONG, documents

from marketframe.llm import graph, recompress, simhash, suffixes

WORDS = LONG.split()


def tangled(spark, seed, long_runs=True):
    """Texts made of shared passages of many lengths, copies, near copies and runs of one word."""
    rng = random.Random(seed)
    passages = [" ".join(WORDS[a : a + n]) for a, n in ((0, 60), (100, 30), (200, 21), (300, 20), (400, 19), (500, 120), (620, 26))]
    rows, texts = [], []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 5)):
            kind = rng.random()
            if kind < 0.5:
                parts.append(rng.choice(passages))
            elif kind < 0.8 or not long_runs:
                parts.append(" ".join(rng.choice(WORDS[700:]) for _ in range(rng.randint(0, 40))))
            else:
                parts.append(" ".join([rng.choice(("aa", "bb", "aa bb"))] * rng.randint(1, 60)))
        text = rng.choice((" ", "\n", "  ")).join(parts)
        if texts and rng.random() < 0.3:
            text = rng.choice(texts)
            if rng.random() < 0.7:
                words = text.split(" ")
                words[rng.randrange(len(words))] = "changed"
                text = " ".join(words)
        texts.append(text)
        rows.append((i * 3 % 61, text))
    rows += [(200, None), (201, ""), (202, "ab" * 700), (203, "ab" * 400 + "c" + "ab" * 120), (204, "é" * 300)]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def plain_bytes(rows):
    data = [(t or "").encode() for _, t in rows]
    often = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for (doc_id, _), d in zip(rows, data):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - 199):
            if often[d[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        out.append((doc_id, len(d), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def plain_words(rows):
    seen, out = set(), []
    for doc_id, text in sorted({(i, t or "") for i, t in rows}):
        words = text.encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(window)
        left = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("part", [4096, 3])
def test_repeated_bytes(spark, seed, part, monkeypatch):
    docs, rows = tangled(spark, seed)
    found = suffixes.repeats(docs, part=part)
    marked = suffixes.with_marks(docs, found)
    got = marked.select("doc_id", suffixes.removal(marked.text, marked["__marks"]).alias("c")).selectExpr(
        "doc_id", "c.n_bytes", "c.n_removed", "c.n_spans", "c.kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == plain_bytes(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeated_words(spark, seed):
    docs, rows = tangled(spark, seed)
    got = recompress.remove_repeats(docs).selectExpr("doc_id", "cut.n_words", "cut.n_removed", "cut.kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == plain_words(rows)


def test_repeats_on_odd_rows(spark):
    docs = documents(spark)
    for operator in (suffixes.remove_repeats, recompress.remove_repeats):
        got = operator(docs)
        assert got.count() == docs.count() and set(docs.columns) == set(got.columns)
        assert operator(docs.limit(0)).count() == 0
    bytes_cut = {(r.doc_id, r.n_bytes): r.n_removed for r in suffixes.remove_repeats(docs).selectExpr("doc_id", "cut.*").collect()}
    assert bytes_cut[(1, 0)] == 0 and all(n == size for (i, size), n in bytes_cut.items() if i == 6)
    words_cut = {(r.doc_id, r.n_words): r.n_removed for r in recompress.remove_repeats(docs).selectExpr("doc_id", "cut.*").collect()}
    assert words_cut[(6, 120)] == 120 and words_cut[(4, 4000)] == 0 and words_cut[(None, 121)] == 120


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=6).map(lambda b: (b"abcab" * 12)[: len(b) * 9] + b), min_size=1, max_size=12))
def test_deep_shallow_order(strings):
    order, near = suffixes.deep_shallow(strings, shallow=8)
    assert [strings[i] for i in order] == sorted(strings) and sorted(order) == list(range(len(strings)))
    for a, b, n in zip(order, order[1:], near[1:]):
        x, y = strings[a], strings[b]
        assert x[:n] == y[:n] and (n == min(len(x), len(y)) or x[n] != y[n])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=0, max_size=90), st.integers(0, 30), st.integers(1, 25))
def test_equal_windows_have_equal_owners(text, at, size):
    names = recompress.mix(np.array([1, 2, 3], np.uint64))
    passage = [i % 3 for i in range(at, at + size)] + [0, 0, 1, 2, 2, 2]
    whole = [text + passage + text[::-1], passage, [1] + passage + text]
    words = names[np.array([w for t in whole for w in t], int)] if any(whole) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(3), [len(t) for t in whole])
    key, number = recompress.owners(words, doc, 8)
    owner = {}
    for s in np.flatnonzero(number >= 0):
        window = tuple(words[s : s + 8].tolist())
        assert owner.setdefault(window, key[s]) == key[s]
    starts = sum(max(0, len(t) - 7) for t in whole)
    assert int((number >= 0).sum()) == starts


def plain_fingerprint(text, size=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(max(1, len(words) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(values, radius=4):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprints_and_groups(spark):
    docs, rows = tangled(spark, 4)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    values = [plain_fingerprint(t) for _, t in rows]
    groups = plain_groups(values)
    smallest = {}
    for (i, _), g in zip(rows, groups):
        smallest[g] = min(i, smallest.get(g, i))
    assert got == {i: (v, smallest[g]) for (i, _), v, g in zip(rows, values, groups)}


@pytest.mark.parametrize("shard_rows", [4096, 7])
def test_dense_groups_lose_no_link(spark, shard_rows):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    values = {rng.getrandbits(64) for _ in range(200)}
    for _ in range(300):
        flips = rng.sample(range(64), rng.randint(0, 6))
        values.add(centre ^ sum(1 << b for b in flips))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), shard_rows=shard_rows)
    roots = {r.node % (1 << 64): r.root for r in graph.components(links).collect()}
    groups = plain_groups(values)
    ours = {}
    for v, g in zip(values, groups):
        ours.setdefault(g, set()).add(roots.get(v, v))
    assert all(len(x) == 1 for x in ours.values()) and len({next(iter(x)) for x in ours.values()}) == len(ours)


def test_near_duplicates_on_odd_rows(spark):
    docs = documents(spark)
    got = simhash.near_duplicates(docs)
    assert got.count() == docs.count()
    zero = [r.component_id for r in got.collect() if r.fp == 0]
    assert zero == [1, 1, 1]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(6) == 0 and ids.count(5) == 1 and ids.count(10) == 2
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200 + i) for i in range(30)] + [(7, 7), (300, 301), (301, 300), (None, 3)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in (100, *range(200, 230))} | {300: 300, 301: 300}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def thue_morse(n, letters):
    """A word on which sums of powers modulo 2^64 collide with its complement, whatever the base."""
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_texts_that_break_sums_of_powers(spark):
    same = [f"w{i}" for i in range(19)]
    words = [thue_morse(1024, "ab"), thue_morse(1024, "ba")]
    rows = [(i, " ".join([*same, w, *same[::-1]])) for i, w in enumerate(words)]
    rows += [(10 + i, thue_morse(2048, [f"{a} ", f"{b} "])) for i, (a, b) in enumerate(["cd", "dc"])]
    rows += [(20 + i, thue_morse(336, letters)) for i, letters in enumerate(["xy", "yx"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in recompress.remove_repeats(docs).select("doc_id", "cut.*").collect()}
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == {i: tuple(r) for i, *r in plain_words(rows)}
    assert got[1].n_removed == 0
    bytes_got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(docs).select("doc_id", "cut.*").collect()}
    assert bytes_got == {i: tuple(r) for i, *r in plain_bytes(rows)}
