"""Near-duplicates of the pipeline: every pair of five-word Jaccard 0.8 or more is joined, and no other."""

import random

import numpy as np
import pyarrow as pa
import pytest
from llm_tables import documents
from pyspark.sql import functions as F

import corpus_pipeline
from marketframe.llm import overlap, simhash


def plain_kept(rows):
    """Ids that stay, by comparing all pairs."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                group[find(i)] = find(j)
    smallest = {}
    for k, (i, _) in enumerate(rows):
        smallest[find(k)] = min(i, smallest.get(find(k), i))
    return sorted(smallest.values())


def edited(rng, words, share):
    return " ".join(rng.choice(words) if rng.random() < share else w for w in words)


@pytest.mark.parametrize("sample", [10_000, 20])
def test_stage_joins_all_similar_pairs(spark, sample, monkeypatch):
    monkeypatch.setattr(overlap, "SAMPLE", sample)
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(900)]
    line = " ".join(rng.choice(vocabulary) for _ in range(25))
    texts = ["", None, "two words", "Two  words", line]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 400))]
        texts += [" ".join(base), *[edited(rng, base, rng.choice([0.005, 0.02, 0.03, 0.05])) for _ in range(3)], line + " " + " ".join(base[:90])]
    base = [rng.choice(vocabulary) for _ in range(120)]
    texts += [edited(rng, base, 0.02) for _ in range(60)]  # a group whose members are not all similar to each other
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, docs, "").collect())
    assert got == plain_kept(rows) and len(got) < len(rows) - 60


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = sorted(r.doc_id for r in overlap.keep_one(docs).collect())
    assert got == plain_kept([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark):
    docs = documents(spark)
    kept = overlap.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and ids.count(2) == 0 and ids.count(6) == 0 and ids.count(5) == 1 and ids.count(10) == 2
    assert overlap.keep_one(docs.limit(0)).count() == 0


def test_stage_links_by_simhash_first(spark, monkeypatch):
    asked, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda values, radius: asked.append((sorted(r.fp for r in values.collect()), radius)) or links(values, radius))
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    rows = [(i, " ".join(words + ["end"] * i)) for i in range(3)] + [(3, " ".join(reversed(words)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, docs, "").collect())
    prints = {simhash.majority(overlap.shingles(t.encode())) for _, t in rows}
    assert asked == [(sorted(prints), simhash.RADIUS)] and got == [0, 3]
    found = overlap.nodes(docs)
    near, _ = overlap.compared(overlap.fingerprint_pairs(found, simhash.RADIUS), docs, found, overlap.SHINGLE)
    assert near.count() == 2  # the copies are joined by their fingerprints alone


def test_bitmaps_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(8)
    ruled_out = 0
    for n in [0, 1, 2, 5, 31, 32, 33, 400, 3000] * 20:
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.choice([0.3, 0.8, 0.9, 1])], rng.integers(0, 1 << 63, rng.integers(0, n // 4 + 2), dtype=np.uint64)]))
        may = overlap.may_reach(overlap.bitmap(a), len(a), overlap.bitmap(b), len(b))
        assert may == overlap.may_reach(overlap.bitmap(b), len(b), overlap.bitmap(a), len(a))
        if len(a) + len(b):
            assert may or not overlap.similar(a.tobytes(), b.tobytes())
        ruled_out += not may
    assert ruled_out > 40


def test_only_sets_that_may_be_similar_are_fetched(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(900)]
    shared = [rng.choice(words) for _ in range(60)]
    far = [" ".join(shared + [rng.choice(words) for _ in range(120)]) for _ in range(20)]
    near = [far[0] + " end", far[1] + " end"]
    docs = spark.createDataFrame(list(enumerate(far + near)), "doc_id long, text string")
    found = overlap.nodes(docs)
    sid = F.col("sid")
    pairs = found.select(sid.alias("a")).join(found.select(sid.alias("b"))).where("a < b")
    links, sets = overlap.compared(pairs, docs, found, overlap.SHINGLE)
    assert links.count() == 2
    assert sets.count() == 4  # of 22, which all pairs name


def near_copies(rng, words, n):
    """Texts a few of whose pairs are similar, though all have most words in common."""
    base = [rng.choice(words) for _ in range(150)]
    return [edited(rng, base, rng.choice([0.01, 0.03, 0.04, 0.05])) for _ in range(n)]


def as_group(sets, roots, late=()):
    columns = {"sid": list(range(len(sets))), "n": [len(s) for s in sets], "root": roots, "early": [i not in late for i in range(len(sets))]}
    return pa.table(columns | {"bits": [overlap.bitmap(s) for s in sets], "set": [s.tobytes() for s in sets]}).sort_by("n")


@pytest.mark.parametrize("late", [(), range(40, 70)])
def test_rows_of_a_group_meet(late):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(600)]
    sets = [overlap.shingles(t.encode()) for t in [*near_copies(rng, words, 50), *[" ".join(rng.choice(words) for _ in range(rng.randint(1, 300))) for _ in range(20)]]]
    rng.shuffle(sets)
    roots = [rng.choice([i, i % 9]) for i in range(len(sets))]
    group = as_group(sets, roots, late)
    sid = group.column("sid").to_pylist()
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if roots[i] != roots[j] and (not late or (i in late) != (j in late))]
    pairs = [(i, j) for i, j in pairs if 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j]))]
    may = {k for i, j in pairs if overlap.may_reach(overlap.bitmap(sets[i]), len(sets[i]), overlap.bitmap(sets[j]), len(sets[j])) for k in (i, j)}
    assert {sid[k] for k in np.flatnonzero(overlap.hopeful(group))} == may and 0 < len(may) < len(sets)
    links = [(sid[i], sid[j]) for i, j in overlap.spanning(group)]
    similar = [(i, j) for i, j in pairs if overlap.similar(sets[i].tobytes(), sets[j].tobytes())]
    assert {(max(p), min(p)) for p in links} <= set(similar) and len(links) < len(similar)

    def joined(edges):
        label = list(roots)
        for i, j in edges:
            label = [label[i] if x == label[j] else x for x in label]
        return {frozenset(k for k in range(len(sets)) if label[k] == x) for x in label}

    assert joined(links) == joined(similar)


def test_pairs_of_a_large_group_are_no_rows_and_none_is_lost(spark, monkeypatch):
    compared, asked = overlap.compared, []
    monkeypatch.setattr(overlap, "compared", lambda pairs, *rest: asked.append(pairs.count()) or compared(pairs, *rest))
    monkeypatch.setattr(overlap, "MEMBERS", 8)  # large hubs are split
    rng = random.Random(14)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(600)]
    base = [rng.choice(words) for _ in range(150)]
    texts = [edited(rng, base, 0.05) for _ in range(80)] + [edited(rng, base, 0.02) for _ in range(40)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in overlap.keep_one(docs).collect())
    assert got == plain_kept(rows) and 40 < len(got) < 110
    assert sum(asked) < 120 * 119 / 2 / 4  # pairs of the whole group
