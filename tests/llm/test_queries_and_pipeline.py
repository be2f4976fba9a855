"""Registered corpus queries beside their SQL, and the pipeline beside a plain version."""

import itertools
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from llm_tables import documents
from oracle_check import TABLES, rows_of, same
from test_repeats import plain_words

import corpus_pipeline
from marketframe.llm import bpe, mixing, zlang
from marketframe.llm.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_beside_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    answer = con.execute(ORACLES[name])
    names = [c[0] for c in answer.description]
    assert sorted(names) == sorted(df.columns)
    assert same(rows_of(df.columns, df.collect()), rows_of(names, answer.fetchall()))


def test_contract_columns():
    ids = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES)
    assert ids == list(range(1, 14))


def plain_shingles(text):
    """The five-word shingles of a text; one of all its words if it has fewer."""
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_pipeline_is_its_plain_version(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert [s for s, _ in corpus_pipeline.STAGES] == list(stages) and len(stages) == 5

    kept = stages["language ID"](spark, docs, FOLDER)
    assert kept.columns == docs.columns
    own = zlang.compressors(zlang.learn(docs))
    want = {i for i, r in rows.items() if (g := zlang.predict_one(r.text, own))[0] != "und" and g[1] >= zlang.MIN_MARGIN}
    assert {r.doc_id for r in kept.collect()} == want

    unique = stages["SimHash near-dedup"](spark, kept, FOLDER)
    ordered = sorted(want)
    sets = [plain_shingles(rows[i].text) for i in ordered]
    root = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            old, new = root[b], root[a]
            root = [new if r == old else r for r in root]
    firsts = {min(i for i, r in zip(ordered, root) if r == g) for g in set(root)}
    assert unique.columns == docs.columns and {r.doc_id for r in unique.collect()} == firsts

    cut = stages["substring dedup"](spark, unique, FOLDER)
    plain = {i: (n, gone) for i, n, gone, _ in plain_words([(i, rows[i].text) for i in firsts])}
    got = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == docs.columns
    assert set(got) == {i for i, (n, gone) in plain.items() if gone == 0 or gone < n}
    for i, r in got.items():
        assert len(r.text.split()) == plain[i][0] - plain[i][1] and r.n_chars == len(r.text)
        assert plain[i][1] or r.text == rows[i].text

    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    mixed = stages["mixing to target weights"](spark, cut, FOLDER)
    rates = {r.doc_id: r.mix.rate for r in mixing.mixing_rates(cut, labels, protect="good", margin=1.15).collect()}
    times = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns
    assert all(times[i] in (int(np.floor(r)), int(np.floor(r)) + 1) for i, r in rates.items())

    ids = stages["byte-level BPE"](spark, mixed, FOLDER).collect()
    encoder = bpe.encoding()
    assert Counter((r.doc_id, bytes(r.token_ids)) for r in ids) == Counter(
        (r.doc_id, np.array(encoder.encode_ordinary(r.text), "<u4").tobytes()) for r in mixed.collect())


def test_pipeline_runs_as_a_whole(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 100


def test_stages_on_odd_rows(spark):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, FOLDER)
        assert name == corpus_pipeline.STAGES[-1][0] or got.columns == docs.columns
        got.count()
        stage(spark, docs.limit(0), FOLDER).count()
