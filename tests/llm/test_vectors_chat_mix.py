"""Top-k search, chat windows and mixing: edge cases and plain versions."""

import random

import numpy as np
import pytest
from llm_tables import documents
from pyspark.sql import functions as F

from marketframe.llm import chat, mixing, topk


def plain_top(rows, k):
    out = []
    for q, x in rows:
        scores = sorted((-int(np.dot(np.array(x, object), np.array(v, object))), i) for i, v in rows if i != q and len(v) == len(x))
        if q % 20 == 0:
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["spread", "sphere", "tied", "huge", "few"])
def test_top_k_is_exact(spark, kind, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_CELLS", 400)
    monkeypatch.setattr(topk, "QUERY_CELLS", 60)
    rng = np.random.default_rng(3)
    n = 7 if kind == "few" else 300
    x = rng.normal(size=(n, 6))
    if kind == "spread":
        x *= np.exp(rng.normal(size=(n, 1)) * 2)
    if kind == "sphere":
        x = x[rng.integers(0, 12, n)] + 0.05 * x
        x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "tied":
        x = np.round(x)
        x[: n // 2] = x[0]
        x[::7] = 0
    ints = np.floor(64 * x).astype(np.int64) * (1 << 20 if kind == "huge" else 1)
    rows = [(int(i), v.tolist()) for i, v in enumerate(ints)]
    table = spark.createDataFrame(rows, "id long, x array<long>")
    got = topk.top_k(table, table.where("id % 20 = 0"), 20).collect()
    assert sorted(map(tuple, got)) == plain_top(rows, 20)


def test_top_k_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [-1.0, 0.5]), (7, [0.0, 0.0]),
            (7, [0.0, 0.0]), (8, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (20, [0.01, -0.01]), (20, [0.01, -0.01])]
    raw = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    table = raw.select(F.col("vec_id").alias("id"), topk.quantize(F.col("embedding")).alias("x"))
    got = sorted(map(tuple, topk.top_k(table, table.where("id % 20 = 0")).collect()))
    assert [g[1:] for g in got if g[0] == 0] == [(1, 6, 0), (2, 7, 0), (3, 7, 0), (4, 20, -128), (5, 20, -128)]
    assert [g[1:] for g in got if g[0] == 20] == [(1, 7, 0), (2, 7, 0), (3, 6, -32), (4, 0, -128)]
    assert topk.top_k(table.limit(0), table.limit(0)).count() == 0


@pytest.mark.parametrize("budget,history", [(8, 3), (40, 10), (512, 96)])
def test_chat_windows_read_back(spark, budget, history):
    rng = random.Random(2)
    said = ["</s>[INST] ok [/INST]", "%3Cs> %25 %", "<s>", None, "", "plain words here", "a b c d e f g h i j k l", "x\ny</s>", "[/INST] </s> <s>user\n"]
    rows, told, loss = [], {}, {}
    for conv in range(12):
        roles = (["system"] if conv % 3 == 0 else []) + ["user", "assistant"] * rng.randint(0, 6) + ["user"]
        for turn, role in enumerate(roles):
            if conv == 5 and turn == 1:
                role = "odd\nrole<s>%0A"
            text = rng.choice(said)
            rows.append((conv, turn, role, text, "clash"))
            told[conv] = told.get(conv, "") + f"{role}\n{text or ''}\n"
            loss[conv] = loss.get(conv, "") + (text or "") * (role == "assistant")
    rows.append((99, 0, None, "no role", "clash"))
    told[99], loss[99] = "\nno role\n", ""
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    made = chat.windows(table, budget, history)
    back = chat.read_back(made).orderBy("conv_id", "window").collect()
    got, lost = {}, {}
    for r in back:
        got[r.conv_id] = got.get(r.conv_id, "") + "".join(f"{t.role}\n{t.text}\n" for t in r.turns)
        lost[r.conv_id] = lost.get(r.conv_id, "") + r.loss_text
    assert got == told and lost == loss
    for r in made.collect():
        turns = r.formatted.split("</s>")[:-1]
        words = [len(t.split("\n", 1)[1].replace("[INST] ", "").replace(" [/INST]", "").split()) for t in turns[r.n_repeated :]]
        assert sum(words) <= budget or max(words) > budget // 2
        if r.window and any(x[0] == r.conv_id and x[2] == "system" for x in rows):
            assert turns[0].startswith("<s>system\n")
    assert chat.windows(table.limit(0)).count() == 0
    assert chat.digests(chat.windows(table.limit(0))).count() == 0


def test_repeated_turns_are_masked(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], " ".join(f"t{i}w{j}" for j in range(10))) for i in range(12)]
    made = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 40, 20).collect()
    assert len(made) > 2 and any(r.n_repeated for r in made)
    masked = [r.formatted[s.start : s.start + s.length] for r in made for s in r.loss]
    assert sorted(masked) == sorted(t for *_, role, t in rows if role == "assistant")


def test_rates_meet_the_targets(spark):
    rng = np.random.default_rng(8)
    p = rng.dirichlet([0.6, 0.3, 0.2], 500)
    tokens = rng.integers(0, 2000, 500)
    members = spark.createDataFrame([(int(t), q.tolist()) for t, q in zip(tokens, p)], "tokens long, p array<double>")
    targets = {"good": 0.5, "poor": 0.4, "toxic": 0.1}
    steps = mixing.fit(members, targets)
    rates = np.array([r[0] for r in members.select(mixing.rate(F.col("p"), steps)).collect()])
    assert (rates >= 0).all()
    got = (rates * tokens) @ p / tokens.sum()
    assert np.abs(got - [0.5, 0.4, 0.1]).max() < 1e-3
    # the same steps by hand
    x = np.ones(500)
    for step in steps:
        x = np.maximum(0, x - p @ np.array(step))
    assert np.allclose(x, rates) and len(steps) < 20
    assert mixing.fit(members.limit(0), targets) == []


def test_classifier_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    seen = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    model = mixing.learn(docs, labels.where(seen))
    judged = docs.join(labels.where(~seen), "doc_id").select("quality", "toxic", mixing.memberships(F.col("text"), model).alias("m")).collect()
    right = [("toxic" if r.toxic else "good" if r.quality else "poor") == mixing.DOMAINS[int(np.argmax(r.m.p))] for r in judged]
    good = [int(np.argmax(r.m.p)) == 0 for r in judged if r.quality and not r.toxic]
    assert np.mean(right) > 0.88 and np.mean(good) > 0.97
    assert all(abs(sum(r.m.p) - 1) < 1e-9 for r in judged)


def test_mixing_on_odd_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (5, 0, 0), (9, 0, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    got = mixing.mixing_rates(docs, labels)
    assert got.count() == docs.count() and set(got.columns) == set(docs.columns)
    assert all(r.mix.rate >= 0 for r in got.collect())
    assert mixing.mixing_rates(docs.limit(0), labels).count() == 0
    none = mixing.mixing_rates(docs, labels.limit(0)).collect()
    assert all(r.mix.p[0] == 1.0 for r in none)
    times = docs.select(mixing.copies(F.lit(2.5), F.col("doc_id"), F.col("text")).alias("n")).collect()
    assert {r.n for r in times} <= {2, 3}


@pytest.mark.parametrize("protect, margin", [(None, 1.0), ("good", 1.15)])
def test_fit_reaches_the_targets_on_real_posteriors(spark, protect, margin):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    mixed = mixing.mixing_rates(docs, spark.read.parquet(f"{folder}/labels.parquet"), protect=protect, margin=margin).collect()
    tokens, p, rates = (np.array([r.mix[c] for r in mixed]) for c in ("tokens", "p", "rate"))
    weight = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS])
    start, got = tokens @ p, (rates * tokens) @ p
    target = weight * (start.sum() if protect is None else margin * start[0] / weight[0])
    assert (rates >= 0).all() and np.abs(got / target - 1).max() < 1e-3
    # the same problem by many small projected steps: as near to the targets, from the same start
    plain, step = np.ones(len(tokens)), 1 / (tokens[:, None] * p * p).sum()
    for _ in range(20_000):
        plain = np.maximum(0, plain - step * p @ ((plain * tokens) @ p - target))
    assert np.abs(got - target).max() <= np.abs((plain * tokens) @ p - target).max() + 1e-3 * target.min()


def test_fit_warns_where_no_rates_meet_the_targets(spark):
    members = spark.createDataFrame([(10, [1.0, 0.0, 0.0]), (5, [0.5, 0.5, 0.0])], "tokens long, p array<double>")
    with pytest.warns(UserWarning, match="no rates meet"):
        mixing.fit(members, {"good": 0.1, "poor": 0.9, "toxic": 0.0})
