"""Hard negatives, license scans and conversation repair against brute force on small odd tables."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from llm_tables import documents
from pyspark.sql import functions as F

from marketframe.llm import licences, mending, negatives, topk


@pytest.mark.parametrize("high, dim", [(300, 64), (10**6, 7), (2**40, 50), (2**62, 9), (5, 0), (30000, 2500)])
def test_residue_products_are_exact(high, dim):
    rng = np.random.default_rng(high)
    a, b = rng.integers(-high, high, (150, dim)), rng.integers(-high, high, (40, dim))
    want = np.array([[sum(x * y for x, y in zip(p, q)) for q in b.tolist()] for p in a.tolist()], object).reshape(150, 40)
    got = np.vstack([part for _, part in negatives.scores(a, b)])
    assert (got == np.clip(want, -(1 << 63), (1 << 63) - 1).astype(np.int64)).all()


def plain_negatives(rows, anchors):
    known = {}
    for i, label, x in rows:
        if None not in (i, label, x):
            known[i] = min(known.get(i, (label, x)), (label, x))
    out = set()
    for a in anchors & known.keys():
        label, x = known[a]
        scored = [(-sum(p * q for p, q in zip(x, y)), i, other) for i, (other, y) in known.items() if i != a and len(y) == len(x)]
        for s, p, _ in sorted(t for t in scored if t[2] == label)[:5]:
            window = sorted(t for t in scored if t[2] != label and 80 * -s <= 100 * -t[0] <= 100 * -s)[:5]
            out |= {(a, p, r, i, -s, -t) for r, (t, i, _) in enumerate(window, 1)}
    return out


def test_negatives_on_odd_rows(spark):
    rng = random.Random(3)
    # a third of all rows has one label; few values make ties, copies of ids and of vectors
    rows = [(i, rng.choice([1, 1, 2, 3, -4]), [rng.randint(-1, 2) for _ in range(rng.choice([3, 3, 3, 5]))]) for i in range(300)]
    rows += [(7, 1, [2, 2, 2]), (7, 1, [2, 2, 2]), (None, 1, [1, 1, 1]), (301, None, [1, 1, 1]), (302, 1, None), (303, 9, [4, 4]), (304, 1, []),
             (305, 2, []), (-20, 3, [2, 2, 2]), (306, 2, [1 << 40, 1 << 40, 5]), (307, 2, [1 << 40, 1 << 39, 5]), (310, 1, [3, 3, 3])]
    table = spark.createDataFrame(rows, "id long, label int, x array<long>").selectExpr("*", "id AS block", "'q' AS rank", "id AS dim", "x AS matrix")
    found = negatives.hard_negatives(table, table.where("id % 10 = 0").select("id"))
    got = [tuple(r) for r in found.collect()]
    want = plain_negatives(rows, {i for i, _, _ in rows if i is not None and i % 10 == 0})
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert negatives.hard_negatives(table.limit(0), table).count() == 0


def test_many_blocks_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_CELLS", 24)
    monkeypatch.setattr(negatives, "TILE", 3)
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 0, 1]), [rng.randint(-3, 3) for _ in range(3)]) for i in range(200)]
    table = spark.createDataFrame(rows, "id long, label int, x array<long>")
    got = {tuple(r) for r in negatives.hard_negatives(table, table.where("id % 5 = 0")).collect()}
    assert got == plain_negatives(rows, set(range(0, 200, 5)))


def test_quantized_rows_that_take_no_part(spark):
    rows = [(1, [0.5, -0.1]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, None), (5, [None, 1.0]), (6, [1e-9, -1e-9])]
    got = spark.createDataFrame(rows, "id long, e array<float>").select("id", topk.quantize(F.col("e"), 256).alias("x")).collect()
    assert {r.id: r.x for r in got} == {1: [128, -26], 2: None, 3: None, 4: None, 5: None, 6: [0, -1]}


# licenses

def plain_phrases(text, phrases):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, p) for i in range(len(words)) for p in phrases if words[i : i + len(p.split())] == p.split()]
    return words, places


LICENSE_TEXTS = [
    None, "", " \n", "MIT License", "mit license mit license", "submit license", "CC BY-NC 4.0, cc by cc by", "the mıt license", "ÉMIT License é",
    "Licensed under the Apache License, Version 2.0.", "GNU General\tPublic\n License; gnu general public licenses", "x " * 5000 + "cc_by " + "y " * 5000,
    "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */\nmit license", "License: foo", "licence: (mit",
    "License: mit or (gpl-3.0+ and bsd-3-clause) and", "license: MIT. or GPL", "license: " + "(" * 3000 + "mit" + ")" * 3000, "license: a" + "-a" * 5000,
    "Permission is hereby granted, free of charge, to any person obtaining a copy", "\x00mit\x00license\x7fcc\x80by"]


def test_phrases_at_every_place(spark):
    table = spark.createDataFrame([(i, t) for i, t in enumerate(LICENSE_TEXTS)], "doc_id long, text string")
    own = documents(spark)
    rows = [(r.text, r.f) for d in (table, own) for r in d.select("text", licences.scan(d.text).alias("f")).collect()]
    assert len(rows) == len(LICENSE_TEXTS) + own.count()
    for text, found in rows:
        words, places = plain_phrases(text, licences.PHRASES)
        notices = {licences.NOTICES[p] for _, p in plain_phrases(text, licences.NOTICES)[1]}
        assert (found.n_words, found.n_base) == (len(words), len(places))
        assert (found.first_word, found.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert found.base_labels == sorted({licences.PHRASES[p] for _, p in places})
        assert set(found.labels) >= set(found.base_labels) | notices and found.labels == sorted(set(found.labels))
        assert (found.score > 0) == bool(places or notices or re.search("licen[sc]e:|identifier:", (text or "").lower()))
    assert table.limit(0).select(licences.scan(table.text)).count() == 0


def plain_value(tokens):
    """Recursive descent, another way to the value of an expression."""
    def term(i):
        if tokens[i] == "(":
            value, i = choice(i + 1)
            return value, i + 1
        label = licences.label_of(tokens[i])
        value, i = (frozenset([label]), licences.RESTRICTION[label]), i + 1
        if i < len(tokens) and tokens[i] == "with":
            value, i = (value[0], 1 if value[1] == 2 else value[1]), i + 2
        return value, i

    def chain(i, inner, name, pick):
        value, i = inner(i)
        while i < len(tokens) and tokens[i] == name:
            more, i = inner(i + 1)
            value = value[0] | more[0], pick(value[1], more[1])
        return value, i

    def choice(i):
        return chain(i, lambda j: chain(j, term, "and", max), "or", min)

    return choice(0)[0]


def test_expressions_by_recursive_descent():
    rng = random.Random(9)

    def build(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            name = rng.choice(["MIT", "Apache-2.0", "GPL-3.0-or-later", "LGPL-2.1+", "CC-BY-NC-4.0", "AGPL-3.0", "MPL-2.0"])
            return name + (" WITH GCC-exception-3.1" if rng.random() < 0.3 else "")
        if kind < 0.5:
            return f"({build(depth - 1)})"
        return f"{build(depth - 1)} {rng.choice(['AND', 'OR', 'or'])} {build(depth - 1)}"

    for _ in range(400):
        text = build(4).lower()
        tail = rng.choice(["", " */", " and", " or (mit", ", or mit", "\nor mit", " with", ") and gpl"])
        tokens = licences.expression_tokens(text + tail, 0)
        assert "".join(tokens) == text.replace(" ", "")
        assert licences.evaluate(licences.postfix(tokens)) == plain_value(tokens)
    for wrong in ["", "and mit", "()", "(mit", "gpl with mit", "foo or mit", "with gcc-exception-3.1"]:
        tokens = licences.expression_tokens(wrong, 0)
        assert tokens in ([], ["gpl"])


# conversations

def plain_repair(rows):
    """All repairs of a conversation by falling cost; the first is the answer. ``rows`` are in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]", "", text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    best = {0: (0, "", ())}  # state: cost, audit, lines
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def inserted(cells):
        cells = dict(cells)
        for _ in range(3):
            for (p, initial), q in after.items():
                if initial != "s" and p in cells:
                    new = cells[p][0] + 2, cells[p][1] + "I", (*cells[p][2], {"u": "user:", "a": "assistant:"}[initial])
                    cells[q] = min(cells.get(q, new), new)
        return cells

    best = inserted(best)
    for (_, role, text), fault in zip(rows, faults):
        cells = {}
        for p, (cost, audit, lines) in best.items():
            found = [(p, (cost + 3, audit + "D", lines))]
            for (state, initial), q in after.items():
                if state == p and fault not in ("blank", "duplicate"):
                    late = fault == "truncated"
                    if role[:1] == initial:
                        found.append((q, (cost + late, audit + "K", (*lines, f"{role}:{text}"))))
                    if initial != "s":
                        full = {"u": "user", "a": "assistant"}[initial]
                        found.append((q, (cost + 2 + late, audit + "R", (*lines, f"{full}:{text}"))))
            for q, new in found:
                cells[q] = min(cells.get(q, new), new)
        best = inserted(cells)
    cost, audit, lines = min(best[q] for q in (0, 3) if q in best) if rows else (0, "", ())
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return {"gaps": gaps, **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")}, "illegal": illegal, "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def exhaustive(kinds, most):
    """(cost, audit) over every string of edits with at most ``most`` insertions; kinds are (initial, must go, truncated)."""
    found = []
    for n_insert in range(most + 1):
        for places in itertools.combinations_with_replacement(range(len(kinds) + 1), n_insert):
            for edits in itertools.product("KRD", repeat=len(kinds)):
                if any(gone and e != "D" for e, (_, gone, _) in zip(edits, kinds)):
                    continue
                audit, shown, cost = "", [], 2 * n_insert
                for i, (e, (initial, _, late)) in enumerate(zip(edits, kinds)):
                    audit, shown = audit + "I" * places.count(i) + e, shown + ["[ua]"] * places.count(i)
                    shown += {"K": [initial or "x"], "R": ["[ua]"], "D": []}[e]
                    cost += {"K": late, "R": 2 + late, "D": 3}[e]
                audit, shown = audit + "I" * places.count(len(kinds)), shown + ["[ua]"] * places.count(len(kinds))
                if any(len(r) == len(shown) and all(c in s for c, s in zip(r, shown))
                       for r in ("ua" * (len(shown) // 2), "s" + "ua" * ((len(shown) - 1) // 2)) if r != "s"):
                    found.append((cost, audit))
    return min(found)


def test_charts_against_every_edit_string():
    rng = random.Random(8)
    for _ in range(60):
        kinds = [(rng.choice("ssuuaa") if rng.random() < 0.9 else "", rng.random() < 0.3, rng.random() < 0.3) for _ in range(rng.randint(1, 4))]
        chart = mending.Chart()
        for initial, gone, late in kinds:
            chart.add(1, mending.deleted_cells(1) if gone else mending.row_cells(initial, late))
        cells = chart.cells()
        assert min(cells[0, q] for q in mending.ACCEPTS if (0, q) in cells) == exhaustive(kinds, 3)


def conversations(rng, n):
    for conv in [None, *range(n)]:
        for turn in range(rng.randint(1, 9)):
            yield (conv, rng.choice([turn, turn, turn, turn + 5, None]), rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None, "users"]),
                   rng.choice(["yes.", "no", "", " \t", "é?", "so! ", "more.\n\n", None, f"t{turn}.", f"u{turn}!", "x" * 5000 + "."]), rng.choice([1, 1, 1, 1, 0, 2, 5]))


def check_repair(spark, rows):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies int").selectExpr(
        "*", "'a' AS n", "'b' AS piece", "'c' AS audit", "'d' AS kind", "'e' AS first")
    got = {r.conv_id: r.asDict() for r in mending.digests(*mending.repair(table)).collect()}
    assert len(got) == len({r[0] for r in rows})
    for conv in got:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x, n in rows if c == conv for _ in range(n)]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        assert got[conv] == {"conv_id": conv} | plain_repair(own), own


def test_repair_on_odd_conversations(spark):
    check_repair(spark, list(conversations(random.Random(6), 120)))
    check_repair(spark, [(1, 0, "user", "x", 0), (2, None, None, None, 1), (3, -5, "assistant", "ok.", 1), (3, 9, "assistant", "ok.", 3)])
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string, copies int")
    assert mending.digests(*mending.repair(empty)).count() == 0


def test_one_conversation_over_many_tasks(spark):
    rng = random.Random(2)
    rows = [(1, rng.choice([t, t, None]), rng.choice(["user", "assistant", "system"]), rng.choice(["same.", f"t{t}.", f"t{t}", " "]), rng.choice([0, 1, 1, 3]))
            for t in range(900)]
    rows += [(2, t, "user", "same.", 40) for t in range(20)] + [(3, 1, "system", "s.", 1)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        check_repair(spark, rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
