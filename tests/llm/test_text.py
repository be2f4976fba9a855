"""Host rules, BPE round trip, token blocks and language: edge cases and plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from llm_tables import LONG, documents
from pyspark.sql import functions as F

from marketframe.llm import bpe, hostrules, repair, zlang


def plain_counts(text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in (text or "")).split(" ") if w]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= set(range(i, i + 8))
    seen, doubled = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            doubled += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), doubled, len(covered)


@pytest.mark.parametrize("text", [
    None, "", " \t\n", "one", "a b c d e", "x\ny\nx\n\n\nx", "# * <b> & | $ %",
    "a b c d e f g h i " * 3, "same " * 30, "a b c d e f g h X a b c d e f g h", "é\x1cü ß\x85"])
def test_counts_are_the_plain_ones(text):
    assert hostrules.text_counts(text) == plain_counts(text)


def test_host_rules_on_odd_rows(spark):
    got = hostrules.host_quality(documents(spark)).collect()
    assert len(got) == documents(spark).count()
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[1].n_words == 0 and by_id[1].base_failed and not by_id[1].kept
    assert by_id[6].kept and by_id[6].host is None
    assert hostrules.host_quality(documents(spark).limit(0)).count() == 0


def test_a_bad_host_takes_its_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, good if i % 50 == 0 else "bad", "bad.example") for i in range(200)]
    rows += [(1000 + i, good, f"host{i % 9}") for i in range(180)] + [(5000, "bad", "tiny"), (5001, good, "tiny")]
    got = {r.doc_id: r.kept for r in hostrules.host_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[0] and got[1000] and got[5001] and not got[5000]


@pytest.mark.parametrize("size", [1, 7, 64])
def test_parts_give_the_ids_of_the_whole(size):
    encoder = bpe.encoding()
    text = "It's 12 été  d'eux\n\n a1 b2, (x)   y. Ünïcode 漢字 😀 don't   stop " * 9 + "q" * 300
    assert "".join(bpe.parts(text, size)) == text
    ids = [i for part in bpe.parts(text, size) for i in encoder.encode_ordinary(part)]
    assert ids == encoder.encode_ordinary(text)


def test_bpe_round_trip_on_odd_rows(spark):
    docs = documents(spark)
    got = bpe.digests(bpe.encode_documents(docs)).collect()
    encoder = bpe.encoding()
    want = sorted(
        (str(r.doc_id), len(ids := encoder.encode_ordinary(r.text or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
         hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect())
    assert sorted((str(r[0]), *r[1:]) for r in got) == want
    assert bpe.encode_documents(docs.limit(0)).count() == 0


def test_blocks_expand_to_their_ids_and_ranges():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 40, 5000), np.tile([3, 3, 3, 7], 500), np.full(777, 5), rng.integers(0, 40, 100)]).astype("<u4")
    left, right, spans, symbols = repair.compress(ids, 60_000)
    assert len(symbols) < len(ids) * 0.7 and (repair.expand(symbols, left, right, 60_000) == ids).all()
    one = [len(repair.expand(np.array([60_000 + i]), left, right, 60_000)) for i in range(len(left))]
    assert one == spans.tolist()
    row = repair.block_row(0, 0, [1, None, 3], [ids[:4000].tobytes(), b"", ids[4000:].tobytes()], 60_000)
    block = repair.Block(row)
    for a, b in ((0, 0), (0, 1), (17, 4321), (len(ids) - 3, len(ids)), (0, len(ids))):
        assert (block.ids(a, b) == ids[a:b]).all()
    assert [(d, len(x)) for d, x in block.documents()] == [(1, 4000), (None, 0), (3, len(ids) - 4000)]


@pytest.mark.parametrize("block_ids", [50, 1 << 20])
def test_token_files_read_back(spark, tmp_path, block_ids):
    docs = documents(spark)
    repair.write(docs, str(tmp_path / "t"), block_ids=block_ids)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in repair.read(spark, str(tmp_path / "t")).collect())
    library = repair.tokenizer()
    rows = sorted(((-1 if r.doc_id is None else r.doc_id), r.text or "") for r in docs.collect())
    sizes = [len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows]
    assert [g[0] for g in got] == [r[0] for r in rows]
    by_start = sorted(got, key=lambda g: g[1])
    assert [g[0] for g in by_start] == [r[0] for r in rows] and sorted(g[2] for g in got) == sorted(sizes)
    assert [g[1] for g in by_start] == np.cumsum([0, *[g[2] for g in by_start[:-1]]]).tolist()
    crc = {zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for _, t in rows}
    assert {g[3] for g in got} == crc
    repair.write(docs.limit(0), str(tmp_path / "e"))
    assert repair.read(spark, str(tmp_path / "e")).count() == 0


def test_words_give_the_library_ids():
    texts = ["", None, "plain text, isn't it? 12%", "<|endoftext|> inside", "漢字かな 😀", "a\x1cb\x85c d e", LONG[:5000], "x" * 3000, " a b", "a  b",
             "a \nb", "a\n b", "a\n\nb c\nd", "a\tb c", "it's we'll d'été ½ ² x", "a b ", "a b\n", "«é» – “q” 3€"]
    encoder = repair.Encoder()
    want = [encoder.library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder(texts)] == want
        encoder.known.clear()


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = zlang.learn(docs.where(~held))
    got = docs.where(held).select("lang", zlang.predict(F.col("text"), model).alias("p")).collect()
    assert np.mean([r.lang == r.p.lang_pred for r in got]) > 0.9
    assert np.mean([r.p.rejected for r in got]) < 0.03
    assert all(0 <= r.p.score <= 1 for r in got)


def test_language_on_odd_rows(spark):
    docs = documents(spark)
    model = zlang.learn(docs)
    got = {r.doc_id: r.p for r in docs.select("doc_id", zlang.predict(F.col("text"), model).alias("p")).collect()}
    assert got[1] == ("und", 0.0, True) and got[2].lang_pred == "und" and got[3].lang_pred == "und"
    assert zlang.learn(docs.limit(0)) == {}
    assert zlang.predict_one("text", []) == ("und", 0.0)
    assert zlang.predict_one("text", zlang.compressors({"en": b"some text here"})) == ("en", 1.0)
    assert zlang.predict_one("12 34 !", zlang.compressors({"en": b"some text here"})) == ("und", 0.0)


def test_library_gets_bounded_parts():
    encode = repair.Encoder()
    sizes, call = [], encode.call
    encode.call = lambda texts: sizes.append((len(texts), sum(map(len, texts)))) or call(texts)
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(900)) for _ in range(20)] + ["a  b " * 30_000, "c  d"]
    got = encode(texts)
    assert got == [np.array(repair.tokenizer().encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert all(n <= repair.CALL_TEXTS and (n == 1 or c <= repair.CALL_CHARACTERS) for n, c in sizes)
