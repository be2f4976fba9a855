"""Small odd tables for the corpus operators."""

import random

_rng = random.Random(5)
#: A text of some thousand different words.
LONG = " ".join("".join(_rng.choice("abcdeilnorstu") for _ in range(_rng.randint(2, 9))) for _ in range(4000))


def documents(spark):
    """Null, empty and blank texts, a very long one, ties, repeated rows, a null id, and columns whose names clash."""
    first = " ".join(LONG.split()[:120])
    rows = [
        (1, None, None, "src0"), (2, "", "en", ""), (3, " \t\n ", "fr", "src1"), (4, LONG, "en", "src0"), (5, first, "en", "src2"),
        (6, first, "en", None), (6, first, "en", None), (7, "été " + first[:400] + " <|endoftext|>", "fr", "src2"), (None, first + " more", "de", "src3"),
        (8, "one word", None, "src4"), (9, "a b " * 200, "es", "src4"), (10, "x" * 900, "en", "src5"), (10, "other text of ten", "en", "src5")]
    out = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    odd = ["n_chars", "marks", "cut", "mix", "fp", "x", "a", "h", "p", "rank", "start", "tokens", "root", "component_id", "kept", "domain", "n_words", "host"]
    return out.selectExpr("*", *[f"'{name}' AS {name}" for name in odd])
