"""License scans: phrases and identifier tags by Aho-Corasick, expressions by a shunting yard.

Two automata read every whole text once. One runs over the text's words (lower-cased, joined
by one space) and finds the phrases: the base ones, which only name a license, and notices,
which grant one. The other runs over the lower-cased text itself and finds identifier tags
(``SPDX-License-Identifier:``, ``License:`` and the like). What follows a tag on its line is
the longest prefix that is an expression of known identifiers, ``AND``, ``OR``, ``WITH`` and
brackets; a shunting yard puts it in postfix order, and a stack evaluates that:

* an identifier's value is the set of its labels and how far it restricts use
  (0 attribution, 1 changed files, 2 whole works, 3 no free use);
* ``OR`` leaves the choice: all labels, the lesser restriction;
* ``AND`` binds: all labels, the greater restriction;
* ``WITH`` names an exception: the same labels, one step less of copyleft.

A document's labels are those of its phrases and expressions; its restriction is the
greatest of theirs; its score is how surely it states a license: 1 with an expression, else
``NOTICE_SCORE``, ``PHRASE_SCORE`` or ``TAG_SCORE`` (a tag whose expression is unknown), else 0.

* A null text counts as empty: no words, no labels, score 0, restriction null.
* Phrases may overlap and repeat; every place counts. A phrase inside a longer word is none.
* A very long text takes time and memory in proportion to its length.
* Documents are judged one by one, so repeated rows get equal results, an empty table gives
  no rows, and other columns stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from marketframe.llm.common import raw

#: Phrases that name a license.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Phrases of notices, with their labels.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "free and unencumbered software released into the public domain": "unlicense",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "all rights reserved": "reserved",
}
#: Tags before an expression.
TAGS = ["spdx-license-identifier:", "license-expression:", "license:", "licence:"]
#: Labels and how far they restrict use. An identifier is a label, or a label, a hyphen and more.
RESTRICTION = {
    "0bsd": 0, "apache": 0, "bsd": 0, "bsl": 0, "cc-by": 0, "cc0": 0, "isc": 0, "mit": 0, "unlicense": 0, "zlib": 0,
    "epl": 1, "lgpl": 1, "mpl": 1, "agpl": 2, "cc-by-sa": 2, "gpl": 2, "cc-by-nc": 3, "cc-by-nd": 3, "reserved": 3,
}
BINDS = {"or": 1, "and": 2, "with": 3}
NOTICE_SCORE, PHRASE_SCORE, TAG_SCORE = 0.9, 0.75, 0.25

_TOKEN = re.compile(r"[ \t]*([()]|[a-z0-9][a-z0-9.+-]*)")
_EXCEPTION = re.compile(r"[a-z0-9.-]*exception[a-z0-9.-]*")
#: Letters in lower case, digits and all bytes from 128 on as they are, everything else a space.
_WORDS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()

FIELDS = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "array<string>",
          "labels": "array<string>", "expressions": "array<string>", "restriction": "int", "score": "double"}


def label_of(identifier: str) -> str | None:
    """The longest label that the identifier is, or starts with before a hyphen."""
    named = identifier.removesuffix("+") + "-"
    return max((label for label in RESTRICTION if named.startswith(f"{label}-")), key=len, default=None)


def expression_tokens(text: str, start: int) -> list[str]:
    """The longest prefix of the rest of the line that is a whole expression; empty if there is none."""
    tokens, whole, depth, operand, last = [], 0, 0, True, ""
    while match := _TOKEN.match(text, start):
        token, start = match[1].rstrip("."), match.end()
        if operand:
            if token == "(" and last != "with":
                depth += 1
            elif (_EXCEPTION.fullmatch(token) if last == "with" else label_of(token)) is not None:
                operand = False
            else:
                break
        elif token == ")" and depth:
            depth -= 1
        elif token in BINDS and not (token == "with" and (last == ")" or _EXCEPTION.fullmatch(last))):
            operand = True
        else:
            break
        tokens.append(token)
        last = token
        if not operand and not depth:
            whole = len(tokens)
        if match[1] != token:  # a full stop ends the expression
            break
    return tokens[:whole]


def postfix(tokens: list[str]) -> list[str]:
    """A whole expression in postfix order, by a shunting yard; equal operators bind from the left."""
    out, waiting = [], []
    for token in tokens:
        if token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        elif token in BINDS:
            while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= BINDS[token]:
                out.append(waiting.pop())
            waiting.append(token)
        else:
            out.append(token)
    return out + waiting[::-1]


def evaluate(ordered: list[str]) -> tuple[frozenset, int]:
    """Labels and restriction of an expression in postfix order."""
    stack: list[tuple[frozenset, int]] = []
    for token in ordered:
        if token not in BINDS:
            label = label_of(token)
            stack.append((frozenset([label]), RESTRICTION[label]) if label else (frozenset(), 0))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left[0], 1 if left[1] == 2 else left[1]))
        else:
            stack.append((left[0] | right[0], (min if token == "or" else max)(left[1], right[1])))
    return stack[0]


@lru_cache(maxsize=1)
def automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    """The automata of the phrases (between spaces) and of the tags, built once a process."""
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase in PHRASES.keys() | NOTICES.keys():
        # a phrase may be both: it is one entry of the automaton
        phrases.add_word(f" {phrase} ", (len(phrase) + 1, PHRASES.get(phrase), NOTICES.get(phrase)))
    for tag in TAGS:
        tags.add_word(tag, len(tag))
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def scan_one(data: bytes) -> tuple:
    """The values of ``FIELDS`` for the UTF-8 bytes of one text."""
    phrases, tags = automata()
    words = data.translate(_WORDS).split()
    joined = f" {b' '.join(words).decode()} "
    base, starts, labels, expressions, worst, score = set(), [], set(), [], [], 0.0
    for end, (back, named, granted) in phrases.iter(joined):
        if named:
            starts.append(end - back)
            base.add(named)
            score = max(score, PHRASE_SCORE)
        if granted:
            labels.add(granted)
            score = max(score, NOTICE_SCORE)
    worst += [RESTRICTION[label] for label in base | labels]
    lowered = data.lower().decode()  # bytes: A to Z only
    for end, _ in tags.iter(lowered):
        tokens = expression_tokens(lowered, end + 1)
        score = max(score, 1.0 if tokens else TAG_SCORE)
        if tokens:
            found, restriction = evaluate(postfix(tokens))
            labels |= found
            worst.append(restriction)
            expressions.append(" ".join(tokens))
    place = [joined.count(" ", 0, at) for at in ((min(starts), max(starts)) if starts else ())] or [None, None]
    return (len(words), len(starts), place[0], place[1], sorted(base), sorted(base | labels), expressions,
            max(worst) if worst else None, score)


def scan(text: Column) -> Column:
    """A struct of ``FIELDS`` for each text."""

    @F.pandas_udf(f"struct<{','.join(f'{name}:{kind}' for name, kind in FIELDS.items())}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = pd.DataFrame([scan_one(t) for t in texts], columns=list(FIELDS))
            for name in ("first_word", "last_word", "restriction"):
                found[name] = found[name].astype("Int64")
            yield found

    return run(raw(text))
