"""Conversation repair: interval parsing with a weighted grammar in Chomsky normal form.

A repaired conversation is empty, or has an optional system turn and then user and assistant
turns by turns, the assistant's last: ``(s?(ua)+)?`` over the initials of the roles. The four
states between two turns are

    0 nothing yet    1 after the system turn    2 after a user's turn    3 after an assistant's turn

and a nonterminal (p, q) stands for "these rows lead from state p to state q". Its rules are
binary, (p, q) -> (p, r) (r, q); of a single row, by an edit (keep, rerole, delete); and of
nothing, by insertions, whose closure is taken once and put around each row's cell. A cell
of the chart is the cheapest (cost, audit) of a nonterminal over a span of rows; the audit is
the string of the edits' initials, ties go to the string that is least in ASCII. An audit
tells its cost, and equal costs mean that no audit starts with another one, so the order
holds whatever is appended, and cells can be combined in any grouping.

Every derivation over a span passes some state at each place inside, so any one place to
split gives the cell of a span; spans are combined bottom-up by length, two neighbours at a
time, first inside a task and then over the pieces of a conversation. Forced deletions in a
row (copies) have a cell of closed form.

Equal rows are counted, not carried. Rows are dealt by ranges of (conversation, turn, role,
text), so a conversation with a third of all rows is spread over tasks; each sends one cell
table and its counts. The audit is then cut at the pieces' borders and applied where the
rows are. Only the audits of one conversation come together, since they are one value.

* Null roles and texts count as one space. Rows go by turn, nulls first, then role and text.
* A row is blank (no word), else duplicate (role and text seen earlier in the conversation),
  else truncated (its last non-space character is not one of ``.!?``).
* Roles other than the three cannot be kept unless their first letter fits.
* A conversation without rows (``copies`` 0) has zeros and an empty audit. A null
  conversation id is a conversation. An empty table gives no rows.
* Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import settle

#: Costs of the edits.
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED_COST = 1
#: What each state allows next: initial of the role and the state after it.
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ACCEPTS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")

Cells = dict[tuple[int, int], tuple[int, str]]


@lru_cache(maxsize=1)
def insertions() -> Cells:
    """The closure of inserted user and assistant turns: the cells of a span without rows."""
    cells: Cells = {}
    for p in NEXT:
        queue = [(0, "", p)]
        while queue:
            cost, audit, q = heapq.heappop(queue)
            if (p, q) not in cells:
                cells[p, q] = cost, audit
                for role, r in NEXT[q].items():
                    if role in ROLES:
                        heapq.heappush(queue, (cost + COST["I"], audit + "I", r))
    return cells


def combine(left: Cells, right: Cells) -> Cells:
    """(p, q) -> (p, r) (r, q): the cells of two neighbouring spans together."""
    out: Cells = {}
    for (p, r), (cost, audit) in left.items():
        for q in NEXT:
            if (r, q) in right:
                more, rest = right[r, q]
                if (p, q) not in out or (cost + more, audit + rest) < out[p, q]:
                    out[p, q] = cost + more, audit + rest
    return out


@lru_cache(maxsize=None)
def row_cells(initial: str, truncated: bool) -> Cells:
    """The cells of one row that may stay, with insertions around it; ``initial`` is s, u, a or empty."""
    cells: Cells = {(p, p): (COST["D"], "D") for p in NEXT}
    for p, allowed in NEXT.items():
        for role, q in allowed.items():
            edit = "K" if role == initial else "R" if role in ROLES else None
            if edit:
                cells[p, q] = COST[edit] + TRUNCATED_COST * truncated, edit
    return combine(combine(insertions(), cells), insertions())


def deleted_cells(n: int) -> Cells:
    """The cells of ``n`` rows that must go: insertions come last, as D is less than I."""
    return {pq: (COST["D"] * n + cost, "D" * n + audit) for pq, (cost, audit) in insertions().items()}


class Chart:
    """Cells of a growing run of rows: neighbouring spans are combined once they are as long as each other."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, Cells]] = []

    def add(self, n: int, cells: Cells) -> None:
        self.spans.append((n, cells))
        while len(self.spans) > 1 and self.spans[-2][0] <= self.spans[-1][0]:
            self._join()

    def _join(self) -> None:
        (n, right), (m, left) = self.spans.pop(), self.spans.pop()
        self.spans.append((m + n, combine(left, right)))

    def cells(self) -> Cells:
        while len(self.spans) > 1:
            self._join()
        return self.spans[0][1] if self.spans else insertions()


def in_order(turns: DataFrame) -> DataFrame:
    """Each different row once, with its number, its kind and whether it is the first of its role and text.

    ``n`` equal rows of a turn are one row here. ``kind`` is blank, duplicate, truncated or
    whole; it is that of the first of them, and all others are duplicates unless blank.
    """
    same = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                        F.col("copies").cast("long").alias("copies"))
    same = same.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("n"))
    key = [F.coalesce(F.col("conv_id"), F.lit(0)).alias("k"), F.col("conv_id").isNull().alias("k_null"), F.col("role").alias("k_role"),
           F.col("text").alias("k_text")]
    first = same.where("n > 0").groupBy(*key).agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
    joined = same.join(first, [key[0] == first.k, key[1] == first.k_null, same.role == first.k_role, same.text == first.k_text], "left")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    kind = (F.when(blank, "blank").when(~F.col("turn").eqNullSafe(F.col("first.turn")), "duplicate")
            .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated").otherwise("whole"))
    return joined.select("conv_id", "turn", "role", "text", "n", kind.alias("kind"))


ORDER = ["conv_id", "turn", "role", "text"]
COUNTS = ["blank", "duplicate", "truncated", "illegal", "distinct_turns"]
_PIECE = pa.schema([("conv_id", pa.int64()), ("piece", pa.int32()), *[(c, pa.int64()) for c in COUNTS], ("rows", pa.int64()),
                    ("first_role", pa.string()), ("last_role", pa.string()), ("min_turn", pa.int64()), ("max_turn", pa.int64()),
                    ("states", pa.list_(pa.int32())), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])
_PIECE_SQL = ("conv_id long, piece int, " + ", ".join(f"{c} long" for c in COUNTS) + ", rows long, first_role string, last_role string, "
              "min_turn long, max_turn long, states array<int>, costs array<long>, audits array<string>")


def flat(cells: Cells) -> dict:
    return {"states": [4 * p + q for p, q in cells], "costs": [c for c, _ in cells.values()], "audits": [a for _, a in cells.values()]}


def unflat(row: dict) -> Cells:
    return {divmod(s, 4): (c, a) for s, c, a in zip(row["states"], row["costs"], row["audits"])}


class Piece:
    """The chart and the counts of one conversation's rows in one task."""

    def __init__(self, conv_id: int | None, piece: int) -> None:
        self.out = {"conv_id": conv_id, "piece": piece, "rows": 0} | dict.fromkeys(COUNTS, 0)
        self.out |= dict.fromkeys(["first_role", "last_role", "min_turn", "max_turn"])
        self.chart = Chart()

    def add(self, turn: int | None, role: str, n: int, kind: str) -> None:
        out, initial = self.out, role[:1]
        if n == 0:
            return
        if out["rows"]:
            out["illegal"] += out["last_role"] + initial not in LEGAL
        else:
            out["first_role"] = initial
        out["illegal"] += n - 1  # no role may follow itself
        out["last_role"] = initial
        out["rows"] += n
        if turn is not None and turn != out["max_turn"]:
            out["distinct_turns"] += 1
            out["min_turn"] = turn if out["min_turn"] is None else out["min_turn"]
            out["max_turn"] = turn
        if kind == "blank":
            out["blank"] += n
            self.chart.add(n, deleted_cells(n))
            return
        out["duplicate"] += n - (kind != "duplicate")
        if kind == "duplicate":
            self.chart.add(n, deleted_cells(n))
            return
        out["truncated"] += kind == "truncated"
        self.chart.add(1, row_cells(initial if initial in ("s", "u", "a") else "", kind == "truncated"))
        if n > 1:
            self.chart.add(n - 1, deleted_cells(n - 1))

    def done(self) -> dict:
        return self.out | flat(self.chart.cells())


def batched(rows: Iterator[dict], schema: pa.Schema, size: int = 1024) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def pieces(rows: DataFrame) -> DataFrame:
    """One row a conversation and task of the range deal: its counts and the cells of its span."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            now = None
            for conv_id, piece, turn, role, n, kind in stream(batches):
                if now is None or (now.out["conv_id"], now.out["piece"]) != (conv_id, piece):
                    if now is not None:
                        yield now.done()
                    now = Piece(conv_id, piece)
                now.add(turn, role, n, kind)
            if now is not None:
                yield now.done()

        yield from batched(each(), _PIECE)

    dealt = rows.select("conv_id", "piece", "turn", "role", "n", "kind", "seq").repartition("conv_id", "piece").sortWithinPartitions("conv_id", "seq")
    return dealt.drop("seq").mapInArrow(work, _PIECE_SQL)


def whole(found: list[dict]) -> Iterator[dict]:
    """The verdict on a conversation, with each piece's cut of the audit; ``found`` are its pieces in order."""
    counts = {c: sum(f[c] for f in found) for c in COUNTS}
    filled = [f for f in found if f["rows"]]
    for a, b in zip(filled, filled[1:]):
        counts["illegal"] += a["last_role"] + b["first_role"] not in LEGAL
    known = [f for f in filled if f["max_turn"] is not None]
    counts["distinct_turns"] -= sum(a["max_turn"] == b["min_turn"] for a, b in zip(known, known[1:]))
    gaps = known[-1]["max_turn"] - known[0]["min_turn"] + 1 - counts["distinct_turns"] if known else 0
    # the best (cost, audit) of the pieces so far by the state they end in, and where each came from
    best, origin = {0: (0, "")}, []
    cells = [unflat(f) if f["rows"] else {(p, p): (0, "") for p in NEXT} for f in found]
    for own in cells:
        ends = [(best[p][0] + cost, best[p][1] + audit, q, p) for (p, q), (cost, audit) in own.items() if p in best]
        best, back = {}, {}
        for cost, audit, q, p in sorted(ends, reverse=True):  # the least comes last and stays
            best[q], back[q] = (cost, audit), p
        origin.append(back)
    (cost, audit), state = min((best[q], q) for q in ACCEPTS if q in best)
    total = {"gaps": gaps} | {c: counts[c] for c in COUNTS[:4]} | {"cost": cost}
    cuts = []
    for f, own, back in zip(found[::-1], cells[::-1], origin[::-1]):
        cuts.append((f["piece"], back[state], own[back[state], state][1]))
        state = back[state]
    at = 0
    for number, (piece, start, own) in enumerate(cuts[::-1]):
        yield total | {"conv_id": found[0]["conv_id"], "piece": piece, "start": start, "cut": own, "at": at, "audit": audit if number == 0 else None}
        at += len(own) - own.count("D")


_WHOLE_SQL = ("conv_id long, piece int, start int, cut string, at long, gaps long, blank long, duplicate long, truncated long, illegal long, "
              "cost long, audit string")
_WHOLE = pa.schema([("conv_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int32()), ("cut", pa.string()), ("at", pa.int64()),
                    *[(c, pa.int64()) for c in ("gaps", *COUNTS[:4], "cost")], ("audit", pa.string())])


def verdicts(found: DataFrame) -> DataFrame:
    """The pieces of each conversation combined; one row a piece, the first has the whole audit."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            held: list[dict] = []
            for batch in batches:
                for row in batch.to_pylist():
                    if held and held[0]["conv_id"] != row["conv_id"]:
                        yield from whole(held)
                        held = []
                    held.append(row)
            if held:
                yield from whole(held)

        yield from batched(each(), _WHOLE)

    # a conversation has at most as many pieces as there are tasks
    return found.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(work, _WHOLE_SQL)


def edited(audit: Iterator[str], state: int, rows: Iterator[tuple]) -> Iterator[tuple]:
    """(edit, role, text) of what stays of a piece, insertions included; ``rows`` are (role, text, n)."""
    edit = next(audit, None)
    for role, text, n in rows:
        for _ in range(n):
            while edit == "I":
                initial = next(r for r in NEXT[state] if r in ROLES)
                state = NEXT[state][initial]
                yield "I", ROLES[initial], ""
                edit = next(audit, None)
            if edit == "K":
                state = NEXT[state][role[:1]]
                yield "K", role, text
            elif edit == "R":
                initial = next(r for r in NEXT[state] if r in ROLES)
                state = NEXT[state][initial]
                yield "R", ROLES[initial], text
            edit = next(audit, None)
    while edit == "I":
        initial = next(r for r in NEXT[state] if r in ROLES)
        state = NEXT[state][initial]
        yield "I", ROLES[initial], ""
        edit = next(audit, None)


_LINES = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def apply_audits(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """The repaired rows: ``conv_id``, ``position``, ``edit``, ``role``, ``text``."""
    cuts = judged.select("conv_id", "piece", F.lit(-1).cast("long").alias("seq"), F.lit("").alias("role"), F.col("cut").alias("text"),
                         F.col("at").alias("n"), "start")
    both = cuts.unionByName(rows.select("conv_id", "piece", "seq", "role", "text", "n", F.lit(0).alias("start")))
    met = both.repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "seq")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = stream(batches)

        def each() -> Iterator[dict]:
            ahead = next(given, None)
            while ahead is not None:
                conv_id, _, cut, at, start = ahead[0], *ahead[2:]  # the cut comes first

                def own() -> Iterator[tuple]:
                    nonlocal ahead
                    ahead = next(given, None)
                    while ahead is not None and ahead[1] >= 0:
                        yield ahead[2:5]
                        ahead = next(given, None)

                for position, (edit, role, text) in enumerate(edited(iter(cut), start, own()), at):
                    yield {"conv_id": conv_id, "position": position, "edit": edit, "role": role, "text": text}

        yield from batched(each(), _LINES, 256)

    return met.select("conv_id", "seq", "role", "text", "n", "start").mapInArrow(
        work, "conv_id long, position long, edit string, role string, text string")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdict a conversation, repaired rows). ``turns`` has conv_id, turn, role, text and ``copies``."""
    ordered = settle(in_order(turns), "repair-rows")
    # the number of the task and of the row in it, in the order of the whole table
    ranged = ordered.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    rows = settle(ranged.withColumn("piece", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()), "repair-ranges")
    judged = settle(verdicts(pieces(rows)), "repair-verdicts")
    verdict = judged.where(F.col("audit").isNotNull()).select("conv_id", "gaps", *COUNTS[:4], "cost", "audit")
    return verdict, apply_audits(rows, judged)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with ``copies``, damaged by crc32 of ``conv_id:turn`` modulo 20 (nulls: one space)."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    hit = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return conversations.select(
        "conv_id", "turn", F.when(hit == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1).alias("copies"))


def digests(verdict: DataFrame, lines: DataFrame) -> DataFrame:
    """``verdict`` with ``repaired_sha256``: the lines ``role:text`` of the repaired rows, joined by newlines."""
    fields = [f.name for f in verdict.schema if f.name != "conv_id"]
    both = verdict.select("conv_id", F.lit(-1).cast("long").alias("position"), F.lit(None).cast("string").alias("line"), F.struct(*fields).alias("v"))
    both = both.unionByName(lines.select("conv_id", "position", F.concat("role", F.lit(":"), "text").alias("line")), allowMissingColumns=True)
    met = both.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.string() if c == "audit" else pa.int64()) for c in fields], ("repaired_sha256", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            now, digest = None, None
            for conv_id, position, text, found in stream(batches):
                if position < 0:
                    if now is not None:
                        yield now | {"repaired_sha256": digest.hexdigest()}
                    now, digest = {"conv_id": conv_id} | found, hashlib.sha256()
                else:
                    digest.update(("\n" * (position > 0) + text).encode())
            if now is not None:
                yield now | {"repaired_sha256": digest.hexdigest()}

        yield from batched(each(), schema)

    return met.mapInArrow(work, ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in schema))
