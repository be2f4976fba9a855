"""Chat formatting into budgeted windows, with Spark SQL functions only.

Template of a turn: ``<s>role\\ntext</s>``, a user's text inside ``[INST] … [/INST]``. The
control strings are escaped inside roles and texts (``<s>`` becomes ``%3Cs>``, ``%`` becomes
``%25`` and so on), so no text can open or close a turn, and ``unescape`` gives it back.

The prefix sums of the turns' words choose the windows: a grid line every ``budget / 2``
words; a turn that crosses or starts on a line starts a new window. A window's own turns
hold at most ``budget`` words, unless its first turn alone has more than half of that; a
turn is never cut. Windows after the first open with the conversation's first system turn
and repeat the last turns of the window before, as far as they fit ``history`` words. Only
an assistant's own turns are under the loss; repeated ones are masked.

* A null text is empty, a null role is the empty role; both keep their turn.
* Turns are ordered by ``turn`` (nulls first), ties by role and text; repeated rows are
  turns of their own. Rows with a null ``conv_id`` form one conversation with a null id.
* A conversation is never collected for windowing: prefix sums run over sorted rows, and
  only a window's turns, bounded by the budget, are gathered into one row.
* An empty table gives no windows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketframe.llm.common import WORD

BUDGET = 512
HISTORY = 96
#: Control strings and what stands for them inside texts; "%" comes first.
ESCAPES = (("%", "%25"), ("<s>", "%3Cs>"), ("</s>", "%3C/s>"), ("[INST]", "%5BINST]"), ("[/INST]", "%5B/INST]"))
OPEN, CLOSE, ASK, ASKED = "<s>", "</s>", "[INST] ", " [/INST]"


def escape(text: Column) -> Column:
    for control, safe in ESCAPES:
        text = F.replace(text, F.lit(control), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for safe, control in (("%3C", "<"), ("%5B", "["), ("%25", "%")):
        text = F.replace(text, F.lit(safe), F.lit(control))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("%0A"), F.lit("\n")))


def _turn_text(role: Column, body: Column) -> Column:
    user = role == "user"
    return F.concat(
        F.lit(OPEN), role, F.lit("\n"), F.when(user, F.lit(ASK)).otherwise(F.lit("")), body,
        F.when(user, F.lit(ASKED)).otherwise(F.lit("")), F.lit(CLOSE))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: ``conv_id``, ``window``, ``formatted``, ``n_repeated`` and ``loss``.

    ``n_repeated`` turns at the start repeat earlier ones. ``loss`` lists (start, length) in
    code points of ``formatted``, counted from 0.
    """
    grid = max(1, budget // 2)
    role = escape_role(F.coalesce(F.col("role"), F.lit("")))
    body = escape(F.coalesce(F.col("text"), F.lit("")))
    turns = conversations.select("conv_id", F.col("turn").alias("turn"), role.alias("role"), body.alias("body")).withColumn(
        "words", F.regexp_count("body", F.lit(WORD)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    sofar = order.rowsBetween(Window.unboundedPreceding, 0)
    turns = turns.withColumn("pos", F.row_number().over(order)).withColumn("end", F.sum("words").over(sofar))
    begin = F.col("end") - F.col("words")
    crosses = F.floor(begin / grid) != F.floor(F.greatest(F.col("end") - 1, begin) / grid)
    starts = (F.col("pos") > 1) & (F.col("words") > 0) & ((begin % grid == 0) | crosses) & (begin > 0)
    turns = turns.withColumn("window", F.sum(starts.cast("int")).over(sofar))
    system = F.first(F.when(F.col("role") == "system", F.struct("pos", "role", "body")), ignorenulls=True)
    inside = Window.partitionBy("conv_id", "window").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    turns = (
        turns.withColumn("windows", F.max("window").over(Window.partitionBy("conv_id")))
        .withColumn("system", system.over(sofar))
        .withColumn("first", F.coalesce(F.lag("window").over(order) != F.col("window"), F.lit(False)))
        .withColumn("tail", F.sum("words").over(inside)))
    # kind 0: the system turn again, 1: history, 2: the window's own turn
    entry = lambda window, kind, pos, role, body: F.struct(
        window.cast("int").alias("window"), F.lit(kind).alias("kind"), pos.alias("pos"), role.alias("role"), body.alias("body"))
    own = entry(F.col("window"), 2, F.col("pos"), F.col("role"), F.col("body"))
    again = F.when((F.col("window") < F.col("windows")) & (F.col("tail") <= history) & (F.col("role") != "system"),
                   entry(F.col("window") + 1, 1, F.col("pos"), F.col("role"), F.col("body")))
    kept = F.when(F.col("first") & F.col("system").isNotNull(),
                  entry(F.col("window"), 0, F.col("system.pos"), F.col("system.role"), F.col("system.body")))
    entries = turns.select("conv_id", F.explode(F.array_compact(F.array(own, again, kept))).alias("e"))
    gathered = entries.groupBy("conv_id", F.col("e.window").alias("window")).agg(
        F.sort_array(F.collect_list(F.struct("e.kind", "e.pos", "e.role", "e.body"))).alias("turns"))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))

    def add(state: Column, t: Column) -> Column:
        piece = _turn_text(t.role, t.body)
        span = F.struct((state.at + F.length(F.concat(F.lit(OPEN), t.role)) + 1).alias("start"), F.length(t.body).alias("length"))
        under = (t.kind == 2) & (t.role == "assistant")
        return F.struct(
            F.concat(state.text, piece).alias("text"), (state.at + F.length(piece)).alias("at"),
            F.when(under, F.concat(state.loss, F.array(span))).otherwise(state.loss).alias("loss"))

    built = gathered.select(
        "conv_id", "window", F.aggregate("turns", start, add).alias("w"),
        F.size(F.filter("turns", lambda t: t.kind < 2)).alias("n_repeated"))
    return built.select("conv_id", "window", F.col("w.text").alias("formatted"), "n_repeated", F.col("w.loss").alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per window, from the formatted text alone: the own turns and the text under the loss."""
    pieces = F.slice(F.split("formatted", CLOSE), F.col("n_repeated") + 1, F.greatest(
        F.size(F.split("formatted", CLOSE)) - 1 - F.col("n_repeated"), F.lit(0)))

    def parse(piece: Column) -> Column:
        inner = F.substring(piece, len(OPEN) + 1, 2147483647)
        cut = F.locate("\n", inner)
        role = F.substr(inner, F.lit(1), cut - 1)
        body = F.substr(inner, cut + 1)
        plain = F.when(role == "user", F.substr(body, F.lit(len(ASK) + 1), F.length(body) - len(ASK) - len(ASKED))).otherwise(body)
        return F.struct(unescape_role(role).alias("role"), unescape(plain).alias("text"))

    loss = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s.start + 1, s.length)))
    return formatted.select(
        "conv_id", "window", F.transform(pieces, parse).alias("turns"), F.array_join(loss, "").alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation: digests of the turns and of the text under the loss, read back from the windows."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    per_window = read_back(formatted).select(
        "conv_id", "window", F.size("turns").alias("n"), told.alias("told"), "loss_text", "formatted_chars")
    whole = per_window.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("window", "told", "loss_text"))).alias("w"),
        F.sum("formatted_chars").alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_windows"))
    turns = F.array_join(F.col("w.told"), "")
    loss = F.array_join(F.col("w.loss_text"), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars", "n_windows")
