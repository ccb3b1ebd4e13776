"""Chat formatting into budgeted training windows, with DataFrame functions only.

Method: prefix sums of turn tokens put each turn into a window; windows are
turn-aligned. The system turn (a first turn of role ``system``) is repeated at
the head of every window, and up to ``history_turns`` last turns of the window
before follow it, as far as they fit into a quarter of the budget. Repeated
turns are masked: each assistant text is a target exactly once.

A window of new turns takes at most the room that the system turn and the
history leave: prefix sums are cut at half of it, and a turn longer than that
half gets a window of its own. Only a system turn or a single turn that is too
long by itself makes a window exceed the budget; no turn is cut or dropped.

Template: ``<s>``, then for each turn ``[INST] role [/INST]text</s>``. Inside
roles and texts a backslash is put after the first character of each of these
markers (and of those with backslashes there already), which ``unescape`` takes
out again.

Nulls and edge cases: a null text or role is empty; rows without conversation
id form one conversation; null turns come first; turns with equal numbers are
ordered by role, then text; repeated rows are repeated turns; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, ROLE_START, ROLE_END, TURN_END = "<s>", "[INST] ", " [/INST]", "</s>"


def escape(text: Column) -> Column:
    text = F.regexp_replace(text, r"<(\\*)(/?s>)", r"<\\$1$2")
    return F.regexp_replace(text, r"\[(\\*)(/?INST\])", r"[\\$1$2")


def unescape(text: Column) -> Column:
    text = F.regexp_replace(text, r"<\\(\\*)(/?s>)", r"<$1$2")
    return F.regexp_replace(text, r"\[\\(\\*)(/?INST\])", r"[$1$2")


def rough_tokens(text: Column) -> Column:
    """Four characters a token, and four tokens for a turn's markers."""
    return F.floor((F.char_length(text) + 3) / 4) + 4


def place_turns(turns: DataFrame, budget: int, history_turns: int, tokens: Callable[[Column], Column]) -> DataFrame:
    """conv_id, window, n (place of the turn), repeated, role, text: a row for each turn in each of its windows."""
    by_conv = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    whole = Window.partitionBy("conv_id")
    history = budget // 4
    t = turns.withColumns({"n": F.row_number().over(by_conv), "tokens": tokens(F.col("text"))})
    t = t.withColumn("is_system", (F.col("n") == 1) & (F.col("role") == "system"))
    room = F.greatest(budget - history - F.max(F.when(F.col("is_system"), F.col("tokens")).otherwise(0)).over(whole), F.lit(budget // 4))
    t = t.withColumn("half", F.floor(room / 2))
    t = t.withColumn("big", ~F.col("is_system") & (F.col("tokens") > F.col("half")))
    order = Window.partitionBy("conv_id").orderBy("n")
    t = t.withColumn("run", 2 * F.sum(F.col("big").cast("int")).over(order) - F.col("big").cast("int"))
    in_run = Window.partitionBy("conv_id", "run").orderBy("n")
    t = t.withColumn("slot", F.when(F.col("big"), 0).otherwise(F.floor((F.sum(F.when(F.col("is_system"), 0).otherwise(F.col("tokens"))).over(in_run) - 1) / F.col("half"))))
    new = ~F.col("is_system") & ~(F.lag("run").over(order).eqNullSafe(F.col("run")) & F.lag("slot").over(order).eqNullSafe(F.col("slot")) & ~F.lag("is_system", 1, False).over(order))
    t = t.withColumn("window", F.sum(new.cast("int")).over(order))
    t = t.withColumn("last_window", F.greatest(F.max("window").over(whole), F.lit(1)))
    from_end = Window.partitionBy("conv_id", "window").orderBy(F.desc("n"))
    again = ~F.col("is_system") & (F.row_number().over(from_end) <= history_turns) & (F.sum("tokens").over(from_end) <= history) & (F.col("window") < F.col("last_window"))
    t = t.withColumn("again", again)
    copies = F.when(F.col("is_system"), F.sequence(F.lit(1), "last_window")).when(F.col("again"), F.array(F.col("window"), F.col("window") + 1)).otherwise(F.array("window"))
    t = t.select("conv_id", "n", "role", "text", "is_system", F.posexplode(copies).alias("copy", "window"))
    return t.select("conv_id", F.col("window").cast("long").alias("window"), "n", (F.col("copy") > 0).alias("repeated"), "role", "text")


def format_windows(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = 1024, history_turns: int = 2, tokens: Callable[[Column], Column] = rough_tokens, target_role: str = "assistant") -> DataFrame:
    """conv_id, window (from 1), formatted, n_repeated (turns at its head that an earlier window had as new), loss (character spans of the targets)."""
    turns = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    placed = place_turns(turns, budget, history_turns, tokens)
    marked = placed.select(
        "conv_id", "window", "n", "repeated",
        F.concat(F.lit(ROLE_START), escape(F.col("role")), F.lit(ROLE_END)).alias("head"),
        escape(F.col("text")).alias("body"),
        ((F.col("role") == target_role) & ~F.col("repeated")).alias("target"),
    )
    rows = marked.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(F.struct("n", "repeated", "head", "body", "target"))).alias("turns"))
    size = lambda t: F.char_length(t.head) + F.char_length(t.body) + len(TURN_END)
    before = lambda i: F.aggregate(F.slice("turns", 1, i), F.lit(len(HEAD)), lambda total, t: total + size(t))
    spans = F.transform("turns", lambda t, i: F.struct(t.target.alias("target"), (before(i) + F.char_length(t.head)).alias("start"), F.char_length(t.body).alias("length")))
    return rows.select(
        "conv_id", "window",
        F.concat(F.lit(HEAD), F.array_join(F.transform("turns", lambda t: F.concat(t.head, t.body, F.lit(TURN_END))), "")).alias("formatted"),
        F.size(F.filter("turns", lambda t: t.repeated)).alias("n_repeated"),
        F.transform(F.filter(spans, lambda s: s.target), lambda s: F.struct(s.start.alias("start"), s.length.alias("length"))).alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, window, chars, turns (role, text of the turns that are new in it) and loss_text, all read from ``formatted``."""
    pieces = F.split(F.substring("formatted", len(HEAD) + 1, 2**31 - 1), "</s>")
    pieces = F.slice(pieces, F.col("n_repeated") + 1, F.size(pieces) - 1 - F.col("n_repeated"))
    pattern = r"(?s)^\[INST\] (.*?) \[/INST\](.*)$"
    part = lambda p, g: unescape(F.regexp_extract(p, pattern, g))
    return windows.select(
        "conv_id", "window", F.char_length("formatted").cast("long").alias("chars"),
        F.transform(pieces, lambda p: F.struct(part(p, 1).alias("role"), part(p, 2).alias("text"))).alias("turns"),
        F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s.start + 1, s.length))), "").alias("loss_text"),
    )


def conversation_digests(windows: DataFrame) -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest of a whole conversation needs its text in one row; the windows don't.
    """
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    rows = read_back(windows).select("conv_id", "chars", F.size("turns").alias("n"), F.struct("window", lines.alias("lines"), "loss_text").alias("part"))
    whole = rows.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.array_sort(F.collect_list("part")).alias("parts"), F.sum("chars").cast("long").alias("formatted_chars"))
    joined = lambda field: F.array_join(F.col("parts").getField(field), "")
    return whole.select("conv_id", "n_turns", F.sha2(joined("lines"), 256).alias("turns_sha256"), F.char_length(joined("loss_text")).cast("long").alias("loss_chars"), F.sha2(joined("loss_text"), 256).alias("loss_sha256"), "formatted_chars")
