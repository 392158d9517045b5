"""Chat formatting in budgeted windows, in DataFrame functions only.

A conversation's turns are written one after the other as

    <|im_start|>ROLE newline TEXT <|im_end|> newline

Control strings inside texts and roles are escaped by one more backslash between ``<`` and ``|``, and
unescaped by taking one away; backslashes and line breaks of a role are written as ``\\\\`` and ``\\n``.

Prefix sums of turn tokens choose the spans: position p lies in cell p div C, where C is the budget
less the system turn and the history, but at least a quarter of the budget, if the system turn leaves that.
Turns that lie within one cell form a span of at most C tokens; a turn that crosses a border has a span of
its own, so spans are aligned with turns and no turn is cut. Each window starts with the system turn, if the
conversation has one, followed by the turns before the span that fit into ``history`` tokens and into what
system turn and span leave of the budget. Repeated turns are context: only assistant turns of the span
itself are targets, so every assistant text is under the loss mask exactly once. A window exceeds
the budget only where one turn and the system turn alone do; such a window repeats no history. With a
system turn that exceeds it by itself, spans are a quarter of the budget.

Prefix sums run over blocks of turns and are shifted by the blocks before them, and history is found by
an equi-join of cells, so a conversation of any length is spread over tasks. Only the digests of a
whole conversation, which its contract asks for, gather its text in one row.

A missing role or text is empty. Turns with equal numbers are ordered by role and text; repeated rows
are turns of their own. A missing conversation id is a conversation. Missing turn numbers come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabscope.plans.scratch import materialise

START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY = 1024, 256
TURNS_PER_BLOCK = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    line = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return escape(line)


def unescape_role(role: Column) -> Column:
    # A lone backslash before n is a line break; two backslashes are one.
    parts = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def turn_tokens(text: Column) -> Column:
    """Words and single signs, a stand-in for model tokens that needs no vocabulary; four for the marks."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]")).cast("long") + 4


def _numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, no, role, text, body, tokens, at): turns from 0, with the tokens before each.

    Equal (conv_id, turn) rows keep together; blocks of turn numbers are summed on their own.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    body = F.concat(F.lit(START), escape_role(role), F.lit("\n"), escape(text), F.lit(f"{END}\n"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), body.alias("body"))
    rows = rows.withColumn("tokens", turn_tokens(F.col("text")))
    rows = rows.withColumn("part", F.coalesce(F.expr(f"floor(turn / {TURNS_PER_BLOCK})").cast("long"), F.lit(-(2**62))))
    order = ["turn", "role", "text"]
    before = Window.partitionBy("conv_id", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumns(
        {
            "own_no": F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)) - 1,
            "own_at": F.coalesce(F.sum("tokens").over(before), F.lit(0)),
        }
    )
    parts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.sum("tokens").alias("sum"))
    above = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select(
        F.col("conv_id").alias("c"),
        F.col("part").alias("p"),
        F.coalesce(F.sum("n").over(above), F.lit(0)).alias("no_before"),
        F.coalesce(F.sum("sum").over(above), F.lit(0)).alias("at_before"),
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
    return inside.join(shifts, same).select(
        "conv_id",
        (F.col("own_no") + F.col("no_before")).alias("no"),
        "role",
        "body",
        "tokens",
        (F.col("own_at") + F.col("at_before")).alias("at"),
    )


def budgeted_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window (rising, with gaps), n_tokens, n_repeated (turns at its start that are
    context), formatted, and loss, the (start, length) spans of targets in code points of formatted.
    """
    rows = materialise(_numbered(turns), "turns")
    system = rows.filter("no = 0 AND role = 'system'").select(
        F.col("conv_id").alias("c"), F.col("body").alias("system"), F.col("tokens").alias("system_tokens")
    )
    placed = rows.join(system, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    held = F.coalesce("system_tokens", F.lit(0))
    quarter = F.lit(max(1, budget // 4))
    step = F.greatest(F.lit(budget - history) - held, quarter)
    # Beyond the budget by itself, a system turn does not narrow the spans any further.
    step = F.when(held < budget, F.least(step, budget - held)).otherwise(quarter).cast("long")
    placed = placed.withColumn("step", step).withColumn("is_system", (F.col("no") == 0) & (F.col("role") == "system"))
    first, last = F.expr("at div step"), F.expr("(at + tokens - 1) div step")
    placed = placed.withColumn("cell", F.struct(first.alias("a"), last.alias("b")))
    # Of the turns that start in a cell, only the last can cross its border.
    number = F.expr("2 * cell.a + int(cell.a < cell.b)").cast("long").alias("window")
    left = F.lit(budget) - F.max(held) - F.sum("tokens")
    spans = placed.groupBy("conv_id", "cell").agg(
        F.min("at").alias("from"),
        F.min("no").alias("from_no"),
        F.greatest(F.lit(0), F.least(F.lit(history), left)).alias("room"),
    )
    spans = spans.select("*", number)
    own = placed.select(
        "conv_id", number, "no", "role", "body", "tokens", F.lit(False).alias("repeated")
    )
    # Turns that begin at most ``room`` tokens before a span does, and so end less than ``history`` before:
    # those of the same or the last cell of ``history`` tokens, counted by where they end.
    wide = max(1, history)
    ends = placed.filter("NOT is_system").select(
        F.col("conv_id").alias("c"),
        "no", "role", "body", "tokens", "at",
        F.expr(f"(at + tokens) div {wide}").alias("end_cell"),
    )
    near = F.explode(F.expr(f"array(`from` div {wide}, `from` div {wide} - 1)")).alias("at_cell")
    later = spans.filter("from_no > 0").select("conv_id", "window", "from", "from_no", "room", near)
    repeated = later.join(
        ends,
        F.col("conv_id").eqNullSafe(F.col("c"))
        & (F.col("at_cell") == F.col("end_cell"))
        & (F.col("no") < F.col("from_no"))
        & (F.col("at") >= F.col("from") - F.col("room")),
    ).select("conv_id", "window", "no", "role", "body", "tokens", F.lit(True).alias("repeated"))
    kept_system = (
        spans.filter("from_no > 0")
        .join(system, F.col("conv_id").eqNullSafe(F.col("c")))
        .select(
            "conv_id", "window", F.lit(0).cast("long").alias("no"), F.lit("system").alias("role"),
            F.col("system").alias("body"), F.col("system_tokens").alias("tokens"), F.lit(True).alias("repeated"),
        )
    )
    members = own.unionByName(repeated).unionByName(kept_system)
    # A window holds at most budget tokens, or one turn more: its turns fit into a row.
    turn = F.struct("no", "role", "body", "tokens", "repeated")
    windows = members.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    lengths = F.transform("turns", lambda t: F.length(t["body"]))
    windows = windows.withColumn("starts", lengths).withColumn(
        "starts", F.transform("starts", lambda x, i: F.aggregate(F.slice("starts", 1, i), F.lit(0), lambda s, y: s + y))
    )

    def span(t: Column, start: Column) -> Column:
        head = F.length(F.lit(START)) + F.length(escape_role(t["role"])) + 1
        return F.struct(
            (start + head).alias("start"),
            (F.length(t["body"]) - head - len(END) - 1).alias("length"),
            ((t["role"] == "assistant") & ~t["repeated"]).alias("target"),
        )

    spans_of = F.zip_with("turns", "starts", span)
    loss = F.transform(
        F.filter(spans_of, lambda s: s["target"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))
    )
    return windows.select(
        "conv_id",
        "window",
        F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + t["tokens"]).alias("n_tokens"),
        F.size(F.filter("turns", lambda t: t["repeated"])).alias("n_repeated"),
        F.array_join(F.transform("turns", lambda t: t["body"]), "").alias("formatted"),
        loss.alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """An array of (role, text) read back from a formatted window."""
    pieces = F.split(formatted, r"<\|im_start\|>", -1)
    pieces = F.slice(pieces, F.lit(2), F.size(pieces))

    def turn(piece: Column) -> Column:
        at = F.instr(piece, "\n")
        text = F.substring(piece, at + 1, F.length(piece) - at - len(END) - 1)
        return F.struct(
            unescape_role(F.substring(piece, F.lit(1), at - 1)).alias("role"), unescape(text).alias("text")
        )

    return F.transform(pieces, turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"])))


def conversation_digests(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows and max_tokens (of
    the longest window), read back from the formatted windows."""
    turns = read_turns(F.col("formatted"))
    turns = F.slice(turns, F.col("n_repeated") + 1, F.size(turns))
    said = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = windows.select(
        "conv_id",
        "window",
        F.size(turns).alias("n_turns"),
        F.array_join(said, "").alias("said"),
        F.array_join(read_loss(F.col("formatted"), F.col("loss")), "").alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
        "n_tokens",
    )
    part = F.struct("window", "said", "loss")
    rows = read.groupBy("conv_id").agg(
        F.sum("n_turns").cast("long").alias("n_turns"),
        F.sum("chars").alias("formatted_chars"),
        F.count("*").alias("n_windows"),
        F.max("n_tokens").alias("max_tokens"),
        F.array_sort(F.collect_list(part)).alias("parts"),
    )
    rows = rows.select(
        "conv_id", "n_turns", "formatted_chars", "n_windows", "max_tokens",
        F.array_join("parts.said", "").alias("said"), F.array_join("parts.loss", "").alias("loss"),
    )
    return rows.select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
        "max_tokens",
    )
