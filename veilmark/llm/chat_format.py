"""Operator 8: chat formatting by event-sourced reconstruction, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Marks of the rendered template. Escaped texts hold neither these nor the control strings below.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of common templates: `<|...`, `<s>`, `</s>`, `[INST]`, `[/INST]`, `<<SYS>>`, `<</SYS>>`.
_CONTROL = r"([<\[])(\||/?s>|/?INST\]|</?SYS>>)"


def escape(text: Column) -> Column:
    """Doubles backslashes, then puts one behind the first character of every control string."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of a log (conv_id, seq, kind, turn, role, text).

    Kinds: `message` opens a turn with a role and a first text, `delta` appends, `edit` replaces the text so
    far, `regenerate` empties the turn and drops the later turns that were open. Each turn's last opening or
    replacing event counts; what is streamed before it is history. A repeated event (all columns equal)
    applies once; different events of one seq apply in the order of kind and text. Null texts are empty, a
    null role reads as empty. A turn's events meet in one task, no more: the rest works on one row a turn.
    """
    reset = F.when(F.col("kind").isin("message", "edit", "regenerate"), F.col("seq"))
    turn = Window.partitionBy("conv_id", "turn")
    current = events.select("conv_id", "seq", "kind", "turn", "role", "text").withColumn("opened", F.max(reset).over(turn))
    current = current.withColumn("regenerated", F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(turn))
    current = current.withColumn("role", F.last("role", True).over(turn.orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    current = current.filter(F.col("opened").isNull() | (F.col("seq") >= F.col("opened")))
    parts = F.array_sort(F.collect_set(F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"))))
    turns = current.groupBy("conv_id", "turn").agg(
        F.coalesce(F.first("role"), F.lit("")).alias("role"),
        F.array_join(F.transform(parts, lambda e: e["text"]), "").alias("text"),
        F.max("opened").alias("opened"),
        F.max("regenerated").alias("regenerated"),
    )
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("cut", F.max("regenerated").over(earlier))
    return turns.filter(F.col("cut").isNull() | (F.col("opened") > F.col("cut"))).select("conv_id", "turn", "role", "text")


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row for each conversation: conv_id, formatted, loss_spans (start and end in code points of formatted).

    The mask covers the escaped text of each turn of `loss_role`, without its marks. Turns stand by number,
    equal numbers by role and text. A conversation without messages has no row.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    rows = messages.select(
        "conv_id", "turn", "role", "text", F.length(head).alias("head_len"), F.length(escape(F.col("text"))).alias("text_len"),
        F.concat(head, escape(F.col("text")), F.lit(END)).alias("piece"),
    )
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn(
        "before", F.coalesce(F.sum(F.length("piece").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    )
    start = F.col("before") + F.col("head_len")
    span = F.when(F.col("role") == loss_role, F.struct(start.alias("start"), (start + F.col("text_len")).alias("end")))
    sorted_rows = F.array_sort(F.collect_list(F.struct("n", "piece", span.alias("span"))))
    return rows.groupBy("conv_id").agg(sorted_rows.alias("turns")).select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss_text, formatted_chars) parsed from the rendered strings and masks alone."""
    pieces = F.filter(F.split("formatted", r"<\|turn\|>"), lambda p: p != "")

    def turn(piece: Column) -> Column:
        role = F.regexp_extract(piece, r"(?s)^(.*?)<\|text\|>", 1)
        text = F.regexp_extract(piece, r"(?s)^.*?<\|text\|>(.*)<\|end\|>$", 1)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    under_mask = F.transform("loss_spans", lambda s: F.col("formatted").substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return formatted.select("conv_id", F.transform(pieces, turn).alias("turns"), unescape(F.array_join(under_mask, "")).alias("loss_text"), F.length("formatted").cast("bigint").alias("formatted_chars"))


def format_chats(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """The log folded into final messages, then rendered: conv_id, formatted, loss_spans.

    Columns beside the six of the log are not read. An empty log gives no rows.
    """
    return render(fold_events(events), loss_role)
