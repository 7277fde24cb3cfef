"""Chat formatting by prefix-target expansion, in DataFrame expressions only.

Every assistant turn becomes an example of its own: all turns before it are
context, only its text is trainable. Turns after the last assistant turn (or a
conversation without one) come in one more example without a trainable part, so
that nothing is lost.

Template of a turn: ``<|role|>\\n`` text ``</s>\\n``. Control strings inside roles
and texts get a backslash after their first character, backslashes are doubled;
both are undone when an example is read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Control strings of this and other common templates: the place where a backslash goes in.
INSIDE = r"(?<=\[)(?=/?INST\])|(?<=<)(?=/?s>|\||<SYS|</SYS)|(?<=\|)(?=>)"
#: The same place with its backslash; doubled backslashes never match.
ESCAPED = r"(?<=\[)\\(?=/?INST\])|(?<=<)\\(?=/?s>|\||<SYS|</SYS)|(?<=\|)\\(?=>)"
END = "</s>\n"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), INSIDE, r"\\")


def unescape(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, ESCAPED, ""), F.lit("\\\\"), F.lit("\\"))


def head(role: Column) -> Column:
    """The role is escaped together with the bar before it: it must not end the head by its first characters."""
    return F.concat(F.lit("<"), escape(F.concat(F.lit("|"), role)), F.lit("|>\n"))


def format_examples(conversations: DataFrame) -> DataFrame:
    """One row per example: conv_id, example_no, last_example, formatted, loss_start,
    loss_chars (code points; loss_start counts from 1), target_turn.

    Input: conv_id, turn, role, text; further columns are ignored. Rows of a
    conversation are ordered by turn, then role and text (null turns first), so
    ties and repeated rows are kept, in a defined order. Null text or role: empty.
    A null conv_id is a conversation of its own. An empty table gives no rows.
    A conversation is one row while it is formatted: its size is bounded by what
    a model can read, not by the table.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), head(role).alias("head"), escape(text).alias("body"))
    # where each turn ends in the whole conversation: prefixes are cut from one string
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    size = F.length("head") + F.length("body") + len(END)
    rows = rows.select("conv_id", "turn", "head", "body", (F.col("role") == "assistant").alias("target"), F.row_number().over(order).alias("no"), F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int").alias("end"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("no", "turn", "target", "head", "body", "end"))).alias("pieces"))
    convs = convs.select("conv_id", "pieces", F.concat_ws("", F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END)))).alias("whole"))
    spans = F.filter(
        F.transform(
            "pieces", lambda p: F.struct(p["end"].alias("end"), p["target"].alias("target"), p["turn"].alias("turn"), F.length(p["body"]).alias("chars"), (p["no"] == F.size("pieces")).alias("final"))
        ),
        lambda s: s["target"] | s["final"],
    )
    rows = convs.select("conv_id", "whole", F.size(spans).alias("n"), F.posexplode(spans).alias("example_no", "span"))
    span = F.col("span")
    return rows.select(
        "conv_id", "example_no", (F.col("example_no") == F.col("n") - 1).alias("last_example"),
        F.substring("whole", F.lit(1), span["end"]).alias("formatted"),
        F.when(span["target"], span["end"] - len(END) - span["chars"] + 1).alias("loss_start"),
        F.when(span["target"], span["chars"]).otherwise(0).alias("loss_chars"),
        F.when(span["target"], span["turn"]).alias("target_turn"),
    )


def loss_text(formatted: Column, start: Column, chars: Column) -> Column:
    """The text under an example's loss mask, unescaped; empty if nothing is trainable."""
    return F.coalesce(unescape(F.substring(formatted, start, chars)), F.lit(""))


def parse_turns(formatted: Column) -> Column:
    """array<struct<role,text>> read back from a formatted example."""
    parts = F.filter(F.split(formatted, END), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            F.substring(unescape(F.substring(p, F.lit(2), F.instr(p, "|>\n") - 2)), F.lit(2), F.length(p)).alias("role"),
            unescape(F.substring(p, F.instr(p, "|>\n") + 3, F.length(p))).alias("text"),
        ),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from its examples alone: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars (of all its examples together)."""
    rows = examples.select(
        "conv_id", F.length("formatted").cast("long").alias("chars"),
        F.struct("example_no", loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("text")).alias("loss"),
        F.when(F.col("last_example"), F.col("formatted")).alias("longest"),
    )
    found = rows.groupBy("conv_id").agg(
        F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("loss")).alias("losses"), F.max("longest").alias("longest")
    )
    loss, turns = F.concat_ws("", F.col("losses.text")), parse_turns(F.col("longest"))
    read = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    found = found.select("conv_id", "formatted_chars", loss.alias("loss"), turns.alias("turns"))
    return found.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(read, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
