"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it as context and only that reply
under the loss. Turns after the last reply form one more example without loss, so that the whole
conversation can be read back. A turn is ``<|turn|>role<|says|>text<|end|>`` and a line break. Inside
roles and texts a backslash is doubled, and one is put after the first character of what a tokenizer
may take for a control string (``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``), so no text can
forge a mark and every text can be read back.

A row holds an example with its whole context, as the method asks, so the rows of one conversation
together must fit into a task; a conversation is the only thing that is gathered.

Defined cases: null texts and roles count as empty; turns are ordered by number (nulls first), then
role, then text, so repeated rows stand side by side; rows with a null conversation form one; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>\n"


def escape(text: Column) -> Column:
    text = F.regexp_replace(text, r"\\", r"\\\\")
    text = F.regexp_replace(text, r"<(?=\||/?s>)", r"<\\")
    return F.regexp_replace(text, r"\[(?=/?INST\])", r"[\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def examples(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target_role: str = "assistant"
) -> DataFrame:
    """``conv_col``, ``example_no`` (from 0), ``example``, ``loss_start`` (from 0, null without loss), ``loss_length``, ``is_last``."""
    role, text = (F.coalesce(turns[c].cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(
        turns[conv_col].alias("__conv"),
        F.struct(
            turns[turn_col].alias("turn"),
            role.alias("role"),
            text.alias("text"),
            F.concat(F.lit(TURN), escape(role), F.lit(SAYS)).alias("head"),
            escape(text).alias("body"),
        ).alias("t"),
    )
    grouped = rows.groupBy("__conv").agg(F.sort_array(F.collect_list("t")).alias("t"))
    n = F.size("t")
    targets = F.filter(F.sequence(F.lit(1), n), lambda i: (F.element_at("t", i)["role"] == target_role) | (i == F.size("t")))
    exploded = grouped.select("__conv", "t", F.posexplode(targets).alias("example_no", "i"))
    last = F.element_at("t", F.col("i"))
    context = F.array_join(F.transform(F.slice("t", 1, F.col("i") - 1), lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    opened = exploded.select(
        F.col("__conv").alias(conv_col),
        F.col("example_no").cast("long").alias("example_no"),
        F.concat(context, last["head"]).alias("__open"),
        last["body"].alias("__body"),
        (last["role"] == target_role).alias("__loss"),
        (F.col("i") == n).alias("is_last"),
    )
    return opened.select(
        conv_col,
        "example_no",
        F.concat("__open", "__body", F.lit(END)).alias("example"),
        F.when(F.col("__loss"), F.length("__open")).cast("long").alias("loss_start"),
        F.when(F.col("__loss"), F.length("__body")).otherwise(0).cast("long").alias("loss_length"),
        "is_last",
    )


def parse(example: Column) -> Column:
    """An array of (role, text) read back from an example."""
    parts = F.filter(F.split(example, r"<\|turn\|>"), lambda x: x != "")
    return F.transform(
        parts,
        lambda x: F.struct(
            unescape(F.regexp_extract(x, r"(?s)^(.*?)<\|says\|>", 1)).alias("role"),
            unescape(F.regexp_extract(x, r"(?s)^.*?<\|says\|>(.*)<\|end\|>\n$", 1)).alias("text"),
        ),
    )


def read_back(out: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row for each conversation, from the examples alone: what its turns and its loss spans hold."""
    said = parse(F.col("example"))
    loss = unescape(F.substring(F.col("example"), F.coalesce(F.col("loss_start"), F.lit(0)).cast("int") + 1, F.col("loss_length").cast("int")))
    rows = out.select(
        conv_col,
        F.struct("example_no", loss.alias("loss")).alias("__loss"),
        F.length("example").alias("__chars"),
        F.when(F.col("is_last"), said).alias("__turns"),
    )
    both = rows.groupBy(conv_col).agg(
        F.max("__turns").alias("__turns"), F.sort_array(F.collect_list("__loss")).alias("__loss"), F.sum("__chars").alias("formatted_chars")
    )
    text = F.array_join(F.transform("__turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss_text = F.array_join(F.transform("__loss", lambda x: x["loss"]), "")
    return both.select(
        conv_col,
        F.size("__turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length(loss_text).cast("long").alias("loss_chars"),
        F.sha2(loss_text, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
