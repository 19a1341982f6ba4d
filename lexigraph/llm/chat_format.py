"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted, and runs of one
role merged to a block.  A block reads ``<s>`` + role mark + texts joined by
``[TURN]`` + ``</s>``.  Control strings inside texts are escaped with a
backslash and their number, backslashes doubled, so the output can be read
back exactly.

The loss mask has one entry per text in output order: offset and length
(code points) inside its segment, a segment being what stands between the
end marks ``[TURN]`` and ``</s>``; length 0 for text that carries no loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template; a text never holds one after escaping.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "[ROLE]", "[/ROLE]", "[TURN]")
ROLE_MARK = {"user": "[INST]", "assistant": "[/INST]", "system": "<<SYS>>"}
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for i, s in enumerate(CONTROL):
        out = F.replace(out, F.lit(s), F.lit(f"\\{i}"))
    return out


def unescape(text: Column) -> Column:
    def part(p: Column) -> Column:
        for i, s in enumerate(CONTROL):
            p = F.replace(p, F.lit(f"\\{i}"), F.lit(s))
        return p

    return F.array_join(F.transform(F.split(text, r"\\\\"), part), "\\")


def _mark(role: Column) -> Column:
    out = F.concat(F.lit("[ROLE]"), escape(role), F.lit("[/ROLE]"))
    for name, mark in ROLE_MARK.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conv_id: formatted, loss_mask (array of offset, length),
    n_blocks.

    Input columns conv_id, turn, role, text; others are ignored.  Null text
    and null role: empty.  Null turn: first.  Equal turns are ordered by
    role, then text; repeated rows are turns of their own.  A null conv_id
    is a conversation.  An empty table gives no row.  Very long texts are
    formatted whole: a conversation is one row.  Ignored columns may have any
    name.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    c = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("s"))
    # run starts first, as a column: a lambda would redo what it captures for each element
    s, n = F.col("s"), F.size("s")
    c = c.withColumn("starts", F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.try_element_at(s, i)["role"] != F.try_element_at(s, i - 1)["role"])))
    c = c.withColumn("blocks", F.transform("starts", lambda p, k: F.struct(
        F.try_element_at(s, p)["role"].alias("role"),
        F.transform(F.slice(s, p, F.coalesce(F.try_element_at(F.col("starts"), k + 2), n + 1) - p), lambda x: escape(x["text"])).alias("texts"))))
    c = c.withColumn("blocks", F.transform("blocks", lambda b: F.struct(
        F.concat(F.lit("<s>"), _mark(b["role"])).alias("head"), (b["role"] == LOSS_ROLE).alias("loss"), b["texts"].alias("texts"))))
    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(b["head"], F.array_join(b["texts"], "[TURN]"), F.lit("</s>"))), "")
    mask = F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda x, j: F.struct(
        F.when(j == 0, F.length(b["head"])).otherwise(0).alias("offset"),
        F.when(b["loss"], F.length(x)).otherwise(0).alias("length")))))
    return c.select("conv_id", formatted.alias("formatted"), mask.alias("loss_mask"), F.size("blocks").alias("n_blocks"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """The inverse: conv_id, turns (array of role, text in order) and
    loss_texts (the texts under the loss mask, in order)."""
    blocks = F.filter(F.split("formatted", "</s>"), lambda b: b != "")
    d = formatted.withColumn("_blocks", blocks)

    def parsed(b: Column) -> Column:
        role = unescape(F.substring_index(F.substring_index(b, "[/ROLE]", 1), "[ROLE]", -1))
        body = b.substr(F.locate("[/ROLE]", b) + 7, F.length(b))
        for name, mark in ROLE_MARK.items():
            here = b.startswith(F.lit("<s>" + mark))
            role = F.when(here, F.lit(name)).otherwise(role)
            body = F.when(here, b.substr(F.lit(len(mark) + 4), F.length(b))).otherwise(body)
        return F.struct(role.alias("role"), F.split(body, r"\[TURN\]").alias("texts"))

    d = d.withColumn("_blocks", F.transform("_blocks", parsed))
    turns = F.flatten(F.transform("_blocks", lambda b: F.transform(b["texts"], lambda x: F.struct(b["role"].alias("role"), unescape(x).alias("text")))))
    # one segment per text; what follows the last end mark is empty and has no mask entry
    pairs = F.arrays_zip(F.split("formatted", r"</s>|\[TURN\]").alias("seg"), F.col("loss_mask").alias("mask"))
    d = d.withColumn("_loss", F.filter(pairs, lambda p: p["mask"]["length"] > 0))
    loss = F.transform("_loss", lambda p: unescape(p["seg"].substr(p["mask"]["offset"] + 1, p["mask"]["length"])))
    return d.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_texts"), "n_blocks")
