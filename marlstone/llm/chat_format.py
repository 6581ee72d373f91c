"""Chat formatting by prefix-target expansion, with DataFrame functions alone.

A turn is written ``<|im_start|>role<|im_sep|>text<|im_end|>\\n``.  Inside roles and texts each
backslash is doubled, then ``<|`` becomes ``<\\|``; so no control string occurs there, and
:func:`unescape` gives every text back.  Each assistant turn becomes an example: all turns up to
it, and a loss mask (start and length in code points) on its text alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def prefix_targets(turns: DataFrame) -> DataFrame:
    """(conv_id, example, n_turns, formatted, loss_start, loss_chars), an example for each assistant
    turn of ``turns`` (conv_id, turn, role, text); loss_start is a 0-based code point.

    Defined cases: turns are taken by turn, then role, then text (repeated rows stay, nulls come
    first); a null role or text is empty; rows of a null conv_id are one conversation.  A conversation
    that doesn't end on an assistant turn gets one more example, with all its turns and no loss, so
    that what is written has every turn.  A conversation's turns meet in one row, as its examples
    need: the prefixes are built one example at a time.
    """
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    conv = turns.select("conv_id", F.struct("turn", clean("role").alias("role"), clean("text").alias("text")).alias("t"))
    conv = conv.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    pieces = F.transform("turns", lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(SEP), escape(t["text"]), F.lit(END)))
    conv = conv.select("conv_id", F.transform("turns", lambda t: t["role"] == "assistant").alias("mine"), pieces.alias("pieces"), F.transform("turns", lambda t: F.length(escape(t["text"]))).alias("sizes"))
    wanted = F.filter(F.sequence(F.lit(1), F.size("mine")), lambda i: F.element_at("mine", i) | (i == F.size("mine")))
    each = conv.select("conv_id", "pieces", "mine", "sizes", F.posexplode(wanted).alias("example", "last"))
    size = F.when(F.element_at("mine", F.col("last")), F.element_at("sizes", F.col("last"))).otherwise(0)
    each = each.select("conv_id", "example", F.col("last").alias("n_turns"), F.array_join(F.slice("pieces", F.lit(1), F.col("last")), "").alias("formatted"), size.cast("bigint").alias("loss_chars"))
    return each.select("conv_id", "example", "n_turns", "formatted", (F.length("formatted") - len(END) - F.col("loss_chars")).alias("loss_start"), "loss_chars")


def parse(formatted: Column) -> Column:
    """array<struct<role,text>> of a formatted example."""
    turns = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda x: x != "")

    def one(x: Column) -> Column:
        halves = F.split(F.substring(x, len(START) + 1, 2_000_000_000), r"<\|im_sep\|>")
        return F.struct(unescape(halves[0]).alias("role"), unescape(halves[1]).alias("text"))

    return F.transform(turns, one)


def digests(examples: DataFrame) -> DataFrame:
    """What the examples hold, read back from them: a row for each conversation."""
    reply = unescape(F.substring(F.col("formatted"), F.col("loss_start").cast("int") + 1, F.col("loss_chars").cast("int")))
    each = examples.select("conv_id", "example", "n_turns", "formatted", reply.alias("reply"), F.length("formatted").alias("chars"))
    grouped = each.groupBy("conv_id").agg(
        F.max(F.struct("example", "formatted")).alias("whole"), F.sort_array(F.collect_list(F.struct("example", "reply"))).alias("replies"),
        F.sum("chars").cast("bigint").alias("formatted_chars"), F.count("*").alias("n_examples"),
    )
    loss = F.array_join(F.transform("replies", lambda r: r["reply"]), "")
    grouped = grouped.select("conv_id", parse(F.col("whole.formatted")).alias("turns"), loss.alias("loss"), "formatted_chars", "n_examples")
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return grouped.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples",
    )
