"""Chat formatting in Spark expressions: collected turn structs become one string with a loss mask, and back.

A conversation's turns are sorted inside an array, adjacent turns of one role are merged into a struct of the role and the
array of their texts, and the merged turns are concatenated. The template marks blocks with ``<|im_start|>role`` and ``<|im_end|>`` and the joints inside a merged
block with ``<|im_sep|>``. Control strings in texts are escaped: ``<``, any number of backslashes and ``|`` take one
backslash more, so no text holds ``<|`` and unescaping takes one away. Roles also escape line ends.

Cases: null text is empty; a null role is the empty role; rows with one turn number are ordered by role, then text;
null turns come first; a null conv_id is a conversation of its own; an empty table gives no row. One conversation is one
string, so its size is bounded by what a row may hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    # a pair of backslashes stands for one; it is parked as a control string, which no escaped text can hold
    parked = F.replace(role, F.lit("\\\\"), F.lit(SEP))
    return unescape(F.replace(F.replace(parked, F.lit("\\n"), F.lit("\n")), F.lit(SEP), F.lit("\\")))


def format_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, and loss_runs (code points to skip, then to learn, in order)."""
    turns = rows.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def merged(start: Column, i: Column) -> Column:
        stop = F.coalesce(F.try_element_at("starts", i + 2), F.size("turns") + 1)
        run = F.slice("turns", start, stop - start)
        return F.struct(run[0]["role"].alias("role"), F.transform(run, lambda t: t["text"]).alias("texts"))

    places = F.sequence(F.lit(1), F.size("turns"))
    begins = F.filter(places, lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]))
    blocks = grouped.select("conv_id", "turns", begins.alias("starts")).select("conv_id", F.transform("starts", merged).alias("blocks"))

    def pieces_of(block: Column, i: Column) -> Column:
        head = F.concat(F.when(i > 0, F.lit(END + "\n")).otherwise(F.lit("")), F.lit(START), _escape_role(block["role"]), F.lit("\n"))
        return F.transform(block["texts"], lambda text, k: F.struct(F.when(k > 0, F.lit(SEP)).otherwise(head).alias("head"), escape(text).alias("body"), (block["role"] == loss_role).alias("learn")))

    pieces = blocks.select("conv_id", F.flatten(F.transform("blocks", pieces_of)).alias("p"))
    body = F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"])), "")
    runs = F.transform("p", lambda x: F.struct(F.when(x["learn"], F.length(x["head"])).otherwise(F.length(x["head"]) + F.length(x["body"])).alias("skip"), F.when(x["learn"], F.length(x["body"])).otherwise(0).alias("learn")))
    return pieces.select("conv_id", F.concat(body, F.lit(END + "\n")).alias("formatted"), runs.alias("loss_runs"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted string holds, in order: the inverse of the template."""
    blocks = F.slice(F.split(formatted, r"<\|im_start\|>"), F.lit(2), F.greatest(F.size(F.split(formatted, r"<\|im_start\|>")) - 1, F.lit(0)))

    def turns(block: Column) -> Column:
        at = F.instr(block, "\n")
        role = _unescape_role(F.substring(block, F.lit(1), at - 1))
        inner = F.substring(block, at + 1, F.length(block) - at - len(END) - 1)
        return F.transform(F.split(inner, r"<\|im_sep\|>"), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_mask(formatted: Column, loss_runs: Column) -> Column:
    """The text under the loss mask: the spans to learn, cut from the string by code points, unescaped each and joined."""

    def step(done: Column, run: Column) -> Column:
        span = F.substring(formatted, done["at"] + run["skip"], run["learn"])
        return F.struct((done["at"] + run["skip"] + run["learn"]).alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.aggregate(loss_runs, start, step, lambda done: F.array_join(F.transform(done["spans"], unescape), ""))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds to formatted conversations what reading them back gives: turns, and the text under the loss mask in order."""
    parsed = formatted.withColumn("turns", read_turns(F.col("formatted")))
    return parsed.withColumn("loss_text", read_mask(F.col("formatted"), F.col("loss_runs")))
