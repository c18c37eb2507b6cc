"""Chat formatting by relational expressions only.

The turn structs of a conversation are collected and sorted, adjacent turns of
one role become one block by slicing the sorted array, and blocks are
concatenated.  Template::

    <s>[ROLE]role[/ROLE]text[PART]text</s><s>[ROLE]...

``[PART]`` separates turns that share a block, so that reading back gives every
turn.  A control string in a text gets one backslash behind its bracket; one
that has backslashes there already gets one more, which makes the escape
reversible for every text.

Defined cases: null text or role counts as empty; null turns sort first; rows
with equal turn sort by role, then text; repeated rows are turns like others;
a null conv_id is one conversation of its own; a text of any length is formatted
whole, a conversation being one row that must fit Spark's 2 GB for a value; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template, without their first bracket.
CONTROL = r"(/?(?:s>|ROLE\]|PART\]|INST\]))"
OPEN, ROLE_END, PART, END = "<s>[ROLE]", "[/ROLE]", "[PART]", "</s>"


def escape(text: Column) -> Column:
    """``text`` without any control string of the template; :func:`unescape` undoes it."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """The text that :func:`escape` was given."""
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, r"$1$2$3")


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted string, loss_spans array<struct<start,chars>> (code points of ``formatted``, from 0).

    ``turns`` has conv_id, turn, role and text.  The loss mask covers the texts
    of ``loss_role``, without role marks, separators and block ends.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    starts = sorted_turns.withColumn(
        "at",
        F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i)["role"] != F.get("t", i - 1)["role"])),
    )
    blocks = starts.select(
        "conv_id",
        F.transform(
            "at",
            lambda a, k: F.struct(
                F.get("t", a)["role"].alias("role"),
                F.transform(F.slice("t", a + 1, F.coalesce(F.get("at", k + 1), F.size("t")) - a), lambda t: escape(t["text"])).alias("parts"),
            ),
        ).alias("b"),
    )
    return blocks.select(
        "conv_id",
        F.array_join(
            F.transform("b", lambda b: F.concat(F.lit(OPEN), escape(b["role"]), F.lit(ROLE_END), F.array_join(b["parts"], PART), F.lit(END))), ""
        ).alias("formatted"),
        _loss_spans(F.col("b"), loss_role).alias("loss_spans"),
    )


def _loss_spans(blocks: Column, loss_role: str) -> Column:
    """Spans of the loss role's parts, found by adding up lengths along the blocks."""
    spans_type = "array<struct<start:int,chars:int>>"

    def part_step(acc: Column, part: Column) -> Column:
        return F.struct(
            (acc["pos"] + F.length(part) + len(PART)).alias("pos"),
            F.concat(acc["spans"], F.array(F.struct(acc["pos"].alias("start"), F.length(part).alias("chars")))).alias("spans"),
        )

    def block_step(acc: Column, b: Column) -> Column:
        head = acc["pos"] + len(OPEN) + F.length(escape(b["role"])) + len(ROLE_END)
        body = F.aggregate(b["parts"], F.lit(0), lambda n, p: n + F.length(p)) + len(PART) * (F.size(b["parts"]) - 1)
        marked = F.aggregate(b["parts"], F.struct(head.alias("pos"), acc["spans"].alias("spans")), part_step)["spans"]
        return F.struct((head + body + len(END)).alias("pos"), F.when(b["role"] == loss_role, marked).otherwise(acc["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("pos"), F.array().cast(spans_type).alias("spans"))
    return F.aggregate(blocks, start, block_step)["spans"]


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans, turns array<struct<role,text>> and loss array<string>, parsed from the output alone."""
    block = lambda b: F.split(b, r"\[/ROLE\]", 2)
    blocks = F.split("formatted", END, -1)
    parsed = F.flatten(
        F.transform(
            F.slice(blocks, 1, F.size(blocks) - 1),
            lambda b: F.transform(
                F.split(block(b)[1], r"\[PART\]", -1),
                lambda p: F.struct(unescape(F.substr(block(b)[0], F.lit(len(OPEN) + 1))).alias("role"), unescape(p).alias("text")),
            ),
        )
    )
    loss = F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["chars"])))
    return formatted.select("*", parsed.alias("turns"), loss.alias("loss"))


def digests(read: DataFrame) -> DataFrame:
    """The digest columns of what was read back."""
    loss = F.array_join("loss", "")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
