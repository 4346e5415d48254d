"""Chat formatting: conversations as one training text each, with a loss mask.

Rows (conversation, turn, role, text) are sorted inside their conversation by
turn, then role, then text.  Adjacent turns of one role are merged into a block:
they share a header, and each text still ends with the end-of-turn mark, so that
the turns can be read back.  Turn structs are collected by block and blocks by
conversation, and put together by array functions; there is no Python.

The offsets of every text come from running sums in the same sort order.  The
loss mask of a conversation is the list of spans, in code points and in UTF-8
bytes, that hold its trained role's texts: the texts alone, without marks.

Control strings inside texts and roles get a tilde after their first character,
and one that has tildes there already gets one more: ``<s>`` becomes ``<~s>``,
``<~s>`` becomes ``<~~s>``.  ``read`` takes one away again.  No control string
holds another's first character further on, so an escaped text holds none, and
none can begin in a text and end in a mark.  Besides the template's own marks the
control strings of other common templates are escaped, so that a text can't
steer a model that was trained with those.

One shuffle by conversation; the window, both groupings and the array functions
share it.  A conversation is one text, hence one row: its size is bounded by
what a string may hold (2 GB), and nothing else in it is.

Defined cases: null text and null role are empty; a null turn comes first; rows
without a conversation id are one conversation; repeated rows are turns of their
own; rows equal in turn are in order of role and text; empty and very long texts
are turns like others; an empty table gives an empty result; only the four
columns are read, so extra ones may have any name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ESCAPE = "~"
#: Control strings of other templates (fixed values).
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")


@dataclass(frozen=True)
class Template:
    """The marks of a chat template (fixed values of a common public one)."""

    begin: str = "<|begin_of_text|>"
    header: str = "<|start_header_id|>"
    header_end: str = "<|end_header_id|>"
    gap: str = "\n\n"
    turn_end: str = "<|eot_id|>"
    end: str = "<|end_of_text|>"
    foreign: tuple[str, ...] = FOREIGN
    trained: str = "assistant"

    def controls(self) -> dict[str, list[str]]:
        """What follows a control string's first character, by that character."""
        found: dict[str, list[str]] = {}
        for c in dict.fromkeys((self.begin, self.header, self.header_end, self.turn_end, self.end, *self.foreign)):
            found.setdefault(c[:1], []).append(c[1:])
        if any(first in tail or ESCAPE in first + tail or not tail for first in found for tails in found.values() for tail in tails):
            raise ValueError("a control string holds the first character of one, or a tilde")
        return found

    def pattern(self, before: str, after: str) -> str:
        """Regular expression for all control strings: before, first character, after, tail."""
        either = lambda tails: "|".join(re.escape(t) for t in tails)
        return "|".join(before.format(re.escape(first)) + after.format(either(tails)) for first, tails in self.controls().items())


def escape(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, template.pattern("(?<={})", "(?=~*+(?:{}))"), ESCAPE)


def unescape(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, template.pattern("(?<={})", "~(?=~*+(?:{}))"), "")


def format_conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, formatted and loss (spans: start, end, start_byte, end_byte) of every conversation."""
    t = template
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("plain"), escape(role, t).alias("head"), escape(text, t).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "plain")
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("opens", ~F.col("role").eqNullSafe(F.lag("role").over(order)))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    offsets = []
    for name, size in (("start", F.char_length), ("start_byte", F.octet_length)):
        length = lambda mark: len(mark) if size is F.char_length else len(mark.encode())  # noqa: B023, E731
        header = F.when(F.col("opens"), size("head") + length(t.header + t.header_end + t.gap)).otherwise(0).cast("long")
        whole = header + size("text") + length(t.turn_end)
        offsets.append((length(t.begin) + F.coalesce(F.sum(whole).over(before), F.lit(0)) + header).alias(name))
    rows = rows.select("conv_id", "place", "role", "head", "text", F.sum(F.col("opens").cast("long")).over(order).alias("block"), *offsets)
    blocks = rows.groupBy("conv_id", "block").agg(
        F.first("role").alias("role"), F.first("head").alias("head"), F.sort_array(F.collect_list(F.struct("place", "text", "start", "start_byte"))).alias("turns")
    )
    whole = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "role", "head", "turns"))).alias("blocks"))

    def written(block: Column) -> Column:
        texts = F.transform(block["turns"], lambda x: F.concat(x["text"], F.lit(t.turn_end)))
        return F.concat(F.lit(t.header), block["head"], F.lit(t.header_end + t.gap), F.array_join(texts, ""))

    def span(x: Column) -> Column:
        return F.struct(
            x["start"].alias("start"),
            (x["start"] + F.char_length(x["text"])).alias("end"),
            x["start_byte"].alias("start_byte"),
            (x["start_byte"] + F.octet_length(x["text"])).alias("end_byte"),
        )

    trained = F.filter("blocks", lambda b: b["role"] == t.trained)
    return whole.select(
        "conv_id",
        F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + F.size(b["turns"])).alias("n_turns"),
        F.concat(F.lit(t.begin), F.array_join(F.transform("blocks", written), ""), F.lit(t.end)).alias("formatted"),
        F.flatten(F.transform(trained, lambda b: F.transform(b["turns"], span))).alias("loss"),
    )


def read(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, turns (role, text) and loss_text, from the texts and masks alone; a text that isn't of the template has null turns."""
    t = template
    edge, mark = len(t.begin) + len(t.end), t.header_end + t.gap
    body = F.substr("formatted", F.lit(len(t.begin) + 1), F.char_length("formatted") - edge)
    whole = F.col("formatted").startswith(t.begin) & F.col("formatted").endswith(t.end) & (F.char_length("formatted") >= edge)
    blocks = F.split(body, re.escape(t.header))

    def turns(block: Column) -> Column:
        head = F.substring_index(block, mark, 1)
        texts = F.split(F.substr(block, F.char_length(head) + len(mark) + 1), re.escape(t.turn_end))
        texts = F.slice(texts, F.lit(1), F.size(texts) - 1)  # what follows the last end of turn is empty
        # the role is read once a block, as the only element of an array
        with_role = lambda r: F.transform(texts, lambda x: F.struct(r.alias("role"), unescape(x, t).alias("text")))
        return F.transform(F.array(unescape(head, t)), with_role)[0]

    def masked(data: Column) -> Column:
        piece = lambda s: F.substring(data, (s["start_byte"] + 1).cast("int"), (s["end_byte"] - s["start_byte"]).cast("int")).cast("string")
        return F.array_join(F.transform("loss", lambda s: unescape(piece(s), t)), "")

    return formatted.select(
        "conv_id",
        F.when(whole, F.flatten(F.transform(F.slice(blocks, F.lit(2), F.size(blocks)), turns))).alias("turns"),
        # the bytes are made once, as the only element of an array
        F.transform(F.array(F.col("formatted").cast("binary")), masked)[0].alias("loss_text"),
        "formatted",
    )
