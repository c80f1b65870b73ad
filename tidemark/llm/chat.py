"""Chats as training texts: a compiled template renders them and marks what is learned."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.chat_template import TemplateError, compile_template, unescape, unescape_line

#: Turns between control strings; the texts of the assistant are what is learned.
CHAT_TEMPLATE = """\
{%- for message in messages -%}
{{ '<|im_start|>' ~ (message.role | escape_line) ~ '\\n' }}
{%- if message.role == 'assistant' -%}
{% generation %}{{ message.text | escape }}{% endgeneration %}
{%- else -%}
{{ message.text | escape }}
{%- endif -%}
{{ '<|im_end|>' ~ '\\n' }}
{%- endfor -%}
"""
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)

FORMATTED = "conv_id long, text string, spans array<struct<start: int, end: int>>"
READ = "conv_id long, turns array<struct<role: string, text: string>>, learned array<string>, chars long"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def format_chats(conversations: DataFrame, template: str = CHAT_TEMPLATE) -> DataFrame:
    """(conv_id, text, spans) of every conversation: its text by the template, and the spans (code points) to learn.

    ``messages`` of the template is the list of a conversation's rows (role, text) by
    turn, role and text, nulls first; a null role or text is empty. Repeated rows are
    turns of their own, rows without ``conv_id`` one conversation. A conversation is a
    row of the result, so it is in one task's memory, and no two are. An empty table
    gives no rows; other columns aren't looked at.
    """
    compile_template(template)  # an error in it is the caller's, not a task's

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = compile_template(template)
        for batch in batches:
            texts, marks = [], []
            for i in range(batch.num_rows):
                text, spans = run(messages=[{"role": r["role"] or "", "text": r["text"] or ""} for r in batch.column("rows")[i].as_py()])
                texts.append(text)
                marks.append([{"start": a, "end": b} for a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(texts, pa.string()), pa.array(marks, _SPANS)], ["conv_id", "text", "spans"])

    chats = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", "role", "text").alias("row")).groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return chats.mapInArrow(render, FORMATTED)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every, learned, chars = [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            text, turns, at = text.as_py(), [], 0
            while at < len(text):
                m = _TURN.match(text, at)
                if not m:
                    raise TemplateError("the text isn't of the chat template")
                turns.append({"role": unescape_line(m[1]), "text": unescape(m[2])})
                at = m.end()
            every.append(turns)
            learned.append([unescape(text[s["start"] : s["end"]]) for s in spans.as_py()])
            chars.append(len(text))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(every, _TURNS), pa.array(learned, pa.list_(pa.string())), pa.array(chars, pa.int64())], ["conv_id", "turns", "learned", "chars"])


def read_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, learned, chars): what ``CHAT_TEMPLATE`` made of conversations, read back from text and spans."""
    return formatted.select("conv_id", "text", "spans").mapInArrow(_read, READ)


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Counts and hashes of what is read back: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return read_chats(formatted).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.char_length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), F.col("chars").alias("formatted_chars")
    )
