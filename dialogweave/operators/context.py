"""Bounded context windows and transcript texts."""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame, Window, functions as F

from dialogweave.fixed_values import CONTEXT_TURNS, FRAME_MESSAGES
from dialogweave.functions.scalars import is_chat_turn, py_strip, render_line, to_chat_role
from dialogweave.model import MODES, PATIENT, ROLES
from dialogweave.operators.ordered import (
    BLOCK_BITS,
    Blocks,
    last_of,
    PART_BYTES,
    PART_ROWS,
    list_parts,
    text_parts,
    with_last_rows,
)


def take_turn(messages: DataFrame, k: int, key: str = "conversation_id") -> DataFrame:
    """Last ``k`` messages per conversation.

    The rank filter is pushed below the shuffle as a group limit, so every map task sends
    at most ``k`` rows per conversation.
    """
    newest_first = Window.partitionBy(key).orderBy(F.col("seq").desc())
    return (
        messages.withColumn("_rank", F.row_number().over(newest_first))
        .where(F.col("_rank") <= k)
        .drop("_rank")
    )


def chat_context(
    messages: DataFrame,
    frame: int = FRAME_MESSAGES,
    turns: int = CONTEXT_TURNS,
    bits: int = BLOCK_BITS,
    keep: tuple[str, ...] = (),
    blocks: Optional[Blocks] = None,
) -> DataFrame:
    """Per patient chat turn: the earlier chat turns a responder gets to see.

    Of the last ``frame`` messages, chat turns are kept except patient texts equal to the
    current one (after stripping), and of those the last ``turns``. Columns named in
    ``keep`` are passed through.
    """
    framed = with_last_rows(
        messages.select("conversation_id", "seq", "role", "content", "mode", *keep),
        frame,
        bits=bits,
        blocks=blocks,
    )
    asked = framed.where(is_chat_turn(F.col("role"), F.col("mode")) & (F.col("role") == PATIENT))
    text = py_strip(F.col("content"))
    kept = F.filter(
        "_frame",
        lambda m: is_chat_turn(m["role"], m["mode"])
        & ~((m["role"] == PATIENT) & (py_strip(m["content"]) == F.col("_text"))),
    )
    return asked.withColumn("_text", text).select(
        "conversation_id",
        "seq",
        *keep,
        F.col("content").alias("user_text"),
        F.transform(
            last_of(kept, turns),
            lambda m: F.struct(to_chat_role(m["role"]).alias("role"), m["content"].alias("content")),
        ).alias("context"),
    )


def transcript_text(
    messages: DataFrame,
    bits: int = BLOCK_BITS,
    part_rows: int = PART_ROWS,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """All messages, rendered as lines and joined in order; see ``text_parts`` for ``part``."""
    line = render_line(F.col("role"), F.col("content"))
    return text_parts(
        messages, line, "\n", bits=bits, name="transcript", part_rows=part_rows, part_bytes=part_bytes
    )


def collect_history(messages: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Patient and assistant messages as an ordered chat history; see ``list_parts``."""
    history = messages.select(
        "conversation_id", "seq", to_chat_role(F.col("role")).alias("role"), "content"
    ).where(F.col("role").isNotNull())
    return list_parts(history, ["role", "content"], bits=bits, name="history")


def chat_turns(messages: DataFrame) -> DataFrame:
    return messages.where(is_chat_turn(F.col("role"), F.col("mode")))


def invalid_messages(messages: DataFrame) -> DataFrame:
    """Messages whose role or mode lies outside its domain; a missing mode is legal."""
    known = F.coalesce(F.col("role").isin(*ROLES), F.lit(False)) & F.coalesce(
        F.col("mode").isin(*MODES), F.col("mode").isNull()
    )
    return messages.where(~known)


def read_transcript(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """All messages of the wanted conversations; order by (conversation_id, seq) on output."""
    return messages.join(ids.select("conversation_id").distinct(), "conversation_id", "left_semi")
