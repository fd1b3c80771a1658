"""Scalar Column functions over raw inputs, messages, chunks and log events."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from dialogweave.fixed_values import CHAT_MARK, QUIT_WORDS, WHITE_SPACE
from dialogweave.model import ANSWER, ASSISTANT, CHAT, PATIENT, QUIT


def py_strip(text: Column) -> Column:
    """Strip Unicode white space at both ends (``trim`` alone only removes blanks)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def input_mode(raw: Column) -> Column:
    """``quit``, ``chat`` or ``answer``; the quit words are tested first."""
    text = py_strip(raw)
    return (
        F.when(F.lower(text).isin(*QUIT_WORDS), QUIT)
        .when(text.startswith(CHAT_MARK), CHAT)
        .otherwise(ANSWER)
    )


def input_text(raw: Column) -> Column:
    """The text behind a chat mark, stripped again; otherwise the stripped input."""
    text = py_strip(raw)
    return F.when(
        text.startswith(CHAT_MARK), py_strip(F.substring(text, 2, 2**31 - 1))
    ).otherwise(text)


# Where a recorder reads: at a question, inside a chat, or at the final prompt; and the
# words that each recorder dialect understands there.
_COMMANDS = {
    ("plain", "question"): {"/chat": "chat", "/quit": "quit"},
    ("plain", "chat"): {"exit": "leave_chat", "quit": "leave_chat", "/quit": "leave_chat"},
    ("skipping", "question"): {"/chat": "chat", "/quit": "quit", "/next": "next"},
    ("skipping", "chat"): {"": "leave_chat", "/quit": "quit"},
    ("skipping", "final"): {"/chat": "chat"},
}


def classify_command(raw: Column, dialect: str = "skipping", place: str = "question") -> Column:
    """Name of the command an input stands for, or NULL when it is ordinary text.

    Dialect ``plain`` has no ``/next`` (it is stored as an answer) and leaves a chat by
    word; dialect ``skipping`` knows ``/next`` and leaves a chat by an empty line.
    """
    words = _COMMANDS[(dialect, place)]
    text = F.lower(py_strip(raw))
    command = F.lit(None).cast("string")
    for name in sorted(set(words.values())):
        spellings = [word for word, meaning in words.items() if meaning == name]
        command = F.when(text.isin(*spellings), name).otherwise(command)
    return command


def normalize_ts(ts: Column) -> Column:
    """Epoch seconds or ISO-8601 text to TIMESTAMP; NULL when it is neither."""
    return F.coalesce(F.timestamp_seconds(ts.try_cast("bigint")), ts.try_cast("timestamp"))


def render_line(role: Column, content: Column) -> Column:
    return F.concat(F.upper(role), F.lit(": "), content)


def to_chat_role(role: Column) -> Column:
    return F.when(role == PATIENT, "user").when(role == ASSISTANT, "assistant")


def is_chat_turn(role: Column, mode: Column) -> Column:
    """Chat-mode rows of patient or assistant; a missing mode is never a chat."""
    return mode.eqNullSafe(F.lit(CHAT)) & role.isin(PATIENT, ASSISTANT)


def match_keywords(text: Column, keywords: tuple[str, ...] | list[str]) -> Column:
    """Any keyword occurs in the lower-cased text, also inside longer words."""
    low = F.lower(text)
    found = F.lit(False)
    for word in keywords:
        found = found | low.contains(word)
    return found


def chunk_token(message_content: Column, response: Column) -> Column:
    return F.coalesce(F.nullif(message_content, F.lit("")), response, F.lit(""))


def tokens_per_second(eval_count: Column, eval_duration: Column) -> Column:
    """Tokens per second from a duration in nanoseconds; NULL for a zero duration."""
    seconds = eval_duration.cast("double") / F.lit(1e9)
    return F.try_divide(eval_count.cast("double"), seconds)


def split_event_text(event_type: Column, text: Column) -> tuple[Column, Column, Column]:
    """(plain text, chat role, chat content): only ``chat`` events hold an object."""
    chat = F.when(event_type == "chat", F.from_json(text, "role string, content string"))
    plain = F.when(event_type.eqNullSafe(F.lit("chat")), F.lit(None)).otherwise(text)
    return plain, chat["role"], chat["content"]
