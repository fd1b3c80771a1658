"""Prompt tables: one row per request with its list of (role, content) entries.

Wording is a parameter everywhere; the defaults are only examples.
"""

from __future__ import annotations

import json
from typing import Optional, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dialogweave.fixed_values import CONTEXT_TURNS, FRAME_MESSAGES, SLOT_BANK, TOPIC_RULES, Slot, TopicRule
from dialogweave.functions.scalars import to_chat_role
from dialogweave.model import ASSISTANT, CHAT_ENTRY, PATIENT
from dialogweave.operators.answers import answered_so_far
from dialogweave.operators.context import chat_context, collect_history, transcript_text
from dialogweave.operators.flow import question_progress
from dialogweave.operators.ordered import BLOCK_BITS, PART_BYTES, PART_ROWS, blocks_of, list_parts, running_last
from dialogweave.operators.slots import slots_before
from dialogweave.operators.topics import keyword_hits, topic_turns

WORDING = {
    "chat_system": "Answer the patient's side question briefly and calmly.",
    "chat_current": "Open question ({id}): {text}",
    "chat_answered": "Answered until now:",
    "summary_system": "Summarize the interview as one JSON document.",
    "summary_shape": "Use exactly this shape:",
    "summary_user": "Interview:",
    "combine_system": "These documents summarize consecutive parts of one interview. Combine them into one, losing nothing.",
    "combine_user": "Documents:",
    "slot_system": "Return one JSON object with these keys, null where unknown:",
    "slot_known": "Known:",
    "slot_answer": "New answer:",
    "note_system": "Write a short pre-operative note.",
    "note_user": "Facts:",
    "topic_closing": "All topics are covered. Close the talk and ask for open questions.",
    "topic_current": "Talk about:",
    "topic_answers": "Known so far:",
}


def _words(wording: Optional[dict[str, str]]) -> dict[str, str]:
    return {**WORDING, **(wording or {})}


def _entry(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _filled(template: str, **columns: Column) -> Column:
    """A text template with its ``{name}`` marks replaced by columns."""
    text = F.lit(template)
    for name, column in columns.items():
        text = F.replace(text, F.lit("{" + name + "}"), column)
    return text


def chat_prompts(
    messages: DataFrame,
    inputs: Optional[DataFrame] = None,
    questions: Optional[DataFrame] = None,
    wording: Optional[dict[str, str]] = None,
    frame: int = FRAME_MESSAGES,
    turns: int = CONTEXT_TURNS,
    bits: int = BLOCK_BITS,
) -> DataFrame:
    """Per patient chat turn: system text, situation in the flow, earlier turns, user text.

    The situation (current question and answers so far) needs the ``inputs`` and
    ``questions`` that ``messages`` were expanded from; a recorded transcript without them
    has no such entry.
    """
    words = _words(wording)
    system = F.array(_entry("system", F.lit(words["chat_system"])))
    user = F.array(_entry("user", F.col("user_text")))
    request = F.concat_ws(":", "conversation_id", "seq").alias("request_id")
    if inputs is None:
        asked = chat_context(messages, frame, turns, bits)
        prompt = F.concat(system, "context", user)
        return asked.select(
            request, "conversation_id", "seq", prompt.cast(CHAT_ENTRY).alias("messages")
        )
    asked = chat_context(messages, frame, turns, bits, keep=("input_seq",))
    blocks = blocks_of(inputs, bits=bits)
    situation = answered_so_far(
        question_progress(inputs, questions, blocks=blocks), questions, blocks=blocks
    ).select(
        "conversation_id",
        F.col("seq").alias("input_seq"),
        "active_question_id",
        "active_question_text",
        "answered",
    )
    current = F.concat_ws(
        "\n",
        _filled(
            words["chat_current"],
            id=F.col("active_question_id"),
            text=F.col("active_question_text"),
        ),
        F.lit(words["chat_answered"]),
        "answered",
    )
    known = F.when(
        F.col("active_question_id").isNotNull(), F.array(_entry("system", current))
    ).otherwise(F.array().cast(CHAT_ENTRY))
    return asked.join(situation, ["conversation_id", "input_seq"], "left").select(
        request,
        "conversation_id",
        "seq",
        F.concat(system, known, "context", user).cast(CHAT_ENTRY).alias("messages"),
    )


def summary_prompts(
    messages: DataFrame,
    shape: Optional[dict] = None,
    wording: Optional[dict[str, str]] = None,
    bits: int = BLOCK_BITS,
    part_rows: int = PART_ROWS,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """System text (with the shape, when given) and the transcript; see ``text_parts``."""
    words = _words(wording)
    system = _with_shape(words["summary_system"], words, shape)
    user = F.concat_ws("\n", F.lit(words["summary_user"]), "transcript")
    return transcript_text(messages, bits, part_rows, part_bytes).select(
        F.concat_ws(":", "conversation_id", "part").alias("request_id"),
        "conversation_id",
        "part",
        F.array(_entry("system", F.lit(system)), _entry("user", user)).cast(CHAT_ENTRY).alias("messages"),
    )


def combine_prompts(
    groups: DataFrame, shape: Optional[dict] = None, wording: Optional[dict[str, str]] = None
) -> DataFrame:
    """Per group (conversation_id, part, documents): system text and the documents in order."""
    words = _words(wording)
    system = _with_shape(words["combine_system"], words, shape)
    user = F.concat_ws("\n", F.lit(words["combine_user"]), F.array_join("documents", "\n"))
    return groups.select(
        F.concat_ws(":", "conversation_id", "part").alias("request_id"),
        "conversation_id",
        "part",
        F.array(_entry("system", F.lit(system)), _entry("user", user)).cast(CHAT_ENTRY).alias("messages"),
    )


def _with_shape(system: str, words: dict[str, str], shape: Optional[dict]) -> str:
    if shape is None:
        return system
    return "\n".join([system, words["summary_shape"], json.dumps(shape, ensure_ascii=False)])


def _as_json(slots: Column) -> Column:
    return F.to_json(slots, {"ignoreNullFields": "false"})


def slot_prompts(
    updates: DataFrame,
    texts: DataFrame,
    slots: Sequence[Slot] = SLOT_BANK,
    wording: Optional[dict[str, str]] = None,
    truthy: Optional[Column] = None,
    bits: int = BLOCK_BITS,
) -> DataFrame:
    """Per new text: system with the slot names; user with the text and the slots known from
    the updates before it."""
    words = _words(wording)
    names = ", ".join(s.slot for s in slots)
    user = F.concat_ws(
        "\n",
        F.lit(words["slot_known"]),
        _as_json(F.col("slots")),
        F.lit(words["slot_answer"]),
        "text",
    )
    return slots_before(updates, texts, slots, truthy, bits).select(
        F.concat_ws(":", "conversation_id", "seq").alias("request_id"),
        "conversation_id",
        "seq",
        F.array(
            _entry("system", F.lit(f"{words['slot_system']} {names}")), _entry("user", user)
        ).cast(CHAT_ENTRY).alias("messages"),
    )


def note_prompts(states: DataFrame, wording: Optional[dict[str, str]] = None) -> DataFrame:
    """System text and the slots as JSON."""
    words = _words(wording)
    user = F.concat_ws("\n", F.lit(words["note_user"]), _as_json(F.col("slots")))
    return states.select(
        F.col("conversation_id").cast("string").alias("request_id"),
        "conversation_id",
        F.array(_entry("system", F.lit(words["note_system"])), _entry("user", user))
        .cast(CHAT_ENTRY)
        .alias("messages"),
    )


def topic_prompts(
    messages: DataFrame,
    progress: DataFrame,
    answers: DataFrame,
    wording: Optional[dict[str, str]] = None,
    bits: int = BLOCK_BITS,
) -> DataFrame:
    """Closing text, or the next topic's label with the answers so far; then the history.

    ``messages`` is the whole exchange, ``progress`` and ``answers`` come from the patient
    side. A history of several blocks gives one prompt per part, each with the system text.
    """
    words = _words(wording)
    known = answers.groupBy("conversation_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("topic", "answer")))).alias("known")
    )
    open_text = F.concat_ws(
        "\n",
        F.concat_ws(" ", F.lit(words["topic_current"]), "next_label"),
        F.concat_ws(" ", F.lit(words["topic_answers"]), F.coalesce(_as_json(F.col("known")), F.lit("{}"))),
    )
    system = F.when(F.col("next_topic").isNull(), words["topic_closing"]).otherwise(open_text)
    situation = progress.join(known, "conversation_id", "left").select(
        "conversation_id", "next_topic", system.alias("system")
    )
    return collect_history(messages, bits).join(situation, "conversation_id").select(
        F.concat_ws(":", "conversation_id", "part").alias("request_id"),
        "conversation_id",
        "part",
        "next_topic",
        F.concat(F.array(_entry("system", F.col("system"))), "history").cast(CHAT_ENTRY).alias("messages"),
    )


def topic_turn_prompts(
    messages: DataFrame,
    rules: Sequence[TopicRule] = TOPIC_RULES,
    wording: Optional[dict[str, str]] = None,
    bits: int = BLOCK_BITS,
) -> DataFrame:
    """One prompt per patient message: the situation behind it, and a reference to the history.

    (request_id, conversation_id, seq, topic_before, next_topic, system, first_seq, last_seq): the
    system text names the topic open after the message and the answers kept until then, that of
    the message included; the history is all patient and assistant messages from ``first_seq``
    to ``last_seq``, which ``with_history`` fetches for the turns that are asked. So the table is
    as long as the messages, not as the sum of all histories.
    """
    words = _words(wording)
    patient = messages.where(F.col("role") == PATIENT).select("conversation_id", "seq", "content")
    blocks = blocks_of(patient, bits=bits)
    turns = topic_turns(patient, rules, bits)
    hits = keyword_hits(F.col("content"), rules)
    stored = F.coalesce(
        *[
            F.when((F.col("topic_before") == r.topic) & (F.getbit(F.col("hits"), F.lit(i)) == 1), F.struct(
                F.lit(i).alias("i"), F.coalesce(F.lit(r.answer).cast("string"), F.col("content")).alias("a")))
            for i, r in enumerate(rules)
        ]
    )
    rows = patient.withColumn("hits", hits).join(turns, ["conversation_id", "seq"]).withColumn("kept", stored)
    kept = {f"_k{i}": F.when(F.col("kept.i") == i, F.col("kept.a")) for i in range(len(rules))}
    known = running_last(rows.drop("hits"), kept, blocks=blocks)
    now = [F.coalesce(F.when(F.col("kept.i") == i, F.col("kept.a")), F.col(f"_k{i}")) for i in range(len(rules))]
    pairs = F.array_sort(F.array_compact(F.array(*[
        F.when(a.isNotNull(), F.struct(F.lit(r.topic).alias("t"), a.alias("a"))) for r, a in zip(rules, now)
    ])))
    topic = F.col("topic_after")
    labels = F.create_map(*[F.lit(x) for r in rules for x in (r.topic, r.label)])
    open_text = F.concat_ws(
        "\n",
        F.concat_ws(" ", F.lit(words["topic_current"]), F.try_element_at(labels, topic)),
        F.concat_ws(" ", F.lit(words["topic_answers"]), F.to_json(F.map_from_entries(pairs))),
    )
    begun = messages.where(F.col("role").isin(PATIENT, ASSISTANT)).groupBy("conversation_id").agg(F.min("seq").alias("first_seq"))
    return known.join(begun, "conversation_id").select(
        F.concat_ws(":", "conversation_id", "seq").alias("request_id"),
        "conversation_id",
        "seq",
        "topic_before",
        topic.alias("next_topic"),
        F.when(topic.isNull(), words["topic_closing"]).otherwise(open_text).alias("system"),
        "first_seq",
        F.col("seq").alias("last_seq"),
    )


def with_history(
    turns: DataFrame, messages: DataFrame, bits: int = BLOCK_BITS, part_rows: int = PART_ROWS, part_bytes: int = PART_BYTES
) -> DataFrame:
    """The prompts of the given turns (see ``topic_turn_prompts``) with their histories.

    Histories are shared parts; a turn gets those up to its ``last_seq``, one row per part, the
    last one cut there. Every part has the system text.
    """
    parts = list_parts_of_history(messages, bits, part_rows, part_bytes)
    joined = turns.join(parts, "conversation_id").where(F.col("_from") <= F.col("last_seq"))
    seen = F.filter("history", lambda m: (m["seq"] >= F.col("first_seq")) & (m["seq"] <= F.col("last_seq")))
    entries = F.transform(seen, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return joined.select(
        "request_id", "conversation_id", "seq", "part", "next_topic",
        F.concat(F.array(_entry("system", F.col("system"))), entries).cast(CHAT_ENTRY).alias("messages"),
    )


def list_parts_of_history(messages: DataFrame, bits: int, part_rows: int, part_bytes: int) -> DataFrame:
    """(conversation_id, part, history, _from): the chat history with its ``seq``, in parts."""
    history = messages.select("conversation_id", "seq", to_chat_role(F.col("role")).alias("role"), "content").where("role is not null")
    placed = history.select("conversation_id", "seq", F.col("seq").alias("s"), "role", "content")
    parts = list_parts(
        placed.select("conversation_id", "seq", F.struct(F.col("s").alias("seq"), "role", "content").alias("m")),
        ["m"], bits=bits, name="history", part_rows=part_rows, part_bytes=part_bytes,
    )
    flat = F.transform("history", lambda e: e["m"])
    return parts.select("conversation_id", "part", flat.alias("history"), F.get(flat, F.lit(0))["seq"].alias("_from"))
