"""Answers per question, answers so far, and question/answer pairs of side chats."""

from __future__ import annotations

from typing import Optional

from pyspark.sql import Column, DataFrame, functions as F

from dialogweave.fixed_values import NONE_ANSWERED_TEXT
from dialogweave.functions.jsontext import bind
from dialogweave.functions.scalars import is_chat_turn
from dialogweave.model import ANSWER, ASSISTANT, CHAT, PATIENT
from dialogweave.operators.ordered import BLOCK_BITS, Blocks, with_earlier, with_next
from dialogweave.sources.flows import flow_columns, one_flow


def latest_answers(answers: DataFrame) -> DataFrame:
    """Last answer per conversation and question id, by ``seq``; combined map-side."""
    return answers.groupBy("conversation_id", *flow_columns(answers), "question_id").agg(
        F.max_by("text", "seq").alias("answer"), F.max("seq").alias("seq")
    )


def questionnaire_answers(latest: DataFrame, questions: DataFrame) -> DataFrame:
    """Flow order; unanswered questions are dropped and empty answers kept. Each conversation
    goes by the flow and version it is bound to, if the answers say so."""
    bound = flow_columns(latest, questions)
    flow = one_flow(questions, latest).select(
        *bound, F.col("id").alias("question_id"), F.col("pos"), F.col("text").alias("question")
    )
    return (
        latest.where(F.col("answer").isNotNull())
        .join(flow, [*bound, "question_id"])
        .select("conversation_id", "pos", "question_id", "question", "answer")
    )


def questionnaire_documents(answers: DataFrame) -> DataFrame:
    """One array of answered questions per conversation, at most the flow's length."""
    entry = F.struct("pos", "question_id", "question", "answer")
    return answers.groupBy("conversation_id").agg(
        F.transform(
            F.array_sort(F.collect_list(entry)),
            lambda e: F.struct(e["question_id"], e["question"], e["answer"]),
        ).alias("questionnaire_answers")
    )


def answered_so_far(
    progress: DataFrame,
    questions: DataFrame,
    none_text: str = NONE_ANSWERED_TEXT,
    bits: int = BLOCK_BITS,
    blocks: Optional[Blocks] = None,
) -> DataFrame:
    """Per chat turn: one ``- question -> answer`` line per question answered before it.

    The flow stores at most one answer per position, so the answers carried along a
    conversation are bounded by the flow. An id that occurs at several positions answers
    all of them.
    """
    bound = flow_columns(progress, questions)
    flow = one_flow(questions, progress)
    places = flow.groupBy(*bound, F.col("id").alias("active_question_id")).agg(
        F.collect_list(F.struct(F.col("pos").alias("p"), F.col("text").alias("q"))).alias("_places")
    )
    answered = F.when(
        F.col("mode") == ANSWER,
        F.transform(
            "_places", lambda x: F.struct(x["p"], F.col("seq").alias("s"), x["q"], F.col("text").alias("a"))
        ),
    )
    asked = progress.join(places, [*bound, "active_question_id"], "left")
    rows = with_earlier(asked, answered, _latest_by_position, bits=bits, blocks=blocks).where(
        F.col("mode") == CHAT
    )
    lines = F.array_join(
        F.transform("_earlier", lambda e: F.concat(F.lit("- "), e["q"], F.lit(" -> "), e["a"])), "\n"
    )
    return (
        rows.withColumn("answered", F.coalesce(F.nullif(lines, F.lit("")), F.lit(none_text)))
        .select(*progress.columns, "answered")
    )


def _latest_by_position(entries: Column) -> Column:
    """Of entries with position ``p`` and place ``s``, the last of each position, in flow order."""
    return bind(
        F.array_sort(entries),
        lambda e: F.filter(e, lambda x, i: F.coalesce(F.get(e, i + 1)["p"] != x["p"], F.lit(True))),
    )


def patient_questions(
    messages: DataFrame, bits: int = BLOCK_BITS, blocks: Optional[Blocks] = None
) -> DataFrame:
    """Pairs each chat question with the chat answer right behind it.

    A question followed by another one is dropped, a trailing one keeps an empty answer,
    and answers without a question are ignored.
    """
    chats = messages.where(is_chat_turn(F.col("role"), F.col("mode"))).select(
        "conversation_id", "seq", "role", "content"
    )
    following = F.col("_next.role")
    return (
        with_next(chats, ["role", "content"], bits=bits, blocks=blocks)
        .where((F.col("role") == PATIENT) & (following.isNull() | (following == ASSISTANT)))
        .select(
            "conversation_id",
            "seq",
            F.col("content").alias("question"),
            F.when(following.isNull(), "").otherwise(F.col("_next.content")).alias("answer"),
        )
    )
