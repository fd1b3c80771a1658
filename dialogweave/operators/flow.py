"""Question flow: progress through the flow and the messages it produces."""

from __future__ import annotations

from typing import Optional

from pyspark.sql import Column, DataFrame, functions as F

from dialogweave.fixed_values import COMPLETION_TEXT, NO_RESPONDER_TEXT
from dialogweave.functions.scalars import input_mode, input_text
from dialogweave.model import (
    ANSWER,
    ASSISTANT,
    CHAT,
    DONE,
    FLOW_WAITING_ANSWER,
    PATIENT,
    QUIT,
    SYSTEM,
)
from dialogweave.operators.ordered import BLOCK_BITS, Blocks, running_sums
from dialogweave.sources.flows import flow_columns, one_flow

MESSAGE = (
    "struct<role:string,content:string,mode:string,question_id:string,channel:string,reask:boolean>"
)


def classify_inputs(inputs: DataFrame) -> DataFrame:
    """(conversation_id, seq, mode, text) of raw console inputs, with the flow they are bound to."""
    return inputs.select(
        "conversation_id",
        "seq",
        *flow_columns(inputs),
        input_mode(F.col("raw_text")).alias("mode"),
        input_text(F.col("raw_text")).alias("text"),
    )


def question_at_index(
    df: DataFrame, questions: DataFrame, index: Column, prefix: str = "question"
) -> DataFrame:
    """Question by position; an index outside the flow gives NULL.

    Rows bound to a flow (see ``sources.flows.bind_flows``) get the questions of theirs; rows
    without flow get those of the only one, and several fail the query. The flows join
    without a hint: Spark broadcasts them below its size threshold and shuffles both sides
    above it.
    """
    bound = flow_columns(df, questions)
    flow = one_flow(questions, df).select(
        *[F.col(c).alias(f"_{c}") for c in bound],
        F.col("pos").cast("bigint").alias("_pos"),
        F.col("id").alias(f"{prefix}_id"),
        F.col("text").alias(f"{prefix}_text"),
    )
    same = F.col("_index") == F.col("_pos")
    for c in bound:
        same = same & (F.col(c) == F.col(f"_{c}"))
    return (
        df.withColumn("_index", index.cast("bigint"))
        .join(flow, same, "left")
        .drop("_index", "_pos", *[f"_{c}" for c in bound])
    )


def _positioned(
    inputs: DataFrame, questions: DataFrame, bits: int, blocks: Optional[Blocks] = None
) -> DataFrame:
    """Classified inputs with counts of what came before and the current question.

    ``alive`` tells whether the loop still runs when the input arrives. Without quit it
    runs while the flow has a current question; an empty flow handles one input.
    """
    classified = classify_inputs(inputs)
    counted = running_sums(
        classified,
        {
            "answers_before": (F.col("mode") == ANSWER).cast("bigint"),
            "chats_before": (F.col("mode") == CHAT).cast("bigint"),
            "quits_before": (F.col("mode") == QUIT).cast("bigint"),
        },
        bits=bits,
        blocks=blocks,
    )
    first = (F.col("answers_before") == 0) & (F.col("chats_before") == 0)
    return (
        question_at_index(counted, questions, F.col("answers_before"), "active_question")
        .withColumn(
            "alive",
            (F.col("quits_before") == 0) & (F.col("active_question_id").isNotNull() | first),
        )
        .withColumn("is_first", first & (F.col("quits_before") == 0))
    )


def question_progress(
    inputs: DataFrame,
    questions: DataFrame,
    bits: int = BLOCK_BITS,
    blocks: Optional[Blocks] = None,
) -> DataFrame:
    """Question index, active question and state before each input the loop handles."""
    return _positioned(inputs, questions, bits, blocks).where("alive").select(
        "conversation_id",
        "seq",
        *flow_columns(inputs),
        "mode",
        "text",
        F.col("answers_before").alias("question_index"),
        "active_question_id",
        "active_question_text",
        F.when(F.col("active_question_id").isNull(), DONE)
        .otherwise(FLOW_WAITING_ANSWER)
        .alias("state"),
    )


def flow_answers(progress: DataFrame) -> DataFrame:
    """Answers as the flow stores them, under the question active at that moment."""
    return progress.where(
        (F.col("mode") == ANSWER) & F.col("active_question_id").isNotNull()
    ).select(
        "conversation_id",
        "seq",
        *flow_columns(progress),
        F.col("question_index").alias("pos"),
        F.col("active_question_id").alias("question_id"),
        "text",
    )


def _message(
    role: str,
    content: Column,
    mode: Optional[str] = None,
    question_id: Optional[Column] = None,
    channel: Optional[str] = None,
    reask: Optional[bool] = None,
) -> Column:
    null = F.lit(None)
    return F.struct(
        F.lit(role).alias("role"),
        content.alias("content"),
        (null if mode is None else F.lit(mode)).alias("mode"),
        (null if question_id is None else question_id).alias("question_id"),
        (null if channel is None else F.lit(channel)).alias("channel"),
        (null if reask is None else F.lit(reask)).alias("reask"),
    ).cast(MESSAGE)


def expand_transcript(
    inputs: DataFrame,
    questions: DataFrame,
    replies: Optional[DataFrame] = None,
    completion_text: str = COMPLETION_TEXT,
    notice_text: str = NO_RESPONDER_TEXT,
    bits: int = BLOCK_BITS,
    blocks: Optional[Blocks] = None,
) -> DataFrame:
    """The full message stream of every conversation found in ``inputs``.

    ``replies(conversation_id, seq, content)`` holds the responder's answers by input
    ``seq``; ``None`` means no responder is configured. Every handled answer yields two
    rows and every chat three, so the new ``seq`` follows from the running counts and
    needs no second numbering pass. ``input_seq`` names the causing input, and ``ends`` is
    true on the row with which the flow ends, whatever its text.
    """
    rows = _positioned(inputs, questions, bits, blocks).where("alive")
    rows = question_at_index(rows, questions, F.col("answers_before") + 1, "next_question")
    over = F.col("active_question_id").isNull() | (
        (F.col("mode") == ANSWER) & F.col("next_question_id").isNull()
    )

    completion = _message(SYSTEM, F.lit(completion_text))
    current_id, current_text = F.col("active_question_id"), F.col("active_question_text")
    next_id, next_text = F.col("next_question_id"), F.col("next_question_text")

    def ask(question_id: Column, text: Column) -> Column:
        shown = _message(SYSTEM, text, question_id=question_id, channel="questionnaire")
        return F.when(question_id.isNull(), completion).otherwise(shown)

    patient_answer = _message(PATIENT, F.col("text"), ANSWER)
    patient_chat = _message(PATIENT, F.col("text"), CHAT)
    if replies is None:
        notice = _message(ASSISTANT, F.lit(notice_text))
        chat_rows = F.array(patient_chat, notice, ask(current_id, current_text))
    else:
        rows = rows.join(
            replies.select("conversation_id", "seq", F.col("content").alias("reply")),
            ["conversation_id", "seq"],
            "left",
        )
        reply = _message(ASSISTANT, F.col("reply"), CHAT)
        again = _message(SYSTEM, current_text, question_id=current_id, reask=True)
        # Without a current question the chat fails after the patient row is stored.
        chat_rows = F.when(current_id.isNull(), F.array(patient_chat)).otherwise(
            F.array(patient_chat, reply, again)
        )

    produced = (
        F.when(F.col("mode") == ANSWER, F.array(patient_answer, ask(next_id, next_text)))
        .when(F.col("mode") == CHAT, chat_rows)
        .otherwise(F.array().cast(f"array<{MESSAGE}>"))
    )
    start = ask(current_id, current_text)
    with_start = F.when(F.col("is_first"), F.concat(F.array(start), produced)).otherwise(produced)
    offset = F.when(F.col("is_first"), 0).otherwise(
        1 + 2 * F.col("answers_before") + 3 * F.col("chats_before")
    )
    return rows.select(
        "conversation_id",
        F.col("seq").alias("input_seq"),
        offset.cast("bigint").alias("_offset"),
        over.alias("_over"),
        F.posexplode(with_start).alias("_i", "m"),
    ).select(
        "conversation_id",
        (F.col("_offset") + F.col("_i")).alias("seq"),
        "m.*",
        "input_seq",
        (F.col("_over") & (F.col("m.role") == SYSTEM) & F.col("m.question_id").isNull()).alias("ends"),
    )


def rejected_inputs(
    inputs: DataFrame, questions: DataFrame, responder: bool = True, bits: int = BLOCK_BITS
) -> DataFrame:
    """Inputs that produce no transcript rows, or fail, with the reason."""
    no_question = (F.col("mode") == CHAT) & F.col("active_question_id").isNull() & F.lit(responder)
    reason = (
        F.when(F.col("quits_before") > 0, "after_quit")
        .when(no_question, "no_active_question")
        .when(~F.col("alive"), "after_completion")
    )
    return (
        _positioned(inputs, questions, bits)
        .select("conversation_id", "seq", "mode", "text", reason.alias("reason"))
        .where(F.col("reason").isNotNull())
    )
