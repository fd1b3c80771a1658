"""The whole interview pipeline: inputs to messages to summary documents."""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from dialogweave.fixed_values import MAX_RETRIES
from dialogweave.operators.answers import latest_answers, patient_questions, questionnaire_answers
from dialogweave.operators.documents import (
    assemble_summary,
    first_valid_attempt,
    repair_queue,
    summary_shape,
)
from dialogweave.operators.flow import expand_transcript, flow_answers, question_progress
from dialogweave.operators.responses import BatchResponder, respond_to_table
from dialogweave.operators.ordered import PART_BYTES, PART_ROWS
from dialogweave.plans.prompts import combine_prompts, summary_prompts

#: How many partial documents one combining prompt holds.
FAN_IN = 8


def collect_attempts(
    spark: SparkSession,
    prompts: DataFrame,
    shape: dict,
    summarizer: BatchResponder,
    folder: str,
    max_retries: int = MAX_RETRIES,
) -> DataFrame:
    """Model outputs (conversation_id = request id, attempt, raw), asked in rounds.

    A first round asks every prompt, each further one only what has no valid output yet.
    The number of rounds is fixed by the retry limit; every round is a written table.
    """
    attempts = None
    for attempt in range(max_retries + 1):
        if attempt:
            queue = repair_queue(attempts, shape, max_retries=max_retries)
            prompts = queue.where(F.col("attempt") == attempt).select(
                F.col("conversation_id").alias("request_id"), "messages"
            )
        replies = respond_to_table(spark, prompts, summarizer, f"{folder}/round{attempt}")
        latest = replies.select(
            F.col("request_id").alias("conversation_id"),
            F.lit(attempt).alias("attempt"),
            F.col("content").alias("raw"),
        )
        attempts = latest if attempts is None else attempts.unionByName(latest)
    return attempts


def _outcome(
    spark: SparkSession, prompts: DataFrame, shape: dict, summarizer: BatchResponder, folder: str
) -> DataFrame:
    """Per prompt: whether an output was valid, and the document or the last error; a written table."""
    attempts = collect_attempts(spark, prompts, shape, summarizer, folder)
    found = first_valid_attempt(attempts, shape).withColumnRenamed("conversation_id", "request_id")
    asked = prompts.select("request_id", "conversation_id", "part")
    asked.join(found, "request_id").write.mode("overwrite").parquet(f"{folder}/outcome")
    return spark.read.parquet(f"{folder}/outcome")


def _failures(outcome: DataFrame) -> DataFrame:
    """Conversations of which some part has no valid output, with the last such part's error."""
    return (
        outcome.where("not ok").groupBy("conversation_id")
        .agg(F.max_by("last_error", "part").alias("last_error"))
    )


def combine_documents(
    spark: SparkSession,
    outcome: DataFrame,
    shape: dict,
    summarizer: BatchResponder,
    folder: str,
    fan_in: int = FAN_IN,
) -> tuple[DataFrame, DataFrame]:
    """One document per conversation from those of all its parts, and what failed.

    Consecutive documents are combined by the summarizer, ``fan_in`` at a time, in rounds
    until each conversation has one; the rounds grow with the logarithm of the parts. A
    conversation with a part or combination that never fits is a failure, so no document
    leaves out a part. Every round is a written table.
    """
    order = Window.partitionBy("conversation_id").orderBy("part")
    failed = _failures(outcome)
    found = outcome.join(failed, "conversation_id", "left_anti").select("conversation_id", "part", "document")
    number = 0
    while True:
        place = f"{folder}/combine{number}"
        in_order = F.array_sort(F.collect_list(F.struct("part", "document")))
        found.withColumn("group", F.floor((F.row_number().over(order) - 1) / fan_in)).groupBy(
            "conversation_id", F.col("group").alias("part")
        ).agg(F.transform(in_order, lambda e: e["document"]).alias("documents")).write.mode(
            "overwrite"
        ).parquet(f"{place}/groups")
        groups = spark.read.parquet(f"{place}/groups")
        single = groups.where(F.size("documents") == 1).select(
            "conversation_id", "part", F.get("documents", F.lit(0)).alias("document")
        )
        several = groups.where(F.size("documents") > 1)
        if several.isEmpty():
            return single.select("conversation_id", "document"), failed
        combined = _outcome(spark, combine_prompts(several, shape), shape, summarizer, place)
        failed = failed.unionByName(_failures(combined))
        found = (
            single.unionByName(combined.select("conversation_id", "part", "document"))
            .join(_failures(combined), "conversation_id", "left_anti")
        )
        number += 1


def run_interviews(
    spark: SparkSession,
    inputs: DataFrame,
    questions: DataFrame,
    replies: Optional[DataFrame],
    summarizer: BatchResponder,
    folder: str,
    shape: Optional[dict] = None,
    part_rows: int = PART_ROWS,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Inputs to summaries: expand, prompt, ask with retries, assemble.

    Only finished conversations are summarized. One for which no output is valid has a row
    with ``last_error`` and without summary.

    Messages and model outputs are written below ``folder`` before they are used again.
    A transcript beyond ``part_rows`` messages or ``part_bytes`` bytes is asked part by part
    and the documents of all parts are combined into the model's share of the summary. A
    document with numbers too large for their type counts as failed.
    """
    shape = shape or summary_shape()
    messages_path = f"{folder}/messages"
    expand_transcript(inputs, questions, replies).write.mode("overwrite").parquet(messages_path)
    messages = spark.read.parquet(messages_path)
    finished = messages.where("ends").select("conversation_id").distinct()
    asked = messages.join(finished, "conversation_id", "left_semi")
    prompts = summary_prompts(asked, shape, part_rows=part_rows, part_bytes=part_bytes)
    outcome = _outcome(spark, prompts, shape, summarizer, folder)
    documents, failed = combine_documents(spark, outcome, shape, summarizer, folder)
    answers = latest_answers(flow_answers(question_progress(inputs, questions)))
    assembled = assemble_summary(
        documents, questionnaire_answers(answers, questions), patient_questions(messages), shape
    )
    fits = F.size("unfit") == 0
    summaries = assembled.select(
        "conversation_id",
        "part",
        F.when(fits, F.col("summary")).alias("summary"),
        F.when(fits, F.col("extra")).alias("extra"),
        F.when(~fits, F.concat(F.lit("too large: "), F.array_join("unfit", ", "))).alias("last_error"),
    )
    failures = failed.select("conversation_id", F.lit(0).cast("bigint").alias("part"), "last_error")
    return summaries.unionByName(failures, allowMissingColumns=True)
