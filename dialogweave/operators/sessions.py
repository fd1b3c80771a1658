"""Session logs: replaying snapshots and status."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dialogweave.model import ABORTED, FINISHED, OPEN
from dialogweave.operators.ordered import BLOCK_BITS, running_sums

TERMINAL = ("session_finished", "session_aborted")


def live_events(events: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Events up to and including the first terminal one of their session."""
    return (
        running_sums(
            events,
            {"_ended": F.col("type").isin(*TERMINAL).cast("bigint")},
            key="session_id",
            bits=bits,
        )
        .where(F.col("_ended") == 0)
        .drop("_ended")
    )


def session_questions(events: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Per session and question: text and order when first shown, and the last answer.

    Rows without a question id carry the session's own facts. Everything is one
    map-side combined aggregate over (session, question).
    """
    shown = F.col("type") == "standard_question_shown"
    given = F.col("type") == "standard_answer_given"
    terminal = F.col("type").isin(*TERMINAL)
    source = F.col("source") if "source" in events.columns else F.lit(None).cast("string")
    return (
        live_events(events, bits)
        .groupBy("session_id", "question_id")
        .agg(
            F.min(F.when(shown, F.col("seq"))).alias("shown_at"),
            F.min_by(F.when(shown, F.col("text")), F.when(shown, F.col("seq"))).alias("question"),
            F.max(F.when(given, F.col("seq"))).alias("answered_at"),
            F.max_by(F.when(given, F.col("text")), F.when(given, F.col("seq"))).alias("answer"),
            F.max(F.when(terminal, F.struct("type", "reason", "ts"))).alias("ending"),
            F.max(F.when(F.col("type") == "session_started", F.col("meta"))).alias("meta"),
            F.min(source).alias("source"),
        )
    )


def replay_session(events: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """One snapshot per session: status, questions in shown order, answers by question id.

    Skipped questions have no answer; a log without terminal event is ``open``. ``meta`` is
    what the session was started with and ``source`` the log it was read from, if known.
    """
    known = F.col("question_id").isNotNull()
    ending = F.max("ending")
    return (
        session_questions(events, bits)
        .groupBy("session_id")
        .agg(
            ending.alias("_end"),
            F.max("meta").alias("meta"),
            F.min("source").alias("source"),
            F.array_sort(
                F.collect_list(
                    F.when(
                        known & F.col("shown_at").isNotNull(),
                        F.struct("shown_at", F.col("question_id").alias("id"), F.col("question").alias("text")),
                    )
                )
            ).alias("_shown"),
            F.map_from_entries(
                F.array_sort(
                    F.collect_list(
                        F.when(
                            known & F.col("answered_at").isNotNull(),
                            F.struct("question_id", "answer"),
                        )
                    )
                )
            ).alias("answers"),
        )
        .select(
            "session_id",
            F.when(F.col("_end.type") == "session_finished", FINISHED)
            .when(F.col("_end.type") == "session_aborted", ABORTED)
            .otherwise(OPEN)
            .alias("status"),
            F.col("_end.reason").alias("reason"),
            F.when(F.col("_end.type") == "session_finished", F.col("_end.ts")).alias("created_at"),
            F.transform("_shown", lambda q: F.struct(q["id"], q["text"])).alias("questions"),
            "answers",
            "meta",
            "source",
        )
    )


def finished_snapshots(snapshots: DataFrame) -> DataFrame:
    """The sessions a snapshot document is written for."""
    return snapshots.where(F.col("status") == FINISHED)
