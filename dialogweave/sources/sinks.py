"""Tables and documents written by the engine."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dialogweave.operators.sessions import finished_snapshots
from dialogweave.sources.keyed import write_keyed


def append_messages(messages: DataFrame, path: str) -> None:
    messages.write.mode("append").parquet(path)


def log_lines(events: DataFrame, iso: bool = True) -> DataFrame:
    """Session events as log lines (one JSON object each), keys without value left out."""
    seconds = F.unix_timestamp("ts")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx") if iso else seconds
    context = F.struct(F.col("ctx_question_id").alias("questionId"), F.col("ctx_phase").alias("phase"))
    has_context = F.col("ctx_question_id").isNotNull() | F.col("ctx_phase").isNotNull()

    def line(text: Column) -> Column:
        return F.to_json(
            F.struct(
                "seq",
                stamp.alias("ts"),
                "type",
                F.col("session_id").cast("string").alias("sessionId"),
                F.col("question_id").alias("questionId"),
                text.alias("text"),
                "command",
                F.when(has_context, context).alias("context"),
                "reason",
                F.try_parse_json("meta").alias("meta"),
            )
        )

    chat = F.struct(F.col("chat_role").alias("role"), F.col("chat_content").alias("content"))
    return events.select(
        "session_id",
        "seq",
        F.when(F.col("type") == "chat", line(chat)).otherwise(line(F.col("text"))).alias("value"),
    )


def append_session_log(events: DataFrame, path: str, iso: bool = True) -> None:
    """Appends events as JSON lines, each session's lines of one file in ``seq`` order.

    Rows are ranged by (session, seq) before sorting, so also one huge session is spread
    over several files; every file holds a contiguous run of events.
    """
    ranged = events.repartitionByRange("session_id", "seq").sortWithinPartitions(
        "session_id", "seq"
    )
    log_lines(ranged, iso).select("value").write.mode("append").text(path)


def snapshot_documents(snapshots: DataFrame) -> DataFrame:
    """Snapshot documents of finished sessions; aborted and open sessions have none.

    The responder is only named in sessions whose start event names it.
    """
    model = F.get_json_object("meta", "$.ollamaModel")
    url = F.get_json_object("meta", "$.ollamaUrl")
    return finished_snapshots(snapshots).select(
        F.col("session_id").alias("sessionId"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias("createdAt"),
        "questions",
        "answers",
        F.when(
            model.isNotNull() | url.isNotNull(), F.struct(model.alias("model"), url.alias("url"))
        ).alias("ollama"),
        F.col("source").alias("transcriptJsonl"),
    )


def write_session_snapshot(snapshots: DataFrame, path: str) -> bool:
    """One document per finished session, keyed by session (see ``keyed.write_keyed``): a re-run
    changes nothing, and a session that is not among the snapshots keeps its document."""
    return write_keyed(snapshot_documents(snapshots), path, ["sessionId"])


def write_summaries(summaries: DataFrame, path: str) -> bool:
    """Summary documents keyed by conversation, and part where there are parts. A new document
    replaces the conversation's old one, others stay."""
    keys = [c for c in ("conversation_id", "part") if c in summaries.columns]
    return write_keyed(summaries, path, keys)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A parquet table, or no rows where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
