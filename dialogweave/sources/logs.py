"""Session logs in JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from dialogweave.functions.scalars import normalize_ts, py_strip, split_event_text
from dialogweave.model import LOG_LINE_SCHEMA, SESSION_EVENT_COLUMNS


def parse_log_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Log lines to session events.

    ``seq`` is the producer's where the line has one, else the column ``seq`` of ``lines``.
    A line that is no JSON object keeps its text in ``corrupt``.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}
    e = lines.withColumn("e", F.from_json(line, LOG_LINE_SCHEMA, options))
    order = F.coalesce("e.seq", "seq") if "seq" in lines.columns else F.col("e.seq")
    source = ["source"] if "source" in lines.columns else []
    return e.select(
        order.alias("seq"), *event_columns(lambda name: F.col(f"e.{name}")), *source
    ).select(*SESSION_EVENT_COLUMNS, "corrupt", *source)


def event_columns(field) -> list[Column]:
    """Event columns from the fields of a log line."""
    plain, role, content = split_event_text(field("type"), field("text"))
    return [
        field("sessionId").alias("session_id"),
        normalize_ts(field("ts")).alias("ts"),
        field("type").alias("type"),
        field("questionId").alias("question_id"),
        plain.alias("text"),
        role.alias("chat_role"),
        content.alias("chat_content"),
        field("command").alias("command"),
        field("context.questionId").alias("ctx_question_id"),
        field("context.phase").alias("ctx_phase"),
        field("reason").alias("reason"),
        field("meta").alias("meta"),
        field("corrupt").alias("corrupt"),
    ]


def read_session_log(spark: SparkSession, path: str) -> DataFrame:
    """Session events of a directory of logs, in the line order of each file.

    Files are read by splits, so a large log is never one row or one task. A line's ``seq`` is
    its number in the file, from 0, blank lines included: its number in the split plus the
    lines of the splits before, which a first pass counts. So it has no gaps and is the same
    however the file is split. Lines with a ``seq`` of their own keep it, so that a session
    may be spread over files.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_read"),
    )
    in_split = Window.partitionBy("_file", "_start").orderBy("_read")
    earlier = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    counts = lines.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_lines"))
    before = counts.select("_file", "_start", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_before"))
    numbered = (
        lines.withColumn("_in_split", F.row_number().over(in_split))
        .join(before, ["_file", "_start"])
        .withColumn("seq", (F.col("_before") + F.col("_in_split") - 1).cast("bigint"))
        .where(py_strip(F.col("value")) != "")
    )
    return parse_log_lines(numbered.select("seq", "value", F.col("_file").alias("source")))
