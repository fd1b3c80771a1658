"""Table schemas and value domains shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

SYSTEM, PATIENT, ASSISTANT = "system", "patient", "assistant"
ROLES = (SYSTEM, PATIENT, ASSISTANT)

ANSWER, CHAT = "answer", "chat"
QUIT = "quit"

MODES = (ANSWER, CHAT)

# Conversation states seen by an input; asking and chatting only last while one is handled.
FLOW_WAITING_ANSWER = "flow_waiting_answer"
DONE = "done"

FINISHED, ABORTED, OPEN = "finished", "aborted", "open"

QUESTION_SCHEMA = T.StructType(
    [
        T.StructField("flow_id", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("required", T.BooleanType()),
        T.StructField("help_prompt", T.StringType()),
        T.StructField("choices", T.ArrayType(T.StringType())),
        T.StructField("validation", T.StringType()),
    ]
)

INPUT_SCHEMA = "conversation_id string, seq bigint, raw_text string"

MESSAGE_SCHEMA = (
    "conversation_id string, seq bigint, role string, content string, ts bigint, "
    "mode string, question_id string, channel string, reask boolean"
)

# One JSON object per log line; `ts` and `text` are polymorphic and stay raw text here.
# `seq` is written by producers that land events in many files.
LOG_LINE_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("sessionId", T.StringType()),
        T.StructField("questionId", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("command", T.StringType()),
        T.StructField(
            "context",
            T.StructType(
                [
                    T.StructField("questionId", T.StringType()),
                    T.StructField("phase", T.StringType()),
                ]
            ),
        ),
        T.StructField("reason", T.StringType()),
        T.StructField("meta", T.StringType()),
        T.StructField("corrupt", T.StringType()),
    ]
)

SESSION_EVENT_COLUMNS = [
    "session_id",
    "seq",
    "ts",
    "type",
    "question_id",
    "text",
    "chat_role",
    "chat_content",
    "command",
    "ctx_question_id",
    "ctx_phase",
    "reason",
    "meta",
]

CHAT_ENTRY = "array<struct<role:string,content:string>>"
