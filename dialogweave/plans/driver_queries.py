"""One query per operator over the test tables, with flat scalar result columns."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from dialogweave.fixed_values import ALL_FILLED_TEXT, DIALOG_SLOTS, SLOT_BANK
from dialogweave.functions import jsontext, scalars
from dialogweave.operators import answers, context, documents, flow, items, responses, sessions, slots, topics
from dialogweave.plans import driver_views as v, prompts
from dialogweave.session import shared_folder
from dialogweave.sources import flows, keyed, logs, sinks
from dialogweave.streaming import dialogue as dialogue_module
from dialogweave.streaming import interview as stream_interview_module
from dialogweave.streaming import sessions as stream_sessions_module
from dialogweave.streaming import slots as stream_slots_module

Query = Callable[[SparkSession, str], DataFrame]
MESSAGE_COLUMNS = [
    "conversation_id", "seq", "role", "content", "mode", "question_id", "channel", "reask",
]


def _chat_text(entries: Column) -> Column:
    """A list of chat entries as one text."""
    return F.array_join(
        F.transform(entries, lambda m: F.concat(m["role"], F.lit("|"), m["content"])), "\n"
    )


# --- scalar functions -----------------------------------------------------------------


def classify_input(spark: SparkSession, sf: str) -> DataFrame:
    return flow.classify_inputs(v.inputs(spark, sf))


def classify_command(spark: SparkSession, sf: str) -> DataFrame:
    raw = v.inputs(spark, sf).withColumn(
        "raw_text",
        F.when(F.col("seq") % 7 == 0, " /CHAT ")
        .when(F.col("seq") % 7 == 1, "/next")
        .when(F.col("seq") % 7 == 2, "/Quit\t")
        .otherwise(F.col("raw_text")),
    )
    text = F.col("raw_text")
    return raw.select(
        "conversation_id",
        "seq",
        scalars.classify_command(text, "plain", "question").alias("plain_question"),
        scalars.classify_command(text, "plain", "chat").alias("plain_chat"),
        scalars.classify_command(text, "skipping", "question").alias("skipping_question"),
        scalars.classify_command(text, "skipping", "chat").alias("skipping_chat"),
        scalars.classify_command(text, "skipping", "final").alias("skipping_final"),
    )


def py_strip(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    padded = F.concat(F.lit(" \t "), F.col("text"), F.lit("\n\x1f "))
    return docs.select("doc_id", F.md5(scalars.py_strip(padded)).alias("stripped"))


def normalize_ts(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.read.parquet(f"{sf}/events.parquet")
    written = F.when(
        F.col("event_id") % 2 == 0, F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string")
    ).otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))
    return events.select(
        "event_id", F.unix_micros(scalars.normalize_ts(written)).alias("micros")
    )


def render_line(spark: SparkSession, sf: str) -> DataFrame:
    return v.messages(spark, sf).select(
        "conversation_id", "seq", scalars.render_line(F.col("role"), F.col("content")).alias("line")
    )


def to_chat_role(spark: SparkSession, sf: str) -> DataFrame:
    return v.messages(spark, sf).select(
        "conversation_id", "seq", scalars.to_chat_role(F.col("role")).alias("chat_role")
    )


def is_chat_turn(spark: SparkSession, sf: str) -> DataFrame:
    return context.chat_turns(v.messages(spark, sf))


def extract_json_block(spark: SparkSession, sf: str) -> DataFrame:
    return v.attempts(spark, sf).select(
        "conversation_id", "attempt", jsontext.extract_json_block(F.col("raw")).alias("block")
    )


def parse_json_strict(spark: SparkSession, sf: str) -> DataFrame:
    raw = v.raw_slot_updates(spark, sf)
    parsed = jsontext.parse_json_strict(F.col("raw"))
    return raw.select(
        "conversation_id",
        "seq",
        parsed.isNotNull().alias("is_json"),
        jsontext.kind_of(parsed).alias("kind"),
    )


def project_known_slots(spark: SparkSession, sf: str) -> DataFrame:
    return slots.project_known_slots(v.raw_slot_updates(spark, sf)).select(
        "conversation_id", "seq", "slot", "value", "error"
    )


def is_truthy(spark: SparkSession, sf: str) -> DataFrame:
    return (
        slots.project_known_slots(v.raw_slot_updates(spark, sf))
        .where("error is null")
        .select("conversation_id", "seq", "slot", "truthy")
    )


def match_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return topics.match_topics(v.messages(spark, sf), v.RULES)


def chunk_token(spark: SparkSession, sf: str) -> DataFrame:
    return v.chunks(spark, sf).select(
        "response_id",
        "chunk_idx",
        scalars.chunk_token(F.col("message_content"), F.col("response")).alias("token"),
    )


def tokens_per_second(spark: SparkSession, sf: str) -> DataFrame:
    return responses.generation_speed(v.chunks(spark, sf))


def split_event_text(spark: SparkSession, sf: str) -> DataFrame:
    events = v.session_events(spark, sf).select(
        "session_id",
        "seq",
        F.when(F.col("text").isNotNull() & (F.col("seq") % 2 == 0), "chat")
        .otherwise(F.col("type"))
        .alias("type"),
        "text",
    )
    events = events.withColumn(
        "text",
        F.when(
            F.col("type") == "chat",
            F.concat(F.lit('{"role": "user", "content": "t'), "text", F.lit('"}')),
        ).otherwise(F.col("text")),
    )
    plain, role, content = scalars.split_event_text(F.col("type"), F.col("text"))
    return events.select(
        "session_id", "seq", plain.alias("text"), role.alias("chat_role"), content.alias("chat_content")
    )


# --- flow -----------------------------------------------------------------------------


def question_progress(spark: SparkSession, sf: str) -> DataFrame:
    return flow.question_progress(v.inputs(spark, sf), v.questions(spark, sf))


def question_at_index(spark: SparkSession, sf: str) -> DataFrame:
    classified = flow.classify_inputs(v.inputs(spark, sf))
    return flow.question_at_index(classified, v.questions(spark, sf), F.col("seq") % 7).select(
        "conversation_id", "seq", "question_id", "question_text"
    )


def expand_transcript(spark: SparkSession, sf: str) -> DataFrame:
    return flow.expand_transcript(
        v.inputs(spark, sf), v.questions(spark, sf), v.replies(spark, sf)
    ).select(*MESSAGE_COLUMNS)


def expand_transcript_without_responder(spark: SparkSession, sf: str) -> DataFrame:
    return flow.expand_transcript(v.inputs(spark, sf), v.questions(spark, sf)).select(*MESSAGE_COLUMNS)


def rejected_inputs(spark: SparkSession, sf: str) -> DataFrame:
    return flow.rejected_inputs(v.inputs(spark, sf), v.questions(spark, sf))


# --- answers and pairs ----------------------------------------------------------------


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    return flow.flow_answers(question_progress(spark, sf))


def latest_answers(spark: SparkSession, sf: str) -> DataFrame:
    given = v.session_events(spark, sf).where("type = 'standard_answer_given'")
    return answers.latest_answers(given.withColumnRenamed("session_id", "conversation_id"))


def questionnaire_answers(spark: SparkSession, sf: str) -> DataFrame:
    latest = answers.latest_answers(_answers(spark, sf))
    return answers.questionnaire_answers(latest, v.questions(spark, sf))


def answered_so_far(spark: SparkSession, sf: str) -> DataFrame:
    return answers.answered_so_far(question_progress(spark, sf), v.questions(spark, sf)).select(
        "conversation_id", "seq", "answered"
    )


def patient_questions(spark: SparkSession, sf: str) -> DataFrame:
    return answers.patient_questions(v.messages(spark, sf))


def patient_questions_long(spark: SparkSession, sf: str) -> DataFrame:
    return answers.patient_questions(v.long_messages(spark, sf))


# --- context --------------------------------------------------------------------------


def _context(asked: DataFrame) -> DataFrame:
    return asked.select(
        "conversation_id", "seq", "user_text", _chat_text(F.col("context")).alias("context")
    )


def chat_context(spark: SparkSession, sf: str) -> DataFrame:
    return _context(context.chat_context(v.long_messages(spark, sf)))


def chat_context_short(spark: SparkSession, sf: str) -> DataFrame:
    return _context(context.chat_context(v.messages(spark, sf), frame=5, turns=2))


def take_turn(spark: SparkSession, sf: str) -> DataFrame:
    return context.take_turn(v.long_messages(spark, sf), 30)


def transcript_text(spark: SparkSession, sf: str) -> DataFrame:
    return context.transcript_text(v.messages(spark, sf))


def collect_history(spark: SparkSession, sf: str) -> DataFrame:
    return context.collect_history(v.messages(spark, sf)).select(
        "conversation_id", "part", _chat_text(F.col("history")).alias("history")
    )


def read_transcript(spark: SparkSession, sf: str) -> DataFrame:
    messages = v.messages(spark, sf)
    return context.read_transcript(messages, messages.where("mode = 'answer'"))


# --- slots ----------------------------------------------------------------------------


def merge_slots(spark: SparkSession, sf: str) -> DataFrame:
    return slots.merge_slots(v.slot_updates(spark, sf))


def slot_completeness(spark: SparkSession, sf: str) -> DataFrame:
    return slots.slot_completeness(v.slot_updates(spark, sf)).select(
        "conversation_id",
        "next_slot",
        "next_text",
        F.array_join("missing_required", ",").alias("missing"),
        "complete",
    )


def missing_required(spark: SparkSession, sf: str) -> DataFrame:
    return slots.missing_required(v.slot_updates(spark, sf)).select("conversation_id", "slot")


def next_unfilled(spark: SparkSession, sf: str) -> DataFrame:
    updates = v.slot_updates(spark, sf)
    items = [s.slot for s in SLOT_BANK]
    filled = updates.withColumn("slot", F.when(F.col("value") != "", F.col("slot")))
    return slots.next_unfilled(filled, items, done_text=ALL_FILLED_TEXT)


def next_dialog_slot(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(s) for s in DIALOG_SLOTS])
    filled = v.slot_updates(spark, sf).select(
        "conversation_id", F.get(names, (F.col("seq") % 11).cast("int")).alias("slot")
    )
    return slots.next_unfilled(filled, DIALOG_SLOTS, done_text=ALL_FILLED_TEXT)


def next_question(spark: SparkSession, sf: str) -> DataFrame:
    """First question of the flow without an answer, joined back to its text; conversations
    without any answer have the first."""
    questions = v.questions(spark, sf).withColumnRenamed("id", "question_id")
    latest = answers.latest_answers(_answers(spark, sf))
    begun = v.inputs(spark, sf).where("conversation_id is not null").select("conversation_id").distinct()
    filled = latest.select("conversation_id", "question_id").unionByName(begun, allowMissingColumns=True)
    first = items.item_progress(filled, questions, item="question_id")
    texts = questions.select(F.col("question_id").alias("next_question_id"), "text")
    return first.join(texts, "next_question_id", "left").select("next_question_id", "conversation_id", "done", "text")


def open_slots(spark: SparkSession, sf: str) -> DataFrame:
    """What is open against the slot bank as a table, per user's day."""
    return items.item_progress(v.slot_events(spark, sf), flows.slot_bank(spark))


def open_required_slots(spark: SparkSession, sf: str) -> DataFrame:
    return items.missing_items(v.slot_events(spark, sf), flows.slot_bank(spark))


def open_flow_questions(spark: SparkSession, sf: str) -> DataFrame:
    """What is open of the flow and version that each conversation is bound to."""
    bank = v.flow_questions(spark, sf).withColumnRenamed("id", "question_id")
    bound, progress = _bound(spark, sf)
    given = flow.flow_answers(progress).select("conversation_id", "flow_id", "version", "question_id")
    begun = bound.select("conversation_id", "flow_id", "version").distinct()
    filled = given.unionByName(begun, allowMissingColumns=True)
    return items.item_progress(filled, bank, item="question_id", bank=("flow_id", "version"))


def dialog_slots(spark: SparkSession, sf: str) -> DataFrame:
    """The first open one of the nine dialog slots, by the bank as a table."""
    bank = flows.dialog_slots(spark).withColumn("required", F.lit(True))
    filled = v.slot_updates(spark, sf).select(
        F.concat_ws("-", "conversation_id", F.col("seq") % 97).alias("conversation_id"), (F.col("seq") % 11).cast("int").alias("pos")
    )
    named = filled.join(bank.select("pos", "slot"), "pos", "left")
    return items.item_progress(named, bank)


def slot_bank(spark: SparkSession, sf: str) -> DataFrame:
    """Merged slots with the bank's question texts."""
    bank = flows.slot_bank(spark).select("slot", "text", "required")
    return slots.merge_slots(v.slot_updates(spark, sf)).join(bank, "slot").select(
        "conversation_id", "slot", "text", "required", "value"
    )


# --- topics ---------------------------------------------------------------------------


def topic_progress(spark: SparkSession, sf: str) -> DataFrame:
    return topics.topic_progress(v.messages(spark, sf), v.RULES).select(
        "conversation_id",
        "next_topic",
        "next_label",
        F.array_join("completed", ",").alias("completed"),
    )


def topic_answers(spark: SparkSession, sf: str) -> DataFrame:
    messages = v.messages(spark, sf)
    return topics.topic_answers(messages, topics.topic_progress(messages, v.RULES), v.RULES)


def topic_turns(spark: SparkSession, sf: str) -> DataFrame:
    return topics.topic_turns(v.messages(spark, sf), v.RULES)


def topic_bank(spark: SparkSession, sf: str) -> DataFrame:
    """Topic progress by the shipped rules, with the bank's labels."""
    progress = topics.topic_progress(v.shipped_messages(spark, sf))
    bank = flows.topic_bank(spark).select(F.col("topic").alias("next_topic"), "pos", "label")
    return progress.join(bank, "next_topic", "left").select(
        "conversation_id", "next_topic", "pos", "label", F.array_join("completed", ",").alias("completed")
    )


def shipped_topic_answers(spark: SparkSession, sf: str) -> DataFrame:
    messages = v.shipped_messages(spark, sf)
    return topics.topic_answers(messages, topics.topic_progress(messages))


def topic_turn_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """The prompt of every patient message, with the history up to it."""
    messages = v.messages(spark, sf)
    turns = prompts.topic_turn_prompts(messages, v.RULES)
    return _prompt_rows(prompts.with_history(turns, messages))


# --- several flows and versions -------------------------------------------------------


def _bound(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    bound = flows.bind_flows(v.flow_inputs(spark, sf), v.flow_versions(spark))
    return bound, flow.question_progress(bound, v.flow_questions(spark, sf))


def bind_flows(spark: SparkSession, sf: str) -> DataFrame:
    bound = flows.bind_flows(v.flow_inputs(spark, sf), v.flow_versions(spark))
    free = flows.unbound_conversations(v.flow_inputs(spark, sf), v.flow_versions(spark))
    return (
        bound.groupBy("conversation_id", "flow_id", "version").agg(F.count("*").alias("inputs"))
        .unionByName(free, allowMissingColumns=True)
    )


def versioned_progress(spark: SparkSession, sf: str) -> DataFrame:
    return _bound(spark, sf)[1].drop("state")


def versioned_transcript(spark: SparkSession, sf: str) -> DataFrame:
    bound, _ = _bound(spark, sf)
    return flow.expand_transcript(bound, v.flow_questions(spark, sf)).select(*MESSAGE_COLUMNS)


def versioned_answers(spark: SparkSession, sf: str) -> DataFrame:
    latest = answers.latest_answers(flow.flow_answers(_bound(spark, sf)[1]))
    return answers.questionnaire_answers(latest, v.flow_questions(spark, sf))


def versioned_so_far(spark: SparkSession, sf: str) -> DataFrame:
    return answers.answered_so_far(_bound(spark, sf)[1], v.flow_questions(spark, sf)).select(
        "conversation_id", "seq", "answered"
    )


# --- conversations of many blocks -----------------------------------------------------

#: So small that every conversation of the long tables has many blocks.
_BITS = 4


def patient_questions_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return answers.patient_questions(v.spread(v.long_messages(spark, sf)), bits=_BITS)


def chat_context_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return _context(context.chat_context(v.spread(v.long_messages(spark, sf)), bits=_BITS))


def question_progress_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return flow.question_progress(v.spread(v.inputs(spark, sf)), v.questions(spark, sf), bits=_BITS)


def answered_so_far_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The flow of 25 questions, so that answers are carried over many blocks."""
    inputs = v.spread(v.inputs(spark, sf)).withColumn("raw_text", F.when(F.col("raw_text") == " QUIT ", "no").otherwise(F.col("raw_text")))
    questions = v.flow_questions(spark, sf).where("flow_id = 'nations'").drop("flow_id", "version")
    progress = flow.question_progress(inputs, questions, bits=2)
    return answers.answered_so_far(progress, questions, bits=2).select("conversation_id", "seq", "answered")


def transcript_text_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return context.transcript_text(v.spread(v.long_messages(spark, sf)), _BITS, part_rows=50)


# --- sessions -------------------------------------------------------------------------


def replay_session(spark: SparkSession, sf: str) -> DataFrame:
    return _snapshot_rows(sessions.replay_session(v.session_events(spark, sf)))


def _snapshot_rows(snapshots: DataFrame) -> DataFrame:
    return snapshots.select(
        "session_id",
        "status",
        "reason",
        F.unix_micros("created_at").alias("created_micros"),
        F.array_join(F.transform("questions", lambda q: F.concat(q["id"], F.lit("="), q["text"])), ",").alias("questions"),
        F.array_join(
            F.transform(
                F.array_sort(F.map_entries("answers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])
            ),
            ",",
        ).alias("answers"),
    )


# --- documents ------------------------------------------------------------------------


def _checked(spark: SparkSession, sf: str, shape: dict) -> DataFrame:
    return documents.validate_documents(v.attempts(spark, sf), shape).select(
        "conversation_id", "attempt", "valid", "error"
    )


def validate_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _checked(spark, sf, v.ATTEMPT_SHAPE)


def shape_from_template(spark: SparkSession, sf: str) -> DataFrame:
    return _checked(spark, sf, documents.shape_from_template(v.ATTEMPT_TEMPLATE))


def first_valid_attempt(spark: SparkSession, sf: str) -> DataFrame:
    return documents.first_valid_attempt(v.attempts(spark, sf), v.ATTEMPT_SHAPE)


def repair_queue(spark: SparkSession, sf: str) -> DataFrame:
    return documents.repair_queue(v.attempts(spark, sf), v.ATTEMPT_SHAPE).select(
        "conversation_id", "attempt", "error", F.get("messages", F.lit(1))["content"].alias("repair")
    )


def _summary_documents(spark: SparkSession, sf: str) -> DataFrame:
    return documents.first_valid_attempt(
        v.summary_outputs(spark, sf), documents.summary_shape()
    ).where("ok")


def summary_columns(spark: SparkSession, sf: str) -> DataFrame:
    return documents.summary_columns(_summary_documents(spark, sf))


def _assembled(spark: SparkSession, sf: str) -> DataFrame:
    progress = question_progress(spark, sf)
    asked = answers.questionnaire_answers(
        answers.latest_answers(flow.flow_answers(progress)), v.questions(spark, sf)
    )
    pairs = patient_questions(spark, sf)
    return documents.assemble_summary(_summary_documents(spark, sf), asked, pairs)


def assemble_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _summary_rows(_assembled(spark, sf))


def _summary_rows(assembled: DataFrame) -> DataFrame:
    return assembled.select(
        "conversation_id",
        "part",
        F.col("summary.patient.name").alias("name"),
        F.col("summary.notes").alias("notes"),
        F.array_join(
            F.transform(
                "summary.questionnaire_answers",
                lambda q: F.concat_ws("|", q["question_id"], q["question"], q["answer"]),
            ),
            "\n",
        ).alias("questionnaire_answers"),
        F.array_join(
            F.transform("summary.patient_questions", lambda q: F.concat_ws("|", q["question"], q["answer"])),
            "\n",
        ).alias("patient_questions"),
    )


# --- prompts and responses ------------------------------------------------------------


def _prompt_rows(prompted: DataFrame) -> DataFrame:
    return prompted.select("request_id", _chat_text(F.col("messages")).alias("prompt"))


def chat_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return _prompt_rows(prompts.chat_prompts(v.messages(spark, sf)))


def chat_prompts_in_flow(spark: SparkSession, sf: str) -> DataFrame:
    inputs, questions = v.inputs(spark, sf), v.questions(spark, sf)
    messages = flow.expand_transcript(inputs, questions, v.replies(spark, sf))
    return _prompt_rows(prompts.chat_prompts(messages, inputs, questions))


def summary_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return _prompt_rows(prompts.summary_prompts(v.messages(spark, sf), v.ATTEMPT_SHAPE))


def slot_prompts(spark: SparkSession, sf: str) -> DataFrame:
    texts = flow.classify_inputs(v.inputs(spark, sf)).where("mode = 'answer'")
    return _prompt_rows(prompts.slot_prompts(v.slot_updates(spark, sf), texts))


def note_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return _prompt_rows(prompts.note_prompts(slots.slot_maps(v.slot_updates(spark, sf))))


def topic_prompts(spark: SparkSession, sf: str) -> DataFrame:
    patient = v.patient_messages(spark, sf)
    progress = topics.topic_progress(patient, v.RULES)
    kept = topics.topic_answers(patient, progress, v.RULES)
    return _prompt_rows(prompts.topic_prompts(v.messages(spark, sf), progress, kept))


def echo_responder(batch: list) -> list:
    """Deterministic stand-in for a model."""
    return [f"{len(messages)} entries, last: {messages[-1]['content']}" for messages in batch]


def respond(spark: SparkSession, sf: str) -> DataFrame:
    asked = prompts.chat_prompts(v.messages(spark, sf))
    return responses.respond_to_table(spark, asked, echo_responder, shared_folder(spark, "responses"))


def assemble_response(spark: SparkSession, sf: str) -> DataFrame:
    return responses.assemble_response(v.chunks(spark, sf))


# --- sources and sinks ----------------------------------------------------------------


def load_question_flow(spark: SparkSession, sf: str) -> DataFrame:
    """The flow written as one JSON document and read back."""
    folder = shared_folder(spark, "flow")
    entry = F.to_json(F.struct("id", "text", "required"))
    listed = F.array_sort(F.collect_list(F.struct("pos", entry.alias("q"))))
    v.questions(spark, sf).agg(
        F.concat(
            F.lit('{"language": "en", "questions": ['),
            F.array_join(F.transform(listed, lambda e: e["q"]), ", "),
            F.lit("]}"),
        ).alias("value")
    ).write.text(folder)
    return flows.load_question_flow(spark, folder).select("pos", "id", "text", "type", "required")


def append_messages(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark, "messages")
    sinks.append_messages(v.messages(spark, sf), folder)
    return spark.read.parquet(folder)


def read_session_log(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark, "log")
    events = v.session_events(spark, sf)
    sinks.append_session_log(events.where("seq % 2 = 0"), folder, iso=True)
    sinks.append_session_log(events.where("seq % 2 = 1"), folder, iso=False)
    return logs.read_session_log(spark, folder).select(
        "session_id",
        "seq",
        F.unix_micros(F.date_trunc("second", "ts")).alias("second_micros"),
        "type",
        "question_id",
        "text",
        "reason",
    )


def read_log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Logs whose lines have no number of their own: it is the line's place in its file."""
    folder = shared_folder(spark, "lines")
    line = F.to_json(F.struct(F.lit("session_started").alias("type"), F.concat_ws("-", "conv_id", "turn").alias("sessionId")))
    turns = spark.read.parquet(f"{sf}/conversations.parquet").withColumn("value", line)
    turns.repartitionByRange(3, "conv_id").sortWithinPartitions("conv_id", "turn").select("value").write.text(folder)
    events = logs.read_session_log(spark, folder)
    in_file = events.groupBy("source").agg(F.count("*").alias("n"), F.min("seq").alias("least"), F.max("seq").alias("most"))
    placed = events.join(in_file.where("least = 0 and most = n - 1"), "source")
    ordered = placed.select(
        F.split("session_id", "-")[0].cast("bigint").alias("conversation_id"), F.split("session_id", "-")[1].cast("bigint").alias("turn"), "seq"
    )
    first = ordered.groupBy("conversation_id").agg(F.min("seq").alias("least"))
    return ordered.join(first, "conversation_id").select("conversation_id", "turn", (F.col("seq") - F.col("least")).alias("place"))


def write_session_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs into one folder, the second over more sessions, and that one again."""
    folder = shared_folder(spark, "snapshots")
    snapshots = sessions.replay_session(v.session_events(spark, sf))
    sinks.write_session_snapshot(snapshots.where("session_id < '5'"), folder)
    sinks.write_session_snapshot(snapshots, folder)
    if sinks.write_session_snapshot(snapshots, folder):
        raise ValueError("a repeated run changed something")
    schema = (
        "sessionId string, createdAt string, questions array<struct<id:string,text:string>>, "
        "answers map<string,string>"
    )
    stored = keyed.read_keyed(spark, folder, schema)
    return _snapshot_rows(stored.select(
        F.col("sessionId").alias("session_id"), F.lit("finished").alias("status"), F.lit(None).cast("string").alias("reason"),
        scalars.normalize_ts(F.col("createdAt")).alias("created_at"), "questions", "answers",
    )).drop("status", "reason")


def write_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """The assembled documents, in two runs of which the second replaces some of the first."""
    folder = shared_folder(spark, "summaries")
    found = _assembled(spark, sf)
    old = found.withColumn("summary", F.col("summary").withField("notes", F.lit("old")))
    sinks.write_summaries(old.where("conversation_id % 3 = 1"), folder)
    sinks.write_summaries(found, folder)
    return _summary_rows(keyed.read_keyed(spark, folder, found.schema))


# --- streaming ------------------------------------------------------------------------


def _events_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")


def _drain(spark: SparkSession, stream: DataFrame, mode: str, purpose: str) -> DataFrame:
    """Runs a stream over what is there and returns its table with ``batch`` numbers."""
    folder = shared_folder(spark, purpose)

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(store)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema.add("batch", T.LongType())).parquet(f"{folder}/rows")


def stream_slots(spark: SparkSession, sf: str) -> DataFrame:
    updates = v.slot_updates_of(_events_stream(spark, sf))
    report = stream_slots_module.stream_slot_completeness(updates)
    rows = _drain(spark, report, "update", "stream-slots")
    latest = F.max_by(F.struct("next_slot", F.array_join("missing_required", ",").alias("missing"), "complete"), "batch")
    return rows.groupBy("conversation_id").agg(latest.alias("r")).select("conversation_id", "r.*")


def stream_interview(spark: SparkSession, sf: str) -> DataFrame:
    ordered = v.questions(spark, sf).orderBy("pos").select("id", "text")
    steps = [(q.id, q.text) for q in ordered.collect()]
    inputs = v.inputs_of(_events_stream(spark, sf))
    said = stream_interview_module.stream_interview(inputs, steps)
    rows = _drain(spark, said, "append", "stream-interview").select(*MESSAGE_COLUMNS)
    return rows.withColumn("conversation_id", F.col("conversation_id").cast("bigint"))


def _files(spark: SparkSession, folder: str) -> int:
    return len(spark.read.text(folder).inputFiles())


def _landed(spark: SparkSession, sf: str, waves: int) -> DataFrame:
    """The events as a stream of several waves in the order of time, one a micro-batch.

    A wave's files go by user, as an input behind a later one of its conversation is an error."""
    folder = shared_folder(spark, "waves")
    events = spark.read.parquet(f"{sf}/events.parquet")
    most, files = events.agg(F.max("event_id")).first()[0] or 0, 1
    for i in range(waves):
        wave = events.where(F.floor(F.col("event_id") * waves / (most + 1)) == i)
        wave.repartition("user_id").write.parquet(f"{folder}/wave{i}")
        files = max(files, len(spark.read.schema(events.schema).parquet(f"{folder}/wave{i}").inputFiles()))
    return (
        spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files)
        .option("recursiveFileLookup", "true").parquet(folder)
    )


def stream_dialogue(spark: SparkSession, sf: str) -> DataFrame:
    """A live interview in several micro-batches, its side questions answered in between."""
    ordered = v.questions(spark, sf).orderBy("pos").select("id", "text")
    steps = [(q.id, q.text) for q in ordered.collect()]
    inputs = v.inputs_of(_landed(spark, sf, 3))
    rows = dialogue_module.run_dialogue(spark, inputs, steps, echo_responder, shared_folder(spark, "dialogue"))
    said = rows.where("role is not null").select(*MESSAGE_COLUMNS)
    return said.withColumn("conversation_id", F.col("conversation_id").cast("bigint"))


def _files_per_batch(spark: SparkSession, files: int, least: int) -> int:
    """Files enough to occupy the cores, few enough that a micro-batch stays of bounded size."""
    return max(least, min(files, spark.sparkContext.defaultParallelism))


def stream_session_waves(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of a day in several micro-batches; ended ones leave the state a day later."""
    folder = shared_folder(spark, "landing")
    events = v.session_events(spark, sf)
    waves = ((1, 10), (11, 20), (21, 31))
    for low, high in waves:
        sinks.append_session_log(events.where(F.day("ts").between(low, high)), folder)
    files = _files_per_batch(spark, -(-_files(spark, folder) // len(waves)), 2)
    stream = stream_sessions_module.stream_session_log(spark, folder, files_per_batch=files)
    rows = _drain(spark, stream_sessions_module.stream_sessions(stream, keep="12 days"), "update", "stream-waves")
    return _current_sessions(rows)


def stream_session_log(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark, "landing")
    sinks.append_session_log(v.session_events(spark, sf), folder)
    files = _files_per_batch(spark, _files(spark, folder) // 3, 3)
    events = stream_sessions_module.stream_session_log(spark, folder, files_per_batch=files)
    # Files go by session, so a micro-batch may lie as far back as the log is long.
    rows = _drain(spark, stream_sessions_module.stream_sessions(events, keep="60 days"), "update", "stream-sessions")
    return _current_sessions(rows)


def _current_sessions(rows: DataFrame) -> DataFrame:
    latest = F.max_by(F.struct("status", "reason", "created_at", "questions", "answers"), "version")
    current = rows.groupBy("session_id").agg(latest.alias("r")).select("session_id", "r.*")
    pairs = F.transform("answers", lambda a: F.concat(a["question_id"], F.lit("="), a["answer"]))
    return current.select(
        "session_id", "status", "reason", F.size("questions").alias("questions"),
        F.array_join(F.array_sort(pairs), ",").alias("answers"),
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        patient_questions,
        patient_questions_long,
        classify_input,
        classify_command,
        py_strip,
        normalize_ts,
        render_line,
        to_chat_role,
        is_chat_turn,
        extract_json_block,
        parse_json_strict,
        project_known_slots,
        is_truthy,
        match_keywords,
        chunk_token,
        tokens_per_second,
        split_event_text,
        question_progress,
        question_at_index,
        expand_transcript,
        expand_transcript_without_responder,
        rejected_inputs,
        latest_answers,
        questionnaire_answers,
        answered_so_far,
        chat_context,
        chat_context_short,
        take_turn,
        transcript_text,
        collect_history,
        read_transcript,
        merge_slots,
        slot_completeness,
        missing_required,
        next_unfilled,
        next_dialog_slot,
        next_question,
        slot_bank,
        topic_progress,
        topic_answers,
        topic_turns,
        replay_session,
        validate_documents,
        shape_from_template,
        first_valid_attempt,
        repair_queue,
        summary_columns,
        assemble_summary,
        chat_prompts,
        chat_prompts_in_flow,
        summary_prompts,
        slot_prompts,
        note_prompts,
        topic_prompts,
        respond,
        assemble_response,
        load_question_flow,
        append_messages,
        read_session_log,
        write_session_snapshot,
        write_summaries,
        stream_slots,
        stream_interview,
        stream_session_log,
        open_slots,
        open_required_slots,
        open_flow_questions,
        dialog_slots,
        topic_bank,
        shipped_topic_answers,
        topic_turn_prompts,
        bind_flows,
        versioned_progress,
        versioned_transcript,
        versioned_answers,
        versioned_so_far,
        patient_questions_blocks,
        chat_context_blocks,
        question_progress_blocks,
        answered_so_far_blocks,
        transcript_text_blocks,
        read_log_lines,
        stream_dialogue,
        stream_session_waves,
    )
}
