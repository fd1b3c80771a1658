"""The canonical tables as views over the test tables; every view reads its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dialogweave.fixed_values import SLOT_BANK, TopicRule

RULES = (
    TopicRule("opening", "Opening", ("tion", "que"), True),
    TopicRule("details", "Details", ("wh", "rr"), True, "seen"),
    TopicRule("closing", "Closing", ("ing", "ci", "sch"), False),
    TopicRule("spare", "Spare", ("th",), True),
)

ATTEMPT_SHAPE = {
    "type": "object",
    "properties": {
        "name": {"type": "string"},
        "age": {"type": "integer"},
        "mood": {"type": "string", "enum": ["good", "bad"]},
    },
    "required": ["name", "age", "mood"],
}
ATTEMPT_TEMPLATE = {"name": "", "age": 0, "mood": ""}

_K = "cast(regexp_extract(props, '([0-9]+)', 1) as int)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").selectExpr(
        "conv_id as conversation_id",
        "turn as seq",
        "case role when 'user' then 'patient' else role end as role",
        "text as content",
        "case when role = 'system' then null when (conv_id + turn) % 3 = 0 then 'answer' "
        "else 'chat' end as mode",
    )


def patient_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).where("role = 'patient'")


def long_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few, long conversations with repeated and padded texts."""
    return _table(spark, sf_dir, "events").selectExpr(
        "user_id % 50 as conversation_id",
        "event_id as seq",
        "case event_type when 'purchase' then 'assistant' when 'error' then 'system' "
        "else 'patient' end as role",
        f"case when {_K} % 4 = 0 then '  ' || event_type || ' ' || ({_K} % 10) || chr(10) "
        f"else event_type || ' ' || ({_K} % 10) end as content",
        "case event_type when 'error' then null when 'signup' then 'answer' else 'chat' end as mode",
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "region").selectExpr(
        "cast(r_regionkey as int) as pos",
        "'q' || (r_regionkey + 1) as id",
        "'What about ' || r_name || '?' as text",
        "r_regionkey <> 3 as required",
    )


_RAW_TEXT = (
    f"case event_type when 'click' then '?  why ' || {_K} when 'purchase' then '?what ' || {_K} "
    f"when 'view' then 'answer ' || {_K} when 'signup' then ' yes ' || {_K} || chr(9) "
    f"else case when {_K} < 10 then ' QUIT ' when {_K} < 30 then '' else 'no' end end"
)


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs_of(_table(spark, sf_dir, "events"))


def inputs_of(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "user_id as conversation_id", "event_id as seq", f"{_RAW_TEXT} as raw_text"
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        inputs(spark, sf_dir)
        .where("raw_text like '?%'")
        .selectExpr("conversation_id", "seq", "'reply to ' || raw_text as content")
    )


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").selectExpr(
        "cast(user_id * 100 + day(ts) as string) as session_id",
        "event_id as seq",
        "cast(ts as timestamp) as ts",
        "case event_type when 'signup' then 'session_started' when 'view' then "
        "'standard_question_shown' when 'click' then 'standard_answer_given' "
        "when 'purchase' then 'session_finished' else 'session_aborted' end as type",
        f"case when event_type in ('view', 'click') then 'q' || ({_K} % 7 + 1) end as question_id",
        "case when event_type in ('view', 'click') then cast(event_id as string) end as text",
        "cast(null as string) as chat_role",
        "cast(null as string) as chat_content",
        "cast(null as string) as command",
        "cast(null as string) as ctx_question_id",
        "cast(null as string) as ctx_phase",
        "case when event_type = 'error' then 'user_quit' end as reason",
        "cast(null as string) as meta",
    )


def slot_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slot_updates_of(_table(spark, sf_dir, "events"))


def slot_updates_of(events: DataFrame) -> DataFrame:
    names = " ".join(f"when {i} then '{s.slot}'" for i, s in enumerate(SLOT_BANK))
    return events.selectExpr(
        "user_id as conversation_id",
        "event_id as seq",
        f"case {_K} % 6 {names} end as slot",
        "case when event_type = 'error' then '' else event_type end as value",
    )


def raw_slot_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model output of every kind: objects with and without known keys, arrays, junk."""
    return _table(spark, sf_dir, "events").selectExpr(
        "user_id as conversation_id",
        "event_id as seq",
        "case event_type "
        "when 'view' then '{\"allergies\": \"e' || event_id || '\", \"other\": 1}' "
        "when 'signup' then '{\"medications\": \"\", \"past_surgery\": ' || (event_id % 3) || '}' "
        "when 'click' then props when 'purchase' then '[' || event_id || ']' "
        "else 'oops ' || props end as raw",
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").selectExpr(
        "conv_id as conversation_id",
        "cast(turn as int) as attempt",
        "case (conv_id + turn) % 4 "
        "when 0 then text || ' {\"name\": \"c' || conv_id || '\", \"age\": ' || turn || "
        "', \"mood\": \"' || case when conv_id % 5 = 0 then 'odd' else 'good' end || '\"} ' || text "
        "when 1 then text "
        "when 2 then '{\"name\": \"c' || conv_id || '\", \"age\": \"' || turn || '\", \"extra\": null}' "
        "else '{\"name\": \"c' || conv_id || '\" ' || text end as raw",
    )


def summary_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A complete summary document per turn, with one to two red flags or none."""
    flag = (
        "'{\"category\": \"' || case when turn % 2 = 0 then 'cardiac_risk' else 'other' end || "
        "'\", \"severity\": \"low\", \"description\": \"turn ' || turn || '\"}'"
    )
    return _table(spark, sf_dir, "conversations").selectExpr(
        "conv_id as conversation_id",
        "cast(turn as int) as attempt",
        "'Summary: {\"patient\": {\"name\": \"Person ' || conv_id || '\", \"age\": ' || (20 + conv_id % 60) || "
        "', \"allergies\": \"None\", \"prior_anesthesia\": \"no\", \"current_surgery\": \"knee\", "
        "\"asa_classification\": \"ASA-I\", \"smoking_status\": \"' || "
        "case when (conv_id + turn) % 3 = 0 then 'sometimes' else 'never' end || '\", "
        "\"fasting_compliance\": \"compliant\"}, \"questionnaire_answers\": [], \"patient_questions\": "
        f"[], \"red_flags\": [' || case conv_id % 3 when 0 then '' when 1 then {flag} "
        f"else {flag} || ', ' || {flag} end || '], \"notes\": \"n' || conv_id || '\"}}' as raw",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").selectExpr(
        "conv_id as response_id",
        "turn as chunk_idx",
        "case when turn % 2 = 0 then text end as message_content",
        "case when turn % 2 = 1 then text end as response",
        "turn % 2 = 1 as done",
        "cast(length(text) as bigint) as eval_count",
        "(turn + 1) * 1000000 as eval_duration",
    )


def flow_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two flows, one of them in two versions of different order and texts."""
    regions = _table(spark, sf_dir, "region")
    first = regions.selectExpr(
        "'regions' as flow_id", "1 as version", "cast(r_regionkey as int) as pos", "'q' || (r_regionkey + 1) as id",
        "'What about ' || r_name || '?' as text", "r_regionkey <> 3 as required",
    )
    second = regions.selectExpr(
        "'regions' as flow_id", "2 as version", "cast(4 - r_regionkey as int) as pos", "'q' || (r_regionkey + 1) as id",
        "'Tell of ' || r_name as text", "r_regionkey < 3 as required",
    )
    nations = _table(spark, sf_dir, "nation").selectExpr(
        "'nations' as flow_id", "1 as version", "cast(n_nationkey as int) as pos", "'n' || n_nationkey as id",
        "n_name || '?' as text", "n_nationkey % 2 = 0 as required",
    )
    return first.unionByName(second).unionByName(nations)


def flow_versions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [("regions", 1, "2024-01-01"), ("regions", 2, "2024-01-01 06:00:00"), ("nations", 1, "2024-01-01 01:00:00")],
        "flow_id string, version int, valid_from string",
    ).selectExpr("flow_id", "version", "cast(valid_from as timestamp) as valid_from")


def flow_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs that name a flow, each user's day being a conversation."""
    return _table(spark, sf_dir, "events").selectExpr(
        "user_id * 100 + day(ts) as conversation_id", "event_id as seq", f"{_RAW_TEXT} as raw_text",
        "case when user_id % 3 = 0 then 'nations' else 'regions' end as flow_id", "cast(ts as timestamp) as ts",
    )


#: Clock-like places: far apart, so that no two rows are in one range of 65,536.
SPREAD = 100_003


def spread(rows: DataFrame) -> DataFrame:
    return rows.withColumn("seq", rows["seq"] * SPREAD)


def slot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled slots of each user's day: few enough that all kinds of completeness occur."""
    names = " ".join(f"when {i} then '{s.slot}'" for i, s in enumerate(SLOT_BANK))
    return _table(spark, sf_dir, "events").selectExpr(
        "user_id * 10 + day(ts) % 10 as conversation_id",
        f"case when event_type <> 'error' then case {_K} % 6 {names} end end as slot",
    )


SHIPPED_TEXT = (
    "case (turn + conv_id) % 7 when 0 then '180 CM' when 1 then 'har aldrig ' || left(text, 5) "
    "when 2 then 'Ingen medicin' when 3 then 'ingen ALLERGI' when 4 then 'motion' else left(text, 3) end"
)


def shipped_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patient messages in the language of the shipped topic rules."""
    return _table(spark, sf_dir, "conversations").where("role = 'user'").selectExpr(
        "conv_id as conversation_id", "turn as seq", "'patient' as role", f"{SHIPPED_TEXT} as content"
    )
