"""Question flows and the fixed slot and topic banks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dialogweave.fixed_values import DIALOG_SLOTS, SLOT_BANK, TOPIC_RULES
from dialogweave.functions.jsontext import field_text, kind_of, object_field, parse_json_strict
from dialogweave.model import QUESTION_SCHEMA

FIELDS = [f.name for f in QUESTION_SCHEMA if f.name not in ("flow_id", "pos")]

#: Columns that name the flow a question belongs to, or a conversation is bound to.
FLOW_COLUMNS = ("flow_id", "version")


def flow_columns(*tables: DataFrame) -> list[str]:
    """The flow columns that all tables have."""
    return [c for c in FLOW_COLUMNS if all(c in t.columns for t in tables)]


def one_flow(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """The questions, where ``rows`` say by which flow they go; else those of the only flow.

    Without such columns, a position that several flows have would multiply rows. It fails the
    query instead.
    """
    if flow_columns(questions) == flow_columns(questions, rows):
        return questions
    several = F.raise_error(F.lit("several flows: bind conversations to theirs with bind_flows"))
    others = [c for c in questions.columns if c != "pos"]
    only = F.when(F.count(F.lit(1)) == 1, F.first(F.struct(*others))).otherwise(several)
    return questions.groupBy("pos").agg(only.alias("_q")).select("pos", "_q.*")


def _in_force(inputs: DataFrame, versions: DataFrame) -> DataFrame:
    """(conversation_id, flow_id, version): what was in force at the first input; NULL if nothing.

    A flow's versions are one sorted array, so an as-of look-up neither multiplies rows nor
    compares a conversation with all versions of all flows.
    """
    first = inputs.where("conversation_id is not null and seq is not null").groupBy("conversation_id").agg(
        F.min_by(F.struct("flow_id", "ts"), "seq").alias("_first")
    )
    history = versions.groupBy(F.col("flow_id").alias("_flow")).agg(
        F.array_sort(F.collect_list(F.struct("valid_from", "version"))).alias("_versions")
    )
    until = F.filter("_versions", lambda v: v["valid_from"] <= F.col("_first.ts"))
    return first.join(history, F.col("_first.flow_id") == F.col("_flow"), "left").select(
        "conversation_id", F.col("_first.flow_id").alias("flow_id"), F.try_element_at(until, F.lit(-1))["version"].alias("version")
    )


def bind_flows(inputs: DataFrame, versions: DataFrame) -> DataFrame:
    """Inputs with ``flow_id`` and ``version``: those in force when their conversation began.

    inputs has ``flow_id`` and ``ts``; versions(flow_id, version, valid_from) says from when a
    version of a flow is in force, until the next one's time; of several from one time the
    highest counts. A conversation keeps the flow and version of its first input (by ``seq``)
    even if later inputs name another flow or fall into a later version's time. Inputs of
    conversations without any version in force are left out (see ``unbound_conversations``).
    """
    bound = _in_force(inputs, versions).where("version is not null")
    return inputs.drop("flow_id", "version").join(bound, "conversation_id")


def unbound_conversations(inputs: DataFrame, versions: DataFrame) -> DataFrame:
    """(conversation_id, flow_id) for which no version of their flow was in force."""
    return _in_force(inputs, versions).where("version is null").drop("version")


def load_question_flow(spark: SparkSession, path: str) -> DataFrame:
    """Questions of one or more flow documents, in list order.

    A document is ``{"questions": [...]}`` or the bare list. Missing optional fields get
    their defaults; an unknown key, or a question without id or text, fails the query.
    One flow is one small document and is read whole.
    """
    docs = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("flow_id"), F.col("value")
    )
    parsed = docs.withColumn("doc", parse_json_strict(F.col("value")))
    listed = F.coalesce(object_field(F.col("doc"), "questions"), F.col("doc"))
    items = (
        parsed.withColumn("list", _must(listed, kind_of(listed) == "array", "no question list"))
        .select(
            "flow_id",
            F.posexplode(F.variant_get("list", "$", "array<variant>")).alias("pos", "q"),
        )
    )
    q = F.col("q")
    keys = F.map_keys(F.variant_get(q, "$", "map<string,variant>"))
    surplus = F.array_except(keys, F.array(*[F.lit(f) for f in FIELDS]))
    checked = _must(q, F.size(surplus) == 0, "unknown key in question")
    items = items.select("flow_id", "pos", checked.alias("q"))

    def text(name: str) -> Column:
        return field_text(object_field(q, name))

    def needed(name: str) -> Column:
        return _must(text(name), object_field(q, name).isNotNull(), f"question without {name}")

    return items.select(
        "flow_id",
        "pos",
        needed("id").alias("id"),
        needed("text").alias("text"),
        F.coalesce(text("type"), F.lit("free_text")).alias("type"),
        F.coalesce(
            F.try_variant_get(object_field(q, "required"), "$", "boolean"), F.lit(True)
        ).alias("required"),
        text("help_prompt").alias("help_prompt"),
        F.try_variant_get(object_field(q, "choices"), "$", "array<string>").alias("choices"),
        F.when(
            kind_of(object_field(q, "validation")) != "null", F.to_json(object_field(q, "validation"))
        ).alias("validation"),
    )


def _must(value: Column, holds: Column, problem: str) -> Column:
    return F.when(F.coalesce(holds, F.lit(False)), value).otherwise(
        F.raise_error(F.lit(problem))
    )


def slot_bank(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, s.slot, s.slot, s.text, s.required) for i, s in enumerate(SLOT_BANK)],
        "pos int, id string, slot string, text string, required boolean",
    )


def dialog_slots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(DIALOG_SLOTS)), "pos int, slot string")


def topic_bank(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, r.topic, r.label) for i, r in enumerate(TOPIC_RULES)],
        "pos int, topic string, label string",
    )
