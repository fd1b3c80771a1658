"""Untrusted model documents: shape, validation, retry selection, repair, assembly."""

from __future__ import annotations

import json
from typing import Any, Optional

from pyspark.sql import Column, DataFrame, functions as F, types as T

from dialogweave.fixed_values import MAX_RETRIES
from dialogweave.functions.jsontext import (
    bind,
    extract_json_block,
    is_integer,
    is_number,
    object_field,
    parse_json_strict,
)
from dialogweave.operators.ordered import BLOCK_BITS, PART_BYTES, PART_ROWS, with_part

VIOLATIONS = "array<struct<path:string,rule:string>>"
KEYWORDS = {"type", "properties", "required", "enum", "items", "additionalProperties"}
_IGNORED = {"$schema", "description", "title"}

# --- fixed values: the summary document ----------------------------------------------
SUMMARY_ENUMS = {
    "prior_anesthesia": ["yes", "no", "unknown"],
    "asa_classification": ["ASA-I", "ASA-II", "ASA-III", "ASA-IV", "ASA-V", "not_assessed"],
    "smoking_status": ["never", "former", "current_light", "current_heavy", "unknown"],
    "fasting_compliance": ["compliant", "non_compliant", "unclear", "not_discussed"],
    "category": [
        "difficult_airway",
        "cardiac_risk",
        "medication_interaction",
        "allergy_concern",
        "fasting_violation",
        "pregnancy_concern",
        "bleeding_risk",
        "respiratory_risk",
        "other",
    ],
    "severity": ["low", "medium", "high", "critical"],
}
PATIENT_FIELDS = [
    "name",
    "age",
    "allergies",
    "prior_anesthesia",
    "current_surgery",
    "asa_classification",
    "smoking_status",
    "fasting_compliance",
]
# --------------------------------------------------------------------------------------


def _object(fields: list[str], integers: tuple[str, ...] = ()) -> dict:
    def leaf(name: str) -> dict:
        if name in SUMMARY_ENUMS:
            return {"type": "string", "enum": SUMMARY_ENUMS[name]}
        return {"type": "integer" if name in integers else "string"}

    return {"type": "object", "properties": {f: leaf(f) for f in fields}, "required": fields}


def summary_shape() -> dict:
    """Shape of the summary document; keys beyond the required ones are allowed."""
    properties = {
        "patient": _object(PATIENT_FIELDS, ("age",)),
        "questionnaire_answers": {
            "type": "array",
            "items": _object(["question_id", "question", "answer"]),
        },
        "patient_questions": {"type": "array", "items": _object(["question", "answer"])},
        "red_flags": {"type": "array", "items": _object(["category", "severity", "description"])},
        "notes": {"type": "string"},
    }
    return {"type": "object", "properties": properties, "required": list(properties)}


def shape_from_template(template: Any) -> dict:
    """Shape of an example document: the kinds of its values, with exactly its keys.

    Walks one small parameter document on the driver. Lists take the shape of their first
    element, an empty list and null allow anything.
    """
    if template is None:
        return {}
    # bool before int: Python's booleans are integers.
    for kind, name in ((bool, "boolean"), (int, "integer"), (float, "number"), (str, "string")):
        if isinstance(template, kind):
            return {"type": name}
    if isinstance(template, list):
        return {"type": "array", "items": shape_from_template(template[0]) if template else {}}
    if isinstance(template, dict):
        return {
            "type": "object",
            "properties": {k: shape_from_template(v) for k, v in template.items()},
            "required": list(template),
            "additionalProperties": False,
        }
    return {}


def struct_type(shape: dict) -> T.DataType:
    """Spark type of a shape; parts that allow anything are VARIANT."""
    plain = {
        "boolean": T.BooleanType(),
        "integer": T.LongType(),
        "number": T.DoubleType(),
        "string": T.StringType(),
    }
    kind = shape.get("type")
    if kind in plain:
        return plain[kind]
    if kind == "array":
        return T.ArrayType(struct_type(shape.get("items", {})))
    if kind == "object" and shape.get("properties"):
        return T.StructType(
            [T.StructField(k, struct_type(v)) for k, v in shape["properties"].items()]
        )
    return T.VariantType()


def _rules(*tests: tuple[Column, str], path: Column) -> Column:
    """The rules whose test holds."""
    found = F.array(
        *[F.when(broken, F.struct(path.alias("path"), F.lit(rule).alias("rule"))) for broken, rule in tests]
    )
    return F.array_compact(found).cast(VIOLATIONS)


def _is_kind(value: Column, name: Column, kind: str) -> Column:
    """Whether a VARIANT of type ``name`` is of a JSON kind."""
    if kind == "integer":
        return is_integer(value, name)
    if kind == "number":
        return is_number(name)
    if kind in ("object", "array"):
        return name.startswith(kind.upper())
    return name == {"string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}[kind]


def _is_one_of(value: Column, name: Column, allowed: list) -> Column:
    """Whether a VARIANT equals one of the listed scalars, kind by kind."""
    texts = [a for a in allowed if isinstance(a, str)]
    truths = [a for a in allowed if isinstance(a, bool)]
    numbers = [float(a) for a in allowed if isinstance(a, (int, float)) and not isinstance(a, bool)]
    if len(texts) + len(truths) + len(numbers) + allowed.count(None) != len(allowed):
        raise ValueError("enum entries must be scalars")
    hit = F.lit(False)
    if texts:
        hit = hit | ((name == "STRING") & F.try_variant_get(value, "$", "string").isin(*texts))
    if truths:
        hit = hit | ((name == "BOOLEAN") & F.try_variant_get(value, "$", "boolean").isin(*truths))
    if numbers:
        hit = hit | (is_number(name) & F.try_variant_get(value, "$", "double").isin(*numbers))
    if None in allowed:
        hit = hit | (name == "VOID")
    return F.coalesce(hit, F.lit(False))


def violations(value: Column, shape: dict, path: Optional[Column] = None) -> Column:
    """Array of (path, rule) a VARIANT breaks, as one native expression."""
    unknown = set(shape) - KEYWORDS - _IGNORED
    if unknown:
        raise ValueError(f"unsupported shape keywords: {sorted(unknown)}")
    path = F.lit("$") if path is None else path
    return bind(
        value,
        lambda v: bind(F.schema_of_variant(v), lambda name: _violations(v, name, shape, path)),
    )


def _violations(value: Column, name: Column, shape: dict, path: Column) -> Column:
    empty = F.array().cast(VIOLATIONS)
    tests, parts = [], []
    if "type" in shape:
        tests.append((~_is_kind(value, name, shape["type"]), f"type {shape['type']}"))
    if "enum" in shape:
        tests.append((~_is_one_of(value, name, shape["enum"]), "enum"))
    is_object = _is_kind(value, name, "object")
    for key in shape.get("required", []):
        tests.append((is_object & object_field(value, key).isNull(), f"required {key}"))
    if tests:
        parts.append(_rules(*tests, path=path))
    inner = [
        _field_violations(value, key, field_shape, path)
        for key, field_shape in shape.get("properties", {}).items()
        if set(field_shape) - _IGNORED
    ]
    extra = shape.get("additionalProperties", True)
    if isinstance(extra, dict):
        raise ValueError("additionalProperties must be true or false")
    if extra is False:
        keys = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
        known = F.array(*[F.lit(k) for k in shape.get("properties", {})]).cast("array<string>")
        surplus = F.transform(
            F.array_sort(F.array_except(keys, known)),
            lambda k: F.struct(path.alias("path"), F.concat(F.lit("unknown key "), k).alias("rule")),
        )
        inner.append(surplus.cast(VIOLATIONS))
    if inner:
        parts.append(F.when(is_object, F.concat(*inner)).otherwise(empty))
    if set(shape.get("items", {})) - _IGNORED:
        nested = F.flatten(
            F.transform(
                F.try_variant_get(value, "$", "array<variant>"),
                lambda x, i: violations(
                    x, shape["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
                ),
            )
        )
        parts.append(F.when(_is_kind(value, name, "array"), nested).otherwise(empty))
    return F.concat(*parts) if parts else empty


def _field_violations(value: Column, key: str, shape: dict, path: Column) -> Column:
    inner_path = F.concat(path, F.lit(f".{key}"))
    return bind(
        object_field(value, key),
        lambda field: F.when(field.isNotNull(), violations(field, shape, inner_path)).otherwise(
            F.array().cast(VIOLATIONS)
        ),
    )


def validate_documents(docs: DataFrame, shape: dict, raw: str = "raw") -> DataFrame:
    """Adds ``document`` (the JSON text found), ``valid``, ``violations`` and ``error``.

    Text without JSON has the violation ``($, parse)``. The JSON text stays a string, as
    VARIANT can neither be grouped nor ordered.
    """
    found = docs.withColumn("document", extract_json_block(F.col(raw))).withColumn(
        "_doc", parse_json_strict(F.col("document"))
    )
    unparsed = F.array(F.struct(F.lit("$").alias("path"), F.lit("parse").alias("rule"))).cast(VIOLATIONS)
    checked = found.withColumn(
        "violations",
        F.when(F.col("_doc").isNull(), unparsed).otherwise(violations(F.col("_doc"), shape)),
    )
    messages = F.transform("violations", lambda v: F.concat(v["path"], F.lit(": "), v["rule"]))
    return (
        checked.withColumn("valid", F.size("violations") == 0)
        .withColumn("error", F.nullif(F.array_join(messages, "; "), F.lit("")))
        .drop("_doc")
    )


def first_valid_attempt(
    attempts: DataFrame, shape: dict, max_retries: int = MAX_RETRIES
) -> DataFrame:
    """The first valid attempt per conversation, or the last error when none is valid.

    Attempts are numbered from 0; those beyond the retry limit were never asked for.
    """
    checked = validate_documents(attempts.where(F.col("attempt") <= max_retries), shape)
    valid_at = F.when(F.col("valid"), F.col("attempt"))
    return (
        checked.groupBy("conversation_id")
        .agg(
            F.min_by(F.when(F.col("valid"), F.col("document")), valid_at).alias("document"),
            F.min(valid_at).alias("attempt"),
            F.max_by("error", "attempt").alias("_error"),
        )
        .select(
            "conversation_id",
            F.col("attempt").isNotNull().alias("ok"),
            "attempt",
            "document",
            F.when(F.col("attempt").isNull(), F.col("_error")).alias("last_error"),
        )
    )


def repair_queue(
    attempts: DataFrame,
    shape: dict,
    wording: Optional[dict[str, str]] = None,
    max_retries: int = MAX_RETRIES,
) -> DataFrame:
    """Next prompt of conversations without a valid attempt that may still retry.

    The prompt holds the system part and a repair part with the error and the raw output;
    the transcript is not repeated.
    """
    words = {
        "system": "Answer with one JSON document of this shape and nothing else:\n",
        "repair": "The last output does not fit. Correct it.",
        "error": "Problem:",
        "output": "Output:",
        **(wording or {}),
    }
    checked = validate_documents(attempts.where(F.col("attempt") <= max_retries), shape)
    latest = checked.groupBy("conversation_id").agg(
        F.max("attempt").alias("attempt"),
        F.max_by("raw", "attempt").alias("raw"),
        F.max_by("error", "attempt").alias("error"),
        F.max(F.col("valid")).alias("_solved"),
    )
    repair = F.concat_ws(
        "\n",
        F.lit(words["repair"]),
        F.concat_ws("\n", F.lit(words["error"]), "error"),
        F.concat_ws("\n", F.lit(words["output"]), "raw"),
    )
    return latest.where(~F.col("_solved") & (F.col("attempt") < max_retries)).select(
        "conversation_id",
        (F.col("attempt") + 1).alias("attempt"),
        "error",
        F.array(
            F.struct(
                F.lit("system").alias("role"),
                F.lit(words["system"] + json.dumps(shape, ensure_ascii=False)).alias("content"),
            ),
            F.struct(F.lit("user").alias("role"), repair.alias("content")),
        ).alias("messages"),
    )


def typed_documents(documents: DataFrame, shape: dict, column: str = "document") -> DataFrame:
    """Validated JSON text as a STRUCT ``doc`` of the shape's type.

    Whole numbers may be written in any way (25, 25.0, 2.5e1). One that does not fit a
    BIGINT is NULL in ``doc``; such documents list their paths in ``unfit``.
    """
    parsed = documents.withColumn("_doc", parse_json_strict(F.col(column)))
    return parsed.withColumns(
        {
            "doc": F.try_variant_get("_doc", "$", struct_type(shape).simpleString()),
            "unfit": F.coalesce(_unfit(F.col("_doc"), shape), F.array().cast("array<string>")),
        }
    ).drop("_doc")


def _unfit(value: Column, shape: dict, path: Optional[Column] = None) -> Column:
    """Paths of the whole numbers of a VARIANT that no BIGINT holds."""
    path = F.lit("$") if path is None else path
    none = F.array().cast("array<string>")
    if shape.get("type") == "integer":
        lost = value.isNotNull() & F.try_variant_get(value, "$", "bigint").isNull()
        return F.when(lost, F.array(path)).otherwise(none)
    if shape.get("type") == "array" and _has_integer(shape.get("items", {})):
        nested = F.transform(
            F.try_variant_get(value, "$", "array<variant>"),
            lambda x, i: _unfit(x, shape["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))),
        )
        return F.coalesce(F.flatten(nested), none)
    inner = [
        _unfit(object_field(value, key), field, F.concat(path, F.lit(f".{key}")))
        for key, field in shape.get("properties", {}).items()
        if _has_integer(field)
    ]
    return F.concat(*inner) if inner else none


def _has_integer(shape: dict) -> bool:
    parts = [*shape.get("properties", {}).values(), *([shape["items"]] if "items" in shape else [])]
    return shape.get("type") == "integer" or any(_has_integer(s) for s in parts)


def extra_fields(document: Column, shape: dict) -> Column:
    """MAP of the top-level keys beyond the shape's to their JSON text."""
    fields = F.try_variant_get(parse_json_strict(document), "$", "map<string,variant>")
    known = list(shape.get("properties", {}))
    extra = F.map_filter(fields, lambda k, v: ~k.isin(*known)) if known else fields
    return F.transform_values(extra, lambda k, v: F.to_json(v))


def summary_columns(documents: DataFrame) -> DataFrame:
    """Flat row per red flag of validated summary documents; documents without any keep one."""
    typed = typed_documents(documents, summary_shape())
    return typed.select(
        "conversation_id",
        *[F.col(f"doc.patient.{f}").alias(f) for f in PATIENT_FIELDS],
        F.col("doc.notes").alias("notes"),
        F.posexplode_outer("doc.red_flags").alias("flag_pos", "_flag"),
    ).select(
        "conversation_id",
        *PATIENT_FIELDS,
        "notes",
        "flag_pos",
        "_flag.category",
        "_flag.severity",
        "_flag.description",
    )


def assemble_summary(
    documents: DataFrame,
    questionnaire: DataFrame,
    pairs: DataFrame,
    shape: Optional[dict] = None,
    bits: int = BLOCK_BITS,
    part_rows: int = PART_ROWS,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Summary documents whose deterministic parts replace the model's.

    ``documents(conversation_id, document)`` are validated model outputs,
    ``questionnaire`` the rows of J1 and ``pairs`` those of W1. A conversation whose pairs
    pass ``part_rows`` or ``part_bytes`` gets one row per part of them, all with the same
    other fields; all others have exactly one row. ``extra`` has the model's other keys as
    JSON texts, ``unfit`` the paths of numbers too large for their type.
    """
    from dialogweave.operators.answers import questionnaire_documents

    shape = shape or summary_shape()
    typed = typed_documents(documents, shape).select(
        "conversation_id", "doc", extra_fields(F.col("document"), shape).alias("extra"), "unfit"
    )
    size = F.octet_length(F.concat_ws("", "question", "answer"))
    asked = (
        with_part(pairs, size, bits=bits, part_rows=part_rows, part_bytes=part_bytes)
        .groupBy("conversation_id", "part")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("seq", "question", "answer"))),
                lambda p: F.struct(p["question"], p["answer"]),
            ).alias("_pairs")
        )
    )
    none = F.array()
    joined = typed.join(questionnaire_documents(questionnaire), "conversation_id", "left").join(
        asked, "conversation_id", "left"
    )
    return joined.select(
        "conversation_id",
        F.coalesce("part", F.lit(0)).cast("bigint").alias("part"),
        F.col("doc")
        .withField(
            "questionnaire_answers",
            F.coalesce(
                "questionnaire_answers",
                none.cast("array<struct<question_id:string,question:string,answer:string>>"),
            ),
        )
        .withField(
            "patient_questions",
            F.coalesce("_pairs", none.cast("array<struct<question:string,answer:string>>")),
        )
        .alias("summary"),
        "extra",
        "unfit",
    )
