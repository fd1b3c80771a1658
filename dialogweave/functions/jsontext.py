"""JSON inside free text: extraction, strict parsing, truthiness, key projection."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, functions as F

from dialogweave.functions.scalars import py_strip


def extract_json_block(raw: Column) -> Column:
    """From the first ``{`` to the last ``}`` of the stripped text, else the whole of it.

    Two position lookups keep the cost linear in the text, also for text full of braces.
    """
    return bind(py_strip(raw), _outer_braces)


def _outer_braces(text: Column) -> Column:
    first = F.instr(text, "{")
    last = F.length(text) - F.instr(F.reverse(text), "}") + 1
    return F.when(
        (first > 0) & F.contains(text, F.lit("}")) & (last > first),
        F.substr(text, first, last - first + 1),
    ).otherwise(text)


def parse_json_strict(text: Column) -> Column:
    """VARIANT of the text, or NULL when it is not exactly one JSON value.

    ``try_parse_json`` stops at the end of the first value, so text behind it is found by
    wrapping. In ``[text]`` a closing bracket inside the text hides what follows it, but
    then ``{"v":text}`` does not parse; otherwise the array must hold exactly one item.
    NaN and repeated keys are rejected on purpose.
    """

    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    entry = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(
        wrapped.isNotNull()
        & F.try_variant_get(wrapped, "$[1]", "variant").isNull()
        & entry.isNotNull(),
        F.try_variant_get(wrapped, "$[0]", "variant"),
    )


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def kind_of(value: Column) -> Column:
    """JSON kind of a VARIANT: null, boolean, integer, number, string, array or object.

    25 and 25.0 are integers, as is a DOUBLE equal to its floor; 25.5 is a number.
    """

    def named(v: Column, name: Column) -> Column:
        return (
            F.when(name == "STRING", "string")
            .when(name.startswith("OBJECT"), "object")
            .when(name.startswith("ARRAY"), "array")
            .when(is_integer(v, name), "integer")
            .when(is_number(name), "number")
            .when(name == "BOOLEAN", "boolean")
            .when(name == "VOID", "null")
        )

    return bind(value, lambda v: bind(F.schema_of_variant(v), lambda name: named(v, name)))


def is_number(name: Column) -> Column:
    """Whether a VARIANT's type name is one of a number."""
    return name.rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)")


def is_integer(value: Column, name: Column) -> Column:
    """Whether a VARIANT of the given type name is a whole number."""
    fraction = F.when(is_number(name), bind(F.try_variant_get(value, "$", "double"), _whole))
    return name.rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$") | F.coalesce(fraction, F.lit(False))


def _whole(number: Column) -> Column:
    # A DOUBLE of 2**53 or more has no fraction, and may not fit the BIGINT of floor().
    large = F.abs(number) >= F.lit(float(2**53))
    return large | F.when(~large, number % 1 == 0)


def is_truthy(value: Column) -> Column:
    """Drops null, empty text, empty array, empty object, zero and false."""
    return F.coalesce(
        bind(value, lambda v: bind(kind_of(v), lambda kind: truthy_of(v, kind))), F.lit(False)
    )


def truthy_of(value: Column, kind: Column) -> Column:
    """``is_truthy`` of a VARIANT whose kind is known; NULL without a value."""
    filled = (
        F.when(kind == "string", F.try_variant_get(value, "$", "string") != "")
        .when(kind == "boolean", F.try_variant_get(value, "$", "boolean"))
        .when(kind.isin("integer", "number"), F.try_variant_get(value, "$", "double") != 0)
        .when(kind == "array", F.size(F.try_variant_get(value, "$", "array<variant>")) > 0)
        .when(kind == "object", F.size(F.try_variant_get(value, "$", "map<string,variant>")) > 0)
    )
    return F.coalesce(filled, F.lit(False))


def key_path(key: str) -> str:
    """Path of one object key, quoted so that any name is taken literally."""
    if '"' in key and "'" in key:
        raise ValueError(f"key holds both kinds of quotes: {key!r}")
    return f"$['{key}']" if '"' in key else f'$["{key}"]'


def object_field(value: Column, key: str) -> Column:
    """The VARIANT under a key; SQL NULL when the key is missing or the value no object."""
    return F.try_variant_get(value, key_path(key), "variant")


def field_text(value: Column) -> Column:
    """Text of a slot value: strings as they are, other kinds as JSON, JSON null as NULL."""
    return bind(value, lambda v: bind(kind_of(v), lambda kind: text_of(v, kind)))


def text_of(value: Column, kind: Column) -> Column:
    """``field_text`` of a VARIANT whose kind is known."""
    return F.when(kind == "string", F.try_variant_get(value, "$", "string")).when(
        kind != "null", F.to_json(value)
    )
