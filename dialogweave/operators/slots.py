"""Slot filling: updates, merging, and what is still open."""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dialogweave.fixed_values import ASK_ABOUT_TEXT, SLOT_BANK, Slot
from dialogweave.functions.jsontext import (
    bind,
    kind_of,
    object_field,
    parse_json_strict,
    text_of,
    truthy_of,
)
from dialogweave.operators.ordered import BLOCK_BITS, running_last


def project_known_slots(
    updates: DataFrame, slots: Sequence[Slot] = SLOT_BANK
) -> DataFrame:
    """Raw model output to one row per known slot.

    Text that is no JSON gives no rows; JSON that is no object gives one row with
    ``error`` set. Unknown keys are ignored and missing ones become NULL.
    """
    row = "array<struct<slot:string,value:string,truthy:boolean,error:string>>"
    nothing = F.lit(None)

    def entry(doc: Column, name: str) -> Column:
        def filled(field: Column, kind: Column) -> Column:
            return F.struct(
                F.lit(name), text_of(field, kind), truthy_of(field, kind), nothing
            )

        return bind(
            object_field(doc, name),
            lambda field: bind(kind_of(field), lambda kind: filled(field, kind)),
        )

    # A column of its own: parsed once and outside the interpreted lambdas.
    doc = F.col("_doc")
    failed = F.struct(nothing, nothing, F.lit(False), F.concat(F.lit("not an object: "), kind_of(doc)))
    found = (
        F.when(
            F.schema_of_variant(doc).startswith("OBJECT"),
            F.array(*[entry(doc, s.slot) for s in slots]).cast(row),
        )
        .when(doc.isNotNull(), F.array(failed).cast(row))
        .otherwise(F.array().cast(row))
    )
    return (
        updates.select("conversation_id", "seq", parse_json_strict(F.col("raw")).alias("_doc"))
        .select("conversation_id", "seq", F.explode(found).alias("_e"))
        .select("conversation_id", "seq", "_e.*")
    )


def _fills(updates: DataFrame, truthy: Optional[Column]) -> Column:
    """Whether an update counts; see ``merge_slots``."""
    if truthy is None and "truthy" in updates.columns:
        truthy = F.col("truthy")
    return F.col("value").isNotNull() & (F.col("value") != "") if truthy is None else truthy


def _slot_state(updates: DataFrame, slots: Sequence[Slot], truthy: Optional[Column]) -> DataFrame:
    """One row per conversation with one column ``v<i>`` per slot, combined map-side."""
    fills = _fills(updates, truthy)
    return updates.groupBy("conversation_id").agg(
        *[
            F.max_by(
                F.when((F.col("slot") == s.slot) & fills, F.col("value")),
                F.when((F.col("slot") == s.slot) & fills, F.col("seq")),
            ).alias(f"v{i}")
            for i, s in enumerate(slots)
        ]
    )


def merge_slots(
    updates: DataFrame, slots: Sequence[Slot] = SLOT_BANK, truthy: Optional[Column] = None
) -> DataFrame:
    """Last truthy value per slot and conversation; slots never filled are NULL.

    ``truthy`` says which updates count; by default the column of that name, as made by
    ``project_known_slots``, and without it non-empty text.
    """
    state = _slot_state(updates, slots, truthy)
    entries = F.array(
        *[
            F.struct(F.lit(i).alias("pos"), F.lit(s.slot).alias("slot"), F.col(f"v{i}").alias("value"))
            for i, s in enumerate(slots)
        ]
    )
    return state.select("conversation_id", F.explode(entries).alias("e")).select(
        "conversation_id", "e.*"
    )


def slot_maps(
    updates: DataFrame, slots: Sequence[Slot] = SLOT_BANK, truthy: Optional[Column] = None
) -> DataFrame:
    """The merged slots as one MAP per conversation."""
    state = _slot_state(updates, slots, truthy)
    pairs = [c for i, s in enumerate(slots) for c in (F.lit(s.slot), F.col(f"v{i}"))]
    return state.select("conversation_id", F.create_map(*pairs).alias("slots"))


def slots_before(
    updates: DataFrame,
    texts: DataFrame,
    slots: Sequence[Slot] = SLOT_BANK,
    truthy: Optional[Column] = None,
    bits: int = BLOCK_BITS,
) -> DataFrame:
    """(conversation_id, seq, text, slots) per row of ``texts``: the MAP of the slots as merged
    from the updates with a smaller ``seq``. Texts before any update have NULL slots.

    Updates and texts go through one shuffle by (conversation, block) as one sequence, so no
    conversation is joined or gathered as a whole.
    """
    value = F.when(_fills(updates, truthy), F.col("value"))
    none = F.lit(None).cast("string")
    given = updates.select("conversation_id", "seq", none.alias("text"), "slot", value.alias("value"), F.lit(False).alias("_asks"))
    asked = texts.select("conversation_id", "seq", "text", none.alias("slot"), none.alias("value"), F.lit(True).alias("_asks"))
    known = {f"v{i}": F.when(F.col("slot") == s.slot, F.col("value")) for i, s in enumerate(slots)}
    rows = running_last(given.union(asked), known, bits=bits).where("_asks")
    pairs = [c for i, s in enumerate(slots) for c in (F.lit(s.slot), F.col(f"v{i}"))]
    return rows.select("conversation_id", "seq", "text", F.create_map(*pairs).alias("slots"))


def _open_items(state_columns: Sequence[Column], items: Sequence[Column]) -> Column:
    """Items whose column is NULL, in order."""
    return F.filter(
        F.array(*[F.when(c.isNull(), item) for c, item in zip(state_columns, items)]),
        lambda x: x.isNotNull(),
    )


def slot_completeness(
    updates: DataFrame, slots: Sequence[Slot] = SLOT_BANK, truthy: Optional[Column] = None
) -> DataFrame:
    """Per conversation: next question, missing required slots, and whether it is complete.

    Optional slots are still asked, but only required ones decide completeness.
    """
    return completeness_columns(_slot_state(updates, slots, truthy), slots)


def completeness_columns(state: DataFrame, slots: Sequence[Slot]) -> DataFrame:
    """The completeness report over columns ``v0 .. vn`` of merged slot values."""
    values = [F.col(f"v{i}") for i in range(len(slots))]
    open_slots = _open_items(
        values,
        [F.struct(F.lit(s.slot).alias("slot"), F.lit(s.text).alias("text")) for s in slots],
    )
    required = [i for i, s in enumerate(slots) if s.required]
    missing = (
        _open_items([values[i] for i in required], [F.lit(slots[i].slot) for i in required])
        if required
        else F.array().cast("array<string>")
    )
    return state.select(
        "conversation_id",
        F.get(open_slots, F.lit(0))["slot"].alias("next_slot"),
        F.get(open_slots, F.lit(0))["text"].alias("next_text"),
        missing.alias("missing_required"),
        (F.size(missing) == 0).alias("complete"),
    )


def missing_required(
    updates: DataFrame, slots: Sequence[Slot] = SLOT_BANK, truthy: Optional[Column] = None
) -> DataFrame:
    """One row per conversation and required slot that is still empty, in bank order."""
    return (
        slot_completeness(updates, slots, truthy)
        .select("conversation_id", F.posexplode("missing_required").alias("n", "slot"))
    )


def next_unfilled(
    filled: DataFrame, items: Sequence[str], item: str = "slot", done_text: Optional[str] = None
) -> DataFrame:
    """First of the ordered items without a row in ``filled``, per conversation.

    One presence flag per item is combined map-side; nothing is crossed or collected.
    Conversations with nothing filled belong into ``filled`` with a NULL item.
    """
    flags = filled.groupBy("conversation_id").agg(
        *[
            F.max(F.when(F.col(item) == name, F.lit(True))).alias(f"f{i}")
            for i, name in enumerate(items)
        ]
    )
    first = F.get(
        _open_items([F.col(f"f{i}") for i in range(len(items))], [F.lit(n) for n in items]),
        F.lit(0),
    )
    result = flags.select("conversation_id", first.alias(f"next_{item}"))
    result = result.withColumn("done", F.col(f"next_{item}").isNull())
    if done_text is None:
        return result
    prompt = F.coalesce(F.concat(F.lit(ASK_ABOUT_TEXT), F.col(f"next_{item}")), F.lit(done_text))
    return result.withColumn("prompt", prompt)
