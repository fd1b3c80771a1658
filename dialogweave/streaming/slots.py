"""Incremental slot filling."""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import Column, DataFrame

from dialogweave.fixed_values import SLOT_BANK, Slot
from dialogweave.operators.slots import slot_completeness, slot_maps


def stream_slots(
    updates: DataFrame, slots: Sequence[Slot] = SLOT_BANK, truthy: Optional[Column] = None
) -> DataFrame:
    """Slot values per conversation, updated as updates arrive (output mode ``update``).

    One built-in streaming aggregate: updates are combined map-side before the shuffle and
    the state holds one value per slot. Replayed rows change nothing, as the value with
    the highest ``seq`` stays.
    """
    return slot_maps(updates, slots, truthy)


def stream_slot_completeness(
    updates: DataFrame, slots: Sequence[Slot] = SLOT_BANK, truthy: Optional[Column] = None
) -> DataFrame:
    """Next slot, missing required slots and completeness, updated as updates arrive."""
    return slot_completeness(updates, slots, truthy)
