"""Open items of a bank that is a table: slots, questions or topics, of any number.

A conversation's filled items are bits, 64 positions to a word, combined map-side. What is open
follows from the words of the item table by bit arithmetic; no conversation is crossed with the
items, and an item's text is joined only where it is asked for.

An item table has ``pos`` (0 and up, each once), the item's name and ``required``. Several banks,
such as the versions of a flow, are told apart by ``bank`` columns that the filled rows have too.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

WORD = 64


def _bit(pos: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(pos, F.lit(WORD)).cast("int"))


def item_words(items: DataFrame, bank: Sequence[str] = ()) -> DataFrame:
    """(bank, _word, _all, _required): the items of each 64 positions as bits."""
    bit = _bit(F.col("pos"))
    return items.groupBy(*bank, F.floor(F.col("pos") / WORD).cast("int").alias("_word")).agg(
        F.bit_or(bit).alias("_all"), F.bit_or(F.when(F.col("required"), bit).otherwise(F.lit(0).cast("bigint"))).alias("_required")
    )


def open_bits(
    filled: DataFrame, items: DataFrame, item: str = "slot", bank: Sequence[str] = (), key: str = "conversation_id"
) -> DataFrame:
    """(key, bank, _word, _open, _missing): open items and open required ones, as bits, one row
    per conversation and word.

    ``filled`` has a row per filled item, and at least one, with a NULL item, for conversations
    without any. Items that the bank lacks fill nothing.
    """
    places = items.select(*bank, F.col(item), F.col("pos"))
    found = filled.select(key, *bank, item).join(places, [*bank, item], "left")
    present = found.groupBy(key, *bank, F.floor(F.coalesce(F.col("pos"), F.lit(0)) / WORD).cast("int").alias("_word")).agg(
        F.bit_or(F.when(F.col("pos").isNull(), F.lit(0).cast("bigint")).otherwise(_bit(F.col("pos")))).alias("_bits")
    )
    largest = items.agg(F.max("pos")).first()[0]
    words = 0 if largest is None else largest // WORD + 1
    if words > 1:  # words in which nothing is filled have to be there too
        every = present.select(key, *bank).distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(words - 1))).alias("_word"))
        present = every.join(present, [key, *bank, "_word"], "left")
    bits = F.coalesce("_bits", F.lit(0).cast("bigint"))
    return present.join(item_words(items, bank), [*bank, "_word"], "left").select(
        key, *bank, "_word",
        F.coalesce(F.col("_all").bitwiseAND(F.bitwise_not(bits)), F.lit(0).cast("bigint")).alias("_open"),
        F.coalesce(F.col("_required").bitwiseAND(F.bitwise_not(bits)), F.lit(0).cast("bigint")).alias("_missing"),
    )


def _lowest(bits: Column) -> Column:
    """Place of the lowest bit set: the ones below it, counted."""
    return F.bit_count(F.bitwise_not(bits).bitwiseAND(F.call_function("try_subtract", bits, F.lit(1).cast("bigint")))).cast("int")


def item_progress(
    filled: DataFrame, items: DataFrame, item: str = "slot", bank: Sequence[str] = (), key: str = "conversation_id"
) -> DataFrame:
    """Per conversation: ``next_<item>`` (the first open one, required or not, NULL if none),
    ``n_open``, ``n_missing`` (open required ones), ``done`` (nothing open) and ``complete``
    (nothing required open)."""
    first = F.min(F.when(F.col("_open") != 0, F.col("_word") * WORD + _lowest_any(F.col("_open"))))
    progress = open_bits(filled, items, item, bank, key).groupBy(key, *bank).agg(
        first.alias("pos"), F.sum(F.bit_count("_open")).cast("int").alias("n_open"),
        F.sum(F.bit_count("_missing")).cast("int").alias("n_missing"),
    )
    named = items.select(*bank, "pos", F.col(item).alias(f"next_{item}"))
    return progress.join(named, [*bank, "pos"], "left").select(
        key, *bank, f"next_{item}", "n_open", "n_missing",
        (F.col("n_open") == 0).alias("done"), (F.col("n_missing") == 0).alias("complete"),
    )


def _lowest_any(bits: Column) -> Column:
    """``_lowest``, also where only the sign bit is set and less one would overflow."""
    return F.when(bits == F.lit(-(1 << 63)), F.lit(63)).otherwise(_lowest(bits))


def missing_items(
    filled: DataFrame, items: DataFrame, item: str = "slot", bank: Sequence[str] = (), key: str = "conversation_id"
) -> DataFrame:
    """(key, bank, pos, item) for every open required item."""
    bits = open_bits(filled, items, item, bank, key).where("_missing <> 0")
    places = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.getbit(F.col("_missing"), b) == 1)
    rows = bits.select(key, *bank, "_word", F.explode(places).alias("_b"))
    return (
        rows.withColumn("pos", (F.col("_word") * WORD + F.col("_b")).cast("int"))
        .join(items.select(*bank, F.col("pos").cast("int").alias("pos"), item), [*bank, "pos"])
        .select(key, *bank, "pos", item)
    )
