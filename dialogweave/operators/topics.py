"""Topic progress: keyword rules applied to the first topic not yet completed."""

from __future__ import annotations

from itertools import takewhile
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from dialogweave.fixed_values import TOPIC_RULES, TopicRule
from dialogweave.functions.scalars import match_keywords
from dialogweave.operators.ordered import (
    BLOCK,
    BLOCK_BITS,
    Blocks,
    across_blocks,
    block_directory,
    blocks_of,
    with_block,
)

_STATE = "struct<state:int,at:array<bigint>,last:bigint>"


def _leading(rules: Sequence[TopicRule]) -> int:
    """Topics that can be completed; a rule that never completes stops all later ones."""
    return len(list(takewhile(lambda r: r.completes, rules)))


def keyword_hits(text: Column, rules: Sequence[TopicRule]) -> Column:
    """Bit ``i`` is set when a keyword of rule ``i`` occurs in the text."""
    hits = F.lit(0)
    for i, rule in enumerate(rules):
        hits = hits + F.when(match_keywords(text, rule.keywords), 1 << i).otherwise(0)
    return hits


def match_topics(messages: DataFrame, rules: Sequence[TopicRule] = TOPIC_RULES) -> DataFrame:
    """One row per message and topic whose keywords occur in it."""
    topics = F.array(
        *[F.when(match_keywords(F.col("content"), r.keywords), r.topic) for r in rules]
    )
    return messages.select(
        "conversation_id", "seq", F.explode(F.array_compact(topics)).alias("topic")
    )


def _run(entries: Column, entry: Column, stop: int) -> Column:
    """State after a block's matching messages, entered with ``entry`` topics completed.

    ``at`` lists the messages that completed a topic, ``last`` the last message matching
    the topic that never completes. A message counts for the topic open on its arrival.
    """
    initial = F.struct(
        entry.cast("int").alias("state"),
        F.array().cast("array<bigint>").alias("at"),
        F.lit(None).cast("bigint").alias("last"),
    )

    def step(acc: Column, e: Column) -> Column:
        completes = F.struct(
            (acc["state"] + 1).alias("state"),
            F.array_append(acc["at"], e["s"]).alias("at"),
            acc["last"].alias("last"),
        )
        repeats = F.struct(acc["state"].alias("state"), acc["at"].alias("at"), e["s"].alias("last"))
        hit = F.getbit(e["h"], acc["state"]) == 1
        return (
            F.when(hit & (acc["state"] < stop), completes.cast(_STATE))
            .when(hit, repeats.cast(_STATE))
            .otherwise(acc)
        )

    return F.aggregate(entries, initial.cast(_STATE), step)


def _block_runs(messages: DataFrame, rules: Sequence[TopicRule], blocks: Blocks) -> DataFrame:
    """Per (conversation, block): topics completed at entry, and what the block did.

    Only (seq, hit bits) of matching messages are grouped, one bounded block at a time. A
    block acts on the number of completed topics; for conversations of several blocks the
    number at each block's entry is found by one pass over the block directory per topic
    that can be completed.
    """
    stop = _leading(rules)
    key = "conversation_id"
    placed = messages.where(F.col(key).isNotNull() & F.col("seq").isNotNull())
    hits = with_block(
        placed.select(key, "seq", keyword_hits(F.col("content"), rules[: stop + 1]).alias("h")), blocks
    )
    entry_struct = F.when(F.col("h") > 0, F.struct(F.col("seq").alias("s"), F.col("h")))
    of_block = hits.groupBy(key, BLOCK).agg(F.array_sort(F.collect_list(entry_struct)).alias("_entries"))
    if blocks.single:
        return of_block.select(
            key, BLOCK, F.lit(0).alias("_entry"), _run(F.col("_entries"), F.lit(0), stop).alias("_ran")
        )
    entered = (
        of_block.join(block_directory(hits, key).select(key, BLOCK), [key, BLOCK])
        .select(
            key,
            BLOCK,
            F.array(
                *[_run(F.col("_entries"), F.lit(s), stop)["state"] for s in range(stop + 1)]
            ).alias("_exit"),
        )
        .withColumn("_entry", F.lit(0))
    )
    before = across_blocks(key).rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(stop):
        # Completed topics never decrease, so each pass settles at least one more change.
        reached = F.max(F.get(F.col("_exit"), F.col("_entry"))).over(before)
        entered = entered.withColumn("_entry", F.coalesce(reached, F.lit(0)))
    entry = F.coalesce(F.col("_entry"), F.lit(0))
    return of_block.join(entered.drop("_exit"), [key, BLOCK], "left").select(
        key, BLOCK, entry.alias("_entry"), _run(F.col("_entries"), entry, stop).alias("_ran")
    )


def topic_progress(
    messages: DataFrame, rules: Sequence[TopicRule] = TOPIC_RULES, bits: int = BLOCK_BITS
) -> DataFrame:
    """Per conversation: next topic, completed topics, and where they were completed."""
    key = "conversation_id"
    ran = (
        _block_runs(messages, rules, blocks_of(messages, bits=bits))
        .groupBy(key)
        .agg(
            F.array_sort(
                F.flatten(F.collect_list(F.when(F.size("_ran.at") > 0, F.col("_ran.at"))))
            ).alias("done_at"),
            F.max("_ran.last").alias("last_at"),
        )
    )
    topics = F.array(*[F.lit(r.topic) for r in rules])
    labels = F.array(*[F.lit(r.label) for r in rules])
    state = F.size("done_at")
    return ran.select(
        key,
        F.get(topics, state).alias("next_topic"),
        F.get(labels, state).alias("next_label"),
        F.slice(topics, F.lit(1), state).alias("completed"),
        "done_at",
        "last_at",
    )


def topic_answers(
    messages: DataFrame,
    progress: DataFrame,
    rules: Sequence[TopicRule] = TOPIC_RULES,
) -> DataFrame:
    """(conversation_id, topic, answer): the message kept for each topic, or its fixed text."""
    stop = _leading(rules)
    pointers = [
        F.struct(
            F.lit(rule.topic).alias("topic"),
            F.lit(rule.answer).cast("string").alias("fixed"),
            (F.get(F.col("done_at"), F.lit(i)) if i < stop else F.col("last_at")).alias("seq"),
        )
        for i, rule in enumerate(rules[: stop + 1])
    ]
    kept = (
        progress.select("conversation_id", F.explode(F.array(*pointers)).alias("p"))
        .select("conversation_id", "p.*")
        .where(F.col("seq").isNotNull())
    )
    return kept.join(
        messages.select("conversation_id", "seq", "content"), ["conversation_id", "seq"]
    ).select(
        "conversation_id", "topic", "seq", F.coalesce("fixed", "content").alias("answer")
    )


def topic_turns(
    messages: DataFrame, rules: Sequence[TopicRule] = TOPIC_RULES, bits: int = BLOCK_BITS
) -> DataFrame:
    """Per message: the open topic on its arrival and after it."""
    topics = F.array(*[F.lit(r.topic) for r in rules])
    seq = F.col("seq")
    blocks = blocks_of(messages, bits=bits)
    return (
        with_block(messages.select("conversation_id", "seq").where("seq is not null"), blocks)
        .join(_block_runs(messages, rules, blocks), ["conversation_id", BLOCK])
        .select(
            "conversation_id",
            "seq",
            _topic_at(topics, F.filter("_ran.at", lambda s: s < seq)).alias("topic_before"),
            _topic_at(topics, F.filter("_ran.at", lambda s: s <= seq)).alias("topic_after"),
        )
    )


def _topic_at(topics: Column, done_in_block: Column) -> Column:
    return F.get(topics, F.col("_entry") + F.size(done_in_block))
