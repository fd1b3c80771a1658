"""Responder output: chunk assembly, generation speed, and batch inference."""

from __future__ import annotations

from typing import Callable, Iterator, Optional, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from dialogweave.functions.scalars import chunk_token, tokens_per_second
from dialogweave.operators.ordered import BLOCK_BITS, text_parts

RESPONSE_SCHEMA = "request_id string, content string, error string"
BatchResponder = Callable[[Sequence[list[dict]]], Sequence[Optional[str]]]


def assemble_response(chunks: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Response texts from their chunks, in order; see ``text_parts`` for ``part``."""
    return text_parts(
        chunks,
        chunk_token(F.col("message_content"), F.col("response")),
        "",
        key="response_id",
        order="chunk_idx",
        bits=bits,
        name="content",
    )


def generation_speed(chunks: DataFrame) -> DataFrame:
    """Tokens per second, from the closing chunk of each response."""
    return chunks.where("done").select(
        "response_id",
        tokens_per_second(F.col("eval_count"), F.col("eval_duration")).alias("tokens_per_second"),
    )


def respond(
    prompts: DataFrame,
    responder: BatchResponder,
    answered: Optional[DataFrame] = None,
) -> DataFrame:
    """One reply per prompt row (request_id, messages); ids already answered are skipped.

    ``responder`` gets a batch of message lists and returns one text per list. A failing
    batch is retried prompt by prompt, and a failing prompt becomes a row with ``error``
    instead of content, so one bad prompt never loses its neighbours.
    """
    if answered is not None:
        prompts = prompts.join(answered.select("request_id"), "request_id", "left_anti")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lists = [[dict(m) for m in messages] for messages in batch["messages"]]
            try:
                texts = list(responder(lists))
                if len(texts) != len(lists):
                    raise ValueError("responder returned a different number of replies")
                errors = [None] * len(texts)
            except Exception:
                texts, errors = [], []
                for one in lists:
                    try:
                        texts.append(list(responder([one]))[0])
                        errors.append(None)
                    except Exception as e:
                        texts.append(None)
                        errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame(
                {"request_id": batch["request_id"], "content": texts, "error": errors}
            )

    narrow = prompts.select(
        F.col("request_id").cast("string").alias("request_id"),
        F.transform(
            "messages", lambda m: F.create_map(F.lit("role"), m["role"], F.lit("content"), m["content"])
        ).alias("messages"),
    )
    return narrow.mapInPandas(ask, RESPONSE_SCHEMA)


def _with_prompt(prompts: DataFrame) -> DataFrame:
    """The prompts with a text id and a hash of what is asked."""
    asked = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return prompts.withColumns(
        {"request_id": F.col("request_id").cast("string"), "prompt": F.xxhash64(asked)}
    )


def respond_to_table(
    spark: SparkSession, prompts: DataFrame, responder: BatchResponder, path: str
) -> DataFrame:
    """Appends replies for unanswered prompts to a table; returns one row per request.

    A reply belongs to a request id and the prompt it was asked with, so a request whose
    prompt has changed is asked anew. The written table is what later steps read: replies
    are never computed twice, also when executors are lost, and a second run asks only for
    what is missing. Rows with an error do not count as answered; a later reply replaces them.
    """
    from dialogweave.sources.sinks import read_or_empty

    schema = f"{RESPONSE_SCHEMA}, prompt long"
    current = _with_prompt(prompts)
    keys = ["request_id", "prompt"]
    done = read_or_empty(spark, path, schema).where(F.col("error").isNull()).select(*keys)
    open_prompts = current.join(done, keys, "left_anti")
    # The responder sees ids that carry the hash, so that no second join is needed.
    marked = open_prompts.withColumn("request_id", F.concat_ws("#", "prompt", "request_id"))
    replies = respond(marked, responder).select(
        F.expr("substring(request_id, locate('#', request_id) + 1)").alias("request_id"),
        "content",
        "error",
        F.expr("cast(substring_index(request_id, '#', 1) as bigint)").alias("prompt"),
    )
    replies.write.mode("append").parquet(path)
    written = spark.read.schema(schema).parquet(path)
    best = F.max_by(F.struct("content", "error"), F.col("error").isNull()).alias("reply")
    return (
        written.join(current.select(*keys).distinct(), keys, "left_semi")
        .groupBy("request_id").agg(best).select("request_id", "reply.*")
    )
