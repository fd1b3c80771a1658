"""Live interviews with a responder that is asked outside the state: requests out, replies in.

The processor never calls a model. A side question becomes a request, with the prompt that the
batch operator would make; the conversation then waits, and inputs that arrive meanwhile are
queued. The batch responder answers a micro-batch's requests, its replies are landed as files of a
second source, and a reply resumes the conversation it belongs to.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections import deque
from typing import Iterator, Optional, Sequence

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from dialogweave.fixed_values import COMPLETION_TEXT, CONTEXT_TURNS, FRAME_MESSAGES, NONE_ANSWERED_TEXT
from dialogweave.model import CHAT_ENTRY
from dialogweave.operators.flow import classify_inputs
from dialogweave.operators.responses import BatchResponder, respond_to_table
from dialogweave.plans.prompts import WORDING
from dialogweave.streaming import placed, use_state_store
from dialogweave.streaming.interview import LATE

ROWS_OUT = (
    "conversation_id string, seq bigint, role string, content string, mode string, question_id string, "
    f"channel string, reask boolean, input_seq bigint, error string, request {CHAT_ENTRY}"
)
_COLUMNS = ("conversation_id", "seq", "role", "content", "mode", "question_id", "channel", "reask", "input_seq", "error", "request")
REPLIES = "conversation_id string, input_seq bigint, content string, error string"


def _range_of(ranges: list[list[int]], seq: int) -> int:
    """The place of the last range that begins at ``seq`` or before, -1 if there is none."""
    return bisect_right(ranges, seq, key=lambda r: r[0]) - 1


def _with_range(ranges: list[list[int]], seq: int) -> list[list[int]]:
    """Sorted ranges of numbers with one more, in place; neighbours grow together."""
    at = _range_of(ranges, seq)
    if at >= 0 and seq <= ranges[at][1]:
        return ranges
    follows = at >= 0 and ranges[at][1] + 1 == seq
    leads = at + 1 < len(ranges) and ranges[at + 1][0] == seq + 1
    if follows:
        ranges[at][1] = ranges.pop(at + 1)[1] if leads else seq
    elif leads:
        ranges[at + 1][0] = seq
    else:
        ranges.insert(at + 1, [seq, seq])
    return ranges


class _Conversation:
    """What a conversation's state holds, while its rows of a micro-batch are handled."""

    def __init__(self, flow, words: dict[str, str], stored, taken, waiting):
        self.flow, self.words = flow, words
        values = tuple(stored) if stored else (None, 0, 0, False, "{}", None, "[]", False)
        self.last, self.number, self.index, self.ended = values[:4]
        self.answers, self.pending = json.loads(values[4]), values[5]
        self.recent = [tuple(m) for m in json.loads(values[6])]
        self.taken, self.waiting = taken, deque(waiting)
        self.out: list[Row] = []

    def say(self, cause: int, role: str, content: Optional[str], mode=None, question=None, channel=None, reask=None, error=None) -> None:
        self.out.append((self.number, role, content, mode, question, channel, reask, cause, error, None))
        self.recent = [*self.recent, (role, content, mode)][-FRAME_MESSAGES:]
        self.number += 1

    def ask(self, cause: int, reask: bool = False) -> None:
        if self.index >= len(self.flow):
            self.say(cause, "system", COMPLETION_TEXT)
            self.ended = True
            return
        question, text = self.flow[self.index]
        place = (None, True) if reask else ("questionnaire", None)
        self.say(cause, "system", text, None, question, *place)

    def prompt(self, text: str) -> list[tuple[str, str]]:
        words, (question, asked) = self.words, self.flow[self.index]
        lines = "\n".join(f"- {q} -> {self.answers[i]}" for i, q in self.flow if i in self.answers)
        opened = words["chat_current"].replace("{id}", question).replace("{text}", asked)
        situation = "\n".join([opened, words["chat_answered"], lines or NONE_ANSWERED_TEXT])
        turns = [
            ("user" if role == "patient" else "assistant", content)
            for role, content, mode in self.recent
            if mode == "chat" and role in ("patient", "assistant")
            and not (role == "patient" and (content or "").strip() == text.strip())
        ]
        return [("system", words["chat_system"]), ("system", situation), *turns[-CONTEXT_TURNS:], ("user", text)]

    def take(self, seq: int, mode: str, text: str) -> None:
        if self.ended:
            return
        if mode == "quit":
            self.ended = True
        elif mode == "chat":
            self.say(seq, "patient", text, "chat")
            if self.index >= len(self.flow):
                self.ended = True
                return
            self.pending = seq
            self.out.append((self.number - 1, None, None, None, None, None, None, seq, None, self.prompt(text)))
        else:
            if self.index < len(self.flow):
                self.answers[self.flow[self.index][0]] = text
            self.index += 1
            self.say(seq, "patient", text, "answer")
            self.ask(seq)

    def resume(self, seq: int, content: Optional[str], error: Optional[str]) -> None:
        """A reply; one to a question that is not the open one was taken before."""
        if self.pending != seq:
            return
        self.pending = None
        self.say(seq, "assistant", content, "chat", error=error)
        self.ask(seq, reask=True)
        while self.waiting and self.pending is None:
            self.take(*self.waiting.popleft())

    def accept(self, seq: int, mode: str, text: str) -> None:
        at = _range_of(self.taken, seq)
        if at >= 0 and seq <= self.taken[at][1]:
            return
        late = self.last is not None and seq < self.last
        self.taken = _with_range(self.taken, seq)
        if late:
            self.out.append((None, None, text, None, None, None, None, seq, LATE, None))
            return
        if self.last is None:
            self.ask(seq)
        self.last = seq
        if self.pending is None:
            self.take(seq, mode, text)
        elif not self.ended:
            self.waiting.append((seq, mode, text))

    def state(self) -> tuple:
        return (
            self.last, self.number, self.index, self.ended, json.dumps(self.answers), self.pending, json.dumps(self.recent),
            bool(self.waiting),
        )


class _Dialogue(StatefulProcessor):
    """State per conversation: progress with the answers (bounded by the flow) and the last
    ``FRAME_MESSAGES`` messages, the inputs queued behind an open request, and which inputs were
    taken, as ranges of their numbers. Every access is a message to the state server: the queue is
    read only where there is one, what was taken only if inputs come, not for replies."""

    def __init__(self, flow: Sequence[tuple[str, str]], words: dict[str, str]):
        self._flow, self._words = flow, words

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._progress = handle.getValueState(
            "progress",
            "last bigint, number bigint, index bigint, ended boolean, answers string, pending bigint, recent string, queued boolean",
        )
        self._taken = handle.getValueState("taken", "ranges string")
        self._waiting = handle.getValueState("waiting", "inputs string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Replies first: they belong to inputs of earlier micro-batches.
        rows = sorted(rows, key=lambda r: (not r.is_reply, r.seq))
        stored = self._progress.get()
        inputs = not rows[-1].is_reply
        taken = self._taken.get() if stored and inputs else None
        queued = json.loads(self._waiting.get()[0]) if stored and stored[7] else []
        talk = _Conversation(self._flow, self._words, stored, json.loads(taken[0]) if taken else [], queued)
        for row in rows:
            if row.is_reply:
                talk.resume(row.seq, row.text, row.error)
            else:
                talk.accept(row.seq, row.mode, row.text)
        self._progress.update(talk.state())
        if inputs:
            self._taken.update((json.dumps(talk.taken),))
        waiting = [list(w) for w in talk.waiting]
        if waiting and waiting != queued:
            self._waiting.update((json.dumps(waiting),))
        elif queued and not waiting:
            self._waiting.clear()
        for row in talk.out:
            yield Row(*_COLUMNS)(key[0], *row)

    def close(self) -> None:
        pass


def stream_dialogue(
    inputs: DataFrame, replies: DataFrame, flow: Sequence[tuple[str, str]], wording: Optional[dict[str, str]] = None
) -> DataFrame:
    """Messages and requests per conversation, from streams of inputs and of replies.

    inputs(conversation_id, seq, raw_text); replies(conversation_id, input_seq, content, error)
    answer requests made before. A message has a ``role``; a request has ``request``, the prompt,
    the ``seq`` of the message it is about and the ``input_seq`` that a reply has to name. While
    a request is open, the conversation's further inputs wait. A repeated input or reply is
    skipped; an input behind a later one becomes a row without ``seq`` with ``error`` LATE.
    """
    use_state_store(inputs.sparkSession)
    none = F.lit(None).cast("string")
    asked = classify_inputs(placed(inputs, "conversation_id")).select(
        F.col("conversation_id").cast("string").alias("conversation_id"), "seq", "mode", "text",
        none.alias("error"), F.lit(False).alias("is_reply"),
    )
    answered = replies.where("conversation_id is not null and input_seq is not null").select(
        "conversation_id", F.col("input_seq").alias("seq"), none.alias("mode"), F.col("content").alias("text"),
        "error", F.lit(True).alias("is_reply"),
    )
    return asked.union(answered).groupBy("conversation_id").transformWithState(
        statefulProcessor=_Dialogue(list(flow), {**WORDING, **(wording or {})}),
        outputStructType=ROWS_OUT,
        outputMode="Append",
        timeMode="None",
    )


def run_dialogue(
    spark: SparkSession,
    inputs: DataFrame,
    flow: Sequence[tuple[str, str]],
    responder: BatchResponder,
    folder: str,
    wording: Optional[dict[str, str]] = None,
) -> DataFrame:
    """Runs a dialogue over the inputs that are there until no request is open; returns all rows.

    Each micro-batch's rows are written under its number, its requests are answered by the batch
    responder into a table that is never asked twice, and the replies are landed before the
    micro-batch ends, so that the next one takes them. The query stops when neither inputs nor
    replies are left. ``folder`` keeps rows, replies and the checkpoint, so a run that dies goes
    on where it was.
    """
    spark.createDataFrame([], REPLIES).write.mode("append").parquet(f"{folder}/replies/start")
    landed = (
        spark.readStream.schema(REPLIES).option("recursiveFileLookup", "true").parquet(f"{folder}/replies")
    )

    def store(batch: DataFrame, number: int) -> None:
        place = f"{folder}/rows/batch={number}"
        batch.write.mode("overwrite").parquet(place)
        asked = spark.read.schema(batch.schema).parquet(place).where("request is not null").select(
            F.concat_ws(":", "conversation_id", "seq").alias("request_id"), "conversation_id", "input_seq",
            F.col("request").alias("messages"),
        )
        if asked.isEmpty():
            return
        said = respond_to_table(spark, asked, responder, f"{folder}/responses")
        back = asked.drop("messages").join(said, "request_id").select("conversation_id", "input_seq", "content", "error")
        back.write.mode("overwrite").parquet(f"{folder}/replies/batch{number}")

    rows = stream_dialogue(inputs, landed, flow, wording)
    query = (
        rows.writeStream.outputMode("append").foreachBatch(store)
        .option("checkpointLocation", f"{folder}/checkpoint").start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(T.StructType([*rows.schema, T.StructField("batch", T.LongType())])).parquet(f"{folder}/rows")
