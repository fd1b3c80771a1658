"""Incremental interviews: inputs in, transcript messages out."""

from __future__ import annotations

import json
from typing import Callable, Iterator, Optional, Sequence

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from dialogweave.fixed_values import COMPLETION_TEXT, NO_RESPONDER_TEXT
from dialogweave.operators.flow import classify_inputs
from dialogweave.streaming import placed, use_state_store

MESSAGES_OUT = (
    "conversation_id string, seq bigint, role string, content string, mode string, "
    "question_id string, channel string, reask boolean, input_seq bigint, error string"
)
LATE = "late input"
COLUMNS = [c.split()[0] for c in MESSAGES_OUT.split(", ")]
Reply = Callable[[str, str, Sequence[tuple[str, str]]], str]


class _Interview(StatefulProcessor):
    """Keeps, per conversation: last input, next output number, question index, end flag, answers.

    One state value, read and written once per micro-batch; the answers are bounded by the
    flow and kept as JSON text. The numbers of the inputs are a list that only grows and is
    read when an input is not newer than the last, to tell a replay from a late input.
    """

    def __init__(self, flow, reply: Optional[Reply], completion: str, notice: str):
        self._flow, self._reply = flow, reply
        self._completion, self._notice = completion, notice

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._progress = handle.getValueState(
            "progress",
            "last_input bigint, next_seq bigint, question_index bigint, ended boolean, answers string",
        )
        self._taken = handle.getListState("taken", "seq bigint")

    def _ask(self, index: int, reask: bool = False) -> tuple:
        if index >= len(self._flow):
            return ("system", self._completion, None, None, None, None, None)
        qid, text = self._flow[index]
        place = (None, True) if reask else ("questionnaire", None)
        return ("system", text, None, qid, *place, None)

    def _chat(self, text: str, index: int, answers: dict[str, str]) -> list[tuple]:
        question = ("patient", text, "chat", None, None, None, None)
        if self._reply is None:
            notice = ("assistant", self._notice, None, None, None, None, None)
            return [question, notice, self._ask(index)]
        if index >= len(self._flow):
            return [question]
        content = error = None
        try:
            so_far = [(asked, answers[qid]) for qid, asked in self._flow if qid in answers]
            content = self._reply(text, self._flow[index][1], so_far)
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
        answer = ("assistant", content, "chat", None, None, None, error)
        return [question, answer, self._ask(index, reask=True)]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        out, late, fresh, earlier = [], [], {}, None
        stored = self._progress.get()
        if stored:
            last, number, index, ended = tuple(stored[:4])
            answers = json.loads(stored[4])
        else:
            last, number, index, ended, answers = None, 0, 0, False, {}
            out.append((self._ask(0), None))
        for row in sorted(rows, key=lambda r: r.seq):
            if last is not None and row.seq <= last:
                if earlier is None:
                    earlier = {taken[0] for taken in self._taken.get()} if stored else set()
                if row.seq not in earlier and row.seq not in fresh:
                    late.append(row)
                    fresh[row.seq] = True
                continue
            fresh[row.seq] = True
            if out and last is None:
                out[0] = (out[0][0], row.seq)
            last = row.seq
            if ended:
                continue
            if row.mode == "quit":
                ended = True
            elif row.mode == "chat":
                out += [(m, last) for m in self._chat(row.text, index, answers)]
                ended = index >= len(self._flow)
            else:
                if index < len(self._flow):
                    answers[self._flow[index][0]] = row.text
                index += 1
                out.append((("patient", row.text, "answer", None, None, None, None), last))
                out.append((self._ask(index), last))
                ended = index >= len(self._flow)
        self._progress.update((last, number + len(out), index, ended, json.dumps(answers)))
        if fresh:
            self._taken.appendList([(seq,) for seq in fresh])
        for i, (message, cause) in enumerate(out):
            yield Row(*COLUMNS)(key[0], number + i, *message[:6], cause, message[6])
        for row in late:
            yield Row(*COLUMNS)(key[0], None, None, row.text, *[None] * 4, row.seq, LATE)

    def close(self) -> None:
        pass


def stream_interview(
    inputs: DataFrame,
    flow: Sequence[tuple[str, str]],
    reply: Optional[Reply] = None,
    completion_text: str = COMPLETION_TEXT,
    notice_text: str = NO_RESPONDER_TEXT,
) -> DataFrame:
    """Transcript messages per conversation, emitted as inputs arrive (output mode append).

    ``flow`` lists (question id, text) in order and ``reply(text, question, answered)``
    answers a chat. Inputs are classified before the shuffle. Arrival order rules between
    micro-batches, ``seq`` within one. An input that was taken before is skipped as a replay.
    One that arrives behind a later input cannot change what was said since: it becomes a
    row without ``seq`` and role, with ``error`` LATE, its text and ``input_seq``. Inputs
    without conversation or ``seq`` are left out (see ``unplaced``). The source's rate limit
    bounds what one conversation brings to a task at a time.
    """
    use_state_store(inputs.sparkSession)
    classified = classify_inputs(placed(inputs, "conversation_id")).withColumn(
        "conversation_id", F.col("conversation_id").cast("string")
    )
    return classified.groupBy("conversation_id").transformWithState(
        statefulProcessor=_Interview(list(flow), reply, completion_text, notice_text),
        outputStructType=MESSAGES_OUT,
        outputMode="Append",
        timeMode="None",
    )
