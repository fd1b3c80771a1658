"""Incremental session replay over landing log files."""

from __future__ import annotations

from typing import Iterator, Optional

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from dialogweave.model import LOG_LINE_SCHEMA, SESSION_EVENT_COLUMNS
from dialogweave.operators.sessions import TERMINAL
from dialogweave.sources.logs import event_columns
from dialogweave.streaming import placed, use_state_store

SNAPSHOT_SCHEMA = (
    "session_id string, status string, reason string, created_at timestamp, "
    "questions array<struct<id:string,text:string>>, "
    "answers array<struct<question_id:string,answer:string>>, last_seq bigint, version bigint"
)


def stream_session_log(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Session events from a folder of JSON-lines files, each read once as it lands.

    Lines appended to a file already read are not seen; producers land new files, with
    ``seq`` in every line. ``files_per_batch`` bounds a micro-batch. A malformed line has its
    text in ``corrupt`` and no session (see ``unplaced``).
    """
    lines = (
        spark.readStream.schema(LOG_LINE_SCHEMA)
        .option("columnNameOfCorruptRecord", "corrupt")
        .option("maxFilesPerTrigger", files_per_batch)
        .json(path)
    )
    return lines.select("seq", *event_columns(F.col)).select(*SESSION_EVENT_COLUMNS, "corrupt")


#: By how much event time an event may come late (see ``stream_sessions``).
KEEP = "7 days"


class _Replayed:
    """What is known of a session while its rows of a micro-batch are handled.

    Holds the entries per question and the answers of this micro-batch. Of the answers stored
    before, single keys are looked up, and all are read only where an end arrives late."""

    def __init__(self, shown: dict[str, tuple], latest: dict[str, tuple], answers=None):
        self.shown, self.latest, self.added = shown, latest, {}
        self._stored = answers
        self.removed: set[tuple[str, int]] = set()

    def show(self, question: str, seq: int, text: Optional[str]) -> bool:
        if question in self.shown and self.shown[question][0] <= seq:
            return False
        self.shown[question] = (seq, text)
        return True

    def answer(self, question: str, seq: int, text: Optional[str]) -> bool:
        newer = question not in self.latest or self.latest[question][0] < seq
        if not newer and self._known((question, seq)):
            return False
        self.added[question, seq] = text
        if newer:
            self.latest[question] = (seq, text)
        return True

    def _known(self, key: tuple[str, int]) -> bool:
        if key in self.added or self.latest[key[0]][0] == key[1]:
            return True
        return self._stored is not None and key not in self.removed and self._stored.containsKey(key)

    def cut(self, end: int) -> None:
        """Takes back what lies behind the end."""
        self.shown = {question: first for question, first in self.shown.items() if first[0] < end}
        if all(last[0] < end for last in self.latest.values()):
            return
        self.added = {key: text for key, text in self.added.items() if key[1] < end}
        left = [(*key, text) for key, text in self.added.items()]
        for (question, seq), (text,) in self._stored.iterator() if self._stored is not None else ():
            if seq >= end:
                self.removed.add((question, seq))
            else:
                left.append((question, seq, text))
        self.latest = {}
        for question, seq, text in left:
            if question not in self.latest or self.latest[question][0] < seq:
                self.latest[question] = (seq, text)


def _store_changes(state, before: dict[str, tuple], after: dict[str, tuple]) -> None:
    for question in before.keys() - after.keys():
        state.removeKey((question,))
    for question, entry in after.items():
        if before.get(question) != entry:
            state.updateValue((question,), entry)


class _SessionReplay(StatefulProcessor):
    """The state of a session, one entry per question and per answer; a micro-batch writes the
    entries that its events change and no others, each once. Every access is a message to the
    state server, so a session that begins reads nothing but that it is not there.

    The state does not depend on the order of arrival: per question the first showing and
    all answers by ``seq``, and the first terminal event, behind which nothing counts. All
    answers are kept, as an end that arrives late may lie before some of them, until the
    watermark has passed the end: a timer then clears the session. What comes for it later is
    behind the watermark too and does not reach the state.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._session = handle.getValueState(
            "session", "last_seq bigint, end_seq bigint, status string, reason string, ended timestamp, version bigint"
        )
        self._shown = handle.getMapState("shown", "question_id string", "seq bigint, text string")
        self._answers = handle.getMapState("answers", "question_id string, seq bigint", "text string")
        self._latest = handle.getMapState("latest", "question_id string", "seq bigint, text string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        stored = self._session.get()
        last, end, status, reason, ended, version = tuple(stored) if stored else (None, None, "open", None, None, 0)
        shown, latest = ({}, {}) if stored is None else (
            {question[0]: tuple(entry) for question, entry in state.iterator()} for state in (self._shown, self._latest)
        )
        known = _Replayed(dict(shown), dict(latest), None if stored is None else self._answers)
        before, changed = last, stored is None
        for row in rows:
            last = row.seq if last is None else max(last, row.seq)
            if end is not None and row.seq >= end:
                continue
            if row.type in TERMINAL:
                if row.at is not None:
                    self._handle.registerTimer(row.at + 1)
                end, status, reason = row.seq, row.type.removeprefix("session_"), row.reason
                ended = row.ts if status == "finished" else None
                known.cut(end)
                changed = True
            elif row.question_id is None:
                continue
            elif row.type == "standard_question_shown":
                changed |= known.show(row.question_id, row.seq, row.text)
            elif row.type == "standard_answer_given":
                changed |= known.answer(row.question_id, row.seq, row.text)
        if not changed and last == before:
            return
        version += 1
        self._session.update((last, end, status, reason, ended, version))
        _store_changes(self._shown, shown, known.shown)
        _store_changes(self._latest, latest, known.latest)
        for place in known.removed:
            self._answers.removeKey(place)
        for place, text in known.added.items():
            self._answers.updateValue(place, (text,))
        yield Row(
            session_id=key[0],
            status=status,
            reason=reason,
            created_at=ended,
            questions=[Row(id=q, text=text) for _, q, text in sorted((seq, q, text) for q, (seq, text) in known.shown.items())],
            answers=[Row(question_id=q, answer=known.latest[q][1]) for q in sorted(known.latest)],
            last_seq=last,
            version=version,
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for state in (self._session, self._shown, self._answers, self._latest):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_sessions(events: DataFrame, keep: str = KEEP) -> DataFrame:
    """Snapshots per session, one row whenever a micro-batch brings new events for it.

    Each row replaces the session's earlier ones; the highest ``version`` is current. The
    order in which events arrive does not matter, and a repeated event changes nothing.
    Events without session or ``seq`` are left out (see ``unplaced``).

    Event time ends the state: ``keep`` behind the latest event seen, an ended session is cleared,
    and events older than that are left out. It has to cover how far apart in time the events
    of one micro-batch and the next may lie. Events without time are never late.
    """
    use_state_store(events.sparkSession)
    narrow = placed(events, "session_id").select(
        F.col("session_id").cast("string").alias("session_id"),
        "seq", "ts", F.unix_millis("ts").alias("at"), "type", "question_id", "text", "reason",
    ).withWatermark("ts", keep)
    return narrow.groupBy("session_id").transformWithState(
        statefulProcessor=_SessionReplay(),
        outputStructType=SNAPSHOT_SCHEMA,
        outputMode="Update",
        timeMode="EventTime",
    )
