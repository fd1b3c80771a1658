"""The stream processors' messages to the state server, counted on a state in memory."""

import random
from collections import Counter

import pytest
from pyspark.sql import Row

from dialogweave.plans import driver_queries
from dialogweave.streaming import dialogue
from dialogweave.streaming.sessions import _SessionReplay


class Memory:
    """State of one key behind the calls of a processor's handle."""

    def __init__(self, name, calls):
        self.name, self.calls, self.value, self.entries = name, calls, None, {}

    def _count(self):
        self.calls[self.name] += 1

    def get(self):
        self._count()
        return self.value

    def update(self, value):
        self._count()
        self.value = value

    def clear(self):
        self._count()
        self.value, self.entries = None, {}

    def containsKey(self, key):
        self._count()
        return key in self.entries

    def getValue(self, key):
        self._count()
        return self.entries.get(key)

    def updateValue(self, key, value):
        self._count()
        self.entries[key] = value

    def removeKey(self, key):
        self._count()
        self.entries.pop(key, None)

    def iterator(self):
        self._count()
        return iter(list(self.entries.items()))


class Handle:
    def __init__(self):
        self.calls, self.states = Counter(), {}

    def getValueState(self, name, *_):
        return self.states.setdefault(name, Memory(name, self.calls))

    getMapState = getListState = getValueState

    def registerTimer(self, _):
        self.calls["timer"] += 1


def begun(processor):
    handle = Handle()
    processor.init(handle)
    return handle


def event(seq, kind, question=None, text=None):
    return Row(seq=seq, ts=None, at=None, type=kind, question_id=question, text=text, reason=None)


SHOWN, GIVEN, END = "standard_question_shown", "standard_answer_given", "session_finished"


def test_a_session_writes_its_changes_once():
    processor = _SessionReplay()
    handle = begun(processor)
    wave = [event(2 * i, SHOWN, f"q{i}", "Q?") for i in range(4)] + [event(2 * i + 1, GIVEN, f"q{i}", "a") for i in range(4)]
    [out] = processor.handleInputRows(("s",), iter(wave), None)
    assert len(out.questions) == len(out.answers) == 4
    assert handle.calls == {"session": 2, "shown": 4, "answers": 4, "latest": 4}
    handle.calls.clear()
    assert list(processor.handleInputRows(("s",), iter(wave), None)) == []
    assert handle.calls["answers"] == 0  # repeated answers are the latest ones


@pytest.mark.parametrize("seed", range(30))
def test_any_cut_of_a_session_is_the_same(seed):
    r = random.Random(seed)
    events = [event(i, r.choice([SHOWN, GIVEN, GIVEN, END if r.random() < 0.2 else SHOWN]), f"q{r.randrange(3)}", str(i)) for i in range(25)]
    end = min((e.seq for e in events if e.type == END), default=99)
    live = [e for e in events if e.seq < end]
    first = {e.question_id: e for e in reversed(live) if e.type == SHOWN}
    last = {e.question_id: e for e in live if e.type == GIVEN}
    r.shuffle(events)
    processor = _SessionReplay()
    handle = begun(processor)
    while events:
        taken = events[: r.randint(1, 8)]
        events = events[len(taken) :]
        for out in processor.handleInputRows(("s",), iter(taken + taken[:1]), None):
            latest = out
    assert [(q.id, q.text) for q in latest.questions] == [(q, e.text) for q, e in sorted(first.items(), key=lambda x: x[1].seq)]
    assert [(a.question_id, a.answer) for a in latest.answers] == [(q, e.text) for q, e in sorted(last.items())]
    kept = {(e.question_id, e.seq) for e in live if e.type == GIVEN}
    assert set(handle.states["answers"].entries) == kept


def said(seq, mode, text, reply=False):
    return Row(seq=seq, mode=mode, text=text, error=None, is_reply=reply)


def test_a_reply_reads_no_inputs():
    processor = dialogue._Dialogue([("q1", "One?"), ("q2", "Two?")], dialogue.WORDING)
    handle = begun(processor)
    list(processor.handleInputRows(("c",), iter([said(1, "chat", "why"), said(2, "answer", "yes")]), None))
    handle.calls.clear()
    rows = list(processor.handleInputRows(("c",), iter([said(1, None, "so", reply=True)]), None))
    assert [r.content for r in rows] == ["so", "One?", "yes", "Two?"]
    assert handle.calls == {"progress": 2, "waiting": 2}
    handle.calls.clear()
    assert list(processor.handleInputRows(("c",), iter([said(1, None, "so", reply=True)]), None)) == []
    assert handle.calls == {"progress": 2}


def test_a_wave_is_landed_in_several_files_by_user(spark, tmp_path):
    events = spark.range(4000).selectExpr(
        "id as event_id", "timestamp_seconds(id) as ts", "id % 97 as user_id", "'view' as event_type", "'{}' as props"
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        stream = driver_queries._landed(spark, str(tmp_path), 2)
    finally:
        spark.conf.set(name, "true")
    query = stream.selectExpr("user_id", "event_id", "input_file_name() as f").writeStream.format("memory").queryName("landed").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [p.numInputRows for p in query.recentProgress if p.numInputRows] == [2000, 2000]
    rows = spark.table("landed").collect()
    home = {}
    for row in rows:
        home.setdefault((row.event_id < 2000, row.user_id), set()).add(row.f)
    assert len({f for files in home.values() for f in files}) > 2 and all(len(files) == 1 for files in home.values())
