import json

import pytest
from pyspark.sql import functions as F

from dialogweave.operators import sessions
from dialogweave.sources import flows, keyed, logs, sinks


def write(path, name, text):
    path.mkdir(exist_ok=True)
    (path / name).write_text(text, encoding="utf-8")
    return str(path)


def test_flow_object_form_and_defaults(spark, tmp_path):
    doc = {
        "language": "da",
        "questions": [
            {"id": "q2", "text": "Højde?", "type": "number", "required": False, "help_prompt": "cm",
             "choices": ["a", "b"], "validation": {"min": 1}},
            {"id": "q1", "text": "Navn?"},
            {"id": "q1", "text": "Navn igen?", "help_prompt": None, "validation": None},
        ],
    }
    rows = flows.load_question_flow(spark, write(tmp_path / "f", "flow.json", json.dumps(doc))).orderBy("pos").collect()
    assert [(r.pos, r.id, r.text) for r in rows] == [(0, "q2", "Højde?"), (1, "q1", "Navn?"), (2, "q1", "Navn igen?")]
    assert (rows[0].type, rows[0].required, rows[0].help_prompt, rows[0].choices) == ("number", False, "cm", ["a", "b"])
    assert json.loads(rows[0].validation) == {"min": 1}
    for r in rows[1:]:
        assert (r.type, r.required, r.help_prompt, r.choices, r.validation) == ("free_text", True, None, None, None)


def test_flow_bare_list(spark, tmp_path):
    path = write(tmp_path / "f", "flow.json", '[{"id":"a","text":"A?"}]')
    assert [r.id for r in flows.load_question_flow(spark, path).collect()] == ["a"]


@pytest.mark.parametrize(
    "doc", ['[{"id":"a","text":"A?","color":1}]', '[{"id":"a"}]', '{"items":[]}', "junk"]
)
def test_flow_errors(spark, tmp_path, doc):
    with pytest.raises(Exception):
        flows.load_question_flow(spark, write(tmp_path / "f", "flow.json", doc)).collect()


EPOCH_LOG = [
    {"ts": 1700000000, "type": "session_started", "sessionId": "s1", "meta": {"ollamaModel": "m1", "ollamaUrl": "u1", "questionsFile": "x.json"}},
    {"ts": 1700000001, "type": "standard_question_shown", "sessionId": "s1", "questionId": "q1", "text": "Hvor gammel er du?"},
    {"ts": 1700000002, "type": "command_used", "sessionId": "s1", "command": "/chat", "context": {"questionId": "q1"}},
    {"ts": 1700000003, "type": "chat", "sessionId": "s1", "questionId": "chat", "text": {"role": "user", "content": "hvorfor æøå"}},
    {"ts": 1700000004, "type": "standard_answer_given", "sessionId": "s1", "questionId": "q1", "text": ""},
    {"ts": 1700000005, "type": "standard_question_shown", "sessionId": "s1", "questionId": "q2", "text": "Ryger du?"},
    {"ts": 1700000006, "type": "standard_answer_given", "sessionId": "s1", "questionId": "q2", "text": "/next"},
    {"ts": 1700000007, "type": "session_finished", "sessionId": "s1"},
]
ISO_LOG = [
    {"ts": "2024-02-03T04:05:06.000007+00:00", "type": "session_started", "sessionId": "s2", "meta": {}},
    {"ts": "2024-02-03T04:05:07+00:00", "type": "standard_question_shown", "sessionId": "s2", "questionId": "q1", "text": "Navn?"},
    {"ts": "2024-02-03T04:05:08+00:00", "type": "standard_answer_skipped", "sessionId": "s2", "questionId": "q1", "text": ""},
    {"ts": "2024-02-03T04:05:09+00:00", "type": "command_used", "sessionId": "s2", "command": "/chat", "context": {"phase": "after_questions"}},
    {"ts": "2024-02-03T04:05:10+00:00", "type": "patient_chat_question", "sessionId": "s2", "text": "og så?"},
    {"ts": "2024-02-03T04:05:11+00:00", "type": "session_aborted", "sessionId": "s2", "reason": "user_quit_in_chat"},
]
OPEN_LOG = [{"ts": 1700000000, "type": "standard_question_shown", "sessionId": "s3", "questionId": "q1", "text": "Navn?"}]


def log_folder(tmp_path):
    folder = tmp_path / "runs"
    for name, events in (("s1", EPOCH_LOG), ("s2", ISO_LOG), ("s3", OPEN_LOG)):
        text = "".join(json.dumps(e, ensure_ascii=False) + "\n" for e in events)
        write(folder, f"{name}.jsonl", text + ("\n" if name == "s3" else ""))
    return str(folder)


@pytest.mark.parametrize("split", [None, "200"])
def test_logs_to_snapshots(spark, tmp_path, split):
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        events = logs.read_session_log(spark, log_folder(tmp_path))
        rows = events.orderBy("session_id", "seq").collect()
        assert [r.type for r in rows] == [e["type"] for e in EPOCH_LOG + ISO_LOG + OPEN_LOG]
        chat = rows[3]
        assert (chat.text, chat.chat_role, chat.chat_content) == (None, "user", "hvorfor æøå")
        assert (rows[2].command, rows[2].ctx_question_id, rows[11].ctx_phase) == ("/chat", "q1", "after_questions")
        assert json.loads(rows[0].meta)["questionsFile"] == "x.json"
        micros = [r[0] for r in events.orderBy("session_id", "seq").select(F.unix_micros("ts")).collect()]
        assert micros[0] == 1700000000000000 and micros[8] == 1706933106000007
        snaps = {r.session_id: r for r in sessions.replay_session(events).collect()}
        assert {k: (s.status, s.reason) for k, s in snaps.items()} == {
            "s1": ("finished", None), "s2": ("aborted", "user_quit_in_chat"), "s3": ("open", None)}
        assert snaps["s1"].answers == {"q1": "", "q2": "/next"} and snaps["s2"].answers == {}
        assert [(q.id, q.text) for q in snaps["s1"].questions] == [("q1", "Hvor gammel er du?"), ("q2", "Ryger du?")]
        out = str(tmp_path / "snapshots")
        sinks.write_session_snapshot(sessions.replay_session(events), out)
        assert not sinks.write_session_snapshot(sessions.replay_session(events), out)
        stored = [json.loads(r.value) for r in keyed.read_lines(spark, out).collect()]
        assert [d["sessionId"] for d in stored] == ["s1"]
        assert stored[0]["answers"] == {"q1": "", "q2": "/next"}
        assert stored[0]["ollama"] == {"model": "m1", "url": "u1"}
        assert stored[0]["transcriptJsonl"].endswith("/s1.jsonl")
        assert stored[0]["createdAt"].startswith("2023-11-14T22:13:27")
    finally:
        if split:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_corrupt_lines_are_kept(spark, tmp_path):
    path = write(tmp_path / "runs", "a.jsonl", '{"ts":1,"type":"session_started","sessionId":"s"}\nno json\n')
    rows = logs.read_session_log(spark, path).orderBy("seq").collect()
    assert [r.corrupt for r in rows] == [None, "no json"]


@pytest.mark.parametrize("iso", [True, False])
def test_log_round_trip(spark, tmp_path, iso):
    columns = [c for c in logs.SESSION_EVENT_COLUMNS]
    events = logs.read_session_log(spark, log_folder(tmp_path)).select(*columns)
    if not iso:
        events = events.withColumn("ts", F.date_trunc("second", "ts"))
    out = str(tmp_path / "copy")
    sinks.append_session_log(events, out, iso)
    copy = logs.read_session_log(spark, out).select(*columns)

    def listed(df):
        return sorted(map(str, df.collect()))

    assert listed(copy) == listed(events)


def test_summaries_keep_non_ascii_and_are_replaced(spark, tmp_path):
    out = str(tmp_path / "summaries")
    for text in ("gammel", "blåbær"):
        df = spark.createDataFrame([("c1", text)], "conversation_id string, notes string")
        sinks.write_summaries(df, out)
    assert [r.value for r in keyed.read_lines(spark, out).collect()] == ['{"conversation_id":"c1","notes":"blåbær"}']


def test_banks(spark):
    assert flows.slot_bank(spark).where("required").count() == 5
    assert flows.dialog_slots(spark).count() == 9
    assert [r.topic for r in flows.topic_bank(spark).orderBy("pos").collect()][0] == "basic_info"
