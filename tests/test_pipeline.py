import json

from pyspark.sql import functions as F

from dialogweave.fixed_values import Slot
from dialogweave.operators import responses
from dialogweave.operators.flow import expand_transcript
from dialogweave.plans import interview, prompts
from tests.test_documents import summary_text


def flow_and_inputs(spark):
    questions = spark.createDataFrame(
        [(0, "q1", "Name?"), (1, "q2", "Age?")], "pos int, id string, text string"
    )
    inputs = spark.createDataFrame(
        [("c1", 0, "? why"), ("c1", 1, "Ib"), ("c1", 2, "?and"), ("c1", 3, "40"), ("c2", 0, "quit")],
        "conversation_id string, seq bigint, raw_text string",
    )
    replies = spark.createDataFrame(
        [("c1", 0, "because"), ("c1", 2, "so")], "conversation_id string, seq bigint, content string"
    )
    return questions, inputs, replies


def test_chat_prompts_show_the_situation(spark):
    questions, inputs, replies = flow_and_inputs(spark)
    messages = expand_transcript(inputs, questions, replies)
    words = {"chat_system": "S", "chat_current": "[{id}|{text}]", "chat_answered": "A"}
    got = {r.request_id: [(m.role, m.content) for m in r.messages]
           for r in prompts.chat_prompts(messages, inputs, questions, words).collect()}
    assert got == {
        "c1:1": [("system", "S"), ("system", "[q1|Name?]\nA\nNone yet."), ("user", "why")],
        "c1:6": [("system", "S"), ("system", "[q2|Age?]\nA\n- Name? -> Ib"), ("user", "why"),
                 ("assistant", "because"), ("user", "and")],
    }


def test_whole_pipeline_with_repairs(spark, tmp_path):
    questions, inputs, replies = flow_and_inputs(spark)

    def summarizer(batch):
        out = []
        for messages in batch:
            repaired = "does not fit" in messages[-1]["content"]
            out.append(f"here: {summary_text()} end" if repaired else "no document")
        return out

    rows = interview.run_interviews(
        spark, inputs, questions, replies, summarizer, str(tmp_path / "run")
    ).collect()
    by_id = {r.conversation_id: r.summary for r in rows}
    assert set(by_id) == {"c1"}  # c2 was quit
    c1 = by_id["c1"]
    assert [(a.question_id, a.question, a.answer) for a in c1.questionnaire_answers] == [
        ("q1", "Name?", "Ib"), ("q2", "Age?", "40")]
    assert [(p.question, p.answer) for p in c1.patient_questions] == [("why", "because"), ("and", "so")]
    assert c1.patient.name == "Test Person" and rows[0].last_error is None


def test_pipeline_reports_what_never_fits(spark, tmp_path):
    questions, inputs, replies = flow_and_inputs(spark)
    [row] = interview.run_interviews(
        spark, inputs, questions, replies, lambda batch: ["junk"] * len(batch), str(tmp_path / "run")
    ).collect()
    assert row.conversation_id == "c1" and row.summary is None and row.last_error


def ask(spark, n=20):
    return spark.range(n).select(
        F.col("id").cast("string").alias("request_id"),
        F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("m"), "id").alias("content"))).alias("messages"),
    )


def picky(batch):
    if any(m[-1]["content"] == "m7" for m in batch):
        raise RuntimeError("no sevens")
    return [m[-1]["content"].upper() for m in batch]


def test_respond_captures_failures(spark):
    rows = {r.request_id: r for r in responses.respond(ask(spark), picky).collect()}
    assert len(rows) == 20
    assert rows["3"].content == "M3" and rows["3"].error is None
    assert rows["7"].content is None and rows["7"].error == "RuntimeError: no sevens"


def test_second_run_asks_only_for_what_failed(spark, tmp_path):
    path = str(tmp_path / "responses")
    assert responses.respond_to_table(spark, ask(spark), picky, path).count() == 20
    again = responses.respond_to_table(spark, ask(spark), lambda b: ["late"] * len(b), path)
    rows = [(r.request_id, r.content) for r in again.collect()]
    assert len(rows) == 20 and ("7", "late") in rows
    assert responses.respond_to_table(spark, ask(spark), picky, path).count() == 20
    longer = ask(spark).withColumn("messages", F.concat("messages", "messages"))
    asked_anew = responses.respond_to_table(spark, longer, lambda b: ["new"] * len(b), path)
    assert {r.content for r in asked_anew.collect()} == {"new"}


def test_slot_and_note_prompts_keep_nulls(spark):
    states = spark.sql("select 'c' as conversation_id, map('a', 'x', 'b', cast(null as string)) as slots")
    updates = spark.createDataFrame(
        [("c", 3, "a", "x"), ("c", 4, "a", "now"), ("c", 5, "b", "later")],
        "conversation_id string, seq bigint, slot string, value string",
    )
    texts = spark.createDataFrame([("c", 4, "hi")], "conversation_id string, seq bigint, text string")
    bank = (Slot("a", "A?", True), Slot("b", "B?", True))
    [row] = prompts.slot_prompts(updates, texts, bank).collect()
    assert '{"a":"x","b":null}' in row.messages[1].content and row.messages[1].content.endswith("hi")
    [note] = prompts.note_prompts(states).collect()
    assert json.loads(note.messages[1].content.split("\n")[1]) == {"a": "x", "b": None}


NOTES = {"type": "object", "properties": {"notes": {"type": "string"}}, "required": ["notes"]}


def test_every_part_reaches_the_summary(spark, tmp_path):
    questions, inputs, replies = flow_and_inputs(spark)

    def summarizer(batch):
        out = []
        for messages in batch:
            asked = messages[-1]["content"]
            if asked.startswith("Documents:"):
                notes = [json.loads(t)["notes"] for t in asked.split("\n")[1:]]
            else:
                notes = [asked.split("\n", 1)[1]]
            out.append(json.dumps({"notes": "\n".join(notes), "more": "x"}))
        return out

    def run(name, **limits):
        return interview.run_interviews(
            spark, inputs, questions, replies, summarizer, str(tmp_path / name), NOTES, **limits
        ).collect()

    [whole] = run("whole")
    [parts] = run("rows", part_rows=1)
    assert parts.summary == whole.summary and parts.last_error is None
    assert whole.extra == {"more": '"x"'}


def test_a_part_that_never_fits_fails_its_conversation(spark, tmp_path):
    questions, inputs, replies = flow_and_inputs(spark)

    def summarizer(batch):
        return ["junk" if "40" in m[-1]["content"] or "junk" in m[-1]["content"] else '{"notes":"n"}' for m in batch]

    [row] = interview.run_interviews(
        spark, inputs, questions, replies, summarizer, str(tmp_path / "run"), NOTES, part_rows=2
    ).collect()
    assert row.conversation_id == "c1" and row.summary is None and row.last_error
