"""Streaming results equal batch results, however the input is cut into micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from dialogweave.fixed_values import Slot
from dialogweave.operators import flow, sessions
from dialogweave.operators.slots import slot_completeness
from dialogweave.sources import sinks
from dialogweave.streaming import interview, slots, sessions as stream_sessions, unplaced
from tests.test_ordered_equivalence import FLOWS, flow_frame, random_inputs

BANK = (Slot("a", "A?", True), Slot("b", "B?", True), Slot("c", "C?", False))


def land(spark, rows, schema, folder, pieces, replay):
    """Rows cut by seq into files, one micro-batch each; optionally one piece twice."""
    rows = sorted(rows, key=lambda r: r[1])
    size = -(-len(rows) // pieces)
    cut = [rows[i : i + size] for i in range(0, len(rows), size)]
    if replay:
        cut.insert(2, cut[0])
    for i, piece in enumerate(cut):
        random.Random(i).shuffle(piece)
        spark.createDataFrame(piece, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in/{i:03d}")
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    )


def drain(spark, stream, mode, folder):
    def store(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/{number:05d}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(store)
        .option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/out")


def listed(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("pieces,replay,number,responder", [(1, False, 0, True), (6, True, 3, True), (5, True, 2, False), (4, False, 0, False)])
def test_stream_interview(spark, tmp_path, pieces, replay, number, responder):
    table = random_inputs(40 + number, 8)
    schema = "conversation_id string, seq bigint, raw_text string"
    rows = [(c, s, t) for c, inputs in table.items() for s, t in inputs]
    stream = land(spark, rows, schema, str(tmp_path), pieces, replay)
    reply = (lambda text, question, known: f"{text}|{question}|{len(known)}") if responder else None
    got = drain(spark, interview.stream_interview(stream, FLOWS[number], reply), "append", str(tmp_path))
    batch_inputs, dim = spark.createDataFrame(rows, schema), flow_frame(spark, FLOWS[number])
    replies = None
    if responder:
        from dialogweave.operators.answers import answered_so_far

        progress = flow.question_progress(batch_inputs, dim)
        known = F.when(F.col("answered") == "None yet.", 0).otherwise(F.size(F.split("answered", "\n")))
        replies = answered_so_far(progress, dim).select(
            "conversation_id", "seq",
            F.concat_ws("|", "text", "active_question_text", known.cast("string")).alias("content"),
        )
    want = flow.expand_transcript(batch_inputs, dim, replies)
    columns = ["conversation_id", "seq", "role", "content", "mode", "question_id", "channel", "reask", "input_seq"]
    assert listed(got.select(*columns)) == listed(want.select(*columns))


def test_failing_reply_is_an_error_not_content(spark, tmp_path):
    schema = "conversation_id string, seq bigint, raw_text string"
    stream = land(spark, [("c", 0, "?x")], schema, str(tmp_path), 1, False)

    def broken(*_):
        raise TimeoutError("late")

    rows = drain(spark, interview.stream_interview(stream, FLOWS[0], broken), "append", str(tmp_path)).collect()
    [answer] = [r for r in rows if r.role == "assistant"]
    assert answer.content is None and answer.error == "TimeoutError: late"


@pytest.mark.parametrize("pieces,replay", [(1, False), (5, True)])
def test_stream_slots(spark, tmp_path, pieces, replay):
    rnd = random.Random(8)
    rows = [(f"c{rnd.randrange(9)}", i, rnd.choice("abcz"), rnd.choice(["", "x", "y"])) for i in range(60)]
    schema = "conversation_id string, seq bigint, slot string, value string"
    stream = land(spark, rows, schema, str(tmp_path), pieces, replay)
    out = drain(spark, slots.stream_slot_completeness(stream, BANK), "update", str(tmp_path))
    latest = out.groupBy("conversation_id").agg(
        F.max_by(F.struct("next_slot", "next_text", "missing_required", "complete"), "batch").alias("r")
    ).select("conversation_id", "r.*")
    assert listed(latest) == listed(slot_completeness(spark.createDataFrame(rows, schema), BANK))


@pytest.mark.parametrize("cuts,backwards", [(1, False), (4, False), (4, True)])
def test_stream_sessions(spark, tmp_path, cuts, backwards):
    rnd = random.Random(cuts)
    kinds = ["standard_question_shown"] * 4 + ["standard_answer_given"] * 4 + ["session_started", "session_finished", "session_aborted"]
    rows = []
    for i in range(90):
        kind = rnd.choice(kinds)
        std = kind.startswith("standard")
        rows.append((f"s{rnd.randrange(8)}", i, kind, f"q{rnd.randrange(3)}" if std else None,
                     rnd.choice(["", "ja", "blåbær"]) if std else None,
                     "user_quit" if kind == "session_aborted" else None))
    schema = "session_id string, seq bigint, type string, question_id string, text string, reason string"
    events = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("seq") + 1_700_000_000))
    for name in ("chat_role", "chat_content", "command", "ctx_question_id", "ctx_phase", "meta"):
        events = events.withColumn(name, F.lit(None).cast("string"))
    folder = str(tmp_path / "log")
    size = 90 // cuts
    for i in reversed(range(cuts)) if backwards else range(cuts):
        piece = events.where((F.col("seq") >= i * size) & ((F.col("seq") < (i + 1) * size) | F.lit(i == cuts - 1)))
        sinks.append_session_log(piece, folder, iso=i % 2 == 0)
    if cuts > 1:
        sinks.append_session_log(events.where(F.col("seq") < size), folder)
    # Arrival order is file order, one file per micro-batch when cut.
    stream = stream_sessions.stream_session_log(spark, folder, 1000 if cuts == 1 else 1)
    out = drain(spark, stream_sessions.stream_sessions(stream), "update", str(tmp_path))
    latest = out.groupBy("session_id").agg(
        F.max_by(F.struct("status", "reason", "created_at", "questions", "answers"), "version").alias("r")
    ).select("session_id", "r.*")
    want = sessions.replay_session(events).select(
        "session_id", "status", "reason", "created_at", "questions",
        F.transform(F.array_sort(F.map_entries("answers")), lambda e: F.struct(e["key"].alias("question_id"), e["value"].alias("answer"))).alias("answers"),
    )
    assert listed(latest) == listed(want)


def test_malformed_lines_are_set_apart(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    good = '{"seq":1,"ts":"2024-01-01T00:00:00Z","type":"session_started","sessionId":"s"}'
    no_seq = '{"ts":"2024-01-01T00:00:00Z","type":"session_started","sessionId":"t"}'
    (folder / "a.json").write_text("\n".join([good, "{bad", "worse}", no_seq]) + "\n")
    events = stream_sessions.stream_session_log(spark, str(folder))
    out = drain(spark, stream_sessions.stream_sessions(events), "update", str(tmp_path / "x"))
    assert [(r.session_id, r.status) for r in out.collect()] == [("s", "open")]
    apart = drain(spark, unplaced(events, "session_id"), "append", str(tmp_path / "y")).collect()
    assert sorted((r.session_id or "", r.corrupt or "") for r in apart) == [("", "worse}"), ("", "{bad"), ("t", "")]


def test_late_inputs_are_errors_and_replays_are_not(spark, tmp_path):
    schema = "conversation_id string, seq bigint, raw_text string"
    folder = str(tmp_path)
    for i, piece in enumerate([[("c", 5, "a")], [("c", 2, "b")], [("c", 5, "a"), ("c", 2, "b"), (None, 1, "x")]]):
        spark.createDataFrame(piece, schema).coalesce(1).write.parquet(f"{folder}/in/{i}")
    stream = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    )
    rows = drain(spark, interview.stream_interview(stream, FLOWS[0]), "append", folder).collect()
    assert [(r.role, r.content, r.input_seq) for r in rows if r.error == interview.LATE] == [(None, "b", 2)]
    assert [r.content for r in rows if r.role == "patient"] == ["a"]


def _session_events(spark, rows):
    events = spark.createDataFrame(
        rows, "session_id string, seq bigint, type string, question_id string, text string, reason string"
    ).withColumn("ts", F.timestamp_seconds(F.col("seq") + 1_700_000_000))
    for name in ("chat_role", "chat_content", "command", "ctx_question_id", "ctx_phase", "meta"):
        events = events.withColumn(name, F.lit(None).cast("string"))
    return events


def test_ended_sessions_leave_the_state(spark, tmp_path):
    shown, given, ended = "standard_question_shown", "standard_answer_given", "session_finished"
    day = 86_400
    waves = [
        [("a", 1, shown, "q", "Q?", None), ("a", 2, given, "q", "x" * 50, None), ("a", 3, ended, None, None, None), ("b", 1, shown, "q", "Q?", None)],
        [("b", 10 * day, given, "q", "one", None)],
        # What is repeated of an ended session does not open it again.
        [("a", 2, given, "q", "again", None), ("b", 20 * day, given, "q", "two", None)],
    ]
    folder = str(tmp_path / "log")
    for wave in waves:
        sinks.append_session_log(_session_events(spark, wave).coalesce(1), folder)
    checkpoint = str(tmp_path / "state")
    stream = stream_sessions.stream_sessions(stream_sessions.stream_session_log(spark, folder, 1), keep="1 day")
    out = drain(spark, stream, "update", checkpoint).orderBy("session_id", "version").collect()
    assert [(r.session_id, r.status, r.version) for r in out] == [("a", "finished", 1), ("b", "open", 1), ("b", "open", 2), ("b", "open", 3)]
    assert out[-1].answers[0].answer == "two"

    def left(name):
        return spark.read.format("statestore").option("stateVarName", name).load(f"{checkpoint}/ck")

    assert [r.key.session_id for r in left("session").collect()] == ["b"]
    assert {r.key.session_id for r in left("answers").collect()} == {"b"}
    assert {r.key.session_id for r in left("shown").collect()} == {"b"}
