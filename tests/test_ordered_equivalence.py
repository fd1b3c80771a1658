"""Randomized equivalence with plain loops, with tiny blocks so that carries are exercised."""

import random

import pytest
from pyspark.sql import functions as F

from dialogweave.fixed_values import TOPIC_RULES, TopicRule
from dialogweave.model import MESSAGE_SCHEMA
from dialogweave.operators import answers, context, flow, ordered, sessions, topics
from tests import loops

BITS = [1, 16]


def random_messages(seed, conversations=12, longest=70, sparse=True):
    rnd = random.Random(seed)
    table = {}
    for c in range(conversations):
        seq, rows = rnd.randrange(5), []
        for _ in range(rnd.randrange(1, longest)):
            role = rnd.choice(["patient", "patient", "assistant", "system"])
            mode = None if role == "system" else rnd.choice(["chat", "chat", "answer", None])
            pad = rnd.choice(["", "", " ", "\t", "\n", " "])
            rows.append((seq, role, mode, pad + rnd.choice("abcdef") + pad))
            seq += rnd.choice([1, 1, 1, 2, 9]) if sparse else 1
        table[f"c{c}"] = rows
    return table


def message_frame(spark, table):
    rows = [
        (cid, seq, role, content, None, mode, None, None, None)
        for cid, rows in table.items()
        for seq, role, mode, content in rows
    ]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, MESSAGE_SCHEMA)


@pytest.mark.parametrize("bits", BITS)
def test_running_sums(spark, bits):
    table = random_messages(5)
    df = message_frame(spark, table)
    got = ordered.running_sums(
        df, {"n": F.lit(1), "chats": (F.coalesce(F.col("mode"), F.lit("")) == "chat").cast("bigint")}, bits=bits
    )
    got = {(r.conversation_id, r.seq): (r.n, r.chats) for r in got.collect()}
    want = {}
    for cid, rows in table.items():
        for i, row in enumerate(rows):
            want[cid, row[0]] = (i, sum(m[2] == "chat" for m in rows[:i]))
    assert got == want


@pytest.mark.parametrize("bits", BITS)
def test_patient_questions(spark, bits):
    table = random_messages(7)
    got = answers.patient_questions(message_frame(spark, table), bits=bits).collect()
    got = sorted((r.conversation_id, r.seq, r.question, r.answer) for r in got)
    want = sorted((c, *p) for c, rows in table.items() for p in loops.as_pairs(rows))
    assert got == want


@pytest.mark.parametrize("bits,frame,turns", [(1, 30, 10), (3, 7, 2), (16, 30, 10), (2, 1, 1), (3, 2, 5)])
def test_chat_context(spark, bits, frame, turns):
    table = random_messages(11)
    got = context.chat_context(message_frame(spark, table), frame, turns, bits).collect()
    got = {
        (r.conversation_id, r.seq): [(m.role, m.content) for m in r.context] for r in got
    }
    want = {
        (c, seq): kept
        for c, rows in table.items()
        for seq, kept in loops.seen_context(rows, frame, turns).items()
    }
    assert got == want


def test_take_turn(spark):
    table = random_messages(13)
    got = context.take_turn(message_frame(spark, table), 3).collect()
    want = {(c, m[0]) for c, rows in table.items() for m in rows[-3:]}
    assert {(r.conversation_id, r.seq) for r in got} == want


@pytest.mark.parametrize("bits", [1, 16])
def test_transcript_text_parts_join_to_the_whole(spark, bits):
    table = random_messages(17)
    part_rows = 1 << bits
    parts = context.transcript_text(message_frame(spark, table), bits, part_rows).collect()
    for cid, rows in table.items():
        mine = sorted((r.part, r.transcript) for r in parts if r.conversation_id == cid)
        whole = "\n".join(f"{m[1].upper()}: {m[3]}" for m in rows)
        assert "\n".join(t for _, t in mine) == whole
        if bits == 16:
            assert len(mine) == 1
    history = context.collect_history(message_frame(spark, table), bits=bits).collect()
    for cid, rows in table.items():
        mine = sorted((r.part, r.history) for r in history if r.conversation_id == cid)
        flat = [(m.role, m.content) for _, part in mine for m in part]
        names = {"patient": "user", "assistant": "assistant"}
        assert flat == [(names[m[1]], m[3]) for m in rows if m[1] in names]


def random_inputs(seed, conversations=25):
    rnd = random.Random(seed)
    words = ["?", "?  x", " ? why", "yes", "", " no ", "?again", "12", "? a ? b"]
    table = {}
    for c in range(conversations):
        seq, rows = rnd.randrange(3), []
        for _ in range(rnd.randrange(1, 14)):
            raw = rnd.choice(words)
            if rnd.random() < 0.04:
                raw = rnd.choice([" QUIT ", "exit", "Quit"])
            rows.append((seq, raw))
            seq += rnd.choice([1, 1, 4])
        table[f"c{c}"] = rows
    return table


def flow_frame(spark, questions):
    return spark.createDataFrame(
        [(i, q[0], q[1]) for i, q in enumerate(questions)], "pos int, id string, text string"
    )


FLOWS = [
    [("q1", "One?"), ("q2", "Two?"), ("q3", "Three?")],
    [("q1", "One?")],
    [],
    [("q1", "One?"), ("q2", "Two?"), ("q1", "One again?"), ("q3", "Three?")],
]


@pytest.mark.parametrize(
    "bits,number,responder",
    [(1, 0, True), (16, 0, False), (1, 1, False), (16, 1, True), (1, 2, True), (1, 2, False), (1, 3, True), (2, 3, False)],
)
def test_expand_transcript(spark, bits, number, responder):
    questions, table = FLOWS[number], random_inputs(100 + number)
    inputs = spark.createDataFrame(
        [(c, s, r) for c, rows in table.items() for s, r in rows],
        "conversation_id string, seq bigint, raw_text string",
    )
    dim = flow_frame(spark, questions)
    said = {(c, s): f"re {c} {s}" for c, rows in table.items() for s, _ in rows}
    replies = None
    if responder:
        replies = spark.createDataFrame(
            [(c, s, t) for (c, s), t in said.items()],
            "conversation_id string, seq bigint, content string",
        )
    got = {}
    for r in flow.expand_transcript(inputs, dim, replies, bits=bits).collect():
        got.setdefault(r.conversation_id, []).append(
            (r.seq, (r.role, r.content, r.mode, r.question_id, r.channel, r.reask))
        )
    progress = flow.question_progress(inputs, dim, bits=bits)
    so_far = {
        (r.conversation_id, r.seq): r.answered
        for r in answers.answered_so_far(progress, dim, bits=bits).collect()
        if r.active_question_id is not None
    }
    rejected = {
        (r.conversation_id, r.seq, r.reason)
        for r in flow.rejected_inputs(inputs, dim, responder, bits=bits).collect()
    }
    want_rejected, want_lines = set(), {}
    for c, rows in table.items():
        mine = None if not responder else {s: said[c, s] for s, _ in rows}
        messages, lines, refused = loops.interview(rows, questions, mine)
        ordered_rows = sorted(got[c], key=lambda p: p[0])
        assert [s for s, _ in ordered_rows] == list(range(len(messages)))
        assert [m for _, m in ordered_rows] == messages
        want_rejected |= {(c, s, why) for s, why in refused}
        for s, pairs in lines.items():
            want_lines[c, s] = "\n".join(f"- {q} -> {a}" for q, a in pairs) or "None yet."
    assert so_far == want_lines
    assert rejected == want_rejected


RULES = [
    TOPIC_RULES,
    [
        TopicRule("one", "1", ("a",), True),
        TopicRule("two", "2", ("b", "xb"), True, "fixed"),
        TopicRule("three", "3", ("a",), True),
        TopicRule("four", "4", ("c",), False),
        TopicRule("five", "5", ("a",), True),
    ],
    [TopicRule("one", "1", ("a",), True), TopicRule("two", "2", ("a", "b"), True)],
    [TopicRule("one", "1", ("a",), False)],
]


@pytest.mark.parametrize("bits,number", [(1, 0), (16, 0), (1, 1), (2, 1), (16, 1), (1, 2), (1, 3)])
def test_topic_progress(spark, bits, number):
    rnd = random.Random(number)
    rules = RULES[number]
    words = ["A1", "b", "c", "xyz", "180 CM", "Ingen", "operationer", "vægten", "ingen medicin", "d"]
    table = {}
    for c in range(40):
        seq, rows = 0, []
        for _ in range(rnd.randrange(1, 25)):
            rows.append((seq, rnd.choice(words)))
            seq += rnd.choice([1, 1, 3])
        table[f"c{c}"] = rows
    df = spark.createDataFrame(
        [(c, s, t) for c, rows in table.items() for s, t in rows],
        "conversation_id string, seq bigint, content string",
    )
    progress = topics.topic_progress(df, rules, bits=bits)
    states = {r.conversation_id: r for r in progress.collect()}
    kept = {}
    for r in topics.topic_answers(df, progress, rules).collect():
        kept.setdefault(r.conversation_id, {})[r.topic] = r.answer
    turns = {}
    for r in topics.topic_turns(df, rules, bits).collect():
        turns.setdefault(r.conversation_id, []).append((r.seq, r.topic_before, r.topic_after))
    for c, rows in table.items():
        following, done, stored, path = loops.topics(rows, rules)
        assert states[c].next_topic == following
        assert list(states[c].completed) == done
        assert kept.get(c, {}) == stored
        assert sorted(turns[c]) == path


@pytest.mark.parametrize("bits", [1, 16])
def test_replay_session(spark, bits):
    rnd = random.Random(3)
    kinds = ["standard_question_shown"] * 4 + ["standard_answer_given"] * 4
    kinds += ["standard_answer_skipped", "command_used", "chat", "session_finished", "session_aborted"]
    table = {}
    for c in range(40):
        rows, seq = [], 0
        for _ in range(rnd.randrange(1, 15)):
            kind = rnd.choice(kinds)
            qid = f"q{rnd.randrange(4)}" if kind.startswith("standard") else None
            text = rnd.choice(["", "ja", "nej", "blåbær"]) if kind.startswith("standard") else None
            reason = "user_quit" if kind == "session_aborted" else None
            rows.append((seq, kind, qid, text, reason))
            seq += rnd.choice([1, 2])
        table[f"s{c}"] = rows
    df = spark.createDataFrame(
        [(c, *row) for c, rows in table.items() for row in rows],
        "session_id string, seq bigint, type string, question_id string, text string, reason string",
    ).withColumn("ts", F.timestamp_seconds(F.col("seq"))).withColumn("meta", F.lit(None).cast("string"))
    for r in sessions.replay_session(df, bits=bits).collect():
        status, why, shown, kept = loops.session(table[r.session_id])
        assert (r.status, r.reason) == (status, why)
        assert [(q.id, q.text) for q in r.questions] == shown
        assert r.answers == kept
        assert (r.created_at is not None) == (status == "finished")


def test_parts_follow_rows_and_bytes_not_seq_values(spark):
    rows = [("c", i * 100_000, "patient", "x" * 10) for i in range(40)]
    sparse = spark.createDataFrame(rows, "conversation_id string, seq bigint, role string, content string")
    assert context.transcript_text(sparse).count() == 1
    assert context.collect_history(sparse).count() == 1
    assert context.transcript_text(sparse, part_rows=10).count() == 4
    whole = "\n".join(["PATIENT: " + "x" * 10] * 40)
    parts = context.transcript_text(sparse, part_bytes=100).orderBy("part").collect()
    assert len(parts) == 8 and "\n".join(p.transcript for p in parts) == whole
