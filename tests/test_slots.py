import random

from pyspark.sql import functions as F

from dialogweave.fixed_values import ALL_FILLED_TEXT, DIALOG_SLOTS, Slot
from dialogweave.operators import slots as s

BANK = (Slot("a", "A?", True), Slot("b", "B?", True), Slot("c", "C?", False))


def frame(spark, rows):
    return spark.createDataFrame(rows, "conversation_id string, seq bigint, slot string, value string")


def test_merge_and_completeness_match_a_loop(spark):
    rnd = random.Random(4)
    table = {
        f"c{i}": [
            (j, rnd.choice(["a", "b", "c", "zz"]), rnd.choice(["", None, "x", "y", "0"]))
            for j in range(rnd.randrange(1, 9))
        ]
        for i in range(60)
    }
    rows = [(c, *u) for c, us in table.items() for u in us]
    rnd.shuffle(rows)
    merged = {}
    for r in s.merge_slots(frame(spark, rows), BANK).collect():
        merged.setdefault(r.conversation_id, {})[r.slot] = r.value
    report = {r.conversation_id: r for r in s.slot_completeness(frame(spark, rows), BANK).collect()}
    for c, updates in table.items():
        want = {b.slot: None for b in BANK}
        for _, slot, value in updates:
            if value and slot in want:
                want[slot] = value
        assert merged[c] == want
        gaps = [b for b in BANK if not want[b.slot]]
        assert report[c].next_text == (gaps[0].text if gaps else None)
        assert report[c].missing_required == [b.slot for b in gaps if b.required]
        assert report[c].complete == (not report[c].missing_required)


def test_project_known_slots(spark):
    raw = [
        '{"a":"x","zz":1,"b":""}', '{"a":null,"b":0,"c":[1]}', "junk", '{"a":1} more', "[1]",
        '{"a":{},"b":false,"c":0e5}', '{"a":5,"b":"0"}',
    ]
    df = spark.createDataFrame([("c", i, r) for i, r in enumerate(raw)], "conversation_id string, seq bigint, raw string")
    rows = s.project_known_slots(df, BANK).collect()
    assert {r.seq for r in rows} == {0, 1, 4, 5, 6}
    got = {(r.seq, r.slot): (r.value, r.truthy) for r in rows if r.error is None}
    assert got[0, "a"] == ("x", True) and got[0, "b"] == ("", False) and got[0, "c"] == (None, False)
    assert got[1, "b"] == ("0", False) and got[1, "c"] == ("[1]", True) and got[1, "a"] == (None, False)
    assert not any(got[5, x][1] for x in "abc")
    assert got[6, "a"] == ("5", True) and got[6, "b"] == ("0", True)
    assert [r.error for r in rows if r.seq == 4] == ["not an object: array"]
    state = {r.slot: r.value for r in s.merge_slots(s.project_known_slots(df, BANK), BANK, F.col("truthy")).collect()}
    assert state == {"a": "5", "b": "0", "c": "[1]"}


def test_next_unfilled(spark):
    filled = spark.createDataFrame(
        [("none", None), ("gap", DIALOG_SLOTS[0]), ("gap", DIALOG_SLOTS[2])]
        + [("all", x) for x in DIALOG_SLOTS] + [("odd", "unknown")],
        "conversation_id string, slot string",
    )
    got = {r.conversation_id: r for r in s.next_unfilled(filled, DIALOG_SLOTS, done_text=ALL_FILLED_TEXT).collect()}
    assert got["none"].next_slot == got["odd"].next_slot == DIALOG_SLOTS[0]
    assert got["gap"].next_slot == DIALOG_SLOTS[1] and not got["gap"].done
    assert got["gap"].prompt == f"Please ask about: {DIALOG_SLOTS[1]}"
    assert got["all"].next_slot is None and got["all"].done and got["all"].prompt == ALL_FILLED_TEXT


def test_missing_required_keeps_bank_order(spark):
    rows = s.missing_required(frame(spark, [("c", 0, "c", "x")]), BANK).orderBy("n").collect()
    assert [r.slot for r in rows] == ["a", "b"]


def test_slots_before_a_text_match_a_loop(spark):
    rnd = random.Random(9)
    updates = [
        (f"c{rnd.randrange(4)}", rnd.randrange(60), rnd.choice(["a", "b", "c", "zz"]), rnd.choice(["", None, "x", "y", "z"]))
        for _ in range(120)
    ]
    updates = list({(c, seq): (c, seq, *rest) for c, seq, *rest in updates}.values()) + [("c0", None, "a", "lost")]
    texts = [(f"c{c}", seq, f"t{seq}") for c in range(6) for seq in rnd.sample(range(70), 15)] + [("c0", None, "no place")]
    want = {}
    for c, seq, text in texts:
        if seq is None:
            continue
        known = {b.slot: None for b in BANK}
        for u in sorted((u for u in updates if u[0] == c and u[1] is not None and u[1] < seq), key=lambda u: u[1]):
            if u[3] and u[2] in known:
                known[u[2]] = u[3]
        want[c, seq] = (text, known)
    asked = spark.createDataFrame(texts, "conversation_id string, seq bigint, text string")
    for bits in (0, 2, 16):
        rows = s.slots_before(frame(spark, updates), asked, BANK, bits=bits).collect()
        assert {(r.conversation_id, r.seq): (r.text, r.slots) for r in rows} == want
        assert len(rows) == len(want)
