"""Blocks by rank, the distributed ordinal, the prefix scan, and items as bits."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from dialogweave.operators import answers, flow, items, ordered
from dialogweave.sources import flows


def test_ordinal_over_all_partitions(spark):
    rnd = random.Random(2)
    rows = [("hot", rnd.randrange(10**12), i) for i in range(500)] + [(None, i, i) for i in range(30)]
    rows += [(f"k{i % 20}", i * i, i) for i in range(100)] + [("ties", 7, i) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, o bigint, n bigint").repartition(7)
    got = ordered.with_ordinal(df, "k", ["o"], "place", "rows").collect()
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in got if r.k == key), key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(len(mine))) and {r.rows for r in mine} == {len(mine)}
        assert [r.o for r in mine] == sorted(r[1] for r in rows if r[0] == key)


@pytest.mark.parametrize("step", [1, 1_000_003, None])
def test_blocks_follow_rows_not_places(spark, step):
    rnd = random.Random(3)
    places = [rnd.randrange(10**15) for _ in range(1000)] if step is None else [i * step for i in range(1000)]
    rows = [("hot", p) for p in places] + [("short", i) for i in range(60)] + [(None, 1), ("hot", None)]
    df = spark.createDataFrame(rows, "conversation_id string, seq bigint")
    blocks = ordered.blocks_of(df, bits=6)
    sizes = {
        (r.conversation_id, r._block): r.n
        for r in ordered.with_block(df.dropna(), blocks).groupBy("conversation_id", "_block").agg(F.count("*").alias("n")).collect()
    }
    assert sizes == {**{("hot", b): 64 for b in range(15)}, ("hot", 15): 40, ("short", 0): 60}
    assert blocks.most == 16 and ordered.blocks_of(df, bits=10).single


def test_prefix_scan(spark):
    rnd = random.Random(4)
    starts = spark.createDataFrame([("a", list(range(13)))], "_long_key string, _starts array<bigint>")
    values = {b: [rnd.randrange(9)] for b in range(13) if b not in (0, 5, 6)}
    states = spark.createDataFrame([("a", b, values.get(b)) for b in range(13)], "k string, _block bigint, _state array<int>")
    got = ordered.prefix_scan(states, "k", lambda a, b: F.concat(a, b), ordered.Blocks(starts, 13)).collect()
    for r in got:
        want = [x for b in range(13) if b < r._block for x in values.get(b, [])]
        assert (r._state or []) == want
    assert {r._block for r in got} >= set(range(1, 13))


def test_carried_state_is_bounded_by_the_flow(spark):
    # Two positions answered over and over would carry every answer, not two.
    rows = [("c", i, [{"p": i % 2, "s": i, "q": f"q{i % 2}", "a": f"a{i}"}]) for i in range(200)]
    df = spark.createDataFrame(rows, "conversation_id string, seq bigint, e array<struct<p:int,s:bigint,q:string,a:string>>")
    got = ordered.with_earlier(df, F.col("e"), answers._latest_by_position, bits=3).collect()
    for r in got:
        last = {x["p"]: x["a"] for _, s, (x,) in rows if s < r.seq for s in [s]}
        assert {e.p: e.a for e in r._earlier} == last and len(r._earlier) <= 2


def test_items(spark):
    rnd, size = random.Random(1), 130
    bank = spark.createDataFrame([(i, f"s{i}", i % 3 != 2) for i in range(size)], "pos int, slot string, required boolean")
    rows, want = [], {}
    for c in range(40):
        filled = set(rnd.sample(range(size), rnd.choice([0, 1, 5, 129, 130]))) if c % 2 else set(range(rnd.choice([0, 63, 64, 65, 130])))
        if c == 7:
            filled = {i for i in range(size) if i % 3 != 2}
        rows += [(f"c{c}", None), (f"c{c}", "unknown")] + [(f"c{c}", f"s{i}") for i in filled]
        left = [i for i in range(size) if i not in filled]
        want[f"c{c}"] = (f"s{left[0]}" if left else None, len(left), [i for i in left if i % 3 != 2])
    filled = spark.createDataFrame(rows, "conversation_id string, slot string")
    progress = {r.conversation_id: r for r in items.item_progress(filled, bank).collect()}
    missing = {}
    for r in items.missing_items(filled, bank).collect():
        assert r.slot == f"s{r.pos}"
        missing.setdefault(r.conversation_id, []).append(r.pos)
    for c, (first, n, needed) in want.items():
        r = progress[c]
        assert (r.next_slot, r.n_open, r.n_missing, r.done, r.complete) == (first, n, len(needed), n == 0, not needed)
        assert sorted(missing.get(c, [])) == needed
    assert any(r.complete and not r.done for r in progress.values())


def _several(spark):
    return spark.createDataFrame(
        [("f", 1, 0, "a", "A1?"), ("f", 1, 1, "b", "B1?"), ("f", 2, 0, "b", "B2?"), ("g", 1, 0, "a", "AG?")],
        "flow_id string, version int, pos int, id string, text string",
    )


def test_conversations_keep_the_version_of_their_first_input(spark):
    versions = spark.createDataFrame(
        [("f", 1, 10), ("f", 2, 20), ("f", 3, 20), ("g", 1, 0)], "flow_id string, version int, at bigint"
    ).select("flow_id", "version", F.timestamp_seconds("at").alias("valid_from")).where("version < 3")
    inputs = spark.createDataFrame(
        [("old", 1, "x", "f", 15), ("old", 2, "y", "g", 25), ("new", 1, "x", "f", 20), ("none", 1, "x", "f", 9), ("other", 1, "x", "h", 50)],
        "conversation_id string, seq bigint, raw_text string, flow_id string, at bigint",
    ).withColumn("ts", F.timestamp_seconds("at"))
    bound = flows.bind_flows(inputs, versions)
    assert {(r.conversation_id, r.flow_id, r.version) for r in bound.collect()} == {("old", "f", 1), ("new", "f", 2)}
    assert {r.conversation_id for r in flows.unbound_conversations(inputs, versions).collect()} == {"none", "other"}
    progress = flow.question_progress(bound, _several(spark))
    asked = {(r.conversation_id, r.seq): r.active_question_text for r in progress.collect()}
    assert asked == {("old", 1): "A1?", ("old", 2): "B1?", ("new", 1): "B2?"}
    latest = answers.latest_answers(flow.flow_answers(progress))
    given = answers.questionnaire_answers(latest, _several(spark)).collect()
    assert {(r.conversation_id, r.question, r.answer) for r in given} == {("old", "A1?", "x"), ("old", "B1?", "y"), ("new", "B2?", "x")}


def test_several_flows_without_binding_fail(spark):
    inputs = spark.createDataFrame([("c", 1, "x")], "conversation_id string, seq bigint, raw_text string")
    with pytest.raises(PySparkException, match="several flows"):
        flow.question_progress(inputs, _several(spark)).collect()
    one = _several(spark).where("flow_id = 'g'")
    assert flow.question_progress(inputs, one).first().active_question_text == "AG?"
