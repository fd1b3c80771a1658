"""The live dialogue: requests equal the batch prompts, replies resume conversations."""

import random

import pytest
from pyspark.sql import functions as F

from dialogweave.operators import flow
from dialogweave.plans.prompts import chat_prompts
from dialogweave.streaming import dialogue
from dialogweave.streaming.interview import LATE
from tests.test_ordered_equivalence import FLOWS, flow_frame, random_inputs
from tests.test_streaming import land, listed

SCHEMA = "conversation_id string, seq bigint, raw_text string"
COLUMNS = ["conversation_id", "seq", "role", "content", "mode", "question_id", "channel", "reask", "input_seq"]


def counting(batch):
    return [f"{len(m)} entries about {m[-1]['content']}" for m in batch]


@pytest.mark.parametrize("pieces,replay,number", [(1, False, 0), (5, True, 3)])
def test_dialogue_equals_batch(spark, tmp_path, pieces, replay, number):
    table = random_inputs(60 + number, 7)
    rows = [(c, s, t) for c, inputs in table.items() for s, t in inputs]
    stream = land(spark, rows, SCHEMA, str(tmp_path), pieces, replay)
    got = dialogue.run_dialogue(spark, stream, FLOWS[number], counting, str(tmp_path / "talk")).cache()
    assert got.where("error is not null").count() == 0
    inputs, dim = spark.createDataFrame(rows, SCHEMA), flow_frame(spark, FLOWS[number])
    said = got.where("role = 'assistant'").select("conversation_id", F.col("input_seq").alias("seq"), "content")
    want = flow.expand_transcript(inputs, dim, said)
    assert listed(got.where("role is not null").select(*COLUMNS)) == listed(want.select(*COLUMNS))
    requests = got.where("request is not null").select(
        F.concat_ws(":", "conversation_id", "seq").alias("request_id"), F.col("request").alias("messages")
    )
    prompts = chat_prompts(want, inputs, dim).join(requests.select("request_id"), "request_id", "left_semi")
    assert listed(requests) == listed(prompts.select("request_id", "messages"))
    assert requests.count() == said.count() > 0


def test_errors_late_inputs_and_ranges(spark, tmp_path):
    rows = [("c", 5, "?a"), ("c", 9, "yes")]
    for i, piece in enumerate([rows, [("c", 7, "late"), ("c", 5, "?a"), (None, 1, "x")]]):
        spark.createDataFrame(piece, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = (
        spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    )

    def broken(batch):
        raise TimeoutError("slow")

    got = dialogue.run_dialogue(spark, stream, FLOWS[0], broken, str(tmp_path / "talk")).orderBy("seq").collect()
    told = [(r.role, r.content, r.input_seq) for r in got if r.role]
    assert told == [("system", "One?", 5), ("patient", "a", 5), ("assistant", None, 5), ("system", "One?", 5),
                    ("patient", "yes", 9), ("system", "Two?", 9)]
    assert [r.error for r in got if r.role == "assistant"] == ["TimeoutError: slow"]
    assert [(r.content, r.input_seq) for r in got if r.error == LATE] == [("late", 7)]
    numbers = random.Random(1).sample(range(30), 25)
    ranges = []
    for n in numbers:
        ranges = dialogue._with_range(ranges, n)
    assert sorted(n for low, high in ranges for n in range(low, high + 1)) == sorted(numbers)
    assert all(a[1] + 1 < b[0] for a, b in zip(ranges, ranges[1:]))
