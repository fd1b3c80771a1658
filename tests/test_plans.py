"""Physical plans have the shape the operators promise."""

import pytest

from dialogweave.operators import answers, context
from dialogweave.plans.driver_queries import QUERIES
from tests.test_ordered_equivalence import message_frame, random_messages

SF = "/root/testdata/sf0.001"


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture()
def stored(spark, tmp_path):
    path = str(tmp_path / "messages")
    message_frame(spark, random_messages(21)).write.parquet(path)
    return spark.read.parquet(path)


def test_short_conversations_need_no_carry(stored):
    plan = final_plan(answers.patient_questions(stored))
    assert "Join" not in plan and plan.count("FileScan") == 1


@pytest.mark.parametrize("operator", [answers.patient_questions, context.chat_context])
def test_carries_reuse_the_shuffle_of_the_rows(stored, operator):
    plan = final_plan(operator(stored, bits=2))
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert "ReusedExchange" in plan
    assert sum("content" in line for line in scans) == 1


def test_last_rows_are_cut_before_the_shuffle(stored):
    plan = final_plan(context.take_turn(stored, 3))
    assert "row_number(), 3, Partial" in plan


@pytest.mark.parametrize(
    "name",
    ["question_progress", "expand_transcript", "answered_so_far", "next_unfilled", "next_question",
     "slot_completeness", "topic_turns", "replay_session", "chat_prompts_in_flow", "assemble_summary"],
)
def test_nothing_is_crossed(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
