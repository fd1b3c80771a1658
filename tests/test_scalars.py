import sys

import pytest
from pyspark.sql import functions as F

from dialogweave.fixed_values import WHITE_SPACE
from dialogweave.functions import scalars as sc


def run(spark, rows, column, schema="x string"):
    rows = [r if isinstance(r, tuple) else (r,) for r in rows]
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_white_space_is_what_strip_removes():
    assert set(WHITE_SPACE) == {c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()}


def test_py_strip(spark):
    texts = [f"{c}a{c}b{c}" for c in WHITE_SPACE] + ["", " ", WHITE_SPACE, "​x "]
    assert run(spark, texts, sc.py_strip(F.col("x"))) == [t.strip() for t in texts]


def test_classify_input(spark):
    cases = {
        "?": ("chat", ""), "?  x": ("chat", "x"), " QUIT ": ("quit", "QUIT"), "exit": ("quit", "exit"),
        "": ("answer", ""), " ?a ?": ("chat", "a ?"), "quit now": ("answer", "quit now"),
        "? quit": ("chat", "quit"), "\x1f? y\n": ("chat", "y"),
    }
    got = run(spark, list(cases), F.struct(sc.input_mode(F.col("x")), sc.input_text(F.col("x"))))
    assert [tuple(g) for g in got] == list(cases.values())


@pytest.mark.parametrize(
    "dialect,place,cases",
    [
        ("plain", "question", {" /CHAT ": "chat", "/next": None, "/quit": "quit", "": None}),
        ("plain", "chat", {"Exit": "leave_chat", "/quit": "leave_chat", "": None, "quit": "leave_chat"}),
        ("skipping", "question", {"/next": "next", "/quit": "quit", "quit": None, "/chat x": None}),
        ("skipping", "chat", {" ": "leave_chat", "/QUIT": "quit", "exit": None}),
        ("skipping", "final", {"/chat": "chat", "/quit": None, "": None}),
    ],
)
def test_classify_command(spark, dialect, place, cases):
    got = run(spark, list(cases), sc.classify_command(F.col("x"), dialect, place))
    assert got == list(cases.values())


def test_normalize_ts(spark):
    texts = ["1700000000", "2023-11-14T22:13:20+00:00", "2023-11-14T23:13:20.250000+01:00", "soon", None]
    got = run(spark, texts, F.unix_micros(sc.normalize_ts(F.col("x"))))
    assert got == [1700000000000000, 1700000000000000, 1700000000250000, None, None]


def test_chunk_token_and_speed(spark):
    rows = [("a", "b"), ("", "b"), (None, "b"), (None, None), ("", None)]
    assert run(spark, rows, sc.chunk_token(F.col("x"), F.col("y")), "x string, y string") == ["a", "b", "b", "", ""]
    rows = [(10, 2_000_000_000), (1, 0)]
    assert run(spark, rows, sc.tokens_per_second(F.col("x"), F.col("y")), "x bigint, y bigint") == [5.0, None]


def test_is_chat_turn_ignores_missing_mode(spark):
    rows = [("patient", "chat"), ("assistant", None), ("system", "chat"), ("patient", "answer")]
    got = run(spark, rows, sc.is_chat_turn(F.col("x"), F.col("y")), "x string, y string")
    assert got == [True, False, False, False]


def test_match_keywords_also_inside_words(spark):
    got = run(spark, ["180 CM", "VÆGTEN", "nothing", ""], sc.match_keywords(F.col("x"), ("cm", "vægt")))
    assert got == [True, True, False, False]


def test_invalid_messages(spark):
    from dialogweave.operators.context import invalid_messages

    rows = [("patient", "chat"), ("system", None), ("user", "chat"), ("patient", "talk"), (None, None)]
    df = spark.createDataFrame(rows, "role string, mode string")
    assert {tuple(r) for r in invalid_messages(df).collect()} == {("user", "chat"), ("patient", "talk"), (None, None)}
