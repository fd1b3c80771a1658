import json
import random

import pytest
from pyspark.sql import functions as F

from dialogweave.functions import jsontext
from dialogweave.operators import documents as d


def one(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_extract_json_block_matches_a_two_step_search(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("{} a\n\tb") for _ in range(rnd.randrange(14))) for _ in range(1500)]
    texts += ["```json\n{\"a\": 1}\n```", "x {a} y {b} z", "}{", "{" * 5000, " {x} "]

    def search(text):
        text = text.strip()
        a, b = text.find("{"), text.rfind("}")
        return text[a : b + 1] if a >= 0 and b > a else text

    got = one(spark, texts, jsontext.extract_json_block(F.col("x")))
    assert got == [search(t) for t in texts]


def test_parse_json_strict(spark):
    good = ['{"a":1}', " [1] ", "1", '"x"', "null", "{}", "true", "25.0"]
    bad = ["", "{", '{"a":1} x', "1]", "1, 2", "1}", "[1],[2]", '1,"v2":2', "NaN", '{"a":1,"a":2}', "{'a':1}"]
    got = one(spark, good + bad, jsontext.parse_json_strict(F.col("x")).isNotNull())
    assert got == [True] * len(good) + [False] * len(bad)


KINDS = {
    "25": "integer", "25.0": "integer", "25.5": "number", "true": "boolean", '"25"': "string",
    "12345678901234567890": "integer", "1e3": "integer", "1e300": "integer", "1.5e0": "number",
    "-0.5": "number", "null": "null", "[]": "array", "{}": "object", "[1,\"x\"]": "array",
    "123456789012345678901234567890123456789012345": "integer",
}


def test_kinds(spark):
    got = one(spark, list(KINDS), jsontext.kind_of(F.parse_json("x")))
    assert got == list(KINDS.values())


def test_truthiness_is_pythons(spark):
    texts = ['""', "null", "0", "0e5", "0.0", "-0.0", "[]", "{}", "false", '"x"', "1", "[0]", '{"a":null}', "true", "0.1"]
    got = one(spark, texts, jsontext.is_truthy(F.parse_json("x")))
    assert got == [bool(json.loads(t)) for t in texts]
    assert one(spark, [None], jsontext.is_truthy(F.parse_json("x"))) == [False]


PERSON = {
    "type": "object",
    "properties": {
        "name": {"type": "string"},
        "age": {"type": "integer"},
        "mood": {"type": "string", "enum": ["good", "bad"]},
        "notes": {"type": "array", "items": {"type": "object", "properties": {"t": {"type": "string"}}, "required": ["t"]}},
        "odd key": {"type": "number"},
    },
    "required": ["name", "age"],
}
CASES = [
    ('{"name":"a","age":25}', []),
    ('{"name":"a","age":25.0,"extra":1}', []),
    ('{"name":"a","age":12345678901234567890}', []),
    ('{"name":"a","age":25.5}', [("$.age", "type integer")]),
    ('{"name":"a","age":true}', [("$.age", "type integer")]),
    ('{"name":"a","age":"25"}', [("$.age", "type integer")]),
    ('{"name":"a","age":null}', [("$.age", "type integer")]),
    ('{"name":"a"}', [("$", "required age")]),
    ('{"name":"a","age":1,"mood":"fine"}', [("$.mood", "enum")]),
    ('{"name":"a","age":1,"mood":"good","odd key":1}', []),
    ('{"name":"a","age":1,"odd key":"1"}', [("$.odd key", "type number")]),
    ('{"name":"a","age":1,"notes":[]}', []),
    ('{"name":"a","age":1,"notes":[{"t":"x"},{"t":5},{},7]}',
     [("$.notes[1].t", "type string"), ("$.notes[2]", "required t"), ("$.notes[3]", "type object")]),
    ("[1]", [("$", "type object")]),
    ("no json", [("$", "parse")]),
    ('{"name":"a","age":1} trailing', []),
    ('{"name":"a","age":1,"age":2}', [("$", "parse")]),
    ('{"name":"a","age":NaN}', [("$", "parse")]),
    ('x {"name":"a","age":1} y {"name":"b","age":2}', [("$", "parse")]),
    ('```json\n{"name":"å","age":1}\n```', []),
]


def test_validator_table(spark):
    df = spark.createDataFrame(list(enumerate(c[0] for c in CASES)), "i int, raw string")
    rows = d.validate_documents(df, PERSON).orderBy("i").collect()
    got = [sorted((v.path, v.rule) for v in r.violations) for r in rows]
    assert got == [sorted(c[1]) for c in CASES]
    assert [r.valid for r in rows] == [not c[1] for c in CASES]


def test_strict_keys_and_scalar_enums(spark):
    strict = {**PERSON, "additionalProperties": False}
    mixed = {"enum": [1, True, None, "x"]}
    got = one(
        spark,
        ['{"name":"a","age":1,"zz":1,"b":2}', '{"name":"a","age":1}'],
        d.violations(F.parse_json("x"), strict),
    )
    assert [[v.rule for v in r] for r in got] == [["unknown key b", "unknown key zz"], []]
    got = one(spark, ["1", "1.0", "true", "null", '"x"', "2", "false", '"1"'], F.size(d.violations(F.parse_json("x"), mixed)))
    assert got == [0, 0, 0, 0, 0, 1, 1, 1]
    with pytest.raises(ValueError):
        d.violations(F.col("x"), {"minLength": 1})


def test_shape_from_template(spark):
    shape = d.shape_from_template(
        {"a": None, "b": True, "i": 0, "f": 0.5, "s": "", "e": [], "l": [{"x": ""}], "o": {"n": 1}}
    )
    props = shape["properties"]
    assert props["a"] == {} and props["e"] == {"type": "array", "items": {}}
    assert [props[k]["type"] for k in "bifs"] == ["boolean", "integer", "number", "string"]
    assert props["l"]["items"]["required"] == ["x"] and props["o"]["additionalProperties"] is False
    assert shape["required"] == ["a", "b", "i", "f", "s", "e", "l", "o"]
    good = '{"a":[1],"b":false,"i":3,"f":1,"s":"x","e":[1,"y"],"l":[{"x":"q"}],"o":{"n":2}}'
    bad = '{"a":1,"b":0,"i":3.5,"f":"1","s":1,"e":{},"l":[{"y":"q"}],"o":{"n":2,"m":1}}'
    got = one(spark, [good, bad], d.violations(F.parse_json("x"), shape))
    assert got[0] == []
    assert {v.path for v in got[1]} == {"$.b", "$.i", "$.f", "$.s", "$.e", "$.l[0]", "$.o"}
    typed = d.typed_documents(spark.createDataFrame([(good,)], "document string"), shape)
    row = typed.select("doc.i", "doc.l", "doc.o.n", F.to_json("doc.a").alias("a")).collect()[0]
    assert (row.i, row.l[0].x, row.n, row.a) == (3, "q", 2, "[1]")


def attempts(spark):
    ok, bad = '{"name":"a","age":%d}', '{"name":"a","age":"x"}'
    rows = [
        ("third", 2, ok % 3), ("third", 0, "junk"), ("third", 1, bad),
        ("first", 1, ok % 9), ("first", 0, "so: " + ok % 1 + " done"),
        ("never", 0, "junk"), ("never", 2, bad), ("never", 1, "junk"),
        ("late", 3, ok % 4), ("late", 0, "junk"), ("late", 1, bad),
    ]
    return spark.createDataFrame(rows, "conversation_id string, attempt int, raw string")


def test_first_valid_attempt(spark):
    rows = {r.conversation_id: r for r in d.first_valid_attempt(attempts(spark), PERSON).collect()}
    assert (rows["third"].attempt, rows["first"].attempt) == (2, 0)
    assert json.loads(rows["first"].document) == {"name": "a", "age": 1}
    assert not rows["never"].ok and rows["never"].last_error == "$.age: type integer"
    assert not rows["late"].ok


def test_repair_queue(spark):
    rows = d.repair_queue(attempts(spark), PERSON, {"repair": "FIX"}).collect()
    assert [(r.conversation_id, r.attempt) for r in rows] == [("late", 2)]
    system, user = rows[0].messages
    assert system.role == "system" and json.dumps(PERSON) in system.content
    assert user.content.startswith("FIX\n") and user.content.endswith('{"name":"a","age":"x"}')
    assert "$.age: type integer" in user.content


def summary_text():
    return json.dumps(
        {
            "patient": {
                "name": "Test Person", "age": 40, "allergies": "None", "prior_anesthesia": "no",
                "current_surgery": "knee", "asa_classification": "ASA-I",
                "smoking_status": "never", "fasting_compliance": "compliant",
            },
            "questionnaire_answers": [{"question_id": "zz", "question": "made up", "answer": "?"}],
            "patient_questions": [{"question": "made up", "answer": "?"}],
            "red_flags": [
                {"category": "cardiac_risk", "severity": "low", "description": "one"},
                {"category": "other", "severity": "high", "description": "blåbær"},
            ],
            "notes": "n",
        }
    )


def test_summary_documents(spark):
    shape = d.summary_shape()
    docs = spark.createDataFrame([("c1", summary_text()), ("c2", summary_text())], "conversation_id string, raw string")
    checked = d.validate_documents(docs, shape)
    assert [r.violations for r in checked.collect()] == [[], []]
    flat = d.summary_columns(checked).where("conversation_id = 'c1'").orderBy("flag_pos").collect()
    assert [(r.age, r.severity, r.description) for r in flat] == [(40, "low", "one"), (40, "high", "blåbær")]
    asked = spark.createDataFrame(
        [("c1", 1, "q2", "Two?", "b"), ("c1", 0, "q1", "One?", "")],
        "conversation_id string, pos int, question_id string, question string, answer string",
    )
    pairs = spark.createDataFrame(
        [("c1", 9, "why", "so"), ("c1", 2, "when", "")],
        "conversation_id string, seq bigint, question string, answer string",
    )
    rows = {(r.conversation_id, r.part): r.summary for r in d.assemble_summary(checked, asked, pairs).collect()}
    assert set(rows) == {("c1", 0), ("c2", 0)}
    c1, c2 = rows["c1", 0], rows["c2", 0]
    assert [(a.question_id, a.answer) for a in c1.questionnaire_answers] == [("q1", ""), ("q2", "b")]
    assert [(p.question, p.answer) for p in c1.patient_questions] == [("when", ""), ("why", "so")]
    assert c2.questionnaire_answers == [] and c2.patient_questions == [] and c2.patient.name == "Test Person"
    parts = d.assemble_summary(checked, asked, pairs, part_rows=1).where("conversation_id = 'c1'").orderBy("part").collect()
    assert [[p.question for p in r.summary.patient_questions] for r in parts] == [["when"], ["why"]]


def test_whole_numbers_in_any_writing_and_extra_keys(spark):
    shape = d.summary_shape()
    ages = ["25.0", "2.5e1", "25", "12345678901234567890"]
    texts = [summary_text().replace('"age": 40', f'"age": {a}, "inner": 1')[:-1] + ', "extra": [1, "x"]}' for a in ages]
    docs = spark.createDataFrame(list(enumerate(texts)), "conversation_id int, raw string")
    checked = d.validate_documents(docs, shape)
    assert all(r.valid for r in checked.collect())
    typed = d.typed_documents(checked, shape).orderBy("conversation_id").select("doc.patient.age", "unfit").collect()
    assert [r.age for r in typed] == [25, 25, 25, None]
    assert [r.unfit for r in typed] == [[], [], [], ["$.patient.age"]]
    pairs = spark.createDataFrame([], "conversation_id int, seq bigint, question string, answer string")
    asked = spark.createDataFrame([], "conversation_id int, pos int, question_id string, question string, answer string")
    rows = d.assemble_summary(checked, asked, pairs, shape).collect()
    assert len(rows) == 4 and all(r.extra == {"extra": '[1,"x"]'} for r in rows)
