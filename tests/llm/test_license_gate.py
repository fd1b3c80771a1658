"""The licence scan's gate lets through every text that a rule or base phrase can match."""

import re

from dialogweave.llm import license_rules, license_scan


def _shortest(pattern):
    """The shortest text that the pattern matches."""
    text = re.sub(r"\[(?:\d-\d|(.)[^]]*)\]", lambda m: m[1] or "0", pattern)
    text = re.sub(r"(\w)\{2\}", r"\1\1", text)
    text = re.sub(r"[\w ]\?", "", text)
    while "(" in text:
        text = re.sub(r"\(\?:([^()]*)\)(\?)?", lambda m: "" if m[2] else min(m[1].split("|"), key=len), text)
    assert re.fullmatch(pattern, text)
    return text


def test_every_rule_passes_the_gate():
    for rule in license_rules.rules():
        text = _shortest(rule.pattern)
        for written in (text, f"({text.upper()})", "é " + text.replace(" ", "--") + "."):
            assert re.search(license_rules.GATE, written), (rule, written)
    for phrase, _ in license_rules.BASE:
        assert re.search(license_rules.GATE, phrase.upper())
    assert not re.search(license_rules.GATE, "komm mit nach Hause, limits submit 0 examples apple")


def test_scan_finds_every_rule_alone(spark):
    texts = ["Distributed under the EUPL 1.2", "Common Development and Distribution, 1.1", *(_shortest(r.pattern) for r in license_rules.rules())]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(table).select("doc_id", "labels", "score").collect()}
    assert got[0].labels == "eupl-1.2" and got[0].score == 0.72 and got[1].labels == "cddl"
    for i, rule in enumerate(license_rules.rules(), 2):
        assert got[i].labels and got[i].score >= rule.priority / 100, (rule, texts[i], got[i])
