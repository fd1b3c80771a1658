"""The licence scan against a plain scan in Python, and on long texts."""

import random
import re
import time

import pytest

from dialogweave.llm import license_rules, license_scan

RULES = license_rules.rules()
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _matches(norm, pattern):
    """Word intervals of the matches of a pattern of whole words."""
    for m in re.finditer(f" {pattern}(?= )", norm):
        at = norm.count(" ", 0, m.start())
        yield at, at + m[0].count(" ")


def _plain(text):
    words = _words(text)
    norm = "".join(" " + w for w in words) + " "
    places, base = [], set()
    for phrase, label in license_rules.BASE:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    found = [
        (a, b, r.priority, i, r.label)
        for i, r in enumerate(RULES) if r.keyword in norm for a, b in _matches(norm, r.pattern)
    ]

    def gives_way(d):
        for e in found:
            if e is not d and e[0] <= d[0] and e[1] >= d[1]:
                rank = lambda x: (x[2], x[1] - x[0], -x[3])
                if rank(e) > rank(d):
                    return True
        return False

    kept = sorted(d for d in found if not gives_way(d))
    return (
        len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
        ",".join(sorted(base | {d[4] for d in kept})), max((d[2] / 100 for d in kept), default=0.0), kept,
    )


def _pieces():
    strip = lambda p: re.sub(r"\(\?:|\)\??|\[(.)[^]]*\]|[?\\]", lambda m: m[1] or "", p).split("|")[0]
    return [strip(r.pattern) for r in RULES] + [p for p, _ in license_rules.BASE]


def _texts():
    r, pieces = random.Random(5), _pieces()
    filler = ["the", "license", "version", "2", "0", "under", "mit", "cc", "by", "nc", "sa", "Apache", "é", "gnu", "general", "public", "bsd", "or", "later"]
    texts = [None, "", " ", "no notice here", "cc by nc cc by nc", "cc by nc nd 4 0 cc-by-nc", "MIT"]
    for _ in range(250):
        parts = [r.choice(pieces) if r.random() < 0.4 else r.choice(filler) for _ in range(r.randrange(1, 60))]
        texts.append("".join(p + r.choice([" ", "-", "\n", ", ", "  "]) for p in parts).replace("license", r.choice(["license", "LICENSE", "licence"])))
    return texts


def test_scan_equals_a_plain_scan(spark):
    texts = _texts()
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(table).collect()}
    assert len(got) == len(texts)
    suppressed = 0
    for i, text in enumerate(texts):
        r, want = got[i], _plain(text)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == want[:6], text
        assert r.score == pytest.approx(want[6])
        assert sorted(tuple(d) for d in r.detections) == want[7], text
        suppressed += len(want[7]) > 1
    assert suppressed > 100


def test_a_long_notice_takes_time_in_proportion(spark):
    notice = "Released under the MIT License. Apache License, Version 2.0; GNU General Public License v3 or later, cc by nc 4.0. "
    took = {}
    for n in (1, 2600, 26000):
        table = spark.createDataFrame([(1, notice * n)], "doc_id long, text string")
        start = time.time()
        row = license_scan.scan_licenses(table).collect()[0]
        took[n] = time.time() - start
        assert row.n_base == 3 * n and row.first_word == 1 and row.base_labels == "apache-2,cc-by-nc,mit"
        assert len(row.detections) == n * len(_plain(notice)[7])
    assert took[26000] < 60
