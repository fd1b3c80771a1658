"""The join's turns on a group around the threshold, and scratch tables given back."""

import random
from pathlib import Path

import pytest

from dialogweave.llm import common, ngram_join
from dialogweave.llm.sentencepiece_codec import KEPT_WORDS, PieceCodec
from dialogweave.llm.queries import tokenizer


def _rows():
    """Variants of one text, most pairs of which lie close to 90 %, and texts with a passage of it."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    base = [r.choice(words) for _ in range(120)]
    rows = []
    for i in range(120):
        text = list(base)
        for _ in range(r.randint(0, 3)):
            text[r.randrange(120)] = r.choice(words)
        rows.append((r.randrange(10**6), " ".join(text)))
    for _ in range(60):
        text = [r.choice(words) for _ in range(r.randint(0, 60))]
        at = r.randrange(len(text) + 1)
        text[at:at] = base[:20]
        rows.append((r.randrange(10**6), " ".join(text)))
    return rows + [(None, rows[0][1]), (None, None), (5, ""), (5, "")]


def _shingles(text, size):
    words = (text or "").split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def _wanted(rows, size, percent):
    sets = [_shingles(t, size) for _, t in rows]
    home = list(range(len(rows)))

    def root(x):
        while home[x] != x:
            x = home[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                home[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return [(doc, len(s), least.get(root(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("turns", [1, 8])
def test_group_around_the_threshold(spark, tmp_path, monkeypatch, turns):
    monkeypatch.setattr(ngram_join, "TURNS", turns)
    paths = []
    monkeypatch.setattr(common, "shared_folder", lambda _, purpose: paths.append(str(tmp_path / f"{len(paths)}-{purpose}")) or paths[-1])
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in ngram_join.jaccard_components(docs, 3, 90).collect()]
    assert sorted(got, key=str) == sorted(_wanted(rows, 3, 90), key=str)
    left = sorted(Path(p).name.split("-")[1] for p in paths if Path(p).exists())
    assert left == ["roots", "rows"], left


def test_short_bitmaps_never_exclude_a_link(spark):
    rows = _rows()
    sets = [(t, list(ngram_join.shingle_sets(ngram_join.pa.array([t]), 3))[0]) for _, t in rows if t]
    made = spark.createDataFrame(
        [(t, len(s), *(int(x) for x in ngram_join.short_bits(s))) for t, s in sets],
        "text string, n long, " + ", ".join(f"{c} long" for c in ngram_join._SHORT),
    ).distinct()
    other = made.select(*(made[c].alias(f"o_{c}") for c in made.columns))
    passed = {(r[0], r[1]) for r in made.crossJoin(other).where(ngram_join._may_link("", "o_", 90)).select("text", "o_text").collect()}
    texts = {t: _shingles(t, 3) for t, _ in sets}
    links = {(a, b) for a in texts for b in texts if 100 * len(texts[a] & texts[b]) >= 90 * len(texts[a] | texts[b])}
    assert links <= passed and len(passed) < len(texts) ** 2 / 2


def test_memos_after_a_task():
    codec = PieceCodec(tokenizer("piece_bpe_32k.model"), cached=300_000)
    text = " ".join(f"word{i}" for i in range(KEPT_WORDS + 5000))
    before = codec.encode_joined(text)
    codec.end_task()
    assert len(codec.whole) == KEPT_WORDS and not codec.whole.older
    assert codec.encode_joined(text) == before
