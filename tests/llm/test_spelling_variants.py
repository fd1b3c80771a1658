"""Spelling variants against brute force, on awkward texts."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from dialogweave.llm import spelling_variants as sv

SCHEMA = "doc_id long, text string, word string, n int, root string"


def _words(rows, least, thin):
    counts = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % thin == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def _brute(rows, least=7, thin=31):
    words = _words(rows, least, thin)
    near = {w: [x for x in words if _near(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()), key=str)


def _rows(seed):
    r = random.Random(seed)
    base = ["spelling", "ààààààà", "variant", "aaaaaaaa", "Ünïcode", "grouping", "øøøøøøøø"]
    rows = []
    for i in range(120):
        words = []
        for _ in range(40):
            w = r.choice(base[: 1 + i % 7])
            if r.random() < 0.15:
                at = r.randrange(len(w))
                w = r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice("abÿ") + w[at:], w[:at] + r.choice("aéz") + w[at + 1 :]])
            words.append(w.upper() if r.random() < 0.1 else w)
        rows.append((i, r.choice([" ", ", ", "\n", "1", "日", "Ā"]).join(words), "c", 0, "c"))
    # Each ten times as frequent as the one before: a way of several steps.
    for k, w in enumerate(["stepping", "steppingx", "steppingxy", "steppingxyz"]):
        name = next(i for i in range(1000 + k, 10_000) if zlib.crc32(f"{i}:{w}".encode()) % 31)
        rows.append((name, " ".join([w] * 2 * 10**k), "c", 0, "c"))
    rows += [(None, "nullish nullish nullisk nullisk", "c", 0, "c"), (None, None, None, None, None), (5, "", "c", 0, "c")]
    rows += [(5, "repeats repeats", "c", 0, "c")] * 3 + [(6, "x" * 700 + " " + "x" * 700 + " " + "x" * 701 + " " + "x" * 350 + "y" + "x" * 349 + " a" * 5000, "c", 0, "c")] * 3
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_variants(spark, seed):
    rows = _rows(seed)
    got = sorted((tuple(r) for r in sv.variant_groups(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == _brute(rows)
    assert any(r[1] and r[1] != r[2] for r in got)


def test_empty(spark):
    assert sv.variant_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_several_shards_and_passes(spark):
    words = sorted(_words(_rows(3), 3, 5))
    table = spark.createDataFrame([(w,) for w in words], "word string")
    want = sorted((a, b) for a in words for b in words if _near(a, b))
    for shard_words, pass_bytes in ((1 << 19, 64 << 20), (20, 100), (50, 1000)):
        got = sorted(tuple(r) for r in sv.near_pairs(table, shard_words, pass_bytes).collect())
        assert got == want


def test_hashes_of_edits():
    alphabet = np.array(sorted(map(ord, "abcdefÿ")), np.uint32)
    for word in ("abcabc", "aab", "f", "ÿaÿ" * 5):
        made = {(int(h), n) for _, hs, n in sv.edits([word], len(word), alphabet) for h in hs}
        want = {word[:i] + word[i + 1 :] for i in range(len(word))}
        want |= {word[:i] + chr(c) + word[i + 1 :] for i in range(len(word)) for c in alphabet if c > ord(word[i])}
        assert made == {(sv.word_hash(w) if w else 0, len(w)) for w in want}


def test_filters_miss_nothing_and_pass_little():
    r = np.random.default_rng(1)
    inside, outside = r.integers(0, 1 << 63, 50_000, dtype=np.uint64), r.integers(0, 1 << 63, 200_000, dtype=np.uint64)
    longs = sv.bloom_of(inside)
    assert len(sv.in_bloom(longs, inside)) == len(inside) and len(longs) * 64 <= 16 * len(inside) + 512
    assert len(sv.in_bloom(longs, outside)) < 0.01 * len(outside)


def test_one_edit():
    r = random.Random(5)
    for _ in range(3000):
        a = "".join(r.choice("ab") for _ in range(r.randint(0, 6)))
        b = "".join(r.choice("ab") for _ in range(r.randint(0, 6)))
        assert sv._is_one_edit(a, b) == _near(a, b)
