"""The training-data operators against brute force, on awkward rows."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from dialogweave.llm import (
    decontamination, license_scan, ngram_join, sharding, suffix_dedup, token_rollup, topk_search, toxicity, warc,
)
from dialogweave.llm import sentencepiece_codec as spc
from dialogweave.llm.queries import tokenizer

MODEL = tokenizer("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_tokens string, root int, block string"
WORDS = [f"w{i}" for i in range(60)]


def _prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


BASE = _prose(1, 120)
TEXTS = [
    None, "", "   ", "one", "one two", "One TWO", BASE, BASE, BASE.upper(), BASE + " tail", BASE.replace("w1 ", "x ", 1),
    "start " + _prose(2, 40) + " " + BASE[:200] + " " + _prose(3, 20), _prose(4, 6000), _prose(4, 6000) + " more",
    "a" * 3000, "é" * 200 + "日本語" * 30, "tab\tand\nbreak \x00 \U0001f600", _prose(5, 10), _prose(5, 9),
]


def _rows():
    rows = [(i, t, "x", i, "b") for i, t in enumerate(TEXTS)]
    return rows + [(None, BASE, "x", 0, "b"), (None, None, None, None, None), (6, BASE, "x", 6, "b"), (4, "one two", "x", 4, "b")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sentencepiece(docs, empty):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = []
    for i, t, *_ in _rows():
        ids = lib.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest(), ids))
    got = [tuple(r) for r in spc.encode_documents(docs, MODEL, with_ids=True).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert spc.encode_documents(empty, MODEL).count() == 0


def test_sentencepiece_random_texts():
    lib, codec = sentencepiece.SentencePieceProcessor(model_file=MODEL), spc.PieceCodec(MODEL, cached=50)
    r = random.Random(7)
    texts = ["".join(r.choice(" ▁abehint.\n\té日😀\x00<>") for _ in range(r.randint(0, 40))) for _ in range(1500)]
    for t in texts + [" " * n + "x" for n in range(40)]:
        ids = lib.encode(t)
        assert codec.encode(t) == ids and codec.decode(ids) == lib.decode(ids)


def _shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(docs, size, percent):
    rows = [(r[0], _shingles(r[1], size)) for r in _rows()]
    home = list(range(len(rows)))
    for _ in rows:
        for i, (_, a) in enumerate(rows):
            for j, (_, b) in enumerate(rows):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    home[i] = home[j] = min(home[i], home[j])
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[home[i]] = min(least.get(home[i], doc), doc)
    want = [(doc, len(s), least.get(home[i]) if s else doc) for i, (doc, s) in enumerate(rows)]
    got = [tuple(r) for r in ngram_join.jaccard_components(docs, size, percent).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_jaccard_combinations_of_frequent_tokens():
    """Linked sets share a key even if all tokens are frequent or very frequent."""
    r = np.random.default_rng(5)
    for share in (0, 20, 230, 255):
        make = ngram_join.Signatures(bytes([share]) * (1 << 22), 15, 225, 80)
        for n in (4, 5, 9, 31, 64, 300):
            a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
            b = np.unique(np.append(a[: len(a) - len(a) // 10], r.integers(0, 1 << 63, len(a) // 12).astype(np.uint64)))
            both = len(np.intersect1d(a, b))
            if not np.array_equal(a, b) and 100 * both >= 80 * (len(a) + len(b) - both):
                assert set(make.of(a)) & set(make.of(b))


def test_jaccard_of_no_rows(empty):
    assert ngram_join.jaccard_components(empty).count() == 0


def _cut(rows):
    out = []
    for doc, text, *_ in rows:
        b = (text or "").encode()
        earlier = {x[p : p + 50] for d, t, *_ in rows if doc is not None and d is not None and d < doc for x in [(t or "").encode()] for p in range(len(x) - 49)}
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if b[p : p + 50] in earlier:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((doc, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("popular", [1000, 0])
def test_suffix_dedup(docs, monkeypatch, popular):
    monkeypatch.setattr(suffix_dedup, "POPULAR", popular)
    got = [tuple(r) for r in suffix_dedup.repeat_report(docs).collect()]
    assert sorted(got, key=str) == sorted(_cut(_rows()), key=str)


def test_suffix_dedup_keeps_columns(docs, empty):
    out = suffix_dedup.strip_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert {r.text for r in out.where("doc_id = 0").collect()} == {None}
    assert suffix_dedup.repeat_report(empty).count() == 0


def test_two_stage_order():
    r = random.Random(3)
    for alphabet in (b"a", b"ab", b"abc\x00", bytes(range(256))):
        for _ in range(40):
            data = bytes(r.choice(alphabet) for _ in range(r.randint(0, 70))) + bytes(24)
            order = suffix_dedup.two_stage_order(np.frombuffer(data, np.uint8), 16)
            keys = [(data + bytes(32))[i : i + 16] for i in order]
            assert sorted(order) == list(range(len(data))) and keys == sorted(keys)


def test_contained_items(spark, docs, empty):
    items = [(1, BASE[:150]), (2, "one two"), (3, None), (4, ""), (5, _prose(9, 30)), (6, " ".join(_prose(4, 6000).split()[50:90])), (1, BASE[:150])]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for doc, text, *_ in _rows():
        for item, t in set(items):
            words = (t or "").split()
            if words:
                size = min(5, len(words))
                a, b = _shingles(t, size), _shingles(text, size)
                if 100 * len(a & b) >= 80 * len(a):
                    want.append((doc, item, len(a), len(a & b)))
    got = [tuple(r)[:4] for r in decontamination.contained_items(docs, table).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and want
    assert decontamination.contained_items(empty, table).count() == 0
    assert decontamination.contained_items(docs, table.limit(0)).count() == 0
    kept = decontamination.clean_documents(docs, table)
    assert kept.columns == docs.columns and kept.where("doc_id = 6").count() == 0 and kept.where("doc_id is null").count() == 2


def test_toxicity_held_out(spark):
    r = random.Random(11)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        words = [r.choice(WORDS) for _ in range(40)] + ([f"awful{r.choice(WORDS)}" for _ in range(4)] if bad else [])
        rows.append((i, " ".join(words), "p", 1))
        if i % 2:
            labels.append((i, int(not bad or i % 3 > 0), int(bad)))
    rows += [(None, None, None, None), (900, "", None, None), (901, "awfulzz awfulyy awfulw1 awfulw2 awfulw3 ok ok", "p", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string, quality int")
    table = spark.createDataFrame(labels + [(None, 1, 1), (3, None, 1)], "doc_id long, quality int, toxic int")
    got = {x.doc_id for x in toxicity.rejected_documents(docs, table).collect()}
    held = [i for i in range(600) if i % 2 == 0]
    assert sum((i in got) == (i % 5 == 0) for i in held) >= 0.95 * len(held)
    assert 901 in got and 900 not in got and None not in got
    scores = toxicity.toxicity_scores(docs, table)
    assert scores.columns == ["doc_id", "p_low_quality", "p_toxic", "toxic"] and scores.count() == len(rows)
    kept = toxicity.keep_clean(docs, table)
    assert kept.columns == docs.columns and kept.count() == len(rows) - len(got)
    assert toxicity.rejected_documents(docs, table.limit(0)).count() == 0


def test_chain_uses_out_of_fold_predictions():
    r = np.random.default_rng(2)
    first = r.random(300) < 0.4
    words = np.where(first, 7, 9).astype(np.uint64)
    chain = toxicity.fit_chain(words, np.arange(300), [first, first & (r.random(300) < 0.9)])
    assert len(chain) == 2 and len(chain[0].earlier) == 0 and chain[1].earlier[0] > 0


def test_sharding(docs, empty):
    rows = [tuple(r) for r in sharding.balanced_shards(docs).collect()]
    assert len(rows) == len(_rows())
    slots = collections.defaultdict(list)
    for doc, size, crc, law, shard, slot, grown, _ in rows:
        slots[shard].append(slot)
        assert law == "bytes" and grown is None and 0 <= shard < 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.balanced_shards(empty).count() == 0


def test_sharding_is_even_with_a_hot_group(spark):
    rows = [(i, BASE if i % 3 == 0 else _prose(i, 20 + i % 50)) for i in range(3000)]
    got = sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string"))
    sums = [r[0] for r in got.groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(sums) == 8 and max(sums) - min(sums) < 0.03 * sum(sums) / 8


def test_place_prefers_residual_capacity():
    items = np.array([[8, 1, 1], [8, 1, 1], [1, 8, 1], [1, 8, 1]])
    chosen = sharding.place(items, 2)
    assert chosen[0] != chosen[1] and chosen[2] != chosen[3]


def test_license_scan(spark, docs, empty):
    texts = {
        1: "Released under the MIT License.", 2: "Licensed under the Apache License, Version 2.0.", 3: "cc-by-nc CC BY-NC 4.0 x",
        4: "GNU General Public License, version 3", 5: None, 6: "", 7: "limits of cc by", 8: "écc by nc", 9: "Under, the MIT\nlicense! under the mit license",
    }
    table = spark.createDataFrame([(i, t, "z") for i, t in texts.items()], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(table).collect()}
    assert got[1].base_labels == got[1].labels == "mit" and got[1].first_word == 1
    assert got[2].labels == "apache-2" and got[2].n_base == 1
    assert (got[3].n_base, got[3].first_word, got[3].last_word, got[3].base_labels) == (2, 0, 3, "cc-by-nc")
    assert "cc-by-nc-4" in got[3].labels.split(",") and "gpl-3" in got[4].labels.split(",")
    assert "gpl" not in got[4].labels.split(",")  # within the longer detection
    assert got[5].n_words == got[6].n_words == 0 and got[5].first_word is None and got[5].score == 0
    assert got[7].n_base == 0 and got[8].n_base == 0 and got[8].n_words == 3
    assert (got[9].n_base, got[9].first_word, got[9].last_word) == (2, 0, 4)
    for r in license_scan.scan_licenses(docs).collect():
        assert r.n_base == 0
    counts = [(r.doc_id, r.n_words) for r in license_scan.scan_licenses(docs).collect()]
    want = [(d, len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()))) for d, t, *_ in _rows()]
    assert sorted(counts, key=str) == sorted(want, key=str)
    assert license_scan.scan_licenses(empty).count() == 0


def test_token_rollup(spark, tmp_path):
    rollup = token_rollup.TokenRollup(spark, str(tmp_path / "rollup"))
    assert rollup.totals().count() == 0
    make = lambda rows: spark.createDataFrame(rows, token_rollup.CHANGES + ", n_docs string")
    first = make([("1", "insert", "a", "en", None, None, "v1", 10, "x"), ("1", "insert", "a", "en", None, None, "v1", 10, "x"), ("2", "insert", None, "en", None, None, "v1", None, "x"), (None, "insert", "a", "en", None, None, "v1", 5, "x")])
    assert rollup.commit("b1", first) and not rollup.commit("b1", first)
    assert rollup.commit("b2", make([("1", "revise", "a", "en", "v1", 10, "v2", 12, "x"), ("9", "delete", None, "en", "v1", 0, None, None, "x")]))
    assert rollup.commit("b3", first.limit(0))
    got = sorted((tuple(r) for r in rollup.totals().collect()), key=str)
    assert got == sorted([("a", "en", "v1", 1, 5), ("a", "en", "v2", 1, 12)], key=str)
    with pytest.raises(Exception, match="unknown action"):
        rollup.commit("b4", make([("1", "move", "a", "en", None, None, "v1", 1, "x")]))
    assert not rollup.committed("b4")


def test_top_inner_products(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.normal(size=6)], i) for i in range(300)]
    rows += [(300, rows[0][1], 0), (20, rows[20][1], 20), (400, None, 0), (420, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (440, [float("nan")] * 6, 0), (460, [1.0, 2.0], 0), (None, [1.0] * 6, 0), (480, [], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = collections.defaultdict(list)
    for q, rank, v, s in sorted(tuple(x) for x in topk_search.top_inner_products(table, F.col("vec_id") % 20 == 0, k=7).collect()):
        got[q].append((v, s))
        assert rank == len(got[q])
    points = {i: np.floor(64 * np.array(v)).astype(int) for i, v, _ in rows[:301]}
    for q in [i for i in points if i % 20 == 0]:
        want = sorted(((-int(points[q] @ x), i) for i, x in points.items() if i != q))[:7]
        assert got[q] == [(i, -s) for s, i in want]
    assert set(got) == {i for i in points if i % 20 == 0}
    assert topk_search.top_inner_products(table.limit(0), F.lit(True)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "u1", "<p>" + BASE), (2, "u2", "<p>" + BASE), (3, None, None), (4, "u", ""), (None, "u\n", "<p>" + BASE), (1, "u1", "<p>" + BASE), (5, "é", "日本" * 50000)]
    pages += [(i, f"http://x/{i}", f"<html>{_prose(i, 80)}</html>") for i in range(10, 60)]
    table = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, refers_to string")
    path = str(tmp_path / "archive")
    got = warc.archive_round_trip(table, path).collect()
    least = {}
    for p, _, h in pages:
        if p is not None:
            least[h or ""] = min(least.get(h or "", p), p)
    want = []
    for p, _, h in pages:
        raw = (h or "").encode()
        refers = least[h or ""] if p is not None and least[h or ""] < p else None
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if refers else "response", refers, None if refers else raw))
    key = lambda x: str(x)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got), key=key) == sorted(want, key=key)
    for file in (tmp_path / "archive").glob("part-*"):
        stream = file.read_bytes()
        assert not stream or int.from_bytes(stream[:4], "little") == warc.DICTIONARY_FRAME
    assert warc.archive_round_trip(table.limit(0), str(tmp_path / "none")).count() == 0
    small = warc.archive_round_trip(table.where("page_id < 3"), str(tmp_path / "small"), min_bytes=10**6)
    assert {r.record_type for r in small.collect()} == {"response"}
