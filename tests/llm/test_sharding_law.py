"""The law of op5's shards against counts in Python, with repeated rows and ids."""

import collections
import re
import zlib

import pytest

from dialogweave.llm import sharding


def _check(spark, rows, tolerance, whole=True):
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, row string").repartition(6)
    got = sharding.balanced_shards(docs).collect()
    want = collections.Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), len(re.findall(r"\S+", t or ""))) for i, t, *_ in rows
    )
    assert collections.Counter((r.doc_id, r.size, r.text_crc32, r.tokens) for r in got) == want
    slots, sums, homes = collections.defaultdict(list), collections.Counter(), collections.defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        sums[r.shard] += r.size
        homes[r.text_crc32, r.size].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    fair = sum(sums.values()) / 8
    assert len(sums) == 8 and max(sums.values()) - min(sums.values()) < tolerance * fair
    if whole:
        weight = collections.Counter()
        for r in got:
            weight[r.text_crc32, r.size] += r.size
        count = collections.Counter((r.text_crc32, r.size) for r in got)
        for group, shards in homes.items():
            if weight[group] < fair and count[group] < len(got) / 8:
                assert len(shards) == 1, group


def _text(i):
    return " ".join(f"w{(i * 31 + k) % 997}" for k in range(10 + i * 7 % 60))


@pytest.mark.parametrize("hot", [None, 7])
def test_a_third_of_rows_are_one_row(spark, hot):
    rows = [(hot, "the same text " * 14, "x", "y") if i % 3 == 0 else (i, _text(i), "x", "y") for i in range(3000)]
    _check(spark, rows, 0.03)


def test_null_and_empty_texts_and_null_ids(spark):
    rows = [(None, None, "x", "y")] * 900 + [(1, "", "x", "y")] * 900 + [(None if i % 2 else i, _text(i), "x", "y") for i in range(2000)]
    _check(spark, rows, 0.03)


@pytest.mark.parametrize(("runs", "tolerance"), [(32, 8 / 32), (512, 0.03)])
def test_more_groups_than_items(spark, monkeypatch, runs, tolerance):
    """Shards differ by an item at most, and an item is up to 1 / runs of all."""
    monkeypatch.setattr(sharding, "RUNS", runs)
    monkeypatch.setattr(sharding, "LARGE", 2 * runs)
    rows = [(i, _text(i) + f" t{i // 2}", "x", "y") for i in range(4000)]
    _check(spark, rows, tolerance)


def test_small_groups_are_their_own_items(spark):
    rows = [(str(i), 40 + i % 3, 8, 1) for i in range(500)]
    groups = spark.createDataFrame(rows, "group string, size long, tokens long, rows long")
    totals = groups.selectExpr("sum(size) size", "sum(tokens) tokens", "sum(rows) rows", "count(*) groups").first()
    assert all(r.item == r.group for r in sharding._runs(groups, totals).collect())
