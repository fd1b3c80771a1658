"""What suffix_dedup exchanges: how much, and that packing and short anchors lose nothing."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from dialogweave.llm import suffix_dedup
from tests.llm.test_operators import _cut, _prose, _rows


def _shuffled(plan):
    """Bytes that the exchanges of an executed plan wrote."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _shuffled(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _shuffled(plan.plan())
    metrics, below = plan.metrics(), plan.children()
    own = metrics.apply("shuffleBytesWritten").value() if metrics.contains("shuffleBytesWritten") else 0
    return own + sum(_shuffled(below.apply(i)) for i in range(below.size()))


def test_bytes_exchanged(spark):
    r = random.Random(8)
    half = [_prose(i, 150) for i in range(40)]
    pairs = [(i, _prose(1000 + i, 300) + " " + r.choice(half)) for i in range(400)]
    out = suffix_dedup.repeat_report(spark.createDataFrame(pairs, "doc_id long, text string"))
    assert len(out.collect()) == 400
    assert _shuffled(out._jdf.queryExecution().executedPlan()) < 0.9 * sum(len(t) for _, t in pairs)




def _chain(pairs, block_rows, buckets, length=50):
    """The operator's steps over blocks and buckets, in this process."""
    sha = lambda t: None if t is None else hashlib.md5(t.encode()).hexdigest()
    blocks = {}
    for i, (doc, text, *_) in enumerate(pairs):
        blocks.setdefault(i % (len(pairs) // block_rows + 1), []).append((doc, text))
    tables = {
        b: pa.table({
            "doc_id": pa.array([d for d, _ in rows], pa.int64()),
            "text": pa.array([None if t is None else suffix_dedup._shrunk(t.encode()) for _, t in rows], pa.binary()),
            "digest": pa.array([sha(t) for _, t in rows], pa.string()),
            "block": pa.array([b] * len(rows), pa.int32()),
        })
        for b, rows in blocks.items()
    }
    known = [(d, sha(t)) for d, t, *_ in pairs if None not in (d, t)]
    least = {}
    for d, s in known:
        least[s] = min(d, least.get(s, d))
    copies = [f"{d}:{s}" for d, s in known if d > least[s]]

    def grouped(rows, by):
        return {k: rows.filter(pc.equal(rows.column(by), k)) for k in set(rows.column(by).to_pylist())}

    def side(schema, found, b):
        none = [None] * len(copies)
        own = pa.table({"copy": pa.array(copies, pa.string()), found: pa.array(none, pa.binary())})
        return own if schema is None or b not in schema else pa.concat_tables([schema[b].select([found]).append_column("copy", pa.nulls(len(schema[b]), pa.string())).select(["copy", found]), own])

    anchors = pa.concat_tables([suffix_dedup._send_anchors(length, buckets)(t, side(None, "anchors", b)) for b, t in tables.items()])
    back = grouped(pa.concat_tables([suffix_dedup._return_anchors(t) for t in grouped(anchors, "bucket").values()]), "block")
    texts = pa.concat_tables([suffix_dedup._send_texts(length, buckets)(t, side(back, "anchors", b)) for b, t in tables.items()])
    spans = grouped(pa.concat_tables([suffix_dedup._find_spans(length)(t) for t in grouped(texts, "bucket").values()]), "block")
    return [tuple(r.values()) for b, t in tables.items() for r in suffix_dedup._cut(length, None, [])(t, side(spans, "spans", b)).to_pylist()]


@pytest.mark.parametrize("popular", [0, 3, 1000])
@pytest.mark.parametrize("bits", [0, 4, 40])
def test_short_anchors_lose_nothing(monkeypatch, popular, bits):
    """With few bits nearly all anchors collide: more texts meet, the cut bytes are the same."""
    short = suffix_dedup._short
    monkeypatch.setattr(suffix_dedup, "POPULAR", popular)
    monkeypatch.setattr(suffix_dedup, "_short", lambda h: short(h) & np.uint64((1 << bits) - 1))
    monkeypatch.setattr(suffix_dedup, "CHUNK", 4096)
    rows = [r for r in _rows() if len(r[1] or "") < 5000]
    rows += [(100 + i, _prose(i % 7, 60) + _prose(50 + i, 20)) for i in range(30)]
    got = _chain(rows, 8, 5)
    assert sorted(got, key=str) == sorted(_cut(rows), key=str)


def test_packed_columns():
    r = np.random.default_rng(2)
    kinds = [np.uint64, np.int32, np.int64, np.uint8]
    parts = []
    for n in (0, 1, 700):
        parts.append([r.integers(np.iinfo(k).min, np.iinfo(k).max, n, k, endpoint=True) for k in kinds])
    got = suffix_dedup._unpack([suffix_dedup._pack(p, kinds) for p in parts], kinds)
    for column, want in zip(got, zip(*parts, strict=True), strict=True):
        assert column.dtype == want[0].dtype and np.array_equal(column, np.concatenate(want))


def test_order_of_deep_groups():
    """Long common beginnings that differ late, in few bytes."""
    r = random.Random(6)
    parts = [_prose(1, 12)[:60] for _ in range(30)]
    parts += [p[:k] + r.choice("ab") + p[k + 1 :] for p in parts for k in r.choices(range(60), k=4)]
    data = "".join(parts).encode() + bytes(58)
    order = suffix_dedup.two_stage_order(np.frombuffer(data, np.uint8), 50)
    keys = [(data + bytes(58))[i : i + 50] for i in order]
    assert sorted(order) == list(range(len(data))) and keys == sorted(keys)
