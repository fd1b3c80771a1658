"""Keyed folders: repeated, failed and competing runs."""

import pytest

from dialogweave.sources import keyed

SCHEMA = "id long, t string, n string"


def _docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _read(spark, path):
    return sorted(tuple(r) for r in keyed.read_keyed(spark, path, SCHEMA).collect())


def test_runs(spark, tmp_path):
    path = str(tmp_path / "docs")
    first = [(i, f"t{i} é", None) for i in range(20)]
    assert keyed.read_lines(spark, path).count() == 0
    assert keyed.write_keyed(_docs(spark, first), path, ["id"], 4)
    before = keyed._manifest(spark, path)
    # A repeated run, also of a part, changes nothing.
    assert not keyed.write_keyed(_docs(spark, first + first[:5]), path, ["id"])
    assert not keyed.write_keyed(_docs(spark, first[:3]), path, ["id"])
    assert keyed._manifest(spark, path) == before
    # A new and a changed document leave the others, and rewrite their buckets only.
    assert keyed.write_keyed(_docs(spark, [(3, "new", "x"), (99, "z", None)]), path, ["id"])
    want = sorted([r for r in first if r[0] != 3] + [(3, "new", "x"), (99, "z", None)], key=lambda r: r[0])
    assert _read(spark, path) == want
    after = keyed._manifest(spark, path)
    moved = [b for b in after["generations"] if after["generations"][b] != before["generations"].get(b)]
    assert after["number"] == 2 and 1 <= len(moved) <= 2
    # What a dead run leaves is not seen, and can be removed.
    _docs(spark, [(7, "dead", None)]).write.json(f"{path}/generation-dead/_bucket=1")
    assert _read(spark, path) == want
    assert keyed.remove_unused(spark, path) >= 1 and _read(spark, path) == want


def test_the_slower_of_two_runs_fails(spark, tmp_path):
    path = str(tmp_path / "docs")
    keyed.write_keyed(_docs(spark, [(1, "a", None)]), path, ["id"])
    with pytest.raises(keyed.ConcurrentWrite):
        keyed._put(spark, path, {"number": 1, "buckets": 1, "generations": {}})
    assert _read(spark, path) == [(1, "a", None)]


def test_no_documents(spark, tmp_path):
    path = str(tmp_path / "docs")
    assert not keyed.write_keyed(_docs(spark, []), path, ["id"])
    assert _read(spark, path) == []
