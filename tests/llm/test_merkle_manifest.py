"""The Merkle manifest against a plain tree, on awkward rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from dialogweave.llm.merkle_manifest import folded, manifest, verified_manifest

SCHEMA = "doc_id long, source string, text string, leaf string, idx long, n int, tree string, digest string, root string"
FIELDS = ["doc_id", "source", "text"]


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _tree(level, fanout):
    proofs, under = [[] for _ in level], [[i] for i in range(len(level))]
    while len(level) > 1:
        above, joined = [], []
        for i in range(0, len(level), fanout):
            run = level[i : i + fanout]
            for j in range(len(run)):
                for leaf in under[i + j]:
                    proofs[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
            above.append(_h(*run))
            joined.append(sum(under[i : i + fanout], []))
        level, under = above, joined
    return level[0], proofs


def _brute(rows, fanout):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0], _h(*map(_enc, r[:3]))))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = _tree([leaf for _, leaf in by[s]], fanout)
    root, upper = _tree([trees[s][0] for s in names], fanout)
    out = []
    for s, up in zip(names, upper):
        for (i, leaf), proof in zip(by[s], trees[s][1]):
            out.append((i, leaf, trees[s][0], root, tuple(proof + up)))
    return sorted(out, key=str)


def _rows():
    rows = [(i, "hot", f"text {i}\nend", None, i, 1, "x", "y", "z") for i in range(40)]
    rows += [(i, f"s{i % 7}", None if i % 5 == 0 else "é" * i, None, i, 1, "x", "y", "z") for i in range(100, 160)]
    rows += [(None, None, None, None, 0, 0, None, None, None), (None, "hot", "", None, 0, 0, None, None, None)]
    rows += [(7, "hot", "again", None, 0, 0, None, None, None)] + [(7, "hot", "same", None, 0, 0, None, None, None)] * 9
    rows += [(1, "", "empty name", None, 0, 0, None, None, None), (2, "ß", "x" * 500_000, None, 0, 0, None, None, None)]
    return rows + [(3, "z", "lone", None, 0, 0, None, None, None), (4, "\U0001f600", "astral", None, 0, 0, None, None, None)]


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_manifest(spark, fanout):
    rows = _rows()
    got = manifest(spark.createDataFrame(rows, SCHEMA), FIELDS, fanout=fanout).collect()
    flat = [(r.doc_id, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.proof)) for r in got]
    assert sorted(flat, key=str) == _brute(rows, fanout)


def test_tampering_is_seen(spark):
    rows = spark.createDataFrame(_rows(), SCHEMA)
    suspect = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    got = verified_manifest(rows, FIELDS, suspect, {"text": F.replace("text", F.lit("\n"), F.lit(""))}).collect()
    hot = [r for r in got if r.doc_id is not None and r.doc_id < 40 and r.doc_id not in (1, 2, 3, 4, 7)]
    assert hot and all(r.verified == (r.doc_id % 2 == 1) for r in hot)
    assert all(r.verified for r in got if r.doc_id is None or r.doc_id >= 100)
    assert all((r.folded_root == r.root) == r.verified for r in got)


def test_one_row_and_none(spark):
    one = spark.createDataFrame(_rows()[:1], SCHEMA)
    row = manifest(one, FIELDS).first()
    assert row.leaf == row.subroot == row.root == row.presented and row.proof == []
    got = verified_manifest(one, FIELDS, F.lit(False), {}).first()
    assert got.verified and got.proof_sha256 == hashlib.sha256(b"").hexdigest()
    assert manifest(one.limit(0), FIELDS).count() == 0


def test_order_of_partitions_does_not_matter(spark):
    rows = spark.createDataFrame(_rows(), SCHEMA)
    roots = {manifest(rows.repartition(n), FIELDS).agg(F.max("root")).first()[0] for n in (1, 7)}
    assert len(roots) == 1


def test_folding_a_foreign_proof_fails(spark):
    made = manifest(spark.createDataFrame(_rows(), SCHEMA), FIELDS).where("doc_id in (10, 11)")
    a, b = sorted(made.collect())
    mixed = spark.createDataFrame([(a.leaf, b.proof, a.root)], "leaf string, proof array<struct<left:string,right:string>>, root string")
    assert not mixed.select(folded(F.col("leaf"), F.col("proof")) == F.col("root")).first()[0]
