"""The join's steps between turns: few scratch tables, the same components."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql.types import LongType, StructType

from dialogweave.llm import common, ngram_join, sentencepiece_codec
from dialogweave.llm.queries import tokenizer
from tests.llm.test_jaccard_turns import _wanted


def _roots(edges):
    home = {x: x for e in edges for x in e}

    def root(x):
        while home[x] != x:
            x = home[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        home[y] = x
    return {x: root(x) for x in home}


@pytest.fixture
def made(tmp_path, monkeypatch):
    """How many tables were written, by purpose."""
    count = Counter()

    def folder(_, purpose):
        count[purpose] += 1
        return str(tmp_path / f"{purpose}-{count[purpose]}")

    monkeypatch.setattr(common, "shared_folder", folder)
    return count


def test_stars_need_no_step(spark, made):
    edges = [(1, n) for n in range(2, 30)] + [(100, n) for n in range(101, 110)]
    found = common.components(spark.createDataFrame(edges, "a long, b long"))
    assert {(r.node, r.root) for r in found.collect()} == set(_roots(edges).items())
    assert made == {"edges": 1, "roots": 1}


def test_steps_keep_components(spark, made):
    r = random.Random(8)
    edges = [(r.randrange(150), r.randrange(150)) for _ in range(110)] + [(n, n + 1) for n in range(200, 240)]
    edges = [e for e in edges + edges[:20] if e[0] != e[1]]
    given = spark.createDataFrame(edges, "a long, b long")
    assert {(x.node, x.root) for x in common.components(given).collect()} == set(_roots(edges).items())
    nearer = [tuple(x) for x in common.nearer(given).select("a", "b").collect()]
    assert all(a >= b for a, b in nearer) and _roots([e for e in nearer if e[0] != e[1]]) == _roots(edges)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tables_of_a_turn(spark, made):
    """One step of the components a turn, also of long texts, on which the longer bitmap decides."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for _ in range(4):
        base = [r.choice(words) for _ in range(700)]
        for _ in range(15):
            text = list(base)
            for _ in range(r.randint(0, 24)):
                text[r.randrange(700)] = r.choice(words)
            rows.append((r.randrange(10**6), " ".join(text)))
    rows += [(None, rows[0][1]), (3, "a b"), (4, "a b"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(x) for x in ngram_join.jaccard_components(docs, 3, 90).collect()]
    assert sorted(got, key=str) == sorted(_wanted(rows, 3, 90), key=str)
    assert made["open"] == 1 and made["roots"] == 2
    turns = made["links"] - 1
    assert turns >= 1 and made["edges"] <= turns + 7


def test_what_is_made_of_rows_comes_in_pieces():
    table = pa.table({"id": range(2500), "text": [f"t{i}" for i in range(2500)]})
    got = list(common.pieces(iter([*table.to_batches(), *table.slice(0, 0).to_batches(), *table.slice(7, 3).to_batches()])))
    assert [b.num_rows for b in got] == [1024, 1024, 452, 3]
    assert sum((b.column(0).to_pylist() for b in got), []) == [*range(2500), 7, 8, 9]
    held = []

    class Docs:
        schema = StructType().add("id", LongType())

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    run = sentencepiece_codec.encode_documents(Docs(), tokenizer("piece_bpe_32k.model"), id_col="id", with_ids=True)
    for batch in run(iter(table.to_batches())):
        held.append(batch.num_rows)
    assert held == [1024, 1024, 452]
