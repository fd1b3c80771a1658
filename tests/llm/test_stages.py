"""The pipeline's stages on awkward rows (NULL and repeated ids, copies), exact row sets compared."""

import hashlib

import pytest
import sentencepiece

import corpus_pipeline
from dialogweave.llm.queries import tokenizer
from tests.llm.test_operators import BASE, _prose, _shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, gone long, component_id long"
A, B, C, D = (_prose(seed, 60) for seed in (21, 22, 23, 24))


def _rows(pairs):
    return [(i, t, "en", "web", len(t or ""), n, -n, 7) for n, (i, t) in enumerate(pairs)]


def _made(spark, pairs, schema=SCHEMA):
    return spark.createDataFrame(_rows(pairs), schema)


def _pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


#: NULL ids: a near copy of 3, a unique text, three copies without any id; 5 repeats with A
#: (unique) and a near copy of 3; 9 repeats one text.
AWKWARD = [
    (3, B), (None, B + " tail"), (None, A), (None, C), (None, C), (None, C + " end"), (5, D), (5, B + " other"),
    (9, BASE), (9, BASE), (9, BASE + " more"), (None, None), (None, None), (1, ""), (1, ""), (4, None), (2, "one two"), (8, "One TWO"),
]


def _one_each(pairs):
    """Brute force: the groups of linked rows, as lists of row numbers."""
    sets = [_shingles(t, 5) for _, t in pairs]
    home = list(range(len(pairs)))
    for _ in pairs:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    home[i] = home[j] = min(home[i], home[j])
    groups = {}
    for i, h in enumerate(home):
        groups.setdefault(h, []).append(i)
    return list(groups.values())


def test_near_duplicates_decide_on_rows(spark):
    out = corpus_pipeline.drop_near_duplicates(spark, _made(spark, AWKWARD), "")
    got = [tuple(r) for r in out.collect()]
    rows = _rows(AWKWARD)
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")] and set(got) <= set(rows)
    left = sorted(r[5] for r in got)
    groups = _one_each(AWKWARD)
    assert len(left) == len(set(left)) == len(groups)
    for group in groups:
        stayed = [i for i in group if i in left]
        assert len(stayed) == 1
        ids = [AWKWARD[i][0] for i in group if AWKWARD[i][0] is not None]
        assert AWKWARD[stayed[0]][0] == (min(ids) if ids else None)
    assert {(None, A), (5, D), (3, B)} < set(_pairs(out)) and (5, B + " other") not in _pairs(out)


def test_near_duplicates_of_no_rows(spark):
    assert corpus_pipeline.drop_near_duplicates(spark, _made(spark, AWKWARD).limit(0), "").count() == 0


ITEMS = [(1, A), (2, _prose(25, 30)), (3, None), (4, "")]


@pytest.fixture
def sf(spark, tmp_path):
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("chunk", [1 << 20, 30])
def test_decontamination_decides_on_rows(spark, sf, monkeypatch, chunk):
    monkeypatch.setattr(corpus_pipeline.decontamination, "CHUNK_SHINGLES", chunk)
    pairs = AWKWARD + [(6, "so " + A + " it"), (6, C), (None, _prose(25, 30)), (None, C), (7, A[: len(A) // 2])]
    held = [_shingles(t, 5) for _, t in ITEMS if t]
    clean = [r for r in _rows(pairs) if not any(100 * len(h & _shingles(r[1], 5)) >= 80 * len(h) for h in held)]
    out = corpus_pipeline.drop_contaminated(spark, _made(spark, pairs), sf)
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(clean, key=str)
    assert (6, C) in _pairs(out) and (None, A) not in _pairs(out) and len(clean) == len(pairs) - 3
    assert corpus_pipeline.drop_contaminated(spark, _made(spark, pairs).limit(0), sf).count() == 0


def _without_repeats(pairs):
    """Brute force: the texts without the strings of 50 bytes that a document of a smaller id has."""
    out = []
    for doc, text in pairs:
        earlier = {t[p : p + 50] for d, t in pairs if None not in (doc, d, t) and d < doc for p in range(len(t) - 49)}
        gone = {q for p in range(len(text or "") - 49) if text[p : p + 50] in earlier for q in range(p, p + 50)}
        out.append((doc, None if text is None else "".join(c for p, c in enumerate(text) if p not in gone)))
    return out


def test_suffix_dedup_cuts_rows(spark):
    pairs = AWKWARD + [(11, BASE[:80] + " new " + BASE[-70:]), (12, _prose(4, 400)), (13, "x" + _prose(4, 400)[100:900]), (13, BASE[:49])]
    out = corpus_pipeline.cut_repeats(spark, _made(spark, pairs), "")
    want = [
        (d, cut, "en", "web", None if cut is None else len(cut), *row[5:])
        for row, (d, cut) in zip(_rows(pairs), _without_repeats(pairs), strict=True)
    ]
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(want, key=str)
    assert corpus_pipeline.cut_repeats(spark, _made(spark, pairs).limit(0), "").count() == 0


def test_toxicity_judges_rows(spark, tmp_path):
    bad = " awful awful awful awful"
    pairs = [(i, _prose(i, 40) + (bad if i % 5 == 0 else "")) for i in range(100, 500)]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(100, 400)] + [(None, 1, 1), (401, None, 1)]
    pairs += [(None, C + bad), (None, C), (None, None), (450, C), (450, C), (451, C + bad), (7, ""), (7, "")]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.drop_toxic(spark, _made(spark, pairs), str(tmp_path))
    want = [r for r in _rows(pairs) if "awful" not in (r[1] or "")]
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(want, key=str)
    assert corpus_pipeline.drop_toxic(spark, _made(spark, pairs).limit(0), str(tmp_path)).count() == 0


def test_sentencepiece_encodes_rows(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for doc, text in AWKWARD:
        ids = lib.encode(text or "")
        want.append((doc, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)), ids))
    out = corpus_pipeline.encode(spark, _made(spark, AWKWARD), "")
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(want, key=str)
    assert corpus_pipeline.encode(spark, _made(spark, AWKWARD).limit(0), "").count() == 0
