"""op7_token_counts on rows that lack or repeat a doc_id."""

import collections

import sentencepiece

from dialogweave.llm import token_rollup
from dialogweave.llm.queries import op7_token_counts, tokenizer


def test_totals_cover_every_row(spark, tmp_path):
    texts = {"a": "one two three", "b": "quite another text", "c": "copied text of some length", "n": None, "e": ""}
    rows = [
        (1, "a", "web", "en"), (1, "b", "web", "de"), (1, "a", "book", "en"), (1, "a", "book", "en"), (2, "c", "web", "en"),
        (3, "c", "web", "en"), (3, "b", "wiki", "en"), (None, "c", "web", "en"), (None, "c", "web", "en"), (4, "n", None, "en"), (4, "e", "web", None),
    ]
    made = [(i, texts[t], s, g, len(texts[t] or "")) for i, t, s, g in rows]
    spark.createDataFrame(made, "doc_id long, text string, source string, lang string, n_chars long").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    least = {}
    for i, text, *_ in made:
        if text is not None and i is not None:
            least[text] = min(least.get(text, i), i)
    lib, want = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model")), collections.Counter()
    for i, text, source, lang, _ in made:
        if i is None or i <= least.get(text, i):
            want[source, lang, "piece_bpe_32k", "docs"] += 1
            want[source, lang, "piece_bpe_32k", "tokens"] += len(lib.encode(text or ""))
    got = {}
    for r in op7_token_counts(spark, str(tmp_path)).collect():
        got[r.source, r.lang, r.tokenizer_version, "docs"] = r.n_docs
        got[r.source, r.lang, r.tokenizer_version, "tokens"] = r.n_tokens
    assert got == dict(want)


def _changes(spark, rows):
    return spark.createDataFrame(rows, token_rollup.CHANGES)


def _insert(i, tokens, source="a"):
    return (str(i), "insert", source, "en", None, None, "v1", tokens)


def _totals(rollup):
    return sorted(tuple(r) for r in rollup.totals().collect())


def test_a_dead_job_does_not_count(spark, tmp_path):
    rollup = token_rollup.TokenRollup(spark, str(tmp_path / "r"))
    assert rollup.commit("b1", _changes(spark, [_insert(1, 10)]))
    effects = token_rollup.signed_effects(_changes(spark, [_insert(1, 10)]))
    effects.write.parquet(str(tmp_path / "r/data/b2-dead"))  # the job ended, the driver died before its commit
    (tmp_path / "r/data/b2-dead/_SUCCESS").unlink()
    (tmp_path / "r/commits/.draft").write_text("{")
    assert not rollup.committed("b2") and _totals(rollup) == [("a", "en", "v1", 1, 10)]
    assert rollup.commit("b2", _changes(spark, [_insert(1, 10)])) and _totals(rollup) == [("a", "en", "v1", 2, 20)]
    assert rollup.remove_unused() == 1 and _totals(rollup) == [("a", "en", "v1", 2, 20)]


def test_one_of_two_drivers_counts(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "r")
    slow, fast = token_rollup.TokenRollup(spark, path), token_rollup.TokenRollup(spark, path)
    monkeypatch.setattr(slow, "committed", lambda batch: False)  # it looked before the other's commit
    assert fast.commit("b", _changes(spark, [_insert(1, 5)]))
    assert not slow.commit("b", _changes(spark, [_insert(1, 7)]))
    assert _totals(fast) == [("a", "en", "v1", 1, 5)] and len(fast._names("data")) == 1


def test_compaction_keeps_totals_and_commits(spark, tmp_path, monkeypatch):
    rollup = token_rollup.TokenRollup(spark, str(tmp_path / "r"))
    assert not rollup.compact()
    for i in range(4):
        rollup.commit(f"b{i}", _changes(spark, [_insert(i, 10 + i, source="ab"[i % 2])]))
    rollup.commit("gone", _changes(spark, [("9", "delete", "b", "en", "v1", 24, None, None), ("8", "delete", "b", "en", "v1", 0, None, None)]))
    want = _totals(rollup)
    assert want == [("a", "en", "v1", 2, 22)] and rollup.compact() and _totals(rollup) == want and not rollup.compact()
    assert not rollup.commit("b1", _changes(spark, [_insert(1, 99)]))
    rollup.commit("more", _changes(spark, [_insert(5, 1)]))
    want = [("a", "en", "v1", 3, 23)]
    assert _totals(rollup) == want and rollup.remove_unused() == 5 and _totals(rollup) == want
    assert len(rollup._names("data")) == 2
    late = token_rollup.TokenRollup(spark, rollup.path)
    monkeypatch.setattr(late, "_base", lambda base=late._base(): base)  # it read the base before the other's
    assert rollup.compact() and not late.compact() and _totals(rollup) == want
    assert len(rollup._names("bases")) == 2 and rollup.remove_unused() == 2 and _totals(rollup) == want
