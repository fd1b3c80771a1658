"""Benchmark items of fewer than five words: the query and its SQL follow one rule."""

import corpus_pipeline
from dialogweave.llm.oracles import OP2
from dialogweave.llm.queries import op2_decontamination
from tests.compare import duckdb

ITEMS = [(1, "rain"), (2, "all day long now"), (3, "it will rain all day"), (4, "it will rain all day long now"), (5, None), (6, " ")]
DOCS = [(1, "rain"), (2, "It will RAIN all day long now, or not"), (3, "so all day long now"), (4, None), (5, "it will rain all day long")]


def test_query_equals_sql_on_short_items(spark, tmp_path):
    for name, rows, schema in (("benchmark", ITEMS, "item_id long, text string"), ("documents", DOCS, "doc_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    con = duckdb.connect()
    for name in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = sorted(tuple(r) for r in op2_decontamination(spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(OP2).fetchall()) and got
    left = corpus_pipeline.drop_contaminated(spark, spark.createDataFrame(DOCS, "doc_id long, text string"), str(tmp_path))
    assert sorted(r.doc_id for r in left.collect()) == [1, 3, 4]


def test_the_memo_is_bounded_by_bytes_and_word_length(monkeypatch):
    from dialogweave.llm import sentencepiece_codec as spc
    from dialogweave.llm.queries import tokenizer

    monkeypatch.setattr(spc, "MEMO_BYTES", 20_000)
    codec = spc.PieceCodec(tokenizer("piece_bpe_32k.model"))
    lib = __import__("sentencepiece").SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    for i in range(400):
        text = f"word{i} again{i % 7} " + "日本語" * 40
        assert codec.encode(text) == lib.encode(text)
        joined, back = codec.encode_joined(text)
        assert joined == ",".join(map(str, lib.encode(text))) and back == lib.decode(lib.encode(text))
    assert len(codec.whole) + len(codec.whole.older) <= 140
    assert all(len(w) <= spc.MEMO_WORD for w in [*codec.whole, *codec.whole.older])
