"""The training-data pipeline: five stages over documents, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's
result to the shared folder and reads it again as the next one's input. All stages but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogweave.llm import decontamination, ngram_join, sentencepiece_codec, suffix_dedup, toxicity
from dialogweave.llm.common import table, written
from dialogweave.llm.queries import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier chain, trained on labels, rejects."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that with the smallest doc_id; of groups without any doc_id
    one row too. Documents link from 80 % of their shingles of five words. The decision is the
    row's: other texts under the doc_id of a row that goes, stay."""
    return ngram_join.without_near_copies(docs, size=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings of 50 bytes that an earlier document has; n_chars follows."""
    cut = suffix_dedup.strip_repeats(docs, length=50)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that hold 80 % of the five-word shingles of a benchmark item, with or
    without doc_id. Items of fewer than five words have no shingle and drop nothing."""
    items = table(spark, sf_dir, "benchmark")
    return decontamination.clean_documents(docs, items, size=5, percent=80, short_items=False, spare_null_ids=False)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, with digests of the ids and of what they decode to."""
    return sentencepiece_codec.encode_documents(docs, tokenizer("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: Trained models, suffix sorting and merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
