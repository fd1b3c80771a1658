"""One query per operator, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogweave.llm import (
    decontamination,
    license_scan,
    merkle_manifest,
    ngram_join,
    sentencepiece_codec,
    sharding,
    spelling_variants,
    suffix_dedup,
    token_rollup,
    topk_search,
    toxicity,
    url_filter,
    warc,
)
from dialogweave.llm.common import table, written
from dialogweave.session import shared_folder


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles have five words, as in the SQL: items of fewer have none and are not searched."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.contained_items(docs, items, size=5, percent=80, short_items=False)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), size=3, percent=90)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the chain rejects, with their probabilities."""
    return toxicity.rejected_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(table(spark, sf_dir, "documents"), shards=8)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("detections")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches over all documents: an estimate by length when a document
    arrives, the exact count in its place, and the deletion of copies of earlier texts. The
    second batch is then sent again, which must change nothing; before the third, the first two
    are compacted into the maintained total. A change is named by the number
    its row got when the counts were written: rows may lack or repeat a doc_id, each counts."""
    docs = table(spark, sf_dir, "documents").withColumns({"digest": F.md5("text"), "row": F.monotonically_increasing_id()})
    keep = ["row", "doc_id", "source", "lang", "n_chars", "digest"]
    counted = written(token_rollup.count_tokens(docs, tokenizer("piece_bpe_32k.model"), keep), "counted")
    change = F.col("row").cast("string").alias("change_id")
    estimate = F.ceil(F.col("n_chars") / 4).cast("long")
    none, zero = F.lit(None).cast("string"), F.lit(None).cast("long")

    def changes(rows: DataFrame, action: str, old: tuple, new: tuple) -> DataFrame:
        return rows.select(
            change, F.lit(action).alias("action"), "source", "lang", old[0].alias("old_version"), old[1].alias("old_tokens"),
            new[0].alias("new_version"), new[1].alias("new_tokens"),
        )

    guess, exact = (F.lit("estimate"), estimate), (F.lit("piece_bpe_32k"), F.col("n_tokens"))
    first = counted.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least"))
    copies = counted.join(first, "digest").where("doc_id > least")
    rollup = token_rollup.TokenRollup(spark, shared_folder(spark, "rollup"))
    rollup.commit("load", changes(counted, "insert", (none, zero), guess))
    revised = changes(counted, "revise", guess, exact)
    rollup.commit("count", revised)
    rollup.compact()
    rollup.commit("copies", changes(copies, "delete", exact, (none, zero)))
    rollup.commit("count", revised)
    return rollup.totals()


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_report(table(spark, sf_dir, "documents"), length=50)


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search.top_inner_products(vectors, F.col("vec_id") % 20 == 0, k=20, scale=64)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).drop("url", "payload")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 2 divides the CRC of the decimal doc_id, the text comes back without its line feeds;
    a row without doc_id comes back as it is."""
    suspect = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    return merkle_manifest.verified_manifest(
        table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"],
        suspect, {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))},
    )


URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variant_groups(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_decontamination": op2_decontamination,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_toxicity": op4_toxicity,
    "op5_sharding": op5_sharding,
    "op6_license_scan": op6_license_scan,
    "op7_token_counts": op7_token_counts,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_topk_search": op9_topk_search,
    "op10_warc": op10_warc,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_url_filter": op12_url_filter,
    "op13_spelling_variants": op13_spelling_variants,
}
