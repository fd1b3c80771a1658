"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is its set of word shingles. Items are partitioned by set size; the sketch of an item
is its k least hashes (MinHash), with k from the size of its partition such that a document
holding the threshold's share of the item must hold one of them: at most n - need of the n
shingles are missing, so n - need + 1 of them always meet. Documents too small for a partition
skip it. The search therefore misses nothing; candidates are verified by exact containment.

Items are the small side. They are sent to the tasks in chunks of bounded size (one pass over
the documents per chunk), so documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogweave.llm.common import written
from dialogweave.llm.textkit import U, flat, mix, shingle_hashes, slices, word_hashes

CHUNK_SHINGLES = 1 << 20


def _item_sets(items: DataFrame, size: int) -> DataFrame:
    """(item_id, words per shingle, packed shingles): an item of fewer words is one shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            words, to = word_hashes(data, offsets)
            width, packed = [], []
            for i in range(batch.num_rows):
                own = words[to[i] : to[i + 1]]
                width.append(min(size, len(own)))
                packed.append(np.unique(shingle_hashes(own, size)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(width, pa.int32()), pa.array(packed, pa.binary())],
                names=["item_id", "width", "shingles"],
            )

    return items.mapInArrow(run, "item_id long, width int, shingles binary").where("width > 0")


class Partition:
    """Items of one shingle width and one size class, with the index of their sketches."""

    def __init__(self, width: int, sizes: int, percent: int):
        self.width, self.percent, self.largest = width, percent, sizes
        self.items: list[tuple[int, np.ndarray]] = []

    def finish(self) -> Partition:
        needs = [self.need(len(s)) for _, s in self.items]
        self.smallest_document = min(needs)
        keys, owners = [], []
        for number, ((_, shingles), need) in enumerate(zip(self.items, needs, strict=True)):
            # k of the partition's largest size would do; an item's own size bounds it further.
            k = min(self.largest - self.need(self.largest), len(shingles) - need) + 1
            order = np.argsort(mix(shingles))[:k]
            keys.append(shingles[order])
            owners.append(np.full(len(order), number))
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], owners[order]
        return self

    def need(self, n: int) -> int:
        return -(-n * self.percent // 100)

    def candidates(self, hits: np.ndarray) -> np.ndarray:
        """The items whose sketch holds one of these shingles."""
        first = np.searchsorted(self.keys, hits, side="left")
        last = np.searchsorted(self.keys, hits, side="right")
        return np.unique(np.concatenate([self.owners[a:b] for a, b in zip(first, last, strict=True)]))


def _partitions(rows: list[tuple[int, int, bytes]], percent: int) -> list[Partition]:
    found: dict[tuple[int, int], Partition] = {}
    for item, width, packed in rows:
        shingles = np.frombuffer(packed, U)
        top = 1 << (len(shingles) - 1).bit_length()
        part = found.setdefault((width, top), Partition(width, top, percent))
        part.items.append((item, shingles))
    return [p.finish() for p in found.values()]


def _found(partitions: list[Partition], texts: pa.Array) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, its shingles, those of them in the text) of every text that holds an item."""
    widths = sorted({p.width for p in partitions})
    data, offsets = flat(texts)
    for first, last in slices(offsets):
        at = offsets[first : last + 1]
        words, to = word_hashes(data[at[0] : at[-1]], at - at[0])
        owner = np.repeat(np.arange(last - first), np.diff(to))
        for width in widths:
            if len(words) < width:
                continue
            tokens = shingle_hashes(words, width)
            inner = owner[: len(tokens)] == owner[width - 1 :]
            count = np.maximum(np.diff(to) - width + 1, 0)
            for part in partitions:
                if part.width != width:
                    continue
                place = np.minimum(np.searchsorted(part.keys, tokens), len(part.keys) - 1)
                hit = np.flatnonzero((part.keys[place] == tokens) & inner)
                hit = hit[count[owner[hit]] >= part.smallest_document]
                for doc in np.unique(owner[hit]):
                    whole = np.unique(tokens[to[doc] : to[doc] + count[doc]])
                    for number in part.candidates(tokens[hit[owner[hit] == doc]]):
                        item, shingles = part.items[number]
                        both = len(np.intersect1d(whole, shingles, assume_unique=True))
                        if both >= part.need(len(shingles)):
                            yield first + int(doc), item, len(shingles), both


def _search(partitions: list[Partition]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_found(partitions, batch.column(1)))
            rows, items, sizes, shared = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(items, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(shared, pa.int64()),
                ],
                names=["doc_id", "item_id", "n_item_shingles", "n_shared"],
            )

    return run


def _without(partitions: list[Partition], text: int, spared: int | None):
    """Batches without the rows whose text (a column's number) holds an item; where the column
    ``spared`` is NULL a row stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[row for row, *_ in _found(partitions, batch.column(text))]] = False
            if spared is not None:
                keep |= batch.column(spared).is_null().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(keep))

    return run


def _chunks(
    items: DataFrame, size: int, percent: int, item_id_col: str, item_text_col: str, short_items: bool
) -> Iterator[list[Partition]]:
    """The items as partitions, about CHUNK_SHINGLES shingles at a time."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    items = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    sets = _item_sets(items, size).distinct()
    sets = written(sets if short_items else sets.where(F.col("width") == size), "items")
    total = sets.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0
    chunks = -(-total // (8 * CHUNK_SHINGLES))
    for chunk in range(chunks):
        part = sets if chunks == 1 else sets.where(F.pmod(F.xxhash64("shingles"), F.lit(chunks)) == chunk)
        rows = [(r["item_id"], r["width"], bytes(r["shingles"])) for r in part.collect()]  # about CHUNK_SHINGLES
        if rows:
            yield _partitions(rows, percent)


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    size: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    short_items: bool = True,
) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment), one row per row of docs and
    item of which ``percent`` of the distinct shingles of ``size`` words occur in its text.

    Items of fewer words are searched as one shingle of their own length; without
    ``short_items`` they have no shingle and are in no document. Items that are NULL
    or without words are in no document; NULL and empty texts hold none. A NULL id stays NULL.
    Repeated rows of docs give repeated results; repeated item rows count once each id and
    text. No document without a hit returns a row. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, n_item_shingles long, n_shared long"
    found = docs.sparkSession.createDataFrame([], schema)
    for partitions in _chunks(items, size, percent, item_id_col, item_text_col, short_items):
        found = found.union(docs.mapInArrow(_search(partitions), schema))
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item_shingles"))


def clean_documents(
    docs: DataFrame,
    items: DataFrame,
    size: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    short_items: bool = True,
    spare_null_ids: bool = True,
) -> DataFrame:
    """docs without the rows in whose own text an item is found (see ``contained_items``), all
    columns kept; no shuffle and no join on the id. Rows with NULL id stay whatever they hold,
    unless ``spare_null_ids`` is False.

    Where the items are more than one chunk, what each but the last leaves is written."""
    schema = docs.schema
    spared = docs.columns.index(id_col) if spare_null_ids else None
    for chunk, partitions in enumerate(_chunks(items, size, percent, item_id_col, item_text_col, short_items)):
        if chunk:
            docs = written(docs, "cleaned")
        docs = docs.mapInArrow(_without(partitions, docs.columns.index(text_col), spared), schema)
    return docs
