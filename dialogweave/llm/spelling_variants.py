"""Grouping of spelling variants: words one edit apart, found through Bloom filters.

The vocabulary is put into blocked Bloom filters, one set per word length. Every word's possible
neighbours are generated as hashes (polynomial hashes follow from prefix sums, no edited string
is built) and probed against the broadcast filters; only the positives are shuffled, to an exact
join with the vocabulary that removes the false ones.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogweave.llm.common import written

U = np.uint64
#: Multiplier of the polynomial hash; its parts are added and multiplied modulo 2 ** 64.
_BASE = U(0x9E3779B97F4A7C15)
_WORDS_PER_BLOCK = 32
_BLOCK_LONGS = 8
_PROBES = 6
#: Words of this length and longer ones share their filters.
_LONG = 256
#: Edits hashed at a time.
_STEP = 1 << 20

_RUNS = re.compile("[a-zÀ-ÿ]+")


def word_counts(docs: DataFrame, least_points: int, thin: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of letters as found in the texts, counted over all documents.

    Runs are `[A-Za-z\\u00C0-\\u00FF]+`, with A-Z lower-cased. A run whose CRC-32 of ``id:run``
    ``thin`` divides loses the code point at CRC modulo its length. Results of fewer than
    ``least_points`` code points are left out. The CRC is the same for all equal runs of one
    document, so each document's runs are counted before they are altered; what is shuffled is
    one row per word and Arrow batch.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for name, text in zip(batch.column(0), batch.column(1)):
                body = text.as_py()
                if not body:
                    continue
                start = zlib.crc32((name.as_py() or "").encode() + b":")
                runs = Counter(r for r in _RUNS.findall(body.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")) if len(r) >= least_points)
                for run, n in runs.items():
                    h = zlib.crc32(run.encode(), start)
                    if h % thin == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least_points:
                            continue
                    found[run] += n
            yield pa.record_batch(
                [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"]
            )

    read = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t"))
    return read.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# --- hashes of words and of their edits -----------------------------------------------


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _values(points: np.ndarray) -> np.ndarray:
    """Spread values of code points; the hash of a word is the sum of value * BASE ** place."""
    return _mixed(points.astype(U) + U(1))


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, U)
    if n > 1:
        out[1:] = np.cumprod(np.full(n - 1, _BASE))
    return out


def _points(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def _hash_rows(points: np.ndarray) -> np.ndarray:
    return (_values(points) * _powers(points.shape[1])).sum(axis=1, dtype=U)


def word_hash(word: str) -> int:
    return int(_hash_rows(_points([word], len(word)))[0])


def _by_length(words: list[str]) -> dict[int, list[int]]:
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    return groups


def hashes_of(words: list[str]) -> np.ndarray:
    out = np.zeros(len(words), U)
    for length, at in _by_length(words).items():
        out[at] = _hash_rows(_points([words[i] for i in at], length))
    return out


def edits(words: list[str], length: int, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(place in ``words``, hash, length) of the edits of words of one length, in pieces.

    Every word loses each of its code points, and has each replaced by every greater one of the
    alphabet. Of two words one edit apart the longer, or the one whose code point is smaller,
    has the other among these, so each pair is generated once (more often where several
    deletions give the same word).
    """
    powers = _powers(length + 1)
    places = max(_STEP // max(len(alphabet), 1), 1)
    rows = max(places // length, 1)
    for first in range(0, len(words), rows):
        points = _points(words[first : first + rows], length)
        terms = _values(points) * powers[:length]
        whole = terms.sum(axis=1, dtype=U)
        after = np.cumsum(terms[:, ::-1], axis=1, dtype=U)[:, ::-1]
        before = whole[:, None] - after
        # What follows a lost code point moves down by one place.
        down = U(pow(int(_BASE), -1, 1 << 64))
        for start in range(0, length, places):
            part = slice(start, min(start + places, length))
            width = part.stop - part.start
            lost = before[:, part] + (after[:, part] - terms[:, part]) * down
            row = np.repeat(np.arange(first, first + len(points)), width)
            yield row, lost.ravel(), length - 1
            if not len(alphabet):
                continue
            greater = alphabet[None, None, :] > points[:, part, None]
            at, place, letter = np.nonzero(greater)
            place = place + start
            put = whole[at] + (_values(alphabet)[letter] - _values(points[at, place])) * powers[place]
            yield at + first, put, length


# --- blocked Bloom filters ------------------------------------------------------------


def _bits(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and its bit places within the block."""
    h = _mixed(hashes)
    block = ((h >> U(32)) * U(blocks)) >> U(32)
    low = _mixed(h ^ _BASE)
    places = np.stack([(low >> U(9 * i)) & U(511) for i in range(_PROBES)], axis=1)
    return block.astype(np.int64), places.astype(np.int64)


def bloom_of(hashes: np.ndarray) -> np.ndarray:
    """A blocked filter of 16 bits a hash: each hash sets its bits in one block of 512."""
    blocks = max(-(-len(hashes) // _WORDS_PER_BLOCK), 1)
    longs = np.zeros(blocks * _BLOCK_LONGS, U)
    block, places = _bits(hashes, blocks)
    at = block[:, None] * _BLOCK_LONGS + (places >> 6)
    np.bitwise_or.at(longs, at.ravel(), U(1) << (places & 63).astype(U).ravel())
    return longs


def in_bloom(longs: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    block, places = _bits(hashes, len(longs) // _BLOCK_LONGS)
    base = block * _BLOCK_LONGS
    left = np.arange(len(hashes))
    for i in range(_PROBES):
        place = places[left, i]
        word = longs[base[left] + (place >> 6)]
        left = left[(word >> (place & 63).astype(U)) & U(1) == 1]
    return left


def _shard_of(hashes: np.ndarray, shards: np.ndarray) -> np.ndarray:
    """Shard of a hash among those of its length."""
    return (_mixed(hashes + U(0x632BE59BD9B4E019)) % shards).astype(np.int64)


def _filters(words: DataFrame, shards: dict[int, int]) -> DataFrame:
    """(length, shard, longs): one filter per length and shard; a shard's hashes are a bounded group."""
    def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.asarray(batch.column("length"))
            hashes = np.asarray(batch.column("h")).view(U)
            shard = _shard_of(hashes, np.array([shards[int(n)] for n in length], U))
            yield pa.record_batch([pa.array(length), pa.array(shard), batch.column("h")], names=["length", "shard", "h"])

    def built(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        longs = bloom_of(np.asarray(rows.column("h").combine_chunks()).view(U))
        return pa.table({"length": [key[0].as_py()], "shard": [key[1].as_py()], "longs": [longs.tobytes()]})

    return (
        words.select("length", "h").mapInArrow(sharded, "length long, shard long, h long")
        .groupBy("length", "shard").applyInArrow(built, "length long, shard long, longs binary")
    )


def near_pairs(
    vocabulary: DataFrame, shard_words: int = 1 << 19, pass_bytes: int = 64 << 20
) -> DataFrame:
    """(a, b): every pair of words(word string) that differ by one inserted, deleted or replaced
    code point, in both directions, each once.

    Filters hold at most about ``shard_words`` words each (a length with more has several, told
    apart by hash) and ``pass_bytes`` bytes are broadcast at a time; a larger vocabulary takes
    more passes, in each of which the edits are probed against that pass's filters only. Hash
    collisions and false positives end in the join with the vocabulary, which compares words.
    """
    spark = vocabulary.sparkSession

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 8192):
                names = batch.column(0).slice(first, 8192)
                words = names.to_pylist()
                lengths = pa.array([min(len(w), _LONG) for w in words], pa.int64())
                yield pa.record_batch([names, pa.array(hashes_of(words).view(np.int64)), lengths], names=["word", "h", "length"])

    words = vocabulary.select("word").where("word <> ''").mapInArrow(hashed, "word string, h long, length long")
    words = written(words, "words")
    letters = (
        words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct()
    )
    alphabet = np.array(sorted(ord(r.c) for r in letters.collect()), np.uint32)
    shards = {r.length: -(-r.n // shard_words) for r in words.groupBy("length").agg(F.count("*").alias("n")).collect()}
    filters = written(_filters(words, shards), "filters")
    sizes = sorted((r.length, r.shard, r.size) for r in filters.select("length", "shard", F.octet_length("longs").alias("size")).collect())
    passes: list[list[tuple[int, int]]] = []
    room = 0
    for length, shard, size in sizes:
        if not passes or room < size:
            passes.append([])
            room = pass_bytes
        passes[-1].append((length, shard))
        room -= size
    found = []
    for chosen in passes:
        keys = spark.createDataFrame(chosen, "length long, shard long")
        held = {
            (r.length, r.shard): np.frombuffer(bytes(r.longs), U)
            for r in filters.join(F.broadcast(keys), ["length", "shard"]).collect()
        }
        shipped = spark.sparkContext.broadcast(held)
        reached = sorted({n for n, _ in chosen} | {min(n + 1, _LONG) for n, _ in chosen})
        found.append(written(_probed(words, shipped, shards, alphabet, reached), "positives"))
        shipped.unpersist()
    if not found:
        return spark.createDataFrame([], "a string, b string")
    positives = found[0]
    for more in found[1:]:
        positives = positives.union(more)
    own = words.select(F.col("h").alias("from"), F.col("word").alias("a"))
    other = words.select(F.col("h").alias("to"), F.col("word").alias("b"))
    pairs = positives.join(other, "to").join(own, "from").select("a", "b").where(one_edit("a", "b"))
    pairs = written(pairs.distinct(), "pairs")
    return pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def one_edit(a: str, b: str) -> Column:
    """Whether two words differ by exactly one inserted, deleted or replaced code point: what is
    left between their longest common beginning and end has at most one code point each."""
    @F.pandas_udf("boolean")
    def check(first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series([_is_one_edit(x, y) for x, y in zip(first, second)], dtype=bool)

    return check(a, b)


def _is_one_edit(x: str, y: str) -> bool:
    if x == y or abs(len(x) - len(y)) > 1:
        return False
    if len(x) > len(y):
        x, y = y, x
    low, high = 0, len(x)
    while low < high:  # longest common beginning, by halving
        mid = (low + high + 1) // 2
        if x[:mid] == y[:mid]:
            low = mid
        else:
            high = mid - 1
    return x[low + (len(x) == len(y)) :] == y[low + 1 :]


def _probed(words: DataFrame, shipped, shards: dict[int, int], alphabet: np.ndarray, reached: list[int]) -> DataFrame:
    """(from, to): hashes of words and of those of their edits that the filters may hold."""
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shipped.value
        for batch in batches:
            texts, own = batch.column("word").to_pylist(), np.asarray(batch.column("h")).view(U)
            for length, at in _by_length(texts).items():
                names = own[at]
                for row, hashes, to_length in edits([texts[i] for i in at], length, alphabet):
                    to_length = min(to_length, _LONG)
                    parts = shards.get(to_length)
                    if not parts:
                        continue
                    shard = _shard_of(hashes, U(parts)) if parts > 1 else None
                    for s in range(parts):
                        longs = held.get((to_length, s))
                        if longs is None:
                            continue
                        mine = None if shard is None else np.flatnonzero(shard == s)
                        hit = in_bloom(longs, hashes if mine is None else hashes[mine])
                        hit = hit if mine is None else mine[hit]
                        # A code point lost from a run of equal ones gives one word, several times.
                        both = np.unique(np.stack([names[row[hit]], hashes[hit]], axis=1), axis=0)
                        if len(both):
                            yield pa.record_batch(
                                [pa.array(both[:, 0].view(np.int64)), pa.array(both[:, 1].view(np.int64))], names=["from", "to"]
                            )

    return words.where(F.col("length").isin(reached)).mapInArrow(probe, "from long, to long")


def variant_groups(
    docs: DataFrame,
    least_points: int = 7,
    least_count: int = 2,
    factor: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    thin: int = 31,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts (see ``word_counts``) with
    ``least_points`` code points and ``least_count`` occurrences.

    Near words are one inserted, deleted or replaced code point apart. ``form`` is the near word
    of largest n (ties: the smallest by code points) if that n is at least ``factor`` times the
    word's own, else NULL; ``root`` follows the forms to the last one. As n grows on the way, the
    way ends, and doubling finds its end in as many rounds as the logarithm of its length.

    NULL and empty texts have no words; a NULL id is an empty string in the CRC; rows that repeat
    an id or text count each. A run may be as long as a text: its edits are probed in pieces.
    An empty table gives no rows. Only the id and the text are read.
    """
    if factor < 2:
        raise ValueError("factor must be 2 or more, or forms need not end")
    counts = written(word_counts(docs, least_points, thin, id_col, text_col).where(F.col("n") >= least_count), "vocabulary")
    pairs = near_pairs(counts)
    near = counts.select(F.col("word").alias("b"), F.col("n").alias("b_n"))
    # The largest n first, then the smallest word.
    rank = F.struct((-F.col("b_n")).alias("n"), F.col("b").alias("w"))
    best = pairs.join(near, "b").groupBy(F.col("a").alias("word")).agg(F.min(rank).alias("_best"), F.count("*").alias("n_near"))
    strong = -F.col("_best.n") >= F.col("n") * factor
    rows = written(
        counts.join(best, "word", "left").select(
            "word", F.when(strong, F.col("_best.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(strong, -F.col("_best.n")).alias("form_n"),
        ),
        "forms",
    )
    heads = written(rows.where("form is not null").select("word", F.col("form").alias("root")), "heads")
    while True:
        on = heads.select(F.col("word").alias("root"), F.col("root").alias("_on"))
        step = written(heads.join(on, "root", "left").select("word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("moved")), "heads")
        heads = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    return rows.join(heads, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
