"""Exact n-gram Jaccard join by token combinations in extended prefixes.

A document is its set of distinct word shingles ("tokens"). Tokens have a global order, rare
ones first, and a class: 1 rare, 2 frequent, 3 very frequent. A set's prefix is its first
tokens in that order, extended until sum over classes k of max(0, tokens of class k - (k-1))
is one more than the number of tokens a linked partner may lack. Two linked sets then share,
within both prefixes, k tokens of some class k. So single tokens of class 1 are indexed, pairs
of class 2 and triples of class 3. Frequent classes are divided into subclasses by hash, so
that long documents have few combinations; each subclass counts as a class of its own.

The order and the classes come from counts of all tokens of all documents in a table of fixed
size (hashed counters). They need not be exact, only the same everywhere: the join is exact.

Sets of equal documents are joined once. Candidates meet bounds from parity bitmaps (each
token of the symmetric difference changes one bit at most), a short one within the join of the
keys and a longer one behind it, then an exact check. In turns every set is checked against two
of the sets that are the pivots of its keys, others each turn; between turns the components are
brought together by one star step, and keys whose members all lie in one are done. When a turn
links few sets, the members of the keys still open meet where they lie in different components,
a pair at the first key in common and seldom again. No key's members are gathered in one task and
no group is expanded into all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialogweave.llm.common import components, give_back, nearer, pieces, shuffle_parts, written
from dialogweave.llm.textkit import U, mix, shingle_sets

COUNTERS_LOG = 22
_BLOCK = 1 << 14
WORDS = 8  # of the short bitmap
BEFORE = 8  # keys of a set that its row at a key carries in the full join
PIVOTS = 2  # of a key and turn
TURNS = 8  # at most; what they leave open is compared in full
_SHORT = [f"s{i}" for i in range(WORDS)]


def _node(tokens: np.ndarray) -> int:
    """The identity of a set: 63 bits of a digest of its sorted tokens."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "big") >> 1


def token_levels(docs: DataFrame, size: int) -> tuple[bytes, int, int]:
    """Hashed token counts over all documents, scaled to a byte each, and the levels up to
    which a token is rare and frequent. Fixed in size whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTERS_LOG, np.uint32)
        for batch in batches:
            for tokens in shingle_sets(batch.column(0), size):
                np.add.at(counts, (tokens >> U(64 - COUNTERS_LOG)).astype(np.int64), np.uint32(1))
        yield from _blocks(counts)

    def _blocks(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for block in range(0, len(counts), _BLOCK):
            part = counts[block : block + _BLOCK]
            most = int(part.max())
            if most:
                kind = np.uint8 if most < 256 else np.uint16 if most < 65536 else np.uint32
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block // _BLOCK], pa.int32()), pa.array([part.astype(kind).tobytes()], pa.binary())],
                    names=["block", "counts"],
                )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        kinds = {1: np.uint8, 2: np.uint16, 4: np.uint32}
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(packed, kinds[len(packed) // _BLOCK])
                total = sums.setdefault(block, np.zeros(_BLOCK, np.uint64))
                total += part
        for block, total in sums.items():
            clipped = np.minimum(total, U(0xFFFFFFFF)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([clipped.tobytes()], pa.binary())], names=["block", "counts"]
            )

    schema = "block int, counts binary"
    parts = docs.select("text").mapInArrow(count, schema)
    summed = parts.repartition(min(64, shuffle_parts(docs.sparkSession)), "block").mapInArrow(add, schema)
    counts = np.zeros(1 << COUNTERS_LOG, np.uint64)
    for row in summed.collect():  # 2**22 counters at most
        counts[row["block"] * _BLOCK : (row["block"] + 1) * _BLOCK] = np.frombuffer(row["counts"], np.uint32)
    load = int(counts.sum()) >> COUNTERS_LOG
    step = max(1, (32 + 4 * load) // 15)
    levels = np.minimum(counts // U(step), U(255)).astype(np.uint8)
    return levels.tobytes(), 15, 15 * 15


class Signatures:
    """Index keys of token sets for one threshold (``percent`` of the union)."""

    def __init__(self, levels: bytes, rare: int, frequent: int, percent: int):
        self.levels = np.frombuffer(levels, np.uint8)
        self.rare, self.frequent, self.percent = rare, frequent, percent
        self.plain = {
            band for n in range(1, 16) if self._largest(n) > n for band in self._bands(n)
            if -(-n * percent // 100) < 3 * self._groups(band) + 1
        }

    def _largest(self, n: int) -> int:
        """The size of the largest set that may link with one of n."""
        return n * 100 // self.percent

    def _bands(self, n: int) -> list[int]:
        """Size classes of a set of n and its partners: two sets that may link share that of the
        larger."""
        return sorted({n.bit_length(), self._largest(n).bit_length()})

    def _groups(self, band: int) -> int:
        return max(1, self.lacking(1 << (band - 1)) // 4)

    def lacking(self, n: int) -> int:
        """The most tokens of a set of n that a linked set may lack."""
        return n - -(-n * self.percent // 100)

    def of(self, tokens: np.ndarray) -> np.ndarray:
        n = len(tokens)
        if self._largest(n) <= n:  # only equal sets link, and these are one node
            return np.zeros(0, np.int64)
        need = self.lacking(n) + 1
        level = self.levels[(tokens >> U(64 - COUNTERS_LOG)).astype(np.int64)]
        order = np.lexsort((tokens, level))
        ordered = tokens[order]
        kind = np.where(level[order] <= self.rare, 1, np.where(level[order] <= self.frequent, 2, 3))
        singles = int(np.searchsorted(kind, 2))
        keys = [ordered[: min(need, singles)]]
        if singles < need:
            for band in self._bands(n):
                keys.append(self._combined(ordered[singles:], kind[singles:], need - singles, band))
        return np.unique(mix(np.concatenate(keys))).astype(np.int64)

    def _combined(self, tokens: np.ndarray, kind: np.ndarray, need: int, band: int) -> np.ndarray:
        """Keys of the pairs and triples of the extended prefix.

        A group of class k adds k - 1 fewer than it has tokens, 3 a pair of groups at most. In the
        ``plain`` bands (low similarity, fewer than 16 tokens) a set may have too few for that;
        there single tokens are keys whatever their class."""
        if band in self.plain:
            return mix(mix(tokens[:need] + U(band)) + U(1))
        groups = self._groups(band)
        held: dict[tuple[int, int], list[int]] = {}
        for token, k in zip(tokens.tolist(), kind.tolist(), strict=True):
            group = held.setdefault((k, (token >> 7) % groups), [])
            group.append(token)
            need -= len(group) >= k
            if not need:
                break
        if need:
            raise ValueError("the similarity is too low for this index")
        found = []
        for (k, _), group in held.items():
            found.extend(combinations(group, k) if k == 2 else ((a ^ (b * 3 & (2**64 - 1)), c) for a, b, c in combinations(group, 3)))
        if not found:
            return np.zeros(0, U)
        pairs = np.array(found, U)
        return mix(mix(pairs[:, 0] + U(band)) + pairs[:, 1])


def parity_bits(tokens: np.ndarray) -> bytes:
    """A bitmap of about one bit per token; bit b: whether an odd number of tokens falls on b."""
    bits = 1 << max(6, (len(tokens)).bit_length())
    odd = np.bincount((mix(tokens) >> U(8)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def short_bits(tokens: np.ndarray) -> np.ndarray:
    """The same in ``WORDS`` longs whatever the number of tokens."""
    odd = np.bincount((mix(tokens) >> U(8)).astype(np.int64) & (64 * WORDS - 1), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _may_link(a: str, b: str, percent: int) -> str:
    """The SQL condition on sizes and short bitmaps of two rows; false only if they surely do not link."""
    differ = " + ".join(f"bit_count({a}{s} ^ {b}{s})" for s in _SHORT)
    return (
        f"least({a}n, {b}n) * 100 >= greatest({a}n, {b}n) * {percent}"
        f" and {100 + percent} * ({differ}) <= {100 - percent} * ({a}n + {b}n)"
    )


def _folded(bitmap: bytes, size: int) -> int:
    whole = np.frombuffer(bitmap, np.uint8)
    return int.from_bytes(np.bitwise_xor.reduce(whole.reshape(-1, size), axis=0).tobytes(), "little")


def may_link(na: int, a: bytes, nb: int, b: bytes, percent: int) -> bool:
    """False only if the symmetric difference is surely too large."""
    if min(na, nb) * 100 < max(na, nb) * percent:
        return False
    size = min(len(a), len(b))
    differ = (_folded(a, size) ^ _folded(b, size)).bit_count()
    return (100 + percent) * differ <= (100 - percent) * (na + nb)


def _nodes(docs: DataFrame, size: int, make: Signatures) -> DataFrame:
    """Per row: its columns besides text (long), a hash of its text, the node of its set, the
    set's size, bitmaps and keys."""
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            node, count, bitmap, short, keys = [], [], [], np.zeros((batch.num_rows, WORDS), np.int64), []
            for i, tokens in enumerate(shingle_sets(batch.column(len(kept) + 1), size)):
                node.append(_node(tokens) if len(tokens) else None)
                count.append(len(tokens))
                bitmap.append(parity_bits(tokens))
                short[i] = short_bits(tokens)
                keys.append(make.of(tokens))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array(node, pa.int64()),
                    pa.array(count, pa.int64()),
                    pa.array(bitmap, pa.binary()),
                    *(pa.array(short[:, w]) for w in range(WORDS)),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=[*kept, "copy", "node", "n", "bits", *_SHORT, "keys"],
            )
            pa.default_memory_pool().release_unused()

    return docs.select(*kept, F.xxhash64("text").alias("copy"), "text").mapInArrow(
        run, ", ".join(f"{c} long" for c in [*kept, "copy", "node", "n"])
        + ", bits binary, " + ", ".join(f"{c} long" for c in _SHORT) + ", keys array<long>"
    )


def _hopeful(pairs: DataFrame, homes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that pass the bound of the bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)
            yield batch.select(["a", "b"]).filter(pa.array([may_link(*row, percent) for row in rows], pa.bool_()))

    left = homes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
    right = homes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "bits_a", "nb", "bits_b").mapInArrow(
        run, "a long, b long"
    )


def _links(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose sets really link, written. Whole sets are made for their members only."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            packed = [t.tobytes() for t in shingle_sets(batch.column(1), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["node", "tokens"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), U), np.frombuffer(b.as_buffer(), U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            pa.default_memory_pool().release_unused()

    def of(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
        return nodes.join(wanted, "node", "left_semi")

    # Written, so that Spark knows their sizes and shuffles the larger side only if none is small.
    met = written(pairs, "met")
    ends = written(of(met, nodes).select("node", "doc_id", "copy", "n", "bits"), "ends")
    pairs = written(_hopeful(met, ends, percent), "pairs")
    homes = written(of(pairs, ends).select("node", "doc_id", "copy"), "homes")
    give_back(met, ends)
    texts = docs.select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("hash")).join(
        homes, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("copy"))
    )
    tokens = written(
        texts.select("node", "text").mapInArrow(sets, "node long, tokens binary").dropDuplicates(["node"]), "sets"
    )
    left = tokens.select(F.col("node").alias("a"), F.col("tokens").alias("tokens_a"))
    right = tokens.select(F.col("node").alias("b"), F.col("tokens").alias("tokens_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "tokens_a", "tokens_b")
    links = written(joined.mapInArrow(check, "a long, b long"), "links")
    give_back(pairs, homes, tokens)
    return links


def _placed(members: DataFrame, nodes: DataFrame, edges: DataFrame | None) -> DataFrame:
    """members(key, node) with the nodes' sizes, short bitmaps and roots: the least node that an
    edge leads to, or the node itself."""
    side = nodes.select("node", "n", *_SHORT, F.col("node").alias("root"))
    if edges is not None:
        least = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        side = side.join(least, "node", "left").withColumn("root", F.coalesce("least", "root")).drop("least")
    return members.join(side, "node")


def _open(members: DataFrame) -> DataFrame:
    """The members of the keys whose members lie in several components, written."""
    several = members.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    return written(members.join(several, "key", "left_semi"), "open")


def _pivot_pairs(members: DataFrame, turn: int, percent: int) -> DataFrame:
    """For every node up to ``PIVOTS`` pairs (a, b) with a pivot of its keys that may link with it
    and lies in another component. The pivots of a key are other members each turn. Keys whose
    members all lie in one component have none."""
    marks = range(turn * PIVOTS, (turn + 1) * PIVOTS)
    pivots = members.groupBy("key").agg(
        F.min("root").alias("x"),
        F.max("root").alias("y"),
        *(
            F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("order"), "node", "root", "n", *_SHORT)).alias(f"p{k}")
            for k in marks
        ),
    ).where("x <> y").drop("x", "y")
    found = members.join(pivots, "key").groupBy("node").agg(*(
        F.min(F.expr(f"if(root <> p{k}.root and {_may_link('', f'p{k}.', percent)}, p{k}.node, null)")).alias(f"p{k}")
        for k in marks
    ))
    pairs = found.select("node", F.explode(F.array_distinct(F.array(*(f"p{k}" for k in marks)))).alias("pivot"))
    return pairs.where("pivot is not null").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))


def _met(members: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with a key in common that may link and lie in different components.

    Sets that are alike have most keys in common and would meet at each. So a row carries the
    ``BEFORE`` keys before its own, and two rows meet only if these have none in common: always at
    the first key that the two sets share, rarely at another."""
    order = Window.partitionBy("node").orderBy("key").rowsBetween(-BEFORE, -1)
    members = members.select("key", "node", "root", "n", *_SHORT, F.collect_list("key").over(order).alias("before"))
    other = members.select("key", *(F.col(c).alias(f"o_{c}") for c in ("node", "root", "n", *_SHORT, "before")))
    several = f"node < o_node and root <> o_root and {_may_link('', 'o_', percent)}"
    return (
        members.join(other, "key").where(f"{several} and not arrays_overlap(before, o_before)")
        .select(F.col("node").alias("a"), F.col("o_node").alias("b"))
    )


def _linked(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows of docs(doc_id, text, ...) as ``_nodes`` gives them, and (node, root) of every
    node with a link."""
    if not 67 <= percent <= 100:
        raise ValueError("percent must be from 67 to 100")
    make = Signatures(*token_levels(docs, size), percent)
    whole = written(_nodes(docs, size, make), "rows")
    rows = written(whole.select("doc_id", "copy", "node", "n"), "rows")
    nodes = written(
        whole.where("node is not null").groupBy("node").agg(
            F.min(F.struct("doc_id", "copy")).alias("home"), *(F.first(c).alias(c) for c in ("n", "bits", *_SHORT, "keys"))
        ).select("node", "home.doc_id", "home.copy", "n", "bits", *_SHORT, "keys"),
        "nodes",
    )
    give_back(whole)
    members = nodes.select("node", F.explode("keys").alias("key"))
    # A node has a key once, so a key that occurs twice has two nodes.
    shared = members.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key")
    members = written(members.join(shared, "key", "left_semi"), "members")
    edges, most = None, 0
    for turn in range(TURNS):
        links = _links(_pivot_pairs(_placed(members, nodes, edges), turn, percent), docs, nodes, size, percent)
        found = links.count()
        last, edges = edges, nearer(links if edges is None else edges.union(links))
        give_back(links, *([] if last is None else [last]))
        most = max(most, found)
        if 4 * found <= most:
            break
    roots = _merged(None, edges)
    left = _open(_placed(members, nodes, roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    give_back(members)
    roots = _merged(roots, _links(_met(left, percent).distinct(), docs, nodes, size, percent))
    give_back(left, nodes)
    return rows, roots


def _merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) of the components of all links so far. Both tables are given back."""
    edges = links if roots is None else roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links)
    merged = components(edges)
    give_back(links, *([] if roots is None else [roots]))
    return merged


def jaccard_components(
    docs: DataFrame, size: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_shingles, component_id) per row of docs: the rows' set sizes and the smallest id
    reachable by links; two rows link when 100 * intersection >= percent * union.

    NULL and wordless texts have no shingles and no links. Repeated rows and texts with equal
    sets share a component. A row with NULL id takes part; its component is the smallest id
    that is not NULL, or NULL. Only id and text are read, so other columns never clash. Ids
    must be long. percent is 67 or more.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows, roots = _linked(docs, size, percent)
    labelled = rows.select("doc_id", "node", "n").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node")
    )
    least = labelled.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return labelled.join(least, "root", "left").select(
        F.col("doc_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
    )


def without_near_copies(
    docs: DataFrame, size: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """docs with one row of each component of linked rows (see ``jaccard_components``).

    That with the smallest id stays, one without id only where all are; among rows of one id
    the least by a hash of the text, and any one of rows that agree in both. The decision is that
    of an id with a text, so other texts under the same id, or without id, stay. NULL and
    wordless texts link with none and all stay."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows, roots = _linked(texts, size, percent)
    times = rows.where("node is not null").groupBy("node", "doc_id", "copy").agg(F.count("*").alias("times"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "copy", "times")).alias("best")
    firsts = times.groupBy("node").agg(best)
    firsts = firsts.join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("best").alias("best"))
    wordless = rows.where("node is null").select("doc_id", "copy").distinct()
    stay = written(
        firsts.select("best.doc_id", "best.copy", (F.col("best.times") > 1).alias("repeated"))
        .union(wordless.withColumn("repeated", F.lit(False))),
        "stay",
    )
    give_back(rows, roots)
    named = docs.select(
        F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("hash")
    )
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("copy"))
    once = named.join(stay.where("not repeated"), same, "left_semi").select("doc.*")
    repeated = named.join(stay.where("repeated"), same, "left_semi")
    return once.union(repeated.groupBy("id", "hash").agg(F.first("doc").alias("doc")).select("doc.*"))
