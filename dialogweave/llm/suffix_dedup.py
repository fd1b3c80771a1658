"""Removal of byte strings that repeat across documents, by two-stage suffix sorting.

1. Every window of ``length`` bytes has an anchor: the least hash among the short strings in
   it (equal windows have equal anchors). Blocks of documents send their distinct anchors to
   hash buckets, packed, with the number of documents; buckets return those that more than
   one document holds.
2. Blocks send the text around repeated anchors to hash buckets. All windows with one anchor
   meet in one bucket. Anchors of very many documents are divided by whole windows instead.
   What repeats within a block is settled there, so a popular passage is sent once a block.
3. A bucket sorts the suffixes of its texts in two stages: those smaller than their successor
   directly, the rest by scans over the buckets of their first byte; common prefixes of
   neighbours in this order show which windows are equal, and the smallest document of each.
4. Blocks take the removed spans back and cut them.

Texts are shuffled for step 1, and once more for steps 2 and 4, which share the exchange: thus the
anchors of step 1 are gone from disk before the pieces of step 2 come. Texts travel compressed,
each by itself; anchors, pieces and spans as compressed columns.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialogweave.llm.common import by_arrow, pieces, shuffle_parts, written
from dialogweave.llm.textkit import U, between, flat, mix, prefix_hashes, slices

GRAM = 24
POPULAR = 1000
BLOCK_ROWS = 512
CHUNK = 2 << 20


def _words(data: np.ndarray, size: int) -> np.ndarray:
    """The 8 bytes from each of ``size`` places on as a big-endian number, zeros after the end."""
    words = np.zeros(size + 8, U)
    words[: len(data)] = data
    for step in (1, 2, 4):
        words = (words[:-step] << U(8 * step)) | words[step:]
    return words[:size]


def _ends_at(first: int, depth: int) -> list[int]:
    """Offsets of the words that cover the bytes from ``first`` to ``depth``."""
    return [*range(first, depth - 8, 8), depth - 8]


def _sorted_places(words: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """The places in order of the ``depth`` bytes from there on.

    By their first word; then five bytes at a time, only groups of equal ones that differ yet."""
    key = words[places]
    order = np.argsort(key)
    places, key = places[order], key[order]
    new = np.ones(len(places), bool)  # whether a place differs from the one before
    new[1:] = key[1:] != key[:-1]
    for at in range(8, depth, 5):
        after = np.flatnonzero(~new)
        differ = np.zeros(len(after), bool)
        for offset in _ends_at(at, depth):
            differ |= words[places[after] + offset] != words[places[after - 1] + offset]
        if not differ.any():
            break
        group = np.cumsum(new) - 1
        unsorted = np.zeros(group[-1] + 1, bool)
        unsorted[group[after[differ]]] = True
        members = np.flatnonzero(unsorted[group])
        group = (np.cumsum(unsorted) - 1)[group[members]].astype(U)
        key = words[places[members] + at] >> U(24)
        whole = (group << U(40)) | key
        order = np.argsort(whole) if group[-1] < 1 << 24 else np.lexsort((key, group))
        places[members] = places[members][order]
        key = key[order]
        new[members[1:]] |= key[1:] != key[:-1]
    return places


def two_stage_order(data: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``data`` in order of their first ``depth`` bytes at least.

    ``data`` ends with ``depth`` + 8 padding bytes. Suffixes smaller than their successor are
    sorted directly, word by word; the others follow from the places of their successors."""
    n = len(data)
    change = np.flatnonzero(data[1:] != data[:-1])
    run_end = np.append(change, n - 1)  # last place of each run of equal bytes
    run_of = np.zeros(n, np.int64)
    run_of[change + 1] = 1
    run_of = np.cumsum(run_of)
    rises = np.append(data[change] < data[change + 1], False)
    smaller = rises[run_of]
    distance = run_end[run_of] - np.arange(n)
    words = _words(data, n + depth + 8)
    direct = _sorted_places(words, np.flatnonzero(smaller), depth)
    counts = np.bincount(data, minlength=256)
    bucket = np.concatenate([[0], np.cumsum(counts)])
    order = np.empty(n, np.int64)
    place = np.full(n + 1, -1, np.int64)
    direct_of = np.bincount(data[direct], minlength=256)
    at = 0
    larger = np.flatnonzero(~smaller)
    larger = larger[np.argsort((data[larger].astype(np.int64) << 48) | distance[larger])]
    larger_of = np.concatenate([[0], np.cumsum(np.bincount(data[larger], minlength=256))])
    for byte in np.flatnonzero(counts):
        put = bucket[byte]
        level = larger[larger_of[byte] : larger_of[byte + 1]]
        steps = distance[level]
        edges = np.concatenate([[0], np.flatnonzero(steps[1:] != steps[:-1]) + 1, [len(level)]])
        for first, last in zip(edges[:-1], edges[1:], strict=True):
            part = level[first:last]
            part = part[np.argsort(place[part + 1])]
            order[put : put + len(part)] = part
            place[part] = np.arange(put, put + len(part))
            put += len(part)
        part = direct[at : at + direct_of[byte]]
        at += len(part)
        order[put : put + len(part)] = part
        place[part] = np.arange(put, put + len(part))
    return order


def least_documents(texts: list[bytes], documents: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of every text: the smallest document with this window.

    Returns them in the order of the texts, and where each text's windows begin."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts) + bytes(length + 8), np.uint8)
    windows = np.maximum(sizes - length + 1, 0)
    begin = np.concatenate([[0], np.cumsum(windows)])
    owner = np.repeat(np.arange(len(texts)), sizes)
    wanted = np.zeros(len(data), bool)
    wanted[: ends[-1]] = np.arange(ends[-1]) + length <= ends[owner]
    order = two_stage_order(data, length)
    order = order[wanted[order]]
    left, right = order[:-1], order[1:]
    same = np.ones(len(left), bool)  # whether neighbours' common prefix reaches the length
    words = _words(data, len(data))
    for i in _ends_at(0, length):
        hold = np.flatnonzero(same) if i else slice(None)
        same[hold] = words[left[hold] + i] == words[right[hold] + i]
    heads = np.flatnonzero(np.append(True, ~same))
    least = np.minimum.reduceat(documents[owner[order]], heads)
    spread = np.repeat(least, np.diff(np.append(heads, len(order))))
    result = np.empty(len(order), np.int64)
    rank = np.cumsum(wanted) - 1
    result[rank[order]] = spread
    return result, begin


class Block:
    """The documents of one block in a fixed order, without those that copy smaller ones."""

    def __init__(self, rows: pa.Table, copies: set[str], length: int):
        ids = rows.column("doc_id").to_pylist()
        digests = rows.column("digest").to_pylist()
        none = -(1 << 63)
        self.order = sorted(range(len(ids)), key=lambda i: (none if ids[i] is None else ids[i], digests[i] or ""))
        self.rows = rows.take(pa.array(self.order, pa.int64()))
        self.ids = [ids[i] for i in self.order]
        self.texts = [None if t is None else _grown(t) for t in self.rows.column("text").to_pylist()]
        self.data, self.offsets = flat(pa.array(self.texts, pa.large_binary()))
        self.length = length
        self.sizes = np.diff(self.offsets)
        self.copied = np.array([f"{ids[i]}:{digests[i]}" in copies for i in self.order], bool)
        self.used = ~self.copied & (self.sizes >= length) & np.array([i is not None for i in self.ids], bool)

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
        """Runs of windows with one anchor: anchor, row, first place and number of windows,
        a slice of the block at a time, with the slice's prefix hashes and first place."""
        span = self.length - GRAM + 1
        for first, last in slices(self.offsets):
            at = self.offsets[first : last + 1]
            base, size = at[0], at[-1] - at[0]
            if size < self.length or not self.used[first:last].any():
                continue
            data = self.data[base : at[-1]]
            sums = prefix_hashes(data)
            places = np.arange(size - GRAM + 1)
            grams = between(sums, places, places + GRAM)
            grams = (grams ^ (grams >> U(29))) * U(0xBF58476D1CE4E5B9)
            grams ^= grams >> U(32)
            least, width = grams, 1
            while width * 2 <= span:
                least = np.minimum(least[: len(least) - width], least[width:])
                width *= 2
            rest = span - width
            anchors = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
            row = np.repeat(np.arange(first, last), np.diff(at))[: len(anchors)]
            valid = self.used[row] & (np.arange(len(anchors)) + self.length <= at[1:][row - first] - base)
            start = valid.copy()
            start[1:] &= ~valid[:-1] | (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1])
            stop = valid.copy()
            stop[:-1] &= ~valid[1:] | start[1:]
            starts, stops = np.flatnonzero(start), np.flatnonzero(stop)
            yield _short(anchors[starts]), row[starts], starts + base, stops - starts + 1, sums, int(base)


def _short(hashes: np.ndarray) -> np.ndarray:
    """Hashes of 40 bits. Where two that differ become one, more texts meet and no others are cut."""
    return mix(hashes) >> U(24)


def _shrunk(data: bytes) -> bytes:
    return struct.pack("<q", len(data)) + pa.compress(data, codec="zstd", asbytes=True)


def _grown(data: bytes) -> bytes:
    return pa.decompress(data[8:], struct.unpack_from("<q", data)[0], codec="zstd", asbytes=True)


def _pack(columns: list[np.ndarray], kinds: list[type]) -> bytes:
    """Columns of equal lengths, compressed: differences of neighbours, by their first, second,
    ... bytes, as most of these are alike."""
    out = []
    for values, kind in zip(columns, kinds, strict=True):
        steps = np.diff(values.astype(kind), prepend=kind(0))
        out.append(steps.view(np.uint8).reshape(len(steps), steps.itemsize).T.tobytes())
    return _shrunk(b"".join(out))


def _unpack(packed: list[bytes], kinds: list[type]) -> list[np.ndarray]:
    """The columns of all that ``_pack`` made of some, one after the other."""
    width = sum(np.dtype(k).itemsize for k in kinds)
    found: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in kinds]
    for data in map(_grown, packed):
        n, at = len(data) // width, 0
        for column, kind in zip(found, kinds, strict=True):
            size = np.dtype(kind).itemsize
            planes = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
            column.append(np.cumsum(np.ascontiguousarray(planes.T).view(kind)[:, 0], dtype=kind))
            at += n * size
    return [np.concatenate(c) for c in found]


def _held(column: pa.ChunkedArray) -> list[bytes]:
    return [b for b in column.to_pylist() if b is not None]


def _buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> U(8)) % U(buckets)).astype(np.int64)


_ANCHORS = "bucket int, block int, anchors binary"
_ANCHOR = [U, np.uint16]  # anchor, number of documents
_BACK = "block int, copy string, anchors binary"
_RETURNED = [U, np.uint8]  # anchor, whether very many documents have it
_TEXTS = "bucket int, block int, places binary, texts binary"  # texts: null for spans that are settled
_PIECE = [np.int32, np.int32, np.int32, np.int64, np.uint8]  # row, start, size, doc_id, part of the bucket
_SPANS = "block int, spans binary"
_SPAN = [np.int32, np.int32, np.int32]  # row, start, stop


def _arrow(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _copies(side: pa.Table) -> set[str]:
    return {c for c in side.column("copy").to_pylist() if c is not None}


def _send_anchors(length: int, buckets: int):
    def run(rows: pa.Table, side: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _arrow(_ANCHORS, [])
        block = Block(rows, _copies(side), length)
        found, owners = [], []
        for anchors, row, *_ in block.runs():
            found.append(anchors)
            owners.append(row)
        if not found:
            return _arrow(_ANCHORS, [])
        anchors, owners = np.concatenate(found), np.concatenate(owners)
        order = np.lexsort((owners, anchors))
        anchors, owners = anchors[order], owners[order]
        new = np.append(True, anchors[1:] != anchors[:-1])
        docs = np.add.reduceat((new | np.append(True, owners[1:] != owners[:-1])).astype(np.int64), np.flatnonzero(new))
        anchors = anchors[new]
        where = _buckets(anchors, buckets)
        order = np.argsort(where, kind="stable")
        edges = np.searchsorted(where[order], np.arange(buckets + 1))
        number = rows.column("block")[0].as_py()
        out = []
        for b in range(buckets):
            part = order[edges[b] : edges[b + 1]]
            if len(part):
                out.append((b, number, _pack([anchors[part], np.minimum(docs[part], 65535)], _ANCHOR)))
        return _arrow(_ANCHORS, out)

    return run


def _return_anchors(rows: pa.Table) -> pa.Table:
    parts = [_unpack([p], _ANCHOR) for p in rows.column("anchors").to_pylist()]
    owner = np.repeat(np.array(rows.column("block").to_pylist(), np.int64), [len(p[0]) for p in parts])
    anchors, docs = (np.concatenate([p[i] for p in parts]) for i in range(2))
    docs = docs.astype(np.int64)
    order = np.argsort(anchors, kind="stable")
    anchors, docs, owner = anchors[order], docs[order], owner[order]
    heads = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1]))
    total = np.repeat(np.add.reduceat(docs, heads), np.diff(np.append(heads, len(anchors))))
    again = np.flatnonzero(total > 1)
    again = again[np.argsort(owner[again], kind="stable")]
    out = []
    edges = np.flatnonzero(np.append(True, owner[again][1:] != owner[again][:-1])) if len(again) else []
    for first, last in zip(edges, np.append(edges[1:], len(again)), strict=True) if len(again) else []:
        part = again[first:last]
        out.append((int(owner[part[0]]), None, _pack([anchors[part], total[part] > POPULAR], _RETURNED)))
    return _arrow(_BACK, out)


def _send_texts(length: int, buckets: int):
    def run(rows: pa.Table, side: pa.Table) -> pa.Table:
        again, popular = _unpack(_held(side.column("anchors")), _RETURNED)
        if not rows.num_rows or not len(again):
            return _arrow(_TEXTS, [])
        order = np.argsort(again)
        again, popular = again[order], popular[order].astype(bool)
        block = Block(rows, _copies(side), length)
        number = rows.column("block")[0].as_py()
        first_with: dict[bytes, int] = {}
        settled: list[tuple[int, int, int]] = []
        sent: list[tuple[int, int, int, int, bytes, int]] = []
        raw = block.data.tobytes()
        for anchors, row, start, count, sums, base in block.runs():
            at = np.minimum(np.searchsorted(again, anchors), len(again) - 1)
            hit = np.flatnonzero(again[at] == anchors)
            wide = popular[at[hit]]
            keys, row, start, count = anchors[hit], row[hit], start[hit], count[hit]
            if wide.any():  # one piece for each window
                each = np.repeat(np.flatnonzero(wide), count[wide])
                shift = np.arange(len(each)) - np.repeat(np.cumsum(count[wide]) - count[wide], count[wide])
                places = start[each] + shift
                whole = _short(between(sums, places - base, places - base + length))
                keep = ~wide
                keys = np.concatenate([keys[keep], whole])
                row = np.concatenate([row[keep], row[each]])
                start = np.concatenate([start[keep], places])
                count = np.concatenate([count[keep], np.ones(len(places), np.int64)])
                back = np.argsort(row, kind="stable")
                keys, row, start, count = keys[back], row[back], start[back], count[back]
            where, sub = _buckets(keys, buckets).tolist(), (keys & U(255)).tolist()
            stops = (start + count + length - 1).tolist()
            for b, s, r, p, q in zip(where, sub, row.tolist(), start.tolist(), stops, strict=True):
                text = raw[p:q]
                doc = block.ids[r]
                seen = first_with.setdefault(text, doc)
                at_row = p - int(block.offsets[r])
                if seen < doc:
                    settled.append((r, at_row, at_row + q - p))
                else:
                    sent.append((b, s, r, at_row, text, doc))
        out = []
        if settled:
            out.append((number % buckets, number, _pack(list(np.array(settled, np.int64).T), _SPAN), None))
        sent.sort(key=lambda x: x[0])
        first = 0
        while first < len(sent):
            last = first
            while last < len(sent) and sent[last][0] == sent[first][0]:
                last += 1
            _, subs, rws, starts, texts, docs = zip(*sent[first:last], strict=True)
            columns = [np.array(c, np.int64) for c in (rws, starts, [len(t) for t in texts], docs, subs)]
            out.append((sent[first][0], number, _pack(columns, _PIECE), _shrunk(b"".join(texts))))
            first = last
        return _arrow(_TEXTS, out)

    return run


def _find_spans(length: int):
    def run(rows: pa.Table) -> pa.Table:
        out = []
        blocks, columns, texts = [], [], []
        for block, places, packed in zip(*(rows.column(c).to_pylist() for c in ("block", "places", "texts")), strict=True):
            if packed is None:
                out.append((block, places))
                continue
            columns.append(_unpack([places], _PIECE))
            sizes = columns[-1][2]
            blocks.append(np.full(len(sizes), block, np.int64))
            whole, at = _grown(packed), 0
            for s in sizes.tolist():
                texts.append(whole[at : at + s])
                at += s
        if texts:
            blocks = np.concatenate(blocks)
            row, start, size, doc, sub = (np.concatenate(c) for c in zip(*columns, strict=True))
            parts = max(1, int(size.sum()) // CHUNK)
            found = []
            for part in range(parts):
                members = np.flatnonzero(sub % parts == part) if parts > 1 else np.arange(len(sub))
                if len(members):
                    found.extend(_spans_of(members, [texts[i] for i in members], doc[members], start[members], length))
            out.extend(_spans_by_block(blocks, row, found))
        return _arrow(_SPANS, out)

    return run


def _spans_of(members: np.ndarray, texts: list[bytes], doc: np.ndarray, start: np.ndarray, length: int) -> list[np.ndarray]:
    """Spans to remove, as (member, start, stop): runs of windows that a smaller document has."""
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(t, len(number)) for t in texts], np.int64)
    if len(number) == len(texts) == 1:
        return []
    least = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(least, which, doc)
    smallest, begin = least_documents(list(number), least, length)
    windows = (begin[1:] - begin[:-1])[which]
    owner = np.repeat(np.arange(len(texts)), windows)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    gone = smallest[begin[which[owner]] + place] < doc[owner]
    first = gone.copy()
    first[1:] &= ~(gone[:-1] & (owner[1:] == owner[:-1]))
    last = gone.copy()
    last[:-1] &= ~(gone[1:] & (owner[1:] == owner[:-1]))
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    at = start[owner[first]]
    return [np.stack([members[owner[first]], at + place[first], at + place[last] + length], axis=1)] if len(first) else []


def _spans_by_block(blocks: np.ndarray, row: np.ndarray, found: list[np.ndarray]) -> Iterator[tuple]:
    if not found:
        return
    spans = np.concatenate(found)
    home = blocks[spans[:, 0]]
    order = np.argsort(home, kind="stable")
    spans, home = spans[order], home[order]
    edges = np.flatnonzero(np.append(True, home[1:] != home[:-1]))
    for first, last in zip(edges, np.append(edges[1:], len(home)), strict=True):
        part = spans[first:last]
        yield int(home[first]), _pack([row[part[:, 0]], part[:, 1], part[:, 2]], _SPAN)


def _cut(length: int, text_col: str | None, extra: list[str]):
    """Texts without their spans, as digests or (``text_col``) as documents."""

    def run(rows: pa.Table, side: pa.Table) -> pa.Table:
        copies = _copies(side)
        block = Block(rows, copies, length)
        gone = np.zeros(len(block.data) + 1, np.int32)
        base = block.offsets[:-1]
        row, start, stop = _unpack(_held(side.column("spans")), _SPAN)
        np.add.at(gone, base[row] + start, 1)
        np.add.at(gone, base[row] + stop, -1)
        whole = np.flatnonzero(block.copied & (block.sizes >= length))
        np.add.at(gone, base[whole], 1)
        np.add.at(gone, base[whole] + block.sizes[whole], -1)
        gone = np.cumsum(gone)[:-1] > 0
        removed, spans, digests, kept = [], [], [], []
        for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True):
            off = gone[a:b]
            left = block.data[a:b][~off].tobytes()
            removed.append(int(off.sum()))
            spans.append(int(off[:1].sum() + (off[1:] & ~off[:-1]).sum()))
            if text_col is None:
                digests.append(hashlib.sha256(left).hexdigest())
            else:
                kept.append(left.decode("utf-8", "ignore"))
        if text_col is None:
            return pa.table(
                [pa.array(block.ids, pa.int64()), pa.array(block.sizes), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )
        untouched = [r == 0 for r in removed]
        values = [k if not same else None if t is None else t.decode() for t, same, k in zip(block.texts, untouched, kept, strict=True)]
        columns = [pa.array(values, pa.string()) if c == text_col else block.rows.column(f"x{i}") for i, c in enumerate(extra)]
        return pa.table(columns, names=extra)

    return run


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    blocks = max(1, -(-docs.count() // BLOCK_ROWS))
    key = F.when(F.col(id_col).isNull(), F.xxhash64(F.col(text_col))).otherwise(F.xxhash64(F.col(id_col)))
    carried = [F.col(c).alias(f"x{i}") for i, c in enumerate(docs.columns) if c != text_col]
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        F.md5(text_col).alias("digest"),
        F.pmod(key, F.lit(blocks)).cast("int").alias("block"),
        *carried,
    )


def _squeezed(docs: DataFrame) -> DataFrame:
    """docs with compressed texts; NULL stays."""
    fields = [T.StructField("text", T.BinaryType()) if f.name == "text" else f for f in docs.schema.fields]
    at = docs.columns.index("text")

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(rows):
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            yield batch.set_column(at, "text", pa.array([None if t is None else _shrunk(t) for t in texts], pa.binary()))

    return by_arrow(docs, batches, T.StructType(fields))


def _run(docs: DataFrame, length: int, id_col: str, text_col: str, as_documents: bool) -> DataFrame:
    if length < GRAM + 8:
        raise ValueError(f"length must be {GRAM + 8} or more")
    spark = docs.sparkSession
    buckets = 8 * shuffle_parts(spark)
    fields = {f.name: f.dataType for f in docs.schema.fields}
    columns = docs.columns if as_documents else []
    docs = _prepared(docs if as_documents else docs.select(id_col, text_col), id_col, text_col)
    narrow = docs.where("text is not null and doc_id is not null").select("doc_id", "digest", "block")
    twice = narrow.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    copies = written(
        narrow.join(twice, "digest").where("doc_id > least").select("block", F.concat_ws(":", "doc_id", "digest").alias("copy")).distinct(), "copies"
    ).select("block", "copy", F.lit(None).cast("binary").alias("anchors"))
    by_block = _squeezed(docs).groupBy("block")
    anchors = by_block.cogroup(copies.groupBy("block")).applyInArrow(_send_anchors(length, buckets), _ANCHORS)
    # Written, so that the anchors are off the disk before the pieces come.
    back = written(anchors.groupBy("bucket").applyInArrow(_return_anchors, _BACK), "anchors")
    texts = by_block.cogroup(back.union(copies).groupBy("block")).applyInArrow(_send_texts(length, buckets), _TEXTS)
    spans = texts.groupBy("bucket").applyInArrow(_find_spans(length), _SPANS)
    spans = spans.withColumn("copy", F.lit(None).cast("string")).union(
        copies.select("block", F.lit(None).cast("binary").alias("spans"), "copy")
    )
    out = T.StructType([T.StructField(c, fields[c]) for c in columns])
    return by_block.cogroup(spans.groupBy("block")).applyInArrow(
        _cut(length, text_col if as_documents else None, columns),
        out if as_documents else "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string",
    )


def repeat_report(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row of docs: what is left of the
    UTF-8 bytes when every byte covered by a ``length``-byte string goes that also starts in a
    document with a smaller id.

    NULL and empty texts are 0 bytes. Rows with NULL id lose nothing and take nothing away.
    Rows with the same id do not affect each other. Strings are judged on the input and never
    cross documents. Other columns are not read. Ids must be long.
    """
    return _run(docs, length, id_col, text_col, False)


def strip_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the bytes that ``repeat_report`` counts cut from the texts, all columns kept.

    A character of which only a part is cut goes whole. Texts without such bytes, NULL
    included, stay as they are; emptied texts stay as empty ones."""
    return _run(docs, length, id_col, text_col, True)
