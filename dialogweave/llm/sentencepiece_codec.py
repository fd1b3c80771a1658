"""Exact SentencePiece (merge type) encoding by backtracking over longest matches.

A valid encoding is the one in which every two adjacent tokens are compatible: merging the
two tokens' own text from scratch gives these two tokens again. The encoder takes the longest
vocabulary match at each position (Aho-Corasick), checks it against the token before it, and
falls back to shorter matches, then to the previous token. A bitfield marks positions from
which no encoding continues, so that none is tried twice.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import string
import sys
import types
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dialogweave.llm.common import pieces

_MARK = "▁"


#: Bytes a generation of the memo may hold, and the longest word it keeps.
MEMO_BYTES = 64 << 20
MEMO_WORD = 64
KEPT_WORDS = 100_000  # that stay when a task ends
WINDOW = 1 << 14  # starts of matches held at once
_SLOT = 100  # bytes of a dictionary's entry beside its key and value
_OTHER = "\0"  # between a word's ids and the text they decode to


class PieceCodec:
    """Encoder and decoder over the vocabulary of a merge-type model file.

    The library is used to read the vocabulary only. Words recur, and no piece spans the
    start of a word, so encodings are kept per word: ``cached`` bounds their number.
    """

    def __init__(self, model: str, cached: int = 1_000_000):
        import ahocorasick
        import sentencepiece

        known = sentencepiece.SentencePieceProcessor(model_file=model)
        size = known.get_piece_size()
        self.pieces = [known.id_to_piece(i) for i in range(size)]
        self.bytes_of = {}
        self.byte_ids = [0] * 256
        self.hidden = set()
        self.ids, self.scores = {}, {}
        for i, piece in enumerate(self.pieces):
            if known.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of[i] = int(piece[3:5], 16)
            elif known.is_control(i):
                self.hidden.add(i)
            elif not known.is_unknown(i) and not known.is_unused(i):
                self.ids[piece] = i
                self.scores[piece] = known.get_score(i)
        self.unknown = known.unk_id()
        self.plain = {i: p.replace(_MARK, " ") for p, i in self.ids.items()} | {i: "" for i in self.hidden}
        self.longest = max(map(len, self.ids))
        self.matcher = ahocorasick.Automaton()
        for piece in self.ids:
            self.matcher.add_word(piece, len(piece))
        self.matcher.make_automaton()
        self.compatible: dict[tuple[str, str] | str, bool] = {}
        self.whole = _Words(self, cached)
        self.cached = cached
        self.split = self._splitter()

    def _splitter(self) -> re.Pattern | None:
        """Cuts between which no merge can happen: no piece holds a mark behind another
        character, and none holds a line break or tab. Without this property: no cuts. A word of
        letters also ends before a sign that follows a letter in no piece."""
        if any(re.search(f"[^{_MARK}]{_MARK}", p) for p in self.ids):
            return None
        lone = "".join(c for c in "\n\t\r" if not any(c in p for p in self.ids))
        pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        signs = [c for c in ".,;:!?" if not any(a + c in pairs for a in string.ascii_letters)]
        letters = "".join(a for a in map(chr, range(0x250)) if a.isalpha() and not any(a + c in pairs for c in signs))
        words = f"{_MARK}*+[^{_MARK}{lone}]++|{_MARK}++"
        if signs:
            words = f"{_MARK}*+[{letters}]++(?=[{''.join(signs)}])|{words}"
        return re.compile(f"{words}|[{lone}]" if lone else words)

    def _merged(self, text: str) -> list[str]:
        """Merges from single characters: best score first, leftmost among equals."""
        parts, scores = list(text), self.scores
        after = list(range(1, len(parts))) + [-1]
        before = list(range(-1, len(parts) - 1))
        queue = []

        def propose(left: int, right: int) -> None:
            both = parts[left] + parts[right]
            if both in scores:
                heapq.heappush(queue, (-scores[both], left, right, both))

        for i in range(len(parts) - 1):
            propose(i, i + 1)
        while queue:
            _, left, right, both = heapq.heappop(queue)
            if not parts[left] or not parts[right] or parts[left] + parts[right] != both:
                continue
            parts[left], parts[right] = both, ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
                propose(left, after[right])
            if before[left] >= 0:
                propose(before[left], left)
        return [p for p in parts if p]

    def fits(self, left: str, right: str) -> bool:
        """Whether merging the text of both from scratch keeps exactly these two tokens (with an
        empty right one: whether the left token comes out of its own text)."""
        pair = (left, right) if right else left
        known = self.compatible.get(pair)
        if known is None:
            if len(self.compatible) >= 300_000:
                self.compatible.clear()
            known = self.compatible[pair] = self._merged(left + right) == [left, right][: 1 + bool(right)]
        return known

    def _ends(self, text: str, first: int, last: int) -> list[list[int]]:
        """For each start from first to last the ends of the matches, ascending; a character of
        no piece stands alone."""
        ends = [[i] for i in range(first + 1, last + 1)]
        for end, size in self.matcher.iter(text, first, min(len(text), last + self.longest)):
            if size > 1 and end + 1 - size < last:
                ends[end + 1 - size - first].append(end + 1)
        return ends

    def tokens(self, text: str) -> list[str]:
        """The tokens of a piece of text, as strings."""
        n = len(text)
        if text in self.ids and self.fits(text, ""):
            return [text]
        ends = self._ends(text, 0, n) if n <= WINDOW else _Windows(self, text)
        open_at = bytearray(b"\xff") * (n // 8 + 1)  # bit p: an encoding may continue at p
        out: list[tuple[int, int, int]] = []  # start, end, place in ends[start]
        at, choice = 0, len(ends[0]) - 1 if n else -1
        while at < n:
            placed = False
            while choice >= 0:
                end = ends[at][choice]
                if open_at[end >> 3] >> (end & 7) & 1 and (
                    self.fits(text[out[-1][0] : at], text[at:end]) if out else self.fits(text[at:end], "")
                ):
                    out.append((at, end, choice))
                    at, choice, placed = end, len(ends[end]) - 1 if end < n else -1, True
                    break
                choice -= 1
            if not placed:
                open_at[at >> 3] &= ~(1 << (at & 7)) & 0xFF
                at, _, choice = out.pop()
                choice -= 1
        return [text[a:b] for a, b, _ in out]

    def _ids_of(self, text: str) -> list[int]:
        found = []
        for token in self.tokens(text):
            known = self.ids.get(token)
            if known is not None:
                found.append(known)
            else:
                found.extend(self.byte_ids[b] for b in token.encode("utf-8"))
        return found

    def encode_joined(self, text: str | None) -> tuple[str, str]:
        """The decimal ids joined by commas, and what they decode to; NULL is empty.

        A word's byte tokens come from whole characters, so words decode one by one."""
        if not text:
            return "", ""
        text = _MARK + text.replace(" ", _MARK)
        words = self.split.findall(text) if self.split else [text]
        found = list(map(self.whole.__getitem__, words))
        joined = ",".join(found)
        if _OTHER not in joined:  # every word decodes to itself
            return joined, text.replace(_MARK, " ")[1:]
        parts = [f.partition(_OTHER) for f in found]
        texts = [back if other else w.replace(_MARK, " ") for w, (_, other, back) in zip(words, parts, strict=True)]
        return ",".join(p[0] for p in parts), "".join(texts)[1:]

    def end_task(self) -> None:
        """Gives most of the memos back: between its tasks a worker holds some 30 MB of them, and
        other operators' tasks have the rest."""
        self.whole.shrink()
        self.compatible = dict(islice(self.compatible.items(), KEPT_WORDS))

    def encode(self, text: str | None) -> list[int]:
        joined = self.encode_joined(text)[0]
        return list(map(int, joined.split(","))) if joined else []

    def decode_inner(self, ids: list[int]) -> str:
        """Pieces joined, marks as spaces; runs of byte tokens are
        read as UTF-8, each byte that is none becoming U+FFFD."""
        try:
            return "".join(map(self.plain.__getitem__, ids))
        except KeyError:  # a byte token or the unknown one
            pass
        parts, run = [], bytearray()
        for i in ids:
            byte = self.bytes_of.get(i)
            if byte is not None:
                run.append(byte)
                continue
            if run:
                parts.append(_utf8(bytes(run)))
                run = bytearray()
            if i == self.unknown:
                parts.append(" ⁇ ")
            elif i not in self.hidden:
                parts.append(self.pieces[i].replace(_MARK, " "))
        if run:
            parts.append(_utf8(bytes(run)))
        return "".join(parts)

    def decode(self, ids: list[int]) -> str:
        text = self.decode_inner(ids)
        marked = bool(ids) and ids[0] not in self.bytes_of and self.pieces[ids[0]].startswith(_MARK)
        return text[1:] if marked else text


class _Windows:
    """The matches of a long text, looked up a window of starts at a time: memory does not grow
    with a text without blanks."""

    def __init__(self, codec: PieceCodec, text: str):
        self.codec, self.text, self.held = codec, text, {}

    def __getitem__(self, start: int) -> list[int]:
        number, place = divmod(start, WINDOW)
        if number not in self.held:
            if len(self.held) == 2:  # encoding moves forwards, and back by a few tokens
                del self.held[min(self.held, key=lambda n: -abs(n - number))]
            first = number * WINDOW
            self.held[number] = self.codec._ends(self.text, first, min(len(self.text), first + WINDOW))
        return self.held[number][place]


class _Words(dict):
    """Joined ids of words, computed when first asked for; behind them the decoded text where it
    is not the word itself.

    Two generations of at most ``most`` words and ``MEMO_BYTES`` each: when the younger is full
    it becomes the older, whose words come back when they are asked for. Words longer than
    ``MEMO_WORD`` (text without blanks is one word) are not kept.
    """

    def __init__(self, codec: PieceCodec, most: int):
        super().__init__()
        self.codec, self.most, self.older, self.size = codec, most, {}, 0

    def __missing__(self, word: str) -> str:
        kept = self.older.pop(word, None)
        if kept is None:
            ids = self.codec._ids_of(word)
            kept, back = ",".join(map(str, ids)), self.codec.decode_inner(ids)
            if back != word.replace(_MARK, " "):
                kept += _OTHER + back
        if len(word) > MEMO_WORD:
            return kept
        if len(self) >= self.most or self.size >= MEMO_BYTES:
            self.older, self.size = dict(self), 0
            self.clear()
        self[word] = kept
        self.size += _bytes(word, kept)
        return kept

    def shrink(self) -> None:
        """Leaves the words that came first in this generation, which are the frequent ones."""
        first = dict(islice(chain(self.items(), self.older.items()), KEPT_WORDS))
        self.clear()
        self.older = {}
        self.update(first)
        self.size = sum(map(_bytes, first, first.values()))


def _bytes(word: str, kept: str) -> int:
    return _SLOT + sys.getsizeof(word) + sys.getsizeof(kept)


def process_codec(model: str) -> PieceCodec:
    """The codec of this Python process: workers keep it, with its memo, from task to task."""
    held = sys.modules.setdefault("dialogweave_codecs", types.ModuleType("dialogweave_codecs")).__dict__
    if model not in held:
        held[model] = PieceCodec(model)
    return held[model]


def _utf8(run: bytes) -> str:
    try:
        return run.decode("utf-8")
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(run):
            for size in (1, 2, 3, 4):
                try:
                    out.append(run[i : i + size].decode("utf-8"))
                    i += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


def encode_documents(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per row of docs: id, n_tokens, ids_sha256, decoded_sha256 and, with
    ``with_ids``, the ids themselves.

    NULL and empty texts have no tokens; a NULL id stays NULL; repeated rows give repeated
    results; other columns are not read. Narrow: no shuffle, each text is handled whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = process_codec(model)
        sha = hashlib.sha256
        for batch in pieces(batches):
            counts, digests, decoded, lists = [], [], [], []
            for text in batch.column(1).to_pylist():
                joined, back = codec.encode_joined(text)
                counts.append(joined.count(",") + bool(joined))
                digests.append(sha(joined.encode()).hexdigest())
                decoded.append(sha(back.encode()).hexdigest())
                if with_ids:
                    lists.append(np.array(joined.split(","), np.int32) if joined else [])
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests), pa.array(decoded)]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("token_ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
        codec.end_task()

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(id_col, text_col).mapInArrow(run, schema + (", token_ids array<int>" if with_ids else ""))
