"""Token ids of texts, and their packing into fixed windows.

Two packings share the tokenizer and one plan: texts are read where the scan puts them and packed in streams of
bounded size (no shuffle), so a partition holds at most one stream in memory and at most one unfilled window is left
over for each stream. A retried task gives the same rows: ids come from the partition and the place in it.

* ``best_fit``: best-fit-decreasing; a segment tree over the free room of open windows finds the tightest one.
* ``differencing``: Karmarkar-Karp; the two partial partitions with the largest imbalances are merged, heavy windows
  of one with light windows of the other, until one is left. Nothing is moved afterwards: while a window is over
  capacity, the number of windows rises by one and the pieces are differenced again. Pieces may be cut anywhere, so the
  last pieces of a group are cut small, which lets the sums meet within a few tokens, and a group leaves that room free.

Documents longer than a window are split without loss: full windows first, the rest is packed like any document.

Defined results: a null text counts as the empty one (its end mark alone); null ids stay; repeated rows are packed
one by one; very long texts are read whole and cut; of equal sizes the earlier piece goes first, of equal rooms the
last opened window; an empty table gives an empty result; other columns are left out, whatever their names.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import release

#: Tokens of a window, and the id that ends each document.
WINDOW, END = 2048, 1
#: Words whose ids a worker remembers.
REMEMBERED = 100_000
#: Letters, then marks that the tokenizer takes for a word of their own.
_MARKED = re.compile(r"([^\W\d_]+)([!#-&(-/:-;=?@\[\]^`{}~]+)")
#: Windows that are balanced together, the longest piece, the sizes of a group's last pieces (as many of each as windows), and the share of a window that a group leaves free.
TOGETHER, PIECE, LAST, FREE = 32, 512, (32, 16), 1 / 200
#: Tokens that one best-fit stream holds.
STREAM = 4_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words(dict):
    """Ids of words by the tokenizers library's vocabulary, each different word encoded once.

    White space is dropped by the tokenizer's normalizer and is never inside a token, so texts are cut at spaces and
    line feeds. Words of Latin letters, with or without ASCII marks after them, are merged by tiktoken over the same
    merges; every other word goes through the tokenizers library itself. The two agree because each token's own
    letters merge to that token (the tests check this for the whole vocabulary, and both on random texts).
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.before: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        ranks, self.ids_of = merge_ranks(path)
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def _library(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _letters(self, word: str) -> bytes:
        """Letters below U+0130 are in normal form and lower-case one by one."""
        of = self.ids_of
        return array("I", [of[r] for r in self.merge(word.lower().encode() + WORD_END)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        found = self.before.get(word)
        if found is None:
            if word.isalpha() and max(word) < "\u0130":
                found = self._letters(word)
            elif (m := _MARKED.fullmatch(word)) and m[1].isalpha() and max(m[1]) < "\u0130":
                found = self[m[1]] + self[m[2]]
            else:
                found = self._library(word)
        self[word] = found
        return found

    def ids(self, texts: list[str]) -> list[bytes]:
        """Unsigned 32-bit ids (little-endian) of each text, without the end mark."""
        if len(self) > REMEMBERED:
            # what is used again moves over, the rest is forgotten
            self.before = dict(self)
            self.clear()
            self[""] = b""
        get = self.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").split(" "))) for t in texts]


#: Stands after a word's last letter; no UTF-8 text has this byte.
WORD_END = b"\xff"


def merge_ranks(path: str) -> tuple[dict[bytes, int], list[int]]:
    """The vocabulary's merges as ranks of byte strings, and the id of each rank (-1 for what never ends a merge)."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    # byte-level vocabularies write bytes as printable characters: those that print stand for themselves
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}

    def raw(token: str) -> bytes:
        body = token.removesuffix("</w>")
        return bytes(byte_of[c] for c in body) + (WORD_END if body != token else b"")

    ranks = {bytes([b]): b for b in range(256)}
    for b in range(255):  # a word's last letter comes with its end, before any merge
        ranks[bytes([b]) + WORD_END] = len(ranks)
    for pair in model["merges"]:
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        ranks.setdefault(raw(left + right), len(ranks))
    ids = [-1] * len(ranks)
    for token, i in model["vocab"].items():
        if not token.startswith("<|") and (r := ranks.get(raw(token))) is not None:
            ids[r] = i
    return ranks, ids


_words: dict[str, Words] = {}


def tokenizer(path: str) -> Words:
    """The worker's tokenizer: one for each vocabulary, kept between tasks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


def best_fit(lengths: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """Items of each window: longest first, each into the window with the least room that holds it."""
    size = 1 << capacity.bit_length()
    tree = [0] * (2 * size)  # how many open windows have so much room, and sums of them
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    windows: list[list[int]] = []

    def add(room: int, n: int) -> None:
        i = room + size
        while i:
            tree[i] += n
            i >>= 1

    def tightest(need: int) -> int:
        """The least room of at least so much, or -1."""
        i = need + size
        if tree[i]:
            return need
        while i > 1:
            if not i & 1 and tree[i + 1]:
                i += 1
                while i < size:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - size
            i >>= 1
        return -1

    for item in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        room = tightest(lengths[item])
        if room < 0:
            w, room = len(windows), capacity
            windows.append([])
        else:
            w = rooms[room].pop()
            add(room, -1)
        windows[w].append(item)
        left = room - lengths[item]
        if left:
            rooms[left].append(w)
            add(left, 1)
    return windows


def differencing(lengths: list[int], n: int) -> tuple[list[list[int]], int]:
    """Items of n windows with near-equal sums, and the heaviest sum."""
    heap: list[tuple[int, int, np.ndarray, list[list[int]]]] = []
    for k, size in enumerate(lengths):
        sums = np.zeros(n, dtype=np.int64)
        sums[-1] = size
        heap.append((-size, k, sums, [[] for _ in range(n - 1)] + [[k]]))
    heapq.heapify(heap)
    merged = len(lengths)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        # a and b rise: the heaviest of one meets the lightest of the other
        total = a + b[::-1]
        order = np.argsort(total, kind="stable")
        y.reverse()
        both = [p + q if p and q else p or q for p, q in zip(x, y, strict=True)]
        total = total[order]
        heapq.heappush(heap, (int(total[0] - total[-1]), merged, total, [both[k] for k in order]))
        merged += 1
    if not heap:
        return [[] for _ in range(n)], 0
    return heap[0][3], int(heap[0][2][-1])


def balanced(lengths: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """Items of near-equal windows: from the least number that could hold them on, the first that differencing fits. No item may be longer than a window."""
    n = max(1, -(-sum(lengths) // capacity))
    while (found := differencing(lengths, n))[1] > capacity:
        n += 1
    return [sorted(w) for w in found[0] if w]


class Room:
    """What a group still takes: pieces of up to PIECE tokens first, small ones at its end."""

    def __init__(self, window: int = WINDOW, together: int = TOGETHER):
        self.piece = min(PIECE, window)
        self.small = [k for k in reversed(LAST) for _ in range(together)] if 8 * sum(LAST) <= window else []
        self.large = together * (window - int(FREE * window)) - sum(self.small)

    def take(self, wanted: int) -> int:
        """The size of the next piece of a document that has so many tokens left."""
        if self.large:
            size = min(wanted, self.piece, self.large)
            self.large -= size
            return size
        return min(wanted, self.small.pop())

    @property
    def full(self) -> bool:
        return not self.large and not self.small


def _texts(batches: Iterator[pa.RecordBatch], path: str, rows: int = 512, chars: int = 4_000_000) -> Iterator[tuple[int | None, bytes]]:
    """Each document's id and its ids with the end mark, a few documents at a time."""
    words, end = tokenizer(path), np.array([END], dtype="<u4").tobytes()

    def encoded(keys, texts):
        return zip(keys, (x + end for x in words.ids(texts)), strict=True)

    keys, texts, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            t = text.as_py() or ""
            keys.append(key)
            texts.append(t)
            size += len(t)
            if len(texts) >= rows or size >= chars:
                yield from encoded(keys, texts)
                keys, texts, size = [], [], 0
    if texts:
        yield from encoded(keys, texts)
    words.before = {}
    release()


def _first_sequence() -> int:
    return TaskContext.get().partitionId() << 36


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_balanced(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece: where it lies in its document and in its window."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = _first_sequence()
        rows: list[tuple] = []
        waiting: list[tuple] = []  # doc, start, ids, tokens of the document
        group = Room(window)

        def settle() -> None:
            nonlocal sequence
            for pieces in balanced([len(w[2]) // 4 for w in waiting], window):
                offset = 0
                for k in pieces:
                    doc, start, ids, total = waiting[k]
                    rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset))
                    offset += len(ids) // 4
                sequence += 1
            waiting.clear()

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            rows.clear()
            names = [x.split()[0] for x in PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        for doc, ids in _texts(batches, path):
            total, start = len(ids) // 4, 0
            while total - start >= window:
                part = ids[4 * start : 4 * (start + window)]
                rows.append((doc, start, window, zlib.crc32(part), total, sequence, 0))
                sequence += 1
                start += window
            while start < total:
                size = group.take(total - start)
                waiting.append((doc, start, ids[4 * start : 4 * (start + size)], total))
                start += size
                if group.full:
                    settle()
                    group = Room(window)
            if len(rows) >= 20_000:
                yield out()
        settle()
        yield out()

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, PIECES)


PACKED = "sequence_id long, input_ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, starts array<long>, n_tokens int"


def pack_best_fit(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, window: int = WINDOW, stream: int = STREAM) -> DataFrame:
    """One row per window: its ids (little-endian uint32), cumulative segment lengths, positions that restart at each segment, and where each segment comes from."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = _first_sequence()
        full: list[list[tuple]] = []
        waiting: list[tuple] = []
        held = 0

        def rows(windows: list[list[tuple]]) -> pa.RecordBatch:
            nonlocal sequence
            made = []
            for segments in windows:
                lengths = [len(s[2]) // 4 for s in segments]
                positions = np.concatenate([np.arange(n, dtype="<u4") for n in lengths]).tobytes()
                made.append((sequence, b"".join(s[2] for s in segments), [0, *np.cumsum(lengths).tolist()], positions, [s[0] for s in segments], [s[1] for s in segments], sum(lengths)))
                sequence += 1
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32()]
            cols = list(zip(*made, strict=True)) if made else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PACKED.split(", ")])

        for doc, ids in _texts(batches, path):
            total, start = len(ids) // 4, 0
            while total - start >= window:
                full.append([(doc, start, ids[4 * start : 4 * (start + window)])])
                start += window
                if len(full) >= 512:
                    yield rows(full)
                    full = []
            if start < total:
                waiting.append((doc, start, ids[4 * start :]))
                held += total - start
            if held >= stream:
                packed = best_fit([len(w[2]) // 4 for w in waiting], window)
                for a in range(0, len(packed), 512):
                    yield rows([[waiting[k] for k in w] for w in packed[a : a + 512]])
                waiting, held = [], 0
        packed = best_fit([len(w[2]) // 4 for w in waiting], window)
        yield rows(full)
        for a in range(0, len(packed), 512):
            yield rows([[waiting[k] for k in w] for w in packed[a : a + 512]])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, PACKED)


def write_packed(docs: DataFrame, out: str, window: int = WINDOW, pad: int = 0, **how) -> None:
    """Writes the packed windows as Parquet: each row of the id matrix padded on the right to the window's width, with its cumulative segment lengths and position resets (padded with 0)."""
    packed = pack_best_fit(docs, window=window, **how)
    wide = {c: F.expr(f"rpad({c}, {4 * window}, X'{fill.to_bytes(4, 'little').hex()}')") for c, fill in (("input_ids", pad), ("position_ids", 0))}
    packed.withColumns(wide).write.parquet(out)


def matrix(rows: pd.DataFrame, window: int = WINDOW, pad: int = 0) -> np.ndarray:
    """The id matrix of packed windows, padded on the right."""
    out = np.full((len(rows), window), pad, dtype=np.uint32)
    for i, ids in enumerate(rows["input_ids"]):
        part = np.frombuffer(ids, dtype="<u4")
        out[i, : len(part)] = part
    return out


def digest(docs: DataFrame) -> DataFrame:
    """Per window of the best-fit packing: its documents, segment bounds, and checksums of ids and positions."""
    return pack_best_fit(docs).select(
        "sequence_id",
        "doc_ids",
        "starts",
        "cu_seqlens",
        "n_tokens",
        F.crc32("input_ids").alias("ids_crc32"),
        F.crc32("position_ids").alias("positions_crc32"),
    )
