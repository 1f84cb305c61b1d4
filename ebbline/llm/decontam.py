"""Benchmark decontamination by latent semantic retrieval.

1. The document frequencies of the benchmark's words are counted in one pass over all documents.
2. Benchmark items are cut into overlapping passages as wide as the widest window, so that long items need no long
   window. Passages are TF-IDF vectors; a distributed randomised SVD (range finder with power iterations, each one
   pass over the passages) gives the latent space, with a dimension for each passage of a portion.
3. Every document is read whole, as overlapping windows. A window whose cosine with a passage in the latent space is
   high enough is a candidate. Windows that can't reach it are left out first, by an upper bound of their product with
   any passage: each word counts with its largest weight in one.
4. Candidates are confirmed on words: the longest common subsequence with the whole item must cover enough of it, or
   less of it if the answer (its last sentence) is there.

The benchmark is taken in portions of bounded size, and ``ROUND`` portions share one pass over the documents, so what
goes to the executors is bounded too (a single item is whole in each portion that has passages of it); documents are
never shuffled. The cosine divides by the square root of the summed squares of a window's words, so where a window
repeats words it is above the true one: never a candidate less.

Defined results: a null, empty or wordless text is clean; wordless benchmark items match nothing; rows with equal ids
are searched one by one and give one row for each item, the best; of equally good places the first counts; very long
texts and items are read whole; an empty table on either side gives an empty result; other columns, whatever their
names, are left out by ``find`` and kept by ``stage``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import cut, release, without

#: Passages of benchmark items and words of a portion. The latent space has a dimension for each passage, so none loses any of its length in it.
ITEMS, ITEM_WORDS = 256, 100_000
#: Portions that are searched in one pass.
ROUND = 8
#: Bits of the filter that tells the benchmark's words from others while words are counted, and words that a task counts at a time.
FILTER_BITS, COUNTED = 1 << 25, 500_000
#: Extra dimensions of the range finder, and power iterations.
EXTRA, POWER = 16, 2
#: Power of a word's inverse frequency in its weight: rare words count more.
SHARP = 1.5
#: Words of a block; windows are so many blocks wide.
BLOCK, WIDE = 16, (1, 2, 4)
#: Words of a passage at most, and from one passage of an item to the next.
PASSAGE, STEP = BLOCK * WIDE[-1], BLOCK * WIDE[-1] // 2
#: Words and windows that are searched at a time.
WORDS_AT_ONCE, WINDOWS_AT_ONCE = 200_000, 512
#: Least cosine of a candidate; least share of an item that its common subsequence covers; the same with the answer; share of the answer.
COSINE, COVER, COVER_ANSWERED, ANSWER = 0.4, 0.6, 0.45, 0.8

_GAPS = bytes(32 if chr(i) in " !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\x00" or i < 32 or i == 127 else i for i in range(256))


def words(text: str) -> list[bytes]:
    """Lower-case words; ASCII marks separate."""
    return text.lower().encode("utf-8", "replace").translate(_GAPS).split()


def answer_of(text: str) -> list[bytes]:
    """Words of the last line or sentence."""
    parts = [w for p in text.replace("\n", ". ").split(". ") if (w := words(p))]
    return parts[-1] if parts else []


def subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    row = np.zeros(len(b) + 1, dtype=np.int32)
    for x in a:
        row[1:] = np.maximum(row[1:], row[:-1] + (b == x))
        np.maximum.accumulate(row, out=row)
    return int(row[-1])


@dataclass
class Model:
    """What the executors need of one portion of the benchmark. Words have numbers from 1 on, those of its passages first; 0 is every other word."""

    ids: list[int]
    items: list[np.ndarray]
    answers: list[np.ndarray]
    vocabulary: dict[bytes, int]
    weight: np.ndarray  # of each word
    reach: np.ndarray  # the most that each word adds to a product with a passage
    latent: np.ndarray  # of each word of a passage, times its weight; the last row is 0
    passages: np.ndarray  # with unit length before the projection
    owners: np.ndarray  # the item of each passage


def starts(n: int) -> list[int]:
    """First words of the passages of an item of n words."""
    return [*range(0, n - PASSAGE, STEP), max(0, n - PASSAGE)]


#: An item of a portion: its id, its text and the first words of those of its passages that belong to the portion.
Part = tuple[int, str, list[int]]


def portions(benchmark: DataFrame, text: str, key: str) -> Iterator[list[Part]]:
    """Items in portions of bounded size, by id; the driver holds one at a time. An item with more passages than a portion takes several."""
    some: list[Part] = []
    size = passages = 0
    for row in benchmark.select(F.col(key).cast("long"), text).orderBy(key, text).toLocalIterator():
        n = len(words(row[1])) if row[1] is not None else 0
        if not n:
            continue
        every = starts(n)
        for a in range(0, len(every), ITEMS):
            part = every[a : a + ITEMS]
            if some and (passages + len(part) > ITEMS or size + n > ITEM_WORDS):
                yield some
                some, size, passages = [], 0, 0
            some.append((row[0], row[1], part))
            size += n
            passages += len(part)
    if some:
        yield some


def _known(found: list[bytes], vocabulary: dict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(vocabulary.get, found, repeat(0)), dtype=np.int32, count=len(found))


def _hashes(found: Iterable[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=n)


def frequencies(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text") -> tuple[int, DataFrame]:
    """The number of documents, and a table of those with each of the benchmark's words (by 64-bit hash), in one pass whatever the benchmark's size.

    A filter of fixed size leaves out nearly all other words before they are counted."""
    marks = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for row in benchmark.select(item_text).filter(F.col(item_text).isNotNull()).toLocalIterator():
        some = set(words(row[0]))
        at = _hashes(some, len(some)) % np.uint64(FILTER_BITS)
        np.bitwise_or.at(marks, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        held: list[np.ndarray] = []
        n = size = 0

        def out(documents: list[int]) -> pa.RecordBatch:
            found, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            held.clear()
            hashes = pa.array([*found.view(np.int64).tolist(), *[None] * len(documents)], pa.int64())
            return pa.RecordBatch.from_arrays([hashes, pa.array([*counts.tolist(), *documents], pa.int64())], names=["word", "n"])

        for batch in batches:
            for t in batch.column(0):
                n += 1
                some = set(words(t.as_py() or ""))
                hashed = _hashes(some, len(some))
                at = hashed % np.uint64(FILTER_BITS)
                held.append(hashed[(marks[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1])
                size += len(held[-1])
            if size > COUNTED:
                yield out([])
                size = 0
        yield out([n])

    counts = cut(docs.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    n = counts.filter("word IS NULL").agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    return n, counts.filter("word IS NOT NULL")


def randomised_svd(rows: DataFrame, width: int, rank: int) -> np.ndarray:
    """The leading right singular vectors (width x rank) of sparse rows (at array<int>, value array<double>): only sums of a word's vectors leave the tasks."""
    spark = rows.sparkSession
    rng = np.random.default_rng(7)
    basis = rng.standard_normal((width, min(rank + EXTRA, width)))
    for turn in range(POWER + 1):
        shared = spark.sparkContext.broadcast(basis)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            side = shared.value
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for at, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    latent = np.asarray(value) @ side[at]
                    for j, v in zip(at, value, strict=True):
                        total[j] = total[j] + v * latent if j in total else v * latent
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["word", "sums"])

        product = np.zeros_like(basis)
        for word, sums in rows.mapInArrow(run, "word int, sums binary").toLocalIterator():
            product[word] += np.frombuffer(sums, dtype=np.float64)
        shared.unpersist()
        if turn < POWER:
            basis = np.linalg.qr(product)[0]
    # product = (A'A) basis, with an orthonormal basis: a small eigenproblem remains
    small = basis.T @ product
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(values)[::-1][:rank]
    return basis @ vectors[:, best[values[best] > 1e-9]]


def fit(some: list[Part], n: int, counts: DataFrame) -> Model:
    """The latent space of one portion of the benchmark. n, counts: as frequencies() gives them."""
    spark = counts.sparkSession
    split = [words(t) for _, t, _ in some]
    pieces = [(item, split[item][a : a + PASSAGE]) for item, (_, _, at) in enumerate(some) for a in at]
    ours = sorted({w for _, x in pieces for w in x})
    others = sorted({w for x in split for w in x}.difference(ours))
    vocabulary = {w: i for i, w in enumerate([*ours, *others], 1)}
    hashes = _hashes(vocabulary, len(vocabulary)).view(np.int64).tolist()
    wanted = spark.createDataFrame([(h, i) for i, h in enumerate(hashes, 1)], "word long, at int")
    df = np.zeros(len(vocabulary) + 1)
    for r in counts.join(F.broadcast(wanted), "word").select("at", "n").collect():
        df[r["at"]] = r["n"]
    idf = np.log((1 + n) / (1 + df)) + 0.05
    idf[0] = np.median(idf[1:])  # the documents' own words count like a middling one of the benchmark
    weight = idf**SHARP
    reach, vectors = np.zeros(len(weight)), []
    for _, x in pieces:
        at, tf = np.unique([vocabulary[w] for w in x], return_counts=True)
        value = tf * weight[at]
        value /= np.linalg.norm(value)
        reach[at] = np.maximum(reach[at], weight[at] * value)
        vectors.append((at, value))
    rows = spark.createDataFrame([(at.tolist(), v.tolist()) for at, v in vectors], "at array<int>, value array<double>")
    space = randomised_svd(rows, len(ours) + 1, len(pieces))
    passages = np.stack([v @ space[at] for at, v in vectors]).astype(np.float32)
    latent = np.zeros((len(ours) + 2, space.shape[1]), dtype=np.float32)
    latent[:-1] = space * weight[: len(ours) + 1, None]
    numbered = [np.array([vocabulary[w] for w in x], dtype=np.int32) for x in split]
    answers = [np.array([vocabulary[w] for w in answer_of(t)], dtype=np.int32) for _, t, _ in some]
    return Model([k for k, _, _ in some], numbered, answers, vocabulary, weight, reach, latent, passages, np.array([item for item, _ in pieces]))


def candidates(texts: list[np.ndarray], model: Model) -> dict[tuple[int, int], list[tuple[int, int, float]]]:
    """(text, item) -> windows (start, end, cosine). All texts lie one after another; windows stay within theirs."""
    lengths = np.array([len(x) for x in texts])
    here = np.concatenate(texts)
    blocks = -(-lengths // BLOCK)
    owner = np.repeat(np.arange(len(texts)), blocks)
    base = np.cumsum(lengths) - lengths
    first = np.cumsum(blocks) - blocks
    number = np.arange(len(owner)) - first[owner]
    at = base[owner] + BLOCK * number
    last = (first + blocks)[owner]
    if not len(at):
        return {}
    whole = np.concatenate([[0.0], np.cumsum(np.add.reduceat(model.weight[here] ** 2, at))])
    most = np.concatenate([[0.0], np.cumsum(np.add.reduceat(model.reach[here], at))])
    found: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
    for width in WIDE:
        ends = np.minimum(np.arange(len(at)) + width, last)
        total = whole[ends] - whole[:-1]
        # no passage's product with the window is above the sum of its words' largest shares (sums of many words are not exact)
        some = np.flatnonzero((most[ends] - most[:-1] >= COSINE * np.sqrt(total) * (1 - 1e-6)) & (total > 0))
        for a in range(0, len(some), WINDOWS_AT_ONCE):
            part = some[a : a + WINDOWS_AT_ONCE]
            start = at[part]
            end = np.minimum(start + width * BLOCK, (base + lengths)[owner[part]])
            place = start[:, None] + np.arange(width * BLOCK)[None, :]
            inside = place < end[:, None]
            known = here[np.where(inside, place, 0)] * inside
            known[known >= len(model.latent)] = 0  # words of an item that none of the passages has
            row, column = np.nonzero(known)
            counts = np.bincount(row, minlength=len(part))
            sums = np.add.reduceat(model.latent[known[row, column]], np.cumsum(counts) - counts, axis=0)
            cosine = (sums @ model.passages.T) / np.sqrt(total[part])[:, None]
            for i, passage in zip(*np.nonzero(cosine >= COSINE), strict=True):
                text = int(owner[part[i]])
                found.setdefault((text, int(model.owners[passage])), []).append((int(start[i] - base[text]), int(end[i] - base[text]), float(cosine[i, passage])))
    return found


def confirmed(here: np.ndarray, item: int, windows: list[tuple[int, int, float]], model: Model, present: np.ndarray) -> tuple[float, int, int, float] | None:
    """Covered share, window and cosine of the window that covers most of the item, if it covers enough. present: flags, all false."""
    passage, answer = model.items[item], model.answers[item]
    best, tried = None, set()
    # one window of each stretch is tried; of a long item with the stretch beside it too, so the others would show no more
    stretch, beside = (2 * BLOCK, len(passage)) if len(passage) <= PASSAGE else (len(passage) // 2, len(passage) + len(passage) // 2)
    for start, end, cosine in sorted(windows, key=lambda x: (-x[2], x[0], x[1])):
        # a window and as much around it as the item could take
        part = here[max(0, start - beside) : end + beside]
        # a subsequence has no more words than occur at all
        present[part] = True
        share, answered = present[passage].mean(), len(answer) > 0 and present[answer].mean() >= ANSWER
        present[part] = False
        key = start // stretch
        if share < (COVER_ANSWERED if answered else COVER) or key in tried:
            continue
        tried.add(key)
        share = subsequence(passage, part) / len(passage)
        answered = answered and subsequence(answer, part) >= ANSWER * len(answer)
        if share >= (COVER_ANSWERED if answered else COVER) and (best is None or share > best[0]):
            best = (share, start, end, cosine)
            if share == 1:
                break
    return best


def search(texts: list[np.ndarray], model: Model) -> list[tuple[int, int, float, int, int, float]]:
    """text, item, covered share, start and end of the window in words, cosine: of each item found in a text, its best window."""
    present = np.zeros(len(model.weight), dtype=bool)
    found = []
    for (text, item), windows in sorted(candidates(texts, model).items()):
        if best := confirmed(texts[text], item, windows, model, present):
            found.append((text, item, *best))
    return found


FOUND = "doc_id long, item_id long, covered double, first_word long, last_word long, cosine double"


def _searched(docs: DataFrame, models: list[Model], text: str, key: str) -> DataFrame:
    """What one pass over the documents finds of some portions."""
    every = {w: i for i, w in enumerate({w for m in models for w in m.vocabulary}, 1)}
    maps = []
    for m in models:
        to = np.zeros(len(every) + 1, dtype=np.int32)
        for w, i in m.vocabulary.items():
            to[every[w]] = i
        maps.append(to)
    shared = docs.sparkSession.sparkContext.broadcast((every, maps, models))
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, maps, models = shared.value

        def out(keys: list, texts: list[np.ndarray]) -> pa.RecordBatch:
            rows = []
            for to, model in zip(maps, models, strict=True):
                ours = [to[x] for x in texts]
                at = [i for i, x in enumerate(ours) if x.any()]
                if at:
                    rows += [(keys[at[i]], model.ids[item], *rest) for i, item, *rest in search([ours[i] for i in at], model)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])

        keys, texts, size = [], [], 0
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                here = _known(words(t.as_py() or ""), every)
                if not here.any():
                    continue
                keys.append(k)
                texts.append(here)
                size += len(here)
                if size >= WORDS_AT_ONCE:
                    yield out(keys, texts)
                    keys, texts, size = [], [], 0
        if texts:
            yield out(keys, texts)
        release()

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, FOUND)


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """One row for each benchmark item found in a document: its best place."""
    out = docs.sparkSession.createDataFrame([], FOUND)
    n, counts = frequencies(docs, benchmark, text, item_text)
    models: list[Model] = []
    for some in portions(benchmark, item_text, item_key):
        models.append(fit(some, n, counts))
        if len(models) == ROUND:
            out = out.union(_searched(docs, models, text, key))
            models = []
    if models:
        out = out.union(_searched(docs, models, text, key))
    # a few rows: one for each portion that has passages of the item
    best = F.max(F.struct("covered", "cosine", (-F.col("first_word")).alias("first"), "last_word")).alias("best")
    found = out.groupBy("doc_id", "item_id").agg(best)
    return found.select("doc_id", "item_id", "best.covered", (-F.col("best.first")).alias("first_word"), "best.last_word", "best.cosine")


def stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones."""
    gone = cut(find(docs, benchmark).filter("doc_id IS NOT NULL").select("doc_id").distinct())
    return without(docs, gone)
