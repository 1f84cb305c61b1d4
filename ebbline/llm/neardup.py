"""MinHash near-dedup with an LSH forest.

1. Documents with equal shingle sets are one class; a class has a MinHash signature and a sketch of one bit a value.
2. Forest: every tree sorts all classes by its own order of the signature's values. In each order a class's candidates
   are its nearest neighbours, those with the longest common prefixes, from a least depth on. Where a region is crowded
   the depth adapts: all classes that share ``crowd_depth`` values are candidates of each other, however many they are.
   Candidates whose sketches differ too much go.
3. Regions: connected candidates. Links are confirmed on full sets inside a region. A small region is compared at once.
   Of a large one, some representatives are compared with every member first; what they link is one component, whose
   members needn't be compared with each other. The rest is compared with every member in blocks of bounded size. A
   task emits the stars of its links, never all pairs.
4. Components of the links.

Reach: a pair of at least the threshold shares the first ``crowd_depth`` values of some tree with a probability of
1 - (1 - J ** depth) ** 32, whatever the crowd: all but 5 in 10^6 at 0.85 (depth 7), all but 4 in 10^6 at 0.8 (depth
5). Their sketches (128 bits) fall below the threshold less ``SLACK`` in some 2 of 10^5 pairs at most; the tests
measure both. Rows of one region are all compared on full sets, so nothing is lost there.

Cost: a region of n members takes n sets for each representative, and the square of what they leave unlinked, by
blocks of 256. Classes that share many values, have like sketches, and yet link with no representative are that rest.

Defined results: a null, empty or wordless text has no shingles, is linked with nothing and is kept; fewer words than
a shingle make one shingle of all; very long texts are taken whole; rows with the same id count as linked; a row with
a null id is kept and has a null component; ties go to the smallest id; an empty table gives an empty result; other
columns, whatever their names, are left out by ``near_duplicates`` and kept by ``stage``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import cut, maybe_broadcast, release, without
from ebbline.llm.components import EDGES, Union, components

TREES, LEVELS = 32, 4
#: Values that neighbours must share at least, and that orders compare at most.
LEAST_DEPTH, DEPTH = 3, 7
#: Share of pairs at the threshold that may share no such prefix in any tree.
LOST = 1e-5
#: Neighbours on each side, whatever the depth from the least one on.
NEIGHBOURS = 2
#: How far below the threshold a sketch may be (one bit per value: over 4 standard deviations).
SLACK = 0.25
#: Classes and shingles of a block, shingles of small regions that a task takes together, and representatives of a large region.
BLOCK, BLOCK_SHINGLES, TOGETHER, FIRST = 256, 500_000, 500_000, 8

_VALUES = TREES * LEVELS
_random = np.random.default_rng(20_240_101)
_MULT = _random.integers(0, 2**32, _VALUES, dtype=np.uint32) | np.uint32(1)
_ADD = _random.integers(0, 2**32, _VALUES, dtype=np.uint32)


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted hashes of the different shingles. Bytes are lower-cased for A-Z only and split at ASCII white space."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    if len(hashed) < size:
        # as long as it is: shorter sequences differ from each other and from all shingles
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words) + b"\n%d" % len(words))], dtype=np.uint64)
    n = len(hashed) - size + 1
    mixed = hashed[:n].copy()
    for k in range(1, size):
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed += hashed[k : k + n]
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed * np.uint64(0xD6E8FEB86659FD93))


def signature(found: np.ndarray, block: int = 1024) -> np.ndarray:
    """The least value of each hash function over a set."""
    least = np.full(_VALUES, 2**32 - 1, dtype=np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(short), block):
        values = short[a : a + block, None] * _MULT[None, :]
        values += _ADD[None, :]
        np.minimum(least, values.min(axis=0), out=least)
    return least


def crowd_depth(percent: int) -> int:
    """The most values of one tree that pairs at the threshold share in some tree, but for a share of LOST."""
    return max(d for d in range(LEAST_DEPTH, DEPTH + 1) if d == LEAST_DEPTH or (1 - (percent / 100) ** d) ** TREES <= LOST)


def sketch_bits(values: np.ndarray) -> np.ndarray:
    """One bit of each value, which all its bits decide: a value's own low bits follow its shingle's."""
    mixed = values * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x85EBCA77)
    mixed ^= mixed >> np.uint32(13)
    return (mixed * np.uint32(0xC2B2AE3D)) >> np.uint32(31)


def _sketches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, tuple[bytes, bytes]] = {}
    for batch in batches:
        rows: tuple[list, ...] = ([], [], [], [], [])
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = shingles(text.as_py() or b"", size)
            digest = xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None
            signed = sketch = None
            if digest and digest not in known:
                values = signature(found)
                if len(known) > 20_000:
                    known.clear()
                known[digest] = values.astype(">u4").tobytes(), np.packbits(sketch_bits(values).astype(bool)).tobytes()
            if digest:
                signed, sketch = known[digest]
            for column, value in zip(rows, (key, len(found), digest, signed, sketch), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=["doc_id", "n_shingles", "digest", "signed", "sketch"])
    release()


def sketches(docs: DataFrame, size: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, digest of the set, its signature and its one-bit sketch."""
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return source.mapInArrow(lambda batches: _sketches(batches, size), "doc_id long, n_shingles long, digest binary, signed binary, sketch binary")


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of one-bit sketches: unlike sets agree in half of the bits."""
    return 2 * (1 - np.bitwise_count(a ^ b).sum(axis=1) / _VALUES) - 1


def connected(sketch: np.ndarray, least: float) -> np.ndarray:
    """The component of each row, where rows are linked if their sketches agree enough.

    Pivots are compared with all rows until every row outside the largest component has been one: links inside that component would change nothing."""
    label = np.arange(len(sketch))
    done = np.zeros(len(sketch), dtype=bool)
    pivot = 0
    while True:
        done[pivot] = True
        near = np.unique(label[_agree(sketch[pivot], sketch) >= least])
        label[np.isin(label, near)] = near.min(initial=label[pivot])
        open_ = ~done & (label != np.bincount(label).argmax())
        if not open_.any():
            return label
        pivot = int(open_.argmax())


class _Orders:
    """Candidates of rows that come sorted by tree and signature values. Rows of a run (one tree, crowd_depth equal values) wait until it ends."""

    def __init__(self, least: float):
        self.least = least
        self.edges: list[np.ndarray] = []
        self.first: tuple[int, int] | None = None
        self.borders: list[tuple[int, int, int]] = []  # node, tree, run

    def take(self, rows: tuple[np.ndarray, ...], seen: int, last: bool) -> int:
        """Adds what rows give, of which some have been seen; returns how many of them must come again."""
        tree, prefix, run, node, sketch = rows
        n = len(node)
        for k in range(1, NEIGHBOURS + 1):
            at = np.arange(max(0, seen - k), n - k)
            at = at[(tree[at] == tree[at + k]) & (prefix[at] == prefix[at + k]) & (node[at] != node[at + k])]
            at = at[_agree(sketch[at], sketch[at + k]) >= self.least]
            self.edges.append(np.stack([node[at], node[at + k]], axis=1))
        starts = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (tree[1:] != tree[:-1])]))
        ends = np.append(starts[1:], n)
        complete = len(starts) if last else len(starts) - 1
        if self.first is None:
            self.first = int(tree[0]), int(run[0])
        for i in range(complete):
            a, b = int(starts[i]), int(ends[i])
            # a run at either end may go on in another task
            border = (last and b == n) or (a == 0 and self.first == (tree[0], run[0]))
            if b - a <= NEIGHBOURS + 1 and not border:
                continue  # its rows are each other's neighbours
            label = connected(sketch[a:b], self.least)
            roots, at = np.unique(label, return_index=True)
            top = dict(zip(roots.tolist(), node[a:b][at].tolist(), strict=True))
            self.edges.append(np.stack([np.array([top[x] for x in label.tolist()], dtype=np.int64), node[a:b]], axis=1))
            if border:
                self.borders += [(x, int(tree[a]), int(run[a])) for x in top.values()]
        return 0 if last else max(n - int(starts[-1]), min(n, NEIGHBOURS))

    def out(self) -> pa.RecordBatch:
        pairs = np.concatenate(self.edges) if self.edges else np.empty((0, 2), dtype=np.int64)
        pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0)
        nothing = [None] * len(pairs)
        nodes, trees, runs = zip(*self.borders, strict=True) if self.borders else ([], [], [])
        columns = [[*pairs[:, 0].tolist(), *nodes], [*pairs[:, 1].tolist(), *[None] * len(nodes)], [*nothing, *trees], [*nothing, *runs]]
        self.edges, self.borders = [], []
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["a", "b", "tree", "run"])


def _candidates(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    width = _VALUES // 8
    orders = _Orders(least)
    held: list[tuple[np.ndarray, ...]] = []
    seen = new = 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        held.append((*columns, np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype=np.uint8).reshape(n, width)))
        new += n
        if new >= seen:  # what waits is copied once for as many new rows
            rows = tuple(np.concatenate(x) for x in zip(*held, strict=True))
            seen, new = orders.take(rows, seen, False), 0
            held = [tuple(x[-seen:] for x in rows)]
            yield orders.out()
    if held:
        rows = tuple(np.concatenate(x) for x in zip(*held, strict=True))
        orders.take(rows, seen, True)
        yield orders.out()


def forest(classes: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of classes (node, signed, sketch), each at most once for a tree and task."""
    spark = classes.sparkSession
    width = 4 * DEPTH

    def order(tree: Column) -> Column:
        # a tree's values as bytes; the last tree's go on with the first values
        at = tree * (4 * LEVELS)
        own = F.concat(F.substr("signed", at + 1, F.lit(width)), F.substr("signed", F.lit(1), F.greatest(at + width - 4 * _VALUES, F.lit(0))))
        return F.struct(tree.alias("tree"), F.xxhash64(F.substring(own, 1, 4 * LEAST_DEPTH)).alias("prefix"), F.substring(own, 4 * LEAST_DEPTH + 1, width).alias("deeper"))

    # a row of the orders takes its few bytes along, not the signature
    keyed = classes.select("node", "sketch", F.inline(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), order)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionByRange(n, "tree", "prefix", "deeper", "node").sortWithinPartitions("tree", "prefix", "deeper", "node")
    run = F.xxhash64("prefix", F.substring("deeper", 1, 4 * (crowd_depth(percent) - LEAST_DEPTH)))
    least = percent / 100 - SLACK
    found = cut(ranged.select("tree", "prefix", run.alias("run"), "node", "sketch").mapInArrow(lambda batches: _candidates(batches, least), "a long, b long, tree int, run long"))
    # a run that several tasks share is one: a few rows for each task
    border = found.filter("run IS NOT NULL").select("tree", "run", F.col("a").alias("b"))
    first = border.groupBy("tree", "run").agg(F.min("b").alias("a"))
    across = border.join(first, ["tree", "run"]).filter("a <> b").select("a", "b")
    return found.filter("run IS NULL").select("a", "b").union(across)


def linked(sets: list[np.ndarray], percent: int, ours: np.ndarray | None = None, columns: int = 8192) -> Iterator[tuple[int, int]]:
    """Pairs of sets with 100 * intersection >= percent * union, by products of membership matrices of bounded width. ours: flags; only pairs of one flagged and one unflagged set, else all pairs."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    left = np.arange(len(sets)) if ours is None else np.flatnonzero(ours)
    right = left if ours is None else np.flatnonzero(~ours)
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    width = max(64, min(columns, 2_000_000 // max(1, len(sets))))
    last = int(place[-1]) + 1 if len(place) else 0
    for a in range(0, last, width):
        i, j = np.searchsorted(place, [a, a + width])
        member = np.zeros((len(sets), min(width, last - a)), dtype=np.float32)
        member[owner[i:j], place[i:j] - a] = 1
        common += member[left] @ member[right].T
    both = np.rint(common).astype(np.int64)
    hit = 100 * both >= percent * (sizes[left][:, None] + sizes[right][None, :] - both)
    if ours is None:
        hit = np.triu(hit, 1)
    for x, y in zip(*np.nonzero(hit), strict=True):
        yield int(left[x]), int(right[y])


def _verified(task: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The stars of the links within one task: small regions, or two blocks (or one) of a large one."""
    union = Union()
    for _, region in task.groupby("region", sort=False):
        nodes = region["node"].tolist()
        if len(nodes) < 2:
            continue
        sets = [np.frombuffer(x, dtype=np.uint64) for x in region["found"]]
        side = region["side"].to_numpy()
        ours = None if (side == 2).all() else side == 0
        if ours is not None and (ours.all() or not ours.any()):
            continue
        for x, y in linked(sets, percent, ours):
            union.join(nodes[x], nodes[y])
    members = [(union.root(x), x) for x in union.up]
    return pd.DataFrame([m for m in members if m[0] != m[1]], columns=["a", "b"], dtype=np.int64)


def _compared(tasks: DataFrame, percent: int) -> DataFrame:
    """tasks: task, region, node, found, side (0 against 1, or 2 among themselves)."""
    return tasks.groupBy("task").applyInPandas(lambda pdf: _verified(pdf, percent), EDGES)


def _blocks(n: str, total: str) -> Column:
    return F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(total) / BLOCK_SHINGLES)).cast("int")


def _others(number: Column) -> Column:
    """0 to number - 1."""
    return F.when(number > 0, F.sequence(F.lit(0), number - 1)).otherwise(F.array().cast("array<int>"))


def links(docs: DataFrame, members: DataFrame, size: int, percent: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Edges that connect what is linked within each region. members: region, node, n_shingles."""
    members = cut(members)
    sums = members.groupBy("region").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"))
    sums = cut(sums.filter("n > 1").withColumn("blocks", _blocks("n", "total")))
    small, everything, large = sums.agg(F.coalesce(F.sum(F.when(F.col("blocks") == 1, F.col("total"))), F.lit(0)), F.count("*"), F.count_if(F.col("blocks") > 1)).first()
    buckets = int(small // TOGETHER + 1)
    buckets = max(buckets, min(docs.sparkSession.sparkContext.defaultParallelism * 2, int(everything)))
    plan = members.join(maybe_broadcast(sums.select("region", "blocks"), everything), "region")
    plan = cut(plan.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))

    source = docs.select(F.col(key).cast("long").alias("node"), F.col(text).cast("binary").alias("__text"))
    chosen = source.join(maybe_broadcast(plan.select("node", "region", "block", "blocks"), plan.count()), "node").select("__text", "node", "region", "block", "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py() or b"", size).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), *batch.columns[1:]], names=["found", "node", "region", "block", "blocks"])

    full = cut(chosen.mapInArrow(run, "found binary, node long, region long, block int, blocks int"))  # texts become sets before the shuffle
    bucket = F.concat(F.lit("s"), F.pmod(F.xxhash64("region"), F.lit(buckets)))
    out = _compared(full.filter("blocks = 1").select(bucket.alias("task"), "region", "node", "found", F.lit(2).alias("side")), percent)
    return out.union(_large_links(full.filter("blocks > 1"), plan.filter("blocks > 1"), sums.filter("blocks > 1"), large, percent)) if large else out


def _large_links(full: DataFrame, plan: DataFrame, sums: DataFrame, regions: int, percent: int) -> DataFrame:
    """Links of large regions: representatives against all, then what they left unlinked against all, by blocks."""
    # the representatives are any few members: those with the least hash of each residue
    slot = F.pmod(F.xxhash64(F.lit(1), "node"), F.lit(FIRST))
    chosen = plan.groupBy("region", slot.alias("slot")).agg(F.min_by("node", F.xxhash64(F.lit(2), "node")).alias("node")).select("region", "node")
    heads = full.join(maybe_broadcast(chosen, regions * FIRST), ["region", "node"], "left_semi")
    task = F.concat_ws(":", F.lit("f"), "region", "block")
    copies = heads.select("region", "node", "found", F.explode(_others(F.col("blocks"))).alias("block"))
    tasks = full.select(task.alias("task"), "region", "node", "found", F.lit(1).alias("side")).union(copies.select(task, "region", "node", "found", F.lit(0)))
    first = cut(_compared(tasks, percent))

    roots = components(first)
    rooted = cut(plan.select("region", "node").join(roots, "node", "left").select("region", "node", F.coalesce("root", "node").alias("root")))
    most = rooted.groupBy("region", "root").agg(F.count("*").alias("n")).groupBy("region").agg(F.max_by("root", F.struct("n", "root")).alias("most"))
    # members outside the largest component are still to be compared: with each other, and with that component
    left = cut(rooted.join(maybe_broadcast(most, regions), "region").select("region", "node", (F.col("root") != F.col("most")).alias("open")))
    sets = full.select("region", "node", "found").join(left, ["region", "node"])
    size = F.octet_length("found") / 8
    counts = sets.groupBy("region").agg(
        F.count_if("open").alias("n"),
        F.coalesce(F.sum(F.when(F.col("open"), size)), F.lit(0)).alias("t"),
        F.count_if(~F.col("open")).alias("m"),
        F.coalesce(F.sum(F.when(~F.col("open"), size)), F.lit(0)).alias("u"),
    )
    counts = cut(counts.select("region", _blocks("n", "t").alias("opens"), _blocks("m", "u").alias("rest")).filter("opens > 0"))
    sets = sets.join(maybe_broadcast(counts, regions), "region")
    sets = sets.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("open"), F.col("opens")).otherwise(F.greatest("rest", F.lit(1)))).cast("int"))
    some = sets.filter("open")
    among = some.select("region", "node", "found", "block", F.explode(_others(F.col("opens"))).alias("other"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(F.col("block") > F.col("other"), 1).when(F.col("block") < F.col("other"), 0).otherwise(2)
    tasks = among.select(F.concat_ws(":", F.lit("o"), "region", low, high).alias("task"), "region", "node", "found", side.alias("side"))
    ours = some.select("region", "node", "found", "block", F.explode(_others(F.col("rest"))).alias("other"))
    tasks = tasks.union(ours.select(F.concat_ws(":", F.lit("g"), "region", "block", "other"), "region", "node", "found", F.lit(0)))
    theirs = sets.filter("NOT open").select("region", "node", "found", "block", F.explode(_others(F.col("opens"))).alias("other"))
    tasks = tasks.union(theirs.select(F.concat_ws(":", F.lit("g"), "region", "other", "block"), "region", "node", "found", F.lit(1)))
    return first.union(_compared(tasks, percent))


def _split_ids(known: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges between the classes of rows that share an id."""
    twice = known.groupBy("doc_id").agg(F.count_distinct("digest").alias("n")).filter("n > 1").select("doc_id")
    of = known.join(twice, "doc_id", "left_semi").select("doc_id", "digest").join(classes.select("digest", "node"), "digest").select("doc_id", "node").distinct()
    least = of.groupBy("doc_id").agg(F.min("node").alias("a"))
    return of.join(least, "doc_id").filter("a <> node").select("a", F.col("node").alias("b"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept and n_copies (documents with an equal set)."""
    signed = cut(sketches(docs, size, text, key))
    known = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut(known.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("signed").alias("signed"), F.first("sketch").alias("sketch"), F.count("*").alias("n_copies")))
    # tables between the Python steps: one task then needs one worker at a time
    pairs = cut(forest(classes, percent))
    members = components(pairs).select(F.col("root").alias("region"), "node")
    sized = members.join(classes.groupBy("node").agg(F.max("n_shingles").alias("n_shingles")), "node")
    found = cut(links(docs, sized.select("region", "node", "n_shingles"), size, percent, text, key))
    roots = cut(components(found.union(_split_ids(known, classes))))
    named = classes.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"), "n_copies")
    joined = signed.join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return joined.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def stage(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near copies: the one with the smallest id."""
    gone = cut(near_duplicates(docs, size, percent).filter("NOT kept").select("doc_id").distinct())
    return without(docs, gone)
