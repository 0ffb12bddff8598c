"""All similar pairs between set-valued records: sorted sketch forests over minhash signatures.

Equal sets are one class first, so copies are compared once. Each tree has minhash levels of its own, packed into one
64-bit signature, and orders the classes lexicographically by it. Neighbourhoods are the runs that share a prefix. A run is
compared as a whole as soon as it is small; a crowded one is left for the runs of the next level inside it, down to the
deepest level, where every run is compared. So sparse neighbourhoods are compared at short prefixes, where few pairs are
missed, and crowded ones at long prefixes. Trees are added until the measured recall meets the target: each link was met
in some of the trees, and from these counts, by similarity, follows how many links no tree has met.

Neighbours are compared without loss by a 64-bit sketch with one bit per item: the symmetric difference of a pair at or
above the threshold has at most (1-t)/(1+t) (|A|+|B|) items, and every differing bit needs one of them. The rest is
verified on the sets themselves. A neighbourhood above ``BLOCK`` classes isn't held by one task: its rows are numbered
in chunks, and each pair of chunks is compared by a task of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.session import cut, discard, small_or_not

#: Classes up to which a run is compared as a whole above the deepest level, and the levels above it that are tried.
SPARSE, LOOSE_LEVELS = 32, 2
#: Chance that a pair at the threshold is met by the planned trees at the deepest level.
MET = 0.9999
#: Share of the links that must be found, and copies of a set that meet its other copies in one place.
RECALL, COPIES = 0.99999, 4096
#: Trees that are added at once while the recall is below its target.
MORE_TREES = 4
#: Classes of a neighbourhood that one task compares; larger ones are compared chunk by chunk.
BLOCK = 16_384
#: Pairs that a task compares at once.
PAIRS_AT_ONCE = 1 << 21

SIGNATURES = "tree smallint, prefix bigint, rep bigint, size int, sketch bigint"
SCANNED = "a bigint, b bigint, tree smallint, prefix bigint, chunk int, size int, sketch bigint"


def depth_for(threshold: Fraction, trees: int, recall: float) -> int:
    """The deepest level at which ``trees`` trees still find a pair at the threshold with the target recall."""
    depth = 1
    while depth < 16 and 1 - (1 - float(threshold) ** (depth + 1)) ** trees >= recall:
        depth += 1
    return depth


def missed_share(counts: list[tuple[int, int]], trees: int) -> float:
    """The share of links that none of ``trees`` has met, from (links, meetings) of each class of similarity.

    A link of a class is met by a tree with a chance that the class's met links show: the mean of their counts, each at
    least one, is trees * q / (1 - (1 - q) ** trees).
    """
    found = missed = 0.0
    for links, meetings in counts:
        mean = meetings / links / trees
        q = mean
        for _ in range(60):
            q = mean * (1 - (1 - q) ** trees)
        unmet = (1 - q) ** trees
        found += links
        missed += links * unmet / max(1 - unmet, 1e-12)
    return missed / (found + missed) if found else 0.0


def _signatures(first: int, trees: int, depth: int, seed: int):
    """Rows of the trees from number ``first`` for batches of (rep, hashed items)."""
    rng = [np.random.default_rng((seed, first + k)) for k in range(trees)]
    a = np.stack([r.integers(0, 2**63, depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for r in rng])
    b = np.stack([r.integers(0, 2**63, depth, dtype=np.uint64) for r in rng])
    width = 64 // depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            item = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            start = np.concatenate([[0], np.cumsum(size)[:-1]])
            sketch = np.bitwise_or.reduceat(np.uint64(1) << (item >> np.uint64(58)), start)
            columns = [batch.column(0), pa.array(size.astype(np.int32)), pa.array(sketch.view(np.int64))]
            for tree in range(trees):
                prefix = np.zeros(len(size), np.uint64)
                for level in range(depth):
                    least = np.minimum.reduceat(item * a[tree, level] + b[tree, level], start)
                    least = (least ^ (least >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    prefix = (prefix << np.uint64(width)) | (least >> np.uint64(64 - width))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(size), first + tree, np.int16)), pa.array(prefix.view(np.int64)), *columns],
                    ["tree", "prefix", "rep", "size", "sketch"],
                )

    return run


class _Near:
    """Whether two classes may reach the threshold, by sizes and sketches."""

    def __init__(self, threshold: Fraction) -> None:
        self.num, self.den = threshold.numerator, threshold.denominator

    def __call__(self, size_a, size_b, sketch_a, sketch_b):  # noqa: ANN001, ANN204
        close = np.bitwise_count(sketch_a ^ sketch_b).astype(np.int64) * (self.den + self.num) <= (self.den - self.num) * (size_a + size_b)
        return close & (np.minimum(size_a, size_b) * self.den >= np.maximum(size_a, size_b) * self.num)


def _within(start: np.ndarray, n: np.ndarray, size: np.ndarray, sketch: np.ndarray, near: _Near) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the near pairs inside each run."""
    left, right = [], []
    small = n <= 64
    first, count = start[small], n[small]
    pairs = np.cumsum(count * (count - 1) // 2)
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + PAIRS_AT_ONCE)))
        rows = np.repeat(first[at:to] - np.concatenate([[0], np.cumsum(count[at:to])[:-1]]), count[at:to]) + np.arange(count[at:to].sum())
        rest = np.repeat(first[at:to] + count[at:to], count[at:to]) - rows - 1
        i = np.repeat(rows, rest)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(rest) - rest, rest)
        good = near(size[i], size[j], sketch[i], sketch[j])
        left.append(i[good])
        right.append(j[good])
        at = to
    for s, m in zip(start[~small].tolist(), n[~small].tolist()):
        step = max(1, PAIRS_AT_ONCE // m)
        for r in range(s, s + m, step):
            rows = np.arange(r, min(r + step, s + m))
            others = np.arange(r + 1, s + m)
            good = near(size[rows][:, None], size[others][None, :], sketch[rows][:, None], sketch[others][None, :])
            x, y = np.nonzero(good & (others[None, :] > rows[:, None]))
            left.append(rows[x])
            right.append(others[y])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _emit(rep: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch | None:
    if not len(i):
        return None
    pair = np.unique(np.stack([np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])]), axis=1)
    void = [pa.nulls(pair.shape[1], t) for t in (pa.int16(), pa.int64(), pa.int32(), pa.int32(), pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), *void], ["a", "b", "tree", "prefix", "chunk", "size", "sketch"])


def _scan(near: _Near, depth: int, loose: int, block: int):
    """Near pairs of sorted rows, and the rows of runs above ``block`` at the deepest level with their chunk."""
    width = 64 // depth
    unused = 64 - width * depth  # bits above the first level

    def level(prefix: np.ndarray, k: int) -> np.ndarray:
        return prefix.view(np.uint64) >> np.uint64(64 - unused - width * k) if k else np.zeros(len(prefix), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the last run, which the next batch may continue
        crowded = False  # whether it is part of a run of the first level that is too long to be held
        chunks = 0  # of the last run of the deepest level, if it is above the block

        def cuts(rows: list[np.ndarray], k: int) -> np.ndarray:
            prefix = level(rows[1], k)
            return np.flatnonzero((prefix[1:] != prefix[:-1]) | (rows[0][1:] != rows[0][:-1])) + 1

        def deferred(rows: list[np.ndarray], chunk: int) -> pa.RecordBatch:
            tree, prefix, rep, size, sketch = rows
            return pa.RecordBatch.from_arrays(
                [pa.array(rep), pa.nulls(len(rep), pa.int64()), pa.array(tree), pa.array(prefix), pa.array(np.full(len(rep), chunk, np.int32)), pa.array(size.astype(np.int32)), pa.array(sketch.view(np.int64))],
                ["a", "b", "tree", "prefix", "chunk", "size", "sketch"],
            )

        def close(rows: list[np.ndarray], from_level: int) -> Iterator[pa.RecordBatch]:
            """Compares whole runs of ``from_level``: each at the first level at which it is sparse, or at the deepest."""
            tree, prefix, rep, size, sketch = rows
            count = len(prefix)
            if not count:
                return
            begins = np.zeros(count, bool)
            open_ = np.ones(count, bool)
            for k in range(from_level, depth + 1):
                edges = np.concatenate([[0], cuts(rows, k)])
                n = np.diff(np.append(edges, count))
                small = (n <= SPARSE) | (k == depth)
                taken = np.repeat(small, n) & open_
                starts = np.zeros(count, bool)
                starts[edges[small]] = True
                begins |= starts & open_
                open_ &= ~taken
                if not open_.any():
                    break
            new = np.flatnonzero(begins)
            n = np.diff(np.append(new, count))
            several = n > 1
            if (out := _emit(rep, *_within(new[several], n[several], size, sketch, near))) is not None:
                yield out

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rows[3], rows[4] = rows[3].astype(np.int64), rows[4].view(np.uint64)
            if held is not None:
                rows = [np.concatenate([x, y]) for x, y in zip(held, rows)]
            if crowded:
                changes, ends = cuts(rows, depth), cuts(rows, loose)
                to = int(ends[0]) if len(ends) else len(rows[0])  # of the crowded run
                inner = changes[changes < to]
                if chunks and (len(inner) or len(ends)):  # the run that is deferred ends here
                    stop = int(inner[0]) if len(inner) else to
                    for k in range(0, stop, block):
                        yield deferred([x[k : min(k + block, stop)] for x in rows], chunks)
                        chunks += 1
                    rows, chunks = [x[stop:] for x in rows], 0
                    to, inner = to - stop, inner[1:] - stop
                if len(ends):
                    yield from close([x[:to] for x in rows], depth)
                    rows, crowded = [x[to:] for x in rows], False
                else:
                    last = int(inner[-1]) if len(inner) else 0
                    yield from close([x[:last] for x in rows], depth)
                    rows = [x[last:] for x in rows]
            if not crowded:
                changes = cuts(rows, loose)
                last = int(changes[-1]) if len(changes) else 0
                yield from close([x[:last] for x in rows], loose)
                rows = [x[last:] for x in rows]
                if len(rows[0]) > block:
                    crowded = True
                    changes = cuts(rows, depth)
                    last = int(changes[-1]) if len(changes) else 0
                    yield from close([x[:last] for x in rows], depth)
                    rows = [x[last:] for x in rows]
            held = rows
            while len(held[0]) > block:
                yield deferred([x[:block] for x in held], chunks)
                held = [x[block:] for x in held]
                chunks += 1
        if held is not None:
            if chunks:
                yield deferred(held, chunks)
            else:
                yield from close(held, depth if crowded else loose)

    return run


def _blocks(near: _Near):
    """Near pairs of two chunks of one run, whose rows come together, marked ``side`` 0 and 1 (both: 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        held: list = []

        def compare(group: pd.DataFrame) -> Iterator[pa.RecordBatch]:
            one, two = group[group.side != 1], group[group.side != 0]
            same = bool((group.side == 2).any())
            rep = np.concatenate([one.rep.to_numpy(), two.rep.to_numpy()])
            size_a, size_b = one["size"].to_numpy(np.int64), two["size"].to_numpy(np.int64)
            sketch_a, sketch_b = one.sketch.to_numpy().view(np.uint64), two.sketch.to_numpy().view(np.uint64)
            step = max(1, PAIRS_AT_ONCE // max(1, len(two)))
            for r in range(0, len(one), step):
                good = near(size_a[r : r + step, None], size_b[None, :], sketch_a[r : r + step, None], sketch_b[None, :])
                x, y = np.nonzero(good)
                x = x + r
                if same:
                    x, y = x[x < y], y[x < y]
                if (out := _emit(rep, x, y + len(one))) is not None:
                    yield out

        keys = ["tree", "prefix", "i", "j"]
        for batch in batches:
            frame = batch.to_pandas()
            for _, part in frame.groupby(keys, sort=False):
                if held and tuple(held[0][keys].iloc[0]) != tuple(part[keys].iloc[0]):
                    yield from compare(pd.concat(held))
                    held = []
                held.append(part)
        if held:
            yield from compare(pd.concat(held))

    return run


def met_pairs(hashed: DataFrame, threshold: Fraction, first: int, trees: int, depth: int, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """``a, b, met``: the pairs of classes that trees ``first``, ``first`` + 1, ... make neighbours and that the sketches don't exclude, and by how many."""
    near = _Near(threshold)
    loose = max(1, depth - LOOSE_LEVELS)
    rows = hashed.mapInArrow(_signatures(first, trees, depth, seed), SIGNATURES)
    # A task gets whole runs of the first level that is compared.
    begin = F.shiftrightunsigned("prefix", 64 // depth * (depth - loose))
    ordered = rows.repartition("tree", begin).sortWithinPartitions("tree", F.col("prefix").bitwiseXOR(F.lit(-(2**63))))
    scanned = cut(ordered.mapInArrow(_scan(near, depth, loose, block), SCANNED))
    pairs = scanned.where("b IS NOT NULL").select("a", "b")
    large = scanned.where("b IS NULL").select("tree", "prefix", "chunk", F.col("a").alias("rep"), "size", "sketch")
    if not large.isEmpty():
        chunks = large.groupBy("tree", "prefix").agg((F.max("chunk") + 1).alias("chunks"))
        own = large.join(chunks, ["tree", "prefix"])
        other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
        spread = own.withColumn("_o", other).select(
            "tree", "prefix", F.least("chunk", "_o").alias("i"), F.greatest("chunk", "_o").alias("j"), "rep", "size", "sketch",
            F.when(F.col("chunk") == F.col("_o"), 2).when(F.col("chunk") < F.col("_o"), 0).otherwise(1).alias("side"),
        )
        blocks = spread.repartition("tree", "prefix", "i", "j").sortWithinPartitions("tree", "prefix", "i", "j")
        pairs = pairs.unionByName(blocks.mapInArrow(_blocks(near), SCANNED).select("a", "b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).cast("int").alias("met"))


def _verified(pairs: DataFrame, classes: DataFrame, threshold: Fraction) -> DataFrame:
    """``a, b, met, likeness``: similarity in hundredths, rounded down; -1 below the threshold."""
    num, den = threshold.numerator, threshold.denominator
    needed = cut(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct())
    used = cut(classes.join(small_or_not(needed), "rep").select("rep", "items"))
    both = pairs.join(used.select(F.col("rep").alias("a"), F.col("items").alias("_ia")), "a").join(used.select(F.col("rep").alias("b"), F.col("items").alias("_ib")), "b")
    both = both.withColumn("_n", F.size(F.array_intersect("_ia", "_ib"))).withColumn("_u", F.size("_ia") + F.size("_ib"))
    alike = F.col("_n") * (den + num) >= F.col("_u") * num
    checked = cut(both.select("a", "b", "met", F.when(alike, F.floor(F.col("_n") * 100 / (F.col("_u") - F.col("_n")))).otherwise(-1).cast("int").alias("likeness")))
    discard(needed)
    discard(used)
    return checked


def class_links(classes: DataFrame, threshold: Fraction, trees: int, recall: float, block: int = BLOCK) -> tuple[DataFrame, list[tuple[int, float]]]:
    """``a, b``: the linked classes of ``classes`` (``rep, items``), and after each round the trees so far and the measured recall.

    The deepest level is the one at which ``trees`` trees would meet a pair at the threshold with the chance ``MET``; it
    begins with three fifths of them and goes on until the measured share of missed links is at most 1 - ``recall``.
    """
    depth = depth_for(threshold, trees, MET)
    hashed = classes.select(F.col("rep").cast("bigint").alias("rep"), F.transform("items", lambda x: F.xxhash64(x)).alias("items"))
    planned, so_far, known, rounds = -(-trees * 3 // 5), 0, None, []
    while True:
        met = met_pairs(hashed, threshold, so_far, planned, depth, block)
        so_far += planned
        if known is None:
            known = _verified(cut(met), classes, threshold)
        else:
            # Pairs that were checked before only add to their counts.
            both = cut(met.withColumnRenamed("met", "_more").join(known, ["a", "b"], "full"))
            new = _verified(both.where("likeness IS NULL").select("a", "b", F.col("_more").alias("met")), classes, threshold)
            old = both.where("likeness IS NOT NULL").select("a", "b", (F.col("met") + F.coalesce("_more", F.lit(0))).cast("int").alias("met"), "likeness")
            before, known = known, cut(old.unionByName(new))
            for table in (before, both, new):
                discard(table)
        counts = known.where("likeness >= 0").groupBy("likeness").agg(F.count(F.lit(1)).alias("n"), F.sum("met").alias("m")).collect()  # at most 101 rows
        missed = missed_share([(r.n, r.m) for r in counts], so_far)
        rounds.append((so_far, 1 - missed))
        if missed <= 1 - recall:
            return known.where("likeness >= 0").select("a", "b"), rounds
        planned = MORE_TREES


def similar_pairs(
    sets: DataFrame, key: str, items: str, threshold: Fraction, trees: int = 20, recall: float = RECALL, block: int = BLOCK, copies: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Pairs ``key_a, key_b`` (key_a < key_b) with |∩|/|∪| >= ``threshold``, and ``key, rep``: the class of each key.

    ``key`` is a distinct integer, ``items`` an array column that is made a sorted set here; null and empty sets, null
    items and null keys take no part; a key that comes repeatedly with one set counts once; an empty table gives no
    rows; other columns are ignored. The similarity is exact; trees are added until the measured share of missed links
    is at most 1 - ``recall``. With ``copies`` every pair of keys is returned, else pairs between the classes' smallest
    keys, which together with the classes lose no link (copies of a set may be most of a table).
    """
    clean = F.array_sort(F.array_distinct(F.filter(items, lambda x: x.isNotNull())))
    own = sets.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), clean.alias("items")).where(F.size("items") > 0)
    classes = cut(own.groupBy("items").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("n")))
    links, _ = class_links(classes, threshold, trees, recall, block)
    several = classes.where("n > 1").select("items", "rep", F.ceil(F.col("n") / COPIES).cast("int").alias("parts"))
    members = own.join(small_or_not(several), "items").select("rep", "key", "parts").distinct()
    single = classes.where("n = 1").select("rep", F.col("rep").alias("key"))
    if not copies:
        return links.select(F.col("a").alias("key_a"), F.col("b").alias("key_b")), single.unionByName(members.select("rep", "key"))
    members = cut(members)
    groups = single.unionByName(members.select("rep", "key"))
    left = links.join(members.select(F.col("rep").alias("a"), F.col("key").alias("_ka")), "a", "left")
    full = left.join(members.select(F.col("rep").alias("b"), F.col("key").alias("_kb")), "b", "left")
    x, y = F.coalesce("_ka", "a"), F.coalesce("_kb", "b")
    between = full.select(F.least(x, y).alias("key_a"), F.greatest(x, y).alias("key_b"))
    # The copies of one set are dealt into parts; a part meets each part in a place of its own.
    one = members.select("rep", F.col("key").alias("key_a"), F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("p"))
    two = members.select("rep", F.col("key").alias("key_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"))
    inside = one.join(two, ["rep", "p"]).where("key_a < key_b")
    return between.unionByName(inside.select("key_a", "key_b")), groups
