"""Items that appear together: external sort of packed 64-bit pair codes.

A term's number is one half of a pair's code: a 31-bit fingerprint, or, for words of the vocabulary that share one, a
number of their own above these. Each scan batch gives sorted, run-length counted runs, cut by code into buckets and sent
as blocks of bytes; the shuffle sorts the blocks by bucket, spilling as it needs, and a bucket merges its sorted runs pair
by pair, runs of like length first, adding the counts of equal codes. The number of buckets follows the number of records.
The batches' distinct words go the same way and give the table that decodes. A word that the vocabulary lacks can still
share a number; a code that passes the count and has a half of several words has its pairs counted again by their words.
So all counts are exact.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.session import cut

#: Pairs per record and per bucket from which the number of buckets follows; both only size tasks.
PAIRS_A_RECORD, PAIRS_A_BUCKET, LEAST_BUCKETS = 60, 250_000, 24
#: Words with numbers of their own that are sent with the tasks.
SENT_WORDS = 100_000
#: Ambiguous codes that are sent with the task that counts their words; beyond it they are joined.
SENT_CODES = 100_000


def fingerprint(term: str, bits: int = 31) -> int:
    return xxhash.xxh64_intdigest(term) & ((1 << bits) - 1)


def number_of(term: str, bits: int, own: dict[str, int]) -> int:
    """The term's own number, if it has one, else its fingerprint."""
    return own[term] if term in own else fingerprint(term, bits)


def own_numbers(vocabulary: DataFrame, bits: int) -> dict[str, int]:
    """Numbers of the words of ``vocabulary`` (``term``, distinct) that share a fingerprint, if they are at most ``SENT_WORDS``, else none."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([fingerprint(w, bits) for w in words], pa.int64())], ["term", "print"])

    hashed = vocabulary.select("term").where("term IS NOT NULL").mapInArrow(prints, "term string, print bigint")
    shared = hashed.groupBy("print").agg(F.collect_set("term").alias("terms"), F.count(F.lit(1)).alias("n")).where("n > 1")
    words = [w for r in shared.select("terms").limit(SENT_WORDS + 1).collect() for w in r.terms]
    return {w: (1 << 31) + k for k, w in enumerate(sorted(words))} if len(words) <= SENT_WORDS else {}


def _codes(batch: pa.RecordBatch, bits: int, own: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Row and word numbers of each pair of two different clean words, the words and their numbers in codes."""
    column = batch.column(0)
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    pairs = column.flatten()
    row = np.repeat(np.arange(len(column)), lengths)
    sides = []
    for name in ("a", "b"):
        values = pc.struct_field(pairs, name)
        sides.append(pc.if_else(pc.is_valid(pairs), values, pa.scalar(None, values.type)).cast(pa.string()).dictionary_encode())
    words: dict[str, int] = {}
    numbers = []
    for side in sides:
        known = side.indices.is_valid().to_numpy(zero_copy_only=False)
        place = [words.setdefault(w.strip(" ").lower(), len(words)) for w in side.dictionary.to_pylist()]
        code = side.indices.fill_null(0).to_numpy(zero_copy_only=False)
        numbers.append(np.where(known, np.asarray(place or [0], np.int64)[code], -1))
    empty = words.get("", -1)
    a, b = numbers
    good = (a >= 0) & (b >= 0) & (a != b) & (a != empty) & (b != empty)
    names = list(words)
    return row[good], a[good], b[good], names, np.array([number_of(w, bits, own) for w in names] or [0], np.uint64)


def _pack(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (np.minimum(x, y) << np.uint64(32)) | np.maximum(x, y)


def _count_runs(code: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of a sorted array with the number, or the sum of ``n``, of each."""
    if not len(code):
        return code, np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[start], np.diff(np.append(start, len(code))) if n is None else np.add.reduceat(n, start)


def _bucket_of(code: np.ndarray, buckets: int) -> np.ndarray:
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)


def _runs(bits: int, buckets: int, own: dict[str, int]):
    """Sorted, counted runs of each batch, one row for each bucket it has codes of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, a, b, names, numbers = _codes(batch, bits, own)
            used = np.zeros(len(names), bool)
            used[a] = used[b] = True
            vocabulary: dict[int, list[str]] = {}
            for k in np.flatnonzero(used).tolist():
                vocabulary.setdefault(-1 - int(numbers[k]) % buckets, []).append(names[k])
            # Once a record: equal pairs of a record have equal words, in either order.
            size = max(1, len(names))
            once = np.unique((row * size + np.minimum(a, b)) * size + np.maximum(a, b))
            pair, n = np.unique(once % (size * size), return_counts=True)
            code = _pack(numbers[pair // size], numbers[pair % size])
            order = np.argsort(code)
            code, n = _count_runs(code[order], n[order])
            to = _bucket_of(code, buckets)
            order = np.argsort(to, kind="stable")
            to, code, n = to[order], code[order], n[order]
            cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, int)
            ends = np.append(cuts[1:], len(to))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*to[cuts].tolist(), *vocabulary], pa.int32()),
                    pa.array([*(np.diff(code[i:j], prepend=np.uint64(0)).tobytes() for i, j in zip(cuts, ends)), *(json.dumps(w).encode() for w in vocabulary.values())], pa.binary()),
                    pa.array([*(n[i:j].astype(np.uint32).tobytes() for i, j in zip(cuts, ends)), *[b""] * len(vocabulary)], pa.binary()),
                ],
                ["bucket", "codes", "counts"],
            )

    return run


class Runs:
    """Sorted, counted runs that are merged as they come: never two of like length stay."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    @staticmethod
    def _two(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The longer run with the codes of the shorter one put in their places, or their counts added."""
        (code, n), (more, m) = (one, two) if len(one[0]) >= len(two[0]) else (two, one)
        if not len(more):
            return code, n
        at = np.searchsorted(code, more)
        same = code[np.minimum(at, len(code) - 1)] == more
        n = n.copy()
        n[at[same]] += m[same]
        return np.insert(code, at[~same], more[~same]), np.insert(n, at[~same], m[~same])

    def add(self, code: np.ndarray, n: np.ndarray) -> None:
        run = (code, n)
        while self.held and len(self.held[-1][0]) <= 2 * len(run[0]):
            run = self._two(self.held.pop(), run)
        self.held.append(run)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        run = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        while self.held:
            run = self._two(run, self.held.pop())
        return run


def _merge(least: int, bits: int, own: dict[str, int]):
    """Counts of at least ``least`` of the codes of each bucket; of a bucket below 0 its distinct words, with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, runs, words = None, Runs(), set()

        def result() -> pa.RecordBatch:
            if words:
                known = sorted(words)
                columns = [pa.array([number_of(w, bits, own) for w in known], pa.int64()), pa.nulls(len(known), pa.int64()), pa.array(known, pa.string())]
            else:
                code, n = runs.merged()
                keep = n >= least
                columns = [pa.array(code[keep].view(np.int64)), pa.array(n[keep].astype(np.int64)), pa.nulls(int(keep.sum()), pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["code", "n", "word"])

        for batch in batches:
            for at, codes, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if at != bucket and bucket is not None:
                    yield result()
                    runs, words = Runs(), set()
                bucket = at
                if at < 0:
                    words.update(json.loads(codes.as_py()))
                else:
                    runs.add(np.cumsum(np.frombuffer(codes.as_py(), np.uint64), dtype=np.uint64), np.frombuffer(counts.as_py(), np.uint32).astype(np.int64))
        if bucket is not None:
            yield result()

    return run


def _words(bits: int, own: dict[str, int], wanted: np.ndarray | None):
    """Word pairs of each batch whose code is ``wanted`` (or all), with the records that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, a, b, names, numbers = _codes(batch, bits, own)
            code = _pack(numbers[a], numbers[b])
            if wanted is not None:
                keep = np.isin(code, wanted)
                row, code, a, b = row[keep], code[keep], a[keep], b[keep]
            order = sorted(range(len(names)), key=names.__getitem__)
            rank = np.empty(len(names), np.int64)
            rank[order] = np.arange(len(names))
            low, high = np.minimum(rank[a], rank[b]), np.maximum(rank[a], rank[b])
            size = max(1, len(names))
            pair = np.unique(np.stack([row, low * size + high, code.view(np.int64)]), axis=1) if len(row) else np.zeros((3, 0), np.int64)
            key, first, n = np.unique(pair[1], return_index=True, return_counts=True)
            name = lambda r: names[order[r]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(pair[2][first].astype(np.int64)),
                    pa.array([name(x) for x in (key // size).tolist()], pa.string()),
                    pa.array([name(x) for x in (key % size).tolist()], pa.string()),
                    pa.array(n, pa.int64()),
                ],
                ["code", "term_a", "term_b", "n"],
            )

    return run


def pair_counts(records: DataFrame, pairs: str, count: int, least: int = 1, bits: int = 31, vocabulary: DataFrame | None = None) -> DataFrame:
    """``term_a, term_b, n``: the records that hold both words as one pair, in either order, for each n >= ``least``.

    ``pairs`` is a column of array<struct<a,b>>, one row a record (repeated rows count each time); ``count`` is about the
    number of records and only sizes tasks; ``vocabulary`` (``term``, distinct) has words that occur, as far as they are
    known, and only saves a second look at the records. Words are taken without outer blanks, in lower case; pairs with a null or
    empty word, of a word with itself, and repeats inside a record don't count. Null or empty arrays and an empty table
    give nothing. term_a < term_b by code points.
    """
    buckets = max(LEAST_BUCKETS, math.ceil(count * PAIRS_A_RECORD / PAIRS_A_BUCKET))
    lists = records.select(pairs).where(F.size(pairs) > 0)
    own = own_numbers(vocabulary, bits) if vocabulary is not None else {}
    runs = lists.mapInArrow(_runs(bits, buckets, own), "bucket int, codes binary, counts binary")
    merged = runs.repartition("bucket").sortWithinPartitions("bucket")
    counted = cut(merged.mapInArrow(_merge(least, bits, own), "code bigint, n bigint, word string"))
    halves = counted.where("word IS NULL").select("code", "n", F.shiftrightunsigned("code", 32).alias("_x"), F.col("code").bitwiseAND(0xFFFFFFFF).alias("_y"))
    named = counted.where("word IS NOT NULL").groupBy(F.col("code").alias("_h")).agg(F.min("word").alias("_t"), F.count(F.lit(1)).alias("_k"))
    decoded = (
        halves.join(named.select(F.col("_h").alias("_x"), F.col("_t").alias("_a"), F.col("_k").alias("_ka")), "_x", "left")
        .join(named.select(F.col("_h").alias("_y"), F.col("_t").alias("_b"), F.col("_k").alias("_kb")), "_y", "left")
    )
    decoded = cut(decoded)
    clear = (F.col("_ka") == 1) & (F.col("_kb") == 1)
    sure = decoded.where(clear).select(F.least("_a", "_b").alias("term_a"), F.greatest("_a", "_b").alias("term_b"), "n")
    unsure = decoded.where(~F.coalesce(clear, F.lit(False))).select("code")
    many = unsure.count()
    if not many:
        return sure
    if many <= SENT_CODES:
        wanted = np.array([r[0] for r in unsure.toLocalIterator()], np.int64).view(np.uint64)
        again = lists.mapInArrow(_words(bits, own, wanted), "code bigint, term_a string, term_b string, n bigint")
    else:
        again = lists.mapInArrow(_words(bits, own, None), "code bigint, term_a string, term_b string, n bigint").join(unsure, "code", "left_semi")
    again = again.groupBy("term_a", "term_b").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return sure.unionByName(again)


def with_term_counts(pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """``pairs`` with ``n_a`` and ``n_b`` from ``terms`` (``term, n``), 0 for words that it lacks."""
    for side in ("a", "b"):
        own = terms.select(F.col("term").alias(f"term_{side}"), F.col("n").alias(f"n_{side}"))
        pairs = pairs.join(own, f"term_{side}", "left").fillna(0, [f"n_{side}"])
    return pairs


def lift(n: Column, n_a: Column, n_b: Column, total: int) -> Column:
    """How many times more often than by chance; null where a word is in no record."""
    return F.when((n_a > 0) & (n_b > 0), n.cast("double") * total / (n_a.cast("double") * n_b))


def odds_ratio(n: Column, n_a: Column, n_b: Column, total: int) -> Column:
    """Odds ratio of the four-field table, with a half added to each field; fields below 0 count as 0."""
    zero = F.lit(0)
    only_a, only_b = F.greatest(n_a - n, zero), F.greatest(n_b - n, zero)
    none = F.greatest(F.lit(total) - n_a - n_b + n, zero)
    return (n + 0.5) * (none + 0.5) / ((only_a + 0.5) * (only_b + 0.5))
