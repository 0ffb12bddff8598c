"""Frequency of every distinct term or n-gram: suffix-sorted n-gram counting.

Every position of a record gives the suffix that begins there, truncated to ``max_n`` terms. Suffixes are counted per
batch, routed by their first term, sorted in reverse lexicographic order, and one pass with a stack gives the counts of
all their prefixes: a prefix ends where the next suffix no longer shares it, and its counts are then added to the
prefix that is one term shorter.

Record sets aren't stored. Within a record the prefixes of a suffix are new from some length on (if "a b" is new, so is
"a b c"); that length, ``fresh``, goes with the suffix, and the records of a prefix of k terms are its suffixes with
``fresh <= k``. So both counts are sums, which combine before the shuffle and may be split over several tasks: a first
term that holds a third of all rows is salted by the hash of its suffix, and the partial counts are added at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUFFIX = "suffix array<string>, fresh int, n bigint"
NGRAM = "ngram array<string>, occurrences bigint, records bigint"


def _suffixes(max_n: int):
    """Counts of (suffix, fresh) in each batch of term lists, over whole arrays of term codes."""

    def counted(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        words = lists.flatten().dictionary_encode()
        code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        size, kinds = len(code), len(words.dictionary)
        suffix = np.full((max_n, size), kinds, np.int64)  # the term k places on, or none
        for k in range(min(max_n, size)):
            same = row[k:] == row[: size - k]
            suffix[k, : size - k][same] = code[k:][same]
        # A prefix of k terms gets a number; it was seen before if its record has that number earlier.
        number, seen = np.zeros(size, np.int64), np.zeros(size, np.int64)
        length = (suffix < kinds).sum(axis=0)
        for k in range(max_n):
            number = np.unique(number * (kinds + 1) + suffix[k], return_inverse=True)[1]
            first = np.unique(row * size + number, return_index=True)[1]
            again = np.ones(size, bool)
            again[first] = False
            seen += again & (length > k)
        fresh = np.where(seen == length, max_n + 1, seen + 1)
        _, at, n = np.unique(number * (max_n + 2) + fresh, return_index=True, return_counts=True)
        own = suffix[:, at].T
        lists_ = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(length[at])]).astype(np.int32), words.dictionary.take(pa.array(own[own < kinds])))
        return lists_, fresh[at], n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            lists = pa.ListArray.from_arrays(_compact_offsets(column), column.flatten())
            suffixes, fresh, n = counted(lists)
            yield pa.RecordBatch.from_arrays([suffixes, pa.array(fresh.astype(np.int32)), pa.array(n.astype(np.int64))], ["suffix", "fresh", "n"])

    return run


def _compact_offsets(column: pa.ListArray) -> pa.Array:
    """Offsets from 0 into ``column.flatten()``, which leaves null lists and sliced-off values out."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))


def _stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of all prefixes of suffixes that come in reverse lexicographic order."""
    stack: list[list] = []  # of the current suffix's prefixes: term, occurrences, records
    done: list[tuple[list[str], int, int]] = []

    def pop() -> None:
        term, occurrences, records = stack.pop()
        done.append(([x[0] for x in stack] + [term], occurrences, sum(records.values())))
        if stack:
            above = stack[-1]
            above[1] += occurrences
            length = len(stack)
            for fresh, n in records.items():
                if fresh <= length:
                    above[2][fresh] = above[2].get(fresh, 0) + n

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in done], pa.list_(pa.string())),
                pa.array([x[1] for x in done], pa.int64()),
                pa.array([x[2] for x in done], pa.int64()),
            ],
            ["ngram", "occurrences", "records"],
        )
        done.clear()
        return batch

    for batch in batches:
        for suffix, fresh, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            shared = 0
            while shared < len(stack) and shared < len(suffix) and stack[shared][0] == suffix[shared]:
                shared += 1
            while len(stack) > shared:
                pop()
            for term in suffix[shared:]:
                stack.append([term, 0, {}])
            top = stack[-1]
            top[1] += n
            if fresh <= len(stack):
                top[2][fresh] = top[2].get(fresh, 0) + n
        if len(done) >= 20_000:
            yield flush()
    while stack:
        pop()
    yield flush()


def ngram_counts(records: DataFrame, terms: str, max_n: int = 1, salts: int = 1) -> DataFrame:
    """``ngram array<string>, occurrences bigint, records bigint`` of every n-gram of 1 to ``max_n`` terms.

    ``terms`` is an array column, one row a record. Null arrays, empty arrays and an empty table give no rows; null
    terms take no part in any n-gram (the terms around one become neighbours); repeated rows count each time. Other
    columns are neither read nor moved. ``salts`` is the number of tasks that share one first term.
    """
    if max_n < 1:
        raise ValueError("max_n must be at least 1")
    lists = records.select(F.filter(F.col(terms), lambda t: t.isNotNull()).alias("terms")).where(F.size("terms") > 0)
    suffixes = lists.mapInArrow(_suffixes(max_n), SUFFIX).groupBy("suffix", "fresh").agg(F.sum("n").alias("n"))
    salt = F.pmod(F.hash("suffix"), F.lit(salts))
    routed = suffixes.repartition(F.col("suffix")[0], salt).sortWithinPartitions(F.col("suffix").desc())
    grams = routed.mapInArrow(_stack, NGRAM)
    if salts > 1:
        grams = grams.groupBy("ngram").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return grams


def mark_terms(counts: DataFrame, total: int, rare_at_most: int = 2, common_percent: int = 2) -> DataFrame:
    """``counts`` with ``mark``: ``rare``, ``common`` or null. Exact integer comparisons; rare goes before common."""
    common = F.col("records") * 100 >= F.lit(total * common_percent)
    return counts.withColumn("mark", F.when(F.col("records") <= rare_at_most, "rare").when(common, "common"))
