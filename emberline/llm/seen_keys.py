"""Has this key been seen before? Blocked Bloom filters over hash-partitioned keys, query then insert.

The key space is split by a hash into shards; each has one blocked Bloom filter, in which a key sets its bits in a
single 512-bit block (one cache line). A shard takes its keys in order of arrival, asks the filter, then inserts. The
bits are sized from the counted keys for a target rate of false positives; there are no false negatives.

Rows of a key that repeats inside one scan batch are settled there (the earliest goes on, the others are repeats), so a
key that holds a third of all rows reaches its shard as one row per batch. An exact check may follow: only the rows
that the filter took for repeats are compared with the keys' first arrivals.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.session import cut

BLOCK_BITS = 512
#: Keys of a shard: its filter stays in a core's cache, and there are shards for every core.
KEYS_A_SHARD = 50_000
#: Known absent keys that each shard asks its filter for when errors are measured.
PROBES = 20_000


def block_sizes(keys: int, target: float) -> tuple[int, int]:
    """Blocks and bits set per key, for which a blocked filter of ``keys`` keys keeps to the ``target`` rate.

    The load of a block is Poisson distributed; the rate is averaged over it and the number of blocks raised until it
    meets the target.
    """
    bits = max(2, min(16, round(-math.log2(target))))
    per_key = -math.log(target) / math.log(2) ** 2
    while True:
        mean = BLOCK_BITS / per_key
        rate = 0.0
        p = math.exp(-mean)
        for load in range(int(mean + 12 * math.sqrt(mean) + 20)):
            rate += p * (1 - (1 - 1 / BLOCK_BITS) ** (bits * load)) ** bits
            p *= mean / (load + 1)
        if rate <= target:
            return max(1, math.ceil(keys * per_key / BLOCK_BITS)), bits
        per_key *= 1.1


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser with a seed, over whole arrays."""
    h = keys.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class BlockedBloom:
    """One shard's filter: ``blocks`` blocks of eight 64-bit words."""

    def __init__(self, blocks: int, bits: int) -> None:
        self.blocks, self.bits, self.words = blocks, bits, np.zeros(blocks * 8, np.uint64)

    def _where(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word and mask of every bit of every key, as arrays of (bits, keys)."""
        block = (_mix(keys, 1) >> np.uint64(1)) % np.uint64(self.blocks)
        hashes = [_mix(keys, 2 + k) for k in range(-(-self.bits // 7))]  # nine bits of a hash name a bit of the block
        bit = np.stack([(hashes[i // 7] >> np.uint64(9 * (i % 7))) & np.uint64(BLOCK_BITS - 1) for i in range(self.bits)])
        return block * np.uint64(8) + (bit >> np.uint64(6)), np.uint64(1) << (bit & np.uint64(63))

    def query(self, keys: np.ndarray) -> np.ndarray:
        word, mask = self._where(keys)
        return ((self.words[word] & mask) == mask).all(axis=0)

    def insert(self, keys: np.ndarray) -> None:
        word, mask = self._where(keys)
        np.bitwise_or.at(self.words, word.ravel(), mask.ravel())


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks the rows whose key came earlier in the same batch. Columns: era, the order columns, key."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        order = np.lexsort([*columns[-2::-1], columns[-1]])
        key = columns[-1][order]
        later = np.concatenate([[False], key[1:] == key[:-1]])
        repeat = np.empty(len(order), bool)
        repeat[order] = later
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(repeat)], [*batch.schema.names, "repeat"])


def _shard(names: list[str], blocks: int, bits: int, with_errors: bool, absent: tuple[int, int]):
    """Asks and fills the filters of sorted shards, one at a time; gives the flagged rows, or each filter's errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, bloom, filled, done = None, None, 0, []

        def close() -> None:
            if number is not None and with_errors:
                probes = np.random.default_rng(number).integers(*absent, PROBES, dtype=np.int64)
                done.append((number, filled, bloom.blocks * BLOCK_BITS, PROBES, int(bloom.query(probes).sum())))

        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column("_shard").to_numpy(zero_copy_only=False)
            key = batch.column("_key").to_numpy(zero_copy_only=False).astype(np.int64)
            known = batch.column("repeat").to_numpy(zero_copy_only=False).astype(bool)
            seen = known.copy()
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for i, j in zip(cuts, cuts[1:]):
                if shard[i] != number:
                    close()
                    number, bloom, filled = int(shard[i]), BlockedBloom(blocks, bits), 0
                at = i + np.flatnonzero(~known[i:j])
                own, first = np.unique(key[at], return_index=True)
                again = np.ones(len(at), bool)
                again[first] = bloom.query(own)
                seen[at] = again
                bloom.insert(own[~again[first]])
                filled += int((~again).sum())
            if not with_errors:
                keep = seen & (batch.column("_era").to_numpy(zero_copy_only=False) > 0)
                yield pa.RecordBatch.from_arrays([batch.column(n).filter(pa.array(keep)) for n in names], names)
        close()
        if with_errors:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.int64()) for k in range(5)], ["shard", "keys", "bits", "absent", "false_positives"])

    return run


def _sharded(rows: DataFrame, key: str, order: list[str], earlier: DataFrame | None, target: float, per_shard: int):
    new = rows.where(F.col(key).isNotNull()).select(F.lit(1).alias("_era"), *[F.col(c).cast("bigint").alias(c) for c in order], F.col(key).cast("bigint").alias("_key"))
    every = new
    if earlier is not None:
        old = earlier.where(F.col(key).isNotNull()).select(F.lit(0).alias("_era"), *[F.lit(0).cast("bigint").alias(c) for c in order], F.col(key).cast("bigint").alias("_key"))
        every = old.unionByName(new)
    n, smallest = every.agg(F.count(F.lit(1)), F.min("_key")).first()
    shards = max(1, math.ceil(n / per_shard))
    # The shards' loads are binomial: four deviations of room keep the fullest within its target.
    blocks, bits = block_sizes(math.ceil(n / shards + 4 * math.sqrt(n / shards)), target)
    settled = every.mapInArrow(_settle, T.StructType([*every.schema.fields, T.StructField("repeat", T.BooleanType())]))
    # Repeats settled in their batch ask no filter; a random-like place spreads a hot key's rows.
    place = F.when(F.col("repeat"), F.pmod(F.xxhash64(*order), F.lit(shards))).otherwise(F.pmod(F.xxhash64("_key"), F.lit(shards)))
    routed = settled.withColumn("_shard", place.cast("int")).repartition("_shard").sortWithinPartitions("_shard", "_era", *order)
    return routed, blocks, bits, smallest


def seen_before(
    rows: DataFrame, key: str, order: list[str], earlier: DataFrame | None = None, target: float = 1e-4, exact: bool = True, per_shard: int = KEYS_A_SHARD
) -> DataFrame:
    """``order`` columns and ``key`` of the rows whose key was in ``earlier`` or in an earlier row by ``order``.

    ``key`` and ``order`` are integer columns; ``earlier`` (or None) has the column ``key``. Null keys are neither asked
    nor kept; of several rows that agree in ``order`` and key, all but one count as repeats; an empty table gives no
    rows; other columns aren't read. With ``exact`` the rows that the filter flagged are checked, and the answer is
    exact; without it about ``target`` of the new keys are flagged wrongly, and no repeat is missed.
    """
    routed, blocks, bits, _ = _sharded(rows, key, order, earlier, target, per_shard)
    names = [*order, "_key"]
    flagged = routed.mapInArrow(_shard([*names, "repeat"], blocks, bits, False, (0, 1)), ", ".join([f"{c} bigint" for c in names] + ["repeat boolean"]))
    flagged = flagged.withColumnRenamed("_key", key)
    if not exact:
        return flagged.select(*order, key)
    # A first arrival that the filter flagged, although no earlier table has the key, is a false positive. Of rows that
    # agree in order and key one is new, so not all of them can be repeats.
    place = [F.col(c).cast("bigint").alias(c) for c in order]
    counted = cut(flagged.groupBy(key, *order).agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(~F.col("repeat"), 1)).alias("_asked")))
    asked = counted.where("_asked > 0")
    keys = asked.select(key).distinct()
    arrivals = rows.select(key, *order).join(keys, key, "left_semi").groupBy(key, *place).agg(F.count(F.lit(1)).alias("_all"))
    first = arrivals.groupBy(key).agg(F.min(F.struct(*order, "_all")).alias("_first"))
    if earlier is not None:
        old = earlier.select(key).join(keys, key, "left_semi").distinct().withColumn("_old", F.lit(True))
        first = first.join(old, key, "left")
    else:
        first = first.withColumn("_old", F.lit(None).cast("boolean"))
    new = (F.struct(*order) == F.struct(*[F.col(f"_first.{c}").alias(c) for c in order])) & F.col("_old").isNull()
    checked = asked.join(first, key).withColumn("_n", F.when(new, F.least(F.col("_n"), F.col("_first._all") - 1)).otherwise(F.col("_n")))
    result = counted.where("_asked = 0").select(*order, key, "_n").unionByName(checked.select(*order, key, "_n"))
    return result.withColumn("_k", F.explode(F.array_repeat(F.lit(0), F.col("_n").cast("int")))).select(*order, key)


def seen_errors(rows: DataFrame, key: str, order: list[str], earlier: DataFrame | None = None, target: float = 1e-4, per_shard: int = KEYS_A_SHARD) -> DataFrame:
    """Per shard the ``keys`` inserted, its ``bits``, the ``absent`` keys asked for, and how many were ``false_positives``.

    Keys that the filter took for seen are not inserted again.

    The absent keys are drawn from below the smallest key that occurs, so that none of them was ever inserted. An empty
    table gives no rows.
    """
    routed, blocks, bits, smallest = _sharded(rows, key, order, earlier, target, per_shard)
    low = -(2**63)
    absent = (low, smallest if smallest is not None and smallest > low + PROBES else low + 1)
    return routed.mapInArrow(_shard([], blocks, bits, True, absent), "shard bigint, keys bigint, bits bigint, absent bigint, false_positives bigint")
