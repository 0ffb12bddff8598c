"""Filling fixed-capacity containers: bounded-space online best fit.

A fixed number of bins is open. Open bins are filed by their free space, and a bitset (an integer) has the free spaces
that occur, so the bin with the least space that still takes an item is one bit operation away. If none takes it, a new
bin opens; before that, if all are open, the fullest closes. An item above the capacity is cut into whole containers
and a rest.

Items go to shards by the hash of their key, and each shard is packed on its own, so the result doesn't depend on the
cluster. A shard has so many tokens that the bins still open at its end are a small share of its containers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins open at once, and containers a shard should fill.
OPEN, CONTAINERS_A_SHARD = 256, 20_000
PLACED = "pack_id int, capacity int, shard int, key bigint, piece int, tokens int, bin int"


class BestFit:
    """Open bins of one capacity; ``place`` gives the number of the bin that takes an item of at most the capacity."""

    def __init__(self, capacity: int, open_bins: int = OPEN) -> None:
        self.capacity, self.most = capacity, open_bins
        self.free = 0  # bit s is set if an open bin has s tokens of space
        self.by_free: dict[int, list[int]] = {}
        self.open = self.made = 0

    def _file(self, number: int, space: int) -> None:
        self.by_free.setdefault(space, []).append(number)
        self.free |= 1 << space

    def _take(self, space: int) -> int:
        bins = self.by_free[space]
        number = bins.pop()
        if not bins:
            del self.by_free[space]
            self.free &= ~(1 << space)
        return number

    def place(self, size: int) -> int:
        fitting = self.free >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            if self.open >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
                self.open -= 1
            number, space = self.made, self.capacity
            self.made += 1
            self.open += 1
        self._file(number, space - size)
        return number


def _pack(open_bins: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, packer = None, None
        for frame in frames:
            rows = []
            for pack, capacity, shard, key, piece, tokens in zip(frame.pack_id, frame.capacity, frame.shard, frame.key, frame.piece, frame.tokens):
                if (pack, shard) != at:
                    at, packer = (pack, shard), BestFit(capacity, open_bins)
                rows.append((pack, capacity, shard, key, piece, tokens, packer.place(tokens)))
            yield pd.DataFrame(rows, columns=["pack_id", "capacity", "shard", "key", "piece", "tokens", "bin"])

    return run


def fill_containers(items: DataFrame, key: str, size: str, capacities: DataFrame, open_bins: int = OPEN, containers_a_shard: int = CONTAINERS_A_SHARD) -> DataFrame:
    """``pack_id, capacity, key, piece, tokens, container``: the container of every item, for every capacity.

    ``capacities`` (``pack_id int, capacity int``) is a table of a few parameters; ``key`` is a distinct integer. An
    item above the capacity gives pieces 0, 1, ... of the capacity and a rest; every other one piece 0. Items of size 0
    are placed too and take no space; a null size counts as 0, a negative one too; rows with a null key, and capacities
    that are null or below 1, are left out; an empty table gives no rows. ``container`` is a text that is unique in its
    ``pack_id``. Repeated keys are repeated items.
    """
    caps = [(int(p), int(c)) for p, c in capacities.where("pack_id IS NOT NULL AND capacity >= 1").select("pack_id", "capacity").distinct().collect()]
    own = items.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("int").alias("_n"))
    total = own.agg(F.sum("_n")).first()[0] or 0
    shards = [F.struct(F.lit(p).alias("pack_id"), F.lit(c).alias("capacity"), F.lit(max(1, math.ceil(total / (c * containers_a_shard)))).alias("shards")) for p, c in caps]
    each = own.withColumn("_c", F.explode(F.array(*shards).cast("array<struct<pack_id:int,capacity:int,shards:int>>"))).select("key", "_n", "_c.*")
    pieces = each.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_n") / F.col("capacity")), F.lit(1)).cast("int") - 1)))
    pieces = pieces.withColumn("tokens", F.least(F.col("capacity"), F.col("_n") - F.col("piece") * F.col("capacity")))
    pieces = pieces.withColumn("_order", F.xxhash64("key", "piece")).withColumn("shard", F.pmod("_order", F.col("shards")).cast("int"))
    ordered = pieces.repartition("pack_id", "shard").sortWithinPartitions("pack_id", "shard", "_order", "key", "piece")
    placed = ordered.select("pack_id", "capacity", "shard", "key", "piece", "tokens").mapInPandas(_pack(open_bins), PLACED)
    return placed.select("pack_id", "capacity", "key", "piece", "tokens", F.concat_ws("-", "shard", "bin").alias("container"))
