"""One row per key: the first by order of arrival, without moving the wide columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.session import BROADCAST_ROWS, cut, fits_broadcast


def first_rows(df: DataFrame, key: str, order: list[str], columns: list[str], limit: int = BROADCAST_ROWS) -> tuple[DataFrame, int]:
    """The first row of each non-null ``key`` by ``order`` with ``key`` and ``columns``, and the number of keys.

    Only the keys and the order are grouped (combined before the shuffle, so one key may hold most rows). The repeated
    keys are a small share of all; they are written once and, if counted at most ``limit``, broadcast to the scan, else
    joined by a shuffle. Nulls as key are left out; of rows that agree in key and order any one is kept (they are taken
    for the same row delivered twice); an empty table gives an empty result and 0.
    """
    rows = df.select(*dict.fromkeys([key, *order, *columns])).where(F.col(key).isNotNull())
    place = F.struct(*order)
    repeats = cut(
        rows.groupBy(key, *order)
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(key)
        .agg(F.sum("_n").alias("_rows"), F.min(F.struct(*order, "_n")).alias("_first"))
        .where("_rows > 1")
    )
    total = rows.count()
    counted = repeats.agg(F.count(F.lit(1)), F.sum("_rows"), F.max("_first._n")).first()
    keys, extra, tie = counted[0], counted[1] or 0, counted[2] or 1
    if not keys:
        return rows.select(key, *columns), total
    side = repeats.select(F.col(key).alias("_key"), F.struct(*[F.col(f"_first.{c}").alias(c) for c in order]).alias("_at"), (F.col("_first._n") > 1).alias("_tie"))
    side = F.broadcast(side) if fits_broadcast(side, keys, limit) else side
    first = rows.join(side, F.col(key) == F.col("_key"), "left").where(F.col("_at").isNull() | (F.col("_at") == place))
    if tie > 1:  # only the rows delivered twice are moved
        tied = F.coalesce("_tie", F.lit(False))
        first = first.where(~tied).unionByName(first.where(tied).dropDuplicates([key]))
    return first.select(key, *columns), total - extra + keys
