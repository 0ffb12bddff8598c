"""Counts over sliding windows of files without copying rows into windows: changes where something enters or leaves, and running sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spans(places: Column, length: int) -> Column:
    """The windows that hold any of the sorted distinct places, as structs of the first window and the one after the last.

    Window w holds the ``length`` places up to w, so a place holds from itself on; it ends where the next one begins.
    """
    return F.transform(
        places,
        lambda o, i: F.struct(o.alias("begin"), F.least(o + length, F.coalesce(F.get(places, i + 1), o + length)).alias("end")),
    )


def in_windows(changes: DataFrame, keys: Sequence[str], values: Sequence[str], last: int, first: int = 1, keep: Column | None = None) -> DataFrame:
    """``keys, w, values``: the running sums of ``changes`` (``keys, w, values``) in each window from ``first`` to ``last``.

    ``keep`` (over the sums) is asked once for each stretch of windows without a change, before the stretch is laid out.
    """
    order = Window.partitionBy(*keys).orderBy("w")  # the frame takes in all changes of a window
    sums = changes.select(*keys, "w", *[F.sum(v).over(order).alias(v) for v in values], F.lead("w").over(order).alias("_next"))
    sums = sums.where(keep) if keep is not None else sums
    begin, end = F.greatest(F.col("w"), F.lit(first)), F.least(F.coalesce("_next", F.lit(last + 1)) - 1, F.lit(last))
    return sums.where(begin <= end).withColumn("w", F.explode(F.sequence(begin, end))).select(*keys, "w", *values)
