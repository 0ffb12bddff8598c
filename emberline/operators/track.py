"""Following events from window to window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.config import DEFAULT, EngineConfig
from emberline.operators.match import bucket_matches
from emberline.session import cut


def parents(buckets: DataFrame, members: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """``w, bucket, parent``: the first matching bucket, by position, of the window before; null if none matches.

    ``buckets`` has ``w, bucket, pos`` with windows numbered without gaps, ``members`` ``w, bucket, id, tokens``. All
    windows are matched in one join.
    """
    before = members.withColumn("w", F.col("w") + 1)
    found = bucket_matches(before, members, config.track_tweet, config.track_bucket)
    places = buckets.select((F.col("w") + 1).alias("w"), F.col("bucket").alias("a"), "pos")
    first = found.join(places, ["w", "a"]).groupBy("w", F.col("b").alias("bucket")).agg(F.min(F.struct("pos", "a"))["a"].alias("parent"))
    return buckets.select("w", "bucket", "pos").join(first, ["w", "bucket"], "left")


def events(linked: DataFrame, first_id: int = 0) -> DataFrame:
    """``w, bucket, pos, event_id``: each bucket's event, the root of its chain of parents, numbered by (window, position).

    The roots are found by pointer jumping, in as many rounds as the logarithm of the longest chain.
    """
    now = cut(linked.select("w", "bucket", "pos", F.coalesce("parent", "bucket").alias("root")))
    while True:
        step = now.select(F.col("bucket").alias("_b"), F.col("root").alias("_r"))
        after = cut(now.join(step, now["root"] == step["_b"], "left").select("w", "bucket", "pos", F.col("root").alias("_old"), F.coalesce("_r", "root").alias("root")))
        now = after.select("w", "bucket", "pos", "root")
        if after.where("_old <> root").isEmpty():
            break
    roots = now.where("bucket = root").select("w", "pos", F.col("bucket").alias("root"))
    # Numbered window by window: counts of the windows before (one row a window), then the place inside.
    counts = roots.groupBy("w").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("w", F.coalesce(F.sum("_n").over(Window.orderBy("w").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("w").orderBy("pos", "root"))
    numbered = roots.join(F.broadcast(before), "w").select("root", (place + F.col("_before") + (first_id - 1)).cast("bigint").alias("event_id"))
    return now.join(numbered, "root").select("w", "bucket", "pos", "event_id")


def summary(tracked: DataFrame, members: DataFrame) -> DataFrame:
    """``event_id, w, bucket, id, closed``: each post of an event in the first window that has it; closed if the event ended before the last window."""
    rows = members.select("w", "bucket", "id").join(tracked.select("w", "bucket", "event_id"), ["w", "bucket"])
    first = rows.groupBy("event_id", "id").agg(F.min("w").alias("w"))
    kept = rows.join(first, ["event_id", "id", "w"], "left_semi")
    last = tracked.agg(F.max("w")).first()[0]
    ends = tracked.groupBy("event_id").agg((F.max("w") < F.lit(last)).alias("closed"))
    return kept.join(ends, "event_id").select("event_id", "w", "bucket", "id", "closed")


def track_length(tracked: DataFrame, only_closed: bool = True) -> DataFrame:
    """``event_id, windows``: in how many windows an event occurs; of closed events, or of all."""
    last = tracked.agg(F.max("w")).first()[0]
    length = tracked.groupBy("event_id").agg(F.count_distinct("w").alias("windows"), F.max("w").alias("_last"))
    return (length.where(F.col("_last") < F.lit(last)) if only_closed else length).select("event_id", "windows")


def closed_events(found: DataFrame, text_order: bool = False) -> DataFrame:
    """``event_id, report``: one text a closed event, a line a window with its posts; windows as numbers or, as older reports have them, as text."""
    lines = found.where("closed").groupBy("event_id", "w").agg(F.array_sort(F.collect_set("id")).alias("_ids"))
    order = F.col("w").cast("string") if text_order else F.lpad(F.col("w").cast("string"), 12, "0")
    line = F.concat_ws(": ", F.col("w").cast("string"), F.array_join(F.transform("_ids", lambda x: x.cast("string")), " "))
    entries = F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l"))))
    return lines.groupBy("event_id").agg(F.array_join(F.transform(entries, lambda e: e["l"]), "\n").alias("report"))


def closed_events_json(found: DataFrame) -> DataFrame:
    """``event_id, event``: each closed event as a JSON object with its windows in order and the ids of each."""
    windows = found.where("closed").groupBy("event_id", "w").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    lists = windows.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("w", "ids"))).alias("windows"))
    return lists.select("event_id", F.to_json(F.struct("event_id", "windows")).alias("event"))
