"""The hourly pipeline as a stream: files arrive, results are appended or replaced by hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.config import DEFAULT, EngineConfig
from emberline.operators.buckets import popular_counts
from emberline.operators.prepare import prepared
from emberline.sources.files import write_stage


def post_stream(spark: SparkSession, path: str, schema, files_a_batch: int | None = None) -> DataFrame:  # noqa: ANN001
    """Posts as a stream of Parquet files."""
    reader = spark.readStream.schema(schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.parquet(path)


def replay_popular(posts: DataFrame, target: str, checkpoint: str, config: EngineConfig = DEFAULT) -> None:
    """Keeps each micro-batch's posts by hour and writes the popular pairs of the hours it has posts of; runs until what has arrived is done.

    An hour may come in several batches: its pairs are counted again over all of its posts that have arrived. A repeated
    batch replaces its own posts and writes the same hours again, so the result is the same after a failure.
    """
    kept = f"{checkpoint}-posts"

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = batch.select("ts", "line_no", "id", "text").withColumn("batch", F.lit(number))
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "ts").parquet(kept)
        here = spark.read.parquet(kept)
        hours = here.where(F.col("batch") == number).select("ts").distinct()
        arrived = here.join(F.broadcast(hours), "ts", "left_semi").withColumn("ts", F.col("ts").cast("bigint"))  # one row an hour
        write_stage(popular_counts(prepared(arrived.drop("batch"), config), config.hourly_floor), target)

    posts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def first_seen_stream(posts: DataFrame, least_id: int = DEFAULT.least_id, delay: str | None = None, time: str = "created_at") -> DataFrame:
    """The first arrival of each valid id; with ``delay`` ids are forgotten that long after the newest time."""
    valid = posts.where(F.col("id") >= least_id)
    return valid.withWatermark(time, delay).dropDuplicatesWithinWatermark(["id"]) if delay else valid.dropDuplicates(["id"])


def counts_by_time(posts: DataFrame, length: str = "1 hour", slide: str | None = None, delay: str = "30 hours", time: str = "created_at") -> DataFrame:
    """``start, lang, n``: posts by window of their own time; late ones count for ``delay``."""
    rows = posts.where(F.col(time).isNotNull()).withWatermark(time, delay)
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return rows.groupBy(window, "lang").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "lang", "n")


def open_events(tracked: DataFrame, target: str, state: str, checkpoint: str) -> None:
    """Follows events hour by hour: ``target`` gets the events that ended, ``state`` holds those still open.

    A micro-batch has tracked buckets ``w, bucket, event_id``. An event is closed when a batch's last window is past its
    own last one.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("event_id", "w").distinct()
        if number:
            rows = rows.unionByName(spark.read.parquet(f"{state}/{number - 1}")).distinct()
        last = rows.agg(F.max("w")).first()[0]
        ends = rows.groupBy("event_id").agg(F.max("w").alias("_last"))
        done = rows.join(ends.where(F.col("_last") < F.lit(last)), "event_id", "left_semi")
        done.groupBy("event_id").agg(F.count_distinct("w").alias("windows")).write.mode("overwrite").parquet(f"{target}/{number}")
        rows.join(ends.where(F.col("_last") == F.lit(last)), "event_id", "left_semi").write.mode("overwrite").parquet(f"{state}/{number}")

    tracked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
