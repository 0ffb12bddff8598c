"""Files of posts and buckets: line-wise JSON, hourly file names, tables by hour, CSV and text sinks."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.functions.tweets import RAW_POST, is_valid
from emberline.session import small_or_not


def _parsed(lines: DataFrame, column: str) -> tuple[DataFrame, Column]:
    parsed = lines.where(F.trim(column) != "").withColumn("post", F.from_json(F.col(column), RAW_POST, {"mode": "PERMISSIVE"}))
    return parsed, F.coalesce(F.ltrim(column).startswith("{") & F.col("post").isNotNull() & F.try_parse_json(column).isNotNull(), F.lit(False))


def parse_lines(lines: DataFrame, column: str = "line", continue_on_error: bool = True) -> DataFrame:
    """``lines`` with ``post``, the JSON object of each line as a struct; bad lines are left out, or fail the job.

    Blank lines are skipped. Lines are data and never evaluated.
    """
    parsed, good = _parsed(lines, column)
    if continue_on_error:
        return parsed.where(good)
    return parsed.withColumn("post", F.when(good, F.col("post")).otherwise(F.raise_error(F.concat(F.lit("bad line: "), F.substring(column, 1, 80))).cast(RAW_POST)))


def line_counts(lines: DataFrame, *keys: str, column: str = "line") -> DataFrame:
    """``keys, lines, bad, invalid``: the lines that aren't blank, those that are no JSON object, and the objects that are no valid post."""
    parsed, good = _parsed(lines, column)
    parts = parsed.select(*keys, good.alias("_good"), is_valid(F.col("post")).alias("_valid"))
    counts = [F.count(F.lit(1)), F.count(F.when(~F.col("_good"), 1)), F.count(F.when(F.col("_good") & ~F.col("_valid"), 1))]
    return parts.groupBy(*keys).agg(*[c.alias(n) for c, n in zip(counts, ("lines", "bad", "invalid"))])


def python_literals(lines: DataFrame, column: str = "line") -> DataFrame:
    """``lines`` in which a Python dict literal became JSON; anything else, code above all, becomes null."""

    @F.pandas_udf("string")
    def convert(values: pd.Series) -> pd.Series:
        import json

        def one(value):  # noqa: ANN001, ANN202
            if value is None:
                return None
            try:
                json.loads(value)
                return value
            except ValueError:
                pass
            try:
                found = ast.literal_eval(value)
                return json.dumps(found) if isinstance(found, dict) else None
            except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
                return None

        return values.map(one)

    return lines.withColumn(column, convert(column))


def file_hour(path: Column) -> Column:
    """The hour in a file's name (its leading number); null for names that begin with . or __ or ``timestamps``."""
    hidden = F.regexp_extract(path, "(?:^|/)((?:\\.|__|timestamps)[^/]*)$", 1) != ""
    return F.when(~hidden, F.regexp_extract(path, "(?:^|/)([0-9]+)[^/]*$", 1).try_cast("bigint"))


def read_lines(spark: SparkSession, directory: str, suffix: str = ".60m.cluster_head.txt") -> DataFrame:
    """``ts, line_no, line`` of all files ``<ts><suffix>`` of a directory; ``line_no`` orders the lines of a file.

    A file may be read in blocks by several tasks. A block has no more lines than bytes, so its start, and the line's
    place in it, give numbers that rise through the file, without sorting it.
    """
    text = spark.read.option("pathGlobFilter", f"*{suffix}").text(directory)
    own = text.select(F.col("_metadata.file_name").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_n"), F.col("value").alias("line"))
    blocks = own.groupBy("_f", "_b").agg(F.min("_n").alias("_first"))
    placed = own.join(small_or_not(blocks), ["_f", "_b"])
    return placed.select(file_hour(F.col("_f")).alias("ts"), (F.col("_b") + F.col("_n") - F.col("_first")).alias("line_no"), "line").where("ts IS NOT NULL")


def read_posts(spark: SparkSession, directory: str, suffix: str = ".60m.cluster_head.txt") -> DataFrame:
    """``ts, line_no, post`` of the good lines of all files ``<ts><suffix>`` of a directory."""
    return parse_lines(read_lines(spark, directory, suffix)).select("ts", "line_no", "post")


def read_stage(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stage's table; a missing one is empty."""
    from py4j.java_gateway import java_import

    jvm = spark._jvm
    java_import(jvm, "org.apache.hadoop.fs.Path")
    target = jvm.Path(path)
    there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def write_stage(df: DataFrame, path: str) -> None:
    """A stage's table, by hour; only the hours of ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ts").parquet(path)


def write_csv(df: DataFrame, path: str, header: bool = False) -> None:
    """A CSV directory; array columns are joined by commas inside their field."""
    flat = [F.array_join(F.transform(f.name, lambda x: x.cast("string")), ",").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite").csv(path, header=header)


def write_reports(df: DataFrame, path: str) -> None:
    """Text files of the column ``report``, a directory an hour."""
    df.select("ts", "report").write.mode("overwrite").partitionBy("ts").text(path)


def item_buckets(raw: DataFrame, shift: int = 5) -> DataFrame:
    """Buckets of the picture source from rows ``ts, data``: one row an element, hours shifted, posts as (id, text).

    ``data`` is array<struct<instagram, twitter: array<struct<text, id>>>>; every bucket has flags and no signature.
    """
    item = F.explode("data").alias("_d")
    rows = raw.select((F.col("ts") + shift).alias("ts"), item)
    posts = F.transform("_d.twitter", lambda t: F.struct(t["id"].alias("id"), t["text"].alias("text")))
    return rows.select("ts", F.lit("").alias("signature"), F.lit(False).alias("t_bucket"), F.lit(True).alias("i_bucket"), posts.alias("twitter"), F.col("_d.instagram").alias("instagram"))


def parse_labelled(reports: DataFrame, column: str = "value") -> DataFrame:
    """``signature, cluster, texts`` of labelled reports, one report a row.

    A line of four or more = begins a bucket, the next line names it (``N. signature``), lines ``*** text`` are posts, a
    line that begins with six or more - ends a cluster. Posts after the last such line belong to no cluster.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for report in frame[column]:
                name, texts, cluster, heading = None, [], 0, False
                for line in (report or "").split("\n"):
                    line = line.strip()
                    if line.startswith("===="):
                        heading, texts, cluster = True, [], 0
                    elif heading:
                        name, heading = line.partition(". ")[2], False
                    elif line.startswith("***"):
                        texts.append(line.partition("*** ")[2])
                    elif line.startswith("------"):
                        rows.append((name, cluster, texts))
                        cluster, texts = cluster + 1, []
            yield pd.DataFrame(rows, columns=["signature", "cluster", "texts"])

    return reports.select(column).mapInPandas(run, "signature string, cluster int, texts array<string>")


def page(listing: DataFrame, number: int, size: int = 10, order: str = "ts") -> DataFrame:
    """Page ``number`` (from 0) of a listing."""
    return listing.orderBy(order).offset(number * size).limit(size)
