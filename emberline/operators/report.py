"""Text reports of buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F


def bucket_kind(t_bucket, i_bucket):  # noqa: ANN001, ANN201
    return (
        F.when(t_bucket & i_bucket, "I-bucket and T-bucket").when(i_bucket, "I-bucket").when(t_bucket, "T-bucket").otherwise("Error")
    )


def general_buckets(members: DataFrame, signatures: DataFrame) -> DataFrame:
    """Buckets of posts in the general form: ``w, bucket, pos, signature, t_bucket, i_bucket, twitter, instagram``.

    ``members`` has ``w, bucket, id, text``, ``signatures`` ``w, bucket, signature``; posts are in order of their ids,
    buckets of their signature and first post. The list of a bucket is as long as the bucket, which the filters before
    bound.
    """
    none = F.array().cast("array<struct<name:string,tags:array<string>,url:string>>")
    lists = members.groupBy("w", "bucket").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("twitter"))
    named = lists.join(signatures, ["w", "bucket"])
    place = F.row_number().over(Window.partitionBy("w").orderBy("signature", F.col("twitter")[0]["id"], "bucket"))
    return named.select("w", "bucket", place.alias("pos"), "signature", F.lit(True).alias("t_bucket"), F.lit(False).alias("i_bucket"), "twitter", none.alias("instagram"))


def reports(buckets: DataFrame, items: bool = True) -> DataFrame:
    """``ts, bucket_id, report``: the text of each bucket, numbered by its position in its file.

    ``buckets`` has ``ts, pos, bucket_id, signature, t_bucket, i_bucket, twitter, instagram``, and optionally
    ``likelihood``. The words, rules and indents of the format are fixed values. Items are numbered by the first item that is equal to them, as earlier reports have it. Null texts and names are written as nothing.
    """
    number = F.row_number().over(Window.partitionBy("ts").orderBy("pos", "bucket_id"))
    none = F.array().cast("array<string>")
    posts = F.transform("twitter", lambda t: F.concat(F.lit("\t*** <"), F.coalesce(t["id"].cast("string"), F.lit("")), F.lit("> "), F.coalesce(t["text"], F.lit(""))))
    shown = lambda i: F.concat(
        F.lit("\t+++ ("), (F.array_position("instagram", i) - 1).cast("string"), F.lit(") ["), F.coalesce(i["name"], F.lit("")), F.lit("]\n\t\t tags: "),
        F.coalesce(F.array_join(i["tags"], ", "), F.lit("")), F.lit("\n\t\t url: "), F.coalesce(i["url"], F.lit("")),
    )
    pictures = F.transform("instagram", shown)
    rule = F.lit("=" * 34)
    head = F.array(rule, F.concat(number.cast("string"), F.lit(". "), F.coalesce("signature", F.lit(""))), F.concat(F.lit("Bucket type: "), bucket_kind(F.col("t_bucket"), F.col("i_bucket"))))
    if "likelihood" in buckets.columns:
        head = F.concat(head, F.array(F.concat(F.lit("Likelihood: "), F.col("likelihood").cast("string"))))
    lines = [head, F.array(F.lit("")), F.coalesce(posts, none)]
    if items:
        lines += [F.when(F.size("instagram") > 0, F.array(F.lit("\n\t\t----------Instagram----------\n"))).otherwise(none), F.coalesce(pictures, none)]
    return buckets.select("ts", "bucket_id", F.concat(F.array_join(F.concat(*lines), "\n"), F.lit("\n\n")).alias("report"))
