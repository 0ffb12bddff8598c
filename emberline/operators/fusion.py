"""Fusing buckets of two sources: those that match directly or through others become one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.config import DEFAULT, EngineConfig
from emberline.operators.components import components
from emberline.operators.match import bucket_matches


def matched_sources(posts: DataFrame, items: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """``w, a, b``: buckets of the first and the second source that share a post or are alike."""
    return bucket_matches(posts, items, config.fuse_tweet, config.fuse_bucket, any_id=True).select("w", "a", "b")


def fused(buckets: DataFrame, matches: DataFrame) -> DataFrame:
    """``w, bucket, root``: the fused bucket of each bucket, named by its smallest; buckets without a match stay by themselves."""
    roots = components(matches.select(F.struct("w", F.col("a").alias("bucket")).alias("a"), F.struct("w", F.col("b").alias("bucket")).alias("b")))
    named = roots.select(F.col("node.w").alias("w"), F.col("node.bucket").alias("bucket"), F.col("root.bucket").alias("root"))
    return buckets.select("w", "bucket").join(named, ["w", "bucket"], "left").select("w", "bucket", F.coalesce("root", "bucket").alias("root"))


def fused_rows(groups: DataFrame, buckets: DataFrame, members: DataFrame, items: DataFrame) -> DataFrame:
    """One row a fused bucket: flags, the signatures of the first source joined in order, and its distinct posts and items.

    ``buckets`` has ``w, bucket, signature, t_bucket, i_bucket``, ``members`` ``w, bucket, id`` and ``items`` ``w, bucket, url``.
    """
    named = buckets.join(groups, ["w", "bucket"])
    signs = F.array_sort(F.collect_set(F.when(F.col("t_bucket") & (F.length("signature") > 0), F.col("signature"))))
    heads = named.groupBy("w", "root").agg(
        F.concat_ws("__", signs).alias("signature"), F.max("t_bucket").alias("t_bucket"), F.max("i_bucket").alias("i_bucket"), F.count(F.lit(1)).alias("buckets")
    )
    posts = members.join(groups, ["w", "bucket"]).groupBy("w", "root").agg(F.count_distinct("id").alias("posts"))
    pictures = items.join(groups, ["w", "bucket"]).groupBy("w", "root").agg(F.count_distinct("url").alias("items"))
    joined = heads.join(posts, ["w", "root"], "left").join(pictures, ["w", "root"], "left")
    return joined.fillna(0, ["posts", "items"])


def fused_buckets(groups: DataFrame, buckets: DataFrame, posts: DataFrame, items: DataFrame) -> DataFrame:
    """One general bucket for each fused one: ``w, root, signature, t_bucket, i_bucket, twitter, instagram``.

    ``buckets`` has ``w, bucket, signature, t_bucket, i_bucket``, ``posts`` ``w, bucket, id, text`` and ``items`` ``w,
    bucket, name, tags, url``. A post comes once, with its text in the first source, else in the smallest bucket; posts
    and items are in order of source, bucket and id or url. A fused bucket without posts or items has an empty list.
    """
    named = buckets.join(groups, ["w", "bucket"])
    signs = F.array_sort(F.collect_set(F.when(F.col("t_bucket") & (F.length("signature") > 0), F.col("signature"))))
    heads = named.groupBy("w", "root").agg(F.concat_ws("__", signs).alias("signature"), F.max("t_bucket").alias("t_bucket"), F.max("i_bucket").alias("i_bucket"))
    place = named.select("w", "bucket", "root", F.when(F.col("t_bucket"), 0).otherwise(1).alias("_side"))
    first = posts.join(place, ["w", "bucket"]).groupBy("w", "root", "id").agg(F.min(F.struct("_side", "bucket", "text")).alias("_f"))
    tweets = first.groupBy("w", "root").agg(F.array_sort(F.collect_list(F.struct("_f._side", "_f.bucket", "id", F.col("_f.text").alias("text")))).alias("_t"))
    pictures = items.join(place, ["w", "bucket"]).groupBy("w", "root").agg(F.array_sort(F.collect_list(F.struct("_side", "bucket", "url", "name", "tags"))).alias("_i"))
    tweet = F.transform("_t", lambda t: F.struct(t["id"].alias("id"), t["text"].alias("text")))
    item = F.transform("_i", lambda i: F.struct(i["name"].alias("name"), i["tags"].alias("tags"), i["url"].alias("url")))
    rows = heads.join(tweets, ["w", "root"], "left").join(pictures, ["w", "root"], "left")
    none = lambda kind: F.array().cast(kind)
    return rows.select(
        "w", "root", "signature", "t_bucket", "i_bucket",
        F.coalesce(tweet, none("array<struct<id:bigint,text:string>>")).alias("twitter"), F.coalesce(item, none("array<struct<name:string,tags:array<string>,url:string>>")).alias("instagram"),
    )
