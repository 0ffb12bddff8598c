"""The whole chain from delivered posts to followed events, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.config import DEFAULT, EngineConfig
from emberline.functions import text as T
from emberline.operators import cluster, detect, fusion, prepare, report, stats, track
from emberline.operators.buckets import popular_counts
from emberline.session import cut


def detected(posts: DataFrame, config: EngineConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """The found pairs of every window and the posts of each."""
    ready = prepare.prepared(posts, config, written=True)
    popular = cut(popular_counts(ready, config.hourly_floor))
    found = cut(detect.bursts_carried(detect.window_counts(ready, posts, config, popular), config))
    return found, detect.bucket_members(found, ready, posts, config, popular)


def consolidated_members(found: DataFrame, rows: DataFrame, config: EngineConfig = DEFAULT, clusters: DataFrame | None = None) -> DataFrame:
    """``w, bucket, root, id, text``: the posts of each consolidated bucket once; buckets are numbered by a hash of window and name."""
    clusters = (clusters if clusters is not None else cluster.consolidated(found, rows, config)).withColumn("bucket", F.xxhash64("w", "root"))
    return rows.join(clusters, ["w", "kwp"]).groupBy("w", "bucket", "root", "id").agg(F.min("text").alias("text"))


def events(posts: DataFrame, config: EngineConfig = DEFAULT, pictures: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every stage's result: ``found``, ``absorbed``, ``parts``, ``pure``, ``general``, ``reports``, ``tracked`` and ``summary``.

    ``pictures`` has the buckets of a second source in the general form (``w, bucket, signature, t_bucket, i_bucket,
    twitter, instagram``); with it ``fused`` and ``fused_reports`` are there too, and the fused buckets are followed.
    """
    found, rows = detected(posts, config)
    rows = cut(rows)
    clusters = cut(cluster.consolidated(found, rows, config))
    own = cut(consolidated_members(found, rows, config, clusters))
    merge = T.preset(F.col("text"), "merge", config)
    absorbed, names = cluster.absorbing(own.select("w", "bucket", "id", merge.alias("tokens")), config)
    signs = cluster.merged_buckets(clusters).select("w", F.xxhash64("w", "root").alias("origin"), "signature")
    signs = cut(cluster.absorbed_signatures(names, signs))
    texts = own.select("w", "id", "text").dropDuplicates(["w", "id"])
    named = cut(absorbed.select("w", "bucket", "id").join(texts, ["w", "id"]))
    tokens = named.select("w", "bucket", "id", T.preset(F.col("text"), "partition", config).alias("tokens"))
    parts = cluster.partitioned(tokens.join(signs, ["w", "bucket"]), config)
    cut_up = cut(named.join(parts, ["bucket", "id"]).withColumn("origin", F.col("bucket")).withColumn("bucket", F.xxhash64("bucket", "part")))
    pure = stats.purified(cut_up.select("bucket", T.preset(F.col("text"), "purify", config).alias("tokens")), config)
    kept = cut(cut_up.join(pure.select("bucket"), "bucket", "left_semi").withColumn("w", F.col("w").cast("int")))
    parents = kept.select("w", "bucket", "origin", "part").distinct().join(signs.select(F.col("bucket").alias("origin"), "signature"), "origin")
    parents = parents.withColumn("signature", F.when(F.col("part") < 0, F.col("signature")).otherwise(F.concat_ws("___", "signature", "part")))  # a part of a bucket
    general = cut(report.general_buckets(kept.select("w", "bucket", "id", "text"), parents.select("w", "bucket", "signature")))
    out = {"found": found, "absorbed": absorbed, "parts": parts, "pure": pure, "general": general, "reports": _reports(general)}
    followed = general
    if pictures is not None:
        out["fused"] = followed = cut(fuse(general, pictures, config))
        out["fused_reports"] = _reports(followed)
    members = cut(_posts(followed).select("w", "bucket", "id", merge.alias("tokens")))
    tracked = cut(track.events(track.parents(followed.select("w", "bucket", "pos"), members, config)))
    return {**out, "tracked": tracked, "summary": track.summary(tracked, members)}


def _posts(buckets: DataFrame) -> DataFrame:
    return buckets.select("w", "bucket", F.explode("twitter").alias("t")).select("w", "bucket", "t.id", "t.text").where("id IS NOT NULL")


def _reports(buckets: DataFrame) -> DataFrame:
    return report.reports(buckets.select(F.col("w").alias("ts"), F.col("bucket").alias("bucket_id"), "pos", "signature", "t_bucket", "i_bucket", "twitter", "instagram"))


def fuse(general: DataFrame, pictures: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """The buckets of both sources, those that match made one; in the general form, with positions by signature and bucket."""
    columns = ["w", "bucket", "signature", "t_bucket", "i_bucket", "twitter", "instagram"]
    both = cut(general.select(*columns).unionByName(pictures.select(*columns)))
    posts = cut(_posts(both).groupBy("w", "bucket", "id").agg(F.min("text").alias("text")))
    tokens = posts.select("w", "bucket", "id", T.preset(F.coalesce("text", F.lit("")), "merge", config).alias("tokens")).join(both.select("w", "bucket", "t_bucket"), ["w", "bucket"])
    found = fusion.matched_sources(tokens.where("t_bucket").drop("t_bucket"), tokens.where("NOT t_bucket").drop("t_bucket"), config)
    groups = cut(fusion.fused(both, found))
    items = both.select("w", "bucket", F.explode("instagram").alias("i")).select("w", "bucket", "i.*")
    rows = fusion.fused_buckets(groups, both, posts, items)
    place = F.row_number().over(Window.partitionBy("w").orderBy("signature", "root"))
    return rows.withColumn("pos", place).withColumnRenamed("root", "bucket")
