"""Token statistics of buckets, and what labels and thresholds make of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.config import DEFAULT, EngineConfig
from emberline.functions.measures import beta_moments
from emberline.session import cut, small_or_not


def token_counts(members: DataFrame) -> DataFrame:
    """``bucket, token, n``: occurrences of each token, repeats counted."""
    return members.select("bucket", F.explode("tokens").alias("token")).groupBy("bucket", "token").agg(F.count(F.lit(1)).alias("n"))


def token_shares(members: DataFrame) -> DataFrame:
    """``bucket, token, df, share``: posts of the bucket that hold the token, and their share of all its posts."""
    size = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"))
    df = token_counts(members.select("bucket", F.array_distinct("tokens").alias("tokens"))).withColumnRenamed("n", "df")
    return df.join(size, "bucket").select("bucket", "token", "df", (F.col("df").cast("double") / F.col("_n")).alias("share"))


def bucket_sums(members: DataFrame) -> DataFrame:
    """``bucket, posts, kinds, total``: posts, distinct tokens, and the sum of the tokens' document frequencies."""
    size = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("posts"))
    df = token_counts(members.select("bucket", F.array_distinct("tokens").alias("tokens")))
    sums = df.groupBy("bucket").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("total"))
    return size.join(sums, "bucket")


def event_buckets(members: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Buckets whose mean token share exceeds the floor; buckets without tokens are none."""
    return bucket_sums(members).where(F.col("total").cast("double") / (F.col("kinds") * F.col("posts")) > config.mean_floor)


def purified(members: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    return event_buckets(members, config).where(F.col("posts") < config.purify_below)


#: Posts with one token in a bucket that meet its other ones in one place.
PLACE_POSTS = 2000


def token_pairs(members: DataFrame, columns: Sequence[str] = (), place_posts: int = PLACE_POSTS) -> DataFrame:
    """``bucket, a, b, shared, na, nb`` and each of ``columns`` of both posts (with _a and _b): pairs a < b of a bucket's posts that share a token.

    The posts of a bucket that hold one common token are dealt into parts, and each part meets every part in a place of
    its own, so that no task has all pairs of a token.
    """
    held = members.select("bucket", "id", *columns, F.size("tokens").alias("n"), F.explode("tokens").alias("t"))
    often = held.groupBy("bucket", "t").agg(F.ceil(F.count(F.lit(1)) / place_posts).cast("int").alias("_k")).where("_k > 1")
    dealt = held.join(small_or_not(cut(often)), ["bucket", "t"], "left").withColumn("_k", F.coalesce("_k", F.lit(1)))
    side = lambda d, name: d.select("bucket", "t", "p", F.col("id").alias(name), F.col("n").alias(f"n{name}"), *[F.col(c).alias(f"{c}_{name}") for c in columns])
    x = side(dealt.withColumn("p", F.pmod(F.xxhash64("id"), F.col("_k")).cast("int")), "a")
    y = side(dealt.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))), "b")
    both = [f"{c}_{name}" for c in columns for name in "ab"]
    return x.join(y, ["bucket", "t", "p"]).where("a < b").groupBy("bucket", "a", "b", "na", "nb", *both).agg(F.count(F.lit(1)).alias("shared"))


def overlap_pairs(members: DataFrame) -> DataFrame:
    """``bucket, a, b, shared, na, nb``: pairs of posts a < b of a bucket that share a token."""
    return token_pairs(members.select("bucket", "id", F.array_distinct("tokens").alias("tokens")))


def _mean_variance(pairs: DataFrame, members: DataFrame, value, of_empty) -> DataFrame:  # noqa: ANN001
    """Mean and sample variance over all pairs of a bucket, from those that share a token and the counts of the others.

    Pairs that share nothing have one known value, 0 or 1, so they are counted, not built. ``of_empty`` gives the
    number of pairs with a post without tokens whose value is the other one.
    """
    sums = pairs.groupBy("bucket").agg(F.sum(value).alias("_s"), F.sum(value * value).alias("_q"), F.count(F.lit(1)).alias("_k"))
    size = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(F.size("tokens") == 0, 1)).alias("_e"))
    return size.join(sums, "bucket", "left").fillna(0, ["_s", "_q", "_k"]).withColumn("pairs", (F.col("_n") * (F.col("_n") - 1) / 2).cast("bigint")).transform(of_empty)


def _finish(rows: DataFrame, total, squares) -> DataFrame:  # noqa: ANN001
    n = F.col("pairs").cast("double")
    mean = F.try_divide(total, n)
    variance = F.when(F.col("pairs") > 1, F.greatest((squares - total * total / F.nullif(n, F.lit(0.0))) / F.nullif(n - 1, F.lit(0.0)), F.lit(0.0)))
    return rows.where("pairs > 0").select("bucket", "pairs", (F.round(mean, 6) + 0.0).alias("mean"), (F.round(variance, 6) + 0.0).alias("variance"))


def distance_stats(members: DataFrame) -> DataFrame:
    """``bucket, pairs, mean, variance`` of the Jaccard distance of all pairs of a bucket's posts (two empty ones: 0)."""
    rows = members.select("bucket", "id", F.array_distinct("tokens").alias("tokens"))
    similar = F.col("shared").cast("double") / (F.col("na") + F.col("nb") - F.col("shared"))
    own = _mean_variance(overlap_pairs(rows), rows, similar, lambda d: d)
    both_empty = (F.col("_e") * (F.col("_e") - 1) / 2).cast("double")
    s, q, n = F.col("_s") + both_empty, F.col("_q") + both_empty, F.col("pairs").cast("double")
    return _finish(own, n - s, n - s * 2 + q)


def overlap_stats(members: DataFrame) -> DataFrame:
    """``bucket, pairs, mean, variance`` of the overlap coefficient of all pairs of a bucket's posts (with an empty one: 1)."""
    rows = members.select("bucket", "id", F.array_distinct("tokens").alias("tokens"))
    value = F.col("shared").cast("double") / F.least("na", "nb")
    own = _mean_variance(overlap_pairs(rows), rows, value, lambda d: d)
    with_empty = (F.col("pairs") - (F.col("_n") - F.col("_e")) * (F.col("_n") - F.col("_e") - 1) / 2).cast("double")
    return _finish(own, F.col("_s") + with_empty, F.col("_q") + with_empty)


def labelled_stats(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``bucket, mean, variance, label``: the distance statistics of the buckets that have a label (``bucket, label``), 1 or -1."""
    return distance_stats(members).join(labels.where("label IN (1, -1)"), "bucket").select("bucket", "mean", "variance", "label")


def every_nth(rows: DataFrame, ts_dim: DataFrame, n: int) -> DataFrame:
    """Rows of the first of every ``n`` source files."""
    return rows.join(F.broadcast(ts_dim.where((F.col("ord") - 1) % n == 0).select("ts")), "ts", "left_semi")  # one row a file


def share_vectors(members: DataFrame, fractions: bool = True) -> DataFrame:
    """``bucket, values``: each bucket's document frequencies, or shares, in falling order, padded with 0 to the longest."""
    column = "share" if fractions else "df"
    lists = token_shares(members).groupBy("bucket").agg(F.sort_array(F.collect_list(F.col(column).cast("double")), asc=False).alias("values"))
    longest = lists.agg(F.max(F.size("values"))).first()[0] or 0
    return lists.select("bucket", F.concat("values", F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("values"))).alias("values"))


def beta_fit(members: DataFrame, whole: bool = False) -> DataFrame:
    """``bucket, alpha, beta`` of the token shares by moments, or of all buckets together; null without variance."""
    rows = token_shares(members)
    n, s, q = F.count(F.lit(1)).cast("double"), F.sum("share"), F.sum(F.col("share") * F.col("share"))
    grouped = (rows.groupBy() if whole else rows.groupBy("bucket")).agg((s / n).alias("_m"), F.round(q / n - (s / n) * (s / n), 12).alias("_v"))
    alpha, beta = beta_moments(F.col("_m"), F.col("_v"))
    keys = [] if whole else ["bucket"]
    return grouped.select(*keys, (F.round(alpha, 4) + 0.0).alias("alpha"), (F.round(beta, 4) + 0.0).alias("beta"))


def expectation_split(fits: DataFrame, floor: float = DEFAULT.mean_floor) -> DataFrame:
    """``bucket, positive``: whether the expectation alpha / (alpha + beta) exceeds the floor."""
    return fits.where("alpha IS NOT NULL").select("bucket", (F.try_divide(F.col("alpha"), F.col("alpha") + F.col("beta")) > floor).alias("positive"))


def cluster_similarity(members: DataFrame) -> DataFrame:
    """``inside, pairs, mean``: the overlap coefficient of post pairs within one part of a bucket, and across its parts.

    ``members`` has ``bucket, part, id, tokens``. Pairs without a shared token count as 0, those with an empty post as 1.
    """
    rows = members.select("bucket", "part", "id", F.array_distinct("tokens").alias("tokens"))
    shared = token_pairs(rows, ["part"])
    sums = shared.groupBy((F.col("part_a") == F.col("part_b")).alias("inside")).agg(F.sum(F.col("shared").cast("double") / F.least("na", "nb")).alias("_s"))
    part = rows.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.size("tokens") == 0, 1)).alias("e"))
    pairs = lambda n: n * (n - 1) / 2
    n, e = F.col("n"), F.col("e")
    one = part.agg(F.sum(pairs(n)).alias("p"), F.sum(pairs(n) - pairs(n - e)).alias("z"))
    whole = part.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("e").alias("e")).agg(F.sum(pairs(n)).alias("p"), F.sum(pairs(n) - pairs(n - e)).alias("z"))
    (p1, z1), (p, z) = one.first(), whole.first()
    p1, z1, p, z = p1 or 0.0, z1 or 0.0, p or 0.0, z or 0.0
    counts = members.sparkSession.createDataFrame([(True, float(p1), float(z1)), (False, float(p - p1), float(z - z1))], "inside boolean, p double, z double")
    mean = F.try_divide(F.coalesce("_s", F.lit(0.0)) + F.col("z"), F.col("p"))
    return counts.join(sums, "inside", "left").select("inside", F.col("p").cast("bigint").alias("pairs"), (F.round(mean, 6) + 0.0).alias("mean"))


def exact_split(rows: DataFrame, key: str, ratio: float = 0.8, seed: int = 0) -> DataFrame:
    """``rows`` with ``train``: the first ceil(n * ratio) by a hash of the key and the seed, so that the split is exact and repeatable.

    The rows are put in order by range partitions and numbered from the partitions' counts, never by one task.
    """
    hashed = rows.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    n = rows.count()
    take = -(-n * int(round(ratio * 1000)) // 1000)
    buckets = hashed.withColumn("_b", F.substring("_h", 1, 3))
    before = buckets.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))  # at most 4096 rows
    before = before.withColumn("_before", F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
    nth = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) + F.coalesce("_before", F.lit(0))
    return buckets.join(F.broadcast(before.select("_b", "_before")), "_b").withColumn("train", nth <= take).drop("_h", "_b", "_before")
