"""Bursting keyword pairs: each window of files against the window before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.config import DEFAULT, EngineConfig
from emberline.functions import text as T
from emberline.functions.measures import information_gain
from emberline.operators.buckets import popular_counts
from emberline.operators.prepare import hours
from emberline.operators.windows import in_windows, spans
from emberline.session import cut, small_or_not


def window_counts(posts: DataFrame, files: DataFrame, config: EngineConfig = DEFAULT, popular: DataFrame | None = None) -> DataFrame:
    """``w, kwp, a, b, c, d`` of the pairs popular in window w: posts with the pair before and now, other posts before and now.

    ``posts`` are prepared posts, ``files`` any rows with ``ts`` of all source files (hours without posts count too);
    ``popular`` has their popular pairs, if they are known. Counts of a pair add up the hours; the totals are distinct
    ids of popular buckets; differences below 0 count as 0.
    """
    length = config.window_hours
    dim = cut(hours(files))
    ts_dim = F.broadcast(dim)  # one row a file
    last = dim.agg(F.max("ord")).first()[0] or 0
    counts = popular if popular is not None else cut(popular_counts(posts, config.hourly_floor))
    # A pair's count enters a window, goes over to the window before, and leaves it.
    n, none = F.col("n"), F.lit(0).cast("bigint")
    steps = F.array(
        F.struct(F.col("ord").alias("w"), none.alias("a"), n.alias("b")),
        F.struct((F.col("ord") + length).alias("w"), n.alias("a"), (-n).alias("b")),
        F.struct((F.col("ord") + 2 * length).alias("w"), (-n).alias("a"), none.alias("b")),
    )
    steps = counts.join(ts_dim, "ts").repartition("kwp").select("kwp", F.explode(steps).alias("s")).select("kwp", "s.*")
    sums = in_windows(steps, ["kwp"], ["a", "b"], last, 2 * length, F.col("b") >= config.window_floor)
    kept = posts.select("ts", "id", F.explode("kwpairs").alias("p")).select("ts", "id", T.pair_key(F.col("p.a"), F.col("p.b")).alias("kwp"))
    ids = kept.join(small_or_not(counts.select("ts", "kwp")), ["ts", "kwp"], "left_semi").join(ts_dim, "ts")
    places = ids.groupBy("id").agg(F.array_sort(F.collect_set("ord")).alias("o")).select(F.explode(spans(F.col("o"), length)).alias("s"))
    ends = places.select(F.explode(F.array(F.struct(F.col("s.begin").alias("w"), F.lit(1).alias("now")), F.struct(F.col("s.end").alias("w"), F.lit(-1).alias("now")))).alias("e"))
    now = cut(in_windows(ends.select("e.*").groupBy("w").agg(F.sum("now").alias("now")), [], ["now"], last))  # one row a file
    total = now.withColumnRenamed("now", "current").join(now.select((F.col("w") + length).alias("w"), F.col("now").alias("before")), "w", "left")
    joined = sums.join(F.broadcast(total), "w", "left").fillna(0, ["before", "current"])
    return joined.select(
        "w", "kwp", "a", "b", F.greatest(F.col("before") - F.col("a"), F.lit(0)).alias("c"), F.greatest(F.col("current") - F.col("b"), F.lit(0)).alias("d")
    )


def with_gain(counts: DataFrame) -> DataFrame:
    gain = information_gain(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    return counts.withColumn("ig", F.round(gain, 6) + F.lit(0.0))


def bursts(counts: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Pairs that aren't rarer than before and whose information gain reaches the floor, without carried ones."""
    return with_gain(counts).where((F.col("b") >= F.col("a")) & (F.col("ig") >= config.gain_floor))


def bursts_carried(counts: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """``w, kwp, ig, a, b, c, d, inherited``: bursts, where a pair that was high in window w - 1 stays while b > a / 2.

    The state of a pair depends on no other pair, so it is a fold over the pair's own windows (at most one row a
    window); an inherited row has ig -1000.
    """
    rows = with_gain(counts)
    entry = F.struct("w", "a", "b", "c", "d", "ig")
    folded = rows.groupBy("kwp").agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    start = F.struct(
        F.lit(-1).cast("int").alias("last"), F.array().cast("array<struct<w:int,a:bigint,b:bigint,c:bigint,d:bigint,ig:double,inherited:boolean>>").alias("out")
    )

    def step(state, x):  # noqa: ANN001, ANN202
        held = state["last"] == x["w"] - 1
        keep = F.when(held, x["b"] > x["a"] / F.lit(2.0)).otherwise((x["b"] >= x["a"]) & (x["ig"] >= config.gain_floor))
        row = F.struct(
            x["w"].cast("int").alias("w"), x["a"].alias("a"), x["b"].alias("b"), x["c"].alias("c"), x["d"].alias("d"),
            F.when(held, F.lit(-1000.0)).otherwise(x["ig"]).alias("ig"), held.alias("inherited"),
        )
        return F.struct(
            F.when(keep, x["w"].cast("int")).otherwise(state["last"]).alias("last"),
            F.when(keep, F.concat(state["out"], F.array(row))).otherwise(state["out"]).alias("out"),
        )

    kept = folded.select("kwp", F.explode(F.aggregate("rows", start, step)["out"]).alias("r"))
    return kept.select("r.w", "kwp", "r.ig", "r.a", "r.b", "r.c", "r.d", "r.inherited")


def bucket_members(found: DataFrame, posts: DataFrame, files: DataFrame, config: EngineConfig = DEFAULT, popular: DataFrame | None = None) -> DataFrame:
    """``w, kwp, ts, id, keywords, text``: the posts of each found pair in its window, from hours in which the pair is popular."""
    length = config.window_hours
    dim = hours(files)
    counts = popular if popular is not None else popular_counts(posts, config.hourly_floor)
    # The hours of each found pair with their windows, so that posts are met once, with the few columns that tell them apart.
    inside = (F.col("ord") <= F.col("w")) & (F.col("ord") > F.col("w") - length)
    wanted = counts.select("ts", "kwp").join(F.broadcast(dim), "ts").join(found.select("w", "kwp"), "kwp").where(inside)  # one row a file
    wanted = cut(wanted.groupBy("ts", "kwp").agg(F.collect_list("w").alias("_w")))
    own = ["ts", "id", "keywords", "text"]
    pairs = posts.select(*own, F.explode("kwpairs").alias("p")).select(*own, T.pair_key(F.col("p.a"), F.col("p.b")).alias("kwp"))
    rows = pairs.join(small_or_not(wanted), ["ts", "kwp"])
    return rows.select(F.explode("_w").alias("w"), "kwp", *own)
