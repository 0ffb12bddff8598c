"""Keyword-pair buckets in long form, and pairs that say little as their words always stand together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.config import DEFAULT
from emberline.functions import text as T
from emberline.operators.prepare import hours
from emberline.operators.windows import in_windows, spans
from emberline.session import cut, small_or_not


def hourly_buckets(posts: DataFrame) -> DataFrame:
    """``ts, kwp, id``: the posts of each keyword pair in each file, each id once."""
    pairs = posts.select("ts", "id", F.explode("kwpairs").alias("p"))
    return pairs.select("ts", T.pair_key(F.col("p.a"), F.col("p.b")).alias("kwp"), "id").distinct()


def pair_counts(posts: DataFrame) -> DataFrame:
    """``ts, kwp, n``: sizes of the hourly buckets. Prepared posts have each id once a file and each pair once a post, so nothing needs to be made distinct."""
    pairs = posts.select("ts", F.explode("kwpairs").alias("p"))
    return pairs.groupBy("ts", T.pair_key(F.col("p.a"), F.col("p.b")).alias("kwp")).agg(F.count(F.lit(1)).alias("n"))


def popular_counts(posts: DataFrame, floor: int = DEFAULT.hourly_floor) -> DataFrame:
    return pair_counts(posts).where(F.col("n") >= floor)


def popular_buckets(posts: DataFrame, floor: int = DEFAULT.hourly_floor) -> DataFrame:
    """``ts, kwp, id`` of the buckets of at least ``floor`` posts in their file."""
    pairs = posts.select("ts", "id", F.explode("kwpairs").alias("p")).select("ts", "id", T.pair_key(F.col("p.a"), F.col("p.b")).alias("kwp"))
    popular = cut(popular_counts(posts, floor).select("ts", "kwp"))
    return pairs.join(small_or_not(popular), ["ts", "kwp"], "left_semi")


def redundant_pairs(posts: DataFrame, floor: float = DEFAULT.pair_removal) -> DataFrame:
    """``a, b, together, total``: neighbouring words that stand together in at least ``floor`` of the posts with both.

    Only neighbouring pairs are candidates, so the posts with both words are counted by a join of the candidates with
    the posts' own pairs (neighbours and others), not by a self-join of the words.
    """
    return _together(posts.select("id", "keywords"), floor)


def _near(posts: DataFrame) -> DataFrame:
    return cut(posts.select(F.explode(T.adjacent_pairs(F.col("keywords"))).alias("p")).select("p.a", "p.b").distinct())


def _pairs(posts: DataFrame, candidates: DataFrame) -> DataFrame:
    """The posts' pairs that are neighbours in some post, with ``_near`` 1 where they are. Pairs that never are go first."""
    marked = lambda words, near: F.transform(words, lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), F.lit(near).alias("_near")))
    every = F.concat(marked(T.adjacent_pairs(F.col("keywords")), 1), marked(T.keyword_pairs(F.col("keywords")), 0))
    rows = posts.select(*[c for c in posts.columns if c != "keywords"], F.explode(every).alias("p")).select("*", "p.*").drop("p")
    return rows.join(small_or_not(candidates), ["a", "b"], "left_semi")


def _together(posts: DataFrame, floor: float) -> DataFrame:
    once = _pairs(posts, _near(posts)).groupBy("a", "b", "id").agg(F.max("_near").alias("_near"))
    counts = once.groupBy("a", "b").agg(F.sum("_near").alias("together"), F.count(F.lit(1)).alias("total")).where("together > 0")
    return counts.where(F.col("together").cast("double") / F.col("total") >= floor)


def diversified(posts: DataFrame, pairs: DataFrame, least: int = 2) -> DataFrame:
    """``ts, id, kept``: posts that keep at least ``least`` keyword pairs without the redundant ones, and how many."""
    own = posts.select("ts", "id", F.explode("kwpairs").alias("p")).select("ts", "id", "p.a", "p.b")
    kept = own.join(pairs.select("a", "b"), ["a", "b"], "left_anti")
    return kept.groupBy("ts", "id").agg(F.count(F.lit(1)).alias("kept")).where(F.col("kept") >= least)


def diversified_posts(posts: DataFrame, pairs: DataFrame, least: int = 2) -> DataFrame:
    """``ts, id, kwpairs``: the posts that keep at least ``least`` keyword pairs without the redundant ones, with these pairs."""
    own = posts.select("ts", "id", F.explode("kwpairs").alias("p")).select("ts", "id", "p.a", "p.b")
    kept = own.join(pairs.select("a", "b"), ["a", "b"], "left_anti")
    return kept.groupBy("ts", "id").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("kwpairs")).where(F.size("kwpairs") >= least)


def sticky_pairs(posts: DataFrame, lookback: int = DEFAULT.lookback, floor: float = DEFAULT.pair_removal) -> DataFrame:
    """``w, a, b, together, total``: the same for each file with the ``lookback`` files before it.

    Posts of one file only are counted by file and pair; those of several (the same id again) by their own spans.
    """
    dim = cut(hours(posts))
    last = dim.agg(F.max("ord")).first()[0] or 0
    numbered = posts.join(F.broadcast(dim), "ts").select("ord", "id", "keywords")  # one row a file
    several = cut(numbered.groupBy("id").agg(F.count_distinct("ord").alias("_n")).where("_n > 1").select("id"))
    both = _pairs(numbered, _near(numbered))
    again = small_or_not(several)
    length = lookback + 1
    counted = both.join(again, "id", "left_anti").groupBy("a", "b", "ord").agg(F.sum("_near").alias("together"), F.count(F.lit(1)).alias("total"))
    change = lambda w, t, n: F.struct(w.alias("w"), t.cast("bigint").alias("together"), n.cast("bigint").alias("total"))
    t, n = F.col("together"), F.col("total")
    steps = counted.select("a", "b", F.explode(F.array(change(F.col("ord"), t, n), change(F.col("ord") + length, -t, -n))).alias("c"))
    held = both.join(again, "id", "left_semi").groupBy("a", "b", "id").agg(
        F.array_sort(F.collect_set("ord")).alias("_all"), F.array_sort(F.collect_set(F.when(F.col("_near") == 1, F.col("ord")))).alias("_some")
    )
    zero, one = F.lit(0), F.lit(1)
    ends = lambda places, t, n: F.flatten(F.transform(spans(places, length), lambda s: F.array(change(s["begin"], t, n), change(s["end"], -t, -n))))
    more = held.select("a", "b", F.explode(F.concat(ends(F.col("_all"), zero, one), ends(F.col("_some"), one, zero))).alias("c"))
    changes = steps.unionByName(more).select("a", "b", "c.*").groupBy("a", "b", "w").agg(F.sum("together").alias("together"), F.sum("total").alias("total"))
    sticky = (F.col("together") > 0) & (F.col("together").cast("double") / F.col("total") >= floor)
    return in_windows(changes, ["a", "b"], ["together", "total"], last, 1, sticky).select("w", "a", "b", "together", "total")
