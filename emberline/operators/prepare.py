"""From delivered posts to prepared ones: first deliveries, filters, keywords and keyword pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.config import DEFAULT, EngineConfig
from emberline.functions import text as T
from emberline.functions import tweets
from emberline.session import cut


def hours(posts: DataFrame) -> DataFrame:
    """``ts, ord``: the source files in order, numbered from 1. One row a file, so one task numbers them."""
    return posts.select("ts").distinct().withColumn("ord", F.row_number().over(Window.orderBy("ts")))


def unwrapped(raw: DataFrame) -> DataFrame:
    """``ts, line_no, id, text, lang, repost_lang`` of valid raw posts (``ts, line_no, post``): of reposts the innermost post's id and text."""
    inner = tweets.innermost(F.col("post"))
    rows = raw.where(tweets.is_valid(F.col("post")))
    return rows.select("ts", "line_no", inner["id"].alias("id"), inner["text"].alias("text"), F.col("post.lang").alias("lang"), F.col("post.retweeted_status.lang").alias("repost_lang"))


def first_seen(posts: DataFrame, scope: Sequence[str] = ("ts",), least_id: int = DEFAULT.least_id) -> DataFrame:
    """The first delivery of each valid id in each file (``scope`` ``("ts",)``) or overall (``()``)."""
    order = Window.partitionBy(*scope, "id").orderBy("ts", "line_no")
    valid = posts.where(F.col("id") >= least_id)
    return valid.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def with_words(posts: DataFrame, words: Sequence[str]) -> DataFrame:
    """Posts whose text holds one of the words, in any case."""
    low = F.lower("text")
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(low, F.lit(w))
    return posts.where(hit)


def in_language(posts: DataFrame, lang: str = "en") -> DataFrame:
    """Posts in a language; of a repost with a language of its own (``repost_lang``, if there is such a column) both count."""
    rows = posts.where(F.col("lang") == lang)
    return rows.where(F.coalesce(F.col("repost_lang") == lang, F.lit(True))) if "repost_lang" in posts.columns else rows


def keep_fields(posts: DataFrame, fields: Sequence[str], user_fields: Sequence[str] = ()) -> DataFrame:
    """The named fields, those that are there; of ``user``, if it is one of them and ``user_fields`` are named, only these."""
    own = []
    for f in fields:
        if f in posts.columns:
            there = [u for u in user_fields if u in posts.schema["user"].dataType.names] if f == "user" and user_fields else []
            own.append(F.struct(*[F.col(f"user.{u}").alias(u) for u in there]).alias("user") if there else F.col(f))
    return posts.select(*own)


def prepared(posts: DataFrame, config: EngineConfig = DEFAULT, search: Sequence[str] = (), written: bool = False) -> DataFrame:
    """``ts, id, text, keywords, kwpairs`` of the first deliveries with enough keywords; only with ``search`` words, if given.

    ``written`` writes the keywords once to the shared folder, for callers that read the posts more than once: the
    optimizer otherwise repeats the tokenizing in every filter that it derives from them.
    """
    rows = first_seen(posts.select("ts", "line_no", "id", "text"), least_id=config.least_id)
    rows = with_words(rows, search) if search else rows
    rows = rows.select("ts", "id", "text", T.keywords(F.col("text"), config).alias("keywords"))
    rows = rows.where(F.size("keywords") >= config.least_keywords)
    rows = cut(rows) if written else rows
    return rows.withColumn("kwpairs", T.keyword_pairs(F.col("keywords")))
