"""Accessors of raw posts: structs with the nested user and an optional reposted post."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline.functions.dates import parse_created_at

USER = "struct<id:bigint,id_str:string,screen_name:string,location:string,profile_location:string,favourites_count:bigint,friends_count:bigint,followers_count:bigint,geo_enabled:boolean>"
_POST = f"id:bigint,id_str:string,text:string,created_at:string,lang:string,user:{USER},from_user:string,from_user_id:bigint,from_user_id_str:string,coordinates:string,geo:string"
#: A raw post with reposts two levels deep.
RAW_POST = f"struct<{_POST},retweeted_status:struct<{_POST},retweeted_status:struct<{_POST}>>>"


def source_id_text(post: Column) -> Column:
    """The account's id as text, from the fields that have it."""
    return F.coalesce(post["user"]["id_str"], post["user"]["id"].cast("string"), post["from_user_id_str"], post["from_user_id"].cast("string"))


def source_id(post: Column) -> Column:
    return F.coalesce(
        post["user"]["id"], post["user"]["id_str"].try_cast("bigint"), post["from_user_id"], post["from_user_id_str"].try_cast("bigint")
    )


def source_name(post: Column) -> Column:
    return F.coalesce(post["user"]["screen_name"], post["from_user"])


def post_id(post: Column) -> Column:
    return F.coalesce(post["id"], post["id_str"].try_cast("bigint"))


def post_id_text(post: Column) -> Column:
    return F.coalesce(post["id_str"], post["id"].cast("string"))


def post_text(post: Column) -> Column:
    """The reposted text, if there is one."""
    return F.coalesce(post["retweeted_status"]["text"], post["text"])


def is_valid(post: Column) -> Column:
    """Whether account, text, time and id are all there."""
    parts = [source_id_text(post), post_text(post), parse_created_at(post["created_at"]), post_id(post)]
    good = parts[0].isNotNull()
    for p in parts[1:]:
        good = good & p.isNotNull()
    return good


def coordinates(post: Column) -> Column:
    return post["coordinates"]


def geo(post: Column) -> Column:
    return post["geo"]


def location(post: Column) -> Column:
    return post["user"]["location"]


def profile_location(post: Column) -> Column:
    return post["user"]["profile_location"]


def innermost(post: Column) -> Column:
    """Id and text of the innermost reposted post."""
    levels = [post["retweeted_status"]["retweeted_status"], post["retweeted_status"], post]
    return F.coalesce(*[F.when(post_id(x).isNotNull(), F.struct(post_id(x).alias("id"), x["text"].alias("text"))) for x in levels])


def decode_bytes(raw: Column) -> Column:
    """UTF-8 bytes as text; bytes that aren't UTF-8 are read as Latin-1."""
    return F.coalesce(F.try_validate_utf8(raw.cast("string")), F.decode(raw, "ISO-8859-1"))
