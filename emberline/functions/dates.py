"""Dates of posts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_created_at(text: Column, legacy_offsets: bool = False) -> Column:
    """The UTC time of a post in one of three formats, a leading % aside; null for anything else.

    ``Mon Sep 24 03:35:21 +0000 2012``, ``2012-09-24 03:35:21`` (UTC) and ``Mon, 24 Sep 2012 03:35:21 +0000``. With
    ``legacy_offsets`` only the whole hours of an offset count, as older results have it.
    """
    clean = F.regexp_replace(F.trim(F.regexp_replace(text, "^%+", "")), "^[A-Za-z]{3},? ", "")
    if legacy_offsets:
        clean = F.regexp_replace(clean, "([+-]\\d\\d)\\d\\d", "$100")
    formats = ["MMM d HH:mm:ss Z yyyy", "yyyy-MM-dd HH:mm:ss", "d MMM yyyy HH:mm:ss Z"]
    return F.coalesce(*[F.try_to_timestamp(clean, F.lit(f)) for f in formats])


def to_unix(time: Column) -> Column:
    return F.unix_timestamp(time)


def from_unix(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)
