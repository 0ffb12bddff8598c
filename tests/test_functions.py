import math

import pytest
from pyspark.sql import functions as F

from emberline.functions import dates, measures, tweets
from emberline.functions import text as T
from emberline.sources.files import file_hour, parse_labelled, parse_lines, python_literals


def one(spark, *columns, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {_kind(v)}" for k, v in values.items()))
    return row.select(*columns).first()


def _kind(value):
    if isinstance(value, list):
        return "array<string>"
    if isinstance(value, int):
        return "bigint"
    return "string"


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ("See http://x.y and more\nnext line", "see  next line"),
        ("@User_1 it’s CAFÉ", " it s caf"),
        ("a—b ^ c\td", "ab ^ c\td"),
        ("", ""),
    ],
)
def test_normalize(spark, text, clean):
    assert one(spark, T.normalize(F.col("t")), t=text)[0] == clean


def test_tokens_drop_parts_of_search_words(spark):
    words = T.tokens(F.col("t"), 1, (), ("bombing",))
    assert one(spark, words, t="bomb bombing bombings the blast")[0] == ["bombings", "blast"]


def test_tokens_of_null(spark):
    assert one(spark, T.tokens(F.col("t")), t=None)[0] is None


@pytest.mark.parametrize(("n", "pairs"), [(0, []), (2, []), (3, ["k0k2"]), (4, ["k0k2", "k0k3", "k1k3"])])
def test_keyword_pairs(spark, n, pairs):
    got = one(spark, T.keyword_pairs(F.col("w")), w=[f"k{i}" for i in range(n)])[0]
    assert [p.a + p.b for p in got] == pairs


def test_adjacent_pairs(spark):
    assert [(p.a, p.b) for p in one(spark, T.adjacent_pairs(F.col("w")), w=["a", "b", "c"])[0]] == [("a", "b"), ("b", "c")]


def test_point_needs_two_words(spark):
    assert one(spark, T.point(F.col("t")), t="RT @name hello http://x")[0] == []
    assert one(spark, T.point(F.col("t")), t="Hello, WORLD hello")[0] == ["hello", "world"]


def test_render_plain(spark):
    assert one(spark, T.render_plain(F.col("t")), t="a%20b+c\\/d\ne")[0] == "a b+c/d e"
    assert one(spark, T.render_plain(F.col("t")), t="100% sure")[0] == "100% sure"


@pytest.mark.parametrize(
    ("a", "b", "jac", "over"), [([], [], 1.0, 1.0), (["x"], [], 0.0, 1.0), (["x"], ["y"], 0.0, 0.0), (["x", "y"], ["y"], 0.5, 1.0)]
)
def test_similarities(spark, a, b, jac, over):
    row = one(spark, measures.jaccard(F.col("a"), F.col("b")), measures.overlap(F.col("a"), F.col("b")), measures.jaccard(F.col("b"), F.col("a")), a=a, b=b)
    assert tuple(row) == (jac, over, jac)


@pytest.mark.parametrize(("counts", "value"), [((0, 5, 100, 95), 0.025462), ((2, 12, 98, 88), 0.030523), ((0, 1, 100, 99), 0.005018), ((5, 5, 95, 95), 0.0)])
def test_information_gain(spark, counts, value):
    a, b, c, d = counts
    got = one(spark, measures.information_gain(F.col("a"), F.col("b"), F.col("c"), F.col("d")), a=a, b=b, c=c, d=d)[0]
    assert math.isclose(got, value, abs_tol=1e-6)


@pytest.mark.parametrize(
    ("text", "seconds"),
    [
        ("Mon Sep 24 03:35:21 +0000 2012", 1348457721),
        ("2012-11-04 05:12:34", 1352005954),
        ("Mon, 24 Sep 2012 03:35:21 +0530", 1348457721 - 19800),
        ("%Mon, 24 Sep 2012 03:35:21 +0000", 1348457721),
        ("garbage", None),
        (None, None),
    ],
)
def test_dates(spark, text, seconds):
    assert one(spark, dates.to_unix(dates.parse_created_at(F.col("t"))), t=text)[0] == seconds


def test_legacy_offsets_use_whole_hours(spark):
    time = dates.parse_created_at(F.col("t"), legacy_offsets=True)
    assert one(spark, dates.to_unix(time), t="Mon, 24 Sep 2012 03:35:21 +0530")[0] == 1348457721 - 5 * 3600


def test_lines(spark):
    lines = spark.createDataFrame(
        [
            ('{"id": 123456, "text": "a", "created_at": "2012-11-04 05:12:34", "user": {"id": 7, "screen_name": "n"}}',),
            ("{'id': 5, 'text': 'b', 'from_user': 'm'}",),
            ("__import__('os').system('true')",),
            ("broken {",),
            ("",),
            (None,),
            ('{"id": 1, "text": "c", "retweeted_status": {"id": 9, "text": "inner"}}',),
        ],
        "line string",
    )
    post = F.col("post")
    rows = parse_lines(python_literals(lines)).select(tweets.post_id(post), tweets.post_text(post), tweets.source_name(post), tweets.is_valid(post), tweets.innermost(post)["id"])
    assert sorted(map(tuple, rows.collect())) == [(1, "inner", None, False, 9), (5, "b", "m", False, 5), (123456, "a", "n", True, 123456)]


def test_bad_line_can_fail(spark):
    with pytest.raises(Exception, match="bad line"):
        parse_lines(spark.createDataFrame([("broken {",)], "line string"), continue_on_error=False).collect()


def test_file_hours(spark):
    paths = spark.createDataFrame([("d/12.60m.txt",), ("d/.12",), ("d/__13",), ("d/timestamps5",), ("7.json",)], "p string")
    assert [r[0] for r in paths.select(file_hour(F.col("p"))).collect()] == [12, None, None, None, 7]


def test_labelled_reports(spark):
    text = "=====\n1. a__b\n\n*** one\n*** two\n-------\n*** three\n-------\n====\n2. c\n*** four\n------\n"
    rows = parse_labelled(spark.createDataFrame([(text,), (None,)], "value string")).collect()
    assert [(r.signature, r.cluster, r.texts) for r in rows] == [("a__b", 0, ["one", "two"]), ("a__b", 1, ["three"]), ("c", 0, ["four"])]
