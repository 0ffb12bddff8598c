import itertools
import random
from dataclasses import replace
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from emberline.config import WHOLE, EngineConfig
from emberline.operators import buckets, cluster, components, detect, fusion, match, prepare, stats, track
from emberline.session import ensure_checkpoint_dir
from emberline.sources.files import read_stage, write_csv, write_stage

POSTS = "ts bigint, line_no bigint, id bigint, text string"
READY = "ts bigint, id bigint, keywords array<string>, kwpairs array<struct<a:string,b:string>>"
MEMBERS = "w bigint, bucket bigint, id bigint, tokens array<string>"


def test_first_seen(spark):
    rows = [(0, 0, 99_999, "a"), (0, 1, 100_000, "b"), (0, 2, 100_000, "c"), (1, 0, 100_000, "d"), (1, 1, None, "e")]
    df = spark.createDataFrame(rows, POSTS)
    assert sorted(r.text for r in prepare.first_seen(df).collect()) == ["b", "d"]
    assert [r.text for r in prepare.first_seen(df, ()).collect()] == ["b"]


def test_prepared_needs_three_keywords(spark):
    df = spark.createDataFrame([(0, 0, 100_000, "alpha beta gamma"), (0, 1, 100_001, "alpha beta"), (0, 2, 100_002, None)], POSTS)
    (row,) = prepare.prepared(df).collect()
    assert row.keywords == ["alpha", "beta", "gamma"]
    assert [(p.a, p.b) for p in row.kwpairs] == [("alpha", "gamma")]


def _ready(spark, rows):
    return spark.createDataFrame([(ts, i, w, [(w[0], w[2])]) for ts, i, w in rows], READY)


def test_popular(spark):
    rows = [(0, i, ["a", "b", "c"]) for i in range(3)] + [(1, i, ["a", "b", "c"]) for i in range(2)]
    assert [tuple(r) for r in buckets.popular_counts(_ready(spark, rows), 3).collect()] == [(0, "a__c", 3)]


def test_bursts_and_carry(spark):
    config = EngineConfig(window_hours=1, hourly_floor=1, window_floor=2, gain_floor=0.003)
    sizes = [1, 8, 5, 2, 9, 0]  # by hour; the pair is high in window 2, kept in 3 (5 > 4), dropped in 4 (2 < 2.5), high in 5
    rows, number = [], itertools.count()
    for ts, n in enumerate(sizes):
        rows += [(ts, next(number), ["k", "l", "m"]) for _ in range(n)] + [(ts, next(number), ["x", "y", f"z{i % 7}"]) for i in range(30)]
    posts = _ready(spark, rows)
    counts = detect.window_counts(posts, posts.select("ts"), config)
    got = {r.w: (r.a, r.b, r.inherited) for r in detect.bursts_carried(counts, config).where("kwp = 'k__m'").collect()}
    assert got == {2: (1, 8, False), 3: (8, 5, True), 5: (2, 9, False)}


def test_too_few_hours_give_no_window(spark):
    posts = _ready(spark, [(0, i, ["a", "b", "c"]) for i in range(9)])
    assert detect.window_counts(posts, posts.select("ts")).count() == 0


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent}


def test_close_buckets_at_the_threshold(spark):
    rows = [(1, "p", t, 1, 1) for t in "abcd"] + [(1, "q", t, 1, 1) for t in "dxyzabc"[:1]] + [(1, "r", t, 1, 1) for t in "vw"]
    tokens = spark.createDataFrame(rows, "w int, kwp string, token string, n bigint, rank int")
    assert [tuple(r) for r in cluster.close_buckets(tokens).collect()] == [(1, "p", "q", 0.75)]


def _members(spark, buckets_):
    return spark.createDataFrame([(w, b, i, t) for w, b, rows in buckets_ for i, t in rows], MEMBERS)


def _matches_by_hand(rows, tweet, share):
    out = set()
    for (wa, a, xs), (wb, b, ys) in itertools.permutations(rows, 2):
        if wa != wb:
            continue
        small, large = (xs, ys) if len(xs) < len(ys) else (ys, xs)
        ids = {i for i, _ in large}

        def alike(s, t):
            s, t = set(s), set(t)
            return not s or not t or len(s & t) >= tweet * min(len(s), len(t)) - 1e-9

        n = sum(i in ids or any(alike(t, u) for _, u in large) for i, t in small)
        if n / len(small) >= share:
            out.add((wa, a, b, n, len(small)))
    return out


def test_bucket_matches_against_all_pairs(spark):
    rng = random.Random(5)
    number = itertools.count(1)
    rows = []
    for w in (1, 2):
        for b in range(8):
            rows.append((w, w * 100 + b, [(next(number) if rng.random() < 0.9 else 1, rng.sample("abcdefgh", rng.randrange(0, 6))) for _ in range(rng.randrange(1, 6))]))
    rows = [(w, b, list({i: t for i, t in xs}.items())) for w, b, xs in rows]
    df = _members(spark, rows)
    got = {tuple(r) for r in match.bucket_matches(df, df, 0.7, 0.5).where("a <> b").collect()}
    assert got == _matches_by_hand(rows, 0.7, 0.5)


def test_absorb_reaches_a_fixpoint(spark):
    rows = [(1, 1, [(1, ["a"]), (2, ["b"])]), (1, 2, [(2, ["b"]), (3, ["c"])]), (1, 3, [(3, ["c"])]), (1, 4, [(9, ["z"])])]
    got = cluster.absorbed(_members(spark, rows)).groupBy("bucket").count().collect()
    assert sorted(map(tuple, got)) == [(1, 3), (4, 1)]


def test_absorbing_broadcasts_no_table_of_buckets(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(cluster, "small_or_not", lambda df, *rest: asked.append(df.columns) or df)
    rows = [(1, 1, [(1, ["a"]), (2, ["b"])]), (1, 2, [(2, ["b"]), (3, ["c"])]), (2, 3, [(3, ["c"])])]
    got = cluster.absorbed(_members(spark, rows)).groupBy("bucket").count().collect()
    assert sorted(map(tuple, got)) == [(1, 3), (3, 1)]
    assert all(columns == ["w"] for columns in asked)


def test_matching_makes_tokens_once_and_leaves_only_its_result(spark):
    made = spark.sparkContext.accumulator(0)

    def own(tokens):
        made.add(1)
        return tokens

    rows = [(1, b, [(10 * b + i, ["a", f"w{b}{i}"]) for i in range(5)]) for b in range(4)]
    df = _members(spark, rows).select("w", "bucket", "id", F.udf(own, "array<string>")("tokens").alias("tokens"))
    cut_tables = lambda: {p.name for p in Path(urlparse(spark.sparkContext.getCheckpointDir()).path).iterdir()}
    ensure_checkpoint_dir(spark)
    before = cut_tables()
    found = match.bucket_matches(df, df, 0.5, 0.5)
    assert found.where("a <> b").count() == 12
    assert made.value == 20
    assert len(cut_tables() - before) == 1


def test_large_buckets_are_not_absorbed(spark):
    rows = [(1, 1, [(i, ["a"]) for i in range(101)]), (1, 2, [(1, ["a"])])]
    assert cluster.absorbed(_members(spark, rows)).select("bucket").distinct().count() == 2


def test_partition_sizes(spark):
    near = lambda n, word: [(i, [word, f"{word}{i % 3}"]) for i in range(n)]
    far = [(i, [f"w{i}"]) for i in range(40)]
    two = [(i, ["p", "q", f"u{i}"]) for i in range(20)] + [(100 + i, ["r", "s", f"v{i}"]) for i in range(20)] + [(500, ["q", "r", "x1", "x2", "x3", "x4", "x5", "x6"])]
    rows = [(1, 1, near(30, "a")), (1, 2, near(31, "b")), (1, 3, near(201, "c")), (1, 4, far), (1, 5, two)]
    config = EngineConfig(mean_floor=0.2)
    got = {}
    for r in cluster.partitioned(_members(spark, rows), config).collect():
        got.setdefault((r.bucket, r.part), []).append(r.id)
    assert len(got[1, -1]) == 30
    assert len(got[2, 0]) == 31
    assert not any(b in (3, 4) for b, _ in got)
    assert sum(1 for b, _ in got if b == 5) >= 1


def test_stats_by_hand(spark):
    df = _members(spark, [(1, 1, [(1, ["a", "b"]), (2, ["b"]), (3, []), (4, [])])])
    (d,) = stats.distance_stats(df).collect()
    values = [1 - 0.5, 1, 1, 1, 1, 0]
    mean = sum(values) / 6
    assert (d.pairs, d.mean) == (6, round(mean, 6))
    assert d.variance == pytest.approx(sum((v - mean) ** 2 for v in values) / 5, abs=1e-6)
    (o,) = stats.overlap_stats(df).collect()
    assert (o.mean, o.variance) == (1.0, 0.0)


def test_purify_by_mean(spark):
    rows = [(1, n, [(i, [f"t{n}_{i}"]) for i in range(n)]) for n in (33, 34, 100)] + [(1, 5, [(1, [])])]
    assert [r.bucket for r in stats.purified(_members(spark, rows)).collect()] == [33]


def test_fusion_chain(spark):
    posts = _members(spark, [(1, 1, [(1, ["a"])]), (1, 2, [(2, ["b"])])])
    items = _members(spark, [(1, 3, [(1, ["x"]), (2, ["y"])]), (1, 4, [(7, ["q"])])])
    found = fusion.matched_sources(posts, items)
    heads = spark.createDataFrame([(1, b) for b in (1, 2, 3, 4)], "w bigint, bucket bigint")
    assert {r.bucket: r.root for r in fusion.fused(heads, found).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_tracking(spark):
    text = lambda *ids: [(i, [f"t{i}"]) for i in ids]
    rows = [(1, 10, text(1, 2)), (1, 11, text(1, 3)), (2, 20, text(1, 2)), (2, 21, text(3, 1)), (4, 40, text(1, 2)), (3, 30, text(8))]
    own = spark.createDataFrame([(w, b, b) for w, b, _ in rows], "w bigint, bucket bigint, pos bigint")
    members = _members(spark, rows)
    linked = track.parents(own, members)
    assert {r.bucket: r.parent for r in linked.collect()} == {10: None, 11: None, 20: 10, 21: 11, 30: None, 40: None}
    found = track.events(linked)
    ids = {r.bucket: r.event_id for r in found.collect()}
    assert ids == {10: 0, 11: 1, 20: 0, 21: 1, 30: 2, 40: 3}
    told = track.summary(found, members)
    assert not told.where("bucket in (20, 21)").count()
    assert {r.event_id for r in told.where("closed").collect()} == {0, 1, 2}
    assert {r.event_id: r.windows for r in track.track_length(found).collect()} == {0: 2, 1: 2, 2: 1}


def test_stage_tables(spark, tmp_path):
    path = str(tmp_path / "stage")
    assert read_stage(spark, path, "ts bigint, n bigint").count() == 0
    write_stage(spark.createDataFrame([(1, 5), (2, 6)], "ts bigint, n bigint"), path)
    write_stage(spark.createDataFrame([(2, 7)], "ts bigint, n bigint"), path)
    assert sorted(tuple(r) for r in read_stage(spark, path, "ts bigint, n bigint").select("ts", "n").collect()) == [(1, 5), (2, 7)]
    write_csv(spark.createDataFrame([(1, [0.5, 1.0])], "b int, v array<double>"), str(tmp_path / "csv"))
    assert spark.read.text(str(tmp_path / "csv")).first()[0] == '1,"0.5,1.0"'


def test_streams(spark, tmp_path):
    from emberline.streaming.replay import counts_by_time, first_seen_stream, open_events, post_stream

    rows = [(1, 0, 100_000, "2024-01-01 00:10:00", "en"), (1, 1, 100_000, "2024-01-01 00:20:00", "en"), (1, 2, 5, "2024-01-01 00:20:00", "en"), (2, 0, 100_001, "2024-01-01 05:00:00", "de")]
    df = spark.createDataFrame(rows, "ts bigint, line_no bigint, id bigint, created_at string, lang string").withColumn("created_at", F.to_timestamp("created_at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = post_stream(spark, str(tmp_path / "in"), df.schema)
    for name, out, mode in (("seen", first_seen_stream(stream), "append"), ("times", counts_by_time(stream), "complete")):
        out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("seen").count() == 2
    assert sorted(r.n for r in spark.table("times").collect()) == [1, 3]
    hours = spark.createDataFrame([(1, 1, 7), (2, 2, 7), (2, 3, 8), (3, 4, 8)], "w bigint, bucket bigint, event_id bigint")
    for w in (1, 2, 3):
        hours.where(F.col("w") == w).coalesce(1).write.mode("append").parquet(str(tmp_path / "tracked"))
    tracked = post_stream(spark, str(tmp_path / "tracked"), hours.schema, 1)
    open_events(tracked, str(tmp_path / "closed"), str(tmp_path / "open"), str(tmp_path / "state"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "closed/*")).collect()] == [(7, 2)]


def test_split_is_exact(spark):
    split = stats.exact_split(spark.range(101).withColumnRenamed("id", "k"), "k").groupBy("train").count().collect()
    assert {r.train: r["count"] for r in split} == {True: 81, False: 20}


def _mixed_posts(rng, n):
    return [(i * 7 % n, [f"g{i % 4}{rng.randrange(9)}" for _ in range(rng.randrange(0, 9))] + ["all"] * (rng.random() < 0.1)) for i in range(n)]


@pytest.mark.parametrize("weight", [None, 0.15, 0.3])
def test_large_buckets_are_cut_by_many_tasks_as_by_one(spark, weight):
    rng = random.Random(3)
    df = _members(spark, [(1, 1, _mixed_posts(rng, 90)), (1, 2, _mixed_posts(rng, 130))])
    one = EngineConfig(mean_floor=0.1, cut_weight=weight, huge_to=None, huge_kept=None)
    many = replace(one, cut_in_task=31, cut_chunk=9)
    got = sorted(map(tuple, cluster.partitioned(df, many).collect()))
    assert got and got == sorted(map(tuple, cluster.partitioned(df, one).collect()))


def test_no_huge_bucket_is_lost_without_caps(spark):
    near = lambda n, word: [(i, [word, f"{word}{i % 3}"]) for i in range(n)]
    df = _members(spark, [(1, b, near(31, f"n{b}")) for b in range(9)] + [(1, 50, near(450, "h"))])
    got = {(r.bucket, r.part): r["count"] for r in cluster.partitioned(df, WHOLE).groupBy("bucket", "part").count().collect()}
    assert got == {**{(b, 0): 31 for b in range(9)}, (50, 0): 450}


def test_huge_kept_follows_signature_and_first_post(spark):
    df = _members(spark, [(1, b, [(100 * (9 - b) + i, ["a"]) for i in range(31)]) for b in range(1, 4)])
    kept = lambda d: [r.bucket for r in cluster.partitioned(d, EngineConfig(huge_kept=1)).select("bucket").distinct().collect()]
    assert kept(df) == [3]
    assert kept(df.withColumn("signature", F.when(F.col("bucket") == 2, "a").otherwise("b"))) == [2]


def test_hours_in_several_batches_are_counted_whole(spark, tmp_path):
    from emberline.streaming.replay import post_stream, replay_popular

    text = "alpha bravo charlie"
    rows = [(1, k, 200_000 + k, text) for k in range(4)] + [(2, 9, 300_000, text)]
    for k, row in enumerate(rows):
        spark.createDataFrame([row], POSTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = post_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], POSTS).schema, 2)
    replay_popular(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert [(r.ts, r.kwp, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, "alpha__charlie", 4)]


def test_lines_of_files_keep_their_order(spark, tmp_path):
    import json

    from emberline.sources.files import line_counts, read_lines, read_posts

    post = lambda k, inner=None: json.dumps({"id": k, "text": f"t{k}", "created_at": "2012-11-04 05:12:34", "lang": "en", "user": {"id": 7, "screen_name": "u"}, **({"retweeted_status": inner} if inner else {})})
    nested = {"id": 900_001, "text": "mid", "lang": "de", "retweeted_status": {"id": 900_002, "text": "deep"}}
    lines = [post(500_000 + k) for k in range(300)] + ["", "not json", "__import__('os')", '{"id": 5}', post(900_000, nested)]
    (tmp_path / "7.60m.cluster_head.txt").write_text("\n".join(lines))
    (tmp_path / "8.60m.cluster_head.txt").write_text(post(1))
    (tmp_path / "timestamps.60m.cluster_head.txt").write_text(post(2))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_lines(spark, str(tmp_path)).where("ts = 7").orderBy("line_no").collect()
        assert [r.line for r in rows] == lines
        raw = read_posts(spark, str(tmp_path))
        found = prepare.unwrapped(raw).orderBy("ts", "line_no").collect()
        assert [r.id for r in found] == [500_000 + k for k in range(300)] + [900_002, 1]
        assert (found[300].text, found[300].repost_lang) == ("deep", "de")
        assert prepare.in_language(prepare.unwrapped(raw)).count() == 301
        assert [tuple(r) for r in line_counts(read_lines(spark, str(tmp_path)), "ts").orderBy("ts").collect()] == [(7, 304, 2, 1), (8, 1, 0, 0)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_common_tokens_meet_in_parts(spark):
    rng = random.Random(2)
    rows = [(1, b, [(i, ["all", *rng.sample("abcdefgh", 3)]) for i in range(40)]) for b in (1, 2)]
    df = _members(spark, rows)
    got = {(r.bucket, r.a, r.b): r.shared for r in stats.token_pairs(df, place_posts=7).collect()}
    assert got == {(b, i, j): len(set(s) & set(t)) for _, b, xs in rows for (i, s), (j, t) in itertools.combinations(xs, 2)}


def test_fields_of_users(spark):
    df = spark.sql("SELECT 1 AS id, named_struct('id', 7, 'location', 'x', 'geo_enabled', true) AS user")
    (row,) = prepare.keep_fields(df, ["id", "user", "none"], ["location", "missing"]).collect()
    assert row.asDict(True) == {"id": 1, "user": {"location": "x"}}
