"""The registered queries of the engine's own operators, over the whole tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.config import DEFAULT, WHOLE
from emberline.functions import dates, measures, tweets
from emberline.functions import text as T
from emberline.operators import buckets as B
from emberline.operators import cluster, detect, fusion, match, prepare, report, stats, track
from emberline.plans import pipeline
from emberline.sources import read_table
from emberline.sources.files import item_buckets, line_counts, page, parse_lines
from emberline.session import cut


def posts(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "tweet")


def ready(spark: SparkSession, d: str, written: bool = True) -> DataFrame:
    return prepare.prepared(posts(spark, d), written=written)


def first_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Each general bucket once (a bucket delivered twice agrees in its flags and signature)."""
    rows = read_table(spark, d, "general_bucket").where("bucket_id IS NOT NULL")
    return rows.groupBy("bucket_id").agg(
        F.min("ts").alias("ts"), F.min("pos").alias("pos"), F.min("signature").alias("signature"), F.max("t_bucket").alias("t_bucket"), F.max("i_bucket").alias("i_bucket")
    )


def members(spark: SparkSession, d: str, name: str = "merge") -> DataFrame:
    """``w, bucket, id, text, tokens`` of the general buckets; of several texts of a post the smallest."""
    rows = read_table(spark, d, "general_bucket").where("bucket_id IS NOT NULL").select("ts", "bucket_id", F.explode("twitter").alias("t"))
    rows = rows.where("t.id IS NOT NULL").groupBy("bucket_id", F.col("t.id").alias("id")).agg(F.min("ts").alias("ts"), F.min("t.text").alias("text"))
    tokens = T.preset(F.coalesce("text", F.lit("")), name)
    return rows.select(F.col("ts").alias("w"), F.col("bucket_id").alias("bucket"), "id", "text", tokens.alias("tokens"))


def normalize_text(spark, d):
    return posts(spark, d).select("ts", "line_no", T.normalize(F.col("text")).alias("clean"))


def tokenize(spark, d):
    words = T.tokens(F.col("text"), 1, (), DEFAULT.search_words)
    return posts(spark, d).where("text IS NOT NULL").select("ts", "line_no", F.array_join(words, " ").alias("tokens"), F.size(words).alias("n"))


def keyword_sets(spark, d):
    return ready(spark, d, False).select("ts", "id", F.array_join("keywords", " ").alias("keywords"), F.size("keywords").alias("n"))


def kw_pairs(spark, d):
    pairs = ready(spark, d).select("ts", "id", F.explode("kwpairs").alias("p"))
    return pairs.groupBy("ts", "id").agg(F.count(F.lit(1)).alias("n"), F.min(T.pair_key(F.col("p.a"), F.col("p.b"))).alias("first"), F.max(T.pair_key(F.col("p.a"), F.col("p.b"))).alias("last"))


def post_tokens(spark, d):
    words = T.post_tokens(F.col("text"))
    return posts(spark, d).where("text IS NOT NULL").select("ts", "line_no", F.array_join(words, "|").alias("tokens"))


def point_from_text(spark, d):
    return posts(spark, d).where("text IS NOT NULL").select("ts", "line_no", F.array_join(T.point(F.col("text")), "|").alias("point"))


def render_text(spark, d):
    plain = T.render_plain(F.concat(F.lit("a%20b\\/c+ "), F.coalesce(F.regexp_replace("text", "%", ""), F.lit(""))))
    return posts(spark, d).select("ts", "line_no", plain.alias("plain"), T.render_browser(F.concat(F.lit("\\/"), "text")).alias("browser"))


def account_links(spark, d):
    return posts(spark, d).where("from_user IS NOT NULL").select("ts", "line_no", T.account_link(F.col("from_user"), F.col("id")).alias("link"))


def url_ids(spark, d):
    url = F.concat(F.lit("http://h.example/status/"), F.coalesce(F.col("id").cast("string"), F.lit("none")))
    return posts(spark, d).select("ts", "line_no", T.last_segment_id(url).alias("status_id"))


def _raw(spark, d):
    return read_table(spark, d, "documents").where("doc_kind = 'raw'").select("doc_id", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))


def raw_line_counts(spark, d):
    """The lines of the raw documents, and how many are no JSON object or no valid post."""
    return line_counts(_raw(spark, d), "doc_id")


def raw_lines(spark, d):
    """The JSON lines inside the raw documents, read as posts."""
    post = F.col("post")
    return parse_lines(_raw(spark, d)).select(
        "doc_id", "line_no", tweets.post_id(post).alias("id"), tweets.post_id_text(post).alias("id_str"), tweets.post_text(post).alias("text"),
        tweets.source_name(post).alias("name"), tweets.source_id(post).alias("source_id"), tweets.is_valid(post).alias("valid"), post["lang"].alias("lang"),
    )


def dedup_first_seen(spark, d):
    return prepare.first_seen(posts(spark, d)).select("ts", "line_no", "id")


def dedup_across_files(spark, d):
    return prepare.first_seen(posts(spark, d), ()).select("ts", "line_no", "id")


def query_filter(spark, d):
    return prepare.with_words(posts(spark, d), DEFAULT.search_words).select("ts", "line_no", "id")


def lang_filter(spark, d):
    return prepare.in_language(posts(spark, d)).select("ts", "line_no", "id", "text")


def project_fields(spark, d):
    return prepare.keep_fields(posts(spark, d), ["ts", "line_no", "text", "id", "nothing"])


def parse_created_at(spark, d):
    time = F.col("created_at")
    shapes = [F.date_format(time, "'Mon 'MMM dd HH:mm:ss '+0530 'yyyy"), F.date_format(time, "yyyy-MM-dd HH:mm:ss"), F.date_format(time, "'%Sat, 'dd MMM yyyy HH:mm:ss '+0000'")]
    rows = posts(spark, d).where("created_at IS NOT NULL").select("ts", "line_no", *[dates.to_unix(dates.parse_created_at(s)).alias(f"t{k}") for k, s in enumerate(shapes)])
    return rows


def time_compare(spark, d):
    hour = dates.from_unix(F.lit(1709251200) + F.col("ts") * 3600)
    rows = posts(spark, d).where("created_at IS NOT NULL")
    diff = measures.seconds_between(F.col("created_at").cast("timestamp"), hour)
    return rows.select("ts", "line_no", diff.alias("late"), (diff > 0).alias("after"), (diff >= 0).alias("not_before"))


def tanimoto_distance(spark, d):
    """The binary vectors of neighbouring posts of a file, compared."""
    rows = posts(spark, d).where("text IS NOT NULL").select("ts", "line_no", T.point(F.col("text")).alias("p"))
    after = rows.select("ts", (F.col("line_no") - 1).alias("line_no"), F.col("p").alias("q"))
    dist = measures.tanimoto_distance(F.col("p"), F.col("q"))
    return rows.join(after, ["ts", "line_no"]).select("ts", "line_no", F.round(dist, 9).alias("dist"), F.round(measures.jaccard(F.col("p"), F.col("q")), 9).alias("jaccard"), F.round(measures.overlap(F.col("p"), F.col("q")), 9).alias("overlap"))


def vector_distance(spark, d):
    """Each embedding against the next one."""
    rows = read_table(spark, d, "embeddings").select("vec_id", "embedding")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(after, "vec_id").select("vec_id", F.round(measures.weighted_tanimoto_distance(F.col("embedding"), F.col("other")), 6).alias("dist"))


def hourly_buckets(spark, d):
    return B.pair_counts(ready(spark, d))


def popular_buckets(spark, d):
    return B.popular_buckets(ready(spark, d))


def redundant_pairs(spark, d):
    return B.redundant_pairs(ready(spark, d)).select("a", "b", "together", "total")


def diversify(spark, d):
    rows = ready(spark, d)
    return B.diversified(rows, B.redundant_pairs(rows))


def diversified_buckets(spark, d):
    """Sizes of the hourly buckets of diversified posts, popular or not."""
    rows = ready(spark, d)
    return B.pair_counts(B.diversified_posts(rows, B.redundant_pairs(rows)))


def sticky_pairs(spark, d):
    return B.sticky_pairs(ready(spark, d)).select("w", "a", "b", "together", "total")


def diversify_recent(spark, d):
    """Posts of each file without the pairs that are sticky in it and the files before."""
    rows = ready(spark, d)
    sticky = B.sticky_pairs(rows).join(F.broadcast(prepare.hours(rows).withColumnRenamed("ord", "w")), "w").select("ts", "a", "b")
    own = rows.select("ts", "id", F.explode("kwpairs").alias("p")).select("ts", "id", "p.a", "p.b").join(sticky, ["ts", "a", "b"], "left_anti")
    return own.groupBy("ts", "id").agg(F.count(F.lit(1)).alias("kept"))


def window_counts(spark, d):
    return detect.window_counts(ready(spark, d), posts(spark, d))


def info_gain(spark, d):
    return detect.with_gain(window_counts(spark, d)).select("w", "kwp", "ig")


def burst_detect(spark, d):
    return detect.bursts(window_counts(spark, d))


def burst_carryover(spark, d):
    return detect.bursts_carried(window_counts(spark, d))


def _found(spark, d):
    return pipeline.detected(posts(spark, d))


def topk_tokens(spark, d):
    return cluster.top_tokens(_found(spark, d)[1])


def bucket_jaccard(spark, d):
    rows = cluster.close_buckets(cluster.top_tokens(_found(spark, d)[1]))
    return rows.withColumn("dist", F.round("dist", 9))


def consolidate(spark, d):
    return cluster.merged_buckets(cluster.consolidated(*_found(spark, d)))


def absorb(spark, d):
    """Consolidated buckets after absorbing each other: their words and how many posts they hold."""
    found, rows = _found(spark, d)
    rows = cut(rows)
    clusters = cut(cluster.consolidated(found, rows))
    own = pipeline.consolidated_members(found, rows, clusters=clusters)
    merged, names = cluster.absorbing(own.select("w", "bucket", "id", T.preset(F.col("text"), "merge").alias("tokens")))
    signs = cluster.merged_buckets(clusters).select("w", F.xxhash64("w", "root").alias("origin"), "signature")
    sizes = merged.groupBy("w", "bucket").agg(F.count(F.lit(1)).alias("posts"))
    return cluster.absorbed_signatures(names, signs).join(sizes, ["w", "bucket"]).select("w", "signature", "posts")


def pictures(spark, d):
    """The picture buckets of ``general_bucket`` in the general form, numbered by window."""
    heads = first_buckets(spark, d).where("i_bucket AND NOT t_bucket")
    number = F.broadcast(prepare.hours(posts(spark, d)).withColumnRenamed("ord", "w"))  # one row a file
    rows = read_table(spark, d, "general_bucket").where("bucket_id IS NOT NULL")
    items = rows.select("bucket_id", F.explode("instagram").alias("i")).where("i.url IS NOT NULL").groupBy("bucket_id", "i.url").agg(F.min(F.struct("i.name", "i.tags")).alias("_i"))
    items = items.groupBy("bucket_id").agg(F.array_sort(F.collect_list(F.struct("_i.name", "_i.tags", "url"))).alias("instagram"))
    tweets = members(spark, d).groupBy(F.col("bucket").alias("bucket_id")).agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("twitter"))
    named = heads.join(number, "ts").join(tweets, "bucket_id", "left").join(items, "bucket_id", "left")
    return named.select("w", F.col("bucket_id").alias("bucket"), F.lit("").alias("signature"), "t_bucket", "i_bucket", "twitter", "instagram")


def pipeline_events(spark, d):
    """The events of the whole chain with both sources: in how many windows each was seen, with how many posts."""
    told = pipeline.events(posts(spark, d), WHOLE, pictures(spark, d))["summary"]
    return told.groupBy("event_id").agg(F.min("w").alias("first"), F.max("w").alias("last"), F.count_distinct("id").alias("posts"), F.max("closed").alias("closed"))


def bipartite_match(spark, d):
    rows = members(spark, d)
    return match.bucket_matches(rows, rows, DEFAULT.absorb_tweet, DEFAULT.absorb_bucket).where("a <> b")


def absorb_buckets(spark, d):
    return cluster.absorbed(members(spark, d)).groupBy("w", "bucket").agg(F.count(F.lit(1)).alias("posts"))


def post_graph(spark, d):
    return cluster.post_graph(members(spark, d, "partition")).withColumn("weight", F.round("weight", 9))


def partition(spark, d):
    return cluster.partitioned(members(spark, d, "partition"), WHOLE)


def token_df(spark, d):
    return stats.token_shares(members(spark, d, "purify")).withColumn("share", F.round("share", 9))


def token_counts(spark, d):
    return stats.token_counts(members(spark, d))


def event_buckets(spark, d):
    return stats.event_buckets(members(spark, d, "purify"))


def purify(spark, d):
    return stats.purified(members(spark, d, "purify"))


def pairwise_stats(spark, d):
    return stats.distance_stats(members(spark, d, "purify"))


def labelled_stats(spark, d):
    """Distance statistics of buckets, labelled 1 if their mean token share makes them events, else -1."""
    rows = cut(members(spark, d, "purify"))
    mean = F.col("total").cast("double") / (F.col("kinds") * F.col("posts"))
    labels = stats.bucket_sums(rows).select("bucket", F.when(mean > DEFAULT.mean_floor, 1).otherwise(-1).alias("label"))
    return stats.labelled_stats(rows, labels)


def overlap_stats(spark, d):
    return stats.overlap_stats(members(spark, d, "overlap"))


def share_vectors(spark, d):
    rows = stats.share_vectors(members(spark, d, "purify"), fractions=False)
    return rows.select("bucket", F.array_join(F.transform("values", lambda x: x.cast("int").cast("string")), ",").alias("csv"))


def beta_moments(spark, d):
    return stats.beta_fit(members(spark, d, "purify"))


def whole_beta(spark, d):
    return stats.beta_fit(members(spark, d, "purify"), whole=True)


def expectation_split(spark, d):
    return stats.expectation_split(stats.beta_fit(members(spark, d, "purify")))


def inter_intra_similarity(spark, d):
    """Overlap of post pairs inside and across two parts of each bucket, by odd and even ids."""
    return stats.cluster_similarity(members(spark, d, "overlap").withColumn("part", F.pmod("id", F.lit(2))))


def file_sample(spark, d):
    return stats.every_nth(posts(spark, d), prepare.hours(posts(spark, d)), 24).select("ts", "line_no")


def exact_split(spark, d):
    return stats.exact_split(first_buckets(spark, d).select("bucket_id"), "bucket_id")


def fuse_buckets(spark, d):
    heads = first_buckets(spark, d).withColumnRenamed("bucket_id", "bucket").withColumnRenamed("ts", "w")
    rows = cut(members(spark, d))
    kind = heads.select("bucket", "t_bucket", "i_bucket")
    marked = rows.join(kind, "bucket")
    found = fusion.matched_sources(marked.where("t_bucket AND NOT i_bucket"), marked.where("i_bucket AND NOT t_bucket"))
    groups = cut(fusion.fused(heads, found))
    items = read_table(spark, d, "general_bucket").select(F.col("ts").alias("w"), F.col("bucket_id").alias("bucket"), F.explode("instagram.url").alias("url")).where("url IS NOT NULL")
    return fusion.fused_rows(groups, heads.select("w", "bucket", "signature", "t_bucket", "i_bucket"), rows.select("w", "bucket", "id"), items)


def fuse_lists(spark, d):
    """The fused buckets with their posts and items."""
    heads = first_buckets(spark, d).withColumnRenamed("bucket_id", "bucket").withColumnRenamed("ts", "w")
    rows = cut(members(spark, d))
    marked = rows.join(heads.select("bucket", "t_bucket", "i_bucket"), "bucket")
    found = fusion.matched_sources(marked.where("t_bucket AND NOT i_bucket"), marked.where("i_bucket AND NOT t_bucket"))
    groups = cut(fusion.fused(heads, found))
    items = read_table(spark, d, "general_bucket").select(F.col("ts").alias("w"), F.col("bucket_id").alias("bucket"), F.explode("instagram").alias("i")).where("bucket IS NOT NULL AND i.url IS NOT NULL")
    items = items.groupBy("w", "bucket", "i.url").agg(F.min("i.name").alias("name"), F.min("i.tags").alias("tags"))
    fused = fusion.fused_buckets(groups, heads, rows, items)
    texts = F.array_join(F.transform("twitter", lambda t: F.concat_ws(" ", t["id"].cast("string"), t["text"])), "\n")
    return fused.select("w", "root", "signature", "t_bucket", "i_bucket", texts.alias("posts"), F.array_join(F.transform("instagram", lambda i: i["url"]), " ").alias("urls"))


def _tracked(spark, d):
    heads = first_buckets(spark, d)
    number = F.broadcast(prepare.hours(heads).withColumnRenamed("ord", "w"))  # one row a window
    own = cut(heads.join(number, "ts").select("w", F.col("bucket_id").alias("bucket"), "pos"))
    rows = cut(members(spark, d).withColumnRenamed("w", "ts").join(number, "ts").select("w", "bucket", "id", "tokens"))
    return own, rows


def track_parent(spark, d):
    return track.parents(*_tracked(spark, d))


def track_events(spark, d):
    return track.events(track_parent(spark, d))


def track_summary(spark, d):
    own, rows = _tracked(spark, d)
    return track.summary(cut(track.events(track.parents(own, rows))), rows)


def track_length(spark, d):
    return track.track_length(track_events(spark, d))


def closed_events(spark, d):
    return track.closed_events(track_summary(spark, d))


def closed_events_json(spark, d):
    return track.closed_events_json(track_summary(spark, d))


def file_page(spark, d):
    """The second page of the source files' hours."""
    return page(prepare.hours(posts(spark, d)).select("ts"), 1)


def text_report(spark, d):
    one = read_table(spark, d, "general_bucket").dropDuplicates(["ts", "pos", "bucket_id", "twitter", "instagram"])
    return report.reports(one)


def item_bucket_rows(spark, d):
    """The picture buckets as their source would deliver them, read back."""
    raw = read_table(spark, d, "general_bucket").where("i_bucket").groupBy("ts", "bucket_id").agg(F.max("pos").alias("_p"), F.collect_list(F.struct("instagram", "twitter")).alias("data"))
    back = item_buckets(raw.select("ts", "data"))
    return back.select("ts", "signature", "t_bucket", "i_bucket", F.coalesce(F.size("twitter"), F.lit(-1)).alias("posts"), F.coalesce(F.size("instagram"), F.lit(-1)).alias("items"))


def stream_popular(spark, d):
    """The popular pairs of each hour, computed by a replayed stream."""
    import uuid

    from emberline.session import ensure_checkpoint_dir
    from emberline.streaming.replay import post_stream, replay_popular

    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    # A table may be one file or a directory of files; the pattern takes either.
    stream = post_stream(spark, f"{d}/tweet.parquet*", posts(spark, d).schema)
    replay_popular(stream, f"{root}/popular", f"{root}/state")
    return spark.read.parquet(f"{root}/popular").select(F.col("ts").cast("bigint").alias("ts"), "kwp", "n")


QUERIES = {
    f.__name__: f
    for f in (
        normalize_text, tokenize, keyword_sets, kw_pairs, post_tokens, point_from_text, render_text, account_links, url_ids, raw_lines, raw_line_counts,
        dedup_first_seen, dedup_across_files, query_filter, lang_filter, project_fields, parse_created_at, time_compare, tanimoto_distance, vector_distance,
        hourly_buckets, popular_buckets, redundant_pairs, diversify, diversified_buckets, sticky_pairs, diversify_recent,
        window_counts, info_gain, burst_detect, burst_carryover, topk_tokens, bucket_jaccard, consolidate, absorb, pipeline_events,
        bipartite_match, absorb_buckets, post_graph, partition, token_df, token_counts, event_buckets, purify, pairwise_stats, labelled_stats, overlap_stats,
        share_vectors, beta_moments, whole_beta, expectation_split, inter_intra_similarity, file_sample, exact_split,
        fuse_buckets, fuse_lists, track_parent, track_events, track_summary, track_length, closed_events, closed_events_json, file_page, text_report, item_bucket_rows, stream_popular,
    )
}
