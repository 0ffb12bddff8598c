"""The queries of the training-data operators."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.bpe import encode_texts
from emberline.llm.components import connected_components
from emberline.llm.cooccurrence import lift, odds_ratio, pair_counts, with_term_counts
from emberline.llm.encoding_repair import garbled, letters_of
from emberline.llm.first_rows import first_rows
from emberline.llm.language_models import fit, languages, named_language
from emberline.llm.ngram_counts import mark_terms, ngram_counts
from emberline.llm.packing import fill_containers
from emberline.llm.personal_data import find_items, learn_parts, redact
from emberline.llm.seen_keys import seen_before, seen_errors
from emberline.llm.sketch_forest import similar_pairs
from emberline.llm.terms import clean_terms, term_set
from emberline.session import cut
from emberline.sources import read_table

#: A pair is a case from so many tweets, and so many times more often than by chance.
PAIR_TWEETS, PAIR_LIFT = 8, 4
#: Tasks that share the suffixes of one first term.
FIRST_TERM_TASKS = 8
#: Largest distance at which two buckets count as tied.
TIED_DIST = 0.75


def _tweets(spark: SparkSession, sf_dir: str, columns: list[str]) -> tuple[DataFrame, int]:
    return first_rows(read_table(spark, sf_dir, "tweet"), "id", ["ts", "line_no"], columns)


#: Of tweets by their terms and of buckets by their members: least similarity and trees.
TWEETS_ALIKE, TWEET_TREES = Fraction(4, 5), 20
BUCKETS_ALIKE, BUCKET_TREES = Fraction(3, 5), 24


def _term_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    tweets, _ = _tweets(spark, sf_dir, ["keywords"])
    return tweets.select("id", term_set(F.col("keywords")).alias("items"))


def _member_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "general_bucket").select("bucket_id", F.col("twitter.id").alias("items"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of tweets with nearly the same terms and of buckets with nearly the same members."""
    tweets, _ = similar_pairs(_term_sets(spark, sf_dir), "id", "items", TWEETS_ALIKE, TWEET_TREES)
    buckets, _ = similar_pairs(_member_sets(spark, sf_dir), "bucket_id", "items", BUCKETS_ALIKE, BUCKET_TREES)
    both = tweets.withColumn("kind", F.lit("tweet")).unionByName(buckets.withColumn("kind", F.lit("bucket")))
    return both.select("kind", "key_a", "key_b").distinct()


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tweet with terms: its class (the smallest id with the same set) and the number of other classes alike."""
    links, groups = similar_pairs(_term_sets(spark, sf_dir), "id", "items", TWEETS_ALIKE, TWEET_TREES, copies=False)
    degree = links.select(F.explode(F.array("key_a", "key_b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    return groups.join(degree, "rep", "left").select(F.col("key").alias("id"), F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each term of the tweets' keywords: how often it occurs, how many tweets hold it, and its mark or null."""
    tweets, total = _tweets(spark, sf_dir, ["keywords"])
    counts = ngram_counts(tweets.select(clean_terms(F.col("keywords")).alias("terms")), "terms")
    marked = mark_terms(counts, total)
    return marked.select(F.col("ngram")[0].alias("term"), "occurrences", F.col("records").alias("tweets"), "mark")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms that are too rare or too common for keyword pairs."""
    return p2_counts(spark, sf_dir).where("mark IS NOT NULL").select("term", "mark")


def p2_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run of one to three neighbouring terms of the tweets' keywords: how often it occurs, and how many tweets hold it."""
    tweets, _ = _tweets(spark, sf_dir, ["keywords"])
    counts = ngram_counts(tweets.select(clean_terms(F.col("keywords")).alias("terms")), "terms", 3, FIRST_TERM_TASKS)
    return counts.select(F.array_join("ngram", " ").alias("ngram"), F.size("ngram").alias("n"), "occurrences", F.col("records").alias("tweets"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tweet rows whose id was in ``seen_id`` or in an earlier row; exact."""
    tweets, seen = read_table(spark, sf_dir, "tweet"), read_table(spark, sf_dir, "seen_id")
    return seen_before(tweets, "id", ["ts", "line_no"], seen).select("ts", "line_no")


def p3_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filters' rate of wrong answers, measured with known absent keys, without the exact check."""
    tweets, seen = read_table(spark, sf_dir, "tweet"), read_table(spark, sf_dir, "seen_id")
    errors = seen_errors(tweets, "id", ["ts", "line_no"], seen)
    return errors.withColumn("rate", F.col("false_positives") / F.col("absent"))


def p4_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word pairs of at least 8 tweets with their counts, lift and corrected odds ratio."""
    tweets, total = _tweets(spark, sf_dir, ["keywords", "kwpairs"])
    terms = ngram_counts(tweets.select(clean_terms(F.col("keywords")).alias("terms")), "terms")
    terms = cut(terms.select(F.col("ngram")[0].alias("term"), F.col("records").alias("n")))
    pairs = with_term_counts(pair_counts(tweets, "kwpairs", total, PAIR_TWEETS, vocabulary=terms), terms)
    n, n_a, n_b = F.col("n"), F.col("n_a"), F.col("n_b")
    scored = pairs.withColumn("lift", lift(n, n_a, n_b, total)).withColumn("odds_ratio", odds_ratio(n, n_a, n_b, total))
    exceeds = n * total >= n_a * n_b * PAIR_LIFT
    return scored.select("term_a", "term_b", n.alias("n_ab"), "n_a", "n_b", "lift", "odds_ratio", exceeds.alias("exceeds"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word pairs of at least 8 tweets that come at least 4 times as often as by chance."""
    return p4_scores(spark, sf_dir).where("exceeds").select("term_a", "term_b")


def _languages(spark: SparkSession, sf_dir: str, every: bool) -> DataFrame:
    samples = read_table(spark, sf_dir, "lang_sample")
    models = fit(samples, read_table(spark, sf_dir, "documents"))
    tweets = read_table(spark, sf_dir, "tweet").where("id IS NOT NULL").withColumn("named", named_language(F.col("lang")))
    return languages(tweets, ["id", "named"], "text", models, letters_of(samples), every)


def p5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage of a tweet that is a sentence, with its language and confidence, and the language its label names."""
    return _languages(spark, sf_dir, True).dropDuplicates(["id", "passage"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of a tweet's sentences that its label doesn't name."""
    found = _languages(spark, sf_dir, False).where("named IS NULL OR named <> found")
    return found.select("id", F.col("found").alias("lang")).distinct()


def p6_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled tweets and Instagram names with the restored text; ``complete`` if no sign of garbling is left."""
    letters = letters_of(read_table(spark, sf_dir, "lang_sample"))
    tweets = garbled(read_table(spark, sf_dir, "tweet").where("id IS NOT NULL"), ["id"], "text", letters)
    tweets = tweets.select(F.lit("tweet").alias("kind"), F.col("id").cast("string").alias("rec_key"), "text", "restored", "layers", "complete")
    items = read_table(spark, sf_dir, "general_bucket").select(F.explode("instagram").alias("item")).where("item.url IS NOT NULL").select("item.url", "item.name")
    names = garbled(items, ["url"], "name", letters)
    names = names.select(F.lit("instagram").alias("kind"), F.col("url").alias("rec_key"), F.col("name").alias("text"), "restored", "layers", "complete")
    return tweets.unionByName(names).dropDuplicates(["kind", "rec_key"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tweets and Instagram items with wrongly decoded characters."""
    return p6_repaired(spark, sf_dir).select("kind", "rec_key")


def _signature(words) -> F.Column:
    """The words of a signature, clean, distinct and sorted; null if there is none."""
    clean = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(words, "__"), lambda w: F.lower(F.trim(w))), lambda w: w != "")))
    return F.when(F.size(clean) > 0, F.concat_ws("__", clean))


def p7_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``a, b``: the bucket ids tied by a row of ``bucket_match``."""
    buckets = read_table(spark, sf_dir, "general_bucket").select("ts", _signature(F.col("signature")).alias("words"), "bucket_id")
    buckets = buckets.where("words IS NOT NULL AND bucket_id IS NOT NULL").groupBy("ts", "words").agg(F.min("bucket_id").alias("bucket_id"))
    match = read_table(spark, sf_dir, "bucket_match").where(F.col("dist") <= TIED_DIST)
    match = match.select(
        F.col("ts_a").alias("_ta"), _signature(F.col("signature_a")).alias("_wa"), F.col("ts_b").alias("_tb"), _signature(F.col("signature_b")).alias("_wb")
    )
    left = buckets.select(F.col("ts").alias("_ta"), F.col("words").alias("_wa"), F.col("bucket_id").alias("a"))
    right = buckets.select(F.col("ts").alias("_tb"), F.col("words").alias("_wb"), F.col("bucket_id").alias("b"))
    return match.join(left, ["_ta", "_wa"]).join(right, ["_tb", "_wb"]).select("a", "b")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bucket tied to another one, directly or through others, with the smallest bucket id of its group."""
    groups = connected_components(p7_edges(spark, sf_dir))
    return groups.select(F.col("vertex").alias("bucket_id"), F.col("component").alias("group_id"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of each document by byte_bpe_50k."""
    return encode_texts(read_table(spark, sf_dir, "documents"))


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each document, or of each piece of one above the capacity, for each capacity of ``pack_size``."""
    sizes = cut(encode_texts(read_table(spark, sf_dir, "documents"), counts=True))
    placed = fill_containers(sizes, "doc_id", "tokens", read_table(spark, sf_dir, "pack_size"))
    return placed.withColumnRenamed("key", "doc_id")


def p9_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each capacity the containers, the tokens in them and the share of unused space."""
    boxes = p9_fill(spark, sf_dir).groupBy("pack_id", "capacity", "container").agg(F.sum("tokens").alias("tokens"))
    use = boxes.groupBy("pack_id", "capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"))
    return use.withColumn("unused", 1 - F.col("tokens") / (F.col("containers") * F.col("capacity")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal information in the documents: its kind and the code points before it."""
    documents = read_table(spark, sf_dir, "documents")
    return find_items(documents, ["doc_id"], "text", learn_parts(documents, "text")).select("doc_id", "pii_type", "start_pos")


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with typed placeholders for personal information."""
    documents = read_table(spark, sf_dir, "documents")
    return redact(documents, ["doc_id"], "text", learn_parts(documents, "text"))


QUERIES = {
    "p1_found": p1_found,
    "p1_classes": p1_classes,
    "p2_found": p2_found,
    "p2_counts": p2_counts,
    "p2_ngrams": p2_ngrams,
    "p3_found": p3_found,
    "p3_errors": p3_errors,
    "p4_found": p4_found,
    "p4_scores": p4_scores,
    "p5_found": p5_found,
    "p5_passages": p5_passages,
    "p6_found": p6_found,
    "p6_repaired": p6_repaired,
    "p7_found": p7_found,
    "p8_ids": p8_ids,
    "p9_fill": p9_fill,
    "p9_use": p9_use,
    "p10_found": p10_found,
    "p10_redacted": p10_redacted,
}
