"""SQL of the queries that DuckDB can express over the same tables."""

from __future__ import annotations

_TWEETS = """
rep AS (
  SELECT id, arg_min(coalesce(keywords, []), (ts, line_no)) AS keywords, arg_min(coalesce(kwpairs, []), (ts, line_no)) AS kwpairs
  FROM tweet WHERE id IS NOT NULL GROUP BY id),
words AS (
  SELECT id, list_filter(list_transform(keywords, lambda w: lower(trim(w))), lambda w: w IS NOT NULL AND w <> '') AS words, kwpairs FROM rep),
held AS (SELECT DISTINCT id, unnest(words) AS term FROM words),
df AS (SELECT term, count(*) AS n FROM held GROUP BY term),
total AS (SELECT count(*) AS total FROM rep)
"""

_P2 = f"""
WITH {_TWEETS},
every AS (SELECT unnest(words) AS term FROM words),
cf AS (SELECT term, count(*) AS occurrences FROM every GROUP BY term)
SELECT term, occurrences, df.n AS tweets,
  CASE WHEN df.n <= 2 THEN 'rare' WHEN df.n * 50 >= total THEN 'common' END AS mark
FROM df JOIN cf USING (term) CROSS JOIN total
"""

_P4 = f"""
WITH {_TWEETS},
pairs AS (
  SELECT id, lower(trim(p.a)) AS a, lower(trim(p.b)) AS b FROM (SELECT id, unnest(kwpairs) AS p FROM words)),
counted AS (
  SELECT least(a, b) AS term_a, greatest(a, b) AS term_b, count(DISTINCT id) AS n_ab
  FROM pairs WHERE a <> '' AND b <> '' AND a <> b GROUP BY 1, 2 HAVING count(DISTINCT id) >= 8),
scored AS (
  SELECT term_a, term_b, n_ab, coalesce(x.n, 0) AS n_a, coalesce(y.n, 0) AS n_b, total
  FROM counted LEFT JOIN df x ON x.term = term_a LEFT JOIN df y ON y.term = term_b CROSS JOIN total)
"""

_WORDS = "list_sort(list_distinct(list_filter(list_transform(string_split({0}, '__'), lambda w: lower(trim(w))), lambda w: w <> '')))"

_P1 = f"""
WITH {_TWEETS},
members AS (
  SELECT DISTINCT bucket_id, id FROM (SELECT bucket_id, unnest(twitter).id AS id FROM general_bucket) WHERE id IS NOT NULL),
tweet_size AS (SELECT id, count(*) AS n FROM held GROUP BY id),
bucket_size AS (SELECT bucket_id, count(*) AS n FROM members GROUP BY bucket_id),
tweet_pairs AS (
  SELECT x.id AS a, y.id AS b, count(*) AS both_hold FROM held x JOIN held y ON x.term = y.term AND x.id < y.id GROUP BY 1, 2),
bucket_pairs AS (
  SELECT x.bucket_id AS a, y.bucket_id AS b, count(*) AS both_hold
  FROM members x JOIN members y ON x.id = y.id AND x.bucket_id < y.bucket_id GROUP BY 1, 2)
SELECT 'tweet' AS kind, a AS key_a, b AS key_b FROM tweet_pairs
JOIN tweet_size x ON x.id = a JOIN tweet_size y ON y.id = b WHERE both_hold * 5 >= 4 * (x.n + y.n - both_hold)
UNION ALL
SELECT 'bucket', a, b FROM bucket_pairs
JOIN bucket_size x ON x.bucket_id = a JOIN bucket_size y ON y.bucket_id = b WHERE both_hold * 5 >= 3 * (x.n + y.n - both_hold)
"""

ORACLES = {
    "p1_found": _P1,
    "p1_classes": f"""
        WITH {_TWEETS},
        sets AS (SELECT id, list_sort(list(term)) AS terms FROM held GROUP BY id),
        classes AS (SELECT terms, min(id) AS class_id FROM sets GROUP BY terms),
        named AS (SELECT id, class_id FROM sets JOIN classes USING (terms)),
        own AS (SELECT class_id, len(terms) AS n, unnest(terms) AS term FROM classes),
        met AS (
          SELECT x.class_id AS a, y.class_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS both_hold
          FROM own x JOIN own y ON x.term = y.term AND x.class_id <> y.class_id GROUP BY 1, 2),
        degree AS (SELECT a AS class_id, count(*) AS links FROM met WHERE both_hold * 5 >= 4 * (na + nb - both_hold) GROUP BY a)
        SELECT id, class_id, coalesce(links, 0) AS links FROM named LEFT JOIN degree USING (class_id)""",
    "p2_counts": _P2,
    "p2_found": f"SELECT term, mark FROM ({_P2}) WHERE mark IS NOT NULL",
    "p2_ngrams": f"""
        WITH {_TWEETS},
        placed AS (SELECT id, words, unnest(range(1, len(words) + 1)) AS k FROM words),
        runs AS (SELECT id, words[k:k + n - 1] AS gram, n FROM placed CROSS JOIN (SELECT unnest([1, 2, 3]) AS n) WHERE k + n - 1 <= len(words))
        SELECT array_to_string(gram, ' ') AS ngram, n::INTEGER AS n, count(*) AS occurrences, count(DISTINCT id) AS tweets FROM runs GROUP BY gram, n""",
    "p3_found": """
        SELECT ts, line_no FROM (
          SELECT ts, line_no, id, row_number() OVER (PARTITION BY id ORDER BY ts, line_no) AS nth FROM tweet WHERE id IS NOT NULL)
        WHERE nth > 1 OR id IN (SELECT id FROM seen_id WHERE id IS NOT NULL)""",
    "p4_scores": f"""{_P4}
        SELECT term_a, term_b, n_ab, n_a, n_b,
          CASE WHEN n_a > 0 AND n_b > 0 THEN n_ab::DOUBLE * total / (n_a::DOUBLE * n_b) END AS lift,
          (n_ab + 0.5::DOUBLE) * (greatest(total - n_a - n_b + n_ab, 0) + 0.5::DOUBLE)
            / ((greatest(n_a - n_ab, 0) + 0.5::DOUBLE) * (greatest(n_b - n_ab, 0) + 0.5::DOUBLE)) AS odds_ratio,
          n_ab * total >= n_a * n_b * 4 AS exceeds
        FROM scored""",
    "p4_found": f"{_P4} SELECT term_a, term_b FROM scored WHERE n_ab * total >= n_a * n_b * 4",
    "p7_found": f"""
        WITH RECURSIVE named AS (
          SELECT DISTINCT ts, {_WORDS.format("signature")} AS words, bucket_id FROM general_bucket),
        tied AS (
          SELECT x.bucket_id AS a, y.bucket_id AS b FROM bucket_match m
          JOIN named x ON x.ts = m.ts_a AND len(x.words) > 0 AND x.words = {_WORDS.format("m.signature_a")}
          JOIN named y ON y.ts = m.ts_b AND len(y.words) > 0 AND y.words = {_WORDS.format("m.signature_b")}
          WHERE m.dist <= 0.75),
        both_ways AS (SELECT a, b FROM tied WHERE a <> b UNION SELECT b, a FROM tied WHERE a <> b),
        reached AS (SELECT a AS v, a AS w FROM both_ways UNION SELECT r.v, e.b FROM reached r JOIN both_ways e ON e.a = r.w)
        SELECT v AS bucket_id, min(w) AS group_id FROM reached GROUP BY v""",
}
