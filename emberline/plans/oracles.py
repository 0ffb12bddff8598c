"""SQL of the registered queries, for DuckDB over the same tables, written independently of the DataFrame code."""

from __future__ import annotations

# Fixed values, stated here by themselves so that a wrong constant of the engine shows.
STOP_WORDS = (
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before", "being",
    "below", "between", "both", "but", "by", "can", "did", "do", "does", "doing", "don", "down", "during", "each", "few", "for", "from", "further", "had",
    "has", "have", "having", "he", "her", "here", "hers", "herself", "him", "himself", "his", "how", "i", "if", "in", "into", "is", "it", "its", "itself",
    "just", "me", "more", "most", "my", "myself", "no", "nor", "not", "now", "of", "off", "on", "once", "only", "or", "other", "our", "ours", "ourselves",
    "out", "over", "own", "s", "same", "she", "should", "so", "some", "such", "t", "than", "that", "the", "their", "theirs", "them", "themselves", "then",
    "there", "these", "they", "this", "those", "through", "to", "too", "under", "until", "up", "very", "was", "we", "were", "what", "when", "where", "which",
    "while", "who", "whom", "why", "will", "with", "you", "your", "yours", "yourself", "yourselves",
)
EXTRA_WORDS = (
    "january", "feburary", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "thing", "would", "could", "hiring", "job",
)
PUNCTUATION = "!~\"#$%&()*+,-./:;<=>?@[\\]_'`{|}\n‘’"
SEPARATORS = (
    " ,.#?:;'\"/<>`!$%^&*()-=+~[]\\|{}\n\t"
    "©℗®℠™،、⟨⟩‒–—―…„“”»«›‹‘’：（）！？=【】　・⁄·†‡°″¡¿÷№ºª‰¶′‴§‖¦⁂❧☞‽⸮◊※⁀「」﹁﹂『』﹃﹄《》，一。►⋘▕▔▏┈⋙ー।؟"
)
SEARCH_WORDS, PROTEST_WORDS = ("rebel", "attack", "bombing"), ("protest",)
KEYWORD_LENGTH, LEAST_KEYWORDS, LEAST_ID = 4, 3, 100_000
WINDOW_HOURS, HOURLY_FLOOR, WINDOW_FLOOR, GAIN_FLOOR, LOOKBACK, PAIR_REMOVAL = 24, 3, 5, 0.003, 24, 0.9
TOP_TOKENS, CONSOLIDATE_DISTANCE, ABSORB_TWEET, ABSORB_BUCKET, ABSORB_LARGEST = 15, 0.75, 0.7, 0.5, 100
MEAN_FLOOR, PURIFY_BELOW, TRACK_TWEET, TRACK_BUCKET, FUSE_TWEET, FUSE_BUCKET = 0.03, 100, 0.7, 0.7, 0.7, 0.5


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _words(values) -> str:  # noqa: ANN001
    return "[" + ", ".join(map(_text, values)) + "]" if values else "[]::VARCHAR[]"


def _normal(text: str) -> str:
    low = rf"regexp_replace(regexp_replace(lower({text}), '(?:http:|https:)[^\n]*', '', 'g'), '@[a-z0-9_]+', '', 'g')"
    return rf"regexp_replace(translate({low}, {_text(PUNCTUATION)}, {_text(' ' * len(PUNCTUATION))}), '[^\x00-\x7F]', '', 'g')"


def _tokens(text: str, least: int, exclude=(), search=SEARCH_WORDS) -> str:  # noqa: ANN001
    drop = _words([*STOP_WORDS, *exclude])
    inside = " OR ".join(f"contains({_text(w)}, t)" for w in search) or "false"
    return f"list_filter(string_split({_normal(text)}, ' '), lambda t: length(t) >= {least} AND NOT list_contains({drop}, t) AND NOT ({inside}))"


_KEYWORDS = f"list_sort(list_distinct({_tokens('text', KEYWORD_LENGTH, EXTRA_WORDS)}))"

#: Prepared posts, their pairs and the numbered files.
_READY = f"""
firsts AS (
  SELECT ts, line_no, id, text FROM (
    SELECT *, row_number() OVER (PARTITION BY ts, id ORDER BY line_no) AS nth FROM tweet WHERE id >= {LEAST_ID}) WHERE nth = 1),
ready AS (SELECT * FROM (SELECT ts, id, text, {_KEYWORDS} AS keywords FROM firsts WHERE text IS NOT NULL) WHERE len(keywords) >= {LEAST_KEYWORDS}),
numbered AS (SELECT ts, id, unnest(keywords) AS word, generate_subscripts(keywords, 1) AS place FROM ready),
near AS (SELECT x.ts, x.id, x.word AS a, y.word AS b FROM numbered x JOIN numbered y ON x.ts = y.ts AND x.id = y.id AND y.place = x.place + 1),
pairs AS (
  SELECT x.ts, x.id, x.word AS a, y.word AS b, x.word || '__' || y.word AS kwp
  FROM numbered x JOIN numbered y ON x.ts = y.ts AND x.id = y.id AND y.place >= x.place + 2),
counts AS (SELECT ts, kwp, count(*) AS n FROM pairs GROUP BY ts, kwp),
popular AS (SELECT ts, kwp, n FROM counts WHERE n >= {HOURLY_FLOOR}),
dim AS (SELECT ts, row_number() OVER (ORDER BY ts) AS ord FROM (SELECT DISTINCT ts FROM tweet)),
own_dim AS (SELECT ts, row_number() OVER (ORDER BY ts) AS ord FROM (SELECT DISTINCT ts FROM ready))
"""

_LEN = WINDOW_HOURS


def _entropy(*counts: str) -> str:
    smooth = [f"({c}::DOUBLE + 1e-9::DOUBLE)" for c in counts]
    total = "(" + " + ".join(smooth) + ")"
    return "(-(" + " + ".join(f"({s} / {total}) * log2({s} / {total})" for s in smooth) + "))"


_GAIN = f"({_entropy('(a + c)', '(b + d)')} + {_entropy('(a + b)', '(c + d)')} - {_entropy('a', 'b', 'c', 'd')})"

_WINDOWS = f"""
{_READY},
ws AS (SELECT ord AS w FROM dim WHERE ord >= {2 * _LEN}),
sums AS (
  SELECT w, kwp, coalesce(sum(n) FILTER (WHERE d.ord <= w - {_LEN}), 0)::BIGINT AS a, coalesce(sum(n) FILTER (WHERE d.ord > w - {_LEN}), 0)::BIGINT AS b
  FROM popular JOIN dim d USING (ts) JOIN ws ON d.ord <= w AND d.ord > w - {2 * _LEN} GROUP BY w, kwp),
held AS (SELECT DISTINCT ts, id FROM pairs JOIN popular USING (ts, kwp)),
totals AS (
  SELECT w, count(DISTINCT id) FILTER (WHERE d.ord <= w - {_LEN}) AS before, count(DISTINCT id) FILTER (WHERE d.ord > w - {_LEN}) AS current
  FROM held JOIN dim d USING (ts) JOIN ws ON d.ord <= w AND d.ord > w - {2 * _LEN} GROUP BY w),
wc AS (
  SELECT w::INTEGER AS w, kwp, a, b, greatest(before - a, 0) AS c, greatest(current - b, 0) AS d
  FROM sums JOIN totals USING (w) WHERE b >= {WINDOW_FLOOR}),
gains AS (SELECT *, round({_GAIN}, 6) + 0.0::DOUBLE AS ig FROM wc)
"""

_BURSTS = f"""
{_WINDOWS},
runs AS (
  SELECT w, kwp, a, b, c, d, ig, 0 AS held, (b >= a AND ig >= {GAIN_FLOOR}::DOUBLE) AS high FROM gains g
  WHERE NOT EXISTS (SELECT 1 FROM gains p WHERE p.kwp = g.kwp AND p.w = g.w - 1)
  UNION ALL
  SELECT g.w, g.kwp, g.a, g.b, g.c, g.d, g.ig, r.high::INTEGER,
    CASE WHEN r.high THEN g.b > g.a / 2.0::DOUBLE ELSE g.b >= g.a AND g.ig >= {GAIN_FLOOR}::DOUBLE END
  FROM runs r JOIN gains g ON g.kwp = r.kwp AND g.w = r.w + 1),
found AS (
  SELECT w, kwp, CASE WHEN held = 1 THEN -1000.0::DOUBLE ELSE ig END AS ig, a, b, c, d, held = 1 AS inherited FROM runs WHERE high)
"""

_CLUSTERS = f"""
{_BURSTS},
bucket_rows AS (
  SELECT f.w, f.kwp, p.ts, p.id, r.keywords FROM found f JOIN pairs p USING (kwp) JOIN popular o ON o.ts = p.ts AND o.kwp = p.kwp
  JOIN dim d ON d.ts = p.ts AND d.ord <= f.w AND d.ord > f.w - {_LEN} JOIN ready r ON r.ts = p.ts AND r.id = p.id),
token_n AS (SELECT w, kwp, token, count(*) AS n FROM (SELECT w, kwp, unnest(keywords) AS token FROM bucket_rows) GROUP BY w, kwp, token),
top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY w, kwp ORDER BY n DESC, token)::INTEGER AS rank FROM token_n) WHERE rank <= {TOP_TOKENS}),
sizes AS (SELECT w, kwp, count(*) AS size FROM top GROUP BY w, kwp),
meet AS (SELECT x.w, x.kwp AS a, y.kwp AS b, count(*) AS shared FROM top x JOIN top y ON x.w = y.w AND x.token = y.token AND x.kwp < y.kwp GROUP BY 1, 2, 3),
close AS (
  SELECT * FROM (SELECT m.w, a, b, 1.0::DOUBLE - shared::DOUBLE / (x.size + y.size - shared) AS dist FROM meet m
    JOIN sizes x ON x.w = m.w AND x.kwp = a JOIN sizes y ON y.w = m.w AND y.kwp = b) WHERE dist <= {CONSOLIDATE_DISTANCE}::DOUBLE)
"""

#: Posts of the general buckets, once each.
_BUCKETS = """
heads AS (
  SELECT bucket_id, min(ts) AS ts, min(pos) AS pos, min(signature) AS signature, bool_or(t_bucket) AS t_bucket, bool_or(i_bucket) AS i_bucket
  FROM general_bucket WHERE bucket_id IS NOT NULL GROUP BY bucket_id),
posts AS (
  SELECT bucket_id AS bucket, t.id AS id, min(ts) AS ts, min(t.text) AS text
  FROM (SELECT bucket_id, ts, unnest(twitter) AS t FROM general_bucket WHERE bucket_id IS NOT NULL) WHERE t.id IS NOT NULL GROUP BY 1, 2)
"""


def _members(name: str) -> str:
    text = "coalesce(text, '')"
    tokens = {
        "merge": _tokens(text, 1),
        "partition": f"list_distinct({_tokens(text, 0, EXTRA_WORDS)})",
        "purify": f"list_distinct({_tokens(text, 1, EXTRA_WORDS)})",
        "overlap": _tokens(text, 1, (), PROTEST_WORDS),
    }[name]
    return f"""
{_BUCKETS},
members AS (SELECT ts AS w, bucket, id, tokens, list_distinct(tokens) AS kinds FROM (SELECT *, {tokens} AS tokens FROM posts)),
held AS (SELECT w, bucket, id, len(kinds) AS n, unnest(kinds) AS token FROM members),
size AS (SELECT bucket, count(*) AS posts FROM members GROUP BY bucket)"""


def _matching(tweet: float, share: float, left: str = "members", right: str = "members", any_id: bool = False) -> str:
    """``found(w, a, b, matched, size)`` of two tables ``w, bucket, id, kinds``."""
    extra = "OR same > 0" if any_id else ""
    return f"""
alike AS (
  SELECT x.w, x.bucket AS a, x.id AS ida, y.bucket AS b, y.id AS idb FROM {left} x JOIN {right} y ON x.w = y.w
  WHERE x.id = y.id OR len(x.kinds) = 0 OR len(y.kinds) = 0
    OR len(list_intersect(x.kinds, y.kinds)) >= {tweet}::DOUBLE * least(len(x.kinds), len(y.kinds)) - 1e-9::DOUBLE),
met AS (
  SELECT w, a, b, count(DISTINCT ida) AS ma, count(DISTINCT idb) AS mb, count(*) FILTER (WHERE ida = idb) AS same FROM alike GROUP BY w, a, b),
size_a AS (SELECT w, bucket AS a, count(DISTINCT id) AS na FROM {left} GROUP BY 1, 2),
size_b AS (SELECT w, bucket AS b, count(DISTINCT id) AS nb FROM {right} GROUP BY 1, 2),
found AS (
  SELECT * EXCLUDE (same) FROM (
    SELECT w, a, b, CASE WHEN na < nb THEN ma ELSE mb END AS matched, CASE WHEN na < nb THEN na ELSE nb END AS size, same
    FROM met JOIN size_a USING (w, a) JOIN size_b USING (w, b)) WHERE matched::DOUBLE / size >= {share}::DOUBLE {extra})"""


_TRACK = f"""
{_members("merge").replace("members AS (SELECT ts AS w", "raw_members AS (SELECT ts").replace("held AS (SELECT w, bucket, id, len(kinds) AS n, unnest(kinds) AS token FROM members),", "").rsplit("size AS", 1)[0]}
dim AS (SELECT ts, row_number() OVER (ORDER BY ts)::INTEGER AS w FROM (SELECT DISTINCT ts FROM heads)),
members AS (SELECT d.w, m.bucket, m.id, m.kinds FROM raw_members m JOIN dim d USING (ts)),
own AS (SELECT d.w, h.bucket_id AS bucket, h.pos FROM heads h JOIN dim d USING (ts)),
earlier AS (SELECT w + 1 AS w, bucket, id, kinds FROM members),
{_matching(TRACK_TWEET, TRACK_BUCKET, "earlier", "members")},
ranked AS (SELECT f.w, f.b AS bucket, f.a AS parent, row_number() OVER (PARTITION BY f.w, f.b ORDER BY o.pos, f.a) AS nth FROM found f JOIN own o ON o.bucket = f.a AND o.w = f.w - 1),
linked AS (SELECT o.w, o.bucket, o.pos, r.parent FROM own o LEFT JOIN (SELECT * FROM ranked WHERE nth = 1) r ON r.w = o.w AND r.bucket = o.bucket),
chain AS (
  SELECT w, bucket, pos, bucket AS root FROM linked WHERE parent IS NULL
  UNION ALL SELECT l.w, l.bucket, l.pos, c.root FROM linked l JOIN chain c ON l.parent = c.bucket),
ids AS (SELECT bucket AS root, row_number() OVER (ORDER BY w, pos, bucket) - 1 AS event_id FROM linked WHERE parent IS NULL),
events AS (SELECT w, bucket, pos, event_id FROM chain JOIN ids USING (root)),
last AS (SELECT max(w) AS last FROM events),
reported AS (
  SELECT event_id, e.w, e.bucket, m.id, min(e.w) OVER (PARTITION BY event_id, m.id) AS first FROM events e JOIN members m ON m.w = e.w AND m.bucket = e.bucket),
ends AS (SELECT event_id, max(w) < any_value(last) AS closed FROM events CROSS JOIN last GROUP BY event_id),
summary AS (SELECT event_id, w, bucket, id, closed FROM reported JOIN ends USING (event_id) WHERE w = first)
"""

_PARTS = f"string_split(translate(array_to_string(list_filter(string_split(text, ' '), lambda x: NOT starts_with(x, 'http:') AND NOT starts_with(x, 'https:')), ' '), {_text(SEPARATORS)}, {_text(' ' * len(SEPARATORS))}), ' ')"
_POST_TOKENS = f"list_filter({_PARTS}, lambda x: x <> '')"
_POINT_WORDS = f"list_sort(list_distinct(list_transform(list_filter({_POST_TOKENS}, lambda x: length(x) >= 4 AND NOT starts_with(x, '@') AND NOT starts_with(x, 'RT')), lambda x: lower(x))))"
_POINT = f"CASE WHEN len({_POINT_WORDS}) >= 2 THEN {_POINT_WORDS} ELSE [] END"

_PAIR_STATS = """
raw_pairs AS (SELECT x.bucket, {value} AS v FROM members x JOIN members y ON x.bucket = y.bucket AND x.id < y.id),
sums AS (SELECT bucket, count(*) AS pairs, avg(v) AS mean, var_samp(v) AS variance FROM raw_pairs GROUP BY bucket)
SELECT bucket, pairs, round(mean, 6) + 0.0::DOUBLE AS mean, round(variance, 6) + 0.0::DOUBLE AS variance FROM sums"""
_SHARED = "len(list_intersect(x.kinds, y.kinds))"
_SHARES = "shares AS (SELECT bucket, token, count(*) AS df, count(*)::DOUBLE / any_value(posts) AS share FROM held JOIN size USING (bucket) GROUP BY bucket, token)"
_SUMS = "sums AS (SELECT bucket, any_value(posts) AS posts, count(DISTINCT token) AS kinds, count(*) AS total FROM held JOIN size USING (bucket) GROUP BY bucket)"
_MOMENTS = """
fits AS (
  SELECT {keys} CASE WHEN v <> 0 THEN round(m * (m * (1 - m) / v - 1), 4) + 0.0::DOUBLE END AS alpha, CASE WHEN v <> 0 THEN round((1 - m) * (m * (1 - m) / v - 1), 4) + 0.0::DOUBLE END AS beta
  FROM (SELECT {keys} sum(share) / count(*) AS m, round(sum(share * share) / count(*) - (sum(share) / count(*)) * (sum(share) / count(*)), 12) AS v FROM shares {group}))"""

_FUSED = f"""{_members("merge")},
        t_side AS (SELECT m.* FROM members m JOIN heads h ON h.bucket_id = m.bucket WHERE t_bucket AND NOT i_bucket),
        i_side AS (SELECT m.* FROM members m JOIN heads h ON h.bucket_id = m.bucket WHERE i_bucket AND NOT t_bucket),
        {_matching(FUSE_TWEET, FUSE_BUCKET, "t_side", "i_side", any_id=True)},
        both_ways AS (SELECT w, a, b FROM found UNION SELECT w, b, a FROM found),
        reached AS (SELECT ts AS w, bucket_id AS v, bucket_id AS r FROM heads UNION SELECT e.w, x.v, e.b FROM reached x JOIN both_ways e ON e.w = x.w AND e.a = x.r),
        roots AS (SELECT w, v AS bucket, min(r) AS root FROM reached GROUP BY w, v)"""

#: Rounds of absorbing that the SQL lays out; the tables take fewer.
ROUNDS = 6


def _absorbing() -> str:
    """Tables m1, m2, ... (``w, bucket, id, kinds``), each after one more round, and r1, r2, ... with the new bucket of each one that moved."""
    out = []
    for k in range(1, ROUNDS + 1):
        m = f"m{k - 1}"
        merged = f" WHERE w IN (SELECT w FROM r{k - 1})" if k > 1 else ""  # only where something merged can more merge
        out.append(f"""
small{k} AS MATERIALIZED (SELECT * FROM {m} SEMI JOIN (SELECT w, bucket FROM {m} GROUP BY w, bucket HAVING count(*) <= {ABSORB_LARGEST}) USING (w, bucket){merged}),
alike{k} AS (
  SELECT x.w, x.bucket AS a, x.id AS ida, y.bucket AS b, y.id AS idb FROM small{k} x JOIN small{k} y ON x.w = y.w AND x.bucket <> y.bucket
  WHERE x.id = y.id OR len(x.kinds) = 0 OR len(y.kinds) = 0
    OR len(list_intersect(x.kinds, y.kinds)) >= {ABSORB_TWEET}::DOUBLE * least(len(x.kinds), len(y.kinds)) - 1e-9::DOUBLE),
met{k} AS (SELECT w, a, b, count(DISTINCT ida) AS ma, count(DISTINCT idb) AS mb FROM alike{k} GROUP BY w, a, b),
size{k} AS (SELECT w, bucket, count(*) AS n FROM small{k} GROUP BY w, bucket),
near{k} AS MATERIALIZED (
  SELECT w, a, b FROM met{k} JOIN (SELECT w, bucket AS a, n AS na FROM size{k}) USING (w, a) JOIN (SELECT w, bucket AS b, n AS nb FROM size{k}) USING (w, b)
  WHERE (CASE WHEN na < nb THEN ma ELSE mb END)::DOUBLE / least(na, nb) >= {ABSORB_BUCKET}::DOUBLE),
ties{k} AS (SELECT w, a, b FROM near{k} UNION SELECT w, b, a FROM near{k}),
far{k} AS (SELECT w, a AS v, a AS r FROM ties{k} UNION SELECT e.w, x.v, e.b FROM far{k} x JOIN ties{k} e ON e.w = x.w AND e.a = x.r),
r{k} AS MATERIALIZED (SELECT w, v AS bucket, min(r) AS root FROM far{k} GROUP BY w, v),
m{k} AS MATERIALIZED (
  SELECT w, coalesce(root, bucket) AS bucket, id, min(kinds) AS kinds FROM {m} LEFT JOIN r{k} USING (w, bucket) GROUP BY w, coalesce(root, bucket), id)""")
    return ",".join(out)


_ABSORBED = _absorbing()


def _homes() -> str:
    """``h``: of each bucket of m0 the one that holds it after all rounds."""
    out = "SELECT w, b0, b0 AS b FROM origins"
    for k in range(1, ROUNDS + 1):
        out = f"SELECT h.w, h.b0, coalesce(t.root, h.b) AS b FROM ({out}) h LEFT JOIN r{k} t ON t.w = h.w AND t.bucket = h.b"
    return out


ORACLES = {
    "normalize_text": f"SELECT ts, line_no, {_normal('text')} AS clean FROM tweet",
    "tokenize": f"SELECT ts, line_no, array_to_string(t, ' ') AS tokens, len(t)::INTEGER AS n FROM (SELECT ts, line_no, {_tokens('text', 1)} AS t FROM tweet WHERE text IS NOT NULL)",
    "keyword_sets": f"WITH {_READY} SELECT ts, id, array_to_string(keywords, ' ') AS keywords, len(keywords)::INTEGER AS n FROM ready",
    "kw_pairs": f"WITH {_READY} SELECT ts, id, count(*) AS n, min(kwp) AS first, max(kwp) AS last FROM pairs GROUP BY ts, id",
    "post_tokens": f"SELECT ts, line_no, array_to_string({_POST_TOKENS}, '|') AS tokens FROM tweet WHERE text IS NOT NULL",
    "point_from_text": f"SELECT ts, line_no, array_to_string({_POINT}, '|') AS point FROM tweet WHERE text IS NOT NULL",
    "render_text": r"""SELECT ts, line_no, 'a b/c+ ' || replace(replace(replace(coalesce(text, ''), '%', ''), '\/', '/'), chr(10), ' ') AS plain,
        replace('\/' || text, '\/', '/') AS browser FROM tweet""",
    "account_links": """SELECT ts, line_no, '<a href="http://twitter.com/account/redirect_by_id?id=' || coalesce(id::VARCHAR, 'null') || '">' || from_user || '</a>' AS link
        FROM tweet WHERE from_user IS NOT NULL""",
    "url_ids": "SELECT ts, line_no, id AS status_id FROM tweet",
    "raw_lines": r"""SELECT doc_id, (k - 1)::INTEGER AS line_no, (line::JSON ->> '$.id')::BIGINT AS id, coalesce(line::JSON ->> '$.id_str', line::JSON ->> '$.id') AS id_str, line::JSON ->> '$.text' AS text,
          line::JSON ->> '$.user.screen_name' AS name, (line::JSON ->> '$.user.id')::BIGINT AS source_id, false AS valid, line::JSON ->> '$.lang' AS lang
        FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS l FROM documents WHERE doc_kind = 'raw'))
        WHERE starts_with(line, '{') AND json_valid(line)""",
    "raw_line_counts": r"""
        SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE NOT (starts_with(ltrim(line), '{') AND json_valid(line))) AS bad,
          count(*) FILTER (WHERE starts_with(ltrim(line), '{') AND json_valid(line)) AS invalid
        FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\r?\n')) AS line FROM documents WHERE doc_kind = 'raw') WHERE trim(line) <> '' GROUP BY doc_id""",
    "dedup_first_seen": f"WITH {_READY} SELECT ts, line_no, id FROM firsts",
    "dedup_across_files": f"SELECT ts, line_no, id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, line_no) AS nth FROM tweet WHERE id >= {LEAST_ID}) WHERE nth = 1",
    "query_filter": "SELECT ts, line_no, id FROM tweet WHERE " + " OR ".join(f"contains(lower(text), {_text(w)})" for w in SEARCH_WORDS),
    "lang_filter": "SELECT ts, line_no, id, text FROM tweet WHERE lang = 'en'",
    "project_fields": "SELECT ts, line_no, text, id FROM tweet",
    "parse_created_at": "SELECT ts, line_no, epoch(created_at)::BIGINT - 19800 AS t0, epoch(created_at)::BIGINT AS t1, epoch(created_at)::BIGINT AS t2 FROM tweet WHERE created_at IS NOT NULL",
    "time_compare": """SELECT ts, line_no, late, late > 0 AS after, late >= 0 AS not_before FROM (
        SELECT ts, line_no, epoch(created_at)::BIGINT - (1709251200 + ts * 3600) AS late FROM tweet WHERE created_at IS NOT NULL)""",
    "tanimoto_distance": f"""
        WITH p AS (SELECT ts, line_no, {_POINT} AS p FROM tweet WHERE text IS NOT NULL),
        two AS (SELECT x.ts, x.line_no, len(list_intersect(x.p, y.p)) AS n, len(x.p) AS a, len(y.p) AS b FROM p x JOIN p y ON x.ts = y.ts AND y.line_no = x.line_no + 1)
        SELECT ts, line_no, CASE WHEN a + b - n > 0 THEN round(1 - n::DOUBLE / (a + b - n), 9) END AS dist,
          CASE WHEN a + b - n = 0 THEN 1.0::DOUBLE ELSE round(n::DOUBLE / (a + b - n), 9) END AS jaccard, CASE WHEN least(a, b) = 0 THEN 1.0::DOUBLE ELSE round(n::DOUBLE / least(a, b), 9) END AS overlap FROM two""",
    "vector_distance": """
        WITH v AS (SELECT x.vec_id, list_transform(x.embedding, lambda e: e::DOUBLE) AS p, list_transform(y.embedding, lambda e: e::DOUBLE) AS q
          FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)
        SELECT vec_id, round(1 - list_dot_product(p, q) / (list_dot_product(p, p) + list_dot_product(q, q) - list_dot_product(p, q)), 6) AS dist FROM v""",
    "hourly_buckets": f"WITH {_READY} SELECT ts, kwp, n FROM counts",
    "popular_buckets": f"WITH {_READY} SELECT ts, id, kwp FROM pairs JOIN popular USING (ts, kwp)",
    "stream_popular": f"WITH {_READY} SELECT ts, kwp, n FROM popular",
    "redundant_pairs": f"""
        WITH {_READY}, t AS (SELECT a, b, count(DISTINCT id) AS together FROM near GROUP BY a, b),
        every AS (SELECT a, b, id FROM near UNION ALL SELECT a, b, id FROM pairs), s AS (SELECT a, b, count(DISTINCT id) AS total FROM every GROUP BY a, b)
        SELECT a, b, together, total FROM t JOIN s USING (a, b) WHERE together::DOUBLE / total >= {PAIR_REMOVAL}::DOUBLE""",
    "diversify": f"""
        WITH {_READY}, t AS (SELECT a, b, count(DISTINCT id) AS together FROM near GROUP BY a, b),
        every AS (SELECT a, b, id FROM near UNION ALL SELECT a, b, id FROM pairs), s AS (SELECT a, b, count(DISTINCT id) AS total FROM every GROUP BY a, b),
        r AS (SELECT a, b FROM t JOIN s USING (a, b) WHERE together::DOUBLE / total >= {PAIR_REMOVAL}::DOUBLE)
        SELECT ts, id, count(*) AS kept FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.a = p.a AND r.b = p.b) GROUP BY ts, id HAVING count(*) >= 2""",
    "diversified_buckets": f"""
        WITH {_READY}, t AS (SELECT a, b, count(DISTINCT id) AS together FROM near GROUP BY a, b),
        every AS (SELECT a, b, id FROM near UNION ALL SELECT a, b, id FROM pairs), s AS (SELECT a, b, count(DISTINCT id) AS total FROM every GROUP BY a, b),
        r AS (SELECT a, b FROM t JOIN s USING (a, b) WHERE together::DOUBLE / total >= {PAIR_REMOVAL}::DOUBLE),
        kept AS (SELECT * FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.a = p.a AND r.b = p.b)),
        enough AS (SELECT ts, id FROM kept GROUP BY ts, id HAVING count(*) >= 2)
        SELECT ts, kwp, count(*) AS n FROM kept SEMI JOIN enough USING (ts, id) GROUP BY ts, kwp""",
    "sticky_pairs": f"""
        WITH {_READY}, wn AS (SELECT e.ord::INTEGER AS w, n.a, n.b, n.id FROM near n JOIN own_dim d USING (ts) JOIN own_dim e ON d.ord <= e.ord AND d.ord >= e.ord - {LOOKBACK}),
        wp AS (SELECT e.ord::INTEGER AS w, n.a, n.b, n.id FROM pairs n JOIN own_dim d USING (ts) JOIN own_dim e ON d.ord <= e.ord AND d.ord >= e.ord - {LOOKBACK}),
        t AS (SELECT w, a, b, count(DISTINCT id) AS together FROM wn GROUP BY w, a, b),
        every AS (SELECT * FROM wn UNION ALL SELECT * FROM wp), s AS (SELECT w, a, b, count(DISTINCT id) AS total FROM every GROUP BY w, a, b)
        SELECT w, a, b, together, total FROM t JOIN s USING (w, a, b) WHERE together::DOUBLE / total >= {PAIR_REMOVAL}::DOUBLE""",
    "diversify_recent": f"""
        WITH {_READY}, wn AS (SELECT e.ts AS wts, n.a, n.b, n.id FROM near n JOIN own_dim d USING (ts) JOIN own_dim e ON d.ord <= e.ord AND d.ord >= e.ord - {LOOKBACK}),
        wp AS (SELECT e.ts AS wts, n.a, n.b, n.id FROM pairs n JOIN own_dim d USING (ts) JOIN own_dim e ON d.ord <= e.ord AND d.ord >= e.ord - {LOOKBACK}),
        t AS (SELECT wts, a, b, count(DISTINCT id) AS together FROM wn GROUP BY ALL), every AS (SELECT * FROM wn UNION ALL SELECT * FROM wp),
        s AS (SELECT wts, a, b, count(DISTINCT id) AS total FROM every GROUP BY ALL),
        r AS (SELECT wts, a, b FROM t JOIN s USING (wts, a, b) WHERE together::DOUBLE / total >= {PAIR_REMOVAL}::DOUBLE)
        SELECT ts, id, count(*) AS kept FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.wts = p.ts AND r.a = p.a AND r.b = p.b) GROUP BY ts, id""",
    "window_counts": f"WITH {_WINDOWS} SELECT w, kwp, a, b, c, d FROM wc",
    "info_gain": f"WITH {_WINDOWS} SELECT w, kwp, ig FROM gains",
    "burst_detect": f"WITH {_WINDOWS} SELECT w, kwp, a, b, c, d, ig FROM gains WHERE b >= a AND ig >= {GAIN_FLOOR}::DOUBLE",
    "burst_carryover": f"WITH RECURSIVE {_BURSTS} SELECT w, kwp, ig, a, b, c, d, inherited FROM found",
    "topk_tokens": f"WITH RECURSIVE {_CLUSTERS} SELECT w, kwp, token, n, rank FROM top",
    "bucket_jaccard": f"WITH RECURSIVE {_CLUSTERS} SELECT w, a, b, round(dist, 9) AS dist FROM close",
    "consolidate": f"""
        WITH RECURSIVE {_CLUSTERS}, both_ways AS (SELECT w, a, b FROM close UNION SELECT w, b, a FROM close),
        reached AS (SELECT w, kwp AS v, kwp AS r FROM found UNION SELECT e.w, x.v, e.b FROM reached x JOIN both_ways e ON e.w = x.w AND e.a = x.r),
        roots AS (SELECT w, v AS kwp, min(r) AS root FROM reached GROUP BY w, v)
        SELECT w, root, array_to_string(list_sort(list_distinct(flatten(list(string_split(kwp, '__'))))), '__') AS signature, count(*) AS pairs FROM roots GROUP BY w, root""",
    "bipartite_match": f"WITH {_members('merge')}, {_matching(ABSORB_TWEET, ABSORB_BUCKET)} SELECT w, a, b, matched, size FROM found WHERE a <> b",
    "post_graph": f"""WITH {_members("partition")} SELECT x.bucket, x.id AS src, y.id AS dst, round({_SHARED}::DOUBLE / least(len(x.kinds), len(y.kinds)), 9) AS weight
        FROM members x JOIN members y ON x.bucket = y.bucket AND x.id < y.id WHERE {_SHARED} > 0""",
    "token_df": f"WITH {_members('purify')}, {_SHARES} SELECT bucket, token, df, round(share, 9) AS share FROM shares",
    "token_counts": f"WITH {_members('merge')} SELECT bucket, token, count(*) AS n FROM (SELECT bucket, unnest(tokens) AS token FROM members) GROUP BY bucket, token",
    "event_buckets": f"WITH {_members('purify')}, {_SUMS} SELECT * FROM sums WHERE total::DOUBLE / (kinds * posts) > {MEAN_FLOOR}::DOUBLE",
    "purify": f"WITH {_members('purify')}, {_SUMS} SELECT * FROM sums WHERE total::DOUBLE / (kinds * posts) > {MEAN_FLOOR}::DOUBLE AND posts < {PURIFY_BELOW}",
    "pairwise_stats": f"WITH {_members('purify')}, "
    + _PAIR_STATS.format(value=f"CASE WHEN len(x.kinds) + len(y.kinds) = 0 THEN 0.0::DOUBLE ELSE 1 - {_SHARED}::DOUBLE / (len(x.kinds) + len(y.kinds) - {_SHARED}) END"),
    "labelled_stats": f"WITH {_members('purify')}, kinds_of AS (SELECT bucket, any_value(posts) AS posts, count(DISTINCT token) AS kinds, count(*) AS total FROM held JOIN size USING (bucket) GROUP BY bucket), "
    + _PAIR_STATS.format(value=f"CASE WHEN len(x.kinds) + len(y.kinds) = 0 THEN 0.0::DOUBLE ELSE 1 - {_SHARED}::DOUBLE / (len(x.kinds) + len(y.kinds) - {_SHARED}) END").replace(
        "SELECT bucket, pairs, round", f"SELECT bucket, CASE WHEN total::DOUBLE / (kinds * posts) > {MEAN_FLOOR}::DOUBLE THEN 1 ELSE -1 END AS label, round"
    )
    + " JOIN kinds_of USING (bucket)",
    "overlap_stats": f"WITH {_members('overlap')}, "
    + _PAIR_STATS.format(value=f"CASE WHEN least(len(x.kinds), len(y.kinds)) = 0 THEN 1.0::DOUBLE ELSE {_SHARED}::DOUBLE / least(len(x.kinds), len(y.kinds)) END"),
    "share_vectors": f"""WITH {_members("purify")}, {_SHARES}, lists AS (SELECT bucket, list_reverse_sort(list(df)) AS l FROM shares GROUP BY bucket), longest AS (SELECT max(len(l)) AS m FROM lists)
        SELECT bucket, array_to_string(list_transform(list_concat(l, list_transform(range((m - len(l))::BIGINT), lambda i: 0)), lambda x: x::BIGINT::VARCHAR), ',') AS csv FROM lists CROSS JOIN longest""",
    "beta_moments": f"WITH {_members('purify')}, {_SHARES}, {_MOMENTS.format(keys='bucket,', group='GROUP BY bucket')} SELECT bucket, alpha, beta FROM fits",
    "whole_beta": f"WITH {_members('purify')}, {_SHARES}, {_MOMENTS.format(keys='', group='')} SELECT alpha, beta FROM fits",
    "expectation_split": f"""WITH {_members("purify")}, {_SHARES}, {_MOMENTS.format(keys="bucket,", group="GROUP BY bucket")}
        SELECT bucket, alpha / (alpha + beta) > {MEAN_FLOOR}::DOUBLE AS positive FROM fits WHERE alpha IS NOT NULL""",
    "inter_intra_similarity": f"""WITH {_members("overlap")}
        SELECT x.id % 2 = y.id % 2 AS inside, count(*) AS pairs, round(avg(CASE WHEN least(len(x.kinds), len(y.kinds)) = 0 THEN 1.0::DOUBLE ELSE {_SHARED}::DOUBLE / least(len(x.kinds), len(y.kinds)) END), 6) + 0.0::DOUBLE AS mean
        FROM members x JOIN members y ON x.bucket = y.bucket AND x.id < y.id GROUP BY 1""",
    "file_sample": "SELECT ts, line_no FROM tweet JOIN (SELECT ts, row_number() OVER (ORDER BY ts) AS ord FROM (SELECT DISTINCT ts FROM tweet)) USING (ts) WHERE (ord - 1) % 24 = 0",
    "exact_split": """
        WITH b AS (SELECT DISTINCT bucket_id FROM general_bucket WHERE bucket_id IS NOT NULL)
        SELECT bucket_id, row_number() OVER (ORDER BY md5('0:' || bucket_id::VARCHAR), bucket_id) <= ceil((SELECT count(*) FROM b) * 0.8) AS train FROM b""",
    "fuse_buckets": f"""
        WITH RECURSIVE {_FUSED},
        urls AS (SELECT DISTINCT bucket_id AS bucket, i.url AS url FROM (SELECT bucket_id, unnest(instagram) AS i FROM general_bucket) WHERE i.url IS NOT NULL)
        SELECT r.w, r.root, coalesce(array_to_string(list_sort(list_distinct(list(signature) FILTER (WHERE t_bucket AND signature <> ''))), '__'), '') AS signature,
          bool_or(t_bucket) AS t_bucket, bool_or(i_bucket) AS i_bucket, count(*) AS buckets,
          (SELECT count(DISTINCT m.id) FROM members m JOIN roots q ON q.bucket = m.bucket WHERE q.w = r.w AND q.root = r.root) AS posts,
          (SELECT count(DISTINCT u.url) FROM urls u JOIN roots q ON q.bucket = u.bucket WHERE q.w = r.w AND q.root = r.root) AS items
        FROM roots r JOIN heads h ON h.bucket_id = r.bucket GROUP BY r.w, r.root""",
    "fuse_lists": f"""
        WITH RECURSIVE {_FUSED},
        owned AS (
          SELECT r.w, r.root, m.id, min(row(CASE WHEN h.t_bucket THEN 0 ELSE 1 END, m.bucket, m.text)) AS f
          FROM (SELECT ts AS w, bucket, id, text FROM posts) m JOIN roots r ON r.w = m.w AND r.bucket = m.bucket JOIN heads h ON h.bucket_id = m.bucket GROUP BY r.w, r.root, m.id),
        tweets AS (SELECT w, root, string_agg(CASE WHEN f[3] IS NULL THEN id::VARCHAR ELSE id::VARCHAR || ' ' || f[3] END, chr(10) ORDER BY f[1], f[2], id) AS posts FROM owned GROUP BY w, root),
        pictures AS (
          SELECT r.w, r.root, string_agg(u.url, ' ' ORDER BY CASE WHEN h.t_bucket THEN 0 ELSE 1 END, u.bucket, u.url) AS urls
          FROM (SELECT DISTINCT ts AS w, bucket_id AS bucket, i.url AS url FROM (SELECT ts, bucket_id, unnest(instagram) AS i FROM general_bucket) WHERE i.url IS NOT NULL) u
          JOIN roots r ON r.w = u.w AND r.bucket = u.bucket JOIN heads h ON h.bucket_id = u.bucket GROUP BY r.w, r.root)
        SELECT r.w, r.root, coalesce(array_to_string(list_sort(list_distinct(list(signature) FILTER (WHERE t_bucket AND signature <> ''))), '__'), '') AS signature,
          bool_or(t_bucket) AS t_bucket, bool_or(i_bucket) AS i_bucket, coalesce(any_value(posts), '') AS posts, coalesce(any_value(urls), '') AS urls
        FROM roots r JOIN heads h ON h.bucket_id = r.bucket LEFT JOIN tweets t ON t.w = r.w AND t.root = r.root LEFT JOIN pictures p ON p.w = r.w AND p.root = r.root GROUP BY r.w, r.root""",
    "absorb_buckets": f"""
        WITH RECURSIVE {_members("merge")}, m0 AS (SELECT w, bucket, id, list_sort(kinds) AS kinds FROM members), {_ABSORBED}
        SELECT w, bucket, count(*) AS posts FROM m{ROUNDS} GROUP BY w, bucket""",
    "absorb": f"""
        WITH RECURSIVE {_CLUSTERS}, both_ways AS (SELECT w, a, b FROM close UNION SELECT w, b, a FROM close),
        reached AS (SELECT w, kwp AS v, kwp AS r FROM found UNION SELECT e.w, x.v, e.b FROM reached x JOIN both_ways e ON e.w = x.w AND e.a = x.r),
        clusters AS (SELECT w, v AS kwp, min(r) AS root FROM reached GROUP BY w, v),
        merged AS (
          SELECT b.w, c.root AS bucket, b.id, min(r.text) AS text FROM bucket_rows b JOIN clusters c ON c.w = b.w AND c.kwp = b.kwp JOIN ready r ON r.ts = b.ts AND r.id = b.id GROUP BY 1, 2, 3),
        m0 AS (SELECT w, bucket, id, list_sort(list_distinct({_tokens("coalesce(text, '')", 1)})) AS kinds FROM merged), {_ABSORBED},
        origins AS (SELECT DISTINCT w, bucket AS b0 FROM m0),
        homes AS ({_homes()}),
        words AS (SELECT h.w, h.b, array_to_string(list_sort(list_distinct(flatten(list(string_split(c.kwp, '__'))))), '__') AS signature FROM homes h JOIN clusters c ON c.w = h.w AND c.root = h.b0 GROUP BY h.w, h.b),
        last_sizes AS (SELECT w, bucket, count(*) AS posts FROM m{ROUNDS} GROUP BY w, bucket)
        SELECT s.w, d.signature, s.posts FROM last_sizes s JOIN words d ON d.w = s.w AND d.b = s.bucket""",
    "track_parent": f"WITH RECURSIVE {_TRACK} SELECT w, bucket, pos, parent FROM linked",
    "track_events": f"WITH RECURSIVE {_TRACK} SELECT w, bucket, pos, event_id FROM events",
    "track_summary": f"WITH RECURSIVE {_TRACK} SELECT event_id, w, bucket, id, closed FROM summary",
    "track_length": f"WITH RECURSIVE {_TRACK} SELECT event_id, count(DISTINCT w) AS windows FROM events JOIN ends USING (event_id) WHERE closed GROUP BY event_id",
    "closed_events": f"""WITH RECURSIVE {_TRACK}, lines AS (
          SELECT event_id, w, w::VARCHAR || ': ' || string_agg(id::VARCHAR, ' ' ORDER BY id) AS line FROM (SELECT DISTINCT event_id, w, id FROM summary WHERE closed) GROUP BY event_id, w)
        SELECT event_id, string_agg(line, chr(10) ORDER BY w) AS report FROM lines GROUP BY event_id""",
    "closed_events_json": f"""WITH RECURSIVE {_TRACK}, lines AS (SELECT event_id, w, list_sort(list_distinct(list(id))) AS ids FROM summary WHERE closed GROUP BY event_id, w)
        SELECT event_id, to_json({{'event_id': event_id, 'windows': list({{'w': w, 'ids': ids}} ORDER BY w)}})::VARCHAR AS event FROM lines GROUP BY event_id""",
    "file_page": "SELECT DISTINCT ts FROM tweet ORDER BY ts LIMIT 10 OFFSET 10",
    "text_report": r"""
        WITH one AS (SELECT DISTINCT ts, pos, bucket_id, signature, t_bucket, i_bucket, twitter, instagram FROM general_bucket),
        n AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY pos, bucket_id) AS k FROM one)
        SELECT ts, bucket_id, array_to_string(list_concat(
            ['==================================', k::VARCHAR || '. ' || coalesce(signature, ''), 'Bucket type: ' || CASE WHEN t_bucket AND i_bucket THEN 'I-bucket and T-bucket'
              WHEN i_bucket THEN 'I-bucket' WHEN t_bucket THEN 'T-bucket' ELSE 'Error' END, ''],
            coalesce(list_transform(twitter, lambda t: chr(9) || '*** <' || coalesce(t.id::VARCHAR, '') || '> ' || coalesce(t.text, '')), []),
            CASE WHEN len(instagram) > 0 THEN [chr(10) || chr(9) || chr(9) || '----------Instagram----------' || chr(10)] ELSE [] END,
            coalesce(list_transform(instagram, lambda i: chr(9) || '+++ (' || (list_position(instagram, i) - 1)::VARCHAR || ') [' || coalesce(i.name, '') || ']' || chr(10) || chr(9) || chr(9) || ' tags: ' || coalesce(array_to_string(i.tags, ', '), '')
              || chr(10) || chr(9) || chr(9) || ' url: ' || coalesce(i.url, '')), [])), chr(10)) || chr(10) || chr(10) AS report FROM n""",
    "item_bucket_rows": """SELECT ts + 5 AS ts, '' AS signature, false AS t_bucket, true AS i_bucket, coalesce(len(twitter), -1)::INTEGER AS posts, coalesce(len(instagram), -1)::INTEGER AS items
        FROM general_bucket WHERE i_bucket""",
}
