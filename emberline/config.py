"""Settings of the engine; every operator takes what it needs as arguments, with these as defaults."""

from __future__ import annotations

from dataclasses import dataclass, replace

#: English function words that are no keywords (fixed values).
STOP_WORDS = (
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before", "being",
    "below", "between", "both", "but", "by", "can", "did", "do", "does", "doing", "don", "down", "during", "each", "few", "for", "from", "further", "had",
    "has", "have", "having", "he", "her", "here", "hers", "herself", "him", "himself", "his", "how", "i", "if", "in", "into", "is", "it", "its", "itself",
    "just", "me", "more", "most", "my", "myself", "no", "nor", "not", "now", "of", "off", "on", "once", "only", "or", "other", "our", "ours", "ourselves",
    "out", "over", "own", "s", "same", "she", "should", "so", "some", "such", "t", "than", "that", "the", "their", "theirs", "them", "themselves", "then",
    "there", "these", "they", "this", "those", "through", "to", "too", "under", "until", "up", "very", "was", "we", "were", "what", "when", "where", "which",
    "while", "who", "whom", "why", "will", "with", "you", "your", "yours", "yourself", "yourselves",
)

#: Extra words that are no keywords (fixed values, the misspelt month included).
EXTRA_WORDS = (
    "january", "feburary", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "thing", "would", "could", "hiring", "job",
)


@dataclass(frozen=True)
class EngineConfig:
    """Thresholds of all stages."""

    search_words: tuple[str, ...] = ("rebel", "attack", "bombing")
    protest_words: tuple[str, ...] = ("protest",)
    stop_words: tuple[str, ...] = STOP_WORDS
    extra_words: tuple[str, ...] = EXTRA_WORDS
    keyword_length: int = 4
    least_keywords: int = 3
    least_id: int = 100_000
    window_hours: int = 24
    hourly_floor: int = 3
    window_floor: int = 5
    gain_floor: float = 0.003
    top_tokens: int = 15
    consolidate_distance: float = 0.75
    absorb_tweet: float = 0.7
    absorb_bucket: float = 0.5
    absorb_largest: int | None = 100
    cut_weight: float | None = 0.15
    huge_from: int = 30
    huge_to: int | None = 200
    huge_kept: int | None = 7
    cut_in_task: int = 200
    cut_chunk: int = 1000
    least_part: int = 5
    mean_floor: float = 0.03
    purify_below: int = 100
    pair_removal: float = 0.9
    lookback: int = 24
    track_tweet: float = 0.7
    track_bucket: float = 0.7
    fuse_tweet: float = 0.7
    fuse_bucket: float = 0.5


DEFAULT = EngineConfig()
#: Without the original's caps on huge buckets, which only saved time: every bucket is cut. The registered queries run with it.
WHOLE = replace(DEFAULT, huge_to=None, huge_kept=None)
