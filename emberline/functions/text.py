"""Text and keyword expressions, all inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline.config import DEFAULT, EngineConfig

#: Characters that become blanks when a text is normalized (fixed values).
PUNCTUATION = "!~\"#$%&()*+,-./:;<=>?@[\\]_'`{|}\n‘’"
#: Characters that separate words of a post; @ and _ don't (fixed values).
SEPARATORS = (
    " ,.#?:;'\"/<>`!$%^&*()-=+~[]\\|{}\n\t"
    "©℗®℠™،、⟨⟩‒–—―…„“”»«›‹‘’：（）！？=【】　・⁄·†‡°″¡¿÷№ºª‰¶′‴§‖¦⁂❧☞‽⸮◊※⁀「」﹁﹂『』﹃﹄《》，一。►⋘▕▔▏┈⋙ー।؟"
)


def normalize(text: Column) -> Column:
    """Lower case; links to the end of their line and mentions go; punctuation becomes blanks; other than ASCII goes."""
    low = F.regexp_replace(F.lower(text), "(?:http:|https:)[^\n]*", "")
    low = F.regexp_replace(low, "@[a-z0-9_]+", "")
    return F.regexp_replace(F.translate(low, PUNCTUATION, " " * len(PUNCTUATION)), "[^\\x00-\\x7F]", "")


def _literals(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def tokens(text: Column, least: int = 1, exclude: Sequence[str] = (), search: Sequence[str] = (), stop: Sequence[str] = DEFAULT.stop_words) -> Column:
    """Words of the normalized text, without stop words, excluded words, short ones and parts of a search word."""
    drop = _literals([*stop, *exclude])
    inside = _literals(search)
    keep = lambda t: (F.length(t) >= least) & ~F.array_contains(drop, t) & ~F.exists(inside, lambda w: F.contains(w, t))
    return F.filter(F.split(normalize(text), " "), keep)


def preset(text: Column, name: str, config: EngineConfig = DEFAULT) -> Column:
    """Tokens as a stage takes them: ``merge``, ``partition``, ``purify``, ``lab`` or ``overlap``."""
    if name == "merge":
        return tokens(text, 1, (), config.search_words, config.stop_words)
    if name == "partition":
        return F.array_distinct(tokens(text, 0, config.extra_words, config.search_words, config.stop_words))
    if name == "purify":
        return F.array_distinct(tokens(text, 1, config.extra_words, config.search_words, config.stop_words))
    if name == "lab":
        return tokens(text, 1, config.extra_words, config.protest_words, config.stop_words)
    if name == "overlap":
        return tokens(text, 1, (), config.protest_words, config.stop_words)
    raise ValueError(name)


def keywords(text: Column, config: EngineConfig = DEFAULT) -> Column:
    """Sorted distinct keywords of a post."""
    words = tokens(text, config.keyword_length, config.extra_words, config.search_words, config.stop_words)
    return F.array_sort(F.array_distinct(words))


def _bound(value: Column, use) -> Column:  # noqa: ANN001
    """``use(value)`` with the value computed once, also where the optimizer moves its expression into a filter."""
    return F.element_at(F.transform(F.array(value), use), 1)


def keyword_pairs(words: Column) -> Column:
    """All pairs of words that aren't neighbours, first word first; none below three words."""
    pair = lambda a: lambda b: F.struct(a.alias("a"), b.alias("b"))
    return _bound(words, lambda w: F.flatten(F.transform(w, lambda a, i: F.transform(F.slice(w, i + 3, F.greatest(F.size(w), F.lit(0))), pair(a)))))


def adjacent_pairs(words: Column) -> Column:
    """The pairs of neighbouring words."""
    pair = lambda a: lambda b: F.struct(a.alias("a"), b.alias("b"))
    return _bound(words, lambda w: F.flatten(F.transform(w, lambda a, i: F.transform(F.slice(w, i + 2, 1), pair(a)))))


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("__", a, b)


def signature(words: Column) -> Column:
    """Sorted distinct words, joined."""
    return F.concat_ws("__", F.array_sort(F.array_distinct(words)))


def post_tokens(text: Column) -> Column:
    """Words between separators, without links; mentions stay."""
    parts = F.filter(F.split(text, " "), lambda x: ~x.startswith("http:") & ~x.startswith("https:"))
    joined = F.translate(F.array_join(parts, " "), SEPARATORS, " " * len(SEPARATORS))
    return F.filter(F.split(joined, " "), lambda x: x != "")


def point(text: Column, least_length: int = 4, least_words: int = 2) -> Column:
    """The binary vector of a post as the sorted set of its words; empty below two words."""
    long = F.filter(post_tokens(text), lambda x: (F.length(x) >= least_length) & ~x.startswith("@") & ~x.startswith("RT"))
    words = F.array_sort(F.array_distinct(F.transform(long, F.lower)))
    return F.when(F.size(words) >= least_words, words).otherwise(F.array().cast("array<string>"))


def render_browser(text: Column) -> Column:
    """Escaped slashes put right."""
    return F.replace(text, F.lit("\\/"), F.lit("/"))


def render_plain(text: Column) -> Column:
    """URL escapes and escaped slashes put right, line ends made blanks; a text with a bad escape stays escaped."""
    decoded = F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    return F.translate(render_browser(F.coalesce(decoded, text)), "\n", " ")


def account_link(name: Column, account: Column) -> Column:
    return F.format_string('<a href="http://twitter.com/account/redirect_by_id?id=%s">%s</a>', account.cast("string"), name)


def last_segment_id(url: Column) -> Column:
    """The number after the last slash; null if there is none."""
    return F.substring_index(url, "/", -1).try_cast("bigint")
