"""Character language models for the languages of texts, and the languages of a text's passages.

Each language has an interpolated Kneser-Ney model of the characters inside words (a word's characters are predicted
from up to ``ORDER`` - 1 before them, its start among these). The models are stored together: for each order the codes
of all n-grams in a sorted array, with a row of log probabilities, one for each language, and the contexts' back-off
weights likewise. They are fitted on all samples and all labelled texts, whose n-grams are counted by the executors. Words are
scored by binary search in these arrays, each distinct word of a batch once. A passage gets
the language of lowest cross-entropy per character, and is cut in two where two languages explain it so much better than
one as they never do sentences of one language. It is rejected as no sentence if too few of its words are likely ones in
its language, which also sets aside names, invented words and single foreign words. All bounds are calibrated on labelled
sentences that the models haven't seen (``Bounds``).
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.encoding_repair import Repair
from emberline.session import cut, discard

ORDER, DISCOUNT, BITS = 5, 0.75, 12
#: The start and the end of a word in an n-gram.
EDGE = "\n"
#: Of words of held-out sentences in their own language: the share that counts as likely, and that isn't noise.
LIKELY_SHARE, KNOWN_SHARE = 0.75, 0.95
#: The share of held-out sentences that must hold the least number of likely words.
SENTENCE_SHARE = 0.85
#: How much better than any split of a held-out sentence a cut has to be.
CUT_MARGIN = 1.5
#: Of a word's frequencies in the languages, the share of the one whose word it is; names and loanwords are no language's own.
OWN_SHARE = 0.9

#: Two- and three-letter codes of the languages (fixed values).
CODES = {
    "en": ("en", "eng"),
    "fr": ("fr", "fra", "fre"),
    "es": ("es", "spa"),
    "de": ("de", "deu", "ger"),
    "pt": ("pt", "por"),
    "it": ("it", "ita"),
    "nl": ("nl", "nld", "dut"),
    "ru": ("ru", "rus"),
}

_WORD = re.compile(r"[^\W\d_]+")
#: Words in the scripts of the languages. Others have no part in the models, so that the alphabet stays below 2 ** BITS letters.
_OWN = re.compile("[a-zªµºß-öø-ʯЀ-ԯḀ-ỿﬀ-ﬆ]+")
_DROP = re.compile(r"https?:\S*|[@#]\w+(?:[-.]\w+)*|&\w+;")
#: What ends a passage.
_END = re.compile(r"[.!?…|/\n\r;]+|\s[—–\ufffd-]+\s|:\s")


def passages(text: str) -> list[list[str]]:
    """The words of each passage, in lower case, without links, mentions and hashtags."""
    clean = _DROP.sub(" ", text)
    return [words for part in _END.split(clean) if (words := _WORD.findall(part.lower()))]


def grams_of(words: Counter) -> Counter:
    """How often each character of the words, and their end, comes after the up to ``ORDER`` - 1 before it."""
    grams: Counter = Counter()
    for word, n in words.items():
        if _OWN.fullmatch(word):
            edged = EDGE + word + EDGE
            for i in range(1, len(edged)):
                grams[edged[max(0, i - ORDER + 1) : i + 1]] += n
    return grams


@dataclass(frozen=True)
class Bounds:
    """Cross-entropies (nats a character) up to which a word is likely in a language, and above which it tells nothing of
    any; the least likely words of a sentence; the temper of the odds of the languages; the gain that a cut has to bring."""

    likely: float = 2.2
    noise: float = 3.2
    least: int = 3
    temper: float = 4.0
    gain: float = 30.0


class LanguageModels:
    """The models of all languages over one alphabet; ``samples`` has the sample texts of each language, ``more`` counts of other texts' n-grams."""

    def __init__(self, samples: dict[str, list[str]], bounds: Bounds = Bounds(), more: dict[str, Counter] | None = None) -> None:
        self.bounds = bounds
        self.languages = sorted(samples)
        counts = {lang: grams_of(Counter(w for t in texts for p in passages(t) for w in p)) for lang, texts in samples.items()}
        for lang in self.languages if more else ():
            counts[lang].update(more.get(lang, {}))
        grams = sorted(set().union(*counts.values()))
        letters = sorted({c for g in grams for c in g} - {EDGE})
        # 0 pads, 1 is the start and the end of a word, 2 any other character.
        self.alphabet = {c: i + 3 for i, c in enumerate(letters)}
        count = np.array([[counts[lang][g] for g in grams] for lang in self.languages], np.float64).reshape(len(self.languages), len(grams)).T
        self._fit(grams, count, len(letters) + 2)
        self.unseen = float(np.log(1.0 / (len(letters) + 2)))

    def _fit(self, grams: list[str], count: np.ndarray, size: int) -> None:
        """Discounted probabilities and back-off weights of each order; lower orders count the characters before."""
        points = np.array(grams, f"U{ORDER}").view(np.uint32).reshape(-1, ORDER)
        places = np.array([ord(EDGE), *map(ord, self.alphabet)], np.uint32)
        numbers = np.array([1, *self.alphabet.values()], np.int64)
        code = np.zeros(len(grams), np.int64)
        for k in range(ORDER):
            code = np.where(points[:, k] > 0, code << BITS | numbers[np.searchsorted(places, points[:, k])], code)
        length = (points > 0).sum(axis=1)
        orders = []
        after, kinds = code[:0], count[:0]
        for n in range(ORDER, 0, -1):  # continuation counts, together with the n-grams that begin a word
            own, total = self._summed(np.concatenate([code[length == n], after]), np.concatenate([count[length == n], kinds]))
            orders.append((own, total))
            after, kinds = own & ((1 << BITS * (n - 1)) - 1), (total > 0).astype(np.float64)
        self.grams, self.values, self.contexts, self.weights = [], [], [], []
        lower = np.full((1, len(self.languages)), 1.0 / size)
        for n, (own, total) in enumerate(reversed(orders), 1):
            context, sums = self._summed(own >> BITS, total)
            weight = DISCOUNT * self._summed(own >> BITS, (total > 0).astype(np.float64))[1] / np.maximum(sums, 1)
            weight[sums == 0] = 1.0
            place = np.searchsorted(context, own >> BITS)
            below = np.searchsorted(self.grams[-1], own & ((1 << BITS * (n - 1)) - 1)) if n > 1 else np.zeros(len(own), np.int64)
            lower = np.where(total > 0, (total - DISCOUNT) / np.maximum(sums, 1)[place], 0.0) + weight[place] * lower[below]
            self.grams.append(own)
            self.values.append(np.log(lower).astype(np.float32))
            self.contexts.append(context)
            self.weights.append(np.log(weight).astype(np.float32))

    @staticmethod
    def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct codes, sorted, and the sums of their rows of counts."""
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        first = np.flatnonzero(np.diff(codes, prepend=-1))
        return codes[first], np.add.reduceat(counts[order], first, axis=0) if len(first) else counts

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities (words x languages) and the number of predicted characters of each word."""
        get = self.alphabet.get
        length = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        flat = np.fromiter((x for w in words for x in (1, *(get(c, 2) for c in w), 1)), np.int64, int(length.sum()) + len(words))
        start = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
        place = np.arange(len(flat)) - np.repeat(start, length + 1)
        out = np.zeros((len(flat), len(self.languages)), np.float32)
        at = np.flatnonzero(place > 0)  # the start of a word is given
        code = np.zeros(len(at), np.int64)
        for k in range(ORDER - 1, -1, -1):
            ahead = at - k
            code = code << BITS | np.where(place[at] >= k, flat[np.maximum(ahead, 0)], 0)
        order = np.minimum(place[at] + 1, ORDER)
        for n in range(ORDER, 0, -1):
            own = order >= n
            rows, gram = at[own], code[own] & ((1 << BITS * n) - 1)
            found = self._find(self.grams[n - 1], gram)
            hit = found >= 0
            out[rows[hit]] += self.values[n - 1][found[hit]]
            order[np.flatnonzero(own)[hit]] = 0
            lost = rows[~hit]
            context = self._find(self.contexts[n - 1], gram[~hit] >> BITS)
            known = context >= 0
            out[lost[known]] += self.weights[n - 1][context[known]]
        out[at[order > 0]] += self.unseen
        return np.add.reduceat(out, start, axis=0) if len(words) else out, length

    @staticmethod
    def _find(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.full(len(codes), -1)
        i = np.minimum(np.searchsorted(table, codes), len(table) - 1)
        return np.where(table[i] == codes, i, -1)

    def _totals(self, scores: np.ndarray, word: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Sums of the words' scores of each passage, which begin at ``start``."""
        return np.add.reduceat(scores[word], start, axis=0)

    def _cuts(self, scores: np.ndarray, word: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each passage the best place of a cut, as a number of words, and how much better two languages explain it than one."""
        end = np.append(start[1:], len(word))
        size = end - start
        own = np.repeat(np.arange(len(start)), size)
        sums = np.cumsum(scores[word], axis=0, dtype=np.float64)  # else the passages before in a batch would count
        before = sums - np.repeat(sums[start] - scores[word[start]], size, axis=0)
        total = self._totals(scores, word, start)
        two = before.max(axis=1) + (total[own] - before).max(axis=1)
        best = np.maximum.reduceat(two, start)
        place = np.arange(len(word)) - start[own]
        first = np.full(len(start), len(word))
        np.minimum.at(first, own, np.where(two >= best[own], place + 1, len(word)))
        return np.minimum(first, size), best - total.max(axis=1)

    def _worded(self, texts: list[list[list[str]]]) -> tuple:
        """The words of all passages of two words or more: number, passage, and of the passages the text and place in it; scores and entropies."""
        number: dict[str, int] = {}
        word, size, owner, place = [], [], [], []
        for i, parts in enumerate(texts):
            for j, words in enumerate(parts):
                if len(words) > 1:
                    owner.append(i)
                    place.append(j)
                    size.append(len(words))
                    word += [number.setdefault(w, len(number)) for w in words]
        if not owner:
            return None
        scores, length = self.score(list(number))
        return np.array(word), np.array(size), np.array(owner), np.array(place), scores, -scores / length[:, None]

    def sentences(self, texts: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each passage, or part of one, that is a sentence: number of the text, number in it, language number, confidence, and the part's words from and to."""
        none = np.zeros(0, np.int64)
        if (found := self._worded(texts)) is None:
            return none, none, none, none.astype(float), none, none
        word, size, owner, place, scores, entropy = found
        useful = (entropy.min(axis=1) <= self.bounds.noise)[word]
        within = (np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size))[useful]
        word, kept = word[useful], np.repeat(np.arange(len(size)), size)[useful]
        if not len(word):
            return none, none, none, none.astype(float), none, none
        known, part = np.unique(kept, return_inverse=True)
        owner, place, size = owner[known], place[known], size[known]
        while True:  # parts are cut in two as long as that explains them much better
            start = np.searchsorted(part, np.arange(len(owner)))
            at, gain = self._cuts(scores, word, start)
            cut = gain > self.bounds.gain
            if not cut.any():
                break
            begins = np.zeros(len(word), bool)
            begins[start] = begins[(start + at)[cut]] = True
            whole = part[begins]
            owner, place, size, part = owner[whole], place[whole], size[whole], np.cumsum(begins) - 1
        total = self._totals(scores, word, start)
        best = total.argmax(axis=1)
        likely = np.add.reduceat((entropy[word, best[part]] <= self.bounds.likely).astype(np.int64), start)
        # The odds of the languages, tempered as neighbouring characters aren't independent.
        odds = np.exp((total - total.max(axis=1, keepdims=True)) / self.bounds.temper)
        sure = odds.max(axis=1) / odds.sum(axis=1)
        good = likely >= self.bounds.least
        head = np.concatenate([[True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])])
        begin = np.where(head, 0, within[start])
        end = np.where(np.append(head[1:], True), size, np.append(begin[1:], 0))
        return owner[good], place[good], best[good], sure[good], begin[good], end[good]


def named_language(label):  # noqa: ANN001, ANN201
    """The two-letter code that a label names: a two- or three-letter code in any case, with or without region; else null."""
    code = F.lower(F.regexp_extract(F.trim(label), "^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    pairs = [(c, lang) for lang, codes in CODES.items() for c in codes]
    named = F.when(code == pairs[0][0], pairs[0][1])
    for c, lang in pairs[1:]:
        named = named.when(code == c, lang)
    return named


def _identify(models: LanguageModels, letters: str | Counter, several: int, every: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = Repair(letters)
        for batch in batches:
            texts = []
            for text in batch.column(several).to_pylist():
                found = repair(text) if text and not text.isascii() else None
                texts.append(passages(found[0] if found else text or ""))
            owner, place, best, sure, _, _ = models.sentences(texts)
            names = np.array(models.languages)
            if not every:  # a language once a text, with its surest passage
                order = np.lexsort((-sure, best, owner))
                owner, place, best, sure = owner[order], place[order], best[order], sure[order]
                first = np.concatenate([[True], (owner[1:] != owner[:-1]) | (best[1:] != best[:-1])]) if len(owner) else np.zeros(0, bool)
                owner, place, best, sure = owner[first], place[first], best[first], sure[first]
            kept = batch.take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns[:several], pa.array(place.astype(np.int32)), pa.array(names[best] if len(best) else [], pa.string()), pa.array(sure.astype(float))],
                [*kept.schema.names[:several], "passage", "found", "confidence"],
            )

    return run


def _pieces(texts: list[str], characters: int = 1 << 20) -> Iterator[list[int]]:
    """The numbers of texts one after the other that together have about so many characters, or of one text that has more."""
    piece, size = [], 0
    for i, text in enumerate(texts):
        piece.append(i)
        size += len(text)
        if size >= characters:
            yield piece
            piece, size = [], 0
    if piece:
        yield piece


def _confirmed(models: LanguageModels, sure: float, words_kept: int = 200_000):
    """Counts of the words in the passages of labelled texts (``lang, text``) to which the models give the label's language."""

    def counted(words: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counts in words.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            labels, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for piece in _pieces(texts):
                parts = [passages(texts[i]) for i in piece]
                for i, j, k, c, begin, end in zip(*models.sentences(parts)):
                    if c >= sure and models.languages[k] == labels[piece[i]]:
                        words[models.languages[k]].update(parts[i][j][begin:end])
                if sum(map(len, words.values())) > words_kept:
                    yield from counted(words)
                    words.clear()
        yield from counted(words)

    return run


def _own_grams(languages: list[str], totals: list[int], known: set[str]):
    """Counts of the n-grams of words (``word``, its count in each language): of ``known`` ones, and of those that are one language's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            counts = np.stack([batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(len(languages))])
            share = counts / np.maximum(totals, 1)[:, None]
            kept = (share >= OWN_SHARE * share.sum(axis=0)) | np.fromiter((w in known for w in words), bool, len(words))
            for lang, own, count in zip(languages, kept & (counts > 0), counts):
                grams = grams_of(Counter({words[i]: int(count[i]) for i in np.flatnonzero(own)}))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["lang", "gram", "n"])

    return run


def fit(samples: DataFrame, more: DataFrame | None = None, lang: str = "lang", text: str = "text", most_each: int | None = None, sure: float = 0.99) -> LanguageModels:
    """Models of the languages of all ``samples`` and of labelled texts.

    ``more`` has texts whose labels may be wrong; those of their passages, or parts of them, are added to the samples to
    which the samples' own models give the same language at least ``sure``, without the words that the samples lack and
    several languages share, which are mostly names. All its texts are read, by the executors, and only sums of n-grams
    come to the driver; with ``most_each`` only so many of each language are, the first by a hash. The bounds are those of
    the samples' own models, as the texts may hold the very sentences of the samples.
    """
    texts: dict[str, list[str]] = defaultdict(list)
    for row in samples.where(F.col(lang).isin(list(CODES)) & F.col(text).isNotNull()).select(lang, text).orderBy(lang, text).collect():
        texts[row[0]].append(row[1])
    bounds = calibrated(texts)
    first = LanguageModels(texts, bounds)
    if more is None or not texts:
        return first
    labelled = more.where(F.col(lang).isin(first.languages) & (F.length(text) > 0)).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    if most_each is not None:
        # The same texts however the table is partitioned.
        each = [labelled.where(F.col("lang") == code).orderBy(F.xxhash64("text"), "text").limit(most_each) for code in first.languages]
        labelled = reduce(DataFrame.unionAll, each)
    found = labelled.mapInArrow(_confirmed(first, sure), "lang string, word string, n bigint")
    each = [F.sum(F.when(F.col("lang") == code, F.col("n")).otherwise(0)).alias(code) for code in first.languages]
    words = cut(found.groupBy("word").agg(*each))
    totals = [n or 0 for n in words.agg(*(F.sum(code) for code in first.languages)).first()]
    known = {w for own in texts.values() for t in own for p in passages(t) for w in p}
    grams = words.mapInArrow(_own_grams(first.languages, totals, known), "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    discard(words)
    counts: dict[str, Counter] = defaultdict(Counter)
    for code, gram, n in zip(*(grams.column(k).to_pylist() for k in range(3))):
        counts[code][gram] = n
    return LanguageModels(texts, bounds, counts)


def calibrated(samples: dict[str, list[str]]) -> Bounds:
    """Bounds from each half of the samples, scored by models of the other half; the defaults if there are too few.

    ``likely`` and ``noise`` are quantiles of the words' cross-entropies in their own language, ``least`` one of the
    likely words of a sentence, ``temper`` makes the odds of the right languages the most probable, and ``gain`` is
    above what a cut of any sentence of one language brings.
    """
    if min(map(len, samples.values()), default=0) < 2:
        return Bounds()
    own, sentences, totals, gains = [], [], [], []
    for half in (0, 1):
        models = LanguageModels({k: v[half::2] for k, v in samples.items()})
        for number, code in enumerate(models.languages):
            for words in (p for t in samples[code][1 - half :: 2] for p in passages(t) if len(p) > 1):
                scores, length = models.score(words)
                entropy = -scores[:, number] / length
                own.append(entropy)
                sentences.append(entropy)
                totals.append((scores.sum(axis=0), number))
                gains.append(float(models._cuts(scores, np.arange(len(words)), np.zeros(1, np.int64))[1][0]))
    if len(sentences) < 20:
        return Bounds()
    likely, noise = (float(np.quantile(np.concatenate(own), q)) for q in (LIKELY_SHARE, KNOWN_SHARE))
    least = int(np.quantile([(e <= likely).sum() for e in sentences], 1 - SENTENCE_SHARE))

    def loss(temper: float) -> float:
        odds = np.stack([t for t, _ in totals]) / temper
        odds -= odds.max(axis=1, keepdims=True)
        right = odds[np.arange(len(totals)), [k for _, k in totals]]
        return float((np.log(np.exp(odds).sum(axis=1)) - right).sum())

    return Bounds(likely, noise, max(2, least), min((0.5 * k for k in range(2, 33)), key=loss), CUT_MARGIN * max(gains))


def languages(rows: DataFrame, keys: list[str], text: str, models: LanguageModels, letters: str | Counter, every: bool = False) -> DataFrame:
    """``keys, passage int, found string, confidence double``: the languages of each row's sentences.

    Each language comes once a row with its surest passage, or with ``every`` each passage that is a sentence. Garbled
    text is repaired first. Null and empty texts, texts without a sentence, and passages that are in none of the
    languages give no row; null keys and repeated rows are kept as they are; an empty table gives no rows.
    """
    own = rows.select(*keys, text)
    schema = ", ".join(f"`{n}` {t}" for n, t in own.select(*keys).dtypes) + ", passage int, found string, confidence double"
    return own.where(F.length(text) > 0).mapInArrow(_identify(models, letters, len(keys), every), schema)
