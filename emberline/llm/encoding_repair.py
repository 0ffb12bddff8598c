"""Garbled text from wrong character encodings: round-trip repair.

Text whose UTF-8 bytes were read in a legacy encoding is re-encoded in that encoding and strictly decoded as UTF-8,
sequence by sequence, so that a text that is garbled in part is repaired in part. Text of one single-byte encoding read
in another one is re-encoded and decoded word by word. Both repeat, in any order, for nested layers, until no step lowers
the cost any more. The cost of a character is what such a character tells of garbling, and that of a word is its
improbability under letter frequencies of good text. Sequences that could be good text (a capital letter before a closing
quote, say) need a second sign of garbling in the text; so does a letter of a script of which the text shows no other one.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings in which UTF-8 may have been read.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "koi8-r", "cp866")
#: Those of them that show Cyrillic letters in UTF-8 with box drawing characters.
BOXES = ("cp437", "cp850", "koi8-r", "cp866")
#: Single-byte encodings of Cyrillic text, and what any single-byte text may have been read in.
CYRILLIC = ("cp1251", "koi8-r", "iso8859-5", "cp866")
ANY_READ = ("cp1252", "latin-1", "cp1251", "koi8-r", "cp866", "iso8859-5", "mac_roman", "cp850", "cp437")
SINGLE = tuple((read, meant) for meant in CYRILLIC for read in ANY_READ if read != meant)
#: The same for text in Latin letters.
LATIN = ("cp1252", "latin-1", "mac_roman", "cp850", "cp437")
WESTERN = tuple((read, meant) for meant in LATIN for read in LATIN if read != meant and {read, meant} != {"cp1252", "latin-1"})
#: Punctuation of good text, which may follow a letter by itself.
PUNCTUATION = "‘’“”„…–—•™‹›«»°º"
#: What may close a word that ends in Ã.
CLOSING = "”…–—"

RESULT = "restored string, layers int, complete boolean"


@lru_cache(maxsize=None)
def _bytes_of(encoding: str) -> dict[str, int]:
    """The byte of each character; bytes without a character stand for the control character of the same number."""
    table = {}
    for value in range(128, 256):
        try:
            table[bytes([value]).decode(encoding)] = value
        except UnicodeDecodeError:
            pass
    for value in range(128, 256):
        if value not in table.values() or encoding == "cp1252":
            table.setdefault(chr(value), value)
    return table


def _class(characters: list[str]) -> str:
    return "[" + "".join(re.escape(c) for c in characters) + "]"


@lru_cache(maxsize=None)
def _runs(read: str, meant: str) -> re.Pattern:
    """Runs of characters, other than ASCII, that are Cyrillic letters if their bytes are read as meant."""
    letters = [c for c, v in _bytes_of(read).items() if re.fullmatch("[а-яА-ЯёЁ]", bytes([v]).decode(meant, "replace"))]
    return re.compile(_class(letters) + "+")


@lru_cache(maxsize=None)
def _reader(encoding: str) -> tuple[re.Pattern, dict[str, int]]:
    """The pattern of whole UTF-8 sequences as that encoding shows them."""
    table = _bytes_of(encoding)
    within = lambda a, b: _class([c for c, v in table.items() if a <= v <= b])
    after = within(0x80, 0xBF)
    return re.compile(f"{within(0xC2, 0xDF)}{after}|{within(0xE0, 0xE0)}{within(0xA0, 0xBF)}{after}|{within(0xE1, 0xEF)}{after}{{2}}|{within(0xF0, 0xF4)}{after}{{3}}"), table


def _usual(c: str) -> bool:
    """Whether one sequence alone is taken for this character: Latin and Cyrillic letters, signs of texts, another layer of garbling."""
    o = ord(c)
    return (
        0x80 <= o <= 0x17F
        or 0x400 <= o <= 0x45F
        or 0x2010 <= o <= 0x203A
        or o in (0x192, 0x2C6, 0x2DC, 0x20AC, 0x200B, 0x200D, 0x2116, 0x2122, 0xFE0F, 0xFEFF)
        or 0x2190 <= o <= 0x21FF
        or 0x2600 <= o <= 0x27BF
        or 0x1F000 <= o <= 0x1FAFF
    )


@lru_cache(maxsize=65_536)
def _script(c: str) -> str | None:
    """The script of any other character, or the kind of a sign; None for what is no character of a text."""
    if unicodedata.category(c) in ("Cn", "Co", "Cs", "Cc"):
        return None
    name = unicodedata.name(c, "").partition(" ")[0]
    return "CJK" if name in ("HIRAGANA", "KATAKANA", "IDEOGRAPHIC", "FULLWIDTH", "HALFWIDTH") else name


_COST = [(0x80, 0x9F, 3.0), (0x2500, 0x259F, 3.0), (0xF8FF, 0xF8FF, 3.0), (0xFFFD, 0xFFFD, 3.0), (0x2200, 0x22FF, 2.0), (0x2300, 0x23FF, 2.0), (0x37E, 0x3FF, 2.0), (0x402, 0x40F, 2.0), (0x452, 0x491, 2.0), (0xA1, 0xA9, 1.6), (0xAA, 0xBE, 1.6)]


@lru_cache(maxsize=4096)
def _cost(c: str) -> float:
    o = ord(c)
    if o < 128:
        return 0.0
    return next((x for a, b, x in _COST if a <= o <= b), 1.0)


def cost(text: str) -> float:
    """The garbling cost of a text: the sum over its characters."""
    return sum(map(_cost, text))


#: Words; control characters and hard spaces, which may be parts of sequences, don't end one.
_TOKEN = re.compile("[^ \t\r\n\f\v]+")
_LETTERS = re.compile("[\xc0-\xd6\xd8-\xf6\xf8-\u02af\u0370-\u04ff\x80-\x9f\u2200-\u259f]")
_CONTROL = re.compile("[\x80-\x9f�]")
_BOX = re.compile("[─-▟]|[ΓÔ≡][^\x00-\x7f]|т[А-Я]|ЁЯ|\xadƒ")
_DRAWN = re.compile("[─-▟]")
#: Runs of Latin letters and signs, as whole words of another script show.
_STRANGE = re.compile("[^\x00-\x7f\u0400-\u04ff\u2000-\u20ff\u2190-\u24ff\u25a0-\u2bff\ufe0f\U0001f000-\U0001faff]{3}")
_CYRILLIC_WORD = re.compile("[\u0400-\u04ff]+")
#: Log probability per letter below which a Cyrillic word is odd, and the odd words in sequence that make a passage one.
_ODD_WORD, _ODD_WORDS = -3.2, 3
#: Signs that other encodings show for accented letters; of these, those that don't follow or open a word of good text.
_SIGNS = "\x80-\xb4\xb6-\xbf×÷ˆ˜‚„†‡‰‹›€™∂∑∏∫Ω√≈∆◊≤≥∞≠ﬁﬂ⁄⌐Γ\u2500-\u259f"
_BAD_SIGNS = "\x80-\x9f‚„†‡ˆ‰‹˜¢¤¥¦¬¯±¶¸¼½¾³÷∂∑∏∫√≈∆◊≤≥∞≠⁄⌐Γ\u2500-\u259f"
#: A sign inside, after or before a word, or a small letter before a capital one: Latin text read in another single-byte encoding.
_ODD = re.compile(f"[^\\W\\d_][{_SIGNS}]+[a-zß-öø-ÿ]|[a-zß-öø-ÿ][{_BAD_SIGNS}]|(?<!\\S)[{_BAD_SIGNS}][a-zß-öø-ÿ]{{2}}|[a-zß-öø-ÿ][À-ÖØ-ÞŸŽŠŒΓΘΣΦΩτ]|[\x80-\x9f]")
#: Garbling shows in two signs side by side, or beside a letter.
_TWO = re.compile("[^\x00-\x7f]{2}")
#: Rests of sequences that lost a byte.
_REST = re.compile("ðŸ|â€|ï¸|Ã[\xa0-\xbf]|Â[\xa0-\xbf]|≡ƒ|├[^\x00-\x7f]|╨|╤|[A-Za-z]√[^\x00-\x7f\\s]|√[^\x00-\x7f\\s][A-Za-z]|ü|рџ|вЂ")


def letter_pairs(text: str) -> Counter:
    """How often a letter comes after another one, or after the start of a word, with the words' script before the two."""
    pairs: Counter = Counter()
    for word, n in Counter(re.findall("[^\\W\\d_]+", text.lower())).items():
        script = "cyrillic" if "а" <= word[0] <= "ё" else "latin" if word[0] < "ʰ" else None
        for a, b in zip("^" + word, word + "$") if script else ():
            pairs[script, a, b] += n
    return pairs


class Repair:
    """Finds and repairs garbled texts. ``letters``: good text in all languages, or its ``letter_pairs``, for the letters' frequencies."""

    def __init__(self, letters: str | Counter) -> None:
        pairs = letter_pairs(letters) if isinstance(letters, str) else letters
        self.cyrillic, self.latin = (self._model({(a, b): n for (own, a, b), n in pairs.items() if own == script}) for script in ("cyrillic", "latin"))
        self.known: dict[str, float] = {}

    @staticmethod
    def _model(pairs: dict[tuple[str, str], int]) -> tuple[dict, dict]:
        """Log probabilities of a letter after another one, and of a letter never seen after it."""
        single: Counter = Counter()
        for (a, _), n in pairs.items():
            single[a] += n
        size = 0.3 * (len(single) + 1)
        return {k: math.log((n + 0.3) / (single[k[0]] + size)) for k, n in pairs.items()}, {a: math.log(0.3 / (n + size)) for a, n in single.items()}

    def _word(self, word: str) -> float:
        """Log probability of a word; capitals inside a word that isn't all capitals cost."""
        if (score := self.known.get(word)) is not None:
            return score
        score, low = 0.0, word.lower()
        pairs, rare = self.cyrillic if "Ѐ" <= low[0] <= "ӿ" else self.latin
        for k in zip("^" + low, low + "$"):
            p = pairs.get(k)
            score += p if p is not None else rare.get(k[0], -3.5 if pairs is self.cyrillic[0] else -6.0)
        if not (word.islower() or word.isupper() or word.istitle()):
            score -= 3 + sum(map(str.isupper, word[1:]))
        if len(self.known) > 200_000:
            self.known.clear()
        self.known[word] = score
        return score

    @staticmethod
    def _doubtful(encoding: str, match: re.Match) -> bool:
        """Whether a sequence may be good text: a letter before punctuation that ends its word, say."""
        found = match.group()
        after = match.string[match.end() : match.end() + 1]
        lead = found[0]
        if lead.isalpha() and all(c in (CLOSING if lead == "Ã" else PUNCTUATION) for c in found[1:]) and not after.isalpha():
            return True
        return len(found) == 2 and ((encoding == "mac_roman" and lead in "–—¬" and found[1].isalpha()) or found[1] in "ёЁ")

    def _scripts(self, encoding: str, pattern: re.Pattern, table: dict[str, int], text: str) -> set[str]:
        """The unusual scripts that the text's sequences show at least twice, or with a control character."""
        count: Counter = Counter()
        for match in pattern.finditer(text):
            found = match.group()
            try:
                decoded = bytes(table[c] for c in found).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if _usual(decoded) or (script := _script(decoded)) is None or self._doubtful(encoding, match):
                continue
            if found.isalpha() and (found[1:].islower() or found[1:].isupper()):
                continue  # letters of a word
            count[script] += 1 + (_CONTROL.search(found) is not None)
        return {script for script, n in count.items() if n > 1}

    def _multibyte(self, text: str) -> str | None:
        best, drop = None, 0.0
        boxes, drawn = _BOX.search(text) is not None, _DRAWN.search(text) is not None
        for encoding in READ_AS:
            pattern, table = _reader(encoding)
            if (encoding in BOXES and not boxes) or pattern.search(text) is None:
                continue
            scripts = self._scripts(encoding, pattern, table, text) if encoding not in BOXES or drawn else set()
            signs = weak = 0

            def whole(match: re.Match) -> str:
                nonlocal signs, weak
                found = match.group()
                try:
                    decoded = bytes(table[c] for c in found).decode("utf-8")
                except UnicodeDecodeError:
                    return found
                if not _usual(decoded) and _script(decoded) not in scripts:
                    return found
                doubtful = self._doubtful(encoding, match)
                weak += doubtful
                signs += not doubtful
                return decoded

            def token(match: re.Match) -> str:
                # A word is garbled as one: no letter of it may be left over.
                nonlocal signs, weak
                before = signs, weak
                word = match.group()
                rest = _LETTERS.search(pattern.sub(" ", word))
                new = pattern.sub(whole, word)
                if rest is not None and new != word:
                    signs, weak = before
                    return word
                return new

            changed = _TOKEN.sub(token, text)
            if changed != text and (signs or weak > 2) and (gain := cost(text) - cost(changed)) > drop:
                best, drop = changed, gain
        return best

    def _singlebyte(self, text: str) -> str | None:
        best, least = None, 6.0
        latin, own = _STRANGE.search(text) is not None, _CYRILLIC_WORD.findall(text)
        strange = {w for w in own if self._word(w) < _ODD_WORD * (len(w) + 1)}
        odd = "".join("x" if w in strange else " " for w in own if len(w) > 2)
        cyrillic = "x" * _ODD_WORDS in odd or 2 * odd.count("x") > len(odd)
        letters = sum(len(w) for w in own if w in strange)
        for read, meant in SINGLE if latin or cyrillic else ():
            if not (cyrillic if read in CYRILLIC else latin) and not (latin and cyrillic):
                continue
            table = _bytes_of(read)
            total, changes = 0.0, []
            for m in _runs(read, meant).finditer(text):
                word = m.group()
                if text[max(0, m.start() - 1) : m.start()].isalpha() or text[m.end() : m.end() + 1].isalpha():
                    continue  # a part of a word, such as an accented letter
                new = bytes(table[c] for c in word).decode(meant)
                if "Ѐ" <= min(word) and max(word) <= "ӿ":
                    gain = self._word(new) - self._word(word)
                    total += gain if gain > 4 else 0
                    kept = gain > 0 or word in strange
                else:  # of Latin letters and signs
                    gain = self._word(new) + 4.2 * len(word) if len(word) > 2 else 0.0
                    total += gain
                    kept = True
                if kept:
                    changes.append((m.start(), m.end(), new))
            if total > least and (read not in CYRILLIC or total >= letters):  # a nat a letter; words of another language gain less
                least = total
                best = self._changed(text, changes)
        return best

    @staticmethod
    def _changed(text: str, changes: list[tuple[int, int, str]]) -> str:
        parts, at = [], 0
        for i, j, new in changes:
            parts += [text[at:i], new]
            at = j
        return "".join([*parts, text[at:]])

    def _of_signs(self, token: str) -> float:
        """Log probability of a token of Latin words with signs between and beside the letters."""
        return sum(self._word(w) for w in re.findall("[^\\W\\d_]+", token)) - 4.0 * len(re.findall("[^\x00-\x7f\\w]", token))

    def _western(self, text: str) -> str | None:
        """Latin text read in another single-byte encoding, if its odd words become likelier as a whole."""
        if _ODD.search(text) is None:
            return None
        best, least = None, 6.0
        words = [m for m in re.finditer("[^\\s\x00-\x2c./:-\x40\\[-`{-\x7f]+", text) if not m.group().isascii()]
        for read, meant in WESTERN:
            table = _bytes_of(read)
            total, changes = 0.0, []
            for m in words:
                word = m.group()
                try:
                    new = bytes(ord(c) if c < "\x80" else table[c] for c in word).decode(meant)
                except (KeyError, UnicodeDecodeError):
                    continue  # its characters aren't all of that encoding
                if not all(c.isalpha() for c in new if c > "\x7f") or _ODD.search(new) is not None:
                    continue
                gain = self._of_signs(new) - self._of_signs(word)
                odd = _ODD.search(word) is not None
                total += max(gain, 0.0) if odd else 0.0
                if odd or gain > 0:
                    changes.append((m.start(), m.end(), new))
            if total > least:
                least = total
                best = self._changed(text, changes)
        return best

    def __call__(self, text: str) -> tuple[str, int, bool] | None:
        """The restored text, the layers taken off and whether no sign of garbling is left; None for good text."""
        if text.isascii() or (_TWO.search(text) is None and _CONTROL.search(text) is None and _ODD.search(text) is None):
            return None
        layers, now, before = 0, text, {text}
        while (new := self._multibyte(now) or self._singlebyte(now) or self._western(now)) is not None and new not in before:
            now, layers = new, layers + 1
            before.add(now)
        left = _CONTROL.search(now) is not None or _REST.search(now) is not None
        return (now, layers, not left) if layers or left else None


def _repairing(letters: str | Counter, several: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = Repair(letters)
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column(several).to_pylist()):
                if text and (result := repair(text)) is not None:
                    rows.append(i)
                    found.append(result)
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.bool_())],
                [*kept.schema.names, "restored", "layers", "complete"],
            )

    return run


def _counted_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = letter_pairs(" ".join(batch.column(0).to_pylist()))
        columns = [pa.array([k[i] for k in pairs], pa.string()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(list(pairs.values()), pa.int64())], ["script", "a", "b", "n"])


def letters_of(samples: DataFrame, text: str = "text") -> Counter:
    """The ``letter_pairs`` of all sample sentences; the executors count them, only the sums come to the driver."""
    pairs = samples.where(F.col(text).isNotNull()).select(text).mapInArrow(_counted_pairs, "script string, a string, b string, n bigint")
    return Counter({(r.script, r.a, r.b): r.n for r in pairs.groupBy("script", "a", "b").agg(F.sum("n").alias("n")).collect()})


def garbled(rows: DataFrame, keys: list[str], text: str, letters: str | Counter) -> DataFrame:
    """The rows whose ``text`` holds wrongly decoded characters: ``keys``, ``text``, ``restored``, ``layers``, ``complete``.

    ``restored`` is the text with every sequence put right that could be; ``complete`` tells whether no sign of garbling
    is left (a replacement character, or a sequence that lost a byte, can't be restored). Null, empty and ASCII texts
    are good and don't leave the JVM; null keys and repeated rows are kept as they are; an empty table gives no rows.
    """
    own = rows.select(*keys, text).where(F.col(text).rlike("[^\\x00-\\x7F]"))
    schema = ", ".join(f"`{n}` {t}" for n, t in own.dtypes) + ", " + RESULT
    return own.mapInArrow(_repairing(letters, len(keys)), schema)
