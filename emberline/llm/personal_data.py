"""Personal information inside free text: anchor expansion.

One Aho-Corasick pass over the lower-cased text finds anchors: at-signs and their written forms, schemes of links, cues
of identity and phone numbers, words of street names, titles, roles, sources and verbs that stand beside a person's name,
and known parts of names; runs of digits are anchors too. From each anchor a deterministic parser of its kind expands to
the real boundaries of the item, however far they are, and validates it. Where items overlap, mail addresses go before
identity numbers, phone numbers, street addresses and names.

No list of persons' names is built in. Names are known by what stands beside them and by their shape. The parts of names
that such cues show in the whole table (``learn_parts``) are known everywhere: in lower case, and without a cue.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.session import cut

PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "idno": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}

PARTICLES = ("de la", "de los", "van der", "van den", "van", "von", "zu", "di", "de", "del", "della", "da", "dos", "du", "al", "el", "bin", "ibn", "ten", "ter", "st")
TITLES = (
    "dr", "dra", "mr", "mrs", "ms", "miss", "mx", "prof", "professor", "sir", "lady", "captain", "sergeant", "sgt", "lieutenant", "colonel", "general", "officer",
    "judge", "senator", "minister", "mayor", "president", "nurse", "father", "sister", "brother", "uncle", "aunt", "mme", "mlle", "madame", "monsieur", "docteur", "maître", "herr",
    "herrn", "frau", "doktor", "señor", "señora", "señorita", "sr", "sra", "don", "doña", "doctor", "doctora", "signor", "signora", "dott", "dottor", "dottoressa",
    "senhor", "senhora", "dona", "doutor", "doutora", "mevrouw", "meneer", "dhr", "mw", "господин", "госпожа", "доктор", "г-н", "г-жа",
)
#: What else a person's name follows.
ROLES = (
    "contact person", "contact", "kontakt", "contacto", "contatto", "contato", "contactpersoon", "photo by", "photos by", "photo", "picture by", "foto", "credit", "video by",
    "spoke with", "spoke to", "talked to", "interview with", "interviewed", "met with", "missing since noon", "missing", "missing person", "vermisst", "disparue", "disparu",
    "desaparecido", "desaparecida", "scomparso", "scomparsa", "vermist", "reported by", "written by", "signed by", "report by", "story by", "text by", "my name is", "name is",
    "her name is", "his name is", "named", "namens", "ich heiße", "je m'appelle", "s'appelle", "me llamo", "se llama", "mi chiamo", "si chiama", "chama-se", "меня зовут", "зовут",
    "witness", "neighbour", "neighbor", "owner", "driver", "author", "reporter", "editor", "holder", "signed", "gez", "i am", "ask for",
)
#: What names a source, which may be an office.
SOURCES = ("according to", "laut", "selon", "d'après", "según", "secondo", "segundo", "volgens", "по словам", "nach angaben von", "as told by", "says", "said")
#: Verbs that follow a person's name at the begin of a sentence.
VERBS = (
    "said", "says", "told", "adds", "added", "wrote", "reports", "reported", "explained", "warned", "claims", "claimed", "recalled", "confirmed", "sagte", "sagt", "erklärte",
    "berichtet", "a dit", "dit", "affirme", "dijo", "dice", "afirmó", "ha detto", "disse", "diz", "zei", "zegt", "сказал", "сказала", "говорит",
)
#: Words that no person's name begins with or holds: function words, and words of offices, places and storms.
NO_NAMES = frozenset(
    "the a an this that these those and or but if as at in on of to for from by with near no not all some many most more his her their our my your its it he she they we you i "
    "yesterday today tomorrow tonight now then there here who what when where why how someone nobody everyone people locals officials sources witnesses volunteers please "
    "der die das den dem des ein eine einer und oder im am zu vom zum zur bei nach noch nicht le la les un une des du et ou au aux dans sur pour par el los las una y o en por para con "
    "il lo gli uno e di os as um uma no na het een en op van die "
    "police fire army ministry minister council city town county state federal national department office hospital university school church cross red press news agency radio television tv "
    "times post street road avenue square station airport bridge river market harbour harbor stadium museum north south east west mount lake port fort new old upper lower saint grand "
    "storm hurricane typhoon cyclone tropical tempête tormenta sturm orkan tempesta tempestade шторм ураган committee union party group club bank company team crew service authority".split()
)

ENGLISH_STREETS = ("road", "rd", "street", "st", "lane", "ln", "drive", "dr", "avenue", "ave", "terrace", "close", "court", "crescent", "square", "way", "place", "row", "gardens", "grove", "boulevard", "blvd")
FRENCH_STREETS = ("rue", "avenue", "av.", "bd", "boulevard", "place", "allée", "impasse", "quai", "chemin", "cours", "route")
ROMANCE_STREETS = ("calle", "c/", "plaza", "avda.", "avda", "avenida", "paseo", "camino", "via", "viale", "piazza", "corso", "rua", "praça", "travessa")
GERMANIC_STREETS = ("straße", "strasse", "str.", "weg", "platz", "allee", "gasse", "ring", "ufer", "damm", "straat", "laan", "plein", "gracht", "kade")
#: Words that aren't part of a street's name between its number and its kind: function words and units.
NOT_STREETS = frozenset("to of the at in on for and from by with a an is are was were km m people streets hours minutes o'clock street".split())
#: Cues of identity and account numbers, and of phone numbers, after which a number of any format is taken.
ID_CUES = (
    "passport", "id no", "id number", "identity number", "identity card", "id card", "national number", "social security", "ssn", "tax id", "iban", "account number", "account no",
    "driving licence", "driver's license", "licence no", "ausweisnummer", "personalausweis", "reisepass", "steuer-id", "versicherungsnummer", "kontonummer", "passeport",
    "carte d'identité", "numéro de sécurité sociale", "pasaporte", "dni", "nie", "nif", "documento de identidad", "passaporte", "cpf", "codice fiscale", "carta d'identità",
    "paspoort", "bsn", "rijbewijs", "паспорт", "снилс", "инн",
)
PHONE_CUES = (
    "tel", "tél", "phone", "telephone", "mobile", "cell", "call", "text", "whatsapp", "hotline", "fax", "sms", "number is", "telefon", "telefonnummer", "handy", "rufnummer", "téléphone",
    "portable", "appelez le", "teléfono", "móvil", "llamen al", "llame al", "telefono", "cellulare", "telefone", "telemóvel", "ligue para", "telefoon", "тел", "телефон", "tel:", "callto:", "sms:",
)
SCHEMES = ("http://", "https://", "ftp://", "www.")


def _any(words) -> str:  # noqa: ANN001
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


@dataclass(frozen=True)
class Cues:
    """What stands beside persons' names."""

    particles: tuple[str, ...] = PARTICLES
    titles: tuple[str, ...] = TITLES
    roles: tuple[str, ...] = ROLES
    sources: tuple[str, ...] = SOURCES
    verbs: tuple[str, ...] = VERBS
    no_names: frozenset[str] = NO_NAMES


@dataclass(frozen=True)
class Parts:
    """Known given names and surnames, in lower case."""

    given: frozenset[str] = frozenset()
    surnames: frozenset[str] = frozenset()


#: A label or local part goes on as far as its characters do.
_LOCAL_CHARS = r"\w.%+\-"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
_DOT = r"(?:\.| ?[\[({] ?dot ?[\])}] ?| dot )"
_DOMAIN = re.compile(rf" ?{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,63}}(?![\w\-])", re.IGNORECASE)
_SPOKEN = re.compile(rf"{_LABEL}(?: dot {_LABEL})* dot [A-Za-z]{{2,63}}(?![\w\-])", re.IGNORECASE)
_EDGE, _STOP = r"(?<![\w.,:/#€$+\-])", r"(?![\w])(?![.,:/\-]\d)"
_RUN = re.compile(r"\d+")
_IDNO = re.compile(
    rf"(?<![\w#\-])(?:[A-Z]{{2}} ?\d\d ?\d\d ?\d\d ?[A-D]"
    rf"|\d{{3}}-\d\d-\d{{4}}|\d{{3}} \d\d \d{{4}}"
    rf"|\d \d\d \d\d \d\d \d{{3}} \d{{3}} \d\d|\d{{13}} \d\d(?=\D|$)"
    rf"|\d{{8}}-?[A-Z]|\d\d-\d{{3}}-\d{{3}}-[A-Z]|\d\d\.\d{{3}}\.\d{{3}}-[A-Z]"
    rf"|[A-Z]{{2}}\d{{7}}){_STOP}"
)
_PHONE = re.compile(
    rf"(?:(?<![\w+])\+\d{{1,3}}(?:[ .\-]?\(\d{{1,4}}\))?(?:[ .\-]?\d{{1,5}}){{1,6}}(?:-\d{{1,4}})?"
    rf"|{_EDGE}00\d{{2}}(?: \d{{2,4}}){{2,4}}"
    rf"|(?<![\w])\(\d{{2,5}}\) ?\d{{3,4}}[ \-]\d{{3,5}}"
    rf"|{_EDGE}\d{{3}}([.\-])\d{{3}}\1\d{{4}}"
    rf"|{_EDGE}0\d([ .])\d\d(?:\2\d\d){{3}}"
    rf"|{_EDGE}0\d{{2,4}}[ /]\d{{4,8}}(?: \d{{3,4}}|-\d{{1,4}})?"
    rf"|{_EDGE}0\d{{2}} \d{{3}} \d{{4}}"
    rf"|{_EDGE}[2-9]\d{{2}} \d{{3}} \d{{4}}"
    rf"|{_EDGE}[2-9]\d{{2}}[2-9]\d{{6}}"
    rf"|{_EDGE}0\d{{9,10}}"
    rf"|{_EDGE}\d{{3}}[ \-]\d{{4}}(?= ?(?:ext|x)))(?: ?(?:ext\.?|x) ?\d{{1,5}})?{_STOP}"
)
#: National digits after a country code; other codes take what is there.
_NATIONAL = {"1": 10, "33": 9, "34": 9, "44": 10}
#: Between a cue and its number, and numbers of any format.
_LINK = re.compile(r"[.:]?(?: ?(?:no|nr|number|n[º°o]|#)\.?)?(?: ?(?:is|:|ist|est|es|è|é))? ?", re.IGNORECASE)
_ANY_ID = re.compile(r"(?<!\w)[A-Z]{0,4}\d(?:[\-./]?[A-Z0-9]){4,30}(?!\w)|(?<!\w)[A-Z0-9]{2,4}(?: [A-Z0-9]{2,4}){2,8}(?!\w)")
_ANY_PHONE = re.compile(r"(?<![\w+])\+?\(?\d(?:[ .\-/()]{0,2}\d){6,14}(?!\w)")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d\d(?: ?[A-Z0-9]{1,4}){3,8}(?!\w)")
_LINK_END = re.compile(r"[^\s<>\"'{}|\\^`]*")
_TOWN = r"(?:, [^\W\d_][^\W\d_\-']+(?: [A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2})?)?"
_ENGLISH = re.compile(rf"{_EDGE}(?P<no>\d{{1,4}}[A-Za-z]?) (?P<street>(?:[^\W\d_][\w'’\-]* ){{1,4}}?)(?:{_any(ENGLISH_STREETS)})\b\.?(?:, (?:Flat|Apt\.?|Unit) ?\w+|{_TOWN})", re.IGNORECASE)
_FRENCH = re.compile(rf"{_EDGE}\d{{1,4}}(?: ?(?:bis|ter|quater))?,? (?:{_any(FRENCH_STREETS)}) (?:(?:de la|de l'|des|du|de|d') ?)?[^\W\d_][\w'’\-]*(?:, \d{{5}} [^\W\d_][\w\-]*)?", re.IGNORECASE)
_ROMANCE = re.compile(rf"(?<!\w)(?:{_any(ROMANCE_STREETS)}) ?(?:(?:de las|de los|de la|del|de|da|do|della|dei) )?[^\W\d_][\w'’\-]*,? (?:n[º°o]\.? ?)?\d{{1,4}}[A-Za-z]?(?!\w)(?:, \d+[º°ª] ?[A-Z]\b)?(?:, \d{{5}} [^\W\d_][\w\-]*)?", re.IGNORECASE)
_GERMANIC = re.compile(rf"(?<!\w)[^\W\d_][^\W\d_\-]*(?:{_any(GERMANIC_STREETS)}) \d{{1,4}}[A-Za-z]?(?!\w)(?:, \d{{4,5}} [^\W\d_][\w\-]*)?", re.IGNORECASE)

_W = r"[^\W\d_]['’]?[^\W\d_]+(?:['’\-][^\W\d_]+)*"
_END = r"(?![\w@]|-\w)"


def iban_end(text: str, start: int, end: int) -> int | None:
    """The end of the longest account number from ``start`` whose check digits hold."""
    while end - start >= 15:
        raw = text[start:end].replace(" ", "")
        if 15 <= len(raw) <= 34 and (end == len(text) or not text[end].isalnum()) and int("".join(str(int(c, 36)) for c in raw[4:] + raw[:4])) % 97 == 1:
            return end
        end -= 1
    return None


class Finder:
    """Finds the items of a text as (kind, start, end) in code points, in order and without overlap."""

    def __init__(self, cues: Cues = Cues(), parts: Parts = Parts(), only_names: bool = False) -> None:
        import ahocorasick

        self.cues, self.parts = cues, parts
        self.automaton = ahocorasick.Automaton()
        anchors: dict[str, set[str]] = {}
        kinds = [
            ("title", cues.titles),
            ("role", cues.roles),
            ("source", cues.sources),
            ("verb", tuple(f" {v}" for v in cues.verbs)),
            ("part", (*parts.given, *parts.surnames)),
        ]
        if not only_names:
            kinds += [
                ("email", ("@", "＠", " at ", "(at)", "[at]", "{at}", "( at )", "[ at ]", "{ at }")),
                ("scheme", SCHEMES),
                ("id", ID_CUES),
                ("phone", PHONE_CUES),
                ("english", [f" {w}" for w in ENGLISH_STREETS]),
                ("french", [f" {w} " for w in FRENCH_STREETS]),
                ("romance", [w + " " for w in ROMANCE_STREETS if w != "c/"] + ["c/"]),
                ("germanic", [w + " " for w in GERMANIC_STREETS]),
            ]
        for kind, words in kinds:
            for word in words:
                anchors.setdefault(word, set()).add(kind)
        for word, kinds_ in anchors.items():
            self.automaton.add_word(word, (len(word), tuple(kinds_)))
        self.automaton.make_automaton()
        initials = r"[^\W\d_]\. ?(?:[^\W\d_]\. ?)?"
        particle = rf"(?:(?i:{_any(cues.particles)}) )?"
        last = rf"{particle}(?P<{{0}}>{_W})"
        self.forms = [
            re.compile(p)
            for p in (
                rf"{initials}{last.format('s')}{_END}",
                rf"(?P<g>{_W}) (?:[^\W\d_]\. ?)?{last.format('s')}(?: {last.format('t')})?{_END}",
                rf"{last.format('s')}, (?P<g>{_W})(?: [^\W\d_]\.)?{_END}",
                rf"{last.format('s')},? [^\W\d_]\.(?!\w)",
            )
        ]
        self.title = re.compile(rf"(?i:(?:{_any(cues.titles)})\b\.? +)")
        self.before = re.compile(rf"(?:{_W}|[^\W\d_]\.)(?:,? (?:{_W}|[^\W\d_]\.)){{0,4}}$")

    # Names. A name is (start, end, given or None, surname, cased, which parts are known).

    def _form(self, k: int, text: str, at: int) -> tuple | None:
        m = self.forms[k].match(text, at)
        if m is None:
            return None
        given, surname, end = (m["g"] if k in (1, 2) else None), m["s"], m.end()
        if k == 1 and m["t"] is not None and not (self._known(m["t"], self.parts.surnames) and not self._known(surname, self.parts.surnames)):
            end = m.end("s")
            if end < len(text) and text[end] == "@":
                return None
        low = self.cues.no_names
        words = [w for w in (given, surname) if w]
        if any(w.lower() in low for w in words) or (k == 1 and surname.lower() in self.cues.titles):
            return None
        cased = all(w[0].isupper() for w in words) and (given is not None or text[at].isupper() or text[end - 2].isupper())
        return at, end, given, surname, cased, given is not None and given.lower() in self.parts.given, self._known(surname, self.parts.surnames)

    @staticmethod
    def _known(word: str, among: frozenset[str]) -> bool:
        return bool(among) and all(w in among for w in word.lower().split("-"))

    def _after_cue(self, text: str, at: int, kind: str) -> tuple | None:
        """The name that begins at ``at``, after a cue; in lower case only one of whose parts one is known."""
        at = m.end() if (m := self.title.match(text, at)) and kind != "title" else at
        for k in (0, 1, 3, 2):
            if (found := self._form(k, text, at)) is None:
                continue
            _, _, given, _, cased, known_given, known_surname = found
            if k == 2 and kind == "source" and not (known_given or known_surname):
                continue  # a place and the begin of a clause
            if k == 3 and not known_surname and not text[at].isupper():
                continue
            lower = not any(c.isupper() for c in text[found[0] : found[1]])
            if cased or (known_surname and (known_given or given is None)) or (lower and known_given):
                return found
        return None

    def _known_name(self, text: str, at: int) -> tuple | None:
        """The name of known parts that begins at ``at``."""
        for k in (1, 2, 3, 0):
            found = self._form(k, text, at)
            if found is not None and found[6] and (found[5] or found[2] is None):
                return found
        m = self.forms[1].match(text, at)  # surname first, without a comma
        if m is not None and m["s"].lower() in self.parts.given and self._known(m["g"], self.parts.surnames):
            return at, m.end("s"), m["s"], m["g"], True, True, True
        return None

    def _names(self, text: str, places: dict[str, list[tuple[int, int]]]) -> Iterator[tuple]:
        """Names by cues, then names of known parts; may overlap."""
        size = len(text)
        for kind in ("title", "role", "source"):
            longest = dict(places.get(kind, ()))  # of the cues that begin at one place the last is the longest
            for a, b in longest.items():
                if a and (text[a - 1].isalnum() or text[a - 1] in "_@#-/"):
                    continue
                if b < size and text[b] == "." and kind == "title":
                    b += 1
                while b < size and text[b] in " :" and b < size:
                    b += 1
                if (b == size or not text[b - 1] in " :") or (kind == "title" and text[b - 1] == ":"):
                    continue
                if (found := self._after_cue(text, b, kind)) is not None:
                    yield kind, found
        for a, b in places.get("part", ()):
            if (a and (text[a - 1].isalnum() or text[a - 1] in "_@#/-'’")) or (b < size and text[b].isalpha()):
                continue
            begins = [a]
            if (m := self._lead.search(text, max(0, a - 24), a)) is not None:
                begins = [m.start(), *begins]  # a particle or initials before a surname
            for at in begins:
                if at and (text[at - 1].isalnum() or text[at - 1] in "_@#/.-"):
                    continue
                if at and text[at - 1] == " " and text[text.rfind(" ", 0, at - 1) + 1 : at - 1].lower() in _STORMS:
                    continue
                if (found := self._known_name(text, at)) is not None:
                    yield "part", found
                    break
        for a, b in places.get("verb", ()):
            if b < size and (text[b].isalnum() or text[b] == "-"):
                continue
            start, blanks = a, 0
            while start and (text[start - 1].isalpha() or text[start - 1] in " ,.'’-"):
                blanks += text[start - 1] == " "
                if blanks > 5:  # a name has five words at most
                    break
                start -= 1
            m = self.before.search(text, start, a)
            if m is None:
                continue
            for w in re.finditer(rf"(?<![\w.,'’\-] )(?<![\w@#.\-/'’]){_W}|(?<=[.!?] ){_W}|[^\W\d_]\.", m.group()):
                at = m.start() + w.start()
                ends = [f for k in (0, 1, 2) if (f := self._form(k, text, at)) is not None and f[1] == a and f[4]]
                opens = at == 0 or text[:at].rstrip(" ")[-1:] in ("", "\n", "\r", "\t", ".", "!", "?", ":", "|", "…", '"', "“", "—", "–", ">", "]", ")")
                if ends and (opens or ends[0][5] or ends[0][6]):
                    yield "verb", ends[0]
                    break
        for m in self._initial_starts(text):
            if (found := self._form(0, text, m)) is not None and found[4]:
                yield "initial", found

    _lead = re.compile(rf"(?:(?:[^\W\d_]\. ?){{1,2}})?(?:(?i:{_any(PARTICLES)}) )?$")
    _starts = re.compile(r"(?<=[:,(.!?] )(?<![\w@#.\-/])[^\W\d_]\. ?(?=[^\W\d_]|[^\W\d_]\.)")

    def _initial_starts(self, text: str) -> Iterator[int]:
        for m in self._starts.finditer(text):
            if m.group()[0].isupper():
                yield m.start()

    def __call__(self, text: str) -> list[tuple[str, int, int]]:
        places, low = self._places(text)
        size = len(text)
        found: list[tuple[str, int, int]] = []
        taken = bytearray(size)

        def add(kind: str, start: int, end: int) -> None:
            if not any(taken[start:end]):
                taken[start:end] = b"\x01" * (end - start)
                found.append((kind, start, end))

        for a, b in places.get("email", ()):
            if (span := self._email(text, a, b)) is not None:
                add("email", *span)
        links = bytearray(size)
        for a, b in places.get("scheme", ()):
            if links[a]:
                continue
            end = _LINK_END.match(text, b).end()
            links[a:end] = b"\x01" * (end - a)
        runs = [m.span() for m in _RUN.finditer(text) if not links[m.start()]]
        if runs:
            for start, end in self._at_runs(text, runs, (3, 2, 0), _IBAN):
                if (stop := iban_end(text, start, end)) is not None:
                    add("idno", start, stop)
            for start, end in self._at_runs(text, runs, (3, 2, 0), _IDNO):
                add("idno", start, end)
            for start, end in self._at_runs(text, runs, (1, 0), _PHONE):
                if (end := self._phone_end(text[start:end], end)) is not None:
                    add("phone", start, end)
            for kind, cue, pattern in (("idno", "id", _ANY_ID), ("phone", "phone", _ANY_PHONE)):
                for a, b in places.get(cue, ()):
                    if a and text[a - 1].isalnum():
                        continue
                    at = _LINK.match(text, b).end()
                    if at == b and text[b - 1] != ":":
                        continue
                    m = pattern.match(text, at)
                    if m is not None and sum(map(str.isdigit, m.group())) >= 5:
                        add(kind, *m.span())
            if "english" in places:
                for m in self._matches(text, runs, (0,), _ENGLISH):
                    if self._street(m["street"]):
                        add("address", *m.span())
            if "french" in places:
                for m in self._matches(text, runs, (0,), _FRENCH):
                    add("address", *m.span())
            at = 0
            for a, _ in places.get("romance", ()):
                if a >= at and (m := _ROMANCE.match(text, a)) is not None:
                    add("address", *m.span())
                    at = m.end()
            at = 0
            for a, _ in places.get("germanic", ()):
                start = a
                while start > at and text[start - 1].isalpha():
                    start -= 1
                if a >= at and (m := _GERMANIC.match(text, start)) is not None:
                    add("address", *m.span())
                    at = m.end()
        for _, name in self._names(text, places):
            if not links[name[0]]:
                add("name", name[0], name[1])
        return sorted(found, key=lambda x: x[1])

    def _places(self, text: str) -> tuple[dict[str, list[tuple[int, int]]], str]:
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        places: dict[str, list[tuple[int, int]]] = {}
        for last, (length, kinds) in self.automaton.iter(low):
            for kind in kinds:
                places.setdefault(kind, []).append((last - length + 1, last + 1))
        return places, low

    @staticmethod
    def _email(text: str, a: int, b: int) -> tuple[int, int] | None:
        """The mail address around an at-sign: the local part goes left, the domain right, each to its real boundary."""
        spoken = text[a] == " "
        end = a - 1 if text[a] in "([{" and a and text[a - 1] == " " else a
        start = end
        while start and (text[start - 1].isalnum() or text[start - 1] in "_.%+-"):
            start -= 1
        while start < end and not (text[start].isascii() and text[start].isalnum()):
            start += 1
        if start == end or text[end - 1] in ".%" or (start and text[start - 1].isalnum()):
            return None
        m = (_SPOKEN if spoken else _DOMAIN).match(text, b)
        if m is None or (text[a] in "@＠" and text[b : b + 1] == " "):
            return None
        return start, m.end()

    @staticmethod
    def _matches(text: str, runs: list[tuple[int, int]], before: tuple[int, ...], pattern: re.Pattern) -> Iterator[re.Match]:
        """Matches that begin at a run of digits or up to some characters before it, in order, without overlap."""
        at = 0
        for a, _ in runs:
            if a < at:
                continue
            for k in before:
                if a - k >= at and (m := pattern.match(text, a - k)) is not None:
                    yield m
                    at = m.end()
                    break

    def _at_runs(self, text: str, runs: list[tuple[int, int]], before: tuple[int, ...], pattern: re.Pattern) -> Iterator[tuple[int, int]]:
        return (m.span() for m in self._matches(text, runs, before, pattern))

    @staticmethod
    def _street(words: str) -> bool:
        """Words of a street's name: no function words, and all written alike."""
        return NOT_STREETS.isdisjoint(words.lower().split()) and len({w[0].isupper() for w in words.split()}) == 1

    @staticmethod
    def _phone_end(raw: str, end: int) -> int | None:
        """The end of a number of a likely length; what follows the national digits of a known country isn't part of it."""
        start = end - len(raw)
        digits = sum(map(str.isdigit, raw.split("x")[0]))
        if not 7 <= digits <= 16:
            return None
        if raw[0] != "+" or "(" in raw:
            return end
        for code, national in _NATIONAL.items():
            if raw[1:].startswith(code):
                count = 0
                for i, c in enumerate(raw):
                    count += c.isdigit()
                    if count == len(code) + national:
                        rest = raw[i + 1 :].lstrip()
                        return end if rest.startswith(("ext", "x")) else start + i + 1
                return None if digits < len(code) + national - 1 else end
        return end

    def parts_of(self, text: str) -> set[tuple[str, bool]]:
        """The parts of the cased names after titles and roles, in lower case, with whether each is a given name."""
        out = set()
        for kind, (_, _, given, surname, cased, *_) in self._names(text, self._places(text)[0]):
            if cased and kind in ("title", "role"):
                if given is not None:
                    out.add((given.lower(), True))
                out.update((w, False) for w in surname.lower().split("-"))
        return out


_STORMS = frozenset("storm hurricane typhoon cyclone tempête tormenta sturm orkan tempesta tempestade шторм ураган".split())


@lru_cache(maxsize=4)
def finder(cues: Cues, parts: Parts, only_names: bool = False) -> Finder:
    return Finder(cues, parts, only_names)


def _learning(cues: Cues):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(cues, Parts(), True)
        for batch in batches:
            counts = Counter(x for text in batch.column(0).to_pylist() for x in find.parts_of(text))
            own = list(counts.items())
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for (p, _), _ in own], pa.string()), pa.array([g for (_, g), _ in own], pa.bool_()), pa.array([n for _, n in own], pa.int64())], ["part", "given", "n"]
            )

    return run


def learn_parts(rows: DataFrame, text: str, cues: Cues = Cues(), share: float = 1e-5, least: int = 2) -> Parts:
    """The parts of names that titles and roles show in the texts of all ``rows``.

    A part is known if at least ``least`` texts, and at least the ``share`` of all (text, part) pairs, show it; so at
    most 1 / ``share`` parts come to the driver, whatever the size of the table. It is a given name if it is shown more
    often as one. An empty table gives no parts.
    """
    found = rows.select(text).where(F.length(text) > 0).mapInArrow(_learning(cues), "part string, given boolean, n bigint")
    counts = cut(found.groupBy("part").agg(F.sum(F.when(F.col("given"), F.col("n")).otherwise(0)).alias("g"), F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    kept = counts.where(F.col("n") >= max(least, math.ceil(total * share))).collect()
    return Parts(frozenset(r.part for r in kept if 2 * r.g > r.n), frozenset(r.part for r in kept if 2 * r.g <= r.n))


def replaced(text: str, items: list[tuple[str, int, int]]) -> str:
    """The text with each item replaced by the placeholder of its kind; the rest is unchanged."""
    parts, at = [], 0
    for kind, start, end in items:
        parts += [text[at:start], PLACEHOLDERS[kind]]
        at = end
    return "".join([*parts, text[at:]])


def _finding(cues: Cues, parts: Parts, several: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(cues, parts)
        for batch in batches:
            rows, kinds, starts, ends = [], [], [], []
            for i, text in enumerate(batch.column(several).to_pylist()):
                for kind, start, end in find(text) if text else ():
                    rows.append(i)
                    kinds.append(kind)
                    starts.append(start)
                    ends.append(end)
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns[:several], pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
                [*kept.schema.names[:several], "pii_type", "start_pos", "end_pos"],
            )

    return run


def _replacing(cues: Cues, parts: Parts, several: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(cues, parts)
        for batch in batches:
            texts, counts = [], []
            for text in batch.column(several).to_pylist():
                items = find(text) if text else []
                texts.append(replaced(text, items) if text else text)
                counts.append(len(items))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:several], pa.array(texts, pa.string()), pa.array(counts, pa.int32())], [*batch.schema.names[:several], "redacted", "items"]
            )

    return run


def find_items(rows: DataFrame, keys: list[str], text: str, parts: Parts = Parts(), cues: Cues = Cues()) -> DataFrame:
    """``keys, pii_type, start_pos, end_pos``: each item of each text, by code points before its first and last + 1.

    Null and empty texts give no row; null keys and repeated rows are kept as they are; an empty table gives no rows;
    other columns are dropped. Texts are searched in whole, by one task each.
    """
    own = rows.select(*keys, text)
    schema = ", ".join(f"`{n}` {t}" for n, t in own.select(*keys).dtypes) + ", pii_type string, start_pos int, end_pos int"
    return own.where(F.length(text) > 0).mapInArrow(_finding(cues, parts, len(keys)), schema)


def redact(rows: DataFrame, keys: list[str], text: str, parts: Parts = Parts(), cues: Cues = Cues()) -> DataFrame:
    """``keys, redacted, items``: each text with typed placeholders for its items, and their number.

    Null and empty texts stay as they are with 0 items.
    """
    own = rows.select(*keys, text)
    schema = ", ".join(f"`{n}` {t}" for n, t in own.select(*keys).dtypes) + ", redacted string, items int"
    return own.mapInArrow(_replacing(cues, parts, len(keys)), schema)
