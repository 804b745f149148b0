"""Problem 3: personal data in running text, found and replaced by typed placeholders.

Regular expressions propose spans; validators (number plans, Luhn, mod 97, the shapes of identity numbers)
confirm or refuse them; words around a span raise or lower its score; the best-scored spans that do not
overlap are kept. Person names are proposed from capitalised words with a name model: how often a word
stands as given name or as surname in the corpus's name columns, confirmed by the address it is typed with.

Defined results: null and empty fields have no spans and stay as they are; equal spans of a repeated id are
one; positions count code points in the field as stored; null ids are left out; extra columns are ignored;
empty tables give no rows.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquarry.runtime import first_deliveries, small_enough

TYPES = ("name", "email", "phone", "id_number", "address")
#: A name model of at most so many words is sent to every worker; of a larger one every message gets the words that it holds.
BROADCAST_NAME_WORDS = 200_000
MIN_SCORE = 0.5

# A gap between the parts of a wrapped item: spaces, or a line end with the next line's quote marks.
_GAP = r"(?:[ \t]{1,2}|[ \t]?\r?\n[ \t]*(?:[>|:}][ \t]?){0,6})"
_SEP = rf"(?:[-./]|{_GAP})"
_EMAIL = re.compile(r"[\w.+'-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")
_EMAIL_SPELT = re.compile(
    rf"\b[\w+-]+(?:(?:{_GAP}?[(\[{{]?(?:dot|punkt)[)\]}}]?{_GAP}|\.)[\w+-]+)*(?:{_GAP}[(\[{{<]?(?:at|AT)[)\]}}>]?{_GAP}|\s?[(\[{{](?:at|@)[)\]}}]\s?)[\w-]+(?:(?:{_GAP}[(\[{{]?(?:dot|DOT|punkt)[)\]}}]?{_GAP}|\s?[(\[{{](?:dot|\.)[)\]}}]\s?|\.)[\w-]+)+"
)
_PHONES = (
    re.compile(rf"(?<![\w+./-])(?:\+?1{_SEP})?(?:\(\d{{3}}\){_GAP}?|\d{{3}}{_SEP})\d{{3}}{_SEP}\d{{4}}(?:,?{_GAP}?(?:x|ext\.?|extension|Ext\.?){_GAP}?\d{{1,6}})?(?![\w-]|[./]\d)"),
    re.compile(rf"(?<![\w+./-])(?:\+?1)?\d{{10}}(?:,?{_GAP}?(?:x|ext\.?|Ext\.?){_GAP}?\d{{1,6}})?(?![\w-]|[./]\d)"),
    re.compile(rf"(?<![\w./-])(?:\+|00)\d{{1,3}}{_SEP}?(?:\(0\){_GAP}?)?\d{{1,5}}(?:{_SEP}\d{{2,8}}){{1,4}}(?:{_GAP}?(?:x|ext\.?|Ext\.?){_GAP}?\d{{1,6}})?(?![\w-]|[./]\d)"),
    re.compile(rf"(?<![\w+./-])\(?0\d{{2,4}}\)?{_SEP}\d{{3,8}}(?:{_SEP}\d{{3,6}})?(?:{_GAP}?(?:x|ext\.?){_GAP}?\d{{1,6}})?(?![\w-]|[./]\d)"),
)
_SSN = re.compile(rf"(?<![\w./-])\d{{3}}(?:-|{_GAP})\d{{2}}(?:-|{_GAP})\d{{4}}(?![\w-]|[./]\d)")
_NINE = re.compile(r"(?<![\w./-])\d{9}(?![\w-]|[./]\d)")
_NINO = re.compile(rf"(?<!\w)[A-Z]{{2}}{_GAP}?\d{{2}}{_GAP}?\d{{2}}{_GAP}?\d{{2}}{_GAP}?[A-D](?!\w)")
_PASSPORT = re.compile(r"(?<![\w./-])(?:[A-Z]{1,2}\d{6,8}|\d{9}|[A-Z]\d{2}[A-Z]\d{5})(?![\w-])")
_CARD = re.compile(r"(?<![\w./-])\d(?:[ -]?\d){12,18}(?![\w-])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
#: Words before an identity number, and words that make a number something else.
_ID_LABEL = re.compile(r"(?:ssn|ss#|soc(?:ial|\.)?(?:[ \t\r\n>|:}]+sec(?:urity|\.)?)?|sozialversicherungs\w*|nino|ni|national[ \t\r\n>|:}]+insurance|insurance|passport|reisepass\w*|passeport|pasaporte)(?:[ \t\r\n>|:}]+(?:number|no\.?|nr\.?|num\.?|is|#))*[ \t\r\n>|:}#.]*$", re.I)
_NOT_PERSONAL = re.compile(r"(?:invoice|meter|contract|lot|deal|ticket|reference|ref\.?|order|build|feed|path|account|passcode|replaces|section|form|rechnung|vertrag|zähler)[ \t\r\n>|:}#]*(?:no\.?|number|nr\.?)?[ \t\r\n>|:}#]*$", re.I)
_PHONE_LABEL = re.compile(r"(?:phone|tel|telephone|cell|mobile|fax|direct|office|dial-in|call|reach (?:me|us) at|t|ph|fon)[ \t\r\n>|:}.]*(?:is|at)?[ \t\r\n>|:}]*$", re.I)
#: Street words.
_STREET = r"(?:Street|St|Avenue|Ave|Boulevard|Blvd|Road|Rd|Lane|Ln|Drive|Dr|Court|Ct|Way|Parkway|Pkwy|Place|Pl|Terrace|Ter|Square|Sq|Highway|Hwy|Circle|Cir|Trail|Row|Close|Crescent)"
_UNIT = rf"(?:(?:Suite|Ste|Apt|Apartment|Unit|Floor|Fl|Room|Rm|Bldg|Building)\.?{_GAP}\w{{1,5}}|\#{_GAP}?\w{{1,5}})"
_COMMA = rf"(?:,{_GAP}?|{_GAP})"
_TOWN = rf"[A-ZÄÖÜ][\w'.-]+(?:{_GAP}[A-ZÄÖÜ][\w'.-]+){{0,2}}"
_TAIL = rf"(?:,?{_GAP}?{_UNIT})?(?:,{_GAP}?{_TOWN}(?:,{_GAP}?[A-Z]{{2}}\b(?:{_GAP}\d{{5}}(?:-\d{{4}})?)?|{_GAP}\d{{5}})?)?"
_ADDRESSES = (
    re.compile(rf"(?<![\w.$-])\d{{1,5}}[a-z]?{_GAP}(?:[NSEW]\.?{_GAP})?(?:[A-Z][\w'-]+{_GAP}){{1,3}}{_STREET}\b\.?{_TAIL}"),
    re.compile(rf"\bP\.?{_GAP}?O\.?{_GAP}?Box{_GAP}\d{{1,6}}{_TAIL}", re.I),
    re.compile(rf"(?<!\w)(?:Am|An der|Im|Zum|Zur|Auf dem){_GAP}[A-ZÄÖÜ][\w-]+(?:{_GAP}[A-ZÄÖÜ][\w-]+)?{_GAP}\d{{1,4}}{_GAP}?[a-z]?,{_GAP}?\d{{4,5}}{_GAP}{_TOWN}"),
    re.compile(rf"(?<!\w)[A-ZÄÖÜ][\w-]*(?:straße|strasse|str\.|allee|weg|gasse|platz|ring|damm|ufer|steig|chaussee){_GAP}\d{{1,4}}{_GAP}?[a-z]?\b(?:,{_GAP}?(?:\d{{4,5}}{_GAP})?{_TOWN})?"),
    re.compile(rf"(?<!\w)(?:Am|An der|Im|Zum|Zur|Auf dem){_GAP}[A-ZÄÖÜ][\w-]+(?:{_GAP}[A-ZÄÖÜ][\w-]+)?{_GAP}\d{{1,4}}[a-z]?(?=\s*(?:\n|\r|$))"),
)
# One scan finds capitalised words and stretches of digits; everything costlier looks only there.
_SCAN = re.compile(r"([^\W\d_a-zà-öø-ÿßł](?:[^\W\d_]+|['’-](?=[^\W\d_]))*)|[+(]?\d(?:[-./() \t\r\n>|:}]{0,8}\d){6,}")
_STREET_HINT = re.compile(rf"^(?:{_STREET}|Box|Am|An|Im|Zum|Zur|Auf)$|(?:straße|strasse|str|allee|weg|gasse|platz|ring|damm|ufer|steig|chaussee)$")
#: Words that name a company or place after a capitalised word, titles, ordinary words that are names too, and words that follow them when they are not names.
COMPANY = frozenset(
    "accounts advisory analytics associates bank brokerage capital co company corp corporation energy gas generation gmbh group holdings inc limited llc logistics lp ltd marketing metering midstream partners petroleum pipeline plc power resources sa services shipping storage systems team trading transmission transport utilities ventures".split()
)
_PLACE = frozenset("bay blvd citygate county court creek drive field flats gate header house hub interconnect island junction lane lateral line meter north parkway plant point pool ridge road south st station street substation terminal tie town unit west zone east".split())
TITLES = frozenset("mr mrs ms miss dr prof herr frau sr sra señor señora monsieur madame mme sir".split())
_WORDLIKE = frozenset("will mark grant rose grace frank may april june august bill art sue pat drew dawn faith hope joy chance chase miles rich rob skip victor wade dean earl guy jack josh max melody misty ray robin sandy summer sterling tab tad theo ty van".split())
_AFTER_WORD = frozenset("the a an it its is was be been this that these those my our your his her their we i you he she they any some all no not do have see up down down in on of for to at as or".split())
_GREETING = frozenset("hi hello dear hey hola bonjour cher chère estimado estimada querido querida hallo lieber liebe guten tag morning afternoon evening good ciao".split())


def fold(word: str) -> str:
    """Lower case without diacritics."""
    word = word.lower().replace("ł", "l").replace("ø", "o").replace("æ", "ae").replace("ß", "ss").replace("đ", "d")
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def luhn(digits: str) -> bool:
    """The Luhn check of a card number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The mod-97 check of an IBAN."""
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _lettered(text: str, at: int) -> Iterator[tuple[float, int, int, str]]:
    """Identity numbers and account numbers that begin with letters, at a position."""
    if (m := _IBAN.match(text, at)) and mod97(m[0].replace(" ", "")):
        yield 0.95, m.start(), m.end(), "iban"
    for pattern, base, labelled in ((_NINO, 0.7, 0.2), (_PASSPORT, 0.1, 0.75)):
        if m := pattern.match(text, at):
            yield _id_score(text, m.start(), base, labelled), m.start(), m.end(), "id_number"


def _id_score(text: str, at: int, base: float, labelled: float) -> float:
    before = text[max(0, at - 45) : at]
    return base + (labelled if _ID_LABEL.search(before) else 0) - (0.5 if _NOT_PERSONAL.search(before) else 0)


def _numbers(text: str, lo: int, hi: int) -> Iterator[tuple[float, int, int, str]]:
    """(score, start, end, type) of confirmed proposals in the stretch of digits [lo, hi)."""
    digits = sum(c.isdigit() for c in text[lo:hi])
    if digits >= 13:
        for m in _CARD.finditer(text, lo, hi):
            if len(_digits(m[0])) <= 19 and luhn(_digits(m[0])) and re.search(r"(?:card|visa|amex|mastercard)\W{1,12}$", text[max(0, m.start() - 30) : m.start()], re.I):
                yield 0.9, m.start(), m.end(), "card"
    if digits >= 9:
        for pattern, base, labelled in ((_SSN, 0.6, 0.4), (_NINE, 0.1, 0.7)):
            for m in pattern.finditer(text, lo, min(len(text), hi + 1)):
                yield _id_score(text, m.start(), base, labelled), m.start(), m.end(), "id_number"
    for k, pattern in enumerate(_PHONES):
        for m in pattern.finditer(text, max(0, lo - 1), min(len(text), hi + 20)):
            before = text[max(0, m.start() - 30) : m.start()]
            score = (0.7, 0.45, 0.7, 0.6)[k] + (0.25 if _PHONE_LABEL.search(before) else 0) - (0.6 if _NOT_PERSONAL.search(before) else 0)
            number = _digits(re.split(r"[xXeE]", m[0])[0])
            if k < 2:
                local = number[-10:]
                score += 0.1 if local[0] in "23456789" and local[3] in "23456789" else -0.4
            if not 7 <= len(number) <= 15:
                score -= 0.5
            yield score, m.start(), m.end(), "phone"


def _street(text: str) -> Iterator[tuple[float, int, int, str]]:
    for pattern in _ADDRESSES:
        for m in pattern.finditer(text):
            yield 0.8, m.start(), m.end(), "address"


def _emails(text: str) -> Iterator[tuple[float, int, int, str]]:
    for m in _EMAIL.finditer(text) if "@" in text else ():
        start = m.start() + len(m[0]) - len(m[0].lstrip("'.-+"))
        yield 0.95, start, m.end(), "email"
    low = text.lower()
    if "dot" in low or "(at)" in low or "[at]" in low or "punkt" in low or "(@)" in low:
        for m in _EMAIL_SPELT.finditer(text):
            parts = re.split(r"[\s>|:}().\[\]]+", m[0].lower())
            if "dot" in parts[parts.index("at") :] if "at" in parts else True:
                yield 0.9, m.start(), m.end(), "email"
            elif re.search(r"[(\[](?:at|@)[)\]]", m[0]):
                yield 0.9, m.start(), m.end(), "email"


class Names:
    """Names in text, given the model: word -> (times as given name, times as surname)."""

    def __init__(self, model: dict[str, tuple[int, int]]):
        self.given = {w for w, (g, s) in model.items() if g > s and len(w) > 2}
        self.surname = {w for w, (g, s) in model.items() if s >= g and len(w) > 2}
        self.cache: dict[str, str] = {}
        self.streets: set[str] = set()

    def kind(self, word: str) -> str:
        """G given, S surname, T title, I initial, C company word, P place word, U unknown."""
        k = self.cache.get(word)
        if k is None:
            low, plain = word.lower(), fold(word)
            if len(word) == 1:
                k = "I"
            elif low in TITLES:
                k = "T"
            elif plain in self.given:
                k = "G"
            elif plain in self.surname:
                k = "S"
            elif low in COMPANY:
                k = "C"
            elif low in _PLACE:
                k = "P"
            elif len(word) == 2 and word.isupper():
                k = "J"  # two initials
            else:
                k = "U"
            if len(self.cache) > 300_000:
                self.cache.clear()
                self.streets.clear()
            if _STREET_HINT.search(word):
                self.streets.add(word)
            self.cache[word] = k
        return k

    def spans(self, text: str, words: list[tuple[int, int, str, str]], taken: list[tuple[int, int]]) -> Iterator[tuple[float, int, int, str]]:
        """Mentions among the capitalised ``words`` outside the spans ``taken`` (both sorted)."""
        free, t, nt = [], 0, len(taken)
        for word in words:
            while t < nt and taken[t][1] <= word[0]:
                t += 1
            if t >= nt or taken[t][0] >= word[1]:
                free.append(word)
        words = free
        i, n = 0, len(words)
        while i < n:
            k = words[i][3]
            # an unknown word begins a mention only before a given name, or as SURNAME/GIVEN
            if k in "GSIJT" or (k == "U" and i + 1 < n and (words[i + 1][3] == "G" or (words[i + 1][3] == "S" and text[words[i][1]] == "/"))):
                j, score = self._mention(text, words, i)
                if j:
                    first = i + 1 if k == "T" else i
                    yield score, words[first][0], words[j - 1][1], "name"
                    i = j
                    continue
            i += 1

    def _mention(self, text: str, words: list[tuple[int, int, str, str]], i: int) -> tuple[int, float]:
        """(index after the mention, score) of a mention that begins at word ``i``, or (0, 0)."""
        n = len(words)

        def gap(a: int) -> str:
            """What stands between words a and a + 1, with a line break read as a space."""
            between = text[words[a][1] : words[a + 1][0]] if a + 1 < n else "?"
            return re.sub(r"[ \t]*\r?\n[ \t]*(?:[>|:}][ \t]?)*", " ", between) if "\n" in between and between.count("\n") == 1 else between

        def kind(a: int) -> str:
            return words[a][3] if a < n else "?"

        def company(a: int) -> bool:
            """Whether word a is followed by a company word, so that it is part of a company's name."""
            return a + 1 < n and kind(a + 1) == "C" and gap(a) == " "

        def place(a: int) -> bool:
            return a + 1 < n and kind(a + 1) == "P" and gap(a) == " " and "\n" not in text[words[a][1] : words[a + 1][0]]

        s, e, w, k = words[i]
        if k == "T":
            if kind(i + 1) in "SUG" and gap(i) in (" ", ". ", ".") and not company(i + 1):
                j = i + 2
                if kind(i + 1) == "G" and kind(j) in "SU" and j < n and gap(i + 1) == " ":
                    j += 1
                return j, 0.9
            return 0, 0
        if k in "IJ":
            if i + 1 < n and gap(i) in (". ", ".", " ") and (k == "J" or gap(i) != " "):
                j = i + 1
                if kind(j) == "I" and gap(j) in (". ", "."):
                    j += 1
                if (kind(j) == "S" or (kind(j) == "U" and k == "I" and words[j][2][1:].islower() and len(words[j][2]) > 3)) and not company(j) and not place(j):
                    return j + 1, 0.8
            return 0, 0
        between = gap(i) if i + 1 < n else "?"
        if between == "/" and w.isupper() and words[i + 1][2].isupper() and len(w) > 2 and len(words[i + 1][2]) > 2 and ("G" in (k, kind(i + 1)) or "S" in (k, kind(i + 1))):
            return i + 2, 0.9
        if k in "SU" and between == ", " and kind(i + 1) == "G" and (k == "S" or "\n" not in text[e : words[i + 1][0]]) and (k == "S" or re.search(r"(?:From|To|Cc|Von|An|De|À|Para)\s*:\s*$|;\s*$|^$|[\n\"']\s*$", text[max(0, s - 12) : s])):
            j = i + 2
            if kind(j) == "I" and gap(i + 1) == " ":
                j += 1
            elif k == "U" and kind(j) in "SU" and gap(i + 1) == " ":
                return 0, 0
            return j, 0.85
        if k == "G":
            j, at = i + 1, i
            while kind(j) == "I" and j < n and gap(at) == " " and gap(j) in (". ", " "):
                at, j = j, j + 1
            if j < n and (gap(at) in (" ",) or at > i) and kind(j) == "S" and not company(j):
                return j + 1, 0.9
            if j < n and (gap(at) == " " or at > i) and kind(j) == "U" and len(words[j][2]) > 3 and words[j][2][1:].islower() == w[1:].islower() and not company(j) and not place(j) and not self._sentence(text, words, j):
                return j + 1, 0.75
            if company(i) or place(i) or (i + 2 < n and kind(i + 1) == "U" and company(i + 1) and gap(i) == " "):
                return 0, 0
            return i + 1, 0.7 if self._person(text, s, e, w) else 0.3
        if k == "S":
            if company(i) or place(i):
                return 0, 0
            if between == " " and kind(i + 1) == "G" and (w.isupper() == words[i + 1][2].isupper()):
                return i + 2, 0.8
            if between == " " and kind(i + 1) == "I" and text[words[i + 1][1] : words[i + 1][1] + 1] == ".":
                return i + 2, 0.7
            return i + 1, 0.65
        return 0, 0

    @staticmethod
    def _sentence(text: str, words: list[tuple[int, int, str, str]], j: int) -> bool:
        """Whether word j starts a line of its own, as a company or a title does under a signature."""
        between = text[words[j - 1][1] : words[j][0]]
        return "\n" in between and (text[: words[j - 1][0]].rfind("\n") + 1 >= words[j - 1][0] - 3)

    @staticmethod
    def _person(text: str, s: int, e: int, w: str) -> bool:
        """Whether a given name that is an ordinary word too is used as a name here."""
        low = w.lower()
        if low not in _WORDLIKE:
            return True
        m = re.match(r"[ \t\r\n>|}]*([^\W\d_]+)", text[e : e + 40])
        after = m[1].lower() if m else ""
        b = re.search(r"([^\W\d_]+)[ \t]*$", text[max(0, s - 24) : s])
        before = b[1].lower() if b else ""
        if w.isupper() and len(w) > 1:
            return False
        alone = re.match(r"[ \t]*(?:$|\r?\n[ \t>|:}]*(?:\r?\n|$))", text[e : e + 60])
        if before in _GREETING or text[e : e + 1] in (",", ":", "-") or text[e : e + 2] in (" -", "") or alone:
            return low != "may" or before in _GREETING
        return after not in _AFTER_WORD and not re.match(r"\s*\d", text[e : e + 6]) and low not in ("may", "april", "june", "august")


def find(text: str | None, names: Names) -> list[tuple[int, int, str]]:
    """(start, end, type) of the kept spans of a text, in order."""
    if not text:
        return []
    words: list[tuple[int, int, str, str]] = []
    proposals = list(_emails(text))
    kinds, streets = names.cache, False
    for m in _SCAN.finditer(text):
        w = m[1]
        s, e = m.span()
        if w is None:
            proposals += _numbers(text, s, e)
            continue
        if w[-2:] in ("'s", "’s", "'S"):
            w, e = w[:-2], e - 2
        k = kinds.get(w) or names.kind(w)
        if len(w) <= 2 and (text[e : e + 1].isdigit() or text[e + 1 : e + 2].isdigit()):
            proposals += _lettered(text, s)
        streets = streets or w in names.streets
        words.append((s, e, w, k))
    if streets:
        proposals += _street(text)
    proposals = [p for p in proposals if p[0] >= MIN_SCORE]
    # emails and addresses first, then the better score, then the longer span
    proposals.sort(key=lambda p: (p[3] != "email", p[3] != "address", -p[0], p[1] - p[2], p[1]))
    kept: list[tuple[int, int, str]] = []
    for _, s, e, what in proposals:
        at = bisect(kept, (s, e, what))
        if (at == 0 or kept[at - 1][1] <= s) and (at == len(kept) or kept[at][0] >= e):
            kept.insert(at, (s, e, what))
    found = names.spans(text, words, [(s, e) for s, e, _ in kept])
    return sorted(kept + [(s, e, what) for score, s, e, what in found if score >= MIN_SCORE])


def mask(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with each span replaced by its placeholder, such as ``[NAME]``."""
    if not text:
        return text
    out, at = [], 0
    for s, e, what in spans:
        out += [text[at:s], f"[{what.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def name_model(typed: DataFrame) -> DataFrame:
    """(word, given, surname): the name model of ``typed`` (name, address): names written given name first, whose address repeats the surname."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, given, last = [], [], []
            for name, address in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                local, _, domain = (address or "").lower().partition("@")
                parts = re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", re.sub(r"\(.*?\)|<.*", "", name or ""))
                parts = [p for p in parts if len(p) > 1 and p.lower() not in TITLES]
                if len(parts) != 2 or "," in name or name.isupper() or parts[1].lower() in COMPANY or parts[0].islower():
                    continue
                first, surname = fold(parts[0]), fold(parts[1])
                if local.endswith(surname) and not (len(surname) > 3 and surname in domain.split(".")[0]):
                    words += [first, surname]
                    given += [1, 0]
                    last += [0, 1]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(given, pa.int64()), pa.array(last, pa.int64())], ["word", "given", "surname"])

    counted = typed.distinct().mapInArrow(read, "word string, given bigint, surname bigint").groupBy("word").agg(F.sum("given").alias("given"), F.sum("surname").alias("surname"))
    return counted.persist()


def _modelled(rows: DataFrame, model: DataFrame, fields: tuple[str, ...]) -> tuple[DataFrame, dict[str, tuple[int, int]] | None]:
    """``rows`` (id, fields) with a column ``model``, and the model if it is small enough to be sent to every worker.

    A larger model is joined by word: each message then has the part of it that its own words need, so no word is left out.
    """
    if small_enough(model, BROADCAST_NAME_WORDS):
        return rows.withColumn("model", F.lit(None).cast("array<struct<word:string,given:bigint,surname:bigint>>")), {r["word"]: (r["given"], r["surname"]) for r in model.collect()}

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted({fold(m[1].removesuffix("'s").removesuffix("’s").removesuffix("'S")) for text in texts for m in _SCAN.finditer(text or "") if m[1]}) for texts in zip(*(batch.column(k + 1).to_pylist() for k in range(len(fields))))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.string()))], ["id", "words"])

    asked = rows.select("id", *fields).mapInArrow(words, "id string, words array<string>").select("id", F.explode("words").alias("word"))
    told = asked.join(model, "word").groupBy("id").agg(F.collect_list(F.struct("word", "given", "surname")).alias("model"))
    return rows.join(told, "id", "left"), None


def _names(shared, batch: pa.RecordBatch, column: int) -> Iterator[Names]:
    """The names of each row: one model for all, or the row's own."""
    if shared is not None:
        while True:
            yield shared
    for rows in batch.column(column).to_pylist():
        yield Names({r["word"]: (r["given"], r["surname"]) for r in rows or ()})


def typed_names(mails: DataFrame, mailboxes: DataFrame, mentions: DataFrame) -> DataFrame:
    """(name, address): how people are written in the name columns."""
    senders = mails.select(F.col("from_name").alias("name"), F.col("from_addr").alias("address"))
    to = mails.select(F.explode("to_addrs").alias("t")).where(F.col("t").contains("<"))
    to = to.select(F.trim(F.regexp_extract("t", r"^([^<]*)<", 1)).alias("name"), F.regexp_extract("t", r"<([^>]*)>", 1).alias("address"))
    owners = mailboxes.select(F.col("owner_name").alias("name"), F.col("owner_addr").alias("address"))
    known = mentions.select(F.col("name_typed").alias("name"), "address")
    return senders.unionByName(to).unionByName(owners).unionByName(known).where("name is not null and address is not null").distinct()


def spans(mails: DataFrame, model: DataFrame, fields: tuple[str, ...] = ("body", "quoted_text")) -> DataFrame:
    """(id, field_name, pii_type, start_pos, end_pos) of ``mails`` (id, arrival, and the fields)."""
    once, whole = _modelled(first_deliveries(mails.select("id", "arrival", *fields)).select("id", *fields), model, fields)
    shared = mails.sparkSession.sparkContext.broadcast(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = None if shared.value is None else Names(shared.value)
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for k, field in enumerate(fields):
                for ident, text, names in zip(batch.column(0).to_pylist(), batch.column(k + 1).to_pylist(), _names(every, batch, len(fields) + 1)):
                    for s, e, what in find(text, names):
                        for column, value in zip(out, (ident, field, what, s, e)):
                            column.append(value)
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["id", "field_name", "pii_type", "start_pos", "end_pos"])

    return once.mapInArrow(run, "id string, field_name string, pii_type string, start_pos int, end_pos int")


def masked(mails: DataFrame, model: DataFrame, fields: tuple[str, ...] = ("body", "quoted_text")) -> DataFrame:
    """(id, and the fields with placeholders), one row per distinct id."""
    once, whole = _modelled(first_deliveries(mails.select("id", "arrival", *fields)).select("id", *fields), model, fields)
    shared = mails.sparkSession.sparkContext.broadcast(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = None if shared.value is None else Names(shared.value)
        for batch in batches:
            columns = [pa.array([mask(t, find(t, names)) for t, names in zip(batch.column(k + 1).to_pylist(), _names(every, batch, len(fields) + 1))], pa.string()) for k in range(len(fields))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *fields])

    return once.mapInArrow(run, "id string, " + ", ".join(f"{f} string" for f in fields))
