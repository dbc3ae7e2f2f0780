"""Personal information in free text: found, and replaced by placeholders of its type.

Information-theoretic sanitisation in two passes over the corpus. The first counts, over
all documents, how often terms occur beside something that is protected for certain: a
word beside a known name part, or a phrase around a certain name or number. What a term
discloses of a protected entity beside it is their pointwise mutual information, in
bits: how much more likely the entity is beside the term than at a random word of the
corpus. The entity's own information is the logarithm of that prior, and a term discloses
it if it gives away at least the share ``DISCLOSED`` of it. The second pass takes
candidates by their shape and keeps those whose terms disclose enough; they are
generalised to their type.

Certain from the start are names of two known parts, and mail addresses, addresses and
numbers of a shape that nothing else has. What the corpus decides are name parts that are
not known yet, phrases that introduce names or plain numbers, words before a number that
tell of a thing and not a person, and terms that look like a part of an address or name
but always come with the same value and so disclose nothing.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.plans.lineage import release, spread, stash

#: A term discloses a protected entity if it gives away this share of the entity's information ...
DISCLOSED = 0.75
#: ... and is beside one so often.
LEAST_SUPPORT = 2

#: A part or street of which a smaller share of contexts has a disclosing phrase isn't introduced by them.
LEAST_INTRODUCED = 0.25

#: A word before so many numbers that identity numbers follow it more rarely than any word tells of a thing.
THING_SUPPORT = 20

#: Name parts up to which lines are first tested by one pattern of all of them; the automaton alone gives the same.
FEW_PARTS = 5_000

#: Terms of the lexicon up to which it is brought to the tasks whole; a larger one is joined to blocks of documents.
LEXICON_TERMS = 1_000_000
#: Documents of such a block.
BLOCK_DOCUMENTS = 2_000

#: A word beside so many different parts that disclose a name is a name part, however often it is used otherwise.
MANY_COMPANIONS = 3

#: A family name that follows a given name in less than this share of at least so many occurrences says little by itself.
WEAK_SHARE, WEAK_SUPPORT = 0.15, 5

#: A known part or word is common if it is in lower case this often, and not much rarer than capitalised.
COMMON_SUPPORT, COMMON_SHARE = 5, 0.3

#: A word of which more than this share of companions is the same one is no name part if it
#: is in so many different lines, and too few of them have a phrase that discloses names. A street
#: with one house number discloses no address if it is, and too few have a phrase that is beside other streets too.
MOST_CONSTANT, MANY_CONTEXTS = 0.8, 5

_MARKS = "̀-ͯ"
_UP, _LOW = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
_GAP = "[    ][​‌‍﻿]?[    ]?"
_LETTERS = rf"[^\W\d_](?:[^\W\d_]|[{_MARKS}]|['’](?=[^\W\d_]))*"

# --- shapes ---------------------------------------------------------------------------------------

_LOCAL = r"[A-Za-z0-9À-ÖØ-öø-ÿ_%+-](?:[A-Za-z0-9À-ÖØ-öø-ÿ_.%+-]*[A-Za-z0-9À-ÖØ-öø-ÿ_%+-])?"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_AT = r"(?:@| @ | ?[\(\[\{] ?(?i:at) ?[\)\]\}] ?| AT (?=\S+ DOT )| at (?=\S+ dot ))"
_DOT = r"(?:\.| ?[\(\[\{] ?(?i:dot) ?[\)\]\}] ?| DOT | dot )"
EMAIL = re.compile(rf"(?<![\w@.+-]){_LOCAL}{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,24}}(?![\w@-])(?!\.[A-Za-z0-9])")
_MAIL_HINT = re.compile(r"@|(?i:[\(\[\{] ?at ?[\)\]\}])| DOT | dot ")

_S = "[    ./‑–-]"
_NB = "[    ]"
_ENDS = r"(?![\w/])(?![-.‑]\w)"
PHONE = re.compile(
    rf"(?<![\w.+/-])(?<!\d[ ,])(?:"
    rf"(?:\+|00(?=[1-9])){_S}?[1-9]\d{{0,2}}(?:{_S}{{0,2}}\(\d{{1,5}}\)|{_S}?\d)(?:{_S}{{0,2}}\d|{_S}?\(\d{{1,5}}\)){{5,12}}"
    rf"|\(\d{{2,5}}\){_S}{{0,2}}\d{{3,4}}(?:{_S}?\d{{2,5}}){{1,2}}"
    rf"|0[1-9]\d{{0,3}}(?:{_NB}|[/-])\d{{3,6}}(?:(?:{_NB}|-)\d{{3,5}}){{0,2}}"
    rf"|0[1-9](?:(?:{_NB}|\.)\d\d){{4}}"
    rf"|[2-9]\d\d(?P<sep>{_NB}|[-.‑])\d{{3}}(?P=sep)\d{{4}}"
    rf"){_ENDS}"
)
_PLAIN_NUMBER = re.compile(rf"(?<![\w.+/-])(?:0\d{{9,10}}|[2-9]\d{{9}}){_ENDS}")
IDENTITY = re.compile(
    rf"(?<![\w.+/-])(?<!\d )(?:"
    rf"[A-Z]{{2}}(?P<gap>{_NB}?)\d\d(?P=gap)\d\d(?P=gap)\d\d(?P=gap)[A-D]"
    rf"|\d\d{_NB}\d{{3}}{_NB}\d{{3}}{_NB}\d{{3}}"
    rf"|\d{{3}}(?P<s>{_NB}|-)\d\d(?P=s)\d{{4}}"
    rf"|[A-Z]\d\d[A-Z]\d{{5}}"
    rf"|\d{{6}}[-+]\d{{4}}"
    rf"|[A-Z]\d{{8}}"
    rf"){_ENDS}(?! \d)"
)

_TYPE = "(?:Street|St|Road|Rd|Lane|Ln|Way|Drive|Dr|Avenue|Ave|Court|Ct|Close|Terrace|Place|Square|Boulevard|Blvd|Crescent|Row|Gardens|Grove|Hill|Walk)"
_NAME = rf"[{_UP}][{_MARKS}]?[{_LOW}{_MARKS}’']+(?:-[{_UP}{_LOW}][{_LOW}{_MARKS}]+)*"
_HOUSE = r"\d{1,4}[a-zA-Z]?"
_OF = r"(?:(?:de|du|des|del|la|las|los|el|le|les)[  ]|[dl]['’])"
ADDRESS_EN = re.compile(rf"(?<![\w.,/-])(?<!\d )(?P<house>{_HOUSE}){_NB}(?:[NSEW]\.?[ ])?(?P<street>{_NAME}(?:[ ]{_NAME}){{0,2}}?){_NB}{_TYPE}\b")
ADDRESS_DE = re.compile(rf"(?<![\w-])(?P<street>[{_UP}][{_LOW}{_MARKS}-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm|ring)){_NB}(?P<house>{_HOUSE})(?![\w])")
ADDRESS_ES = re.compile(rf"(?<!\w)(?:Calle|Avenida|Avda\.|Plaza|Paseo|Camino|C/){_NB}(?P<street>{_OF}*{_NAME}(?:[ ]{_OF}*{_NAME}){{0,3}}),?{_NB}(?P<house>{_HOUSE})(?!\w)")
ADDRESS_FR = re.compile(rf"(?<![\w.,/-])(?<!\d )(?P<house>\d{{1,4}}(?:[ ](?:bis|ter|quater))?[a-zA-Z]?),?{_NB}(?:rue|avenue|place|boulevard|chemin|quai|allée|impasse|cours|route){_NB}(?P<street>{_OF}*{_NAME})(?:{_NB}(?P<more>{_NAME}))?")
_STREET_ENDS = ("straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "ufer", "damm", "ring")
_HOUSE_FIRST = re.compile(rf"\d[a-zA-Z]?(?:,| bis,?| ter,?| quater,?)?{_NB}(?:[{_UP}]|rue|avenue|place|boulevard|chemin|quai|allée|impasse|cours|route)")
_HOUSE_LAST = re.compile("\\d(?:" + "|".join(rf"(?<={re.escape(w)}{_NB}\d)" for w in _STREET_ENDS) + ")")
_SPANISH = ("Calle", "Avenida", "Avda.", "Plaza", "Paseo", "Camino", "C/ ")
_NUMBER_HINT = re.compile(rf"\d(?:[    ./()‑–-]{{0,3}}\d){{6}}|\d\d{_NB}?\d\d{_NB}?\d\d{_NB}?[A-D]\b|\d[A-Z]\d{{5}}")

# Words before the numbers of things.
THINGS = "build|ticket|order|part|version|release|invoice|serial|batch|bestellung|teil|rechnung|auftrag|commande|pièce|facture|pedido|pieza|factura|versión"

# Words that join given and family names.
PARTICLES = "von|van|de|der|den|del|della|di|da|do|dos|du|al|el|la|le|bin|ben|zu|ter|ten|af|av|san"

_PARTICLE = rf"(?:(?:(?i:{PARTICLES})|d['’]){_GAP}){{0,2}}"
_INITIAL = rf"[{_UP}]\."
_PARTICLES = frozenset(PARTICLES.split("|"))
_DOUBLE = re.compile(rf"{_LETTERS}(?:-{_LETTERS}){{0,2}}")
_AFTER_FORMS = [
    re.compile(rf"(?P<middle>(?:{_GAP}(?:{_INITIAL}|{_LETTERS})){{{n}}}){_GAP}(?P<particle>{_PARTICLE})(?P<family>{_LETTERS}(?:-{_LETTERS}){{0,2}})(?![\w{_MARKS}])") for n in range(3)
]
_BEFORE_GIVEN = re.compile(rf"(?P<family>{_LETTERS}(?:-{_LETTERS}){{0,2}}),{_GAP}$")
_GIVEN_BEFORE = re.compile(rf"(?:^|[^\w{_MARKS}.@+’'-])(?P<given>{_LETTERS})(?P<middle>(?:{_GAP}{_INITIAL}){{0,2}}){_GAP}$")
_INITIALS_BEFORE = re.compile(rf"(?:^|[^\w.{_MARKS}])((?:{_INITIAL}{_GAP}){{1,2}}){_PARTICLE}$")
_INITIAL_FAMILY = re.compile(rf"(?<![\w.{_MARKS}])(?:{_INITIAL}{_GAP}){{1,2}}(?P<particle>{_PARTICLE})(?P<family>{_LETTERS}(?:-{_LETTERS}){{0,2}})(?![\w{_MARKS}])")
_INITIAL_AFTER = re.compile(rf"{_GAP}{_INITIAL}(?!\w)")
_SWAPPED_AFTER = re.compile(rf",{_GAP}(?P<given>{_INITIAL})(?!\w)")
_CAPITALISED = re.compile(rf"[{_UP}][{_MARKS}]*[{_LOW}{_MARKS}]+")
_PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "\n\r\t—–…“”„«»‘’¿¡​‌‍﻿   "
_TOKEN = re.compile(rf"{_LETTERS}|[^\w\s]|\d+")


def fold(word: str) -> str:
    """The form by which words are looked up: composed and without letter case."""
    return word.casefold() if word.isascii() else unicodedata.normalize("NFC", word).casefold()


def _style(word: str) -> str:
    """How a word is written: Cap, CAPS or low."""
    letters = unicodedata.normalize("NFC", word)
    if letters.islower():
        return "low"
    if letters.isupper() and len(letters) > 1:
        return "CAPS"
    return "Cap" if letters[:1].isupper() and letters[1:2].islower() else "odd"


@dataclass
class Lexicon:
    """What the corpus discloses: name parts, phrases, and street terms that are constant."""

    given: set[str] = field(default_factory=set)
    family: set[str] = field(default_factory=set)
    common: set[str] = field(default_factory=set)
    phrases: set[str] = field(default_factory=set)
    number_phrases: set[str] = field(default_factory=set)
    constant_streets: set[str] = field(default_factory=set)
    weak: set[str] = field(default_factory=set)
    street_pairs: set[str] = field(default_factory=set)
    things: set[str] = field(default_factory=lambda: set(THINGS.split("|")))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("scanner", "any_part")}

    def pattern(self) -> str:
        """A pattern that is in every line with a name part, in any letter case."""
        if "any_part" not in self.__dict__:
            written = {w for p in self.given | self.family or {"\0"} for w in (p, unicodedata.normalize("NFD", p))}
            self.__dict__["any_part"] = "(?i:" + "|".join(re.sub(r"([!-/:-@\[-`{-~])", r"\\\1", w) for w in sorted(written)) + ")"
        return self.__dict__["any_part"]

    def anchors(self, text: str) -> Iterator[tuple[int, int, str]]:
        """``(start, end, part)`` of each name part in a text, as a whole word in any letter case."""
        scanner = self.__dict__.get("scanner")
        if scanner is None:
            scanner = self.__dict__["scanner"] = ahocorasick.Automaton()
            for part in self.given | self.family:
                for written in {part, unicodedata.normalize("NFD", part)}:
                    scanner.add_word(written, (len(written), part))
            scanner.make_automaton()
        if not len(scanner):
            return
        low = text.lower()
        if len(low) != len(text):
            # the only sign that is longer in lower case
            low = text.replace("\u0130", "\u0131").lower()
        for last, (length, part) in scanner.iter(low):
            start, end = last + 1 - length, last + 1
            before, after = low[start - 1 : start], low[end : end + 1]
            if not before.isalnum() and not (after.isalnum() or "\u0300" <= after <= "\u036f"):
                yield start, end, part


_BLANKS = frozenset(" \u00a0\u202f\u2009\u200b\u200c\u200d\ufeff")
_SPACE = frozenset(" \t\r\n\u00a0\u202f\u2009\u200b\u200c\u200d\ufeff\u3000")


def _back(text: str, at: int, words: int) -> int:
    """Where the last ``words`` words before a place begin, however long they are."""
    for _ in range(words):
        while at and text[at - 1] in _SPACE:
            at -= 1
        while at and text[at - 1] not in _SPACE:
            at -= 1
    return at


def _ahead(text: str, at: int, words: int) -> int:
    """Where the next ``words`` words after a place end."""
    n = len(text)
    for _ in range(words):
        while at < n and text[at] in _SPACE:
            at += 1
        while at < n and text[at] not in _SPACE:
            at += 1
    return at


def phrases_around(line: str, start: int, end: int) -> tuple[str, str]:
    """The two tokens before and after a span, the phrases that may introduce it; line ends count as tokens."""
    before = ["^", *(fold(t) for t in _TOKEN.findall(line[_back(line, start, 2) : start]))][-2:]
    after = [*(fold(t) for t in _TOKEN.findall(line[end : _ahead(line, end, 2)])), "$"][:2]
    return "<" + " ".join(before), ">" + " ".join(after)


@dataclass
class NameSpan:
    start: int
    end: int
    given: str
    family: str
    given_known: bool
    family_known: bool
    style: str


def name_spans(text: str, lexicon: Lexicon) -> Iterator[NameSpan]:
    """Spans shaped like a name around each known part; the other part may be unknown."""
    for start, end, part in lexicon.anchors(text):
        before = text[start - 1 : start]
        if before and before in ".@_+’'":
            continue
        if part in lexicon.given and before != "-":
            yield from _around_given(text, start, end, part, lexicon)
        if part in lexicon.family and before != "-":
            yield from _around_family(text, start, end, lexicon)


def _family_parts(said: str) -> list[str]:
    return [fold(p) for p in said.split("-")]


def _trim(said: str) -> str:
    """A word without a possessive ending."""
    return said[:-2] if said.endswith(("'s", "’s", "'S", "’S")) else said


def _around_given(text: str, start: int, end: int, given: str, lexicon: Lexicon) -> Iterator[NameSpan]:
    style = _style(text[start:end])
    best = None
    if text[end : end + 1] in _BLANKS:
        # the shortest run that ends in a family name, else the next word alone
        for form in _AFTER_FORMS:
            hit = form.match(text, end)
            if not hit:
                break
            family = _trim(hit["family"])
            middle = hit["middle"].split()
            if not all(_INITIAL_ONLY.fullmatch(x) or fold(x) in lexicon.given for x in middle):
                break
            if any(p in lexicon.family for p in _family_parts(family)):
                best = (hit, family, True)
                break
            if best is None or middle and _INITIAL_ONLY.fullmatch(middle[-1]):
                best = (hit, family, False)
        if best:
            hit, family, known = best
            stop = hit.start("family") + len(family)
            told = known or style != "low" or bool(lexicon.phrases) and given not in lexicon.common
            if told and text[stop : stop + 1] not in _GLUE and _same_style(style, [family]):
                yield NameSpan(start, stop, given, fold(family), True, known, style)
                return
    if text[start - 2 : start - 1] == "," or text[start - 3 : start - 2] == ",":
        low = max(0, _back(text, start, 2) - 1)
        head = _BEFORE_GIVEN.search(text[low:start])
        if head:
            begin, family = low + head.start("family"), head["family"]
            prior = text[begin - 1 : begin]
            known = all(p in lexicon.family for p in _family_parts(family))
            follow = _INITIAL_AFTER.match(text, end)
            if not (prior and (prior.isalnum() or prior in ".@_+-’'")) and _same_style(style, [family]):
                sure = known and (style != "low" or not lexicon.common & {given, *_family_parts(family)})
                yield NameSpan(begin, follow.end() if follow else end, given, fold(family), True, sure, style)


_INITIAL_ONLY = re.compile(_INITIAL)
_GLUE = frozenset("@_")


def _around_family(text: str, start: int, end: int, lexicon: Lexicon) -> Iterator[NameSpan]:
    before = text[start - 1 : start]
    family = _trim(_DOUBLE.match(text, start).group())
    stop = start + len(family)
    if text[stop : stop + 1] in _GLUE or text[stop : stop + 1].isalnum():
        return
    style = _style(family.split("-")[0])
    if before in _BLANKS:
        low = max(0, _back(text, start, 6) - 1)
        words = text[low:start].split()
        at = -1
        while words and len(words) + at > 0 and words[at].casefold() in _PARTICLES:
            at -= 1
        last = words[at] if words and len(words) + at >= 0 else ""
        if last[-1:] == "." and last[-2:-1].isupper() and not last[-3:-2].isalnum():
            initials = _INITIALS_BEFORE.search(text[low:start])
            if initials and style in ("Cap", "CAPS"):
                yield NameSpan(low + initials.start(1), stop, "", fold(family), True, True, style)
        if at == -1 and style != "low" and (last[:1].isupper() or last[-1:] == "."):
            given = _GIVEN_BEFORE.search(text[low:start])
            if given and fold(given["given"]) not in lexicon.given and _same_style(style, [given["given"]]):
                yield NameSpan(low + given.start("given"), stop, fold(given["given"]), fold(family), False, True, style)
    if text[stop : stop + 1] == "," and fold(family) not in lexicon.common and style != "low":
        swapped = _SWAPPED_AFTER.match(text, stop)
        if swapped and not (before and (before.isalnum() or before in ".@_+-’'")):
            yield NameSpan(start, swapped.end(), "", fold(family), True, True, style)


def initial_spans(text: str, lexicon: Lexicon) -> Iterator[NameSpan]:
    """Spans of initials and a family name that isn't known."""
    for m in _INITIAL_FAMILY.finditer(text):
        family = _trim(m["family"])
        if not any(p in lexicon.family for p in _family_parts(family)) and _style(family.split("-")[0]) in ("Cap", "CAPS"):
            yield NameSpan(m.start(), m.start("family") + len(family), "", fold(family), True, False, _style(family.split("-")[0]))


def _same_style(style: str, others: Iterable[str]) -> bool:
    return style != "odd" and all({_style(p) for p in o.split("-")} == {style} for o in others)


#: More than a number's shape can have before and after the seven digits of the hint: twelve more digits, each with two signs and brackets of up to five.
_NUMBER_BEFORE, _NUMBER_AFTER = 16, 120


def _windows(hint: re.Pattern, text: str, before: int, after: int) -> Iterator[tuple[int, int]]:
    """The stretches around what a cheap pattern finds, merged where they touch."""
    low = high = -1
    for m in hint.finditer(text):
        if m.start() - before > high:
            if high >= 0:
                yield low, high
            low = max(0, m.start() - before)
        high = min(len(text), m.end() + after)
    if high >= 0:
        yield low, high


_THREE_GROUPS = re.compile(r"(\d{3})\D\d\d\D(\d{4})")


def _issued(number: str) -> bool:
    """Whether a number isn't all zeros, nor one of three groups of which the first or last is; those are never issued."""
    groups = _THREE_GROUPS.fullmatch(number)
    return bool(re.search("[1-9]", number)) and not (groups and "0" * len(groups[1]) in groups.groups() or groups and groups[2] == "0000")


# Words that only say that a number follows.
_NUMBER_WORDS = frozenset(("no", "nr", "number", "num", "nummer", "numéro", "número", "id"))


def word_before(text: str, start: int) -> str:
    """The word that stands before a number, at most three signs away, folded; empty if none does. Words that only say number are passed over."""
    at, word = start, ""
    for _ in range(2):
        signs = 0
        while at and signs < 3 and not (text[at - 1].isalnum() or text[at - 1] == "_"):
            at, signs = at - 1, signs + 1
        end = at
        while at and text[at - 1].isalpha():
            at -= 1
        if at == end:
            break
        word = fold(text[at:end])
        if word not in _NUMBER_WORDS:
            break
    return word


_NUMBER_STARTS = re.compile(r"\d(?<![\w.:/,-]\d)")


def number_spans(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """``(kind, start, end, certain)`` of numbers shaped like those of persons."""
    for low, high in _windows(_NUMBER_HINT, text, _NUMBER_BEFORE, _NUMBER_AFTER):
        for m in IDENTITY.finditer(text, low, high):
            if _issued(m.group()):
                yield "identity", m.start(), m.end(), True
        for m in PHONE.finditer(text, low, high):
            if 7 <= sum(c.isdigit() for c in m.group()) <= 15:
                yield "phone", m.start(), m.end(), True
        for m in _PLAIN_NUMBER.finditer(text, low, high):
            yield "phone", m.start(), m.end(), False


@dataclass
class AddressSpan:
    start: int
    end: int
    street: str
    house: str
    more: str | None = None
    more_end: int = -1


def address_spans(text: str) -> Iterator[AddressSpan]:
    """Spans shaped like a street with its house number; ``more`` is a word after it that may belong to its name."""
    found = []
    if _HOUSE_FIRST.search(text):
        found += [*ADDRESS_EN.finditer(text), *ADDRESS_FR.finditer(text)]
    if _HOUSE_LAST.search(text):
        found += ADDRESS_DE.finditer(text)
    if any(word in text for word in _SPANISH):
        found += ADDRESS_ES.finditer(text)
    for m in found:
        if m.re is ADDRESS_FR:
            more = m["more"]
            yield AddressSpan(m.start(), m.end("street"), fold(m["street"]), m["house"], fold(more) if more else None, m.end())
        else:
            yield AddressSpan(m.start(), m.end(), fold(m["street"]), m["house"])


# --- which lines are worth a look --------------------------------------------------------------------

_RE2_GAP = "[ \\x{a0}\\x{202f}\\x{2009}\\x{200b}-\\x{200d}\\x{feff}]{1,3}"
_RE2_SHAPES = (
    r"@|[(\[{] ?(?i:at) ?[)\]}]| DOT | dot "
    r"|[0-9](?:[ \x{a0}\x{202f}\x{2009}./()\x{2011}\x{2013}-]{0,3}[0-9]){6}|[0-9]{2}[ \x{a0}]?[0-9]{2}[ \x{a0}]?[0-9]{2}[ \x{a0}]?[A-D]\b|[0-9][A-Z][0-9]{5}"
    rf"|[0-9][a-zA-Z]?[ \x{{a0}}](?:[NSEW]\.? )?(?:\p{{Lu}}[\p{{L}}\p{{M}}'’-]+[ \x{{a0}}]){{1,3}}{_TYPE}\b"
    r"|(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm|ring)[ \x{a0}][0-9]"
    r"|\b(?:Calle|Avenida|Avda\.|Plaza|Paseo|Camino|C/)[ \x{a0}]"
    r"|[0-9][a-zA-Z]?(?: bis| ter| quater)?,?[ \x{a0}](?:rue|avenue|place|boulevard|chemin|quai|allée|impasse|cours|route)[ \x{a0}]"
)


_NEXT_WORD = re.compile(rf"{_GAP}(?:d['’])?({_LETTERS})")


def _worth(text: str, start: int, end: int, part: str, lexicon: Lexicon) -> bool:
    """Whether a known part has beside it what a name needs."""
    before, after = text[start - 1 : start], text[end : end + 1]
    if part in lexicon.given:
        if after in _BLANKS and (m := _NEXT_WORD.match(text, end)):
            word = m[1]
            if word[0].isupper() or lexicon.phrases and part not in lexicon.common or (w := fold(word)) in _PARTICLES or w in lexicon.given or w in lexicon.family:
                return True
        if before in _BLANKS and "," in text[max(0, start - 4) : start]:
            return True
    if part in lexicon.family:
        if after == ",":
            return True
        if before in _BLANKS:
            at = start - 1
            while at and text[at - 1] in _BLANKS:
                at -= 1
            last = text[_back(text, at, 1) : at].lstrip("([{\"'“„«‘¿¡|>")
            return last[:1].isupper() or last[-1:] == "." or last.casefold() in _PARTICLES or bool(re.search(r"\W", last))
    return False


def promising(lines: pa.Array, lexicon: Lexicon) -> tuple[pa.Array, list[int]]:
    """Which lines may hold anything that ``find`` or ``count_terms`` looks at, and those whose name may go on in the next.

    Shapes are tested by linear-time patterns, name parts by one automaton over all lines
    together, whose size is no limit. Both let through more than is found, and nothing
    that is found is kept back.
    """
    mask = pc.or_(pc.match_substring_regex(lines, _RE2_SHAPES), pc.match_substring_regex(lines, rf"\p{{Lu}}\.{_RE2_GAP}\p{{L}}"))
    # few parts fit into one more pattern, which is quicker and lets through all that the automaton finds
    few = len(lexicon.given) + len(lexicon.family) <= FEW_PARTS
    places = np.flatnonzero(pc.match_substring_regex(lines, lexicon.pattern()).to_numpy(zero_copy_only=False)) if few else np.arange(len(lines))
    said = lines.take(pa.array(places)).to_pylist()
    text = "\n".join(said)
    starts = np.concatenate(([0], np.cumsum([len(x) + 1 for x in said]))).astype(np.int64)
    hits, ends = [], []
    for start, end, part in lexicon.anchors(text):
        if _worth(text, start, end, part, lexicon):
            hits.append(start)
        if ((near := text.find("\n", end, end + 6)) >= 0 or (near := len(text)) - end < 6) and text[start].isupper() and not text[end:near].strip(" \r,.ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
            ends.append(start)
    if hits:
        flags = np.zeros(len(lines), dtype=bool)
        flags[places[np.searchsorted(starts, np.array(hits), side="right") - 1]] = True
        mask = pc.or_(mask, pa.array(flags))
    return mask, sorted(set(places[np.searchsorted(starts, np.array(ends, dtype=np.int64), side="right") - 1].tolist())) if ends else []


# --- pass one: what terms disclose ------------------------------------------------------------------


def count_words(tokens: Iterable[tuple[str, int]]) -> Counter:
    """``(kind, term, True)`` counts of tokens cut at blanks: words capitalised (word) and in lower case (low)."""
    counts: Counter = Counter()
    for token, n in tokens:
        word = _trim(token.strip(_PUNCTUATION))
        if _CAPITALISED.fullmatch(word):
            counts["word", fold(word), True] += n
        elif word.islower() and word.isalpha():
            counts["low", fold(word), True] += n
    return counts


def _context(kind: str, term: str, line: str, start: int, end: int) -> str:
    return "\t".join([kind, term, hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest(), *phrases_around(line, start, end)])


def count_terms(lines: Iterable[str], known: Lexicon) -> Counter:
    """Counts of ``(kind, term, beside a protected entity)`` over lines.

    Kinds: family (words after a known given name) and given (unknown words before a known
    family name), together with the part beside them, to see how it varies; phrase and number (phrases around certain and uncertain candidates),
    street (with the house number), and way (with the word that follows the street's name).
    Kind context has the phrases around an unknown part or an address, and the line they are in.
    """
    counts: Counter = Counter()
    for line in lines:
        seen = set()
        for span in name_spans(line, known):
            if (span.start, span.end) in seen or not span.given:
                continue
            seen.add((span.start, span.end))
            certain = span.given_known and span.family_known
            counts["total", "name", certain] += 1
            if span.style == "Cap":
                if span.given_known:
                    for part in span.family.split("-"):
                        counts["family", f"{part}\t{span.given}", True] += 1
                        if part not in known.family:
                            counts["context", _context("family", part, line, span.start, span.end), True] += 1
                # before a comma a family name may start a name of its own
                if span.family_known and not span.given_known and line[span.end : span.end + 1] != ",":
                    counts["given", f"{span.given}\t{span.family}", True] += 1
                    counts["context", _context("given", span.given, line, span.start, span.end), True] += 1
            for phrase in phrases_around(line, span.start, span.end):
                counts["phrase", phrase, certain] += 1
        for kind, start, end, certain in number_spans(line):
            if kind == "identity" and (word := word_before(line, start)):
                counts["thing", word, True] += 1
            counts["total", "number", certain] += 1
            for phrase in phrases_around(line, start, end):
                counts["number", phrase, certain] += 1
        for address in address_spans(line):
            counts["street", f"{address.street}\t{address.house}", True] += 1
            counts["context", _context("street", address.street, line, address.start, address.more_end if address.more_end >= 0 else address.end), True] += 1
            if address.more_end >= 0:
                counts["way", f"{address.street}\t{address.more or ''}", True] += 1
    return counts


def disclosure_bits(beside: Column, occurrences: Column, prior: float) -> Column:
    """What a term gives away about an entity beside it: their pointwise mutual information, in bits."""
    return F.log2(F.greatest(beside / occurrences, F.lit(1e-12)) / prior)


def discloses(beside: Column, occurrences: Column, prior: float, share: float = DISCLOSED) -> Column:
    """Whether a term gives away ``share`` of the information ``-log2(prior)`` of the entity, and is beside one often enough."""
    return (beside >= LEAST_SUPPORT) & (disclosure_bits(beside, occurrences, prior) >= -share * math.log2(prior))


def priors(counts: DataFrame) -> dict[str, float]:
    """How likely a certain name or number is at a word of the corpus; at most one half, at least one in a billion."""
    totals = counts.where("kind in ('word', 'low', 'total')").groupBy(F.when(F.col("kind") == "total", F.col("term")).otherwise("words").alias("what")).agg(F.sum("beside").alias("n"))
    n = {r["what"]: r["n"] for r in totals.collect()}
    return {what: min(0.5, max(1e-9, n.get(what, 0) / max(1, n.get("words", 0)))) for what in ("name", "number")}


def known_parts(name_parts: DataFrame) -> Lexicon:
    """The known parts; a small table of fixed size. Null and blank parts are left out."""
    lexicon = Lexicon()
    for row in name_parts.where("name_part is not null and trim(name_part) != ''").select("name_part", "part_role").distinct().collect():
        (lexicon.given if row["part_role"] == "given" else lexicon.family).add(fold(row["name_part"].strip()))
    return lexicon


def term_disclosure(documents: DataFrame, known: Lexicon, text: str = "text") -> DataFrame:
    """``kind, term, beside, occurrences`` over all documents: counted per task, then summed by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            lines = pc.split_pattern(batch.column(0), "\n").flatten()
            tokens = pc.value_counts(pc.split_pattern(lines, " ").flatten())
            counts.update(count_words(zip(tokens.field("values").to_pylist(), tokens.field("counts").to_pylist())))
            counts.update(count_terms(lines.filter(promising(lines, known)[0]).to_pylist(), known))
            for line in lines.filter(pc.match_substring_regex(lines, "[0-9]")).to_pylist():
                counts.update(("thing", word, False) for m in _NUMBER_STARTS.finditer(line) if (word := word_before(line, m.start())))
        rows = [(kind, term, n if hit else 0, n) for (kind, term, hit), n in counts.items()]
        kinds, terms, beside, n = zip(*rows) if rows else ((), (), (), ())
        columns = [pa.array(kinds, pa.string()), pa.array(terms, pa.string()), pa.array(beside, pa.int64()), pa.array(n, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["kind", "term", "beside", "occurrences"])

    parts = spread(documents.where(F.col(text).isNotNull()).select(text)).mapInArrow(run, "kind string, term string, beside bigint, occurrences bigint")
    return parts.groupBy("kind", "term").agg(F.sum("beside").alias("beside"), F.sum("occurrences").alias("occurrences"))


#: A phrase with a word or number in it.
_SAYING = r"[^<>^$.,;:!?() -]"


def _contexts(counts: DataFrame) -> DataFrame:
    """``kind, term, line, phrase``: the phrases around each part, a row for each."""
    parts = F.split("term", "\t")
    return counts.where("kind = 'context'").select(parts[0].alias("kind"), parts[1].alias("term"), parts[2].alias("line"), F.explode(F.slice(parts, 4, 2)).alias("phrase"))


def _introduced(contexts: DataFrame, disclosing: DataFrame) -> DataFrame:
    """``kind, term, contexts, introduced``: the distinct lines of each part, and those in which a disclosing phrase is beside it."""
    said = contexts.join(disclosing.distinct().withColumn("hit", F.lit(1)), "phrase", "left")
    lines = said.groupBy("kind", "term", "line").agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
    return lines.groupBy("kind", "term").agg(F.count("*").alias("contexts"), F.sum("hit").alias("introduced"))


def disclosing_terms(counts: DataFrame) -> DataFrame:
    """``kind, term, bits`` of the terms that disclose enough, or that tell of something else.

    Kinds: given, family, weak, common, phrase, number, pair, constant and thing. One row
    per word or phrase that the corpus has often enough beside protected entities.
    """
    prior = priors(counts)
    words = counts.where("kind = 'word'").select("term", F.col("occurrences").alias("all_n"))
    beside = counts.where("kind in ('given', 'family')").select("kind", F.split("term", "\t")[0].alias("term"), F.split("term", "\t")[1].alias("with"), "beside")
    none = F.lit(0.0).alias("bits")

    def shares(parts: DataFrame) -> DataFrame:
        found = parts.groupBy("kind", "term").agg(F.sum("beside").alias("beside"), F.max("beside").alias("most"), F.count("*").alias("companions"))
        return found.join(introduced, ["kind", "term"], "left").join(words, "term").withColumn("bits", disclosure_bits(F.col("beside"), F.col("all_n"), prior["name"]))

    def telling(kind: str, what: str) -> DataFrame:
        said = counts.where((F.col("kind") == kind) & F.col("term").rlike(_SAYING))
        return said.where(discloses(F.col("beside"), F.col("occurrences"), prior[what])).withColumn("bits", disclosure_bits(F.col("beside"), F.col("occurrences"), prior[what]))

    phrases = telling("phrase", "name")
    # one companion alone is no reason to refuse a part: a person may be named often, and always in full
    introduced = _introduced(_contexts(counts).where("kind in ('family', 'given')"), phrases.select(F.col("term").alias("phrase")))
    varied = F.expr(f"beside >= {LEAST_SUPPORT} and (most < {MOST_CONSTANT} * beside or coalesce(contexts, 0) < {MANY_CONTEXTS} or introduced >= {LEAST_INTRODUCED} * contexts)")
    enough = discloses(F.col("beside"), F.col("all_n"), prior["name"])
    followed = shares(beside.where("kind = 'family'"))
    families = followed.where(varied & enough)
    # family names that are mostly other words say nothing about the word before them
    seen = beside.where("kind = 'given'").select(F.col("with").alias("term")).unionByName(followed.select("term")).distinct().join(words, "term")
    seen = seen.join(followed.select("term", F.col("beside").alias("names")), "term", "left")
    weak = seen.where(f"all_n >= {WEAK_SUPPORT} and coalesce(names, 0) < {WEAK_SHARE} * all_n").select(F.lit("weak").alias("kind"), "term", none)
    strong = beside.where("kind = 'given'").join(weak.select(F.col("term").alias("with")), "with", "left_anti")
    givens = shares(strong).where(varied & (enough | (F.col("companions") >= MANY_COMPANIONS)))
    columns = ["kind", "term", "bits"]
    kept = families.select(*columns).unionByName(givens.select(*columns)).unionByName(phrases.select(*columns)).unionByName(telling("number", "number").select(*columns))
    low = counts.where(f"kind = 'low' and occurrences >= {COMMON_SUPPORT}").join(words, "term", "left").where(f"occurrences > {COMMON_SHARE} * coalesce(all_n, 0)")
    parts = beside.select("term").unionByName(beside.select(F.col("with").alias("term"))).distinct()
    common = low.join(parts, "term", "left_semi").select(F.lit("common").alias("kind"), "term", none)
    streets = counts.where("kind = 'street'").select(F.split("term", "\t")[0].alias("term"), "beside")
    around = _contexts(counts).where("kind = 'street'")
    shared = around.where(F.col("phrase").rlike(_SAYING)).groupBy("phrase").agg(F.min("term").alias("low"), F.max("term").alias("high")).where("low < high").select("phrase")
    constant = streets.groupBy("term").agg(F.count("*").alias("values")).where("values = 1").join(_introduced(around, shared), "term")
    constant = constant.where(f"contexts >= {MANY_CONTEXTS} and introduced < {LEAST_INTRODUCED} * contexts").select(F.lit("constant").alias("kind"), "term", none)
    ways = counts.where("kind = 'way'").select(F.split("term", "\t")[0].alias("street"), F.split("term", "\t")[1].alias("more"), "beside")
    ways = ways.join(ways.groupBy("street").agg(F.sum("beside").alias("n")), "street").where(f"more != '' and beside >= {LEAST_INTRODUCED} * n")
    pairs = ways.where(f"beside >= {LEAST_SUPPORT} or n < {LEAST_SUPPORT}").select(F.lit("pair").alias("kind"), F.concat_ws(" ", "street", "more").alias("term"), F.log2(F.col("beside") / F.col("n")).alias("bits"))
    # a word that numbers of all kinds follow, but identity numbers more rarely than at any word
    numbered = counts.where("kind = 'thing'").withColumn("all_n", F.col("occurrences") - F.col("beside")).where(f"all_n >= {THING_SUPPORT}")
    base = counts.where("kind = 'thing'").agg(F.sum("beside").alias("hit"), F.sum(F.col("occurrences") - F.col("beside")).alias("all")).first()
    rate = min(0.5, max(1e-9, (base["hit"] or 0) / max(1, base["all"] or 0)))
    bits = disclosure_bits(F.col("beside"), F.col("all_n"), rate)
    things = numbered.where(bits < 0).select(F.lit("thing").alias("kind"), "term", bits.alias("bits"))
    return kept.unionByName(pairs).unionByName(weak).unionByName(common).unionByName(constant).unionByName(things)


_FIELDS = {"given": "given", "family": "family", "common": "common", "phrase": "phrases", "number": "number_phrases", "constant": "constant_streets", "weak": "weak", "pair": "street_pairs", "thing": "things"}


def _with_terms(known: Lexicon, terms: Iterable[tuple[str, str]]) -> Lexicon:
    lexicon = Lexicon(set(known.given), set(known.family))
    for kind, term in terms:
        getattr(lexicon, _FIELDS[kind]).add(term)
    return lexicon


def disclosed(documents: DataFrame, name_parts: DataFrame, text: str = "text") -> tuple[Lexicon, DataFrame, int]:
    """The known parts, the terms the corpus adds to them (``kind, term``, written once), and how many there are."""
    known = known_parts(name_parts)
    counts = stash(term_disclosure(documents, known, text))
    terms = stash(disclosing_terms(counts).select("kind", "term").distinct(), n=F.count("*"))
    release(counts)
    return known, terms, terms.observed["n"]


def learn(documents: DataFrame, name_parts: DataFrame, text: str = "text") -> Lexicon:
    """The known parts and what the corpus adds to them, brought to the driver whole."""
    known, terms, _ = disclosed(documents, name_parts, text)
    return _with_terms(known, terms.collect())


def terms_of(texts: Iterable[str | None], known: Lexicon) -> set[str]:
    """Every term that ``find`` may look up in some texts: words, phrases beside any place, streets."""
    asked: set[str] = set()
    for text in texts:
        for line in (text or "").split("\n"):
            tokens = [fold(t) for t in _TOKEN.findall(line)]
            asked.update(tokens, (p for t in tokens for p in t.split("-")), (_trim(t) for t in tokens))
            asked.update(fold(w) for m in _DOUBLE.finditer(line) for w in (m.group(), _trim(m.group())))
            before, after = ["^", *tokens], [*tokens, "$"]
            asked.update("<" + " ".join(before[max(0, i - 1) : i + 1]) for i in range(len(before)))
            asked.update(">" + " ".join(after[i : i + 2]) for i in range(len(after)))
            asked.update(phrases_around(line, m.start(), m.start())[1] for m in re.finditer("['’](?=[sS])", line))
            for address in address_spans(line):
                asked.update((address.street, f"{address.street} {address.more}"))
    return asked


def _amid_capitals(line: str, start: int, end: int) -> bool:
    """Whether the words beside a span are all in capitals, so that capitals say nothing."""
    beside = [*re.findall(_LETTERS, line[max(0, start - 30) : start])[-1:], *re.findall(_LETTERS, line[end : end + 30])[:1]]
    return bool(beside) and all(w.isupper() and len(w) > 1 for w in beside)


# --- pass two: candidates that disclose enough -------------------------------------------------------


def find(text: str, lexicon: Lexicon) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of all personal information of a line, in order, without overlaps."""
    spans: list[tuple[int, int, str]] = []
    if _MAIL_HINT.search(text):
        spans += [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    for kind, start, end, certain in number_spans(text):
        if kind == "identity" and word_before(text, start) in lexicon.things:
            continue
        if certain or any(p in lexicon.number_phrases for p in phrases_around(text, start, end)):
            spans.append((start, end, kind))
    for address in address_spans(text):
        if address.street not in lexicon.constant_streets:
            whole = address.more and f"{address.street} {address.more}" in lexicon.street_pairs
            spans.append((address.start, address.more_end if whole else address.end, "address"))
    for span in chain(name_spans(text, lexicon), initial_spans(text, lexicon) if lexicon.phrases else ()):
        keep = span.given_known and span.family_known
        plain = span.style == "low" or span.style == "CAPS" and _amid_capitals(text, span.start, span.end)
        if plain and span.style == "CAPS" and not keep:
            continue
        if plain and keep:
            keep = bool(span.given) and span.given not in lexicon.common or any(p not in lexicon.common for p in span.family.split("-"))
        if not span.given_known and span.family in lexicon.weak:
            continue
        if keep or any(p in lexicon.phrases for p in phrases_around(text, span.start, span.end)):
            spans.append((span.start, span.end, "name" if keep else "likely name"))
    order = {"email": 0, "identity": 1, "phone": 2, "address": 3, "name": 4, "likely name": 5}
    spans.sort(key=lambda s: (order[s[2]], s[0], -s[1]))
    taken: list[tuple[int, int, str]] = []
    for s in spans:
        if not any(s[0] < t[1] and t[0] < s[1] for t in taken):
            taken.append(s)
    return [(kind.removeprefix("likely "), start, end) for start, end, kind in sorted(taken)]


#: What stands in place of each kind.
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "identity": "[IDENTITY]", "address": "[ADDRESS]", "name": "[NAME]"}


def wrapped_name(line: str, following: str, lexicon: Lexicon) -> tuple[int, int] | None:
    """A name of two known parts that a line end cuts: where it begins in its line, and where it ends in the next."""
    tail = line.rstrip()
    low = _back(tail, len(tail), 5)
    indent = len(following) - len(following.lstrip(" \t"))
    head = following[indent : _ahead(following, indent, 5)]
    joined, cut = f"{tail[low:]} {head}", len(tail) - low
    for span in name_spans(joined, lexicon):
        if span.start < cut < span.end and span.given_known and span.family_known and span.style == "Cap" and not (span.given in lexicon.common and span.family in lexicon.common):
            return low + span.start, indent + span.end - cut - 1
    return None


def find_lines(lines: list[str], looked_at: Iterable[int], cut_at: Iterable[int], lexicon: Lexicon) -> Iterator[tuple[int, str, int, int, int]]:
    """``(line, kind, start, last line, end)`` of everything found in some lines, and of names that go on in the line after one of ``cut_at``."""
    taken: dict[int, list[tuple[int, int]]] = {}
    for at in looked_at:
        for kind, start, end in find(lines[at], lexicon):
            taken.setdefault(at, []).append((start, end))
            yield at, kind, start, at, end
    for at in cut_at:
        if at + 1 < len(lines) and (span := wrapped_name(lines[at], lines[at + 1], lexicon)):
            start, end = span
            if not any(start < e for _, e in taken.get(at, ())) and not any(s < end for s, _ in taken.get(at + 1, ())):
                taken.setdefault(at + 1, []).append((0, end))
                yield at, "name", start, at + 1, end


def sanitise(text: str | None, lexicon: Lexicon) -> str | None:
    """The text with a placeholder for each thing found; null stays null."""
    if not text:
        return text
    lines = text.split("\n")
    begins = [0]
    for line in lines:
        begins.append(begins[-1] + len(line) + 1)
    spans = sorted((begins[a] + start, begins[b] + end, kind) for a, kind, start, b, end in find_lines(lines, range(len(lines)), range(len(lines)), lexicon))
    out, at = [], 0
    for start, end, kind in spans:
        out += [text[at:start], PLACEHOLDERS[kind]]
        at = end
    return "".join([*out, text[at:]])


def _found(texts: pa.Array, lexicon: Lexicon) -> list[tuple[int, str, str]]:
    """``(row, kind, its characters)`` of everything found in some texts, each once per text."""
    split = pc.split_pattern(texts, "\n")
    lines, owner = split.flatten(), pc.list_parent_indices(split).to_pylist()
    mask, cut_at = promising(lines, lexicon)
    said = lines.to_pylist()
    cut_at = [k for k in cut_at if k + 1 < len(said) and owner[k] == owner[k + 1]]
    rows = {}
    for a, kind, start, b, end in find_lines(said, np.flatnonzero(mask.to_numpy(zero_copy_only=False)).tolist(), cut_at, lexicon):
        rows[owner[a], kind, said[a][start:end] if a == b else f"{said[a][start:]}\n{said[b][:end]}"] = None
    return list(rows)


def _by_blocks(documents: DataFrame, known: Lexicon, terms: DataFrame, key: str, text: str, schema: str, work) -> DataFrame:
    """``work(frame, lexicon)`` on blocks of documents, each with the terms of the lexicon that are in its texts.

    The terms asked for by each block are joined to the lexicon, so no task holds more of
    it than its documents have words.
    """
    blocks = max(1, -(-documents.count() // BLOCK_DOCUMENTS))
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("said"), F.pmod(F.xxhash64(key, text), F.lit(blocks)).alias("block"))

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block, part in frame.groupby("block"):
                yield pd.DataFrame({"block": block, "term": sorted(terms_of(part["said"], known))})

    asked = rows.select("block", "said").mapInPandas(ask, "block bigint, term string").distinct()
    hits = asked.join(terms, "term").select("block", "kind", "term")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return work(left[["key", "said"]], _with_terms(known, zip(right["kind"], right["term"])))

    return rows.groupBy("block").cogroup(hits.groupBy("block")).applyInPandas(run, schema)


def personal_information(documents: DataFrame, name_parts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, pii_kind, pii_text`` of everything found, each once per document.

    Null and empty texts give no rows. A lexicon of at most ``LEXICON_TERMS`` terms goes
    to the tasks as a broadcast; a larger one is joined to blocks of documents, with the
    same result. A name of two known parts may be cut by a line end; then its characters
    are those on both lines and the line end between.
    """
    known, terms, n = disclosed(documents, name_parts, text)
    kind = dict(documents.dtypes)[key]
    schema = f"`{key}` {kind}, pii_kind string, pii_text string"
    said = documents.select(F.col(key), F.col(text)).where(F.col(text).isNotNull())
    if n > LEXICON_TERMS:

        def work(frame: pd.DataFrame, lexicon: Lexicon) -> pd.DataFrame:
            keys = frame["key"].tolist()
            return pd.DataFrame([(keys[at], kind, span) for at, kind, span in _found(pa.array(frame["said"], pa.string()), lexicon)], columns=[key, "pii_kind", "pii_text"])

        return _by_blocks(said, known, terms, key, text, schema, work).distinct()
    shipped = documents.sparkSession.sparkContext.broadcast(_with_terms(known, terms.collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _found(batch.column(1), shipped.value)
            keys = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=[key, "pii_kind", "pii_text"])

    return spread(said).mapInArrow(run, schema).distinct()


def sanitised(documents: DataFrame, name_parts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text`` of every row, with placeholders; null and empty texts stay as they are."""
    known, terms, n = disclosed(documents, name_parts, text)
    schema = f"`{key}` {dict(documents.dtypes)[key]}, `{text}` string"
    if n > LEXICON_TERMS:
        return _by_blocks(documents, known, terms, key, text, schema, lambda frame, lexicon: pd.DataFrame({key: frame["key"], text: [sanitise(t, lexicon) for t in frame["said"]]}))
    shipped = documents.sparkSession.sparkContext.broadcast(_with_terms(known, terms.collect()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({key: frame.iloc[:, 0], text: [sanitise(t, shipped.value) for t in frame.iloc[:, 1]]})

    return spread(documents.select(F.col(key), F.col(text))).mapInPandas(run, schema)
