"""Personal data: plain identifiers by pattern, and disguised ones by offset-preserving normalisation.

A transducer rewrites homoglyphs, spelled-out digits and at/dot disguises and keeps, for each character it
writes, the source span it came from; detectors run on what it wrote and their spans are mapped back.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from spacemill.llm.common import others
from spacemill.llm.spans import Span, digest, joined, map_rows

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# the look-behind only skips starts inside a digit run, at which no match can begin
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
# any address holds this; the literal dot in front makes it quick to look for
_IP_HINT = re.compile(r"\.[0-9]++\.[0-9]")
# shorter chains have too few digits, and chains are maximal
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){11,}")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of ``local@label(.label)+``, found from each @ in linear time: a match begins where its run of local characters does."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def cards(text: str) -> Iterator[Span]:
    for m in CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if len(d) <= 19 and luhn(d):
            yield "card", m.start(), m.end()


def detect(text: str) -> Iterator[Span]:
    """The base spans of a text, kind by kind."""
    if "@" in text:
        yield from emails(text)
    if _IP_HINT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                yield "ip", m.start(), m.end()
    yield from cards(text)
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                yield "phone", m.start(), m.end()


# Look-alike letters and the ASCII letter each is read as.
CYRILLIC = dict(zip("АВЕКМНОРСТУХавекмнорстухіјѕԁһԛԝ", "ABEKMHOPCTYXabekmhopctyxijsdhqw"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαορικτυνχ", "ABEZHIKMNOPTYXaopiktuvx"))
# Digit words of English, German, French and Spanish.
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Full-width forms and other decimal digits are read by rule: U+FF01..U+FF5E minus 0xFEE0, and digits by their value.
_SHIFT = 0xFEE0
_ODD = re.compile("[" + "".join([*CYRILLIC, *GREEK]) + "！-～․。٠-٩۰-۹०-९​-‍⁠﻿­‐-―   ]")
_SPACES = "   "
_DASHES = "‐‑‒–—―"
_BREAK = r"[\x20\t]*+"
# Words for @ and the dot, and top-level domains that a bare "at ... dot ..." must end in.
_ATS, _DOTS = "at|arroba|ät", "dot|punkt|point|punto"
_TOP = "com|org|net|edu|gov|info|io|co|de|fr|es|uk|eu|us|ai|dev|app|biz|me|ch|at|it|nl|example|test|local"
# runs of blanks are taken whole and, by what stands before, from their start only, so that every pattern is linear
_OPEN, _CLOSE = rf"{_BREAK}[\[({{<]{_BREAK}", rf"{_BREAK}[\])}}>]{_BREAK}"
# a domain's labels: of 63 characters and 126 before the last, as many as a domain name may have
_LABELS = rf"(?:[A-Za-z0-9-]{{1,63}}+(?:{_OPEN}(?:{_DOTS}|\.){_CLOSE}|[\x20\t]++(?:{_DOTS})[\x20\t]++|\.)){{1,126}}"
# bracketed, or standing alone before a domain
_AT = re.compile(rf"(?<![\x20\t]){_OPEN}(?:{_ATS}){_CLOSE}|(?<=[A-Za-z0-9]){_BREAK}\(@\){_BREAK}|(?<=[A-Za-z0-9])[\x20\t]++(?:{_ATS})[\x20\t]++(?={_LABELS}(?:{_TOP})(?![A-Za-z0-9]))", re.I)
_DOT = re.compile(rf"(?<=[A-Za-z0-9]){_OPEN}(?:{_DOTS}|\.){_CLOSE}(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])[\x20\t]++(?:{_DOTS})[\x20\t]++(?=[A-Za-z0-9])", re.I)
_NUMBER = rf"(?:{'|'.join(sorted(DIGIT_WORDS, key=len, reverse=True))})"
_SPELLED = re.compile(rf"(?<![^\W_])(?:plus[\x20]++(?:[0-9]++[\x20.-]++)*+)?{_NUMBER}(?:[\x20.-]++(?:{_NUMBER}|[0-9]+))+(?![^\W_])", re.I)
_WORD = re.compile(rf"plus[\x20]+|{_NUMBER}", re.I)
_HINT = re.compile(rf"(?:{_ATS}|@)[\x20\t]*+[\])}}>]|(?:{_DOTS}|\.)[\x20\t]*+[\])}}>]|[ \t](?:{_DOTS})[ \t]", re.I)
# a bare "at" of _AT, whatever stands before it
_BARE_AT = re.compile(rf"[\x20\t](?:{_ATS})[\x20\t]++(?={_LABELS}(?:{_TOP})(?![A-Za-z0-9]))", re.I)
_BARE_DOTS = tuple(f"{a}{w}" for w in _DOTS.split("|") for a in " \t")
_BARE_ATS = tuple(f"{a}{w}" for w in _ATS.split("|") for a in " \t")
_TOKEN = re.compile(r"[^\W_]+")


def _fold(text: str) -> str:
    """Lower case, with the three further letters that re.I takes for s and i."""
    return (text if text.isascii() else text.replace("ſ", "s").replace("ı", "i").replace("İ", "i")).lower()


def _hints(text: str, low: str) -> bool:
    """Whether at/dot disguises are worth looking for, true wherever _AT or _DOT match; substrings are looked for before patterns."""
    if (any(c in text for c in "])}>") or any(w in low for w in _BARE_DOTS)) and _HINT.search(text):
        return True
    return any(w in low for w in _BARE_ATS) and bool(_BARE_AT.search(text))


def _numbers(low: str) -> bool:
    """Whether a number word and another, or digits, stand next to each other, true wherever _SPELLED matches: both are tokens of their own."""
    words = _TOKEN.findall(low)
    return any(w in DIGIT_WORDS and (words[i] in DIGIT_WORDS or words[i][0].isdigit()) for i, w in enumerate(words[:-1], 1))


class Tape:
    """A text with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text = text
        self.start: list[int] | range = range(len(text))
        self.end: list[int] | range = range(1, len(text) + 1)

    def rewrite(self, pattern: re.Pattern, write) -> None:
        """Puts write(match) for each match; what it writes carries the whole match's source span."""
        out, start, end, at, changed = [], [], [], 0, False
        for m in pattern.finditer(self.text):
            new = write(m)
            if new is None:
                continue
            changed = True
            out += [self.text[at : m.start()], new]
            start += [*self.start[at : m.start()], *[self.start[m.start()]] * len(new)]
            end += [*self.end[at : m.start()], *[self.end[m.end() - 1]] * len(new)]
            at = m.end()
        if changed:
            out.append(self.text[at:])
            self.text = "".join(out)
            self.start, self.end = [*start, *self.start[at:]], [*end, *self.end[at:]]

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.start[a], self.end[b - 1]


def _plain(m: re.Match) -> str:
    c = m[0]
    if c in CYRILLIC or c in GREEK:
        return CYRILLIC.get(c) or GREEK[c]
    if c in _SPACES:
        return " "
    if c in _DASHES:
        return "-"
    if c in "․。":
        return "."
    if "！" <= c <= "～":
        return chr(ord(c) - _SHIFT)
    return str(int(c)) if c.isdecimal() else ""


def _spelled(m: re.Match) -> str:
    """Digit words become digits; the separators stay but for blanks, so that groups of a number stay apart."""
    return re.sub(r"(?<=[0-9])\x20+(?=[0-9])", "", _WORD.sub(lambda w: DIGIT_WORDS.get(_fold(w[0]), "+"), m[0]))


def normalise(text: str) -> Tape | None:
    """The rewritten text with its source spans, or None where nothing is disguised."""
    tape = Tape(text)
    if not text.isascii() and _ODD.search(text):
        tape.rewrite(_ODD, _plain)
    # each test reads what the transducers before have written
    if _numbers(_fold(tape.text)):
        tape.rewrite(_SPELLED, _spelled)
    if _hints(tape.text, _fold(tape.text)):
        tape.rewrite(_AT, lambda m: "@")
        if "@" in tape.text or re.search("[0-9]", tape.text):
            tape.rewrite(_DOT, lambda m: ".")
    return tape if tape.text != text else None


def disguised(text: str, base: list[Span]) -> list[Span]:
    """Spans seen only after normalisation: those overlapping no base span of their kind."""
    tape = normalise(text)
    if tape is None:
        return []
    taken = {k: sorted((a, b) for kind, a, b in base if kind == k) for k in KINDS}
    out = []
    for kind, a, b in detect(tape.text):
        s, e = tape.source(a, b)
        # base spans of a kind do not overlap, so the last that starts before e is the one to look at
        i = bisect_left(taken[kind], (e,)) - 1
        if i < 0 or taken[kind][i][1] <= s:
            out.append((kind, s, e))
    return out


RESULT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of docs but for the text, with n_<kind> of the base spans, base_sha256, and spans, base and disguised ones together.

    A null text counts as empty; texts are taken whole, and rows that repeat an id or a text are rows of their own. Columns of docs
    with these names, in any case, are replaced. An empty table gives no rows.
    """
    new = StructType.fromDDL(RESULT)
    own = [c for c in others(docs, new.names) if c != text_col]
    rows = docs.select(*[f"`{c}`" for c in own], text_col)

    def row(*values):
        text = values[-1] or ""
        base = list(detect(text))
        return {
            **dict(zip(own, values)), **{f"n_{k}": sum(s[0] == k for s in base) for k in KINDS},
            "base_sha256": digest(base, KINDS), "spans": joined([*base, *disguised(text, base)], KINDS),
        }

    return map_rows(rows, row, StructType([*rows.schema.fields[:-1], *new.fields]))
