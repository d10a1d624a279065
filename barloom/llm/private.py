"""Personal data in texts, plain or disguised, as spans of the text's own characters.

Plain identifiers are found where they stand. For disguised ones a text goes through transducers, one
after another: characters that look like ASCII ones (or cannot be seen), at and dot in brackets, bare
dots between words, spelled digits, bare at. Each keeps a list of its edits, so that what is then
found in the rewritten text is mapped back, edit by edit, to the characters it came from.

A text takes a transducer only if it shows what that one rewrites, and what is found without an
edit inside is plain already; so clean texts cost a scan and gain no span."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm.text import sliced

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++")
#: Numbers joined by dots, as long as they go: an address is every four of them.
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """True if every second digit from the right, doubled, and the others sum to a multiple of ten."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            end = domain.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def _addresses(text: str) -> Iterator[Span]:
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        parts, at = run.group().split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            own = parts[i : i + 4]
            size = sum(map(len, own)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in own):
                yield "ip", at, at + size
            at += size + 1


def _cards(text: str) -> Iterator[Span]:
    for run in _CARD.finditer(text):
        if run.end() - run.start() >= 12:
            digits = run.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield "card", run.start(), run.end()


def _phones(text: str) -> Iterator[Span]:
    for run in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(run.group())) <= 15:
            yield "phone", run.start(), run.end()


def plain_spans(text: str) -> list[Span]:
    """(kind, start, end) of what stands plainly in the text: the leftmost matches of each kind, those of
    one kind apart from each other. Linear in the text, however long its runs of digits or letters."""
    found: list[Span] = []
    if "@" in text:
        found += _emails(text)
    if _DIGIT.search(text):
        found += [*_addresses(text), *_cards(text)]
        if "+" in text:
            found += _phones(text)
    return found


@dataclass
class Rewritten:
    """A text and where each changed stretch of it came from, in the text it was made of."""

    text: str
    starts: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    source: list[tuple[int, int]] = field(default_factory=list)

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """The stretch that start to end was made of, and whether an edit stands in it. An edit counts whole;
        one that left nothing behind counts if it stands inside."""
        first, last = bisect_right(self.ends, start), bisect_left(self.starts, end)
        inside = first < last
        low = self.source[first][0] if inside and self.starts[first] <= start else start + self._shift(first)
        high = self.source[last - 1][1] if inside and self.ends[last - 1] >= end else end + self._shift(last)
        return low, high, inside

    def _shift(self, n: int) -> int:
        """How far the text after n edits stands from where it came from."""
        return self.source[n - 1][1] - self.ends[n - 1] if n else 0


def rewrite(text: str, edits: Iterable[tuple[int, int, str]]) -> Rewritten:
    """text with each stretch (start, end, what stands there instead) of edits, in order and apart."""
    out, parts, at, size = Rewritten(""), [], 0, 0
    for start, end, new in edits:
        parts += [text[at:start], new]
        size += start - at
        out.starts.append(size)
        size += len(new)
        out.ends.append(size)
        out.source.append((start, end))
        at = end
    out.text = "".join([*parts, text[at:]])
    return out


# Letters of other scripts that look like Latin ones, and the Latin ones.
_LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХаеорсухѕіјһԁԛԝ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧορν",
        "ABESIJKMHOPCTYXaeopcyxsijhdqw" + "ABEZHIKMNOPTYXopv",
        strict=True,
    )
)
# Characters that cannot be seen, and characters that stand for a dash, a space, a dot or an at.
_UNSEEN = frozenset("­​‌‍‎‏⁠⁡⁢⁣⁤﻿")
_SIGNS = {
    "-": "‐‑‒–—―−",
    " ": "              　",
    ".": "․。．｡",
    "@": "﹫＠",
}
_SIGN_OF = {char: sign for sign, chars in _SIGNS.items() for char in chars}
_NOT_ASCII = re.compile(r"[^\x00-\x7f]")
_WORDS = re.compile(r"[^\W_]+")


@lru_cache(1 << 14)
def _lookalike(char: str) -> str | None:
    """The ASCII character that char looks like, '' if it cannot be seen, None if neither."""
    if char in _UNSEEN:
        return ""
    known = _LOOKALIKES.get(char) or _SIGN_OF.get(char)
    if known:
        return known
    if unicodedata.decomposition(char).startswith(("<wide>", "<narrow>", "<small>", "<font>")):  # not superscripts: they are notes
        plain = unicodedata.normalize("NFKC", char)
        return plain if len(plain) == 1 and plain.isascii() else None
    digit = unicodedata.decimal(char, None)
    return None if digit is None else str(digit)


def _characters(text: str) -> list[tuple[int, int, str]]:
    """Lookalikes; of letters only in words that are ASCII afterwards, since a word of another script is no disguise."""
    if text.isascii():
        return []
    found, spoilt = [], -1
    for m in _NOT_ASCII.finditer(text):
        at = m.start()
        if at < spoilt or (new := _lookalike(text[at])) is None:
            continue
        if text[at].isalpha():
            word = _WORDS.search(text, _word_start(text, at))
            if any(not c.isascii() and _lookalike(c) is None for c in word.group()):
                spoilt = word.end()  # its other characters stay as well
                continue
        found.append((at, at + 1, new))
    return found


def _word_start(text: str, at: int) -> int:
    while at and (text[at - 1].isalnum()):
        at -= 1
    return at


# The words for at and dot, and the ten digits, in English, French, German and Spanish.
_AT_WORDS = ("at", "arobase", "arroba", "klammeraffe")
_DOT_WORDS = ("dot", "point", "punkt", "punto")
DIGIT_WORDS = {
    "0": ("zero", "oh", "zéro", "null", "cero"),
    "1": ("one", "un", "eins", "uno"),
    "2": ("two", "deux", "zwei", "dos"),
    "3": ("three", "trois", "drei", "tres"),
    "4": ("four", "quatre", "vier", "cuatro"),
    "5": ("five", "cinq", "fünf", "cinco"),
    "6": ("six", "sechs", "seis"),
    "7": ("seven", "sept", "sieben", "siete"),
    "8": ("eight", "huit", "acht", "ocho"),
    "9": ("nine", "neuf", "neun", "nueve"),
}
_DIGIT_OF = {word: digit for digit, words in DIGIT_WORDS.items() for word in words}
_SPELLED = frozenset(w.encode() for w in _DIGIT_OF)
_BARE_DOTS = frozenset((b"dot", b"punkt", b"punto"))
_BARE_ATS = frozenset(w.encode() for w in _AT_WORDS)
#: ASCII letters in lower case, other ASCII as a space; bytes of other characters stay.
_LETTERS = bytes(c if c > 127 else (c | 32 if chr(c).isalpha() else 32) for c in range(256))

_OPEN, _CLOSE = r"[\[({<]\s{0,2}", r"\s{0,2}[\])}>]"
_BRACKETED = re.compile(rf"\s{{0,2}}{_OPEN}(?:(?P<at>{'|'.join(_AT_WORDS)}|@)|{'|'.join(_DOT_WORDS)}|\.){_CLOSE}\s{{0,2}}", re.I)
_BRACKET = re.compile(rf"{_OPEN}(?:{'|'.join(_AT_WORDS + _DOT_WORDS)}|[@.]){_CLOSE}", re.I)
_BARE_DOT = re.compile(r"(?<=[A-Za-z0-9_-])[ \t]{1,2}(?:dot|punkt|punto)[ \t]{1,2}(?=[A-Za-z0-9])", re.I)
_NUMERAL = rf"(?:{'|'.join(sorted(_DIGIT_OF, key=len, reverse=True))})"
_TOKEN = re.compile(rf"(?P<word>(?<![^\W\d_]){_NUMERAL}(?![^\W\d_]))|(?P<plus>\bplus\b)|(?P<digits>[0-9]+)|(?P<gap>[ \t]*[-,][ \t]*|[ \t]+)|(?P<sign>[+().])", re.I)
#: Spelled digits in a row of numerals that make it a number, if they are not all the same word ("un un un un").
LEAST_SPELLED = 4
#: Digits of a number that counts as a phone's without a plus, and how many different ones it needs.
UNMARKED, UNLIKE = (10, 15), 3
_BARE_AT = re.compile(rf"[ \t]{{1,2}}(?:{'|'.join(_AT_WORDS)})[ \t]{{1,2}}(?=[A-Za-z0-9-]+\.)", re.I)
_LONG_NUMBER = re.compile(r"(?<![0-9+.])[0-9]++")
_LABEL = re.compile(r"[A-Za-z]{2,12}")
_NAME_SIGN = re.compile(r"[0-9]$|[._]")


def _brackets(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "@" if m["at"] else ".") for m in _BRACKETED.finditer(text)]


def _dots(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), ".") for m in _BARE_DOT.finditer(text)]


def _numbers(text: str) -> list[tuple[int, int, str]]:
    """Spelled digits as digits, in rows of numerals with LEAST_SPELLED spelled ones or more. Gaps beside a spelled
    digit go, a spelled plus becomes a sign; what stands between numerals written as digits stays."""
    out: list[tuple[int, int, str]] = []
    row: list[re.Match] = []

    def close() -> None:
        while row and row[-1].lastgroup in ("gap", "plus", "sign"):
            row.pop()
        spelled = [m.group().lower() for m in row if m.lastgroup == "word"]
        if len(spelled) >= LEAST_SPELLED and len(set(spelled)) > 1:
            for i, m in enumerate(row):
                near = {row[k].lastgroup for k in (i - 1, i + 1) if 0 <= k < len(row)}
                if m.lastgroup == "word":
                    out.append((m.start(), m.end(), _DIGIT_OF[m.group().lower()]))
                elif m.lastgroup == "plus":
                    out.append((m.start(), m.end(), "+"))
                elif m.lastgroup == "gap" and i and near & {"word", "plus"}:
                    out.append((m.start(), m.end(), ""))
        row.clear()

    at = 0
    while m := _TOKEN.search(text, at):
        if m.start() != at:
            close()
        if row or m.lastgroup != "gap":
            row.append(m)
        at = m.end()
    close()
    return out


def _ats(text: str, stages: list[Rewritten]) -> list[tuple[int, int, str]]:
    """Bare at between a name and a domain. The word is common, so one more sign is asked for: a spelled dot in
    the domain, or a name with a dot or underscore inside or a digit at its end."""
    out = []
    for m in _BARE_AT.finditer(text):
        start = m.start()
        while start and text[start - 1] in _LOCAL:
            start -= 1
        name, domain = text[start : m.start()], _DOMAIN.match(text, m.end())
        if name and name[0].isalpha() and name[-1].isalnum() and domain and _LABEL.fullmatch(domain.group().rsplit(".", 1)[1]):
            if _source(stages, domain.start(), domain.end())[2] or _NAME_SIGN.search(name):
                out.append((m.start(), m.end(), "@"))
    return out


def transduced(text: str) -> list[Rewritten]:
    """The text through every transducer that it needs, in order; none if it needs none."""
    stages: list[Rewritten] = []

    def put(edits: list[tuple[int, int, str]]) -> str:
        if edits:
            stages.append(rewrite(text, edits))
        return stages[-1].text if edits else text

    text = put(_characters(text))
    if _BRACKET.search(text):
        text = put(_brackets(text))
    found = text.encode("utf-8", "replace").translate(_LETTERS).split()
    words = set(found)
    if words & _BARE_DOTS:
        text = put(_dots(text))
    if words & _SPELLED and sum(map(_SPELLED.__contains__, found)) >= LEAST_SPELLED:
        text = put(_numbers(text))
    if words & _BARE_ATS:
        put(_ats(text, stages))
    return stages


def _source(stages: list[Rewritten], start: int, end: int) -> tuple[int, int, bool]:
    touched = False
    for stage in reversed(stages):
        start, end, edited = stage.back(start, end)
        touched |= edited
    return start, end, touched


def _plausible(kind: str, found: str) -> bool:
    """A rewritten e-mail address ends in letters; a number such as 4@1.5 is none."""
    return kind != "email" or bool(_LABEL.fullmatch(found.rsplit(".", 1)[1])) and found[0].isalnum()


def _unmarked_phones(text: str, stages: list[Rewritten]) -> Iterator[Span]:
    """Rows of UNMARKED digits that were spelled, UNLIKE different ones or more, that are no card and follow no plus."""
    for m in _LONG_NUMBER.finditer(text):
        start, end, _ = _source(stages, m.start(), m.end())
        if UNMARKED[0] <= len(m.group()) <= UNMARKED[1] and end - start >= 2 * len(m.group()) and len(set(m.group())) >= UNLIKE and not luhn(m.group()):
            yield "phone", m.start(), m.end()


def disguised_spans(text: str) -> list[Span]:
    """(kind, start, end), in characters of text, of identifiers that only the rewritten text shows."""
    stages = transduced(text)
    if not stages:
        return []
    last, out = stages[-1].text, []
    for kind, start, end in [*plain_spans(last), *_unmarked_phones(last, stages)]:
        low, high, touched = _source(stages, start, end)
        if touched and _plausible(kind, last[start:end]):
            out.append((kind, low, high))
    return out


def ordered(spans: Iterable[Span]) -> list[Span]:
    """By start, then kind as KINDS has them, then end; each once."""
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, plain, added) for each row of docs: arrays of spans (kind, start, end), end exclusive, in
    code points of the text. plain: as they stand; added: disguised ones that are not in plain.

    A null text is empty: no spans. Very long texts are scanned whole, in time linear in their length. Rows
    with equal or null ids stay rows of their own; other columns are not read. An empty table gives an
    empty table."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            plain, added = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = ordered(plain_spans(text))
                plain.append([{"kind": k, "start": a, "end": b} for k, a, b in base])
                more = ordered(set(disguised_spans(text)) - set(base))
                added.append([{"kind": k, "start": a, "end": b} for k, a, b in more])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(plain, span), pa.array(added, span)], names=[id_col, "plain", "added"])

    kind = docs.schema[id_col].dataType.simpleString()
    one = "array<struct<kind: string, start: int, end: int>>"
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, plain {one}, added {one}")
