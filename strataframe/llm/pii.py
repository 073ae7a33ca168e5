"""Offset-preserving detection of personal data, disguised or not.

The plain detectors run over every whole text. A text that shows a sign of disguise is also
normalised by small transducers (look-alike letters and digits, spelled digits, at and dot in
words or brackets); each writes characters with the source span that they stand for. The same
detectors run over the normalised text, and what they find beyond the plain spans is mapped
back to source characters.

Every pattern looks at a character a bounded number of times, and the places of edits are all that is kept
of a long text beside copies of itself, so time and memory stay linear in it.

Defined results: null text counts as empty and holds nothing; rows are kept one for one,
repeated rows and null doc_id included. Very long texts are searched whole. Spans are code points, end exclusive. Redaction keeps a
null text null.
"""

from __future__ import annotations

import hashlib
import io
import re
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import mapped, slices, table

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ENDING = re.compile(r"\.[A-Za-z]{2,}\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits that fails at its first digit fails at each, so matches begin at runs.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјкорсухԁԛԝһѵΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυϲϳօոսıɑɡ", "ABESIJKMHOPCTYXaesijkopcyxdqwhvABEZHIKMNOPTYXaikvopucjonuiag", strict=True))
# Signs that stand for at, dot, plus and hyphen.
SIGNS = {"﹫": "@", "。": ".", "․": ".", "﹢": "+", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " "}
# Characters without width.
HIDDEN = "­​‌‍⁠﻿"
# Digits in words, in the languages of the corpus.
_DIGIT_NAMES = ("zero oh null zéro cero", "one eins un uno", "two zwei deux dos", "three drei trois tres", "four vier quatre cuatro", "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve")
SPELLED = {w: str(k) for k, words in enumerate(_DIGIT_NAMES) for w in words.split()}
_ALPHABETIC = re.compile(r"[^\W\d_]+")
_ODD = re.compile(f"[{''.join(LOOKALIKES)}{''.join(SIGNS)}{HIDDEN}！-～Ⓐ-ⓩ\U0001d400-\U0001d7ff]|(?![0-9])\\d")
_DIGIT_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
_SPOKEN = re.compile(rf"(?<![^\W_])(?:plus[ ,-]+)?(?:(?:{_DIGIT_WORD}|[0-9])(?:[ ,-]+(?:(?:dot|point|punkt|punto)[ ,-]+)?|(?=[0-9]))){{3,}}(?:{_DIGIT_WORD}|[0-9])(?![^\W\d_])", re.I)
_SPOKEN_SIGN = re.compile(rf"(?<![^\W_])(?:{_DIGIT_WORD})[ ,-]+(?:(?:dot|point|punkt|punto)[ ,-]+)?(?:{_DIGIT_WORD})(?![^\W_])", re.I)
_SPOKEN_MIXED = re.compile(rf"[0-9][ ,-]+(?:(?:dot|point|punkt|punto)[ ,-]+)?(?:{_DIGIT_WORD})[ ,-]+(?:(?:dot|point|punkt|punto)[ ,-]+)?[0-9]", re.I)
_SPOKEN_PART = re.compile(rf"({_DIGIT_WORD})|(plus)|(dot|point|punkt|punto)|([0-9])", re.I)
# Latin letters that stand for digits inside numbers.
LETTER_DIGITS = {"O": "0", "o": "0", "l": "1", "I": "1"}
_LETTERED = re.compile(r"(?<![A-Za-z0-9])[+]?[0-9OolI](?:[ ().-]{0,2}[0-9OolI]){6,}(?![A-Za-z0-9])")
_LETTERED_IP = re.compile(r"(?<![A-Za-z0-9.])[0-9OolI]{1,3}(?:\.[0-9OolI]{1,3}){3}(?!\.?[A-Za-z0-9])")
#: Single letters at either end of a number are words of their own ("I", "o").
_LONE_LETTERS = re.compile(r"(?:[OolI] [ ().-]*)+")
_BRACKET_SIGN = re.compile(r"[\[({<]\s?(?:at|dot|@|\.)\s?[\])}>]", re.I)
_BRACKETS = re.compile(r"\s{0,3}(?:\[\s?(at|@|dot|\.)\s?\]|\(\s?(at|@|dot|\.)\s?\)|\{\s?(at|@|dot|\.)\s?\}|<\s?(at|dot)\s?>)\s{0,3}", re.I)
_AT = re.compile(r" at | @ |@", re.I)
_WORD_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?: dot | \. |\.)[A-Za-z0-9-]+)+", re.I)
_WORD_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?: dot | \. )[0-9]{1,3}){3}(?![0-9])", re.I)
_JOINED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9.%+]+([_-])at\1[A-Za-z0-9]+(?:\1dot\1[A-Za-z0-9]+)+(?![A-Za-z0-9_-])", re.I)
_WORDS_PART = re.compile(r" (at|dot|@|\.) |[_-](at|dot)[_-]", re.I)
# Last parts of domains that may follow a bare "dot".
ENDINGS = frozenset("com org net edu gov mil info biz name io co ai app dev me tv uk us ca au nz ie de at ch fr be nl lu es pt it gr pl cz se no dk fi eu ru ua in cn jp kr br mx ar cl test example invalid local".split())

# Words that may follow a spelled "dot" in prose and are no endings.
_NO_ENDINGS = frozenset("and or the of on for with was were that then which who but not from where when".split())
_AT_NAME = re.compile(r" at [a-z0-9-]+(?: dot | \. |\.)[a-z0-9-]")
#: A local part that no plain word is: parted inside, or a name with digits. A run of letters is looked at once, from its begin.
_LOCAL_SIGN = re.compile(r"[A-Za-z0-9](?:[._%+]| dot )[A-Za-z0-9]|(?<![A-Za-z-])-*+[A-Za-z][A-Za-z-]*+[0-9]|[0-9]-?[A-Za-z]", re.I)
# Words before a local part that tell an address, and words between that are none.
_CUE = re.compile(r"(?<![^\W_])(?:e-?mails?|mail|contact|write|reach|kontakt|schreib\w*|courriel|écri\w*|correo|escrib\w*)(?:[ :,]+(?:to|is|me|us|an|à|a)){0,2}[ :,]+$", re.I)
_NO_LOCALS = frozenset("me us him her them you it out back address addresses form page list team sent found here there or and to is".split())


def _worded(text: str) -> Iterator[tuple[int, int, int, int]]:
    """Where an address with at or dot in words may begin, its at begin and end, and it end: from each at
    outwards, so that a long chain of dots is looked at once."""
    free = 0
    for m in _AT.finditer(text):
        start, domain = m.start(), _WORD_DOMAIN.match(text, m.end())
        if start < free or not domain:
            continue
        while start > free:
            if text[start - 1] in _LOCAL:
                start -= 1
            elif start < m.start() and start - 5 > free and text[start - 5 : start].lower() == " dot " and text[start - 6] in _LOCAL:
                start -= 5
            else:
                break
        if start < m.start():
            free = domain.end()
            yield start, m.start(), m.end(), free


def _is_address(text: str, start: int, at: int, after: int, end: int) -> bool:
    """Whether a find of _worded() is an address, by the passage alone."""
    local, sign, domain = text[start:at], text[at:after].lower(), text[after:end].lower()
    last = re.split(r"[. ]", domain)[-1]
    named = last.isalpha() and len(last) > 1
    if " dot " in domain:
        return last in ENDINGS or named and last not in _NO_ENDINGS and text[end : end + 4].lower() != " dot"
    if sign != " at ":
        return last in ENDINGS or sign == "@" and " . " not in domain and " dot " not in local.lower()
    if " . " in domain:
        return last in ENDINGS
    return named and not local.endswith(".") and bool(_LOCAL_SIGN.search(local) or local.lower() not in _NO_LOCALS and _CUE.search(text[max(0, start - 40) : start]))


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, not overlapping; linear, where a search by pattern would try each character of a long run."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        free = m.end() if m else at + 1
        if m:
            yield start, free
        at = text.find("@", free)


def detect(text: str) -> list[Span]:
    """The plain spans, by kind and start."""
    found: list[Span] = [("email", a, b) for a, b in emails(text)]
    if _CARD.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 37 and 13 <= len(digits := re.sub("[ -]", "", m[0])) <= 19 and _luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return found


class Tape:
    """A text that knows which source span each of its characters stands for. It keeps the places of
    its edits only, so a long text with few of them costs little more than itself."""

    def __init__(self, text: str):
        self.text, self.changed, self.edits = text, False, []

    def replace(self, text: str) -> None:
        """Another text, character for character."""
        self.changed |= text != self.text
        self.text = text

    def rewrite(self, edits: Iterable[tuple[int, int, str]]) -> None:
        """edits: (start, end, what stands there instead), in order and apart. The span of what stands
        there ends without the blanks, commas and hyphens at its end, if anything is left."""
        starts, ends, seen, sizes, out, at = array("q"), array("q"), array("q"), array("q"), io.StringIO(), 0
        for a, b, new in edits:
            out.write(self.text[at:a])
            out.write(new)
            last = b
            while last > a + 1 and self.text[last - 1] in " ,-":
                last -= 1
            for column, x in zip((starts, ends, seen, sizes), (a, b, last, len(new)), strict=True):
                column.append(x)
            at = b
        if not starts:
            return
        starts, ends, seen, sizes = (np.frombuffer(x, np.int64) for x in (starts, ends, seen, sizes))
        gone = np.cumsum(ends - starts - sizes)
        self.edits.append((starts - gone + (ends - starts - sizes), sizes, starts, ends, seen))
        self.text, self.changed = out.getvalue() + self.text[at:], True

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source span of a span of the text."""
        last = end - 1
        for at, sizes, starts, ends, seen in reversed(self.edits):
            k, j = (int(np.searchsorted(at, x, "right")) - 1 for x in (start, last))
            inside = lambda x, k: k >= 0 and x < at[k] + sizes[k]
            after = lambda x, k: x if k < 0 else int(ends[k] + x - at[k] - sizes[k])
            start = int(starts[k]) if inside(start, k) else after(start, k)
            last = int(seen[j]) - 1 if inside(last, j) else after(last, j)
        return start, last + 1


class _Plain(dict):
    """For str.translate(): the plain character that an odd one stands for."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        plain = c
        if _ODD.match(c) and c not in HIDDEN:
            if "！" <= c <= "～":
                plain = chr(code - 0xFEE0)
            elif c >= "\U0001d400" or "Ⓐ" <= c <= "ⓩ":  # letters and digits of other styles
                plain = unicodedata.normalize("NFKC", c)
            else:
                plain = LOOKALIKES.get(c) or SIGNS.get(c) or str(unicodedata.decimal(c, c))
        self[code] = plain if len(plain) == 1 else c
        return self[code]


_PLAIN = _Plain()
_HIDDEN_RUN = re.compile(f"[{HIDDEN}]+")


def _without_odd(text: str) -> str:
    """The text with plain characters for odd ones, a replacement for each where they are few."""
    odd = [c for c in set(text) if c > "\x7f" and _PLAIN[ord(c)] != c]
    if len(odd) > 16:
        return text.translate(_PLAIN)
    for c in odd:
        text = text.replace(c, _PLAIN[ord(c)])
    return text


def _may_be_odd(text: str) -> bool:
    """Whether a search for look-alikes can succeed: Latin-1 has two of the odd characters."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return bool(_ODD.search(text))
    return "\u00a0" in text or "\u00ad" in text


#: Characters of a text whose words are listed at once.
_PIECE = 1 << 20


def _may_be_spoken(low: str) -> bool:
    """Whether digits in words can follow each other, or a word after each other; low: the text in lower case."""
    at, n, last = 0, 0, -3
    while at < len(low):
        to = low.find(" ", at + _PIECE)
        to = len(low) if to < 0 else to
        words = _ALPHABETIC.findall(low, at, to)
        names = SPELLED.keys() & set(words)
        if names:
            for k, w in enumerate(words, n):
                if w in names:
                    if k - last <= 2:
                        return True
                    last = k
        n, at = n + len(words), to
    return False


def _before_lone_letters(part: str) -> int:
    """Where the single letters at the end of a number begin, each with a space before it; from the end, so that each is looked at once."""
    end = len(part)
    while end > 1 and part[end - 1] in LETTER_DIGITS and part[end - 2] == " ":
        end -= 2
        while end and part[end - 1] in " ().-":
            end -= 1
    return end


def _digit_letters(text: str) -> list[int]:
    """Where letters stand for digits: in candidates with a plain digit that are a number of some kind once they are read so."""
    found = set()
    for pattern in (_LETTERED, _LETTERED_IP):
        for m in pattern.finditer(text):
            if m[0].isascii() and not LETTER_DIGITS.keys().isdisjoint(m[0]):
                start, part = m.start(), m[0]
                if lone := _LONE_LETTERS.match(part):
                    start, part = start + lone.end(), part[lone.end() :]
                part = part[: _before_lone_letters(part)]
                for _, a, b in detect("".join(LETTER_DIGITS.get(c, c) for c in part)):
                    if any(c in "0123456789" for c in part[a:b]):
                        found.update(start + k for k in range(a, b) if part[k] in LETTER_DIGITS)
    return sorted(found)


def _spoken(text: str) -> Iterator[tuple[int, int, str]]:
    """Edits of numbers in words."""
    for m in _SPOKEN.finditer(text):
        own, before = [], None
        for p in _SPOKEN_PART.finditer(text, *m.span()):  # what parts the digits goes with the digit before it
            if before:
                own.append((before[0], p.start(), before[2]))
            before = p.start(), p.end(), "+" if p[2] else "." if p[3] else p[4] or SPELLED[p[1].lower()]
        own.append(before)
        # words apart from each other must make a number of some kind
        if _SPOKEN_SIGN.search(m[0]) or _SPOKEN_MIXED.search(m[0]) and detect("+" * (text[m.start() - 1 : m.start()] == "+") + "".join(x for _, _, x in own)):
            yield from own


def _at_words(text: str) -> Iterator[tuple[int, int, str]]:
    """Edits of addresses and of parts of ips that at and dot in words join."""
    spans = [(x[0], x[3]) for x in _worded(text) if _is_address(text, *x)]
    starts = [a for a, _ in spans]
    for m in _WORD_IP.finditer(text):
        k = bisect_right(starts, m.end() - 1) - 1
        if k < 0 or spans[k][1] <= m.start():
            spans.append(m.span())
    for a, b in sorted(spans):
        yield from ((p.start(), p.end(), "@" if p[1].lower() in ("at", "@") else ".") for p in _WORDS_PART.finditer(text, a, b) if p[1])


def _joined(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _JOINED.finditer(text):
        yield from ((p.start(), p.end(), "@" if p[2].lower() == "at" else ".") for p in _WORDS_PART.finditer(text, *m.span()) if p[2])


def normalised(text: str) -> Tape | None:
    """The text without disguises, or None where it shows no sign of one."""
    tape = Tape(text)
    if _may_be_odd(text):
        tape.replace(_without_odd(text))
        tape.rewrite((m.start(), m.end(), "") for m in _HIDDEN_RUN.finditer(tape.text))
    low = tape.text.lower()
    if _may_be_spoken(low) and _SPOKEN_SIGN.search(tape.text) or _SPOKEN_MIXED.search(tape.text):
        tape.rewrite(_spoken(tape.text))
    if any(c in low for c in "([{<") and _BRACKET_SIGN.search(tape.text):
        tape.rewrite((m.start(), m.end(), "@" if next(filter(None, m.groups())).lower() in ("at", "@") else ".") for m in _BRACKETS.finditer(tape.text))
    if any(x in low for x in (" dot ", " . ", " @ ")) or " at " in low and _AT_NAME.search(low):
        tape.rewrite(_at_words(tape.text))
    if "_at_" in low or "-at-" in low:
        tape.rewrite(_joined(tape.text))
    tape.rewrite((k, k + 1, LETTER_DIGITS[tape.text[k]]) for k in _digit_letters(tape.text))
    return tape if tape.changed else None


def find(text: str) -> tuple[list[Span], list[Span]]:
    """The plain spans; the spans that only the normalised text shows. Those may hold a plain span of
    their kind, where a disguise left a shorter one, but don't lie in one."""
    base = detect(text)
    tape = normalised(text)
    if tape is None:
        return base, []
    ends = {kind: ([a for k, a, _ in base if k == kind], [b for k, _, b in base if k == kind]) for kind in KINDS}
    added = []
    for kind, a, b in detect(tape.text):
        if kind == "email" and not _ENDING.search(tape.text, a, b):
            continue
        start, end = tape.source(a, b)
        k = bisect_right(ends[kind][0], start) - 1  # plain spans of a kind are apart: only this one can hold it
        if k < 0 or ends[kind][1][k] < end:
            added.append((kind, start, end))
    return base, added


def _told(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def _texts(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        for part, data, rows in slices(batch, text):
            whole = data.tobytes()
            yield part, [whole[a:b].decode() for a, b in zip(rows[:-1], rows[1:], strict=True)]


def find_pii(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """carry; per kind the number of plain spans; base_sha256; spans; n_added, the spans that only the normalised text shows."""
    schema = docs.select(*carry).schema
    for name in (f"n_{k}" for k in KINDS):
        schema = schema.add(name, "long")
    schema = schema.add("base_sha256", "string").add("spans", "string").add("n_added", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches, text):
            got = [find(t) for t in texts]
            counts = [pa.array([sum(k == kind for k, _, _ in base) for base, _ in got], pa.int64()) for kind in KINDS]
            digests = pa.array([hashlib.sha256(_told(base).encode()).hexdigest() for base, _ in got], pa.string())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), *counts, digests, pa.array([_told(base + more) for base, more in got], pa.string()), pa.array([len(more) for _, more in got], pa.int64())], names=schema.names)

    return mapped(docs.select(*carry, *[text][text in carry :]), run, schema)


def redacted(text: str) -> str:
    """The text with [KIND] in place of each span; spans that overlap give way together to the first one's."""
    base, added = find(text)
    out, at, end = [], 0, -1
    for kind, a, b in sorted(base + added, key=lambda x: (x[1], -x[2], KINDS.index(x[0]))):
        if a >= end:
            out += text[at:a], f"[{kind.upper()}]"
            at = end = b
        else:
            at = end = max(end, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of personal data replaced in the text."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches, text):
            null = part.column(text).is_null().to_pylist()
            new = pa.array([None if x else redacted(t) for x, t in zip(null, texts, strict=True)], part.schema.field(text).type)
            yield pa.RecordBatch.from_arrays([new if c == text else part.column(k) for k, c in enumerate(names)], names=names)

    return mapped(docs, run, docs.schema)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
