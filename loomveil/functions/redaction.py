"""Redaction of one text: normalise, detect, resolve overlaps, number, replace, restore.

Offsets are code points of the original text.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from loomveil.functions import fixed as fx
from loomveil.functions.names import Lexicon, detect_names

_W = fx.WS


@dataclass(frozen=True)
class FilterConfig:
    enabled_types: tuple[str, ...] = fx.TYPES
    custom_names: tuple[str, ...] = ()
    exclude_words: tuple[str, ...] = ()
    placeholder_style: str = "bracket"  # or "redacted"
    lexicon: Lexicon = field(default_factory=Lexicon)

    def updated(self, **changes) -> FilterConfig:
        return replace(self, **changes)


@dataclass(frozen=True)
class Match:
    placeholder: str
    original: str
    type: str
    start: int
    end: int


# --- normalisation -------------------------------------------------------------------------

#: What normalisation changes: words broken at line ends, and stretches of blanks and invisible characters but for a lone blank.
_EVENT = re.compile(rf"(?<=[{fx.LOW}])-[ \t]*\n[ \t]*(?=[{fx.LOW}])|[\t \u00a0{fx.INVISIBLE}]{{2,}}|[\t\u00a0{fx.INVISIBLE}]")
_BLANK = re.compile(r"[\t \u00a0]")
_BOUNDARY = re.compile(rf"(?<=[{fx.LOW}0-9])(?=[A-ZÀ-Ý])")


class Places:
    """Where stretches of the normalised text are in the original one; what is between them was put in."""

    def __init__(self, starts: list[int], origins: list[int], lengths: list[int]):
        self.starts, self.origins, self.lengths = starts, origins, lengths

    def of(self, start: int, end: int) -> tuple[int, int] | None:
        """A span of the normalised text in the original one; what was put in at its ends is left out."""
        k = max(bisect_right(self.starts, start) - 1, 0)
        while k < len(self.starts) and self.starts[k] + self.lengths[k] <= start:
            k += 1
        if k == len(self.starts) or self.starts[k] >= end:
            return None
        first = self.origins[k] + max(start - self.starts[k], 0)
        k = bisect_left(self.starts, end) - 1
        return first, self.origins[k] + min(end - self.starts[k], self.lengths[k])


def normalised(text: str) -> tuple[str, Places]:
    """Text as detectors see it, and where its characters are in `text`."""
    pieces, at, upto = [], [], 0  # stretches of `text` that stay, one after another
    for m in _EVENT.finditer(text):
        a, b = m.span()
        blank = None if text[a] == "-" else _BLANK.search(text, a, b)
        pieces.append(text[upto:a])
        at.append(upto)
        if blank:
            pieces.append(" ")
            at.append(blank.start())
        upto = b
    pieces.append(text[upto:])
    at.append(upto)
    clean = "".join(pieces)
    cuts = [m.start() for m in _BOUNDARY.finditer(clean)]
    starts, origins, lengths, begin, shift, i = [], [], [], 0, 0, 0
    for piece, origin in zip(pieces, at, strict=True):
        end, here = begin + len(piece), begin
        while i < len(cuts) and cuts[i] < end:  # a blank comes in before that character
            if cuts[i] > here:
                starts.append(here + shift)
                origins.append(origin + here - begin)
                lengths.append(cuts[i] - here)
            here, shift, i = cuts[i], shift + 1, i + 1
        if end > here:
            starts.append(here + shift)
            origins.append(origin + here - begin)
            lengths.append(end - here)
        begin = end
    if cuts:
        clean = " ".join(clean[a:b] for a, b in zip([0, *cuts], [*cuts, len(clean)], strict=True))
    return clean, Places(starts, origins, lengths)


def mapped_back(start: int, end: int, at: Places) -> tuple[int, int] | None:
    """A span of the normalised text in the original one; inserted blanks at its ends are left out."""
    return at.of(start, end)


# --- detectors -----------------------------------------------------------------------------

_MONTH, _SHORT = "|".join(fx.MONTHS), "|".join(fx.SHORT_MONTHS)
_A, _AI = re.A, re.A | re.I
_DATE = r"\d{1,2}[-/.]\d{1,2}[-/.]"
PATTERNS: dict[str, list[re.Pattern]] = {
    "bsn": [re.compile(r"\b\d{9}\b|\b\d{4}[. \t-\r]\d{2}[. \t-\r]\d{3}\b", _A)],
    "date": [
        re.compile(rf"\b{_DATE}\d{{4}}\b", _A),
        re.compile(rf"\b{_DATE}\d{{2}}\b", _A),
        re.compile(rf"\b\d{{1,2}}[{_W}]+(?:{_MONTH}|{_SHORT})\.?[{_W}]+\d{{4}}\b", _AI),
        re.compile(rf"\b(?:{_MONTH})[{_W}]+\d{{4}}\b", _AI),
        re.compile(rf"\b(?:geboren[{_W}]+op|geb\.?)[{_W}]+{_DATE}\d{{4}}\b", _AI),
    ],
    "iban": [re.compile(rf"\b[A-Z]{{2}}\d{{2}}[{_W}]?[A-Z]{{4}}[{_W}]?\d{{4}}[{_W}]?\d{{4}}[{_W}]?\d{{2,4}}\b", _A)],
    "email": [re.compile(r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-z]{2,10}\b", _A)],
    "phone": [
        re.compile(rf"\b06(?:[-{_W}.]?\d{{1,2}}){{5}}\b", _A),
        re.compile(rf"(?:\+31|0031)[-{_W}.]?(?:\(0\)|0)?[-{_W}.]?6(?:[-{_W}.]?\d{{2}}){{4}}", _A),
        re.compile(rf"\b0[1-9]\d{{1,2}}[-{_W}.]\d{{1,3}}[-{_W}.]?\d{{1,3}}[-{_W}.]?\d{{1,3}}\b", _A),
        re.compile(rf"(?:\+31|0031)[-{_W}.]?(?:\(0\)|0)?[-{_W}.]?[1-9]\d{{1,2}}[-{_W}.]?\d{{6,7}}\b", _A),
        re.compile(rf"\b(?:tel:|telefoon:)[{_W}]*[-{_W}\d()]+", _AI),
    ],
    "postcode": [re.compile(rf"\b\d{{4}}[{_W}]?[A-Z]{{2}}\b", _A)],
    "address": [re.compile(rf"\b[A-Z][a-zéèêëïöüà]+(?:[{_W}][a-z]+)*(?:{'|'.join(fx.STREETS)})[{_W}]+\d{{1,5}}[{_W}]?[a-zA-Z]?(?:[{_W}]?(?:bis|hs))?\b", _A)],
}
#: All types but these two have a digit.
_WITHOUT_DIGITS = ("name", "email")
_DIGIT = re.compile(r"\d", _A)
_BSN_WORD = re.compile(r"\bbsn\b|burgerservicenummer", _A)
_NUMERIC_DATE = re.compile(r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{2,4})", _A)
_DASHES = str.maketrans({"–": "-", "—": "-", "−": "-"})


def valid_bsn(digits: str) -> bool:
    """The eleven test: weights 9 to 2 and -1."""
    if len(digits) != 9 or digits == "000000000":
        return False
    total = sum(int(d) * w for d, w in zip(digits, (9, 8, 7, 6, 5, 4, 3, 2, -1), strict=True))
    return total > 0 and total % 11 == 0


def plausible_date(text: str) -> bool:
    m = _NUMERIC_DATE.search(text)
    return not m or 1 <= int(m[1]) <= 31 and 1 <= int(m[2]) <= 12


def _accepted(kind: str, text: str, m: re.Match) -> bool:
    if kind == "bsn":
        return valid_bsn(re.sub(r"\D", "", m[0])) or bool(_BSN_WORD.search(text[max(0, m.start() - 40) : m.start() + 20].lower()))
    if kind == "date":
        return plausible_date(m[0])
    if kind == "phone":
        return sum(c in "0123456789" for c in m[0]) >= 9
    if kind == "postcode":
        return int(m[0][:4]) >= 1000
    return True


def detect(text: str, kind: str, lexicon: Lexicon) -> list[tuple[int, int]]:
    """Spans of one type in normalised text."""
    if kind == "name":
        return detect_names(text, lexicon)
    if kind not in _WITHOUT_DIGITS and not _DIGIT.search(text) or kind == "email" and "@" not in text:
        return []
    seen = text.translate(_DASHES) if kind == "phone" else text
    return [m.span() for p in PATTERNS[kind] for m in p.finditer(seen) if _accepted(kind, seen, m)]


# --- resolution and numbering --------------------------------------------------------------


def resolved(found: Iterable[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The earliest start wins, the longest of equal starts, the first listed of equal spans."""
    out: list[tuple[int, int, str]] = []
    for f in sorted(found, key=lambda x: (x[0], x[0] - x[1])):
        if not out or f[0] >= out[-1][1]:
            out.append(f)
    return out


class People:
    """Numbers of persons: mentions by a part of a known name share its number."""

    def __init__(self) -> None:
        self.known: list[list] = []  # [name, number]

    def number(self, name: str) -> int:
        low = name.lower()
        for person in self.known:
            full = person[0].lower()
            if full == low or full.startswith(low + " ") or full.endswith(" " + low) or len(low.split()) == 1 and low in full.split():
                return person[1]
            if low.startswith(full + " "):
                person[0] = name
                return person[1]
        self.known.append([name, len(self.known) + 1])
        return len(self.known)


def placeholder(kind: str, number: int, original: str, style: str) -> str:
    return "█" * len(original) if style == "redacted" else f"[{kind.upper()}-{number:03d}]"


def find_matches(text: str, config: FilterConfig) -> list[Match]:
    """All matches of a text in order, disjoint and numbered."""
    seen, at = normalised(text)
    lexicon = config.lexicon.with_first(config.custom_names)
    found = [(*span, kind) for kind in config.enabled_types for s, e in detect(seen, kind, lexicon) if (span := mapped_back(s, e, at))]
    excluded = {w.lower() for w in config.exclude_words}
    people, counts, out = People(), dict.fromkeys(fx.TYPES, 0), []
    for s, e, kind in resolved(found):
        original = text[s:e]
        if original.lower() in excluded:
            continue
        counts[kind] += 1
        number = people.number(original) if kind == "name" else counts[kind]
        out.append(Match(placeholder(kind, number, original, config.placeholder_style), original, kind, s, e))
    return out


def spliced(text: str, matches: Iterable[Match]) -> str:
    out, at = [], 0
    for m in matches:
        out += [text[at : m.start], m.placeholder]
        at = m.end
    return "".join([*out, text[at:]])


def restored(filtered: str, matches: list[Match]) -> str:
    """The original text, from offsets: exact even where placeholders repeat."""
    out, at, read = [], 0, 0
    for m in matches:
        gap = m.start - at
        out += [filtered[read : read + gap], m.original]
        read, at = read + gap + len(m.placeholder), m.end
    return "".join([*out, filtered[read:]])


def restored_by_text(filtered: str, matches: list[Match]) -> str:
    """Replace the first occurrence of each placeholder, last match first; lossy where they repeat."""
    for m in reversed(matches):
        filtered = filtered.replace(m.placeholder, m.original, 1)
    return filtered


def stats(matches: Iterable[Match]) -> dict[str, int]:
    out = dict.fromkeys(fx.TYPES, 0)
    for m in matches:
        out[m.type] += 1
    return out
