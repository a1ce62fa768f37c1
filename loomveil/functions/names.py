"""Person names in Dutch text: ten passes over one text, each seeing what earlier ones found.

What the passes start from is found in two runs over a text, whatever the size of the lists:
one automaton over the indicators, on the text in lower case, and one over all given names.
Their hits are read by every pass; a text without hits ends there but for names that need
neither (initials, labels, capitals), whose patterns run only where a sign of them is seen.

A text's spans are kept sorted and disjoint, so asking whether a position is taken
is a bisection. Passes that extend a given name look at the text in place.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import ahocorasick

from loomveil.functions import fixed as fx

Span = tuple[int, int]
_C, _L, _W = fx.CAP, fx.LOW, fx.WS
_WIDE = rf"""[{_W}.,;:!?()"'„«»]"""
_NARROW = rf"""[{_W}.,;:!?()"']"""
_TAIL = rf"(?={_NARROW}|\Z)"


def _after(edge: str) -> str:
    return rf"(?:^|(?<={edge}))"


def _any(words: Iterable[str]) -> str:
    return "|".join(map(re.escape, words))


_PARTICLES = "van|de|den|der|het|'t|d'|te|ten|ter"
_LONG_PARTICLES = "van|de|den|der|het|'t|d'|te|ten|ter|in|op|aan|bij|uit|voor|over|onder|tot"
LABEL_PARTICLES = "van|de|den|der|het|'t|te|ten|ter|in|op|aan|bij|uit|voor|over|onder|tot"
_LONGEST_FIRST = sorted(fx.PREFIXES, key=len, reverse=True)
_LETTER = rf"(?:[{_L}]|'(?=[A-Za-zÀ-ÿ]))"
_GIVEN = rf"[{_C}][{_L}']+(?:-[{_C}][{_L}']+)*"

NAMED = re.compile(rf"{_GIVEN}(?:[{_W}]+{_GIVEN})?[{_W}]+(?:(?:{_LONG_PARTICLES})[{_W}]+)*[{_C}][{_L}']+")
SINGLE = re.compile(rf"[{_C}][{_L}']{{2,}}(?:-[{_C}][{_L}']+)*")
WORD = re.compile(rf"{_after(_WIDE)}([{_C}]{_LETTER}+(?:-[{_C}]{_LETTER}+)*)(?={_WIDE}|$)", re.M)
# every prefix, longest first; d' sticks to what follows it
PREFIXED = [re.compile(rf"[{_W}]+{re.escape(p)}{'' if p.endswith(chr(39)) else f'[{_W}]+'}([{_C}][{_L}]+){_TAIL}", re.I) for p in _LONGEST_FIRST]
SPACED = [re.compile(rf"[{_W}]+{re.escape(p)}[{_W}]+([{_C}][{_L}]+){_TAIL}", re.I) for p in _LONGEST_FIRST]
HYPHENED = [re.compile(rf"-{re.escape(p)}[{_W}]+([{_C}][{_L}]+){_TAIL}", re.I) for p in _LONGEST_FIRST]
HYPHEN = re.compile(rf"-([{_C}][{_L}]+){_TAIL}")
DIRECT = re.compile(rf"""[{_W}]+([{_C}][{_L}']+)(?=[{_W}.,;:!?()"'\-]|\Z)""")
SECOND = re.compile(rf"[{_W}]+([{_C}][{_L}]+){_TAIL}")
DIRECT3 = re.compile(rf"[{_W}]+([{_C}][{_L}']{{2,}}){_TAIL}")
INITIALS = re.compile(rf"{_after(_WIDE)}([{_C}]\.(?:[{_W}]?[{_C}]\.)*[{_W}]?)((?:(?:{_PARTICLES}|El|el)[{_W}]+)*[{_C}][{_L}']+)(?={_WIDE}|$)", re.M)
ONE_PARTICLE = re.compile(rf"(?:{_PARTICLES}|El|el)[{_W}]+", re.I)
CLOCK = re.compile(r"[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?")
LABEL_WORD = re.compile(rf"(?:{LABEL_PARTICLES})", re.I)
REVERSED = re.compile(rf"(?:^|(?<=[{_W}(]))([{_C}][{_L}']*),[{_W}]+([{_C}][{_L}'.]*(?:-[{_C}][{_L}'.]+)?)(?:[{_W}]+(?:{_PARTICLES}))*(?=[{_W}).,;:!?]|$)", re.M)
_CAPS = "[A-ZÀ-Ý]{2,}(?:-[A-ZÀ-Ý]{2,})?"
CAPITALS = re.compile(rf"{_after(_NARROW)}{_CAPS}(?:[{_W}]+(?:VAN|DE|DEN|DER|HET|TE|TEN|TER))*[{_W}]+{_CAPS}(?={_NARROW}|$)", re.M)
COMMA_CONTEXT = re.compile(rf",[{_W}]+(?:{_any(fx.AFTER_COMMA)})\b", re.I | re.A)
VERB_CONTEXT = re.compile(rf"[{_W}]+(?:{_any(fx.VERBS)})\b", re.I | re.A)
BEFORE_CONTEXT = re.compile(rf"(?:{_any(fx.BEFORE_NAME)})[{_W}]+\Z", re.I)
LONG_WORD = re.compile(rf"{_after(_WIDE)}([A-Za-zÀ-ÿ]{{5,}})(?={_WIDE}|$)", re.M)
SPACES = re.compile(f"[{_W}]+")
BLANKS, EDGES = frozenset(re.findall(f"[{_W}]", "".join(map(chr, range(0x10000))))), frozenset(re.findall(_NARROW, "".join(map(chr, range(0x10000)))))
#: Signs that a text may hold initials or names in capitals.
INITIAL, TWO_CAPITALS = re.compile(rf"[{_C}]\."), re.compile("[A-ZÀ-Ý]{2}")
COMMON = frozenset(fx.COMMON_WORDS)
COMPONENT_PARTICLES = frozenset("van de den der het 't d' te ten ter el al in op".split())
GLUED_PARTICLES = frozenset("de den der van ten ter".split())
ALL_CAPS_PARTICLES = frozenset("VAN DE DEN DER HET TE TEN TER".split())


def _automaton(words: Iterable[str]) -> ahocorasick.Automaton | None:
    """An automaton over words that gives the length of what it finds; none for no words."""
    made = ahocorasick.Automaton()
    for w in words:
        if w:
            made.add_word(w, len(w))
    if not len(made):
        return None
    made.make_automaton()
    return made


@lru_cache(maxsize=1)
def _indicators() -> tuple[ahocorasick.Automaton, dict[str, int]]:
    """The indicators in lower case, and the place of each in the list."""
    order: dict[str, int] = {}
    for i, w in enumerate(fx.INDICATORS):
        order.setdefault(w.lower(), i)
    return _automaton(order), order


@dataclass(frozen=True)
class Lexicon:
    """Given names and surnames, case-sensitive; there are none by default.

    Without lists, names are found by indicators, initials and likely surnames alone.
    """

    first: frozenset[str] = frozenset()
    last: frozenset[str] = frozenset()
    #: Further given names, looked up beside `first` so that neither list is copied.
    more: frozenset[str] = frozenset()

    @classmethod
    def of(cls, first: Iterable[str], last: Iterable[str]) -> Lexicon:
        return cls(frozenset(first), frozenset(last))

    @classmethod
    def from_files(cls, first: str, last: str) -> Lexicon:
        """From two text files with a name on each line."""
        read = lambda p: frozenset(x.strip() for x in open(p, encoding="utf-8") if x.strip())  # noqa: E731, SIM115
        return cls(read(first), read(last))

    @classmethod
    def from_tables(cls, first, last, column: str = "name", most: int = 1_000_000) -> Lexicon:
        """From two DataFrames with a column of names; lists are sent to every worker, so more than `most` names are refused."""
        lists = [[r[0] for r in t.where(f"{column} is not null").select(column).distinct().limit(most + 1).collect()] for t in (first, last)]
        if max(map(len, lists)) > most:
            raise ValueError(f"a list has more than {most} names")
        return cls(*map(frozenset, lists))

    def with_first(self, names: Iterable[str]) -> Lexicon:
        more = frozenset(names)
        if not more:
            return self
        made = Lexicon(self.first, self.last, self.more | more)
        made.__dict__["_listed"] = self._listed  # compiled once for all that share the list
        return made

    @cached_property
    def _listed(self) -> ahocorasick.Automaton | None:
        return _automaton(self.first)

    @cached_property
    def _further(self) -> ahocorasick.Automaton | None:
        return _automaton(self.more)

    def __getstate__(self) -> dict:  # automata are compiled where they are used
        return {k: self.__dict__[k] for k in ("first", "last", "more")}

    def is_first(self, word: str) -> bool:
        known = lambda w: w in self.first or w in self.more
        return known(word) or "-" in word and all(map(known, word.split("-")))

    def is_last(self, word: str) -> bool:
        return word in self.last or likely_surname(word)

    def first_places(self, text: str) -> list[int]:
        """Where listed given names begin, inside longer words too."""
        found = {end - n + 1 for made in (self._listed, self._further) if made for end, n in made.iter(text)}
        return sorted(found)


def common(word: str) -> bool:
    return word.lower() in COMMON


def likely_surname(word: str) -> bool:
    if len(word) < 3 or common(word):
        return False
    low = word.lower()
    return low.endswith(tuple(fx.SURNAME_ENDINGS)) or len(word) > 5 and low.startswith(tuple(fx.SURNAME_STARTS))


def sweep(spans: Iterable[Span]) -> list[Span]:
    """Disjoint spans: the earlier start wins, and the longer of equal starts."""
    out: list[Span] = []
    for s in sorted(spans, key=lambda x: (x[0], -x[1])):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def taken(start: int, end: int, held: list[Span]) -> bool:
    """Whether a span overlaps one of sorted disjoint spans."""
    at = bisect_left(held, (end,))
    return at > 0 and held[at - 1][1] > start


class _Found:
    """Spans that a pass adds to those of earlier passes."""

    def __init__(self, held: list[Span]):
        self.held, self.new = held, []

    def free(self, start: int, end: int) -> bool:
        return not taken(start, end, self.held) and not taken(start, end, self.new)

    def add(self, start: int, end: int) -> None:
        """A span that overlaps none of those added before."""
        insort(self.new, (start, end))


def _lower(text: str) -> str:
    """Lower case of the same length: the few letters whose lower case is longer stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


class _Text:
    """A text with what the automata found in it."""

    def __init__(self, text: str, lex: Lexicon):
        self.text, self.lex, self.held = text, lex, []
        self.places = lex.first_places(text)

    @cached_property
    def given(self) -> list[tuple[int, int]]:
        """Words that are listed given names, or all of whose parts are, and no common words."""
        found = (WORD.match(self.text, s) for s in self.places)
        return [m.span(1) for m in found if m and self.lex.is_first(m[1]) and not common(m[1])]

    def indicators(self) -> Iterator[int]:
        """Where the text goes on after each indicator and its blanks; of indicators that begin together the first listed."""
        made, order = _indicators()
        low, n = _lower(self.text), len(self.text)
        hits = [(end - k + 1, order[low[end - k + 1 : end + 1]], end + 1) for end, k in made.iter(low) if end + 1 < n and low[end + 1] in BLANKS]
        upto = 0
        for start, _, end in sorted(hits):
            if start >= upto:
                upto = SPACES.match(self.text, end).end()
                yield upto


# --- first round: each pass by itself ------------------------------------------------------


def _after_indicators(t: _Text) -> Iterator[Span]:
    for at in t.indicators():
        if full := NAMED.match(t.text, at):
            yield full.span()
        elif (one := SINGLE.match(t.text, at)) and (t.lex.is_first(one[0]) or one[0] in t.lex.last):
            yield one.span()


def _extended(text: str, at: int, lex: Lexicon) -> int | None:
    """Where a full name ends whose given name ends at `at`."""
    for p in PREFIXED:
        if m := p.match(text, at):
            return m.end()
    direct = DIRECT.match(text, at)
    if not direct:
        return None
    word = direct[1]
    if not common(word) and lex.is_last(word):
        for p in HYPHENED:
            if m := p.match(text, direct.end()):
                return m.end()
        m = HYPHEN.match(text, direct.end())
        return m.end() if m and lex.is_last(m[1]) else direct.end()
    if common(word) and word in lex.last:
        m = SECOND.match(text, direct.end())
        if m and lex.is_last(m[1]):
            return m.end()
    return None


def _full_names(t: _Text) -> Iterator[Span]:
    upto = 0
    for start, at in t.given:
        if start >= upto and (end := _extended(t.text, at, t.lex)) is not None:
            upto = end
            yield start, end


def _initials(t: _Text) -> Iterator[Span]:
    for m in INITIALS.finditer(t.text) if INITIAL.search(t.text) else ():
        if t.lex.is_last(ONE_PARTICLE.sub("", m[2], count=1).strip() if ONE_PARTICLE.match(m[2]) else m[2]):
            yield m.span()


def _speakers(t: _Text) -> Iterator[Span]:
    at, before = 0, None
    for raw in t.text.split("\n"):
        line, start, previous = raw.strip(), at, before
        at, before = at + len(raw) + 1, line
        if previous is not None and not CLOCK.fullmatch(previous):
            continue
        words = SPACES.split(line)
        fits = 2 <= len(words) <= 5 and re.match(f"[{_C}]", line) and line[-1] not in ".!?;"
        if fits and all(re.match(f"[{_C}]", w) or LABEL_WORD.fullmatch(w) or w == "-" for w in words) and any(t.lex.is_first(w) or t.lex.is_last(w) for w in words):
            yield start, start + len(line)  # the untrimmed line's start, the trimmed line's length


def _reversed(t: _Text) -> Iterator[Span]:
    for m in REVERSED.finditer(t.text) if t.places else ():
        if t.lex.is_first(m[2]) and t.lex.is_last(m[1]):
            yield m.span()


def _capitals(t: _Text) -> Iterator[Span]:
    title = lambda w: "-".join(p[:1].upper() + p[1:].lower() for p in w.split("-"))
    for m in CAPITALS.finditer(t.text) if TWO_CAPITALS.search(t.text) else ():
        names = [title(w) for w in SPACES.split(m[0]) if w and w.upper() not in ALL_CAPS_PARTICLES]
        if len(names) >= 2 and (t.lex.is_first(names[0]) or t.lex.is_last(names[-1])):
            yield m.span()


# --- later rounds: with what was found -----------------------------------------------------


def _components(texts: Iterable[str]) -> list[str]:
    out: dict[str, None] = {}
    for t in texts:
        parts = SPACES.split(t)
        if len(parts) < 2:
            continue
        for p in (parts[0], parts[-1]):
            if len(p) >= 2 and re.match(f"[{_C}]", p) and not common(p):
                out[p] = None
        for i, p in enumerate(parts[:-1]):
            if p.lower() in COMPONENT_PARTICLES:
                surname = " ".join(parts[i:])
                if len(surname) >= 4:
                    out[surname] = None
                    out[p[:1].upper() + p[1:] + " " + " ".join(parts[i + 1 :])] = None
                break
    return list(out)


def _propagated(t: _Text) -> list[Span]:
    found, text = _Found(t.held), t.text
    for name in _components(text[s:e] for s, e in t.held):
        s = text.find(name)
        while s >= 0:
            e = s + len(name)
            whole = (s == 0 or text[s - 1] in EDGES) and (e == len(text) or text[e] in EDGES)
            if whole and found.free(s, e):
                found.add(s, e)
            s = text.find(name, e if whole else s + 1)
    return found.new


def _in_context(t: _Text) -> list[Span]:
    found, text = _Found(t.held), t.text
    for s, e in t.given:
        if found.free(s, e) and (COMMA_CONTEXT.match(text, e) or BEFORE_CONTEXT.search(text[max(0, s - 20) : s]) or VERB_CONTEXT.match(text, e)):
            found.add(s, e)
    return found.new


def _further_name(t: _Text, s: int, e: int) -> int | None:
    """Where a name ends that goes on after a given name, by a prefix and any word, or by a word where other names are."""
    text = t.text
    for p in SPACED:
        if (x := p.match(text, e)) and not common(x[1]):
            return x.end()
    x = DIRECT3.match(text, e)
    if x and not common(x[1]):
        lo, hi = text.rfind("\n\n", 0, s + 2), text.find("\n\n", s)
        lo, hi = max(lo, 0), len(text) if hi < 0 else hi
        if likely_surname(x[1]) or any(a >= lo and b <= hi for a, b in t.held):
            return x.end()
    return None


def _aggressive(t: _Text) -> list[Span]:
    found, upto = _Found(t.held), 0
    for s, e in t.given:
        if s >= upto and found.free(s, e) and (end := _further_name(t, s, e)) is not None:
            found.add(s, end)
            upto = end
    for s, e in t.given:
        if found.free(s, e) and any(abs(a - s) < 200 or abs(b - s) < 200 for a, b in t.held):
            found.add(s, e)
    return found.new


def _glued(t: _Text) -> list[Span]:
    surnames: set[str] = set()
    for s, e in t.held:
        parts = SPACES.split(t.text[s:e].lower())
        for i, p in enumerate(parts[:-1]):
            if p in GLUED_PARTICLES:
                surnames.add("".join(parts[i:]))
                if len(rest := "".join(parts[i + 1 :])) >= 3:
                    surnames.add(rest)
    found = _Found(t.held)
    if surnames:
        for m in LONG_WORD.finditer(t.text):
            if m[1].lower() in surnames and found.free(*m.span(1)):
                found.add(*m.span(1))
    return found.new


def speaker_labels(text: str, lex: Lexicon) -> list[Span]:
    """Spans of the names that stand alone in a first line, or in a line after a clock."""
    return list(_speakers(_Text(text, lex)))


def detect_names(text: str, lex: Lexicon) -> list[Span]:
    """Sorted disjoint spans of person names."""
    t = _Text(text, lex)
    alone = (_after_indicators, _full_names, _initials, _speakers, _reversed, _capitals)
    t.held = sweep(s for p in alone for s in p(t))
    for p in (_propagated, _in_context, _aggressive, _glued):
        t.held = sweep([*t.held, *p(t)])
    return t.held
