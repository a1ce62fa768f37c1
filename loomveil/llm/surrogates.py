"""PII surrogates: keyed, type-consistent replacements with collision checks.

Detected: e-mail addresses, phone numbers, card and account numbers, national
numbers (3-2-4 digits), IBANs, IPv4 addresses, secrets after words such as
`token =`, and person names (after a title, or a listed given name before a
capitalised surname; each name's parts are then found throughout its document).
A secret or an address's local part without a letter or digit is none.

A surrogate is a keyed permutation of the entity within its own format. Every letter
and every decimal digit, of any script, is replaced by one of its class: the digits
of its script, the letters of one case of its stretch of its script (vowels by vowels
and consonants by consonants in names), or hexadecimal digits. Letter case is carried
over position by position, and separators stay. The permutation is a Feistel network
over all strings of that format, so different entities of one format never meet, and
the same entity gets the same surrogate in every document and in every letter case.
Valid check digits (Luhn's of cards, those of IBANs) become valid ones.

Coreference: a redraw belongs to the entity with all its forms. Phone numbers are known
by their last seven digits, which are permuted by themselves, as is the area; a
shortened mention so agrees with the full one after any number of redraws. An address's
domain is permuted alike in all addresses. Full names are replaced part by part, so
later mentions by one part agree.

Gender and script: listed given names are permuted within their gender's list for four
draws. In a corpus that holds all names of a list those draws all meet real names;
then names are composed of syllables with an ending of the same script and gender.
No composed name is a listed one, and their number grows with the redraws. Surnames with
an ending that shows gender get one of the same gender (`ENDINGS`).

Collision check, over the distinct entities of the whole corpus: a surrogate that
equals a real entity, or the surrogate of another one, is drawn again with the next
tweak until none is left. From `max_tweaks` on every redraw widens the format by
one more letter (digit, in numbers), so entities of a format that is used up get a
free surrogate too; only IPv4 addresses have no wider format. Initials between a
listed given name and a surname ("John F. Kennedy") are replaced in that place only,
by another letter; one letter names nobody and is not checked for collisions. A
capitalised word after such an initial counts as the surname.
The few redrawn entities travel as a broadcast while they
are at most `max_redrawn`; beyond that each document gets its own by a join.

Whoever has the key can undo the surrogates. Without a key of the caller's, one is made
up for this session: results then differ from session to session.

Edge cases: null texts stay null, texts without entities stay untouched, repeated
rows get equal results, columns of the caller's named n_entities or kinds stay (ours
get a trailing underscore then).
"""

from __future__ import annotations

import functools
import hmac
import json
import re
import secrets
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomveil.llm import bytescan as bs
from loomveil.llm import scratch

# Given names by script and gender (fixed values); a listed name's surrogate is of its own list.
GIVEN = {
    "latin-f": "Anna Maria Emma Julia Laura Sophie Clara Elena Lucia Marta Carmen Isabel Sarah Emily Alice Rachel Hannah Olivia Camille Chloe Manon Claire Ingrid Greta Heike Sabine Petra Monika Susan Karen Linda Nancy Teresa Paula Rosa Silvia Nora Eva Ida Ruth",
    "latin-m": "Jan Peter Paul Thomas Michael David Daniel Robert James John William George Henri Louis Pierre Jacques Antoine Hugo Carlos Miguel Javier Pablo Diego Luis Hans Karl Friedrich Stefan Markus Jonas Felix Oscar Simon Martin Richard Edward Frank Walter Bruno Emil",
    "cyrillic-f": "Анна Мария Елена Ольга Наталья Ирина Светлана Татьяна Екатерина Юлия",
    "cyrillic-m": "Иван Пётр Сергей Алексей Дмитрий Андрей Михаил Николай Павел Олег",
    "greek-f": "Μαρία Ελένη Κατερίνα Σοφία Άννα Ειρήνη",
    "greek-m": "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Παύλος",
}
# Consonants, vowels and endings of composed given names, by script and gender (fixed values). All heads of one number
# of syllables are equally long and no ending is of two genders, so names composed of different parts differ.
COMPOSED = {
    "latin-f": ("bdfglmnprstv", "aeiou", "linda drina nella vessa rianne mira"),
    "latin-m": ("bdfglmnprstv", "aeiou", "rick lbert mund nard stian vor"),
    "cyrillic-f": ("бвгдлмнпрст", "аеио", "лина мира слава ислава нелла"),
    "cyrillic-m": ("бвгдлмнпрст", "аеио", "мир слав ислав дан рад"),
    "greek-f": ("βγδλμνπρστ", "αειο", "λίνα νθη ρία ούλα δώρα"),
    "greek-m": ("βγδλμνπρστ", "αειο", "νδρος ρίων λέας κλής δωρος"),
}
TITLES = "Mr Mrs Ms Miss Dr Prof Sir Madam Herr Frau Monsieur Madame Mme Mlle Señor Señora Sr Sra Don Doña г-н г-жа Κος Κα".split()


# Endings of surnames that show gender; one is replaced by another of its group (fixed values).
ENDINGS = ("ова ева ёва", "ина ына", "ская цкая", "ский цкий", "ов ев ёв", "ин ын", "ova eva", "ska cka", "ski cki")
SESSION_KEY = secrets.token_bytes(32)


@dataclass(frozen=True)
class SurrogateRules:
    key: bytes = SESSION_KEY
    max_redrawn: int = 200_000
    max_tweaks: int = 32


# --- detection -----------------------------------------------------------------------------

_EMAIL = re.compile(r"[.%+-]*\w[\w.%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_SECRET = re.compile(r"""(?i)\b(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth)\b["']?\s*[:=]\s*["']?((?=[_\-./+]*[A-Za-z0-9])[A-Za-z0-9_\-./+]{8,})""")
_NUMERIC = (
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("ip", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)")),
    ("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3}[ .-]?\d{3,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4}|\d{3}-\d{4}|\+\d{8,14}|\+\d{1,3}(?:[ .-]\d{1,4}){3,5})(?![\w])")),
    ("national", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("card", re.compile(r"(?<!\d)(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{13,19}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)")),
)
_CAPITAL = "[" + "".join(filter(str.isupper, map(chr, range(0x41, 0x530)))) + "]"
_WORD = rf"{_CAPITAL}[^\W\d_]*(?:['’-]{_CAPITAL}?[^\W\d_]+)*"
_TITLED = re.compile(rf"(?<!\w)(?:{'|'.join(TITLES)})\.?[ ]({_WORD}(?: (?:van|von|de|der|den|del|la|du) ?| ){{0,1}}(?:{_WORD})?)")
_PAIR = re.compile(rf"(?<!\w)(?=({_CAPITAL}\w+) ({_WORD}))")
#: A given name's initials, and the surname after them; an initial without a full stop needs the surname.
_INITIALS = re.compile(rf"(?<!\w)(?=({_CAPITAL}\w+)((?: {_CAPITAL}(?:\.(?: ?{_CAPITAL}\.)*|(?= {_CAPITAL})))+)(?: ({_WORD}))?)")


@functools.cache
def _given() -> dict[str, tuple[str, int]]:
    return {n.casefold(): (k, i) for k, names in GIVEN.items() for i, n in enumerate(names.split())}


def detect(text: str) -> list[tuple[int, int, str]]:
    """Disjoint spans (start, end, type) in order; the earlier and then the longer span wins."""
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        found += [(m.start(), m.end(), "email") for m in _EMAIL.finditer(text)]
    if "=" in text or ":" in text:
        found += [(m.start(1), m.end(1), "secret") for m in _SECRET.finditer(text)]
    if re.search(r"\d", text):
        found += [(m.start(), m.end(), kind) for kind, p in _NUMERIC for m in p.finditer(text)]
    found += _names(text)
    out: list[tuple[int, int, str]] = []
    for s in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def _names(text: str) -> list[tuple[int, int, str]]:
    given, parts, initials = _given(), set(), set()
    for m in _TITLED.finditer(text):
        parts |= {w for w in m[1].split() if w[0].isupper() and len(w) > 1}
    for m in _PAIR.finditer(text):
        if m[1].casefold() in given and m[1] not in TITLES:
            parts |= {m[1], m[2]} if len(m[2]) > 1 else {m[1]}
    for m in _INITIALS.finditer(text) if parts else ():
        if m[1].casefold() in given and m[1] not in TITLES:
            initials |= {m.start(2) + i for i, c in enumerate(m[2]) if c.isalpha()}
            parts |= {m[3]} if m[3] and len(m[3]) > 1 else set()
    if not parts:
        return []
    wanted = re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, parts), key=len, reverse=True)) + r")(?!\w)")
    return [(m.start(), m.end(), "name") for m in wanted.finditer(text)] + [(i, i + 1, "initial") for i in initials]


# --- keyed permutations --------------------------------------------------------------------

#: Scripts of so many letters that a stretch of 128 would tell much of a letter: all their letters are one class.
_WHOLE = ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAC00, 0xD7A4))
#: Stretches without letters of old or foreign spellings: Greek, Cyrillic, and Cyrillic's further letters.
_CORE = ((0x3B1, 0x3CA), (0x430, 0x450), (0x450, 0x460))
_VOWELS = frozenset("aeiouyæœøıαεηιουωаеиоуыэюяёієї")
_DIGITS, _HEX, _PLAIN = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"


def _vowel(c: str) -> bool:
    return unicodedata.normalize("NFD", c)[0] in _VOWELS


@functools.lru_cache(1 << 16)
def letters_like(c: str, names: bool) -> str:
    """What a lower-case letter or a digit may become, itself among it; "" for all other characters, which stay.

    A letter that is alone in its class becomes one of a to z.
    """
    if c.isdecimal():
        zero = ord(c) - unicodedata.decimal(c)
        return "".join(chr(zero + k) for k in range(10))
    if not c.isalpha():
        return ""
    lo, hi = next(((a, b) for a, b in (*_WHOLE, *_CORE) if a <= ord(c) < b), (ord(c) & ~127, (ord(c) & ~127) + 128))
    kind, single = unicodedata.category(c), len(c.upper()) == 1
    fits = lambda x: x.isalpha() and unicodedata.category(x) == kind and (len(x.upper()) == 1) == single and unicodedata.normalize("NFKC", x) == x and (not names or _vowel(x) == _vowel(c))
    found = "".join(x for x in map(chr, range(lo, hi)) if fits(x))
    return found if c in found and len(found) > 1 else c + _PLAIN.replace(c, "")


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0..size-1: a Feistel network on enough bits, walked until it lands inside."""
    if size < 2:
        return value
    half = (max(2, (size - 1).bit_length()) + 1) // 2
    low = (1 << half) - 1
    while True:
        a, b = value >> half, value & low
        for r in range(8):
            f = _round_bytes(key, f"{tweak}|{size}|{r}|{b}", (half + 7) // 8 + 1)
            a, b = b, a ^ (int.from_bytes(f, "big") & low)
        value = a << half | b
        if value < size:
            return value


def _round_bytes(key: bytes, text: str, n: int) -> bytes:
    out = hmac.digest(key, text.encode(), "sha256")
    k = 1
    while len(out) < n:  # formats of more than 500 bits
        out += hmac.digest(key, f"{text}|{k}".encode(), "sha256")
        k += 1
    return out[:n]


def permute_text(text: str, key: bytes, tweak: str, names: bool = False, like: Callable[[str], str] | None = None, ends: str = "") -> str:
    """Replace each letter and digit by one of its class, as one permutation of all such strings; others stay.

    ends: endings of which one follows `text` (the last of them that does), replaced by another of them.
    """
    ending = next((e for e in sorted(ends.split(), key=len, reverse=True) if text.lower().endswith(e)), "")
    body, options = text[: len(text) - len(ending)], ends.split()
    lower = [c.lower() if len(c.lower()) == 1 else c for c in body]
    of = [(like or (lambda c: letters_like(c, names)))(c) for c in lower]
    value, size = 0, 1
    for c, a in zip(lower, of, strict=True):
        if a:
            value, size = value * len(a) + a.index(c), size * len(a)
    if ending:
        value, size = value * len(options) + options.index(ending), size * len(options)
    # the fixed characters and the classes are part of the format, and so of the tweak
    shape = "".join(c if not a else f"<{min(a)}{len(a)}>" for c, a in zip(lower, of, strict=True)) + (ends if ending else "")
    value = permute(value, size, key, f"{tweak}|{shape}")
    out: list[str] = []
    if ending:
        value, k = divmod(value, len(options))
        out.append(options[k].upper() if text[-1].isupper() else options[k])
    for c, a in zip(reversed(body), reversed(of), strict=True):
        if not a:
            out.append(c)
            continue
        value, k = divmod(value, len(a))
        new = a[k]
        out.append(new.upper() if c != c.lower() and len(new.upper()) == 1 else new)
    return "".join(reversed(out))


def luhn(digits: str) -> int:
    """The digit that makes `digits` + it valid."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def iban_check(country: str, account: str) -> str:
    """The two check digits of an account."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


def _ascii_digits(text: str) -> str:
    return "".join(str(unicodedata.decimal(c)) for c in text if c.isdecimal())


def _digits_into(form: str, digits: str) -> str:
    """`form` with other digits, in its own script; those beyond its own stand at the end."""
    it = iter(digits)
    return "".join(letters_like(c, False)[int(next(it))] if c.isdecimal() else c for c in form) + "".join(it)


def canonical(kind: str, text: str) -> str:
    """What makes two mentions the same number, address or name."""
    if kind == "phone":
        digits = _ascii_digits(text)
        return digits[-10:] if len(digits) >= 10 else digits
    if kind in ("card", "national"):
        return _ascii_digits(text)
    if kind == "iban":
        return text.replace(" ", "")
    if kind == "ip":
        return ".".join(str(int(x)) for x in text.split("."))
    return text.casefold() if kind in ("email", "name") else text


def entity(kind: str, text: str) -> str:
    """What a redraw belongs to: of a phone number its last seven digits, which its short forms have too."""
    return _ascii_digits(text)[-7:] if kind == "phone" else canonical(kind, text)


def composed_name(group: str, index: int, key: bytes, tweak: str, syllables: int) -> str:
    """A name of the script and gender of `group`; different indexes get different names."""
    consonants, vowels, endings = COMPOSED[group]
    ends, per = endings.split(), len(consonants) * len(vowels)
    value, end = divmod(permute(index, per**syllables * len(ends), key, f"{tweak}|{group}|composed"), len(ends))
    head = ""
    for _ in range(syllables):
        value, k = divmod(value, per)
        head += consonants[k // len(vowels)] + vowels[k % len(vowels)]
    return (head + ends[end]).capitalize()


def _other_label(label: str, key: bytes) -> str:
    """A domain's label as another one, the same in all addresses."""
    new, k = permute_text(label, key, "email|domain"), 0
    while new.lower() == label.lower() and any(map(str.isalnum, label)):
        k += 1
        new = permute_text(label, key, f"email|domain|{k}")
    return new


def surrogate(kind: str, text: str, key: bytes, tweak: int = 0, widen_from: int = SurrogateRules.max_tweaks) -> str:
    """The replacement of one mention; `tweak` counts redraws of its entity, those from `widen_from` on add characters."""
    t, extra = f"{kind}|{tweak}", max(0, tweak - widen_from + 1)
    if kind == "email":
        local, _, domain = text.rpartition("@")
        *labels, top = domain.split(".")
        return permute_text(local + "a" * extra, key, t) + "@" + ".".join([*(_other_label(x, key) for x in labels), top])
    if kind == "phone":
        d = _ascii_digits(text)
        local, rest = d[-7:] + "0" * extra, d[:-7]
        area, country = (rest[-3:], rest[:-3]) if len(d) >= 10 else ("", rest)
        return _digits_into(text, country + permute_text(area, key, "phone|area") + permute_text(local, key, f"{t}|local"))
    if kind == "card":
        d = _ascii_digits(text)
        if luhn(d[:-1]) == int(d[-1]):
            head = permute_text(d[:-1] + "0" * extra, key, t)
            return _digits_into(text, head + str(luhn(head)))
        return _digits_into(text, permute_text(d + "0" * extra, key, f"{t}|plain"))
    if kind == "national":
        return _digits_into(text, permute_text(_ascii_digits(text) + "0" * extra, key, t))
    if kind == "iban":
        plain = text.replace(" ", "")
        if plain.isascii() and plain[2:4] == iban_check(plain[:2], plain[4:]):
            account = permute_text(plain[4:] + "0" * extra, key, f"{t}|{plain[:2]}")
            made = plain[:2] + iban_check(plain[:2], account) + account
        else:
            made = plain[:2] + permute_text(plain[2:] + "0" * extra, key, t)
        new = iter(made)
        return "".join(c if c == " " else next(new) for c in text) + "".join(new)
    if kind == "ip":
        a = [int(x) for x in text.split(".")]
        v = permute(a[0] << 24 | a[1] << 16 | a[2] << 8 | a[3], 1 << 32, key, t)
        return ".".join(str(v >> s & 255) for s in (24, 16, 8, 0))
    if kind == "initial":
        letters = letters_like(text.lower() if len(text.lower()) == 1 else text, False) or text + _PLAIN
        # a step of 1 or more along a keyed ring of the letters: never the letter itself
        ring = sorted(letters, key=lambda c: permute(letters.index(c), len(letters), key, t))
        return ring[(ring.index(text.lower() if text.lower() in ring else text) + 1) % len(ring)].upper()
    if kind == "name":
        known = _given().get(text.casefold())
        if known:
            names = GIVEN[known[0]].split()
            # four draws from the list; then composed names, longer by a syllable every eight draws
            new = names[permute(known[1], len(names), key, f"{t}|{known[0]}")] if tweak < 4 else composed_name(known[0], known[1], key, t, 2 + (tweak - 4) // 8)
            return new.upper() if text.isupper() and len(text) > 1 else new
        low = text.lower()
        ends = next((e for e in ENDINGS if low.endswith(tuple(e.split())) and len(low) > 1 + max(map(len, e.split()))), "")
        if not ends:
            return permute_text(text + text[-1:] * extra, key, t, names=True)
        cut = len(text) - len(next(e for e in ends.split() if low.endswith(e)))
        return permute_text(text[:cut] + text[cut - 1 : cut] * extra + text[cut:], key, t, names=True, ends=ends)
    hexed = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) and not text.isdigit()
    return permute_text(text + ("0" if hexed or text[-1:].isdigit() else "a") * extra, key, t, like=(lambda c: _HEX) if hexed else None)


# --- the corpus ----------------------------------------------------------------------------


def find_entities(docs: DataFrame) -> DataFrame:
    """Distinct (kind, entity, form) of the corpus; form is a mention of the entity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, str], str] = {}
            for text in batch.column("text"):
                t = text.as_py()
                if t:
                    for a, b, kind in detect(t):
                        if kind == "initial":
                            continue
                        k = (kind, entity(kind, t[a:b]))
                        form = k[1] if kind == "phone" else t[a:b]
                        seen[k] = min(seen.get(k, form), form)
            yield pa.RecordBatch.from_pydict({"kind": [k for k, _ in seen], "entity": [e for _, e in seen], "form": list(seen.values())}, pa.schema([("kind", pa.string()), ("entity", pa.string()), ("form", pa.string())]))

    found = docs.select("text").mapInArrow(run, "kind string, entity string, form string")
    return found.groupBy("kind", "entity").agg(F.min("form").alias("form"))


def _drawn(entities: DataFrame, rules: SurrogateRules) -> DataFrame:
    key, widen_from = rules.key, rules.max_tweaks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, forms, tweaks = (batch.column(c).to_pylist() for c in ("kind", "form", "tweak"))
            made = [canonical(k, surrogate(k, f, key, t, widen_from)) for k, f, t in zip(kinds, forms, tweaks, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*batch.schema.names, "made"])

    return entities.select("kind", "entity", "form", "tweak").mapInArrow(run, "kind string, entity string, form string, tweak int, made string")


def draw_surrogates(entities: DataFrame, rules: SurrogateRules = SurrogateRules()) -> DataFrame:
    """(kind, entity, tweak, made): the least tweaks at which no surrogate is a real entity or another's surrogate."""
    real = entities.select("kind", F.col("entity").alias("made"), F.lit(True).alias("real"))
    now = scratch.table(_drawn(entities.withColumn("tweak", F.lit(0)), rules), "surrogates")
    while True:  # ends: from max_tweaks on each redraw has more surrogates to choose from
        owner = now.groupBy("kind", "made").agg(F.min(F.struct("tweak", "entity")).alias("first"))
        judged = now.join(owner, ["kind", "made"]).join(real, ["kind", "made"], "left")
        bad = F.col("real").isNotNull() | (F.col("first.entity") != F.col("entity"))
        judged = scratch.table(judged.select("kind", "entity", "form", "tweak", "made", bad.alias("bad")), "surrogates-judged")
        if not judged.where("bad").limit(1).count():
            return now
        again = _drawn(judged.where("bad").withColumn("tweak", F.col("tweak") + 1), rules)
        now = scratch.table(judged.where("not bad").drop("bad").unionByName(again), "surrogates")


def replace_pii(docs: DataFrame, rules: SurrogateRules = SurrogateRules()) -> DataFrame:
    """`docs` with surrogates in `text`, and n_entities and kinds ("email:2,ip:1") beside it."""
    entities = scratch.table(find_entities(docs), "entities")
    redrawn = draw_surrogates(entities, rules).where("tweak > 0").select("kind", "entity", "tweak")
    names = list(docs.columns)
    n_name, kinds_name = (scratch.free_name(c, names) for c in ("n_entities", "kinds"))
    plain, key, widen_from, token = docs, rules.key, rules.max_tweaks, uuid.uuid4().hex
    schema = f"{scratch.ddl(plain.schema)}, {n_name} long, {kinds_name} string"
    few = redrawn.count() <= rules.max_redrawn
    held = docs.sparkSession.sparkContext.broadcast({(r.kind, r.entity): r.tweak for r in redrawn.collect()} if few else None)
    if not few:
        plain = _with_own_tweaks(plain, redrawn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = bs.process_store()
        if kept.get("surrogates-of") != token:
            kept["surrogates-of"], kept["surrogates"] = token, {}
        memo = kept["surrogates"]
        for batch in batches:
            texts, counts, kinds = [], [], []
            own = batch.column("__tweaks").to_pylist() if not few else None
            for i, text in enumerate(batch.column("text")):
                t = text.as_py()
                spans = detect(t) if t else []
                tweaks = held.value if few else {(k, e): int(n) for k, e, n in json.loads(own[i] or "[]")}
                out, at, by = [], 0, {}
                for a, b, kind in spans:
                    mention = t[a:b]
                    tweak = tweaks.get((kind, entity(kind, mention)), 0)
                    if len(memo) > 100_000:
                        memo.clear()
                    if (made := memo.get((kind, mention, tweak))) is None:
                        made = memo[kind, mention, tweak] = surrogate(kind, mention, key, tweak, widen_from)
                    out += [t[at:a], made]
                    at, by[kind] = b, by.get(kind, 0) + 1
                texts.append("".join([*out, t[at:]]) if spans else t)
                counts.append(len(spans))
                kinds.append(",".join(f"{k}:{n}" for k, n in sorted(by.items())))
            cols = {c: batch.column(c) for c in names} | {"text": pa.array(texts, pa.string()), n_name: pa.array(counts, pa.int64()), kinds_name: pa.array(kinds, pa.string())}
            yield pa.RecordBatch.from_pydict(cols)

    return plain.mapInArrow(run, schema)


def _with_own_tweaks(docs: DataFrame, redrawn: DataFrame) -> DataFrame:
    """Each document with its own redrawn entities, as JSON in __tweaks."""

    def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {(row, kind, entity(kind, t[a:b])) for row, t in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True) for a, b, kind in detect(t or "") if kind != "initial"}
            yield pa.RecordBatch.from_pydict({"row": pa.array([r for r, _, _ in rows], pa.string()), "kind": pa.array([k for _, k, _ in rows], pa.string()), "entity": pa.array([e for _, _, e in rows], pa.string())})

    text_key = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    found = docs.select(text_key.alias("row"), "text").mapInArrow(mentions, "row string, kind string, entity string").distinct().join(redrawn, ["kind", "entity"])
    own = found.groupBy("row").agg(F.to_json(F.collect_list(F.array("kind", "entity", F.col("tweak").cast("string")))).alias("__tweaks"))
    return docs.withColumn("__row", text_key).join(own.withColumnRenamed("row", "__row"), "__row", "left").drop("__row")
