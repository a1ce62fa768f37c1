"""Column functions: normalisation, native detectors with positions, sweeps, placeholders.

All are built-in expressions, so they stay in the JVM. Word boundaries are spelled
out as look-arounds over ASCII word characters, as the pattern dialect defines them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomveil.functions import fixed as fx

_B, _E = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
_W1 = "[A-Za-z0-9_]"
_EDGE = f"(?:(?<={_W1})(?!{_W1})|(?<!{_W1})(?={_W1}))"
_MONTHS, _SHORT, _STREETS = "|".join(fx.MONTHS), "|".join(fx.SHORT_MONTHS), "|".join(fx.STREETS)
_DATE = r"[0-9]{1,2}[-/.][0-9]{1,2}[-/.]"


def _from(first: str) -> str:
    """The begin of a word with one of these characters, which is looked at first, as nearly all places fail by it."""
    return f"(?=[{first}]){_B}"


_N, _UP = _from("0-9"), _from("A-Z")
_MONTH_STARTS = "".join(sorted({m[0] for m in fx.MONTHS}))

#: Java patterns by detector; those with several are scanned one by one.
PATTERNS = {
    "bsn": [rf"{_N}(?:[0-9]{{9}}|[0-9]{{4}}[.\s][0-9]{{2}}[.\s][0-9]{{3}}){_E}"],
    "date_numeric": [rf"{_N}{_DATE}[0-9]{{4}}{_E}"],
    "date_short": [rf"{_N}{_DATE}[0-9]{{2}}{_E}"],
    "date_text": [rf"(?i){_N}[0-9]{{1,2}}\s+(?:{_MONTHS}|{_SHORT})\.?\s+[0-9]{{4}}{_E}"],
    "date_month": [rf"(?i){_from(_MONTH_STARTS)}(?:{_MONTHS})\s+[0-9]{{4}}{_E}"],
    "date_birth": [rf"(?i){_from('g')}(?:geboren\s+op|geb\.?)\s+{_DATE}[0-9]{{4}}{_E}"],
    "iban": [rf"{_UP}[A-Z]{{2}}[0-9]{{2}}\s?[A-Z]{{4}}\s?[0-9]{{4}}\s?[0-9]{{4}}\s?[0-9]{{2,4}}{_E}"],
    "email": [rf"{_B}[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-z]{{2,10}}{_E}"],
    "phone_mobile": [rf"{_from('0')}06(?:[-\s.]?[0-9]{{1,2}}){{5}}{_E}"],
    "phone_landline": [rf"{_from('0')}0[1-9][0-9]{{1,2}}[-\s.][0-9]{{1,3}}[-\s.]?[0-9]{{1,3}}[-\s.]?[0-9]{{1,3}}{_E}"],
    "phone_intl_mobile": [r"(?:\+31|0031)[-\s.]?(?:\(0\)|0)?[-\s.]?6(?:[-\s.]?[0-9]{2}){4}"],
    "phone_intl": [rf"(?:\+31|0031)[-\s.]?(?:\(0\)|0)?[-\s.]?[1-9][0-9]{{1,2}}[-\s.]?[0-9]{{6,7}}{_E}"],
    "phone_prefixed": [rf"(?i){_from('t')}(?:tel:|telefoon:)\s*[-\s0-9()]+"],
    "postcode": [rf"{_N}[0-9]{{4}}\s?[A-Z]{{2}}{_E}"],
    "address": [rf"{_UP}[A-Z][a-zéèêëïöüà]+(?:\s[a-z]+)*(?:{_STREETS})\s+[0-9]{{1,5}}\s?[a-zA-Z]?(?:\s?(?:bis|hs))?{_E}"],
}
KIND_OF = {k: k.split("_")[0] for k in PATTERNS}
#: What every match of a detector holds, found much faster than the match: texts without it aren't searched.
NEEDS = {"email": "@", **dict.fromkeys(("date_numeric", "date_text", "date_month", "date_birth", "iban"), "[0-9]{4}"), "date_short": "[0-9][-/.][0-9]"}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is computed once for a row however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Stands on both sides of a match while it is looked for; in a text it counts as the character after it, which no pattern tells apart.
_MARK, _PLAIN = "\ue000", "\ue001"


def spans(text: Column, pattern: str, needs: str | None = None) -> Column:
    """All matches as array<struct<start, end, original>>: one search marks them, and the lengths of what the marks part give their positions.

    `needs` is a pattern that every match holds. No match may hold a private-use character.
    """
    kind = "array<struct<start:int,end:int,original:string>>"
    none = F.array().cast(kind)
    marked = F.regexp_replace(F.replace(text, F.lit(_MARK), F.lit(_PLAIN)), pattern, f"{_MARK}$0{_MARK}")
    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:  # gaps and matches come in turn
        end = acc["at"] + F.length(x)
        hit = F.struct(acc["at"].alias("start"), end.alias("end"), x.alias("original"))
        return F.struct(end.alias("at"), (~acc["hit"]).alias("hit"), F.when(acc["hit"], F.array_append(acc["out"], hit)).otherwise(acc["out"]).alias("out"))

    # a text without a mark is one gap; a null text stays null
    found = let(F.split(marked, _MARK, -1), lambda parts: F.when(F.size(parts) == 1, none).otherwise(F.aggregate(parts, zero, step, lambda acc: acc["out"])))
    return F.when(~text.rlike(needs), none).otherwise(found) if needs else found


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def valid_bsn(x: Column) -> Column:
    """The eleven test on a column of digits."""
    total = sum((F.substring(x, i + 1, 1).cast("int") * w for i, w in enumerate((9, 8, 7, 6, 5, 4, 3, 2, -1))), F.lit(0))
    return (F.length(x) == 9) & (x != "000000000") & (total > 0) & (total % 11 == 0)


def bsn_context(text: Column, start: Column) -> Column:
    """Whether a citizen number's word stands from 40 before to 20 after a start (0-based)."""
    begin = F.greatest(start - 40, F.lit(0))
    around = F.lower(F.substring(text, begin + 1, start + 20 - begin))
    return around.rlike(rf"{_B}bsn{_E}|burgerservicenummer")


def plausible_date(x: Column) -> Column:
    """Day 1-31 and month 1-12 of the first numeric date in it; dates in words pass."""
    part = lambda k: F.regexp_extract(x, r"([0-9]{1,2})[-/.]([0-9]{1,2})[-/.][0-9]{2,4}", k)
    return (part(1) == "") | (F.expr("true") & part(1).try_cast("int").between(1, 31) & part(2).try_cast("int").between(1, 12))


def accepted(name: str, text: Column) -> Callable[[Column], Column]:
    """The check that follows a detector's pattern."""
    kind = KIND_OF[name]
    if kind == "bsn":
        return lambda m: valid_bsn(digits(m["original"])) | bsn_context(text, m["start"])
    if kind == "date":
        return lambda m: plausible_date(m["original"])
    if kind == "phone":
        return lambda m: F.length(digits(m["original"])) >= 9
    if kind == "postcode":
        return lambda m: F.substring(m["original"], 1, 4).cast("int") >= 1000
    return lambda m: F.lit(True)


def detected(text: Column, name: str) -> Column:
    """Accepted matches of one detector as array<struct<start, end, original>>."""
    seen = text
    if KIND_OF[name] == "phone":
        for dash in "–—−":  # by bytes, where translate() looks up each character
            seen = F.replace(seen, F.lit(dash), F.lit("-"))
    found = [F.filter(spans(seen, p, NEEDS.get(name)), accepted(name, seen)) for p in PATTERNS[name]]
    return F.concat(*found) if len(found) > 1 else found[0]


def resolved(found: Column) -> Column:
    """Disjoint spans of array<struct<start, end, ...>>: earliest start, then longest, then first in the array."""
    order = F.array_sort(found, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    free = lambda acc, x: (F.size(acc) == 0) | (x["start"] >= F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0)))
    return let(order, lambda o: F.aggregate(o, F.slice(o, 1, 0), lambda acc, x: F.when(free(acc, x), F.array_append(acc, x)).otherwise(acc)))


def placeholder(kind: Column, number: Column) -> Column:
    return F.format_string("[%s-%03d]", F.upper(kind), number)


def spliced(text: Column, matches: Column) -> Column:
    """Text with each match of array<struct<start, end, placeholder>> (sorted, disjoint) replaced."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    body = F.aggregate(matches, zero, lambda acc, m: F.struct(m["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, m["start"] - acc["at"]), m["placeholder"]).alias("out")))
    return let(body, lambda b: F.concat(b["out"], F.substring(text, b["at"] + 1, F.length(text))))


def case_boundaries(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<=[{fx.LOW}0-9])(?=[A-ZÀ-Ý])", " ")


def cleaned(text: Column) -> Column:
    """OCR clean-up: invisible characters, words broken at line ends, runs of blanks."""
    x = F.translate(text, fx.INVISIBLE, "")
    x = F.regexp_replace(x, rf"(?<=[{fx.LOW}])-[ \t]*\n[ \t]*(?=[{fx.LOW}])", "")
    return F.regexp_replace(x, r"[ \t\u00a0]+", " ")


def normalize_text(text: Column) -> Column:
    """Extracted text: line ends, at most one blank line and one blank, lines and text trimmed."""
    x = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\n{3,}", "\n\n")
    x = F.regexp_replace(x, " {2,}", " ")
    lines = F.transform(F.split(x, "\n"), trimmed)
    return trimmed(F.array_join(lines, "\n"))


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, rf"^[{fx.WS}]+|[{fx.WS}]+$", "")


def sanitize_error(x: Column) -> Column:
    """Error text without what could be personal."""
    for pattern, new in (
        (rf"{_B}[0-9]{{9}}{_E}", "[GETAL]"),
        (rf"{_B}[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{4,30}}{_E}", "[IBAN]"),
        (rf"(?i){_B}[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-z]{{2,10}}{_E}", "[EMAIL]"),
        (rf"{_B}0[0-9][0-9\s.-]{{8,}}{_EDGE}", "[TELEFOON]"),
        (rf"{_B}[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+{_E}", "[NAAM]"),
    ):
        x = F.regexp_replace(x, pattern, new)
    return x


def title_of(x: Column) -> Column:
    """A conversation's title: blanks collapsed, at most 50 characters."""
    t = F.trim(F.regexp_replace(x, rf"[{fx.WS}]+", " "))
    return F.when(F.length(t) > 50, F.concat(F.substring(t, 1, 47), F.lit("..."))).otherwise(t)


def excerpt(x: Column, most: int = 200) -> Column:
    """The first `most` characters, and dots where there are more."""
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("..."))).otherwise(x)


def day_label(when: Column, today: Column) -> Column:
    """A day as people say it: today, yesterday, days ago within a week, else the date."""
    days = F.datediff(today.cast("date"), when.cast("date"))
    near = F.when(days == 0, "Vandaag").when(days == 1, "Gisteren").when(days < 7, F.concat(days.cast("string"), F.lit(" dagen geleden")))
    return F.when(days < 7, near).otherwise(F.date_format(when, "dd-MM-yyyy"))


def common(x: Column) -> Column:
    """Whether a word is too common for a name, in any letter case."""
    return F.lower(x).isin(*fx.COMMON_WORDS)


def likely_surname(x: Column) -> Column:
    low = F.lower(x)
    ends, starts = "|".join(fx.SURNAME_ENDINGS), "|".join(fx.SURNAME_STARTS)
    return (F.length(x) >= 3) & ~common(x) & (low.rlike(f"(?:{ends})$") | ((F.length(x) > 5) & low.rlike(f"^(?:{starts})")))


def known_first(word: Column, names: tuple[str, ...]) -> Column:
    """Whether a word is a listed given name, or all its parts between hyphens are."""
    return word.isin(*names) | (word.contains("-") & F.forall(F.split(word, "-"), lambda p: p.isin(*names)))


def known_last(word: Column, names: tuple[str, ...]) -> Column:
    return word.isin(*names) | likely_surname(word)
