"""Notes with personal data at known places, made from the customer table, and what a filter has to find in them.

Each note is a list of pieces of text; a piece may be marked as a match of a type with a number. One SQL expression,
which both engines run, makes the pieces of a row, so offsets, placeholders and redacted texts follow from them
without any detector. There is a form of note for each way in which a name is found: after an indicator, in full,
with initials, as a speaker's label, reversed, in capitals, by its parts, in context, with an unknown surname, near
other names, glued to its prefix, broken by a line end or by invisible characters; and one with all other types.

Names are made by rule from syllables; they are the lexicon, too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomveil.functions.names import Lexicon
from loomveil.functions.redaction import FilterConfig

_GIVEN = (("Ma", "Lo", "Ta", "Ve", "So", "Ru", "Ke", "Ni"), ("relle", "vano", "dika", "mone", "lou", "tessa", "bine", "jona"))
_LAST = (("Bra", "Kel", "Ost", "Wie", "Tor", "Zan", "Hul", "Pem"), ("vaart", "moed", "ruit", "zicht", "pel", "tuin", "grond", "klomp"))

LEXICON = Lexicon.of((a + b for a in _GIVEN[0] for b in _GIVEN[1]), (a + b for a in _LAST[0] for b in _LAST[1]))
CONFIG = FilterConfig(lexicon=LEXICON)

_K = "c_custkey"


def _pick(words: tuple[str, ...], index: str) -> str:
    """SQL of the word at an index: words lie in one string, each as wide as the longest."""
    wide = max(map(len, words))
    return f"rtrim(substr('{''.join(w.ljust(wide) for w in words)}', cast(1 + {wide} * (({index}) % {len(words)}) as int), {wide}))"


def _name(parts: tuple[tuple[str, ...], tuple[str, ...]], index: str) -> str:
    """SQL of the name at an index: all 64 come in turn."""
    return f"{_pick(parts[0], index)} || {_pick(parts[1], f'cast(floor(({index}) / 8.0) as bigint)')}"


#: Two given names, two surnames and a prefix for each customer.
_PEOPLE = f"select {_K}, {_name(_GIVEN, _K)} as g, {_name(_GIVEN, f'{_K} * 7 + 3')} as g2, {_name(_LAST, f'{_K} * 5 + 1')} as s, {_name(_LAST, f'{_K} * 11 + 2')} as s2, {_pick(('van der', 'de', 'van den', 'ten'), _K)} as p from "
_G, _G2, _S, _S2, _P = "g", "g2", "s", "s2", "p"
_pad = lambda x, n: f"lpad(cast({x} as string), {n}, '0')"
_NL, _SOFT = "chr(10)", "chr(173)"

#: A piece of text in SQL, and the type and number of the match that it is, if any.
Piece = tuple[str, str | None, int | None]


def _text(s: str) -> Piece:
    return "'" + s + "'", None, None


def _is(kind: str, number: int, sql: str) -> Piece:
    return sql, kind, number


def _person(number: int, sql: str) -> Piece:
    return _is("name", number, sql)


FORMS: tuple[tuple[Piece, ...], ...] = (
    # after an indicator; later by the surname alone
    (_text("Vandaag schreef de heer "), _person(1, f"{_G} || ' ' || {_P} || ' ' || {_S}"), _text(" een brief. Later belde "), _person(1, _S), _text(" terug.")),
    # in full; later by the given name alone
    (_text("Gisteren zag ik "), _person(1, f"{_G} || ' ' || {_S}"), _text(" lopen, en daarna kwam "), _person(1, _G), _text(" binnen.")),
    # with initials
    (_text("Een brief van "), _person(1, f"'A.B. de ' || {_S}"), _text(" kwam aan. Volgens "), _person(2, f"'J. ' || {_S2}"), _text(" klopt dat.")),
    # labels of speakers whose given names are unknown, in the first line and after a clock
    (_person(1, "'Bokke ' || substr(" + _S + ", 1, 3) || 'stra'"), (f"{_NL} || 'goed, we beginnen.' || {_NL} || '04:20' || {_NL}", None, None), _person(2, f"'Wubbo ' || {_S2}"), (f"{_NL} || 'dank je, '", None, None), _person(1, "'Bokke'"), _text(".")),
    # reversed
    (_text("Lijst: ("), _person(1, f"{_S} || ', ' || {_G}"), _text(") is aanwezig. Daarna sprak "), _person(1, _G), _text(".")),
    # in capitals; the same person by the given name in context
    (_text("Bel nu "), _person(1, f"upper({_G} || ' de ' || {_S})"), _text(" terug. Spreek ook met "), _person(1, _G), _text(".")),
    # given names in context
    (_text("Ik ging met "), _person(1, _G), _text(" naar huis. Daar zat ook "), _person(2, _G2), _text(", die niets zei.")),
    # a given name and an unknown surname, where the paragraph has a name
    (_text("Hier woont "), _person(1, f"{_G} || ' ' || {_S}"), _text(" en daar "), _person(2, f"{_G2} || ' Quint'"), _text(" sinds kort.")),
    # a given name near another name
    (_text("Ook "), _person(1, f"{_G} || ' ' || {_S}"), _text(" kwam. Eigenlijk zou "), _person(2, _G2), _text(" eerder vertrekken.")),
    # glued to its prefix: another person, as numbers go
    (_text("Eerst kwam "), _person(1, f"{_G} || ' de ' || {_S}"), _text(" langs, later "), _person(2, f"'De' || lower({_S})"), _text(" nogmaals.")),
    # invisible characters, a word broken at a line end, and a date without a blank behind it
    (_text("Dossier van mevrouw "), _person(1, f"substr({_G}, 1, 2) || {_SOFT} || substr({_G}, 3) || ' de ' || {_S}"), _text(" is klaar. Ook "), _person(2, f"substr({_G2}, 1, 2) || '-' || {_NL} || substr({_G2}, 3) || ' ' || {_S2}"), _text(" kwam op "), _is("date", 1, f"{_pad(f'1 + {_K} % 28', 2)} || '-02-2026'"), _text("Vandaag niet.")),
    # all other types
    (
        _text("Naam: "), _person(1, f"{_G} || ' ' || {_S}"), _text(", mail "), _is("email", 1, f"lower({_G}) || cast({_K} as string) || '@testmail.example'"), _text(", BSN "), _is("bsn", 1, _pad(f"100000000 + {_K}", 9)),
        _text(", tel "), _is("phone", 1, f"'06-' || {_pad(f'({_K} * 31337) % 100000000', 8)}"), _text(", IBAN "), _is("iban", 1, f"'NL' || {_pad(f'{_K} % 100', 2)} || ' ABNA 0417 ' || {_pad(f'({_K} * 13) % 10000', 4)} || ' 30'"),
        _text(". Woont "), _is("address", 1, f"'Parklaan ' || cast(1 + {_K} % 300 as string)"), _text(", "), _is("postcode", 1, f"cast(1000 + {_K} % 8999 as string) || ' AB'"),
        _text(". Gezien "), _is("date", 1, "'15 maart 2023'"), _text(" en "), _is("date", 2, f"{_pad(f'1 + {_K} % 28', 2)} || '/2/' || {_pad(f'{_K} % 100', 2)}"), _text("."),
    ),
)


def _by_form(value: str, make, array: str) -> str:
    """SQL of an array for each form, chosen by the key."""
    return f"case {_K} % {len(FORMS)} " + " ".join(f"when {i} then {array}({', '.join(map(make, form))})" for i, form in enumerate(FORMS)) + f" end as {value}"


def _literal(x: str | int | None, kind: str) -> str:
    return f"cast(null as {kind})" if x is None else f"'{x}'" if isinstance(x, str) else f"cast({x} as {kind})"


def notes(customer: DataFrame) -> DataFrame:
    """doc_id and text."""
    pieces = _by_form("pieces", lambda p: p[0], "array")
    made = customer.sparkSession.sql(f"select {_K} as doc_id, {pieces} from ({_PEOPLE} {{customer}})", customer=customer)
    # made once for each row, and not again wherever the text is looked at
    return made.select("doc_id", F.explode(F.array(F.array_join("pieces", ""))).alias("text"))


#: Tables `planted` (doc_id, text, n pieces), `piece` (doc_id, i, piece, type, number, start_offset) and `hit`, the pieces that are matches.
SQL = f"""
  planted0 as (select {_K} as doc_id, {_by_form("pieces", lambda p: p[0], "list_value")}, {_by_form("types", lambda p: _literal(p[1], "string"), "list_value")}, {_by_form("numbers", lambda p: _literal(p[2], "int"), "list_value")} from ({_PEOPLE} customer)),
  planted as (select doc_id, array_to_string(pieces, '') as text from planted0),
  flat as (select doc_id, unnest(pieces) as piece, unnest(types) as type, unnest(numbers) as number, generate_subscripts(pieces, 1) as i from planted0),
  piece as (select *, (sum(length(piece)) over (partition by doc_id order by i) - length(piece))::int as start_offset from flat),
  hit as (select doc_id, (row_number() over (partition by doc_id order by i) - 1)::int as position, '[' || upper(type) || '-' || lpad(number::varchar, 3, '0') || ']' as placeholder, piece as original, type, start_offset, (start_offset + length(piece))::int as end_offset from piece where type is not null)"""
