"""Registered queries over the test tables, and their SQL.

`notes` are synthetic Dutch notes made from the customer table by one SQL expression
that both engines run, so that every detector has something to find.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomveil.functions import columns as c
from loomveil.functions import fixed as fx
from loomveil.functions.redaction import FilterConfig
from loomveil.operators import chat, pii, search
from loomveil.operators.layout import dealt, positioned, shared_folder, spread
from loomveil.plans import planted
from loomveil.sources import store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_CK = "c_custkey"
_PAD = lambda x, n: f"lpad(cast({x} as string), {n}, '0')"
NOTES = f"""select {_CK} as doc_id,
  'Klant ' || c_name || ' heeft BSN ' || {_PAD(f"({_CK} * 7919 + 12345) % 1000000000", 9)} || ' en ' || {_PAD(f"({_CK} * 104729 + 99) % 1000000000", 9)}
  || '. Tel 06-' || {_PAD(f"({_CK} * 31337) % 100000000", 8)} || ' of 020 ' || {_PAD(f"({_CK} * 77) % 10000000", 7)}
  || '. Mail k.bakker' || cast({_CK} as string) || '@testmail.example of x@Y.NL. IBAN NL' || {_PAD(f"{_CK} % 100", 2)} || ' ABNA 0417 ' || {_PAD(f"({_CK} * 13) % 10000", 4)} || ' 30.'
  || chr(10) || 'Woont Parklaan ' || cast(1 + {_CK} % 300 as string) || ', ' || {_PAD(f"({_CK} * 37) % 10000", 4)} || ' AB. Geboren op '
  || {_PAD(f"1 + {_CK} % 35", 2)} || '-' || {_PAD(f"1 + {_CK} % 14", 2)} || '-' || cast(1940 + {_CK} % 60 as string) || ', gezien 15 maart 2023 en in april 2024, ook ' || cast(1 + {_CK} % 28 as string) || '/2/99.'
  as text from customer"""


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _notes(customer: DataFrame) -> DataFrame:
    return customer.sparkSession.sql(NOTES.replace(" from customer", " from {customer}"), customer=dealt(customer.select(_CK, "c_name")))


def _each(rows: DataFrame) -> DataFrame:
    """Rows of explode_outer() that have an element: plain explode() brings a filter on the array along, which computes it again."""
    return rows.where("m is not null")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents")


# --- detectors -----------------------------------------------------------------------------

_RE2 = {
    "bsn": r"\b[0-9]{9}\b",
    "date_numeric": r"\b[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}\b",
    "date_short": r"\b[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2}\b",
    "date_text": rf"(?i)\b[0-9]{{1,2}}\s+(?:{'|'.join(fx.MONTHS)}|{'|'.join(fx.SHORT_MONTHS)})\.?\s+[0-9]{{4}}\b",
    "date_month": rf"(?i)\b(?:{'|'.join(fx.MONTHS)})\s+[0-9]{{4}}\b",
    "date_birth": r"(?i)\b(?:geboren\s+op|geb\.?)\s+[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}\s?[A-Z]{4}\s?[0-9]{4}\s?[0-9]{4}\s?[0-9]{2,4}\b",
    "email": r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-z]{2,10}\b",
    "phone_mobile": r"\b06(?:[-\s.]?[0-9]{1,2}){5}\b",
    "phone_landline": r"\b0[1-9][0-9]{1,2}[-\s.][0-9]{1,3}[-\s.]?[0-9]{1,3}[-\s.]?[0-9]{1,3}\b",
    "postcode": r"\b[0-9]{4}\s?[A-Z]{2}\b",
    "address": rf"\b[A-Z][a-zéèêëïöüà]+(?:\s[a-z]+)*(?:{'|'.join(fx.STREETS)})\s+[0-9]{{1,5}}\s?[a-zA-Z]?(?:\s?(?:bis|hs))?\b",
}
_PLAUSIBLE = r"""(regexp_extract(original, '([0-9]{1,2})[-/.]([0-9]{1,2})[-/.][0-9]{2,4}', 1) = '' or
    (try_cast(regexp_extract(original, '([0-9]{1,2})[-/.]([0-9]{1,2})[-/.][0-9]{2,4}', 1) as int) between 1 and 31 and
     try_cast(regexp_extract(original, '([0-9]{1,2})[-/.]([0-9]{1,2})[-/.][0-9]{2,4}', 2) as int) between 1 and 12))"""
_ELEVEN = " + ".join(f"substr(d, {i + 1}, 1)::int * {w}" for i, w in enumerate((9, 8, 7, 6, 5, 4, 3, 2, -1)))
_CHECK = {"date": _PLAUSIBLE, "phone": "length(regexp_replace(original, '[^0-9]', '', 'g')) >= 9", "postcode": "substr(original, 1, 4)::int >= 1000"}


def _positions(source: str, pattern: str) -> str:
    """SQL with doc_id, text, start_offset and original of all matches."""
    return rf"""found as (select doc_id, text, regexp_extract_all(text, '{pattern}') as m, string_split_regex(text, '{pattern}') as g from {source}),
      flat as (select doc_id, text, unnest(m) as original, generate_subscripts(m, 1) as i, m, g from found),
      hits as (select doc_id, text, original, list_sum(list_transform(g[1:i], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::bigint as start_offset from flat)"""


def _detect(name: str, source: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        d = _notes(read(spark, sf, "customer")) if source == "notes" else docs(spark, sf)
        found = _each(d.select("doc_id", F.explode_outer(c.detected(F.col("text"), name)).alias("m")))
        return found.select("doc_id", F.col("m.start").cast("long").alias("start_offset"), F.col("m.original").alias("original"))

    run.__name__ = f"detect_{name}"
    QUERIES[run.__name__] = run
    check = _CHECK.get(c.KIND_OF[name], "true")
    if c.KIND_OF[name] == "bsn":
        d = "regexp_replace(original, '[^0-9]', '', 'g')"
        context = r"regexp_matches(lower(substr(text, greatest(start_offset - 40, 0) + 1, start_offset + 20 - greatest(start_offset - 40, 0))), '\bbsn\b|burgerservicenummer')"
        check = f"({context} or (({_ELEVEN.replace('d,', d + ',')}) > 0 and ({_ELEVEN.replace('d,', d + ',')}) % 11 = 0))"
    SQL[run.__name__] = f"with notes as ({NOTES}), {_positions(source, _RE2[name])} select doc_id, start_offset, original from hits where {check}"


for _n in _RE2:
    _detect(_n, "documents" if _n in ("email", "date_short") else "notes")


@query(f"""with notes as ({NOTES}), d9 as (select doc_id, {_PAD("(doc_id * 7919 + 12345) % 1000000000", 9)} as d from notes)
  select doc_id, d as digits, (d <> '000000000' and ({_ELEVEN}) > 0 and ({_ELEVEN}) % 11 = 0) as valid from d9""")
def bsn_elfproef(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.lpad(((F.col("c_custkey") * 7919 + 12345) % 1000000000).cast("string"), 9, "0").alias("digits"))
    return d.withColumn("valid", c.valid_bsn(F.col("digits")))


@query(rf"""with notes as ({NOTES}), {_positions("notes", _RE2["bsn"])} select doc_id, start_offset,
  regexp_matches(lower(substr(text, greatest(start_offset - 40, 0) + 1, start_offset + 20 - greatest(start_offset - 40, 0))), '\bbsn\b|burgerservicenummer') as in_context from hits""")
def bsn_context_window(spark: SparkSession, sf: str) -> DataFrame:
    m = _each(_notes(read(spark, sf, "customer")).select("doc_id", "text", F.explode_outer(c.spans(F.col("text"), c.PATTERNS["bsn"][0])).alias("m")))
    return m.select("doc_id", F.col("m.start").cast("long").alias("start_offset"), c.bsn_context(F.col("text"), F.col("m.start")).alias("in_context"))


@query(f"with {_positions('documents', _RE2['date_short'])} select doc_id, original, {_PLAUSIBLE} as plausible from hits")
def date_plausibility(spark: SparkSession, sf: str) -> DataFrame:
    m = _each(docs(spark, sf).select("doc_id", F.explode_outer(c.spans(F.col("text"), c.PATTERNS["date_short"][0])).alias("m")))
    return m.select("doc_id", F.col("m.original").alias("original"), c.plausible_date(F.col("m.original")).alias("plausible"))


PHONES = f"""select {_CK} as doc_id, 'Bel +31 6 ' || {_PAD(f"({_CK} * 31337) % 100000000", 8)} || ' of 0031(0)6-' || {_PAD(f"({_CK} * 77) % 100000000", 8)} || ', kantoor +31 20 ' || {_PAD(f"({_CK} * 91) % 10000000", 7)}
  || ', 0031-70-' || {_PAD(f"({_CK} * 17) % 10000000", 7)} || '. Tel: 020 ' || {_PAD(f"({_CK} * 13) % 10000000", 7)} || ' en TELEFOON: (030) ' || {_PAD(f"({_CK} * 7) % 1000000", 6)} as text from customer"""
_RE2_PHONES = {
    "phone_intl_mobile": r"(?:\+31|0031)[-\s.]?(?:\(0\)|0)?[-\s.]?6(?:[-\s.]?[0-9]{2}){4}",
    "phone_intl": r"(?:\+31|0031)[-\s.]?(?:\(0\)|0)?[-\s.]?[1-9][0-9]{1,2}[-\s.]?[0-9]{6,7}\b",
    "phone_prefixed": r"(?i)\b(?:tel:|telefoon:)\s*[-\s0-9()]+",
}


def _detect_phone(name: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        d = spark.sql(PHONES.replace(" from customer", " from {customer}"), customer=dealt(read(spark, sf, "customer").select(_CK)))
        found = _each(d.select("doc_id", F.explode_outer(c.detected(F.col("text"), name)).alias("m")))
        return found.select("doc_id", F.col("m.start").cast("long").alias("start_offset"), F.col("m.original").alias("original"))

    QUERIES[f"detect_{name}"] = run
    SQL[f"detect_{name}"] = f"with notes as ({PHONES}), {_positions('notes', _RE2_PHONES[name])} select doc_id, start_offset, original from hits where {_CHECK['phone']}"


for _n in _RE2_PHONES:
    _detect_phone(_n)


# --- notes with personal data at known places ----------------------------------------------


def _planted(spark: SparkSession, sf: str, config: FilterConfig = planted.CONFIG) -> DataFrame:
    return pii.filter_documents(planted.notes(spread(read(spark, sf, "customer"))), config)


@query(f"with {planted.SQL} select * from hit")
def filter_planted(spark: SparkSession, sf: str) -> DataFrame:
    """All matches of all types with their numbers, names among them."""
    return pii.exploded(_planted(spark, sf))


@query(f"with {planted.SQL} select doc_id, string_agg(case when type is null then piece else '[' || upper(type) || '-' || lpad(number::varchar, 3, '0') || ']' end, '' order by i) as filtered_text from piece group by doc_id")
def redact_planted(spark: SparkSession, sf: str) -> DataFrame:
    return _planted(spark, sf).select("doc_id", "filtered_text")


@query(f"with {planted.SQL} select doc_id, string_agg(case when type is null then piece else repeat('█', length(piece)) end, '' order by i) as filtered_text from piece group by doc_id")
def redact_planted_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return _planted(spark, sf, planted.CONFIG.updated(placeholder_style="redacted")).select("doc_id", "filtered_text")


@query(f"with {planted.SQL} select doc_id, text as restored_text, upper(text) as by_text from planted where doc_id % {len(planted.FORMS)} not in (0, 1, 3, 4, 5)"
       f" union all select doc_id, text, null from planted where doc_id % {len(planted.FORMS)} in (0, 1, 3, 4, 5)")
def restore_planted(spark: SparkSession, sf: str) -> DataFrame:
    """Texts from the redacted ones and their matches alone; by first occurrences too where no placeholder repeats (in capitals, to tell the two apart)."""
    filtered = _planted(spark, sf).select("doc_id", "filtered_text", "matches")
    exact = pii.restore_documents(filtered)
    loose = pii.restore_documents(filtered, by_text=True).select(F.col("doc_id").alias("d"), F.col("restored_text").alias("loose"))
    again = F.size(F.array_distinct(F.transform("matches", lambda m: m["placeholder"]))) < F.size("matches")
    return exact.join(loose, F.col("doc_id") == F.col("d")).select("doc_id", "restored_text", F.when(~again, F.upper("loose")).alias("by_text"))


@query(f"with {planted.SQL}, n as (select p.doc_id, " + ", ".join(f"count(*) filter (where type = '{t}') as {t}" for t in fx.TYPES) + ", count(type) as total from planted p left join hit h on h.doc_id = p.doc_id group by p.doc_id) select * from n")
def stats_planted(spark: SparkSession, sf: str) -> DataFrame:
    return pii.stats(_planted(spark, sf))


@query(f"with {planted.SQL} select original, count(*) as n, count(distinct doc_id) as documents from hit where type = 'name' group by original")
def names_planted(spark: SparkSession, sf: str) -> DataFrame:
    m = pii.exploded(_planted(spark, sf, planted.CONFIG.updated(enabled_types=("name",))))
    return m.groupBy("original").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


@query(f"with {planted.SQL}, words as (select distinct original from hit where type = 'name' and regexp_full_match(original, '[A-Za-z]+')) select original, row_number() over (order by lower(original)) as position from words")
def names_in_locale_order(spark: SparkSession, sf: str) -> DataFrame:
    """Names of one word as a Dutch list has them, whatever their letter case."""
    names = pii.exploded(_planted(spark, sf)).where("type = 'name' and original rlike '^[A-Za-z]+$'")
    return positioned(pii.names_in_order(names)).select("original", "position")


@query(f"""with {planted.SQL}, found as (select distinct lower(original) as o from hit where type = 'name'), x as (select distinct c_name as name from customer where c_custkey % 10 = 0 union select distinct original from hit where type = 'name' and doc_id % 50 = 0)
  select name, exists (select 1 from found where contains(lower(name), o) or contains(o, lower(name))) as found from x""")
def recall_planted(spark: SparkSession, sf: str) -> DataFrame:
    """Which of some expected names are found: those planted are, customers' numbers aren't."""
    m = pii.exploded(_planted(spark, sf)).where("type = 'name'")
    expected = read(spark, sf, "customer").where("c_custkey % 10 = 0").select(F.col("c_name").alias("name")).union(m.where("doc_id % 50 = 0").select("original")).distinct()
    return pii.missed_names(expected, m)


@query(f"with {planted.SQL} select doc_id, case when i = 1 then 0 else 3 end::bigint as line_no, piece as line from piece where doc_id % {len(planted.FORMS)} = 3 and i in (1, 3)")
def speaker_labels_planted(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of speakers in first lines and after clocks, by built-in expressions."""
    return pii.speaker_lines(planted.notes(read(spark, sf, "customer")), planted.LEXICON)


# --- joins of spans ------------------------------------------------------------------------


def _two_spans(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Notes with blank lines between paragraphs, their numbers of nine digits, and their e-mail addresses."""
    n = _notes(read(spark, sf, "customer")).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    of = lambda p: _each(n.select("doc_id", F.explode_outer(c.spans(F.col("text"), p)).alias("m"))).select("doc_id", F.col("m.start").cast("long").alias("start_offset"), F.col("m.end").cast("long").alias("end_offset"))
    return n, of(c.PATTERNS["bsn"][0]), of(c.PATTERNS["phone_landline"][0])


def _spans_sql(select: str) -> str:
    one = _positions("wide", _RE2["bsn"])
    two = _positions("wide", _RE2["phone_landline"]).replace("found", "found2").replace("flat", "flat2").replace("hits", "hits2")
    return f"with notes as ({NOTES}), wide as (select doc_id, replace(text, chr(10), chr(10) || chr(10)) as text from notes), {one}, {two}, a as (select *, start_offset + length(original) as end_offset from hits), b as (select *, start_offset + length(original) as end_offset from hits2) {select}"


@query(_spans_sql("select doc_id, start_offset from a where exists (select 1 from b where a.doc_id = b.doc_id and (abs(a.start_offset - b.start_offset) < 60 or abs(b.end_offset - a.start_offset) < 60))"))
def spans_near_others(spark: SparkSession, sf: str) -> DataFrame:
    _, a, b = _two_spans(spark, sf)
    return pii.near_spans(a, b, 60).select("doc_id", "start_offset")


@query(_spans_sql("select doc_id, start_offset from b where not exists (select 1 from a where a.doc_id = b.doc_id and b.start_offset < a.end_offset + 40 and b.end_offset > a.start_offset)"))
def spans_uncovered(spark: SparkSession, sf: str) -> DataFrame:
    _, a, b = _two_spans(spark, sf)
    return pii.uncovered_spans(b, a.withColumn("end_offset", F.col("end_offset") + 40)).select("doc_id", "start_offset")


@query(_spans_sql(", cut as (select doc_id, string_split(text, chr(10) || chr(10)) as l from wide), par as (select doc_id, unnest(l) as p, generate_subscripts(l, 1) - 1 as paragraph from cut), placed as (select *, (sum(length(p) + 2) over (partition by doc_id order by paragraph) - length(p) - 2)::bigint as q from par) "
                  "select b.doc_id, b.start_offset, paragraph from b join placed on placed.doc_id = b.doc_id and b.start_offset >= q and b.end_offset <= q + length(p)"))
def spans_in_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    n, _, b = _two_spans(spark, sf)
    return pii.in_paragraphs(b, n).select("doc_id", "start_offset", "paragraph")


_GIVEN, _LAST = sorted(planted.LEXICON.first), sorted(planted.LEXICON.last)
_FIRST_DICT, _LAST_DICT = (", ".join(f"('{w}')" for w in words) for words in (_GIVEN, _LAST))
_NAMED = "case doc_id % 3 when 0 then ' Marelle-Lovano' when 1 then ' Marelle-Xyz Bravaart' else ' Sodika Kelstra' end"
_HYPHENED = f"raw as (select doc_id, unnest(string_split_regex(text || {_NAMED}, '[^\\p{{L}}-]+')) as w from documents), tokens as (select doc_id, w, count(*) as n from raw where w <> '' group by doc_id, w)"


def _hyphened(spark: SparkSession, sf: str) -> DataFrame:
    words = F.split(F.concat("text", F.expr(_NAMED)), r"[^\p{L}-]+")
    return docs(spark, sf).select("doc_id", F.explode(words).alias("w")).where("w <> ''").groupBy("doc_id", "w").agg(F.count("*").alias("n"))


@query(f"with {_HYPHENED}, dict(d) as (values {_FIRST_DICT}) select doc_id, w, n from tokens where w in (select d from dict) or contains(w, '-') and len(list_filter(string_split(w, '-'), lambda p: p not in ({', '.join(chr(39) + x + chr(39) for x in _GIVEN)}))) = 0")
def first_names(spark: SparkSession, sf: str) -> DataFrame:
    return _hyphened(spark, sf).where(c.known_first(F.col("w"), tuple(_GIVEN)))


@query(f"""with {_HYPHENED} select doc_id, w, n from tokens where w in (select * from (values {_LAST_DICT})) or length(w) >= 3 and lower(w) not in (select * from (values {", ".join(f"('{w}')" for w in fx.COMMON_WORDS)}))
  and (regexp_matches(lower(w), '(?:{"|".join(fx.SURNAME_ENDINGS)})$') or (length(w) > 5 and regexp_matches(lower(w), '^(?:{"|".join(fx.SURNAME_STARTS)})')))""")
def last_names(spark: SparkSession, sf: str) -> DataFrame:
    return _hyphened(spark, sf).where(c.known_last(F.col("w"), tuple(_LAST)))


@query(f"with notes as ({NOTES}), {_positions('notes', _RE2['email'])} select doc_id, start_offset, original from hits where lower(original) <> 'k.bakker7@testmail.example'")
def excluded_words(spark: SparkSession, sf: str) -> DataFrame:
    m = pii.exploded(pii.filter_documents(_notes(read(spark, sf, "customer")), FilterConfig(enabled_types=("email",), exclude_words=("K.Bakker7@testmail.example",))))
    return m.select("doc_id", F.col("start_offset").cast("long").alias("start_offset"), "original")


# --- resolution, numbering, redaction ------------------------------------------------------

_EMAIL_HITS = f"with {_positions('documents', _RE2['email'])}, ranked as (select *, row_number() over (partition by doc_id order by start_offset) as number from hits)"
_SPLICE = """, pieces as (select r.*, lag(start_offset + length(original), 1, 0) over (partition by doc_id order by start_offset) as before, count(*) over (partition by doc_id) as n from ranked r),
  joined as (select doc_id, any_value(text) as text, string_agg(substr(text, (before + 1)::bigint, (start_offset - before)::bigint) || {0}, '' order by start_offset) as head,
             max(start_offset + length(original)) as upto from pieces group by doc_id)
  select d.doc_id, coalesce(j.head || substr(j.text, (j.upto + 1)::bigint), d.text) as filtered_text from documents d left join joined j on d.doc_id = j.doc_id"""


@query(_EMAIL_HITS + _SPLICE.format("'[EMAIL-' || case when number < 1000 then lpad(number::varchar, 3, '0') else number::varchar end || ']'"))
def redact_bracket(spark: SparkSession, sf: str) -> DataFrame:
    return pii.native_redaction(docs(spark, sf).select("doc_id", "text"), ["email"]).select("doc_id", "filtered_text")


@query(_EMAIL_HITS + _SPLICE.format("repeat('█', length(original))"))
def redact_block(spark: SparkSession, sf: str) -> DataFrame:
    return pii.native_redaction(docs(spark, sf).select("doc_id", "text"), ["email"], "redacted").select("doc_id", "filtered_text")


@query(_EMAIL_HITS + " select doc_id, start_offset, number, '[EMAIL-' || lpad(number::varchar, 3, '0') || ']' as placeholder from ranked")
def placeholder_numbering(spark: SparkSession, sf: str) -> DataFrame:
    m = pii.native_matches(docs(spark, sf), ["email"])
    n = m.withColumn("number", F.row_number().over(Window.partitionBy("doc_id", "type").orderBy("start_offset")).cast("long"))
    return n.select("doc_id", "start_offset", "number", c.placeholder(F.col("type"), F.col("number")).alias("placeholder"))


@query("""with recursive spans as (select l_orderkey as k, l_linenumber::bigint as i, (l_partkey % 40)::bigint as s, (l_partkey % 40 + 1 + l_suppkey % 15)::bigint as e from lineitem),
  ranked as (select *, row_number() over (partition by k order by s, e desc, i) as n from spans),
  walk as (select k, n, s, e, true as kept, e as upto from ranked where n = 1
           union all select r.k, r.n, r.s, r.e, r.s >= w.upto, case when r.s >= w.upto then r.e else w.upto end from walk w join ranked r on r.k = w.k and r.n = w.n + 1)
  select k as doc_id, s as start_offset, e as end_offset from walk where kept""")
def overlap_resolution(spark: SparkSession, sf: str) -> DataFrame:
    part = F.col("l_partkey") % 40
    one = F.struct(part.cast("int").alias("start"), (part + 1 + F.col("l_suppkey") % 15).cast("int").alias("end"), F.col("l_linenumber").alias("i"))
    grouped = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one), lambda a, b: a["i"] - b["i"]).alias("m"))
    kept = grouped.select(F.col("l_orderkey").alias("doc_id"), F.explode(c.resolved(F.col("m"))).alias("m"))
    return kept.select("doc_id", F.col("m.start").cast("long").alias("start_offset"), F.col("m.end").cast("long").alias("end_offset"))


_STAT_DETECTORS = ("email", "date_numeric", "date_short", "date_text", "date_month", "date_birth", "iban")


def _stat_rows(spark: SparkSession, sf: str, types: tuple[str, ...] | None = None) -> DataFrame:
    """doc_id, lang, source and the resolved matches of each type and in total: of all formats of three types, natively; or of `types`, names among them."""
    d = docs(spark, sf).select("doc_id", "lang", "source", "text")
    if types:
        return pii.stats(pii.filter_documents(spread(d), planted.CONFIG.updated(enabled_types=types)), ["doc_id", "lang", "source"]).select("doc_id", "lang", "source", *types, "total")
    return pii.stats(pii.native_redaction(d, list(_STAT_DETECTORS)), ["doc_id", "lang", "source"]).select("doc_id", "lang", "source", "email", "date", "iban", "total")


def _kept_sql(source: str, names: tuple[str, ...]) -> str:
    """Common tables that end in `kept` (doc_id, type, s, e): accepted matches of all formats, overlaps resolved by walking through them."""
    parts, every = [], []
    for i, name in enumerate(names):
        here = _positions(source, _RE2.get(name) or _RE2_PHONES[name])
        for word in ("found", "flat", "hits"):
            here = here.replace(f"{word} as", f"{word}{i} as").replace(f"from {word}", f"from {word}{i}")
        parts.append(here)
        every.append(f"select doc_id, '{c.KIND_OF[name]}' as type, start_offset as s, start_offset + length(original) as e, {i} as p from hits{i} where {_CHECK.get(c.KIND_OF[name], 'true')}")
    return ", ".join(parts) + f""", every as ({" union all ".join(every)}), ranked as (select *, row_number() over (partition by doc_id order by s, e desc, p) as n from every),
  walk as (select doc_id, n, type, s, e, true as kept, e as upto from ranked where n = 1
           union all select r.doc_id, r.n, r.type, r.s, r.e, r.s >= w.upto, case when r.s >= w.upto then r.e else w.upto end from walk w join ranked r on r.doc_id = w.doc_id and r.n = w.n + 1),
  kept as (select * from walk where kept)"""


_STAT_SQL = f"""with recursive {_kept_sql("documents", _STAT_DETECTORS)}, e as (select d.doc_id, any_value(lang) as lang, any_value(source) as source,
  count(*) filter (where type = 'email') as email, count(*) filter (where type = 'date') as date, count(*) filter (where type = 'iban') as iban from documents d left join kept k on k.doc_id = d.doc_id group by d.doc_id)"""


@query(_STAT_SQL + " select doc_id, email, date, iban, email + date + iban as total from e")
def pii_stats_by_doc(spark: SparkSession, sf: str) -> DataFrame:
    return _stat_rows(spark, sf).select("doc_id", "email", "date", "iban", "total")


@query(_STAT_SQL + " select lang, sum(email)::bigint as email, sum(date)::bigint as date, sum(email + date + iban)::bigint as total from e group by lang")
def pii_stats_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    return _stat_rows(spark, sf).groupBy("lang").agg(F.sum("email").alias("email"), F.sum("date").alias("date"), F.sum("total").alias("total"))


@query(_STAT_SQL + " select lang, source, sum(email + date + iban)::bigint as total from e group by rollup (lang, source)")
def pii_stats_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return _stat_rows(spark, sf).rollup("lang", "source").agg(F.sum("total").alias("total"))


_NOTE_DETECTORS = (*_STAT_DETECTORS, "phone_mobile", "phone_landline", "postcode", "address")


@query(f"""with recursive notes as ({NOTES}), {_kept_sql("notes", _NOTE_DETECTORS)} select d.doc_id, {", ".join(f"count(*) filter (where type = '{t}') as {t}" for t in fx.TYPES)}, count(type) as total
  from notes d left join kept k on k.doc_id = d.doc_id group by d.doc_id""")
def stats_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Notes with seven types in eleven formats, which overlap."""
    return pii.stats(pii.native_redaction(_notes(read(spark, sf, "customer")), list(_NOTE_DETECTORS)))


# All eight types, names among them, which SQL can't find; the three queries above keep the columns of their SQL.


@query()
def pii_stats_all_by_doc(spark: SparkSession, sf: str) -> DataFrame:
    return _stat_rows(spark, sf, fx.TYPES).drop("lang", "source")


@query()
def pii_stats_all_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    return _stat_rows(spark, sf, fx.TYPES).groupBy("lang").agg(*(F.sum(x).alias(x) for x in (*fx.TYPES, "total")))


@query()
def pii_stats_all_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return _stat_rows(spark, sf, fx.TYPES).rollup("lang", "source").agg(F.sum("total").alias("total"))


@query(f"with {_positions('documents', _RE2['email'])} select doc_id, start_offset, original from hits where lower(original) not in (select lower(original) from hits where original like '%mail7%')")
def exclude_words(spark: SparkSession, sf: str) -> DataFrame:
    m = pii.native_matches(docs(spark, sf), ["email"])
    return pii.without_words(m, m.where(F.col("original").contains("mail7")).select("original")).select("doc_id", "start_offset", "original")


@query(f"with notes as ({NOTES}) select doc_id, len(regexp_extract_all(text, '{_RE2['email']}'))::bigint as n from notes")
def enabled_types(spark: SparkSession, sf: str) -> DataFrame:
    return pii.native_counts(_notes(read(spark, sf, "customer")), ["email", "iban", "postcode"], enabled=("email",))


@query(f"with {_positions('documents', _RE2['email'])} select original, count(*) as n from hits group by original")
def distinct_entities(spark: SparkSession, sf: str) -> DataFrame:
    return pii.native_matches(docs(spark, sf), ["email"]).groupBy("original").agg(F.count("*").alias("n"))


# --- dictionaries and ranges ---------------------------------------------------------------

_WORDS = "words as (select doc_id, unnest(string_split_regex(text, '[^\\p{L}]+')) as w from documents), tokens as (select * from words where w <> '')"


def _words(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.explode(F.split("text", r"[^\p{L}]+")).alias("w")).where("w <> ''")


def _values(words: list[str]) -> str:
    return ", ".join(f"('{w}')" for w in words)


@query(f"with {_WORDS}, dict(w) as (values {_values(['Thea', 'Bo', 'Dora', 'Ties', *_GIVEN])}) select doc_id, w, count(*) as n from tokens where w in (select w from dict) group by doc_id, w")
def dictionary_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _words(spark, sf).where(c.known_first(F.col("w"), ("Thea", "Bo", "Dora", "Ties", *_GIVEN))).groupBy("doc_id", "w").agg(F.count("*").alias("n"))


@query(f"""with {_WORDS} select w, count(*) as n from tokens where length(w) >= 3 and lower(w) not in (select * from (values {_values(fx.COMMON_WORDS)}))
  and (regexp_matches(lower(w), '(?:{"|".join(fx.SURNAME_ENDINGS)})$') or (length(w) > 5 and regexp_matches(lower(w), '^(?:{"|".join(fx.SURNAME_STARTS)})'))) group by w""")
def likely_surname(spark: SparkSession, sf: str) -> DataFrame:
    return _words(spark, sf).where(c.likely_surname(F.col("w"))).groupBy("w").agg(F.count("*").alias("n"))


@query(f"with {_WORDS} select doc_id, count(*) as n from tokens where lower(w) not in (select * from (values {_values(fx.COMMON_WORDS)})) group by doc_id")
def common_word_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _words(spark, sf).where(~c.common(F.col("w"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"""with notes as ({NOTES}), {_positions("notes", _RE2["bsn"])}, mail as (select doc_id, instr(text, '@')::bigint - 1 as p from notes)
  select h.doc_id, h.start_offset from hits h where exists (select 1 from mail m where m.doc_id = h.doc_id and (abs(m.p - h.start_offset) < 100 or abs(m.p + 1 - h.start_offset) < 100))""")
def near_name_range_join(spark: SparkSession, sf: str) -> DataFrame:
    n = _notes(read(spark, sf, "customer"))
    hits = _each(n.select("doc_id", F.explode_outer(c.spans(F.col("text"), c.PATTERNS["bsn"][0])).alias("m"))).select("doc_id", F.col("m.start").cast("long").alias("start_offset"))
    at = (F.instr("text", "@") - 1).cast("long")
    return pii.near_spans(hits, n.select("doc_id", at.alias("start_offset"), (at + 1).alias("end_offset")), 100).select("doc_id", "start_offset")


_LINES = "lines as (select doc_id, string_split(text, chr(10)) as l from documents), numbered as (select doc_id, unnest(l) as line, generate_subscripts(l, 1)::bigint - 1 as line_no from lines)"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return pii.lines_of(docs(spark, sf)).select("doc_id", "line_no", "line")


@query(f"with {_LINES}, placed as (select *, sum(length(line) + 1) over (partition by doc_id order by line_no) - length(line) - 1 as p from numbered), {_positions('documents', _RE2['email'])[0:]} select h.doc_id, h.start_offset, p.line_no from hits h join placed p on h.doc_id = p.doc_id and h.start_offset >= p.p and h.start_offset + length(h.original) <= p.p + length(p.line)")
def paragraph_containment(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.native_matches(docs(spark, sf), ["email"])
    return pii.in_paragraphs(found, docs(spark, sf), "\n").select("doc_id", "start_offset", F.col("paragraph").alias("line_no"))


@query(f"with {_LINES} select doc_id, line_no, lag(line) over (partition by doc_id order by line_no) as prev_line from numbered")
def prev_line(spark: SparkSession, sf: str) -> DataFrame:
    return pii.lines_of(docs(spark, sf)).select("doc_id", "line_no", F.col("previous").alias("prev_line"))


@query(f"with {_LINES} select doc_id, line_no, line from numbered where line_no = 0 and len(string_split_regex(trim(line), '\\s+')) between 2 and 5 and regexp_matches(trim(line), '^[A-ZÀ-ÿ]') and not regexp_matches(trim(line), '[.!?;]$')")
def speaker_labels(spark: SparkSession, sf: str) -> DataFrame:
    t = F.trim("line")
    return _lines(spark, sf).where((F.col("line_no") == 0) & F.size(F.split(t, r"\s+")).between(2, 5) & t.rlike("^[A-ZÀ-ÿ]") & ~t.rlike("[.!?;]$"))


@query()
def speaker_labels_all(spark: SparkSession, sf: str) -> DataFrame:
    """The operator's labels: first lines and lines after a clock, with name-like words and a known or likely name; the query above keeps what its SQL says."""
    return pii.speaker_lines(docs(spark, sf), planted.LEXICON)


# --- ingest and chunks ---------------------------------------------------------------------


@query("select sha256(text) as hash, count(*) as n, min(doc_id) as doc_id from documents group by 1")
def doc_hash_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))


@query("""with a as (select doc_id as path, sha256(text) as hash, doc_id as id from documents where doc_id % 3 <> 0),
  b as (select doc_id as path, sha256(case when doc_id % 5 = 0 then text || 'x' else text end) as hash, doc_id + 1000000 as id from documents where doc_id % 4 <> 0)
  select coalesce(b.path, a.path) as path, case when b.path is not null and a.hash is distinct from b.hash then b.hash else a.hash end as hash,
  case when b.path is not null and a.hash is distinct from b.hash then b.id else a.id end as id from a full outer join b on a.path = b.path""")
def upsert_by_hash(spark: SparkSession, sf: str) -> DataFrame:
    from loomveil.sources.files import upsert

    d = docs(spark, sf)
    a = d.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash"), F.col("doc_id").alias("id"))
    b = d.where("doc_id % 4 <> 0").select(F.col("doc_id").alias("path"), F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("hash"), (F.col("doc_id") + 1000000).alias("id"))
    return upsert(a, b)


@query(r"""with t as (select doc_id, replace(text, '. ', chr(13) || chr(10) || chr(10) || chr(10) || '  ') as x from documents),
  u as (select doc_id, regexp_replace(regexp_replace(replace(x, chr(13) || chr(10), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g') as x from t),
  l as (select doc_id, array_to_string(list_transform(string_split(x, chr(10)), lambda v: trim(v, ' ' || chr(9) || chr(13))), chr(10)) as x from u)
  select doc_id, trim(x, ' ' || chr(9) || chr(10) || chr(13)) as text from l""")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", c.normalize_text(F.replace("text", F.lit(". "), F.lit("\r\n\n\n  "))).alias("text"))


def _paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))


# Paragraphs are taken in order; what is held goes out before one that would make it too long, and its end is carried over.
_OVERLAP = r"""case when length({0}) <= 100 then {0} when regexp_matches(right({0}, 200), '[.!?]\s+[A-Z]') then substr(right({0}, 200), length(regexp_extract(right({0}, 200), '^(.*?)[.!?]\s+[A-Z]', 1, 's')) + 3)
  when contains(left(right({0}, 200), 101), ' ') then substr(right({0}, 200), length(regexp_extract(left(right({0}, 200), 101), '^(.*) ', 1, 's')) + 2) else right({0}, 100) end"""
_CHUNKS = f"""recursive cut as (select doc_id, string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\n\n+') as l from documents where text <> ''),
  pieces as (select doc_id, generate_subscripts(l, 1) as i, len(l) as k, unnest(l) as p from cut), texts as (select doc_id, i, k, case when i > 1 then chr(10) || chr(10) else '' end || p as piece from pieces),
  walk as (select doc_id, i, k, piece as held, 0 as start, length(piece) as pos, null::varchar as content, null::int as c_start, null::int as c_end, 0 as done from texts where i = 1
           union all select doc_id, i, k, case when over then tail || piece else held || piece end, case when over then pos - length(tail) else start end, pos + length(piece),
                            case when over then held end, case when over then start end, case when over then start + length(held) end, done + over::int
           from (select w.doc_id, w.k, w.held, w.start, w.pos, w.done, t.piece, t.i, held <> '' and length(held) + length(t.piece) > 1000 as over, {_OVERLAP.format("held")} as tail
                 from walk w join texts t on t.doc_id = w.doc_id and t.i = w.i + 1) x),
  chunks as (select doc_id, done - 1 as chunk_index, content, c_start, c_end from walk where content is not null
             union all select doc_id, done, held, start, start + length(held) from walk where i = k and regexp_matches(held, '[^\\s]')),
  made as (select doc_id as document_id, chunk_index::int as chunk_index, trim(content, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as content, c_start as start_offset, c_end as end_offset,
           doc_id || '-' || lpad(chunk_index::varchar, 6, '0') as chunk_id from chunks)"""


@query(f"with {_CHUNKS} select document_id, chunk_index, content, start_offset, end_offset, chunk_id from made")
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    return search.chunk_documents(_paragraphs(spark, sf))


@query(f"with {_CHUNKS} select document_id, count(*) as chunks, max(end_offset) as last_end from made group by document_id")
def chunk_count_by_doc(spark: SparkSession, sf: str) -> DataFrame:
    return search.chunk_documents(_paragraphs(spark, sf)).groupBy("document_id").agg(F.count("*").alias("chunks"), F.max("end_offset").alias("last_end"))


@query(f"with {_CHUNKS} select document_id, string_agg(content, chr(10) || chr(10) order by chunk_index) as full_text from made group by document_id")
def chunk_join_back(spark: SparkSession, sf: str) -> DataFrame:
    return store.joined_chunks(search.chunk_documents(_paragraphs(spark, sf)))


@query(f"with {_CHUNKS} select chunk_id as id, row_number() over (order by document_id::varchar, chunk_index) as position from made")
def chunks_in_order(spark: SparkSession, sf: str) -> DataFrame:
    d = _paragraphs(spark, sf).select(F.col("doc_id").cast("string").alias("id"), "text")
    return positioned(store.chunks_of(store.chunk_rows(d)).select("id"))


_STORED = "stored as (select doc_id::varchar as id, 'doc ' || doc_id as name, '/in/' || source || '/' || doc_id || '.txt' as path, timestamp '2024-01-01' + to_hours((doc_id * 37 % 500)::int) as updated_at from documents)"


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf)
    rows = d.select(F.col("doc_id").alias("id"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("name"), F.concat(F.lit("/in/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
                    (F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=(F.col("doc_id") * 37 % 500).cast("int"))).alias("updated_at"), "text")
    return store.shaped(rows, "documents", F.lit("2024-01-01").cast("timestamp"))


@query(f"with {_STORED} select id, row_number() over (order by updated_at desc, id) as position from stored")
def documents_newest_first(spark: SparkSession, sf: str) -> DataFrame:
    return positioned(store.newest_first(_stored(spark, sf)).select("id"))


@query(f"with {_STORED} select id, name, path from stored where path = (select path from stored where id = '17')")
def document_by_path(spark: SparkSession, sf: str) -> DataFrame:
    path = store.by_key(_stored(spark, sf), id="17").select("path")
    return _stored(spark, sf).join(path, "path", "left_semi").select("id", "name", "path")


@query("select conv_id::varchar as conversation_id, '[' || string_agg('\"' || turn || '\"', ',' order by turn) || ']' as document_ids, count(*) as n, min(turn)::varchar as first from conversations group by conv_id")
def json_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Arrays as JSON text and back."""
    ids = F.transform(F.sort_array(F.collect_list("turn")), lambda t: t.cast("string"))
    rows = store.to_json_columns(read(spark, sf, "conversations").groupBy(F.col("conv_id").cast("string").alias("conversation_id")).agg(ids.alias("document_ids")))
    back = store.from_json_columns(rows.withColumn("json", F.col("document_ids")))
    return back.select("conversation_id", F.col("json").alias("document_ids"), F.size("document_ids").cast("long").alias("n"), F.element_at("document_ids", 1).alias("first"))


@query("select count(*) as n, count(*) as ids, 36::bigint as chars, count(*) as titled from conversations")
def new_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = store.shaped(read(spark, sf, "conversations").select("conv_id"), "conversations", F.current_timestamp())
    return rows.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.max(F.length("id")).cast("long").alias("chars"), F.count_if(F.col("title") == chat.DEFAULT_TITLE).alias("titled"))


@query("select doc_id, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as content from documents where not contains(text, chr(10)) and trim(text) <> ''")
def chunk_single_paragraph(spark: SparkSession, sf: str) -> DataFrame:
    one = docs(spark, sf).where(~F.contains("text", F.lit("\n")))
    return search.chunk_documents(one).select(F.col("document_id").alias("doc_id"), "content")


@query("select doc_id || '_gefilterd.txt' as name, 'text/plain' as mime_type, strlen(coalesce(text, ''))::bigint as size, sha256(coalesce(text, '')) as hash, coalesce(text, '') as text, null::varchar as error from documents")
def text_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as files of their own names, and read back as documents."""
    from loomveil.sources import files

    path = f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}"
    rows = docs(spark, sf).select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("filtered_text"))
    files.write_texts(rows, path).write.format("noop").mode("overwrite").save()
    return files.read_documents(spark, path).drop("path")


@query("""select 'n' || c_nationkey || '_gefilterd.xlsx' as file, nr as row, k::int as col, ['c_custkey', 'c_name', 'c_mktsegment'][k + 1] as header,
  case k when 0 then c_custkey::varchar when 1 then c_name else coalesce(c_mktsegment, '') end as value
  from (select *, row_number() over (partition by c_nationkey order by c_custkey)::int - 1 as nr from customer), range(3) t(k)""")
def sheet_files(spark: SparkSession, sf: str) -> DataFrame:
    """The customers of each nation as a workbook, written as files and read back as cells."""
    from loomveil.sources import files

    path = f"{shared_folder(spark)}/sheets-{uuid.uuid4().hex}"
    c_ = read(spark, sf, "customer")
    cells = pii.to_cells(c_.select("c_custkey", "c_name", "c_mktsegment"), F.lit("x"), F.col("c_custkey")).drop("sheet")
    cells = cells.join(c_.select(F.col("c_custkey").alias("row"), F.concat(F.lit("/in/n"), F.col("c_nationkey").cast("string"), F.lit(".xlsx")).alias("sheet")), "row")
    books = files.workbooks(cells.withColumn("filtered_text", F.col("value")))
    files.write_files(books.select(F.col("file_name").alias("path"), "file_name", "content"), path).write.format("noop").mode("overwrite").save()
    return files.read_cells(spark, path).select(F.element_at(F.split("sheet", "/"), -1).alias("file"), "row", "col", "header", "value")


_LOADED = "a as (select doc_id, '/in/' || doc_id as path, sha256(text) as hash from documents where doc_id % 3 <> 0), b as (select doc_id, '/in/' || doc_id as path, sha256(case when doc_id % 5 = 0 then text || 'x' else text end) as hash from documents where doc_id % 4 <> 0)"


@query(f"""with {_LOADED}, v2 as (select coalesce(b.path, a.path) as path, coalesce(b.hash, a.hash) as hash, a.hash is not distinct from coalesce(b.hash, a.hash) as kept from a full join b on a.path = b.path)
  select 1 as version, path, hash, true as kept from a union all select 2, path, hash, kept from v2 union all select 3, path, hash, kept from v2 where not ends_with(path, '7')""")
def stored_versions(spark: SparkSession, sf: str) -> DataFrame:
    """A table of documents with chunks and index: loaded, upserted by path and hash, some deleted; read as of each version."""
    d, path = docs(spark, sf), f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    rows = lambda text, which: d.where(which).select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string")).alias("path"), F.sha2(text, 256).alias("hash"), text.alias("text"))
    store.insert_documents(rows(F.col("text"), "doc_id % 3 <> 0"), path)
    store.upsert_documents(rows(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), "doc_id % 4 <> 0"), path)
    store.delete_documents(store.table(spark, path, "documents").where("path like '%7'").select("id"), path)
    first = store.table(spark, path, "documents", 1).select(F.col("id").alias("old"))
    seen = [store.table(spark, path, "documents", v).select(F.lit(v).alias("version"), "path", "hash", "id") for v in (1, 2, 3)]
    every = seen[0].union(seen[1]).union(seen[2]).join(first.withColumn("kept", F.lit(True)), F.col("id") == F.col("old"), "left")
    return every.select("version", "path", "hash", F.coalesce("kept", F.lit(False)).alias("kept"))


# --- full-text search ----------------------------------------------------------------------

_TERMS = r"raw as (select doc_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) as term from documents), terms as (select * from raw where term <> '')"
_TOP = "order by score desc, doc_id limit 10"


def _bm25_sql(where: list[str], scope: str = "true") -> str:
    qs = " union all ".join(f"select {i} as q, doc_id, count(*) as tf from terms where {w} group by doc_id" for i, w in enumerate(where))
    return f"""with {_TERMS}, dls as (select doc_id, count(*) as dl from terms group by doc_id),
      st as (select (select count(*) from documents) as n, (select sum(dl) from dls) / (select count(*) from documents)::double as avgdl),
      hits as ({qs}), df as (select q, count(*) as df from hits group by q),
      parts as (select h.doc_id, case when ln((n - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n - df + 0.5) / (df + 0.5)) end * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) as s
                from hits h join df using (q) join dls using (doc_id), st),
      scored as (select doc_id, sum(s) as score from parts group by doc_id having count(*) = {len(where)})
      select doc_id, round(score, 6) as score from scored where {scope} {_TOP}"""


def _contents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as chunks of their own."""
    return docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("text").alias("content"))


def _matches(spark: SparkSession, sf: str, asked: list[list[search.Phrase]]) -> DataFrame:
    """The best ten for a query, whose terms alone are indexed."""
    return _top(search.match(search.build_index(_contents(spark, sf), False, asked), asked))


def _top(hits: DataFrame) -> DataFrame:
    return search.ranked(hits, 10).select(F.col("document_id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"with {_TERMS} select doc_id, term, count(*) as tf from terms group by doc_id, term")
def tokenize_terms(spark: SparkSession, sf: str) -> DataFrame:
    return search.term_counts(_contents(spark, sf)).select(F.col("document_id").alias("doc_id"), "term", "tf")


@query(f"with {_TERMS}, d as (select doc_id, count(*) as dl from terms group by doc_id) select (select count(*) from documents) as n, (select count(distinct term) from terms) as terms, round((select sum(dl) from d) / (select count(*) from documents)::double, 6) as avgdl")
def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    i = search.build_index(_contents(spark, sf), False)
    return i.chunk_stats.agg(F.count("*").alias("n"), F.round(F.avg("dl"), 6).alias("avgdl")).join(i.postings.agg(F.count_distinct("term").alias("terms")))


@query(_bm25_sql(["term = 'idiot'"]))
def bm25_single(spark: SparkSession, sf: str) -> DataFrame:
    return _matches(spark, sf, [[(("idiot",), False)]])


@query(_bm25_sql(["term = 'the'", "term = 'clown'"]))
def bm25_and(spark: SparkSession, sf: str) -> DataFrame:
    return _matches(spark, sf, search.parse_query("the clown"))


@query(_bm25_sql(["starts_with(term, 'path')"]))
def bm25_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return _matches(spark, sf, search.parse_query("path"))


def _phrase_sql(where: list[tuple[str, str]], matched: str) -> str:
    """bm25 of queries given as (source of positions, condition), where a chunk's set of them has to fulfil `matched`."""
    qs = " union all ".join(f"select {i} as q, doc_id, count(*) as tf from {source} where {w} group by doc_id" for i, (source, w) in enumerate(where))
    return f"""with raw0 as (select doc_id, string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+') as l from documents), raw as (select doc_id, unnest(l) as term, generate_subscripts(l, 1) as p from raw0),
      terms as (select * from raw where term <> ''), pairs as (select *, lead(term) over (partition by doc_id order by p) as next from terms),
      dls as (select doc_id, count(*) as dl from terms group by doc_id), st as (select (select count(*) from documents) as n, (select sum(dl) from dls) / (select count(*) from documents)::double as avgdl),
      hits as ({qs}), df as (select q, count(*) as df from hits group by q),
      parts as (select h.doc_id, h.q, case when ln((n - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n - df + 0.5) / (df + 0.5)) end * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) as s
                from hits h join df using (q) join dls using (doc_id), st),
      scored as (select doc_id, sum(s) as score from parts group by doc_id having {matched})
      select doc_id, round(score, 6) as score from scored {_TOP}"""


@query(_phrase_sql([("pairs", "term = 'on' and next = 'and'")], "true"))
def bm25_phrase(spark: SparkSession, sf: str) -> DataFrame:
    return _matches(spark, sf, search.parse_query('"on and"'))


@query(_phrase_sql([("terms", "term = 'idiot'"), ("terms", "term = 'clown'"), ("terms", "starts_with(term, 'path')")], "bool_or(q = 0) and bool_or(q = 1) or bool_or(q = 2)"))
def bm25_or(spark: SparkSession, sf: str) -> DataFrame:
    return _matches(spark, sf, search.parse_query("idiot clown OR path*"))


def _search(spark: SparkSession, sf: str, **options) -> DataFrame:
    """The operator's search for the one word, documents being chunks of their own."""
    hits = search.search(None, _contents(spark, sf), docs(spark, sf).select("doc_id", "lang", "source"), '"idiot"', stemmed=False, **options)
    return hits.withColumn("score", F.round("score", 6)).withColumnRenamed("document_id", "doc_id")


@query("select doc_id as chunk_id, doc_id as document_id, source as document_name, text as content, score from (" + _bm25_sql(["term = 'idiot'"]) + ") join documents using (doc_id)")
def search_sources(spark: SparkSession, sf: str) -> DataFrame:
    """What an answer names as its sources."""
    return chat.sources_of(_search(spark, sf).withColumn("document_id", F.col("doc_id")), "source")


@query("with best as (" + _bm25_sql(["term = 'idiot'"]) + r"""), cut as (select doc_id, score, regexp_extract_all(text, '[\p{L}\p{N}]+') as w, string_split_regex(text, '[\p{L}\p{N}]+') as g from best join documents using (doc_id)),
  marked as (select *, len(w) as n, list_transform(w, lambda x: lower(x) = 'idiot') as hit from cut), placed as (select *, list_position(hit, true) - 1 as first from marked),
  chosen as (select *, list_filter(range(greatest(0, first - 31), first + 1), lambda i: i = 0 or regexp_matches(g[i + 1], '[.:]')) as begins from placed),
  counted as (select *, list_transform(begins, lambda i: len(list_filter(hit[i + 1:i + 32], lambda h: h))) as held from chosen),
  bounds as (select *, case when n <= 32 then 0 when len(begins) = 0 then greatest(0, least(first, n - 32)) else begins[list_position(held, list_max(held))] end as lo from counted)
  select doc_id, round(score, 6) as score, case when lo > 0 then '...' else '' end || array_to_string(list_transform(range(lo, least(n, lo + 32)), lambda i: case when i > lo or lo = 0 then g[i + 1] else '' end || case when hit[i + 1] then '<mark>' || w[i + 1] || '</mark>' else w[i + 1] end), '')
         || case when least(n, lo + 32) < n then '...' else g[n + 1] end as highlight from bounds""")
def search_highlights(spark: SparkSession, sf: str) -> DataFrame:
    """The best ten for a word, each with its snippet."""
    return _search(spark, sf).select("doc_id", "score", F.col("highlights")[0].alias("highlight"))


@query(_bm25_sql(["term = 'idiot'"], "doc_id % 2 = 0"))
def search_scoped(spark: SparkSession, sf: str) -> DataFrame:
    even = docs(spark, sf).where("doc_id % 2 = 0").select(F.col("doc_id").alias("document_id"))
    return _search(spark, sf, document_ids=even).select("doc_id", "score")


@query("select * from (" + _bm25_sql(["term = 'idiot'"]) + ") where score >= 2.5")
def search_min_score(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, min_score=2.5).select("doc_id", "score")


@query("select doc_id, lang, score from (" + _bm25_sql(["term = 'idiot'"]) + ") join documents using (doc_id)")
def search_join_back(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf).select("doc_id", "lang", "score")


_KEPT = "with kept as (select * from documents where doc_id % 5 <> 0 or doc_id % 10 = 0), raw"


def _stored_index(spark: SparkSession, sf: str, deleted: bool) -> str:
    """A stored index in two inserts; `deleted`: with a fifth of its documents deleted and half of those inserted again."""
    d, path = _contents(spark, sf), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    for part in (0, 1):
        search.insert_chunks(d.where(f"document_id % 2 = {part}"), path, stemmed=False)
    if deleted:
        search.delete_documents(d.where("document_id % 5 = 0"), path)
        search.insert_chunks(d.where("document_id % 10 = 0"), path, stemmed=False)
    return path


def _reported(rows: DataFrame, path: str) -> DataFrame:
    """The few rows of a report, after which its index is deleted."""
    spark, got, schema = rows.sparkSession, rows.collect(), rows.schema
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return spark.createDataFrame(got, schema)


@query(_bm25_sql(["term = 'clown'"]).replace("documents", "kept").replace("with raw", _KEPT))
def search_stored(spark: SparkSession, sf: str) -> DataFrame:
    """A stored index with deletions that are looked up."""
    path = _stored_index(spark, sf, True)
    return _reported(_top(search.bm25(search.open_index(spark, path), [("clown", False)])), path)


@query(_phrase_sql([("terms", "term = 'the'"), ("terms", "starts_with(term, 'clow')")], "count(*) = 2").replace("documents", "kept").replace("with raw0", _KEPT.replace(", raw", ", raw0")))
def search_compacted(spark: SparkSession, sf: str) -> DataFrame:
    """The same index after compaction, asked for a word and a prefix."""
    path = _stored_index(spark, sf, True)
    search.compact_index(spark, path)
    return _reported(_top(search.match(search.open_index(spark, path), search.parse_query("the clow*"))), path)


@query(_phrase_sql([("terms", "term = 'idiot'"), ("terms", "term = 'clown'"), ("terms", "term = 'the'")], "true"))
def search_top_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """The best ten of words parted by OR, from the tiers of postings that can hold them."""
    path = _stored_index(spark, sf, False)
    hits = search.best(search.open_index(spark, path), search.parse_query("idiot OR clown OR the"), 10)
    return _reported(hits.select(F.col("document_id").alias("doc_id"), F.round("score", 6).alias("score")), path)


@query("select string_agg('[Bron ' || i || ': ' || source || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by i) as context from (select *, row_number() over (order by score desc, doc_id) as i from (" + _bm25_sql(["term = 'idiot'"]) + ") join documents using (doc_id))")
def build_context(spark: SparkSession, sf: str) -> DataFrame:
    hits = _search(spark, sf).select("chunk_id", "source", "content", "score")
    return chat.context_text(hits, "source")


_CHUNK_TERMS = f"""{_CHUNKS}, raw as (select chunk_id, document_id, unnest(string_split_regex(lower(translate(content, '{"".join(search._ACCENTS[0])}', '{"".join(search._ACCENTS[1])}')), '[^\\p{{L}}\\p{{N}}]+')) as term from made),
  terms as (select * from raw where term <> ''), dls as (select chunk_id, count(*) as dl from terms group by chunk_id), st as (select count(*) as n, (select sum(dl) from dls) / count(*)::double as avgdl from made),
  hits as (select 0 as q, chunk_id, count(*) as tf from terms where starts_with(term, 'pathet') group by chunk_id union all select 1, chunk_id, count(*) from terms where regexp_matches(term, '^rewh(e|es|s|ed|eds|ing|ings)?$') group by chunk_id),
  df as (select q, count(*) as df from hits group by q),
  scored as (select chunk_id, sum(case when ln((n - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n - df + 0.5) / (df + 0.5)) end * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score from hits join df using (q) join dls using (chunk_id), st group by chunk_id)"""


@query(f"with {_CHUNK_TERMS} select chunk_id, document_id::bigint as document_id, source as name, round(score, 6) as score from scored join made using (chunk_id) join documents on doc_id = document_id order by score desc, chunk_id limit 10")
def search_stemmed(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks with forms of two words, of which one is a prefix: their stems are found, whatever their endings."""
    d = docs(spark, sf).select("doc_id", F.col("source").alias("name"))
    chunks = search.chunk_documents(_paragraphs(spark, sf))
    hits = search.search(None, chunks, d, "rewhed OR pathetic*")
    return hits.select("chunk_id", "document_id", "name", F.round("score", 6).alias("score"))


# --- conversations -------------------------------------------------------------------------


@query("select conv_id, turn, role, text from (select *, row_number() over (partition by conv_id order by turn desc) as k from conversations) where k <= 3")
def history_last_n(spark: SparkSession, sf: str) -> DataFrame:
    return chat.last_messages(read(spark, sf, "conversations"), 3, "conv_id", ("turn",)).select("conv_id", "turn", "role", "text")


@query(r"with t as (select conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) as x from conversations) select conv_id, turn, case when length(x) > 50 then substr(x, 1, 47) || '...' else x end as title from t")
def generate_title(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "conversations").select("conv_id", "turn", c.title_of(F.col("text")).alias("title"))


@query("select conv_id, count(*) as n, string_agg(role || ': ' || text, chr(10) order by turn) as messages from conversations group by conv_id")
def conversation_messages(spark: SparkSession, sf: str) -> DataFrame:
    said = read(spark, sf, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("created_at"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))
    whole = chat.with_messages(said.select(F.col("conversation_id").alias("id")).distinct(), said)
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return whole.select(F.col("id").alias("conv_id"), F.size("messages").cast("long").alias("n"), F.array_join(lines, "\n").alias("messages"))


@query("""with t as (select conv_id::varchar as id, count(*) as n, max(turn) as last from conversations group by conv_id)
  select id, case when conv_id % 3 = 0 then 'T' || id when conv_id % 2 = 0 then 'eigen' else 'Nieuw gesprek' end as title, case when conv_id % 3 = 0 then '["' || id || '"]' else '[]' end as document_ids,
    timestamp '2024-01-01' as created_at, greatest(timestamp '2024-01-01' + to_minutes(last), case when conv_id % 3 = 0 then timestamp '2024-01-01 00:01:00' else timestamp '2024-01-01' end) as updated_at, n as messages
  from (select *, id::bigint as conv_id from t) where conv_id % 5 <> 0""")
def conversation_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations created, some renamed, all with messages, some deleted with theirs."""
    start = F.lit("2024-01-01").cast("timestamp")
    turns = read(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("conversation_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"), (start + F.make_dt_interval(mins=F.col("turn").cast("int"))).alias("created_at"))
    ids = turns.select(F.col("conversation_id").alias("id"), F.col("conversation_id").cast("long").alias("k")).distinct()
    talks = chat.create_conversations(ids.select("id", F.when(F.col("k") % 2 == 0, F.lit("eigen")).alias("title"), F.lit(None).cast("array<string>").alias("document_ids"), start.alias("now")))
    renamed = ids.where("k % 3 = 0").select("id", F.concat(F.lit("T"), "id").alias("title"), F.array("id").alias("document_ids"), (start + F.make_dt_interval(mins=F.lit(1))).alias("now"))
    talks, messages = chat.append_messages(chat.update_conversations(talks, renamed), turns.limit(0), turns)
    talks, messages = chat.delete_conversations(talks, messages, ids.where("k % 5 = 0").select("id"))
    every = chat.with_messages(talks, messages)
    return store.to_json_columns(every.select("id", "title", "document_ids", *(F.col(x).cast("timestamp_ntz").alias(x) for x in ("created_at", "updated_at")), F.size("messages").cast("long").alias("messages")))


@query(r"""with q as (select conv_id, text, row_number() over (partition by conv_id order by turn, text) as k from conversations where role = 'user'),
  x as (select *, trim(regexp_replace(text, '\s+', ' ', 'g')) as t from q)
  select conv_id as conversation_id, 2 * k - 1 as seq, 'user' as role, text as content, least(4, 2 * (k - 1))::int as seen, case when k = 1 then case when length(t) > 50 then left(t, 47) || '...' else t end end as title from x
  union all select conv_id, 2 * k, 'assistant', t || case when t = '' then '' else ' ' end, least(4, 2 * (k - 1))::int, null from x""")
def converse(spark: SparkSession, sf: str) -> DataFrame:
    """All questions of all conversations answered in order by a model that repeats them, with four messages of history."""
    asked = read(spark, sf, "conversations").where("role = 'user'").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("seq"), F.col("text").alias("content"))
    return chat.converse(asked, chat.EchoModel(), 4)


@query(rf"""with notes as ({NOTES}) select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\b[0-9]{{9}}\b', '[GETAL]', 'g'),
  '\b[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{4,30}}\b', '[IBAN]', 'g'), '(?i)\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-z]{{2,10}}\b', '[EMAIL]', 'g'), '\b0[0-9][0-9\s.-]{{8,}}\b', '[TELEFOON]', 'g'),
  '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b', '[NAAM]', 'g') as message from notes""")
def sanitize_errors(spark: SparkSession, sf: str) -> DataFrame:
    return _notes(read(spark, sf, "customer")).select("doc_id", c.sanitize_error(F.col("text")).alias("message"))


@query("select doc_id, case when length(text) > 200 then substr(text, 1, 200) || '...' else text end as excerpt from documents")
def excerpt_200(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", c.excerpt(F.col("text")).alias("excerpt"))


@query("""select o_orderkey, case when d = 0 then 'Vandaag' when d = 1 then 'Gisteren' when d < 7 then d || ' dagen geleden' else strftime(o_orderdate, '%d-%m-%Y') end as label
  from (select o_orderkey, o_orderdate, date_diff('day', o_orderdate::date, date '1998-08-02') as d from orders)""")
def relative_day(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select("o_orderkey", c.day_label(F.col("o_orderdate"), F.lit("1998-08-02")).alias("label"))


@query(r"select page_id, lower(regexp_extract(u, '(\.[^./]+)$', 1)) as ext, regexp_matches(lower(u), '\.(xlsx|xls)$') as sheet, regexp_replace(u, '\.[^.]+$', '') || '_gefilterd.txt' as out_name from (select page_id, string_split(string_split(url, '?')[1], '/')[-1] as u from pages)")
def file_names(spark: SparkSession, sf: str) -> DataFrame:
    from loomveil.sources import files

    u = F.element_at(F.split(F.element_at(F.split("url", r"\?"), 1), "/"), -1)
    p = read(spark, sf, "pages").select("page_id", u.alias("u"))
    return p.select("page_id", files.extension(F.col("u")).alias("ext"), files.is_spreadsheet(F.col("u")).alias("sheet"), files.filtered_name(F.col("u")).alias("out_name"))


# --- tabular data --------------------------------------------------------------------------

_COLS = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
_CELLS = "cells as (" + " union all ".join(f"select 'customer' as sheet, c_custkey as row, {i} as col, '{x}' as header, coalesce({x}::varchar, '') as value from customer" for i, x in enumerate(_COLS)) + ")"


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return pii.to_cells(read(spark, sf, "customer").select(*_COLS), F.lit("customer"), F.col("c_custkey"))


@query(f"with {_CELLS} select sheet, row, col::bigint as col, header, value from cells")
def tabular_long_form(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(spark, sf).withColumn("col", F.col("col").cast("long"))


@query(f"with {_CELLS} select sheet, col::bigint as col, least(greatest(greatest(max(length(value)), max(length(header))) + 2, 10), 50)::bigint as width from cells group by sheet, col")
def cell_widths(spark: SparkSession, sf: str) -> DataFrame:
    return pii.column_widths(_cells(spark, sf)).withColumn("col", F.col("col").cast("long"))


@query(f"""with {planted.SQL}, cells as (select p.doc_id, 'sheet' || p.doc_id % 3 as sheet, string_agg(case when type is null then piece else '[' || upper(type) || '-' || lpad(number::varchar, 3, '0') || ']' end, '' order by i) as filtered_text,
  string_agg('[' || upper(type) || '-' || lpad(number::varchar, 3, '0') || '] [VERWIJDERD] ' || type || ' 0 0', ',' order by i) as safe from piece p group by p.doc_id)
  select sheet, doc_id as row, 1::bigint as col, 'Kolom 2' as header, filtered_text, safe from cells""")
def tabular_planted(spark: SparkSession, sf: str) -> DataFrame:
    """Sheets of planted notes, whose names count as given names in each of their cells; the changed cells, with matches that show nothing."""
    n = planted.notes(spread(read(spark, sf, "customer")))
    cells = pii.to_cells(n.select("doc_id", F.col("text").alias(" ")), F.concat(F.lit("sheet"), (F.col("doc_id") % 3).cast("string")), F.col("doc_id"))
    cells = cells.withColumn("header", F.trim("header"))
    said = F.transform("matches", lambda m: F.concat_ws(" ", m["placeholder"], m["original"], m["type"], m["start_offset"], m["end_offset"]))
    found = pii.changed_cells(pii.filter_cells(cells, planted.CONFIG))
    return found.select("sheet", "row", F.col("col").cast("long").alias("col"), "header", "filtered_text", F.array_join(said, ",").alias("safe"))


@query()
def tabular_filter(spark: SparkSession, sf: str) -> DataFrame:
    cells = pii.to_cells(_notes(read(spark, sf, "customer")).select("doc_id", "text"), F.lit("notes"), F.col("doc_id"))
    return pii.changed_cells(pii.filter_cells(cells, planted.CONFIG)).select("sheet", "row", "col", "header", "filtered_text")


@query(f"with notes as ({NOTES}) select 'notes' as sheet, count(*) as rows, 2::bigint as cols, count(*) as changed, sum(len(regexp_extract_all(text, '{_RE2['email']}')))::bigint as items from notes")
def sheet_totals(spark: SparkSession, sf: str) -> DataFrame:
    cells = pii.to_cells(_notes(read(spark, sf, "customer")).select("doc_id", "text"), F.lit("notes"), F.col("doc_id"))
    return pii.sheet_totals(pii.filter_cells(cells, FilterConfig(enabled_types=("email",))))


@query(_STAT_SQL + " select doc_id, case when email > 0 and date > 0 then 'date:' || date || ',email:' || email when email > 0 then 'email:' || email when date > 0 then 'date:' || date else '' end as badges from e")
def type_badges(spark: SparkSession, sf: str) -> DataFrame:
    rows = pii.badges(pii.stats(pii.native_redaction(docs(spark, sf).select("doc_id", "text"), [d for d in _STAT_DETECTORS if d != "iban"])))
    said = F.transform(F.sort_array(F.map_entries("counts")), lambda x: F.concat(x["key"], F.lit(":"), x["value"].cast("string")))
    return rows.select("doc_id", F.array_join(said, ",").alias("badges"))


@query(f"with {_CELLS} select string_agg(value, chr(10) order by row, col) as text from cells where trim(value) <> ''")
def sheet_text(spark: SparkSession, sf: str) -> DataFrame:
    return pii.sheet_texts(_cells(spark, sf)).select("text")


# --- the exact filter ----------------------------------------------------------------------


@query()
def names_full(spark: SparkSession, sf: str) -> DataFrame:
    m = pii.exploded(pii.filter_documents(spread(docs(spark, sf).select("doc_id", "text")), planted.CONFIG))
    return m.where("type = 'name'").select("doc_id", "original", "placeholder", "start_offset", "end_offset")


@query()
def filter_notes(spark: SparkSession, sf: str) -> DataFrame:
    return pii.stats(pii.filter_documents(_notes(read(spark, sf, "customer")), planted.CONFIG))


@query("select doc_id, text as restored_text from documents")
def restore_offset(spark: SparkSession, sf: str) -> DataFrame:
    return pii.restore_documents(pii.filter_documents(spread(docs(spark, sf).select("doc_id", "text")), planted.CONFIG)).select("doc_id", "restored_text")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
