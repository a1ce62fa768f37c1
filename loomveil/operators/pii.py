"""Redaction over DataFrames: exact per-document filter, exploded matches, statistics, restore, tabular data."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from loomveil.functions import columns as c
from loomveil.functions import fixed as fx
from loomveil.functions import redaction as r
from loomveil.functions.names import LABEL_PARTICLES, Lexicon

MATCHES = "array<struct<placeholder:string,original:string,type:string,start_offset:int,end_offset:int>>"
_PA_MATCHES = pa.list_(pa.struct([("placeholder", pa.string()), ("original", pa.string()), ("type", pa.string()), ("start_offset", pa.int32()), ("end_offset", pa.int32())]))


#: Rows, and about how many bytes, that a worker holds as Python objects at once.
SLICE_ROWS, SLICE_BYTES = 256, 1 << 20


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of few rows and bytes, so that what is made of them doesn't grow with the batch."""
    for batch in batches:
        rows = min(SLICE_ROWS, max(1, SLICE_BYTES * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def filter_documents(docs: DataFrame, config: r.FilterConfig = r.FilterConfig(), text: str = "text", names: str | None = None, sheet: str | None = None, sheets: dict | None = None) -> DataFrame:
    """`docs` with filtered_text and matches.

    names: a column of further given names for each row; or sheet: a column whose value has
    its further given names in `sheets`, which is broadcast. One pass in Arrow batches, no
    shuffle; a null text gives null and no matches. Columns of the caller's named
    filtered_text or matches are replaced.
    """
    lexicon = docs.sparkSession.sparkContext.broadcast((config.lexicon.first, config.lexicon.last, config.lexicon.more, sheets))
    bare = config.updated(lexicon=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, more, by_sheet = lexicon.value
        own, of_sheet = bare.updated(lexicon=Lexicon(first, last, more)), {}
        for batch in _slices(batches):
            further = batch.column(names).to_pylist() if names else None
            at = batch.column(sheet).to_pylist() if sheet else None
            texts, found = [], []
            for i, t in enumerate(batch.column(text).to_pylist()):
                cfg = own
                if at is not None:  # one lexicon for each sheet
                    if at[i] not in of_sheet:
                        of_sheet[at[i]] = own.updated(lexicon=own.lexicon.with_first(by_sheet.get(at[i], ())))
                    cfg = of_sheet[at[i]]
                elif further:
                    cfg = own.updated(custom_names=(*own.custom_names, *(further[i] or ())))
                m = r.find_matches(t, cfg) if t else []
                texts.append(r.spliced(t, m) if m else t)
                found.append([{"placeholder": x.placeholder, "original": x.original, "type": x.type, "start_offset": x.start, "end_offset": x.end} for x in m])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(found, _PA_MATCHES)], [*batch.schema.names, "filtered_text", "matches"])

    held = docs.drop("filtered_text", "matches")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema)
    return held.mapInArrow(run, f"{schema}, filtered_text string, matches {MATCHES}")


def _resolved(text: Column, detectors: list[str], enabled: Iterable[str] = fx.TYPES) -> Column:
    """Disjoint matches; detectors of types that aren't enabled don't run, so what they would find hides nothing."""
    running = [d for d in detectors if c.KIND_OF[d] in enabled]

    def typed(name: str) -> Column:
        return F.transform(c.detected(text, name), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["original"].alias("original"), F.lit(c.KIND_OF[name]).alias("type")))

    if not running:  # a null text stays null
        return F.when(text.isNotNull(), F.array().cast("array<struct<start:int,end:int,original:string,type:string>>"))
    kinds = [typed(d) for d in running]
    if len(kinds) == 1 and len(c.PATTERNS[running[0]]) == 1:  # matches of one pattern are disjoint and in order
        return kinds[0]
    return c.resolved(F.concat(*kinds) if len(kinds) > 1 else kinds[0])


def native_matches(docs: DataFrame, detectors: list[str], text: str = "text", enabled: Iterable[str] = fx.TYPES) -> DataFrame:
    """doc_id, type, start_offset, end_offset, original and number, by built-in expressions only."""
    # plain explode() brings a filter on the array along, which computes it again
    found = docs.select("doc_id", F.explode_outer(_resolved(F.col(text), detectors, enabled)).alias("m")).where("m is not null")
    rows = found.select("doc_id", F.col("m.type").alias("type"), F.col("m.start").cast("long").alias("start_offset"), F.col("m.end").cast("long").alias("end_offset"), F.col("m.original").alias("original"))
    return rows


def native_counts(docs: DataFrame, detectors: list[str], text: str = "text", enabled: Iterable[str] = fx.TYPES) -> DataFrame:
    """doc_id and n, the number of matches of each row, without moving any; a null text gives null."""
    n = F.size(_resolved(F.col(text), detectors, enabled)).cast("long")
    return docs.select("doc_id", F.when(F.col(text).isNotNull(), n).alias("n"))


def native_redaction(docs: DataFrame, detectors: list[str], style: str = "bracket", text: str = "text") -> DataFrame:
    """`docs` with filtered_text and matches, by built-in expressions only; numbers run by type in text order."""
    held = docs.withColumn("__found", _resolved(F.col(text), detectors))
    found = F.col("__found")

    # running counts by type in one fold
    kinds = sorted({c.KIND_OF[d] for d in detectors})
    zero = F.struct(F.array(*(F.lit(0) for _ in kinds)).alias("n"), F.array().cast("array<int>").alias("out"))

    def count(acc: Column, m: Column) -> Column:
        here = [F.when(m["type"] == k, acc["n"][i] + 1).otherwise(acc["n"][i]) for i, k in enumerate(kinds)]
        own = reduce(lambda a, b: F.when(m["type"] == b[0], b[1]).otherwise(a), zip(kinds, here, strict=True), F.lit(0))
        return F.struct(F.array(*here).alias("n"), F.array_append(acc["out"], own).alias("out"))

    def numbered(m: Column, number: Column) -> Column:
        shown = F.repeat(F.lit("█"), F.length(m["original"])) if style == "redacted" else c.placeholder(m["type"], number)
        return F.struct(shown.alias("placeholder"), m["original"].alias("original"), m["type"].alias("type"), m["start"].alias("start"), m["end"].alias("end"))

    # side by side: looked up within the lambda, all numbers would be counted anew for each match
    if len(kinds) == 1:
        made = F.transform(found, lambda m, i: numbered(m, i + 1))
    else:
        made = F.zip_with(found, F.aggregate(found, zero, count, lambda acc: acc["out"]), numbered)
    held = held.withColumn("__numbered", made)
    return held.withColumn("filtered_text", c.spliced(F.col(text), F.col("__numbered"))).withColumn("matches", F.col("__numbered")).drop("__found", "__numbered")


def exploded(filtered: DataFrame, key: str = "doc_id") -> DataFrame:
    return filtered.select(key, F.posexplode("matches").alias("position", "m")).select(key, "position", "m.*")


def stats(filtered: DataFrame, key: str | list[str] = "doc_id") -> DataFrame:
    """Counts of all eight types, and their total, for each key; documents without matches count zero."""
    keys = [key] if isinstance(key, str) else key
    count = lambda t: F.size(F.filter("matches", lambda m: m["type"] == F.lit(t)))
    rows = filtered.select(*keys, *(count(t).cast("long").alias(t) for t in fx.TYPES), F.size("matches").cast("long").alias("total"))
    return rows.groupBy(*keys).agg(*(F.sum(x).alias(x) for x in (*fx.TYPES, "total")))


# --- joins of spans ------------------------------------------------------------------------


def near_spans(spans: DataFrame, others: DataFrame, distance: int = 200) -> DataFrame:
    """`spans` (doc_id, start_offset, ...) that start within `distance` of the start or the end of one of `others` of their document.

    Both sides meet by stretches of `distance` characters, so work grows with what is near and not with a document's spans.
    Within a stretch all are near; of the stretch before only its last point matters, and of the next one its first.
    """
    stretch = lambda x: F.floor(F.col(x) / distance)
    points = others.select(F.col("doc_id").alias("__doc"), F.explode(F.array("start_offset", "end_offset")).alias("__at"))
    ends = points.groupBy("__doc", stretch("__at").alias("__in")).agg(F.min("__at").alias("__first"), F.max("__at").alias("__last"))
    of = lambda step, x: F.struct((F.col("__in") + step).alias("cell"), F.col(x).alias("at"))
    met = ends.select("__doc", F.explode(F.array(of(-1, "__first"), of(0, "__first"), of(1, "__last"))).alias("p")).select("__doc", F.col("p.cell").alias("__cell"), F.col("p.at").alias("__at"))
    near = (F.col("doc_id") == F.col("__doc")) & (F.col("__own") == F.col("__cell")) & (F.abs(F.col("__at") - F.col("start_offset")) < distance)
    return spans.withColumn("__own", stretch("start_offset")).join(_sorted(met), near, "left_semi").drop("__own")


def _sorted(side: DataFrame) -> DataFrame:
    """A side of a join that is not sent to all executors: what packs to a few MB in a shuffle can take a GB as a hash table in each."""
    return side.hint("merge")


#: Characters of a cell: spans meet by the cells that they touch.
CELL = 512


def _cells(start: str, end: str) -> Column:
    """The cells that a span touches; none for a null."""
    return F.sequence(F.floor(F.col(start) / CELL), F.floor(F.greatest(F.col(end) - 1, F.col(start)) / CELL))


def uncovered_spans(spans: DataFrame, others: DataFrame) -> DataFrame:
    """`spans` that overlap none of `others` of their document; equal spans are judged alike.

    Both sides meet by cells of their document, so work grows with what is near and not with a document's spans. Both are
    made once: a span stays if it is free in each cell that it touches, and equal ones are counted by their first cell.
    """
    held = others.select(F.col("doc_id").alias("__doc"), F.col("start_offset").alias("__start"), F.col("end_offset").alias("__end"))
    held = held.withColumn("__cell", F.explode(_cells("__start", "__end")))
    own = spans.withColumn("__at", F.explode_outer(_cells("start_offset", "end_offset")))  # without a start it meets nothing
    overlap = (F.col("doc_id") == F.col("__doc")) & (F.col("__at") == F.col("__cell")) & (F.col("start_offset") < F.col("__end")) & (F.col("end_offset") > F.col("__start"))
    free = own.join(_sorted(held), overlap, "left_anti")
    first, last = F.floor(F.col("start_offset") / CELL), F.floor(F.greatest(F.col("end_offset") - 1, F.col("start_offset")) / CELL)
    counted = free.groupBy(*spans.columns).agg(F.count("*").alias("__free"), F.count_if(F.col("__at").eqNullSafe(first)).alias("__copies"))
    whole = counted.where(F.col("__free") == F.col("__copies") * F.coalesce(last - first + 1, F.lit(1)))
    return whole.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__copies"))).select(*spans.columns)


def paragraphs(docs: DataFrame, between: str = "\n\n") -> DataFrame:
    """doc_id, paragraph (from 0), p_start and p_end of the stretches of each text between blank lines, or between another string."""
    pieces = F.split("text", F.concat(F.lit("\\Q"), F.lit(between), F.lit("\\E")))
    lengths = F.transform(pieces, F.length)
    ends = F.aggregate(lengths, F.array().cast("array<int>"), lambda acc, n: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)) + len(between), F.lit(0)) + n))
    rows = docs.select("doc_id", F.posexplode(F.arrays_zip(ends.alias("e"), lengths.alias("n"))).alias("paragraph", "x"))
    return rows.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), (F.col("x.e") - F.col("x.n")).cast("long").alias("p_start"), F.col("x.e").cast("long").alias("p_end"))


def in_paragraphs(spans: DataFrame, docs: DataFrame, between: str = "\n\n") -> DataFrame:
    """`spans` with the paragraph of their document that holds them whole; those across two are left out.

    A span looks in the cell where it begins, a paragraph is in each cell that it touches: so they meet once.
    """
    held = paragraphs(docs, between).withColumnRenamed("doc_id", "__doc").withColumn("__cell", F.explode(_cells("p_start", "p_end")))
    inside = (F.col("doc_id") == F.col("__doc")) & (F.col("__at") == F.col("__cell")) & (F.col("start_offset") >= F.col("p_start")) & (F.col("end_offset") <= F.col("p_end"))
    return spans.withColumn("__at", F.floor(F.col("start_offset") / CELL)).join(_sorted(held), inside).drop("__doc", "__cell", "__at")


def without_words(matches: DataFrame, words: DataFrame) -> DataFrame:
    """`matches` (original, ...) without those that equal one of `words` (original), in any letter case."""
    return matches.join(words.select(F.lower("original").alias("__word")).distinct(), F.lower("original") == F.col("__word"), "left_anti")


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line and the previous line of all lines; a text's lines stay together, so nothing is shuffled."""
    lines = F.split("text", "\n")
    rows = docs.select("doc_id", lines.alias("l")).select("doc_id", "l", F.posexplode("l").alias("at", "line"))
    return rows.select("doc_id", F.col("at").cast("long").alias("line_no"), "line", F.get("l", F.col("at") - 1).alias("previous"))


def speaker_lines(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, line_no and line of labels: a first line, or one after a clock, of two to five name-like words with a known or likely name.

    The lists are expressions of the plan, so they are meant to be short; the exact filter takes long ones.
    """
    blank = f"[{fx.WS}]+"
    line, words = c.trimmed(F.col("line")), F.split(c.trimmed(F.col("line")), blank)
    after = F.col("previous").isNull() | c.trimmed(F.col("previous")).rlike("^[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?$")
    name_like = lambda w: w.rlike(f"^[{fx.CAP}]") | F.lower(w).isin(*LABEL_PARTICLES.split("|")) | (w == "-")
    known = lambda w: c.known_first(w, tuple(sorted(lexicon.first | lexicon.more))) | c.known_last(w, tuple(sorted(lexicon.last)))
    fits = line.rlike(f"^[{fx.CAP}]") & ~line.rlike(r"[.!?;]\z") & F.size(words).between(2, 5) & F.forall(words, name_like) & F.exists(words, known)
    return lines_of(docs).where(after & fits).select("doc_id", "line_no", "line")


def safe_matches(matches: Column) -> Column:
    """Matches without what they matched."""
    return F.transform(matches, lambda m: F.struct(m["placeholder"].alias("placeholder"), F.lit("[VERWIJDERD]").alias("original"), m["type"].alias("type"), F.lit(0).alias("start_offset"), F.lit(0).alias("end_offset")))


def restore_documents(filtered: DataFrame, by_text: bool = False) -> DataFrame:
    """`filtered` with restored_text: exact, from offsets; by_text: first occurrences, which repeats make lossy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        undo = r.restored_by_text if by_text else r.restored
        for batch in _slices(batches):
            out = [t if t is None else undo(t, [r.Match(m["placeholder"], m["original"], m["type"], m["start_offset"], m["end_offset"]) for m in ms or []]) for t, ms in zip(batch.column("filtered_text").to_pylist(), batch.column("matches").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "restored_text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in filtered.schema)
    return filtered.mapInArrow(run, f"{schema}, restored_text string")


# --- tabular data --------------------------------------------------------------------------


def to_cells(table: DataFrame, sheet: Column, row: Column) -> DataFrame:
    """sheet, row, col, header and value of every cell; nulls are empty."""
    cells = F.array(*(F.struct(F.lit(x).alias("header"), F.coalesce(F.col(x).cast("string"), F.lit("")).alias("value")) for x in table.columns))
    return table.select(sheet.alias("sheet"), row.alias("row"), F.posexplode(cells).alias("col", "c")).select("sheet", "row", "col", "c.header", "c.value")


#: Rows of a sheet that are read as one text, when rows have numbers.
BLOCK_ROWS = 10_000
#: Names of all sheets that are broadcast; more travel with their cells.
MOST_NAMES = 2_000_000


def sheet_texts(cells: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Each sheet's non-blank cells, trimmed, row by row, one to a line; with block_rows, one text for each block of so many rows."""
    full = cells.withColumn("value", c.trimmed(F.col("value"))).where("value <> ''")
    ordered = F.sort_array(F.collect_list(F.struct("row", "col", "value")))
    joined = F.array_join(F.transform(ordered, lambda x: x["value"]), "\n").alias("text")
    if not block_rows or not isinstance(cells.schema["row"].dataType, IntegralType):
        return full.groupBy("sheet").agg(joined)
    return full.groupBy("sheet", F.floor(F.col("row") / block_rows).alias("block")).agg(joined).drop("block")


_SMALL = re.compile("(?:van|de|den|der|het|te|ten|ter|in|op|aan|bij|uit|voor|over|onder|tot)", re.I)


def name_parts(name: str) -> list[str]:
    """A discovered name and its capitalised parts."""
    return [name, *(p for p in name.split() if len(p) >= 2 and re.match(f"[{fx.CAP}]", p) and not _SMALL.fullmatch(p))]


def discovered_names(cells: DataFrame, config: r.FilterConfig = r.FilterConfig()) -> DataFrame:
    """sheet and names: what the sheet's text reveals, read in blocks of BLOCK_ROWS rows, together.

    The texts are those of sheet_texts(). A task has its cells in order and holds one block of them, and of a block its names go on.
    """
    by_blocks = isinstance(cells.schema["row"].dataType, IntegralType)
    block = F.floor(F.col("row") / BLOCK_ROWS) if by_blocks else F.lit(0).cast("long")
    full = cells.select("sheet", block.alias("block"), "row", "col", c.trimmed(F.col("value")).alias("value")).where("value <> ''")
    ordered = full.repartition("sheet", "block").sortWithinPartitions("sheet", "block", "row", "col", "value").select("sheet", "block", "value")
    lexicon = cells.sparkSession.sparkContext.broadcast((config.lexicon.first, config.lexicon.last, config.lexicon.more))
    bare = config.updated(lexicon=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kind = bare.updated(lexicon=Lexicon(*lexicon.value)), None

        def lines() -> Iterator[tuple]:
            nonlocal kind
            for batch in _slices(batches):
                kind = batch.schema.field("sheet").type
                yield from zip(*(x.to_pylist() for x in batch.columns), strict=True)

        for (sheet, _), held in groupby(lines(), lambda x: x[:2]):
            names = sorted({p for m in r.find_matches("\n".join(x[2] for x in held), own) if m.type == "name" for p in name_parts(m.original)})
            yield pa.RecordBatch.from_arrays([pa.array([sheet] * len(names), kind), pa.array(names, pa.string())], ["sheet", "name"])

    found = ordered.mapInArrow(run, f"sheet {cells.schema['sheet'].dataType.simpleString()}, name string")
    return found.groupBy("sheet").agg(F.sort_array(F.collect_set("name")).alias("names"))


def filter_cells(cells: DataFrame, config: r.FilterConfig = r.FilterConfig()) -> DataFrame:
    """Two passes: names found in the whole sheet count as given names in each of its cells; numbering restarts in each cell."""
    found = discovered_names(cells, config).cache()
    if (found.agg(F.sum(F.size("names"))).first()[0] or 0) <= MOST_NAMES:
        sheets = {x.sheet: x.names for x in found.collect()}
        found.unpersist()
        out = filter_documents(cells, config, text="value", sheet="sheet", sheets=sheets)
    else:
        out = filter_documents(cells.join(found, "sheet", "left"), config, text="value", names="names").drop("names")
    blank = c.trimmed(F.col("value")) == ""
    header = F.coalesce(F.nullif("header", F.lit("")), F.concat(F.lit("Kolom "), (F.col("col") + 1).cast("string")))
    return out.withColumns({"filtered_text": F.when(blank, F.lit("")).otherwise(F.col("filtered_text")), "header": header})


def sheet_totals(filtered: DataFrame) -> DataFrame:
    """rows, cols, changed (cells with matches) and items of each sheet of filtered cells."""
    return filtered.groupBy("sheet").agg(F.count_distinct("row").alias("rows"), F.count_distinct("col").alias("cols"), F.count_if(F.size("matches") > 0).alias("changed"), F.sum(F.size("matches")).cast("long").alias("items"))


def badges(stats_rows: DataFrame) -> DataFrame:
    """`stats_rows` with counts, a map of the types that occur and their numbers."""
    every = F.create_map(*(x for t in fx.TYPES for x in (F.lit(t), F.col(t))))
    return stats_rows.withColumn("counts", F.map_filter(every, lambda k, v: v > 0))


def names_in_order(found: DataFrame, locale: str = "nl") -> DataFrame:
    """Distinct names (original) in the order of a language: letters first, then accents, then letter case."""
    return found.select("original").distinct().orderBy(F.collate("original", locale), "original")


def _holding(long: DataFrame, short: DataFrame) -> DataFrame:
    """(long, short) where the lower-case string `l` of a row of `long` holds `s` of a row of `short`: they meet by the first three letters of `s`."""
    starts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("l")), lambda i: F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.substring(F.col("l"), i, n)))))
    pieces = long.where("l <> ''").select("l", F.explode(starts).alias("__piece"))
    met = pieces.join(short.where("s <> ''").withColumn("__start", F.substring("s", 1, 3)), F.col("__piece") == F.col("__start"))
    return met.where(F.col("l").contains(F.col("s"))).select("l", "s").distinct()


def missed_names(expected: DataFrame, found: DataFrame) -> DataFrame:
    """`expected` (name) with `found`: whether some found name (original) holds it or is held by it, in any letter case. An empty or null name isn't found."""
    a, b = expected.select(F.lower("name").alias("l")).distinct(), found.select(F.lower("original").alias("s")).distinct()
    wider = _holding(a, b).select(F.col("l").alias("__name"))
    narrower = _holding(b.withColumnRenamed("s", "l"), a.withColumnRenamed("l", "s")).select(F.col("s").alias("__name"))
    hits = wider.union(narrower).distinct().withColumn("__found", F.lit(True))
    rows = expected.drop("found").join(hits, F.lower("name") == F.col("__name"), "left")
    return rows.withColumn("found", F.coalesce("__found", F.lit(False))).drop("__name", "__found")


def changed_cells(filtered: DataFrame) -> DataFrame:
    return filtered.where(F.size("matches") > 0).withColumn("matches", safe_matches(F.col("matches")))


def column_widths(cells: DataFrame) -> DataFrame:
    """Width of each column: the longest value or header and 2 more, within 10 and 50."""
    longest = F.greatest(F.max(F.length("value")), F.max(F.length("header")))
    return cells.groupBy("sheet", "col").agg(F.least(F.greatest(longest + 2, F.lit(10)), F.lit(50)).cast("long").alias("width"))
