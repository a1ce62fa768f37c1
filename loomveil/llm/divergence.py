"""Source divergence audit: how each source of a language differs from the others and from the language.

1. Byte-level tokenizer. The texts of a batch are one UTF-8 buffer; a lookup table of 256
   entries says which bytes belong to a term (ASCII letters and every byte of another
   character), boundaries are where that changes, and a second table lower-cases A-Z.
   xxhash numbers the slices, equal numbers are compared byte by byte with the first of
   their kind, and slices that differ get kinds of their own. A batch's counts and document
   counts go on, and Spark adds them up by (lang, source, term), the terms' own bytes.
2. A language keeps the terms of `min_docs` of its documents.
3. A term's share in a group is p = 1 + floor(10^9 (count + 5) / (N + 5 V)): N is the sum of
   the group's counts of kept terms, V the number of kept terms. All arithmetic is exact.
4. Divergences. Kept terms are dealt to blocks by hash, a block's rows become a CSR matrix
   of sources by terms, and reduceat over its rows gives one source's distance to all
   others at once; terms that neither has count by their number. Blocks are added up by
   Spark. Languages of more than `tile` sources are cut into tiles of sources too, so that
   no task holds more than two tiles' rows of one block.

`pair` gives all other sources of the language, `term` the `top` terms that a source has
more of than its language, by a rank that takes no more than `top` rows of a group from a
task. Results of pairs are as many as pairs of sources of a language: that is what is asked.

Edge cases: null text, lang and source read as empty. Groups without terms are groups.
Without kept terms all distances are 0, and no terms are given. Repeated rows count as
documents of their own; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomveil.llm import bytescan as bs
from loomveil.llm import scratch

SCALE = 1_000_000_000
PRIOR = 5


@dataclass(frozen=True)
class AuditRules:
    min_docs: int = 30
    top: int = 50
    #: Rows of the kept counts in one block; more where a block's pairs of sources would be more than its rows.
    block_rows: int = 20_000
    #: Sources in one tile.
    tile: int = 256


# --- tokenizer -----------------------------------------------------------------------------


def _term_bytes() -> np.ndarray:
    table = np.zeros(256, bool)
    table[0x41:0x5B] = table[0x61:0x7B] = table[0x80:] = True
    return table


def terms_of(t: bs.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Of all term occurrences: where each text's begin, and their kind; and the kinds' bytes."""
    low = t.lower[t.buf]
    start, end, first = t.stretches(_term_bytes()[t.buf])
    data, size = low.tobytes(), end - start
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)), np.uint64, len(start))
    _, example, kind = np.unique(hashes, return_index=True, return_inverse=True)
    of = example[kind]
    differ = size != size[of]
    # the bytes of every slice beside those of the first of its kind
    length = np.where(differ, 0, size)
    begin = np.cumsum(length) - length
    inside = np.arange(length.sum()) - np.repeat(begin, length)
    unequal = np.flatnonzero(low[np.repeat(start, length) + inside] != low[np.repeat(start[of], length) + inside])
    differ[np.searchsorted(begin + length, unequal, side="right")] = True
    kinds = [data[a:b] for a, b in zip(start[example].tolist(), end[example].tolist(), strict=True)]
    if differ.any():  # equal hashes of different bytes
        known: dict[bytes, int] = {}
        for i in np.flatnonzero(differ):
            term = data[start[i] : end[i]]
            if term not in known:
                known[term] = len(kinds)
                kinds.append(term)
            kind[i] = known[term]
    return first, kind, kinds


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of `docs`, and a row with a null term for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = [batch.column(c).dictionary_encode() for c in ("lang", "source")]
            code = pair[0].indices.to_numpy() * np.int64(len(pair[1].dictionary)) + pair[1].indices.to_numpy()
            groups, of_row = np.unique(code, return_inverse=True)
            names = [d.dictionary.take(pa.array(x)) for d, x in zip(pair, np.divmod(groups, max(1, len(pair[1].dictionary))), strict=True)]
            zero = np.zeros(len(groups), np.int64)
            yield pa.RecordBatch.from_arrays([*names, pa.nulls(len(groups), pa.string()), pa.array(zero), pa.array(zero)], ["lang", "source", "term", "n", "docs"])
            for t in bs.slices(batch.column("text")):
                first, kind, kinds = terms_of(t)
                many = np.int64(max(1, len(kinds)))
                each, n = np.unique(bs.owners(first) * many + kind, return_counts=True)  # by document
                group = of_row[each // many + t.first] * many + each % many
                order = np.argsort(group, kind="stable")
                group, n = group[order], n[order]
                new = np.flatnonzero(np.diff(group, prepend=-1))
                which, term = np.divmod(group[new], many)
                counts = (np.add.reduceat(n, new) if len(new) else n, np.diff(np.append(new, len(n))))
                strings = pa.array(kinds, pa.binary()).take(pa.array(term)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(x.take(pa.array(which)) for x in names), strings, *map(pa.array, counts)], ["lang", "source", "term", "n", "docs"])

    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    found = docs.select(none("lang"), none("source"), none("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# --- shares --------------------------------------------------------------------------------


def share(count: str, of: str) -> Column:
    """1 + floor(10^9 (count + 5) / of) of two columns, by way of integers of 38 digits."""
    return F.expr(f"1 + (cast({count} as decimal(27,0)) + {PRIOR}) * cast({SCALE} as decimal(10,0)) div cast({of} as decimal(28,0))")


def shares(count: np.ndarray, of: np.ndarray | int) -> np.ndarray:
    """The same by long division, which doesn't overflow below 9 * 10^15."""
    left = np.asarray(count, np.int64) + PRIOR
    out = left // of
    left = left - out * of
    for _ in range(3):
        left = left * 1000
        digit = left // of
        out, left = out * 1000 + digit, left - digit * of
    return out + 1


# --- divergences ---------------------------------------------------------------------------


def distances(src: np.ndarray, term: np.ndarray, n: np.ndarray, of: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each source i in `rows`, its distance to every source in `cols` over the terms that occur in this block.

    src, term, n: the nonzero counts, terms being numbered from 0; of: N + 5 V of every source.
    """
    order = np.lexsort([term, src])
    src, term, n = src[order], term[order], n[order]
    begin = np.searchsorted(src, np.arange(len(of) + 1))  # CSR: row offsets, columns, values
    p, base = shares(n, of[src]), shares(np.zeros(len(of), np.int64), of)
    many = int(term.max()) + 1 if len(term) else 0
    some = np.flatnonzero(np.diff(begin) > 0)
    own_base = base[src]
    for i in rows:
        mine, at = p[begin[i] : begin[i + 1]], term[begin[i] : begin[i + 1]]
        dense = np.full(many, base[i], np.int64)
        dense[at] = mine
        there = dense[term]
        out = np.zeros(len(of), np.int64)
        # terms that the other has, instead of its share without them
        if len(some):
            out[some] = np.add.reduceat(np.abs(there - p) - np.abs(there - own_base), begin[some])
        # all terms, as if the other had none: sums of differences to sorted shares
        s = np.sort(mine)
        sums = np.concatenate([[0], np.cumsum(s)])
        below = np.searchsorted(s, base)
        out += base * below - sums[below] + (sums[-1] - sums[below]) - base * (len(s) - below)
        out += (many - len(s)) * np.abs(base - base[i])
        yield int(i), out[cols]


def pair_distances(kept: DataFrame, groups: DataFrame, rules: AuditRules) -> DataFrame:
    """(lang, i, j, value, present) for i < j: distances over the terms that occur in a block, and how many those are.

    kept: (lang, term, nr, n); groups: (lang, nr, of, sources, cells), nr numbering a language's sources from 0.
    """
    tile = rules.tile
    block_rows = F.greatest(F.lit(rules.block_rows), F.pow(F.least("sources", F.lit(tile)), 2).cast("long"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("cells") / block_rows))
    spread = kept.join(groups.select("lang", "nr", "of", "sources", "cells"), ["lang", "nr"])
    rows = spread.withColumn("block", F.pmod(F.xxhash64("term"), blocks))
    empty = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    every = rows.select("lang", "block", "nr", "of", "sources", "term", "n").unionByName(empty.select("lang", "block", "nr", "of", "sources", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n")))
    own = F.expr(f"nr div {tile}")
    every = every.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(sources - 1) div {tile}")))).withColumns({"x": F.least(own, "other"), "y": F.greatest(own, "other")})

    def compute(group: pa.Table) -> pa.Table:
        x, y = (group.column(c)[0].as_py() for c in ("x", "y"))
        nr, ofs = (group.column(c).to_numpy() for c in ("nr", "of"))
        ids, example, src = np.unique(nr, return_index=True, return_inverse=True)
        full = np.flatnonzero(group.column("term").is_valid().to_numpy())
        terms = group.column("term").combine_chunks().take(pa.array(full)).dictionary_encode()
        rows, cols = np.flatnonzero(ids // tile == x), np.flatnonzero(ids // tile == y)
        code = terms.indices.to_numpy() if len(full) else np.zeros(0, np.int64)
        left, right, value = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, out in distances(src[full], code, group.column("n").to_numpy()[full], np.maximum(ofs[example], 1), rows, cols):
            later = ids[cols] > ids[i]
            left.append(np.full(int(later.sum()), ids[i]))
            right.append(ids[cols][later])
            value.append(out[later])
        i, j, v = map(np.concatenate, (left, right, value))
        lang = pa.array([group.column("lang")[0].as_py()] * len(i), pa.string())
        return pa.table({"lang": lang, "i": i, "j": j, "value": v, "present": np.full(len(i), len(terms.dictionary), np.int64)})

    found = every.select("lang", "block", "x", "y", "nr", "of", "term", "n").groupBy("lang", "block", "x", "y").applyInArrow(compute, "lang string, i long, j long, value long, present long")
    return found.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"), F.sum("present").alias("present"))


def audit(docs: DataFrame, rules: AuditRules = AuditRules()) -> DataFrame:
    """lang, source, part, item, value and rank of every (lang, source) of `docs` (text, lang, source)."""
    terms = scratch.table(count_terms(docs), "audit-terms")
    by_term = terms.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("of"))
    kept = by_term.where(F.col("docs") >= rules.min_docs).select("lang", "term", "all", F.explode("of").alias("of")).select("lang", "term", "all", "of.source", "of.n")
    kept = scratch.table(kept, "audit-kept")  # no more rows than terms kept times sources
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("nonzero"))
    sizes = kept.groupBy("lang").agg(F.sum("n").alias("all_total"), F.count_distinct("term").alias("v"), F.count("*").alias("cells"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = terms.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.select("lang", "source", *map(zero, ("total", "all_total", "v", "cells")))
    by_lang = W.partitionBy("lang")
    groups = groups.withColumns({"nr": F.row_number().over(by_lang.orderBy("source")).cast("long") - 1, "sources": F.count("*").over(by_lang), "of": F.col("total") + PRIOR * F.col("v"), "all_of": F.col("all_total") + PRIOR * F.col("v")})
    groups = scratch.table(groups, "audit-groups")  # a row for each group

    of_group = kept.join(groups.select("lang", "source", "nr", "of", "all_of"), ["lang", "source"])
    pairs = pair_distances(of_group.select("lang", "term", "nr", "n"), groups, rules)
    base = F.when(F.col("v") > 0, share("0", "of")).otherwise(F.lit(0).cast("long"))
    named = lambda c: groups.select("lang", F.col("nr").alias(c), F.col("source").alias(f"{c}_source"), base.alias(f"{c}_base"), *(["v"] if c == "i" else []))
    both = pairs.join(named("i"), ["lang", "i"]).join(named("j"), ["lang", "j"])
    both = both.withColumn("value", F.col("value") + (F.col("v") - F.col("present")) * F.abs(F.col("i_base") - F.col("j_base")))
    ends = F.explode(F.array(*(F.struct(F.col(f"{a}_source").alias("source"), F.col(f"{b}_source").alias("item")) for a, b in ("ij", "ji"))))
    far = both.select("lang", "value", ends.alias("end")).select("lang", "end.source", F.lit("pair").alias("part"), "end.item", "value")
    p, q = share("n", "of"), share("all", "all_of")
    more = of_group.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    out = far.withColumn("rank", rank).unionByName(more.withColumn("rank", rank).where(F.col("rank") <= rules.top))
    return out.select("lang", "source", "part", "item", "value", "rank")
