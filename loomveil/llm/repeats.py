"""Substring dedup by repeated-phrase automata.

A window is `words` consecutive words of one document. Every word that lies in a window
whose word sequence starts anywhere else too, in the same document or in another, goes;
windows are judged on the input.

1. Candidates. The anchor of a window is its least n-gram of `anchor` words, by hash, the
   leftmost of equal ones: equal windows have equal anchors at equal places. Windows of a
   document that share one anchor make up a context, about `words` - `anchor` words and a
   window long. Anchors are counted over the corpus; a context whose anchor occurs once
   has no repeated window, and a Bloom filter of the others keeps it at the scan.
2. Confirmation. Contexts are grouped by their words, byte by byte. The only context of an
   anchor is a recurring passage if it occurs twice. Where an anchor has several contexts,
   their windows are counted one by one. What is repeated is cut, in one of its contexts,
   where the set of contexts that hold it changes: so wherever one of a passage's windows
   occurs, the whole passage does. Each repeated window is in exactly one passage.
3. Automata. Passages are dealt to shards by their anchor, about `shard_words` words to a
   shard. A task compiles a shard's Aho-Corasick automaton, whose letters are the words of
   its passages.
4. Streaming. The contexts of all documents go to their anchor's shard and through its
   automaton, which gives the place of every passage in them. Shards of many contexts are
   salted with a copy of their passages for each salt, and the passages of an anchor that
   has more than `part_words` are parted, its contexts going to every part.
5. The covered words of a text come back by two 64-bit hashes of the text, as equal texts
   lose equal words. Texts that lose nothing, which a Bloom filter tells, are not moved.

Work follows the repeated text: words outside contexts of repeated anchors never leave the
scan. No pairs of documents are made, and a task holds one shard's passages and a batch.
Windows of one anchor are told apart by 64-bit hashes; passages meet texts byte by byte.

Edge cases: a null text stays null and has no words; a text of fewer than `words` words
loses nothing. White space between words becomes one space. Repeated rows are documents of
their own, so that they lose all their windows. Columns of the caller's named n_words or
n_removed are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomveil.llm import bloom, scratch
from loomveil.llm import bytescan as bs


@dataclass(frozen=True)
class RepeatRules:
    words: int = 35
    anchor: int = 8
    #: Words of the passages of one automaton, small enough for a processor's cache.
    shard_words: int = 25_000
    #: Words of the passages of one anchor in one automaton.
    part_words: int = 200_000
    #: Contexts that one task streams through one automaton.
    rows_per_salt: int = 50_000
    #: Bytes of the filter of repeated anchors; beyond, all contexts leave the scan.
    max_filter: int = 64 << 20

    def __post_init__(self):
        if not 1 <= self.anchor <= self.words:
            raise ValueError("an anchor lies inside a window")


# --- contexts ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Contexts:
    text: np.ndarray  # which text
    at: np.ndarray  # the first word's number in its text
    windows: np.ndarray  # how many windows
    place: np.ndarray  # of the anchor, in words from the first
    anchor: np.ndarray  # its hash


def contexts_of(h: np.ndarray, first: np.ndarray, rules: RepeatRules) -> Contexts:
    """All contexts of the texts whose word hashes are given."""
    g, gf = bs.grams(h, first, rules.anchor)
    width = rules.words - rules.anchor + 1
    least, span = np.arange(len(g)), 1
    while span < width and len(least) > span:  # least[i]: the leftmost least of g[i : i + span]
        step = min(span, width - span)
        a, b = least[:-step], least[step:]
        least, span = np.where(g[b] < g[a], b, a), span + step
    count = np.maximum(np.diff(gf) - width + 1, 0)
    own = np.repeat(np.arange(len(count)), count)
    begin = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + gf[:-1][own]  # a window's first gram
    at = least[begin]
    new = np.flatnonzero(np.diff(at, prepend=-1))  # grams differ between texts
    begin, own, at = begin[new], own[new], at[new]
    return Contexts(own, begin - gf[own], np.diff(np.append(new, count.sum())), at - begin, g[at].view(np.int64))


def _words(t: bs.Texts) -> tuple[np.ndarray, ...]:
    t.prepare(lower=False)
    start, end, first = t.words()
    return start, end, first, t.span(start, end)


def count_anchors(docs: DataFrame, rules: RepeatRules) -> DataFrame:
    """(hash) of the anchors that have two contexts or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in bs.slices(batch.column("text")):
                *_, first, h = _words(t)
                value, n = np.unique(contexts_of(h, first, rules).anchor, return_counts=True)
                yield pa.RecordBatch.from_pydict({"hash": value, "n": n})

    return docs.select("text").mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash")


def contexts(docs: DataFrame, anchors: DataFrame, rules: RepeatRules) -> DataFrame:
    """(anchor, place, t1, t2, at, words) of the contexts of `docs` (t1, t2, text) whose anchor may be in `anchors`."""
    n, rate, held = anchors.count(), 0.01, None
    if n and bloom.bits_needed(n, rate) <= 8 * rules.max_filter:
        held = docs.sparkSession.sparkContext.broadcast(bloom.build(anchors, n, rate))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = batch.column("t1").to_numpy(), batch.column("t2").to_numpy()
            for t in bs.slices(batch.column("text")):
                start, end, first, h = _words(t)
                c = contexts_of(h, first, rules)
                some = np.flatnonzero(bloom.probe(*held.value, 0, c.anchor.view(np.uint64))) if held else np.arange(len(c.anchor))
                buf, _, at = bs.joined(t, start, end, first, np.ones(len(h), bool))
                data, size = buf.tobytes(), end - start
                for i in range(0, len(some), 8192):  # contexts overlap: a batch holds some thousands of them
                    k = some[i : i + 8192]
                    lo = first[c.text[k]] + c.at[k]
                    hi = lo + c.windows[k] + rules.words - 2  # the last word
                    cut = [data[a:b] for a, b in zip(at[lo].tolist(), (at[hi] + size[hi]).tolist(), strict=True)]
                    own = c.text[k] + t.first
                    yield pa.RecordBatch.from_pydict({"anchor": c.anchor[k], "place": c.place[k].astype(np.int32), "t1": t1[own], "t2": t2[own], "at": c.at[k], "words": pa.array(cut, pa.binary())})

    if not n:
        return docs.sparkSession.createDataFrame([], "anchor long, place int, t1 long, t2 long, at long, words binary")
    return docs.select("t1", "t2", "text").mapInArrow(run, "anchor long, place int, t1 long, t2 long, at long, words binary")


# --- recurring passages --------------------------------------------------------------------


def passages(found: DataFrame, rules: RepeatRules) -> DataFrame:
    """(anchor, words, n) of the recurring passages in contexts (anchor, place, words), and how many words each has."""
    n_words = rules.words
    distinct = scratch.table(found.groupBy("anchor", "place", "words").agg(F.count("*").alias("n")).withColumn("id", F.xxhash64("words")), "repeat-contexts")
    # two contexts of one anchor, or one that occurs twice; a table, so that a hot anchor's contexts can be split when they meet it
    by_anchor = distinct.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("n").alias("all")).where("all > 1")
    by_anchor = scratch.table(by_anchor.select("anchor", (F.col("kinds") > 1).alias("mixed")), "repeat-anchors")
    judged = distinct.join(by_anchor, "anchor")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, place, ids, n = (batch.column(c).to_numpy() for c in ("anchor", "place", "id", "n"))
            for t in bs.slices(batch.column("words").cast(pa.large_binary())):
                *_, first, h = _words(t)
                w, wf = bs.grams(h, first, n_words)
                own = bs.owners(wf)
                row = own + t.first
                yield pa.RecordBatch.from_pydict({"anchor": anchor[row], "window": w.view(np.int64), "shift": (np.arange(len(w)) - wf[own] - place[row]).astype(np.int32), "id": ids[row], "n": n[row]})

    flat = judged.where("mixed").select("anchor", "place", "id", "n", "words").mapInArrow(windows, "anchor long, window long, shift int, id long, n long")
    # in which contexts a window is: a mark of that set; its place in each follows from the anchor's
    counted = flat.groupBy("anchor", "window").agg(F.sum("n").alias("n"), F.bit_xor("id").alias("holders"), F.min("id").alias("id"), F.min("shift").alias("shift")).where("n > 1")
    cuts = counted.groupBy("anchor", "id").agg(F.sort_array(F.collect_list(F.struct("shift", "holders"))).alias("cuts"))  # of one context: no more than its windows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors, out, size = [], [], []
            for anchor, place, words, marks in zip(*(batch.column(c).to_pylist() for c in ("anchor", "place", "words", "cuts")), strict=True):
                parts, i = words.split(b" "), 0
                for j in range(1, len(marks) + 1):
                    if j == len(marks) or marks[j]["holders"] != marks[i]["holders"] or marks[j]["shift"] != marks[j - 1]["shift"] + 1:
                        lo, hi = place + marks[i]["shift"], place + marks[j - 1]["shift"] + n_words
                        anchors.append(anchor)
                        out.append(b" ".join(parts[lo:hi]))
                        size.append(hi - lo)
                        i = j
            yield pa.RecordBatch.from_pydict({"anchor": pa.array(anchors, pa.int64()), "words": pa.array(out, pa.binary()), "n": pa.array(size, pa.int64())})

    held = judged.where("mixed").select("anchor", "place", "id", "words").join(cuts, ["anchor", "id"])
    pieces = held.select("anchor", "place", "words", "cuts").mapInArrow(cut, "anchor long, words binary, n long")
    spaces = F.length(F.regexp_replace(F.col("words").cast("string"), "[^ ]+", ""))
    whole = judged.where("not mixed").select("anchor", "words", (spaces + 1).cast("long").alias("n"))
    return whole.unionByName(pieces)


# --- automata ------------------------------------------------------------------------------


class Automaton:
    """Aho-Corasick over words: the letters are the passages' words."""

    def __init__(self, phrases: list[bytes]):
        import ahocorasick

        self.letters: dict[bytes, str] = {}
        self.machine = ahocorasick.Automaton()
        for p in phrases:
            words = p.split(b" ")
            for w in words:
                if w not in self.letters:
                    k = len(self.letters) + 1  # letter 0 is any other word
                    self.letters[w] = chr(k if k < 0xD800 else k + 0x800)
            self.machine.add_word("".join(map(self.letters.__getitem__, words)), len(words))
        self.machine.make_automaton()

    def covered(self, text: bytes) -> list[tuple[int, int]]:
        """The stretches of words that passages cover."""
        get = self.letters.get
        out: list[tuple[int, int]] = []
        for last, n in self.machine.iter("".join([get(w, "\0") for w in text.split(b" ")])):
            lo, hi = last + 1 - n, last + 1
            while out and lo <= out[-1][1]:
                a, b = out.pop()
                lo, hi = min(a, lo), max(b, hi)
            out.append((lo, hi))
        return out


def stream(found: DataFrame, phrases: DataFrame, rules: RepeatRules) -> DataFrame:
    """(t1, t2, lo, hi): stretches of words that the passages cover, of contexts (anchor, t1, t2, at, words)."""
    sized = phrases.groupBy("anchor").agg(F.sum("n").alias("n"))
    total = phrases.agg(F.sum("n")).first()[0] or 0
    shards = max(1, math.ceil(total / rules.shard_words))
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")
    few = bloom.keep_maybe(found, "anchor", sized.select(F.col("anchor").alias("hash"))).select(shard, "anchor", "t1", "t2", "at", "words")
    kept = phrases.select(shard, "anchor", "words").withColumn("part", F.lit(0))
    wide = scratch.table(sized.where(F.col("n") > rules.part_words).select("anchor", F.ceil(F.col("n") / rules.part_words).cast("int").alias("parts")), "repeat-wide")
    few = few.withColumn("part", F.lit(0))
    if wide.limit(1).count():  # anchors of too many passages for one automaton
        kept = kept.join(wide, "anchor", "left").withColumn("part", F.pmod(F.xxhash64("words"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        few = few.join(wide, "anchor", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    hot = few.groupBy("shard", "part").count().where(F.col("count") > rules.rows_per_salt)
    hot = scratch.table(hot.select("shard", "part", F.ceil(F.col("count") / rules.rows_per_salt).cast("int").alias("salts")), "repeat-hot")
    salts = F.coalesce("salts", F.lit(1))
    asked = few.join(hot, ["shard", "part"], "left").select("shard", "part", F.pmod(F.xxhash64("t1", "at"), salts).cast("int").alias("salt"), F.lit(1).alias("kind"), "t1", "t2", "at", "words")
    copies = kept.join(hot, ["shard", "part"], "left").select("shard", "part", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("kind"), *(F.lit(0).cast("long").alias(c) for c in ("t1", "t2", "at")), "words")
    dealt = copies.unionByName(asked).repartition("shard", "part", "salt").sortWithinPartitions("shard", "part", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_shard, machine, phrases = None, None, []
        for batch in batches:
            cells = list(zip(*(batch.column(c).to_pylist() for c in ("shard", "part", "salt")), strict=True))
            kinds, words = batch.column("kind").to_pylist(), batch.column("words").to_pylist()
            t1, t2, begin = (batch.column(c).to_pylist() for c in ("t1", "t2", "at"))
            out: list[tuple[int, int, int, int]] = []
            for i, cell in enumerate(cells):
                if cell != at_shard:
                    at_shard, machine, phrases = cell, None, []
                if kinds[i] == 0:
                    phrases.append(words[i])
                elif phrases or machine:
                    if machine is None:
                        machine, phrases = Automaton(phrases), []
                    out += [(t1[i], t2[i], begin[i] + lo, begin[i] + hi) for lo, hi in machine.covered(words[i])]
            a = np.array(out, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_pydict({"t1": a[:, 0], "t2": a[:, 1], "lo": a[:, 2], "hi": a[:, 3]})

    return dealt.mapInArrow(run, "t1 long, t2 long, lo long, hi long")


# --- documents -----------------------------------------------------------------------------


def remove_repeats(docs: DataFrame, rules: RepeatRules = RepeatRules()) -> DataFrame:
    """`docs` (text, ...) with its words outside repeated windows as text, joined by one space, n_words and n_removed."""
    names = [c for c in docs.columns if c.lower() not in ("n_words", "n_removed")]
    keyed = docs.select(*names).withColumns({"__t1": F.xxhash64("text"), "__t2": F.xxhash64("text", F.lit(1))})
    texts = keyed.select(F.col("__t1").alias("t1"), F.col("__t2").alias("t2"), "text").where("text is not null")
    anchors = scratch.table(count_anchors(docs, rules), "repeat-anchors")
    found = scratch.table(contexts(texts, anchors, rules), "repeat-found")
    phrases = scratch.table(passages(found, rules), "repeat-passages")
    spans = stream(found, phrases, rules).distinct().groupBy("t1", "t2").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("__gone"))
    spans = scratch.table(spans.select(F.col("t1").alias("__of1"), F.col("t2").alias("__of2"), "__gone"), "repeat-spans")
    ask = bloom.asker(docs, spans.select(F.col("__of1").alias("hash")))
    none = F.array().cast("array<struct<lo: bigint, hi: bigint>>")
    sure, unsure = (keyed.where(~ask(F.col("__t1"))), keyed.where(ask(F.col("__t1")))) if ask else (keyed.limit(0), keyed)
    met = unsure.join(spans, (F.col("__t1") == F.col("__of1")) & (F.col("__t2") == F.col("__of2")), "left").withColumn("__gone", F.coalesce("__gone", none))
    both = sure.withColumn("__gone", none).unionByName(met.drop("__of1", "__of2")).select(*names, "__gone")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in bs.slices(batch.column("text")):
                start, end, first = t.words()
                part = batch.slice(t.first, t.n)
                lists = part.column("__gone")
                own, spans = np.repeat(np.arange(t.n), lists.value_lengths().to_numpy()), lists.flatten()
                step = np.zeros(len(start) + 1, np.int32)
                np.add.at(step, first[own] + spans.field("lo").to_numpy(), 1)
                np.add.at(step, first[own] + spans.field("hi").to_numpy(), -1)
                keep = np.cumsum(step[:-1]) == 0
                buf, off, _ = bs.joined(t, start, end, first, keep)
                new = pc.if_else(pc.is_valid(part.column("text")), bs.as_strings(buf, off).cast(pa.string()), None)
                lost = np.concatenate([[0], np.cumsum(~keep)])
                cols = {c: part.column(c) for c in names} | {"text": new, "n_words": pa.array(np.diff(first)), "n_removed": pa.array(lost[first[1:]] - lost[first[:-1]])}
                yield pa.RecordBatch.from_pydict(cols)

    return both.mapInArrow(rebuild, f"{scratch.ddl(docs.select(*names).schema)}, n_words long, n_removed long")


def digest(docs: DataFrame, rules: RepeatRules = RepeatRules()) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words."""
    out = remove_repeats(docs.select("doc_id", "text"), rules)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
