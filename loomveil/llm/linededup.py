"""Line dedup by a sharded minimal perfect hash.

1. Every task hashes the keys of its documents' lines to 128 bits, once for each
   document, and adds up counts; one shuffle of (hash, count) totals them.
2. All distinct line hashes are dealt to shards by their hash, about `shard_keys` to a
   shard. One task builds a shard's minimal perfect hash (levels of bit arrays: keys
   that meet nobody in a level get its bit, the others go on to the next level; a key's
   index is the rank of its bit), and stores a 64-bit fingerprint and a saturating count
   at each index. The level bits take about 4 bits a key; a shard is a few megabytes.
3. Documents probe the arrays: a line goes if the fingerprint at its index is its own
   and the count there reaches `min_docs`. No lines are joined.

Arrays of up to `max_broadcast` bytes, by their measured size, are sent to every
executor, and a scan of the documents probes them in place. Beyond that the probes are
dealt to the arrays: rows of (shard, line hash, text hash, line number) are sorted behind
their shard's arrays, a hot shard's rows being salted with a copy of its arrays for each
salt, and each task holds one shard at a time. What comes back are the numbers of the
lines that go, by the hash of their text, as a text's lines go or stay whatever row it is
in. Texts that keep all lines, which a Bloom filter of bounded size tells at the scan, are
not moved; the others meet their line numbers once.

A document is a row: repeated rows count as documents of their own. A null or
empty text is one empty line, and a null text without counts stays null. The empty key
(a blank line) never goes, as keys have at least `min_chars` code points. Columns of the
caller's named n_lines or n_dropped are replaced, unless no counts are asked for.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomveil.llm import bloom, scratch
from loomveil.llm import bytescan as bs


@dataclass(frozen=True)
class LineRules:
    min_docs: int = 10
    min_chars: int = 1
    shard_keys: int = 1 << 18
    max_broadcast: int = 64 << 20
    rows_per_salt: int = 1 << 20


# --- minimal perfect hash of one shard -------------------------------------------------


def build_mph(keys: np.ndarray, counts: np.ndarray, prints: np.ndarray, kind: type = np.uint16) -> dict:
    """Level bit arrays with ranks, and fingerprints and counts (of type `kind`) in index order. Keys are distinct."""
    levels, left, place = [], np.arange(len(keys)), np.empty(len(keys), np.int64)
    base = 0
    while len(left):
        size = max(64, int(len(left) * 1.5) + 63 >> 6 << 6)
        slot = _slot(keys[left], len(levels), size)
        used = np.bincount(slot, minlength=size)
        bits = used == 1
        rank = np.cumsum(bits) - bits
        own = bits[slot]
        place[left[own]] = base + rank[slot[own]]
        base += int(bits.sum())
        packed = np.packbits(bits, bitorder="little")
        levels.append((size, packed, np.concatenate([[0], np.cumsum(np.bitwise_count(packed.view(np.uint64)), dtype=np.int64)])[:-1].astype(np.int32)))
        left = left[~own]
        if len(levels) > 64:
            raise ValueError("keys of a shard aren't distinct")
    fp, c = np.empty(len(keys), np.uint64), np.empty(len(keys), kind)
    fp[place], c[place] = prints, np.minimum(counts, np.iinfo(kind).max)
    return {"levels": levels, "prints": fp, "counts": c}


def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (bs.mix(keys ^ (np.uint64(level + 1) * bs._GOLD)) % np.uint64(size)).astype(np.int64)


def probe_mph(mph: dict, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """The count of each key; 0 for a key that isn't in the shard."""
    out, left, base = np.zeros(len(keys), np.int64), np.arange(len(keys)), 0
    for level, (size, packed, ranks) in enumerate(mph["levels"]):
        slot = _slot(keys[left], level, size)
        on = (packed[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
        at, s = left[on], slot[on]
        words = packed.view(np.uint64)
        below = words[s >> 6] & ((np.uint64(1) << (s & 63).astype(np.uint64)) - np.uint64(1))
        index = base + ranks[s >> 6] + np.bitwise_count(below)
        same = mph["prints"][index] == prints[at]
        out[at[same]] = mph["counts"][index[same]]
        base += int(np.bitwise_count(words).sum())
        left = left[~on]
        if not len(left):
            break
    return out


# --- lines of documents ----------------------------------------------------------------


def _line_keys(t: bs.Texts, min_chars: int) -> tuple[np.ndarray, ...]:
    """Of all lines: where they start and end, each text's first, two hashes of the key and whether it counts."""
    ls, le, lf = t.lines()
    start, end, _ = t.words()
    t.prepare(lower=True)
    a, b = np.searchsorted(start, ls), np.searchsorted(start, np.maximum(le, ls))
    some = np.flatnonzero(a < b)  # lines with a word; their key runs from the first word's start to the last one's end
    h1, h2 = np.zeros(len(ls), np.uint64), np.zeros(len(ls), np.uint64)
    ks, ke = start[a[some]], end[b[some] - 1]
    h1[some] = t.span(ks, ke)
    t.value_lower = bs.seeds(256, 2)[t.lower]
    t.prepare(lower=True)
    h2[some] = t.span(ks, ke)
    counts = np.zeros(len(ls), bool)
    points = np.concatenate([[0], np.cumsum((t.buf & 0xC0) != 0x80, dtype=np.int64)])
    counts[some] = points[ke] - points[ks] >= min_chars
    if min_chars <= 0:
        counts[:] = True
    return ls, le, lf, h1, h2, counts


def count_lines(docs: DataFrame, rules: LineRules) -> DataFrame:
    """(h1, h2, n) of all keys and the number of documents they are in."""
    least = rules.min_chars

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in bs.slices(batch.column("text")):
                _, _, lf, h1, h2, ok = _line_keys(t, least)
                own, h1, h2 = bs.owners(lf)[ok], h1[ok], h2[ok]
                order = np.argsort(bs.by_text(h1 ^ bs.mix(h2), own), kind="stable")
                o, a, b = own[order], h1[order], h2[order]
                new = np.concatenate([[True], (o[1:] != o[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(o) else np.zeros(0, bool)
                a, b = a[new], b[new]  # once for each document
                order = np.lexsort([b, a])
                a, b = a[order], b[order]
                first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_pydict({"h1": a[first].view(np.int64), "h2": b[first].view(np.int64), "n": np.diff(np.append(first, len(a)))})

    found = docs.select("text").mapInArrow(count, "h1 long, h2 long, n long")
    return found.groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def build_arrays(counted: DataFrame, shards: int, kind: type = np.uint16) -> DataFrame:
    """(shard, arrays): the pickled arrays of each shard."""

    def build(pdf):
        import pandas as pd

        keys, prints = pdf["h1"].to_numpy().view(np.uint64), pdf["h2"].to_numpy().view(np.uint64)
        # equal h1 of different lines would never part in any level: such keys are told apart by h2
        keys = _fold(keys, prints)
        mph = build_mph(keys, pdf["n"].to_numpy(), prints, kind)
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "arrays": [pickle.dumps(mph, 5)]})

    return counted.withColumn("shard", F.pmod("h1", F.lit(shards))).groupBy("shard").applyInPandas(build, "shard long, arrays binary")


def _fold(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return h1 ^ bs.mix(h2)


def _shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    return np.mod(h1.view(np.int64), shards)


def _rebuilt(t: bs.Texts, i: int, lo: int, hi: int, ls: np.ndarray, le: np.ndarray, gone: np.ndarray) -> bytes:
    if not gone[lo:hi].any():
        return t.text(i)
    return b"\n".join(t.buf[ls[k] : le[k]].tobytes() for k in range(lo, hi) if not gone[k])


def dedup_lines(docs: DataFrame, rules: LineRules = LineRules(), counts: bool = True) -> DataFrame:
    """`docs` (doc_id, text, ...) with `text` rebuilt without its frequent lines.

    Adds n_lines and n_dropped; all other columns stay as they are. Without `counts` the
    columns are those of `docs`.
    """
    spark = docs.sparkSession
    counted = scratch.table(count_lines(docs, rules), "line-counts")
    keys = counted.count()
    shards = max(1, math.ceil(keys / rules.shard_keys))
    # counts below the type's largest value are exact, so the threshold has to be one
    arrays = scratch.table(build_arrays(counted, shards, np.uint16 if rules.min_docs < 1 << 16 else np.uint32), "line-arrays")
    size = arrays.agg(F.sum(F.length("arrays"))).first()[0] or 0
    if size <= rules.max_broadcast:
        held = spark.sparkContext.broadcast({r.shard: r.arrays for r in arrays.collect()})
        return _probe_broadcast(docs, held, shards, rules, counts)
    return _probe_dealt(docs, arrays, shards, rules, counts)


def _rebuild(docs: DataFrame, gone_of: Callable[[pa.RecordBatch, bs.Texts, tuple], np.ndarray], least: int, counts: bool, leave: tuple[str, ...] = ()) -> DataFrame:
    """`docs` without the lines that gone_of(batch, texts, their line keys) marks; the columns in `leave` are left out."""
    added = ("n_lines", "n_dropped") if counts else ()
    names = [c for c in docs.columns if c not in (*added, *leave)]

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in bs.slices(batch.column("text")):
                lines = _line_keys(t, least)
                ls, le, lf = lines[:3]
                gone = gone_of(batch, t, lines)
                texts = [_rebuilt(t, i, lf[i], lf[i + 1], ls, le, gone) for i in range(t.n)]
                part = batch.slice(t.first, t.n)
                new = pa.array(texts, pa.binary()).cast(pa.string())
                if not counts:
                    new = pc.if_else(pc.is_valid(part.column("text")), new, None)
                lost = np.concatenate([[0], np.cumsum(gone)])
                cols = {c: part.column(c) for c in names} | {"text": new} | dict(zip(added, (pa.array(np.diff(lf)), pa.array(lost[lf[1:]] - lost[lf[:-1]])), strict=False))
                yield pa.RecordBatch.from_pydict(cols)

    schema = scratch.ddl(docs.select(*names).schema) + "".join(f", {c} long" for c in added)
    return docs.mapInArrow(rebuild, schema)


def _probe_broadcast(docs: DataFrame, held, shards: int, rules: LineRules, counts: bool) -> DataFrame:
    token, min_docs = uuid.uuid4().hex, rules.min_docs

    def gone_of(batch: pa.RecordBatch, t: bs.Texts, lines: tuple) -> np.ndarray:
        kept = bs.process_store()
        if kept.get("lines-token") != token:
            kept["lines-token"], kept["lines"] = token, {k: pickle.loads(bytes(v)) for k, v in held.value.items()}
        *_, h1, h2, ok = lines
        gone, asked = np.zeros(len(h1), bool), np.flatnonzero(ok)
        h1, h2 = h1[asked], h2[asked]
        keys, shard = _fold(h1, h2), _shard_of(h1, shards)
        for k, mph in kept["lines"].items():
            own = np.flatnonzero(shard == k) if shards > 1 else np.arange(len(h1))
            gone[asked[own]] = probe_mph(mph, keys[own], h2[own]) >= min_docs
        return gone

    return _rebuild(docs, gone_of, rules.min_chars, counts)


def _probe_dealt(docs: DataFrame, arrays: DataFrame, shards: int, rules: LineRules, counts: bool) -> DataFrame:
    """Probes go to the arrays, and the numbers of lines that go come back by the hash of their text."""
    least, min_docs = rules.min_chars, rules.min_docs
    # two hashes of 64 bits: a text is known by both
    keyed = docs.withColumns({"__t1": F.xxhash64("text"), "__t2": F.xxhash64("text", F.lit(1))})

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = batch.column("__t1").to_numpy(), batch.column("__t2").to_numpy()
            for t in bs.slices(batch.column("text")):
                _, _, lf, h1, h2, ok = _line_keys(t, least)
                own, at = bs.owners(lf)[ok] + t.first, np.flatnonzero(ok)
                yield pa.RecordBatch.from_pydict({"t1": t1[own], "t2": t2[own], "line": at - lf[own - t.first], "h1": h1[ok].view(np.int64), "h2": h2[ok].view(np.int64)})

    texts = keyed.select("__t1", "__t2", "text")
    asked = texts.mapInArrow(ask, "t1 long, t2 long, line long, h1 long, h2 long")
    asked = scratch.table(asked.withColumn("shard", F.pmod("h1", F.lit(shards))), "line-probes")
    salts = asked.groupBy("shard").count().select("shard", F.ceil(F.col("count") / rules.rows_per_salt).cast("int").alias("salts"))
    salts = F.broadcast(scratch.table(salts, "line-salts"))  # a row for each shard
    probe = ("t1", "t2", "line", "h1", "h2")
    probes = asked.join(salts, "shard").select("shard", F.pmod(F.xxhash64("t1", "line"), "salts").cast("int").alias("salt"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("arrays"), *probe)
    copies = arrays.join(salts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "arrays", *(F.lit(0).cast("long").alias(c) for c in probe))
    dealt = copies.unionByName(probes).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mph, shard = None, None
        for batch in batches:
            kinds, of = batch.column("kind").to_numpy(), batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(kinds) != 0) | (np.diff(of) != 0)) + 1), batch.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                if kinds[i] == 0:
                    mph, shard = pickle.loads(batch.column("arrays")[j - 1].as_py()), of[i]
                elif mph is not None and shard == of[i]:
                    h1, h2 = (batch.column(c).to_numpy()[i:j].view(np.uint64) for c in ("h1", "h2"))
                    hit = probe_mph(mph, _fold(h1, h2), h2) >= min_docs
                    yield batch.slice(i, j - i).select(["t1", "t2", "line"]).filter(pa.array(hit))

    answers = dealt.mapInArrow(answer, "t1 long, t2 long, line long")
    answers = answers.groupBy("t1", "t2").agg(F.sort_array(F.collect_set("line")).alias("__gone"))  # the lines of one text
    answers = scratch.table(answers.select(F.col("t1").alias("__of1"), F.col("t2").alias("__of2"), "__gone"), "line-answers")
    ask_text = bloom.asker(docs, answers.select(F.col("__of1").alias("hash")))
    if ask_text:
        sure, unsure = keyed.where(~ask_text(F.col("__t1"))), keyed.where(ask_text(F.col("__t1")))
    else:
        sure, unsure = keyed.limit(0), keyed
    none = F.array().cast("array<bigint>")
    met = unsure.join(answers, (F.col("__t1") == F.col("__of1")) & (F.col("__t2") == F.col("__of2")), "left").withColumn("__gone", F.coalesce("__gone", none)).drop("__of1", "__of2")
    both = sure.withColumn("__gone", none).unionByName(met)

    def gone_of(batch: pa.RecordBatch, t: bs.Texts, lines: tuple) -> np.ndarray:
        lf, lists = lines[2], batch.column("__gone").slice(t.first, t.n)
        gone = np.zeros(lf[-1], bool)
        gone[np.repeat(lf[:-1], lists.value_lengths().to_numpy()) + lists.flatten().to_numpy()] = True
        return gone

    return _rebuild(both, gone_of, least, counts, ("__t1", "__t2", "__gone"))


def digest(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the kept text."""
    out = dedup_lines(docs.select("doc_id", "text"), rules)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def kept_hash(text: str | None) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()
