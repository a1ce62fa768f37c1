"""Periodic runs of words: repeated k-gram masking, then Main-Lorentz on what survives.

A run is a stretch of consecutive words with smallest period q, at least `min_words`
long and at least `min_exponent` periods, that no neighbouring word extends.

1. Masking. A run of length l and period q overlaps itself, shifted by q, in l - q words.
   The least such overlap of any allowed run is k (5 words for the default rules), and as
   l >= 2 q every word of a run lies in a k-gram that occurs twice in the run. So words
   outside a document's repeated k-grams are in no run. What is left falls into segments;
   inside each, only k-grams that are repeated in that very segment stay, until nothing
   changes. Two copies of a passage that lie apart survive the first round only.
2. Main-Lorentz. Segments are halved again and again. A run inside a stretch that crosses
   its middle has at least half of its periods on one side of it, so one comparison of
   hashes for each side and period tells the few periods that may have a run there; binary
   search over prefix hashes then gives how far the equality reaches both ways. All
   segments of a batch are halved together, so that each level is a few array operations.
   n words cost O(n log n) comparisons and O(n) memory.
3. Of equal stretches the least period stays. Every run is compared word by word at last,
   and where prefix hashes lied it is measured again without them.

Words are compared by 64-bit hashes. Each row is judged by itself; no rows meet, and
nothing is shuffled. A task holds a batch of at most 1 MB of texts, or one longer text.

Edge cases: null, empty and blank texts have no words and no runs, and collapse to the
empty text. Repeated rows get equal results each. Columns of the caller's named runs or
collapsed are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomveil.llm import bytescan as bs
from loomveil.llm import scratch

RUN = "struct<start: bigint, length: bigint, period: bigint>"


@dataclass(frozen=True)
class RunRules:
    min_words: int = 6
    min_exponent: int = 4

    def __post_init__(self):
        if self.min_exponent < 2 or self.min_words < 2:
            raise ValueError("a run has two words and two periods at least")

    @property
    def overlap(self) -> int:
        """The least overlap of a run with itself, shifted by its period."""
        return min(max(self.min_words, self.min_exponent * q) - q for q in range(1, self.min_words + 1))


def segments(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words that k-grams repeated inside them cover."""
    g, gf = bs.grams(h, first, k)
    own = bs.owners(gf)
    at = np.arange(len(g)) - gf[own] + first[own]  # each gram's first word
    edge = np.zeros(len(h) + 1, bool)
    edge[first] = True
    while True:
        stay = bs.repeated(bs.by_text(g, own))
        settled = bool(stay.all())
        g, at = g[stay], at[stay]
        step = np.zeros(len(h) + 1, np.int32)
        np.add.at(step, at, 1)
        np.add.at(step, at + k, -1)
        covered = np.cumsum(step[:-1]) > 0
        begins, ends = covered.copy(), covered.copy()
        begins[1:] &= ~covered[:-1] | edge[1:-1]
        ends[:-1] &= ~covered[1:] | edge[1:-1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        if settled:
            return start, end
        own = np.searchsorted(start, at, side="right") - 1


def runs_of(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, rules: RunRules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of all runs inside the segments from lo to hi, by start and period."""
    powers, inverse = bs._powers(len(h))
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(bs.mix(h) * powers[: len(h)])])

    def same(i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from i and from j are equal."""
        return (prefix[i + n] - prefix[i]) * inverse[i] == (prefix[j + n] - prefix[j]) * inverse[j]

    def reach(i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words, at most `most`, are equal from i and j onwards, or before them."""
        least = np.zeros(len(i), np.int64)
        most = most.copy()
        while (least < most).any():
            n = (least + most + 1) >> 1
            ok = same(i - n, j - n, n) if back else same(i, j, n)
            least, most = np.where(ok, n, least), np.where(ok, most, n - 1)
        return least

    exponent, shortest = rules.min_exponent, rules.min_words
    found: list[tuple[np.ndarray, ...]] = []
    left, right, seg = lo, hi, np.arange(len(lo))
    while len(left):
        long = right - left >= max(shortest, exponent)
        left, right, seg = left[long], right[long], seg[long]
        middle, most = (left + right) >> 1, (right - left) // exponent
        node = np.repeat(np.arange(len(left)), most)
        q = np.arange(len(node)) - np.repeat(np.cumsum(most) - most, most) + 1
        m, a, b = middle[node], lo[seg[node]], hi[seg[node]]
        t = (exponent - 2) * q // 2  # so many words on one side of the middle equal those a period further
        on = np.flatnonzero(m + q + t <= b)
        on = on[same(m[on], m[on] + q[on], t[on])]
        off = np.flatnonzero(m - q - t >= a)
        off = off[same((m - q - t)[off], (m - t)[off], t[off])]
        i, which = np.concatenate([m[on], (m - q - t)[off]]), np.concatenate([on, off])
        q, a, b = q[which], a[which], b[which]
        s = i - reach(i, i + q, i - a, back=True)
        e = i + q + reach(i, i + q, b - i - q, back=False)
        good = e - s >= np.maximum(shortest, exponent * q)
        found.append(tuple(x[good] for x in (s, e, q, i, a, b)))
        left, right, seg = np.concatenate([left, middle]), np.concatenate([middle, right]), np.concatenate([seg, seg])
    if not found:
        return (np.zeros(0, np.int64),) * 3
    s, e, q, i, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    s, e, q, i, a, b = _least_periods(s, e, q, i, a, b)
    wrong = [k for k in range(len(s)) if not np.array_equal(h[s[k] : e[k] - q[k]], h[s[k] + q[k] : e[k]])]
    if wrong:
        for k in wrong:
            s[k], e[k] = _measured(h, int(i[k]), int(q[k]), int(a[k]), int(b[k]))
        good = e - s >= np.maximum(shortest, exponent * q)
        s, e, q = _least_periods(s[good], e[good], q[good])
    order = np.lexsort([q, s])
    return s[order], e[order], q[order]


def _least_periods(s: np.ndarray, e: np.ndarray, q: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of equal stretches that with the least period: the others' periods are its multiples."""
    order = np.lexsort([q, e, s])
    out = [x[order] for x in (s, e, q, *more)]
    new = np.ones(len(order), bool)
    new[1:] = (out[0][1:] != out[0][:-1]) | (out[1][1:] != out[1][:-1])
    return tuple(x[new] for x in out)


def _measured(h: np.ndarray, i: int, q: int, lo: int, hi: int) -> tuple[int, int]:
    """The stretch with period q around word i, without prefix hashes."""
    differ = np.flatnonzero(h[lo : hi - q] != h[lo + q : hi]) + lo
    k = int(np.searchsorted(differ, i))
    return (int(differ[k - 1]) + 1 if k else lo), (int(differ[k]) if k < len(differ) else hi - q) + q


def find_runs(docs: DataFrame, rules: RunRules = RunRules()) -> DataFrame:
    """`docs` (text, ...) with `runs`, an array of (start, length, period) in words by start and period, and `collapsed`.

    `collapsed` is the text's words without those that a run holds after its first period, joined by one space.
    """
    names = [c for c in docs.columns if c.lower() not in ("runs", "collapsed")]
    k = rules.overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in bs.slices(batch.column("text")):
                t.prepare(lower=False)
                start, end, first = t.words()
                h = t.span(start, end)
                s, e, q = runs_of(h, *segments(h, first, k), rules)
                step = np.zeros(len(h) + 1, np.int32)
                np.add.at(step, s + q, 1)
                np.add.at(step, e, -1)
                buf, off, _ = bs.joined(t, start, end, first, np.cumsum(step[:-1]) == 0)
                of = np.searchsorted(first, s, side="right") - 1
                fields = [pa.array(x.astype(np.int64)) for x in (s - first[of], e - s, q)]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(s, first).astype(np.int32)), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                part = batch.slice(t.first, t.n)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), lists, bs.as_strings(buf, off).cast(pa.string())], [*names, "runs", "collapsed"])

    held = docs.select(*names)
    return held.mapInArrow(run, f"{scratch.ddl(held.schema)}, runs array<{RUN}>, collapsed string")


def strongest(runs: str = "runs") -> Column:
    """The run with the greatest exponent; of equal ones the first by start and period. Null without runs."""
    none = F.lit(None).cast(RUN)
    better = lambda x, y: y["length"] * x["period"] > x["length"] * y["period"]
    return F.aggregate(runs, none, lambda best, x: F.when(best.isNull() | better(best, x), x).otherwise(best))


def with_periods(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text, ...) in which one document of ten, by the checksum of its id, turns periodic at some word.

    Its text becomes its words joined by one space, each word i from a on being word a + (i - a) % p. For tests at scale.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    held = docs.withColumns({"__w": words, "__g": F.floor(h / 10)}).withColumn("__n", F.size("__w"))
    held = held.withColumn("__a", F.when(F.col("__n") > 0, F.col("__g") % F.col("__n")).cast("int"))
    held = held.withColumn("__p", F.expr("cast(1 + (__n - __a) div (3 + __g % 8) as int)"))
    tail = F.expr("slice(flatten(array_repeat(slice(__w, __a + 1, __p), cast((__n - __a - 1) div __p + 1 as int))), 1, __n - __a)")
    turned = F.array_join(F.concat(F.expr("slice(__w, 1, __a)"), tail), " ")
    return held.withColumn("text", F.when(F.col("__a").isNotNull(), turned).otherwise(F.col("text"))).select(*docs.columns)


def digest(docs: DataFrame, rules: RunRules = RunRules()) -> DataFrame:
    """doc_id, n_runs, the strongest run, and SHA-256 of all runs and of the collapsed text."""
    found = find_runs(docs.select("doc_id", "text"), rules).withColumn("best", strongest())
    line = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    every = F.when(F.size("runs") > 0, F.concat(line, F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(every.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
