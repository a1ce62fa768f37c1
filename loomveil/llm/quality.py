"""Quality rules: hashed n-gram log-likelihood ratio of trusted target against raw corpus.

Words and word pairs are hashed into a fixed number of buckets. One pass over all
documents counts each bucket in the raw corpus and in the trusted target; with
add-one smoothing the two count vectors are multinomials, and a bucket's weight
is the logarithm of their ratio, rounded to a multiple of 2**-20 so that scores
are sums of integers and don't depend on the order of summation. A document's
score is the sum of its n-grams' weights over their number, and one threshold,
fixed when the model is fitted, decides every document: a low quantile of the
scores of trusted documents that were kept out of the target counts, less a slack.

What meets at the driver is one pair of counts a bucket (65,536 by default) and
one score for each trusted row (`max_trusted` at most), whatever the corpus.

Nulls and odd input: a null or blank text has no n-grams, scores 0 and fails the
base rules. Without labels every weight is 0 and the threshold lets all pass.
Repeated rows are judged alike, each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomveil.llm import bytescan as bs

SCALE = 1 << 20
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


@dataclass(frozen=True)
class Rules:
    """Fixed values of the base rules, and the parameters of the likelihood ratio."""

    min_words: int = 50
    max_repeat_percent: int = 50
    buckets: int = 1 << 16
    max_trusted: int = 100_000
    #: Share of trusted documents that may score below the threshold, and slack below that.
    reject_share: float = 0.002
    slack: float = 0.2
    #: One in so many trusted documents is kept out of the target counts and fixes the threshold.
    held_out: int = 4


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # int64 by bucket, in units of 1/SCALE
    threshold: int  # in the same units


def trusted_ids(labels: DataFrame, most: int) -> DataFrame:
    """Ids of documents labelled good and not toxic: all of them, or the `most` whose hashes are least."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null")
    return good.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _buckets(t: bs.Texts, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words, then of all word pairs, and how many of each text."""
    t.prepare(lower=True)
    start, end, first = t.words()
    h = t.span(start, end)
    pairs, pair_first = bs.grams(h, first, 2)
    mask = np.uint64(buckets - 1)
    return ((bs.mix(h) & mask).astype(np.int64), first), ((pairs & mask).astype(np.int64), pair_first)


def fit(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> Model:
    """Count all documents' n-grams, twice where trusted, and fix weights and threshold."""
    n = rules.buckets
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(rules.held_out))
    ids = F.broadcast(trusted_ids(labels, rules.max_trusted).withColumn("trusted", fold != 0))
    marked = docs.select("doc_id", "text").join(ids, "doc_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"), (~F.coalesce("trusted", F.lit(True))).alias("judge"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bs.release()
        raw, target = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for batch in batches:
            flags = batch.column("trusted").to_numpy(zero_copy_only=False)
            for t in bs.slices(batch.column("text")):
                good = flags[t.first : t.first + t.n]
                for b, first in _buckets(t, n):
                    raw += np.bincount(b, minlength=n)
                    target += np.bincount(b[np.repeat(good, np.diff(first))], minlength=n)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"bucket": seen, "raw": raw[seen], "target": target[seen]})

    counts = marked.select("text", "trusted").mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.ones(n), np.ones(n)
    for row in counts.collect():  # a row for each bucket
        raw[row.bucket] += row.raw
        target[row.bucket] += row.target
    if target.sum() == n:
        return Model(np.zeros(n, np.int64), -(1 << 62))
    weights = np.rint(np.log((target / target.sum()) / (raw / raw.sum())) * SCALE).astype(np.int64)
    draft = Model(weights, 0)
    scored = score(marked.where("judge").select(F.lit(0).alias("doc_id"), "text"), draft, rules)
    got = np.sort(np.array([r.score for r in scored.where("not base_failed").select("score").collect()], np.int64))
    if not len(got):
        return Model(weights, -(1 << 62))
    return Model(weights, int(got[int(len(got) * rules.reject_share)]) - int(rules.slack * SCALE))


def score(docs: DataFrame, model: Model, rules: Rules = Rules(), carry: bool = False) -> DataFrame:
    """Base counts, base_failed, score and kept of every document; carry: the kept documents themselves instead."""
    n = rules.buckets
    weights = docs.sparkSession.sparkContext.broadcast(model.weights)
    threshold = model.threshold
    symbols = np.zeros(256, bool)
    symbols[list(b"#*$%&|<>")] = True

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            for t in bs.slices(batch.column("text")):
                t.prepare(lower=False)
                start, end, first = t.words()
                n_words = np.diff(first)
                h, own = t.span(start, end), bs.owners(first)
                solid = ~t.space[t.buf] & ((t.buf & 0xC0) != 0x80)
                n_dup, n_repeat = _dup_lines(t, start), _repeat_words(h, first, own, t.n)
                total, many = np.zeros(t.n, np.int64), np.zeros(t.n, np.int64)
                for b, bf in _buckets(t, n):
                    sums = np.concatenate([[0], np.cumsum(w[b])])
                    total += sums[bf[1:]] - sums[bf[:-1]]
                    many += np.diff(bf)
                value = total // np.maximum(many, 1)
                failed = (n_words < rules.min_words) | (100 * n_repeat > rules.max_repeat_percent * n_words)
                kept = ~failed & (value >= threshold)
                part = batch.slice(t.first, t.n)
                if carry:
                    yield part.filter(pa.array(kept))
                    continue
                counts = (n_words, t.spread(solid), t.spread(symbols[t.buf]), n_dup, n_repeat, failed, value, kept)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, counts)], ["doc_id", *COUNTS])

    if carry:
        return docs.mapInArrow(judge, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    kinds = ", ".join(f"{c} {'boolean' if c in ('base_failed', 'kept') else 'long'}" for c in COUNTS)
    return docs.select("doc_id", "text").mapInArrow(judge, f"doc_id {id_type}, {kinds}")


def _dup_lines(t: bs.Texts, start: np.ndarray) -> np.ndarray:
    """Of each text, its lines with a word that equal an earlier line."""
    ls, le, lf = t.lines()
    wordy = np.searchsorted(start, ls) < np.searchsorted(start, np.maximum(le, ls))
    own, text_lines = bs.owners(lf)[wordy], t.span(ls[wordy], le[wordy])
    keys = bs.by_text(text_lines, own)
    again = np.flatnonzero(bs.repeated(keys))
    _, first = np.unique(keys[again], return_index=True)
    n = np.bincount(own[again], minlength=t.n)
    return n - np.bincount(own[again][first], minlength=t.n)


def _repeat_words(h: np.ndarray, first: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Of each text, its words in windows of three that occur twice or more in it."""
    g, gf = bs.grams(h, first, 3)
    g_own = bs.owners(gf)
    hit = np.flatnonzero(bs.repeated(bs.by_text(g, g_own)))
    at = hit - gf[g_own[hit]] + first[g_own[hit]]
    covered = np.zeros(len(h), bool)
    for k in range(3):
        covered[at + k] = True
    return np.bincount(own[covered], minlength=n)


def filter_documents(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with all their columns."""
    return score(docs, fit(docs, labels, rules), rules, carry=True)


def judge_documents(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Fit on the corpus and its labels, then judge every document."""
    return score(docs, fit(docs, labels, rules), rules)
