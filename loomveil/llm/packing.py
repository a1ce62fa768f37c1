"""Best-fit packing with vector capacities: tokens, documents and attention cost.

Tokenization: a document is its token ids followed by one end id; ids are those of the
given tokenizer file by `tokenizers` without special tokens added, so strings of the
file's added tokens, such as <|endoftext|>, are those tokens. Texts are cut at every
blank that precedes a character which is no white space, where the tokenizer's own
splitting has a boundary too, and around the added tokens' strings; pieces of text are
looked up by hash in a bounded table of the worker, and only unknown ones are encoded.
Documents longer than a sequence are cut
into full pieces, the first of which may be shorter.

Packing: a sequence has residual capacities of tokens, documents and attention
cost (a piece of n tokens costs n * n). A piece is known to the packer only by its
length, so the whole corpus is a histogram of at most `capacity` counts, which is
what meets at the driver at any size. Sequences are filled one pattern at a time:
the pattern opens with the longest length left and then takes, among lengths that
fit under every constraint, the one with the best score against the residual
vector, either the weighted dot product or the least norm of what would be left
(both keep a length as long as it fits). A pattern is repeated as often as the
counts allow at once, so the number of steps depends on the number of lengths and
not on the corpus.

With the default capacities only tokens can bind: a sequence of 2048 tokens holds at most
2048 documents, and their squares add up to at most 2048 * 2048. The other two weigh in
the score then; with smaller ones every constraint holds for every sequence.

Dealing: piece number k of a length goes to the k-th place that the patterns hold
for it. Ranks come from counts by (partition, length) and running sums, so no
length, however frequent, meets in one task.

Edge cases: null and empty texts are a piece of one token. Repeated rows are
packed each for itself. An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from loomveil.llm import bytescan as bs
from loomveil.llm import scratch


#: Pieces of text that are encoded at once.
ENCODED = 8192


@dataclass(frozen=True)
class PackRules:
    capacity: int = 2048
    max_documents: int = 2048
    max_attention: int = 2048 * 2048
    end_id: int = 0
    #: "norm" takes what leaves the least weighted residual norm, "dot" the largest weighted dot product.
    score: str = "norm"
    weights: tuple[float, float, float] = (1.0, 0.05, 0.25)
    table_entries: int = 1_000_000


# --- tokens ------------------------------------------------------------------------------


def load_encoder(tokenizer_json: str) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Ids of texts, one after another, and how many each has, by the tokenizer of a file, special tokens not added.

    Texts are encoded as one, with an added token's string between them: the tokenizer takes what lies between two of those
    by itself, which is tried here on some texts. Without such a token, or where a text holds it, each is encoded alone.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(tokenizer_json)
    made.no_truncation()
    made.no_padding()
    between = next(iter(added_strings(tokenizer_json)), None)
    mark = made.token_to_id(between) if between else None

    def alone(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [x.ids for x in made.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter((x for ids in got for x in ids), np.uint32), np.fromiter(map(len, got), np.int64, len(got))

    def together(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(made.encode_batch_fast([between.join(texts)], add_special_tokens=False)[0].ids, np.uint32)
        at = np.flatnonzero(ids == mark)
        if len(at) != len(texts) - 1:
            return alone(texts)
        return np.delete(ids, at), np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1

    some = ["a", " b", "c d", "\n x", "", " é1", "\t", "."]
    fits = mark is not None and all(np.array_equal(x, y) for x, y in zip(alone(some), together(some), strict=True))
    return together if fits else alone


def added_strings(tokenizer_json: str) -> list[str]:
    """The strings of a tokenizer file's added tokens."""
    tokens = json.loads(tokenizer_json).get("added_tokens", [])
    if any(t.get(k) for t in tokens for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that depend on the characters around them are not supported")
    return [t["content"] for t in tokens]


class TokenTable:
    """Ids of text pieces by their hash, sorted; at most `most` pieces. No piece crosses a string in `added`."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int, added: list[str]):
        self.encode, self.most = encode, most
        longest = sorted((x.encode() for x in added), key=len, reverse=True)
        self.pattern = re.compile(b"|".join(map(re.escape, longest))) if longest else None
        self.clear()

    def clear(self) -> None:
        self.keys, self.begin, self.count, self.ids, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.uint32), 0

    def _append(self, ids: np.ndarray) -> None:
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(ids), len(self.ids)), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def look_up(self, h: np.ndarray, t: bs.Texts, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each piece's ids begin in self.ids, and how many there are."""
        order = np.argsort(h)
        s = h[order]
        head = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
        keys, group = s[head], np.cumsum(head) - 1
        if len(self.keys) + len(keys) > self.most:
            self.clear()
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            example = order[head][new]
            raw = t.buf.tobytes()
            count = np.zeros(len(example), np.int64)
            for k in range(0, len(example), ENCODED):  # an encoding is many times larger than its ids
                part = example[k : k + ENCODED]
                ids, count[k : k + ENCODED] = self.encode([raw[a:b].decode() for a, b in zip(start[part].tolist(), end[part].tolist(), strict=True)])
                self._append(ids)
            begin = self.used - np.cumsum(count[::-1])[::-1]
            place = np.searchsorted(self.keys, keys[new])
            self.keys, self.begin, self.count = np.insert(self.keys, place, keys[new]), np.insert(self.begin, place, begin), np.insert(self.count, place, count)
            at = np.searchsorted(self.keys, keys)
        where = np.empty(len(h), np.int64)
        where[order] = at[group]
        return self.begin[where], self.count[where]


def _added_spans(t: bs.Texts, pattern: re.Pattern[bytes] | None) -> list[tuple[int, int]]:
    """Starts and ends of the added tokens' strings; none crosses texts."""
    out: list[tuple[int, int]] = []
    raw, at = t.buf.tobytes() if pattern else b"", 0
    while pattern and (m := pattern.search(raw, at)):
        upto = int(t.off[np.searchsorted(t.off, m.start(), side="right")])
        m = pattern.search(raw, m.start(), upto)
        at = m.end() if m else upto
        if m:
            out.append(m.span())
    return out


def _chunks(t: bs.Texts, pattern: re.Pattern[bytes] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of text, cut at each blank before a character that is no white space, and around matches of `pattern`.

    White space outside ASCII is at most three bytes and starts with C2, E1, E2 or
    E3: no cut is made before those bytes, which costs a few longer pieces.
    """
    b = t.buf
    solid = ~t.space[b]
    solid &= ~np.isin(b, np.array([0xC2, 0xE1, 0xE2, 0xE3, 0x1C, 0x1D, 0x1E, 0x1F], np.uint8))
    cut = np.zeros(len(b), bool)
    cut[:-1] = (b[:-1] == 0x20) & solid[1:]
    last = t.off[1:][np.diff(t.off) > 0] - 1
    cut[last] = False  # the next byte belongs to another text
    added = _added_spans(t, pattern)
    cut[[a - 1 for a, _ in added if a]] = False  # that blank is the last of its stretch of text
    cut[t.off[:-1][np.diff(t.off) > 0]] = True
    cut[[x for span in added for x in span if x < len(b)]] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], len(b)) if len(start) else start
    return start, end, np.searchsorted(start, t.off)


def token_pieces(docs: DataFrame, tokenizer_path: str, rules: PackRules = PackRules()) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document.

    tokenizer_path: a file on the driver; its contents are broadcast.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    token, cap, end_id, most = uuid.uuid4().hex, rules.capacity, rules.end_id, rules.table_entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bs.release("tokens", "tokens-of")
        kept = bs.process_store()
        if kept.get("tokens-of") != token:
            kept["tokens-of"], kept["tokens"] = token, TokenTable(load_encoder(vocabulary.value), most, added_strings(vocabulary.value))
        table: TokenTable = kept["tokens"]
        for batch in batches:
            ids = batch.column("doc_id")
            for t in bs.slices(batch.column("text")):
                start, end, first = _chunks(t, table.pattern)
                t.prepare(lower=False)
                begin, count = table.look_up(t.span(start, end), t, start, end)
                # all ids of the slice in a row, each document's followed by the end id
                upto = np.concatenate([[0], np.cumsum(count)])
                own = np.repeat(np.arange(t.n), np.diff(first))
                place = upto[:-1] + own
                flat = np.full(int(upto[-1]) + t.n, end_id, np.uint32)
                run_of = np.arange(int(upto[-1])) - np.repeat(upto[:-1], count)
                flat[np.repeat(place, count) + run_of] = table.ids[np.repeat(begin, count) + run_of]
                size = upto[first[1:]] - upto[first[:-1]] + 1
                doc_at = np.cumsum(size) - size
                rows: list[tuple[int, int, int, int, int]] = []
                for i, (a, n) in enumerate(zip(doc_at.tolist(), size.tolist(), strict=True)):
                    at, piece, length = 0, 0, (n - 1) % cap + 1
                    while at < n:
                        rows.append((i, piece, at, length, zlib.crc32(flat[a + at : a + at + length].tobytes())))
                        at, piece, length = at + length, piece + 1, cap
                i, piece, at, length, crc = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(t.first, t.n).take(pa.array(i)), pa.array(piece, pa.int32()), pa.array(at, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


# --- patterns ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Placement:
    """Places of one length in `repeat` sequences from `sequence` on: `many` to a sequence, the first at `offset`."""

    length: int
    rank: int  # of the first piece of this length that goes here
    many: int
    repeat: int
    sequence: int
    offset: int


def plan_patterns(counts: dict[int, int], rules: PackRules = PackRules()) -> list[Placement]:
    """Fill sequences pattern by pattern until every piece of the histogram has a place."""
    limit = np.array([rules.capacity, rules.max_documents, rules.max_attention], np.int64)
    lengths = np.array(sorted(counts), np.int64)
    left = np.array([counts[int(n)] for n in lengths], np.int64)
    demand = np.stack([lengths, np.ones_like(lengths), lengths * lengths], 1)
    if (demand > limit).any():
        raise ValueError("a piece exceeds the capacity of an empty sequence")
    weight, used = np.array(rules.weights), np.zeros(len(lengths), np.int64)
    out: list[Placement] = []
    sequence = 0
    while left.any():
        residual, pattern = limit.copy(), np.zeros(len(lengths), np.int64)
        pick = int(np.flatnonzero(left)[-1])
        order: list[int] = []
        while True:
            # as many as fit under every constraint and are there
            many = int(min(left[pick] - pattern[pick], (residual // demand[pick]).min()))
            if pattern[pick] == 0:
                order.append(pick)
            pattern[pick] += many
            residual = residual - demand[pick] * many
            fits = (left > pattern) & (demand <= residual).all(axis=1)
            if not fits.any():
                break
            at = np.flatnonzero(fits)
            share = demand[at] / limit
            if rules.score == "dot":
                value = (share * (residual / limit) * weight).sum(axis=1)
            else:
                value = -(weight * ((residual - demand[at]) / limit) ** 2).sum(axis=1)
            pick = int(at[np.flatnonzero(value == value.max())[-1]])
        repeat = int((left[order] // pattern[order]).min())
        offset = 0
        for k in order:
            out.append(Placement(int(lengths[k]), int(used[k]), int(pattern[k]), repeat, sequence, offset))
            offset += int(lengths[k] * pattern[k])
        left -= pattern * repeat
        used += pattern * repeat
        sequence += repeat
    return out


def pack(pieces: DataFrame, rules: PackRules = PackRules()) -> DataFrame:
    """`pieces` (doc_id, piece, length, ...) with sequence_id and offset."""
    dealt = scratch.table(pieces.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()), "pack-pieces")
    held = dealt.groupBy("__part", "length").agg(F.count("*").alias("n"))
    before = held.select("__part", "length", "n", (F.sum("n").over(Window.partitionBy("length").orderBy("__part")) - F.col("n")).alias("__before"))
    histogram = held.groupBy("length").agg(F.sum("n").alias("n"))
    plan = plan_patterns({r.length: r.n for r in histogram.collect()}, rules)
    by: dict[int, list[Placement]] = {}
    for p in plan:
        by.setdefault(p.length, []).append(p)
    plain = {n: np.array([(p.rank, p.many, p.sequence, p.offset) for p in ps], np.int64) for n, ps in by.items()}
    places = dealt.sparkSession.sparkContext.broadcast(plain)
    ranked = dealt.withColumn("__n", F.row_number().over(Window.partitionBy("__part", "length").orderBy("__row")) - 1)
    ranked = ranked.join(before.select("__part", "length", "__before"), ["__part", "length"]).withColumn("__rank", F.col("__before") + F.col("__n")).select(*pieces.columns, "__rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = places.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts):
                n = int(length[rows[0]])
                p = of[n][np.searchsorted(of[n][:, 0], rank[rows], side="right") - 1]
                k = rank[rows] - p[:, 0]
                sequence[rows], offset[rows] = p[:, 2] + k // p[:, 1], p[:, 3] + k % p[:, 1] * n
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, rules: PackRules = PackRules()) -> DataFrame:
    """Tokenize, cut and pack all documents."""
    return pack(token_pieces(docs, tokenizer_path, rules), rules)
