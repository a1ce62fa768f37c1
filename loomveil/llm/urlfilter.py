"""URL filters: exact membership by a cascade of Bloom filters.

Level 0 encodes the listed keys. Over the corpus's complete key universe, the
unlisted keys that pass it are its false positives; level 1 encodes those; level 2
encodes the listed keys that pass level 1, and so on until no key errs. A key's
answer is the parity of the first level that it fails, and that is exact for every
key of the universe, so pages are judged where they are read, without a join.

Keys that a rule could name are, for each URL, its host and parent domains joined
with its path's prefixes, of only as many labels and characters as some listed
rule has; one array expression makes them, however many such shapes there are. Filters
tell keys apart by 64 bits of one hash; keys that no level can tell apart (two with one
hash, one of them listed) are carried verbatim, as strings, and compared as such.

Level 0 is sized for as many false positives as there are listed keys, so the
cascade takes about n * log2(universe / n) bits. Its size is measured against
`max_bytes` before it is sent out. Beyond it the keys are dealt to shards by their hash, each
small enough for a cascade of its own; that is built over its shard's keys alone, asked where
they are read, and the pages then gather their answers, so the list's size has no limit.

Edge cases: a null URL or one without "://" has an empty host and path and no
keys. Repeated pages are judged each for itself. Rules given twice must agree.
Of two rules of one length the one with more of the host wins. Further columns of the
pages, whatever their names, are not looked at.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomveil.llm import bloom, scratch
from loomveil.llm import bytescan as bs


#: Between the host and the path of a key: neither of a URL's has it, so a key has it once.
BETWEEN = "?"
#: Shards get a cascade of at least so many bytes, however small the bound is.
LEAST_SHARD = 1 << 20
#: Parts over which the rows of one shard are spread.
SPREAD = 64


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    action: str  # "allow" or "block"

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column, both empty without "://"."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(F.col(url), pattern, k), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def candidate_keys(rules: DataFrame, host: str = "host", path: str = "path") -> Column:
    """Keys of a URL that some rule could name, longest first, as array<struct<size, labels, key, hash>>."""
    labels = (F.length("host") - F.length(F.translate("host", ".", "")) + 1).alias("labels")
    by_labels = rules.groupBy(labels).agg(F.collect_set(F.length("path")).alias("chars")).collect()  # as many rows as hosts have labels
    if not by_labels:
        return F.array().cast("array<struct<size:int,labels:int,key:string,hash:bigint>>")
    lengths = F.create_map(*(x for r in by_labels for x in (F.lit(r.labels), F.lit(sorted(r.chars)))))
    h, p = F.col(host), F.col(path)
    most = F.least(F.length(h) - F.length(F.translate(h, ".", "")) + 1, F.lit(max(r.labels for r in by_labels)))

    def of_domain(n: Column) -> Column:
        domain = F.call_function("substring_index", h, F.lit("."), -n)
        chars = F.filter(F.coalesce(F.try_element_at(lengths, n), F.array().cast("array<int>")), lambda k: k <= F.length(p))

        def one(k: Column) -> Column:
            key = F.concat(domain, F.lit(BETWEEN), F.substring(p, F.lit(1), k))
            return F.struct((F.length(domain) + k).alias("size"), n.alias("labels"), key.alias("key"), F.xxhash64(key).alias("hash"))

        return F.transform(chars, one)

    found = F.flatten(F.transform(F.sequence(F.lit(1), most), of_domain))
    return F.reverse(F.array_sort(F.when(h != "", found).otherwise(F.slice(found, 1, 0))))


class Cascade:
    """Levels of Bloom filters; answers are exact for every key of the universe that built it."""

    def __init__(self, levels: list[bloom.Filter], verbatim: dict[int, dict[str, bool]]):
        self.levels, self.verbatim = levels, verbatim

    @property
    def size(self) -> int:
        return sum(len(bits) for bits, _, _ in self.levels) + sum(16 + len(k) for ks in self.verbatim.values() for k in ks)

    def contains(self, hashes: np.ndarray, keys: pa.Array | None = None) -> np.ndarray:
        """keys: the keys themselves, looked at only where their hash is one of those carried verbatim."""
        out, left = np.zeros(len(hashes), bool), np.arange(len(hashes))
        for level, (bits, m, k) in enumerate(self.levels):
            on = bloom.probe(bits, m, k, level, hashes[left])
            out[left[~on]] = level % 2 == 1
            left = left[on]
        out[left] = len(self.levels) % 2 == 1
        if self.verbatim and keys is not None:
            for i in np.flatnonzero(np.isin(hashes.view(np.int64), np.array(list(self.verbatim), np.int64))).tolist():
                out[i] = self.verbatim[int(hashes.view(np.int64)[i])].get(keys[i].as_py(), bool(out[i]))
        return out


def build_cascade(listed: DataFrame, universe: DataFrame, max_levels: int = 24, max_bytes: int = 64 << 20) -> Cascade | None:
    """A cascade of `listed` (key, hash), exact over `universe` (key, hash); None if it would exceed max_bytes."""
    spark = listed.sparkSession
    inside = scratch.table(listed.select("key", "hash").distinct(), "cascade-listed")
    n = inside.count()
    total = max(universe.agg(F.approx_count_distinct("hash")).first()[0], n, 1)
    rate = min(0.5, max(n, 1) / (total * math.sqrt(2)))
    if bloom.bits_needed(n, rate) > 8 * max_bytes:
        return None
    levels: list[bloom.Filter] = []
    outside: DataFrame | None = None  # false positives so far; the whole universe at first
    for level in range(max_levels):
        own, other = (inside, outside) if level % 2 == 0 else (outside, inside)
        levels.append(bloom.build(own, n, rate if level == 0 else 0.5, level))
        if sum(len(x[0]) for x in levels) > max_bytes:
            return None
        held = spark.sparkContext.broadcast(levels[-1])

        def passing(batches: Iterator[pa.RecordBatch], held=held, level=level) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                on = bloom.probe(*held.value, level, batch.column("hash").to_numpy().view(np.uint64))
                yield batch.filter(pa.array(on))

        source = universe.select("key", "hash") if other is None else other
        passed = source.mapInArrow(passing, "key string, hash long")
        if level == 0:
            # the few that pass, less the listed ones
            passed = passed.distinct().join(inside.select("key"), "key", "left_anti")
        passed = scratch.table(passed, "cascade-passed")
        n = passed.count()
        if n == 0:
            return Cascade(levels, {})
        if level % 2 == 0:
            outside = passed
        else:
            inside = passed
    verbatim: dict[int, dict[str, bool]] = {}
    for keys, is_listed in ((outside, False), (inside, True)):  # undecided after all levels: a handful
        for r in keys.select("key", "hash").collect():
            verbatim.setdefault(r.hash, {})[r.key] = is_listed
    return Cascade(levels, verbatim)


def judge_urls(pages: DataFrame, rules: Iterable[Rule] | DataFrame, max_bytes: int = 64 << 20, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every page (page_id, url, ...)."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([(r.host, r.path, r.action) for r in rules], "host string, path string, action string")
    listed = rules.select("host", "path", "action", F.concat("host", F.lit(BETWEEN), "path").alias("key")).withColumn("hash", F.xxhash64("key"))
    host, path = host_and_path()
    keyed = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("keys", candidate_keys(rules))
    universe = keyed.select(F.explode("keys").alias("k")).select("k.key", "k.hash")
    cascade = build_cascade(listed, universe, max_bytes=max_bytes)
    # which listed keys block: a second cascade, whose universe is the list
    blocking = build_cascade(listed.where("action = 'block'"), listed, max_bytes=max_bytes) if cascade else None
    if cascade is None or blocking is None:
        return _judge_in_shards(keyed, listed, default, max_bytes)
    plain = [(c.levels, c.verbatim) for c in (cascade, blocking)]
    held, token = spark.sparkContext.broadcast(plain), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = bs.process_store()
        if kept.get("cascade-of") != token:
            kept["cascade-of"], kept["cascade"] = token, [Cascade(*x) for x in held.value]
        inner, block = kept["cascade"]
        for batch in batches:
            lists = batch.column("keys")
            first, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
            h = flat.field("hash").to_numpy().view(np.uint64)
            keys = flat.field("key")
            on = np.flatnonzero(inner.contains(h, keys))
            # the first listed key of each page
            at = np.searchsorted(on, first[:-1])
            has = (at < len(on)) & (on[np.minimum(at, len(on) - 1)] < first[1:]) if len(on) else np.zeros(len(first) - 1, bool)
            picked = on[at[has]] if len(on) else np.zeros(0, np.int64)
            verdict = np.full(len(has), default, object)
            verdict[has] = np.where(block.contains(h[picked], keys.take(pa.array(picked))), "block", "allow")
            rule = np.full(len(has), None, object)
            rule[has] = [x.replace(BETWEEN, "") for x in keys.take(pa.array(picked)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    id_type = pages.schema["page_id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"page_id {id_type}, host string, path string, rule string, verdict string")


def _judge_in_shards(keyed: DataFrame, listed: DataFrame, default: str, max_bytes: int, shards: int = 0) -> DataFrame:
    """For lists whose cascade exceeds the size bound: one cascade for each shard of the keys, asked where that shard's keys are read."""
    spark, bound = keyed.sparkSession, max(max_bytes, LEAST_SHARD)
    rows = scratch.table(keyed.withColumn("row", F.expr("uuid()")), "url-rows")
    listed = scratch.table(listed.select("key", "hash", "action").distinct(), "url-list")
    keys = rows.select("row", F.posexplode("keys").alias("pos", "k")).select("row", "pos", "k.key", "k.hash")
    if not shards:
        n = max(listed.count(), 1)
        total = max(keys.agg(F.approx_count_distinct("hash")).first()[0], n)
        shards = max(2, math.ceil(bloom.bits_needed(n, min(0.5, n / (total * math.sqrt(2)))) / 4 / bound))
    shard = F.pmod("hash", F.lit(shards)).cast("int").alias("shard")
    # dealt by shard and row, so that a key of many pages spreads; a shard's keys are folders of their own
    dealt = keys.select("*", shard).repartition("shard", F.pmod(F.xxhash64("row"), F.lit(SPREAD)))
    path = scratch.new_path(spark, "url-keys")
    dealt.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    stored = spark.read.schema(dealt.schema).parquet(path)
    found: DataFrame | None = None
    for k in range(shards):
        own, names = stored.where(F.col("shard") == k), listed.where(shard == k)
        inner = build_cascade(names, own, max_bytes=bound)
        block = build_cascade(names.where("action = 'block'"), names, max_bytes=bound) if inner else None
        if inner is None or block is None:
            return _judge_in_shards(keyed, listed, default, max_bytes, 2 * shards)
        held = spark.sparkContext.broadcast([(c.levels, c.verbatim) for c in (inner, block)])

        def ask(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            inner, block = (Cascade(*x) for x in held.value)
            for batch in batches:
                on = inner.contains(batch.column("hash").to_numpy().view(np.uint64), batch.column("key"))
                hit = batch.filter(pa.array(on))
                blocks = block.contains(hit.column("hash").to_numpy().view(np.uint64), hit.column("key"))
                yield pa.RecordBatch.from_arrays([hit.column("row"), hit.column("pos"), hit.column("key"), pa.array(blocks)], ["row", "pos", "key", "blocks"])

        hits = scratch.table(own.select("row", "pos", "key", "hash").mapInArrow(ask, "row string, pos int, key string, blocks boolean"), "url-hits")
        held.destroy()
        found = hits if found is None else found.unionByName(hits)
    best = found.groupBy("row").agg(F.min_by(F.struct("key", "blocks"), "pos").alias("b"))
    verdict = F.when(F.col("b").isNull(), F.lit(default)).when(F.col("b.blocks"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(best, "row", "left").select("page_id", "host", "path", F.replace("b.key", F.lit(BETWEEN), F.lit("")).alias("rule"), verdict.alias("verdict"))
