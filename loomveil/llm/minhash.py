"""Near-duplicate detection by fast similarity sketching, banding and exact verification.

Sketch: `bins` coordinates. In round r of the first `bins` rounds every shingle of
a document is thrown into one hashed bin with the value (r, hash); in the second
`bins` rounds all shingles go to bin r - bins, so every coordinate of a non-empty
document fills, mostly within a few rounds. Each coordinate keeps its least value.
Two documents' coordinates agree with the probability of their Jaccard similarity,
and the number of agreements is concentrated at least as well as with independent
MinHash values.

Candidates: documents with equal shingle sets form one class, and only classes go
on. A class has `bins // rows` band keys; a pair at similarity 0.75 shares none of
51 bands of 5 rows with probability 1.0e-6.

Links, without all pairs of a bucket:
1. a bucket's least class is its centre; each class is paired with the one centre that
   it shares most bands with. Pairs whose sketches agree in at least `least_agree` of 256
   coordinates (a true link agrees in fewer with probability 2e-6) are checked exactly;
2. checked links form trees; their roots are found by pointer jumping;
3. in buckets where several roots remain, the classes outside the bucket's most common
   root are compared with all its classes by their sketches, in blocks of at most `block`
   of either: work and copies grow with the number of those outside, and a family whose
   members are near its centre costs nothing here. What agrees in `least_agree`
   coordinates stays together as a cluster; a task emits each class's cluster, no pairs;
   clusters are dealt in blocks of about `block_shingles` shingles, and again those
   outside a cluster's most common root meet all others, by their full sets. One link for
   each two trees leaves the task. A cluster of more than `most_blocks` blocks is dealt
   bucket by bucket instead: no bucket is capped and no link between trees is lost.
4. merged roots are components by large-star/small-star rounds, in which ends of many
   links are split.

Exact checks stream: texts are sorted behind their centre's text, and a task holds
one centre's shingles at a time; hot centres are salted. What is compared are the
full sets of 64-bit shingle hashes. Texts are fetched by a hash of (doc_id, text) of one
row of each class that is to be checked; all other rows fall out at the scan, by a Bloom
filter of those hashes as long as it has a bounded size, and a text's digest tells it
from one with an equal hash.

Edge cases: null, empty and blank texts have no shingles and link with nothing.
A null doc_id is never the smallest; a component of null ids only has a null id.
Rows that share an id, or have none, are rows of their own. Repeated rows get equal
results each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomveil.llm import bloom, scratch
from loomveil.llm import bytescan as bs


@dataclass(frozen=True)
class NearRules:
    words: int = 5
    percent: int = 75
    bins: int = 256
    rows: int = 5
    least_agree: int = 160
    block: int = 2048
    rows_per_salt: int = 2000
    block_shingles: int = 1 << 17
    most_blocks: int = 50
    #: Most tasks for what is written on the way; by default as many as the table of sketches has, or a few for each core.
    tasks: int | None = None


# --- shingles and sketches ---------------------------------------------------------------


def shingle_sets(t: bs.Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and where each begins."""
    t.prepare(lower=True)
    start, end, first = t.words()
    h = t.span(start, end)
    g, gf = bs.grams(h, first, n)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):  # the whole sequence is the one shingle
        whole = np.zeros(len(short), np.uint64)
        for k, i in enumerate(short):
            x = h[first[i] : first[i + 1]]
            v = x[:1].copy()
            for w in x[1:]:
                v = v * bs._GRAM + w
            whole[k] = bs.mix(v ^ bs.seeds(len(x), 5)[-1:])[0]
        own = np.concatenate([bs.owners(gf), short])
        g = np.concatenate([g, whole])
    else:
        own = bs.owners(gf)
    order = np.lexsort([g, own]) if len(short) else _order(g, gf)
    g, own = g[order], own[order]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (g[1:] != g[:-1])]) if len(g) else np.zeros(0, bool)
    g, own = g[new], own[new]
    return g, np.searchsorted(own, np.arange(t.n + 1))


def _order(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.empty(len(g), np.int64)
    for a, b in zip(first[:-1], first[1:], strict=True):
        out[a:b] = np.argsort(g[a:b])
        out[a:b] += a
    return out


def sketches(g: np.ndarray, first: np.ndarray, bins: int) -> np.ndarray:
    """Fast similarity sketches, a row for each text; rows of empty texts are meaningless."""
    n = len(first) - 1
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((n, bins), empty, np.uint64)
    flat, seed, mask = out.reshape(-1), bs.seeds(bins, 3), np.uint64(bins - 1)
    active = np.flatnonzero(np.diff(first) > 0)
    own = bs.owners(first)
    el, at = g, own * bins
    for r in range(2 * bins):
        if not len(active):
            break
        x = bs.mix(el ^ seed[r % bins])
        where = at + (x & mask).astype(np.int64) if r < bins else at + (r - bins)
        np.minimum.at(flat, where, (x >> np.uint64(10)) | np.uint64(r) << np.uint64(54))
        if r < 4 or r % 4 == 0 or r >= bins:
            open_ = (out[active] == empty).any(axis=1)
            if not open_.all():
                active = active[open_]
                on = np.zeros(n, bool)
                on[active] = True
                sel = on[own]
                own_, el = own[sel], g[sel]
                at = own_ * bins
    return out


def row_key(docs: DataFrame) -> Column:
    """A hash of a row's doc_id and text; only repeated rows, and some rows by chance, share it."""
    return F.xxhash64(docs["doc_id"], docs["text"])


def sketch_documents(docs: DataFrame, rules: NearRules) -> DataFrame:
    """doc_id, rid, n_shingles, node (128-bit digest of the set), bands and 8-bit signature."""
    n, bins, rows = rules.words, rules.bins, rules.rows
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bs.release()
        bands = bins // rows
        tag = bs.seeds(bands, 4)
        for batch in batches:
            for t in bs.slices(batch.column("text")):
                g, first = shingle_sets(t, n)
                size = np.diff(first)
                node = [hashlib.blake2b(g[first[i] : first[i + 1]].tobytes(), digest_size=16).digest() if size[i] else None for i in range(t.n)]
                s = sketches(g, first, bins)
                part = s[:, : bands * rows].reshape(t.n, bands, rows)
                key = np.broadcast_to(tag, (t.n, bands)).copy()
                for k in range(rows):
                    key = key * bs._GRAM + part[:, :, k]
                key = bs.mix(key).view(np.int64)
                sig = pa.Array.from_buffers(pa.binary(bins), t.n, [None, pa.py_buffer(bs.mix(s).astype(np.uint8).tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(t.first, t.n) for c in ("doc_id", "rid")), pa.array(size), pa.array(node, pa.binary()), pa.ListArray.from_arrays(np.arange(0, bands * t.n + 1, bands, dtype=np.int32), pa.array(key.reshape(-1))), sig.cast(pa.binary())],
                    ["doc_id", "rid", "n_shingles", "node", "bands", "sig"],
                )

    return docs.select("doc_id", row_key(docs).alias("rid"), "text").mapInArrow(run, f"doc_id {id_type}, rid long, n_shingles long, node binary, bands array<long>, sig binary")


# --- exact checks ------------------------------------------------------------------------


def with_texts(members: DataFrame, docs: DataFrame) -> DataFrame:
    """`members` (rid, ...) with the text of their row; few other texts leave the scan."""
    rows = docs.select(row_key(docs).alias("rid"), "text")
    few = bloom.keep_maybe(rows, "rid", members.select(F.col("rid").alias("hash")))
    # of repeated rows one is enough; they are combined where they are read
    return members.join(few.groupBy("rid").agg(F.first("text").alias("text")), "rid")


def _sets(group: pa.Table | pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows and their shingle sets; a text with this row's hash, but another digest, is left out."""
    node = group.column("node").to_pylist()
    for t in bs.slices(group.column("text")):
        g, first = shingle_sets(t, n)
        for k in range(t.n):
            own = g[first[k] : first[k + 1]]
            if hashlib.blake2b(own.tobytes(), digest_size=16).digest() == node[t.first + k]:
                yield t.first + k, own


def close_pairs(pairs: DataFrame, classes: DataFrame, rules: NearRules) -> DataFrame:
    """Those (a, b) of `pairs` whose sketches and sizes allow a link."""
    of = lambda c: classes.select(F.col("cid").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a")  # pairs come dealt by b
    bins, percent, least_agree = rules.bins, rules.percent, rules.least_agree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, bins) for c in ("sig_a", "sig_b"))
            m, n = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            ok = (100 * np.minimum(m, n) >= percent * np.maximum(m, n)) & ((x == y).sum(axis=1) >= least_agree)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return both.select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, rules: NearRules) -> DataFrame:
    """Those (a, b) of `pairs`, a written table, whose full sets reach the threshold."""
    n, percent = rules.words, rules.percent
    # a table of its own, so that a hot centre's pairs can be split when they meet their number of salts
    hot = scratch.table(pairs.groupBy("a").count().where(F.col("count") > rules.rows_per_salt).select("a", F.ceil(F.col("count") / rules.rows_per_salt).cast("int").alias("many")), "near-hot", rules.tasks)
    salts = F.coalesce("many", F.lit(1))
    sides = pairs.join(hot, "a", "left").select("a", F.pmod(F.xxhash64("b"), salts).cast("int").alias("salt"), F.lit(1).alias("kind"), F.col("b").alias("cid"))
    centres = pairs.select("a").distinct().join(hot, "a", "left").select("a", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("a").alias("cid"))
    members = scratch.table(sides.unionByName(centres).join(classes.select("cid", "rid", "node"), "cid"), "near-members", rules.tasks)
    dealt = with_texts(members, docs).select("a", "salt", "kind", "cid", "node", "text").repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, held = None, None
        for batch in batches:
            a, kind, cid = (batch.column(c).to_pylist() for c in ("a", "kind", "cid"))
            left, right = [], []
            for i, own in _sets(batch, n):
                if kind[i] == 0:
                    centre, held = a[i], own
                elif centre == a[i]:
                    x, y = (own, held) if len(own) < len(held) else (held, own)
                    if 100 * len(x) < percent * len(y):
                        continue
                    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        left.append(a[i])
                        right.append(cid[i])
            if left:
                yield pa.RecordBatch.from_pydict({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return dealt.mapInArrow(run, "a long, b long")


# --- components --------------------------------------------------------------------------


def roots_of_trees(parents: DataFrame, tasks: int | None = None) -> DataFrame:
    """(cid, root) for (cid, parent) edges of a forest, by pointer jumping."""
    now = scratch.table(parents.select("cid", F.col("parent").alias("root")), "near-roots", tasks)
    while True:
        up = now.select(F.col("cid").alias("root"), F.col("root").alias("higher"))
        now, seen = scratch.observed(now.join(up, "root", "left").select("cid", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "near-roots", F.count_if("moved").alias("moved"), most=tasks)
        now = now.select("cid", "root")
        if not seen["moved"]:
            return now


#: Hot ends of links are sent out, this many at most.
HOT_ENDS = 100_000


def _with_least(rows: DataFrame, least: DataFrame, most: int) -> DataFrame:
    """`rows` (a, b) with the m of `least` (a, m, n), a written table; ends of more than `most` links don't meet them by a shuffle."""
    hot = F.broadcast(least.where(F.col("n") > most).select("a", F.col("m").alias("hot")))
    met = rows.join(hot, "a", "left")
    cold = met.where("hot is null").select("a", "b").join(least.select("a", "m"), "a")
    return met.where("hot is not null").select("a", "b", F.col("hot").alias("m")).unionByName(cold)


def components(edges: DataFrame, rows_per_end: int = 2000, tasks: int | None = None) -> DataFrame:
    """(cid, component) of an undirected graph (a, b) of longs: alternating large-star and small-star rounds.

    Ends of more than `rows_per_end` links (of more, where the links are so many that more than `HOT_ENDS` ends
    could have that) are split: their links stay where they are, and the ends' least neighbours come to them.
    Each round's tables are written by `tasks` tasks at most.
    """
    of_all = (F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")).alias("s"))
    now, before = scratch.observed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "near-edges", *of_all, most=tasks)
    while True:
        # 2 * n ends of links, so that at most HOT_ENDS keys have more than this
        most = max(rows_per_end, -(-2 * before["n"] // HOT_ENDS))
        split = before["n"] > most  # no end has more links than there are

        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        # no more rows than edges, so that repeats may wait for the end of the round
        if split:
            least = scratch.table(least, "near-least", tasks)
        upper = both.where("b > a")
        large = (_with_least(upper, least, most) if split else upper.join(least, "a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        if split:
            least = scratch.table(least, "near-least", tasks)
        small = (_with_least(large, least, most) if split else large.join(least, "a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        now, after = scratch.observed(small, "near-edges", *of_all, most=tasks)
        if after == before:
            return now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "cid")
        before = after


# --- the rest of the buckets -------------------------------------------------------------


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows outside their group's `main` root meet all rows of the group, block by block: group, x, y and `outside`.

    rows: cid, root, main, blocks (of the group) and out_blocks (of those outside).
    """
    place = lambda c: F.pmod(F.xxhash64("cid"), c).cast("int")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c).cast("int") - 1))
    out = rows.where("root <> main").withColumn("x", place("out_blocks")).withColumn("y", upto("blocks")).withColumn("outside", F.lit(True))
    every = rows.withColumn("y", place("blocks")).withColumn("x", upto("out_blocks")).withColumn("outside", F.lit(False))
    return out.unionByName(every).drop("blocks", "out_blocks")


def close_clusters(keys: DataFrame, classes: DataFrame, labels: DataFrame, rules: NearRules) -> DataFrame:
    """(key, cid, star): classes of a bucket that may link with another root, with the least class of those they hang together with.

    keys: (key, cid); classes: (cid, n_shingles, sig); labels: (cid, root) of those that aren't their own root.
    """
    rooted = scratch.table(keys.join(labels, "cid", "left").select("key", "cid", F.coalesce("root", "cid").alias("root")), "near-rooted", rules.tasks)
    by_root = rooted.groupBy("key", "root").count()
    mixed = by_root.groupBy("key").agg(F.max(F.struct("count", "root")).alias("top"), F.sum("count").alias("n"), F.count("*").alias("roots")).where("roots > 1")
    mixed = scratch.table(mixed.select("key", F.col("top.root").alias("main"), F.ceil(F.col("n") / rules.block).cast("int").alias("blocks"), F.ceil((F.col("n") - F.col("top.count")) / rules.block).cast("int").alias("out_blocks")), "near-mixed", rules.tasks)
    rows = _dealt(rooted.join(mixed, "key").join(classes.select("cid", "n_shingles", "sig"), "cid"))
    bins, percent, least_agree = rules.bins, rules.percent, rules.least_agree

    def compare(group: pa.Table) -> pa.Table:
        cid, root, size, outside = (group.column(c).to_numpy() for c in ("cid", "root", "n_shingles", "outside"))
        main, sig = group.column("main")[0].as_py(), np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(-1, bins)
        left, right = np.flatnonzero(outside), np.flatnonzero(~outside.astype(bool))
        ids, code = np.unique(cid, return_inverse=True)
        star, hit = np.arange(len(ids)), np.zeros(len(ids), bool)
        r_cid, r_root, r_size, r_sig = cid[right], root[right], size[right], sig[right]
        for i in left:
            # two classes outside meet twice, once is enough
            ok = (r_root != root[i]) & ((r_root == main) | (r_cid > cid[i])) & (100 * np.minimum(r_size, size[i]) >= percent * np.maximum(r_size, size[i]))
            at = np.flatnonzero(ok)
            near = at[(r_sig[at] == sig[i]).sum(axis=1) >= least_agree]
            if len(near):
                near = np.append(code[right[near]], code[i])
                hit[near] = True
                together = np.unique(star[near])
                star[np.isin(star, together)] = together[0]
        found = np.flatnonzero(hit)
        return pa.table({"key": pa.array(np.full(len(found), group.column("key")[0].as_py(), np.int64)), "cid": ids[found], "star": ids[star[found]]})

    return rows.groupBy("key", "x", "y").applyInArrow(compare, "key long, cid long, star long")


def cluster_links(stars: DataFrame, classes: DataFrame, labels: DataFrame, docs: DataFrame, rules: NearRules) -> DataFrame:
    """Verified (a, b) between roots: at least one for each two roots of a cluster that a link joins, directly or through others."""
    n, percent = rules.words, rules.percent
    joined = components(stars.select(F.col("cid").alias("a"), F.col("star").alias("b")), rules.rows_per_salt, rules.tasks)
    held = stars.select("key", "cid").repartition("cid").distinct().join(joined, "cid", "left").join(classes.select("cid", "n_shingles"), "cid").join(labels, "cid", "left")
    held = held.select("key", "cid", F.coalesce("root", "cid").alias("root"), F.coalesce("component", "cid").alias("cluster"), (F.col("n_shingles") + 32).alias("weight"))
    held = scratch.table(held, "near-clusters", rules.tasks)
    blocks = lambda w: F.ceil(w / rules.block_shingles).cast("int")
    large = scratch.table(held.select("cluster", "cid", "weight").distinct().groupBy("cluster").agg(blocks(F.sum("weight")).alias("many")), "near-large-clusters", rules.tasks)
    whole = F.col("many") <= rules.most_blocks
    # the cluster, or the bucket of a cluster that is too large
    dealt = held.join(large, "cluster").select(F.when(whole, F.lit(0)).otherwise(1).alias("kind"), F.when(whole, F.col("cluster")).otherwise(F.col("key")).alias("at"), "cid", "root", "weight").distinct()
    dealt = scratch.table(dealt, "near-groups", rules.tasks)
    by_root = dealt.groupBy("kind", "at", "root").agg(F.sum("weight").alias("w"))
    plan = by_root.groupBy("kind", "at").agg(F.max(F.struct("w", "root")).alias("top"), F.sum("w").alias("total"), F.count("*").alias("roots")).where("roots > 1")
    plan = scratch.table(plan.select("kind", "at", F.col("top.root").alias("main"), blocks(F.col("total")).alias("blocks"), blocks(F.col("total") - F.col("top.w")).alias("out_blocks")), "near-plan", rules.tasks)
    members = scratch.table(dealt.join(plan, ["kind", "at"]).drop("weight").join(classes.select("cid", "rid", "node"), "cid"), "near-members", rules.tasks)
    rows = _dealt(with_texts(members, docs).drop("rid"))

    def check(group: pa.Table) -> pa.Table:
        cid, root, outside = (group.column(c).to_numpy() for c in ("cid", "root", "outside"))
        main, kept, sets = group.column("main")[0].as_py(), [], []
        for i, own in _sets(group, n):
            kept.append(i)
            sets.append(own)
        left, right = [], []
        cid, root, outside = cid[kept], root[kept], outside[kept].astype(bool)
        l_at, r_at = np.flatnonzero(outside), np.flatnonzero(~outside)
        if len(l_at) and len(r_at):
            size = np.array([len(x) for x in sets])
            values, code = np.unique(np.concatenate([sets[j] for j in r_at]), return_inverse=True)
            r_cid, r_root, r_size = cid[r_at], root[r_at], size[r_at]
            first = np.concatenate([[0], np.cumsum(r_size)])[:-1]
            mark = np.zeros(len(values), np.int32)
            _, tree = np.unique(root, return_inverse=True)
            tree = tree.copy()
            for i in l_at:
                ok = (tree[r_at] != tree[i]) & ((r_root == main) | (r_cid > cid[i])) & (100 * np.minimum(r_size, size[i]) >= percent * np.maximum(r_size, size[i]))
                if not ok.any():
                    continue
                own = np.minimum(np.searchsorted(values, sets[i]), len(values) - 1)
                own = own[values[own] == sets[i]]
                mark[own] = 1
                both = np.add.reduceat(mark[code], first)  # no set is empty
                mark[own] = 0
                at = np.flatnonzero(ok & (100 * both >= percent * (r_size + size[i] - both)))
                met, where = np.unique(tree[r_at[at]], return_index=True)
                for j in at[where]:
                    left.append(int(cid[i]))
                    right.append(int(r_cid[j]))
                tree[np.isin(tree, met)] = tree[i]
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return rows.groupBy("kind", "at", "x", "y").applyInArrow(check, "a long, b long").distinct()


def merged(labels: DataFrame, links: DataFrame, rules: NearRules) -> DataFrame:
    """(cid, root) after joining the trees that links connect."""
    root = lambda c: F.coalesce(F.col(f"{c}_root"), F.col(c))
    of = lambda c: labels.select(F.col("cid").alias(c), F.col("root").alias(f"{c}_root"))
    lifted = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(root("a").alias("a"), root("b").alias("b"))
    joined = scratch.table(components(lifted, rules.rows_per_salt, rules.tasks), "near-components", rules.tasks)
    tops = labels.join(joined.withColumnRenamed("cid", "root"), "root", "left").select("cid", F.coalesce("component", "root").alias("root"))
    return scratch.table(tops.unionByName(joined.join(labels, "cid", "left_anti").select("cid", F.col("component").alias("root"))), "near-labels", rules.tasks)


def component_rows(docs: DataFrame, rules: NearRules = NearRules()) -> DataFrame:
    """doc_id, rid, n_shingles, component_id and `top` (a number of the component, null without shingles) of every row."""
    return _component_rows(docs, *_sketched(docs, rules))


def _sketched(docs: DataFrame, rules: NearRules) -> tuple[DataFrame, NearRules]:
    """The table of sketches, which what follows doesn't exceed but for texts, and rules with their number of tasks."""
    sketched = scratch.table(sketch_documents(docs, rules), "near-sketches")
    return sketched, replace(rules, tasks=rules.tasks or scratch.tasks_for(sketched))


def _component_rows(docs: DataFrame, sketched: DataFrame, rules: NearRules) -> DataFrame:
    same = sketched.where("node is not null").groupBy("node")
    # a class speaks through one of its rows
    classes = same.agg(F.min("doc_id").alias("least"), F.min("rid").alias("rid"), *(F.first(c).alias(c) for c in ("n_shingles", "bands", "sig")))
    classes = scratch.table(classes.withColumn("cid", F.monotonically_increasing_id()), "near-classes", rules.tasks)
    keys = classes.select(F.explode("bands").alias("key"), "cid")
    centres = scratch.table(keys.groupBy("key").agg(F.min("cid").alias("a"), F.max("cid").alias("top")).where("a <> top").select("key", "a"), "near-centres", rules.tasks)
    # keys of one class only don't leave the scan
    shared = scratch.table(bloom.keep_maybe(keys, "key", centres.select(F.col("key").alias("hash"))).join(centres, "key"), "near-buckets", rules.tasks)
    hits = shared.where("cid <> a").repartition("cid").groupBy("cid", "a").count()
    # most shared bands, then the largest centre: ids of rows are below 2 ** 56
    best = hits.groupBy("cid").agg(F.max(F.shiftleft("count", 56).bitwiseOR(F.col("a"))).alias("x")).select(F.col("x").bitwiseAND(F.lit((1 << 56) - 1)).alias("a"), F.col("cid").alias("b"))
    near = scratch.table(close_pairs(best, classes, rules), "near-pairs", rules.tasks)
    trees = scratch.table(verify(near, classes, docs, rules), "near-trees", rules.tasks)
    labels = roots_of_trees(trees.select(F.col("b").alias("cid"), F.col("a").alias("parent")), rules.tasks)
    stars = scratch.table(close_clusters(shared.select("key", "cid"), classes, labels, rules), "near-stars", rules.tasks)
    links = scratch.table(cluster_links(stars, classes, labels, docs, rules), "near-links", rules.tasks)
    if links.limit(1).count():
        labels = merged(labels, links, rules)
    tops = labels.withColumnRenamed("root", "top")
    # the least id of each component of several classes
    named = tops.select("cid", "top").unionByName(tops.select(F.col("top").alias("cid"), "top")).distinct()
    few = classes.select("cid", "node", "least")
    # a table of its own, so that a large component's classes can be split when they meet its id
    ids = scratch.table(named.join(few, "cid").groupBy("top").agg(F.min("least").alias("component_id")), "near-least-ids", rules.tasks)
    many = scratch.table(named.join(ids, "top"), "near-ids", rules.tasks)
    found = few.join(many, "cid", "left").select("node", F.coalesce("top", "cid").alias("top"), F.when(F.col("top").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    out = sketched.select("doc_id", "rid", "n_shingles", "node").join(found, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "rid", "n_shingles", component.alias("component_id"), "top")


def near_duplicates(docs: DataFrame, rules: NearRules = NearRules()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of `docs` (doc_id, text, ...)."""
    rows = component_rows(docs, rules).select("doc_id", "n_shingles", "component_id")
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, rules: NearRules = NearRules()) -> DataFrame:
    """`docs` with one row of each component: that with the least doc_id, a null one last. Rows without shingles stay."""
    sketched, rules = _sketched(docs, rules)
    rows = scratch.table(_component_rows(docs, sketched, rules).where("top is not null").select("top", "doc_id", "rid"), "near-rows", rules.tasks)
    first = rows.groupBy("top").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first"))
    first = scratch.table(first.select("top", F.col("first.doc_id").alias("first_id"), F.col("first.rid").alias("first_rid")), "near-first", rules.tasks)
    marked = rows.join(first, "top").withColumn("kept", (F.col("rid") == F.col("first_rid")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    by_row = marked.groupBy("doc_id", "rid").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    # rows that go, and rows of which one of several equal ones stays
    odd = scratch.table(by_row.where("not kept or n > 1").select(F.col("doc_id").alias("__of_id"), F.col("rid").alias("__of_rid"), F.col("kept").alias("__kept")), "near-odd", rules.tasks)
    held = docs.withColumn("__rid", row_key(docs))
    ask = bloom.asker(docs, odd.select(F.col("__of_rid").alias("hash")))
    same = (F.col("__rid") == F.col("__of_rid")) & F.col("doc_id").eqNullSafe(F.col("__of_id"))
    sure, unsure = (held.where(~ask(F.col("__rid"))), held.where(ask(F.col("__rid")))) if ask else (held.limit(0), held)
    judged = unsure.join(odd, same, "left").where("__kept is null or __kept")
    alone, again = judged.where("__kept is null"), judged.where("__kept").dropDuplicates(["__rid", "doc_id"])
    return sure.select(*docs.columns).unionByName(alone.select(*docs.columns)).unionByName(again.select(*docs.columns))
