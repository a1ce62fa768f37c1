"""Periodic runs, repeated passages and source divergences against brute force on small tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomveil.llm import bytescan, divergence, periods, repeats

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def prose(seed, n, kinds=50):
    r = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in r.integers(0, kinds, n))


# --- periodic runs -------------------------------------------------------------------------


def runs(w, rules):
    out = {}
    for q in range(1, len(w) // rules.min_exponent + 1):
        j = 0
        while j < len(w) - q:
            s = j
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > s and j + q - s >= max(rules.min_words, rules.min_exponent * q):
                out.setdefault((s, j + q), q)
            j += j == s
    return sorted((s, q, e - s) for (s, e), q in out.items())


def turned(i, w):
    if i is None or not w or zlib.crc32(str(i).encode()) % 10:
        return w
    g = zlib.crc32(str(i).encode()) // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[a + (k - a) % p] if k >= a else w[k] for k in range(len(w))]


def run_row(i, t, rules):
    w = turned(i, words(t))
    found = runs(w, rules)
    gone = {k for s, q, n in found for k in range(s + q, s + n)}
    best = min(found, key=lambda x: (-x[2] / x[1], x[0], x[1]), default=None)
    s, q, n = best or (None, None, None)
    return i, len(found), s, n, q, best and 1000 * n // q, sha("".join(f"{s},{n},{q}\n" for s, q, n in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))


def test_runs_of_random_words_are_all_found():
    r = np.random.default_rng(0)
    for _ in range(120):
        rules = periods.RunRules(int(r.integers(2, 9)), int(r.integers(2, 6)))
        texts = []
        for _ in range(6):
            w = [chr(97 + x) for x in r.integers(0, r.integers(1, 5), r.integers(0, 90))]
            i, p = int(r.integers(0, 90)), int(r.integers(1, 8))
            texts.append(" ".join(w[:i] + (w[i : i + p] * 20)[: max(0, len(w) - i)]))
        for t in bytescan.slices(pa.array(texts)):
            t.prepare(lower=False)
            start, end, first = t.words()
            h = t.span(start, end)
            s, e, q = periods.runs_of(h, *periods.segments(h, first, rules.overlap), rules)
            for i in range(t.n):
                got = [(a - first[i], c, b - a) for a, b, c in zip(s, e, q, strict=True) if first[i] <= a < first[i + 1]]
                assert got == runs(texts[t.first + i].split(), rules)


def test_prefix_hashes_that_lie_do_no_harm(monkeypatch):
    # a base whose powers vanish makes every long stretch look equal to any other
    monkeypatch.setattr(bytescan, "_powers", lambda n: (np.array([1, 1, *[0] * n], np.uint64), np.ones(n + 2, np.uint64)))
    w = prose(3, 40).split() + ["a", "b"] * 8 + prose(4, 40).split()
    h = np.array([zlib.crc32(x.encode()) for x in w], np.uint64)
    rules = periods.RunRules()
    for s, e, q in zip(*periods.runs_of(h, np.array([0]), np.array([len(w)]), rules), strict=True):
        assert (s, q, e - s) in runs(w, rules)


def test_masking_keeps_only_words_of_repeated_grams():
    rules = periods.RunRules()
    assert rules.overlap == 5
    passage = prose(1, 60, 10_000).split()
    w = passage + prose(2, 30, 10_000).split() + passage + ["x", "y"] * 6
    h = np.array([zlib.crc32(x.encode()) for x in w], np.uint64)
    lo, hi = periods.segments(h, np.array([0, len(w)]), rules.overlap)
    # the passage is repeated in the document, but not inside any stretch; the periodic tail is
    assert list(zip(lo, hi, strict=True)) == [(len(w) - 12, len(w))]


def test_periodic_documents(spark):
    rules = periods.RunRules()
    texts = [None, "", " \n\t ", "a", "a a a a a", "a a a a a a", "b a a a a a a\x0bc", "a b a b a b a b", "x " + "a b c " * 4 + "a y", prose(5, 300), prose(6, 300, 2), "é 日本 " * 9, prose(7, 4000) + " z" * 4000, "A a " * 8]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, "a b " * 5), (1, "a b " * 5), (None, "q " * 7)] + [(100 + i, prose(i, 20 + 5 * i)) for i in range(60)]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, t in rows if i is not None and words(t)) > 3
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, Runs int")
    got = periods.digest(periods.with_periods(docs)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((run_row(i, t, rules) for i, t in rows), key=str)
    found = periods.find_runs(docs)
    assert found.columns == ["doc_id", "text", "runs", "collapsed"]
    assert found.where("doc_id is null").first().collapsed == "q" and found.where("doc_id is null").first().text == "q " * 7
    assert periods.digest(periods.with_periods(docs.limit(0))).count() == 0
    with pytest.raises(ValueError, match="two periods"):
        periods.RunRules(min_exponent=1)


# --- repeated passages ---------------------------------------------------------------------


def removed(texts, n):
    count = collections.Counter(tuple(w[i : i + n]) for w in map(words, texts) for i in range(len(w) - n + 1))
    for t in texts:
        w = words(t)
        gone = {k for i in range(len(w) - n + 1) if count[tuple(w[i : i + n])] > 1 for k in range(i, i + n)}
        yield len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)


def passage_rows():
    shared, other = prose(1, 60, 10_000), prose(2, 50, 10_000)
    rows = [(1, None), (2, ""), (3, " \n "), (4, prose(3, 34)), (5, "a " * 200), (6, "a b " * 90), (7, "a " * 34), (8, prose(4, 3000, 100_000))]
    # a passage whole, in parts that overlap, twice in one text, and between other white space
    rows += [(20 + i, f"{prose(50 + i, 40, 10_000)} {shared} {prose(90 + i, 30, 10_000)}") for i in range(12)]
    rows += [(40 + i, f"{prose(150 + i, 9, 10_000)} {' '.join(shared.split()[i : i + 38])} {prose(190 + i, 9, 10_000)}") for i in range(14)]
    rows += [(60, f"{other} x {other}"), (61, other.replace(" ", "\n")), (62, " ".join(other.split()[:35])), (63, " ".join(other.split()[:34]))]
    copy = prose(9, 400, 10_000)
    rows += [(70, copy), (70, copy), (71, copy), (None, copy.replace(copy.split()[200], "changed", 1)), (72, copy + " more")]
    near = prose(10, 120, 10_000).split()
    for i in range(30):  # near copies: each lacks another word
        rows.append((100 + i, " ".join(near[: 4 * i] + [f"n{i}"] + near[4 * i + 1 :])))
    return rows


@pytest.mark.parametrize("rules", [{}, {"shard_words": 100, "part_words": 100, "rows_per_salt": 7}, {"shard_words": 60, "part_words": 40, "max_filter": 0, "words": 12, "anchor": 4}, {"words": 9, "anchor": 9}])
def test_repeated_passages(spark, rules):
    rules = repeats.RepeatRules(**rules)
    rows = passage_rows()
    docs = spark.createDataFrame([(i, t, 7, "en") for i, t in rows], "doc_id long, text string, N_WORDS int, lang string").repartition(5)
    exp = sorted(((i, n, k, sha(t)) for (i, _), (n, k, t) in zip(rows, removed([t for _, t in rows], rules.words), strict=True)), key=str)
    assert sorted(map(tuple, repeats.digest(docs, rules).collect()), key=str) == exp
    assert sum(k for _, _, k, _ in exp) > 1000 and any(k == 0 and n > 100 for _, n, k, _ in exp)


def test_passages_keep_nulls_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, 7), (2, "a  b", 7)], "doc_id long, text string, n_removed int")
    got = repeats.remove_repeats(docs)
    assert got.columns == ["doc_id", "text", "n_words", "n_removed"]
    assert sorted(map(tuple, got.collect())) == [(1, None, 0, 0), (2, "a b", 2, 0)]
    assert repeats.digest(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="inside a window"):
        repeats.RepeatRules(words=5, anchor=6)


def test_a_passage_of_many_contexts_is_cut_where_they_part(spark):
    # ab and bc are both held by abc; the cuts let each of the three be found
    part = [prose(s, 20, 10_000) for s in (1, 2, 3)]
    texts = [" ".join(part), f"x {part[0]} {part[1]} y", f"u {part[1]} {part[2]} v", "nothing"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in repeats.remove_repeats(docs).collect()}
    assert got == {0: "", 1: "x y", 2: "u v", 3: "nothing"}


def test_automaton_covers_overlapping_phrases():
    machine = repeats.Automaton([b"a b c", b"c d e", b"b", "é".encode()])
    assert machine.covered(b"x a b c d e y b z") == [(1, 6), (7, 8)]
    assert machine.covered("z é q".encode()) == [(1, 2)] and machine.covered(b"") == []
    big = repeats.Automaton([b" ".join(b"%d" % i for i in range(k, k + 3)) for k in range(60_000)])  # letters beyond the surrogates
    assert big.covered(b"59999 60000 60001") == [(0, 3)] and big.covered(b"59999 60001") == []


# --- source divergences --------------------------------------------------------------------


def audited(rows, rules):
    docs = [(a or "", b or "", [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]) for a, b, t in rows]
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = collections.Counter(x for d in own for x in set(d[2]))
        kept = [x for x in df if df[x] >= rules.min_docs]
        count = {s: collections.Counter(x for d in own if d[1] == s for x in d[2] if df[x] >= rules.min_docs) for s in {d[1] for d in own}}
        count[None] = collections.Counter(x for d in own for x in d[2] if df[x] >= rules.min_docs)
        p = {s: {x: 1 + 10**9 * (c[x] + 5) // (sum(c.values()) + 5 * len(kept)) for x in kept} for s, c in count.items()}
        for s in count:
            if s is None:
                continue
            far = [(-sum(abs(p[s][x] - p[o][x]) for x in kept), o.encode(), o) for o in count if o not in (s, None)]
            more = [(p[None][x] - p[s][x], x.encode(), x) for x in kept if count[s][x] and p[s][x] > p[None][x]]
            for part, values, top in (("pair", far, None), ("term", more, rules.top)):
                for rank, (v, _, item) in enumerate(sorted(values)[:top], 1):
                    yield lang, s, part, item, -v, rank


def audit_rows():
    r = np.random.default_rng(5)
    rows = [("en", f"s{r.integers(0, 6)}", " ".join(f"T{x}erm Ünit, x{chr(97 + x)}y" for x in r.integers(0, 26, r.integers(0, 40)))) for _ in range(150)]
    rows += [("de", s, f"größe {s} ÄÖ a1b {'Wort ' * i}") for i in range(12) for s in ("a", "b", "é", "\U0001f600", "｡")]
    rows += [("en", "wordless", "1 2 3"), ("en", "wordless", None), (None, None, "Alone"), (None, "z", ""), ("fr", "one", "seul"), ("fr", "two", None)]
    return rows


@pytest.mark.parametrize("rules", [{}, {"min_docs": 3, "top": 4, "tile": 2, "block_rows": 5}, {"min_docs": 1, "block_rows": 3, "tile": 1}, {"min_docs": 10**6}])
def test_audit(spark, rules):
    rules = divergence.AuditRules(**rules)
    rows = audit_rows()
    docs = spark.createDataFrame([(a, b, t, 1, 2) for a, b, t in rows], "lang string, source string, text string, term int, n int").repartition(4)
    got = [tuple(r) for r in divergence.audit(docs, rules).collect()]
    assert sorted(got) == sorted(audited(rows, rules))
    assert divergence.audit(docs.limit(0), rules).count() == 0


def test_slices_with_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(divergence.xxhash, "xxh3_64_intdigest", lambda x: len(x) % 2)
    texts = ["ab cd ab", "cd x é zz", "", "ab abc abd AB"]
    seen = []
    for t in bytescan.slices(pa.array(texts)):
        first, kind, kinds = divergence.terms_of(t)
        seen += [[kinds[k].decode() for k in kind[first[i] : first[i + 1]]] for i in range(t.n)]
    assert seen == [["ab", "cd", "ab"], ["cd", "x", "é", "zz"], [], ["ab", "abc", "abd", "ab"]]


def test_shares_are_exact(spark):
    pairs = [(0, 5), (3, 10**6), (10**13, 2 * 10**13 + 7), (8 * 10**15, 9 * 10**15 - 1), (1, 3 * 10**14 + 1)]
    exact = [1 + 10**9 * (c + 5) // d for c, d in pairs]
    assert [int(divergence.shares(np.array([c]), np.array([d]))[0]) for c, d in pairs] == exact
    df = spark.createDataFrame(pairs, "c long, d long")
    assert [r[0] for r in df.select(divergence.share("c", "d").alias("p")).collect()] == exact


def test_hot_source(spark):
    # a third of all rows in one source
    rows = [("en", "hot" if i % 3 == 0 else f"s{i % 7}", f"alpha beta w{chr(97 + i % 5)}") for i in range(300)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert sorted(tuple(r) for r in divergence.audit(docs).collect()) == sorted(audited(rows, divergence.AuditRules()))
    assert docs.where(F.col("source") == "hot").count() == 100
