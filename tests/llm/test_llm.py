"""Each operator against brute force on small tables with nulls, empty texts, ties and repeated rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomveil.llm import bytescan, chatfmt, decontam, linededup, minhash, packing, quality, queries, scratch, sharding, surrogates, urlfilter, warc

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def prose(seed, n, extra=()):
    r = np.random.default_rng(seed)
    return " ".join([*(WORDS[i] + str(r.integers(0, 40)) for i in r.integers(0, len(WORDS), n)), *extra])


def texts():
    long = prose(1, 400)
    near = long.replace("alpha", "omega", 2)
    rows = [(1, long), (2, near), (3, long), (3, long), (4, None), (5, ""), (6, " \n\t "), (7, "a b"), (8, "A  b"), (9, "a b c d e f g"), (10, "x b c d e f g")]
    rows += [(20 + i, prose(100 + i, 60) + "\nShared LINE \n" + prose(200 + i, 5)) for i in range(12)]
    rows += [(40 + i, prose(7, 80, [f"tail{i}"])) for i in range(8)]
    return [*rows, (None, "ß é\x0b日本 😀\n\n"), (60, prose(9, 6000))]


@pytest.fixture(scope="module")
def docs(spark):
    # extra columns, one with a clashing name
    return spark.createDataFrame([(i, t, "en", 1) for i, t in texts()], "doc_id long, text string, lang string, n_lines int")


def test_bytescan_words_and_lines():
    import pyarrow as pa

    data = [t for _, t in texts()]
    for most in (7, 500, 10**6):
        for t in bytescan.slices(pa.array(data), most):
            s, e, f = t.words()
            ls, le, lf = t.lines()
            for i in range(t.n):
                raw = (data[t.first + i] or "").encode()
                assert [t.buf[a:b].tobytes() for a, b in zip(s[f[i] : f[i + 1]], e[f[i] : f[i + 1]], strict=True)] == raw.split()
                assert [t.buf[a:b].tobytes() for a, b in zip(ls[lf[i] : lf[i + 1]], le[lf[i] : lf[i + 1]], strict=True)] == raw.split(b"\n")


# --- 1 -------------------------------------------------------------------------------------


def judged(url, rules):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url) if url is not None else None
    h, p = (low(m[1]), m[2]) if m else ("", "")
    fit = [r for r in rules if (h == r.host or h.endswith("." + r.host)) and p.startswith(r.path)]
    best = max(fit, key=lambda r: (len(r.text), len(r.host)), default=None)
    return h, p, best and best.text, best.action if best else "allow"


@pytest.mark.parametrize("max_bytes", [1 << 26, 0])
def test_urls(spark, max_bytes):
    urls = [None, "", "abc", "x://COM/en/", "x://a.com/en/7?a://net/de/", "http://net", "://example.net/de/89#", "http://xcom/en/", "h://b.example.com/en/70", "h://EXAMPLE.com/en/6", "h://org\n/es/", "h://a.org/es/1", "h://a.org/es/1"]
    rows = [(i, u) for i, u in enumerate(urls + [f"http://h{i}.example.{t}/{p}/{i}" for i in range(300) for t in ("com", "net", "org") for p in ("en", "de", "es")])]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: tuple(r)[1:] for r in urlfilter.judge_urls(pages, queries.URL_RULES, max_bytes).collect()}
    assert got == {i: judged(u, queries.URL_RULES) for i, u in rows}
    assert urlfilter.judge_urls(pages.limit(0), queries.URL_RULES, max_bytes).count() == 0


@pytest.mark.parametrize("max_bytes", [1 << 26, 0])
def test_urls_with_odd_characters(spark, max_bytes):
    rules = [urlfilter.Rule("com", "/x\ty", "block"), urlfilter.Rule("a\tb.org", "/\t\t", "block"), urlfilter.Rule("net", "x", "block"), urlfilter.Rule("é.de", "/日本", "block")]
    urls = ["h://com/x\tyz", "h://u.com/x\ty", "h://com/xy", "h://a\tb.org/\t\t?", "h://a\tb.org/\t", "h://netx/", "h://net/x", "h://w.é.de/日本/1", "h://é.de/日"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: tuple(r)[1:] for r in urlfilter.judge_urls(pages, rules, max_bytes).collect()}
    assert got == {i: judged(u, rules) for i, u in enumerate(urls)}


def test_cascade_is_exact_over_its_universe(spark):
    keys = [f"k{i}" for i in range(5000)]
    u = spark.createDataFrame([(k,) for k in keys], "key string").withColumn("hash", F.xxhash64("key"))
    c = urlfilter.build_cascade(u.where("key like '%7'"), u)
    assert len(c.levels) > 1
    got = c.contains(np.array([r.hash for r in u.collect()], np.int64).view(np.uint64))
    assert [k for k, g in zip(keys, got, strict=True) if g] == [k for k in keys if k.endswith("7")]


# --- 2 -------------------------------------------------------------------------------------


def base(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    g = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if g[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality(spark, docs):
    more = [(100 + i, " ".join(f"{w[:4]}###|" for w in prose(i, 80).split()) + "\nx\nx\nx") for i in range(30)] + [(200, "same words again " * 40)]
    good = [(300 + i, prose(1000 + i, 80)) for i in range(260)]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more + good, "doc_id long, text string"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300, 500)] + [(100, 0, 0), (None, 1, 0), (301, 1, 0)], "doc_id long, quality int, toxic int")
    rows = [(r.doc_id, r.text) for r in every.collect()]
    got = quality.judge_documents(every, labels).collect()
    exp = sorted(((i, *base(t)) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=str) == exp
    kept = {r.doc_id for r in got if r.kept}
    assert kept >= set(range(300, 560)) and not kept & set(range(100, 130))
    assert not any(r.kept and r.base_failed for r in got)
    # the score is the quantised log ratio of the two multinomials
    model, rules = quality.fit(every, labels), quality.Rules()
    assert len(model.weights) == rules.buckets
    assert sorted(r.doc_id for r in quality.filter_documents(every, labels).collect() if r.doc_id) == sorted(r.doc_id for r in got if r.kept and r.doc_id)
    none = quality.judge_documents(every, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in none)
    assert quality.judge_documents(every.limit(0), labels).count() == 0


# --- 3 -------------------------------------------------------------------------------------


def test_shards(spark, docs):
    for parts in (1, 5):
        got = sharding.shard_by_bytes(docs, 4, parts).collect()
        rows = texts()
        assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
        by = collections.defaultdict(list)
        for r in got:
            by[r.shard].append(r)
        order = []
        for s in sorted(by):
            assert sorted(r.slot for r in by[s]) == list(range(len(by[s])))
            order += [r.doc_id if r.doc_id is not None else -math.inf for r in sorted(by[s], key=lambda r: r.slot)]
        assert order == sorted(order)
    even = spark.createDataFrame([(i % 7, "x" * 99) for i in range(160)], "doc_id long, text string")
    assert {r["count"] for r in sharding.shard_by_bytes(even, 16).groupBy("shard").count().collect()} == {10}
    assert sharding.shard_by_bytes(docs.limit(0), 4).count() == 0


# --- 4 -------------------------------------------------------------------------------------


def line_key(x):
    return low(x.strip(" \t\n\x0b\x0c\r"))


@pytest.mark.parametrize("rules", [linededup.LineRules(), linededup.LineRules(max_broadcast=0, shard_keys=1, rows_per_salt=3), linededup.LineRules(min_docs=2, shard_keys=2)])
def test_lines(docs, rules):
    n = collections.Counter(k for _, t in texts() for k in {line_key(x) for x in (t or "").split("\n")} - {""})
    exp = collections.Counter()
    for i, t in texts():
        lines = (t or "").split("\n")
        kept = [x for x in lines if not line_key(x) or n[line_key(x)] < rules.min_docs]
        exp[i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in linededup.digest(docs, rules).collect()) == exp
    assert linededup.dedup_lines(docs.limit(0), rules).count() == 0
    out = linededup.dedup_lines(docs, rules)
    assert set(out.columns) == {*docs.columns, "n_dropped"}


def test_minimal_perfect_hash():
    keys = bytescan.seeds(20_000, 9)
    mph = linededup.build_mph(keys, np.arange(20_000) % 70_000, bytescan.mix(keys))
    assert len(mph["counts"]) == 20_000
    assert (linededup.probe_mph(mph, keys, bytescan.mix(keys)) == np.arange(20_000)).all()
    other = bytescan.seeds(20_000, 10)
    assert not linededup.probe_mph(mph, other, bytescan.mix(other)).any()


# --- 5 -------------------------------------------------------------------------------------


def test_preferences(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a <|x"), (2, 0, "user", "hi"), (2, 1, "assistant", "b"), (2, 2, "user", "c"), (3, 0, "user", "q"), (3, 1, "assistant", "r1"), (3, 2, "user", "q2"), (3, 3, "assistant", "é😀"), (4, None, None, None), (None, 0, "user", "x")]
    rows += [(10 + i, t, "user" if t % 2 == 0 else "assistant", "same" if t < 2 else f"{i}-{t}") for i in range(9) for t in range(4)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.chosen_id, r.rejected_id): r for r in chatfmt.preference_pairs(turns, rows_per_salt=2).collect()}
    assert set(got) == {(2, 1), (3, 3), (4, None)} | {(18, 10 + i) for i in range(8)}
    assert got[18, 10].shared_turns == 2 and got[18, 10].prompt == "<|user|>\nsame<|end|>\n<|assistant|>\nsame<|end|>\n"
    assert got[2, 1].rejected == "<|assistant|>\na <\\|x<|end|>\n"
    for r in got.values():
        for text, mask in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            spans = [tuple(map(int, s.split("-"))) for s in (mask or "").split(",") if s]
            assert [text[a:b] for a, b in spans] == [m[1] for m in re.finditer(r"<\|assistant\|>\n((?s:.*?)<\|end\|>\n)", text or "")]
    assert chatfmt.preference_pairs(turns.limit(0)).count() == 0


# --- 6 -------------------------------------------------------------------------------------


def test_archives(spark):
    m = warc.MAGIC
    fake = m + "WARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    big = "z" * 500 + m + "y" * 600
    rows = [(1, None, None), (2, "u\r\nx", ""), (3, "u", fake * 40), (4, "u", big), (5, "u", big), (6, None, m), (7, "u", m + m + "x"), (8, "u", "é" * 499 + "a"), (9, "u", "é" * 499 + "a"), (10, "u", "é" * 500), (11, "u", "é" * 500), (12, "u", m + "Content-Length: 300\r\n\r\n"), (None, "u", big), (14, "u", "WARC/1.1\r"), (15, "u", "\r\n\r\n"), (16, "u", "b" * 40_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    top = {}
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(top.get(h or "", i), i)
    n = collections.Counter(h or "" for _, _, h in rows)
    exp = collections.Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 1000 and n[h or ""] > 1 and i != top[h or ""]
        exp[i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top[h or ""] if again else None] += 1
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("128m", "3000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1000")
            path = scratch.new_path(spark, "archives")
            made = warc.round_trip(pages, path)
            # executors that come or go change the splits between the two scans
            spark.conf.set("spark.sql.files.maxPartitionBytes", {"128m": "2000", "3000": "5000"}[size])
            got = made.collect()
            assert collections.Counter(tuple(r)[:5] for r in got) == exp and all(r.intact for r in got)
            assert all(r.intact for r in warc.read_archives(spark, path).collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert warc.round_trip(pages.limit(0), scratch.new_path(spark, "archives")).count() == 0


# --- 7 -------------------------------------------------------------------------------------


def near_brute(rows):
    sets = []
    for _, t in rows:
        w = low(t or "").encode().split()
        sets.append(frozenset(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return collections.Counter((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("rules", [minhash.NearRules(), minhash.NearRules(block=2, rows_per_salt=2), minhash.NearRules(block_shingles=100), minhash.NearRules(block_shingles=100, most_blocks=0)])
def test_near_duplicates(spark, docs, rules):
    # chains: each is near the next only, so that trees have to be joined
    words = prose(77, 200).split()
    chain = [(500 + i, " ".join([f"c{i}x{k}" if k < 6 * i else w for k, w in enumerate(words)])) for i in range(6)]
    slide = [(600 + i, " ".join(prose(78, 260).split()[8 * i : 8 * i + 160])) for i in range(8)]
    rows = texts() + chain + slide
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(df, rules).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == near_brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert minhash.near_duplicates(docs.limit(0), rules).count() == 0


def test_sketches_fill_and_estimate():
    import pyarrow as pa

    a, b = prose(1, 900).split(), prose(2, 900).split()
    data = [" ".join(a), " ".join(a[:800] + b[:100]), "one two three"]
    t = next(bytescan.slices(pa.array(data)))
    g, first = minhash.shingle_sets(t, 5)
    s = minhash.sketches(g, first, 256)
    assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    x, y = set(g[first[0] : first[1]]), set(g[first[1] : first[2]])
    assert abs((s[0] == s[1]).mean() - len(x & y) / len(x | y)) < 0.1


# --- 8 -------------------------------------------------------------------------------------


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    odd = ["  b\n\n c   x \t\t q", "don't 123,4 5　x \x1c z", "<|endoftext|> a  b", "\r\n!? \x85 ok "]
    rows = texts() + [(700 + i, x) for i, x in enumerate(odd)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    exp = collections.Counter()
    for d, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at, piece, size = 0, 0, (len(ids) - 1) % 2048 + 1
        while at < len(ids):
            exp[d, piece, at, size, zlib.crc32(ids[at : at + size].tobytes())] += 1
            at, piece, size = at + size, piece + 1, 2048
    out = packing.pack_documents(df, path).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == exp
    by = collections.defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 2048
    assert len(by) <= math.ceil(sum(r.length for r in out) / 2048) + 1
    assert packing.pack_documents(df.limit(0), path).count() == 0


def test_added_tokens_are_ids_of_their_own(spark, tmp_path):
    from tokenizers import Tokenizer

    e = "<|endoftext|>"
    odd = [f"a {e} b", e, e + e, f"a  {e}  {e} \n{e}\n b", f" {e}", f"{e} ", f"x{e}'s {e}é日本\u3000{e}", "a <|endof", "text|> b", f"<|endof{e}text|>", "", None, f"a\u3000{e} c d"]
    spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    t = Tokenizer.from_file(queries.tokenizer_path())
    ids = [np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for x in odd]
    assert 50256 in ids[0]
    exp = {(i, 0, 0, len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(ids)}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for out in (queries.op8_vector_packing(spark, str(tmp_path)), corpus_pipeline.packing_stage(spark, docs, str(tmp_path))):
        assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out.collect()} == exp


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_patterns_keep_every_constraint(score):
    r = np.random.default_rng(3)
    counts = collections.Counter(r.integers(1, 101, 5000).tolist())
    rules = packing.PackRules(capacity=100, max_documents=4, max_attention=6000, score=score) if score == "norm" else packing.PackRules(capacity=100, max_documents=4, max_attention=10_000, score=score)
    if score == "norm":
        counts = collections.Counter({k: v for k, v in counts.items() if k * k <= 6000})
    plan = packing.plan_patterns(counts, rules)
    placed, load = collections.Counter(), collections.defaultdict(list)
    for p in plan:
        placed[p.length] += p.many * p.repeat
        for s in range(p.sequence, p.sequence + p.repeat):
            load[s] += [p.length] * p.many
    assert placed == counts
    assert all(sum(x) <= 100 and len(x) <= 4 and sum(n * n for n in x) <= rules.max_attention for x in load.values())


# --- 9 -------------------------------------------------------------------------------------


def test_leaks(spark):
    items = [(1, "Anna has 3 apples and Bob has 5 km of rope so how many apples are left today"), (2, None), (3, ""), (4, "two words"), (5, "Anna has 3 apples and Bob has 5 km of rope so how many apples are left today"), (6, prose(5, 40))]
    rows = [
        (1, "foo Maria has 7 apples and Piet has 9 miles of rope so how many apples are left today bar"),
        (2, "We saw 3 apples and Bob has 5 km of rope. Later 4 apples and Bob has 6 km of rope"),
        (3, "nothing here at all but words that go on and on for a while"), (4, None), (4, ""), (5, prose(5, 40) + " " + prose(6, 300)), (5, prose(5, 40) + " " + prose(6, 300)),
        (6, prose(6, 300)), (7, "x" * 50_000), (8, " ".join(prose(5, 40).split()[:25])), (None, prose(5, 40)),
    ]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, hash string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(df, bench).collect()}
    assert set(got) >= {(1, 1), (5, 6), (8, 6), (None, 6)} and not {k[0] for k in got} & {3, 4, 6, 7}
    assert got[5, 6].verbatim and got[5, 6].matched == got[5, 6].windows and not got[1, 1].verbatim
    blocks = {(r.doc_id, r.item_id) for r in decontam.contaminated(df, bench, decontam.LeakRules(block_rows=10)).collect()}
    assert blocks == set(got)
    # slots that contradict each other: one item value, two document values
    odd = spark.createDataFrame([(1, "if x equals 3 then add 3 to it and then take 3 from it again")], "item_id long, text string")
    said = spark.createDataFrame([(1, "if x equals 4 then add 4 to it and then take 4 from it again"), (2, "if x equals 4 then add 5 to it and then take 6 from it again")], "doc_id long, text string")
    assert {r.doc_id for r in decontam.contaminated(said, odd).collect()} == {1}
    assert {r.doc_id for r in decontam.drop_contaminated(df, bench).collect()} == {i for i, _ in rows} - {i for i, _ in got}
    assert decontam.contaminated(df.limit(0), bench).count() == 0 and decontam.contaminated(df, bench.limit(0)).count() == 0


def test_leaks_of_number_dense_items(spark):
    items = [(1, "Compute 12 + 7 * 3 - 4."), (2, "What is 3 + 4 * 5?"), (3, "What is 6 + 7 * 8?"), (4, "Is 3 > 2"), (5, "Add 1, 2, 3, 4, 5, 6, 7, 8 and 9 to the number of apples in it")]
    rows = [(1, "Please answer. Compute 12 + 7 * 3 - 4. Thanks"), (2, "so What is 3 + 4 * 5?"), (3, "What is 6 + 7 * 8?"), (4, "Well: is 3 > 2 then"), (5, "Add 1, 2, 3, 4, 5, 6, 7, 8 and 9 to the number of apples in it"),
            (6, "Compute 12 + 7 * 3 - 5. What is 3 + 4 * 6? Is 3 > 1"), (7, "Add 11, 12, 13, 14, 15, 16, 17, 18 and 19 to the number of apples in it"), (8, "the answer is 1, 2, 3 or 4 of 5")]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(df, bench).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (7, 5)}
    assert all(r.verbatim == (k != (7, 5)) for k, r in got.items()) and got[5, 5].matched == got[5, 5].windows
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(df, bench, decontam.LeakRules(block_rows=3)).collect()} == set(got)


def test_leaks_with_slots_that_become_equal(spark):
    odd = spark.createDataFrame([(1, "if x equals 3 then add 5 to it and then take 7 from it again")], "item_id long, text string")
    said = spark.createDataFrame([(1, "if x equals 4 then add 4 to it and then take 4 from it again"), (2, "if x equals 4 then add 4 to it and then take 9 from it again")], "doc_id long, text string")
    assert {(r.doc_id, r.verbatim, r.matched == r.windows) for r in decontam.contaminated(said, odd).collect()} == {(1, False, True), (2, False, True)}


def test_leaks_of_items_of_one_template(spark):
    # the first item's values are equal, so other parameters have to be equal, too; the second's needn't
    items = [(1, "if x equals 3 then add 3 to it and then take 3 from it again"), (2, "if x equals 4 then add 5 to it and then take 6 from it again")]
    rows = [(1, "if x equals 7 then add 8 to it and then take 9 from it again"), (2, "if x equals 7 then add 7 to it and then take 7 from it again"), (3, items[1][1])]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.verbatim for r in decontam.contaminated(df, bench).collect()}
    assert got == {(1, 2): False, (2, 1): False, (2, 2): False, (3, 2): True}
    assert decontam.drop_contaminated(df, bench).count() == 0


def test_windows_leave_their_tokens_behind(spark):
    # a row that leaves generated code is copied, and those of a document wait there together
    items = [(1, "if x equals 3 then add 5 to it and then take 7 from it again")]
    df, bench = spark.createDataFrame([(1, items[0][1]), (2, prose(60, 40))], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for rules in (decontam.LeakRules(), decontam.LeakRules(block_rows=3), decontam.LeakRules(block_rows=3, filter_rows=0)):
            caught = decontam.caught_rows(df, bench, rules)
            lines = [x for x in caught._jdf.queryExecution().executedPlan().toString().splitlines() if "tokens#" in x]
            assert lines and all("*(" in x for x in lines)
            assert [(x.doc_id, x.item_id, x.verbatim) for x in caught.collect()] == [(1, 1, True)]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


# --- 10 ------------------------------------------------------------------------------------


def test_permutations():
    for size in (2, 10, 37, 1000):
        assert sorted(surrogates.permute(i, size, b"k", "t") for i in range(size)) == list(range(size))
    made = {surrogates.surrogate("national", f"{i:03d}-00-0001", b"k") for i in range(1000)}
    assert len(made) == 1000
    s = surrogates.surrogate
    assert s("email", "Ab.34@mail7.example.com", b"k").lower() == s("email", "AB.34@MAIL7.example.com", b"k").lower()
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", s("phone", "+1 (017) 555-7713", b"k"))
    assert s("phone", "+1 (017) 555-7713", b"k")[-8:] == s("phone", "555-7713", b"k")
    d = s("card", "4539 5787 6362 1486", b"k").replace(" ", "")
    assert surrogates.luhn(d[:-1]) == int(d[-1])
    assert s("name", "Anna", b"k") in surrogates.GIVEN["latin-f"].split() and s("name", "Иван", b"k") in surrogates.GIVEN["cyrillic-m"].split()
    assert re.fullmatch("[А-ЯЁ][а-яё]+в", s("name", "Иванов", b"k"))
    assert s("ip", "10.0.0.1", b"k") != s("ip", "10.0.0.1", b"other")


def test_surrogates(spark):
    rows = [
        (1, "Dr. Anna Bakker mailed und.34@mail7.example.com from 152.143.123.131. Bakker rang +1 (980) 555-2833"), (2, "card 4785380592391139, token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" and 123-45-6789"),
        (3, "und.34@mail7.example.com again, version 2.0 of 2004, nothing else"), (4, None), (5, ""), (6, "a clean text\nwith lines"), (1, "rang 555-2833"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kinds string")
    a = {(r.doc_id, i): r for i, r in enumerate(surrogates.replace_pii(df).collect())}
    b = [r for r in surrogates.replace_pii(df, surrogates.SurrogateRules(max_redrawn=-1)).collect()]
    assert sorted(map(str, a.values())) == sorted(map(str, b))
    out = {r.doc_id: r.text for r in a.values() if not (r.doc_id == 1 and r.text.startswith("rang"))}
    whole = "\n".join(t or "" for t in out.values())
    for secret in ("und.34", "152.143.123.131", "980", "555-2833", "4785380592391139", "24be64439e", "123-45-6789", "Anna", "Bakker"):
        assert secret not in whole
    mail = re.search(r"\S+@\S+", out[3])[0].rstrip(",")
    assert mail in out[1] and "version 2.0 of 2004" in out[3]
    assert out[4] is None and out[5] == "" and out[6] == rows[5][1]
    assert surrogates.replace_pii(df.limit(0)).count() == 0


def test_collisions_are_redrawn(spark):
    # three-digit area codes: many real entities, so some surrogates hit a real one
    many = spark.createDataFrame([("national", f"{i:03d}{i % 100:02d}0000", f"{i:03d}-{i % 100:02d}-0000") for i in range(400)], "kind string, entity string, form string")
    got = surrogates.draw_surrogates(many).collect()
    assert len({r.made for r in got}) == 400 and not {r.made for r in got} & {r.entity for r in got}
    dense = spark.createDataFrame([("name", chr(97 + i), chr(97 + i) + "a") for i in range(3)] + [("name", x, x) for x in ("ba", "ca")], "kind string, entity string, form string")
    got = surrogates.draw_surrogates(dense).collect()
    assert len({r.made for r in got}) == len(got) and not {r.made for r in got} & {r.entity for r in got}


def test_initials_and_full_formats(spark):
    text = "John F. Kennedy met Anna B Smit. Vitamin F and F. stay; Kennedy spoke to Smit"
    assert [(text[a:b], k) for a, b, k in surrogates.detect(text)] == [("John", "name"), ("F", "initial"), ("Kennedy", "name"), ("Anna", "name"), ("B", "initial"), ("Smit", "name"), ("Kennedy", "name"), ("Smit", "name")]
    rows = [(1, text), (2, "said John I"), (3, "Robert J.R. Bakker")]
    out = {r.doc_id: r.text for r in surrogates.replace_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert re.fullmatch(r"\w+ [A-EG-Z]\. \w+ met \w+ [AC-Z] \w+\. Vitamin F and F\. stay; \w+ spoke to \w+", out[1])
    assert not re.search("John|Kennedy|Anna|Smit|Robert|Bakker", "".join(out.values())) and re.fullmatch(r"said \w+ I", out[2])
    # formats without a free surrogate: all of a vowel + x, one letter, letters of no alphabet
    forms = [*(v + "x" for v in "aeiouy"), "Q", "Žž"]
    full = spark.createDataFrame([("name", f.casefold(), f) for f in forms], "kind string, entity string, form string")
    got = surrogates.draw_surrogates(full, surrogates.SurrogateRules(max_tweaks=2)).collect()
    assert len({r.made for r in got}) == len(forms) == len(got) and not {r.made for r in got} & {r.entity for r in got}
    for kind, form in (("card", "4539 5787 6362 1486"), ("national", "123-45-6789"), ("iban", "NL91 ABNA 0417 1643 00"), ("phone", "555-7713"), ("email", "a@b.nl"), ("secret", "abcdef0123")):
        made = {n: surrogates.canonical(kind, surrogates.surrogate(kind, form, b"k", n, 2)) for n in range(5)}
        assert [len(made[n]) - len(made[0]) for n in range(5)] == [0, 0, 1, 2, 3]


def test_given_names_keep_gender_when_all_are_real(spark):
    listed = {n.casefold(): g for g, names in surrogates.GIVEN.items() for n in names.split()}
    ends = {g: tuple(e.casefold().split()) for g, (_, _, e) in surrogates.COMPOSED.items()}
    real = spark.createDataFrame([("name", n, n.capitalize()) for n in listed], "kind string, entity string, form string")
    got = surrogates.draw_surrogates(real).collect()
    assert len({r.made for r in got}) == len(listed) and not {r.made for r in got} & set(listed)
    for r in got:
        assert [g for g in ends if r.made.endswith(ends[g])] == [listed[r.entity]], r
    # no composed name is a listed one, nor do two indexes meet
    for g, (consonants, vowels, endings) in surrogates.COMPOSED.items():
        shape = re.compile(f"(?:[{consonants}][{vowels}]){{2,}}(?:{endings.casefold().replace(' ', '|')})")
        assert not any(map(shape.fullmatch, listed))
        assert len({surrogates.composed_name(g, i, b"k", "t", 2) for i in range(2000)}) == 2000
    assert surrogates.surrogate("name", "ANNA", b"k", 5).isupper()


# --- pipeline ------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    bench = prose(5, 40)
    clean = [(i, prose(3000 + i, 90)) for i in range(40)]
    rows = clean + [(100, clean[0][1]), (101, clean[1][1] + " more"), (102, prose(50, 60) + " " + bench)]
    rows += [(200 + i, prose(4000 + i, 90) + "\nread our terms of use") for i in range(12)] + [(300, "short"), (301, None), (302, "")]
    sf = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.table(stage(spark, docs, sf), f"test-{name}")
        if name != "packing":
            assert out.columns == docs.columns
        seen.append({r.doc_id for r in out.select("doc_id").collect()})
        if name == "line_dedup":
            assert not out.where("text like '%terms of use%'").count() and not out.where("n_chars <> length(text)").count()
        docs = out
    good = set(range(40)) | set(range(200, 212))
    assert seen[0] == seen[1] == good | {100, 101, 102}
    assert seen[2] == good | {102} and seen[3] == good == seen[4]
