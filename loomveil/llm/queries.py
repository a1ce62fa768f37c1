"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomveil.llm import chatfmt, decontam, divergence, linededup, minhash, packing, periods, quality, repeats, scratch, sharding, surrogates, urlfilter, warc

URL_RULES = (
    urlfilter.Rule("com", "/en/", "block"),
    urlfilter.Rule("example.com", "/en/7", "allow"),
    urlfilter.Rule("net", "/de/", "allow"),
    urlfilter.Rule("example.net", "/de/8", "block"),
    urlfilter.Rule("org", "/es/", "block"),
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(read(spark, sf_dir, "pages"), URL_RULES)


def op2_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(read(spark, sf_dir, "documents"), 16)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(read(spark, sf_dir, "documents"))


def op5_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chatfmt.preference_pairs(read(spark, sf_dir, "conversations"))


def op6_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"), scratch.new_path(spark, "archives"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())


def op9_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a key for tests, so that runs agree; whoever replaces real data brings a secret one
    rules = surrogates.SurrogateRules(key=b"key of the registered query, for tests only")
    return surrogates.replace_pii(read(spark, sf_dir, "documents"), rules).select("doc_id", "text", "n_entities", "kinds")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digest(periods.with_periods(read(spark, sf_dir, "documents")))


def op12_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(read(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_url_cascade, op2_quality_ratio, op3_byte_shards, op4_line_dedup, op5_preferences, op6_warc_chain, op7_near_dedup, op8_vector_packing, op9_template_leaks, op10_surrogates, op11_periodic_runs, op12_repeated_passages, op13_source_divergence)
    return {f.__name__: f for f in made}


_HOST = r"translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '')"
_WORD, _TERM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES = {
    "op1_url_cascade": f"""
        with parsed as (select page_id, {_HOST} as host, {_PATH} as path from pages),
        rules(rh, rp, action) as (values {", ".join(f"('{r.host}', '{r.path}', '{r.action}')" for r in URL_RULES)}),
        fits as (
            select page_id, host, path, rh || rp as rule, action,
                   row_number() over (partition by page_id order by length(rh || rp) desc, length(rh) desc) as k
            from parsed, rules where (host = rh or host like '%.' || rh) and starts_with(path, rp))
        select p.page_id, p.host, p.path, f.rule, coalesce(f.action, 'allow') as verdict
        from parsed p left join fits f on p.page_id = f.page_id and f.k = 1""",
    "op4_line_dedup": f"""
        with rows as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
        cut as (select r, doc_id, string_split(text, chr(10)) as lines from rows),
        flat as (select r, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as nr from cut),
        keyed as (select *, translate(trim(line, {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from flat),
        frequent as (select k from keyed where k <> '' group by k having count(distinct r) >= 10)
        select doc_id, count(*) as n_lines, count(*) filter (where f.k is not null) as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by nr) filter (where f.k is null), '')) as kept_sha256
        from keyed left join frequent f on keyed.k = f.k group by r, doc_id""",
    "op5_preferences": r"""
        with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
        c as (select conv_id, count(*) as k, list({'role': role, 'text': text} order by turn nulls first, role, text) as turns from t group by conv_id),
        o as (select *, turns[1] as opening, count(*) over (partition by turns[1]) as n, row_number() over (partition by turns[1] order by k desc, conv_id desc) as nth,
                     list_filter(range(1, k + 1), lambda i: turns[i].role = 'assistant') as replies from c),
        s as (select *, replies[1] as first, replies[-1] as last from o where n = 1),
        f as (select *, coalesce(first < last and turns[first].text <> turns[last].text, false) as fit from s),
        p as (select b.conv_id as chosen_id, o.conv_id as rejected_id, 'sibling' as source, b.turns as a, o.turns as b from o join o b on b.opening = o.opening and b.nth = 1 where o.nth > 1
              union all select conv_id, case when fit then conv_id end, case when fit then 'earlier reply' else 'unpaired' end,
                               case when fit then turns[1:last] end, case when fit then list_concat(turns[1:last - 1], [turns[first]]) end from f),
        m as (select *, least(len(a), len(b)) as l, list_position(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i]), false) as d from p),
        k as (select chosen_id, rejected_id, source, case when coalesce(d, 0) = 0 then l else d - 1 end as q, a, b from m),
        e as (select chosen_id, rejected_id, source, q::int as shared_turns, a[1:q] as pre, a[q + 1:] as x, b[q + 1:] as y from k),
        r as (select *, list_transform(pre, lambda z: '<|' || replace(z.role, '<|', '<\|') || '|>' || chr(10) || replace(z.text, '<|', '<\|') || '<|end|>' || chr(10)) as rp,
                     list_transform(x, lambda z: '<|' || replace(z.role, '<|', '<\|') || '|>' || chr(10) || replace(z.text, '<|', '<\|') || '<|end|>' || chr(10)) as rx,
                     list_transform(y, lambda z: '<|' || replace(z.role, '<|', '<\|') || '|>' || chr(10) || replace(z.text, '<|', '<\|') || '<|end|>' || chr(10)) as ry from e)
        select chosen_id, rejected_id, source, shared_turns, case when shared_turns is not null then coalesce(array_to_string(rp, ''), '') end as prompt,
               case when shared_turns is not null then coalesce(array_to_string(rx, ''), '') end as chosen,
               case when shared_turns is not null then coalesce(array_to_string(list_transform(list_filter(range(1, len(x) + 1), lambda i: x[i].role = 'assistant'),
                   lambda i: (coalesce(length(array_to_string(rx[1:i - 1], '')), 0) + 14)::varchar || '-' || length(array_to_string(rx[1:i], ''))::varchar), ','), '') end as chosen_mask,
               case when shared_turns is not null then coalesce(array_to_string(ry, ''), '') end as rejected,
               case when shared_turns is not null then coalesce(array_to_string(list_transform(list_filter(range(1, len(y) + 1), lambda i: y[i].role = 'assistant'),
                   lambda i: (coalesce(length(array_to_string(ry[1:i - 1], '')), 0) + 14)::varchar || '-' || length(array_to_string(ry[1:i], ''))::varchar), ','), '') end as rejected_mask
        from r""",
    "op6_warc_chain": """
        with p as (select page_id, coalesce(html, '') as html from pages),
        d as (select page_id, strlen(html)::bigint as payload_bytes, sha1(html) as payload_digest,
                     max(page_id) over (partition by html) as top from p)
        select page_id, payload_bytes, payload_digest,
               case when payload_bytes >= 1000 and page_id <> top then 'revisit' else 'response' end as record_type,
               case when payload_bytes >= 1000 and page_id <> top then top end as refers_to, true as intact from d""",
    "op11_periodic_runs": rf"""
        with rows as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint) as id from documents),
        hashed as (select r, doc_id, w, len(w) as n, coalesce(xor(4294967295, list_reduce(list_prepend(4294967295, id), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))), 1) as h from rows),
        placed as (select *, case when h % 10 = 0 and n > 0 then (h // 10) % n end as a from hashed),
        paced as (select *, 1 + (n - a) // (3 + (h // 10) % 8) as p from placed),
        docs as (select r, doc_id, n, case when a is null then w else list_transform(range(0, n), lambda i: w[1 + case when i >= a then a + (i - a) % p else i end]) end as w from paced),
        words as (select r, n, unnest(w) as v, generate_subscripts(w, 1) - 1 as i from docs),
        grams as (select r, n, i, md5(v || ' ' || lead(v, 1) over o || ' ' || lead(v, 2) over o || ' ' || lead(v, 3) over o || ' ' || lead(v, 4) over o) as g from words window o as (partition by r order by i)),
        again as (select a.r, b.i - a.i as q, a.i from grams a join grams b on a.r = b.r and a.g = b.g and a.i < b.i and 4 * (b.i - a.i) <= a.n),
        islands as (select *, i - row_number() over (partition by r, q order by i) as island from again),
        found as (select r, q, min(i) as s, count(*) + 4 + q as l from islands group by r, q, island having count(*) + 4 + q >= greatest(6, 4 * q)),
        runs as (select r, s, l, min(q) as q from found group by r, s, l),
        gone as (select distinct r, unnest(range(s + q, s + l)) as i from runs),
        left_over as (select w.r, string_agg(v, ' ' order by i) as t from words w anti join gone using (r, i) group by w.r),
        per as (select r, count(*) as n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) as t from runs group by r),
        best as (select * from runs qualify row_number() over (partition by r order by l / q desc, s, q) = 1)
        select doc_id, coalesce(n_runs, 0)::bigint as n_runs, s::bigint as start, l::bigint as length, q::bigint as period, (1000 * l // q)::bigint as exponent_milli,
               sha256(coalesce(per.t, '')) as runs_sha256, sha256(coalesce(left_over.t, '')) as collapsed_sha256
        from docs left join per using (r) left join best using (r) left join left_over using (r)""",
    "op12_repeated_passages": rf"""
        with rows as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents),
        spots as (select r, unnest(range(1, len(w) - 33)) as i, w from rows where len(w) >= 35),
        windows as (select r, i, md5(array_to_string(w[i:i + 34], ' ')) as k from spots),
        twice as (select k from windows group by k having count(*) > 1),
        gone as (select distinct r, unnest(range(i, i + 35)) as i from windows where k in (select k from twice)),
        per as (select r, list(i) as gone, count(*) as n from gone group by r),
        kept as (select rows.*, per.n, list_filter(range(1, len(w) + 1), lambda i: not list_contains(coalesce(gone, []), i)) as stay from rows left join per using (r))
        select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(array_to_string(list_transform(stay, lambda i: w[i]), ' '), '')) as kept_sha256 from kept""",
    "op13_source_divergence": rf"""
        with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
        found as (select r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) as term from d),
        kept as (select lang, term, count(*) as n from found group by lang, term having count(distinct r) >= 30),
        counts as (select lang, source, term, count(*) as n from found semi join kept using (lang, term) group by lang, source, term),
        grp as (select distinct lang, source from d),
        lsize as (select lang, sum(n) as total, count(*) as v from kept group by lang),
        gsize as (select g.lang, g.source, coalesce(sum(c.n), 0) as total from grp g left join counts c using (lang, source) group by g.lang, g.source),
        p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (g.total + 5 * l.v) as p, 1 + (1000000000::hugeint * (k.n + 5)) // (l.total + 5 * l.v) as q
              from gsize g join lsize l using (lang) join kept k using (lang) left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
        far as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
        every as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
                  from grp a join grp b on a.lang = b.lang and a.source <> b.source left join far f on f.lang = a.lang and f.source = a.source and f.item = b.source
                  union all select lang, source, 'term', term, p - q from p where n > 0 and p > q),
        ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from every)
        select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 50""",
    "op7_near_dedup": r"""
        with recursive rows as (select row_number() over () as r, doc_id,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
        words as (select r, unnest(w) as v, generate_subscripts(w, 1) as p from rows),
        grams as (select r, v || ' ' || lead(v, 1) over o || ' ' || lead(v, 2) over o || ' ' || lead(v, 3) over o || ' ' || lead(v, 4) over o as g from words window o as (partition by r order by p)),
        flat0 as (select distinct r, g from grams where g is not null union all select r, array_to_string(w, ' ') from rows where len(w) between 1 and 4),
        sizes as (select rows.r, doc_id, count(g)::bigint as n from rows left join flat0 using (r) group by rows.r, doc_id),
        digests as (select r, md5(string_agg(g, chr(10) order by g)) as d from flat0 group by r),
        member as (select r, min(r) over (partition by d) as c from digests),
        flat as (select f.r as c, n, g from flat0 f join member m on m.r = f.r and m.c = f.r join sizes s on s.r = f.r),
        pairs as (select a.c as x, b.c as y, count(*) as i, any_value(a.n) as m, any_value(b.n) as n from flat a join flat b on a.g = b.g and a.c < b.c group by a.c, b.c),
        links as (select x, y from pairs where 100 * i >= 75 * (m + n - i)),
        edges as (select x, y from links union all select y, x from links),
        walk(x, y) as (select distinct c, c from member union select w.x, b.y from walk w join edges b on w.y = b.x),
        least as (select w.x as c, min(d.doc_id) as component_id from walk w join member m on m.c = w.y join sizes d on d.r = m.r group by w.x)
        select s.doc_id, s.n as n_shingles, case when s.n = 0 then s.doc_id else l.component_id end as component_id,
               s.doc_id is not distinct from case when s.n = 0 then s.doc_id else l.component_id end as kept
        from sizes s left join member m on m.r = s.r left join least l on l.c = m.c""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def deduped_lines(docs: DataFrame) -> DataFrame:
    """`docs` without frequent lines, and with no other column changed but n_chars, which follows the text."""
    out = linededup.dedup_lines(docs, counts=False)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
