import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomveil.functions import redaction as r
from loomveil.functions.names import Lexicon, detect_names, likely_surname, sweep
from loomveil.operators import pii

LEX = Lexicon(frozenset("Jan Anna Jeroen Tom Klaas Maria".split()), frozenset("Bakker Vries Polet Klein Visser Meer".split()))
CFG = r.FilterConfig(lexicon=LEX)


def found(text, kind):
    return [m.original for m in r.find_matches(text, CFG.updated(enabled_types=(kind,)))]


@pytest.mark.parametrize(
    ("kind", "text", "expected"),
    [
        ("bsn", "123456782", ["123456782"]), ("bsn", "1234.56.782", ["1234.56.782"]), ("bsn", "BSN 987654321", ["987654321"]), ("bsn", "987654321", []), ("bsn", "000000000", []),
        ("date", "14-03-1948", ["14-03-1948"]), ("date", "1/2/99", ["1/2/99"]), ("date", "15 maart 2023", ["15 maart 2023"]), ("date", "3 jan. 1990", ["3 jan. 1990"]),
        ("date", "geb. 01-01-1970", ["geb. 01-01-1970"]), ("date", "32-01-2020", []), ("date", "10-13-2020", []), ("date", "07-02-2026Organisatie", ["07-02-2026"]),
        ("iban", "NL91 ABNA 0417 1643 00", ["NL91 ABNA 0417 1643 00"]), ("iban", "NL91ABNA0417164300", ["NL91ABNA0417164300"]), ("iban", "nl91abna0417164300", []),
        ("email", "k.bakker@testmail.example", ["k.bakker@testmail.example"]), ("email", "a@b.NL", []),
        ("phone", "06-12345678", ["06-12345678"]), ("phone", "06 12 34 56 78", ["06 12 34 56 78"]), ("phone", "+31 6 99998888", ["+31 6 99998888"]), ("phone", "020 123 45 67", ["020 123 45 67"]),
        ("phone", "Tel: 06–10101010", ["Tel: 06–10101010"]), ("phone", "06-12345", []),
        ("postcode", "1017 AB", ["1017 AB"]), ("postcode", "1017AB", ["1017AB"]), ("postcode", "0999 AB", []), ("postcode", "1017 ab", []),
        ("address", "Parklaan 12", ["Parklaan 12"]), ("address", "Woustraat 99 hs", ["Woustraat 99 hs"]), ("address", "Parklaan", []),
        ("name", "dhr. Jan Bakker", ["Jan Bakker"]), ("name", "zei Anna de Vries gisteren", ["Anna de Vries"]), ("name", "J. van der Meer", ["J. van der Meer"]),
        ("name", "(Vries, Anna)", ["Vries, Anna"]), ("name", "JEROEN DE VRIES", ["JEROEN DE VRIES"]), ("name", "met Tom naar", ["Tom"]), ("name", "Zonder namen", []),
        ("name", "Anna de Vries en later Devries", ["Anna de Vries", "Devries"]), ("name", "Jan in de tuin", ["Jan in de tuin"]),
    ],
)
def test_detectors(kind, text, expected):
    assert found(text, kind) == expected


def test_overlaps_numbers_and_restore():
    text = "Tom Polet (BSN 123456782) mailt a@b.nl. Polet belt 06-12345678, Tom ook. IBAN NL91 ABNA 0417 1643 00"
    m = r.find_matches(text, CFG)
    out = r.spliced(text, m)
    assert [x.placeholder for x in m if x.type == "name"] == ["[NAME-001]"] * 3
    assert "[IBAN-001]" in out and r.restored(out, m) == text
    assert r.stats(m)["phone"] == 1 and sum(r.stats(m).values()) == len(m)
    assert r.find_matches(text, CFG.updated(exclude_words=("TOM POLET",)))[0].type == "bsn"
    assert r.spliced(text, r.find_matches(text, CFG.updated(placeholder_style="redacted"))).count("█") == sum(len(x.original) for x in m)


def test_numbers_past_999_keep_their_digits():
    assert r.placeholder("bsn", 1000, "x", "bracket") == "[BSN-1000]"


def test_normalised_maps_back():
    text = "ver-\n  volg­ a\t\tb1C"
    seen, at = r.normalised(text)
    assert seen == "vervolg a b1 C"
    assert r.mapped_back(12, 14, at) == (len(text) - 1, len(text))


def test_sweep_and_surnames():
    assert sweep([(3, 20), (0, 5), (0, 9), (9, 10)]) == [(0, 9), (9, 10)]
    assert likely_surname("Dijkstra") and not likely_surname("maart") and not likely_surname("Xy")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("Jan Anna de Vries Bakker, 123456782 a@b.nl \n 06-12345678 . dhr. Klein é ­ 1017AB van Tom-Jan".split(" ")), max_size=25))
def test_matches_are_disjoint_and_restore(words):
    text = " ".join(words)
    m = r.find_matches(text, CFG)
    assert all(a.end <= b.start for a, b in zip(m, m[1:], strict=False))
    assert all(text[x.start : x.end] == x.original for x in m)
    assert r.restored(r.spliced(text, m), m) == text
    spans = detect_names(text, LEX)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_dataframe_filter(spark):
    rows = [(1, "Mail a@b.nl en 06-12345678"), (2, None), (3, ""), (1, "Mail a@b.nl en 06-12345678")]
    df = spark.createDataFrame([(*x, "old") for x in rows], "doc_id long, text string, matches string")
    out = pii.filter_documents(df, CFG)
    got = sorted(out.select("doc_id", "filtered_text").collect(), key=str)
    assert [tuple(g) for g in got] == sorted([(1, "Mail [EMAIL-001] en [PHONE-001]"), (2, None), (3, ""), (1, "Mail [EMAIL-001] en [PHONE-001]")], key=str)
    s = {x.doc_id: x for x in pii.stats(out).collect()}
    assert s[1].email == 2 and s[1].total == 4 and s[2].total == 0
    back = pii.restore_documents(out).select("text", "restored_text").collect()
    assert all(x.text == x.restored_text for x in back)
    native = pii.native_redaction(df.drop("matches"), ["email", "phone_mobile"]).where("doc_id = 1").first()
    assert native.filtered_text == "Mail [EMAIL-001] en [PHONE-001]"
    assert pii.filter_documents(df.limit(0), CFG).count() == 0


def test_tabular(spark):
    t = spark.createDataFrame([(1, "Anna de Vries", "x"), (2, "Vries belde", None)], "id int, naam string, `` string")
    from pyspark.sql import functions as F

    cells = pii.to_cells(t, F.lit("s"), F.col("id"))
    out = {(x.row, x.col): x for x in pii.filter_cells(cells, CFG).collect()}
    assert out[1, 1].filtered_text == "[NAME-001]" and out[1, 2].header == "Kolom 3" and out[2, 2].filtered_text == ""
    assert {x.col: x.width for x in pii.column_widths(cells).collect()} == {0: 10, 1: 15, 2: 10}
    assert all(m.original == "[VERWIJDERD]" for x in pii.changed_cells(pii.filter_cells(cells, CFG)).collect() for m in x.matches)


def test_notes_are_dealt_and_numbers_counted_once(spark, tmp_path):
    from loomveil.plans import catalogue

    spark.range(1, 50).selectExpr("id as c_custkey", "'K' || id as c_name").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    notes = catalogue._notes(catalogue.read(spark, str(tmp_path), "customer"))
    assert notes.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    # the fold that numbers matches stands beside the matches, not in the lambda that is run for each of them
    plan = pii.native_redaction(notes, ["email", "iban"]).select("matches")._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with(__found" in plan
    got = pii.native_redaction(notes, ["email", "iban"]).selectExpr("transform(matches, m -> m.placeholder)").distinct().collect()
    assert [r[0] for r in got] == [["[EMAIL-001]", "[IBAN-001]"]]


def test_batches_are_cut_into_few_rows(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"x": list(range(1000))})
    cut = list(pii._slices(iter([batch, batch.slice(0, 0)])))
    assert max(b.num_rows for b in cut) == pii.SLICE_ROWS and [x for b in cut for x in b.column("x").to_pylist()] == list(range(1000))
    df = spark.range(0, 700, 1, 1).selectExpr("id as doc_id", "'Mail a' || id || '@b.nl' as text")
    out = pii.restore_documents(pii.filter_documents(df, CFG))
    assert out.where("restored_text = text and filtered_text = 'Mail [EMAIL-001]'").count() == 700


def test_spans_are_sent_to_no_executor_whole(spark):
    kind = "doc_id long, start_offset long, end_offset long"
    a = spark.createDataFrame([(d, s, s + 9) for d in range(20) for s in range(0, 600, 7)], kind)
    b = spark.createDataFrame([(d, s, s + 12) for d in range(20) for s in (d, 200 + 3 * d, 203 + 3 * d, 390)], kind)
    near, free = pii.near_spans(a, b, 60), pii.uncovered_spans(a, b)
    others = [(d, (d, d + 12, 200 + 3 * d, 212 + 3 * d, 203 + 3 * d, 215 + 3 * d, 390, 402)) for d in range(20)]
    assert sorted((x.doc_id, x.start_offset) for x in near.collect()) == [(d, s) for d, at in others for s in range(0, 600, 7) if any(abs(p - s) < 60 for p in at)]
    assert sorted((x.doc_id, x.start_offset) for x in free.collect()) == [(d, s) for d, at in others for s in range(0, 600, 7) if not any(s < at[i + 1] and s + 9 > at[i] for i in (0, 2, 4, 6))]
    for joined in (near, free):
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_texts_without_what_a_match_needs_are_not_searched(spark):
    from loomveil.functions import columns as c

    texts = ["Mail a1@b.nl", "a at b", None, "", "op 1-2-2024, 3/4/99 en 15 maart 2023", "in april 2024, geb. 1-2-1990", "IBAN NL12 ABNA 0417 1234 30", "1.2 1234"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").orderBy("id")
    for name, needs in c.NEEDS.items():
        guarded, plain = (rows.select(c.spans(F.col("text"), c.PATTERNS[name][0], n).alias("m")) for n in (needs, None))
        assert guarded.collect() == plain.collect() and guarded.where("size(m) > 0").count() > 0
        plan = rows.select(c.detected(F.col("text"), name).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
        assert "CASE WHEN NOT" in plan  # the guard stands before the search


def test_a_detector_searches_a_text_once(spark):
    import re

    from loomveil.functions import columns as c

    mark = "\ue000"
    texts = [
        None, "", mark, "niets", f"{mark}123456782{mark}{mark} 111222333", "\U0001f600 1234.56.782 en\n14-03-1948, 1/2/99, 15 Maart 2023, MEI 2024, xmei 2024, Geb. 1.2.1990", f"a.b%c@d.e.nl{mark}x+y@z.nl a@b a@@b.nl",
        "NL91 ABNA 0417 1643 00 NL91ABNA0417164300, 1017AB 0999 ZZ 1234 ab", "06-12345678 0612345678 020 123 45 67 +31 6 99998888 0031(0)6-12345678 +31 20 1234567 Telefoon: (030) 123456 tel:1",
        "Parklaan 12, Oude hoge Woustraat 99 hs! éParklaan 3 Eéndaan 4 Lange straat 12345 b", "\u00e9123456782 _123456782 x123456782",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").orderBy("id")
    for name, patterns in c.PATTERNS.items():
        for p in patterns:
            made = rows.select(c.spans(F.col("text"), p, c.NEEDS.get(name)).alias("m"))
            expected = [None if t is None else [(x.start(), x.end(), x[0]) for x in re.finditer(p, t, re.ASCII)] for t in texts]
            assert [None if r.m is None else [tuple(x) for x in r.m] for r in made.collect()] == expected and any(expected), name
            plan = made._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("regexp_replace(") == 1 and "regexp_extract_all" not in plan and plan.count("split(") == 1
