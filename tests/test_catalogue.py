"""Queries of the catalogue on documents with formats that the given tables lack."""

from loomveil.operators import pii
from loomveil.plans import catalogue

TEXT = "Marelle de Bravaart, IBAN NL91 ABNA 0417 1643 00, geboren op 14-03-1948, gezien 15 maart 2023 en 1/2/99, mail a.b@testmail.example, Tel 06-12345678, 1234 AB, BSN 111222333"


def test_stats_count_every_format(spark, tmp_path):
    rows = [(1, TEXT, "nl", "a"), (2, "niets", "nl", "b"), (3, "op 14-03-1948", "en", "a")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    q = catalogue.queries()
    got = {r.doc_id: tuple(r)[1:] for r in q["pii_stats_by_doc"](spark, str(tmp_path)).collect()}
    assert got == {1: (1, 3, 1, 5), 2: (0, 0, 0, 0), 3: (0, 1, 0, 1)}
    assert {r.lang: tuple(r)[1:] for r in q["pii_stats_by_lang"](spark, str(tmp_path)).collect()} == {"nl": (1, 3, 5), "en": (0, 1, 1)}
    assert {(r.lang, r.source): r.total for r in q["pii_stats_rollup"](spark, str(tmp_path)).collect()}[None, None] == 6
    every = {r.doc_id: r.asDict() for r in q["pii_stats_all_by_doc"](spark, str(tmp_path)).collect()}
    one = every[1]
    assert [one[k] for k in ("bsn", "date", "iban", "email", "phone", "postcode")] == [1, 3, 1, 1, 1, 1] and one["name"] >= 1
    assert one["total"] == sum(v for k, v in one.items() if k not in ("doc_id", "total"))
    assert sum(r.total for r in q["pii_stats_all_by_lang"](spark, str(tmp_path)).collect()) == sum(r["total"] for r in every.values())
    assert {(r.lang, r.source): r.total for r in q["pii_stats_all_rollup"](spark, str(tmp_path)).collect()}[None, None] == sum(r["total"] for r in every.values())


def test_speaker_labels_of_all_lines(spark, tmp_path):
    text = "Marelle Bravaart\nhallo daar\n04:20\n Sodika de Kelmoed\nMarelle Bravaart\n1:02:03\nGoed Weer Vandaag.\n01:05\nPeter van Dijk"
    rows = [(1, text), (2, "Geen Xq Label"), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.line_no, r.line) for r in catalogue.queries()["speaker_labels_all"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0, "Marelle Bravaart"), (1, 3, " Sodika de Kelmoed"), (1, 8, "Peter van Dijk")}


def test_types_that_are_not_enabled_hide_nothing(spark, tmp_path):
    # the postcode "1234 AB" would begin before the address AB@b.nl and hide it; a note without a name has no text
    rows = [(1, "K1"), (2, "1234 AB@b.nl"), (3, None), (4, "a@b.nl c@d.nl"), (4, "K4")]
    spark.createDataFrame(rows, "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    got = catalogue.queries()["enabled_types"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 1), (2, 2), (3, None), (4, 1), (4, 3)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan  # a note is counted where it was searched
    texts = spark.createDataFrame([(1, "1234 AB@b.nl"), (2, None)], "doc_id long, text string")
    found = lambda **only: [r.original for r in pii.native_matches(texts, ["postcode", "email"], **only).collect()]
    assert found() == ["1234 AB"] and found(enabled=("email",)) == ["AB@b.nl"] and found(enabled=()) == []
    assert [tuple(r) for r in pii.native_counts(texts, ["email"], enabled=()).orderBy("doc_id").collect()] == [(1, 0), (2, None)]
