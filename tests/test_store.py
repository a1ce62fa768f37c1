"""Stored tables and indexes, sinks, formatted sheets, streamed upserts and whole conversations."""

import sqlite3
import zipfile
from io import BytesIO

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomveil.functions import redaction as r
from loomveil.functions.names import Lexicon
from loomveil.functions.redaction import FilterConfig
from loomveil.operators import chat, pii, search
from loomveil.sources import files, store
from loomveil.sources.parts import Parts
from loomveil.streaming import ingest

import golden

TEXTS = ["running dogs run fast", "the quick brown fox", "a dog ran away. The dogs run", "runs and runners running", "nothing here", "fox fox fox dog", "quick the brown run dogs", "dogs run dogs run"]


def fts(query):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, id unindexed, tokenize='porter unicode61')")
    db.executemany("insert into t values (?, ?)", [(t, i) for i, t in enumerate(TEXTS)])
    return {i: -s for i, s in db.execute("select id, bm25(t) from t where t match ?", (query,))}


@pytest.mark.parametrize("query", ['"dogs run"', '"the quick" brown', "fox OR runners", "quick brown OR away", 'runn* OR "dogs run"', "brown AND fox", '"dogs ru"*'])
def test_phrases_and_operators_equal_sqlite(spark, query):
    chunks = spark.createDataFrame([(str(i), i, t) for i, t in enumerate(TEXTS)], "chunk_id string, document_id int, content string")
    asked = [[(tuple(search.stem(w) for w in words), p) for words, p in alternative] for alternative in search.parse_query(query)]
    got = {x.document_id: x.score for x in search.match(search.build_index(chunks), asked).collect()}
    assert got == pytest.approx(fts(query))


def test_parse_query():
    assert search.parse_query("term") == [[(("term",), True)]]
    assert search.parse_query("a b") == [[(("a",), False), (("b",), False)]]
    assert search.parse_query("'a b' OR c*") == [[(("a", "b"), False)], [(("c",), True)]]
    assert search.parse_query('"a b') == [[(("a",), False), (("b",), False)]]
    assert search.parse_query("OR") == [[(("or",), True)]] and search.parse_query("x OR") == [[(("x",), False), (("or",), False)]]
    assert search.parse_query(" ?!") == [] and search.parse_query('""') == [] and search.parse_query("well-known") == [[(("well",), False), (("known",), False)]]


def test_stored_index(spark, tmp_path):
    path = str(tmp_path)
    rows = [(str(i), i, t) for i, t in enumerate([*TEXTS, None, ""])]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id int, content string")
    search.insert_chunks(chunks.where("document_id < 3"), path)
    search.insert_chunks(chunks.where("document_id >= 3"), path)
    every = lambda: {x.document_id: x.score for x in search.bm25(search.open_index(spark, path), [("dog", False)]).collect()}
    assert every() == pytest.approx({x.document_id: x.score for x in search.bm25(search.build_index(chunks), [("dog", False)]).collect()})
    search.delete_documents(chunks.where("document_id in (0, 5)"), path)
    search.insert_chunks(chunks.where("document_id = 0"), path)
    left = chunks.where("document_id <> 5")
    assert every() == pytest.approx({x.document_id: x.score for x in search.bm25(search.build_index(left), [("dog", False)]).collect()})
    plan = search.match(search.open_index(spark, path), [[(("dog",), False)]])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan or "folder#" in plan.split("PartitionFilters:")[1][:200]


def test_tables(spark, tmp_path):
    path = str(tmp_path)
    store.create_tables(spark, path)
    now = F.lit("2024-05-01").cast("timestamp")
    docs = spark.createDataFrame([("a", "A", "/a", "alpha one\n\nbeta two"), (None, "B", "/b", None)], "id string, name string, path string, text string")
    store.insert_documents(docs, path, now)
    store.insert_documents(docs.limit(1).select(F.lit("c").alias("id"), F.lit("/c").alias("path"), F.lit("gamma").alias("text")), path)
    held = store.table(spark, path, "documents")
    assert {r.path for r in held.collect()} == {"/a", "/b", "/c"} and held.where("id is null").count() == 0
    assert [r.id for r in store.by_key(held, path="/a").collect()] == ["a"] and store.newest_first(held).first().id == "c"
    chunks = store.table(spark, path, "chunks")
    assert {r.document_id for r in chunks.collect()} == {"a", "c"} and [r.chunk_index for r in store.chunks_of(chunks, "a").collect()] == [0]
    assert {r.document_id: r.full_text for r in store.joined_chunks(chunks).collect()} == {"a": "alpha one\n\nbeta two", "c": "gamma"}
    hits = search.search(search.open_index(spark, path), chunks.withColumnRenamed("id", "chunk_id"), held.select(F.col("id").alias("doc_id"), "name"), "beta")
    assert [(r.document_id, r.name) for r in hits.collect()] == [("a", "A")]
    store.insert(spark.createDataFrame([("k", ["a"]), ("m", None)], "id string, document_ids array<string>"), path, "conversations", now)
    talks = store.table(spark, path, "conversations")
    assert {(r.id, r.title, tuple(r.document_ids)) for r in talks.collect()} == {("k", chat.DEFAULT_TITLE, ("a",)), ("m", chat.DEFAULT_TITLE, ())}
    again = store.from_json_columns(store.to_json_columns(talks))
    assert sorted(map(str, again.collect())) == sorted(map(str, talks.collect()))
    store.create_tables(spark, path)
    assert store.table(spark, path, "documents").count() == 3


def test_conversation_is_kept(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    one = spark.createDataFrame([("k", chat.DEFAULT_TITLE, ["1"], 0)], "id string, title string, document_ids array<string>, t int").select("id", "title", "document_ids", now.alias("created_at"), now.alias("updated_at"))
    none = spark.createDataFrame([], "conversation_id string, seq int, role string, content string, sources array<struct<chunk_id:string,document_id:string,document_name:string,content:string,score:double>>, created_at timestamp")
    res = spark.createDataFrame([("k1", 1, "A", "x", 1.0)], "chunk_id string, document_id int, name string, content string, score double")
    later = F.lit("2024-01-02").cast("timestamp")
    talks, said, text = chat.say(chat.EchoModel(), "Wat staat er in het verslag?", one, none, res, later)
    assert text.strip() == "Wat staat er in het verslag?" and [(r.role, r.seq) for r in said.orderBy("seq").collect()] == [("user", 1), ("assistant", 2)]
    row = talks.first()
    assert row.title == "Wat staat er in het verslag?" and str(row.updated_at).startswith("2024-01-02")
    assert said.where("role = 'assistant'").first().sources[0].document_name == "A"
    talks, said, _ = chat.say(chat.EchoModel(), "en nu", talks, said, res, later)
    assert talks.first().title == "Wat staat er in het verslag?" and said.count() == 4
    assert chat.answer_text(chat.EchoModel(), "a b", res).strip() == "a b"


def test_sinks(spark, tmp_path):
    cells = spark.createDataFrame([("/in/een.xlsx", r, k, h, f"{h}{r}" if (r, k) != (1, 1) else None) for r in range(3) for k, h in enumerate(["naam", "code"])], "sheet string, row int, col int, header string, filtered_text string")
    books = files.workbooks(cells)
    one = books.first()
    assert one.file_name == "een_gefilterd.xlsx" and one.rows == 3
    assert files.xlsx_rows(bytes(one.content)) == [["naam", "code"], ["naam0", "code0"], ["naam1", ""], ["naam2", "code2"]]
    audit = files.export_audit(books, F.lit("2024-01-01").cast("timestamp")).first()
    assert audit.items_filtered == 3 and audit.operation == "export"
    texts = spark.createDataFrame([("/in/a.txt", "een\ntwee"), ("/in/b.md", None)], "path string, filtered_text string")
    files.write_filtered(texts, str(tmp_path / "out"))
    a, = (tmp_path / "out" / "file_name=a_gefilterd.txt").glob("part-*")
    assert a.read_text(encoding="utf-8") == "een\ntwee\n" and len(list((tmp_path / "out").glob("file_name=b_gefilterd.txt"))) == 1


def test_workbooks_are_packed_and_read_in_pieces(spark, tmp_path):
    import tracemalloc

    rows = spark.range(0, 5000, 1, 3).selectExpr("case when id % 7 = 0 then '/in/b.xlsx' else '/in/a.xlsx' end as sheet", "cast(id as int) as row", "explode(array(0, 2)) as col")
    cells = rows.selectExpr("sheet", "row", "col", "'k' || col as header", "case when row % 11 <> 0 then '<' || row || '&' || col end as filtered_text")
    made = {r.file_name: r for r in files.workbooks(cells).collect()}
    want = lambda which: [["k0", "k2"], *([f"<{i}&0", f"<{i}&2"] if i % 11 else ["", ""] for i in range(5000) if (i % 7 == 0) == which)]
    for name, which in (("b_gefilterd.xlsx", True), ("a_gefilterd.xlsx", False)):
        assert files.xlsx_rows(bytes(made[name].content)) == want(which) and made[name].rows == len(want(which)) - 1
        (tmp_path / name).write_bytes(bytes(made[name].content))
    cut = files.xlsx_bytes(["d"], [["x"], ["y"]])
    with zipfile.ZipFile(BytesIO(cut)) as old, zipfile.ZipFile(tmp_path / "c.xlsx", "w") as new:
        for n in old.namelist():
            new.writestr(n, old.read(n)[:-30] if n.endswith("sheet1.xml") else old.read(n))
    got = [(r.sheet.rsplit("/", 1)[-1], r.row, r.col, r.header, r.value) for r in files.read_cells(spark, str(tmp_path)).where("error is null").collect()]
    assert sorted(got) == sorted((name, i, k, f"k{2 * k}", v) for name, which in (("b_gefilterd.xlsx", True), ("a_gefilterd.xlsx", False)) for i, r in enumerate(want(which)[1:]) for k, v in enumerate(r))
    assert [r.error is None for r in files.read_cells(spark, str(tmp_path / "c.xlsx")).collect()] == [False]
    large = files.xlsx_bytes(["d", "e"], [[f"waarde {i}", "x"] for i in range(50_000)])
    tracemalloc.start()
    head, kept = files._compact_rows(large)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert head == ["d", "e"] and sum(map(len, kept)) == 50_000 and most < 10 << 20


def test_texts_are_files_of_their_names(spark, tmp_path):
    rows = [("/in/a.txt", "een\r\ntwee"), ("/in/b.md", None), ("/x/c.txt", "é"), ("/y/c.docx", "zonder eind\n"), ("/in/d", "")]
    out = tmp_path / "uit"
    done = files.write_texts(spark.createDataFrame(rows, "path string, filtered_text string").repartition(3), str(out)).collect()
    held = {p.name: p.read_bytes().decode() for p in out.iterdir() if not p.name.startswith(".")}
    assert {held[r.file_name] for r in done} == {t or "" for _, t in rows} and len(held) == 5
    by_path = {r.path: r for r in done}
    assert held["a_gefilterd.txt"] == "een\r\ntwee" and by_path["/x/c.txt"].file_name != by_path["/y/c.docx"].file_name
    assert all(r.bytes == len((dict(rows)[r.path] or "").encode()) for r in done)
    again = files.write_texts(spark.createDataFrame(rows, "path string, filtered_text string"), f"file://{out}").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, done)) and len(list(out.iterdir())) == 5


def test_every_text_comes_back(spark, tmp_path):
    from loomveil.plans import catalogue

    rows = [(1, "een"), (2, ""), (3, None), (4, "vier"), (4, "vijf"), (4, "vijf")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalogue.queries()["text_files"](spark, str(tmp_path)).collect()
    assert sorted((x.name, x.mime_type, x.size, x.text, x.error) for x in got) == sorted((f"{i}_gefilterd.txt", "text/plain", len(t or ""), t or "", None) for i, t in rows)


def test_files_are_read_by_tasks_as_by_spark(spark, tmp_path, monkeypatch):
    for name, text in (("x.txt", "een"), ("leeg.txt", ""), ("a b/y%20.txt", "twee"), ("a b/c+/z.md", ""), (".h.txt", "-"), ("_h/h.txt", "-"), ("k=1/v.txt", "vier")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
    with monkeypatch.context() as m:  # the driver lists nothing
        m.setattr(files, "_by_spark", None)
        got = files.contents(spark, str(tmp_path)).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, files.contents(spark, f"file://{tmp_path}").collect()))
    assert {x.path.split(f"{tmp_path}/")[1]: bytes(x.content).decode() for x in got} == {"x.txt": "een", "leeg.txt": "", "a b/y%20.txt": "twee", "a b/c+/z.md": "", "k=1/v.txt": "vier"}
    assert sorted(map(tuple, got)) == sorted(map(tuple, files._by_spark(spark, str(tmp_path), True).collect()))
    assert {x.path.rsplit("/", 1)[-1] for x in files.contents(spark, f"{tmp_path}/*.txt").collect()} == {"x.txt", "leeg.txt"}
    assert [x.length for x in files.contents(spark, f"{tmp_path}/leeg.txt").collect()] == [0]


def test_small_files_share_tasks(spark, tmp_path):
    for i in range(800):
        (tmp_path / f"{i}.txt").write_text(f"tekst {i}", encoding="utf-8")
    scan = spark.read.format("binaryFile").load(str(tmp_path))
    found = files.read_documents(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism < scan.rdd.getNumPartitions()
    assert {(x.name, x.text, x.error) for x in found.collect()} == {(f"{i}.txt", f"tekst {i}", None) for i in range(800)}


@pytest.mark.parametrize(("number", "code", "expected"), [("45000", "m/d/yy", "3/15/23"), ("45000.5", "yyyy\\-mm\\-dd hh:mm", "2023-03-15 12:00"), ("45000", "dd-mmm-yyyy", "15-Mar-2023"), ("0.5", "h:mm AM/PM", "12:00 PM"), ("0.256", "0%", "26%"), ("1234.5", "#,##0.00", "1,234.50"), ("2.345", "0.00", "2.35"), ("7", "General", "7"), ("7.25", "General", "7.25"), ("12", '"EUR" 0.0', "EUR 12.0"), ("x", "0", "x")])
def test_numbers_as_shown(number, code, expected):
    assert files.shown(number, code) == expected


def test_broken_workbooks_are_rows(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(files.xlsx_bytes(["d"], [["x"]]))
    (tmp_path / "b.xlsx").write_bytes(b"no workbook")
    (tmp_path / "c.xlsx").write_bytes(files.xlsx_bytes(["d"], []))
    styled = BytesIO()
    with zipfile.ZipFile(BytesIO(files.xlsx_bytes(["d"], [["x"]]))) as old, zipfile.ZipFile(styled, "w") as new:
        ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        for n in old.namelist():
            new.writestr(n, old.read(n) if "sheet1.xml" not in n else f'<worksheet xmlns="{ns}"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>d</t></is></c></row><row r="2"><c r="A2" s="1"><v>45000</v></c></row></sheetData></worksheet>')
        new.writestr("xl/styles.xml", f'<styleSheet xmlns="{ns}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
    (tmp_path / "d.xlsx").write_bytes(styled.getvalue())
    got = {r.sheet.rsplit("/", 1)[-1]: (r.value, bool(r.error)) for r in files.read_cells(spark, str(tmp_path)).collect()}
    assert got == {"a.xlsx": ("x", False), "b.xlsx": (None, True), "c.xlsx": (None, True), "d.xlsx": ("3/15/23", False)}


def test_sheets_in_blocks_have_one_lexicon(spark, monkeypatch):
    lex = FilterConfig(lexicon=Lexicon(frozenset(["Anna"]), frozenset(["Vries"])))
    rows = [(k, "Anna de Vries" if k == 0 else f"Vries {k}", f"s{k % 2}") for k in range(40)]
    t = spark.createDataFrame(rows, "id int, naam string, s string")
    cells = pii.to_cells(t.select("id", "naam", "s"), F.col("s"), F.col("id")).where("header = 'naam'")
    monkeypatch.setattr(pii, "BLOCK_ROWS", 4)
    assert {r.sheet: sorted(r.names) for r in pii.discovered_names(cells, lex).collect()} == {"s0": ["Anna", "Anna de Vries", "Vries"]}
    one = sorted(map(str, pii.filter_cells(cells, lex).collect()))
    monkeypatch.setattr(pii, "MOST_NAMES", -1)
    assert sorted(map(str, pii.filter_cells(cells, lex).collect())) == one


def test_blocks_are_held_one_by_one(spark, monkeypatch):
    lex = FilterConfig(lexicon=Lexicon(frozenset(["Anna", "Bram"]), frozenset(["Vries", "Bakker"])))
    rows = [(k if k % 7 else None, f"{('Anna', 'Bram')[k % 2]} {('de Vries', 'Bakker')[k % 3 % 2]} {k}" if k % 5 else " ", k % 3) for k in range(60)]
    cells = pii.to_cells(spark.createDataFrame(rows, "id int, naam string, s int").select("naam", "id", "s").repartition(7), F.col("s"), F.col("id")).where("col < 2")
    monkeypatch.setattr(pii, "BLOCK_ROWS", 4)
    texts = pii.filter_documents(pii.sheet_texts(cells, 4), lex).collect()
    expected = {s: {p for t in texts if t.sheet == s for m in t.matches if m.type == "name" for p in pii.name_parts(m.original)} for s in range(3)}
    found = pii.discovered_names(cells, lex)
    assert {x.sheet: set(x.names) for x in found.collect()} == expected and all(expected.values())
    assert "collect_list" not in found._jdf.queryExecution().executedPlan().toString()
    large = pa.RecordBatch.from_arrays([pa.array(["x" * (3 << 20)] * 9)], ["text"])
    assert [x.num_rows for x in pii._slices([large])] == [1] * 9


GOLDEN = FilterConfig(lexicon=Lexicon.of(golden.FIRST, golden.LAST))


def test_golden_document_by_reading():
    m = r.find_matches(golden.TEXT, GOLDEN)
    assert [(x.type, int(x.placeholder[-4:-1]), x.start, x.end) for x in m] == list(golden.MATCHES)
    assert r.restored(r.spliced(golden.TEXT, m), m) == golden.TEXT


def test_golden_document_as_a_table(spark):
    d = spark.createDataFrame([(0, golden.TEXT)], "doc_id long, text string")
    filtered = pii.filter_documents(d, GOLDEN)
    found = pii.exploded(filtered)
    rows = [(x.type, int(x.placeholder[-4:-1]), x.start_offset, x.end_offset) for x in found.orderBy("position").collect()]
    assert rows == list(golden.MATCHES)
    kinds = [x[0] for x in golden.MATCHES]
    assert pii.stats(filtered).first().asDict() == {"doc_id": 0, "total": len(kinds)} | {k: kinds.count(k) for k in r.fx.TYPES}
    expected = spark.createDataFrame([(n,) for n in golden.EXPECTED_NAMES], "name string")
    assert all(x.found for x in pii.missed_names(expected, found.where("type = 'name'")).collect())
    assert pii.restore_documents(filtered.drop("text")).first().restored_text == golden.TEXT


def test_upsert_stream_keeps_the_table(spark, tmp_path):
    table, source, schema = str(tmp_path / "t"), str(tmp_path / "in"), "path string, hash string, seq int"

    def now(version=None):
        return {(r.path, r.hash) for r in ingest.current_rows(spark, table, schema, version).collect()}

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        ingest.upsert_stream(ingest.stream_table(spark, source, schema), table, str(tmp_path / "cp"), "seq").awaitTermination(60)
        return now()

    assert feed([("a", "1", 1), ("b", "1", 1), ("a", "2", 2)]) == {("a", "2"), ("b", "1")}
    assert feed([("b", "3", 3), ("c", "1", 3), ("a", "2", 3)]) == {("a", "2"), ("b", "3"), ("c", "1")}
    # a row with the hash that is there stays the older one
    assert {(r.path, r.seq) for r in ingest.current_rows(spark, table, schema).collect()} == {("a", 2), ("b", 3), ("c", 3)}
    assert feed([("c", "2", 4)]) == {("a", "2"), ("b", "3"), ("c", "2")}
    assert now(1) == {("a", "2"), ("b", "1")}  # the first batch's version
    parts = Parts(spark, table)
    assert len(parts.versions()) == 3
    # a batch that is run again is left out, and a commit that is not written to its end is not there
    again = parts.write(spark.createDataFrame([("z", "9", 9)], schema), "rows")
    assert parts.commit({"rows": again}, batch=(str(tmp_path / "cp"), 2)) == 3
    assert ingest.compact_upserts(spark, table, schema) == 4 and now() == {("a", "2"), ("b", "3"), ("c", "2")}
    (tmp_path / "t" / "commits" / f"{5:012d}.json").write_text('{"version": 5, "pa')
    assert now() == {("a", "2"), ("b", "3"), ("c", "2")}
    for part in (tmp_path / "t" / "rows").glob("*/part-*"):
        part.write_bytes(b"broken")
    with pytest.raises(Exception):  # noqa: B017, PT011
        now()


def test_commits_hold_all_or_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    docs = spark.createDataFrame([("a", "/a", "1", "alpha one"), ("b", "/b", "1", "beta two")], "id string, path string, hash string, text string")
    first = store.insert_documents(docs, path)
    more = spark.createDataFrame([("c", "/c", "1", "gamma alpha")], "id string, path string, hash string, text string")
    with monkeypatch.context() as m:  # the writer dies after its chunks, before its index
        m.setattr(search, "index_parts", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.insert_documents(more, path)
    state = lambda v=None: ({r.path for r in store.table(spark, path, "documents", v).collect()}, {r.document_id for r in store.table(spark, path, "chunks", v).collect()}, {r.document_id for r in search.match(search.open_index(spark, path, v), [[(("alpha",), False)]]).collect()})
    assert state() == ({"/a", "/b"}, {"a", "b"}, {"a"})
    second = store.insert_documents(more, path)
    changed = spark.createDataFrame([("x", "/a", "2", "alpha alpha"), ("y", "/b", "1", "other"), ("z", "/d", "1", "delta")], "id string, path string, hash string, text string")
    third = store.upsert_documents(changed, path)
    held = {r.path: (r.id, r.hash) for r in store.table(spark, path, "documents").collect()}
    assert held["/b"] == ("b", "1") and held["/a"][1] == "2" and held["/a"][0] not in ("a", "x") and set(held) == {"/a", "/b", "/c", "/d"}
    assert state()[1] == state()[0].__class__(i for i, _ in held.values()) and "a" not in state()[2] and len(state()[2]) == 2
    fourth = store.delete_documents(spark.createDataFrame([("c",)], "id string"), path)
    assert [first, second, third, fourth] == [1, 2, 3, 4] and state(1) == ({"/a", "/b"}, {"a", "b"}, {"a"}) and state(2)[2] == {"a", "c"}
    assert state()[0] == {"/a", "/b", "/d"} and len(state()[2]) == 1
    # two writers at once: the second takes the next version
    parts = Parts(spark, path)
    seen, real = [], parts.state
    monkeypatch.setattr(parts, "state", lambda v=None: seen.pop() if seen else real(v))
    seen.append(real(3))
    assert parts.commit({"documents": parts.write(spark.createDataFrame([], store.SCHEMAS["documents"]), "documents")}) == 5


def test_compaction_keeps_scores_and_later_commits(spark, tmp_path):
    path = str(tmp_path)
    chunks = spark.createDataFrame([(str(i), i, t) for i, t in enumerate([*TEXTS, None, ""])], "chunk_id string, document_id int, content string")
    search.insert_chunks(chunks.where("document_id < 5"), path)
    search.insert_chunks(chunks.where("document_id >= 5"), path)
    search.delete_documents(chunks.where("document_id in (0, 5)"), path)
    score = lambda q: {x.document_id: x.score for x in search.match(search.open_index(spark, path), search.stemmed_query(q)).collect()}
    before = {q: score(q) for q in ("dog", "run*", '"dogs run"', "fox OR brown")}
    assert search.open_index(spark, path).deleted
    search.compact_index(spark, path)
    index = search.open_index(spark, path)
    assert not index.deleted and {q: score(q) for q in before} == {q: pytest.approx(v) for q, v in before.items()}
    parts = Parts(spark, path)
    parts.vacuum(1)
    assert {q: score(q) for q in before} == {q: pytest.approx(v) for q, v in before.items()}
    assert [len(parts.state()["parts"][t]) for t in ("postings", "blocks", "chunk_stats")] == [1, 1, 1]
    # what is committed while a compaction writes stays
    real, added = parts.read, []

    def read(*a, **k):
        if not added:
            added.append(parts.commit({"t": parts.write(spark.range(2), "t")}))
        return real(*a, **k)

    parts.commit({"t": parts.write(spark.range(5), "t")})
    parts.read = read
    parts.compact({"t": ("id long", lambda rows: parts.write(rows, "t"))})
    assert sorted(r.id for r in real("t", "id long").collect()) == [0, 0, 1, 1, 2, 3, 4]


def test_top_k_reads_fewer_postings(spark, tmp_path):
    import random

    r = random.Random(1)
    words = ["rare"] * 2 + ["mid"] * 20 + ["often"] * 200 + [f"w{i}" for i in range(300)]
    rows = [(f"{i:04d}", i, " ".join(r.choice(words) for _ in range(r.randint(3, 60)))) for i in range(1500)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id int, content string")
    path = str(tmp_path)
    for k in (0, 1):
        search.insert_chunks(chunks.where(f"document_id % 2 = {k}"), path, stemmed=False)
    index = search.open_index(spark, path)
    for query in ("'often'", "'mid'", "often OR mid OR rare", "often mid", "mid rare often", "'nothing'", "nothing often", "nothing OR often"):
        asked = search.parse_query(query)
        every = search.match(index, asked)
        exp = [(x.chunk_id, round(x.score, 9)) for x in every.orderBy(F.desc("score"), "chunk_id").limit(5).collect()]
        assert [(x.chunk_id, round(x.score, 9)) for x in search.best(index, asked, 5).collect()] == exp
        read, held = search.top_rows(index, asked, 5)[0].count(), search._rows_of(index, asked).count()
        assert read <= held and (query != "'often'" or read < held / 2) and (query not in ("often mid", "mid rare often") or read < held)
    assert search.top_rows(index, search.parse_query("oft*"), 5) is None and search.top_rows(index, search.parse_query('"often mid"'), 5) is None
    search.delete_documents(chunks.where("document_id = 3"), path)
    again = search.open_index(spark, path)
    assert search.top_rows(again, search.parse_query("'often'"), 5) is None
    assert {x.document_id for x in search.best(again, search.parse_query("'often'"), 2000).collect()} == {x.document_id for x in search.match(index, search.parse_query("'often'")).where("document_id <> 3").collect()}


def test_conversations_in_a_stream_and_at_once(spark, tmp_path):
    class Counts:
        def stream(self, messages, system=""):
            yield chat.Delta(f"{len(messages)}:{messages[-1]['content']}|{messages[0]['content']}|{system[-3:]}", True)

    rows = [(f"c{i % 3}", i, f"vraag {i}  van {i % 3} " + "x" * (i * 7)) for i in range(18)] + [("solo", 1, None), ("solo", 2, "")]
    schema = "conversation_id string, seq long, content string"

    def expected(history):
        out = []
        for c in ("c0", "c1", "c2", "solo"):
            past = []
            for k, (_, _, q) in enumerate(sorted((r for r in rows if r[0] == c), key=lambda r: r[1])):
                said = [*past[-history:], q or ""]
                text = f"{len(said)}:{said[-1]}|{said[0]}|{chat.BASE_PROMPT[-3:]}"
                title = " ".join((q or "").split())
                out += [(c, 2 * k + 1, "user", q or "", len(said) - 1, (title if len(title) <= 50 else title[:47] + "...") if k == 0 else None), (c, 2 * k + 2, "assistant", text, len(said) - 1, None)]
                past += [q or "", text]
        return sorted(out, key=str)

    got = chat.converse(spark.createDataFrame(rows, schema), Counts(), 5).collect()
    assert sorted(map(tuple, got), key=str) == expected(5)
    with_context = spark.createDataFrame([("a", 1, "q", "Bron")], schema + ", context string")
    assert chat.converse(with_context, Counts()).where("role = 'assistant'").first().content.endswith("--")
    assert chat.converse(spark.createDataFrame([], schema), Counts()).count() == 0
    source, table = str(tmp_path / "in"), str(tmp_path / "log")
    for part in (rows[:7], rows[7:9], rows[9:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        ingest.chat_stream(ingest.stream_table(spark, source, schema), Counts(), table, str(tmp_path / "cp"), 5).awaitTermination(120)
    assert sorted(map(tuple, ingest.answers(spark, table).collect()), key=str) == expected(5)
    assert {r.conversation_id for r in ingest.answers(spark, table, 1).collect()} == {"c0", "c1", "c2"}


def test_span_joins_equal_all_pairs(spark):
    import random

    r = random.Random(4)
    make = lambda n, wide: [(r.choice([1, 2, None]), a := r.randint(0, 3000), a + r.randint(0, wide)) for _ in range(n)]
    a, b = make(150, 40) + [(1, 600, 600), (1, 7, 7), (1, 7, 7)], make(60, 1500)
    kind = "doc_id long, start_offset long, end_offset long"
    got = pii.uncovered_spans(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)).collect()
    free = [x for x in a if not any(x[0] is not None and x[0] == y[0] and x[1] < y[2] and x[2] > y[1] for y in b)]
    assert sorted(map(tuple, got), key=str) == sorted(free, key=str)
    near = pii.near_spans(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), 25).collect()
    assert sorted(map(tuple, near), key=str) == sorted((x for x in a if any(x[0] is not None and x[0] == y[0] and min(abs(x[1] - y[1]), abs(x[1] - y[2])) < 25 for y in b)), key=str)
    text = "\n\n".join("p" * n for n in (700, 0, 3, 1200, 513, 512))
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    parts, at = [], 0
    for k, p in enumerate(text.split("\n\n")):
        parts.append((k, at, at + len(p)))
        at += len(p) + 2
    inside = [(*x, k) for x in a for k, s, e in parts if x[0] == 1 and x[1] >= s and x[2] <= e]
    found = pii.in_paragraphs(spark.createDataFrame(a, kind), docs).select("doc_id", "start_offset", "end_offset", "paragraph").collect()
    assert sorted(map(tuple, found)) == sorted(inside)
    plan = pii.in_paragraphs(spark.createDataFrame(a, kind), docs)._jdf.queryExecution().toString()
    assert "__at" in plan and "__cell" in plan


def test_snippets(spark):
    import re

    def cut(text, marks, most=32):
        tokens = list(re.finditer(r"[^\W_]+", text))
        if len(tokens) <= most:
            lo, hi = 0, len(tokens)
        else:
            first = marks[0] if marks else 0
            begins = [i for i in range(max(0, first - most + 1), first + 1) if i == 0 or re.search(r"[.:]", text[tokens[i - 1].end() : tokens[i].start()])]
            lo = max(begins or [max(0, min(first, len(tokens) - most))], key=lambda i: (sum(i <= m < i + most for m in marks), -i))
            hi = min(len(tokens), lo + most)
        out, at = ["..." if lo else ""], tokens[lo].start() if lo else 0
        for i in range(lo, hi):
            out += [text[at : tokens[i].start()], f"<mark>{tokens[i][0]}</mark>" if i in marks else tokens[i][0]]
            at = tokens[i].end()
        return "".join([*out, "..." if hi < len(tokens) else text[at:]])

    import random

    r = random.Random(7)
    rows = [("", []), ("één", [0]), (" a b. ", [1])]
    for _ in range(120):
        n = r.randint(1, 90)
        text = "".join(f"w{i}" + r.choice([" ", " ", " ", ". ", ": ", ", ", "\n"]) for i in range(n))
        rows.append((r.choice(["", "  "]) + text, sorted(r.sample(range(n), min(n, r.randint(1, 6))))))
    df = spark.createDataFrame(rows, "t string, m array<int>")
    assert [x[0] for x in df.select(search.snippet(F.col("t"), F.col("m"))).collect()] == [cut(t, m) for t, m in rows]


def test_uncovered_spans_are_made_once(spark):
    kind = "doc_id long, start_offset long, end_offset long, note string"
    # copies, spans over three cells that are covered in one, and rows with nulls; what makes a span is in the plan once
    a = [(1, 0, 9, "a")] * 3 + [(1, 500, 1100, "b")] * 3 + [(1, 1500, 2600, "c"), (1, 1500, 2600, "c"), (1, 1500, 2600, "d"), (2, 0, 9, None), (None, 0, 9, "e"), (1, None, 9, "f"), (1, 3, None, "g")]
    others = spark.createDataFrame([(1, 1050, 1060, ""), (1, 9, 12, ""), (None, 0, 9, ""), (2, None, 5, "")], kind)
    got = pii.uncovered_spans(spark.createDataFrame(a, kind).where("note is null or upper(note) <> 'Z'"), others)
    assert sorted(map(tuple, got.collect()), key=str) == sorted((x for x in a if x[3] != "b"), key=str)
    assert got.columns == ["doc_id", "start_offset", "end_offset", "note"]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("upper(") == 1


def test_missed_names_and_paragraphs(spark):
    expected, found = spark.createDataFrame([("Anna de Vries",), ("Piet",)], "name string"), spark.createDataFrame([("anna",), ("Klaas",)], "original string")
    assert {(r.name, r.found) for r in pii.missed_names(expected, found).collect()} == {("Anna de Vries", True), ("Piet", False)}
    docs = spark.createDataFrame([(1, "ab\n\ncdef\n\n"), (2, None), (3, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in pii.paragraphs(docs).collect()) == [(1, 0, 0, 2), (1, 1, 4, 8), (1, 2, 10, 10), (3, 0, 0, 0)]
    spans = spark.createDataFrame([(1, 4, 6), (1, 1, 5), (2, 0, 1), (None, 4, 6)], "doc_id long, start_offset long, end_offset long")
    assert [(r.start_offset, r.paragraph) for r in pii.in_paragraphs(spans, docs).collect()] == [(4, 1)]
    assert {r.start_offset for r in pii.uncovered_spans(spans.where("doc_id = 1"), spans.where("start_offset = 1")).collect()} == set()


def test_positions_of_a_list_whose_cuts_are_sampled(spark):
    from pyspark.sql import functions as F

    from loomveil.operators.layout import positioned

    # what is counted is much smaller than the rows, so that it would be dealt to fewer tasks
    text = F.concat(*(F.sha2((F.col("id") + k).cast("string"), 256) for k in range(8)))
    rows = spark.range(0, 50_000, 1, 4).select((F.col("id") * 7919 % 100_003).alias("key"), text.alias("name"))
    got = positioned(rows.orderBy("key").select("name")).select("name", "position")
    # the list is read, not made again for its counts: its cuts could be others
    assert "Sort [" not in got._jdf.queryExecution().optimizedPlan().toString()
    told = got.agg(F.count("*").alias("n"), F.min("position").alias("low"), F.max("position").alias("high"), F.count_distinct("position").alias("places")).first()
    assert tuple(told) == (50_000, 1, 50_000, 50_000)


def test_scores_equal_as_shown_are_ordered_by_id(spark, tmp_path):
    from loomveil.plans import catalogue

    # a word that all have weighs 1e-6, so longer texts score less by less than what is shown
    rows = [(i, i, "the clown" + " x" * (20 - i)) for i in range(1, 13)]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id long, content string")
    one = [[(("the",), False)]]
    assert [r.doc_id for r in catalogue._top(search.match(search.build_index(chunks, False), one)).collect()] == list(range(1, 11))
    path = str(tmp_path / "index")
    search.insert_chunks(chunks, path, stemmed=False)
    assert [r.chunk_id for r in search.best(search.open_index(spark, path), one, 10).collect()] == list(range(1, 11))


def test_postings_are_made_without_a_shuffle(spark):
    rows = [(1, 1, "the dog, the dogs"), (2, 1, "a dog"), (3, 2, None), (4, 2, "")]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id long, content string")
    for stemmed, dog in ((False, {(1, 1, 4, (1,)), (2, 1, 2, (1,))}), (True, {(1, 2, 4, (1, 3)), (2, 1, 2, (1,))})):
        index = search.build_index(chunks, stemmed)
        assert "Exchange" not in index.postings._jdf.queryExecution().executedPlan().toString()
        assert {(r.chunk_id, r.tf, r.dl, tuple(r.positions)) for r in index.postings.where("term = 'dog'").collect()} == dog
        assert {(r.chunk_id, r.dl) for r in index.chunk_stats.collect()} == {(1, 4), (2, 2), (3, 0), (4, 0)}
        assert {r.term for r in search.build_index(chunks, stemmed, [[(("the",), False)]]).postings.collect()} == {"the"}
