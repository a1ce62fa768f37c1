import io
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from loomveil.functions import columns as c
from loomveil.functions.porter import stem
from loomveil.operators import chat, search
from loomveil.sources import files

TEXTS = ["running dogs run fast", "the quick brown fox", "a dog ran away. The dogs run", "runs and runners running", "nothing here", "fox fox fox dog"]


def fts(query):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, id unindexed, tokenize='porter unicode61')")
    db.executemany("insert into t values (?, ?)", [(t, i) for i, t in enumerate(TEXTS)])
    return {i: -s for i, s in db.execute("select id, bm25(t) from t where t match ?", (query,))}


@pytest.mark.parametrize("query", ["running*", "fox*", "dogs run", "dog fox"])
def test_bm25_equals_sqlite(spark, query):
    chunks = spark.createDataFrame([(str(i), i, t) for i, t in enumerate(TEXTS)], "chunk_id string, document_id int, content string")
    words = [(stem(t), p) for t, p in search.sanitize_query(query)]
    got = {x.document_id: x.score for x in search.bm25(search.build_index(chunks), words).collect()}
    assert got == pytest.approx(fts(query))


def test_search_scopes_limits_and_marks(spark):
    chunks = spark.createDataFrame([(str(i), i, t) for i, t in enumerate(TEXTS)], "chunk_id string, document_id int, content string")
    docs = spark.createDataFrame([(i, f"d{i}") for i in range(6)], "doc_id int, name string")
    index = search.build_index(chunks)
    rows = search.search(index, chunks, docs, "fox", limit=1).collect()
    assert [x.document_id for x in rows] == [5] and rows[0].highlights[0].startswith("<mark>fox</mark>")
    assert search.search(index, chunks, docs, "fox", document_ids=[1]).count() == 1
    assert search.search(index, chunks, docs, "fox", min_score=99.0).count() == 0
    assert search.search(index, chunks, docs, "?!").count() == 0
    assert search.sanitize_query("well-known 'x' OR") == [("well", False), ("known", False), ("x", False), ("or", False)]


def test_chunks():
    text = "\n\n".join(["a" * 600, "b" * 300, "c" * 300, "d" * 1500])
    out = search.chunks_of(text)
    assert len(out) == 3 and out[0][1:] == (0, 902)
    assert out[1][0].endswith("c" * 300) and out[2][0].endswith("d" * 1500)
    assert search.chunks_of("  \n\n ") == [] and search.overlap_of("x" * 150 + ". Next one", 100) == "Next one"


def test_chunks_by_expressions_equal_those_of_one_text(spark):
    import random

    r = random.Random(3)
    bits = ["a" * 40, "Een zin. Nog een", "x" * 130, "woord woord", "é😀 ", "! Ja", "\u00a0", "", "\n", " ", "lang" * 60]
    texts = ["".join(r.choice(bits) + r.choice(["\n\n", "\n\n\n", "\n", " ", ""]) for _ in range(r.randint(0, 40))) for _ in range(150)] + [None, "", " \n\n "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for cfg in (search.ChunkConfig(), search.ChunkConfig(120, 30), search.ChunkConfig(50, 0)):
        got = {}
        for x in search.chunk_documents(docs, cfg).orderBy("document_id", "chunk_index").collect():
            got.setdefault(x.document_id, []).append((x.content, x.start_offset, x.end_offset))
        assert got == {i: c for i, t in enumerate(texts) if t and (c := search.chunks_of(t, cfg))}


def test_chat(spark):
    m = spark.createDataFrame([("c", i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(5)], "conversation_id string, seq int, role string, content string").withColumn("created_at", F.col("seq"))
    assert sorted(x.seq for x in chat.last_messages(m, 2).collect()) == [3, 4]
    conv = spark.createDataFrame([("c", "T", ["1"], 0, 0), ("e", "U", [], 0, 0)], "id string, title string, document_ids array<string>, created_at int, updated_at int")
    both = {x.id: len(x.messages) for x in chat.with_messages(conv, m).collect()}
    assert both == {"c": 5, "e": 0}
    left, rest = chat.delete_conversations(conv, m, spark.createDataFrame([("c",)], "id string"))
    assert left.count() == 1 and rest.count() == 0
    res = spark.createDataFrame([("k1", 1, "A", "x", 1.0), ("k2", 2, "B", "y", 2.0)], "chunk_id string, document_id int, name string, content string, score double")
    assert chat.context_text(res).first().context == "[Bron 1: B]\ny\n\n---\n\n[Bron 2: A]\nx"
    deltas, rows = chat.answer(chat.EchoModel(), "wat nu", res, m)
    assert "".join(d.content for d in deltas).strip() == "wat nu" and len(rows) == 2


def test_model_streams():
    reads = [b'{"message":{"content":"a"}}\n{"mess', b'age":{"content":"b"},"done":true}\n']
    assert [(d.content, d.done) for d in chat.ndjson_deltas(reads)] == [("a", False), ("b", True)]
    sse = [b'data: {"choices":[{"delta":{"content":"x"}}]}\n\nda', b"ta: [DONE]\n"]
    assert [(d.content, d.done) for d in chat.sse_deltas(sse)] == [("x", False), ("", True)]
    cfg = chat.ModelConfig("openai", "http://h", "m", api_key="k")
    got = []
    model = chat.HttpModel(cfg, lambda r, t: got.append(r) or sse)
    assert "".join(d.content for d in model.stream([{"role": "user", "content": "q"}])) == "x"
    assert got[0].full_url == "http://h/v1/chat/completions" and cfg.public()["api_key"] == "********"
    assert chat.ModelConfig(api_key="********").saved_over(cfg).api_key == "k"


def test_sanitize_and_title(spark):
    rows = [("BSN 123456782",), ("Jan Bakker",), ("x" * 51,), ("x" * 50,)]
    got = spark.createDataFrame(rows, "t string").select(c.sanitize_error(F.col("t")).alias("s"), c.title_of(F.col("t")).alias("n")).collect()
    assert [g.s for g in got[:2]] == ["BSN [GETAL]", "[NAAM]"]
    assert got[2].n == "x" * 47 + "..." and got[3].n == "x" * 50


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hallo\r\n\r\n\r\nwereld", encoding="utf-8")
    (tmp_path / "b.xyz").write_bytes(b"?")
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Een</w:t></w:r></w:p><w:p><w:r><w:t>twee  drie</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    got = {x.name: x for x in files.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.txt"].text == "hallo\r\n\r\n\r\nwereld" and got["c.docx"].text == "Een\n\ntwee drie"
    assert got["b.xyz"].error and got["d.pdf"].error and got["d.pdf"].text is None
    data = files.xlsx_bytes(["naam", "b"], [["Anna & co", "1"], ["<x>", ""]])
    assert files.xlsx_rows(data) == [["naam", "b"], ["Anna & co", "1"], ["<x>", ""]]
    (tmp_path / "e.xlsx").write_bytes(data)
    assert files.read_cells(spark, str(tmp_path)).count() == 4
    assert zipfile.ZipFile(io.BytesIO(data)).testzip() is None
    s = files.save_settings(str(tmp_path / "s.json"), {"llm": {"a": 1}, "privacy": {"p": 1}}, {"llm": {"a": 2}})
    assert s == {"llm": {"a": 2}, "privacy": {"p": 1}} == files.load_settings(str(tmp_path / "s.json"), {"llm": {"a": 0}, "privacy": {"p": 0}})


def test_upsert_and_audit(spark):
    a = spark.createDataFrame([(1, "p", "h"), (2, "q", "h")], "id int, path string, hash string")
    b = spark.createDataFrame([(3, "p", "h"), (4, "q", "new"), (5, "r", "x")], "id int, path string, hash string")
    assert sorted(x.id for x in files.upsert(a, b).collect()) == [1, 4, 5]
    from loomveil.operators import pii

    done = pii.filter_documents(spark.createDataFrame([("f/x.txt", "h", "a@b.nl")], "path string, hash string, text string"))
    row = files.audit_rows(done, "filter", F.lit("2024-01-01").cast("timestamp")).first()
    assert row.items_filtered == 1 and "a@b" not in row.filter_stats and row.file_name == "x.txt"


def test_stream_equals_batch(spark, tmp_path):
    from loomveil.operators import pii
    from loomveil.streaming import ingest

    df = spark.createDataFrame([(i, f"mail u{i}@x.nl") for i in range(20)], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "in"))
    q = ingest.redact_stream(ingest.stream_table(spark, str(tmp_path / "in"), "doc_id long, text string"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    got = {x.doc_id: x.filtered_text for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {x.doc_id: x.filtered_text for x in pii.filter_documents(df).collect()}
