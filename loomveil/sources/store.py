"""The stored tables: documents, chunks, conversations, messages, the audit log and the index.

Tables lie below one path under one list of commits (`parts.Parts`), with the schemas here.
Arrays and structs are columns; JSON text of them is made and read at the edge only
(`to_json_columns`, `from_json_columns`). Documents come in with their chunks and postings, and
go with them, in one commit each: a reader sees all of it or nothing, and a version that was
opened stays as it is. Paths are unique because `upsert_documents` replaces what has the same.

Nulls: a missing id becomes a new random one, missing times become the insert's time, a
missing title the default; null sources stay null. Equal times are ordered by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomveil.operators import search
from loomveil.operators.chat import DEFAULT_TITLE
from loomveil.sources.parts import Parts

SOURCE = "struct<chunk_id:string,document_id:string,document_name:string,content:string,score:double>"
SCHEMAS = {
    "documents": "id string, name string, path string, mime_type string, size bigint, hash string, text string, created_at timestamp, updated_at timestamp",
    "chunks": "id string, document_id string, content string, chunk_index int, start_offset int, end_offset int",
    "conversations": "id string, title string, document_ids array<string>, created_at timestamp, updated_at timestamp",
    "messages": f"id string, conversation_id string, role string, content string, sources array<{SOURCE}>, created_at timestamp",
    "privacy_audit_log": "id string, timestamp timestamp, file_name string, file_hash string, operation string, items_filtered int, filter_stats string, user_action string",
}
#: Columns kept as JSON text by systems without arrays.
JSON_COLUMNS = {"document_ids": "array<string>", "sources": f"array<{SOURCE}>"}


#: Tables that hold rows of documents, and their column with the document's id.
OF_DOCUMENTS = {"documents": "id", "chunks": "document_id", "postings": "document_id", "chunk_stats": "document_id"}


def create_tables(spark: SparkSession, path: str) -> None:
    """Empty tables below `path`; those that exist stay."""
    Parts(spark, path).change(lambda state, _: [state["parts"].setdefault(name, []) for name in SCHEMAS])


def table(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame:
    """A table as it is now, or as it was in a version."""
    return Parts(spark, path).read(name, SCHEMAS[name], version).drop("part")


def new_id(given: Column) -> Column:
    """The id that is there, else a random one."""
    return F.coalesce(given.cast("string"), F.uuid())


def shaped(rows: DataFrame, name: str, now: Column) -> DataFrame:
    """`rows` with the columns of a table: those they lack are null, but for ids, times and titles."""
    made = []
    for f in rows.sparkSession.createDataFrame([], SCHEMAS[name]).schema:
        c = F.col(f.name) if f.name in rows.columns else F.lit(None)
        if f.name == "id":
            c = new_id(c)
        elif f.name in ("created_at", "updated_at", "timestamp"):
            c = F.coalesce(c.cast("timestamp"), now)
        elif f.name == "title":
            c = F.coalesce(c, F.lit(DEFAULT_TITLE))
        elif f.name == "document_ids":
            c = F.coalesce(c, F.array().cast("array<string>"))
        made.append(c.cast(f.dataType).alias(f.name))
    return rows.select(*made)


def insert(rows: DataFrame, path: str, name: str, now: Column | None = None) -> int:
    """Append rows to a table; gives the version that has them."""
    parts = Parts(rows.sparkSession, path)
    return parts.commit({name: parts.write(shaped(rows, name, F.current_timestamp() if now is None else now), name)})


def chunk_rows(documents: DataFrame, cfg: search.ChunkConfig = search.ChunkConfig()) -> DataFrame:
    """Chunks of documents (id, text, ...) as rows of the chunk table."""
    made = search.chunk_documents(documents.withColumnRenamed("id", "doc_id"), cfg)
    return made.select(F.col("chunk_id").alias("id"), "document_id", "content", "chunk_index", "start_offset", "end_offset")


def _document_parts(documents: DataFrame, parts: Parts, now: Column | None, cfg: search.ChunkConfig) -> dict[str, str]:
    """Write documents, their chunks and the index of those as parts; random ids are drawn once."""
    written = lambda name, part: parts.spark.read.schema(SCHEMAS[name]).parquet(f"{parts.path}/{name}/part={part}")
    made = {"documents": parts.write(shaped(documents, "documents", F.current_timestamp() if now is None else now), "documents")}
    made["chunks"] = parts.write(chunk_rows(written("documents", made["documents"]).select("id", "text"), cfg), "chunks")
    chunks = written("chunks", made["chunks"]).select(F.col("id").alias("chunk_id"), "document_id", "content")
    return made | search.index_parts(chunks, parts)


def insert_documents(documents: DataFrame, path: str, now: Column | None = None, cfg: search.ChunkConfig = search.ChunkConfig()) -> int:
    """Documents with their chunks and postings in one commit; gives the version that has them."""
    parts = Parts(documents.sparkSession, path)
    return parts.commit(_document_parts(documents, parts, now, cfg))


def delete_documents(ids: DataFrame, path: str) -> int:
    """Documents in `ids` (id) go with their chunks and postings, in one commit."""
    return Parts(ids.sparkSession, path).delete(ids, "id", OF_DOCUMENTS)


def upsert_documents(documents: DataFrame, path: str, now: Column | None = None, cfg: search.ChunkConfig = search.ChunkConfig()) -> int:
    """Documents by path and hash, one row a path: equal ones stay as they are, others replace that of their path, new ids and all.

    One commit takes the old ones out with their chunks and postings and brings the new ones in; a null path is nobody's.
    """
    parts = Parts(documents.sparkSession, path)
    state = parts.state()
    held = parts.read("documents", SCHEMAS["documents"], state=state).select(F.col("path").alias("__path"), F.col("hash").alias("__hash"), F.col("id").alias("__id"))
    both = documents.join(held, F.col("path") == F.col("__path"), "left").where(F.col("__path").isNull() | ~F.col("hash").eqNullSafe(F.col("__hash")))
    gone = parts.write(both.where("__id is not null").select(F.col("__id").alias("key")).distinct(), "deleted")
    new = _document_parts(both.drop("__path", "__hash", "__id", "id"), parts, now, cfg)
    return parts.commit(new, {table: (key, gone) for table, key in OF_DOCUMENTS.items()})


# --- reading -------------------------------------------------------------------------------


def by_key(rows: DataFrame, **keys) -> DataFrame:
    """Point lookup: rows whose columns equal the given values; the filter reaches the scan."""
    for column, value in keys.items():
        rows = rows.where(F.col(column) == F.lit(value))
    return rows


def newest_first(rows: DataFrame) -> DataFrame:
    """Documents or conversations, last changed first."""
    return rows.orderBy(F.desc("updated_at"), "id")


def chunks_of(chunks: DataFrame, document_id: str | None = None) -> DataFrame:
    """Chunks of one document, or of all, in order."""
    held = chunks if document_id is None else by_key(chunks, document_id=document_id)
    return held.orderBy("document_id", "chunk_index")


def joined_chunks(chunks: DataFrame) -> DataFrame:
    """document_id and full_text: each document's chunks in order, parted by blank lines; what chunks share comes twice."""
    ordered = F.sort_array(F.collect_list(F.struct("chunk_index", "content")))
    return chunks.groupBy("document_id").agg(F.array_join(F.transform(ordered, lambda x: x["content"]), "\n\n").alias("full_text"))


def to_json_columns(rows: DataFrame) -> DataFrame:
    """Arrays as JSON text; null stays null."""
    return rows.withColumns({c: F.to_json(c) for c in JSON_COLUMNS if c in rows.columns})


def from_json_columns(rows: DataFrame) -> DataFrame:
    """JSON text as arrays; null and text that is no JSON are null."""
    return rows.withColumns({c: F.from_json(c, kind) for c, kind in JSON_COLUMNS.items() if c in rows.columns})
