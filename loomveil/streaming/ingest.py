"""Streaming ingestion: files or rows arrive, the stateless transformations of the batch path apply, results are appended."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import StructType

from loomveil.functions.redaction import FilterConfig
from loomveil.operators import chat, pii, search
from loomveil.sources import files
from loomveil.sources.parts import Parts


def stream_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Documents of files as they appear below `path`."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return files.extract(spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(path))


def stream_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def redact_stream(docs: DataFrame, out: str, checkpoint: str, config: FilterConfig = FilterConfig()) -> StreamingQuery:
    """Append redacted documents to a Parquet table, once for all that is there."""
    filtered = pii.filter_documents(docs, config)
    return filtered.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def chunk_stream(docs: DataFrame, out: str, checkpoint: str, cfg: search.ChunkConfig = search.ChunkConfig()) -> StreamingQuery:
    chunks = search.chunk_documents(docs, cfg)
    return chunks.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def upsert_stream(docs: DataFrame, table: str, checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Keep a table of documents (path, hash, ...) current: what a micro-batch changes comes in, and takes out what it replaces, in one commit.

    Of several rows of one path in a batch the one with the largest `order` counts, then the
    largest hash; rows with the hash that is there change nothing, and a null path is nobody's.
    A batch that is run again after a failure is found among the commits and left out. Only
    changed rows are written; `compact_upserts` folds replaced rows in. Reading: `current_rows`.
    """
    schema = docs.schema

    def merge(batch: DataFrame, epoch: int) -> None:
        parts = Parts(batch.sparkSession, table)
        rank = Window.partitionBy("path").orderBy(*([F.desc(order)] if order else []), F.desc("hash"))
        newest = batch.withColumn("__n", F.row_number().over(rank)).where("__n = 1 or path is null").drop("__n")
        held = parts.read("rows", schema).select(F.col("path").alias("__path"), F.col("hash").alias("__hash"))
        changed = newest.join(held, (F.col("path") == F.col("__path")) & F.col("hash").eqNullSafe(F.col("__hash")), "left_anti")
        part = parts.write(changed, "rows")
        paths = parts.spark.read.schema(schema).parquet(f"{parts.path}/rows/part={part}").where("path is not null").select("path")
        parts.delete(paths, "path", {"rows": "path"}, {"rows": part}, (checkpoint, epoch))

    return docs.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chat_stream(questions: DataFrame, model, table: str, checkpoint: str, history: int = 10, order: str = "seq", idle_seconds: int = 7 * 86_400) -> StreamingQuery:
    """Answer questions (conversation_id string, `order`, content) as they arrive; messages are committed to the table once for each batch.

    The state of a conversation is its last `history` messages and how many questions it has had; it goes when no question has
    come for `idle_seconds`, after which a conversation starts anew. A batch that is run again after a failure may ask the model again,
    but its answers are committed once. Reading: `answers`.
    """

    def answered(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        asked, past = (state.get[0], json.loads(state.get[1])) if state.exists else (0, [])
        talk = chat.Talk(model, history, [tuple(x) for x in past], asked)
        new = pd.concat(list(batches)).sort_values([order, "content"])
        out = [(key[0], *row) for q in new["content"] for row in talk.turn(q)]
        state.update((talk.asked, json.dumps(list(talk.past))))
        state.setTimeoutDuration(idle_seconds * 1000)
        yield pd.DataFrame(out, columns=["conversation_id", "seq", "role", "content", "seen", "title"])

    def keep(batch: DataFrame, epoch: int) -> None:
        parts = Parts(batch.sparkSession, table)
        parts.commit({"answers": parts.write(batch, "answers")}, batch=(checkpoint, epoch))

    said = questions.groupBy("conversation_id").applyInPandasWithState(answered, ANSWERS, "asked bigint, past string", "append", "ProcessingTimeTimeout")
    return said.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


ANSWERS = f"conversation_id string, {chat.TURN}"


def answers(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """Questions and answers that `chat_stream` has committed."""
    return Parts(spark, table).read("answers", ANSWERS, version).drop("part")


def current_rows(spark: SparkSession, table: str, schema: str | StructType, version: int | None = None) -> DataFrame:
    """A table that `upsert_stream` keeps, as it is now or was in a version."""
    return Parts(spark, table).read("rows", schema, version).drop("part")


def compact_upserts(spark: SparkSession, table: str, schema: str | StructType) -> int:
    """Write the table anew without replaced rows, and delete what only older versions name."""
    parts = Parts(spark, table)
    version = parts.compact({"rows": (schema, lambda rows: parts.write(rows, "rows"))})
    parts.vacuum()
    return version
