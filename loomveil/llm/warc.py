"""WARC archives: deduplicating writer and boundary-chain verified reader.

Writer: Spark's text writer with the record terminator as its line separator, so
archives lie on whatever file system the path names and a task's archive is never
held in memory. Of records with equal payloads of `min_revisit_bytes` or more the
one with the largest page_id is the response; the others are revisit records that
refer to it and carry its digest and length in their headers.

Reader: the text reader with the magic "WARC/1.1\\r\\n" as line separator cuts an
archive, split by split, at every occurrence of the magic, real or inside a
payload. Byte offsets are prefix sums of piece lengths: totals of each split, then
running sums inside it. Every piece that parses is a candidate record with the
offset of its successor. In each split a task compresses its candidates' chains to
their exits; pointer jumping over the splits' entry points then marks, in rounds
that are logarithmic in the number of splits of a file, what the file's start
reaches, and each split is walked once from its entries. Only reachable records
are returned; magic inside payloads falls out, and payloads that hold the magic are
put together again from their pieces, which a second scan finds by 128 bits of their
contents, so that it may cut the archives elsewhere than the first.

Memory: a task holds the offsets of one split's candidates, and the pieces of one
record. A chain that meets something that is no record ends there; `read_archives`
returns what was verified, with the digest check of each payload in `intact`.

Edge cases: null html is an empty payload; a null page_id has no field in the
record and reads back as null; line breaks in a URL are percent-encoded; repeated
rows are records of their own (of equal page_ids the revisits name that page_id).
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from loomveil.llm import scratch

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
BROADCAST_ROWS = 500_000


def plan_records(pages: DataFrame, min_revisit_bytes: int = 1000) -> DataFrame:
    """`pages` with payload, payload_bytes, payload_digest and refers_to (null for responses)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    held = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("payload_digest"))
    narrow = held.where(F.col("payload_bytes") >= min_revisit_bytes).select("page_id", "payload_bytes", "payload_digest")
    groups = narrow.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = scratch.table(groups, "warc-groups")
    if groups.count() <= BROADCAST_ROWS:  # 60 bytes a row
        marked = held.join(F.broadcast(groups), ["payload_digest", "payload_bytes"], "left")
    else:  # a page common to many rows meets its group without its payload; payloads move by page
        refs = narrow.join(groups, ["payload_digest", "payload_bytes"]).select(F.col("page_id").alias("__page"), F.col("payload_digest").alias("__digest"), "refers_to").distinct()
        marked = held.join(refs, F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("payload_digest") == F.col("__digest")), "left").drop("__page", "__digest")
    # of repeated rows of the largest page_id all stay responses
    return marked.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("refers_to")), F.col("refers_to")))


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 1000) -> None:
    """Write one record for each page below `path`."""
    r = plan_records(pages, min_revisit_bytes)
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    optional = lambda name, value: F.coalesce(field(name, value), F.lit(""))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    record = F.concat(
        F.lit(MAGIC),
        field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        field("WARC-Date", F.lit(DATE)),
        optional("WARC-Target-URI", url),
        optional("WARC-Page-Id", F.col("page_id").cast("string")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        field("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(field("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise(F.lit("")),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        field("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    r.select(record.alias("value")).write.option("lineSep", END).text(path)


# --- reading -------------------------------------------------------------------------------


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.schema("value string").option("lineSep", MAGIC).text(path)
    return read.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))


def _hashes() -> list[Column]:
    """128 bits that a piece is known by, wherever the splits of a scan cut the archives."""
    return [F.xxhash64("value").alias("h1"), F.xxhash64("value", F.lit(1)).alias("h2")]


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """All pieces that follow a magic: file, block, seq, off, and, where they parse as a record, its fields and `succ`."""
    head = F.substring_index("value", END, 1)
    pieces = _pieces(spark, path).withColumn("head", F.when(F.instr("value", END) > 0, head))
    get = lambda name, pattern: F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}:[ \t]*{pattern}[ \t]*(?:\r\n|$)", 1)
    some = lambda c: F.when(c != "", c)
    parsed = pieces.select(
        "file", "block", "seq",
        F.octet_length("value").cast("long").alias("n"),
        (F.octet_length("head") + len(END)).cast("long").alias("head_bytes"),
        some(get("Content-Length", r"([0-9]{1,18})")).cast("long").alias("length"),
        some(get("WARC-Type", r"([a-z]+)")).alias("record_type"),
        some(get("WARC-Page-Id", r"(-?[0-9]+)")).alias("page_id"),
        some(get("WARC-Payload-Digest", r"sha1:([0-9a-f]{40})")).alias("said_digest"),
        some(get("WARC-Payload-Length", r"([0-9]{1,18})")).cast("long").alias("said_length"),
        some(get("WARC-Refers-To", r"<urn:page:(-?[0-9]+)>")).alias("refers_to"),
        *_hashes(),
        "value",
    )
    body = F.expr("substring(cast(value as binary), cast(head_bytes + 1 as int), cast(length as int))")
    whole = F.col("n") - F.col("head_bytes") >= F.col("length")
    narrow = parsed.withColumn("whole", whole).withColumn("digest", F.when(whole, F.sha1(body))).drop("value")
    step = F.col("n") + len(MAGIC)
    rows = scratch.table(narrow, "warc-pieces")
    blocks = rows.groupBy("file", "block").agg(F.sum(step).alias("bytes"))
    starts = blocks.select("file", "block", (F.sum("bytes").over(Window.partitionBy("file").orderBy("block")) - F.col("bytes")).alias("before"))
    inner = F.sum(step).over(Window.partitionBy("file", "block").orderBy("seq")) - step
    placed = rows.withColumn("inner", inner).join(starts, ["file", "block"]).withColumn("off", F.col("before") + F.col("inner") - len(MAGIC))
    # the piece before a file's first magic has no magic before it
    placed = placed.where("off >= 0").withColumn("succ", F.expr(f"off + {len(MAGIC)} + head_bytes + length + {len(END)}"))
    return scratch.table(placed.drop("before", "inner"), "warc-candidates")


def reachable(found: DataFrame) -> DataFrame:
    """(file, off) of the candidates that the chain from their file's start reaches."""

    def compress(group: pa.Table) -> pa.Table:
        """Where each candidate's chain leaves the block."""
        succ = dict(zip(group.column("off").to_pylist(), group.column("succ").to_pylist(), strict=True))
        out: dict[int, int] = {}
        for off in sorted(succ, reverse=True):
            to = succ[off]
            out[off] = out.get(to, to)
        n = len(out)
        return pa.table({"file": [group.column("file")[0].as_py()] * n, "block": [group.column("block")[0].as_py()] * n, "off": pa.array(list(out), pa.int64()), "to": pa.array(list(out.values()), pa.int64())})

    links = found.where("succ is not null").select("file", "block", "off", "succ")
    exits = scratch.table(links.groupBy("file", "block").applyInArrow(compress, "file string, block long, off long, to long"), "warc-exits")
    entries = exits.select("file", F.col("to").alias("off")).distinct()
    nodes = exits.join(entries, ["file", "off"], "left_semi").unionByName(exits.where("off = 0")).distinct()
    nodes = scratch.table(nodes.withColumn("reached", F.col("off") == 0), "warc-nodes")
    most = found.groupBy("file").agg(F.count_distinct("block").alias("n")).agg(F.max("n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(most)) + 1):
        # twice the steps in each round: what a reached node reaches now is reached too
        onto = nodes.where("reached and to is not null").select("file", F.col("to").alias("off"), F.lit(True).alias("hit")).distinct()
        further = nodes.select("file", F.col("off").alias("to"), F.col("to").alias("further"))
        jumped = nodes.join(onto, ["file", "off"], "left").join(further, ["file", "to"], "left")
        nodes = scratch.table(jumped.select("file", "block", "off", F.col("further").alias("to"), (F.col("reached") | F.coalesce("hit", F.lit(False))).alias("reached")), "warc-nodes")

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        succ = dict(zip(left.column("off").to_pylist(), left.column("succ").to_pylist(), strict=True))
        seen: set[int] = set()
        for off in right.column("off").to_pylist():
            while off in succ and off not in seen:
                seen.add(off)
                off = succ[off]
        file = left.column("file")[0].as_py() if left.num_rows else ""
        return pa.table({"file": pa.array([file] * len(seen), pa.string()), "off": pa.array(sorted(seen), pa.int64())})

    entered = nodes.where("reached").select("file", "block", "off")
    return links.groupBy("file", "block").cogroup(entered.groupBy("file", "block")).applyInArrow(walk, "file string, off long")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id (string), payload_bytes, payload_digest, record_type, refers_to (string) and intact of every verified record."""
    found = candidates(spark, path)
    real = scratch.table(found.join(reachable(found), ["file", "off"]), "warc-records")
    cut = real.where("not whole")
    if cut.limit(1).count():
        owner = F.last(F.when(F.col("real"), F.col("off")), True).over(Window.partitionBy("file").orderBy("off"))
        marks = found.select("file", "off", "h1", "h2").join(real.select("file", "off", F.lit(True).alias("real")), ["file", "off"], "left")
        owned = marks.withColumn("owner", owner).join(cut.select("file", F.col("off").alias("owner")), ["file", "owner"], "left_semi")
        owned = scratch.table(owned.select("file", "owner", "off", "h1", "h2"), "warc-owned")
        # this scan may cut the archives into other splits than the first: pieces are found by what they hold
        again = _pieces(spark, path).select("value", *_hashes()).join(owned.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
        parts = owned.join(again.groupBy("h1", "h2").agg(F.first("value").alias("value")), ["h1", "h2"]).groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("off", "value"))).alias("parts"))
        joined = F.array_join(F.transform("parts", lambda x: x["value"]), MAGIC)
        body = F.expr("substring(cast(value as binary), cast(head_bytes + 1 as int), cast(length as int))")
        mended = parts.select("file", F.col("owner").alias("off"), joined.alias("value")).join(cut.select("file", "off", "head_bytes", "length"), ["file", "off"])
        mended = mended.where("octet_length(value) - head_bytes >= length").select("file", "off", F.sha1(body).alias("mended"))
        real = real.join(mended, ["file", "off"], "left").withColumn("digest", F.coalesce("digest", "mended"))
    revisit = F.col("record_type") == "revisit"
    return real.select(
        "page_id",
        F.when(revisit, F.col("said_length")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(revisit, F.col("said_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
        F.coalesce(revisit | (F.col("digest") == F.col("said_digest")), F.lit(False)).alias("intact"),
    )


def round_trip(pages: DataFrame, path: str, min_revisit_bytes: int = 1000) -> DataFrame:
    """Write all pages as archives below `path` and read them back."""
    write_archives(pages, path, min_revisit_bytes)
    got = read_archives(pages.sparkSession, path)
    kind = pages.schema["page_id"].dataType
    return got.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "intact")
