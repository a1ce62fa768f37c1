"""Tables written to the folder that all executors share, and small helpers on schemas.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and
reading it again: the result is columnar, survives the loss of any executor and
is laid out the same for every later reader.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.types import StructType

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only in local mode where none is set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomveil-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/loomveil/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def tasks_for(scan: DataFrame) -> int:
    """Most tasks for tables no larger than `scan`, a written table: as many as it has, and at least a few for each core."""
    return max(4 * scan.sparkSession.sparkContext.defaultParallelism, scan.rdd.getNumPartitions())


def table(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it again; by `most` tasks at most, each of which makes a file.

    A file costs far more than its rows where these are few: without native code, Hadoop starts a process for the rights of
    each file, of its checksums and of its folder.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.coalesce(most) if most else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, name: str, *metrics: Column, most: int | None = None) -> tuple[DataFrame, dict]:
    """table(), and aggregates of its rows taken while it is written. A repeated task may count twice: use them only to ask whether to go on."""
    seen = Observation(name)
    return table((df.coalesce(most) if most else df).observe(seen, *metrics), name), seen.get


def mark() -> int:
    """How many tables there are; what is written after this can be dropped with `drop_since`."""
    return len(_written)


def drop_since(spark: SparkSession, first: int, keep: int = 0) -> None:
    """Delete the tables written since mark(), but for the last `keep`; call it once what was made of them is written."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    upto = len(_written) - keep
    gone, _written[first:upto] = _written[first:upto], []
    for name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def drop_all(spark: SparkSession) -> None:
    """Delete every table that this session wrote; call once results are saved."""
    drop_since(spark, 0)


def free_name(name: str, taken: Iterable[str]) -> str:
    """`name`, with underscores behind it until no column in `taken` has it (in any letter case)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def ddl(schema: StructType) -> str:
    """The columns of a schema as mapInArrow takes them."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
