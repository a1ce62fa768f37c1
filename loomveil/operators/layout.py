"""How rows lie over tasks before steps that cost far more for a row than moving it does."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def spread(scan: DataFrame) -> DataFrame:
    """A scan's rows over all cores if its files give fewer tasks than there are cores; else the scan as it is.

    A file of one row group is one task, whatever its size. Tables of many row groups are not moved. Only for plans
    without exchanges: the number of tasks of others isn't known before they run.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def dealt(rows: DataFrame) -> DataFrame:
    """Small rows over all cores, a few tasks for each, whatever their files are like.

    For tables whose rows cost far more to work on than to move: a scan may have as many tasks as there are cores, and
    few of them rows, as a row group is read by one.
    """
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


#: Tasks of small files that become one.
GATHERED = 32


def gathered(scan: DataFrame) -> DataFrame:
    """A scan of small files in fewer tasks, without moving rows, and at least a few for each core.

    A scan counts each file as 4 MB, so that 32 files of any size are a task; starting one costs more than to read them.
    """
    tasks, least = scan.rdd.getNumPartitions(), 4 * scan.sparkSession.sparkContext.defaultParallelism
    return scan.coalesce(max(least, tasks // GATHERED)) if tasks > least else scan


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; one of our own only in local mode, where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomveil-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(rows: DataFrame, name: str) -> DataFrame:
    """`rows` as Parquet in the shared folder, read again: made once, and the same for whoever reads them."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def positioned(ordered: DataFrame, name: str = "position") -> DataFrame:
    """Rows of an ordered list with their place from 1: rows are counted by task, and each task's go on where those before it end.

    The list stays dealt over its tasks; what meets is a row for each of them. It is written once with its tasks and places:
    made a second time it could be cut elsewhere, as Spark draws the cuts of a sort from a sample.
    """
    marked = written(ordered.withColumn("__at", F.monotonically_increasing_id()), "ordered")  # the task, and the place in it
    task, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = marked.groupBy(task.alias("__task")).count()
    before = counts.select("__task", (F.sum("count").over(Window.orderBy("__task")) - F.col("count")).alias("__before"))
    return marked.join(F.broadcast(before), task == F.col("__task")).withColumn(name, F.col("__before") + place + 1).drop("__at", "__task", "__before")
