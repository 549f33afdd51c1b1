"""Tables that a job writes for itself in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []

#: Files that one task writes and, as they stand in a folder of its own, one task lists; and least such folders, as Spark
#: lists more than 32 folders in tasks, but each folder of fewer in a job of its own.
FILES, FOLDERS = 250, 48
#: Characters that Spark writes by their numbers in folders' names.
ESCAPED = frozenset("\"#%'*/:=?\\\x7f{[]^")


#: Rows that one task makes texts of.
DEALT = 10_000
#: Most rows that a Python worker gets at once: a batch of whole texts has to fit several times over, and each core has a worker.
BATCH_ROWS = 500


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to BATCH_ROWS, for good, as results are lazy."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, named in spark.checkpoint.dir.

    Where the setting is absent, a temporary folder of this machine is set for a local session; on a cluster that fails,
    as executors wouldn't see one another's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="provenant-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; remove_scratch, or the end of the Python process, removes it."""
    path = f"{shared_dir(spark)}/provenant-{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(remove_scratch)
    _written.append((spark, path))
    return path


def remove_scratch() -> None:
    """Removes all scratch tables so far. A session that runs many jobs calls it when their results have been stored."""
    while _written:
        spark, path = _written.pop()
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended: nothing can be removed through it
            return


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back.

    The result no longer depends on earlier shuffles or on any executor, and later uses read only the columns they need.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df dealt to tasks by a key, about DEALT rows each.

    A file of keys is so small that Spark reads it in one task or a few, however many texts are made of its rows, and the
    work on these would stay in those tasks.
    """
    parts = -(-df.count() // DEALT)
    return df.repartition(parts, key) if parts > 1 else df


def _name(value: str) -> str:
    """A name as Spark writes it in a folder's."""
    return "".join(f"%{ord(c):02X}" if c in ESCAPED or c < " " else c for c in value)


def written_files(df: DataFrame, name_col: str, value_col: str, name: str) -> str:
    """Writes a row's text and a line end as a file in a folder name_col=its name, and returns the path of the whole.

    Names are dealt to tasks by their hash, and what a task writes stands in a folder of that task. So writing and listing
    are spread over tasks that have about FILES files each, however few partitions df has. Rows of one name are lines of one
    file. Where the shared folder is mounted, tasks write by themselves, which took 2.3 s for 6,000 files where Spark's writer
    took 25.0 s, dealt the same way; elsewhere Spark's writer does. Files and their folders are the same, but for the files' own names.
    """
    spark = df.sparkSession
    path, n = scratch_path(spark, name), df.count()
    parts = max(1, min(n, max(FOLDERS, -(-n // FILES))))
    dealt = df.select(F.col(name_col).alias("name"), F.coalesce(value_col, F.lit("")).alias("value")).repartition(parts, "name").withColumn("task", F.spark_partition_id())
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() != "file":
        dealt.withColumnRenamed("name", name_col).write.partitionBy("task", name_col).text(path)
        return path
    root = target.toUri().getPath()
    os.makedirs(root)

    def write(batches):
        seen = set()  # about FILES names
        for batch in batches:
            for key, value, task in zip(*(batch.column(c).to_pylist() for c in ("name", "value", "task")), strict=True):
                folder = f"{root}/task={task}/{name_col}={_name(key)}"
                os.makedirs(folder, exist_ok=True)
                with open(f"{folder}/part.txt", "ab" if key in seen else "wb") as file:  # a repeated task begins anew
                    file.write(value.encode() + b"\n")
                seen.add(key)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    dealt.mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return path
