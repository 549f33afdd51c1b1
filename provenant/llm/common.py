"""What the operators of this package share: scratch tables, bounded Arrow batches, stable hashes."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows in one Arrow batch. A batch of whole texts has to fit in a Python worker several times over.
BATCH_ROWS = 1000

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back.

    The result no longer depends on earlier shuffles or on any executor, and later uses read only the columns they need.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's rows per Arrow batch to BATCH_ROWS, for good, as results are lazy.

    Bytes of a batch are bounded by spark.sql.execution.arrow.maxBytesPerBatch, whose default of 64 MB stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def map_batches(df: DataFrame, rows: Callable[[dict[str, list]], dict[str, Iterable]], schema: str, arrow_columns: tuple[str, ...] = ()) -> DataFrame:
    """mapInArrow of a function from a batch's columns, as lists, to the columns of its result.

    Those in arrow_columns are handed over as Arrow arrays; any column of the result may be one.
    """
    bounded_batches(df.sparkSession)
    probe = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(probe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = rows({name: batch.column(i) if name in arrow_columns else batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)})
                columns = [made[f.name] for f in arrow]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(text: str | None) -> bytes:
    """A text's UTF-8 bytes; of a null none, of a lone surrogate a question mark."""
    return (text or "").encode("utf-8", "replace")


def column(df: DataFrame, name: str):
    """A column by its plain name, dots included."""
    return df["`" + name.replace("`", "``") + "`"]


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def held_out(doc_id) -> F.Column:
    """True for the ids kept out of training: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
