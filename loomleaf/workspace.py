"""The folder for working tables that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local master may do
    without: then a temporary folder is set once for the session.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomleaf-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, which cuts its lineage.

    The folder goes when the driver's process ends, or before by ``_loomleaf_path``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    back = spark.read.schema(df.schema).parquet(path)
    back._loomleaf_path = path
    return back


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Have Spark hand at most ``rows`` rows at a time to Python; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    said = spark.conf.get(key, None)
    if said is None or not 0 < int(said) <= rows:
        spark.conf.set(key, rows)


#: Spark's names of the kinds of columns that Python makes.
SPARK_KINDS = {pa.string(): "string", pa.binary(): "binary", pa.int32(): "int", pa.int64(): "long", pa.bool_(): "boolean", pa.list_(pa.string()): "array<string>", pa.map_(pa.string(), pa.string()): "map<string,string>"}


def record_batch(rows: list[tuple], columns: dict[str, pa.DataType]) -> pa.RecordBatch:
    """Rows as a batch for Spark; there may be none."""
    values = list(zip(*rows, strict=True)) or [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, columns.values(), strict=True)], names=list(columns))


def gathered(rows: Iterable[tuple], columns: dict[str, pa.DataType], weigh: Callable[[tuple], int] = lambda _: 0, most: int = 4096, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of many small files or documents as few batches, each of ``most`` rows and, by ``weigh``, little over ``most_bytes``."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += weigh(row)
        if len(held) >= most or weight >= most_bytes:
            yield record_batch(held, columns)
            held, weight = [], 0
    if held:
        yield record_batch(held, columns)


def spread(df: DataFrame, most: int = 64 << 20) -> DataFrame:
    """A small table dealt evenly over the cores; a larger one as it lies.

    A table of up to ``most`` bytes often is one file of one row group, which a single task would
    read and work on.  Moving so little costs next to nothing; a large table has row groups for
    every core and is never moved.
    """
    if df.isStreaming:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= most else df


def dealt(df: DataFrame) -> DataFrame:
    """A table of short rows that each take long to work on, over all cores whatever its size.

    Its file may be one row group, which a single task would read; moving the rows costs little
    beside the work.  A larger table is dealt in more tasks than cores, so that none has to wait long for the last.
    """
    if df.isStreaming:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism * (4 if size > 4 << 20 else 1))
