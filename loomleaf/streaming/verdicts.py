"""An extension: verdicts on packages as their files arrive.

A file stream hands over each new file (a path once: what changes must come under another
name).  Every micro-batch writes a row for each of its files, and a verdict for each content
that has none yet, to folders of its own, so a batch that is run again replaces its rows; the stream
itself keeps no state but the list of files that every file stream keeps.  A file's verdict
is that of its content, so every copy of a content has one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import vocab as V
from ..operators.checks import check_packages, verdicts

_FILES = "path string, modificationTime timestamp, length long, content binary"
_SEEN, _JUDGED = "doc string, at timestamp, sha256 string", "sha256 string, ok boolean, exit_code int"


def arriving_packages(spark: SparkSession, path: str, pattern: str = "*.docx", per_batch: int = 1000) -> DataFrame:
    """A stream of doc, at, sha256, content; a file beyond the size limit has a null content and its path as digest."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(path)
    return files.select(F.col("path").alias("doc"), F.col("modificationTime").alias("at"), F.when(F.col("length") <= V.MAX_FILE, F.sha2("content", 256)).otherwise(F.col("path")).alias("sha256"), F.when(F.col("length") <= V.MAX_FILE, F.col("content")).alias("content"))


def _table(spark: SparkSession, out: str, name: str, schema: str, but: int | None = None) -> DataFrame:
    """The rows that batches (all, or all but one) have written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out.rstrip('/')}/{name}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], f"{schema}, batch long")
    rows = spark.read.schema(f"{schema}, batch long").parquet(path.toString())
    return rows if but is None else rows.filter(F.col("batch") != but)


def check_arriving(stream: DataFrame, out: str, checkpoint: str) -> DataStreamWriter:
    """A writer that checks every micro-batch of ``stream`` into ``out``; start it to run it."""

    def check(batch: DataFrame, batch_id: int) -> None:
        spark, place = batch.sparkSession, f"{out.rstrip('/')}/{{}}/batch={batch_id}"
        known = _table(spark, out, "contents", _JUDGED, but=batch_id).select("sha256").distinct()
        new = batch.select("sha256", "content").join(known, "sha256", "left_anti").dropDuplicates(["sha256"])
        found = verdicts(check_packages(new.select(F.col("sha256").alias("doc"), "content")))
        found.select(F.col("doc").alias("sha256"), "ok", "exit_code").write.mode("overwrite").parquet(place.format("contents"))
        batch.select("doc", "at", "sha256").write.mode("overwrite").parquet(place.format("files"))

    return stream.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint)


def latest_verdicts(spark: SparkSession, out: str) -> DataFrame:
    """Each file's verdict: that of its latest content."""
    files = _table(spark, out, "files", _SEEN).groupBy("doc").agg(F.max_by(F.struct("at", "sha256"), F.struct("at", "batch")).alias("v")).select("doc", "v.*")
    judged = _table(spark, out, "contents", _JUDGED).groupBy("sha256").agg(F.max_by(F.struct("ok", "exit_code"), "batch").alias("w"))
    return files.join(judged, "sha256").select("doc", "at", "sha256", "w.*")
