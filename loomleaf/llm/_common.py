"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import bounded_batches, written

__all__ = ["WORD", "bounded_batches", "free_name", "hash128", "hash_bound", "materialise", "release", "scratch", "shared_value", "slices", "small"]

#: A word is a run of anything but these; the same class for Java and RE2.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes up to which a materialised table is broadcast.
BROADCAST_BYTES = 16 << 20


def free_name(taken, base: str) -> str:
    """``base``, underscored until it clashes with none of ``taken``."""
    names = {c.lower() for c in taken}
    while base.lower() in names:
        base = "_" + base
    return base


def slices(batches, rows: int = 256):
    """Arrow batches cut into pieces of at most ``rows`` rows, to bound Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class _Written(threading.local):
    """Folders of working tables that this thread wrote and has not released."""

    def __init__(self):
        self.paths: list[str] = []


_WRITTEN = _Written()


def materialise(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, which cuts its lineage.

    The folder goes with :func:`release`, at the end of a :func:`scratch` block, or at the
    latest when the driver's process ends.
    """
    back = written(df)
    _WRITTEN.paths.append(back._loomleaf_path)
    return back


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _WRITTEN.paths:
        _WRITTEN.paths.remove(path)


def release(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialise` that nothing will read again."""
    for df in tables:
        _delete(df.sparkSession, df._loomleaf_path)


@contextlib.contextmanager
def scratch(spark: SparkSession, *kept: DataFrame):
    """Working tables written inside the block go at its end, but those appended to the list it yields."""
    before, stay = set(_WRITTEN.paths), list(kept)
    try:
        yield stay
    finally:
        paths = {getattr(t, "_loomleaf_path", None) for t in stay}
        for path in [p for p in _WRITTEN.paths if p not in before and p not in paths]:
            _delete(spark, path)


def _held(column: str, kind: T.DataType) -> Column:
    """About how many bytes a value takes beyond its slot in the row."""
    c = F.col(f"`{column}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + 16 + F.coalesce(F.octet_length(x), F.lit(0))), F.lit(0).cast("long"))
    if isinstance(kind, T.ArrayType):
        return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long") * 8
    return F.lit(0).cast("long")


def small(table: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A materialised table with a broadcast hint if its rows take at most ``most`` bytes, else as it is.

    Bytes are counted, not estimated from files: a slot for every column and the lengths
    of strings and arrays.  Without the hint the join is a plain shuffle of both sides,
    which adaptive execution can split where a key is skewed.
    """
    beyond = sum((_held(f.name, f.dataType) for f in table.schema.fields), F.lit(0).cast("long"))
    rows, more = table.agg(F.count("*"), F.coalesce(F.sum(beyond), F.lit(0))).first()
    return F.broadcast(table) if rows * (24 + 8 * len(table.columns)) + more <= most else table


def hash128(*cols) -> list:
    """Two independent 64-bit hashes as columns."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)]


def hash_bound(share: float) -> int:
    """The signed 64-bit hash that ``share`` of all hashes do not exceed."""
    return (1 << 63) - 1 if share >= 1 else int(-(1 << 63) + share * ((1 << 64) - 1))


_BROADCASTS: dict = {}


def shared_value(spark: SparkSession, value):
    """``value`` as a broadcast, made once for an object that is used again (the last two are kept)."""
    key = (spark.sparkContext.applicationId, id(value))
    if key not in _BROADCASTS:
        while len(_BROADCASTS) > 1:
            _BROADCASTS.pop(next(iter(_BROADCASTS)))
        _BROADCASTS[key] = (value, spark.sparkContext.broadcast(value))
    return _BROADCASTS[key][1]
