"""Where files may come from: pictures that a text names, and profiles of settings found along a search path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# --- Fixed values: the most that one picture and all pictures of a document may take, and what a listing shows ---
MAX_PICTURE, MAX_PICTURES, LISTED = 32 << 20, 64 << 20, 100
#: Letters with their marks, digits, "-" and "_", never "-" first.
PROFILE_NAME = r"^[\p{L}\p{M}\p{N}_][\p{L}\p{M}\p{N}_-]{0,63}$"


def network_path(c) -> Column:
    """Whether an address leads to a network: two slashes or backslashes in front, or a scheme (a drive letter is none)."""
    path = F.col(c) if isinstance(c, str) else c
    return path.rlike(r"^(?:[\\/]{2}|[A-Za-z][A-Za-z0-9+.-]+:)")


def resolve_pictures(wanted: DataFrame, held: DataFrame, roots: DataFrame) -> DataFrame:
    """doc, ord, src, path, fault: each picture that a document names, in the order of first use.

    ``wanted``: doc, base (the document's own folder), ord, src; ``held``: path, length; ``roots``:
    root, folders that pictures may lie in besides the documents' own.  A network path is refused before
    anything is looked up; then comes a path outside of the folders, one that isn't held, one
    beyond the size of a picture, and the first with which a document's pictures take too much.
    """
    first = wanted.groupBy("doc", "base", "src").agg(F.min("ord").alias("ord"))
    clean = X.resolve_path(F.concat("base", F.lit("/x")), F.regexp_replace("src", r"\\", "/"))
    rows = first.withColumn("network", network_path("src")).withColumn("path", F.when(~F.col("network"), clean))
    # A folder of a path meets the root it equals: as many rows as the path has folders.
    steps = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    inside = rows.filter("path is not null").select("doc", "src", "base", F.explode(folders).alias("folder"))
    inside = inside.join(roots.select(F.col("root").alias("folder"), F.lit(True).alias("rooted")).distinct(), "folder", "left")
    inside = inside.groupBy("doc", "src").agg(F.max(F.coalesce("rooted", F.lit(False)) | (F.col("folder") == F.col("base"))).alias("inside"))
    sized = rows.join(inside, ["doc", "src"], "left").join(held.select("path", "length").distinct(), "path", "left")
    usable = F.coalesce("inside", F.lit(False)) & F.col("length").isNotNull() & (F.col("length") <= MAX_PICTURE)
    along = Window.partitionBy("doc").orderBy("ord", "src").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.when(usable, F.col("length")).otherwise(0)).over(along)
    fault = (
        F.when(F.col("network"), "a network path").when(~F.coalesce("inside", F.lit(False)), "outside of the folders that may be read").when(F.col("length").isNull(), "not found")
        .when(F.col("length") > MAX_PICTURE, "too large").when(total > MAX_PICTURES, "too much in all")
    )
    return sized.withColumn("fault", fault).select("doc", "ord", "src", "path", "fault")


def profile_listing(files: DataFrame, most: int = LISTED) -> DataFrame:
    """place, name, shadowed, nth of profile files (place, name): the first ``most`` of each place by the bytes of their names.

    Names that no profile may have aren't read; a name that a place of a smaller number has
    too is shadowed.
    """
    valid = files.filter(F.col("name").rlike(PROFILE_NAME)).select("place", "name").distinct()
    rows = valid.withColumn("shadowed", F.col("place") > F.min("place").over(Window.partitionBy("name")))
    order = Window.partitionBy("place").orderBy(F.encode("name", "utf-8"))
    return rows.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most)


def profiles_omitted(files: DataFrame, most: int = LISTED) -> DataFrame:
    """place, omitted: how many profiles of a place a listing leaves out."""
    counts = files.filter(F.col("name").rlike(PROFILE_NAME)).groupBy("place").agg(F.countDistinct("name").alias("n"))
    return counts.filter(F.col("n") > most).select("place", (F.col("n") - most).alias("omitted"))
