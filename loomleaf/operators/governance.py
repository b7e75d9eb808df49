"""Rules over a project's records as tables: commits, numbered documents, registries, versions, measured ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- Fixed values: kinds of commit, the longest title, and a sign-off's shape ----------
KINDS, LONGEST = ("feat", "fix", "docs", "style", "refactor", "perf", "test", "build", "ci", "chore", "revert"), 72
SIGN_OFF = r"(?m)^Signed-off-by: [^\s<>][^<>]*? <([^<>@\s]+@[^<>\s]+)>[ \t]*$"
TITLE = rf"^(?:{'|'.join(KINDS)})(?:\([\w./-]+\))?!?: \S.{{0,70}}$"


def _said(df: DataFrame, key: str, found: dict[str, Column]) -> DataFrame:
    """A row for each condition that holds: ``key``, fault."""
    faults = F.array_compact(F.array(*(F.when(c, name) for name, c in found.items())))
    return df.select(key, F.explode(faults).alias("fault"))


def commit_faults(commits: DataFrame, trailers: tuple[str, ...] = ("Co-authored-by",)) -> DataFrame:
    """sha, fault of commits (sha, title, body): a title too long or of another shape, no sign-off, a trailer that credits others."""
    refused = rf"(?im)^(?:{'|'.join(trailers)}):"
    body = F.coalesce("body", F.lit(""))
    return _said(commits, "sha", {"long title": F.length("title") > LONGEST, "title shape": ~F.col("title").rlike(TITLE), "no sign-off": ~body.rlike(SIGN_OFF), "credit": body.rlike(refused)})


def author_faults(commits: DataFrame) -> DataFrame:
    """sha, fault, address of commits (sha, author, committer, body): an author who didn't sign, a signer who neither wrote nor committed."""
    signed = F.transform(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(SIGN_OFF), F.lit(1)), lambda a: F.lower(a))
    rows = commits.select("sha", F.lower(F.coalesce("author", F.lit(""))).alias("author"), F.lower(F.coalesce("committer", F.lit(""))).alias("committer"), signed.alias("signed"))
    unsigned = rows.filter(~F.array_contains("signed", F.col("author")) | (F.col("author") == "")).select("sha", F.lit("author unsigned").alias("fault"), F.col("author").alias("address"))
    strangers = F.array_except("signed", F.array("author", "committer"))
    return unsigned.unionByName(rows.select("sha", F.lit("stranger signed").alias("fault"), F.explode(strangers).alias("address")))


def ranges(points: DataFrame, keys: list[str], point: str = "cp") -> DataFrame:
    """Whole numbers of each group as ranges without gaps: ``keys``, low, high."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(point))
    each = points.select(*keys, point).distinct().withColumn("island", F.col(point) - nth)
    return each.groupBy(*keys, "island").agg(F.min(point).alias("low"), F.max(point).alias("high")).drop("island")


def index_faults(records: DataFrame, listed: DataFrame) -> DataFrame:
    """fault, number: of numbered records (number, name) and the index (number) that should list each once."""
    say = lambda df, fault: df.select(F.lit(fault).alias("fault"), "number")
    numbers, index = records.select("number").distinct(), listed.select("number").distinct()
    twice = records.groupBy("number").agg(F.countDistinct("name").alias("n")).filter("n > 1")
    found = ranges(numbers, [], "number")
    # A gap lies in front of every range but the first.
    gaps = found.join(found.agg(F.min("low").alias("first")), F.col("low") > F.col("first")).select(F.col("low").alias("number"))
    return reduce(DataFrame.unionByName, [say(twice, "twice"), say(numbers.join(index, "number", "left_anti"), "not listed"), say(index.join(numbers, "number", "left_anti"), "gone"), say(gaps, "gap before")])


def one_way_edges(edges: DataFrame, back: DataFrame) -> DataFrame:
    """missing, new, old: succession that only one side tells; ``edges`` (new, old) as the new ones say, ``back`` as the old ones do."""
    forth = edges.distinct().join(back.distinct(), ["new", "old"], "left_anti").withColumn("missing", F.lit("superseded by"))
    return forth.unionByName(back.distinct().join(edges.distinct(), ["new", "old"], "left_anti").withColumn("missing", F.lit("supersedes")))


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``key``, side: names that only one of two registries has."""
    only = lambda a, b, side: a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").withColumn("side", F.lit(side))
    return only(left, right, "left").unionByName(only(right, left, "right"))


def disagreeing_versions(said: DataFrame) -> DataFrame:
    """name, versions: what different sources (name, source, version) say differently, sorted."""
    sums = said.groupBy("name").agg(F.array_sort(F.collect_set("version")).alias("versions"))
    return sums.filter(F.size("versions") > 1)


def release_matrix(variants: DataFrame, applications: DataFrame) -> DataFrame:
    """variant, application: each variant (variant, kinds) in every application (application, kind) of its kinds."""
    wanted = variants.select("variant", F.explode("kinds").alias("kind")).distinct()
    return wanted.join(applications.select("application", "kind"), "kind").select("variant", "application").distinct()
