"""Sets, bags and reconciliation: priorities, differences, running caps, settings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import written


def most_common(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each group; of equally frequent ones the smallest."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b"))
    return best.select(*keys, F.col("b.v").alias(value), (-F.col("b.m")).alias("n"))


def first_place(df: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """Every row with ``shadowed``: whether a row of a smaller rank has the same keys."""
    return df.withColumn("shadowed", F.col(rank) > F.min(rank).over(Window.partitionBy(*keys)))


def bag_difference(after: DataFrame, before: DataFrame) -> DataFrame:
    """Rows of ``after`` beyond those of ``before``, repeats counted."""
    return after.exceptAll(before)


def first_difference(a: DataFrame, b: DataFrame, keys: list[str], ord_: str, value: str) -> DataFrame:
    """For each group the first place where two sequences differ (either may be shorter), or none."""
    left = a.select(*keys, F.col(ord_).alias("o"), F.col(value).alias("va"), F.lit(True).alias("ina"))
    right = b.select(*keys, F.col(ord_).alias("o"), F.col(value).alias("vb"), F.lit(True).alias("inb"))
    both = left.join(right, [*keys, "o"], "full_outer")
    differs = F.col("ina").isNull() | F.col("inb").isNull() | ~F.col("va").eqNullSafe(F.col("vb"))
    return both.filter(differs).groupBy(*keys).agg(F.min("o").alias("first_difference"))


def first_crossing(df: DataFrame, keys: list[str], order: list[str], size: str, cap: int) -> DataFrame:
    """For each group the row whose running total first exceeds ``cap``.

    Rows are dealt by ranges of group and order, so a large group is many tasks; a task's
    total goes to those behind it in the group.
    """
    dealt = written(df.orderBy(*keys, *order).withColumn("task", F.spark_partition_id()))
    sums = dealt.groupBy(*(F.col(k).alias(f"of_{k}") for k in keys), F.col("task").alias("of_task")).agg(F.sum(size).alias("words"))
    ahead = Window.partitionBy(*(f"of_{k}" for k in keys)).orderBy("of_task").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("before", F.coalesce(F.sum("words").over(ahead), F.lit(0))).drop("words")
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in (*keys, "task")]
    rows = dealt.join(before, reduce(lambda a, b: a & b, same)).select(*dealt.columns, "before")
    here = Window.partitionBy(*keys, "task").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    over = rows.withColumn("total", F.sum(size).over(here) + F.col("before")).filter((F.col("total") > cap) & (F.col("before") <= cap))
    first = Window.partitionBy(*keys).orderBy("task", *order)
    return over.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth", "task", "before")


def dangling(refs: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """References that nothing they may name holds."""
    return refs.join(held.select(*keys).distinct(), keys, "left_anti")


def changed_nothing(settings: DataFrame, presence: DataFrame) -> DataFrame:
    """Settings whose structure a document lacks, by structure: (doc, need, flags joined by " and ").

    ``settings``: doc, ord, flag, need (non-default settings only); ``presence``: doc, need.
    """
    absent = settings.filter("need is not null").join(presence.distinct(), ["doc", "need"], "left_anti")
    lists = absent.groupBy("doc", "need").agg(F.array_sort(F.collect_list(F.struct("ord", "flag"))).alias("fs"))
    return lists.select("doc", "need", F.array_join("fs.flag", " and ").alias("flags"), F.col("fs.ord")[0].alias("ord"))


def conditional(name: str, condition: Column) -> Column:
    """A count of the rows that meet a condition."""
    return F.count_if(condition).alias(name)
