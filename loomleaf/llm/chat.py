"""Cumulative-snapshot collapse (operator 2): keep maximal logged conversations, then render them.

A logging client often stores a conversation again after every exchange.  Each
turn gets the hash of the conversation up to it: position-tagged turn hashes
summed along the conversation (128 bits, so that a prefix's hash rolls on by one
addition).  A conversation whose whole hash is another's proper prefix hash is a
snapshot and is dropped by an anti-join; of equal conversations the one with the
smallest id stays and ``copies`` counts them.  Only SQL functions run.

Positions come from one sort of all turns by conversation and turn, dealt over tasks by
range: a turn's rank less the rank of its conversation's first turn.  Running sums work by
runs of ``run_turns`` positions, and the runs' totals are added up, so a conversation that
holds most of the rows, with whatever turn numbers, is many small groups.  Rendering
joins the runs' texts; the row of a conversation is as long as its text.  Classes of equal
conversations and distinct prefixes are formed by partial aggregation before they meet.

Defined cases: rows that repeat in all four columns count once; turns are ordered
by turn number (null first), then role and text, whatever gaps the numbers have; a null role
renders as "unknown", a null text as nothing (they differ from empty ones when conversations
are compared); a conversation may have any number of turns and texts any length (up to what a
cell can hold); a row without conversation id belongs to no known conversation: it is one
of its own, with a null id that sorts last, and distinct ones are compared like all others; an
empty table gives an empty one; further columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import hash128, materialise, release, small

RUN_TURNS = 256
_SUMS = ("s0", "s1", "s2", "s3")
_KEY = ["no_conv", "key", "lone"]


def ranked_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every distinct turn with its conversation's key, its position in it and the conversation's length; materialised."""
    spark = df.sparkSession
    kind = df.schema[conv].dataType.simpleString()
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).distinct()
    # A row without id is told apart from the others by its hash.
    lone = F.when(F.col("conv").isNull(), F.concat_ws(":", *(h.cast("string") for h in hash128(F.col("turn").isNull(), "turn", F.col("role").isNull(), "role", F.col("text").isNull(), "text")))).otherwise("")
    rows = rows.select("*", F.col("conv").isNull().alias("no_conv"), F.coalesce("conv", F.lit(0).cast(kind)).alias("key"), lone.alias("lone"))
    order = [*_KEY, F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text")]
    # The id holds a row's partition in its upper bits and its place in the partition below them.
    dealt = materialise(rows.orderBy(*order).withColumn("at", F.monotonically_increasing_id()))
    task, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dealt.groupBy(task.alias("task")).agg(F.count("*").alias("n")).collect()  # one row a task
    offsets, seen = [], 0
    for r in sorted(sizes, key=lambda r: r["task"]):
        offsets.append((r["task"], seen))
        seen += r["n"]
    table = spark.createDataFrame(offsets, "task long, offset long")
    numbered = dealt.withColumn("task", task).join(F.broadcast(table), "task").withColumn("rank", F.col("offset") + place)
    spans = materialise(numbered.groupBy(*_KEY).agg(F.min("rank").alias("first"), F.count("*").alias("n_turns")))
    out = materialise(numbered.join(small(spans), _KEY).select("conv", *_KEY, "role", "text", (F.col("rank") - F.col("first") + 1).alias("pos"), "n_turns"))
    release(dealt, spans)
    return out


def turn_prefixes(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", run_turns: int = RUN_TURNS) -> DataFrame:
    """Every distinct turn with its position, its run, its conversation's length and the hash up to it."""
    return _prefixes_of(ranked_turns(df, conv, turn, role, text), run_turns)


def _prefixes_of(turns: DataFrame, run_turns: int) -> DataFrame:
    turns = turns.withColumn("run", F.floor((F.col("pos") - 1) / run_turns).cast("long"))
    group = [*_KEY, "run"]
    told = ["pos", F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    first, second = F.xxhash64(F.lit(1), *told), F.xxhash64(F.lit(2), *told)
    low = F.lit(0xFFFFFFFF)
    parts = (first.bitwiseAND(low), F.shiftrightunsigned(first, 32), second.bitwiseAND(low), F.shiftrightunsigned(second, 32))
    slim = turns.select("conv", *group, "pos", "n_turns", *(p.alias(s) for s, p in zip(_SUMS, parts, strict=True)))
    upto = Window.partitionBy(*group).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    within = slim.select("conv", *group, "pos", "n_turns", *(F.sum(s).over(upto).alias(s) for s in _SUMS))
    # Only conversations of several runs have anything before a run.
    before = Window.partitionBy(*_KEY).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    totals = slim.filter(F.col("n_turns") > run_turns).groupBy(*group).agg(*(F.sum(s).alias(s) for s in _SUMS))
    totals = materialise(totals.select(*group, *(F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"{s}_before") for s in _SUMS)))
    rolled = within.join(small(totals), group, "left")
    return rolled.select("conv", *group, "pos", "n_turns", *((F.col(s) + F.coalesce(f"{s}_before", F.lit(0))).alias(s) for s in _SUMS))


def maximal(prefixes: DataFrame) -> DataFrame:
    """The conversations to keep (``no_conv``, ``key``, ``lone``), how many equal ones there are, from :func:`turn_prefixes`."""
    proper = prefixes.filter("pos < n_turns").select("pos", *_SUMS).distinct()
    whole = prefixes.filter("pos = n_turns").groupBy("n_turns", *_SUMS).agg(F.min(F.struct(*_KEY)).alias("first"), F.count("*").alias("copies"))
    same = (whole["n_turns"] == proper["pos"]) & (whole["s0"] == proper["s0"]) & (whole["s1"] == proper["s1"]) & (whole["s2"] == proper["s2"]) & (whole["s3"] == proper["s3"])
    return whole.join(proper, same, "left_anti").select("first.*", "copies")


def render_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", run_turns: int = RUN_TURNS) -> DataFrame:
    """Maximal conversations as chat text, a row each: ``conv_id``, ``n_turns``, ``copies``, ``chat``.

    A marker inside a message ("<|") is broken up as "< |", so that no message can open
    or close a turn.
    """
    turns = ranked_turns(df, conv, turn, role, text)
    prefixes = materialise(_prefixes_of(turns, run_turns))
    keep = materialise(maximal(prefixes))
    release(prefixes)
    safe = lambda c, other: F.replace(F.coalesce(c, F.lit(other)), F.lit("<|"), F.lit("< |"))
    piece = F.concat(F.lit("<|im_start|>"), safe("role", "unknown"), F.lit("\n"), safe("text", ""), F.lit("<|im_end|>\n"))
    rows = turns.join(small(keep), _KEY).select("conv", *_KEY, "n_turns", "copies", F.floor((F.col("pos") - 1) / run_turns).cast("long").alias("run"), F.struct("pos", piece.alias("piece")).alias("p"))
    whole = ["conv", *_KEY, "n_turns", "copies"]
    runs = rows.groupBy(*whole, "run").agg(F.array_sort(F.collect_list("p")).alias("ps")).select(*whole, "run", F.array_join("ps.piece", "").alias("told"))
    chats = runs.groupBy(*whole).agg(F.array_sort(F.collect_list(F.struct("run", "told"))).alias("rs"))
    return chats.select(F.col("conv").alias("conv_id"), F.col("n_turns").cast("long").alias("n_turns"), F.col("copies").cast("long").alias("copies"), F.array_join("rs.told", "").alias("chat"))
