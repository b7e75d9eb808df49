"""SimHash near-duplicates (operator 10) by deletion-variant signatures.

A text's words are lower-cased (A-Z only); its shingles are hashed with XXH64,
seed 42, and bit i of the 64-bit fingerprint is set if it is set in over half of
the hashes.  Fingerprints link at ``distance`` (at most 3) or fewer differing
bits.  The fingerprint is cut into two halves: of any linked pair one half
differs by one bit at most, so both sides share a signature "half with bit i left
out".  Every distinct fingerprint is indexed under its 64 signatures, rows with
equal signatures meet, and each candidate is verified on all 64 bits.

Large groups: equal fingerprints are one node from the start, so thousands of
exact copies cost one row.  Inside a signature's group only the merges of a
spanning forest leave the task, never all pairs.  A half that more than
``crowd`` fingerprints share would make large groups: its groups are indexed
once more by the other half's own halves (one of which again differs by one bit
at most), after which a group holds no more than 2**18 fingerprints whatever the
data.  No group is capped.

Defined cases: a null text counts as empty; a text without words has fingerprint
zero and links like any other; fewer words than a shingle make one shingle of
them all.  Rows with a null ``doc_id`` take part, and never name a component
unless all of its ids are null.  Repeated rows share fingerprint and component; an empty
table gives an empty one; texts are hashed whole, whatever their length; columns passed
through may have any names (working columns are underscored until they clash with none).
"""

from __future__ import annotations

from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bounded_batches, free_name, materialise, release, scratch, slices, small
from .graph import components

SEED, SHINGLE_WORDS, DISTANCE, CROWD = 42, 3, 3, 8192
_CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    shingles = map(b" ".join, zip(*(islice(found, i, None) for i in range(words)), strict=False)) if len(found) > words else iter([b" ".join(found)])
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    ones, total = np.zeros(64, dtype=np.int64), 0
    while len(some := np.fromiter(islice(hashes, _CHUNK), dtype="<u8")):
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(some)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, text: str = "text", keep: tuple = (), out: str = "fp", words: int = SHINGLE_WORDS) -> DataFrame:
    """``keep`` columns and the fingerprint as a signed 64-bit number."""
    inner = free_name(keep, "hashed_text")
    bounded_batches(df.sparkSession)
    source = df.select(*keep, F.col(text).cast("string").alias(inner))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(out, T.LongType())])

    def run(batches):
        for batch in slices(batches):
            prints = np.array([fingerprint(x.as_py(), words) for x in batch.column(batch.num_columns - 1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints.view(np.int64))], names=schema.names)

    return source.mapInArrow(run, schema)


def _forest(prints: np.ndarray, sides: np.ndarray, within: bool, distance: int) -> list[tuple[int, int]]:
    """Edges that join what is linked in one group; those inside a side only if ``within``.

    A node takes all unvisited nodes near it with it, so every node is compared
    with the unvisited ones once.
    """
    label, edges = np.arange(len(prints)), []
    for side in (0, 1):
        left = np.flatnonzero(sides == side)
        while len(left):
            root, queue, left = left[0], [left[0]], left[1:]
            while queue and len(left):
                near = np.bitwise_count(prints[left] ^ prints[queue.pop()]) <= distance
                if near.any():
                    new, left = left[near], left[~near]
                    label[new] = root
                    queue.extend(new)
                    if within:
                        edges += [(prints[root], prints[n]) for n in new]
    a, b = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    if len(a) < len(b):
        a, b = b, a
    joined: dict = {}

    def top(n):
        while n in joined:
            n = joined[n]
        return n

    for n in b if len(a) else ():
        for other in np.unique(label[a[np.bitwise_count(prints[a] ^ prints[n]) <= distance]]):
            if (x := top(other)) != (y := top(label[n])):
                joined[max(x, y)] = min(x, y)
                edges.append((prints[other], prints[n]))
    return edges


def _edges_of(groups: np.ndarray, prints: np.ndarray, sides: np.ndarray, within: np.ndarray, distance: int, few: int = 6):
    """Edges of whole groups, given sorted by group; small groups are handled together."""
    if not len(groups):
        return np.zeros((0, 2), dtype=np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    sizes = np.diff(np.append(starts, len(groups)))
    low, high = np.minimum.reduceat(sides, starts), np.maximum.reduceat(sides, starts)
    useful = (sizes > 1) & (within[starts] | (low != high))
    size_of, use_of = np.repeat(sizes, sizes), np.repeat(useful, sizes)
    found = []
    quick = use_of & (size_of <= few)
    for shift in range(1, few):
        i = np.flatnonzero(quick[:-shift] & (groups[:-shift] == groups[shift:]))
        j = i + shift
        ok = (np.bitwise_count(prints[i] ^ prints[j]) <= distance) & (within[i] | (sides[i] != sides[j]))
        found.append(np.stack([prints[i[ok]], prints[j[ok]]], axis=1))
    for g in np.flatnonzero(useful & (sizes > few)):
        s = slice(starts[g], starts[g] + sizes[g])
        if edges := _forest(prints[s], sides[s], bool(within[starts[g]]), distance):
            found.append(np.array(edges, dtype=np.uint64))
    return np.concatenate(found)


def _verify(distance: int):
    """Arrow function over rows (key, fp, side, within) sorted by key: the edges."""

    def run(batches):
        kept: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.asarray(batch.column(i)) for i in range(4)]
            columns[1] = columns[1].view(np.uint64)
            if kept:
                kept.append(columns)
                if columns[0][-1] == kept[0][0][0]:  # the open group goes on
                    continue
                columns = [np.concatenate(c) for c in zip(*kept, strict=True)]
            last = int(np.searchsorted(columns[0], columns[0][-1]))
            kept = [[c[last:] for c in columns]]
            edges = _edges_of(*(c[:last] for c in columns), distance)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0].view(np.int64)), pa.array(edges[:, 1].view(np.int64))], names=["a", "b"])
        if kept:
            edges = _edges_of(*(np.concatenate(c) for c in zip(*kept, strict=True)), distance)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0].view(np.int64)), pa.array(edges[:, 1].view(np.int64))], names=["a", "b"])

    return run


def _variants(value, bits: int, group: int):
    """For each bit i of ``value``: (group, i, value without bit i) as one number, the bit, and i."""
    return [F.struct(
        (F.lit((group * 64 + i) << 32) + value.bitwiseAND(F.lit(((1 << bits) - 1) & ~(1 << i)))).alias("key"),
        F.shiftright(value, i).bitwiseAND(F.lit(1)).cast("int").alias("side"),
        F.lit(i == 0).alias("within"),
    ) for i in range(bits)]


def links(prints: DataFrame, fp: str = "fp", distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect exactly what links connect.

    ``prints`` must be cheap to read more than once, as a materialised table is.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two halves find up to three differing bits")
    # Every row becomes 64 index rows: dealt evenly first, as few files make few tasks.
    nodes = prints.select(F.col(fp).alias("fp")).repartition("fp")
    mask = F.lit(0xFFFFFFFF)
    half = [F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(mask)]
    index = nodes.select("fp", F.explode(F.array(*_variants(half[0], 32, 0), *_variants(half[1], 32, 1))).alias("v")).select("v.*", "fp")
    values = prints.select(F.col(fp).alias("fp")).select(F.explode(F.array(F.struct(F.lit(0).alias("h"), half[0].alias("value")), F.struct(F.lit(1).alias("h"), half[1].alias("value")))).alias("s"))
    crowded = materialise(values.groupBy("s.h", "s.value").count().filter(F.col("count") > crowd).select("h", "value"))
    plain = index
    finer = None
    if crowded.count():
        keys = [F.when(F.col("h") == g, F.lit((g * 64 + i) << 32) + F.col("value").bitwiseAND(F.lit(0xFFFFFFFF & ~(1 << i)))) for g in (0, 1) for i in range(32)]
        full = materialise(crowded.select(F.explode(F.array(*keys)).alias("key")).filter("key is not null").distinct())
        plain = index.join(small(full), "key", "left_anti")
        inside = index.join(small(full), "key", "left_semi")
        other = F.when(F.shiftright("key", 38) == 0, half[1]).otherwise(half[0])
        upper, lower = F.shiftright(other, 16), other.bitwiseAND(F.lit(0xFFFF))
        parts = inside.select("key", "fp", F.explode(F.array(*_variants(upper, 16, 2), *_variants(lower, 16, 3))).alias("v"))
        finer = parts.select(F.col("key").alias("first"), F.col("v.key").alias("second"), "fp")
    out = _group_edges(plain.select("key", "fp", "side", "within"), distance)
    if finer is not None:
        same = finer.select(F.xxhash64("first", "second").alias("key"), "fp", F.lit(0).alias("side"), F.lit(True).alias("within"))
        out = out.union(_group_edges(same, distance))
    return out


def _group_edges(rows: DataFrame, distance: int) -> DataFrame:
    dealt = rows.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_verify(distance), "a long, b long")


def near_components(prints_of: DataFrame, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """A row per document: ``doc_id``, ``fp``, ``node`` (its component's fingerprint) and ``component_id``.

    ``prints_of`` is a materialised table with ``doc_id`` and ``fp``.
    """
    docs = prints_of.select("doc_id", "fp")
    with scratch(prints_of.sparkSession) as stay:
        prints = materialise(docs.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")))
        roots = components(links(prints, distance=distance, crowd=crowd))
        of = prints.join(small(roots.select(F.col("node").alias("fp"), "root")), "fp", "left").select("fp", "first_id", "copies", F.coalesce("root", "fp").alias("node"))
        of = materialise(of)
        release(prints, roots)
        least = materialise(of.groupBy("node").agg(F.min("first_id").alias("component_id"), F.sum("copies").alias("members")).filter("members > 1"))
        grouped = materialise(of.join(small(least), "node").select("fp", "node", "component_id"))
        stay.append(grouped)
    joined = docs.join(small(grouped), "fp", "left")
    return joined.select("doc_id", "fp", F.coalesce("node", "fp").alias("node"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def print_table(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``fp`` of every row, materialised."""
    return materialise(fingerprints(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), keep=("doc_id",)))


def near_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each component one row stays, of its smallest id.

    Of rows that repeat id and fingerprint one stays; all columns pass through.
    The rows are written once with their fingerprints, so texts are hashed once
    and only shuffled where ids repeat.
    """
    fp = free_name(df.columns, "print_of_row")
    with scratch(df.sparkSession) as stay:
        rows = materialise(fingerprints(df, text, tuple(df.columns), fp))
        found = materialise(near_components(rows.select(F.col(doc_id).alias("doc_id"), F.col(fp).alias("fp")), distance, crowd))
        out, drops = one_each(rows, found, df.columns, doc_id, fp)
        stay += [rows, drops]
    return out


def one_each(rows: DataFrame, found: DataFrame, columns: list[str], doc_id: str, fp: str) -> tuple[DataFrame, DataFrame]:
    """``columns`` of one row per ``node``, and a working table it reads; ``found`` has ``doc_id``, ``fp`` and ``node`` of every row."""
    keeper = found.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("k"), F.count("*").alias("n"))
    keeper = materialise(keeper.filter("n > 1").select("node", F.col("k.doc_id").alias("kept_id"), F.col("k.fp").alias("kept_fp")))
    mine = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("fp") == F.col("kept_fp"))
    flags = found.join(small(keeper), "node").groupBy("doc_id", "fp").agg(F.max(mine).alias("stays"), F.count("*").alias("rows"))
    d, f, stays = (free_name(rows.columns, n) for n in ("drop_id", "drop_fp", "stays"))
    drops = materialise(flags.filter("not stays or rows > 1").select(F.col("doc_id").alias(d), F.col("fp").alias(f), F.col("stays").alias(stays)))
    both = rows.join(small(drops), rows[doc_id].eqNullSafe(F.col(d)) & (F.col(fp) == F.col(f)), "left")
    once = both.filter(F.col(stays).isNull())
    if not drops.filter(F.col(stays)).isEmpty():
        once = once.union(both.filter(F.col(stays)).dropDuplicates([doc_id, fp]))
    return once.select(*columns), drops
