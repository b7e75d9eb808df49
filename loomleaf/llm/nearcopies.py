"""Near copies by shingle similarity (the near-dedup stage): SimHash and MinHash candidates, verified.

Two texts are near copies if the sets of their shingles, ``words`` words long and
hashed as in :mod:`simhash`, have a Jaccard similarity of ``similarity`` or more.
SimHash at three bits finds few of these below 0.9 (ten of 64 bits differ at 0.8
on average, too many for segments with a wildcard), so candidates come from two
indexes: groups of fingerprints that :func:`simhash.links` joins, and ``BANDS`` keys of
``ROWS`` MinHash values each.  A pair of similarity s shares a band key with
probability 1 - (1 - s**ROWS)**BANDS: 0.9993 at 0.8.  Every candidate is verified
on the whole shingle sets, so no text goes that isn't similar enough to another.

Large groups: texts with equal sets are one node from the start, and each node is first
compared with one node of the largest group it is in.  Then in every group some nodes, the
pivots (one at first), are compared with all that they aren't connected with yet, and closed; then the components are formed again, and so on until every node
outside of a group's largest component is closed.  Of any two similar nodes one is closed
first, when the other was compared or already connected: no link is lost, near copies of one
text cost one pass, and every pass is a join over tables.  No group is capped or gathered in a
task, and groups of all sizes are treated alike.

Defined cases: a null text counts as empty, and all texts without words are equal;
fewer words than a shingle make one shingle of them all; of rows that repeat one stays; rows
without id rank last; an empty table gives an empty one; texts are read whole; all columns
pass through, whatever their names (working columns are underscored until they clash with none).
"""

from __future__ import annotations

from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from ._common import bounded_batches, free_name, materialise, release, scratch, slices, small
from .graph import components

WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 24, 6
#: Hashes that meet all factors at a time, and rows of a batch: what bounds a worker's memory.
_CHUNK, _ROWS_AT_ONCE = 512, 64
_FACTORS = np.random.default_rng(simhash.SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingle hashes of a text in order."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    shingles = map(b" ".join, zip(*(islice(found, i, None) for i in range(words)), strict=False)) if len(found) > words else iter([b" ".join(found)])
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(simhash.SEED)), dtype=np.uint64))


def short_set(hashes: np.ndarray) -> np.ndarray:
    """A set by half of each hash, which is what is moved to verify a pair: chance equals shift a similarity by millionths."""
    return np.unique((hashes >> np.uint64(32)).astype(np.uint32))


def band_keys(hashes: np.ndarray) -> list[int]:
    """The signed band keys of a set; none for the empty set."""
    if not len(hashes):
        return []
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), _CHUNK):
        least = np.minimum(least, (hashes[at : at + _CHUNK, None] * _FACTORS).min(axis=0))
    keys = [xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets in order; of two empty ones 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def _sketch(text: str | None, words: int) -> tuple[int, int, int, list[int]]:
    """The digest of a text's set, its size, its fingerprint and its band keys."""
    hashes = shingle_set(text, words)
    signed = lambda n: n - (1 << 64) if n >> 63 else n
    return signed(xxhash.xxh3_64_intdigest(hashes.tobytes())), len(hashes), signed(simhash.fingerprint(text, words)), band_keys(hashes)


def _sketches(df: DataFrame, text: str, names: list[str], words: int) -> DataFrame:
    """``df`` with the set's digest, its size, the fingerprint and the band keys under ``names``."""
    inner = free_name([*df.columns, *names], "sketched_text")
    bounded_batches(df.sparkSession, 256)
    source = df.select("*", F.col(text).cast("string").alias(inner))
    kinds = (T.LongType(), T.LongType(), T.LongType(), T.ArrayType(T.LongType()))
    schema = T.StructType([*source.schema.fields[:-1], *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))])

    def run(batches):
        for batch in slices(batches, _ROWS_AT_ONCE):
            rows = [_sketch(x.as_py(), words) for x in batch.column(batch.num_columns - 1)]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=schema.names)

    return source.mapInArrow(run, schema)


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """``node`` and its shingle hashes as bytes, of rows (node, text)."""

    def run(batches):
        for batch in slices(batches, _ROWS_AT_ONCE):
            sets = [short_set(shingle_set(x.as_py(), words)).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "hashes"])

    return rows.mapInArrow(run, "node long, hashes binary")


def _similar(similarity: float):
    """Arrow function over rows (a, b, hashes of a, hashes of b): the pairs that are similar enough."""

    def run(batches):
        for batch in slices(batches, _ROWS_AT_ONCE):
            pairs = zip(batch.column(2), batch.column(3), strict=True)
            near = [jaccard(np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)) >= similarity for x, y in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    left, right = (sets.select(F.col("node").alias(x), F.col("hashes").alias(f"hashes_{x}")) for x in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "hashes_a", "hashes_b").mapInArrow(_similar(similarity), "a long, b long")


def _within_groups(edges: DataFrame, groups: DataFrame, sets: DataFrame, similarity: float, first: int = 1, growth: int = 16) -> DataFrame:
    """``edges`` and those that join what is similar within ``groups`` (key, node, size); materialised."""
    state, pivots_each = materialise(groups.select("key", "node", "size", F.lit(False).alias("closed"))), first
    while True:
        roots = components(edges)
        named = materialise(state.join(small(roots), "node", "left").select("key", "node", "size", "closed", F.coalesce("root", "node").alias("label")))
        labels = named.groupBy("key", "label").agg(F.count("*").alias("n"))
        main = labels.groupBy("key").agg(F.max(F.struct("n", "label")).alias("main"), F.count("*").alias("labels")).filter("labels > 1").select("key", F.col("main.label").alias("main"))
        order = Window.partitionBy("key").orderBy(F.xxhash64("node"), "node")
        left = named.filter("not closed").join(main, "key").filter("label != main")
        pivots = materialise(left.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= pivots_each).select("key", F.col("node").alias("pivot"), F.col("label").alias("pivot_label"), F.col("size").alias("pivot_size")))
        if pivots.isEmpty():
            return edges
        met = named.join(small(pivots), "key").filter(F.col("label") != F.col("pivot_label")).filter(F.least("size", "pivot_size") >= F.greatest("size", "pivot_size") * similarity)
        pairs = met.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
        # Components of what was found so far are stars, which say the same with fewer rows.
        stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        edges = materialise(stars.unionByName(_verified(pairs, sets, similarity)))
        done = pivots.select("key", F.col("pivot").alias("node"), F.lit(True).alias("done"))
        # A group without a pivot is done for good: what was closed has met all that could come to lie outside later.
        going = named.join(pivots, "key", "left_semi")
        after = materialise(going.join(small(done), ["key", "node"], "left").select("key", "node", "size", (F.col("closed") | F.col("done").isNotNull()).alias("closed")))
        release(state, roots, named, pivots)
        state, pivots_each = after, min(pivots_each * growth, 4096)


def similar_edges(nodes: DataFrame, rows: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Edges (a, b) that connect what is similar; ``nodes`` has node, size, fp, bands and row, ``rows`` has row, node and text.  Materialised."""
    banded = nodes.select("node", "size", F.explode("bands").alias("key"))
    shared = materialise(banded.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1"))
    # What SimHash links, directly or through others, is one more group.
    prints = materialise(nodes.select("fp").distinct())
    roots = components(simhash.links(prints))
    of = nodes.join(small(roots.select(F.col("node").alias("fp"), "root")), "fp", "left").select("node", "size", F.xxhash64(F.lit("print"), F.coalesce("root", "fp")).alias("key"))
    linked = materialise(of.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1"))
    met = materialise(banded.join(small(shared), "key").unionByName(of.join(small(linked), "key")))
    # Each node with one node of the largest group it is in: a family of near copies is mostly joined by as many pairs as it has nodes.
    best = met.groupBy("node", "size").agg(F.max(F.struct("members", "key")).alias("m")).select("node", "size", F.col("m.key").alias("key"))
    heads = materialise(met.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node", "size")).alias("p")).select("key", F.col("p.node").alias("head"), F.col("p.size").alias("head_size")))
    first = best.join(small(heads), "key").filter((F.col("node") != F.col("head")) & (F.least("size", "head_size") >= F.greatest("size", "head_size") * similarity)).select(F.col("node").alias("a"), F.col("head").alias("b"))
    pairs = materialise(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    # One row of each node that is to be compared gives its set.
    wanted = materialise(nodes.join(met.select("node").distinct(), "node", "left_semi").select("row"))
    sets = materialise(_sets(rows.join(small(wanted), "row").select("node", "text"), words))
    edges = materialise(_verified(pairs, sets, similarity))
    release(shared, linked, roots, heads, prints, pairs, wanted)
    out = _within_groups(edges, met, sets, similarity)
    release(met, sets)
    return out


def drop_near_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``df`` without near copies: of each component one row stays, of its smallest id."""
    names: list[str] = []
    for n in ("set_of_row", "set_size", "print_of_row", "bands_of_row", "number_of_row"):
        names.append(free_name([*df.columns, *names], n))
    with scratch(df.sparkSession) as stay:
        rows = materialise(_sketches(df, text, names[:4], words).withColumn(names[4], F.monotonically_increasing_id()))
        as_node = F.col(names[0]).alias("node")
        every = rows.select(as_node, F.col(names[1]).alias("size"), F.col(names[2]).alias("fp"), F.col(names[3]).alias("bands"), F.col(names[4]).alias("row"))
        nodes = materialise(every.groupBy("node").agg(F.first("size").alias("size"), F.min("fp").alias("fp"), F.first("bands").alias("bands"), F.min("row").alias("row")))
        edges = similar_edges(nodes, rows.select(as_node, F.col(names[4]).alias("row"), F.col(text).cast("string").alias("text")), words, similarity)
        release(nodes)
        roots = components(edges)
        of = rows.select(F.col(doc_id).alias("doc_id"), F.col(names[0]).alias("fp"))
        root = roots.select(F.col("node").alias("fp"), "root")
        found = materialise(of.join(small(root), "fp", "left").select("doc_id", "fp", F.coalesce("root", "fp").alias("node")))
        out, drops = simhash.one_each(rows, found, df.columns, doc_id, names[0])
        stay += [rows, drops]
    return out
