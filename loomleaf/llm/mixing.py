"""Mixing sources to target weights (operator 5).

Every source's documents are laid end to end and cut into blocks of
``block_words`` words.  Targets share ``share`` times all words out by weight; a
source stops at ``most`` times its own size and the excess goes to the others.

The mix is a run of output shards of fixed length (in slots).  For each shard a
multinomial draw says how many slots each source gets, by the weights of what its
target still lacks, so that chance deviations of early shards are made up by later ones;
what a source can't give (``most`` times its blocks are drawn) is drawn again among
the others.  Each source's counts run on from shard to shard: they say which of its
slots exist, so the draw decides how many words are taken, near the target but not
equal to it.  A slot is mapped to a block by the source's own pseudorandom permutation
of block indices, a fresh one in each epoch, and slots meet blocks in an equality join
on the index.  :func:`packed_blocks` emits the mix so, by shard; :func:`taken_words`
counts it by document; :func:`mixed_documents` puts the drawn words of each document
and epoch back together.

A block is ``block_words`` words but for the tail of a source, which stands last
in each epoch.  Documents are placed in a source by hash buckets: running sums by
bucket plus bucket offsets, so a source that holds most rows is many groups; a table has
the more buckets, the more rows it has.  The permutation is a generalised Feistel network
with cycle walking, in SQL functions.  The draw itself runs over one row a source.

Defined cases: a null text has size 0 and is never drawn; a null source is a
source of its own, last in order; repeated rows are separate documents; sources
of size 0 have target 0; a source smaller than a block is one block; an empty table gives
an empty one; further columns pass through :func:`mixed_documents` whatever their names,
and are not read by the others.  Results depend on the rows and parameters alone, not on
partitions, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, materialise, small

WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2
#: Words a block; shards at least; slots a shard at most; buckets a source at least, and rows of the table a bucket stands for; seed.
BLOCK_WORDS, SHARDS, SHARD_SLOTS, BUCKETS, BUCKET_ROWS, SEED = 128, 256, 1 << 20, 1024, 1 << 14, 20
_SLOT_RUN, _TASK_SLOTS, _TASKS = 4096, 1 << 17, 64
_SOURCE, _ROW = ["none", "src"], ["k0", "k1"]


def _row_key(doc_id: str, tie: Column) -> list[Column]:
    """128 bits that tell rows of different id or text apart."""
    return [F.xxhash64(F.col(doc_id), tie), F.xxhash64(F.lit("row"), F.col(doc_id), tie)]


def permuted(i: Column, n: Column, *key: Column) -> Column:
    """Index ``i`` of 0..n-1 under a pseudorandom permutation chosen by ``key``.

    Four Feistel rounds permute an a x b grid of at least n cells with a, b near
    the root of n; cells past the end walk on along their cycle.  Fewer than a
    cells lie past the end: for a below 64 no walk is longer than the 64 steps
    taken, and above that one step in 64 or fewer leads to another.
    """
    n = F.greatest(n, F.lit(1))
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.floor((n + a - 1) / a).cast("long")

    def step(x: Column) -> Column:
        left, right = F.pmod(x, a), F.floor(x / a).cast("long")
        for turn in range(4):
            if turn % 2 == 0:
                left = F.pmod(left + F.pmod(F.xxhash64(F.lit(turn), *key, right), a), a)
            else:
                right = F.pmod(right + F.pmod(F.xxhash64(F.lit(turn), *key, left), b), b)
        return right * a + left

    once = step(i)
    return F.when(once < n, once).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(63)), once, lambda x, _: F.when(x < n, x).otherwise(step(x))))


def target_table(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sizes`` (one row per source: none, src, source_size) with ``target``.

    Sources take the weights in turn by code point, null last.  The global order is
    over this summary, one row per source.
    """
    order = Window.orderBy("none", "src")
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight"))
    up = Window.orderBy("ratio", "none", "src")
    before, every = up.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total = F.sum("source_size").over(every) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", level).withColumn("open", F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "none", "src", "level")))
    rows = rows.withColumn("final", F.min("open").over(every))
    capped = F.col("final").isNull() | (F.struct("ratio", "none", "src") < F.struct("final.ratio", "final.none", "final.src"))
    target = F.when(capped, F.col("cap")).otherwise(F.least(F.col("weight") * F.col("final.level"), F.col("cap")))
    return rows.select("none", "src", "source_size", target.alias("target"))


def bucket_count(df: DataFrame) -> int:
    """Buckets a source: a power of two times BUCKETS that keeps a bucket of the whole table near BUCKET_ROWS rows."""
    return BUCKETS << max(0, (df.count() // (BUCKETS * BUCKET_ROWS)).bit_length())


def _columns(doc_id: str, text: str, source: str, n_buckets: int) -> list[Column]:
    """Whether the source is null, the source, the size and the bucket of a row."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    bucket = F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(n_buckets))
    return [F.col(source).isNull().alias("none"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("src"), size.alias("size"), bucket.alias("bucket")]


def placed_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: tuple = (), n_buckets: int = BUCKETS) -> DataFrame:
    """``keep`` columns with each row's source, ``size``, bucket, number in it and first word's place in the bucket."""
    rows = df.select(*[F.col(c).alias(f"in_{c}") for c in keep], F.col(doc_id).alias("doc_id"), *_columns(doc_id, text, source, n_buckets), F.xxhash64(F.col(text)).alias("tie"))
    here = Window.partitionBy("none", "src", "bucket").orderBy("doc_id", "tie")
    return rows.select("*", F.row_number().over(here).alias("row_no"), (F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("place"))


def bucket_table(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", n_buckets: int = BUCKETS) -> DataFrame:
    """Words of each source and bucket, and the words before it in the source; materialised."""
    sums = df.select(*_columns(doc_id, text, source, n_buckets))
    sums = sums.groupBy(*_SOURCE, "bucket").agg(F.sum("size").alias("words"))
    along = Window.partitionBy(*_SOURCE).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return materialise(sums.select(*_SOURCE, "bucket", "words", F.coalesce(F.sum("words").over(along), F.lit(0)).alias("before")))


def source_plan(buckets: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per source: size, target, blocks, and the slots it can give (``epochs`` whole ones and ``rest`` words); materialised."""
    sizes = buckets.groupBy(*_SOURCE).agg(F.sum("words").cast("long").alias("source_size"))
    rows = target_table(sizes, weights, share, most)
    size = F.greatest(F.col("source_size"), F.lit(1))
    room = F.floor(F.col("source_size") * F.lit(float(most))).cast("long")
    rows = rows.withColumns({"full": F.floor(F.col("source_size") / block_words).cast("long"), "tail": F.col("source_size") % block_words, "epochs": F.floor(room / size).cast("long"), "rest": room % size})
    blocks = F.col("full") + (F.col("tail") > 0).cast("long")
    part = F.when(F.col("rest") > F.col("full") * block_words, F.col("full") + 1).otherwise(F.ceil(F.col("rest") / block_words)).cast("long")
    return materialise(rows.withColumns({"blocks": blocks, "slots": F.col("epochs") * blocks + part}))


def draw_counts(sources: pd.DataFrame, shards: int, shard_slots: int, block_words: int, seed: int):
    """(shard, slots of each source) for one shard after another; ``sources`` has source_size, target, blocks and slots."""
    size, target, blocks, room = (sources[c].to_numpy(np.int64 if c != "target" else np.float64) for c in ("source_size", "target", "blocks", "slots"))
    alive = blocks > 0
    per = np.where(alive, size / np.maximum(blocks, 1), 1.0)
    words = lambda n: n // np.maximum(blocks, 1) * size + np.minimum(n % np.maximum(blocks, 1) * block_words, size)
    every = int(round(float((target[alive] / per[alive]).sum())))
    parts = max(1, min(shards, every), -(-every // shard_slots))
    length, drawn = -(-every // parts), np.zeros(len(size), dtype=np.int64)
    for shard in range(parts):
        rng, before = np.random.default_rng([seed, shard]), drawn.copy()
        left = min(length, every - shard * length)
        while left > 0:
            space = alive & (drawn < room)
            weight = np.where(space, np.maximum(target - words(drawn), 0.0) / per, 0.0)
            if not weight.sum():
                weight = np.where(space, target / per, 0.0)
            if not weight.sum():
                return
            more = np.minimum(rng.multinomial(left, weight / weight.sum()), room - drawn)
            drawn = drawn + more
            left -= int(more.sum())
        yield shard, before, drawn - before


def _draws(shards: int, shard_slots: int, block_words: int, seed: int):
    """Arrow-side form of :func:`draw_counts`: source, shard, first slot and count, where there are any."""

    def run(frames):
        frames = list(frames)
        rows = pd.concat(frames) if frames else None
        if rows is None or not len(rows):
            return
        rows = rows.sort_values(["none", "src"], ignore_index=True)
        for shard, first, count in draw_counts(rows, shards, shard_slots, block_words, seed):
            some = np.flatnonzero(count)
            yield pd.DataFrame({"none": rows["none"].to_numpy()[some], "src": rows["src"].to_numpy()[some], "shard": np.int64(shard), "first": first[some], "count": count[some]})

    return run


def slot_table(plan: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Every drawn slot: source, ``shard``, ``slot`` (in the source), ``epoch``, ``block``, ``take`` (words from the block's start)."""
    dealt = plan.select(*_SOURCE, "source_size", "target", "blocks", "slots").repartition(1).mapInPandas(_draws(shards, shard_slots, block_words, seed), "none boolean, src string, shard long, first long, count long")
    dealt = materialise(dealt)
    every = dealt.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    runs = dealt.select(*_SOURCE, "shard", (F.col("first") + F.col("count")).alias("end"), F.explode(F.sequence("first", F.col("first") + F.col("count") - 1, F.lit(_SLOT_RUN))).alias("at"))
    runs = runs.repartition(max(_TASKS, -(-every // _TASK_SLOTS)), "none", "src", "shard", "at")  # a number, so that small runs aren't put back together
    slots = runs.select(*_SOURCE, "shard", F.explode(F.sequence("at", F.least(F.col("at") + _SLOT_RUN, F.col("end")) - 1)).alias("slot")).join(small(plan), _SOURCE)
    slots = slots.withColumns({"epoch": F.floor(F.col("slot") / F.col("blocks")).cast("long"), "i": F.col("slot") % F.col("blocks")})
    mixed = permuted(F.col("i"), F.col("full"), F.lit(seed), F.col("none"), F.col("src"), F.col("epoch"))
    long = F.when(F.col("i") == F.col("full"), F.col("tail")).otherwise(F.lit(block_words).cast("long"))
    take = F.when(F.col("epoch") < F.col("epochs"), long).otherwise(F.least(long, F.col("rest") - F.col("i") * block_words))
    return slots.select(*_SOURCE, "shard", "slot", "epoch", F.when(F.col("i") == F.col("full"), F.col("i")).otherwise(mixed).alias("block"), take.alias("take"))


def _pieces(placed: DataFrame, buckets: DataFrame, block_words: int) -> DataFrame:
    """Rows of ``placed`` once for each block that they share words with (once, with no block, if of size 0)."""
    rows = placed.join(buckets.select(*_SOURCE, "bucket", "before"), [*_SOURCE, "bucket"]).withColumn("start", F.col("before") + F.col("place"))
    last = F.floor((F.col("start") + F.col("size") - 1) / block_words).cast("long")
    rows = rows.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block_words).cast("long"), last))))
    lo = F.greatest(F.col("start"), F.col("block") * block_words)
    hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    return rows.withColumns({"lo": lo - F.col("block") * block_words, "hi": hi - F.col("block") * block_words, "from_word": lo - F.col("start")})


def taken_words(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """A row per document: ``doc_id``, ``size``, ``source_size``, ``target`` (its source's) and ``taken`` (repeats counted)."""
    n_buckets = bucket_count(df)
    buckets = bucket_table(df, doc_id, text, source, n_buckets)
    plan = source_plan(buckets, weights, share, most, block_words)
    slots = slot_table(plan, block_words, shards, seed)
    pieces = _pieces(placed_documents(df, doc_id, text, source, n_buckets=n_buckets), buckets, block_words)
    joined = pieces.join(slots.select(*_SOURCE, "block", "take"), [*_SOURCE, "block"], "left")
    words = F.greatest(F.least("hi", F.coalesce("take", F.lit(0))) - F.col("lo"), F.lit(0))  # no slot draws the block: none of it
    sums = joined.groupBy(*_SOURCE, "bucket", "row_no", "doc_id", "size").agg(F.coalesce(F.sum(words), F.lit(0)).cast("long").alias("taken"))
    return sums.join(small(plan).select(*_SOURCE, "source_size", "target"), _SOURCE).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED, length: str | None = "n_chars") -> DataFrame:
    """The mix as rows of ``df``: each document once for every epoch that draws words of it.

    ``text`` is what the epoch drew, in the document's order: the whole text if it
    drew every word, else its drawn words with the white space after them.
    ``length``, if a column, is set to the new text's code points.
    """
    n_buckets = bucket_count(df)
    buckets = bucket_table(df, doc_id, text, source, n_buckets)
    plan = source_plan(buckets, weights, share, most, block_words)
    slots = slot_table(plan, block_words, shards, seed)
    slim = placed_documents(df, doc_id, text, source, n_buckets=n_buckets).withColumns(dict(zip(_ROW, _row_key("doc_id", F.col("tie")), strict=True)))
    # Rows of equal id, text and source are told apart by a number; which of them gets which draw makes no difference.
    slim = slim.withColumn("copy", F.row_number().over(Window.partitionBy(*_SOURCE, "bucket", *_ROW).orderBy("row_no")))
    own = [*_SOURCE, *_ROW, "copy"]
    joined = _pieces(slim, buckets, block_words).join(slots.select(*_SOURCE, "block", "epoch", "take"), [*_SOURCE, "block"])
    n = F.least("hi", "take") - F.col("lo")
    drawn = joined.filter(n > 0).groupBy(*own, "size", "epoch").agg(F.array_sort(F.collect_list(F.struct("from_word", n.alias("n")))).alias("drawn"), F.sum(n).alias("words"))
    drawn = drawn.groupBy(*own, "size").agg(F.collect_list(F.struct("epoch", "words", "drawn")).alias("draws"))
    many = materialise(slim.groupBy(*_SOURCE, *_ROW).agg(F.count("*").alias("n")).filter("n > 1").select(*_SOURCE, *_ROW))
    none, src = F.col(source).isNull().alias("none"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("src")
    full = df.select(*[F.col(c).alias(f"in_{c}") for c in df.columns], none, src, *(c.alias(name) for name, c in zip(_ROW, _row_key(doc_id, F.xxhash64(F.col(text))), strict=True)))
    if many.isEmpty():
        rows = full.withColumn("copy", F.lit(1))
    else:
        key = [*_SOURCE, *_ROW]
        numbered = full.join(small(many), key, "left_semi").withColumn("copy", F.row_number().over(Window.partitionBy(*key).orderBy("k0")))
        rows = full.join(small(many), key, "left_anti").withColumn("copy", F.lit(1)).unionByName(numbered)
    rows = rows.join(drawn, own).withColumn("draw", F.explode("draws"))
    words = F.regexp_extract_all(F.col(f"in_{text}"), F.lit(rf"{WORD}[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.aggregate("draw.drawn", F.lit(""), lambda out, d: F.concat(out, F.array_join(F.slice(F.col("words"), (d["from_word"] + 1).cast("int"), d["n"].cast("int")), "")))
    whole = F.col("draw.words") == F.col("size")
    rows = rows.withColumn("words", F.when(~whole, words)).withColumn("mixed_text", F.when(whole, F.col(f"in_{text}")).otherwise(cut))
    out = {c: F.col(f"in_{c}") for c in df.columns} | {text: F.col("mixed_text")}
    if length in df.columns:
        out[length] = F.length("mixed_text").cast(df.schema[length].dataType)
    return rows.select(*(c.alias(name) for name, c in out.items()))


def packed_blocks(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix as packed blocks: a row per slot with ``shard``, ``place`` (order it by this in the shard), ``source``, ``slot``, ``epoch``, ``block``, ``n_words``, ``text``.

    A block's words are joined by single spaces.
    """
    n_buckets = bucket_count(df)
    buckets = bucket_table(df, doc_id, text, source, n_buckets)
    slots = slot_table(source_plan(buckets, weights, share, most, block_words), block_words, shards, seed)
    rows = placed_documents(df, doc_id, text, source, (text,), n_buckets).filter("size > 0").join(buckets.select(*_SOURCE, "bucket", "before"), [*_SOURCE, "bucket"])
    start, end = F.col("before") + F.col("place"), F.col("before") + F.col("place") + F.col("size")
    lo, hi = lambda b: F.greatest(start, b * block_words), lambda b: F.least(end, (b + 1) * block_words)
    spans = F.sequence(F.floor(start / block_words).cast("long"), F.floor((end - 1) / block_words).cast("long"))
    piece = lambda words, b: F.struct(b.alias("block"), (lo(b) - b * block_words).alias("lo"), F.slice(words, (lo(b) - start + 1).cast("int"), (hi(b) - lo(b)).cast("int")).alias("words"))
    # One array around the words binds them, so that a text is split once for all of its blocks.
    bound = F.array(F.regexp_extract_all(F.col(f"in_{text}"), F.lit(WORD), F.lit(0)))
    pieces = rows.select(*_SOURCE, F.explode(F.transform(bound, lambda words: F.transform(spans, lambda b: piece(words, b)))[0]).alias("p")).select(*_SOURCE, "p.*")
    blocks = pieces.groupBy(*_SOURCE, "block").agg(F.array_sort(F.collect_list(F.struct("lo", "words"))).alias("pieces"))
    blocks = blocks.select(*_SOURCE, "block", F.flatten("pieces.words").alias("words"))
    rows = slots.join(blocks, [*_SOURCE, "block"])
    named = F.when(~F.col("none"), F.col("src")).alias("source")
    return rows.select("shard", F.xxhash64(F.lit(seed), *_SOURCE, "slot").alias("place"), named, "slot", "epoch", "block", F.col("take").alias("n_words"), F.array_join(F.slice("words", F.lit(1), F.col("take").cast("int")), " ").alias("text"))
