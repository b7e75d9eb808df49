"""Windows over ordered rows: segmentation, counters, regions, captions, schema order, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocab as V


def _upto(w):
    return w.rowsBetween(Window.unboundedPreceding, 0)


def text_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line: ``key``, ``line_no`` from 1, ``line``."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("p", "line")).select(key, (F.col("p") + 1).cast("long").alias("line_no"), "line")


def islands(df: DataFrame, keys: list[str], order: list[str], same: list[str]) -> DataFrame:
    """``df`` with ``island``: a number that goes up where any of ``same`` changes (null equals null)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    return df.withColumn("island", F.sum((changed | first).cast("int")).over(_upto(w)).cast("long"))


def cap_per_code(df: DataFrame, keys: list[str], code: str, order: list[str], most: int = V.LISTED) -> DataFrame:
    """The first ``most`` rows of each code, in order."""
    w = Window.partitionBy(*keys, code).orderBy(*order)
    return df.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= most).drop("nth")


def omitted_per_code(df: DataFrame, keys: list[str], code: str, most: int = V.LISTED) -> DataFrame:
    """How many rows of each code are beyond the cap."""
    return df.groupBy(*keys, code).agg((F.count("*") - most).alias("omitted")).filter("omitted > 0")


def order_violations(children: DataFrame, ranks: DataFrame) -> DataFrame:
    """The first child of each element that stands before one it must follow.

    ``children``: element, ord, list, name; ``ranks``: list, name, rank.  Names that a
    list doesn't hold are skipped; the child named is the one before it that is known.
    """
    known = children.join(F.broadcast(ranks), ["list", "name"])
    w = Window.partitionBy("element").orderBy("ord")
    known = known.withColumn("before_rank", F.lag("rank").over(w)).withColumn("before_name", F.lag("name").over(w))
    bad = known.filter(F.col("rank") < F.col("before_rank"))
    first = bad.groupBy("element", "list").agg(F.min(F.struct("ord", "name", "before_name")).alias("v"))
    return first.select("element", "list", F.col("v.ord").alias("ord"), F.col("v.name").alias("name"), F.col("v.before_name").alias("must_follow"))


def rank_table(spark) -> DataFrame:
    return spark.createDataFrame([(o, n, r) for o in V.ORDERS for n, r in V.PLACES[o].items()], "list string, name string, rank int")


def heading_counters(headings: DataFrame, key: str = "doc", pos: str = "pos", level: str = "level", levels: int = 6) -> DataFrame:
    """``headings`` with ``counters``: how often each level came since a higher one did.

    Level k counts headings of level k in the group that the headings above level k
    cut out, so the rule "advance your own, reset the deeper" is two running sums.
    """
    w = Window.partitionBy(key).orderBy(pos)
    out = headings
    for k in range(1, levels + 1):
        out = out.withColumn(f"g{k}", F.sum((F.col(level) < k).cast("int")).over(_upto(w)))
    for k in range(1, levels + 1):
        wk = Window.partitionBy(key, f"g{k}").orderBy(pos)
        out = out.withColumn(f"n{k}", F.sum((F.col(level) == k).cast("int")).over(_upto(wk)))
    return out.withColumn("counters", F.array(*(F.col(f"n{k}").cast("int") for k in range(1, levels + 1)))).drop(*(f"{x}{k}" for x in "gn" for k in range(1, levels + 1)))


def dotted_number(counters: Column, level: Column, thai_digits: bool = False) -> Column:
    """"1." for the first level, "1.2.3" below it."""
    shown = F.transform(F.slice(counters, F.lit(1), level), lambda n: X.number_text(n, "decimal", thai_digits))
    return F.when(level == 1, F.concat(shown[0], F.lit("."))).otherwise(F.array_join(shown, "."))


def outline_gaps(headings: DataFrame, key: str = "doc", pos: str = "pos", level: str = "level") -> DataFrame:
    """Headings more than one level below the heading before them."""
    w = Window.partitionBy(key).orderBy(pos)
    return headings.withColumn("before", F.lag(level).over(w)).filter(F.col(level) > F.col("before") + 1)


def regions(blocks: DataFrame, key: str = "doc", pos: str = "pos") -> DataFrame:
    """Blocks (key, pos, type, level, name) with region, section number, chapter and appendix.

    A region comment names the region of what follows; a block opens a section if a
    region comment or a first-level heading opens it and something stands before it.
    Comments themselves are left out.  Without any comment nothing is sectioned.
    """
    w = Window.partitionBy(key).orderBy(pos)
    is_comment = (F.col("type") == "directive") & F.col("name").isin(*V.REGIONS)
    rows = blocks.withColumn("comment", F.when(is_comment, F.col("name"))).withColumn("here", F.last("comment", True).over(_upto(w)))
    rows = rows.withColumn("sectioned", F.max(F.col("comment").isNotNull()).over(Window.partitionBy(key)))
    rows = rows.withColumn("comments", F.sum(F.col("comment").isNotNull().cast("int")).over(_upto(w)))
    rows = rows.filter(~is_comment).withColumn("region", F.coalesce("here", F.lit("cover")))
    first = F.coalesce((F.col("type") == "heading") & (F.col("level") == 1), F.lit(False))
    opens = F.col("sectioned") & F.lag("comments").over(w).isNotNull() & ((F.col("comments") > F.lag("comments").over(w)) | first)
    rows = rows.withColumn("new_section", F.coalesce(opens, F.lit(False))).withColumn("h1", F.col("sectioned") & first)
    count = lambda c: F.sum(c.cast("int")).over(_upto(w)).cast("int")
    return rows.withColumns({
        "section": count(F.col("new_section")) + 1,
        "h1_group": count(F.col("h1")),
        "chapter": count(F.col("h1") & (F.col("region") == "chapters")),
        "appendix": count(F.col("h1") & (F.col("region") == "appendices")),
    }).drop("comment", "here", "comments")


def region_faults(blocks: DataFrame, key: str = "doc", pos: str = "pos") -> DataFrame:
    """Region comments given twice or out of order: key, pos, name, fault.  A second "back" may follow the appendices."""
    w = Window.partitionBy(key).orderBy(pos)
    marks = blocks.filter((F.col("type") == "directive") & F.col("name").isin(*V.REGIONS))
    late = F.coalesce(F.max(F.col("name") == "appendices").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    place = F.when((F.col("name") == "back") & late, 4).otherwise(F.array_position(F.array(*map(F.lit, V.REGIONS)), F.col("name")) - 1)
    marks = marks.withColumn("place", place.cast("int"))
    again = F.row_number().over(Window.partitionBy(key, "place").orderBy(pos)) > 1
    marks = marks.withColumn("fault", F.when(again, "twice").when(F.col("place") < F.lag("place").over(w), "order"))
    return marks.filter("fault is not null").select(key, pos, "name", "fault")


def captions(blocks: DataFrame, key: str = "doc", pos: str = "pos") -> DataFrame:
    """Blocks of :func:`regions` (with text, image_only) with caption kind, chapter part and number.

    "Table:" makes a caption just before a table, "Figure:" just after an image on its
    own; each kind counts on from the last first-level heading of a sectioned document.
    """
    w = Window.partitionBy(key).orderBy(pos)
    opens = lambda word: (F.col("type") == "paragraph") & F.col("text").rlike(f"^{word}(?:[ \t]|$)")
    table = opens("Table:") & F.coalesce(F.lead("type").over(w) == "table", F.lit(False))
    figure = opens("Figure:") & F.coalesce(F.lag("image_only").over(w), F.lit(False))
    kinds = blocks.withColumn("kind", F.when(table, "table").when(figure, "figure"))
    stray = kinds.withColumn("stray", F.col("kind").isNull() & (opens("Table:") | opens("Figure:")))
    number = F.row_number().over(Window.partitionBy(key, "h1_group", "kind").orderBy(pos))
    numbered = stray.withColumn("seq", F.when(F.col("kind").isNotNull(), number))
    part = F.when((F.col("region") == "chapters") & (F.col("chapter") > 0), X.number_text("chapter")).when((F.col("region") == "appendices") & (F.col("appendix") > 0), X.number_text("appendix", "thai-letters"))
    return numbered.withColumn("caption_number", F.when(F.col("kind").isNotNull(), F.concat_ws("-", part, X.number_text("seq"))))


def script_runs(texts: DataFrame, key: str = "id", text: str = "t") -> DataFrame:
    """Text cut where the script changes: key, run (from 1), is_complex, piece.

    Characters are complex script, letters of others, neutral (white space) or
    punctuation; punctuation is complex only with complex letters on each side that
    has any; a neutral goes with what is before it, or with the first that is not.
    """
    letter, space = f"(?!{V.char_class(V.THAI)}){V.char_class(V.COMPLEX_SCRIPT)}", r"\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
    script, marks = V.char_class(V.COMPLEX_SCRIPT)[1:-1], "".join(f"\\x{{{ord(c):X}}}" for c in V.PUNCTUATION)
    # Stretches of one kind, not characters, are the rows; a joiner between two complex letters that aren't Thai belongs to their word.
    kinds = {"C": rf"(?:[{script}]|(?<={letter})[\x{{200C}}\x{{200D}}](?={letter}))+", "N": f"[{space}]+", "P": f"[{marks}]+", "L": f"[^{script}{space}{marks}]+"}
    found = F.regexp_extract_all(F.col(text), F.lit("|".join(kinds.values())), F.lit(0))
    parts = texts.select(F.col(key), F.posexplode(found).alias("i", "ch"))
    mark = F.when(F.col("ch").rlike(f"^[{script}]"), "C").when(F.col("ch").rlike(f"^[{space}]"), "N").when(F.col("ch").rlike(f"^[{marks}]"), "P").otherwise("L")
    w = Window.partitionBy(key).orderBy("i")
    parts = parts.withColumn("mark", mark).withColumn("letter", F.when(F.col("mark").isin("C", "L"), F.col("mark")))
    left = F.last("letter", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    right = F.first("letter", True).over(w.rowsBetween(1, Window.unboundedFollowing))
    inside = F.coalesce(left, right).eqNullSafe("C") & F.coalesce(right, left).eqNullSafe("C")
    parts = parts.withColumn("strong", F.when(F.col("mark") == "P", F.when(inside, "C").otherwise("L")).otherwise(F.col("letter")))
    whole = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.withColumn("script", F.coalesce(F.last("strong", True).over(_upto(w)), F.first("strong", True).over(whole), F.lit("L")))
    runs = islands(parts, [key], ["i"], ["script"])
    pieces = runs.groupBy(key, "island", "script").agg(F.array_sort(F.collect_list(F.struct("i", "ch"))).alias("cs"))
    return pieces.select(key, F.col("island").alias("run"), (F.col("script") == "C").alias("is_complex"), F.array_join("cs.ch", "").alias("piece"))


def nesting_depth(tags: DataFrame, keys: list[str], pos: str = "pos", kind: str = "kind") -> DataFrame:
    """The deepest nesting of open, close and empty tags; an empty one counts where it stands."""
    w = Window.partitionBy(*keys).orderBy(pos)
    level = F.sum(F.when(F.col(kind) == "open", 1).when(F.col(kind) == "close", -1).otherwise(0)).over(_upto(w)) + F.when(F.col(kind) == "empty", 1).otherwise(0)
    return tags.withColumn("level", level).groupBy(*keys).agg(F.max("level").cast("long").alias("depth"))
