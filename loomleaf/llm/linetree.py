"""Line dedup by a log-template tree (operator 3).

Every line is parsed to a fixed depth: by its number of tokens, then by its first
``depth`` tokens, where a token that holds a digit reads "<*>".  Lines that reach
the same leaf are generalised: past the leading tokens, a token that fewer than
``min_docs`` documents of the leaf have at its place is a variable field and
reads "<*>" too.  A template must keep three quarters of its tokens literal, else
the line stands for itself (with digit fields masked if that leaves half of its
tokens literal).  A template found in ``min_docs`` or more different texts is
recurring: its lines are dropped wherever they stand, but in the text with the
smallest document id that has it, so nothing leaves the corpus altogether.

Documents with equal text are one text here: they count once and get equal
results, so exact copies stay copies for a later document dedup.  Only SQL
functions run.  The corpus is parsed once, into a working table of lines.  A leaf with fewer
than ``min_docs`` texts can't hold a recurring template; that prunes the lines before their
tokens are looked at.  What the line pass is joined with is broadcast only if it takes
few bytes, else shuffled.

``min_docs`` is a number of texts, or below 1 a share of the distinct texts (but 2 at least): in
a corpus that grows, a fixed number makes ever more short lines recurring by chance.

Lines in fewer texts mostly belong to near copies, which a later stage drops whole
and wouldn't know without them; ``drop_repeated_lines`` then finds those of
``LONG_WORDS`` words or more that two texts still share word for word.

Defined cases: a null text stays null; lines without tokens are never dropped; a
document all of whose lines go keeps an empty text; documents without id rank
last as "smallest id"; repeated rows get equal results; an empty table gives an empty one; a
text may have any number of lines, which are dropped in time linear in it; all columns pass
through, whatever their names (working columns are underscored until they clash with none).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WORD, free_name, hash128, materialise, release, scratch, small

MIN_DOCS, DEPTH, LONG_WORDS = 10, 4, 8
_GAP = r"[\x20\x09-\x0D]+"
#: A whole token with a digit; it starts only where a token starts, so it takes linear time.
_FIELD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
_TEXT_KEY = ["t0", "t1"]


def _named(cols, names) -> list:
    return [c.alias(n) for c, n in zip(cols, names, strict=True)]


def tree_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """Every line that has tokens: text key, ``doc_id``, line number, the line, its token count and leaf key."""
    docs = df.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *_named(hash128(F.col(text)), _TEXT_KEY))
    lines = docs.select(*_TEXT_KEY, "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("n", F.regexp_count("line", F.lit(WORD))).filter("n > 0")
    lead = F.regexp_extract("line", rf"^{_GAP[:-1]}*((?:{WORD}{_GAP}){{0,{depth - 1}}}{WORD})", 1)
    lead = F.regexp_replace(F.regexp_replace(lead, _GAP, " "), _FIELD, "<*>")
    return lines.select("*", *_named(hash128(F.col("n"), lead), ["leaf0", "leaf1"]))


def least_texts(df: DataFrame, min_docs: float, text: str = "text") -> int:
    """``min_docs`` as a number of texts: itself, or below 1 that share of the distinct texts."""
    if min_docs >= 1:
        return int(min_docs)
    return max(2, math.ceil(min_docs * df.filter(F.col(text).isNotNull()).select(*hash128(F.col(text))).distinct().count()))


def recurring_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: float = MIN_DOCS, depth: int = DEPTH) -> DataFrame:
    """For each text that loses lines: its key and the array of their numbers; materialised."""
    with scratch(df.sparkSession) as stay:
        stay.append(out := _recurring(df, doc_id, text, least_texts(df, min_docs, text), depth))
    return out


def _recurring(df: DataFrame, doc_id: str, text: str, min_docs: int, depth: int) -> DataFrame:
    leaf, key, own = ["leaf0", "leaf1"], ["m0", "m1"], ["k0", "k1"]
    lines = materialise(tree_lines(df, doc_id, text, depth))
    full = materialise(lines.select(*leaf, *_TEXT_KEY).distinct().groupBy(*leaf).agg(F.count("*").alias("texts")).filter(F.col("texts") >= min_docs).select(*leaf))
    found = lines.join(small(full), leaf)
    plain = F.btrim(F.regexp_replace("line", _GAP, " "))
    found = found.withColumn("masked", F.regexp_replace(plain, _FIELD, "<*>"))
    literal = F.size(F.filter(F.split("masked", " "), lambda t: t != "<*>"))
    found = found.withColumn("form", F.when(literal * 2 >= F.col("n"), F.col("masked")).otherwise(plain))
    # The forms of a leaf, in how many texts each stands, and where.
    stands = found.groupBy(*leaf, "form", "n", *_TEXT_KEY).agg(F.min("doc_id").alias("doc_id"), F.collect_set("line_no").alias("line_nos"))
    stands = materialise(stands.select("*", *_named(hash128("leaf0", "leaf1", "form"), key)))
    release(lines)
    forms = materialise(stands.groupBy(*leaf, *key, "form", "n").agg(F.count("*").alias("texts")))
    # Tokens past the leading ones, and which of them are not variable.
    tokens = forms.filter(F.col("n") > depth).select(*leaf, *key, "texts", F.posexplode(F.split("form", " ")).alias("at", "token"))
    steady = tokens.filter((F.col("at") >= depth) & (F.col("token") != "<*>")).groupBy(*leaf, "at", "token").agg(F.sum("texts").alias("texts"))
    steady = materialise(steady.filter(F.col("texts") >= min_docs).select(*leaf, "at", "token", F.lit(True).alias("steady")))
    read = tokens.join(small(steady), [*leaf, "at", "token"], "left")
    shown = F.when((F.col("at") < depth) | F.col("steady"), F.col("token")).otherwise("<*>")
    trees = read.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", shown.alias("token")))).alias("ts"))
    trees = trees.select(*key, F.col("ts.token").alias("template"))
    joined = forms.join(trees, key, "left")
    kept = F.size(F.filter("template", lambda t: t != "<*>"))
    final = F.when(kept * 4 >= 3 * F.col("n"), F.array_join("template", " ")).otherwise(F.col("form"))
    named = materialise(joined.select(*key, *_named(hash128("leaf0", "leaf1", final), own)))
    placed = materialise(stands.join(small(named), key).select(*own, *_TEXT_KEY, "doc_id", "line_nos"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *_TEXT_KEY)).alias("first")
    texts = placed.groupBy(*own, *_TEXT_KEY).agg(F.min("doc_id").alias("doc_id"))
    repeated = materialise(texts.groupBy(*own).agg(F.count("*").alias("texts"), first).filter(F.col("texts") >= min_docs).select(*own, F.col("first.t0").alias("f0"), F.col("first.t1").alias("f1")))
    drop = placed.join(small(repeated), own).filter("t0 != f0 or t1 != f1")
    return materialise(drop.groupBy(*_TEXT_KEY).agg(F.array_distinct(F.flatten(F.collect_set("line_nos"))).alias("line_nos")))


def repeated_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 2, min_words: int = LONG_WORDS) -> DataFrame:
    """As ``recurring_lines`` for lines of ``min_words`` or more that stand word for word in ``min_docs`` texts."""
    with scratch(df.sparkSession) as stay:
        stay.append(out := _repeated(df, doc_id, text, min_docs, min_words))
    return out


def _repeated(df: DataFrame, doc_id: str, text: str, min_docs: int, min_words: int) -> DataFrame:
    own = ["k0", "k1"]
    lines = tree_lines(df, doc_id, text).filter(F.col("n") >= min_words)
    placed = materialise(lines.select(*_named(hash128(F.btrim(F.regexp_replace("line", _GAP, " "))), own), *_TEXT_KEY, "doc_id", "line_no"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *_TEXT_KEY)).alias("first")
    texts = placed.groupBy(*own, *_TEXT_KEY).agg(F.min("doc_id").alias("doc_id"))
    repeated = materialise(texts.groupBy(*own).agg(F.count("*").alias("texts"), first).filter(F.col("texts") >= min_docs).select(*own, F.col("first.t0").alias("f0"), F.col("first.t1").alias("f1")))
    drop = placed.join(small(repeated), own).filter("t0 != f0 or t1 != f1")
    return materialise(drop.groupBy(*_TEXT_KEY).agg(F.collect_set("line_no").alias("line_nos")))


def drop_repeated_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 2, min_words: int = LONG_WORDS) -> DataFrame:
    """``df`` with repeated long lines cut out of ``text``, for texts of which near copies are gone."""
    return _without(df, repeated_lines(df, doc_id, text, min_docs, min_words), text)


def drop_recurring_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: float = MIN_DOCS, depth: int = DEPTH, counts: bool = False) -> DataFrame:
    """``df`` with the recurring lines cut out of ``text``; with ``counts`` also ``n_lines`` and ``n_dropped``."""
    return _without(df, recurring_lines(df, doc_id, text, min_docs, depth), text, counts)


def _without(df: DataFrame, drops: DataFrame, text: str, counts: bool = False) -> DataFrame:
    """``df`` without the lines of ``drops``."""
    names = [free_name([*df.columns, "n_lines", "n_dropped"], n) for n in ("key0", "key1", "gone0", "gone1", "gone")]
    table = small(drops.select(*_named([F.col("t0"), F.col("t1"), F.col("line_nos")], names[2:])))
    rows = df.select("*", *_named(hash128(F.col(text)), names[:2]))
    rows = rows.join(table, (F.col(names[0]) == F.col(names[2])) & (F.col(names[1]) == F.col(names[3])) & F.col(text).isNotNull(), "left")
    # One array around the lines binds them: they are split once, and looked up by the numbers that stay.
    stay = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(names[4]))
    left = F.transform(F.array(F.split(text, "\n")), lambda lines: F.array_join(F.transform(stay(lines), lambda i: F.get(lines, i)), "\n"))[0]
    out = [F.when(F.col(names[4]).isNull(), F.col(c)).otherwise(left).alias(c) if c == text else F.col(c) for c in df.columns]
    if counts:
        out += [F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.when(F.col(names[4]).isNotNull(), F.size(names[4])), F.lit(0)).cast("long").alias("n_dropped")]
    return rows.select(*out)
