"""The catalogue: every query with, where SQL can express it, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions import vocab as V
from ..operators import governance as G
from ..operators import ordered as O
from ..operators import places as P
from ..operators import sets as S
from ..operators import settings as C
from ..operators.build import build_packages, build_warnings
from ..operators.checks import check_packages, package_summaries, part_roles
from ..operators.repair import repair_packages
from ..sources.markdown import markdown_blocks, markdown_inlines
from ..sources.packages import admit, package_parts, rewrite_package
from ..sources.xmlnodes import xml_nodes
from ..workspace import dealt, spread
from . import fixtures as L

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"


def query(oracle: str | None = None):
    """Register the decorated function under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; the texts, which take work, over all cores even where they are one small file."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("documents", "conversations") else rows


_sql_text = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"

# -- over the tables ----------------------------------------------------------------

_LINES_SQL = "SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents"
_CODES = {"digits": "[0-9]{6,}", "email": _EMAIL, "markup": r"[*|]{2,}|\| ", "shout": "[!?]{2,}", "not ascii": r"[^\x00-\x7F]"}
_LINT_SQL = f"WITH l AS ({_LINES_SQL}) " + " UNION ALL ".join(f"SELECT doc_id, line_no, '{c}' AS code FROM l WHERE regexp_matches(line, '{r}')" for c, r in _CODES.items()) + " UNION ALL SELECT doc_id, line_no, 'long line' AS code FROM l WHERE length(line) > 1000"


def lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every code that holds for a line of a document."""
    lines = O.text_lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    codes = F.array_compact(F.array(*(F.when(F.col("line").rlike(r), c) for c, r in _CODES.items()), F.when(F.length("line") > 1000, "long line")))
    return lines.select("doc_id", "line_no", F.explode(codes).alias("code"))


@query(_LINES_SQL)
def lines_numbered(spark, sf_dir):
    return O.text_lines(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"SELECT code, count(*) AS findings, count(DISTINCT doc_id) AS documents FROM ({_LINT_SQL}) GROUP BY code")
def lint_summary(spark, sf_dir):
    """How often each code is found, and in how many documents."""
    each = lint(spark, sf_dir).groupBy("doc_id", "code").agg(F.count("*").alias("n"))
    return each.groupBy("code").agg(F.sum("n").alias("findings"), F.count("*").alias("documents"))


@query(f"SELECT doc_id, line_no, code FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, code ORDER BY line_no) AS nth FROM ({_LINT_SQL})) WHERE nth <= 20")
def cap20_per_code(spark, sf_dir):
    """The first twenty findings of each code in a document."""
    return O.cap_per_code(lint(spark, sf_dir), ["doc_id"], "code", ["line_no"])


@query(f"SELECT doc_id, code, count(*) - 20 AS omitted FROM ({_LINT_SQL}) GROUP BY doc_id, code HAVING count(*) > 20")
def omitted_per_code(spark, sf_dir):
    return O.omitted_per_code(lint(spark, sf_dir), ["doc_id"], "code")


@query(r"SELECT lang, count(*) AS documents, count(*) FILTER (regexp_matches(text, '[0-9]')) AS with_digits, count(*) FILTER (regexp_matches(text, '[^\x00-\x7F]')) AS not_ascii, count(*) FILTER (regexp_matches(text, '[\x{E00}-\x{E7F}]')) AS thai FROM documents GROUP BY lang")
def char_class_by_lang(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.count("*").alias("documents"), S.conditional("with_digits", F.col("text").rlike("[0-9]")), S.conditional("not_ascii", F.col("text").rlike(r"[^\x00-\x7F]")), S.conditional("thai", X.has_thai("text")))


@query(f"SELECT doc_id, unnest(regexp_extract_all(text, '{_EMAIL}')) AS email FROM documents")
def emails_found(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({_EMAIL})"), F.lit(1))).alias("email"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def digest_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE event_type = before")
def adjacent_same_event(spark, sf_dir):
    """Events that repeat the type of the user's event before them."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("before", F.lag("event_type").over(w)).filter("event_type = before").select("user_id", "event_id")


@query("""SELECT user_id, island, min(event_type) AS event_type, count(*) AS events FROM (
  SELECT *, sum(CASE WHEN event_type IS DISTINCT FROM before OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (
    SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)) GROUP BY user_id, island""")
def event_islands(spark, sf_dir):
    """Stretches of equal events of a user."""
    runs = O.islands(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type"])
    return runs.groupBy("user_id", "island").agg(F.min("event_type").alias("event_type"), F.count("*").alias("events"))


@query("""SELECT conv_id, island, min(role) AS role, count(*) AS turns FROM (
  SELECT *, sum(CASE WHEN role IS DISTINCT FROM before OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM (
    SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)) GROUP BY conv_id, island""")
def turn_islands(spark, sf_dir):
    runs = O.islands(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], ["role"])
    return runs.groupBy("conv_id", "island").agg(F.min("role").alias("role"), F.count("*").alias("turns"))


@query("SELECT user_id, event_id, event_id - before AS gap FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE event_id - before > 100")
def id_gaps(spark, sf_dir):
    """Jumps of more than a hundred between a user's events, as outline gaps jump levels."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf_dir, "events").withColumn("before", F.lag("event_id").over(w))
    return rows.filter("event_id - before > 100").select("user_id", "event_id", (F.col("event_id") - F.col("before")).alias("gap"))


@query("SELECT length(word) AS word_length, count(*) AS words FROM (SELECT unnest(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS word FROM documents) GROUP BY 1".replace("\\\\", "\\"))
def word_length_hist(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([^ \t\n\r]+)"), F.lit(1))).alias("word"))
    return words.groupBy(F.length("word").cast("long").alias("word_length")).agg(F.count("*").alias("words"))


_HREF_SQL = """SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages"""


def _hrefs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


@query(f"SELECT page_id, href, count(*) AS times FROM ({_HREF_SQL}) GROUP BY 1, 2")
def page_links(spark, sf_dir):
    return _hrefs(spark, sf_dir).groupBy("page_id", "href").agg(F.count("*").alias("times"))


_PATH_SQL = "SELECT page_id AS target_id, regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) AS path FROM pages"


def _paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("target_id"), F.regexp_extract("url", r"^[^:]*://[^/?#]*([^?#]*)", 1).alias("path"))


_SELF_SQL = f"SELECT page_id, path AS href FROM ({_HREF_SQL}) JOIN ({_PATH_SQL}) ON target_id = page_id + 1 UNION ALL {_HREF_SQL}"


@query(f"SELECT l.page_id, p.target_id, count(*) AS links FROM ({_SELF_SQL}) l JOIN ({_PATH_SQL}) p ON l.href = p.path GROUP BY 1, 2")
def page_links_internal_join(spark, sf_dir):
    """Links joined to the pages whose path they name; each page's links also name its neighbour's path, as the pages' own name none."""
    own, paths = _hrefs(spark, sf_dir), _paths(spark, sf_dir)
    links = own.join(paths, F.col("target_id") == F.col("page_id") + 1).select("page_id", F.col("path").alias("href")).unionByName(own)
    to = _paths(spark, sf_dir)
    return links.join(to, links["href"] == to["path"]).groupBy("page_id", to["target_id"]).agg(F.count("*").alias("links"))


@query(f"SELECT href, count(*) AS links FROM ({_HREF_SQL}) l WHERE NOT EXISTS (SELECT 1 FROM ({_PATH_SQL}) p WHERE p.path = l.href) GROUP BY 1")
def dangling_links(spark, sf_dir):
    held = _paths(spark, sf_dir).withColumnRenamed("path", "href")
    return S.dangling(_hrefs(spark, sf_dir), held, ["href"]).groupBy("href").agg(F.count("*").alias("links"))


@query("SELECT entity, count(*) AS times FROM (SELECT unnest(regexp_extract_all(html, '&[a-z]+;')) AS entity FROM pages) GROUP BY 1")
def entities_in_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("(&[a-z]+;)"), F.lit(1))).alias("entity")).groupBy("entity").agg(F.count("*").alias("times"))


@query("""SELECT doc_id, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped_chars,
  replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') = text AS same FROM documents""")
def escape_roundtrip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.length(X.xml_text("text")).cast("long").alias("escaped_chars"), (X.xml_unescape(X.xml_text("text")) == F.col("text")).alias("same"))


@query("""SELECT doc_id, count(*) FILTER (regexp_matches(w, '[^\\x00-\\x7F]')) AS accented, count(*) FILTER (regexp_matches(w, '[a-z]') AND NOT regexp_matches(w, '[^\\x00-\\x7F]')) AS plain
  FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents) GROUP BY doc_id""")
def first_word_language(spark, sf_dir):
    """Words with and without letters beyond ASCII, as a message's language is decided."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.lower("text"), " ")).alias("w"))
    beyond = F.col("w").rlike(r"[^\x00-\x7F]")
    return words.groupBy("doc_id").agg(S.conditional("accented", beyond), S.conditional("plain", F.col("w").rlike("[a-z]") & ~beyond))


@query(r"SELECT page_id, upper(replace(lower(regexp_replace(trim(regexp_extract(html, '<title>([^<]*)', 1), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[ \t\r\n]+', ' ', 'g')), 'ß', 'ss')) AS label FROM pages")
def label_normalized(spark, sf_dir):
    """Every page's title as link labels are compared; SQL's upper() lacks the one letter that becomes two."""
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", X.normalize_label(title).alias("label"))


@query("SELECT lang, source, n FROM (SELECT lang, source, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS nth FROM documents GROUP BY lang, source) WHERE nth = 1")
def top_value_tiebreak(spark, sf_dir):
    """The commonest source of each language, the smallest of equals."""
    return S.most_common(table(spark, sf_dir, "documents"), ["lang"], "source")


_PLACES_SQL = "SELECT 0 AS place, s_nationkey AS nation, min(s_name) AS name FROM supplier GROUP BY s_nationkey UNION ALL SELECT 1, c_nationkey, min(c_name) FROM customer GROUP BY c_nationkey UNION ALL SELECT 2, n_nationkey, n_name FROM nation"


@query(f"SELECT nation, place, name, place > min(place) OVER (PARTITION BY nation) AS shadowed FROM ({_PLACES_SQL})")
def priority_resolution(spark, sf_dir):
    """A name for each nation from three places, and which of them an earlier place hides."""
    first = lambda t, p, k, n: table(spark, sf_dir, t).groupBy(F.col(k).alias("nation")).agg(F.min(n).alias("name")).withColumn("place", F.lit(p))
    every = first("supplier", 0, "s_nationkey", "s_name").unionByName(first("customer", 1, "c_nationkey", "c_name")).unionByName(first("nation", 2, "n_nationkey", "n_name"))
    return S.first_place(every, ["nation"], "place").select("nation", "place", "name", "shadowed")


@query("SELECT l_returnflag AS flag, l_linenumber AS line FROM lineitem WHERE l_linenumber > 2 EXCEPT ALL SELECT l_returnflag, l_linenumber FROM lineitem WHERE l_quantity > 5")
def bag_difference(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    pair = lambda df: df.select(F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("line"))
    return S.bag_difference(pair(items.filter("l_linenumber > 2")), pair(items.filter("l_quantity > 5")))


@query("""WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS o FROM events),
  f AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS o FROM events)
SELECT user_id, min(o) AS first_difference FROM (SELECT coalesce(e.user_id, f.user_id) AS user_id, coalesce(e.o, f.o) AS o, e.event_type AS a, f.event_type AS b FROM e FULL OUTER JOIN f ON e.user_id = f.user_id AND e.o = f.o)
WHERE a IS DISTINCT FROM b GROUP BY user_id""")
def sequence_diff_first(spark, sf_dir):
    """Where a user's events first differ when read backwards."""
    rows = table(spark, sf_dir, "events")
    forth = rows.withColumn("o", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    back = rows.withColumn("o", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id"))).cast("long"))
    return S.first_difference(forth, back, ["user_id"], "o", "event_type")


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS filled, count(*) FILTER (o_totalprice > 200000) AS large FROM orders GROUP BY o_orderpriority")
def conditional_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(S.conditional("open", F.col("o_orderstatus") == "O"), S.conditional("filled", F.col("o_orderstatus") == "F"), S.conditional("large", F.col("o_totalprice") > 200000))


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def benchmark_overlap(spark, sf_dir):
    """Documents that hold a benchmark passage whole.

    A passage of five words or more is looked for by its second to fourth word, which
    stand whole in any text that holds it: a hash of three words in a row meets it in
    an equality join and the texts are compared.  One of three or four words is looked for by its
    second word alone.  Passages of one or two words may stand inside of words; each is
    looked for by its pairs of characters, of which the text must hold as many kinds, before
    it is compared.
    """
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    split = lambda c: F.split(F.btrim(F.regexp_replace(c, r"\s+", " ")), " ")
    words = items.withColumn("w", split("item"))
    ws = docs.select("doc_id", split("text").alias("w"))
    of_three = F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 2).alias("x"), F.slice("w", F.lit(2), F.size("w") - 2).alias("y"), F.slice("w", F.lit(3), F.size("w") - 2).alias("z"))
    threes = ws.filter(F.size("w") >= 3).select("doc_id", F.explode(of_three).alias("t")).select("doc_id", F.xxhash64(F.concat_ws(" ", "t.x", "t.y", "t.z")).alias("anchor"))
    ones = ws.select("doc_id", F.explode(F.array_distinct("w")).alias("word")).select("doc_id", F.xxhash64("word").alias("anchor"))
    keys = words.filter(F.size("w") >= 3).select("item_id", F.when(F.size("w") >= 5, F.xxhash64(F.array_join(F.slice("w", 2, 3), " "))).otherwise(F.xxhash64(F.get("w", F.lit(1)))).alias("anchor"), (F.size("w") >= 5).alias("long"))

    def near(long: bool, found: DataFrame) -> DataFrame:
        mine = keys.filter(F.col("long") == long).select("item_id", "anchor")
        heads = mine.select("anchor").distinct()
        met = found.join(F.broadcast(heads) if heads.count() <= 100_000 else heads, "anchor", "left_semi").distinct()
        return met.join(mine, "anchor").select("doc_id", "item_id")

    pairs = near(True, threes).union(near(False, ones))
    # Short ones: an inverted list of character pairs, those of a text that some item has.
    chars = lambda df, c, id_: df.select(id_, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(2))))).alias("two"))
    short = chars(words.filter(F.size("w") < 3), F.col("item"), "item_id")
    if not short.isEmpty():
        needs = short.groupBy("item_id").agg(F.count("*").alias("kinds"))
        held = chars(docs, F.col("text"), "doc_id").join(short, "two").groupBy("doc_id", "item_id").agg(F.count("*").alias("n"))
        pairs = pairs.union(held.join(needs, "item_id").filter("n >= kinds").select("doc_id", "item_id"))
    return pairs.distinct().join(items, "item_id").join(docs, "doc_id").filter(F.contains("text", "item")).select("doc_id", "item_id")


@query("""SELECT source, doc_id, total FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM (
  SELECT source, doc_id, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS total FROM documents) WHERE total > 20000) WHERE nth = 1""")
def running_size_cap(spark, sf_dir):
    """The document of each source with which its running size first passes a cap."""
    return S.first_crossing(table(spark, sf_dir, "documents"), ["source"], ["doc_id"], "n_chars", 20_000).select("source", "doc_id", "total")


_ADDRESSED_SQL = "SELECT doc_id, text || ' see ' || CASE doc_id % 4 WHEN 0 THEN 'https://a.example and ftp://b.example' WHEN 1 THEN 'http://c.example' WHEN 2 THEN 'data://d and javascript://e' ELSE '' END AS text FROM documents"


@query(f"SELECT doc_id, scheme, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme FROM ({_ADDRESSED_SQL})) WHERE lower(scheme) NOT IN ('http', 'https', 'mailto') GROUP BY 1, 2")
def schemes_refused(spark, sf_dir):
    """Schemes that a link may not have, anywhere in the texts; the documents hold none, so addresses are put behind them."""
    kind = F.col("doc_id") % 4
    said = F.when(kind == 0, "https://a.example and ftp://b.example").when(kind == 1, "http://c.example").when(kind == 2, "data://d and javascript://e").otherwise("")
    docs = table(spark, sf_dir, "documents").withColumn("text", F.concat("text", F.lit(" see "), said))
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z][A-Za-z0-9+.-]*)://"), F.lit(1))).alias("scheme"))
    return found.filter(X.refused_scheme(F.concat("scheme", F.lit(":"))).isNotNull()).groupBy("doc_id", "scheme").agg(F.count("*").alias("times"))


# -- over literal rows -----------------------------------------------------------------

_RANKS = [(o, n, r) for o in ("pPr", "rPr", "sectPr") for n, r in V.PLACES[o].items()]


@query(f"""WITH c AS {L.values(*L.CHILDREN)}, r AS {L.values('list string, name string, rank int', _RANKS)},
k AS (SELECT c.*, rank, lag(rank) OVER w AS br, lag(c.name) OVER w AS must_follow FROM c JOIN r ON c.list = r.list AND c.name = r.name WINDOW w AS (PARTITION BY element ORDER BY ord)),
b AS (SELECT *, row_number() OVER (PARTITION BY element ORDER BY ord) AS nth FROM k WHERE rank < br)
SELECT element, list, ord, name, must_follow FROM b WHERE nth = 1""")
def order_violations(spark, sf_dir):
    return O.order_violations(L.frame(spark, *L.CHILDREN), O.rank_table(spark))


_COUNTERS_SQL = "".join(f", sum(CASE WHEN level < {k} THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos) AS g{k}" for k in range(1, 7))
_LEVELS_SQL = ", ".join(f"CAST(sum(CASE WHEN level = {k} THEN 1 ELSE 0 END) OVER (PARTITION BY doc, g{k} ORDER BY pos) AS INTEGER)" for k in range(1, 7))


@query(f"SELECT doc, pos, level, CASE WHEN level = 1 THEN ns[1]::VARCHAR || '.' ELSE array_to_string(ns[1:level], '.') END AS number FROM (SELECT doc, pos, level, [{_LEVELS_SQL}] AS ns FROM (SELECT *{_COUNTERS_SQL} FROM {L.values(*L.HEADINGS)}))")
def heading_numbers(spark, sf_dir):
    counted = O.heading_counters(L.frame(spark, *L.HEADINGS))
    return counted.select("doc", "pos", "level", O.dotted_number(F.col("counters"), F.col("level")).alias("number"))


@query(f"SELECT doc, pos, level FROM (SELECT *, lag(level) OVER (PARTITION BY doc ORDER BY pos) AS before FROM {L.values(*L.HEADINGS)}) WHERE level > before + 1")
def outline_gaps(spark, sf_dir):
    return O.outline_gaps(L.frame(spark, *L.HEADINGS)).select("doc", "pos", "level")


_REGIONS_SQL = f"""
WITH b AS (SELECT *, CASE WHEN type = 'directive' AND name IN ('front', 'chapters', 'back', 'appendices') THEN name END AS mark FROM {L.values(*L.BLOCKS)}),
m AS (SELECT *, last_value(mark IGNORE NULLS) OVER w AS here, sum((mark IS NOT NULL)::INT) OVER w AS marks, bool_or(mark IS NOT NULL) OVER (PARTITION BY doc) AS sectioned FROM b WINDOW w AS (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, coalesce(here, 'cover') AS region, lag(marks) OVER (PARTITION BY doc ORDER BY pos) AS before, sectioned AND type = 'heading' AND coalesce(level, 0) = 1 AS h1 FROM m WHERE mark IS NULL),
s AS (SELECT *, coalesce(sectioned AND before IS NOT NULL AND (marks > before OR h1), FALSE) AS new_section FROM r),
t AS (SELECT *, CAST(sum(new_section::INT) OVER w + 1 AS INTEGER) AS section, CAST(sum(h1::INT) OVER w AS INTEGER) AS h1_group, CAST(sum((h1 AND region = 'chapters')::INT) OVER w AS INTEGER) AS chapter,
  CAST(sum((h1 AND region = 'appendices')::INT) OVER w AS INTEGER) AS appendix FROM s WINDOW w AS (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING))"""


@query(_REGIONS_SQL + " SELECT doc, pos, region, section, chapter, appendix FROM t")
def region_sections(spark, sf_dir):
    return O.regions(L.frame(spark, *L.BLOCKS)).select("doc", "pos", "region", "section", "chapter", "appendix")


@query(f"""WITH m AS (SELECT *, coalesce(max((name = 'appendices')::INT) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS late FROM {L.values(*L.BLOCKS)} WHERE type = 'directive'),
p AS (SELECT *, CASE WHEN name = 'back' AND late = 1 THEN 4 ELSE list_position(['front', 'chapters', 'back', 'appendices'], name) - 1 END AS place FROM m),
f AS (SELECT *, lag(place) OVER (PARTITION BY doc ORDER BY pos) AS before, row_number() OVER (PARTITION BY doc, place ORDER BY pos) AS nth FROM p)
SELECT doc, pos, name, CASE WHEN nth > 1 THEN 'twice' ELSE 'order' END AS fault FROM f WHERE nth > 1 OR place < before""")
def region_faults(spark, sf_dir):
    return O.region_faults(L.frame(spark, *L.BLOCKS))


@query(_REGIONS_SQL + """, k AS (SELECT *, CASE WHEN type = 'paragraph' AND regexp_matches(text, '^Table:(?:[ \\t]|$)') AND lead(type) OVER w = 'table' THEN 'table'
  WHEN type = 'paragraph' AND regexp_matches(text, '^Figure:(?:[ \\t]|$)') AND lag(image_only) OVER w THEN 'figure' END AS kind FROM t WINDOW w AS (PARTITION BY doc ORDER BY pos)),
n AS (SELECT *, row_number() OVER (PARTITION BY doc, h1_group, kind ORDER BY pos) AS seq FROM k)
SELECT doc, pos, kind, concat_ws('-', CASE WHEN region = 'chapters' AND chapter > 0 THEN chapter::VARCHAR WHEN region = 'appendices' AND appendix > 0 THEN substr('กขคงจ', appendix, 1) END, seq::VARCHAR) AS caption_number FROM n WHERE kind IS NOT NULL""")
def caption_numbers(spark, sf_dir):
    return O.captions(O.regions(L.frame(spark, *L.BLOCKS))).filter("kind is not null").select("doc", "pos", "kind", "caption_number")


_SCRIPT_CLASS = V.char_class(V.COMPLEX_SCRIPT)
_PUNCT_SQL = V.PUNCTUATION.replace("'", "''")


@query(f"""WITH c AS (SELECT id, unnest(range(1, length(t) + 1)) AS i, t FROM {L.values(*L.MIXED)}),
m AS (SELECT id, i, substr(t, i, 1) AS ch, CASE WHEN regexp_matches(substr(t, i, 1), '{_SCRIPT_CLASS}') THEN 'C' WHEN substr(t, i, 1) = ' ' THEN 'N' WHEN contains('{_PUNCT_SQL}', substr(t, i, 1)) THEN 'P' ELSE 'L' END AS mark FROM c),
l AS (SELECT *, last_value(CASE WHEN mark IN ('C', 'L') THEN mark END IGNORE NULLS) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
  first_value(CASE WHEN mark IN ('C', 'L') THEN mark END IGNORE NULLS) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM m),
s AS (SELECT *, CASE mark WHEN 'P' THEN CASE WHEN coalesce(a, b) = 'C' AND coalesce(b, a) = 'C' THEN 'C' ELSE 'L' END WHEN 'N' THEN NULL ELSE mark END AS strong FROM l),
f AS (SELECT *, coalesce(last_value(strong IGNORE NULLS) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING), first_value(strong IGNORE NULLS) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 'L') AS script FROM s),
g AS (SELECT *, CASE WHEN script IS DISTINCT FROM lag(script) OVER (PARTITION BY id ORDER BY i) THEN 1 ELSE 0 END AS starts FROM f),
r AS (SELECT *, sum(starts) OVER (PARTITION BY id ORDER BY i) AS run FROM g)
SELECT id, CAST(run AS BIGINT) AS run, script = 'C' AS is_complex, string_agg(ch, '' ORDER BY i) AS piece FROM r GROUP BY id, run, script""")
def script_runs(spark, sf_dir):
    return O.script_runs(L.frame(spark, *L.MIXED))


@query(f"""SELECT id, list_reduce(string_split(t, chr(10)), lambda told, line: told || CASE WHEN regexp_matches(told, '[\\x{{E00}}-\\x{{E7F}}][.]?$') AND regexp_matches(line, '^[\\x{{E00}}-\\x{{E7F}}]') THEN '' ELSE ' ' END || line) AS joined
FROM {L.values(*L.BREAKS)}""")
def soft_break_join(spark, sf_dir):
    return L.frame(spark, *L.BREAKS).select("id", X.soft_break_join("t").alias("joined"))


@query("SELECT n, translate(n::VARCHAR, '0123456789', '๐๑๒๓๔๕๖๗๘๙') AS digits FROM " + L.values(*L.NUMBERS))
def thai_digits(spark, sf_dir):
    return L.frame(spark, *L.NUMBERS).select("n", X.number_text("n", "decimal", True).alias("digits"))


@query(f"""WITH RECURSIVE signs AS (SELECT * FROM (VALUES {', '.join(map(str, V.ROMAN))}) AS v(worth, sign)),
steps AS (SELECT n, n AS rest, '' AS roman FROM {L.values(*L.NUMBERS)}
  UNION ALL SELECT s.n, s.rest - w.worth, s.roman || w.sign FROM steps s JOIN signs w ON w.worth = (SELECT max(worth) FROM signs WHERE worth <= s.rest))
SELECT n, repeat(substr('{V.THAI_LETTERS}', (n - 1) % {len(V.THAI_LETTERS)} + 1, 1), (n - 1) // {len(V.THAI_LETTERS)} + 1) AS thai, repeat(chr(65 + (n - 1) % 26), (n - 1) // 26 + 1) AS upper_letters, roman
FROM steps WHERE rest = 0""")
def number_formats(spark, sf_dir):
    return L.frame(spark, *L.NUMBERS).select("n", X.number_text("n", "thai-letters").alias("thai"), X.number_text("n", "upper-letters").alias("upper_letters"), X.number_text("n", "upper-roman").alias("roman"))


_ALIAS_SQL = " ".join(f"WHEN '{a}' THEN '{d}'" for a, d in V.DIRECTIVE_ALIASES.items())
_NEAR_SQL = ", ".join(f"CASE WHEN levenshtein(word, '{d}') <= {2 if len(d) >= 6 else 1} THEN '{d}' END" for d in V.DIRECTIVES)


@query(f"""SELECT id, CASE WHEN inside <> '' THEN coalesce(CASE word {_ALIAS_SQL} END, {_NEAR_SQL}) END AS meant FROM (
  SELECT id, regexp_extract(t, '^<!--[ \\t]*([A-Za-z][A-Za-z _-]{{0,30}}?)[ \\t]*-->$', 1) AS inside, regexp_replace(lower(regexp_extract(t, '^<!--[ \\t]*([A-Za-z][A-Za-z _-]{{0,30}}?)[ \\t]*-->$', 1)), '[ _]+', '-', 'g') AS word FROM {L.values(*L.COMMENTS)})""")
def directive_suggestion(spark, sf_dir):
    return L.frame(spark, *L.COMMENTS).select("id", X.meant_directive("t").alias("meant"))


@query("SELECT id, nfc_normalize(t) AS composed FROM " + L.values(*L.DECOMPOSED))
def nfc_thai(spark, sf_dir):
    return L.frame(spark, *L.DECOMPOSED).select("id", X.nfc_thai("t").alias("composed"))


@query(f"""SELECT id, ltrim(list_reduce(list_concat([CASE WHEN starts_with(target, '/') OR NOT contains(source, '/') THEN '' ELSE '/' || regexp_replace(source, '/[^/]*$', '') END], string_split(target, '/')),
  lambda path, step: CASE WHEN step = '..' THEN regexp_replace(path, '/[^/]*$', '') WHEN step IN ('', '.') THEN path ELSE path || '/' || step END), '/') AS part FROM {L.values(*L.PATHS)}""")
def part_path_resolve(spark, sf_dir):
    return L.frame(spark, *L.PATHS).select("id", X.resolve_path("source", "target").alias("part"))


@query(f"SELECT part, CAST(max(level) AS BIGINT) AS depth FROM (SELECT part, sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY part ORDER BY pos) + CASE kind WHEN 'empty' THEN 1 ELSE 0 END AS level FROM {L.values(*L.TAGS)}) GROUP BY part")
def nesting_depth(spark, sf_dir):
    return O.nesting_depth(L.frame(spark, *L.TAGS), ["part"])


@query(f"SELECT s.doc, s.need, string_agg(flag, ' and ' ORDER BY ord) AS flags FROM {L.values(*L.SETTINGS)} s WHERE need IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {L.values(*L.PRESENCE)} p WHERE p.doc = s.doc AND p.need = s.need) GROUP BY s.doc, s.need")
def settings_changed_nothing(spark, sf_dir):
    return S.changed_nothing(L.frame(spark, *L.SETTINGS), L.frame(spark, *L.PRESENCE)).select("doc", "need", "flags")


_one = lambda *groups: "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for g in groups for a, b in g) + "]"
_none = lambda *groups: "[^" + _one(*groups)[1:]
_AM, _SILENT = ((0x0E33, 0x0E33),), ((0x0E4C, 0x0E4C),)
_count = lambda *groups: f"length(regexp_replace(run, '{_none(*groups)}', '', 'g'))"


@query(f"""WITH lines AS {L.values(*L.LINES)},
chars AS (SELECT id, i, substr(t, i, 1) AS ch, CASE WHEN i > 1 THEN substr(t, i - 1, 1) ELSE '' END AS before FROM (SELECT id, t, unnest(range(1, length(t) + 1)) AS i FROM lines)),
lone AS (SELECT id, 'a Thai mark (U+' || printf('%04X', unicode(arg_min(ch, i))) || ') with no letter before it' AS said FROM chars
  WHERE regexp_matches(ch, '{_one(V.MARKS)}') AND NOT regexp_matches(before, '{_one(V.CONSONANTS, V.MARKS)}') GROUP BY id),
runs AS (SELECT id, unnest(regexp_extract_all(t, '{_one(V.MARKS, _AM)}+')) AS run FROM lines),
judged AS (SELECT id, bool_or({_count(V.TONES)} >= 2) AS two, bool_or({_count(V.ABOVE)} >= 2 OR {_count(V.BELOW)} >= 2 OR ({_count(V.TONES)} >= 1 AND {_count(_SILENT)} >= 1) OR {_count(_AM)} >= 2) AS stacked FROM runs GROUP BY id)
SELECT id, said || '; it is written as it stands' AS said FROM (SELECT * FROM lone UNION ALL SELECT id, 'a letter with two tone marks' FROM judged WHERE two
  UNION ALL SELECT id, 'a letter with two marks that stand in one place' FROM judged WHERE stacked AND NOT two)""")
def thai_marks(spark, sf_dir):
    """What is wrong with the marks of a line."""
    return L.frame(spark, *L.LINES).select("id", F.explode(X.marks_out_of_place("t")).alias("said"))


@query("SELECT id, contains(t, chr(3661) || chr(3634)) AS long_form FROM " + L.values(*L.LINES))
def long_sara_am(spark, sf_dir):
    return L.frame(spark, *L.LINES).select("id", X.long_sara_am("t").alias("long_form"))


@query(r"SELECT id, CASE WHEN length(s) > 64 THEN left(s, 63) || '…' ELSE s END AS shown FROM (SELECT id, regexp_replace(t, '[^A-Za-z0-9 \-_./()\[\]+&,\x{E00}-\x{E7F}]', '?', 'g') AS s FROM " + L.values(*L.NAMES) + ")")
def quoted_names(spark, sf_dir):
    return L.frame(spark, *L.NAMES).select("id", X.quoted("t").alias("shown"))


@query("SELECT id, CASE WHEN s <> '' AND lower(s) NOT IN ('http', 'https', 'mailto') THEN s END AS refused FROM (SELECT id, regexp_extract(t, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) AS s FROM " + L.values(*L.LINKS) + ")")
def link_schemes(spark, sf_dir):
    return L.frame(spark, *L.LINKS).select("id", X.refused_scheme("t").alias("refused"))


@query("SELECT x, CAST(floor(x + 0.5) AS INTEGER) AS rounded FROM " + L.values(*L.HALVES))
def half_up(spark, sf_dir):
    return L.frame(spark, *L.HALVES).select("x", X.half_up("x").alias("rounded"))


@query(f"""WITH plain AS (SELECT id, replace(translate(trim(regexp_replace(t, '[ \t\n\r]+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '_', '-') AS s FROM {L.values(*L.MESSAGES)}),
words AS (SELECT id, s, list_transform(string_split(replace(replace(s, 'thai-docx grill', ''), 'thai docx grill', ''), ' '), lambda w: CASE WHEN length(translate(w, 'กขคงจฉชซญดตถทธนบปผพฟภมยรลวศษสหอฮ', '')) < length(w) THEN 't' WHEN w <> upper(w) THEN 'l' ELSE '' END) AS kinds FROM plain)
SELECT id, CASE WHEN contains(s, 'thai-docx grill') OR contains(s, 'thai docx grill') THEN 'grill' ELSE 'build' END AS mode,
  CASE WHEN list_contains(kinds, 't') AND len(list_filter(kinds, lambda k: k = 't')) >= len(list_filter(kinds, lambda k: k = 'l')) THEN 'th' ELSE 'en' END AS language FROM words""")
def message_modes(spark, sf_dir):
    return L.frame(spark, *L.MESSAGES).select("id", X.message_mode("t").alias("mode"), X.message_language("t").alias("language"))


@query("""SELECT id, replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS as_text,
  '"' || replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(9), '&#9;') || '"' AS as_attribute FROM """ + L.values(*L.MARKUP))
def xml_escapes(spark, sf_dir):
    return L.frame(spark, *L.MARKUP).select("id", X.xml_text("t").alias("as_text"), X.xml_attribute("t").alias("as_attribute"))


_NAMED_SQL = " ".join(f"WHEN {ord(c)} THEN '{label}'" for c, label in V.INVISIBLE.items())
_FIRST_SQL = ", ".join(f"max(CASE WHEN code = {ord(c)} AND seen THEN label END)" for c in V.INVISIBLE)
_other_letter = lambda c: f"(regexp_matches({c}, '{_one(V.COMPLEX_SCRIPT)}') AND NOT regexp_matches({c}, '{_one(V.THAI)}'))"


@query(f"""WITH chars AS (SELECT id, i, substr(t, i, 1) AS ch, CASE WHEN i > 1 THEN substr(t, i - 1, 1) ELSE '' END AS before, substr(t, i + 1, 1) AS after FROM (SELECT id, t, unnest(range(1, length(t) + 1)) AS i FROM {L.values(*L.HIDDEN)})),
found AS (SELECT id, i, unicode(ch) AS code, ch, regexp_matches(ch, '{_one(V.FORMAT, V.NONCHARACTERS)}') AS seen FROM chars
  WHERE regexp_matches(ch, '{_one(V.CONTROLS, V.FORMAT, V.NONCHARACTERS)}') AND NOT (unicode(ch) IN (8204, 8205) AND {_other_letter('before')} AND {_other_letter('after')})),
said AS (SELECT *, CASE code {_NAMED_SQL} ELSE 'U+' || printf('%04X', code) || ', ' || CASE WHEN regexp_matches(ch, '{_one(V.CONTROLS)}') THEN 'a control character' WHEN regexp_matches(ch, '{_one(V.FORMAT)}') THEN 'a format character' ELSE 'a noncharacter' END END AS label FROM found)
SELECT id, coalesce({_FIRST_SQL}, arg_min(label, i) FILTER (seen), arg_min(label, i)) AS label, arg_min(label, i) AS first_label FROM said GROUP BY id""")
def hidden_characters(spark, sf_dir):
    """The hidden character reported in text, and the first one that input refuses."""
    rows = L.frame(spark, *L.HIDDEN).select("id", X.unseen_in("t").alias("seen"), X.forbidden_label("t").alias("first_label"))
    return rows.select("id", F.coalesce("seen", "first_label").alias("label"), "first_label").filter("label is not null")


_CLAUSE_SQL = ", ".join(f"nullif(regexp_extract(run, '(?i) (?:{en} |{th} ?)([^ ]+)', 1), '') AS {'from_' if name == 'from' else name}" for name, (en, th) in X.CLAUSES.items())


@query(f"""SELECT id, {_CLAUSE_SQL}, nullif(regexp_extract(rest, '{X.LATER_CLAUSE}', 1), '') AS unread FROM (
  SELECT id, regexp_extract(s, '{X.CLAUSE_RUN}', 1) AS run, regexp_extract(s, '{X.CLAUSE_RUN}(.*)', 2) AS rest FROM (SELECT id, trim(regexp_replace(t, '[ \t\n]+', ' ', 'g')) AS s FROM {L.values(*L.CLAUSES)}))""")
def message_clauses(spark, sf_dir):
    """What a message says after the phrase, and what it says too late."""
    said = L.frame(spark, *L.CLAUSES).select("id", X.message_clauses("t").alias("c"))
    return said.select("id", F.col("c")["from"].alias("from_"), "c.save_to", "c.only", "c.unread")


# -- over rows made by rule -------------------------------------------------------------

_COMMITS = {0: ("feat(parser): read lists", "Signed-off-by: A B <a@x.example>"), 1: ("fixed things", "Signed-off-by: A B <a@x.example>"), 2: ("fix: " + "y" * 80, "body\nSigned-off-by: A B <A@x.example>"), 3: ("docs!: say more", "no line"), 4: ("ci: run", "Signed-off-by: A B <a@x.example>\nSigned-off-by: C D <c@x.example>\nCO-AUTHORED-BY: someone"), 5: ("perf: less", "Signed-off-by:    <a@x.example>")}
_FAULTY = [(1, "title shape"), (2, "long title"), (2, "title shape"), (3, "no sign-off"), (4, "credit"), (5, "no sign-off")]
_UNSIGNED = [(3, "author unsigned", "a@x.example"), (4, "stranger signed", "c@x.example"), (5, "author unsigned", "a@x.example")]
_rule_rows = lambda rows: "(VALUES " + ", ".join("(" + ", ".join(map(repr, r)) + ")" for r in rows) + ")"


def _commits(spark, sf_dir):
    told = F.element_at(F.create_map(*(x for k, (t, b) in _COMMITS.items() for x in (F.lit(k), F.struct(F.lit(t).alias("title"), F.lit(b).alias("body"))))), (F.col("o_orderkey") % 6).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha"), told.alias("c"), F.lit("a@x.example").alias("author"), F.lit("a@x.example").alias("committer")).select("sha", "c.*", "author", "committer")


@query(f"SELECT o_orderkey AS sha, fault FROM orders JOIN {_rule_rows(_FAULTY)} AS f(kind, fault) ON kind = o_orderkey % 6")
def commit_faults(spark, sf_dir):
    """What is wrong with the titles and trailers of commits made by rule."""
    return G.commit_faults(_commits(spark, sf_dir))


@query(f"SELECT o_orderkey AS sha, fault, address FROM orders JOIN {_rule_rows(_UNSIGNED)} AS f(kind, fault, address) ON kind = o_orderkey % 6")
def author_faults(spark, sf_dir):
    return G.author_faults(_commits(spark, sf_dir))


@query("SELECT l_returnflag AS flag, min(k) AS low, max(k) AS high FROM (SELECT l_returnflag, k, k - dense_rank() OVER (PARTITION BY l_returnflag ORDER BY k) AS island FROM (SELECT DISTINCT l_returnflag, l_orderkey AS k FROM lineitem)) GROUP BY l_returnflag, island")
def key_ranges(spark, sf_dir):
    """The order keys under each return flag as ranges without gaps."""
    return G.ranges(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_orderkey").alias("cp")), ["flag"])


_NUMBERED_SQL = "WITH r AS (SELECT c_custkey AS number, 'a' AS name FROM customer WHERE c_custkey % 50 <> 7 UNION ALL SELECT c_custkey, 'b' FROM customer WHERE c_custkey % 40 = 3), i AS (SELECT c_custkey AS number FROM customer WHERE c_custkey % 30 <> 4)"


@query(_NUMBERED_SQL + """, d AS (SELECT DISTINCT number FROM r), g AS (SELECT number, lag(number) OVER (ORDER BY number) AS before FROM d)
SELECT 'twice' AS fault, number FROM r GROUP BY number HAVING count(DISTINCT name) > 1 UNION ALL SELECT 'not listed', number FROM d WHERE number NOT IN (SELECT number FROM i)
UNION ALL SELECT DISTINCT 'gone', number FROM i WHERE number NOT IN (SELECT number FROM d) UNION ALL SELECT 'gap before', number FROM g WHERE number > before + 1""")
def index_faults(spark, sf_dir):
    """Numbers used twice, left out or listed in vain, and gaps, among records made by rule."""
    n = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer")
    records = rows.filter(n % 50 != 7).select(n.alias("number"), F.lit("a").alias("name")).unionByName(rows.filter(n % 40 == 3).select(n.alias("number"), F.lit("b").alias("name")))
    return G.index_faults(records, rows.filter(n % 30 != 4).select(n.alias("number")))


@query("SELECT c_custkey + 1 AS new, c_custkey AS old, CASE WHEN c_custkey % 10 = 0 THEN 'superseded by' ELSE 'supersedes' END AS missing FROM customer WHERE (c_custkey % 10 = 0) <> (c_custkey % 15 = 0)")
def one_way_edges(spark, sf_dir):
    """Successions that only one side tells."""
    n = F.col("c_custkey")
    edge = lambda c: table(spark, sf_dir, "customer").filter(c).select((n + 1).alias("new"), n.alias("old"))
    return G.one_way_edges(edge(n % 10 == 0), edge(n % 15 == 0))


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_nationkey > 2) a FULL OUTER JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_nationkey < 20) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def unmatched_names(spark, sf_dir):
    """Nations that only customers or only suppliers name."""
    left = table(spark, sf_dir, "customer").filter("c_nationkey > 2").select(F.col("c_nationkey").alias("k"))
    return G.unmatched(left, table(spark, sf_dir, "supplier").filter("s_nationkey < 20").select(F.col("s_nationkey").alias("k")), "k")


@query("SELECT user_id AS name, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS versions FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1")
def disagreeing_versions(spark, sf_dir):
    """Users whose events don't all agree on their type."""
    said = table(spark, sf_dir, "events").select(F.col("user_id").alias("name"), F.col("event_id").alias("source"), F.col("event_type").alias("version"))
    return G.disagreeing_versions(said).select("name", F.array_join("versions", ",").alias("versions"))


@query("SELECT DISTINCT r_name AS variant, n_name AS application FROM nation JOIN region ON r_regionkey = n_regionkey OR r_regionkey + 1 = n_regionkey")
def release_matrix(spark, sf_dir):
    """Regions with the nations of their own and of the next region."""
    variants = table(spark, sf_dir, "region").select(F.col("r_name").alias("variant"), F.array(F.col("r_regionkey"), F.col("r_regionkey") + 1).alias("kinds"))
    return G.release_matrix(variants, table(spark, sf_dir, "nation").select(F.col("n_name").alias("application"), F.col("n_regionkey").alias("kind")))


_SOURCES = {0: ("pic.png", "docs/a/pic.png", None), 1: ("../shared/p.png", "docs/shared/p.png", None), 2: ("//host/p.png", None, "a network path"), 3: ("https://h/p.png", None, "a network path"), 4: ("../../etc/p.png", "etc/p.png", "outside of the folders that may be read"), 5: ("gone.png", "docs/a/gone.png", "not found"), 6: ("big.png", "docs/a/big.png", "too large"), 7: ("wide.png", "docs/a/wide.png", "too much in all")}


@query("SELECT c_custkey AS doc, kind AS ord, src, path, fault FROM customer, (VALUES " + ", ".join(f"({k}, {_sql_text(s)}, {_sql_text(p)}, {_sql_text(f)})" for k, (s, p, f) in _SOURCES.items()) + ") AS v(kind, src, path, fault) WHERE kind <> c_custkey % 9")
def pictures_resolved(spark, sf_dir):
    """Pictures that documents made by rule name, each with its path or why it isn't read."""
    sources = L.frame(spark, "ord int, src string", [(k, s) for k, (s, _, _) in _SOURCES.items()])
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.lit("docs/a").alias("base"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("ord")).filter(F.col("ord") != F.col("doc") % 9).join(F.broadcast(sources), "ord")
    held = L.frame(spark, "path string, length long", [("docs/a/pic.png", 10), ("docs/shared/p.png", 20), ("etc/p.png", 1), ("docs/a/big.png", P.MAX_PICTURE + 1), ("docs/a/wide.png", P.MAX_PICTURE), ("docs/a/wider.png", P.MAX_PICTURE)])
    more = wanted.select("doc", "base", F.lit(-1).alias("ord"), F.lit("wider.png").alias("src")).distinct()
    return P.resolve_pictures(wanted.select("doc", "base", "ord", "src").unionByName(more), held, L.frame(spark, "root string", [("docs/shared",)])).filter("ord >= 0")


_PROFILES_SQL = "SELECT p_size % 3 AS place, replace(lower(p_name), ' ', '-') AS name FROM part"


@query(f"""WITH v AS (SELECT DISTINCT place, name FROM ({_PROFILES_SQL}) WHERE regexp_matches(name, '^[\\p{{L}}\\p{{M}}\\p{{N}}_][\\p{{L}}\\p{{M}}\\p{{N}}_-]{{0,63}}$')),
r AS (SELECT *, place > min(place) OVER (PARTITION BY name) AS shadowed, row_number() OVER (PARTITION BY place ORDER BY name) AS nth FROM v) SELECT place, name, shadowed, CAST(nth AS INTEGER) AS nth FROM r WHERE nth <= 100""")
def profile_listing(spark, sf_dir):
    """Profiles along a search path of three places: the first hundred of each, and which of them an earlier place hides."""
    return P.profile_listing(table(spark, sf_dir, "part").select((F.col("p_size") % 3).alias("place"), F.replace(F.lower("p_name"), F.lit(" "), F.lit("-")).alias("name")))


@query("SELECT doc_id, contains(text, chr(65533)) OR doc_id % 7 = 0 AS refused FROM documents")
def arguments_refused(spark, sf_dir):
    """Texts that couldn't be decoded whole; every seventh is made one."""
    broken = F.when(F.col("doc_id") % 7 == 0, F.make_valid_utf8(F.concat("text", F.lit(b"\xff").cast("string")))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", X.not_text(broken).alias("refused"))


# -- rows only: parsing and building ------------------------------------------------------


@query()
def md_blocks(spark, sf_dir):
    """The Markdown blocks of every document, by type, and the refusals."""
    blocks = markdown_blocks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return blocks.groupBy("doc", F.coalesce("type", F.lit("refusal")).alias("type")).agg(F.count("*").alias("blocks"))


@query()
def md_inlines(spark, sf_dir):
    """The inline nodes of every document, by kind and formatting."""
    nodes = markdown_inlines(markdown_blocks(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return nodes.groupBy("t", "b", "i", "code", F.col("link").isNotNull().alias("linked")).agg(F.count("*").alias("nodes"), F.sum(F.length("s")).alias("chars"))


@query()
def docx_build(spark, sf_dir):
    """Every document built into a package, and whether its text reads back the same."""
    return build_packages(table(spark, sf_dir, "documents"), "doc_id", "text").drop("content")


#: Faults planted in built packages by number: part, what is replaced by what, the code and message that must follow, and the repair or why there is none.
_STYLE, _SETTINGS, _DOCUMENT = "word/styles.xml", "word/settings.xml", "word/document.xml"
_LEFT = "nothing here is a repair this version makes; the findings say what is wrong"
_SLANTED = "<w:r><w:rPr><w:i/><w:iCs/></w:rPr><w:t>ab</w:t></w:r>"
_STRICT = "Strict Open XML (ISO/IEC 29500 Strict) is not read: every element would be missed; save it from Word as Word Document (.docx)"
_MODE = f'<w:compatSetting w:name="compatibilityMode" w:uri="{V.COMPAT_URI}" w:val="15"/>'
PLANTED = [
    (None, "", "", None, None, "", None),
    (_SETTINGS, 'w:val="15"', 'w:val="14"', "1", "compatibilityMode declared as 14; must be exactly one 15", "1:1", None),
    (_STYLE, "<w:b/><w:bCs/>", "<w:b/><w:bCs/><w:noProof/>", "3", "<w:noProof/> switches Thai proofing — and Thai line breaking — off", "3:1", None),
    (_STYLE, "<w:b/><w:bCs/>", "<w:b/>", "5", "in a style, <w:b> has no <w:bCs> beside it", "5:1", None),
    (_STYLE, '<w:name w:val="heading 1"/><w:basedOn w:val="Normal"/>', '<w:basedOn w:val="Normal"/><w:name w:val="heading 1"/>', "order", "in w:style, <w:name> must come before <w:basedOn>", "order:1", None),
    (_SETTINGS, "<w:settings", "<!DOCTYPE x><w:settings", "doctype", "XML part declares a DOCTYPE; refused", None, "XML part declares a DOCTYPE; refused"),
    (_STYLE, "</w:styles>", "", "package", "XML is not well-formed", None, "XML is not well-formed"),
    (_DOCUMENT, "<w:body>", '<w:body><w:p><w:hyperlink r:id="gone"/></w:p>', "package", "refers to relationship gone, which its own relationships do not hold", None, "refers to relationship gone, which its own relationships do not hold"),
    (_DOCUMENT, "<w:body>", "<w:body><w:p><w:r><w:t>ไทย</w:t></w:r></w:p>", "2", "a run whose text is complex script has no <w:cs/> element", "2:1", None),
    (_DOCUMENT, "<w:body>", f"<w:body><w:p>{_SLANTED * 2}</w:p>", "4", "two adjacent runs carry identical formatting; a word may be split across them", None, _LEFT),
    (_DOCUMENT, "<w:body>", "<w:body><w:p><w:r><w:t>a\u200bb</w:t></w:r></w:p>", "invisible", "text contains U+200B ZERO WIDTH SPACE", None, _LEFT),
    (_STYLE, ' w:cs="', ' w:other="', "5", "in a style, w:rFonts names a Latin font but no w:cs font", "5:1", None),
    (_DOCUMENT, V.W, V.STRICT_W, "package", _STRICT, None, _STRICT),
    (_STYLE, 'encoding="UTF-8"', 'encoding="ISO-8859-1"', "package", "XML part is not UTF-8", None, "XML part is not UTF-8"),
    (_DOCUMENT, "<w:sectPr>", "<w:sectPr><w:pgMar/>", "order", "in w:sectPr, <w:pgSz> must come before <w:pgMar>", "order:1", None),
    (_SETTINGS, "</w:compat>", f"{_MODE}</w:compat>", "1", "compatibilityMode declared as 15, 15; must be exactly one 15", "1:1", None),
]
_KIND = "(conv_id + turn) % 16"
_PLANTED_SQL = "(VALUES " + ", ".join(f"({i}, {_sql_text(code)}, {_sql_text(message)}, {_sql_text(mended)}, {_sql_text(error)})" for i, (_, _, _, code, message, mended, error) in enumerate(PLANTED)) + ") AS p(kind, code, message, mended, error)"


@F.pandas_udf(T.BinaryType())
def _planted(contents: pd.Series, kinds: pd.Series) -> pd.Series:
    """Packages with the fault of a number."""

    def one(data, kind):
        part, old, new = PLANTED[kind][:3]
        content = next((d for e, d in admit(data)[0] if e.name == part), None)
        return data if content is None else rewrite_package(data, {part: content.replace(old.encode(), new.encode(), 1)})

    return pd.Series([one(d, k) for d, k in zip(contents, kinds, strict=True)])


def _planted_packages(spark, sf_dir):
    """A package of every conversation's turn, with a fault by its numbers."""
    turns = table(spark, sf_dir, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    kinds = turns.select(F.col("id").alias("doc"), F.expr(_KIND).cast("int").alias("kind"))
    built = build_packages(turns, "id", "text").filter("content is not null").join(kinds, "doc")
    return built.select("doc", _planted("content", "kind").alias("content"))


@query(f"SELECT p.code, p.message, count(*) AS documents FROM conversations JOIN {_PLANTED_SQL} ON p.kind = {_KIND} WHERE p.code IS NOT NULL GROUP BY 1, 2")
def docx_check(spark, sf_dir):
    """The findings of the packages built from every conversation's turns, each with a fault planted by its numbers or none."""
    return check_packages(_planted_packages(spark, sf_dir), keep=False).findings.groupBy("code", "message").agg(F.countDistinct("doc").alias("documents"))


@query(f"""SELECT conv_id || '-' || turn AS doc, p.mended IS NOT NULL AS ok, CASE WHEN p.mended IS NULL THEN 2 ELSE 0 END AS exit_code, CASE WHEN p.mended <> '' THEN p.mended END AS repaired, p.error
FROM conversations JOIN {_PLANTED_SQL} ON p.kind = {_KIND}""")
def docx_repair(spark, sf_dir):
    """The same packages repaired: what was mended, and what can't be."""
    outcomes = repair_packages(_planted_packages(spark, sf_dir)).outcomes
    counts = F.transform(F.map_entries("repaired"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return outcomes.select("doc", "ok", "exit_code", F.array_join(F.array_sort(counts), ",").alias("repaired"), "error")


_KNOWN_SQL = """WITH d AS (SELECT c_custkey AS id, c_custkey % 6 + 1 AS level, c_custkey % 3 AS quotes, c_custkey % 4 + 1 AS items, c_custkey % 5 AS fences, c_custkey % 2 AS tables FROM customer)
SELECT id::VARCHAR AS doc, type, n AS blocks FROM (SELECT id, unnest(['heading', 'quote', 'paragraph', 'list', 'item', 'code', 'table', 'break']) AS type,
  unnest([1, quotes, 1 + quotes + items, 1, items, fences, tables, 1]) AS n FROM d) WHERE n > 0"""


def _known_markdown(spark, sf_dir):
    """Documents whose blocks are known by the customer's number."""
    id_ = F.col("c_custkey")
    times = lambda text, n: F.repeat(F.lit(text), n.cast("int"))
    parts = [
        F.repeat(F.lit("#"), (id_ % 6 + 1).cast("int")), F.lit(" Heading *"), F.col("c_name"), F.lit("*\n\nA paragraph\nof two lines.\n\n"), times("> quoted text\n\n", id_ % 3),
        F.lit("***\n\n"), times("```\n# no heading\n- no item\n```\n\n", id_ % 5), times("| a | b |\n|---|--:|\n| 1 | `x` |\n\n", id_ % 2), times("- item\n", id_ % 4 + 1),
    ]
    return dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_name")).select(id_.cast("string").alias("id"), F.concat(*parts).alias("text"))


@query(_KNOWN_SQL)
def md_blocks_known(spark, sf_dir):
    """The blocks of documents whose structure is known, by type."""
    blocks = markdown_blocks(_known_markdown(spark, sf_dir), "id", "text")
    return blocks.groupBy("doc", F.coalesce("type", F.lit("refusal")).alias("type")).agg(F.count("*").alias("blocks"))


@query("""SELECT c_custkey::VARCHAR AS doc, c_custkey % 2 = 1 AS in_table, count(*) AS nodes, 8 * (c_custkey % 2) AS table_cells FROM customer GROUP BY c_custkey""".replace("count(*) AS nodes", "any_value(c_name) AS marked").replace("8 *", "4 *"))
def md_inlines_known(spark, sf_dir):
    """The emphasised text of each of those documents, and how many table cells hold text."""
    nodes = markdown_inlines(markdown_blocks(_known_markdown(spark, sf_dir), "id", "text"))
    return nodes.groupBy("doc").agg(F.max(F.col("row").isNotNull()).alias("in_table"), F.max(F.when(F.col("i"), F.col("s"))).alias("marked"), F.count_if(F.col("row").isNotNull()).alias("table_cells"))


def _known_packages(spark, sf_dir):
    return build_packages(_known_markdown(spark, sf_dir), "id", "text", read_back=False).select("doc", "content")


_PARTS_SQL = "(VALUES ('[Content_Types].xml', NULL, 0), ('_rels/.rels', NULL, 1), ('word/_rels/document.xml.rels', NULL, 2), ('word/document.xml', 'document', 3), ('word/document.xml', 'text', 3), ('word/styles.xml', 'styles', 4), ('word/settings.xml', 'settings', 5)) AS p(name, role, ord)"


@query(f"SELECT name, CAST(ord AS INTEGER) AS ord, count(DISTINCT c_custkey) AS packages FROM customer, {_PARTS_SQL} GROUP BY 1, 2")
def package_entries(spark, sf_dir):
    """The entries of the packages built from those documents, with their places, read back from the containers."""
    return package_parts(_known_packages(spark, sf_dir), data=False).groupBy("name", "ord").agg(F.count("*").alias("packages"))


@query(f"SELECT role, name, count(*) AS packages FROM customer, {_PARTS_SQL} WHERE role IS NOT NULL GROUP BY 1, 2")
def package_roles(spark, sf_dir):
    """Which part plays which role, by the packages' relationships."""
    return part_roles(_known_packages(spark, sf_dir)).groupBy("role", "name").agg(F.count("*").alias("packages"))


@query("""SELECT c_custkey::VARCHAR AS doc, 3 + c_custkey % 3 + 2 * (c_custkey % 5) + 5 * (c_custkey % 2) + c_custkey % 4 + 1 AS paragraphs, c_custkey % 2 AS tables, 0 AS exit_code FROM customer""")
def package_counts(spark, sf_dir):
    """Paragraphs and tables of each of those packages, and that nothing is wrong with it."""
    return package_summaries(_known_packages(spark, sf_dir)).select("doc", "paragraphs", "tables", "exit_code")


@query("SELECT CAST(c_custkey % 6 + 1 AS INTEGER) AS depth, count(*) AS headings FROM customer GROUP BY 1")
def package_headings(spark, sf_dir):
    """Heading levels by the styles in the node tables of those packages."""
    nodes = xml_nodes(package_parts(_known_packages(spark, sf_dir), named=("word/document.xml",)), only=("pStyle",))
    style = F.regexp_extract(F.element_at("attrs", f"{{{V.W}}}val"), "^Heading([1-6])$", 1)
    return nodes.filter((F.col("local") == "pStyle") & (style != "")).groupBy(style.cast("int").alias("depth")).agg(F.count("*").alias("headings"))


_WARNED = {
    0: ("![](a.png)\n\nText.", 1, "the image 'a.png' has no text between the brackets of ![]; a reader who cannot see it is told nothing"),
    1: ("# One\n\n### Three", 3, "a heading of level 3 follows one of level 1; the contents and a screen reader read the levels in order"),
    2: ("Table: alone\n\nText.", 1, "'Table:' makes a caption only in the paragraph just before a table; kept as text"),
    3: ("# One\n\n## Two\n\nFigure: alone", 5, "'Figure:' makes a caption only in the paragraph just after an image on its own; kept as text"),
    4: ("ตาราง: ก\n\n| a |\n|---|\n| b |", 1, "a caption is written 'Table:' in English, in every language; this paragraph is kept as text"),
    5: ("Text.\n\n[x]: http://a.example", 3, "the link definition [x] is never used; it is not written into the document"),
    6: ("# Fine\n\nText.", None, None),
}


@query("SELECT o_orderkey::VARCHAR AS doc, 1 AS seq, line, 'markdown' AS code, message FROM orders JOIN (VALUES " + ", ".join(f"({k}, {line if line else 'NULL'}, {_sql_text(m)})" for k, (_, line, m) in _WARNED.items()) + ") AS w(kind, line, message) ON kind = o_orderkey % 7 WHERE message IS NOT NULL")
def build_warnings_known(spark, sf_dir):
    """What a build has to say about documents with one flaw each, by number."""
    text = F.element_at(F.create_map(*(F.lit(x) for k, (t, _, _) in _WARNED.items() for x in (k, t))), (F.col("o_orderkey") % 7).cast("int"))
    return build_warnings(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), text.alias("text")), "id", "text")


_ARGV = ("doc int, argv array<string>, profile string", [
    (1, ["--toc", "--table-widths", "auto", "--size", "14"], None), (2, [], '{"schema": 1, "settings": {"align": "thai", "indent": 0.5, "size": 15}}'), (3, ["--size", "15", "--default", "align"], '{"schema": 1, "settings": {"align": "thai", "indent": 0.5}}'),
    (4, ["--no-page-number-first"], None), (5, ["--margins", "1,1,1,8"], None), (6, [], '{"schema": 2}'),
])


@query()
def settings_resolved(spark, sf_dir):
    """Flags over profiles over defaults: the shortest flags that say the same, or the refusal."""
    return C.resolve(L.frame(spark, *_ARGV), "argv", "profile").select("doc", F.array_join("flags", " ").alias("flags"), "refused")


_GIVEN_SQL = """WITH g AS (SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 2 = 0 THEN 12 + o_orderkey % 6 END AS size_flag, CASE WHEN o_orderkey % 3 = 0 THEN 'thai' WHEN o_orderkey % 3 = 1 THEN 'left' END AS align_flag,
  CASE WHEN o_orderkey % 5 < 3 THEN 13 + o_orderkey % 5 END AS size_profile, CASE WHEN o_orderkey % 5 < 3 THEN 'thai' END AS align_profile, o_orderkey % 7 = 0 AS reset, o_orderkey % 4 = 1 AS toc, o_orderkey % 11 = 0 AS wrong FROM orders),
v AS (SELECT *, coalesce(size_flag, CASE WHEN NOT reset THEN size_profile END, 16) AS size, coalesce(align_flag, align_profile, 'left') AS align FROM g)"""


def _given(spark, sf_dir):
    """Flags and profiles by the order's number."""
    n = F.col("o_orderkey")
    flags = F.flatten(F.array(
        F.when(n % 2 == 0, F.array(F.lit("--size"), (n % 6 + 12).cast("string"))).otherwise(F.array().cast("array<string>")),
        F.when(n % 3 == 0, F.array(F.lit("--align=thai"))).when(n % 3 == 1, F.array(F.lit("--align"), F.lit("left"))).otherwise(F.array().cast("array<string>")),
        F.when(n % 7 == 0, F.array(F.lit("--default"), F.lit("size"))).otherwise(F.array().cast("array<string>")), F.when(n % 4 == 1, F.array(F.lit("--toc"))).otherwise(F.array().cast("array<string>")),
        F.when(n % 11 == 0, F.array(F.lit("--size"), F.lit("0"))).otherwise(F.array().cast("array<string>")),
    ))
    profile = F.when(n % 5 < 3, F.format_string('{"schema": 1, "settings": {"size": %d, "align": "thai"}}', n % 5 + 13))
    return table(spark, sf_dir, "orders").select(n.alias("doc"), flags.alias("argv"), profile.alias("profile"))


@query(_GIVEN_SQL + """ SELECT doc, CASE WHEN NOT wrong THEN concat_ws(' ', CASE WHEN size <> 16 THEN '--size ' || size END, CASE WHEN align <> 'left' THEN '--align ' || align END, CASE WHEN toc THEN '--toc' END) END AS flags,
  CASE WHEN wrong THEN '--size takes a number of points from 1 to 400' END AS refused FROM v""")
def settings_by_rule(spark, sf_dir):
    """Flags over profiles, but for what is reset, over defaults: the shortest flags that say the same, or the refusal."""
    return C.resolve(_given(spark, sf_dir), "argv", "profile").select("doc", F.array_join("flags", " ").alias("flags"), "refused")


@query(_GIVEN_SQL + ", l AS (SELECT * FROM (VALUES ('a', 16), ('b', 14), ('c', 15)) AS c(letter, points)) SELECT doc, coalesce(max(letter) FILTER (points = size), 'd') AS letter FROM v, l WHERE NOT wrong GROUP BY doc")
def interview_by_rule(spark, sf_dir):
    """The choice of the question about the size that holds for those settings."""
    asked = C.questions(C.resolve(_given(spark, sf_dir), "argv", "profile")).filter("question = 'size' and current")
    return asked.select("doc", "letter")


@query()
def interview_choices(spark, sf_dir):
    """The choice of every question that holds for the settings in force."""
    return C.questions(C.resolve(L.frame(spark, *_ARGV), "argv", "profile")).filter("current").select("doc", "number", "question", "letter")
