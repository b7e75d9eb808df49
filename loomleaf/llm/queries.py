"""The ten operators applied to their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import functools
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import spread
from . import chat, covertree, langid, linetree, mainregion, mixing, simhash, tiff, unigram, urltrie

#: Where the public tokenizer models are, and which one is used; never copied.
TOKENIZERS = os.environ.get("LOOMLEAF_TOKENIZERS", "/opt/tokenizers")
PIECES = "piece_bpe_32k.model"

URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


@functools.lru_cache(maxsize=2)
def piece_model(path: str = f"{TOKENIZERS}/{PIECES}") -> unigram.UnigramModel:
    return unigram.read_model(path)


def op1_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a TIFF, and what its page read back holds."""
    stored = tiff.store_texts(_table(spark, sf_dir, "documents"), keep=("doc_id",))
    stored = stored.select("doc_id", "n_bytes", "media", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    pages = tiff.tiff_pages(stored, keep=("doc_id", "n_bytes", "media_bytes", "media_sha256"))
    return pages.select(
        "doc_id", "n_bytes", F.length("pixels").cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -64, 64)).alias("tail_crc32"), "media_bytes", "media_sha256", "feature", "compression", "layout", "predictor", "error",
    )


def op2_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return chat.render_chats(_table(spark, sf_dir, "conversations"))


def op3_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its recurring lines."""
    return linetree.drop_recurring_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


def op4_main_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = _table(spark, sf_dir, "pages")
    return mainregion.extract_main_text(pages, mainregion.learn_weights(pages), keep=("page_id", "url")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.taken_words(_table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text."""
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out())
    model = langid.learn_languages(docs.filter(~F.col("held_out")))
    return langid.identify(docs, model, keep=("doc_id", "held_out"))


def op7_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return urltrie.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES, keep=("page_id",))


def op8_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best partners of every fiftieth vector."""
    rows = _table(spark, sf_dir, "embeddings").filter(covertree.usable("embedding"))
    scaled = lambda x: F.lit(256.0) * x.cast("double")
    # Doubles from 2**53 up are whole as they are, and may not fit a long.
    whole = F.transform("embedding", lambda x: F.when(F.abs(scaled(x)) < float(1 << 53), F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
    return covertree.top_k(rows.select("vec_id", whole.alias("vector")), F.col("vec_id") % 50 == 0, k=5).select("query_id", "rank", "vec_id", "score")


def op9_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as pieces, and the digest of what they decode to."""
    model = piece_model()
    coded = unigram.encode_texts(_table(spark, sf_dir, "documents"), model, keep=("doc_id",))
    return unigram.decode_pieces(coded, model, keep=("doc_id", "pieces", "n_pieces")).select("doc_id", "n_pieces", "pieces", F.length("decoded").cast("long").alias("decoded_chars"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate component."""
    found = simhash.near_components(simhash.print_table(_table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {f.__name__: f for f in (op1_tiff_pages, op2_snapshot_collapse, op3_template_lines, op4_main_region, op5_source_mix, op6_language, op7_url_trie, op8_cover_tree, op9_unigram_pieces, op10_simhash_groups)}

#: The turns of every conversation as a list, and all its proper prefixes, are compared as values, not as hashes.
_CHAT_SQL = r"""
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
named AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER (ORDER BY turn, role, text) ELSE 0 END AS lone FROM turns),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lone ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM named),
whole AS (SELECT conv_id, lone, count(*) AS n, list({'r': role, 'x': text} ORDER BY pos) AS told,
                 string_agg('<|im_start|>' || replace(coalesce(role, 'unknown'), '<|', '< |') || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS chat
          FROM placed GROUP BY conv_id, lone),
proper AS (SELECT DISTINCT k, told[1:k] AS told FROM (SELECT told, unnest(range(1, n)) AS k FROM whole)),
classes AS (SELECT n, told, min(conv_id) AS conv_id, count(*) AS copies, min(chat) AS chat FROM whole GROUP BY n, told)
SELECT c.conv_id, c.n AS n_turns, c.copies, c.chat FROM classes c WHERE NOT EXISTS (SELECT 1 FROM proper p WHERE p.k = c.n AND p.told = c.told)
"""

_LINE_SQL = r"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
ids AS (SELECT text, min(doc_id) AS doc_id, any_value(ls) AS ls FROM docs WHERE text IS NOT NULL GROUP BY text),
lines AS (SELECT text, doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM ids),
tokens AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS raw FROM lines),
masked AS (SELECT *, len(raw) AS n, list_transform(raw, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS ts FROM tokens WHERE len(raw) > 0),
formed AS (SELECT *, ts[1:4] AS lead, CASE WHEN 2 * len(list_filter(ts, lambda t: t <> '<*>')) >= n THEN ts ELSE raw END AS form FROM masked),
leaves AS (SELECT n, lead FROM formed GROUP BY n, lead HAVING count(DISTINCT text) >= 10),
found AS (SELECT f.* FROM formed f JOIN leaves USING (n, lead)),
forms AS (SELECT n, lead, form, count(DISTINCT text) AS texts FROM found GROUP BY n, lead, form),
spread AS (SELECT n, lead, form, texts, unnest(range(1, n + 1)) AS nth, unnest(form) AS token FROM forms),
steady AS (SELECT n, lead, nth, token FROM spread WHERE nth > 4 AND token <> '<*>' GROUP BY n, lead, nth, token HAVING sum(texts) >= 10),
read AS (SELECT s.n, s.lead, s.form, s.nth, CASE WHEN s.nth <= 4 OR y.token IS NOT NULL THEN s.token ELSE '<*>' END AS token
         FROM spread s LEFT JOIN steady y ON y.n = s.n AND y.lead = s.lead AND y.nth = s.nth AND y.token = s.token),
templates AS (SELECT n, lead, form, list(token ORDER BY nth) AS template FROM read GROUP BY n, lead, form),
named AS (SELECT n, lead, form, CASE WHEN n > 4 AND 4 * len(list_filter(template, lambda t: t <> '<*>')) >= 3 * n THEN template ELSE form END AS own FROM templates),
placed AS (SELECT n, lead, own, text, doc_id, line_no FROM found JOIN named USING (n, lead, form)),
firsts AS (SELECT n, lead, own, arg_min(text, doc_id) AS first_text FROM placed GROUP BY n, lead, own HAVING count(DISTINCT text) >= 10),
gone AS (SELECT DISTINCT text, line_no FROM placed JOIN firsts USING (n, lead, own) WHERE text <> first_text),
lost AS (SELECT text, list(line_no) AS nos FROM gone GROUP BY text)
SELECT d.doc_id, CASE WHEN l.nos IS NULL THEN d.text ELSE array_to_string(list_filter(d.ls, lambda x, i: NOT list_contains(l.nos, i - 1)), chr(10)) END AS text,
       coalesce(len(d.ls), 0) AS n_lines, coalesce(len(l.nos), 0) AS n_dropped
FROM docs d LEFT JOIN lost l ON l.text = d.text
"""

_URL_SQL = r"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
fits AS (SELECT *, '.' || host AS h FROM parts),
ruled AS (SELECT page_id, host, path, CASE
  WHEN (h LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (h LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (h LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (h LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM fits)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""

_TOP_SQL = r"""
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(r.v AS DOUBLE[])) AS BIGINT) AS score
  FROM rows q JOIN rows r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id AND len(q.v) = len(r.v))
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scores) WHERE rank <= 5
"""

ORACLES = {"op2_snapshot_collapse": _CHAT_SQL, "op3_template_lines": _LINE_SQL, "op7_url_trie": _URL_SQL, "op8_cover_tree": _TOP_SQL}
