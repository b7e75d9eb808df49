"""URL filter (operator 7): allow and block rules in a trie over reversed host labels, then path segments.

A rule is (verdict, host, path).  It fits its host and all subdomains when the
url's path starts with the rule's path.  The rule with the longest host and path
together wins; among equals the one with more host labels, and of two rules for
the same place the block.  No rule: the default verdict.

Defined cases: a null url, or one without "://", has an empty host and path and
gets the default; matching compares whole host labels, so a port or a trailing
dot belongs to the last label and fits nothing without it; A-Z alone are lower-cased, in urls
and rules alike; repeated rows get equal verdicts, a row each; an empty table gives an empty
one; urls are read whole, whatever their length; columns kept may have any names (new ones are
underscored until they clash with none).
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bounded_batches, free_name, slices

ALLOW, BLOCK = "allow", "block"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_URL = re.compile(r".*?://([^/?#]*)([^?#]*)", re.DOTALL)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    found = _URL.match(url or "")
    if not found:
        return "", ""
    return found[1].encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), found[2]


class UrlTrie:
    """Nodes are dicts by label or segment; what a rule's last segment must start with hangs at its node."""

    def __init__(self, rules: Iterable[tuple[str, str, str]], default: str = ALLOW):
        self.default = default
        self.root: dict = {"next": {}, "paths": None}
        for verdict, host, path in rules:
            if verdict not in (ALLOW, BLOCK):
                raise ValueError(f"unknown verdict {verdict!r}")
            host = host.encode().lower().decode()
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node["next"].setdefault(label, {"next": {}, "paths": None})
            node["paths"] = node["paths"] or {"next": {}, "starts": {}}
            node = node["paths"]
            *whole, start = path.split("/")
            for segment in whole:
                node = node["next"].setdefault(segment, {"next": {}, "starts": {}})
            if node["starts"].get(start, (0, 0, "", ALLOW))[3] != BLOCK:
                node["starts"][start] = (len(host) + len(path), host.count(".") + 1 if host else 0, host + path, verdict)

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        """The winning rule (host and path, or None) and the verdict."""
        best, node, segments = None, self.root, path.split("/")
        labels = host.split(".")
        for depth in range(len(labels) + 1):
            if node["paths"]:
                here = node["paths"]
                for segment in segments:
                    starts = here["starts"]
                    for start in starts if len(starts) <= len(segment) else (segment[:n] for n in range(len(segment) + 1)):
                        if segment.startswith(start) and (found := starts.get(start)) and (best is None or found > best):
                            best = found
                    here = here["next"].get(segment)
                    if here is None:
                        break
            if depth == len(labels) or (node := node["next"].get(labels[-1 - depth])) is None:
                break
        return (best[2], best[3]) if best else (None, self.default)


def judge_urls(df: DataFrame, rules: Iterable[tuple[str, str, str]], url: str = "url", keep: tuple = (), default: str = ALLOW, max_rules: int = 1_000_000) -> DataFrame:
    """``keep`` columns with ``host``, ``path``, ``rule`` and ``verdict``.

    The trie is broadcast: ``max_rules`` bounds its size, and a longer list is
    refused (:func:`judge_urls_by_join` takes a list of any length).
    """
    rules = list(rules)
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules exceed max_rules={max_rules}; use judge_urls_by_join")
    trie = df.sparkSession.sparkContext.broadcast(UrlTrie(rules, default))
    inner = free_name(keep, "judged_url")
    bounded_batches(df.sparkSession)
    source = df.select(*keep, F.col(url).cast("string").alias(inner))
    names = [free_name(keep, n) for n in ("host", "path", "rule", "verdict")]
    schema = T.StructType([*source.schema.fields[:-1], *(T.StructField(n, T.StringType()) for n in names)])

    def run(batches):
        for batch in slices(batches, 4096):
            parts = [split_url(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            found = [trie.value.judge(*x) for x in parts]
            columns = [[x[0] for x in parts], [x[1] for x in parts], [x[0] for x in found], [x[1] for x in found]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, pa.string()) for c in columns)], names=schema.names)

    return source.mapInArrow(run, schema)


def judge_urls_by_join(df: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id", default: str = ALLOW) -> DataFrame:
    """The same verdicts for a rule table (verdict, host, path) that is too large to broadcast.

    Each distinct url is expanded to its host suffixes; those are joined with the rules by
    host, the path is compared, and the longest fit is kept per url.  A suffix that most urls
    share is one key of a plain inner join, which adaptive execution splits.
    """
    u = F.coalesce(F.col("u"), F.lit(""))
    parts = df.select(F.col(key).alias("k"), F.col(url).cast("string").alias("u"))
    parts = parts.withColumns({
        "h": F.translate(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _UPPER.lower()),
        "p": F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1),
    })
    labels = F.split("h", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    listed = rules.select(F.translate("host", _UPPER, _UPPER.lower()).alias("rh"), F.col("path").alias("rp"), F.col("verdict").alias("rv"))
    fit = parts.select("u", "h", "p").distinct().withColumn("suffix", F.explode(F.array_union(F.array(F.lit("")), suffixes)))
    fit = fit.join(listed, F.col("suffix") == F.col("rh")).filter(F.col("p").startswith(F.col("rp")))
    best = fit.groupBy("u").agg(F.max(F.struct((F.length("rh") + F.length("rp")).alias("n"), F.when(F.col("rh") == "", 0).otherwise(F.size(F.split("rh", r"\."))).alias("labels"), F.concat("rh", "rp").alias("rule"), F.col("rv").alias("verdict"))).alias("best"))
    best = best.select(F.col("u").alias("bu"), "best")
    joined = parts.join(best, F.col("u").eqNullSafe(F.col("bu")), "left")
    return joined.select(F.col("k").alias(key), F.col("h").alias("host"), F.col("p").alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
