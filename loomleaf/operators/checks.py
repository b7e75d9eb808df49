"""Checks of packages as tables: findings, warnings, counts and numbering kinds.

All rules are local to a package, so each one is examined where it is (:mod:`examine`) and only
records leave the task; nothing is joined or shuffled to find a fault.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocab as V
from ..workspace import SPARK_KINDS, bounded_batches, gathered, written
from .examine import NUMBERINGS, examine, roles_of
from .ordered import cap_per_code, omitted_per_code

_PLACE = ["stage", "part_ord", "node", "seq"]
_TEXT, _INT, _LONG = pa.string(), pa.int32(), pa.int64()
_RECORDS = {
    "doc": _TEXT, "kind": _TEXT, "code": _TEXT, "part": _TEXT, "message": _TEXT, "names": pa.list_(_TEXT), "short": pa.bool_(),
    "stage": _INT, "part_ord": _INT, "node": _INT, "seq": _INT, "n": _LONG,
}
_COUNTS = ("runs", "thai_language_runs", "paragraphs", "tables", "footnotes")
_SUMMARY = {"doc": _TEXT, "ok": pa.bool_(), "exit_code": _INT, **dict.fromkeys(_COUNTS, _LONG), "numbering": _TEXT}
_ROLES = {"doc": _TEXT, "role": _TEXT, "name": _TEXT, "name_ord": _INT}
_UNREAD = ("package", "doctype", "size")


def w_attr(name: str, column: str = "attrs") -> Column:
    return F.element_at(F.col(column), f"{{{V.W}}}{name}")


@dataclass
class Checked:
    """The tables of a check; ``records`` is what they are read from."""

    records: DataFrame
    docs: DataFrame
    roles: DataFrame
    findings: DataFrame
    warnings: DataFrame
    counts: DataFrame
    numbering: DataFrame
    fonts: DataFrame


def _of_packages(packages: DataFrame, rows: Callable[[str, bytes | None], Iterable[tuple]], columns: dict[str, pa.DataType]) -> DataFrame:
    """The rows of each package (doc, content), made where it is."""
    bounded_batches(packages.sparkSession, 64)

    def run(batches):
        each = ((doc.as_py(), content.as_py()) for batch in batches for doc, content in zip(batch.column(0), batch.column(1), strict=True))
        return gathered((row for doc, content in each for row in rows(doc, content)), columns, most=10_000)

    return packages.select(F.col("doc").cast("string").alias("doc"), "content").mapInArrow(run, ", ".join(f"{c} {SPARK_KINDS[k]}" for c, k in columns.items()))


def package_records(packages: DataFrame) -> DataFrame:
    """The records of each package (doc, content), and one of kind "doc" for the package itself."""

    def rows(doc, content):
        yield doc, "doc", "", None, None, (), False, 0, 0, 0, 0, None
        for r in examine(content):
            yield doc, r.kind, r.code, r.part, r.message, r.names, r.short, r.stage, r.part_ord, r.node, r.seq, r.n

    return _of_packages(packages, rows, _RECORDS)


def package_summaries(packages: DataFrame) -> DataFrame:
    """One row per package (doc, content): doc, ok, exit_code as in ``verdicts``, its counts and its kind of numbering.

    The same as those tables of ``check_packages``, for who needs no more of it: nothing is
    written or shuffled.
    """

    def rows(doc, content):
        found = examine(content)
        codes = {r.code for r in found if r.kind == "finding"}
        counts = {r.code: r.n for r in found if r.kind == "count"}
        used = {r.code.split("_")[0] for r in found if r.kind == "numbering" and r.n}
        kind = ("mixed" if len(used) > 1 else next(iter(used), "none")) if counts else None
        yield doc, not codes, 0 if not codes else 2 if codes & {*_UNREAD} else 1, *(counts.get(c) for c in _COUNTS), kind

    return _of_packages(packages, rows, _SUMMARY)


def part_roles(packages: DataFrame) -> DataFrame:
    """doc, role, name, name_ord: the roles of ``check_packages`` without the rules that don't bear on them."""
    return _of_packages(packages, lambda doc, content: ((doc, r.code, r.part, r.part_ord) for r in roles_of(content)), _ROLES)


def _told(records: DataFrame, kind: str) -> DataFrame:
    """Findings or warnings with names from files as they may be shown."""
    shown = F.transform("names", lambda n: F.coalesce(F.when(F.col("short"), X.quoted(n, V.FONT_MAX)).otherwise(X.quoted(n)), F.lit("no w:val")))
    message = F.replace("message", F.lit("\0"), F.array_join(shown, ", "))
    return records.filter(F.col("kind") == kind).select("doc", "code", X.quoted("part").alias("part"), message.alias("message"), *_PLACE)


def check_packages(packages: DataFrame, keep: bool = True) -> Checked:
    """The whole check of packages (doc, content).

    With ``keep`` the records are written once to the shared folder, for more than one of
    the tables; without, each table examines the packages when it is read.
    """
    records = package_records(packages)
    records = written(records) if keep else records
    of = lambda kind: records.filter(F.col("kind") == kind)
    sums = lambda kind, names: of(kind).groupBy("doc").agg(*(F.max(F.when(F.col("code") == n, F.col("n"))).alias(n) for n in names))
    counts = sums("count", _COUNTS)
    kinds = sums("numbering", NUMBERINGS)
    auto, wrote = (F.greatest(*(n for n in NUMBERINGS if n.startswith(s))) > 0 for s in ("automatic", "written"))
    kinds = kinds.withColumn("kind", F.when(auto & wrote, "mixed").when(auto, "automatic").when(wrote, "written").otherwise("none"))
    roles = of("role").select("doc", F.col("code").alias("role"), F.col("part").alias("name"), F.col("part_ord").alias("name_ord"))
    fonts = of("font").groupBy("doc", F.col("code").alias("font")).agg(F.sum("n").alias("n"))
    return Checked(records, of("doc").select("doc"), roles, _told(records, "finding"), _once(_told(records, "warning")), counts, kinds, fonts)


def _once(warnings: DataFrame) -> DataFrame:
    """Each warning of a document once, at its first place."""
    first = warnings.groupBy("doc", "code", "part", "message").agg(F.min(F.struct(*_PLACE)).alias("p"))
    return first.select("doc", "code", "part", "message", "p.*")


def listed_findings(findings: DataFrame) -> DataFrame:
    """The first twenty findings of each code and document, in order."""
    return cap_per_code(findings, ["doc"], "code", _PLACE)


def omitted_findings(findings: DataFrame) -> DataFrame:
    return omitted_per_code(findings, ["doc"], "code")


def verdicts(checked: Checked) -> DataFrame:
    """doc, ok and exit code: 2 for a package that isn't read, 1 for findings, else 0."""
    worst = checked.findings.groupBy("doc").agg(F.max(F.col("code").isin(*_UNREAD)).alias("unread"))
    out = checked.docs.join(worst, "doc", "left")
    return out.select("doc", F.col("unread").isNull().alias("ok"), F.when(F.col("unread").isNull(), 0).when(F.col("unread"), 2).otherwise(1).alias("exit_code"))


def result_lines(checked: Checked) -> DataFrame:
    """doc, exit_code, line: what a check says of each package, as one line of JSON; what there is none of is left out."""
    told = lambda df, name: df.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(*_PLACE, "code", "part", "message"))).alias("xs")).select("doc", F.transform("xs", lambda x: F.struct(x["code"].alias("code"), x["part"].alias("part"), x["message"].alias("message"))).alias(name))
    omitted = omitted_findings(checked.findings).groupBy("doc").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "omitted")))).alias("omitted"))
    counts = checked.counts.select("doc", F.struct(*_COUNTS).alias("counts"))
    out = verdicts(checked)
    for part in (told(listed_findings(checked.findings), "findings"), omitted, told(checked.warnings, "warnings"), counts, checked.numbering.select("doc", F.col("kind").alias("numbering"))):
        out = out.join(part, "doc", "left")
    none = F.array().cast("array<struct<code:string,part:string,message:string>>")
    line = F.to_json(F.struct("ok", F.coalesce("findings", none).alias("findings"), "omitted", F.coalesce("warnings", none).alias("warnings"), "counts", "numbering"))
    return out.select("doc", "exit_code", line.alias("line"))
