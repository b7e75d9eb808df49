"""Build settings: the registry, flags and profiles read into values, the report, the interview.

Values travel as JSON texts by key, so one table holds settings of every type.
The later wins: defaults, the profile (less what ``--default`` names), the flags.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vocab as V
from .places import PROFILE_NAME

_NUMBER = re.compile(r"[0-9]+(?:\.[0-9]+)?")
_SPACES = " \t\r\n\f\v 　"
MAX_PROFILE = 64 << 10

# --- Fixed values: paper sizes in twips, positions, number formats -------------------
PAPER = {"a4": (11906, 16838), "letter": (12240, 15840), "f14": (12240, 18720)}
POSITIONS = ("top-right", "top-center", "bottom-center")
FRONT_NUMBERS = ("thai-letters", "lower-roman", "upper-roman", "decimal")
APPENDIX_NUMBERS = ("thai-letters", "upper-letters", "decimal", "upper-roman")
INCH = 1440


class SettingFault(ValueError):
    """A flag or a profile that a build refuses."""


def _shown(c: str) -> bool:
    n = ord(c)
    return not any(a <= n <= b for group in (V.CONTROLS, V.FORMAT, V.NONCHARACTERS) for a, b in group)


def text(most: int, without: str = "") -> Callable:
    return lambda v: v if 0 < len(v) <= most and v.strip(_SPACES) and all(_shown(c) and c not in without for c in v) else None


def choice(*values: str) -> Callable:
    return lambda v: v if v in values else None


def number(least: float = 0, most: float = math.inf, whole: bool = False) -> Callable:
    def read(v):
        x = float(v) if _NUMBER.fullmatch(v) else math.nan
        fits = math.isfinite(x) and least <= x <= most
        return None if not fits else int(x) if whole and x == int(x) else x

    return read


def numbers(count: int) -> Callable:
    def read(v):
        found = [number()(x) for x in v.split(",")]
        return found if len(found) == count and None not in found else None

    return read


@dataclass(frozen=True)
class Setting:
    """``kind``: value, switch (on), off (switches off), option (may be absent), position (its value may be left out)."""

    key: str
    kind: str
    default: object
    takes: str = ""
    read: Callable | None = None
    needs: str | None = None
    report: str = ""
    named: str = ""

    @property
    def flag(self) -> str:
        return self.named or "--" + self.key.replace("_", "-")


_LABEL = {"kind": "value", "takes": 'text of 1 to 40 characters on one line, without %, " or \\', "read": text(40, '\t\n%"\\')}
_POINTS = {"takes": "a number of points from 1 to 400", "read": number(1, 400, whole=True)}
_LINE = {"kind": "option", "default": None, "takes": "text of 1 to 200 characters on one line", "read": text(200, "\t\n")}

# --- Fixed values: the settings in the order of the report ----------------------------
REGISTRY = (
    Setting("font", "value", "TH Sarabun New", "a font name of 1 to 64 characters", text(64)),
    Setting("size", "value", 16, **_POINTS, report="size_pt"),
    Setting("paper", "value", "a4", "a4, letter or f14", choice(*PAPER)),
    Setting("landscape", "switch", False),
    Setting("margins", "value", [1.0, 1.0, 1.0, 1.5], "four non-negative numbers: top,right,bottom,left", numbers(4), report="margins_in"),
    Setting("indent", "value", 0.0, "a non-negative number of inches", number(), "body paragraphs", "first_line_indent_in"),
    Setting("line_spacing", "value", 1.0, "a multiple of single spacing from 1 to 3", number(1, 3)),
    Setting("align", "value", "left", "left or thai", choice("left", "thai")),
    Setting("toc", "switch", False),
    Setting("heading_numbers", "switch", False),
    Setting("page_numbers", "position", False, "top-right, top-center or bottom-center", choice(*POSITIONS)),
    Setting("page_number_on_first", "off", True, needs="page_numbers", named="--no-page-number-first"),
    Setting("header", **_LINE),
    Setting("footer", **_LINE),
    Setting("thai_language", "switch", False),
    Setting("force_cs_whole_doc", "switch", False, needs="other text"),
    Setting("thai_digits", "switch", False),
    Setting("auto_numbering", "switch", False, needs="numbers"),
    Setting("hide_spelling_errors", "switch", False),
    Setting("repeat_table_header", "off", True, needs="tables", named="--no-repeat-table-header"),
    Setting("table_widths", "value", "equal", "equal or auto", choice("equal", "auto"), "tables"),
    Setting("table_size", "option", None, **_POINTS, report="table_size_pt"),
    Setting("chapter_label", default="บทที่", **_LABEL, needs="chapter headings"),
    Setting("table_label", default="ตารางที่", **_LABEL, needs="table captions"),
    Setting("figure_label", default="รูปที่", **_LABEL, needs="figure captions"),
    Setting("caption_hanging_indent", "value", 0.0, "a number of inches from 0 to 4", number(0, 4), "captions", "caption_hanging_indent_in"),
    Setting("center_images", "switch", False, needs="images"),
    Setting("caption_matches_object", "switch", False, needs="figure captions"),
    Setting("front_page_numbers", "value", "thai-letters", ", ".join(FRONT_NUMBERS), choice(*FRONT_NUMBERS), "front"),
    Setting("appendix_label", default="ภาคผนวก", **_LABEL, needs="appendix headings"),
    Setting("appendix_numbers", "value", "thai-letters", ", ".join(APPENDIX_NUMBERS), choice(*APPENDIX_NUMBERS), "appendix headings"),
    Setting("chapter_title_on_new_line", "switch", False, needs="numbered headings"),
)
BY_KEY = {s.key: s for s in REGISTRY}
BY_FLAG = {s.flag: s for s in REGISTRY}
DEFAULTS = {s.key: s.default for s in REGISTRY}

# --- Fixed values: the interview's questions; "*" takes a typed value ------------------
QUESTIONS = (
    ("font", ({"font": "TH Sarabun New"}, {"font": "TH SarabunPSK"}, {"font": "Sarabun"}, "*")),
    ("size", ({"size": 16}, {"size": 14}, {"size": 15}, "*")),
    ("paper", ({"paper": "a4", "margins": [1.0, 1.0, 1.0, 1.5]}, {"paper": "a4", "margins": [1.0, 1.0, 1.0, 1.0]}, {"paper": "letter", "margins": [1.0, 1.0, 1.0, 1.5]}, "*")),
    ("align", ({"align": "left"}, {"align": "thai"})),
    ("indent", ({"indent": 0.0}, {"indent": 0.5}, {"indent": 1.0}, "*")),
    ("toc", ({"toc": False}, {"toc": True})),
    ("page-numbers", ({"page_numbers": False}, {"page_numbers": "top-right"})),
    ("squiggles", ({"hide_spelling_errors": False}, {"hide_spelling_errors": True})),
)


def said(value) -> str:
    """A value as its flag takes it."""
    if isinstance(value, list):
        return ",".join(map(said, value))
    return value if isinstance(value, str) else str(int(value)) if value == int(value) else repr(float(value))


def as_flags(values: dict) -> list[str]:
    """The flags that set these values, in the registry's order."""
    out: list[str] = []
    for s in REGISTRY:
        value = values.get(s.key)
        if s.kind in ("switch", "off"):
            out += [s.flag] * (value is (s.kind == "switch"))
        elif value is not None and value is not False:
            out += [s.flag, said(value)]
    return out


def _value(s: Setting, given: str):
    if (value := s.read(given)) is None:
        raise SettingFault(f"{s.flag} takes {s.takes}")
    return value


def font_name(name: str) -> str:
    """The name as applications read it: no space at an end, 31 characters."""
    return name.strip(V.FONT_SPACES)[: V.FONT_MAX].rstrip(V.FONT_SPACES)


def read_flags(argv: list[str], profile: dict | None = None) -> dict:
    """Every setting's value for these flags over a profile's settings; raises SettingFault."""
    args = iter(list(argv))
    waiting: list[str] = []
    values: dict = {}
    reset: set[str] = set()
    while (arg := waiting.pop() if waiting else next(args, None)) is not None:
        name, given_here, given = arg.partition("=")
        s = BY_FLAG.get(name)
        if s is None and name != "--default":
            raise SettingFault(f"unknown option {name}")
        if s is not None and s.kind in ("switch", "off"):
            if given_here:
                raise SettingFault(f"{name} takes no value")
            values[s.key] = s.kind == "switch"
            continue
        if not given_here:
            given = next(args, None)
            if s is not None and s.kind == "position" and given not in POSITIONS:
                waiting += [given] if given is not None else []
                given = POSITIONS[0]
            if given is None:
                raise SettingFault(f"{name} needs a value")
        if s is not None:
            values[s.key] = _value(s, given)
            continue
        if unknown := [k for k in given.split(",") if k not in BY_KEY]:
            raise SettingFault(f"--default names no setting: {unknown[0]}")
        reset |= set(given.split(","))
    out = DEFAULTS | {k: v for k, v in (profile or {}).items() if k not in reset} | values
    out["font"] = font_name(out["font"])
    _together(out)
    return out


def _together(o: dict) -> None:
    """The rules that more than one setting take part in."""
    for s in REGISTRY:
        if s.needs in BY_KEY and o[s.key] != s.default and o[s.needs] == DEFAULTS[s.needs]:
            raise SettingFault(f"{s.flag} needs {BY_KEY[s.needs].flag}")
    for key in ("table_label", "figure_label") if o["auto_numbering"] else ():
        if any(c in _SPACES for c in o[key]):
            raise SettingFault(f"{BY_KEY[key].flag} takes no space with --auto-numbering")
    width, height = PAPER[o["paper"]][:: -1 if o["landscape"] else 1]
    top, right, bottom, left = (math.floor(m * INCH + 0.5) for m in o["margins"])
    room = width - left - right
    if min(room, height - top - bottom) < INCH:
        raise SettingFault("--margins leave less than one inch for text")
    for key in ("indent", "caption_hanging_indent"):
        if room - math.floor(o[key] * INCH + 0.5) < INCH:
            raise SettingFault(f"{BY_KEY[key].flag} leaves less than one inch for text")


def read_profile(content: str | None) -> dict:
    """The settings of a profile's JSON; raises SettingFault."""
    if len((content or "").encode()) > MAX_PROFILE:
        raise SettingFault("larger than 64 KiB; a profile is settings")
    try:
        told = json.loads(content or "")
    except ValueError:
        raise SettingFault("not JSON") from None
    if not isinstance(told, dict) or type(told.get("schema")) is not int or told["schema"] != 1:
        raise SettingFault('"schema" is the integer 1')
    given = told.get("settings")
    if not isinstance(given, dict):
        raise SettingFault('"settings" is an object')
    out = {}
    for key, value in given.items():
        s = BY_KEY.get(key)
        if s is None:
            raise SettingFault(f"no setting is named '{key[: V.QUOTED_MAX]}'")
        if value == s.default and type(value) is type(s.default):
            out[key] = value
        elif s.kind in ("switch", "off"):
            if type(value) is not bool:
                raise SettingFault(f"{key} is true or false")
            out[key] = value
        else:
            right = type(value) in (int, float, str) or isinstance(value, list) and isinstance(s.default, list) and all(type(v) in (int, float) for v in value)
            if not right or isinstance(value, str) != isinstance(s.read(said(value)) if right else None, str):
                raise SettingFault(f"{s.flag} takes {s.takes}")
            out[key] = _value(s, said(value))
    _together(DEFAULTS | out)
    return out


def report(values: dict) -> dict:
    """The settings as a build reports them."""
    out = {s.report or s.key: values[s.key] for s in REGISTRY}
    out["margins_in"] = dict(zip(("top", "right", "bottom", "left"), values["margins"], strict=True))
    return out


def changed(values: dict) -> dict:
    """What a profile of these values would hold: those that aren't the defaults."""
    return {k: v for k, v in values.items() if v != DEFAULTS[k]}


def _as_json(v) -> str:
    return json.dumps(v, ensure_ascii=False)


def _resolved(argv, profile) -> tuple:
    try:
        values = read_flags(list(argv if argv is not None else ()), None if profile is None else read_profile(profile))
    except SettingFault as e:
        return None, None, None, str(e)
    return {k: _as_json(v) for k, v in values.items()}, _as_json(report(values)), as_flags(changed(values)), None


def resolve(df: DataFrame, argv: str, profile: Column | str | None = None) -> DataFrame:
    """``df`` with settings (key to JSON), report (JSON), flags (a shortest form) and refused.

    ``argv``: a column of flags; null is none.  ``profile``: a profile's JSON; null is none.
    """
    kind = "settings map<string,string>, report string, flags array<string>, refused string"

    @F.pandas_udf(kind)
    def run(argvs: pd.Series, profiles: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_resolved(a, p) for a, p in zip(argvs, profiles, strict=True)], columns=["settings", "report", "flags", "refused"])

    of_profile = F.lit(None).cast("string") if profile is None else F.col(profile) if isinstance(profile, str) else profile
    return df.withColumn("_r", run(F.col(argv), of_profile)).select(*df.columns, "_r.*")


def registry_table(spark: SparkSession) -> DataFrame:
    """ord, key, flag, default (JSON), need (a structure a document must have, or null)."""
    rows = [(i, s.key, s.flag, _as_json(s.default), s.needs if s.needs not in BY_KEY else None) for i, s in enumerate(REGISTRY)]
    return spark.createDataFrame(rows, "ord int, key string, flag string, default string, need string")


def not_default(resolved: DataFrame, doc: str = "doc") -> DataFrame:
    """doc, ord, flag, need: the settings of each document that aren't the defaults, for ``sets.changed_nothing``."""
    each = resolved.filter("settings is not null").select(F.col(doc).alias("doc"), F.explode("settings").alias("key", "value"))
    return each.join(F.broadcast(registry_table(resolved.sparkSession)), "key").filter("value <> default").select("doc", "ord", "flag", "need")


def questions(resolved: DataFrame, doc: str = "doc") -> DataFrame:
    """doc, number, question, letter, current, other: every choice against the settings in force.

    A choice is current if all that it sets holds; the one for a typed value if no other is.
    ``change``: the settings (key to JSON) that the choice would change.
    """
    empty = "cast(null as map<string,string>)"
    choices = F.array(*(
        F.struct(F.lit(n).alias("number"), F.lit(q).alias("question"), F.lit("abcd"[i]).alias("letter"), (F.expr(empty) if c == "*" else F.create_map(*(F.lit(x) for k, v in c.items() for x in (k, _as_json(v))))).alias("sets"))
        for n, (q, cs) in enumerate(QUESTIONS, 1) for i, c in enumerate(cs)
    ))
    every = resolved.filter("settings is not null").select(F.col(doc).alias("doc"), "settings", F.explode(choices).alias("q"))
    change = F.map_filter("q.sets", lambda k, v: F.col("settings")[k] != v)
    each = every.select("doc", "q.number", "q.question", "q.letter", F.col("q.sets").isNull().alias("other"), F.when(F.col("q.sets").isNotNull(), change).alias("change"))
    holds = F.coalesce(F.size("change") == 0, F.lit(False)) & ~F.col("other")
    matched = F.max("holds").over(Window.partitionBy("doc", "number"))
    return each.withColumn("holds", holds).withColumn("matched", matched).select("doc", "number", "question", "letter", "other", F.when(F.col("other"), ~F.col("matched")).otherwise(F.col("holds")).alias("current"), "change")


def written_profile(settings: dict) -> str:
    """The one written form of a profile: keys sorted, two spaces, characters as themselves, one line feed at the end."""
    return json.dumps({"schema": 1, "settings": settings}, ensure_ascii=False, indent=2, sort_keys=True) + "\n"


def saved_profiles(resolved: DataFrame, name: str) -> DataFrame:
    """name, content, digest: for each resolved row that isn't refused and has a name that a profile may have, its settings that aren't the defaults.

    Rows of (name, content) go to files with the whole-files sink; equal settings have equal digests.
    """

    @F.pandas_udf("content string, digest string")
    def run(settings: pd.Series) -> pd.DataFrame:
        held = [changed({k: json.loads(v) for k, v in dict(s).items()}) for s in settings]
        return pd.DataFrame([(written_profile(h), hashlib.sha256((json.dumps(h, ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode()).hexdigest()) for h in held], columns=["content", "digest"])

    fit = resolved.filter(F.col("settings").isNotNull() & F.col(name).rlike(PROFILE_NAME))
    return fit.select(F.col(name).alias("name"), run("settings").alias("p")).select("name", "p.*")


def choice_flags(change: dict) -> list[str]:
    """The flags that make a choice true against the settings in force, from what it changes (key to JSON)."""
    told = {k: json.loads(v) for k, v in change.items()}
    reset = [s.key for s in REGISTRY if s.key in told and told[s.key] == s.default]
    return as_flags({k: v for k, v in told.items() if k not in reset}) + (["--default", ",".join(reset)] if reset else [])


def choice_args(asked: DataFrame) -> DataFrame:
    """``asked`` (of :func:`questions`) with ``args``, the fewest flags that each choice takes; none for a typed value."""

    @F.pandas_udf("array<string>")
    def run(changes: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else choice_flags(dict(c)) for c in changes])

    return asked.withColumn("args", run("change"))


def font_said(what: str, name: str) -> str | None:
    """What a build says about a font whose name it doesn't write as it is given, or None."""
    kept, inner = font_name(name), name.strip(V.FONT_SPACES)
    if kept == name:
        return None
    named = lambda spaces: f" ({', '.join(odd)})" if (odd := list(dict.fromkeys(f"U+{ord(c):04X}" for c in spaces if c != " "))) else ""
    ends = name[: len(name) - len(name.lstrip(V.FONT_SPACES))] + name[len(name.rstrip(V.FONT_SPACES)) :]
    if len(inner) <= V.FONT_MAX:
        return f"{what} '{name}' begins or ends with a space{named(ends)}, which no font's name does, so the document names '{kept}'"
    cut = inner[: V.FONT_MAX]
    ends += cut[len(cut.rstrip(V.FONT_SPACES)) :]
    without = f", without a space{named(ends)} at either end" if ends else ""
    return f"{what} '{name[: V.FONT_MAX - 1]}…' is longer than the {V.FONT_MAX} characters Word reads of a font's name, so the document names '{kept}'{without}: Word uses a font only if one is installed under exactly that name, and shows another font if none is"
