"""Text functions over columns.  All are SQL expressions but those named as Arrow UDFs."""

from __future__ import annotations

import html.entities
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocab as V

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OTHER_COMPLEX = tuple((a, b) for a, b in ((0x0590, 0x0DFF), (0x0E80, 0x0FFF), *V.COMPLEX_SCRIPT[3:]))
_JOINED = rf"(?<={V.char_class(_OTHER_COMPLEX)})[\x{{200C}}\x{{200D}}](?={V.char_class(_OTHER_COMPLEX)})"
UNSEEN = rf"(?!{_JOINED}){V.char_class(V.FORMAT, V.NONCHARACTERS)}"
FORBIDDEN = rf"(?!{_JOINED}){V.char_class(V.CONTROLS, V.FORMAT, V.NONCHARACTERS)}"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c) -> Column:
    """A-Z only; other letters have no business in part names and phrases."""
    return F.translate(_c(c), _UPPER, _LOWER)


def has_thai(c) -> Column:
    return _c(c).rlike(V.char_class(V.THAI))


def has_complex(c) -> Column:
    return _c(c).rlike(V.char_class(V.COMPLEX_SCRIPT))


def not_text(c) -> Column:
    """Whether an argument was no text: a character that couldn't be decoded stands in it (columns can't hold half of a pair)."""
    return F.contains(_c(c), F.lit("\ufffd"))


def code_label(char: Column) -> Column:
    """"U+XXXX" of a character."""
    code = F.conv(F.hex(F.encode(char, "utf-32")), 16, 16)
    return F.concat(F.lit("U+"), F.when(F.length(code) < 4, F.lpad(code, 4, "0")).otherwise(code))


def unseen_label(char: Column) -> Column:
    """How a character that a reader can't see is named."""
    named = F.create_map(*(F.lit(x) for pair in V.INVISIBLE.items() for x in pair))[char]
    kind = F.when(char.rlike(V.char_class(V.CONTROLS)), "a control character").when(char.rlike(V.char_class(V.FORMAT)), "a format character").otherwise("a noncharacter")
    return F.when(char == "", None).otherwise(F.coalesce(named, F.concat(code_label(char), F.lit(", "), kind)))


def forbidden_label(c) -> Column:
    """The label of the first character that input may not hold, or null."""
    return unseen_label(F.regexp_extract(_c(c), f"({FORBIDDEN})", 1))


def unseen_in(c) -> Column:
    """The label of an invisible character in text, the five named ones first, or null."""
    found = F.regexp_extract_all(_c(c), F.lit(f"({UNSEEN})"), F.lit(1))
    first_named = F.coalesce(*(F.when(F.array_contains(found, ch), ch) for ch in V.INVISIBLE))
    return unseen_label(F.coalesce(first_named, F.try_element_at(found, F.lit(1)), F.lit("")))


def marks_out_of_place(c) -> Column:
    """What is wrong with how a line's Thai marks sit: an array of messages, once each."""
    line, tail = _c(c), "; it is written as it stands"
    lone = F.regexp_extract(line, rf"(?<!{V.char_class(V.CONSONANTS, V.MARKS)})({V.char_class(V.MARKS)})", 1)
    runs = F.regexp_extract_all(line, F.lit(f"({V.char_class(V.MARKS, ((0x0E33, 0x0E33),))}+)"), F.lit(1))
    count = lambda run, *groups: F.length(F.regexp_replace(run, V.char_class(*groups, negated=True), ""))
    am, over = ((0x0E33, 0x0E33),), ((0x0E4C, 0x0E4C),)
    two = F.exists(runs, lambda r: count(r, V.TONES) >= 2)
    stacked = F.exists(runs, lambda r: (count(r, V.ABOVE) >= 2) | (count(r, V.BELOW) >= 2) | ((count(r, V.TONES) >= 1) & (count(r, over) >= 1)) | (count(r, am) >= 2))
    return F.array_compact(F.array(
        F.when(lone != "", F.concat(F.lit("a Thai mark ("), code_label(lone), F.lit(f") with no letter before it{tail}"))),
        F.when(two, f"a letter with two tone marks{tail}"),
        F.when(stacked & ~two, f"a letter with two marks that stand in one place{tail}"),
    ))


def long_sara_am(c) -> Column:
    """The vowel written as the two characters that it looks like."""
    return F.contains(_c(c), F.lit(V.NIKHAHIT_AA))


def soft_break_join(c) -> Column:
    """A line break vanishes between Thai and Thai, and after a Thai full stop before Thai; else it is a space."""
    thai = V.char_class(V.THAI)
    return F.replace(F.regexp_replace(_c(c), rf"(?<={thai}|{thai}\.)\n(?={thai})", ""), F.lit("\n"), F.lit(" "))


def quoted(c, most: int = V.QUOTED_MAX) -> Column:
    """A name from a file as it may be shown: known characters, others as "?", cut with an ellipsis."""
    shown = F.regexp_replace(_c(c), r"[^A-Za-z0-9 \-_./()\[\]+&,\x{E00}-\x{E7F}]", "?")
    return F.when(F.length(shown) > most, F.concat(F.left(shown, F.lit(most - 1)), F.lit("…"))).otherwise(shown)


def normalize_label(c) -> Column:
    """Link labels compare without case, with inner white space collapsed."""
    return F.upper(F.lower(F.regexp_replace(F.btrim(_c(c), F.lit(" \t\n\x0b\x0c\r")), "[ \t\r\n]+", " ")))


def refused_scheme(c) -> Column:
    """The scheme of a link that may lead nowhere, or null."""
    scheme = F.regexp_extract(_c(c), "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    return F.when((scheme != "") & ~F.lower(scheme).isin(*V.SCHEMES), scheme)


def xml_text(c) -> Column:
    return F.replace(F.replace(F.replace(_c(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def xml_attribute(c) -> Column:
    out = xml_text(c)
    for char, reference in (('"', "&quot;"), ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;")):
        out = F.replace(out, F.lit(char), F.lit(reference))
    return F.concat(F.lit('"'), out, F.lit('"'))


def xml_unescape(c) -> Column:
    out = _c(c)
    for reference, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(reference), F.lit(char))
    return out


def half_up(c) -> Column:
    return F.floor(_c(c).cast("double") + 0.5).cast("int")


def number_text(n, kind: str = "decimal", thai_digits: bool = False) -> Column:
    """A positive number in a chapter or appendix format."""
    n = _c(n).cast("int")
    if kind in ("thai-letters", "upper-letters"):
        letters = V.THAI_LETTERS if kind == "thai-letters" else _UPPER
        return F.repeat(F.substring(F.lit(letters), (n - 1) % len(letters) + 1, F.lit(1)), (F.floor((n - 1) / len(letters)) + 1).cast("int"))
    if kind == "upper-roman":
        steps = F.array(*(F.struct(F.lit(v).alias("v"), F.lit(s).alias("s")) for v, s in V.ROMAN))
        start = F.struct(n.alias("left"), F.lit("").alias("out"))
        done = F.aggregate(steps, start, lambda acc, x: F.struct((acc["left"] % x["v"]).cast("int").alias("left"), F.concat(acc["out"], F.repeat(x["s"], F.floor(acc["left"] / x["v"]).cast("int"))).alias("out")))
        return done["out"]
    return F.translate(n.cast("string"), "0123456789", V.THAI_DIGITS) if thai_digits else n.cast("string")


def meant_directive(c) -> Column:
    """The layout comment that a short comment looks meant as, or null."""
    inner = F.regexp_extract(_c(c), "^<!--[ \t]*([A-Za-z][A-Za-z _-]{0,30}?)[ \t]*-->$", 1)
    word = F.regexp_replace(F.lower(inner), "[ _]+", "-")
    alias = F.create_map(*(F.lit(x) for pair in V.DIRECTIVE_ALIASES.items() for x in pair))[word]
    near = F.coalesce(*(F.when(F.levenshtein(word, F.lit(d), 2 if len(d) >= 6 else 1) >= 0, d) for d in V.DIRECTIVES))
    return F.when(inner != "", F.coalesce(F.when(word.isin(*V.DIRECTIVES), word), alias, near))


_SPACES = " \t\n\r\x0c\x0b\u00a0\u3000"


def plain_message(c) -> Column:
    """A message as phrases are looked for in it: ASCII case and "_" folded, white space single."""
    single = F.btrim(F.regexp_replace(_c(c), f"[{_SPACES}]+", " "))
    return F.translate(single, _UPPER + "_", _LOWER + "-")


def message_mode(c, most: int = 20_000) -> Column:
    """"grill" if the phrase stands in the first or last part that is read, else "build"."""
    said = lambda part: plain_message(part).rlike("thai[- ]docx grill")
    return F.when(said(F.left(_c(c), F.lit(most))) | said(F.right(_c(c), F.lit(most))), "grill").otherwise("build")


#: The words that may follow the phrase, as regex alternatives: from, save to, only.
CLAUSES = {"from": ("from", "จาก"), "save_to": ("save to", "บันทึกเป็น"), "only": ("only", "เฉพาะ")}
_EN, _TH = ("|".join(pair[i] for pair in CLAUSES.values()) for i in (0, 1))
CLAUSE_RUN = f"(?i)thai[-_ ]docx grill((?: (?:(?:{_EN}) [^ ]+|(?:{_TH}) ?[^ ]+))*)"
LATER_CLAUSE = f"(?i) ((?:{_EN})(?: [^ ]+)?|(?:{_TH})(?: ?[^ ]+)?)(?: |$)"


def message_clauses(c) -> Column:
    """from, save_to, only: the words after a clause word that directly follows the phrase; unread: such a clause later on.

    Null where a message has none (or no phrase); of a repeated clause the first counts.
    """
    single = F.btrim(F.regexp_replace(_c(c), f"[{_SPACES}]+", " "))
    run = F.regexp_extract(single, CLAUSE_RUN, 1)
    after = F.regexp_extract(single, CLAUSE_RUN + "(.*)", 2)
    found = [F.nullif(F.regexp_extract(run, f"(?i) (?:{en} |{th} ?)([^ ]+)", 1), F.lit("")).alias(name) for name, (en, th) in CLAUSES.items()]
    return F.struct(*found, F.nullif(F.regexp_extract(after, LATER_CLAUSE, 1), F.lit("")).alias("unread"))


def message_language(c) -> Column:
    """The language most words of a message are in, the phrase aside; Thai on a tie."""
    words = F.split(F.regexp_replace(plain_message(c), "thai[- ]docx grill", ""), " ")
    thai = F.size(F.filter(words, lambda w: has_thai(w)))
    latin = F.size(F.filter(words, lambda w: w.rlike("[a-z]") & ~has_thai(w)))
    return F.when((thai > 0) & (thai >= latin), "th").otherwise("en")


def resolve_path(source, target) -> Column:
    """A relationship's target as a part name, relative to the folder of the source."""
    source, target = _c(source), _c(target)
    parts = F.split(source, "/")
    folder = F.when(F.startswith(target, F.lit("/")) | (F.size(parts) < 2), F.array().cast("array<string>")).otherwise(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))))
    step = lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(s.isin("", "."), acc).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(F.split(target, "/"), folder, step), "/")


# -- Arrow UDFs: what SQL has no function for ---------------------------------------


@F.pandas_udf(T.StringType())
def nfc_thai(texts: pd.Series) -> pd.Series:
    """NFC within Thai stretches only."""
    stretch = re.compile("[\u0e00-\u0e7f]+")
    return texts.map(lambda t: stretch.sub(lambda m: unicodedata.normalize("NFC", m[0]), t), na_action="ignore")


@F.pandas_udf(T.StringType())
def uri(links: pd.Series) -> pd.Series:
    """Percent-encoding of all that a URI may not carry as it is; "%" stays."""
    kept = frozenset(V.URI_AS_IS)
    return links.map(lambda t: "".join(c if c in kept else "".join(f"%{b:02X}" for b in c.encode()) for c in t), na_action="ignore")


_REFERENCE = re.compile(r"&(?:#[xX]([0-9a-fA-F]{1,6})|#([0-9]{1,7})|([A-Za-z][A-Za-z0-9]{1,31}));")
_ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])|" + _REFERENCE.pattern)


def decode_reference(hexa: str | None, decimal: str | None, name: str | None) -> str | None:
    """A character reference's text, or None for a name that there isn't."""
    if name:
        return html.entities.html5.get(name + ";")
    code = int(hexa, 16) if hexa else int(decimal)
    return "\ufffd" if code == 0 or code > 0x10FFFF or 0xD800 <= code <= 0xDFFF else chr(code)


def unescape_text(t: str) -> str:
    """Backslash escapes and character references decoded."""
    return _ESCAPED.sub(lambda m: m[1] or decode_reference(m[2], m[3], m[4]) or m[0], t)


@F.pandas_udf(T.StringType())
def unescape(texts: pd.Series) -> pd.Series:
    return texts.map(unescape_text, na_action="ignore")
