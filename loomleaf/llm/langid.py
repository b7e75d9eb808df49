"""Language identification by compression (operator 6).

For each language a dictionary of plain text is put together from labelled
documents; a text is compressed with every language's dictionary as raw zstandard
content, and the smallest result names the language.  Text is lower-cased and
reduced to letters and single spaces first, and compressed whole, in pieces short
enough that each leans on the dictionary rather than on what came before it.  A
marker that ends every dictionary opens every piece, so that short pieces are
compressed blocks too and their sizes tell languages apart.

The score is how much smaller the best result is than the second, as a share of
the second.  A text is rejected when that margin is narrower than ``min_margin``.
Noise and languages not learned lie below the default, labelled texts above it; sizes
are whole bytes, so below 50 of them a lead of one byte passes.  Equal sizes go to the language with more labelled rows.

Bounded parameters: dictionaries hold ``dictionary_bytes`` per language, taken
from at most ``sample_texts`` distinct labelled texts chosen by hash, of each a passage
of at most ``sample_chars`` characters that starts at a place chosen by hash; counts of
labels cover all rows.  At most ``max_languages`` dictionaries are broadcast and loaded at
a time: a longer list is judged group after group, each pass carrying the two smallest
sizes so far, with the same result.

Defined cases: text null or without a letter gives "und", score 0, rejected; with
one language the score is 1; with none learned everything is "und"; only text
decides, so repeated rows get equal results; unlabelled rows teach nothing, nor do
labelled texts without a letter; an empty table gives an empty one, and one without labelled
rows a model of no language; texts are compressed whole, whatever their length; columns
kept may have any names: new ones are underscored until they clash with none.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bounded_batches, free_name, hash_bound, slices

DICTIONARY_BYTES, SAMPLE_TEXTS, SAMPLE_CHARS, MAX_LANGUAGES = 262_144, 256, 4096, 200
LEVEL, PIECE, MIN_MARGIN, UNKNOWN = 6, 2048, 0.02, "und"
_MARK = bytes(range(1, 32)) * 3
#: All but letters and the marks that combine with them, as the vowel signs of many scripts do.
_OTHER, _OTHER_ASCII = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"[^a-z]+")
_NO_SIZE = 1 << 62


def plain_letters(text: str) -> str:
    """Lower-cased letters with single spaces around and between words; empty if there is no letter."""
    low = text.lower()
    kept = (_OTHER_ASCII if low.isascii() else _OTHER).sub(" ", low).strip()
    return f" {kept} " if any(map(str.isalpha, kept)) else ""


@dataclass
class LanguageModel:
    """Languages in order of preference among equals, and the dictionary of each."""

    languages: list[str]
    dictionaries: list[bytes]
    level: int = LEVEL
    piece: int = PIECE
    min_margin: float = MIN_MARGIN

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for content in self.dictionaries:
            shape = zstandard.ZstdCompressionParameters.from_level(self.level, dict_size=len(content), source_size=self.piece, write_content_size=False, write_checksum=False, write_dict_id=False)
            known = zstandard.ZstdCompressionDict(content + _MARK, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=shape)
            out.append(zstandard.ZstdCompressor(dict_data=known, compression_params=shape))
        return out

    def groups(self, most: int = MAX_LANGUAGES) -> list[LanguageModel]:
        """The model in parts of at most ``most`` languages, in order."""
        cut = lambda x: [x[at : at + most] for at in range(0, len(x), most)]
        return [LanguageModel(names, contents, self.level, self.piece, self.min_margin) for names, contents in zip(cut(self.languages), cut(self.dictionaries), strict=True)]

    def sizes(self, text: str | None, compressors: list) -> list[int]:
        """The compressed size under every language; none for a text without a letter."""
        data = plain_letters(text or "").encode()
        if not data:
            return []
        pieces = [_MARK + data[at : at + self.piece] for at in range(0, len(data), self.piece)]
        return [sum(len(c.compress(p)) for p in pieces) for c in compressors]

    def judge(self, text: str | None, compressors: list) -> tuple[str, float, bool]:
        """Language, score, rejected."""
        return self.verdict(*leading(self.sizes(text, compressors), self.languages))

    def verdict(self, language: str | None, best: int, second: int) -> tuple[str, float, bool]:
        """Language, score and rejected from the smallest size, its language and the next size."""
        if language is None:
            return UNKNOWN, 0.0, True
        if second == _NO_SIZE:
            return language, 1.0, False
        score = (second - best) / second
        return language, score, score < self.min_margin


def leading(sizes: list[int], languages: list[str], so_far: tuple = (None, _NO_SIZE, _NO_SIZE)) -> tuple[str | None, int, int]:
    """The language of the smallest size (the first of equal ones), that size and the next, also counting ``so_far``."""
    name, best, second = so_far
    for language, size in zip(languages, sizes, strict=False):
        if size < best:
            name, best, second = language, size, best
        else:
            second = min(second, size)
    return name, best, second


def learn_languages(df: DataFrame, text: str = "text", lang: str = "lang", dictionary_bytes: int = DICTIONARY_BYTES, sample_texts: int = SAMPLE_TEXTS, sample_chars: int = SAMPLE_CHARS, **model) -> LanguageModel:
    """Learn from the rows of ``df`` whose ``lang`` isn't null.

    Copies of one text count once in the sample: it takes the distinct texts with
    the smallest hashes.  Only hashes below a bound leave a task, by a share of a language's rows
    that is raised until there are enough texts.
    """
    known = F.col(lang).isNotNull() & F.col(text).isNotNull()
    rows = df.filter(known).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h")).filter(F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect() if r["lang"] != UNKNOWN}
    share, texts = {x: min(1.0, 4 * sample_texts / n) for x, n in counts.items()}, {}
    spare = F.greatest(F.length("text") - sample_chars, F.lit(0))
    passage = F.substring(F.col("text"), F.pmod(F.xxhash64(F.lit("place"), "h"), spare + 1).cast("int") + 1, F.lit(sample_chars))
    while open_ := [x for x in counts if x not in texts]:
        upto = F.create_map(*(F.lit(v) for x in open_ for v in (x, hash_bound(share[x]))))
        low = rows.filter(F.col("lang").isin(open_) & (F.col("h") <= upto[F.col("lang")])).groupBy("lang", "h").agg(F.count("*").alias("copies"))
        bounds = {r["lang"]: (r["n"], r["hs"]) for r in low.groupBy("lang").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("h")).alias("hs")).select("lang", "n", F.slice("hs", 1, sample_texts).alias("hs")).collect()}
        done = [x for x in open_ if share[x] >= 1 or bounds.get(x, (0, []))[0] >= sample_texts]
        for x in set(open_) - set(done):
            share[x] = min(1.0, share[x] * 16)
        if not done:
            continue
        last = F.create_map(*(F.lit(v) for x in done for v in (x, bounds[x][1][-1])))
        for x in done:
            texts[x] = {}
        for r in rows.filter(F.col("lang").isin(done) & (F.col("h") <= last[F.col("lang")])).groupBy("lang", "h").agg(F.min(passage).alias("text")).collect():
            texts[r["lang"]][r["h"]] = r["text"]
    names = sorted(texts, key=lambda x: (-counts[x], x))
    contents = {x: "".join(plain_letters(t) for _, t in sorted(texts[x].items())).encode()[:dictionary_bytes] for x in names}
    names = [x for x in names if contents[x]]
    return LanguageModel(names, [contents[x] for x in names], **model)


def identify(df: DataFrame, model: LanguageModel, text: str = "text", keep: tuple = (), names: tuple = ("lang_pred", "score", "rejected"), max_languages: int = MAX_LANGUAGES) -> DataFrame:
    """``keep`` columns with the language, the score and whether the margin is too narrow."""
    spark, parts = df.sparkSession, model.groups(max_languages) or [model]
    inner = free_name(keep, "judged_text")
    bounded_batches(spark)
    out = [free_name(keep, n) for n in names]
    state = [T.StructField(n, k) for n, k in zip(out, (T.StringType(), T.LongType(), T.LongType()), strict=True)]
    final = [T.StructField(n, k) for n, k in zip(out, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True)]
    rows = df.select(*keep, F.col(text).cast("string").alias(inner))
    width = len(rows.columns)
    for i, part in enumerate(parts):
        shared, first, last = spark.sparkContext.broadcast(part), i == 0, i == len(parts) - 1
        schema = T.StructType([*rows.schema.fields[: width - last], *(final if last else state)])

        def run(batches, shared=shared, first=first, last=last, schema=schema):
            known = shared.value.compressors()
            kinds = (pa.string(), pa.float64(), pa.bool_()) if last else (pa.string(), pa.int64(), pa.int64())
            for batch in slices(batches):
                before = [(None, _NO_SIZE, _NO_SIZE)] * batch.num_rows if first else zip(*(batch.column(width + j).to_pylist() for j in range(3)), strict=True)
                found = [leading(shared.value.sizes(x.as_py(), known), shared.value.languages, b) for x, b in zip(batch.column(width - 1), before, strict=True)]
                found = [shared.value.verdict(*f) for f in found] if last else found
                columns = [pa.array([f[j] for f in found], kind) for j, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: width - last], *columns], names=schema.names)

        rows = rows.mapInArrow(run, schema)
    return rows


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept out of learning: crc32 of the id as text leaves 2 when divided by 4 (a null id is not held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
