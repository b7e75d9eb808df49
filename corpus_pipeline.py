"""From documents to training pieces: language, recurring lines, near-duplicates, mix, pieces.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept.
All but the last return the columns of ``documents``; the last one the pieces of
every mixed document.

Defined cases: a null or empty text, or one without a letter, goes in the first stage; of
rows that repeat, one stays after near-dedup (the smallest id of a group; rows without id
last); texts are worked on whole, whatever their length; a null source is a source of its
own; an empty table gives an empty one; further columns pass through to the last stage,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomleaf.llm import langid, linetree, mixing, nearcopies, unigram
from loomleaf.llm._common import free_name, materialise, release, scratch
from loomleaf.llm.queries import piece_model
from loomleaf.workspace import spread


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; what it rejects goes (no letters, or a narrow margin, as noise and other languages have)."""
    model = langid.learn_languages(docs.filter(~langid.held_out()))
    rejected = free_name(docs.columns, "rejected")
    names = (free_name(docs.columns, "lang_pred"), free_name(docs.columns, "score"), rejected)
    return langid.identify(docs, model, keep=tuple(docs.columns), names=names).filter(~F.col(rejected)).select(*docs.columns)


def _counted(left: DataFrame, docs: DataFrame) -> DataFrame:
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines whose template recurs; ``n_chars`` counts what is left."""
    return _counted(linetree.drop_recurring_lines(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more.

    Long lines that two of the documents left still share then stay in the first only.
    """
    with scratch(spark) as stay:
        stay.append(kept := materialise(nearcopies.drop_near_copies(docs)))
    return _counted(linetree.drop_repeated_lines(kept), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix draws, by document and epoch."""
    return mixing.mixed_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every mixed document."""
    return unigram.encode_texts(docs, piece_model(), keep=("doc_id", "lang", "source"))


STAGES = [("language ID", language), ("line dedup", recurring_lines), ("SimHash near-dedup", near_duplicates), ("mixing sources", mix), ("unigram pieces", pieces)]

#: Compression, hashing with a seed, permutations and the piece search have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of ``sf_dir``, each one's result written before the next reads it."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    *before, last = STAGES
    done = None
    for _, stage in before:
        with scratch(spark) as stay:
            stay.append(docs := materialise(stage(spark, docs, sf_dir)))
        if done is not None:
            release(done)
        done = docs
    return last[1](spark, docs, sf_dir)
