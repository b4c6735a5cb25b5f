"""The corpus pipeline: quality rules, line dedup, near-dedup, source mix, tokens.

Each stage takes (spark, docs, sf_dir) with the columns of ``documents``, works on all rows its predecessor
kept and returns those columns again; the last returns the encoded corpus. ``run`` writes each stage as
Parquet in the shared folder and reads it back for the next.

All stages: columns beyond those of ``documents`` are left out, whatever their names; rows without id, source or language
are rows like others, and rows that repeat are judged each; an empty table gives an empty result; texts of any length are
read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acopio.llm import bpe, line_dedup, mixing, quality, simhash
from acopio.llm.common import table
from acopio.session import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIX_BLOCK = 256    # words of a block of the mix

#: None: the mix's seeded order and the encoder have no SQL form; tests hold ``run`` against plain Python.
ORACLE_SQL = None


def _with_text(rows: DataFrame, text: str) -> DataFrame:
    return rows.select("doc_id", F.col(text).alias("text"), "lang", "source", F.length(text).cast("bigint").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose their failing lines. A null or empty text has no words and is rejected."""
    judged = quality.judge_rows(docs.select(*COLUMNS)).where("kept")
    return _with_text(judged, "clean_text")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines go from all documents but the one with the largest id; a document left without a word goes, a null
    text too."""
    cleaned = line_dedup.dedup(docs.select(*COLUMNS)).where(mixing.n_tokens(F.col("kept_text")) > 0)
    return _with_text(cleaned, "kept_text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (``op2``'s fingerprints and bits) one row stays, the one with the smallest id.

    Rows are judged each, whatever their id: texts that share an id are kept unless they are near-duplicates.
    """
    return simhash.one_of_each(docs.select(*COLUMNS))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of the chosen blocks, a row for each time a document or a part of it is taken. Documents without words
    are absent; a null source is a source of its own. Reruns give the same rows."""
    mixed = mixing.mixed_texts(mixing.plan(docs.select(*COLUMNS), block=MIX_BLOCK), block=MIX_BLOCK)
    return _with_text(mixed, "text")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, decoded): the token ids of every row of the mix and the text they decode to; a null text has none
    and decodes to an empty one."""
    return bpe.round_trip(docs, bpe.word_vocabulary())


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup_stage), ("near dedup", near_dedup),
          ("source mix", source_mix), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
