"""Corpus cleaning: language ID, near-duplicate join, substring dedup, decontamination, BPE.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), works on all
rows its predecessor kept and returns a DataFrame. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spendlens.llm import bpe, decontaminate, language_id, ngram_join, queries, suffix_dedup  # noqa: E402
from spendlens.session import ensure_checkpoint_dir, ship_package  # noqa: E402


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told (no letter in the text). The model
    learns from the rows outside the held-out quarter."""
    model = language_id.fit(docs, ~language_id.is_held_out())
    columns = docs.columns
    scored = language_id.predict(docs, model, keep=tuple(columns), names=("__lang", "__score"))
    return scored.where(F.col("__lang") != "und").select(*columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near-duplicates (five words, 0.8). Rows that
    share an id are judged each by its own text; rows equal in id and text stay or go together."""
    groups = ngram_join.similar_groups(docs, with_text_hash=True)
    copies = groups.where(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    same = (docs["doc_id"] == F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__hash"))
    return docs.join(copies, same, "left_anti").select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the byte strings of 50 or more that a document with a smaller doc_id holds too.
    A character that lost some of its bytes goes; n_chars counts what is left; a document
    that lost all stays with an empty text, and a null text stays null."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    marked = suffix_dedup.remove_repeats(docs.withColumn("__null", F.col("text").isNull()), keep=(*others, "__null"), names=CUT)
    kept = marked.withColumn("text", F.when(~F.col("__null"), whole_characters(F.col(CUT[2]))))
    kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def whole_characters(kept) -> Column:
    """The text of UTF-8 bytes of which some may be missing."""
    text = F.coalesce(F.try_validate_utf8(kept), F.make_valid_utf8(kept))
    return F.when(F.is_valid_utf8(kept), text).otherwise(F.replace(text, F.lit("\ufffd"), F.lit("")))


CUT = ("__bytes", "__spans", "__kept")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more repeats benchmark passages."""
    columns = docs.columns
    found = decontaminate.find_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=tuple(columns), names=("__words", "__matches"))
    bad = decontaminate.is_contaminated(F.col("__words"), decontaminate.hit_words("__matches"))
    return found.where(~bad).select(*columns)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every kept text, and the texts' round trip through them."""
    coded = bpe.encode_decode(docs, bpe.vocabulary(queries._bpe_path()))
    return queries.bpe_digests(coded)


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", one_of_each_group),
    ("suffix_dedup", without_repeats),
    ("decontaminate", decontaminated),
    ("bpe", tokenized),
]

#: SQL can't express the models, searches and merges of the stages; tests hold them
#: against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
