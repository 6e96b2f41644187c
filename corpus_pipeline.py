"""The corpus pipeline: five stages over `documents`, each one operator of thermocline.llm on all that was kept.

Stages before the last return the columns doc_id, text, lang, source and n_chars.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from thermocline.llm import bpe, language, line_dedup, mixing, simhash  # noqa: E402
from thermocline.llm.common import NO_ID  # noqa: E402
from thermocline.llm.queries import word_bpe  # noqa: E402
from thermocline.session import remove_path, scratch_path, tune  # noqa: E402

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: No document is passed over more than this often when sources are mixed.
MOST_PASSES = 2.0


def _row_key(docs: DataFrame) -> DataFrame:
    """documents with what joins decisions to rows: a null-free id and a hash of the text."""
    return docs.select(*COLUMNS).withColumns({
        "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "_key": F.xxhash64(F.coalesce("text", F.lit("")))})


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language, with `lang` as predicted from the text; null texts and texts without a letter go.

    A model of no language at all rejects nothing and leaves lang alone, as it cannot tell.
    """
    tune(spark)
    return language.keep(docs.select(*COLUMNS), language.train(docs)).select(*COLUMNS)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that three or more documents share, but for one holder of each line.

    A document that loses all its lines stays, with an empty text. n_chars is that of the new text.
    """
    tune(spark)
    rows = line_dedup.dedup_rows(docs.select(*COLUMNS))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each component of fingerprints within four bits; rows as they came.

    Rows that share that id all stay.
    """
    tune(spark)
    kept = (simhash.near_dedup(docs, width=4, radius=4).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id")).distinct())
    return _row_key(docs).join(kept, "_id", "left_semi").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and documents of small sources again, so that sources get temperature weights.

    The budget is the least that passes every source once, and no document comes more often than MOST_PASSES. Rows are in
    the order of the mixture: ranges of positions, so that every prefix of the written files holds the sources in
    proportion.
    """
    tune(spark)
    draws = (mixing.draw(docs, max_repeat=MOST_PASSES)
             .select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.col("text_key").alias("_key"), F.col("source").alias("_source"),
                     "position", "block", "draw"))
    rows = _row_key(docs)
    same = (rows["_id"] == draws["_id"]) & (rows["_key"] == draws["_key"]) & rows["source"].eqNullSafe(draws["_source"])
    return rows.join(draws, same).orderBy("position", "_source", "block", "draw", rows["_id"], rows["_key"]).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to, a row for each row."""
    return bpe.encode(docs, word_bpe(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("language", identify_language),
    ("line_dedup", drop_shared_lines),
    ("near_dedup", drop_near_duplicates),
    ("mix", mix_sources),
    ("encode", encode),
]

#: SQL has no SimHash, no fitted language model and no BPE; tests compare each stage and the whole run with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written as Parquet in the shared folder and read by the next.

    A stage's table is removed once the next one's is written; that of the last stage but one stays, as the result is read
    from it.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
