"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Stands for a null doc_id inside an operator, so that joins and minima treat it as one id below all others.
NO_ID = -(2 ** 63)
#: White space of the contracts, as a character class body and as bytes.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever else the input carries: null ids become NO_ID, null texts empty."""
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("doc_id"),
                       F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))


def public_id(column="doc_id") -> Column:
    """The id as callers know it."""
    return F.nullif(F.col(column), F.lit(NO_ID))


def held_out(doc_id: Column) -> Column:
    """True for ids whose crc32, of the id as text, leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
