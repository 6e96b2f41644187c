"""Raw files to cleaned, stored and reconciled profiles."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from thermocline.operators.quality import clean, file_outcomes, with_day_order
from thermocline.session import durable, remove_path, scratch_path
from thermocline.sources.files import processed_name, read_csv_files, read_stored
from thermocline.sources.months import replace_sources, rows_of

COUNTS = ("rows_read", "rows_malformed", "rows_unparsed", "rows_dropped", "rows_rejected", "rows_kept")


def ingest_directory(spark: SparkSession, directory: str, output: str,
                     null_policy: str = "zero", jdbc: dict = None) -> DataFrame:
    """Clean every CSV file into Parquet, and into a database when ``jdbc`` options are given.

    Raw text is parsed once, into a staged table that the cleaned rows and all counts come from. Rows of an earlier run of
    the same file are replaced, also when the file keeps no row now; a file that cannot be used leaves what was stored.
    Returns one row per file: its error, rows read, malformed, with a time that could not be read, dropped, rejected, kept,
    found again in the output, and whether those agree.
    """
    staged = scratch_path(spark, "raw")
    summary = ingest_files(spark, read_csv_files(spark, directory), output, staged, null_policy)
    remove_path(spark, staged)
    if jdbc:
        from thermocline.sources.jdbc import write_jdbc
        write_jdbc(read_stored(spark, output), jdbc)
    return summary


def ingest_files(spark: SparkSession, found: tuple, output: str, staged: str, null_policy: str = "zero") -> DataFrame:
    """What `read_csv_files` found into the store, by way of tables below ``staged``; the counts of `ingest_directory`."""
    rows, files = found
    rows.write.mode("overwrite").parquet(f"{staged}/raw")
    raw = with_day_order(spark.read.parquet(f"{staged}/raw"))
    outcomes = file_outcomes(raw)
    summary = durable(files.join(outcomes, "source_name", "left").withColumns(
        {"source_name": processed_name(F.col("source_name")), **{c: F.coalesce(c, F.lit(0).cast("long")) for c in COUNTS}}))
    cleaned = clean(raw, null_policy).withColumn("source_name", processed_name(F.col("source_name")))
    replace_sources(cleaned, output, summary.where("error IS NULL"), f"{staged}/clean")
    return durable(verify(summary.drop("modified", "length"), rows_of(spark, output, summary.select("source_name"))))


def ingest_totals(summary: DataFrame) -> DataFrame:
    """One row for a run: files, files with an error, all counts, files that are not intact, and its status.

    The status is complete, partial if some files have errors or differ from the output, failed if all have, and empty
    without a file.
    """
    bad = F.col("error").isNotNull() | (F.col("intact") == 0)
    totals = summary.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("error").isNotNull()).alias("files_failed"),
                         *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in (*COUNTS, "rows_stored")],
                         F.count_if(bad).alias("files_not_intact"))
    return totals.withColumn("status", F.when(F.col("files") == 0, "empty").when(F.col("files_not_intact") == 0, "complete")
                             .when(F.col("files_not_intact") < F.col("files"), "partial").otherwise("failed"))


def verify(summary: DataFrame, stored: DataFrame) -> DataFrame:
    """Counts per file next to the rows found in the output."""
    found = stored.groupBy("source_name").agg(F.count(F.lit(1)).alias("rows_stored"))
    return (summary.join(found, "source_name", "left")
            .withColumn("rows_stored", F.coalesce("rows_stored", F.lit(0)))
            .withColumn("intact", (F.col("error").isNull() & (F.col("rows_stored") == F.col("rows_kept"))).cast("int")))
