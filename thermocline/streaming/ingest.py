"""Continuous ingest of arriving raw files."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from thermocline.operators.quality import clean
from thermocline.plans.ingest import ingest_files
from thermocline.session import path_exists, remove_path
from thermocline.sources.files import CSV_OPTIONS, csv_files, processed_name, read_csv_files
from thermocline.sources.months import sources


def stream_clean(spark: SparkSession, directory: str, columns, null_policy: str = "zero"):
    """Arriving CSV files through the same cleaning as a batch. ``columns`` is the header."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    raw = (spark.readStream.schema(schema).options(**CSV_OPTIONS)
           .option("pathGlobFilter", "*.csv").csv(directory)
           .withColumn("source_name", F.col("_metadata.file_name")))
    return clean(raw, null_policy)


def ingest_available(spark: SparkSession, directory: str, output: str, checkpoint: str, columns,
                     null_policy: str = "zero", timeout: int = None):
    """Process what has arrived since the last run, exactly once, and stop.

    ``output`` and ``checkpoint`` must be on storage that all executors share. Cleaning is row by
    row: no state is kept and no watermark is needed.
    """
    rows = stream_clean(spark, directory, columns, null_policy).withColumn(
        "source_name", processed_name(F.col("source_name")))
    query = (rows.writeStream.format("parquet").partitionBy("source_name")
             .option("path", output).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination(timeout)
    return query


NOTICES = "source_path string, modified timestamp, length long"
#: Files of one micro-batch.
BATCH_FILES = 1000


def announce(spark: SparkSession, directory: str, output: str, notices: str) -> None:
    """One notice for each CSV file that is new, or has another time or length than when it was stored.

    A file source remembers paths and never looks at a path again, so a file that arrives a second time needs a notice.
    Files with an error are announced again in each run, and read again.
    """
    stored = sources(spark, output).select("source_path", "modified", "length").distinct()
    due = _unlike(csv_files(spark, directory), stored).select("source_path", "modified", "length")
    due.write.mode("append").option("maxRecordsPerFile", BATCH_FILES).parquet(notices)


def _unlike(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose path, time and length are not those of a stored file."""
    same = [files[c].eqNullSafe(stored[c]) for c in ("source_path", "modified", "length")]
    return files.join(stored, same, "left_anti")


def apply_notices(notices: DataFrame, batch_id: int, output: str, state: str, null_policy: str = "zero") -> None:
    """One micro-batch: the files that its notices name, as they are now, in place of what was stored of them.

    Rows are staged under the batch's id. A batch that is delivered again finds its files stored with the same time and
    length and changes nothing; one that broke off finds them listed without, and does its work again. The paths of one
    batch, BATCH_FILES at most, pass through the driver.
    """
    spark = notices.sparkSession
    stored = sources(spark, output).select("source_path", "modified", "length").distinct()
    paths = [r.source_path for r in notices.select("source_path").distinct().collect()]
    paths = [p for p in paths if path_exists(spark, p)]
    if not paths:
        return
    due = [r.source_path for r in _unlike(csv_files(spark, paths), stored).collect()]
    if due:
        staged = f"{state}/staged/{batch_id}"
        ingest_files(spark, read_csv_files(spark, due), output, staged, null_policy)
        remove_path(spark, staged)


def ingest_changes(spark: SparkSession, directory: str, output: str, state: str, null_policy: str = "zero", timeout: int = None):
    """Process the files that arrived or changed since the last run, and stop; the store equals that of a batch run.

    ``state`` keeps notices and the stream's checkpoint, on storage that all executors share like ``output``. Any stream of
    notices (path, time, length) can take the place of the listing: ``apply_notices`` is its foreachBatch.
    """
    notices = f"{state}/notices"
    announce(spark, directory, output, notices)
    query = (spark.readStream.schema(NOTICES).option("maxFilesPerTrigger", 1).parquet(notices).writeStream
             .foreachBatch(lambda batch, batch_id: apply_notices(batch, batch_id, output, state, null_policy))
             .option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination(timeout)
    return query
