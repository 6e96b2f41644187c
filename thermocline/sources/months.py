"""Profiles stored by month, beside a table of the sources they came from, so that a source can be replaced.

`path` holds the rows in partitions (month, slot): month is that of the timestamp (202501, 0 without a time) and slot one of
SLOTS shares of the sources by a hash of their name. `path/_sources` lists, by slot, each source with the path, time and
length of its file and the rows it has in each month. One writer at a time; Spark's readers take `path` as it is.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from thermocline.schema import PROFILE_COLUMNS, PROFILE_SCHEMA
from thermocline.session import durable, path_exists, remove_path, scratch_path

#: A source that comes again rewrites its share of a month, not the month. Fixed for a store's life.
SLOTS = 16
LAYOUT = ["month", "slot"]
ROWS_SCHEMA = StructType([*PROFILE_SCHEMA, StructField("source_name", StringType()),
                          StructField("month", IntegerType()), StructField("slot", IntegerType())])
SOURCES_SCHEMA = "source_name string, source_path string, modified timestamp, length long, month int, rows long, slot int"
FILE_STATE = {"source_path": "string", "modified": "timestamp", "length": "long"}


def month_of(time: Column) -> Column:
    return F.coalesce(F.year(time) * 100 + F.month(time), F.lit(0)).cast("int")


def slot_of(source_name: Column) -> Column:
    return F.pmod(F.xxhash64(source_name), F.lit(SLOTS)).cast("int")


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows with source_name, month and slot; no rows when every source was emptied or nothing was stored."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], ROWS_SCHEMA)
    return spark.read.schema(ROWS_SCHEMA).parquet(path)


def sources(spark: SparkSession, path: str) -> DataFrame:
    """The table of sources: a row for each month of a source, one with a null month for a source without rows."""
    if not path_exists(spark, f"{path}/_sources"):
        return spark.createDataFrame([], SOURCES_SCHEMA)
    return spark.read.schema(SOURCES_SCHEMA).parquet(f"{path}/_sources")


def rows_of(spark: SparkSession, path: str, names: DataFrame) -> DataFrame:
    """Stored rows of the sources named in `source_name`; only partitions that hold one of them are read."""
    held = sources(spark, path).join(names, "source_name", "left_semi").where("month IS NOT NULL").select(LAYOUT).distinct()
    return stored_rows(spark, path).join(F.broadcast(held), LAYOUT, "left_semi").join(names, "source_name", "left_semi")


def replace_sources(rows: DataFrame, path: str, files: DataFrame = None, staged: str = None) -> None:
    """Store `rows`, the nine columns and source_name, in place of all that their sources had before.

    ``files`` names the sources that are replaced, also those that keep no row now, with what is known of their file
    (FILE_STATE); without it they are the sources of `rows`. Months and slots in which a replaced source had rows are
    written again without them, all other rows are only added. The table of sources first names old and new months
    together, without a file state, and the new ones alone at the end: a run that broke off is repaired by running it again,
    also when the file has changed meanwhile, and repeating a run changes nothing. Rows come from a table written to
    ``staged``, so a lost executor cannot change them. Driver: only partitions left empty, at most months x SLOTS.
    """
    spark = rows.sparkSession
    place = staged or scratch_path(spark, "incoming")
    name = F.coalesce("source_name", F.lit(""))
    (rows.select(*PROFILE_COLUMNS, name.alias("source_name"))
     .withColumns({"month": month_of(F.col("timestamp")), "slot": slot_of(F.col("source_name"))}).write.mode("overwrite").parquet(place))
    new = spark.read.schema(ROWS_SCHEMA).parquet(place)
    # Stored, as the maxima below are of texts: over the rows themselves each scan task would be sorted by source.
    counts = durable(new.groupBy("source_name", "month").agg(F.count(F.lit(1)).alias("rows")))
    listed = counts.select("source_name") if files is None else files.withColumn("source_name", name)
    known = [F.max(F.col(c) if c in listed.columns else F.lit(None).cast(t)).alias(c) for c, t in FILE_STATE.items()]
    listed = listed.groupBy("source_name").agg(*known)
    now = durable(listed.join(counts, "source_name", "left").select(
        "source_name", *FILE_STATE, "month", F.coalesce("rows", F.lit(0)).alias("rows"), slot_of(F.col("source_name")).alias("slot")))
    names = now.select("source_name").distinct()
    before = durable(sources(spark, path).join(names, "source_name", "left_semi"))
    touched = before.where("month IS NOT NULL").select(LAYOUT).distinct()
    unfinished = before.unionByName(now).withColumns({"modified": F.lit(None).cast("timestamp"), "length": F.lit(-1).cast("long")})
    _list(spark, path, names, unfinished.distinct())
    if touched.isEmpty():
        _write(new, path, "append")
    else:
        others = stored_rows(spark, path).join(F.broadcast(touched), LAYOUT, "left_semi").join(names, "source_name", "left_anti")
        _write(others.unionByName(new.join(F.broadcast(touched), LAYOUT, "left_semi")), path, "overwrite")
        _write(new.join(F.broadcast(touched), LAYOUT, "left_anti"), path, "append")
    _list(spark, path, names, now)
    left = sources(spark, path).where("month IS NOT NULL").select(LAYOUT)
    for r in touched.join(left, LAYOUT, "left_anti").toLocalIterator():
        remove_path(spark, f"{path}/month={r.month}/slot={r.slot}")
    if not staged:
        remove_path(spark, place)


def _write(rows: DataFrame, path: str, mode: str) -> None:
    """Rows to their partitions in files of even size, by time; a crowded partition is cut, small ones share a task."""
    (rows.hint("rebalance", *LAYOUT).sortWithinPartitions(*LAYOUT, "timestamp", "pressure_decibar").write.mode(mode)
     .option("partitionOverwriteMode", "dynamic").partitionBy(*LAYOUT).parquet(path))


def _list(spark: SparkSession, path: str, names: DataFrame, entries: DataFrame) -> None:
    """The entries in place of all that the named sources had in the table of sources."""
    slots = names.select(slot_of(F.col("source_name")).alias("slot")).distinct()
    others = sources(spark, path).join(F.broadcast(slots), "slot", "left_semi").join(names, "source_name", "left_anti")
    (others.unionByName(entries).hint("rebalance", "slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("slot").parquet(f"{path}/_sources"))
