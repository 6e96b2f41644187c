"""File sources and sinks."""

import csv

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from thermocline.functions.curve import cell, z_order
from thermocline.schema import PROFILE_COLUMNS
from thermocline.sources.months import LAYOUT, month_of, replace_sources, stored_rows

CSV_OPTIONS = {"header": "true", "escape": '"', "enforceSchema": "false"}
RESULT_COLUMNS = ["chunk_id", "score", "timestamp", "latitude", "longitude", "basin",
                  "measurement_count", "source", "chunk_type"]


def processed_name(file_name: Column) -> Column:
    """Name of the cleaned copy of a raw file: extension dropped, _raw becomes _processed.

    A file that already has _processed in its name keeps all of it, so that no two files get one name.
    """
    stem = F.regexp_replace(file_name, r"\.[^.]*$", "")
    return F.when(F.contains(stem, F.lit("_processed")), file_name).otherwise(F.replace(stem, F.lit("_raw"), F.lit("_processed")))


def read_csv(spark: SparkSession, directory: str) -> DataFrame:
    """All ``*.csv`` files of a directory, every column as text, with the file they came from.

    Column names come from the header; a file with a different header is an error. `read_csv_files` takes any.
    """
    raw = (spark.read.options(**CSV_OPTIONS).option("pathGlobFilter", "*.csv").csv(directory))
    return raw.withColumn("source_name", F.col("_metadata.file_name"))


RAW_COLUMNS = [*PROFILE_COLUMNS, "source_name", "malformed"]


def csv_files(spark: SparkSession, where) -> DataFrame:
    """Every ``*.csv`` file of a directory, or of a list of paths: source_path, source_name, modified and length.

    Names come from the listing, empty files too; these have no time and no length.
    """
    names = [(p.replace("file:///", "file:/"),) for p in spark.read.option("pathGlobFilter", "*.csv").text(where).inputFiles()]
    listed = (spark.createDataFrame(names, "source_path string").select(_plain_path(F.col("source_path")).alias("source_path"))
              .withColumn("source_name", F.regexp_extract("source_path", "[^/]+$", 0)))
    if not names:
        return listed.selectExpr("*", "CAST(NULL AS timestamp) AS modified", "CAST(NULL AS long) AS length")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(where)
    state = found.select(F.replace("path", F.lit("file:///"), F.lit("file:/")).alias("source_path"), F.col("modificationTime").alias("modified"), "length")
    return listed.join(state, "source_path", "left")


def csv_headers(spark: SparkSession, where) -> DataFrame:
    """`csv_files` with the header of each, its first line that is not blank (null without), from its first block."""
    text = spark.read.option("pathGlobFilter", "*.csv").text(where)
    lines = (text.select(_plain_path(F.replace(F.col("_metadata.file_path"), F.lit("file:///"), F.lit("file:/"))).alias("source_path"),
                         F.col("_metadata.file_block_start").alias("start"), "value")
             .where((F.col("start") == 0) & (F.trim("value") != "")).withColumn("at", F.monotonically_increasing_id()))
    first = lines.groupBy("source_path").agg(F.min_by("value", "at").alias("header"))
    return csv_files(spark, where).join(first, "source_path", "left")


def _plain_path(path: Column) -> Column:
    """A path as readers take it, from the encoded form that listings have."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def header_names(header: str) -> list:
    """Column names of a header line, the one that raw files spell with a capital letter as it is stored."""
    names = next(csv.reader([header.lstrip("\ufeff")]), [])
    return [{"temperature_degC": "temperature_degc"}.get(n.strip(), n.strip()) for n in names]


def header_error(header: str) -> str:
    """What makes a file unusable as a whole, None if nothing does."""
    if header is None:
        return "the file has no header line"
    try:
        names = header_names(header)
    except csv.Error as e:
        return f"the header line cannot be read: {e}"
    if missing := [c for c in PROFILE_COLUMNS if c not in names]:
        return f"columns missing: {', '.join(missing)}"
    if twice := sorted({n for n in names if names.count(n) > 1 and n in PROFILE_COLUMNS}):
        return f"columns repeated: {', '.join(twice)}"
    return None


def read_csv_files(spark: SparkSession, where) -> tuple:
    """(rows, files): rows of all usable ``*.csv`` files of a directory or a list of paths as RAW_COLUMNS, and one row for
    each file with its time, length and `error`.

    Files are read by header, one typed read for each different one, so columns may stand in any order and further columns
    are left out. A file without the nine columns has an error and no rows; the others are read all the same. `malformed`
    marks rows with too few or too many fields.
    """
    found = csv_headers(spark, where)
    kinds = found.groupBy("header").agg(F.collect_list("source_path").alias("paths")).collect()
    schema = ", ".join([*[f"{c} string" for c in PROFILE_COLUMNS], "source_name string", "malformed boolean"])
    rows = spark.createDataFrame([], schema)
    errors = []
    for kind in kinds:
        error = header_error(kind.header)
        errors.append((kind.header, error))
        if error:
            continue
        names = header_names(kind.header)
        places = {c: names.index(c) for c in PROFILE_COLUMNS}
        fields = [StructField(f"c{i}", StringType()) for i in range(len(names))]
        read = (spark.read.schema(StructType([*fields, StructField("bad", StringType())]))
                .options(header="true", escape='"', enforceSchema="true", mode="PERMISSIVE", columnNameOfCorruptRecord="bad",
                         columnPruning="false").csv(kind.paths))
        rows = rows.unionByName(read.select(
            *[F.col(f"c{places[c]}").alias(c) for c in PROFILE_COLUMNS],
            _plain_path(F.substring_index("_metadata.file_path", "/", -1)).alias("source_name"),
            F.col("bad").isNotNull().alias("malformed")))
    named = spark.createDataFrame(errors, "header string, error string")
    files = found.join(named, found["header"].eqNullSafe(named["header"])).select("source_path", "source_name", "modified", "length", "error")
    return rows, files


def read_profiles(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    """Cleaned profiles; every profile column must be present.

    ``start`` (included) and ``end`` (excluded) bound the time; of a table that ``write_profiles`` wrote only their months
    are read.
    """
    df = spark.read.parquet(path)
    missing = [c for c in PROFILE_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    by_month = all(c in df.columns for c in LAYOUT)
    if start is not None:
        first = F.lit(start).cast("timestamp")
        df = df.filter((F.col("timestamp") >= first) & (F.col("month") >= month_of(first) if by_month else F.lit(True)))
    if end is not None:
        last = F.lit(end).cast("timestamp")
        df = df.filter((F.col("timestamp") < last) & (F.col("month") <= month_of(last) if by_month else F.lit(True)))
    return df.drop(*LAYOUT) if by_month else df


def row_limit(df: DataFrame, n: int, order=("timestamp", "pressure_decibar")) -> DataFrame:
    """The first n rows in a total order, for trial runs."""
    rest = [c for c in df.columns if c not in order]
    return df.orderBy(*order, *rest).limit(n) if n else df


def write_profiles(df: DataFrame, path: str) -> None:
    """Rows by month, in place of what their sources had before (`months.replace_sources`)."""
    replace_sources(df.withColumn("source_name", processed_name(F.col("source_name"))), path)


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_profiles`` stored, with source names; no rows when every source was emptied."""
    return stored_rows(spark, path).drop(*LAYOUT)


def write_clustered(df: DataFrame, path: str, order=("timestamp", "pressure_decibar"), curve=None, files: int = None,
                    row_group_bytes: int = 16 << 20, bloom=("cycle_number", "basin")) -> None:
    """Profiles laid out so that scans skip files and row groups.

    Without ``curve``, files cover disjoint ranges of ``order``, by default time; pressure is part of the range key to cut
    a crowded time. ``curve`` names two or three columns (say latitude, longitude and timestamp) whose Z-order takes the
    place of a range: a filter on any of them, or a box of all, meets few row groups by their minimum and maximum.
    Columns of ``bloom`` get a Bloom filter in each row group that has no full dictionary of them, so a search for one
    value skips groups whose range holds it by chance. ``files`` sets how many ranges are made, else Spark's setting.
    """
    keys = [_curve_key(df, curve)] if curve else []
    rest = ["latitude", "longitude"] if not curve else []
    # The order after the key settles ties, so a crowded place is cut too.
    by = [*keys, *[F.col(c) for c in order], *[F.col(c) for c in rest]]
    ranged = df.repartitionByRange(files, *by) if files else df.repartitionByRange(*by)
    writer = ranged.sortWithinPartitions(*keys, *order).write.mode("overwrite").option("parquet.block.size", row_group_bytes)
    for column in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(path)


#: Ends of the dimensions that have fixed ones.
CURVE_ENDS = {"latitude": (-90.0, 90.0), "longitude": (-180.0, 180.0)}


def _curve_key(df: DataFrame, columns) -> Column:
    """Z-order of the columns; ends that are not fixed come from one aggregate over the table."""
    def number(name):
        return F.col(name).cast("timestamp").cast("double") if dict(df.dtypes)[name].startswith("timestamp") else F.col(name).cast("double")

    free = [c for c in columns if c not in CURVE_ENDS]
    ends = dict(CURVE_ENDS)
    if free:
        found = df.agg(*[f(number(c)).alias(f"{f.__name__}_{c}") for c in free for f in (F.min, F.max)]).first()
        ends.update({c: (found[f"min_{c}"] or 0.0, found[f"max_{c}"] or 0.0) for c in free})
    return z_order(*[cell(number(c), *ends[c]) for c in columns])


def write_chunks_json(chunks: DataFrame, path: str, limit: int) -> None:
    """JSON lines with nested fields, the creation time and the size limit used."""
    (chunks.withColumns({"created_at": F.current_timestamp(), "chunk_size_limit": F.lit(limit)})
     .write.mode("overwrite").json(path))


def write_results(results: DataFrame, path: str, format: str = "json") -> None:
    """Retrieved chunks in full as JSON lines, or nine flat columns as CSV."""
    kind = format.lower()
    if kind == "json":
        results.write.mode("overwrite").json(path)
    elif kind == "csv":
        flat_results(results).write.mode("overwrite").option("header", "true").csv(path)
    else:
        raise ValueError(f"Unsupported export format: {format}")


def flat_results(results: DataFrame) -> DataFrame:
    return results.select(
        "chunk_id", "score", "timestamp", "metadata.latitude", "metadata.longitude", "metadata.basin",
        F.size("measurements").alias("measurement_count"), "source", "chunk_type")
