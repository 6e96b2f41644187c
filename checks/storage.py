"""Sources and sinks: what is written is what is read back."""

from pyspark.sql import functions as F

from checks.chunks import SQL_CHUNKS, chunks
from checks.fixture import RAW, SQL_PROFILES, SQL_RAW, SQL_TYPED, centroids, profiles, raw_files, raw_rows
from checks.quality import COMPLETE, FILLED, IN_RANGE, SECONDS, SEVEN, clean_profiles, with_seconds
from checks.registry import query
from checks.search import _IP, _RESULTS, _VISIBLE, SQL_INDEX, SQL_QUERIES, _ranked, index, results, stored_cells
from thermocline.operators import quality as Q
from thermocline.operators.vectors import exact_topk
from thermocline.plans.ingest import ingest_directory, ingest_totals
from thermocline.session import remove_path, scratch_path
from thermocline.sources import files, index as index_files
from thermocline.streaming.ingest import ingest_available, ingest_changes

_STORED = "replace(replace(source_name, '_raw.csv', '_processed'), '.csv', '') AS source_name"
_CLEANED = f"WITH {SQL_TYPED} SELECT {FILLED}, {_STORED}, {SECONDS} FROM typed WHERE {COMPLETE} AND {IN_RANGE}"


@query("src_csv", f"WITH {SQL_TYPED} SELECT {SEVEN}, {SECONDS} FROM typed")
def _(spark, sf_dir):
    raw = files.read_csv(spark, raw_files(spark, sf_dir, False))
    return with_seconds(Q.typed(Q.rename_temperature(raw)).drop("source_name"))


@query("src_parquet", f'WITH {SQL_PROFILES} SELECT {SEVEN}, "timestamp" AS observed_at FROM profiles')
def _(spark, sf_dir):
    path = scratch_path(spark, "profiles")
    profiles(spark, sf_dir).write.parquet(path)
    return files.read_profiles(spark, path).withColumnRenamed("timestamp", "observed_at")


@query("sink_parquet", _CLEANED)
def _(spark, sf_dir):
    path = scratch_path(spark, "cleaned")
    files.write_profiles(Q.clean(raw_rows(spark, sf_dir)), path)
    return with_seconds(files.read_profiles(spark, path))


@query("sink_parquet_again", _CLEANED)
def _(spark, sf_dir):
    """Ingesting the same sources twice replaces their rows."""
    path = scratch_path(spark, "cleaned")
    cleaned = Q.clean(raw_rows(spark, sf_dir))
    files.write_profiles(cleaned, path)
    files.write_profiles(cleaned, path)
    return with_seconds(files.read_profiles(spark, path))


@query("sink_parquet_months", f"""WITH {SQL_TYPED}, cleaned AS (SELECT {FILLED}, {_STORED}, "timestamp" AS t FROM typed WHERE {COMPLETE} AND {IN_RANGE})
SELECT year(t) * 100 + month(t) AS month, source_name, count(*) AS n, CAST(min(epoch_ms(t)) // 1000 AS bigint) AS first_second FROM cleaned
WHERE t >= TIMESTAMP '1995-03-10 00:00:00' AND t < TIMESTAMP '1996-01-01 00:00:00' GROUP BY ALL""")
def _(spark, sf_dir):
    """Stored profiles of a time range, whose months alone are read."""
    path = scratch_path(spark, "cleaned")
    files.write_profiles(Q.clean(raw_rows(spark, sf_dir)), path)
    found = files.read_profiles(spark, path, "1995-03-10", "1996-01-01")
    month = F.year("timestamp") * 100 + F.month("timestamp")
    return (found.groupBy(month.cast("long").alias("month"), "source_name")
            .agg(F.count(F.lit(1)).alias("n"), F.unix_seconds(F.min("timestamp")).alias("first_second")))


@query("profiles_ddl", f'WITH {SQL_PROFILES} SELECT {SEVEN}, "timestamp" AS observed_at FROM profiles WHERE "timestamp" >= TIMESTAMP \'1999-06-01 00:00:00\'')
def _(spark, sf_dir):
    """Profiles laid out by time, then read with a time filter."""
    path = scratch_path(spark, "clustered")
    files.write_clustered(profiles(spark, sf_dir), path)
    return (files.read_profiles(spark, path).filter("timestamp >= TIMESTAMP_NTZ '1999-06-01 00:00:00'")
            .withColumnRenamed("timestamp", "observed_at"))


_CURVE = ("latitude", "longitude", "timestamp")
_BOX = "latitude BETWEEN -20 AND 35 AND longitude BETWEEN -60 AND 20"


@query("profiles_ddl_box", f"""WITH {SQL_PROFILES} SELECT {SEVEN}, "timestamp" AS observed_at FROM profiles
WHERE {_BOX} AND "timestamp" >= TIMESTAMP '1995-01-01 00:00:00' AND "timestamp" < TIMESTAMP '1997-01-01 00:00:00'""")
def _(spark, sf_dir):
    """Profiles laid out along a curve through place and time, then read by a box and a time range."""
    path = scratch_path(spark, "curve")
    files.write_clustered(profiles(spark, sf_dir), path, curve=_CURVE, files=16)
    inside = "timestamp >= TIMESTAMP_NTZ '1995-01-01 00:00:00' AND timestamp < TIMESTAMP_NTZ '1997-01-01 00:00:00'"
    return files.read_profiles(spark, path).filter(f"{_BOX} AND {inside}").withColumnRenamed("timestamp", "observed_at")


@query("profiles_ddl_cycle", f"""WITH {SQL_PROFILES} SELECT {SEVEN}, "timestamp" AS observed_at FROM profiles WHERE cycle_number = 417""")
def _(spark, sf_dir):
    """The same layout, read by one cycle."""
    path = scratch_path(spark, "curve")
    files.write_clustered(profiles(spark, sf_dir), path, curve=_CURVE, files=16)
    return files.read_profiles(spark, path).filter("cycle_number = 417").withColumnRenamed("timestamp", "observed_at")


@query("q_reconcile", f"""WITH {SQL_TYPED}, kept AS (SELECT count(*) AS n FROM typed WHERE {COMPLETE} AND {IN_RANGE})
SELECT n AS processed_rows, n AS stored_rows, n AS exported_rows, CAST(0 AS bigint) AS stored_shortfall, CAST(0 AS bigint) AS exported_shortfall, 1 AS passed FROM kept""")
def _(spark, sf_dir):
    stored, exported = scratch_path(spark, "stored"), scratch_path(spark, "exported")
    cleaned = Q.clean(raw_rows(spark, sf_dir))
    files.write_profiles(cleaned, stored)
    files.write_clustered(files.read_profiles(spark, stored), exported)
    return Q.reconcile(cleaned, files.read_profiles(spark, stored), files.read_profiles(spark, exported))


@query("q_ingest_run", f"""WITH {SQL_TYPED} SELECT count(*) AS rows_read, count(*) FILTER (WHERE NOT ({COMPLETE})) AS rows_dropped,
count(*) FILTER (WHERE {COMPLETE} AND NOT ({IN_RANGE})) AS rows_rejected, count(*) FILTER (WHERE {COMPLETE} AND {IN_RANGE}) AS rows_stored, 1 AS intact FROM typed""")
def _(spark, sf_dir):
    """CSV files to stored profiles, totals over all files."""
    summary = ingest_directory(spark, raw_files(spark, sf_dir, False), scratch_path(spark, "stored"))
    return summary.agg(*[F.sum(c).alias(c) for c in ("rows_read", "rows_dropped", "rows_rejected", "rows_stored")],
                       F.min("intact").alias("intact"))


_TOKENS = ", ".join(f"'{t}'" for t in Q.NULL_TOKENS)


@query("q_ingest_errors", f"""WITH {SQL_RAW}, {SQL_TYPED} SELECT CAST(6 AS bigint) AS files, CAST(3 AS bigint) AS files_failed, count(*) + 4 AS rows_read, CAST(1 AS bigint) AS rows_malformed,
(SELECT count(*) FROM raw WHERE trim("timestamp") NOT IN ({_TOKENS})) - count("timestamp") + 1 AS rows_unparsed, count(*) FILTER (WHERE {COMPLETE} AND {IN_RANGE}) + 2 AS rows_kept, count(*) FILTER (WHERE {COMPLETE} AND {IN_RANGE}) + 2 AS rows_stored,
CAST(3 AS bigint) AS files_not_intact, 'partial' AS status FROM typed""")
def _(spark, sf_dir):
    """A run over files with columns in another order, one column more, a truncated row, and files that cannot be used."""
    folder = scratch_path(spark, "mixed")
    rows = raw_rows(spark, sf_dir).drop("source_name")
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(2)) == 0
    _one_csv(rows.filter(part), f"{folder}/plain_raw.csv")
    _one_csv(rows.filter(~part).withColumn("ship", F.lit("x")).select("ship", *reversed(rows.columns)), f"{folder}/turned_raw.csv")
    good = "1,2024-02-01 00:00:00,3,s,1,2,3,4,5"
    head = "basin,timestamp,cycle_number,vertical_sampling_scheme,longitude,latitude,pressure_decibar,salinity_psu,temperature_degC"
    for name, text in {"cut_raw.csv": f"{head}\n{good}\n1,13/02/2024 07:30 PM,3,s,1,2,3,4,5\n1,some day,3,s,1,2,3,4,5\n1,2024-02-01,3,s,1,2\n",
                       "short_raw.csv": "basin,timestamp\n1,2024-02-01\n", "empty_raw.csv": "", "junk_raw.csv": "\x00\x01,\"\n\x02"}.items():
        _put(spark, f"{folder}/{name}", text)
    totals = ingest_totals(ingest_directory(spark, folder, scratch_path(spark, "stored")))
    return totals.select("files", "files_failed", "rows_read", "rows_malformed", "rows_unparsed", "rows_kept", "rows_stored", "files_not_intact", "status")


def _one_csv(rows, target):
    """Rows as one CSV file: lines are made by all tasks, and one task only puts them after each other below the header."""
    spark, parts, whole = rows.sparkSession, scratch_path(rows.sparkSession, "lines"), scratch_path(rows.sparkSession, "whole")
    rows.write.option("header", False).option("escape", '"').csv(parts)
    _put(spark, f"{parts}-header", ",".join(rows.columns) + "\n")
    header, lines = (spark.read.option("lineSep", "\n").text(p) for p in (f"{parts}-header", parts))
    header.union(lines).coalesce(1).write.option("lineSep", "\n").text(whole)
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(whole)
    files = found.getFileSystem(spark._jsc.hadoopConfiguration())
    place = spark._jvm.org.apache.hadoop.fs.Path(target)
    files.mkdirs(place.getParent())
    if not files.rename(files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{whole}/part-*"))[0].getPath(), place):
        raise OSError(f"{target} could not be written")
    for path in (parts, f"{parts}-header", whole):
        remove_path(spark, path)


def _put(spark, path, text):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    out.write(bytearray(text.encode()))
    out.close()


@query("st_ingest", f"WITH {SQL_TYPED} SELECT {FILLED}, {SECONDS} FROM typed WHERE {COMPLETE} AND {IN_RANGE}")
def _(spark, sf_dir):
    """The same files through the stream: equal to the batch."""
    output = scratch_path(spark, "streamed")
    ingest_available(spark, raw_files(spark, sf_dir, False), output, scratch_path(spark, "stream-state"), list(RAW))
    return with_seconds(files.read_profiles(spark, output).drop("source_name"))


@query("st_ingest_changes", f"WITH {SQL_TYPED} SELECT {FILLED}, {SECONDS} FROM typed WHERE {COMPLETE} AND {IN_RANGE}")
def _(spark, sf_dir):
    """A stream to which one file comes again: first with a single other row, then as it should be. Equal to the batch."""
    raw, folder = raw_files(spark, sf_dir, False), scratch_path(spark, "arriving")
    paths = sorted(spark.read.option("pathGlobFilter", "*.csv").text(raw).inputFiles())
    for i, path in enumerate(paths[1:], 1):
        _copy(spark, path, f"{folder}/part{i}_raw.csv")
    _put(spark, f"{folder}/part0_raw.csv", ",".join(RAW) + "\n1,2031-02-01 00:00:00,3,s,1,2,3,4,5\n")
    output, state = scratch_path(spark, "streamed"), scratch_path(spark, "stream-state")
    ingest_changes(spark, folder, output, state)
    _copy(spark, paths[0], f"{folder}/part0_raw.csv")
    ingest_changes(spark, folder, output, state)
    return with_seconds(files.read_profiles(spark, output).drop("source_name"))


def _copy(spark, source, target):
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    a, b = hadoop.Path(spark._jvm.java.net.URI(source)), hadoop.Path(target)
    hadoop.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)


@query("sink_chunks_json", f"""WITH {SQL_CHUNKS} SELECT chunk_id, timestamp_text, basin, latitude, sub_chunk_info, chunk_type,
CAST(len(ms) AS int) AS n, ms[1].p AS first_pressure, ms[len(ms)].s AS last_salinity, 2000 AS chunk_size_limit FROM chunks""")
def _(spark, sf_dir):
    path, rows = scratch_path(spark, "chunks"), chunks(spark, sf_dir)
    files.write_chunks_json(rows, path, 2000)
    back = spark.read.schema(f"{rows._jdf.schema().toDDL()}, created_at timestamp, chunk_size_limit int").json(path)
    return back.filter("created_at is not null").select(
        "chunk_id", F.col("timestamp").alias("timestamp_text"), "metadata.basin", "metadata.latitude",
        "metadata.sub_chunk_info", "chunk_type", F.size("measurements").alias("n"),
        F.element_at("measurements", 1)["pressure_decibar"].alias("first_pressure"),
        F.element_at("measurements", -1)["salinity_psu"].alias("last_salinity"), "chunk_size_limit")


@query("sink_chunks_json_readings", f"""WITH {SQL_CHUNKS} SELECT chunk_id, CAST(i AS int) AS position, ms[i].p AS pressure_decibar,
ms[i].t AS temperature_degc, ms[i].s AS salinity_psu FROM (SELECT chunk_id, ms, unnest(range(1, len(ms) + 1)) AS i FROM chunks) u""")
def _(spark, sf_dir):
    """Every reading of every chunk, in its place."""
    path, rows = scratch_path(spark, "chunks"), chunks(spark, sf_dir)
    files.write_chunks_json(rows, path, 2000)
    back = spark.read.schema(rows.schema).json(path).filter("chunk_id is not null")
    return back.select("chunk_id", F.posexplode("measurements").alias("at", "m")).select(
        "chunk_id", (F.col("at") + 1).alias("position"), "m.pressure_decibar", "m.temperature_degc", "m.salinity_psu")


_INDEX_ROWS = f"""WITH {SQL_CHUNKS}, {SQL_INDEX} SELECT chunk_id, timestamp_text, basin, cycle_number, latitude, longitude, chunk_type,
CAST(len(ms) AS int) AS readings, round(list_sum(list_transform(v, lambda x, i: x * i)), 6) AS vector_mark FROM idx"""


def _index_rows(rows):
    marked = F.transform("embedding", lambda x, i: x.cast("double") * (i + 1))
    mark = F.aggregate(marked, F.lit(0.0), lambda total, x: total + x)
    return rows.select("chunk_id", F.col("timestamp").alias("timestamp_text"), "metadata.basin", "metadata.cycle_number",
                       "metadata.latitude", "metadata.longitude", "chunk_type", F.size("measurements").alias("readings"),
                       F.round(mark, 6).alias("vector_mark"))


@query("sink_index_rows", _INDEX_ROWS)
def _(spark, sf_dir):
    """What an index holds once it is written: every vector beside its own metadata."""
    path = scratch_path(spark, "index")
    index_files.write_index(index(spark, sf_dir), path, model="given")
    return _index_rows(index_files.load_index(spark, path))


@query("sink_index_cells_rows", _INDEX_ROWS)
def _(spark, sf_dir):
    """The same of an index stored by cell."""
    return _index_rows(stored_cells(spark, sf_dir)[0])


@query("sink_index", f"""WITH {SQL_CHUNKS}, {SQL_INDEX} SELECT count(*) AS total_vectors, CAST(max(len(v)) AS int) AS vector_dimension,
'exact' AS index_type, 'given' AS embedding_model FROM idx""")
def _(spark, sf_dir):
    path = scratch_path(spark, "index")
    index_files.write_index(index(spark, sf_dir), path, model="given")
    return index_files.load_info(spark, path).drop("created_at")


@query("src_chunk_index", f"WITH {SQL_CHUNKS}, {SQL_QUERIES}, {SQL_INDEX} {_VISIBLE.format(key='chunk_id')} ({_ranked(_IP, 'DESC', 5, 'idx', 'chunk_id')}) z")
def _(spark, sf_dir):
    """An index written, loaded again and searched."""
    path = scratch_path(spark, "index")
    index_files.write_index(index(spark, sf_dir), path, model="given")
    found = exact_topk(index_files.load_index(spark, path), centroids(spark, sf_dir), 5)
    return found.withColumn("score", F.round("score", 6))


@query("sink_results", f"""{_RESULTS} SELECT chunk_id, round(score, 4) AS score, strftime(ts, '%Y-%m-%d %H:%M:%S') AS observed, latitude, longitude, basin,
CAST(len(ms) AS int) AS measurement_count, source, chunk_type FROM found""")
def _(spark, sf_dir):
    path = scratch_path(spark, "results")
    files.write_results(results(spark, sf_dir), path, "csv")
    schema = ("chunk_id string, score double, observed string, latitude double, longitude double, basin int, "
              "measurement_count int, source string, chunk_type string")
    return spark.read.schema(schema).option("header", True).csv(path).withColumn("score", F.round("score", 4))


@query("sink_results_json", f"""{_RESULTS} SELECT query_id, chunk_id, CAST(r AS int) AS rank, round(score, 4) AS score, preview AS text, latitude FROM found""")
def _(spark, sf_dir):
    path, rows = scratch_path(spark, "results"), results(spark, sf_dir)
    files.write_results(rows, path)
    back = spark.read.schema(rows._jdf.schema().toDDL()).json(path)
    return back.select("query_id", "chunk_id", "rank", F.round("score", 4).alias("score"), "text", "metadata.latitude")


@query("sql_schema_info", f"""WITH {SQL_PROFILES} SELECT column_name, data_type, total FROM (VALUES ('basin', 'int'), ('timestamp', 'timestamp'), ('cycle_number', 'int'),
('vertical_sampling_scheme', 'string'), ('longitude', 'double'), ('latitude', 'double'), ('pressure_decibar', 'double'), ('salinity_psu', 'double'),
('temperature_degc', 'double')) AS t(column_name, data_type), (SELECT count(*) AS total FROM profiles WHERE pressure_decibar >= 0) c""")
def _(spark, sf_dir):
    """Columns and types of the registered view, with its number of rows."""
    from thermocline.operators.sqlguard import register_views, schema_info
    rows = clean_profiles(spark, sf_dir)
    register_views(spark, rows.withColumn("timestamp", F.col("timestamp").cast("timestamp")))
    total = rows.agg(F.count(F.lit(1)).alias("total")).scalar()
    info = schema_info(spark).filter("table_name = 'profiles'")
    return info.select("column_name", "data_type").withColumn("total", total)
