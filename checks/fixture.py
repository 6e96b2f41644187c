"""Inputs of the registered queries: ocean profiles projected from the given tables.

Each input is a list of SQL expressions that mean the same in Spark and in an ANSI engine.
"""

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from thermocline.session import scratch_path
from thermocline.sources.files import CSV_OPTIONS

_LON = "CAST((l_partkey * 37) % 3600 AS double) / 1e1 - 1.8e2"
_LAT = "CAST((l_suppkey * 53) % 1800 AS double) / 1e1 - 9e1"
_PRESSURE = "floor(l_extendedprice) / 5e1 - 1e2"
_SALINITY = "CASE WHEN l_tax > 0 THEN 3e1 + round(l_discount * 100) END"
_TEMPERATURE = "CASE WHEN l_linenumber < 7 THEN 2.5e1 - l_quantity / 2e0 END"
_SCHEME = "CASE l_returnflag WHEN 'R' THEN 'Primary sampling' WHEN 'A' THEN 'Secondary sampling' END"

PROFILES = {
    "basin": "CAST(l_suppkey % 5 + 1 AS int)",
    "timestamp": "l_shipdate",
    "cycle_number": "CAST(l_orderkey % 999 + 1 AS int)",
    "vertical_sampling_scheme": _SCHEME,
    "longitude": _LON,
    "latitude": _LAT,
    "pressure_decibar": _PRESSURE,
    "salinity_psu": _SALINITY,
    "temperature_degc": _TEMPERATURE,
}

# Raw text rows: null tokens, mixed time formats, broken and out-of-range values.
_D = "CAST(l_shipdate AS string)"
_SOURCE = "CASE WHEN l_partkey % 3 = 0 THEN '1998' ELSE l_returnflag END"
RAW = {
    "basin": "CASE WHEN l_partkey % 97 = 0 THEN 'NULL' WHEN l_partkey % 97 = 1 THEN '' ELSE CAST(l_suppkey % 5 + 1 AS string) END",
    "timestamp": (f"CASE WHEN l_partkey % 89 = 0 THEN 'not a date' WHEN l_orderkey % 5 = 0 THEN replace({_D}, ' ', 'T') || 'Z' "
                  f"WHEN l_orderkey % 5 = 1 THEN replace({_D}, ' ', 'T') || '+02:00' WHEN l_orderkey % 5 = 2 THEN substr({_D}, 1, 10) "
                  f"WHEN l_orderkey % 5 = 3 THEN replace(substr({_D}, 1, 10), '-', '/') ELSE {_D} END"),
    "cycle_number": "CAST(l_orderkey % 999 + 1 AS string) || CASE WHEN l_linenumber = 2 THEN '.0' ELSE '' END",
    "vertical_sampling_scheme": "CASE l_returnflag WHEN 'R' THEN 'Primary sampling' WHEN 'A' THEN 'Secondary sampling' ELSE 'NaN' END",
    "longitude": f"CASE WHEN l_partkey % 83 = 0 THEN '-181.5' ELSE CAST({_LON} AS string) END",
    "latitude": f"CASE WHEN l_partkey % 79 = 0 THEN '99.65' ELSE CAST({_LAT} AS string) END",
    "pressure_decibar": f"CASE WHEN l_partkey % 73 = 0 THEN 'n/a' ELSE CAST({_PRESSURE} AS string) END",
    "salinity_psu": f"coalesce(CAST({_SALINITY} AS string), 'nan')",
    "temperature_degC": f"coalesce(CAST({_TEMPERATURE} AS string), '')",
}
RAW_SOURCE = f"'float_data_' || {_SOURCE} || '_raw.csv'"

# What the raw rows mean once read.
TYPED = {
    "basin": "CASE WHEN l_partkey % 97 > 1 THEN CAST(l_suppkey % 5 + 1 AS int) END",
    "timestamp": "CASE WHEN l_partkey % 89 = 0 THEN NULL WHEN l_orderkey % 5 = 1 THEN l_shipdate - INTERVAL 2 HOUR ELSE l_shipdate END",
    "cycle_number": PROFILES["cycle_number"],
    "vertical_sampling_scheme": _SCHEME,
    "longitude": f"CASE WHEN l_partkey % 83 = 0 THEN -181.5e0 ELSE {_LON} END",
    "latitude": f"CASE WHEN l_partkey % 79 = 0 THEN 99.65e0 ELSE {_LAT} END",
    "pressure_decibar": f"CASE WHEN l_partkey % 73 > 0 THEN {_PRESSURE} END",
    "salinity_psu": _SALINITY,
    "temperature_degc": _TEMPERATURE,
    "source_name": RAW_SOURCE,
}

_BASIN_ROWS = "(1, 'Atlantic Ocean'), (2, 'Pacific Ocean'), (3, 'Indian Ocean'), (4, 'Southern Ocean'), (5, 'Arctic Ocean')"


def select_list(columns: dict, quote='"') -> str:
    return ", ".join(f"{expr} AS {quote}{name}{quote}" for name, expr in columns.items())


SQL_PROFILES = f"profiles AS (SELECT {select_list(PROFILES)} FROM lineitem)"
SQL_BASINS = f"basins AS (SELECT * FROM (VALUES {_BASIN_ROWS}) AS t(basin, basin_name))"
SQL_RAW = f"raw AS (SELECT {select_list({**RAW, 'source_name': RAW_SOURCE})} FROM lineitem)"
SQL_TYPED = f"typed AS (SELECT {select_list(TYPED)} FROM lineitem)"

# Logged statements, one per event: good ones, each kind of violation, and borderline wording.
_S = [
    "'SELECT count(*) AS n FROM profiles WHERE basin = ' || CAST(user_id AS string)",
    "'SELECT basin, avg(temperature_degc) FROM profiles WHERE pressure_decibar < ' || CAST(event_id AS string) || ' GROUP BY basin'",
    "'SELECT * FROM profiles p JOIN trajectory t ON p.cycle_number = t.cycle_number WHERE p.basin = ' || CAST(user_id AS string) || ';'",
    "'DROP TABLE profiles_' || CAST(user_id AS string)",
    "'SELECT * FROM users_' || CAST(user_id AS string)",
    "'SELECT * FROM profiles; DELETE FROM profiles WHERE basin = ' || CAST(user_id AS string)",
    "'SELECT * FROM profiles -- ' || event_type",
    "'   '",
    "'SELECT basin FROM profiles WHERE EXTRACT(month FROM timestamp) IN (6, 7, ' || CAST(user_id AS string) || ')'",
    "'SELECT created_at FROM measurements WHERE depth_meters > ' || CAST(event_id AS string)",
    "'SELECT p.basin FROM profiles p, secrets s WHERE s.id = ' || CAST(user_id AS string)",
    "'WITH w AS (SELECT basin FROM profiles) SELECT * FROM w WHERE basin = ' || CAST(user_id AS string)",
    "'EXPLAIN SELECT ' || event_type || ' FROM profiles'",
    "'SELECT basin FROM profiles UNION SELECT 1 FROM profiles UNION SELECT 2 FROM profiles UNION SELECT 3 FROM profiles UNION SELECT ' || CAST(user_id AS string) || ' FROM profiles'",
    "'SELECT ((((((((((((' || CAST(user_id AS string) || ')))))))))))) FROM profiles'",
    "'SELECT 1 FROM profiles a JOIN profiles b ON 1=1 JOIN profiles c ON 1=1 JOIN profiles d ON 1=1 JOIN profiles e ON 1=1 JOIN profiles f ON 1=1 JOIN profiles g ON g.basin = ' || CAST(user_id AS string)",
    "'SELECT ' || event_type || '_value FROM trajectory'",
]
QUERY_LOG = {
    "query_id": "event_id",
    "sql": "CASE " + " ".join(f"WHEN event_id % {len(_S)} = {i} THEN {s}" for i, s in enumerate(_S)) + " END",
}
SQL_LOG = f"query_log AS (SELECT {select_list(QUERY_LOG)} FROM events)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _project(df, columns) -> DataFrame:
    return df.selectExpr(*[f"{expr} AS `{name}`" for name, expr in columns.items()])


def profiles(spark, sf_dir) -> DataFrame:
    return _project(table(spark, sf_dir, "lineitem"), PROFILES)


_STAGED = {}


def raw_files(spark, sf_dir, by_source: bool) -> str:
    """The raw rows as CSV files, written once per session: in one folder, or in one per source."""
    key = (spark.sparkContext.applicationId, sf_dir, by_source)
    if key not in _STAGED:
        path = scratch_path(spark, "raw")
        rows = _project(table(spark, sf_dir, "lineitem"), {**RAW, "source_name": RAW_SOURCE})
        writer = rows.write if by_source else rows.drop("source_name").write
        if by_source:
            writer = writer.partitionBy("source_name")
        with open_writers(spark):
            writer.option("header", True).option("escape", '"').csv(path)
        _STAGED[key] = path
    return _STAGED[key]


#: Files that a task writes side by side; one that meets more partitions sorts the rest of its rows.
OPEN_WRITERS = 16


@contextmanager
def open_writers(spark):
    """Writing by a few partitions without sorting whole tasks by them first."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(OPEN_WRITERS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def raw_rows(spark, sf_dir) -> DataFrame:
    """Text rows with the name of their source."""
    return spark.read.options(**CSV_OPTIONS).csv(raw_files(spark, sf_dir, True))


def query_log(spark, sf_dir) -> DataFrame:
    return _project(table(spark, sf_dir, "events"), QUERY_LOG)


def centroids(spark, sf_dir) -> DataFrame:
    """Search queries: per label, the direction of the mean vector and a sentence."""
    parts = (table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
             .groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
             .groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")))
    sentence = (F.when(F.col("label") % 3 == 0, "Warm water: temperature of each profile")
                .when(F.col("label") % 3 == 1, "Salinity and pressure at depth")
                .otherwise("Anything from the Arctic"))
    x = F.col("v.x")
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda total, y: total + y * y))
    return parts.select(F.col("label").alias("query_id"), sentence.alias("query"),
                        F.transform(x, lambda y: y / norm).alias("query_vector"))
