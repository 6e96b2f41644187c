"""Cleaning and validation."""

from pyspark.sql import functions as F

from checks.fixture import SQL_PROFILES, SQL_RAW, SQL_TYPED, profiles, raw_rows
from checks.registry import query
from thermocline.functions.rendering import timestamp_text
from thermocline.operators import quality as Q
from thermocline.schema import PROFILE_COLUMNS
from thermocline.sources.files import row_limit

SEVEN = "basin, cycle_number, vertical_sampling_scheme, longitude, latitude, pressure_decibar, salinity_psu, temperature_degc"
COMPLETE = ("basin IS NOT NULL AND \"timestamp\" IS NOT NULL AND cycle_number IS NOT NULL AND longitude IS NOT NULL "
            "AND latitude IS NOT NULL AND pressure_decibar IS NOT NULL")
IN_RANGE = "longitude BETWEEN -180 AND 180 AND latitude BETWEEN -90 AND 90 AND pressure_decibar >= 0"
FILLED = ("basin, cycle_number, coalesce(vertical_sampling_scheme, '') AS vertical_sampling_scheme, longitude, latitude, "
          "pressure_decibar, coalesce(salinity_psu, 0e0) AS salinity_psu, coalesce(temperature_degc, 0e0) AS temperature_degc")
SECONDS = "strftime(\"timestamp\", '%Y-%m-%d %H:%M:%S') AS observed_at"


def typed(spark, sf_dir):
    return Q.typed(Q.rename_temperature(raw_rows(spark, sf_dir)))


def with_seconds(df):
    """The time as text, so that the comparison does not depend on a session's time zone."""
    return df.withColumn("observed_at", timestamp_text(F.col("timestamp"))).drop("timestamp")


def clean_profiles(spark, sf_dir):
    return Q.fill_defaults(Q.range_validate(Q.drop_critical(profiles(spark, sf_dir))))


@query("q_null_tokens", f"""WITH {SQL_RAW} SELECT source_name, longitude, latitude,
CASE WHEN basin NOT IN ('NULL', '') THEN basin END AS basin, "timestamp" AS observed, cycle_number,
CASE WHEN vertical_sampling_scheme <> 'NaN' THEN vertical_sampling_scheme END AS vertical_sampling_scheme,
CASE WHEN pressure_decibar <> 'n/a' THEN pressure_decibar END AS pressure_decibar,
CASE WHEN salinity_psu <> 'nan' THEN salinity_psu END AS salinity_psu,
CASE WHEN "temperature_degC" <> '' THEN "temperature_degC" END AS temperature FROM raw""")
def _(spark, sf_dir):
    return (Q.null_tokens(raw_rows(spark, sf_dir))
            .withColumnsRenamed({"timestamp": "observed", "temperature_degC": "temperature"}))


@query("q_rename", f'WITH {SQL_RAW} SELECT nullif("temperature_degC", \'\') AS temperature_degc, count(*) AS n FROM raw GROUP BY 1')
def _(spark, sf_dir):
    renamed = Q.rename_temperature(raw_rows(spark, sf_dir))
    return renamed.groupBy("temperature_degc").agg(F.count(F.lit(1)).alias("n"))


def _missing_sql(cte, columns):
    parts = [f"""SELECT '{c}' AS column_name, count(*) - count("{c}") AS missing, round((count(*) - count("{c}")) * 1e2 / count(*), 2) AS missing_percent FROM {cte}"""
             for c in columns]
    return " UNION ALL ".join(parts)


@query("q_missing_profile", f"WITH {SQL_TYPED} {_missing_sql('typed', PROFILE_COLUMNS)}")
def _(spark, sf_dir):
    return Q.missing_profile(typed(spark, sf_dir), PROFILE_COLUMNS)


@query("q_drop_critical", f"WITH {SQL_TYPED} SELECT {SEVEN}, {SECONDS} FROM typed WHERE {COMPLETE}")
def _(spark, sf_dir):
    return with_seconds(Q.drop_critical(typed(spark, sf_dir)).drop("source_name"))


@query("q_fill_defaults", f"WITH {SQL_PROFILES} SELECT {FILLED}, {SECONDS} FROM profiles")
def _(spark, sf_dir):
    return with_seconds(Q.fill_defaults(profiles(spark, sf_dir)))


@query("q_range_validate", f"WITH {SQL_TYPED} SELECT {SEVEN}, {SECONDS} FROM typed WHERE {COMPLETE} AND {IN_RANGE}")
def _(spark, sf_dir):
    return with_seconds(Q.range_validate(typed(spark, sf_dir)).drop("source_name"))


@query("q_reject_summary", f"""WITH {SQL_TYPED} SELECT CASE
WHEN "timestamp" IS NULL OR cycle_number IS NULL OR basin IS NULL THEN 'required'
WHEN longitude IS NULL OR longitude < -180 OR longitude > 180 THEN 'longitude'
WHEN latitude IS NULL OR latitude < -90 OR latitude > 90 THEN 'latitude'
WHEN pressure_decibar IS NULL OR pressure_decibar < 0 THEN 'pressure' ELSE 'valid' END AS outcome, count(*) AS n
FROM typed GROUP BY 1""")
def _(spark, sf_dir):
    return Q.reject_summary(typed(spark, sf_dir))


def _qc_sql():
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) AS flagged, count(*) - count({c}) AS missing FROM profiles"
        for c, (lo, hi) in Q.QC_THRESHOLDS.items())


@query("q_qc_flags", f"WITH {SQL_PROFILES} {_qc_sql()}")
def _(spark, sf_dir):
    return Q.qc_summary(profiles(spark, sf_dir))


@query("q_parse_timestamp", f"""WITH {SQL_RAW}, {SQL_TYPED}
SELECT strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS observed_at, count(*) AS n FROM typed GROUP BY 1""")
def _(spark, sf_dir):
    parsed = raw_rows(spark, sf_dir).select(Q.parse_timestamp(F.col("timestamp")).alias("t"))
    return parsed.groupBy(timestamp_text(F.col("t")).alias("observed_at")).agg(F.count(F.lit(1)).alias("n"))


@query("q_project9", f'WITH {SQL_PROFILES} SELECT {SEVEN}, "timestamp" AS observed_at FROM profiles')
def _(spark, sf_dir):
    return Q.select_profile_columns(profiles(spark, sf_dir)).withColumnRenamed("timestamp", "observed_at")


@query("q_ingest_summary", f"""WITH {SQL_TYPED} SELECT source_name, count(*) AS rows_read,
count(*) FILTER (WHERE NOT ({COMPLETE})) AS rows_dropped,
count(*) FILTER (WHERE {COMPLETE} AND NOT ({IN_RANGE})) AS rows_rejected,
count(*) FILTER (WHERE {COMPLETE} AND {IN_RANGE}) AS rows_kept FROM typed GROUP BY source_name""")
def _(spark, sf_dir):
    return Q.ingest_summary(raw_rows(spark, sf_dir))


@query("q_clean", f"WITH {SQL_TYPED} SELECT {FILLED}, source_name, {SECONDS} FROM typed WHERE {COMPLETE} AND {IN_RANGE}")
def _(spark, sf_dir):
    """The whole cleaning path, raw text to stored rows."""
    return with_seconds(Q.clean(raw_rows(spark, sf_dir)))


@query("row_limit", f"""WITH {SQL_PROFILES} SELECT {SEVEN}, "timestamp" AS observed_at FROM profiles
ORDER BY "timestamp", pressure_decibar, basin, cycle_number, vertical_sampling_scheme NULLS FIRST, longitude, latitude,
salinity_psu NULLS FIRST, temperature_degc NULLS FIRST LIMIT 500""")
def _(spark, sf_dir):
    return row_limit(profiles(spark, sf_dir), 500).withColumnRenamed("timestamp", "observed_at")
