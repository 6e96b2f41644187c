import datetime

import pytest
from pyspark.sql import functions as F

from thermocline.operators import quality as Q

RAW = ("basin string, timestamp string, cycle_number string, vertical_sampling_scheme string, longitude string, "
       "latitude string, pressure_decibar string, salinity_psu string, temperature_degC string")


def _raw(spark, *changes):
    good = {"basin": "2", "timestamp": "2024-05-01T10:00:00Z", "cycle_number": "12", "vertical_sampling_scheme": "Primary",
            "longitude": "10.5", "latitude": "-3.25", "pressure_decibar": "100.5", "salinity_psu": "35.1", "temperature_degC": "12.5"}
    rows = [{**good, **c} for c in changes]
    return spark.createDataFrame([tuple(r.values()) for r in rows], RAW)


@pytest.mark.parametrize("text, expected", [
    ("2024-01-02T03:04:05", "2024-01-02 03:04:05"),
    ("2024-01-02T03:04:05Z", "2024-01-02 03:04:05"),
    ("2024-01-02 03:04:05+02:00", "2024-01-02 01:04:05"),
    ("2024-01-02T03:04:05.250Z", "2024-01-02 03:04:05.250000"),
    ("2024-01-02", "2024-01-02 00:00:00"),
    ("2024/01/02", "2024-01-02 00:00:00"),
    ("13/01/2024 10:00", "2024-01-13 10:00:00"),
    ("01/13/2024 10:00", "2024-01-13 10:00:00"),
    ("02.01.2024", "2024-01-02 00:00:00"),
    ("02.01.2024 03:04:05", "2024-01-02 03:04:05"),
    ("01/02/2024 03:04 PM", "2024-01-02 15:04:00"),
    ("1/2/2024 12:04:05 am", "2024-01-02 00:04:05"),
    ("Jan 2 2024", "2024-01-02 00:00:00"),
    ("January 2 2024 10:00", "2024-01-02 10:00:00"),
    ("13/13/2024", None),
    ("01/02/2024", "2024-01-02 00:00:00"),
    ("02-Jan-2024", "2024-01-02 00:00:00"),
    ("20240102", "2024-01-02 00:00:00"),
    ("2024/01/02 03:04:05", "2024-01-02 03:04:05"),
    ("2024/01/02 03:04:05.5", "2024-01-02 03:04:05.500000"),
    ("2024/01/02T03:04:05Z", "2024-01-02 03:04:05"),
    ("2024/01/02 03:04:05+02:00", "2024-01-02 01:04:05"),
    ("01/02/2024 03:04", "2024-01-02 03:04:00"),
    ("01/02/2024 03:04:05", "2024-01-02 03:04:05"),
    ("20240102T030405", "2024-01-02 03:04:05"),
    ("20240102T030405Z", "2024-01-02 03:04:05"),
    ("2-Jan-2024", "2024-01-02 00:00:00"),
    ("02-Jan-2024 03:04:05", "2024-01-02 03:04:05"),
    ("1/2/2024", "2024-01-02 00:00:00"),
    ("January 2, 2024", "2024-01-02 00:00:00"),
    ("May 2, 2024 10:20", "2024-05-02 10:20:00"),
    ("2 Jan 2024", "2024-01-02 00:00:00"),
    ("13/45/2024", None), ("2024/02/30 10:00", None),
    ("12:30:00", None), ("tomorrow", None), ("", None), (None, None), ("2024-13-45", None),
])
def test_parse_timestamp(spark, text, expected):
    from thermocline.functions.rendering import timestamp_text
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(timestamp_text(Q.parse_timestamp(F.col("t")))).first()[0] == expected


@pytest.mark.parametrize("token", ["", "nan", "NaN", "null", "NULL", "N/A", "None", "<NA>", "#N/A"])
def test_null_tokens_become_null(spark, token):
    row = Q.null_tokens(_raw(spark, {"salinity_psu": token, "vertical_sampling_scheme": token})).first()
    assert row.salinity_psu is None and row.vertical_sampling_scheme is None
    row = Q.typed(Q.rename_temperature(_raw(spark, {"salinity_psu": token, "vertical_sampling_scheme": token}))).first()
    assert row.salinity_psu is None and row.vertical_sampling_scheme is None


def test_float_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert [r.x for r in Q.null_tokens(df).collect()] == [None, 1.0]


def test_rename_is_exact(spark):
    assert "temperature_degc" in Q.rename_temperature(_raw(spark, {})).columns
    same = spark.createDataFrame([(1.0,)], "temperature_degc double")
    assert Q.rename_temperature(same).columns == ["temperature_degc"]


def test_clean_one_row(spark):
    row = Q.clean(_raw(spark, {})).first()
    assert row.timestamp == datetime.datetime(2024, 5, 1, 10)
    assert (row.basin, row.cycle_number, row.pressure_decibar, row.temperature_degc) == (2, 12, 100.5, 12.5)


def test_clean_parses_once(spark):
    """The filter of clean reads what was parsed and does not parse it again."""
    plan = Q.clean(_raw(spark, {}, {"timestamp": "some day"}))._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if line.strip(" +-:").startswith("Filter")]
    assert filters and not any("RLIKE" in line.upper() or "try_cast" in line for line in filters)


@pytest.mark.parametrize("change", [
    {"basin": "NULL"}, {"timestamp": "never"}, {"cycle_number": ""}, {"cycle_number": "1.5"}, {"longitude": "nan"},
    {"latitude": "north"}, {"pressure_decibar": "n/a"},
    {"longitude": "180.01"}, {"longitude": "-180.01"}, {"latitude": "99.65"}, {"latitude": "-90.5"},
    {"pressure_decibar": "-0.01"},
])
def test_clean_rejects(spark, change):
    assert Q.clean(_raw(spark, change)).count() == 0


@pytest.mark.parametrize("change", [
    {"longitude": "180"}, {"longitude": "-180"}, {"latitude": "90"}, {"latitude": "-90"}, {"pressure_decibar": "0"},
    {"cycle_number": "3.0"},
])
def test_bounds_are_inclusive(spark, change):
    assert Q.clean(_raw(spark, change)).count() == 1


def test_null_policies(spark):
    raw = _raw(spark, {"salinity_psu": "nan", "temperature_degC": "", "vertical_sampling_scheme": ""})
    zero, keep = Q.clean(raw).first(), Q.clean(raw, "keep").first()
    assert (zero.salinity_psu, zero.temperature_degc, zero.vertical_sampling_scheme) == (0.0, 0.0, "")
    assert (keep.salinity_psu, keep.temperature_degc, keep.vertical_sampling_scheme) == (None, None, None)
    with pytest.raises(ValueError):
        Q.clean(raw, "drop").count()


def test_reject_summary_names_the_first_rule(spark):
    rows = Q.typed(Q.rename_temperature(_raw(
        spark, {}, {"basin": "x", "longitude": "999"}, {"longitude": "999", "latitude": "999"}, {"latitude": "999"},
        {"pressure_decibar": "-1"})))
    got = {r.outcome: r.n for r in Q.reject_summary(rows).collect()}
    assert got == {"valid": 1, "required": 1, "longitude": 1, "latitude": 1, "pressure": 1}


def test_missing_profile(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, 3), (4, None)], "a int, b int")
    got = {r.column_name: (r.missing, r.missing_percent) for r in Q.missing_profile(df).collect()}
    assert got == {"a": (1, 25.0), "b": (3, 75.0)}
    assert {r.missing_percent for r in Q.missing_profile(df.limit(0)).collect()} == {0.0}


def test_qc_flags(spark):
    df = spark.createDataFrame([(41.0, 35.0, 10.0), (None, 20.0, 4000.0), (40.0, 25.0, 3000.0)],
                               "temperature_degc double, salinity_psu double, pressure_decibar double")
    assert [r.flags for r in Q.qc_flags(df).collect()] == [1, 2, 0]


def test_reconcile_reports_shortfall(spark):
    row = Q.reconcile(spark.range(5), spark.range(5), spark.range(3)).first()
    assert (row.stored_shortfall, row.exported_shortfall, row.passed) == (0, 2, 0)
    assert Q.reconcile(spark.range(5), spark.range(5), spark.range(5)).first().passed == 1


def test_ingest_summary_counts(spark):
    raw = _raw(spark, {}, {"basin": ""}, {"latitude": "95"}).withColumn("source_name", F.lit("f.csv"))
    row = Q.ingest_summary(raw).first()
    assert (row.rows_read, row.rows_dropped, row.rows_rejected, row.rows_kept) == (3, 1, 1, 1)


def test_day_order_is_found_once_and_broadcast(spark):
    """However often rows are read, votes are counted once, and no task takes all rows of a large file."""
    raw = spark.createDataFrame([("a", "13/02/2024"), ("a", "01/02/2024"), ("b", "2024-01-01"), ("b", None), ("c", "02/13/2024")],
                                "source_name string, timestamp string")
    found = Q.with_day_order(raw)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Aggregate" not in plan
    assert {(r.source_name, r.day_first) for r in found.collect()} == {("a", True), ("b", None), ("c", False)}
    order = {r.source_name: (r.day_first, r.ambiguous) for r in Q.day_order(raw).collect()}
    assert order == {"a": (True, 1), "b": (None, 0), "c": (False, 0)}
