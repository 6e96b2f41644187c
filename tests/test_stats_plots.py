import numpy as np
import pytest
from pyspark.sql import functions as F

from thermocline.operators import plots as P, stats as S


def test_upper_median(spark):
    for values in ([1], [1, 2], [1, 2, 3], [5, 5, 1, 9], [2, 2, 2, 7, 8, 8]):
        df = spark.createDataFrame([(v,) for v in values], "v int")
        assert S.upper_median(df, "v").first()[0] == sorted(values)[len(values) // 2]


def test_score_summary_and_bins(spark):
    scores = [-0.1, 0.2, 0.4, 0.6, 0.8, 1.0]
    df = spark.createDataFrame([(1, s) for s in scores], "query_id int, score double")
    row = S.score_summary(df).first()
    assert (row.total_chunks, row.min_score, row.max_score, row.median_score) == (6, -0.1, 1.0, 0.6)
    assert {r.label: r.n for r in S.score_distribution(df).collect()} == {
        "0.0-0.2": 1, "0.2-0.4": 1, "0.4-0.6": 1, "0.6-0.8": 1, "0.8-1.0": 2}
    assert all(r.n == 0 for r in S.score_distribution(df.limit(0)).collect())


def test_latitude_bands(spark):
    df = spark.createDataFrame([(30.0,), (30.1,), (-30.0,), (-31.0,)], "latitude double")
    assert [r.n for r in S.latitude_distribution(df).orderBy("label").collect()] == [1, 1, 2]


def test_numeric_summary_skips_text_and_empty_columns(spark):
    df = spark.createDataFrame([(1, 2.0, "a", None), (3, None, "b", None)], "a int, b double, c string, d double")
    got = {r.column_name: (r["count"], r["min"], r["max"], r["mean"], r.non_null_percent) for r in S.numeric_summary(df).collect()}
    assert got == {"a": (2, 1.0, 3.0, 2.0, 100.0), "b": (1, 2.0, 2.0, 2.0, 50.0)}


def test_unique_counts(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (None, 2)], "basin int, cycle_number int")
    assert {r.column_name: r.distinct_values for r in S.unique_counts(df).collect()} == {"basin": 1, "cycle_number": 2}
    assert {r.column_name: r.distinct_values for r in S.unique_counts(df.filter("basin > 5")).collect()} == {"basin": 0, "cycle_number": 0}


def test_measurement_summary(spark):
    df = spark.createDataFrame(
        [([(1.0, 10.0, 35.0), (3.0, None, 36.0)],), ([],)],
        "m array<struct<pressure_decibar: double, temperature_degc: double, salinity_psu: double>>")
    full, empty = [r.s for r in df.select(S.measurement_summary(F.col("m")).alias("s")).collect()]
    assert (full["count"], full.depth_range.mean, full.temperature_range.min, full.salinity_range.max) == (2, 2.0, 0.0, 36.0)
    assert (empty["count"], empty.depth_range.mean, empty.salinity_range.min) == (0, 0.0, 0.0)


@pytest.mark.parametrize("values", [[1.0, 2.0, 2.5, 9.0, 10.0], [4.0, 4.0], list(np.random.default_rng(0).normal(size=500))])
def test_histogram_matches_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    got = P.histogram(df, "v").orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=30)
    assert [r.n for r in got] == counts.tolist()
    assert np.allclose([r.low for r in got] + [got[-1].high], edges)


def test_series_drops_incomplete_pairs(spark):
    df = spark.createDataFrame([(3, 1.0), (1, None), (None, 2.0), (2, 5.0)], "t int, v double")
    assert [(r.x, r.y) for r in P.series(df, "t", "v").collect()] == [(2, 5.0), (3, 1.0)]
    with pytest.raises(ValueError):
        P.series(df, "t", "w")


def test_scatter_matrix(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(50, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in data] + [(None, 1.0, 1.0)], "a double, b double, c double")
    got = {(r.x, r.y): (r.n, r.correlation) for r in P.scatter_matrix(df).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    assert got[("a", "c")][0] == 50 and got[("a", "c")][1] == pytest.approx(np.corrcoef(data[:, 0], data[:, 2])[0, 1])
    with pytest.raises(ValueError):
        P.scatter_matrix(df.select("a"))


@pytest.mark.parametrize("ddl, plot, want", [
    ("timestamp timestamp, temperature_degc double, pressure_decibar double", "depth_profile", ("pressure_decibar", "temperature_degc")),
    ("timestamp timestamp, temperature_degc double, pressure_decibar double", "line", ("timestamp", "temperature_degc")),
    ("name string, n int, m double", "scatter", ("n", "m")),
    ("name string, n int", "line", ("name", "n")),
    ("n int", "line", ("n", "n")),
])
def test_pick_columns(spark, ddl, plot, want):
    assert P.pick_columns(spark.createDataFrame([], ddl), plot) == want


def test_pick_columns_keeps_a_valid_choice(spark):
    df = spark.createDataFrame([], "a int, b int, timestamp timestamp, temperature_degc double")
    assert P.pick_columns(df, "line", "b", "a") == ("b", "a")
    assert P.pick_columns(df, "line", "b", "zzz") == ("timestamp", "temperature_degc")


def test_axis_labels():
    assert P.axis_label("salinity_psu") == "Salinity (PSU)" and P.axis_label("some_name") == "Some Name"


def test_depth_profile_and_axis_statistics(spark):
    df = spark.createDataFrame([(1.0, 20.0, None), (2.0, None, 35.0)], "pressure_decibar double, temperature_degc double, salinity_psu double")
    assert {tuple(r) for r in P.depth_profile(df).collect()} == {(1.0, "temperature_degc", 20.0), (2.0, "salinity_psu", 35.0)}
    got = {r.axis: (r["min"], r["max"], r["count"]) for r in P.axis_statistics(df, "pressure_decibar", "salinity_psu").collect()}
    assert got == {"x_axis": (1.0, 2.0, 2), "y_axis": (35.0, 35.0, 1)}


def test_bucketed_series(spark):
    rng = np.random.default_rng(3)
    x, y = rng.uniform(0, 10, 400), rng.normal(size=400)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (1.0, None)], "x double, y double")
    got = {r.bucket: r for r in P.series_bucketed(df, "x", "y", 7).collect()}
    at = np.minimum(np.floor((x - x.min()) / ((x.max() - x.min()) / 7)), 6).astype(int)
    assert set(got) == set(at.tolist()) and sum(r.n for r in got.values()) == 400
    for b, r in got.items():
        assert r["mean"] == pytest.approx(y[at == b].mean()) and (r.x_first, r.x_last) == (x[at == b].min(), x[at == b].max())
        assert (r["min"], r["max"]) == (y[at == b].min(), y[at == b].max())


def test_bucketed_series_of_one_time_and_of_none(spark):
    df = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-01", 3.0)], "t string, y double").withColumn("t", F.to_date("t"))
    row = P.series_bucketed(df, "t", "y").first()
    assert (row.bucket, row.n, row["mean"], str(row.x_first)) == (0, 2, 2.0, "2024-01-01")
    assert P.series_bucketed(df.limit(0), "t", "y").count() == 0


def test_binned_depth_profile(spark):
    df = spark.createDataFrame([(0.0, 1.0, None), (9.9, 3.0, 30.0), (10.0, 5.0, 31.0), (None, 7.0, 32.0)],
                               "pressure_decibar double, temperature_degc double, salinity_psu double")
    got = {(r.depth, r.variable): (r.n, r["mean"], r["min"], r["max"]) for r in P.depth_profile_binned(df).collect()}
    assert got == {(0.0, "temperature_degc"): (2, 2.0, 1.0, 3.0), (0.0, "salinity_psu"): (1, 30.0, 30.0, 30.0),
                   (10.0, "temperature_degc"): (1, 5.0, 5.0, 5.0), (10.0, "salinity_psu"): (1, 31.0, 31.0, 31.0)}
    with pytest.raises(ValueError):
        P.depth_profile_binned(df, step=0)


def test_matrix_diagonal_is_the_histogram_of_complete_cases(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (4.0, 2.0), (9.0, None)], "a double, b double")
    got = P.scatter_matrix_diagonal(df, ["a", "b"], 3)
    whole = df.dropna()
    for c in ("a", "b"):
        want = sorted((r.bin, r.low, r.high, r.n) for r in P.histogram(whole, c, 3).collect())
        assert sorted((r.bin, r.low, r.high, r.n) for r in got.filter(F.col("column_name") == c).collect()) == want


def test_selection_of_a_median_without_a_window(spark, monkeypatch):
    import random
    rng = random.Random(2)
    for kind, values in (("double", [rng.gauss(0, 10 ** rng.randint(-8, 8)) for _ in range(3001)]),
                         ("double", [float("inf"), float("-inf"), 1.0, 1.0, float("nan"), 2.0, 1e308, -1e308]), ("double", [3.0] * 9),
                         ("long", [2 ** 60 + i for i in range(50)]), ("int", [5]), ("double", [5e-324, 0.0, -0.0, 1e-320])):
        df = spark.createDataFrame([(v,) for v in [*values, None]], f"v {kind}")
        want = sorted(values, key=lambda v: (v != v, v))[len(values) // 2]
        assert S.upper_median(df, "v").first()[0] == want, (kind, want)
    assert S.upper_median(spark.createDataFrame([(None,)], "v double"), "v").first()[0] is None


def test_a_median_of_a_million_distinct_doubles(spark, capsys):
    df = spark.range(1_000_000).select((F.xxhash64("id") / 3.0).alias("v"))
    want = df.orderBy("v").offset(500_000).first()[0]
    found = S.upper_median(df, "v")
    found.explain()
    assert "Window" not in capsys.readouterr().out and found.first()[0] == want


@pytest.mark.parametrize("odd", [float("nan"), float("inf"), float("-inf")])
def test_values_without_a_place_leave_histograms_alone(spark, odd):
    df = spark.createDataFrame([(float(i), float(-i)) for i in range(10)] + [(odd, odd), (None, 1.0)], "a double, b double")
    clean = spark.createDataFrame([(float(i), float(-i)) for i in range(10)], "a double, b double")
    assert sorted(map(tuple, P.histogram(df, "a", 5).collect())) == sorted(map(tuple, P.histogram(clean, "a", 5).collect()))
    assert sorted(map(tuple, P.scatter_matrix_diagonal(df, ["a", "b"], 5).collect())) == sorted(map(tuple, P.scatter_matrix_diagonal(clean, ["a", "b"], 5).collect()))
