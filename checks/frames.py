"""Places, times, result statistics and plot tables."""

from pyspark.sql import functions as F

from checks.chunks import SQL_CHUNKS, chunks
from checks.fixture import SQL_PROFILES, profiles, table
from checks.registry import query
from thermocline.operators import places as G, plots as P, stats as S
from thermocline.operators.sqlguard import register_views
from thermocline.plans.retrieval import plot_source
from thermocline.schema import PROFILE_COLUMNS

LAT, LON = -12.5, 30.0
_KM = f"sqrt(({LAT} - latitude) * ({LAT} - latitude) + ({LON} - longitude) * ({LON} - longitude)) * 111e0"


def placed(spark, sf_dir):
    return chunks(spark, sf_dir).select("chunk_id", "observed_at", "timestamp", "metadata.latitude",
                                        "metadata.longitude", "metadata.basin")


@query("g_radius", f"""WITH {SQL_CHUNKS} SELECT chunk_id, latitude, longitude, round({_KM}, 6) AS distance_km,
round(1 - {_KM} / 2500, 6) AS score FROM chunks WHERE {_KM} <= 2500 ORDER BY 1 - {_KM} / 2500 DESC, chunk_id LIMIT 10""")
def _(spark, sf_dir):
    found = G.nearest_by_location(placed(spark, sf_dir), LAT, LON, 2500.0, 10)
    return found.select("chunk_id", "latitude", "longitude", F.round("distance_km", 6).alias("distance_km"),
                        F.round("score", 6).alias("score"))


_HAVERSINE = (f"2 * 6371.0088e0 * asin(sqrt(least(1e0, sin(radians({LAT} - latitude) / 2) * sin(radians({LAT} - latitude) / 2) + "
              f"cos(radians({LAT})) * cos(radians(latitude)) * sin(radians({LON} - longitude) / 2) * sin(radians({LON} - longitude) / 2))))")


@query("g_radius_haversine", f"""WITH {SQL_PROFILES} SELECT basin, latitude, longitude, round({_HAVERSINE}, 6) AS distance_km FROM profiles
WHERE {_HAVERSINE} <= 1500""")
def _(spark, sf_dir):
    found = G.within_radius(profiles(spark, sf_dir), LAT, LON, 1500.0, metric="haversine")
    return found.select("basin", "latitude", "longitude", F.round("distance_km", 6).alias("distance_km"))


def _sphere_km(lat, lon, to_lat, to_lon):
    return (f"2 * 6371.0088e0 * asin(sqrt(least(1e0, sin(radians({lat} - {to_lat}) / 2) * sin(radians({lat} - {to_lat}) / 2) + "
            f"cos(radians({lat})) * cos(radians({to_lat})) * sin(radians({lon} - {to_lon}) / 2) * sin(radians({lon} - {to_lon}) / 2))))")


_DATE_LINE, _POLE = (_sphere_km(*at, "latitude", "longitude") for at in (("-1.25e1", "1.795e2"), ("8.85e1", "1e1")))


@query("g_radius_edges", f"""WITH {SQL_PROFILES} SELECT 'date line' AS edge, latitude, longitude, round({_DATE_LINE}, 6) AS distance_km FROM profiles
WHERE {_DATE_LINE} <= 900 UNION ALL SELECT 'pole', latitude, longitude, round({_POLE}, 6) FROM profiles WHERE {_POLE} <= 900""")
def _(spark, sf_dir):
    """Circles on the sphere that cross the date line and hold a pole."""
    found = [G.within_radius(profiles(spark, sf_dir), at, lon, 900.0, metric="haversine").select(
        F.lit(edge).alias("edge"), "latitude", "longitude", F.round("distance_km", 6).alias("distance_km"))
        for edge, at, lon in (("date line", -12.5, 179.5), ("pole", 88.5, 10.0))]
    return found[0].unionByName(found[1])


# Points: one per customer, spread over the globe by key.
_PLON, _PLAT = "CAST((c_custkey * 71) % 3600 AS double) / 1e1 - 1.8e2", "CAST((c_custkey * 59) % 1800 AS double) / 1e1 - 9e1"
_POINTS = f"points AS (SELECT c_custkey AS point_id, {_PLAT} AS plat, {_PLON} AS plon FROM customer)"
_PKM = "sqrt((plat - latitude) * (plat - latitude) + (plon - longitude) * (plon - longitude)) * 111e0"
_JOINED = f"""WITH {SQL_CHUNKS}, {_POINTS}, near AS (SELECT point_id, chunk_id, {_PKM} AS d FROM points JOIN chunks ON {_PKM} <= 300)"""


def _points(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS point_id", f"{_PLAT} AS latitude", f"{_PLON} AS longitude")


@query("g_radius_join", f"{_JOINED} SELECT point_id, chunk_id, round(d, 6) AS distance_km, round(1 - d / 300, 6) AS score FROM near")
def _(spark, sf_dir):
    found = G.radius_join(_points(spark, sf_dir), placed(spark, sf_dir), 300.0)
    return found.select("point_id", "chunk_id", F.round("distance_km", 6).alias("distance_km"), F.round("score", 6).alias("score"))


@query("g_radius_join_salted", f"{_JOINED} SELECT point_id, chunk_id, round(d, 6) AS distance_km, round(1 - d / 300, 6) AS score FROM near")
def _(spark, sf_dir):
    """The same without a broadcast, crowded cells cut by their counts."""
    found = G.radius_join(_points(spark, sf_dir), placed(spark, sf_dir), 300.0, broadcast_points=0, salt_rows=4)
    return found.select("point_id", "chunk_id", F.round("distance_km", 6).alias("distance_km"), F.round("score", 6).alias("score"))


_PSPHERE = _sphere_km("plat", "plon", "latitude", "longitude")
_SPHERE_JOINED = f"""WITH {SQL_CHUNKS}, {_POINTS} SELECT point_id, chunk_id, round({_PSPHERE}, 6) AS distance_km FROM points JOIN chunks ON {_PSPHERE} <= 300"""


@query("g_radius_join_sphere", _SPHERE_JOINED)
def _(spark, sf_dir):
    """Points all over the globe, poles and both sides of the date line included."""
    found = G.radius_join(_points(spark, sf_dir), placed(spark, sf_dir), 300.0, metric="haversine", decimals=6)
    return found.select("point_id", "chunk_id", "distance_km")


@query("g_radius_join_sphere_salted", _SPHERE_JOINED)
def _(spark, sf_dir):
    """The same without a broadcast, crowded cells cut by their counts."""
    found = G.radius_join(_points(spark, sf_dir), placed(spark, sf_dir), 300.0, metric="haversine",
                          broadcast_points=0, salt_rows=4, decimals=6)
    return found.select("point_id", "chunk_id", "distance_km")


@query("g_radius_join_topk", f"""{_JOINED} SELECT point_id, chunk_id, CAST(row_number() OVER (PARTITION BY point_id ORDER BY 1 - d / 300 DESC, chunk_id) AS int) AS rank
FROM near QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY 1 - d / 300 DESC, chunk_id) <= 10""")
def _(spark, sf_dir):
    return G.radius_join(_points(spark, sf_dir), placed(spark, sf_dir), 300.0, 10).select("point_id", "chunk_id", "rank")


@query("g_bbox", f"WITH {SQL_PROFILES} SELECT basin, latitude, longitude, pressure_decibar FROM profiles WHERE latitude BETWEEN -30 AND 30 AND longitude BETWEEN -60 AND 0")
def _(spark, sf_dir):
    return G.in_box(profiles(spark, sf_dir), -30, 30, -60, 0).select("basin", "latitude", "longitude", "pressure_decibar")


@query("t_range", f"""WITH {SQL_CHUNKS} SELECT chunk_id, timestamp_text, 1e0 AS score FROM chunks
WHERE ts BETWEEN TIMESTAMP '1996-02-01 00:00:00' AND TIMESTAMP '1996-03-01 00:00:00' ORDER BY ts, chunk_id LIMIT 25""")
def _(spark, sf_dir):
    found = G.by_time_range(placed(spark, sf_dir), "1996-02-01", "1996-03-01", 25)
    return found.select("chunk_id", F.col("timestamp").alias("timestamp_text"), "score")


@query("t_range_events", """SELECT event_id, ts AS observed_at, event_type FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00' ORDER BY ts, event_id LIMIT 1000""")
def _(spark, sf_dir):
    found = G.by_time_range(table(spark, sf_dir, "events"), "2024-01-05", "2024-01-20 12:00:00", 1000, ts="ts", id_col="event_id")
    return found.select("event_id", F.col("ts").alias("observed_at"), "event_type")


_NUMERIC = ["basin", "cycle_number", "longitude", "latitude", "pressure_decibar", "salinity_psu", "temperature_degc"]


def _summary_sql(columns):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS count, round(min(CAST({c} AS double)), 3) AS min, round(max(CAST({c} AS double)), 3) AS max, "
        f"round(avg({c}), 3) AS mean, round(count({c}) * 1e2 / count(*), 1) AS non_null_percent FROM profiles" for c in columns)


@query("r_numeric_summary", f"WITH {SQL_PROFILES} {_summary_sql(_NUMERIC)}")
def _(spark, sf_dir):
    return S.numeric_summary(profiles(spark, sf_dir))


@query("r_unique_counts", f"WITH {SQL_PROFILES} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT \"{c}\") AS distinct_values FROM profiles" for c in S.KEY_COLUMNS))
def _(spark, sf_dir):
    return S.unique_counts(profiles(spark, sf_dir))


@query("r_unique_counts_approx")
def _(spark, sf_dir):
    return S.unique_counts(profiles(spark, sf_dir), approximate=True)


@query("p_series", f'WITH {SQL_PROFILES} SELECT "timestamp" AS x, temperature_degc AS y FROM profiles WHERE temperature_degc IS NOT NULL')
def _(spark, sf_dir):
    return P.series(profiles(spark, sf_dir), "timestamp", "temperature_degc")


def _bucketed_sql(cte, x, y, source):
    return f"""{cte} points AS (SELECT {x} AS x, CAST({y} AS double) AS y, CAST(epoch_us({x}) AS double) AS place FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
span AS (SELECT min(place) AS lo, max(place) AS hi FROM points)
SELECT CAST(least(floor((place - lo) / ((hi - lo) / 500)), 499) AS int) AS bucket, min(x) AS x_first, max(x) AS x_last, count(*) AS n,
round(avg(y), 6) AS mean, min(y) AS min, max(y) AS max FROM points, span GROUP BY 1"""


@query("p_series_bucketed", _bucketed_sql(f"WITH {SQL_PROFILES},", '"timestamp"', "temperature_degc", "profiles"))
def _(spark, sf_dir):
    found = P.series_bucketed(profiles(spark, sf_dir), "timestamp", "temperature_degc")
    return found.withColumn("mean", F.round("mean", 6))


@query("p_series_bucketed_events", _bucketed_sql("WITH", "ts", "value", "events"))
def _(spark, sf_dir):
    return P.series_bucketed(table(spark, sf_dir, "events"), "ts", "value").withColumn("mean", F.round("mean", 6))


@query("p_pick_columns", f'WITH {SQL_PROFILES} SELECT "timestamp" AS x, round(avg(temperature_degc), 6) AS y FROM profiles GROUP BY 1')
def _(spark, sf_dir):
    """Axes picked from the schema, then the mean of y per x."""
    frame = profiles(spark, sf_dir)
    x, y = P.pick_columns(frame, "line")
    return frame.groupBy(F.col(x).alias("x")).agg(F.round(F.avg(y), 6).alias("y"))


@query("p_series_events", "SELECT ts AS x, value AS y FROM events WHERE value IS NOT NULL AND ts IS NOT NULL")
def _(spark, sf_dir):
    return P.series(table(spark, sf_dir, "events"), "ts", "value")


def _histogram_sql(cte, column, source):
    return f"""{cte} span AS (SELECT min(CAST({column} AS double)) AS lo, (max(CAST({column} AS double)) - min(CAST({column} AS double))) AS width FROM {source}),
counts AS (SELECT CAST(least(floor(({column} - lo) / (width / 30)), 29) AS int) AS bin, count(*) AS n FROM {source}, span WHERE {column} IS NOT NULL GROUP BY 1)
SELECT CAST(b.bin AS int) AS bin, round(lo + b.bin * (width / 30), 6) AS low, round(lo + (b.bin + 1) * (width / 30), 6) AS high, coalesce(n, 0) AS n
FROM (SELECT unnest(range(30)) AS bin) b CROSS JOIN span LEFT JOIN counts c ON c.bin = b.bin"""


def _edges(df):
    return df.withColumns({c: F.round(c, 6) for c in ("low", "high")})


@query("p_histogram", _histogram_sql(f"WITH {SQL_PROFILES},", "pressure_decibar", "profiles"))
def _(spark, sf_dir):
    return _edges(P.histogram(profiles(spark, sf_dir), "pressure_decibar"))


@query("p_histogram_events", _histogram_sql("WITH", "value", "events"))
def _(spark, sf_dir):
    return _edges(P.histogram(table(spark, sf_dir, "events"), "value"))


@query("p_depth_profile", f"""WITH {SQL_PROFILES} SELECT pressure_decibar AS depth, 'temperature_degc' AS variable, temperature_degc AS value
FROM profiles WHERE temperature_degc IS NOT NULL UNION ALL SELECT pressure_decibar, 'salinity_psu', salinity_psu FROM profiles WHERE salinity_psu IS NOT NULL""")
def _(spark, sf_dir):
    return P.depth_profile(profiles(spark, sf_dir))


@query("p_depth_profile_binned", f"""WITH {SQL_PROFILES}, points AS (SELECT pressure_decibar AS depth, 'temperature_degc' AS variable, temperature_degc AS value
FROM profiles WHERE temperature_degc IS NOT NULL UNION ALL SELECT pressure_decibar, 'salinity_psu', salinity_psu FROM profiles WHERE salinity_psu IS NOT NULL)
SELECT floor(depth / 10) * 1e1 AS depth, variable, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max
FROM points WHERE depth IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf_dir):
    return P.depth_profile_binned(profiles(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


def _pairs_sql():
    cols = P.PREFERRED
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    return " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, count(*) AS n, round(corr({a}, {b}), 6) AS correlation FROM complete" for a, b in pairs)


@query("p_scatter_matrix", f"""WITH {SQL_PROFILES}, complete AS (SELECT * FROM profiles WHERE temperature_degc IS NOT NULL AND salinity_psu IS NOT NULL
AND pressure_decibar IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL) {_pairs_sql()}""")
def _(spark, sf_dir):
    return P.scatter_matrix(profiles(spark, sf_dir)).withColumn("correlation", F.round("correlation", 6))


_LONG = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS double) AS v FROM complete" for c in P.PREFERRED)


@query("p_scatter_matrix_diagonal", f"""WITH {SQL_PROFILES}, complete AS (SELECT * FROM profiles WHERE temperature_degc IS NOT NULL AND salinity_psu IS NOT NULL
AND pressure_decibar IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL), long AS ({_LONG}),
span AS (SELECT column_name, min(v) AS lo, max(v) - min(v) AS width FROM long GROUP BY column_name),
counts AS (SELECT column_name, CAST(least(floor((v - lo) / (width / 30)), 29) AS int) AS bin, count(*) AS n FROM long JOIN span USING (column_name) GROUP BY 1, 2)
SELECT s.column_name, b.bin, round(lo + b.bin * (width / 30), 6) AS low, round(lo + (b.bin + 1) * (width / 30), 6) AS high, coalesce(n, 0) AS n
FROM span s CROSS JOIN (SELECT CAST(unnest(range(30)) AS int) AS bin) b LEFT JOIN counts c ON c.column_name = s.column_name AND c.bin = b.bin""")
def _(spark, sf_dir):
    return _edges(P.scatter_matrix_diagonal(profiles(spark, sf_dir)))


@query("p_scatter_points", f"""WITH {SQL_PROFILES} SELECT temperature_degc, salinity_psu, pressure_decibar, latitude, longitude FROM profiles
WHERE temperature_degc IS NOT NULL AND salinity_psu IS NOT NULL""")
def _(spark, sf_dir):
    return P.scatter_points(profiles(spark, sf_dir))


@query("p_axis_stats", f"""WITH {SQL_PROFILES} SELECT 'x_axis' AS axis, 'pressure_decibar' AS column_name, min(pressure_decibar) AS min, max(pressure_decibar) AS max,
round(avg(pressure_decibar), 6) AS mean, count(pressure_decibar) AS count FROM profiles UNION ALL SELECT 'y_axis', 'temperature_degc', min(temperature_degc),
max(temperature_degc), round(avg(temperature_degc), 6), count(temperature_degc) FROM profiles""")
def _(spark, sf_dir):
    frame = profiles(spark, sf_dir)
    x, y = P.pick_columns(frame, "depth_profile")
    return P.axis_statistics(frame, x, y).withColumn("mean", F.round("mean", 6))


_LABELS = {**P.AXIS_LABELS, "vertical_sampling_scheme": "Vertical Sampling Scheme"}


@query("p_axis_labels", f"WITH {SQL_PROFILES} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{_LABELS[c]}' AS label, count(\"{c}\") AS n FROM profiles" for c in PROFILE_COLUMNS))
def _(spark, sf_dir):
    """Values per column, with the label that an axis of that column carries."""
    counts = profiles(spark, sf_dir).agg(*[F.count(c).alias(c) for c in PROFILE_COLUMNS])
    return P.with_axis_label(counts.unpivot([], PROFILE_COLUMNS, "column_name", "n"))


@query("p_source_sql", f"""WITH {SQL_PROFILES} SELECT basin, pressure_decibar, temperature_degc FROM profiles WHERE temperature_degc IS NOT NULL AND basin < 4""")
def _(spark, sf_dir):
    """Every row of a guarded statement, for a plot."""
    register_views(spark, profiles(spark, sf_dir))
    return plot_source(spark, "SELECT basin, pressure_decibar, temperature_degc FROM profiles WHERE temperature_degc IS NOT NULL AND basin < 4")
