"""Chunking."""

from pyspark.sql import functions as F

from checks.fixture import SQL_PROFILES
from checks.quality import clean_profiles
from checks.registry import query
from thermocline.functions.rendering import fixed_point
from thermocline.operators import chunking as C

_CLEAN = f"""{SQL_PROFILES}, clean AS (SELECT basin, "timestamp" AS ts, cycle_number, coalesce(vertical_sampling_scheme, '') AS scheme,
longitude, latitude, pressure_decibar AS p, coalesce(temperature_degc, 0e0) AS t, coalesce(salinity_psu, 0e0) AS s
FROM profiles WHERE pressure_decibar >= 0 AND longitude BETWEEN -180 AND 180 AND latitude BETWEEN -90 AND 90)"""
_LINE = "printf('  %3d. Pressure: %6.1f dbar, Temperature: %6.3f°C, Salinity: %6.3f PSU', i, m.p, m.t, m.s)"


def _header(n):
    return (f"'ARGO Float Profile - Timestamp: ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || chr(10) || "
            f"printf('Location: %.6f°N, %.6f°E', latitude, longitude) || chr(10) || "
            f"'Basin: ' || basin || ', Cycle: ' || cycle_number || chr(10) || 'Sampling Scheme: ' || scheme || chr(10) || "
            f"'Profile Depth Points: ' || {n} || chr(10)")


def _text(ms):
    return (f"{_header(f'len({ms})')} || chr(10) || 'Depth Profile Measurements:' || chr(10) || "
            f"array_to_string(list_transform({ms}, lambda m, i: {_LINE}), chr(10))")


def _preview(ms):
    more = f"CASE WHEN len({ms}) > 10 THEN chr(10) || '  ... and ' || (len({ms}) - 10) || ' more measurements' ELSE '' END"
    return (f"{_header(f'len({ms})')} || chr(10) || 'Depth Profile Measurements:' || chr(10) || "
            f"array_to_string(list_transform({ms}[1:10], lambda m, i: {_LINE}), chr(10)) || {more}")


SQL_CHUNKS = f"""{_CLEAN}, grouped AS (SELECT ts, count(*) AS n, list({{'p': p, 't': t, 's': s}} ORDER BY p, t, s) AS ms,
first({{'basin': basin, 'cycle_number': cycle_number, 'scheme': scheme, 'longitude': longitude, 'latitude': latitude}}
ORDER BY p, t, s, basin, cycle_number, scheme, longitude, latitude) AS f FROM clean GROUP BY ts),
flat AS (SELECT ts, n, ms, f.basin AS basin, f.cycle_number AS cycle_number, f.scheme AS scheme, f.longitude AS longitude,
f.latitude AS latitude FROM grouped),
sized AS (SELECT *, length({_text('ms')}) > 2000 AS split FROM flat),
counted AS (SELECT *, CASE WHEN split THEN CAST(ceil(n / 15e0) AS bigint) ELSE 1 END AS parts FROM sized),
numbered AS (SELECT *, CAST(coalesce(sum(parts) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS before FROM counted),
pieces AS (SELECT * EXCLUDE (ms), unnest(range(parts)) AS part, ms AS whole FROM numbered),
cut AS (SELECT * EXCLUDE (whole), CASE WHEN split THEN whole[part * 15 + 1 : part * 15 + 15] ELSE whole END AS ms FROM pieces),
chunks AS (SELECT *, before + part AS chunk_number,
printf('argo_timestamp_%06d', before) || CASE WHEN split THEN printf('_part_%02d', part) ELSE '' END AS chunk_id,
strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp_text, len(ms) AS profile_count,
CASE WHEN split THEN printf('Part %d, depths %d-%d', part + 1, part * 15 + 1, part * 15 + len(ms)) END AS sub_chunk_info,
'argo_floats' AS source, CASE WHEN split THEN 'temporal_profile_split' ELSE 'temporal_profile' END AS chunk_type,
{_text('ms')} AS text, {_preview('ms')} AS preview FROM cut)"""


def chunks(spark, sf_dir):
    return C.chunk_profiles(clean_profiles(spark, sf_dir))


@query("c_group", f"""WITH {SQL_CHUNKS} SELECT ts AS observed_at, n AS profile_count, basin, cycle_number,
scheme AS vertical_sampling_scheme, longitude, latitude FROM numbered""")
def _(spark, sf_dir):
    facts = C.group_facts(clean_profiles(spark, sf_dir))
    return facts.select(F.col("timestamp").alias("observed_at"), F.col("n").alias("profile_count"), "meta.basin",
                        "meta.cycle_number", "meta.vertical_sampling_scheme", "meta.longitude", "meta.latitude")


@query("c_measurements", f"""WITH {SQL_CHUNKS} SELECT chunk_id,
array_to_string(list_transform(ms, lambda m: printf('%.2f/%.3f/%.3f', m.p, m.t, m.s)), ';') AS readings FROM chunks""")
def _(spark, sf_dir):
    reading = F.transform("measurements", lambda m: F.concat_ws(
        "/", fixed_point(m["pressure_decibar"], 2), fixed_point(m["temperature_degc"], 3),
        fixed_point(m["salinity_psu"], 3)))
    return chunks(spark, sf_dir).select("chunk_id", F.array_join(reading, ";").alias("readings"))


@query("c_text", f"WITH {SQL_CHUNKS} SELECT chunk_id, text FROM chunks")
def _(spark, sf_dir):
    return C.with_text(chunks(spark, sf_dir)).select("chunk_id", "text")


@query("c_split", f"""WITH {SQL_CHUNKS} SELECT chunk_id, chunk_type, sub_chunk_info, profile_count, basin, cycle_number,
latitude, longitude, source FROM chunks""")
def _(spark, sf_dir):
    return chunks(spark, sf_dir).select(
        "chunk_id", "chunk_type", "metadata.sub_chunk_info", F.col("metadata.profile_count").cast("long").alias("profile_count"),
        "metadata.basin", "metadata.cycle_number", "metadata.latitude", "metadata.longitude", "source")


@query("c_split_spread", f"""WITH {SQL_CHUNKS} SELECT chunk_id, sub_chunk_info, text FROM chunks""")
def _(spark, sf_dir):
    """The same chunks with every split group on the path for groups too large for one task."""
    spread = C.chunk_profiles(clean_profiles(spark, sf_dir), hot_rows=0, few_keys=0)
    return C.with_text(spread).select("chunk_id", "metadata.sub_chunk_info", "text")


@query("c_chunk_id", f"WITH {SQL_CHUNKS} SELECT chunk_id, chunk_number, ts AS observed_at, timestamp_text FROM chunks")
def _(spark, sf_dir):
    return chunks(spark, sf_dir).select("chunk_id", "chunk_number", "observed_at", F.col("timestamp").alias("timestamp_text"))


@query("c_chunk_id_many", f"WITH {SQL_CHUNKS} SELECT chunk_id, chunk_number, ts AS observed_at FROM chunks")
def _(spark, sf_dir):
    """The same numbers on the path for more groups than one window may see."""
    return C.chunk_profiles(clean_profiles(spark, sf_dir), few_keys=0).select("chunk_id", "chunk_number", "observed_at")


@query("c_stats", f"""WITH {SQL_CHUNKS}, sizes AS (SELECT CAST(length(text) AS int) AS l, CAST(len(ms) AS int) AS m, chunk_type FROM chunks)
SELECT count(*) AS total_chunks, min(l) AS text_min, max(l) AS text_max, round(avg(l), 6) AS text_mean,
(SELECT l FROM (SELECT l, row_number() OVER (ORDER BY l) AS r FROM sizes) x WHERE r = (SELECT count(*) // 2 + 1 FROM sizes)) AS text_median_upper,
min(m) AS measurements_min, max(m) AS measurements_max, round(avg(m), 6) AS measurements_mean,
CAST(sum(m) AS bigint) AS measurements_total,
count(*) FILTER (WHERE chunk_type = 'temporal_profile') AS whole_chunks,
count(*) FILTER (WHERE chunk_type = 'temporal_profile_split') AS split_chunks,
count(*) FILTER (WHERE l > 2000) AS oversized_chunks FROM sizes""")
def _(spark, sf_dir):
    stats = C.chunk_statistics(chunks(spark, sf_dir))
    return stats.withColumns({c: F.round(c, 6) for c in ("text_mean", "measurements_mean")})


@query("c_preview_text", f"WITH {SQL_CHUNKS} SELECT chunk_id, preview FROM chunks")
def _(spark, sf_dir):
    return C.with_preview(chunks(spark, sf_dir)).select("chunk_id", F.col("text").alias("preview"))


@query("c_explode", f"""WITH {SQL_CHUNKS} SELECT chunk_id, timestamp_text, latitude, longitude, basin, cycle_number,
m.p AS pressure_decibar, m.t AS temperature_degc, m.s AS salinity_psu FROM (SELECT *, unnest(ms) AS m FROM chunks) u""")
def _(spark, sf_dir):
    return C.explode_measurements(chunks(spark, sf_dir)).withColumnRenamed("timestamp", "timestamp_text")
