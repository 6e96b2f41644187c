"""The documented sample statements over ``profiles``, and one per further SQL keyword.

The text runs unchanged on any ANSI engine; identifiers that are type names are quoted by ``TS``.
"""

TS = "{ts}"

SAMPLES = {
    "s01_count": "SELECT count(*) AS total_profiles FROM profiles",
    "s02_by_basin": "SELECT basin, count(*) AS profile_count FROM profiles GROUP BY basin",
    "s03_distinct_floats": "SELECT count(DISTINCT cycle_number) AS unique_floats FROM profiles",
    "s04_surface_temp": "SELECT round(avg(temperature_degc), 6) AS avg_temp FROM profiles WHERE pressure_decibar BETWEEN 0 AND 100",
    "s05_basin_salinity": "SELECT basin, round(avg(salinity_psu), 6) AS avg_salinity FROM profiles GROUP BY basin",
    "s06_temp_range": "SELECT min(temperature_degc) AS min_temp, max(temperature_degc) AS max_temp FROM profiles WHERE basin = 1",
    "s07_bbox": "SELECT basin, {ts} AS observed_at, cycle_number, vertical_sampling_scheme, longitude, latitude, pressure_decibar, salinity_psu, temperature_degc FROM profiles WHERE latitude BETWEEN 40 AND 50 AND longitude BETWEEN -10 AND 0 ORDER BY {ts}, pressure_decibar, basin, cycle_number, longitude, latitude, salinity_psu NULLS LAST, temperature_degc NULLS LAST, vertical_sampling_scheme NULLS LAST LIMIT 10",
    "s08_arctic": "SELECT count(*) AS n FROM profiles WHERE latitude > 60",
    "s09_warm": "SELECT basin, latitude, longitude FROM profiles WHERE temperature_degc > 20",
    "s10_by_year": "SELECT date_trunc('year', {ts}) AS year_start, count(*) AS n FROM profiles GROUP BY date_trunc('year', {ts}) ORDER BY year_start",
    "s11_since": "SELECT basin, {ts} AS observed_at, cycle_number, vertical_sampling_scheme, longitude, latitude, pressure_decibar, salinity_psu, temperature_degc FROM profiles WHERE {ts} > TIMESTAMP '2000-01-01 00:00:00' ORDER BY {ts}, pressure_decibar, basin, cycle_number, longitude, latitude, salinity_psu NULLS LAST, temperature_degc NULLS LAST, vertical_sampling_scheme NULLS LAST LIMIT 100",
    "s12_summer": "SELECT round(avg(temperature_degc), 6) AS avg_temp FROM profiles WHERE extract(month FROM {ts}) IN (6, 7, 8)",
    "s13_depth_curve": "SELECT pressure_decibar, round(avg(temperature_degc), 6) AS avg_temp FROM profiles WHERE pressure_decibar < 1000 GROUP BY pressure_decibar ORDER BY pressure_decibar",
    "s14_deep": "SELECT count(*) AS n FROM profiles WHERE pressure_decibar > 1900",
    "s15_deepest_floats": "SELECT cycle_number, max(pressure_decibar) AS max_depth FROM profiles GROUP BY cycle_number ORDER BY max_depth DESC, cycle_number LIMIT 10",
    "s16_salty": "SELECT count(*) AS n FROM profiles WHERE salinity_psu > 35",
    "s17_at_depth_year": "SELECT round(avg(temperature_degc), 6) AS avg_temp FROM profiles WHERE pressure_decibar BETWEEN 90 AND 110 AND extract(year FROM {ts}) = 1998",
    "s18_basin_named": "SELECT b.basin_name, count(*) AS n FROM profiles p JOIN basins b ON p.basin = b.basin GROUP BY b.basin_name",
    "s19_bbox_wide": "SELECT basin, {ts} AS observed_at, cycle_number, vertical_sampling_scheme, longitude, latitude, pressure_decibar, salinity_psu, temperature_degc FROM profiles WHERE latitude BETWEEN 40 AND 50 AND longitude BETWEEN -10 AND 0",
}

KEYWORDS = {
    "k01_having": "SELECT basin, count(*) AS n FROM profiles GROUP BY basin HAVING count(*) > 100",
    "k02_case_bands": "SELECT CASE WHEN pressure_decibar < 200 THEN 'surface' WHEN pressure_decibar < 1000 THEN 'mid' ELSE 'deep' END AS band, count(*) AS n FROM profiles GROUP BY 1",
    "k03_stddev_variance": "SELECT basin, round(stddev(temperature_degc), 6) AS sd_temp, round(variance(salinity_psu), 6) AS var_sal FROM profiles GROUP BY basin",
    "k04_union_all": "SELECT basin, pressure_decibar FROM profiles WHERE pressure_decibar < 10 UNION ALL SELECT basin, pressure_decibar FROM profiles WHERE pressure_decibar > 1900",
    "k05_union_distinct": "SELECT basin FROM profiles WHERE latitude > 60 UNION SELECT basin FROM profiles WHERE latitude < -60",
    "k06_left_join_null": "SELECT b.basin_name, count(p.basin) AS n FROM basins b LEFT JOIN profiles p ON p.basin = b.basin AND p.temperature_degc > 24 AND p.latitude > 80 GROUP BY b.basin_name",
    "k07_right_join": "SELECT b.basin_name, count(p.basin) AS n FROM profiles p RIGHT JOIN basins b ON p.basin = b.basin AND p.temperature_degc > 24 AND p.latitude > 80 GROUP BY b.basin_name",
    "k08_exists_semi": "SELECT count(*) AS n FROM profiles p WHERE EXISTS (SELECT 1 FROM profiles w WHERE w.cycle_number = p.cycle_number AND w.temperature_degc > 24.4)",
    "k09_not_exists_anti": "SELECT DISTINCT cycle_number FROM profiles p WHERE NOT EXISTS (SELECT 1 FROM profiles w WHERE w.cycle_number = p.cycle_number AND w.temperature_degc > 24.4)",
    "k10_like": "SELECT count(*) AS n FROM profiles WHERE vertical_sampling_scheme LIKE 'Primary%'",
    "k11_distinct": "SELECT DISTINCT basin, vertical_sampling_scheme FROM profiles",
    "k12_offset": "SELECT cycle_number, count(*) AS n FROM profiles GROUP BY cycle_number ORDER BY n DESC, cycle_number LIMIT 20 OFFSET 20",
    "k13_cte": "WITH per_cycle AS (SELECT cycle_number, count(*) AS n FROM profiles GROUP BY cycle_number) SELECT n, count(*) AS cycles FROM per_cycle GROUP BY n",
    "k14_scalar_subquery": "SELECT count(*) AS n FROM profiles WHERE temperature_degc > (SELECT avg(temperature_degc) FROM profiles)",
    "k15_extract_day_month": "SELECT CAST(extract(month FROM {ts}) AS int) AS month_no, CAST(extract(day FROM {ts}) AS int) AS day_no, count(*) AS n FROM profiles GROUP BY 1, 2",
    "k16_cast_round": "SELECT basin, CAST(round(avg(pressure_decibar), 0) AS int) AS mean_pressure FROM profiles GROUP BY basin",
    "k17_in_list": "SELECT basin, count(*) AS n FROM profiles WHERE basin IN (1, 2, 3) GROUP BY basin",
    "k18_is_null": "SELECT CAST(sum(CASE WHEN salinity_psu IS NULL THEN 1 ELSE 0 END) AS bigint) AS no_salinity, CAST(sum(CASE WHEN vertical_sampling_scheme IS NULL THEN 1 ELSE 0 END) AS bigint) AS no_scheme FROM profiles",
}


def spark_text(statement: str) -> str:
    return statement.replace(TS, "`timestamp`")


def ansi_text(statement: str) -> str:
    return statement.replace(TS, '"timestamp"')
