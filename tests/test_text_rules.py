import pytest
from pyspark.sql import functions as F

from thermocline.operators import intent as I, sqlguard as G


def _audit(spark, sql, mode):
    row = G.audit(spark.createDataFrame([(sql,)], "sql string"), mode=mode).first()
    return row.reason if not row.accepted else None


@pytest.mark.parametrize("mode", ["word", "substring"])
@pytest.mark.parametrize("sql, accepted", [
    ("SELECT COUNT(*) as total_profiles FROM profiles", True),
    ("SELECT basin, COUNT(*) as count FROM profiles GROUP BY basin", True),
    ("SELECT AVG(temperature_degc) as avg_temp FROM profiles WHERE pressure_decibar < 100", True),
    ("SELECT * FROM profiles WHERE basin = 1 LIMIT 5", True),
    ("DROP TABLE profiles", False),
    ("SELECT * FROM invalid_table", False),
    ("INSERT INTO profiles VALUES (1,2,3)", False),
    ("SELECT * FROM profiles; DELETE FROM profiles", False),
    ("", False), (None, False), ("   ", False),
    ("SELECT 1 -- x", False), ("SELECT /* x */ 1", False),
    ("SELECT * FROM profiles;", True),
])
def test_documented_cases(spark, sql, accepted, mode):
    assert (_audit(spark, sql, mode) is None) == accepted


@pytest.mark.parametrize("sql, word, substring", [
    ("SELECT created_at FROM profiles", True, False),
    ("SELECT AVG(t) FROM profiles WHERE EXTRACT(month FROM timestamp) IN (6,7,8)", True, False),
    ("WITH w AS (SELECT basin FROM profiles) SELECT * FROM w", True, False),
    ("WITH w AS (SELECT basin FROM secrets) SELECT * FROM w", False, False),
    ("SELECT * FROM profiles p, secrets s", False, True),
    ("SELECT * FROM profiles AS p, measurements m WHERE p.basin = 1", True, True),
    ("SELECT * FROM `secrets`", False, True),
    ("SELECT a FROM profiles WHERE x = 'from secrets'", True, False),
    ("SELECT * FROM parquet.`/etc/data`", False, False),
    ("SELECT reflect('java.lang.System', 'exit', 1) FROM profiles", False, True),
    ("SELECT * FROM profiles; SELECT * FROM profiles;", False, True),
])
def test_modes_differ_where_intended(spark, sql, word, substring):
    assert (_audit(spark, sql, "word") is None, _audit(spark, sql, "substring") is None) == (word, substring)


@pytest.mark.parametrize("sql, reason", [
    ("SELECT 1 FROM profiles" + " JOIN profiles ON 1=1" * 6, "Too many JOIN operations (maximum 5 allowed)"),
    ("SELECT 1 FROM profiles" + " UNION SELECT 1 FROM profiles" * 4, "Too many UNION operations (maximum 3 allowed)"),
    ("SELECT " + "(" * 11 + "1" + ")" * 11 + " FROM profiles", "Query too complex (too many nested operations)"),
    ("SELECT " + "(" * 10 + "1" + ")" * 10 + " FROM profiles", None),
    ("UPSERT profiles", "Only SELECT queries are allowed"),
    ("SELECT * FROM b_table JOIN a_table ON 1=1", "Access to table 'a_table' is not allowed"),
])
def test_reasons(spark, sql, reason):
    assert _audit(spark, sql, "word") == reason


def test_guarded_execution(spark):
    G.register_views(spark, spark.range(50).select(
        (F.col("id") % 3).cast("int").alias("basin"), F.lit("2024-01-01").cast("timestamp").alias("timestamp"),
        F.lit(1).alias("cycle_number"), F.col("id").cast("double").alias("pressure_decibar"),
        F.when(F.col("id") < 10, 1.0).alias("temperature_degc"), F.lit(35.0).alias("salinity_psu")))
    assert G.guarded_sql(spark, "SELECT * FROM profiles;", cap=7).count() == 7
    with pytest.warns(UserWarning):
        assert G.guarded_sql(spark, "SELECT * FROM profiles LIMIT 20", cap=7).count() == 7
    assert G.guarded_sql(spark, "SELECT * FROM profiles", cap=None).count() == 50
    assert G.guarded_sql(spark, "SELECT count(*) AS n FROM measurements").first().n == 60
    with pytest.raises(ValueError, match="not allowed"):
        G.guarded_sql(spark, "SELECT * FROM secrets")
    names = {(r.table_name, r.column_name) for r in G.schema_info(spark).collect()}
    assert ("profiles", "basin") in names and ("measurements", "parameter_value") in names


@pytest.mark.parametrize("sql, kind", [
    ("select basin from profiles group by basin", "aggregate"), ("SELECT COUNT(*) FROM profiles", "aggregate"),
    ("SELECT MAX(x) FROM profiles", "simple_select"), ("SELECT * FROM a JOIN b WHERE x", "join"),
    ("SELECT * FROM a WHERE x = 1", "filtered_select"),
])
def test_query_type(spark, sql, kind):
    assert spark.createDataFrame([(sql,)], "s string").select(G.query_type(F.col("s"))).first()[0] == kind


def _scores(spark, text):
    return I.recommend(I.intent_scores(spark.createDataFrame([(text,)], "text string"))).first()


def test_intent_scores_by_hand(spark):
    row = _scores(spark, "Plot temperature over time")
    # plot: keywords plot, over time; pattern plot; boosts 0.4 and 0.3
    assert row.plot_timeseries_score == pytest.approx(4 / 28 + 0.7)
    # sql: keyword temperature of 19 + 7 patterns twice
    assert row.query_sql_score == pytest.approx(1 / 33)
    assert row.retrieve_docs_score == 0.0
    assert row.recommended == ["plot_timeseries"] and row.max_confidence == pytest.approx(0.7 * row.plot_timeseries_score)


def test_intent_default_and_empty(spark):
    assert _scores(spark, "hello").recommended == ["retrieve_docs"]
    assert _scores(spark, None).max_confidence == 0.0


def test_intent_close_second_and_model_scores(spark):
    df = I.intent_scores(spark.createDataFrame([("x", 1.0, 0.9)], "text string, a double, b double"))
    row = I.recommend(df, {"query_sql": "a", "plot_timeseries": "b"}).first()
    assert row.max_confidence == pytest.approx(0.3) and row.recommended == ["retrieve_docs"]  # 0.3 is not above 0.3
    df = I.intent_scores(spark.createDataFrame([("how many", 1.0, None)], "text string, a double, b double"))
    row = I.recommend(df, {"query_sql": "a", "retrieve_docs": "b"}).first()
    assert row.recommended == ["query_sql"]


@pytest.mark.parametrize("statement", [
    "SELECT * FROM (SELECT basin FROM profiles) a, secrets s",
    "SELECT p.basin FROM profiles p JOIN profiles t ON p.basin = t.basin, secrets s",
    "WITH secrets AS (SELECT * FROM secrets) SELECT * FROM secrets",
    "WITH w AS (TABLE secrets) SELECT * FROM w",
    "SELECT basin FROM profiles WHERE basin IN (TABLE secrets)",
    "SELECT * FROM profiles, range(5)",
    "SELECT * FROM (SELECT basin FROM profiles) a, IDENTIFIER('sec' || 'rets') s",
    "SELECT * FROM (SELECT basin FROM profiles) a, IDENTIFIER('secrets') s",
    "SELECT basin FROM profiles WHERE 's3cret' IN (SELECT id FROM (SELECT 1) z, IDENTIFIER(concat('sec','rets')))",
    "SELECT basin FROM profiles WHERE EXISTS (SELECT 1 FROM (SELECT 1) z, LATERAL (SELECT * FROM IDENTIFIER('secrets')))",
    "WITH profiles AS (SELECT id AS basin FROM IDENTIFIER('secrets')) SELECT * FROM profiles",
    "WITH w AS (SELECT 1) FROM w INSERT INTO stored SELECT *",
    "SELECT * FROM profiles, parquet.`/root`",
])
def test_execution_follows_the_parser(spark, statement):
    spark.range(3).selectExpr("CAST(id AS int) AS basin").createOrReplaceTempView("profiles")
    spark.range(3).createOrReplaceTempView("secrets")
    with pytest.raises(ValueError):
        G.guarded_sql(spark, statement)


@pytest.mark.parametrize("sql, accepted", [
    ("SELECT count(*) AS n FROM profiles WHERE vertical_sampling_scheme = 'drop -- update; /* x */'", True),
    ("SELECT 'it''s a merge' AS a, \"call me\" AS b FROM profiles", True),
    (r"SELECT 'a\'; drop' AS a FROM profiles", True),
    ("SELECT 'open FROM profiles; DROP TABLE profiles", False),
    (r"SELECT r'\' FROM profiles; DROP TABLE x WHERE a = '", False),
    ("SELECT 'x' FROM profiles -- '", False),
    ("SELECT '" + "x" * 100_000 + "' AS a FROM profiles", True),
])
def test_literals_break_no_rule(spark, sql, accepted):
    assert (_audit(spark, sql, "word") is None) == accepted
    assert (G.check(spark, sql) is None) == accepted


def test_a_check_runs_no_job(spark):
    spark.range(3).selectExpr("CAST(id AS int) AS basin").createOrReplaceTempView("profiles")
    sc = spark.sparkContext
    sc.setJobGroup("guard", "statements are judged without a job")
    try:
        for sql in ("SELECT basin FROM profiles", "DROP TABLE profiles", None, "WITH w AS (SELECT basin FROM profiles) SELECT * FROM w"):
            assert (G.check(spark, sql) is None) == bool(sql and not sql.startswith("DROP"))
        G.guarded_sql(spark, "SELECT basin, count(*) AS n FROM profiles GROUP BY basin")
        assert not sc.statusTracker().getJobIdsForGroup("guard")
        spark.range(3).count()
        assert sc.statusTracker().getJobIdsForGroup("guard")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_checks_agree_with_the_audit_of_a_log(spark):
    statements = ["SELECT 1 FROM profiles", "SELECT a FROM profiles, secrets", "", None, "SELECT 1; SELECT 2", "select x from profiles where y = 'drop'"]
    for mode in ("word", "substring"):
        log = G.audit(spark.createDataFrame([(x,) for x in statements], "sql string"), mode=mode).collect()
        assert [None if r.accepted else r.reason for r in log] == [G.check(spark, x, mode) for x in statements]


def test_basins_are_broadcast(spark):
    """Five rows of known size: profiles are joined where they were read, not sorted into five tasks."""
    from thermocline.schema import BASIN_NAMES, basins
    profiles = spark.createDataFrame([(i % 5 + 1,) for i in range(1000)], "basin int")  # of unknown size
    joined = profiles.join(basins(spark), "basin")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert basins(spark).dtypes == [("basin", "int"), ("basin_name", "string")]
    assert {(r.basin_name, r["count"]) for r in joined.groupBy("basin_name").count().collect()} == {(n, 200) for n in BASIN_NAMES.values()}
