"""Sample statements and SQL keywords."""

from checks.fixture import SQL_BASINS, SQL_PROFILES, profiles
from checks.registry import query
from thermocline.plans.statements import KEYWORDS, SAMPLES, ansi_text, spark_text
from thermocline.operators.sqlguard import guarded_sql, register_views
from thermocline.schema import basins


def _views(spark, sf_dir):
    register_views(spark, profiles(spark, sf_dir))
    basins(spark).createOrReplaceTempView("basins")


def _register(name, statement):
    text = ansi_text(statement)
    with_clause = f"WITH {SQL_PROFILES}, {SQL_BASINS}"
    sql = f"{with_clause}, {text[5:]}" if text.startswith("WITH ") else f"{with_clause} {text}"

    def run(spark, sf_dir):
        _views(spark, sf_dir)
        return guarded_sql(spark, spark_text(statement))

    query(name, sql)(run)


for _name, _statement in {**SAMPLES, **KEYWORDS}.items():
    _register(_name, _statement)


_GUARDED = ("SELECT basin, CAST(extract(year FROM {ts}) AS int) AS year_no, count(*) AS n FROM profiles "
            "GROUP BY basin, extract(year FROM {ts})")


@query("sql_guarded", f"WITH {SQL_PROFILES} {ansi_text(_GUARDED)}")
def _(spark, sf_dir):
    """A statement that a plain substring guard would refuse, run through the word guard."""
    _views(spark, sf_dir)
    return guarded_sql(spark, spark_text(_GUARDED))


@query("sql_long_measurements", f"""WITH {SQL_PROFILES}
SELECT parameter_name, count(*) AS n, round(sum(parameter_value), 4) AS total FROM (
SELECT 'temperature_degc' AS parameter_name, temperature_degc AS parameter_value FROM profiles
UNION ALL SELECT 'salinity_psu', salinity_psu FROM profiles) u WHERE parameter_value IS NOT NULL GROUP BY parameter_name""")
def _(spark, sf_dir):
    """The long measurements view, through the guard."""
    _views(spark, sf_dir)
    return guarded_sql(spark, "SELECT parameter_name, count(*) AS n, round(sum(parameter_value), 4) AS total "
                              "FROM measurements GROUP BY parameter_name")
