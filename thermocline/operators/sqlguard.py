"""Read-only SQL: an audit of statement texts and guarded execution."""

import re
import warnings

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Rules and limits for statements.
FORBIDDEN = [
    "drop", "delete", "insert", "update", "create", "alter", "truncate",
    "grant", "revoke", "exec", "execute", "sp_", "xp_", "cmdshell",
    "bulk", "openrowset", "opendatasource", "shutdown", "backup",
    "restore", "dbcc", "merge", "call", "procedure", "function",
]
ALLOWED_TABLES = ["profiles", "trajectory", "measurements", "basins"]
MAX_JOINS, MAX_UNIONS, MAX_PARENTHESES = 5, 3, 10
ACCEPTED = "Query validated successfully"

# Spark functions that reach outside the data.
_ESCAPES = ["reflect", "java_method", "try_reflect", "read_files", "load_file"]
_NAME_LIST = r"(\w+(?:\s+(?:as\s+)?(?!(?:where|join|inner|left|right|full|cross|on|group|order|limit|having|union|offset)\b)\w+)?(?:\s*,\s*\w+(?:\s+(?:as\s+)?\w+)?)*)"


# String literals as Spark reads them, quotes doubled or escaped inside.
_LITERAL = r"""'[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+'|"[^"\\]*+(?:(?:\\.|"")[^"\\]*+)*+\""""


def without_literals(sql: Column) -> Column:
    """The statement with empty string literals, so that their contents break no rule.

    Raw literals (r'...') end elsewhere; a statement that may hold one is taken as it is.
    """
    return F.when(sql.rlike(r"(?i)\br['\"]"), sql).otherwise(F.regexp_replace(sql, _LITERAL, "''"))


def _occurrences(text: Column, word: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def referenced_tables(lowered: Column, mode: str) -> Column:
    """Distinct names that follow FROM and JOIN, in name order.

    "substring" takes one word after each; "word" also follows comma lists, ignores the FROM inside
    EXTRACT, TRIM and the like, and leaves out names that a WITH clause defines.
    """
    if mode == "substring":
        found = F.concat(F.regexp_extract_all(lowered, F.lit(r"from\s+(\w+)"), 1),
                         F.regexp_extract_all(lowered, F.lit(r"join\s+(\w+)"), 1))
        return F.sort_array(F.array_distinct(found))
    text = F.regexp_replace(F.translate(lowered, "`", " "), r"'[^']*'", "''")
    text = F.regexp_replace(text, r"\b(extract|trim|substring|overlay)\s*\(([^()]*)\bfrom\b", "$1($2 ")
    lists = F.regexp_extract_all(text, F.lit(r"\bfrom\s+" + _NAME_LIST), 1)
    names = F.flatten(F.transform(lists, lambda x: F.transform(
        F.split(x, ","), lambda y: F.regexp_extract(F.trim(y), r"^(\w+)", 1))))
    joins = F.regexp_extract_all(text, F.lit(r"\bjoin\s+(?:lateral\s+)?(\w+)"), 1)
    defined = F.regexp_extract_all(text, F.lit(r"(?:\bwith\s+|,\s*)(\w+)\s+as\s*\("), 1)
    return F.sort_array(F.array_except(F.array_distinct(F.concat(names, joins)), defined))


def verdict(sql: Column, mode: str = "word", tables=ALLOWED_TABLES) -> Column:
    """Why a statement is refused, or that it is accepted; the first broken rule counts."""
    if mode not in ("word", "substring"):
        raise ValueError("mode must be 'word' or 'substring'")
    word = mode == "word"
    if word:
        sql = without_literals(sql)
    lowered = F.lower(F.trim(sql))

    def whole(keyword):
        return keyword + ("" if keyword.endswith("_") else r"\b")

    keywords = FORBIDDEN + (_ESCAPES if word else [])
    named = F.coalesce(*[F.when(lowered.rlike(r"\b" + whole(k)) if word else lowered.contains(k), k)
                         for k in keywords])
    if word:  # one pass tells most statements from those worth a closer look
        named = F.when(lowered.rlike(r"\b(?:" + "|".join(map(whole, keywords)) + ")"), named)
    if word:
        starts = lowered.rlike(r"^(select|with)\b")
        several = F.rtrim(sql).rlike(r";(?s:.)*\S")
    else:
        starts = lowered.startswith("select")
        several = sql.contains(";") & ~F.rtrim(sql).endswith(";")
    refused = F.array_except(referenced_tables(lowered, mode), F.array(*map(F.lit, tables)))
    # Each term is null when its rule holds; the first that is not gives the reason.
    return F.coalesce(
        F.when(F.trim(F.coalesce(sql, F.lit(""))) == "", "SQL query cannot be empty"),
        F.concat(F.lit("Forbidden keyword detected: "), named),
        F.when(~starts, "Only SELECT queries are allowed"),
        F.when(several, "Multiple SQL statements are not allowed"),
        F.when(sql.contains("--") | sql.contains("/*"), "SQL comments are not allowed"),
        F.concat(F.lit("Access to table '"), F.try_element_at(refused, F.lit(1)), F.lit("' is not allowed")),
        F.when(_occurrences(lowered, "join") > MAX_JOINS,
               f"Too many JOIN operations (maximum {MAX_JOINS} allowed)"),
        F.when(_occurrences(lowered, "union") > MAX_UNIONS,
               f"Too many UNION operations (maximum {MAX_UNIONS} allowed)"),
        F.when(_occurrences(sql, "(") > MAX_PARENTHESES, "Query too complex (too many nested operations)"),
        F.lit(ACCEPTED))


def audit(log: DataFrame, sql_col="sql", mode: str = "word") -> DataFrame:
    """Add ``accepted`` (0/1) and ``reason`` to a table of logged statements."""
    return (log.withColumn("reason", verdict(F.col(sql_col), mode))
            .withColumn("accepted", (F.col("reason") == ACCEPTED).cast("int")))


def query_type(sql: Column) -> Column:
    lowered = F.lower(F.trim(sql))
    aggregate = (lowered.contains("group by") | lowered.contains("count(")
                 | lowered.contains("sum(") | lowered.contains("avg("))
    return (F.when(aggregate, "aggregate").when(lowered.contains("join"), "join")
            .when(lowered.contains("where"), "filtered_select").otherwise("simple_select"))


def check(spark: SparkSession, sql: str, mode: str = "word") -> str:
    """Reason for refusing one statement, None when it is accepted. The optimizer evaluates the rules; no job runs."""
    one = spark.sql("SELECT * FROM VALUES (CAST(:statement AS string)) AS t(sql)", args={"statement": sql})
    row = one.select(verdict(F.col("sql"), mode).alias("reason")).first()
    return None if row.reason == ACCEPTED else row.reason


def outside_relations(spark: SparkSession, sql: str, tables=ALLOWED_TABLES) -> list:
    """What a statement reads or does beyond the views ``tables``, in the plan that Spark's analyser makes of it.

    Every leaf of the plan and of its subqueries must lie in one of these temporary views, or be a literal row or the use
    of a WITH name, whose definition is part of the plan. Names are resolved by then, whether they were spelled out, in
    comma lists or made up by IDENTIFIER. Commands are not run and not allowed.
    """
    jvm, state = spark._jvm, spark._jsparkSession.sessionState()
    parsed = state.sqlParser().parsePlan(sql)
    skip = jvm.org.apache.spark.sql.execution.CommandExecutionMode.SKIP()
    command = jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command")
    beyond, todo = set(), [state.executePlan(parsed, skip).analyzed()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "View":
            name = node.desc().identifier().unquotedString().lower()
            if not node.isTempView() or name not in tables:
                beyond.add(name)
            continue
        children, inner = node.children(), node.subqueries()
        if command.isInstance(node) or (children.isEmpty() and kind not in _OWN_LEAVES):
            beyond.add(_relation_name(node, kind))
        todo += [x.apply(i) for x in (children, inner) for i in range(x.size())]
    return sorted(beyond)


#: Leaves that hold no data but the statement's own.
_OWN_LEAVES = {"OneRowRelation", "OneRowRelation$", "LocalRelation", "CTERelationRef"}


def _relation_name(node, kind: str) -> str:
    return f"{kind.rstrip('$').lower()}()" if kind in ("Range", "ResolvedTableValuedFunction") else node.nodeName()


def guarded_sql(spark: SparkSession, sql: str, cap: int = None, mode: str = "word") -> DataFrame:
    """Run one read-only statement over the registered views, completely unless the caller sets a ``cap``.

    With a cap, a result that is longer gives a warning. Its first rows are then those by the statement's own
    ORDER BY, if that comes last, else by all columns.
    """
    refused = check(spark, sql, mode)
    if refused:
        raise ValueError(refused)
    statement = sql.strip().rstrip(";")
    if beyond := outside_relations(spark, statement):
        raise ValueError(f"Access to these relations is not allowed: {', '.join(beyond)}")
    result = spark.sql(statement)
    if cap is None:
        return result
    if result.limit(cap + 1).count() > cap:
        warnings.warn(f"the result has more than {cap} rows and was cut", stacklevel=2)
    ordered = re.search(r"\border\s+by\b[^()]*$", statement, re.IGNORECASE)
    return (result if ordered else result.orderBy(*[F.col(f"`{c}`") for c in result.columns])).limit(cap)


def register_views(spark: SparkSession, profiles: DataFrame, trajectory: DataFrame = None,
                   measurements: DataFrame = None) -> None:
    """Make the frames available under the names that statements may use."""
    views = {"profiles": profiles, "trajectory": trajectory,
             "measurements": long_measurements(profiles) if measurements is None else measurements}
    for name, df in views.items():
        if df is not None:
            df.createOrReplaceTempView(name)


def long_measurements(profiles: DataFrame) -> DataFrame:
    """One row per measured quantity."""
    keys = ["basin", "timestamp", "cycle_number", "pressure_decibar"]
    return (profiles.unpivot(keys, ["temperature_degc", "salinity_psu"], "parameter_name", "parameter_value")
            .filter(F.col("parameter_value").isNotNull()))


def schema_info(spark: SparkSession, tables=ALLOWED_TABLES) -> DataFrame:
    """Columns, types and comments of the registered views."""
    rows = []
    for table in tables:
        if spark.catalog.tableExists(table):
            for field in spark.table(table).schema:
                rows.append((table, field.name, field.dataType.simpleString(), field.nullable,
                             field.metadata.get("comment", "")))
    return spark.createDataFrame(
        rows, "table_name string, column_name string, data_type string, nullable boolean, comment string")
