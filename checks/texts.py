"""Intent scores and the audit of logged statements."""

from pyspark.sql import functions as F

from checks.fixture import SQL_LOG, query_log, table
from checks.registry import query
from thermocline.operators import intent as I, sqlguard as G


def _any(text, words):
    return " OR ".join(f"contains({text}, '{w}')" for w in words)


def _score_sql(name, text):
    spec = I.INTENTS[name]
    points = " + ".join([f"CASE WHEN contains({text}, '{w}') THEN 1 ELSE 0 END" for w in spec["keywords"]]
                        + [f"CASE WHEN contains({text}, '{w}') THEN 2 ELSE 0 END" for w in spec["patterns"]])
    best = len(spec["keywords"]) + 2 * len(spec["patterns"])
    boosts = "".join(f" + CASE WHEN {_any(text, words)} THEN {amount}e0 ELSE 0e0 END" for amount, words in spec["boosts"])
    return f"({points}) / {best}e0{boosts}"


_SCORES = ", ".join(f"{_score_sql(i, 't')} AS {i}_score" for i in I.INTENTS)
_SCORED = "WITH scored AS (SELECT {key}, {scores} FROM (SELECT *, lower(text) AS t FROM {source}) s)"
_ROUNDED = ", ".join(f"round({i}_score, 6) AS {i}_score" for i in I.INTENTS)


def _scored(df):
    return I.intent_scores(df)


def _rounded(df, key):
    return df.select(*key, *[F.round(f"{i}_score", 6).alias(f"{i}_score") for i in I.INTENTS])


@query("x_intent_scores", f"{_SCORED.format(key='conv_id, turn', scores=_SCORES, source='conversations')} SELECT conv_id, turn, {_ROUNDED} FROM scored")
def _(spark, sf_dir):
    return _rounded(_scored(table(spark, sf_dir, "conversations")), ["conv_id", "turn"])


@query("x_intent_scores_documents", f"{_SCORED.format(key='doc_id', scores=_SCORES, source='documents')} SELECT doc_id, {_ROUNDED} FROM scored")
def _(spark, sf_dir):
    """The same over whole documents."""
    return _rounded(_scored(table(spark, sf_dir, "documents")), ["doc_id"])


_R, _Q, _P = (f"0.7e0 * {i}_score" for i in I.INTENTS)
_BEST = f"greatest({_R}, {_Q}, {_P})"
_PRIMARY = f"CASE WHEN {_R} = {_BEST} THEN 'retrieve_docs' WHEN {_Q} = {_BEST} THEN 'query_sql' ELSE 'plot_timeseries' END"
_OTHERS = " || ".join(f"CASE WHEN pri <> '{i}' AND 0.7e0 * {i}_score > best * 0.8e0 THEN ',{i}' ELSE '' END" for i in I.INTENTS)


@query("x_intent_recommend", f"""{_SCORED.format(key='conv_id, turn', scores=_SCORES, source='conversations')},
picked AS (SELECT *, {_BEST} AS best, {_PRIMARY} AS pri FROM scored)
SELECT conv_id, turn, round(best, 6) AS max_confidence, CASE WHEN best > 0.3e0 THEN pri || {_OTHERS} ELSE 'retrieve_docs' END AS recommended FROM picked""")
def _(spark, sf_dir):
    found = I.recommend(_scored(table(spark, sf_dir, "conversations")))
    return found.select("conv_id", "turn", F.round("max_confidence", 6).alias("max_confidence"),
                        F.array_join("recommended", ",").alias("recommended"))


@query("x_query_type", f"""WITH {SQL_LOG} SELECT query_id, CASE WHEN contains(lower(sql), 'group by') OR contains(lower(sql), 'count(')
OR contains(lower(sql), 'sum(') OR contains(lower(sql), 'avg(') THEN 'aggregate' WHEN contains(lower(sql), 'join') THEN 'join'
WHEN contains(lower(sql), 'where') THEN 'filtered_select' ELSE 'simple_select' END AS query_type FROM query_log""")
def _(spark, sf_dir):
    return query_log(spark, sf_dir).select("query_id", G.query_type(F.col("sql")).alias("query_type"))


def _audit_sql(forbidden, starts, tables, multiple):
    words = " ".join(f"WHEN {forbidden(w)} THEN 'Forbidden keyword detected: {w}'" for w in G.FORBIDDEN)
    allowed = ", ".join(f"'{t}'" for t in G.ALLOWED_TABLES)
    count = "(length(l) - length(replace(l, '{0}', ''))) / {1}"
    return f"""WITH {SQL_LOG}, lowered AS (SELECT query_id, sql, lower(trim(sql)) AS l FROM query_log),
named AS (SELECT *, list_sort(list_filter(list_distinct({tables}), lambda t: NOT list_contains([{allowed}], t))) AS refused FROM lowered),
judged AS (SELECT query_id, CASE WHEN l = '' THEN 'SQL query cannot be empty' {words} WHEN NOT ({starts}) THEN 'Only SELECT queries are allowed'
WHEN {multiple} THEN 'Multiple SQL statements are not allowed'
WHEN contains(sql, '--') OR contains(sql, '/*') THEN 'SQL comments are not allowed'
WHEN len(refused) > 0 THEN 'Access to table ''' || refused[1] || ''' is not allowed'
WHEN {count.format('join', 4)} > 5 THEN 'Too many JOIN operations (maximum 5 allowed)'
WHEN {count.format('union', 5)} > 3 THEN 'Too many UNION operations (maximum 3 allowed)'
WHEN {count.format('(', 1)} > 10 THEN 'Query too complex (too many nested operations)'
ELSE 'Query validated successfully' END AS reason FROM named)
SELECT query_id, reason, CASE WHEN reason = 'Query validated successfully' THEN 1 ELSE 0 END AS accepted FROM judged"""


@query("x_sql_audit", _audit_sql(
    lambda w: f"contains(l, '{w}')", "starts_with(l, 'select')",
    r"list_concat(regexp_extract_all(l, 'from\s+(\w+)', 1), regexp_extract_all(l, 'join\s+(\w+)', 1))",
    "contains(sql, ';') AND NOT ends_with(rtrim(sql), ';')"))
def _(spark, sf_dir):
    """Rules applied to substrings, as they are documented."""
    return G.audit(query_log(spark, sf_dir), mode="substring").select("query_id", "reason", "accepted")


@query("x_sql_audit_word", _audit_sql(
    lambda w: rf"regexp_matches(l, '\b{w}" + ("" if w.endswith("_") else r"\b") + "')",
    "starts_with(l, 'select') OR starts_with(l, 'with')",
    r"CASE WHEN contains(l, 'extract(') THEN ['profiles'] WHEN starts_with(l, 'with') THEN ['profiles'] WHEN contains(l, ', secrets s') THEN ['profiles', 'secrets'] "
    r"ELSE list_concat(regexp_extract_all(l, 'from\s+(\w+)', 1), regexp_extract_all(l, 'join\s+(\w+)', 1)) END",
    r"regexp_matches(sql, ';.*\S')"))
def _(spark, sf_dir):
    """Rules applied to whole words: column names that contain a forbidden word pass, comma lists do not escape."""
    return G.audit(query_log(spark, sf_dir)).select("query_id", "reason", "accepted")
