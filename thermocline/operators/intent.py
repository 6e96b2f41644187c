"""Intent scores of free-text questions, as plain column expressions over a table of texts."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Word lists, boosts and weights per intent.
INTENTS = {
    "retrieve_docs": {
        "keywords": ["what", "show", "find", "about", "information", "context", "similar",
                     "conditions", "profiles", "explain", "describe", "ocean", "atlantic",
                     "pacific", "indian", "mediterranean", "basin", "region", "area"],
        "patterns": ["what are", "show me", "find", "explain", "describe", "information about"],
        "boosts": [(0.2, ["what", "explain", "about", "information"])],
    },
    "query_sql": {
        "keywords": ["how many", "count", "average", "maximum", "minimum", "between",
                     "statistics", "data", "number", "total", "sum", "range", "filter",
                     "where", "measurements", "records", "depth", "temperature", "salinity"],
        "patterns": ["how many", "count", "average", "max", "min", "statistics", "data for"],
        "boosts": [(0.3, ["how many", "count", "average", "total", "statistics"]),
                   (0.2, ["between", "range", "from", "to", "where"])],
    },
    "plot_timeseries": {
        "keywords": ["plot", "chart", "graph", "visualize", "show", "display", "create",
                     "time series", "trends", "versus", "vs", "over time", "profile",
                     "visualization", "draw", "generate"],
        "patterns": ["plot", "chart", "graph", "visualize", "show graph", "create plot"],
        "boosts": [(0.4, ["plot", "chart", "graph", "visualize"]),
                   (0.3, ["time series", "over time", "trend"])],
    },
}
RULE_WEIGHT, MODEL_WEIGHT = 0.7, 0.3
CONFIDENCE_THRESHOLD, CLOSE_SHARE = 0.3, 0.8
DEFAULT_INTENT = "retrieve_docs"


def _hits(text: Column, words) -> Column:
    return reduce(lambda a, b: a + b, [text.contains(w).cast("int") for w in words])


def rule_score(text: Column, intent: str) -> Column:
    """``text`` is lower case. One point per keyword, two per pattern, as a share of all points;
    plus each boost any of whose words occurs."""
    spec = INTENTS[intent]
    points = _hits(text, spec["keywords"]) + 2 * _hits(text, spec["patterns"])
    score = points / float(len(spec["keywords"]) + 2 * len(spec["patterns"]))
    for amount, words in spec["boosts"]:
        score = score + F.when(_hits(text, words) > 0, amount).otherwise(0.0)
    return score


def intent_scores(df: DataFrame, text_col="text") -> DataFrame:
    lowered = df.withColumn("__text", F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    return lowered.withColumns({f"{i}_score": rule_score(F.col("__text"), i) for i in INTENTS}).drop("__text")


def recommend(scored: DataFrame, model_scores: dict = None) -> DataFrame:
    """Combine rule and model scores; ``model_scores`` maps an intent to an optional score column.

    Adds max_confidence and recommended: the best intent and any other within reach of it, or the
    default when none is confident. Ties go to the intent listed first.
    """
    model_scores = model_scores or {}
    combined = {}
    for intent in INTENTS:
        model = F.coalesce(F.col(model_scores[intent]), F.lit(0.0)) if intent in model_scores else F.lit(0.0)
        combined[f"{intent}_confidence"] = RULE_WEIGHT * F.col(f"{intent}_score") + MODEL_WEIGHT * model
    df = scored.withColumns(combined)
    df = df.withColumn("max_confidence", F.greatest(*combined))
    primary = F.coalesce(*[F.when(F.col(f"{i}_confidence") == F.col("max_confidence"), i) for i in INTENTS])
    df = df.withColumn("primary", primary)
    others = [F.when((F.col("primary") != i)
                     & (F.col(f"{i}_confidence") > F.col("max_confidence") * CLOSE_SHARE), i) for i in INTENTS]
    chosen = F.array_compact(F.array("primary", *others))
    return df.withColumn("recommended", F.when(
        F.col("max_confidence") > CONFIDENCE_THRESHOLD, chosen).otherwise(F.array(F.lit(DEFAULT_INTENT)))).drop("primary")
