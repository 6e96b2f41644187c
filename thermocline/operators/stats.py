"""Statistics of query results and of retrieved chunks."""

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from thermocline.session import durable

# Labels of score bins and latitude bands.
SCORE_BINS = ["0.0-0.2", "0.2-0.4", "0.4-0.6", "0.6-0.8", "0.8-1.0"]
LATITUDE_BANDS = ["North (>30°)", "Tropical (30°S-30°N)", "South (<-30°)"]
KEY_COLUMNS = ["basin", "cycle_number", "timestamp"]


#: Parts that one pass of a selection cuts the remaining range into.
SELECTION_PARTS = 256


def upper_median(df: DataFrame, value: str, by=(), weight: str = None) -> DataFrame:
    """Element at sorted position n // 2, per group; of a table without groups by `select_rank`.

    Equal values are counted before the running sum of a group, so its window sees distinct values only.
    """
    by = list(by)
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(n.alias("__n"))
    if not by:
        found = select_rank(durable(counts), value, "__n")
        kind = df.schema[value].dataType
        return df.sparkSession.createDataFrame([(found,)], T.StructType([T.StructField("median_upper", kind)]))
    group = Window.partitionBy(*by)
    running = F.sum("__n").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("__n").over(group)
    return (counts.withColumns({"__upto": running, "__all": total})
            .filter(F.col("__upto") > F.floor(F.col("__all") / 2))
            .groupBy(*by).agg(F.min(value).alias("median_upper")))


def select_rank(counts: DataFrame, value: str, weight: str, rank: int = None):
    """The value at a position (by default half of all, rounded down) of sorted values that stand `weight` times each.

    Distributed selection: every pass counts the remaining range in equal parts by one aggregate and goes on in the part
    that holds the position, between the least and the greatest value there. Neither a sort nor a window is needed, and
    the driver sees SELECTION_PARTS rows a pass. NaN counts as the greatest. None without values.
    """
    most = float(np.finfo(float).max)
    x = F.col(value).cast("double")
    x = F.when(F.isnan(x), most).otherwise(F.greatest(F.least(x, F.lit(most)), F.lit(-most)))
    at = counts.select(x.alias("x"), F.col(value).alias("value"), F.col(weight).alias("n"))
    total, low, high = at.agg(F.sum("n"), F.min("x"), F.max("x")).first()
    if not total:
        return None
    rank = total // 2 if rank is None else rank
    while low < high:
        # Halves of the bounds are taken first, since their difference may not be a double.
        place = F.floor(F.try_divide(F.col("x") / 2 - low / 2, F.lit(high / 2 - low / 2)) * SELECTION_PARTS)
        parts = (at.where(F.col("x").between(low, high)).groupBy(F.least(place, F.lit(SELECTION_PARTS - 1)).alias("part"))
                 .agg(F.sum("n").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("part").collect())
        for part in parts:
            if rank < part.n:
                break
            rank -= part.n
        if (part.low, part.high) == (low, high):
            break
        low, high = part.low, part.high
    # Whole numbers beyond 2^53 may share a double; the few that do are told apart here.
    for row in at.where(F.col("x").between(low, high)).orderBy("value").toLocalIterator():
        if rank < row.n:
            return row.value
        rank -= row.n


def numeric_columns(df: DataFrame):
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def numeric_summary(df: DataFrame, columns=None) -> DataFrame:
    """Per numeric column: count, min, max, mean and share of non-null values. One aggregate."""
    columns = columns or numeric_columns(df)
    total = F.count(F.lit(1))

    def summary(name):
        c = F.col(name).cast("double")
        return F.struct(
            F.count(c).alias("count"), F.round(F.min(c), 3).alias("min"),
            F.round(F.max(c), 3).alias("max"), F.round(F.avg(c), 3).alias("mean"),
            F.round(F.count(c) * 100 / total, 1).alias("non_null_percent")).alias(name)

    return (df.agg(*map(summary, columns)).unpivot([], columns, "column_name", "s")
            .filter("s.count > 0").select("column_name", "s.*"))


def unique_counts(df: DataFrame, columns=KEY_COLUMNS, approximate=False) -> DataFrame:
    """Distinct non-null values of the key columns that are present.

    Exact counting goes through one deduplication of (column, value) pairs, so no distinct set is
    gathered anywhere; the approximate form is a fixed-size sketch per column.
    """
    present = [c for c in columns if c in df.columns]
    if approximate:
        counts = df.agg(*[F.approx_count_distinct(c).alias(c) for c in present])
        return counts.unpivot([], present, "column_name", "distinct_values")
    pairs = df.select([F.col(c).cast("string").alias(c) for c in present])
    values = pairs.unpivot([], present, "column_name", "value").filter("value is not null")
    found = values.distinct().groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_values"))
    labels = df.sparkSession.createDataFrame([(c,) for c in present], "column_name string")
    return (labels.join(found, "column_name", "left")
            .withColumn("distinct_values", F.coalesce("distinct_values", F.lit(0))))


def measurement_summary(measurements: Column) -> Column:
    """Count and min / max / mean of the three quantities of a nested list; zeros when empty."""
    n = F.size(measurements)

    def span(field, digits):
        values = F.transform(measurements, lambda m: F.coalesce(m[field], F.lit(0.0)))
        mean = F.aggregate(values, F.lit(0.0), lambda a, b: a + b) / F.nullif(n, F.lit(0))
        return F.struct(*[F.coalesce(F.round(v, digits), F.lit(0.0)).alias(name) for name, v in (
            ("min", F.array_min(values)), ("max", F.array_max(values)), ("mean", mean))])

    return F.struct(F.greatest(n, F.lit(0)).alias("count"),
                    span("pressure_decibar", 1).alias("depth_range"),
                    span("temperature_degc", 3).alias("temperature_range"),
                    span("salinity_psu", 3).alias("salinity_range"))


def score_summary(results: DataFrame, by=("query_id",)) -> DataFrame:
    """Number, mean, min, max and upper median of the scores per query."""
    by = list(by)
    basic = results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.round(F.avg("score"), 4).alias("average_score"),
        F.round(F.min("score"), 4).alias("min_score"),
        F.round(F.max("score"), 4).alias("max_score"))
    median = upper_median(results, "score", by)
    return (basic.join(median, by, "left")
            .withColumn("median_score", F.round("median_upper", 4)).drop("median_upper"))


def score_bin(score: Column) -> Column:
    b = SCORE_BINS
    return (F.when(score < 0.2, b[0]).when(score < 0.4, b[1]).when(score < 0.6, b[2])
            .when(score < 0.8, b[3]).otherwise(b[4]))


def latitude_band(latitude: Column) -> Column:
    return (F.when(latitude > 30, LATITUDE_BANDS[0]).when(latitude < -30, LATITUDE_BANDS[2])
            .otherwise(LATITUDE_BANDS[1]))


def _labelled_counts(df: DataFrame, label: Column, labels) -> DataFrame:
    """Counts per label, zero rows for labels that do not occur."""
    counts = df.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    full = df.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    return full.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def score_distribution(results: DataFrame) -> DataFrame:
    return _labelled_counts(results, score_bin(F.col("score")), SCORE_BINS)


def latitude_distribution(df: DataFrame, latitude="latitude") -> DataFrame:
    return _labelled_counts(df, latitude_band(F.col(latitude)), LATITUDE_BANDS)


def basin_distribution(df: DataFrame, basin="basin") -> DataFrame:
    label = F.concat(F.lit("Basin "), F.coalesce(F.col(basin).cast("string"), F.lit("Unknown")))
    return df.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def year_distribution(df: DataFrame, ts="observed_at") -> DataFrame:
    return (df.filter(F.col(ts).isNotNull())
            .groupBy(F.year(ts).alias("year")).agg(F.count(F.lit(1)).alias("n")))


def format_results(results: DataFrame, *keep) -> DataFrame:
    """Response rows: rounded score, nested metadata with location, measurement summary.

    Expects retrieved chunks: the chunk columns plus text, score, query, rank and strategy.
    Columns named in ``keep`` are passed through.
    """
    meta = F.struct(
        F.col("timestamp"),
        F.struct("metadata.latitude", "metadata.longitude").alias("location"),
        "metadata.basin", "metadata.cycle_number", "metadata.vertical_sampling_scheme",
        F.size("measurements").alias("measurement_count"))
    return results.select(
        *keep, "chunk_id", "text", F.round("score", 4).alias("score"), meta.alias("metadata"),
        measurement_summary(F.col("measurements")).alias("measurements_summary"),
        "source", "chunk_type",
        F.struct("query", "rank", "strategy").alias("retrieval_context"))


def index_statistics(index: DataFrame) -> DataFrame:
    """Long-form facts about an index: totals, counts by source / type / basin, time range.

    One aggregate over (source, type, basin, dimension) groups, then small roll-ups of it;
    distinct timestamps are counted through their own deduplication.
    """
    groups = index.groupBy(
        F.coalesce("source", F.lit("unknown")).alias("source"),
        F.coalesce("chunk_type", F.lit("unknown")).alias("chunk_type"),
        F.coalesce(F.col("metadata.basin").cast("string"), F.lit("unknown")).alias("basin"),
        F.size("embedding").alias("dimension"),
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("measurements")).alias("m"),
          F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    totals = groups.agg(
        F.sum("n").cast("string").alias("total_vectors"),
        F.max("dimension").cast("string").alias("vector_dimension"),
        F.sum("m").cast("string").alias("total_measurements"),
        F.min("first").alias("earliest"), F.max("last").alias("latest"))
    names = totals.columns
    rows = totals.unpivot([], names, "key", "value").select(
        F.lit("total").alias("kind"), "key", "value")
    counts = groups.select(F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("key"), "n")
        for kind in ("source", "chunk_type", "basin")])).alias("c")).groupBy("c.kind", "c.key").agg(
        F.sum("c.n").cast("string").alias("value"))
    distinct = (index.filter(F.col("timestamp").isNotNull()).select("timestamp").distinct()
                .agg(F.count(F.lit(1)).cast("string").alias("value"))
                .select(F.lit("total").alias("kind"), F.lit("distinct_timestamps").alias("key"), "value"))
    return rows.unionByName(counts).unionByName(distinct)
