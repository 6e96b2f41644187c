"""Tables behind the plots; drawing is left to the caller."""

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from thermocline.operators.stats import numeric_columns

HISTOGRAM_BINS = 30
SERIES_BUCKETS = 500
DEPTH_STEP = 10.0
PREFERRED = ["temperature_degc", "salinity_psu", "pressure_decibar", "latitude", "longitude"]
# Axis labels.
AXIS_LABELS = {
    "temperature_degc": "Temperature (°C)",
    "salinity_psu": "Salinity (PSU)",
    "pressure_decibar": "Pressure (dbar)",
    "latitude": "Latitude (°N)",
    "longitude": "Longitude (°E)",
    "cycle_number": "Cycle Number",
    "basin": "Basin",
    "timestamp": "Time",
}


def axis_label(name: str) -> str:
    return AXIS_LABELS.get(name) or name.replace("_", " ").title()


def with_axis_label(df: DataFrame, column="column_name", out="label") -> DataFrame:
    """Add the axis label for a column of column names."""
    named = F.create_map(*[F.lit(x) for pair in AXIS_LABELS.items() for x in pair])[F.col(column)]
    return df.withColumn(out, F.coalesce(named, F.initcap(F.regexp_replace(column, "_", " "))))


def pick_columns(df: DataFrame, plot_type: str, x: str = None, y: str = None):
    """Axes from the schema alone: depth first for a depth profile, else time against a measured
    quantity, else the first two numeric columns."""
    names = df.columns
    if x in names and y in names:
        return x, y

    def first(*wanted):
        return next((w for w in wanted if w in names), None)

    measured = first("temperature_degc", "salinity_psu")
    time = first("timestamp", "date", "time")
    second = names[min(1, len(names) - 1)]
    if plot_type == "depth_profile":
        return first("pressure_decibar", "depth", "pressure") or names[0], measured or second
    if time and measured:
        return time, measured
    numbers = numeric_columns(df)
    return tuple(numbers[:2]) if len(numbers) >= 2 else (names[0], second)


def _require(df, *columns):
    for c in columns:
        if c not in df.columns:
            raise ValueError(f"column '{c}' not found")


def series(df: DataFrame, x: str, y: str) -> DataFrame:
    """Line or scatter points, complete pairs in x order."""
    _require(df, x, y)
    return df.select(F.col(x).alias("x"), F.col(y).alias("y")).dropna().orderBy("x", "y")


def series_bucketed(df: DataFrame, x: str, y: str, buckets: int = SERIES_BUCKETS) -> DataFrame:
    """A line of at most ``buckets`` points, whatever the number of rows: equal widths of x (a time or a number) from
    its minimum to its maximum, each with its first and last x and the count, mean and range of y. Empty buckets are
    left out; incomplete pairs count nowhere."""
    _require(df, x, y)
    timed = isinstance(df.schema[x].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
    place = F.unix_micros(F.col("x").cast("timestamp")).cast("double") if timed else F.col("x").cast("double")
    points = (df.select(F.col(x).alias("x"), F.col(y).cast("double").alias("y")).dropna()
              .withColumn("at", place))
    span = points.agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    bucket = F.when(hi > lo, F.least(F.floor((F.col("at") - lo) / ((hi - lo) / buckets)), F.lit(buckets - 1))).otherwise(0)
    return points.groupBy(bucket.cast("int").alias("bucket")).agg(
        F.min("x").alias("x_first"), F.max("x").alias("x_last"), F.count(F.lit(1)).alias("n"),
        F.avg("y").alias("mean"), F.min("y").alias("min"), F.max("y").alias("max"))


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins from minimum to maximum, the last one closed; empty bins are kept.

    NaN and infinite values have no place between edges and count nowhere.
    """
    _require(df, column)
    values = df.select(F.col(column).cast("double").alias("v")).filter(_finite("v"))
    # One value only: a unit interval around it.
    span = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).select(
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.lit(1.0)).otherwise(F.col("hi") - F.col("lo")).alias("width"))
    lo, width = span.select("lo").scalar(), span.select("width").scalar()
    at = F.least(F.floor((F.col("v") - lo) / (width / bins)), F.lit(bins - 1)).cast("int")
    counts = values.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = df.sparkSession.range(bins).select(
        F.col("id").cast("int").alias("bin"),
        (lo + F.col("id") * (width / bins)).alias("low"),
        (lo + (F.col("id") + 1) * (width / bins)).alias("high"))
    return edges.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _finite(name: str) -> Column:
    """False for null, NaN and infinite values."""
    return F.coalesce(~F.isnan(name) & (F.abs(name) < float("inf")), F.lit(False))


def depth_profile(df: DataFrame, depth="pressure_decibar", values=None) -> DataFrame:
    """(depth, variable, value) points, nulls dropped per pair."""
    values = values or [c for c in ("temperature_degc", "salinity_psu") if c in df.columns]
    if not values:
        raise ValueError("no value columns for a depth profile")
    _require(df, depth, *values)
    columns = [F.col(c).cast("double").alias(c) for c in values]
    return (df.select(F.col(depth).alias("depth"), *columns)
            .unpivot(["depth"], values, "variable", "value").dropna())


def depth_profile_binned(df: DataFrame, depth="pressure_decibar", values=None, step: float = DEPTH_STEP) -> DataFrame:
    """Count, mean and range of each variable per depth bin of ``step``; ``depth`` is the bin's upper edge in the water."""
    if not step > 0:
        raise ValueError("step must be positive")
    points = depth_profile(df, depth, values)
    edge = F.floor(F.col("depth").cast("double") / step) * F.lit(float(step))
    return points.groupBy(edge.alias("depth"), "variable").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))


def matrix_columns(df: DataFrame, columns=None):
    numbers = numeric_columns(df)
    columns = columns or [c for c in PREFERRED if c in numbers] or numbers[:4]
    if len(columns) < 2:
        raise ValueError("need at least two numeric columns")
    return list(columns)


def scatter_points(df: DataFrame, columns=None) -> DataFrame:
    """Complete cases of the matrix columns."""
    return df.select(matrix_columns(df, columns)).dropna()


def scatter_matrix(df: DataFrame, columns=None) -> DataFrame:
    """One row per pair of columns with the number of complete cases and the correlation."""
    columns = matrix_columns(df, columns)
    pairs = list(combinations(columns, 2))
    stats = scatter_points(df, columns).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}")
          for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"r{i}").alias("correlation"))
                     for i, (a, b) in enumerate(pairs)])
    return stats.select("n", F.explode(rows).alias("p")).select("p.x", "p.y", "n", "p.correlation")


def scatter_matrix_diagonal(df: DataFrame, columns=None, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """The histograms of the matrix diagonal: bins of each column over the complete cases, empty ones included.

    NaN and infinite values of a column count nowhere in its histogram.
    """
    columns = matrix_columns(df, columns)
    values = (scatter_points(df, columns).select([F.col(c).cast("double").alias(c) for c in columns])
              .unpivot([], columns, "column_name", "v").filter(_finite("v")))
    span = values.groupBy("column_name").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).select(
        "column_name", F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.lit(1.0)).otherwise(F.col("hi") - F.col("lo")).alias("width"))
    width = F.col("width") / bins
    at = F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    # One row for each column of the matrix, so the spans can be broadcast.
    counts = (values.join(F.broadcast(span), "column_name").groupBy("column_name", at.alias("bin"))
              .agg(F.count(F.lit(1)).alias("n")))
    edges = (span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
             .select("column_name", "bin", (F.col("lo") + F.col("bin") * width).alias("low"),
                     (F.col("lo") + (F.col("bin") + 1) * width).alias("high")))
    return edges.join(counts, ["column_name", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def axis_statistics(df: DataFrame, x: str, y: str) -> DataFrame:
    """Min, max, mean and count of the numeric axes."""
    axes = {axis: name for axis, name in (("x_axis", x), ("y_axis", y))
            if name in df.columns and isinstance(df.schema[name].dataType, T.NumericType)}

    def stat(axis, name) -> Column:
        c = F.col(name).cast("double")
        return F.struct(F.lit(name).alias("column_name"), F.min(c).alias("min"), F.max(c).alias("max"),
                        F.avg(c).alias("mean"), F.count(c).alias("count")).alias(axis)

    return (df.agg(*[stat(a, n) for a, n in axes.items()])
            .unpivot([], list(axes), "axis", "s").filter("s.count > 0").select("axis", "s.*"))
