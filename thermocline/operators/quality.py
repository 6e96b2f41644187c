"""Cleaning and validation of raw measurement rows."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from thermocline.schema import CRITICAL_COLUMNS, PROFILE_COLUMNS, PROFILE_SCHEMA
from thermocline.session import durable

# Texts read as missing.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Patterns tried after ISO 8601, each only on texts of its shape: a failed parse is expensive. A time of day may have
# seconds and a fraction of them; a zone may follow it.
_CLOCK = "[ ]['T'][ ]H:mm[:ss][.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S][ ][XXX][X]"
_CLOCK_SHAPE = r"([T ]\d{1,2}:\d{2}(:\d{2}(\.\d{1,6})?)? ?(Z|[+-]\d{2}:?\d{2})?)?$"
_HALF_DAY = "[ ]['T']h:mm[:ss][ ]a"
_HALF_DAY_SHAPE = r"[T ]\d{1,2}:\d{2}(:\d{2})? ?[AaPp][Mm]$"
_DATES = {
    "y/M/d": r"^\d{4}/\d{1,2}/\d{1,2}",
    "d.M.y": r"^\d{1,2}\.\d{1,2}\.\d{4}",
    "d-MMM-y": r"^\d{1,2}-[A-Za-z]{3}-\d{4}",
    "d MMM y": r"^\d{1,2} [A-Za-z]{3} \d{4}",
    "MMM d, y": r"^[A-Za-z]{3} \d{1,2}, \d{4}",
    "MMM d y": r"^[A-Za-z]{3} \d{1,2} \d{4}",
    "MMMM d, y": r"^[A-Za-z]{4,9} \d{1,2}, \d{4}",
    "MMMM d y": r"^[A-Za-z]{4,9} \d{1,2} \d{4}",
}
_SLASHED = r"^(\d{1,2})/(\d{1,2})/\d{4}"
TIMESTAMP_PATTERNS = {
    **{f"{date}[{_CLOCK}]": shape + _CLOCK_SHAPE for date, shape in _DATES.items()},
    **{f"{date}{_HALF_DAY}": shape + _HALF_DAY_SHAPE for date, shape in _DATES.items()},
    "yyyyMMdd": r"^\d{8}$",
    "yyyyMMdd'T'HHmmss": r"^\d{8}T\d{6}$",
    "yyyyMMdd'T'HHmmssX": r"^\d{8}T\d{6}Z$",
}

# Plausible ranges of the measured quantities.
QC_THRESHOLDS = {
    "temperature_degc": (-5.0, 40.0),
    "salinity_psu": (25.0, 45.0),
    "pressure_decibar": (0.0, 3000.0),
}


#: Files whose date orders are broadcast.
BROADCAST_FILES = 100_000


def rename_temperature(df: DataFrame) -> DataFrame:
    """Normalise the one column the raw files spell with a capital letter."""
    if "temperature_degC" in df.columns:
        return df.withColumnRenamed("temperature_degC", "temperature_degc")
    return df


def _without_token(text: Column) -> Column:
    return F.when(~F.trim(text).isin(NULL_TOKENS), text)


def null_tokens(df: DataFrame) -> DataFrame:
    """Missing-value texts and float NaN become null."""
    def cleaned(field):
        col = F.col(field.name)
        if isinstance(field.dataType, T.StringType):
            return _without_token(col).alias(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(col), col).alias(field.name)
        return col

    return df.select([cleaned(f) for f in df.schema])


def parse_timestamp(text: Column, day_first: Column = None) -> Column:
    """ISO 8601 first, then the other patterns; null when none fits.

    Of two numbers between slashes the one above twelve is the day. If both could be, `day_first` decides (`day_order`
    finds it by file), and without it the month stands first.
    """
    text = F.trim(text)
    parsed = F.when(text.rlike(r"^\d{4}-"), F.try_to_timestamp(text))
    for pattern, shape in TIMESTAMP_PATTERNS.items():
        parsed = parsed.when(text.rlike(shape), F.try_to_timestamp(_half_day(text, pattern), F.lit(pattern)))
    first, second = _slashed(text)
    days = F.when(first > 12, True).when(second > 12, False).otherwise(F.coalesce(day_first if day_first is not None else F.lit(False), F.lit(False)))
    for day, date in ((True, "d/M/y"), (False, "M/d/y")):
        for clock, shape in ((f"[{_CLOCK}]", _CLOCK_SHAPE), (_HALF_DAY, _HALF_DAY_SHAPE)):
            fits = text.rlike(_SLASHED + shape) & (days == F.lit(day))
            parsed = parsed.when(fits, F.try_to_timestamp(_half_day(text, clock), F.lit(date + clock)))
    return parsed


def _half_day(text: Column, pattern: str) -> Column:
    """AM and PM as the parser wants them; names of months have no such ending."""
    return F.concat(F.substring(text, F.lit(1), F.length(text) - 2), F.upper(F.right(text, F.lit(2)))) if pattern.endswith("a") else text


def _slashed(text: Column) -> tuple:
    return tuple(F.regexp_extract(text, _SLASHED, i).try_cast("int") for i in (1, 2))


def day_order(raw: DataFrame, by: str = "source_name") -> DataFrame:
    """For each file whether days stand before months between slashes, by the dates that can only be read one way.

    `day_first` is null where nothing tells or both kinds are as frequent; `ambiguous` counts the dates that follow it.
    """
    # Most texts have no slash, and those that have are matched once.
    text = F.trim("timestamp")
    numbers = [F.when(F.contains(text, F.lit("/")), n).alias(name) for n, name in zip(_slashed(text), ("_first", "_second"))]
    first, second = F.col("_first"), F.col("_second")
    both = first.between(1, 12) & second.between(1, 12)
    votes = raw.select(by, *numbers).groupBy(by).agg(F.count_if((first > 12) & (second <= 12)).alias("days"), F.count_if((first <= 12) & (second > 12)).alias("months"),
                                F.count_if(both & (first != second)).alias("ambiguous"))
    return votes.select(by, F.when(F.col("days") > F.col("months"), True).when(F.col("days") < F.col("months"), False).alias("day_first"), "ambiguous")


def with_day_order(raw: DataFrame, by: str = "source_name") -> DataFrame:
    """`raw` with day_first of its file, which `typed` follows.

    The files' orders are found once, however often the rows are read, and broadcast unless there are very many files, so
    that no task takes all rows of a large file.
    """
    order = durable(day_order(raw, by).select(by, "day_first"))
    return raw.join(F.broadcast(order) if order.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES else order, by, "left")


def typed(df: DataFrame) -> DataFrame:
    """All-text profile columns to their types; a value that does not parse becomes null, which
    covers the missing-value texts of every column but the scheme.

    Columns beyond the nine are kept as they are; `day_first` settles times whose day and month could change places.
    """
    def cast(field):
        col = F.col(field.name)
        if isinstance(field.dataType, T.TimestampType):
            return parse_timestamp(col, F.col("day_first") if "day_first" in df.columns else None).alias(field.name)
        if isinstance(field.dataType, T.StringType):
            return _without_token(col).alias(field.name)
        if isinstance(field.dataType, T.IntegerType):
            # "3.0" is a whole number too; through double, as a failed cast costs an exception.
            number = col.try_cast("double")
            return F.when(number == F.floor(number), number.try_cast("int")).alias(field.name)
        return F.nanvl(col.try_cast(field.dataType), F.lit(None).cast("double")).alias(field.name)

    extra = [c for c in df.columns if c not in PROFILE_COLUMNS]
    return df.select([cast(f) for f in PROFILE_SCHEMA] + extra)


def select_profile_columns(df: DataFrame) -> DataFrame:
    return df.select(PROFILE_COLUMNS)


def missing_profile(df: DataFrame, columns=None) -> DataFrame:
    """Nulls per column: one aggregate, then one row per column."""
    columns = columns or df.columns
    counts = df.agg(F.count(F.lit(1)).alias("total"),
                    *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return (counts.unpivot(["total"], columns, "column_name", "missing")
            .select("column_name", "missing",
                    F.when(F.col("total") > 0, F.round(F.col("missing") * 100 / F.col("total"), 2))
                    .otherwise(0.0).alias("missing_percent")))


def drop_critical(df: DataFrame) -> DataFrame:
    return df.dropna(subset=CRITICAL_COLUMNS)


def fill_defaults(df: DataFrame, null_policy: str = "zero") -> DataFrame:
    """Missing measurements become 0.0 and a missing scheme an empty text, or stay ("keep")."""
    if null_policy == "keep":
        return df
    if null_policy != "zero":
        raise ValueError("null_policy must be 'zero' or 'keep'")
    return df.fillna({"salinity_psu": 0.0, "temperature_degc": 0.0, "vertical_sampling_scheme": ""})


def failed_rule() -> Column:
    """Name of the first validation rule a row breaks, null for a valid row. Bounds are inclusive."""
    def outside(name, low, high):
        return ~F.coalesce(F.col(name).between(low, high), F.lit(False))

    return (F.when(F.col("timestamp").isNull() | F.col("cycle_number").isNull() | F.col("basin").isNull(),
                   "required")
            .when(outside("longitude", -180, 180), "longitude")
            .when(outside("latitude", -90, 90), "latitude")
            .when(~F.coalesce(F.col("pressure_decibar") >= 0, F.lit(False)), "pressure"))


def range_validate(df: DataFrame) -> DataFrame:
    """Rows that pass every rule, as plain conjuncts so that they reach the file scan."""
    return df.filter(
        F.col("timestamp").isNotNull() & F.col("cycle_number").isNotNull() & F.col("basin").isNotNull()
        & F.col("longitude").between(-180, 180) & F.col("latitude").between(-90, 90)
        & (F.col("pressure_decibar") >= 0))


def reject_summary(df: DataFrame) -> DataFrame:
    """Valid and invalid row counts, the invalid ones by first failed rule."""
    return (df.select(F.coalesce(failed_rule(), F.lit("valid")).alias("outcome"))
            .groupBy("outcome").agg(F.count(F.lit(1)).alias("n")))


def qc_flags(df: DataFrame, thresholds=None) -> DataFrame:
    """One 0/1 column per threshold: is a present value outside its plausible range?"""
    flags = {f"{name}_flag": F.coalesce(~F.col(name).between(low, high), F.lit(False)).cast("int")
             for name, (low, high) in (thresholds or QC_THRESHOLDS).items()}
    flagged = df.withColumns(flags)
    return flagged.withColumn("flags", reduce(lambda a, b: a + b, map(F.col, flags)))


def qc_summary(df: DataFrame, thresholds=None) -> DataFrame:
    """Counts of flagged and missing values per threshold column."""
    thresholds = thresholds or QC_THRESHOLDS
    flagged = qc_flags(df, thresholds)
    counts = flagged.agg(*[F.struct(
        F.coalesce(F.sum(f"{name}_flag"), F.lit(0)).alias("flagged"),
        F.count_if(F.col(name).isNull()).alias("missing")).alias(name) for name in thresholds])
    return (counts.unpivot([], list(thresholds), "column_name", "v")
            .select("column_name", "v.flagged", "v.missing"))


def clean(raw: DataFrame, null_policy: str = "zero") -> DataFrame:
    """Raw text rows to valid profile rows: the one path that batch and stream share. Rows marked malformed go."""
    rows = typed(rename_temperature(raw))
    if "malformed" in rows.columns:
        rows = rows.filter(~F.col("malformed"))
    # The same rows as drop_critical and range_validate. A filter on parsed columns alone would be moved below their parsing
    # and parse all of them a second time; beside a task's number, which cannot be moved, they are parsed once.
    kept = rows.drop("malformed", "day_first").withColumn("_task", F.spark_partition_id()).filter(
        (F.col("_task") >= 0) & F.col("timestamp").isNotNull() & F.col("cycle_number").isNotNull() & F.col("basin").isNotNull()
        & (F.abs("longitude") <= 180) & (F.abs("latitude") <= 90) & (F.col("pressure_decibar") >= 0)).drop("_task")
    return fill_defaults(kept, null_policy)


def file_outcomes(raw: DataFrame, by: str = "source_name") -> DataFrame:
    """Per file: rows read, malformed, with a time that could not be read, dropped for a missing critical field (such a
    time is one), rejected, kept. One pass; a malformed row counts as nothing else."""
    rows = typed(raw.withColumn("_time", _without_token(F.col("timestamp"))))
    good = ~F.col("malformed")
    complete = good & reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in CRITICAL_COLUMNS])
    marked = rows.select(by, (~good).alias("malformed"), (good & F.col("_time").isNotNull() & F.col("timestamp").isNull()).alias("unparsed"),
                         good.alias("good"), complete.alias("complete"), (complete & failed_rule().isNull()).alias("valid"))
    return marked.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows_read"), F.count_if("malformed").alias("rows_malformed"), F.count_if("unparsed").alias("rows_unparsed"),
        F.count_if(F.col("good") & ~F.col("complete")).alias("rows_dropped"),
        F.count_if(F.col("complete") & ~F.col("valid")).alias("rows_rejected"), F.count_if("valid").alias("rows_kept"))


def ingest_summary(raw: DataFrame, by="source_name") -> DataFrame:
    """Per source: rows read, dropped for a missing critical field, rejected, kept. One pass."""
    rows = typed(rename_temperature(raw))
    critical = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in CRITICAL_COLUMNS])
    marked = rows.select(by, critical.alias("complete"), (critical & failed_rule().isNull()).alias("valid"))
    return marked.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(~F.col("complete")).alias("rows_dropped"),
        F.count_if(F.col("complete") & ~F.col("valid")).alias("rows_rejected"),
        F.count_if(F.col("valid")).alias("rows_kept"))


def reconcile(processed: DataFrame, stored: DataFrame, exported: DataFrame) -> DataFrame:
    """Row counts of the three copies, the shortfalls and whether all agree."""
    tagged = [df.select(F.lit(name).alias("copy"))
              for name, df in (("processed", processed), ("stored", stored), ("exported", exported))]
    counts = reduce(DataFrame.unionAll, tagged).agg(
        *[F.count_if(F.col("copy") == name).alias(f"{name}_rows")
          for name in ("processed", "stored", "exported")])
    return counts.withColumns({
        "stored_shortfall": F.col("processed_rows") - F.col("stored_rows"),
        "exported_shortfall": F.col("processed_rows") - F.col("exported_rows"),
        "passed": ((F.col("stored_rows") == F.col("processed_rows"))
                   & (F.col("exported_rows") == F.col("processed_rows"))).cast("int"),
    })
