"""Relational source and sink. The caller supplies the URL and credentials as options."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from thermocline.operators.quality import fill_defaults
from thermocline.schema import JDBC_DECIMALS, PROFILE_COLUMNS
from thermocline.sources.files import write_profiles

BATCH_ROWS = 1000


def read_jdbc(spark: SparkSession, options: dict, lower: str, upper: str, partitions: int = 64,
              table: str = "profiles") -> DataFrame:
    """Profiles read in parallel by time slices; order is left to whoever needs it."""
    reader = (spark.read.format("jdbc").options(**options).option("dbtable", table)
              .option("partitionColumn", "timestamp").option("lowerBound", lower)
              .option("upperBound", upper).option("numPartitions", partitions)
              .option("fetchsize", 10_000))
    doubles = {c: F.col(c).cast("double") for c in JDBC_DECIMALS}
    return reader.load().select(PROFILE_COLUMNS).withColumns(doubles)


def for_jdbc(df: DataFrame) -> DataFrame:
    """The nine columns with the store's decimal precision."""
    return df.select(PROFILE_COLUMNS).withColumns(
        {c: F.col(c).cast(t) for c, t in JDBC_DECIMALS.items()})


def write_jdbc(df: DataFrame, options: dict, table: str = "profiles") -> None:
    (for_jdbc(df).write.format("jdbc").options(**options).option("dbtable", table)
     .option("batchsize", BATCH_ROWS).mode("append").save())


def export_to_parquet(spark: SparkSession, options: dict, path: str, lower: str, upper: str,
                      partitions: int = 64) -> None:
    """The whole stored table to Parquet with the usual defaults for missing values."""
    rows = fill_defaults(read_jdbc(spark, options, lower, upper, partitions))
    write_profiles(rows.withColumn("source_name", F.lit("converted_processed")), path)
