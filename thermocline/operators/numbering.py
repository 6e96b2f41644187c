"""Exact order-based numbering without a window over the whole table."""

from pyspark.sql import DataFrame, Window, functions as F

from thermocline.session import durable


def _before(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def add_running_sum(df: DataFrame, keys, value: str, out: str) -> DataFrame:
    """As ``add_preceding_sum`` for a table that is known to be small: one window in one task."""
    return df.withColumn(out, F.coalesce(F.sum(value).over(_before(Window.orderBy(*keys))), F.lit(0)))


def add_preceding_sum(df: DataFrame, keys, value: str, out: str) -> DataFrame:
    """Add the sum of ``value`` over all rows that sort before each row by ``keys``, which are unique.

    Rows are range partitioned by ``keys`` whatever their dates, and the totals of earlier partitions are added; the
    widest window is over one row for each partition.
    """
    return add_group_offset(df, [], keys, value, out)


def add_group_offset(df: DataFrame, group, order, weight: str, out: str) -> DataFrame:
    """Add, per row, the total ``weight`` of the rows before it inside its group.

    For groups too large for one task: rows are range partitioned on group and order together, so
    one group spreads over many partitions, and the totals of the earlier partitions are added.
    (group, order) must be unique.
    """
    ranged = (df.repartitionByRange(*group, *order)
              .withColumn("__slice", F.spark_partition_id()))
    # Range boundaries are sampled; both passes below must see the same slices.
    ranged = durable(ranged)
    slices = ranged.groupBy(*group, "__slice").agg(F.sum(weight).alias("__sum"))
    slices = slices.select(*group, "__slice", F.coalesce(F.sum("__sum").over(
        _before(Window.partitionBy(*group).orderBy("__slice"))), F.lit(0)).alias("__earlier"))
    local = F.coalesce(F.sum(weight).over(
        _before(Window.partitionBy(*group, "__slice").orderBy(*order))), F.lit(0))
    return (ranged.withColumn("__local", local).join(slices, [*group, "__slice"])
            .withColumn(out, F.col("__earlier") + F.col("__local"))
            .drop("__slice", "__local", "__earlier"))
