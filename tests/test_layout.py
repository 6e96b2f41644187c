"""Layout of stored profiles: which row groups a filter has to read."""

import glob
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from thermocline.functions.curve import BITS, cell, spread, z_order
from thermocline.sources.files import write_clustered

CURVE = ("latitude", "longitude", "timestamp")


def interleaved(*numbers, bits):
    return sum((n >> b & 1) << (b * len(numbers) + i) for i, n in enumerate(numbers) for b in range(bits))


@pytest.mark.parametrize("dimensions", [2, 3])
def test_z_order_interleaves_bits(spark, dimensions):
    rng = random.Random(1)
    rows = [tuple(rng.choice((0, 1, (1 << BITS) - 1, rng.randrange(1 << BITS))) for _ in range(dimensions)) for _ in range(300)]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} long" for i in range(dimensions)))
    got = df.select(*df.columns, z_order(*[F.col(c) for c in df.columns]).alias("z")).collect()
    assert all(r.z == interleaved(*r[:dimensions], bits=BITS) for r in got)
    assert spark.range(1).select(spread(F.lit(7).cast("long"), 3, 5)).first()[0] == 0b1001001
    with pytest.raises(ValueError):
        z_order(*[F.lit(1)] * 4)


def test_cells_of_ends_and_missing_values(spark):
    df = spark.createDataFrame([(x,) for x in (-90.0, 0.0, 90.0, 400.0, -400.0, None, float("nan"))], "x double")
    assert [r[0] for r in df.select(cell(F.col("x"), -90, 90, 4)).collect()] == [0, 8, 15, 15, 0, 0, 0]
    assert df.select(cell(F.col("x"), 5, 5, 4)).count() == 7


def profiles(spark, n=60_000):
    def part(i, size):
        return F.pmod(F.xxhash64("id", F.lit(i)), F.lit(size))

    return spark.range(n).select(
        (part(1, 5) + 1).cast("int").alias("basin"), F.timestamp_seconds(part(2, 10 ** 8) + 10 ** 9).alias("timestamp"),
        F.xxhash64("id", F.lit(9)).alias("cycle_number"), (part(4, 3600) / 10.0 - 180).alias("longitude"),
        (part(5, 1800) / 10.0 - 90).alias("latitude"), (part(6, 4000) / 2.0).alias("pressure_decibar"))


def groups_met(path, **ranges):
    """(row groups whose statistics meet all ranges, all row groups)"""
    met = total = 0
    for name in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
        for g in range(meta.num_row_groups):
            stats = {c: meta.row_group(g).column(at[c]).statistics for c in ranges}
            total += 1
            met += all(s.max >= low and s.min <= high for (low, high), s in ((ranges[c], stats[c]) for c in ranges))
    return met, total


def scanned(df):
    """Rows that the file scan of a plan without shuffles put out."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_a_box_meets_fewer_row_groups_along_the_curve(spark, tmp_path):
    rows = profiles(spark)
    write_clustered(rows, str(tmp_path / "time"), files=64)
    write_clustered(rows, str(tmp_path / "curve"), curve=CURVE, files=64)
    box = {"latitude": (5.0, 25.0), "longitude": (0.0, 40.0)}
    by_time, total = groups_met(str(tmp_path / "time"), **box)
    along, same = groups_met(str(tmp_path / "curve"), **box)
    assert by_time == total and same >= 60 and along <= same // 3
    for one in box:  # a single dimension is not lost either
        assert groups_met(str(tmp_path / "curve"), **{one: box[one]})[0] <= same * 2 // 3
    where = "latitude BETWEEN 5 AND 25 AND longitude BETWEEN 0 AND 40"
    want = sorted(map(tuple, rows.where(where).collect()))
    got = spark.read.parquet(str(tmp_path / "curve")).where(where)
    assert sorted(map(tuple, got.collect())) == want and scanned(got) < 60_000 // 3


def test_one_value_is_found_through_bloom_filters(spark, tmp_path):
    """Cycle numbers are spread at random here, so minimum and maximum skip nothing and dictionaries are too large."""
    rows = profiles(spark)
    one = rows.orderBy("cycle_number").limit(40_000).agg(F.max("cycle_number")).first()[0]
    for name, bloom in (("with", ("cycle_number",)), ("without", ())):
        write_clustered(rows, str(tmp_path / name), curve=CURVE, files=8, bloom=bloom, row_group_bytes=64 << 10)
    found = {n: spark.read.option("parquet.filter.columnindex.enabled", "false").option("parquet.filter.dictionary.enabled", "false")
             .parquet(str(tmp_path / n)).where(F.col("cycle_number") == one) for n in ("with", "without")}
    assert found["with"].count() == found["without"].count() == 1
    assert scanned(found["with"]) <= scanned(found["without"]) // 4


def test_crowded_places_and_empty_tables(spark, tmp_path):
    same = profiles(spark, 5_000).withColumns({"latitude": F.lit(1.0), "longitude": F.lit(2.0), "timestamp": F.lit("2024-01-01").cast("timestamp")})
    write_clustered(same, str(tmp_path / "same"), curve=CURVE, files=8)
    sizes = [pq.ParquetFile(f).metadata.num_rows for f in glob.glob(str(tmp_path / "same/*.parquet"))]
    assert sum(sizes) == 5_000 and max(sizes) < 1_500  # pressure cuts what the curve cannot
    write_clustered(same.where("basin > 9"), str(tmp_path / "none"), curve=CURVE)
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0
