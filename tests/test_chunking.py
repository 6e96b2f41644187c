import random

import pytest
from pyspark.sql import functions as F

from thermocline.functions.rendering import fixed_point, fixed_point_length
from thermocline.operators import chunking as C


def _text(rows, ts="2024-01-01 00:00:00"):
    """Independent rendering of one profile."""
    lines = [f"ARGO Float Profile - Timestamp: {ts}", "Location: 45.250000°N, -30.500000°E", "Basin: 1, Cycle: 7",
             "Sampling Scheme: Primary sampling", f"Profile Depth Points: {len(rows)}", "", "Depth Profile Measurements:"]
    lines += [f"  {i:3d}. Pressure: {p:6.1f} dbar, Temperature: {t:6.3f}°C, Salinity: {s:6.3f} PSU"
              for i, (p, t, s) in enumerate(sorted(rows), 1)]
    return "\n".join(lines)


def _profile(n):
    return [(float(i) * 10, 20.0 - i * 0.1, 35.0) for i in range(n)]


def _collect(chunks):
    rows = C.with_text(chunks).orderBy("chunk_number").collect()
    return [(r.chunk_id, r.chunk_number, r.timestamp, r.metadata, r.measurements, r.source, r.chunk_type, r.text)
            for r in rows]


def test_text_and_metadata(spark, profile_rows):
    rows = _profile(3)
    chunk = C.with_text(C.chunk_profiles(profile_rows([("2024-01-01 00:00:00", *m) for m in reversed(rows)]))).first()
    assert chunk.text == _text(rows)
    assert (chunk.chunk_id, chunk.chunk_type, chunk.source) == ("argo_timestamp_000000", "temporal_profile", "argo_floats")
    assert chunk.metadata.profile_count == 3 and chunk.metadata.sub_chunk_info is None


@pytest.mark.parametrize("over", [0, 1])
def test_split_only_beyond_the_limit(spark, profile_rows, over):
    rows = _profile(16)
    limit = len(_text(rows)) - over
    chunks = C.chunk_profiles(profile_rows([("2024-01-01 00:00:00", *m) for m in rows]), limit=limit)
    got = _collect(chunks)
    assert len(got) == (1 if not over else -(-16 // max(1, limit // 80 - 10)))


@pytest.mark.parametrize("n, parts", [(15, [15]), (16, [15, 1]), (31, [15, 15, 1])])
def test_parts_hold_fifteen(spark, profile_rows, n, parts):
    got = _collect(C.chunk_profiles(profile_rows([("2024-01-01 00:00:00", *m) for m in _profile(n)], vertical_sampling_scheme="x" * 2000)))
    assert [len(g[4]) for g in got] == parts
    assert [g[0] for g in got] == [f"argo_timestamp_000000_part_{i:02d}" for i in range(len(parts))]
    assert got[-1][3].sub_chunk_info == f"Part {len(parts)}, depths {15 * (len(parts) - 1) + 1}-{n}"
    assert "    1. Pressure" in got[-1][7] and got[0][6] == "temporal_profile_split"


@pytest.mark.parametrize("few_keys", [0, 100])
def test_numbering_counts_parts_across_days_and_years(spark, profile_rows, few_keys):
    stamps = ["2022-12-31 23:00:00", "2023-01-01 00:00:00", "2023-01-01 06:00:00", "2023-06-01 00:00:00", "2024-01-01 00:00:00"]
    sizes = [2, 40, 1, 33, 3]
    rows = [(ts, *m) for ts, n in zip(stamps, sizes) for m in _profile(n)]
    random.Random(1).shuffle(rows)
    got = _collect(C.chunk_profiles(profile_rows(rows), few_keys=few_keys))
    expected, number = [], 0
    for ts, n in zip(stamps, sizes):
        parts = -(-n // 15) if len(_text(_profile(n), ts)) > 2000 else 1
        split = len(_text(_profile(n), ts)) > 2000
        expected += [f"argo_timestamp_{number:06d}" + (f"_part_{i:02d}" if split else "") for i in range(parts)]
        number += parts
    assert [g[0] for g in got] == expected
    assert [g[1] for g in got] == list(range(number))


def test_large_groups_give_the_same_chunks(spark, profile_rows):
    rng = random.Random(5)
    rows = []
    for day, n in ((1, 400), (2, 3), (3, 90), (4, 1)):
        rows += [(f"2024-01-0{day} 00:00:00", rng.choice([5.0, 10.0, 10.5, 20.0]), rng.choice([1.0, 2.0]), rng.choice([34.0, 35.0]))
                 for _ in range(n)]
    rows += [("2024-01-01 00:00:00", 10.0, 1.0, 34.0)] * 200  # copies of one measurement
    df = profile_rows(rows).repartition(5)
    plain, spread = _collect(C.chunk_profiles(df)), _collect(C.chunk_profiles(df, hot_rows=20))
    assert len(plain) > 45 and plain == spread


def test_copies_beyond_one_block(spark, profile_rows, monkeypatch):
    monkeypatch.setattr(C, "_BLOCK_PARTS", 3)
    df = profile_rows([("2024-01-01 00:00:00", 10.0, 1.0, 34.0)] * 200 + [("2024-01-01 00:00:00", 5.0, 1.0, 34.0)] * 7)
    assert _collect(C.chunk_profiles(df)) == _collect(C.chunk_profiles(df, hot_rows=0))


def test_many_hot_keys_without_broadcast(spark, profile_rows):
    rows = [(f"2024-01-{d:02d} 00:00:00", *m) for d in range(1, 6) for m in _profile(50)]
    want = _collect(C.chunk_profiles(profile_rows(rows)))
    assert _collect(C.chunk_profiles(profile_rows(rows), hot_rows=20, few_keys=2)) == want


def test_independent_of_partitioning_and_order(spark, profile_rows):
    rng = random.Random(3)
    rows = [(f"2024-01-{d:02d} 0{h}:00:00", rng.choice([1.0, 2.0, 3.0]), rng.random(), 35.0, {"latitude": float(rng.randint(-5, 5))})
            for d in range(1, 8) for h in range(4) for _ in range(rng.randint(1, 40))]
    want = _collect(C.chunk_profiles(profile_rows(rows)))
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        assert _collect(C.chunk_profiles(profile_rows(rows).repartition(7))) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_first_row_is_the_shallowest(spark, profile_rows):
    df = profile_rows([("2024-01-01 00:00:00", 50.0, 1.0, 35.0, {"basin": 2}), ("2024-01-01 00:00:00", 5.0, 1.0, 35.0, {"basin": 4})])
    assert C.chunk_profiles(df).first().metadata.basin == 4


def test_group_by_float_as_well(spark, profile_rows):
    df = profile_rows([("2024-01-01 00:00:00", 50.0, 1.0, 35.0, {"basin": 2}), ("2024-01-01 00:00:00", 5.0, 1.0, 35.0, {"basin": 4})])
    got = _collect(C.chunk_profiles(df, keys=("timestamp", "basin", "cycle_number")))
    assert [(g[0], g[3].basin) for g in got] == [("argo_timestamp_000000", 2), ("argo_timestamp_000001", 4)]


def test_fractional_seconds_and_missing_values(spark, profile_rows):
    df = profile_rows([("2024-01-01 00:00:00.5", 5.0, None, None)])
    chunk = C.with_text(C.chunk_profiles(df)).first()
    assert chunk.timestamp == "2024-01-01 00:00:00.500000"
    assert "Temperature:    nan°C, Salinity:    nan PSU" in chunk.text


def test_empty_input(spark, profile_rows):
    assert C.chunk_profiles(profile_rows([("2024-01-01 00:00:00", 1.0, 1.0, 1.0)]).limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 10, 11])
def test_preview(spark, profile_rows, n):
    chunks = C.chunk_profiles(profile_rows([("2024-01-01 00:00:00", *m) for m in _profile(max(n, 1))]))
    if n == 0:
        chunks = chunks.withColumn("measurements", F.slice("measurements", 1, 0))
    text = C.with_preview(chunks).first().text
    assert ("... and 1 more measurements" in text) == (n == 11)
    if n == 0:
        assert text.endswith("Profile Depth Points: 0\n")
    if n == 10:
        assert text == _text(_profile(10))


def test_statistics(spark, profile_rows):
    rows = [("2024-01-01 00:00:00", *m) for m in _profile(2)] + [("2024-01-02 00:00:00", *m) for m in _profile(40)]
    chunks = C.chunk_profiles(profile_rows(rows))
    lengths = sorted(len(g[7]) for g in _collect(chunks))
    row = C.chunk_statistics(chunks).first()
    assert (row.total_chunks, row.whole_chunks, row.split_chunks, row.measurements_total) == (4, 1, 3, 42)
    assert (row.text_min, row.text_max, row.text_median_upper) == (lengths[0], lengths[-1], lengths[2])


def test_explode(spark, profile_rows):
    chunks = C.chunk_profiles(profile_rows([("2024-01-01 00:00:00", *m) for m in _profile(40)]))
    flat = C.explode_measurements(chunks)
    assert flat.count() == 40 and flat.filter("basin = 1 and cycle_number = 7").count() == 40


@pytest.mark.parametrize("value", [0.0, -0.04, 9.95, -9.9996, 99.9996, 100.0, -1234.5, 99999.94, 1e16, 1e300, -0.0004])
@pytest.mark.parametrize("digits", [1, 3])
def test_fixed_point(spark, value, digits):
    row = spark.createDataFrame([(value,)], "x double").select(
        fixed_point(F.col("x"), digits, 6).alias("text"), fixed_point_length(F.col("x"), digits, 6).alias("n")).first()
    if value not in (9.95,):  # a decimal tie
        assert row.text == f"{value:6.{digits}f}" or value >= 1e16
    assert row.n == len(row.text)


def test_running_numbers_of_one_crowded_day(spark):
    from thermocline.operators.numbering import add_preceding_sum

    rows = spark.range(2_000).select(F.expr("timestamp_seconds(id * 7)").alias("t"), F.col("id"), (F.col("id") % 3 + 1).alias("parts"))
    numbered = add_preceding_sum(rows.repartition(8), ["t"], "parts", "before")
    assert "date_trunc" not in numbered._jdf.queryExecution().toString()
    before = 0
    for r in numbered.orderBy("id").collect():
        assert r.before == before
        before += r.parts


def test_parts_do_not_carry_their_group(spark, profile_rows):
    """Each part is cut before it becomes a row; a row for each part with the whole group is quadratic in the group."""
    rows = [("2024-01-01 00:00:00", *m) for m in _profile(200)]
    chunks = C.chunk_profiles(profile_rows(rows))
    plan = chunks._jdf.queryExecution().optimizedPlan().toString()
    assert [line for line in plan.splitlines() if "Generate" in line] and not any("all#" in line for line in plan.splitlines() if "Generate" in line)
    assert [len(r.measurements) for r in chunks.orderBy("chunk_number").collect()] == [15] * 13 + [5]
