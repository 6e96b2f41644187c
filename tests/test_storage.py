import pytest
from pyspark.sql import functions as F

from thermocline import session
from thermocline.operators.chunking import chunk_profiles
from thermocline.operators.quality import clean
from thermocline.plans.ingest import ingest_directory, ingest_totals
from thermocline.plans.retrieval import build_index
from thermocline.sources import files, index as indexes, jdbc
from thermocline.sources import months
from thermocline.streaming.ingest import apply_notices, ingest_available, ingest_changes

HEADER = ["basin", "timestamp", "cycle_number", "vertical_sampling_scheme", "longitude", "latitude",
          "pressure_decibar", "salinity_psu", "temperature_degC"]


def _write(folder, name, lines, header=HEADER):
    (folder / name).write_text("\n".join([",".join(header), *lines]) + "\n", encoding="utf-8")


@pytest.fixture
def raw_dir(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    _write(folder, "data_2025-01_raw.csv", [
        '1,2025-01-01T00:00:00Z,3,"Primary, deep ""x""",10,20,5.5,35,12',
        "2,2025-01-01T00:00:00Z,3,,-180,90,0,nan,",
        "NULL,2025-01-01T00:00:00Z,3,s,10,20,5,35,12",
        "1,2025-01-01T00:00:00Z,3,s,10,99.65,5,35,12"])
    _write(folder, "data_2025-02_raw.csv", ["3,2025-02-01,4,s,1,2,3,4,5"])
    (folder / "notes.txt").write_text("not data")
    return folder


def test_csv_to_parquet(spark, raw_dir, tmp_path):
    out = str(tmp_path / "out")
    summary = {r.source_name: r for r in ingest_directory(spark, str(raw_dir), out).collect()}
    first = summary["data_2025-01_processed"]
    assert (first.rows_read, first.rows_dropped, first.rows_rejected, first.rows_kept, first.rows_stored, first.intact) == (4, 1, 1, 2, 2, 1)
    rows = files.read_profiles(spark, out).orderBy("basin").collect()
    assert [r.basin for r in rows] == [1, 2, 3] and rows[0].vertical_sampling_scheme == 'Primary, deep "x"'
    assert (rows[1].salinity_psu, rows[1].temperature_degc, rows[1].vertical_sampling_scheme) == (0.0, 0.0, "")


def test_ingesting_one_source_again_keeps_the_others(spark, raw_dir, tmp_path):
    out = str(tmp_path / "out")
    ingest_directory(spark, str(raw_dir), out)
    again = clean(files.read_csv(spark, str(raw_dir))).filter("source_name = 'data_2025-02_raw.csv'")
    files.write_profiles(again, out)
    files.write_profiles(again, out)
    assert files.read_profiles(spark, out).count() == 3


def test_a_file_that_keeps_no_row_now_leaves_none(spark, raw_dir, tmp_path):
    out = str(tmp_path / "out")
    ingest_directory(spark, str(raw_dir), out)
    _write(raw_dir, "data_2025-02_raw.csv", ["3,2025-02-01,4,s,1,99,3,4,5"])
    summary = {r.source_name: r for r in ingest_directory(spark, str(raw_dir), out).collect()}
    emptied = summary["data_2025-02_processed"]
    assert (emptied.rows_read, emptied.rows_kept, emptied.rows_stored, emptied.intact) == (1, 0, 0, 1)
    assert sorted(r.basin for r in files.read_profiles(spark, out).collect()) == [1, 2]
    _write(raw_dir, "data_2025-01_raw.csv", ["NULL,2025-01-01,3,s,10,20,5,35,12"])
    assert [r.rows_stored for r in ingest_directory(spark, str(raw_dir), out).collect()] == [0, 0]


def test_a_different_header_is_not_misread(spark, raw_dir):
    _write(raw_dir, "other_raw.csv", ["9,1,2025-02-01,4,s,1,2,3,4"], header=HEADER[1:] + HEADER[:1])
    with pytest.raises(Exception):
        files.read_csv(spark, str(raw_dir)).collect()


def test_stream_equals_batch_and_is_incremental(spark, raw_dir, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    ingest_available(spark, str(raw_dir), out, state, HEADER)
    batch = clean(files.read_csv(spark, str(raw_dir))).drop("source_name")
    stream = files.read_profiles(spark, out).drop("source_name")
    assert batch.exceptAll(stream).count() == 0 and stream.exceptAll(batch).count() == 0
    _write(raw_dir, "data_2025-03_raw.csv", ["4,2025-03-01,4,s,1,2,3,4,5"])
    ingest_available(spark, str(raw_dir), out, state, HEADER)
    ingest_available(spark, str(raw_dir), out, state, HEADER)
    assert sorted(r.basin for r in files.read_profiles(spark, out).collect()) == [1, 2, 3, 4]


def _stored(spark, path):
    return sorted((r.source_name, r.basin, str(r.timestamp)) for r in files.read_stored(spark, path).collect())


def test_stream_replaces_a_file_that_comes_again(spark, raw_dir, tmp_path):
    """Changed, emptied and new files; a replayed batch and a run without news change nothing; equal to the batch."""
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    ingest_changes(spark, str(raw_dir), out, state)
    assert [n for n, _, _ in _stored(spark, out)] == ["data_2025-01_processed"] * 2 + ["data_2025-02_processed"]
    _write(raw_dir, "data_2025-01_raw.csv", ["NULL,2025-01-01,3,s,10,20,5,35,12"])
    _write(raw_dir, "data_2025-02_raw.csv", ["4,2025-02-01,4,s,1,2,3,4,5", "4,2025-05-01,4,s,1,2,3,4,5"])
    _write(raw_dir, "a b+c_raw.csv", ["5,2025-02-01,4,s,1,2,3,4,5"])
    ingest_changes(spark, str(raw_dir), out, state)
    after = _stored(spark, out)
    assert [(n, b) for n, b, _ in after] == [("a b+c_processed", 5), ("data_2025-02_processed", 4), ("data_2025-02_processed", 4)]
    ingest_directory(spark, str(raw_dir), str(tmp_path / "batch"))
    assert _stored(spark, str(tmp_path / "batch")) == after
    written = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
    notices = spark.read.parquet(f"{state}/notices")
    apply_notices(notices, 0, out, state)
    ingest_changes(spark, str(raw_dir), out, state)
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")} == written


def test_a_replacement_that_broke_off_is_repaired(spark, raw_dir, tmp_path, monkeypatch):
    """It stops after the new rows are added; by the next run the file has changed again, to other months."""
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    ingest_changes(spark, str(raw_dir), out, state)
    _write(raw_dir, "data_2025-02_raw.csv", ["3,2025-02-01,4,s,1,2,3,4,5", "4,2025-07-01,4,s,1,2,3,4,5"])
    listed, calls = months._list, []

    def stopping(*args):
        calls.append(1)
        if len(calls) > 1:
            raise RuntimeError("stopped")
        listed(*args)

    monkeypatch.setattr(months, "_list", stopping)
    with pytest.raises(RuntimeError):
        ingest_directory(spark, str(raw_dir), out)
    monkeypatch.undo()
    assert files.read_stored(spark, out).where("month(timestamp) = 7").count() == 1
    _write(raw_dir, "data_2025-02_raw.csv", ["5,2025-09-01,4,s,1,2,3,4,5"])
    ingest_changes(spark, str(raw_dir), out, state)
    assert [b for _, b, _ in _stored(spark, out)] == [1, 2, 5]


def test_months_are_pruned_and_other_sources_left(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = spark.range(1200).selectExpr("1 AS basin", "timestamp'2025-01-15 00:00:00' + make_interval(0, cast(id % 12 AS int)) AS timestamp",
                                        "cast(id AS int) AS cycle_number", "'s' AS vertical_sampling_scheme", "1.0D AS longitude", "2.0D AS latitude",
                                        "cast(id AS double) AS pressure_decibar", "3.0D AS salinity_psu", "4.0D AS temperature_degc",
                                        "concat('f', id % 5, '_raw.csv') AS source_name")
    files.write_profiles(rows, path)
    found = files.read_profiles(spark, path, "2025-03-01", "2025-05-01")
    assert found.count() == 200 and "month" not in found.columns
    assert {int(r[0].split("month=")[1][:6]) for r in found.select(F.input_file_name()).distinct().collect()} == {202503, 202504}
    assert "PartitionFilters: [isnotnull(month" in found._jdf.queryExecution().executedPlan().toString()
    untouched = {p: p.stat().st_mtime_ns for p in (tmp_path / "p").glob("month=*/*/*.parquet")}
    files.write_profiles(rows.where("source_name = 'f1_raw.csv' AND month(timestamp) = 3"), path)
    slot = spark.range(1).select(months.slot_of(F.lit("f1_processed"))).first()[0]
    kept = {p: t for p, t in untouched.items() if f"slot={slot}/" not in str(p)}
    assert kept and all(p.stat().st_mtime_ns == t for p, t in kept.items())
    assert files.read_stored(spark, path).count() == 1200 - 240 + 20
    listed = months.sources(spark, path)
    assert [(r.month, r.rows) for r in listed.where("source_name = 'f1_processed'").collect()] == [(202503, 20)]


def test_missing_columns_are_named(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError, match="latitude"):
        files.read_profiles(spark, str(tmp_path / "p"))


def test_processed_name(spark):
    names = ["a_2025_raw.csv", "b.csv", "c.d_raw.csv", "a_2025_processed.csv"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(files.processed_name(F.col("n"))).collect()] == ["a_2025_processed", "b", "c.d_processed", "a_2025_processed.csv"]


def test_files_of_one_stored_name_are_kept_apart(spark, raw_dir, tmp_path):
    _write(raw_dir, "data_2025-02_processed.csv", ["4,2025-02-03,4,s,1,2,3,4,5", "5,2025-02-03,4,s,1,2,3,4,5"])
    summary = {r.source_name: r for r in ingest_directory(spark, str(raw_dir), str(tmp_path / "out")).collect()}
    assert [(summary[n].rows_stored, summary[n].intact) for n in ("data_2025-02_processed", "data_2025-02_processed.csv")] == [(1, 1), (2, 1)]


def test_one_bad_file_does_not_end_the_run(spark, raw_dir, tmp_path):
    """Other orders, further columns, byte order marks; short, empty and binary files; rows with too few fields."""
    out = str(tmp_path / "out")
    ingest_directory(spark, str(raw_dir), out)
    _write(raw_dir, "order_raw.csv", ["x,7.5,5,4,3,2,1,s,4,2025-03-01,1"], header=["\ufeffship", "speed", *HEADER[::-1]])
    _write(raw_dir, "cut_raw.csv", ["1,2025-04-01,4,s,1,2,3,4,5", "1,2025-04-01,4,s,1", "1,2025-04-01,4,s,1,2,3,4,5,6"])
    _write(raw_dir, "a b+c_raw.csv", ["2,2025-04-01,4,s,1,2,3,4,5"])
    _write(raw_dir, "short_raw.csv", ["1,2"], header=HEADER[:2])
    _write(raw_dir, "twice_raw.csv", ["1,2025-04-01,4,s,1,2,3,4,5,1"], header=[*HEADER, "basin"])
    (raw_dir / "empty_raw.csv").write_text("")
    (raw_dir / "data_2025-01_raw.csv").write_bytes(bytes(range(256)) * 20)  # was good before
    summary = ingest_directory(spark, str(raw_dir), out)
    got = {r.source_name: r for r in summary.collect()}
    assert {n: r.error for n, r in got.items() if r.error} == {
        "short_processed": f"columns missing: {', '.join([*HEADER[2:8], 'temperature_degc'])}", "twice_processed": "columns repeated: basin",
        "empty_processed": "the file has no header line", "data_2025-01_processed": got["data_2025-01_processed"].error}
    assert got["data_2025-01_processed"].rows_stored == 2 and got["data_2025-01_processed"].intact == 0  # what was stored stays
    assert (got["cut_processed"].rows_read, got["cut_processed"].rows_malformed, got["cut_processed"].rows_kept) == (3, 2, 1)
    row = files.read_profiles(spark, out).filter("source_name = 'order_processed'").first()
    assert (row.basin, row.cycle_number, row.longitude, row.latitude, row.pressure_decibar, row.salinity_psu, row.temperature_degc) == (1, 4, 1.0, 2.0, 3.0, 4.0, 5.0)
    totals = ingest_totals(summary).first()
    assert got["a b+c_processed"].rows_stored == 1
    assert (totals.files, totals.files_failed, totals.status, totals.rows_malformed) == (8, 4, "partial", 2)


def test_totals_of_no_files(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    assert ingest_totals(ingest_directory(spark, str(tmp_path / "raw"), str(tmp_path / "out"))).first().status == "empty"


def test_raw_text_is_parsed_once(spark, raw_dir, tmp_path, monkeypatch):
    """Written rows and all counts come from one parse: the staged table is the only thing that reads CSV."""
    from thermocline.plans import ingest
    accumulated = spark.sparkContext.accumulator(0)

    def counting(spark, directory, read=files.read_csv_files):
        rows, found = read(spark, directory)

        def tick(batches):
            for batch in batches:
                accumulated.add(batch.num_rows)
                yield batch

        return rows.mapInArrow(tick, rows.schema), found

    monkeypatch.setattr(ingest, "read_csv_files", counting)
    summary = ingest.ingest_directory(spark, str(raw_dir), str(tmp_path / "out"))
    assert sum(r.rows_read for r in summary.collect()) == 5 and accumulated.value == 5


def test_days_and_months_are_told_apart_by_file(spark, raw_dir, tmp_path):
    _write(raw_dir, "days_raw.csv", [f"1,{t},4,s,1,2,3,4,5" for t in ("13/01/2024 10:00", "02/01/2024", "soon")])
    _write(raw_dir, "months_raw.csv", [f"2,{t},4,s,1,2,3,4,5" for t in ("01/13/2024 10:00", "02/01/2024 03:04 pm")])
    got = {r.source_name: r for r in ingest_directory(spark, str(raw_dir), str(tmp_path / "out")).collect()}
    assert (got["days_processed"].rows_unparsed, got["days_processed"].rows_dropped, got["days_processed"].rows_kept) == (1, 1, 2)
    rows = files.read_profiles(spark, str(tmp_path / "out")).filter("year(timestamp) = 2024")
    times = sorted(str(r.timestamp) for r in rows.select(F.col("timestamp").cast("string").alias("timestamp")).collect())
    assert times == ["2024-01-02 00:00:00", "2024-01-13 10:00:00", "2024-01-13 10:00:00", "2024-02-01 15:04:00"]


def test_row_limit(spark):
    df = spark.createDataFrame([(2, 1.0), (1, 5.0), (1, 2.0)], "timestamp int, pressure_decibar double")
    assert [tuple(r) for r in files.row_limit(df, 2).collect()] == [(1, 2.0), (1, 5.0)]
    assert files.row_limit(df, None).count() == 3


def test_index_round_trip(spark, profile_rows, tmp_path):
    df = profile_rows([(f"2024-01-0{d} 00:00:00", float(p), 1.0, 35.0) for d in (1, 2, 3) for p in range(4)])
    built, path = build_index(df), str(tmp_path / "index")
    indexes.write_index(built, path)
    info = indexes.load_info(spark, path).first()
    assert (info.total_vectors, info.vector_dimension, info.index_type) == (3, 384, "exact")
    loaded = indexes.load_index(spark, path)
    assert indexes.check_index(loaded, loaded, 3).first().consistent == 1
    row = indexes.check_index(loaded.limit(2), loaded, 3).first()
    assert (row.metadata_unmatched, row.vectors_unmatched, row.consistent) == (1, 0, 0)


def test_cells_are_partitions(spark, profile_rows, tmp_path):
    from thermocline.operators import vectors as V
    df = profile_rows([(f"2024-01-{d:02d} 00:00:00", float(d * p), 1.0, 35.0) for d in range(1, 13) for p in range(4)])
    built = build_index(df)
    centres = V.train_cells(built, 3)
    indexes.write_index(V.assign_cells(built, centres), str(tmp_path / "index"), kind="cells")
    cells = indexes.load_index(spark, str(tmp_path / "index"))
    assert cells.count() == 12 and 1 <= cells.select("cell").distinct().count() <= 3


@pytest.mark.parametrize("format", ["json", "csv", "xml"])
def test_results(spark, profile_rows, tmp_path, format):
    chunks = chunk_profiles(profile_rows([("2024-01-01 00:00:00", 1.0, 1.0, 35.0)])).withColumn("score", F.lit(0.5))
    path = str(tmp_path / "r")
    if format == "xml":
        with pytest.raises(ValueError):
            files.write_results(chunks, path, format)
        return
    files.write_results(chunks, path, format)
    if format == "csv":
        assert spark.read.option("header", True).csv(path).columns == files.RESULT_COLUMNS
    else:
        assert spark.read.json(path).first().metadata.basin == 1


def test_jdbc_edge_types(spark, profile_rows):
    types = dict(jdbc.for_jdbc(profile_rows([("2024-01-01 00:00:00", 1.005, 1.0, None)])).dtypes)
    assert types["latitude"] == "decimal(12,8)" and types["pressure_decibar"] == "decimal(10,2)"
    assert types["basin"] == "int" and types["salinity_psu"] == "decimal(10,6)"


def test_clustered_layout_separates_times(spark, profile_rows, tmp_path):
    df = profile_rows([(f"2024-01-{d:02d} 00:00:00", float(p), 1.0, 35.0) for d in range(1, 20) for p in range(20)])
    files.write_clustered(df.repartition(6), str(tmp_path / "c"))
    spans = (spark.read.parquet(str(tmp_path / "c")).groupBy(F.input_file_name())
             .agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).orderBy("a", "b").collect())
    assert all(x.b <= y.a for x, y in zip(spans, spans[1:]))


def test_shared_folder(spark):
    assert session.scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")


def test_names_of_sources_take_no_pattern(spark, tmp_path):
    """A pattern that looks for the end of a path tries every place of it, for every row."""
    from thermocline.sources.files import read_csv_files
    head = "basin,timestamp,cycle_number,vertical_sampling_scheme,longitude,latitude,pressure_decibar,salinity_psu,temperature_degC"
    names = {"a b+c_raw.csv", "d%20e_raw.csv"}
    for name in names:
        (tmp_path / name).write_text(f"{head}\n1,2024-02-01 00:00:00,3,s,1,2,3,4,5\n")
    rows, _ = read_csv_files(spark, str(tmp_path))
    assert "regexp" not in rows._jdf.queryExecution().analyzed().toString()
    assert {r.source_name for r in rows.collect()} == names


def test_staged_files_need_no_sort(spark, tmp_path):
    from checks.fixture import open_writers
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    rows = [(i, None if i % 3 == 0 else f"s{i % 3}") for i in range(30)]
    with open_writers(spark):
        assert int(spark.conf.get(name)) > 0
        spark.createDataFrame(rows, "n long, source string").write.partitionBy("source").csv(str(tmp_path / "t"))
    assert spark.conf.get(name) == before
    assert {(r.n, r.source) for r in spark.read.schema("n long, source string").csv(str(tmp_path / "t")).collect()} == set(rows)


def test_one_csv_is_written_by_all_tasks(spark, tmp_path):
    """One file with its header first, whatever the number of tasks and whatever the texts hold."""
    from checks.storage import _one_csv
    rows = [(str(i), 'a "quoted", text' if i % 7 == 0 else None if i % 7 == 1 else "" if i % 7 == 2 else " x ") for i in range(100)]
    target = tmp_path / "one" / "some_raw.csv"
    _one_csv(spark.createDataFrame(rows, "n string, b string").repartition(5), str(target))
    back = spark.read.option("header", True).option("escape", '"').csv(str(target))
    assert back.columns == ["n", "b"] and target.read_text().startswith("n,b\n") and back.count() == 100
    old = tmp_path / "old"
    spark.createDataFrame(rows, "n string, b string").coalesce(1).write.option("header", True).option("escape", '"').csv(str(old))
    assert sorted(next(old.glob("part-*")).read_text().splitlines()) == sorted(target.read_text().splitlines())
    assert [p.name for p in target.parent.iterdir() if not p.name.startswith(".")] == ["some_raw.csv"]


def test_sources_are_listed_without_sorting_rows(spark, tmp_path, monkeypatch):
    """Sources, months and rows are counted by hash: no task sorts the rows that it reads, whatever their number."""
    rows = spark.createDataFrame([(1, t, 4, "s", 1.0, 2.0, 3.0, 4.0, 5.0, name) for t, name in (
        ("2024-01-05", "a_raw.csv"), ("2024-02-05", "a_raw.csv"), (None, None), ("2024-01-05", "b_raw.csv"))],
        "basin int, timestamp string, cycle_number int, vertical_sampling_scheme string, longitude double, latitude double, "
        "pressure_decibar double, salinity_psu double, temperature_degc double, source_name string")
    rows = rows.withColumn("timestamp", F.to_timestamp("timestamp"))
    kept, plans = months.durable, []

    def recording(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df)

    monkeypatch.setattr(months, "durable", recording)
    path = str(tmp_path / "stored")
    for _ in range(2):
        files.write_profiles(rows, path)
    counting = [p for p in plans if "timestamp" in p or "FileScan" in p and "incoming" in p]
    assert counting and not any("SortAggregate" in p for p in counting)
    listed = months.sources(spark, path).select("source_name", "month", "rows").collect()
    assert sorted(map(tuple, listed)) == [("", 0, 1), ("a_processed", 202401, 1), ("a_processed", 202402, 1), ("b_processed", 202401, 1)]
    assert files.read_profiles(spark, path).count() == 4
