import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermocline.operators import cells as C, vectors as V
from thermocline.plans import retrieval as P
from thermocline.sources import index as I


def _frame(spark, matrix, id_name="chunk_id", vector_name="embedding"):
    rows = [(i if id_name == "query_id" else f"c{i:04d}", [float(x) for x in v]) for i, v in enumerate(matrix)]
    kind = "int" if id_name == "query_id" else "string"
    return spark.createDataFrame(rows, f"{id_name} {kind}, {vector_name} array<float>")


def _rows(df):
    return {(r.query_id, r.chunk_id, r["rank"], r.score) for r in df.collect()}


@pytest.fixture(scope="module")
def data():
    """Twelve far groups, one of them of copies, and queries in, between and far from them."""
    rng = np.random.default_rng(8)
    groups = rng.normal(size=(12, 8)) * 10
    vectors = np.repeat(groups, 50, axis=0) + rng.normal(size=(600, 8)) * 0.3
    vectors[100:150] = vectors[100]
    queries = np.concatenate([groups[:6] + 0.1, (groups[6:9] + groups[7:10]) / 2, vectors[100:101],
                              np.full((1, 8), 500.0), np.zeros((1, 8))])
    return vectors, queries


@pytest.fixture(scope="module")
def stored(spark, data, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cells"))
    I.write_index(C.with_cells(_frame(spark, data[0]), 12), path, cell_rows=20)
    return I.load_index(spark, path), I.load_cells(spark, path), path


def test_stored_cells(spark, data, stored):
    index, cells, path = stored
    described = {r.cell: r for r in cells.collect()}
    assert sum(r.vectors for r in described.values()) == index.count() == 600
    assert I.load_info(spark, path).first().index_type == "cells"
    for cell, r in described.items():
        own = np.array([v.embedding for v in index.filter(F.col("cell") == cell).collect()])
        assert len(own) == r.vectors and np.allclose(own.mean(0), r.centre, atol=1e-5)
        assert np.sqrt(((own - r.centre) ** 2).sum(1)).max() == pytest.approx(r.radius, abs=1e-6)


def test_a_crowded_cell_is_written_by_several_tasks(spark, data, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these parts are small
    try:
        I.write_index(_frame(spark, data[0]).withColumn("cell", F.lit(4)), str(tmp_path), cell_rows=100)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(glob.glob(f"{tmp_path}/vectors/cell=4/*.parquet")) > 1
    assert I.load_cells(spark, str(tmp_path)).first().vectors == 600


@pytest.mark.parametrize("metric", ["ip", "l2"])
@pytest.mark.parametrize("k, broadcast_bytes", [(1, 1 << 20), (7, 600), (700, 1 << 20)])
def test_pruned_search_is_exact(spark, data, stored, metric, k, broadcast_bytes):
    index, cells, _ = stored
    queries = _frame(spark, data[1], "query_id", "query_vector")
    found = C.cell_topk(index, queries, k, metric, cells=cells, probes=2, exact=True, broadcast_bytes=broadcast_bytes)
    assert _rows(found) == _rows(V.exact_topk(index, queries, k, metric))


def test_one_cell_holds_everything(spark, data, tmp_path):
    I.write_index(C.with_cells(_frame(spark, data[0]), 1), str(tmp_path))
    index, queries = I.load_index(spark, str(tmp_path)), _frame(spark, data[1], "query_id", "query_vector")
    found = C.cell_topk(index, queries, 4, cells=I.load_cells(spark, str(tmp_path)), exact=True)
    assert _rows(found) == _rows(V.exact_topk(index, queries, 4))


def test_pruning_leaves_out_most_pairs(spark, data, stored):
    index, cells, _ = stored
    queries = _frame(spark, data[1][:6], "query_id", "query_vector")
    first = C.nearest_cells(queries, cells, 1)
    found = C.cell_topk(index, queries, 5, "l2", cells=cells, probes=1)
    rest = C.remaining_cells(first, found, cells, 5, "l2")
    pairs = sum(C.pairs_scored(p, cells).first().pairs for p in (first, rest))
    assert 6 * 5 <= pairs <= 6 * 600 / 4


def test_probes_for_a_recall(spark, data, stored):
    index, cells, _ = stored
    queries = _frame(spark, data[1][:9], "query_id", "query_vector")
    exact = V.exact_topk(index, queries, 60, "l2")
    for target in (0.7, 0.9, 1.0):
        probes = C.probes_for_recall(index, queries, 60, "l2", cells=cells, target=target)

        def share(n):
            found = C.cell_topk(index, queries, 60, "l2", cells=cells, probes=n)
            return V.recall(found, exact).agg(F.avg("recall")).first()[0]

        assert share(probes) >= target - 1e-9
        assert probes == 1 or share(probes - 1) < target


def test_only_probed_cells_are_read(spark, data, stored):
    index, cells, _ = stored
    planned = C.nearest_cells(_frame(spark, data[1][:1], "query_id", "query_vector"), cells, 1)
    part = C.probed_part(index, planned)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    wanted = planned.first().cells
    read = part.select(F.input_file_name().alias("f")).distinct().collect()
    assert len(wanted) == 1 and all(f"cell={wanted[0]}/" in r.f for r in read)


def test_values_that_are_no_numbers_hide_nothing(spark, data, tmp_path):
    vectors = data[0].copy()
    vectors[3, 2] = np.nan
    I.write_index(C.with_cells(_frame(spark, vectors[50:]), 6).unionByName(
        _frame(spark, vectors[:50]).withColumns({"cell": F.lit(77), "chunk_id": F.concat(F.lit("n"), "chunk_id")})),
        str(tmp_path))
    index, cells = I.load_index(spark, str(tmp_path)), I.load_cells(spark, str(tmp_path))
    queries = _frame(spark, data[1][:1], "query_id", "query_vector")
    rest = C.remaining_cells(C.nearest_cells(queries, cells, 1), spark.createDataFrame(
        [], "query_id int, score double"), cells, 1, "l2")
    done = C.nearest_cells(queries, cells, 1).first().cells
    assert sorted(rest.first().cells + done) == sorted(r.cell for r in cells.collect())
    full = C.remaining_cells(C.nearest_cells(queries, cells, 1), spark.createDataFrame(
        [(0, 0.0)], "query_id int, score double"), cells, 1, "l2")
    assert 77 in full.first().cells + done


def test_nothing_stored_and_nothing_asked(spark, data, stored, tmp_path):
    empty = _frame(spark, data[0][:1]).filter("false")
    I.write_index(C.with_cells(empty), str(tmp_path))
    queries = _frame(spark, data[1], "query_id", "query_vector")
    none = C.cell_topk(I.load_index(spark, str(tmp_path)), queries, 3, cells=I.load_cells(spark, str(tmp_path)), exact=True)
    assert none.count() == 0
    assert C.cell_topk(stored[0], queries.filter("false"), 3, cells=stored[1], exact=True).count() == 0
    nulls = queries.withColumn("query_vector", F.lit(None).cast("array<float>"))
    assert C.cell_topk(stored[0], nulls, 3, cells=stored[1]).count() == 0


def test_refusals(spark, data, stored, monkeypatch):
    queries = _frame(spark, data[1], "query_id", "query_vector")
    with pytest.raises(ValueError):
        C.cell_topk(stored[0], queries, 3, cells=stored[1], probes=0)
    with pytest.raises(Exception, match="elements"):
        C.cell_topk(stored[0], _frame(spark, np.ones((1, 3)), "query_id", "query_vector"), 3, cells=stored[1])
    monkeypatch.setattr(C, "MOST_CELLS", 3)
    with pytest.raises(ValueError, match="at most 3"):
        C.cell_topk(stored[0], queries, 3, cells=stored[1])


@pytest.mark.parametrize("strategy", P.STRATEGIES)
def test_retrieval_from_cells(spark, profile_rows, tmp_path, strategy):
    rows = [(f"2024-01-{d:02d} 00:00:00", float(p), d * 2.0, 35.0, {"basin": d % 3 + 1, "cycle_number": d})
            for d in range(1, 13) for p in range(1, 4)]
    built = P.build_index(profile_rows(rows), kind="cells", cells=3)
    I.write_index(built, str(tmp_path))
    index, cells = I.load_index(spark, str(tmp_path)), I.load_cells(spark, str(tmp_path))
    queries = P.text_queries(spark, ["Cycle: 7 temperature", "Basin 2 salinity"])

    def shown(search, **options):
        found = P.retrieve(index, queries, 4, strategy=strategy, search=search, **options)
        return {(r.query_id, r.chunk_id, r["rank"], r.score) for r in found.collect()}

    for options in ({}, {"metadata_filters": {"basin": 2}, "filter_mode": "pre"}):
        assert shown(C.cell_search(cells, 3), **options) == shown(V.exact_topk, **options)
        assert shown(C.cell_search(cells, 1, exact=True), **options) == shown(V.exact_topk, **options)
    with pytest.raises(ValueError):
        P.build_index(profile_rows(rows), kind="graph")


def test_cells_pass_the_driver_as_bits(spark):
    numbers = np.arange(0, 40, 2, dtype=np.int32)
    planned = spark.createDataFrame([(1, [1.0], [0, 38]), (2, [2.0], [])], "query_id long, query_vector array<float>, cells array<int>")
    block = C._packed(planned, numbers, "query_id", "query_vector").sort_by("query_id")
    bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=20) for b in block.column("cells").to_pylist()]
    assert [list(numbers[np.nonzero(b)[0]]) for b in bits] == [[0, 38], []] and len(block.column("cells")[0].as_py()) == 3


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_blocks_and_parts_of_cells_are_exact(spark, data, stored, monkeypatch, metric):
    """Blocks of a few queries, shards of some cells or of a part of one."""
    index, cells, _ = stored
    monkeypatch.setattr(C, "LEAST_SHARD", 5)
    queries = _frame(spark, data[1], "query_id", "query_vector")
    for most in (20, 130):
        monkeypatch.setattr(C, "VECTORS_PER_SHARD", most)
        found = C.cell_topk(index, queries, 7, metric, cells=cells, probes=2, exact=True, broadcast_bytes=900)
        assert _rows(found) == _rows(V.exact_topk(index, queries, 7, metric))
        own = {r.chunk_id: r.cell for r in index.select("chunk_id", "cell").collect()}
        assert all(own[r.chunk_id] == r.cell for r in found.collect())


def test_blocks_are_one_job(spark, data, stored):
    """The number of jobs does not grow with the number of blocks of queries."""
    index, cells, _ = stored
    queries, context = _frame(spark, data[1], "query_id", "query_vector"), spark.sparkContext

    def jobs(broadcast_bytes):
        group = f"blocks of {broadcast_bytes} bytes"
        context.setJobGroup(group, group)
        try:
            C.cell_topk(index, queries, 3, cells=cells, probes=2, exact=True, broadcast_bytes=broadcast_bytes).count()
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
        return len(context.statusTracker().getJobIdsForGroup(group))

    assert jobs(1) <= jobs(900) + 12  # some joins take a job more or less


def test_bounds_are_carried_from_tile_to_tile():
    rng = np.random.default_rng(2)
    queries, vectors = rng.normal(size=(6, 8)), rng.normal(size=(4000, 8))
    vectors[1500:1520] = vectors[7]
    for largest in (True, False):
        bad = -queries @ vectors.T if largest else ((queries[:, None] - vectors[None]) ** 2).sum(2)
        want = [set(np.lexsort((np.arange(4000), row))[:30]) for row in bad]
        add, result = V._topk_collector(30, largest)[1](queries)
        for cell in range(4):
            add(np.arange(cell, 4000, 4), vectors[cell::4], None, cell)
        q, ids, score, tags = result()
        assert [set(ids[q == i]) for i in range(6)] == want and list(tags) == [i % 4 for i in ids]
        # Nothing worse than the bound, and what ties with it, of the queries asked for.
        cut = np.sort(bad, axis=1)[:, 9] * (1 + 1e-12 * np.sign(np.sort(bad, axis=1)[:, 9]))
        add, result = V._topk_collector(30, largest)[1](queries, cut)
        add(np.arange(4000), vectors, np.array([1, 4]))
        q, ids, score, _ = result()
        assert sorted(set(q)) == [1, 4] and all(len(ids[q == i]) == (bad[i] <= cut[i]).sum() >= 10 for i in (1, 4))


def test_odd_values_hide_no_vector_and_large_ones_are_compared():
    vectors = np.ones((50, 4))
    vectors[:, 0] = np.arange(50)
    vectors[3, 1], vectors[4, 1] = np.nan, -np.inf
    for scale in (1.0, 1e200, 1e-200):
        queries = np.array([[scale, 0, 0, 0], [0.0, 1.0, 0, 0]])
        add, result = V._topk_collector(2, True)[1](queries)
        add(np.arange(50), vectors)
        q, ids, _, _ = result()
        assert list(ids[q == 0]) == [49, 48] and list(ids[q == 1]) == [0, 1]


def test_queries_of_a_cell_are_read_from_bits(spark):
    mask = np.random.default_rng(4).random((40, 21)) < 0.3
    bits = C._bit_matrix(C._bit_rows(mask))
    assert bits.shape == (40, 3) and all(list(C._with_bit(bits, i)) == list(np.flatnonzero(mask[:, i])) for i in range(21))
