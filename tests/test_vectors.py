import numpy as np
import pytest
from pyspark.sql import functions as F

from thermocline.operators import vectors as V
from thermocline.operators.embedding import encode


def _frame(spark, matrix, id_name, vector_name, ids=None):
    ids = ids or [f"c{i:03d}" for i in range(len(matrix))]
    rows = [(i, [float(x) for x in v]) for i, v in zip(ids, matrix)]
    kind = "string" if isinstance(ids[0], str) else "int"
    return spark.createDataFrame(rows, f"{id_name} {kind}, {vector_name} array<float>")


def _brute(vectors, queries, k, metric):
    v, q = vectors.astype(np.float32).astype(float), queries.astype(np.float32).astype(float)
    out = set()
    for i, x in enumerate(q):
        s = v @ x if metric == "ip" else ((v - x) ** 2).sum(1)
        order = sorted(range(len(v)), key=lambda j: (-round(s[j], 12) if metric == "ip" else round(s[j], 12), j))[:k]
        out |= {(i, f"c{j:03d}", r) for r, j in enumerate(order, 1)}
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(120, 6))
    vectors[50:70] = vectors[7]  # copies: ties are settled by id
    return vectors, rng.normal(size=(9, 6))


def _found(df):
    return {(r.query_id, r.chunk_id, r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("metric", ["ip", "l2"])
@pytest.mark.parametrize("k", [1, 5, 200])
@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 1])
def test_exact_matches_brute_force(spark, data, metric, k, broadcast_bytes):
    vectors, queries = data
    index = _frame(spark, vectors, "chunk_id", "embedding").repartition(5)
    q = _frame(spark, queries, "query_id", "query_vector", list(range(9)))
    found = V.exact_topk(index, q, k, metric, broadcast_bytes=broadcast_bytes)
    assert _found(found) == _brute(vectors, queries, k, metric)


def test_vector_equal_to_a_tie_keeps_the_smallest_ids(spark, data):
    vectors, _ = data
    index = _frame(spark, vectors, "chunk_id", "embedding").repartition(7)
    q = _frame(spark, vectors[7:8], "query_id", "query_vector", [0])
    found = V.exact_topk(index, q, 4, "l2").orderBy("rank").collect()
    assert [r.chunk_id for r in found] == ["c007", "c050", "c051", "c052"]
    assert all(abs(r.score) < 1e-9 for r in found)


@pytest.mark.parametrize("size", [1e-7, 1.0, 1e7])
@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_ranking_does_not_depend_on_size(spark, size, metric):
    vectors = np.array([[3.0, 0.0], [1.0, 0.0], [1.0 + 2 ** -20, 0.0], [-2.0, 5.0]]) * size
    index = _frame(spark, vectors, "chunk_id", "embedding")
    q = _frame(spark, vectors[1:2], "query_id", "query_vector", [0])
    order = [r.chunk_id for r in V.exact_topk(index, q, 3, metric).orderBy("rank").collect()]
    assert order == (["c000", "c002", "c001"] if metric == "ip" else ["c001", "c002", "c000"])


def test_close_vectors_far_from_the_origin(spark):
    """Where |q|^2 + |v|^2 - 2qv has no correct digit left."""
    base = np.full((40, 8), 1e6)
    base[np.arange(40), np.arange(40) % 8] += np.arange(40)[::-1] * 0.0625
    index = _frame(spark, base, "chunk_id", "embedding").coalesce(1)
    q = _frame(spark, np.full((1, 8), 1e6), "query_id", "query_vector", [0])
    found = V.exact_topk(index, q, 3, "l2").orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in found] == [("c039", 0.0), ("c038", 0.0625 ** 2), ("c037", 0.125 ** 2)]


@pytest.mark.parametrize("vectors", [[[1.0, 2.0, 3.0], [1.0] * 5], [[1.0] * 3], [[]]])
def test_other_dimensions_are_refused(spark, vectors):
    index = spark.createDataFrame([(str(i), v) for i, v in enumerate(vectors)], "chunk_id string, embedding array<float>").coalesce(1)
    q = _frame(spark, np.ones((1, 4)), "query_id", "query_vector", [0])
    with pytest.raises(Exception, match="dimension|elements"):
        V.exact_topk(index, q, 1).collect()
    with pytest.raises(Exception, match="elements"):
        V.assign_cells(index, np.ones((2, 4))).collect()


def test_merging_by_groups_of_tasks(spark, data, monkeypatch):
    monkeypatch.setattr(V, "MERGED_TASKS", 2)
    vectors, queries = data
    index = _frame(spark, vectors, "chunk_id", "embedding").repartition(7)
    q = _frame(spark, queries, "query_id", "query_vector", list(range(9)))
    assert _found(V.exact_topk(index, q, 4, "l2")) == _brute(vectors, queries, 4, "l2")


def test_the_index_is_not_shuffled(spark, data):
    vectors, queries = data
    index = _frame(spark, vectors, "chunk_id", "embedding")
    q = _frame(spark, queries, "query_id", "query_vector", list(range(9)))
    plan = V.exact_topk(index, q, 4)._jdf.queryExecution().sparkPlan().toString()
    below = plan[plan.index("MapInArrow"):]
    assert "Exchange" not in below and "Join" not in below


def test_batch_equals_one_at_a_time(spark, data):
    vectors, queries = data
    index = _frame(spark, vectors, "chunk_id", "embedding")
    batch = _found(V.exact_topk(index, _frame(spark, queries[:3], "query_id", "query_vector", [0, 1, 2]), 4))
    single = set()
    for i in range(3):
        single |= _found(V.exact_topk(index, _frame(spark, queries[i:i + 1], "query_id", "query_vector", [i]), 4))
    assert batch == single


def test_many_small_merges(spark, data):
    """More queries than fit one slice, in tiny Arrow batches."""
    vectors, queries = data
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        index = _frame(spark, vectors, "chunk_id", "embedding").coalesce(1)
        q = _frame(spark, queries, "query_id", "query_vector", list(range(9)))
        assert _found(V.exact_topk(index, q, 2)) == _brute(vectors, queries, 2, "ip")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_queries_and_no_vectors(spark, data):
    vectors, queries = data
    index = _frame(spark, vectors, "chunk_id", "embedding")
    q = _frame(spark, queries, "query_id", "query_vector", list(range(9)))
    assert V.exact_topk(index, q.limit(0), 3).count() == 0
    assert V.exact_topk(index.limit(0), q, 3).count() == 0


@pytest.mark.parametrize("k, threshold", [(0, None), (-1, None), (3, 1.5), (3, -0.1)])
def test_arguments(k, threshold):
    with pytest.raises(ValueError):
        V.validate_k(k, threshold)


@pytest.mark.parametrize("per_shard, per_block", [(1000, 1000), (10, 2)])
def test_all_cells_probed_is_exact(spark, data, monkeypatch, per_shard, per_block):
    vectors, queries = data
    monkeypatch.setattr(V, "QUERIES_PER_BLOCK", per_block)
    index = _frame(spark, vectors, "chunk_id", "embedding")
    q = _frame(spark, queries, "query_id", "query_vector", list(range(9)))
    centres = V.train_cells(index, 5)
    cells = V.assign_cells(index, centres)
    found = V.approximate_topk(cells, q, 6, "l2", centres=centres, probes=5, per_shard=per_shard)
    assert _found(found) == _brute(vectors, queries, 6, "l2")


def test_few_cells_probed_finds_most(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(8, 10)) * 5
    vectors = np.vstack([c + rng.normal(size=(30, 10)) * 0.3 for c in centres])
    index = _frame(spark, vectors, "chunk_id", "embedding")
    q = _frame(spark, vectors[::24] + 0.01, "query_id", "query_vector", list(range(10)))
    trained = V.train_cells(index, 8)
    found = V.approximate_topk(V.assign_cells(index, trained), q, 5, "l2", centres=trained, probes=2)
    exact = V.exact_topk(index, q, 5, "l2")
    assert V.recall(found, exact).agg(F.avg("recall")).first()[0] > 0.9


def test_dot(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 0.5])], "a array<float>, b array<float>")
    assert df.select(V.dot(F.col("a"), F.col("b"))).first()[0] == 4.0


def test_hashed_encoder(spark):
    df = spark.createDataFrame([(1, "Salt water, deep"), (2, "deep salt WATER"), (3, "warm"), (4, ""), (5, None)], "id int, text string")
    rows = {r.id: np.array(r.embedding) for r in encode(df).collect()}
    assert all(len(v) == 384 for v in rows.values())
    assert np.allclose(rows[1], rows[2]) and np.isclose(np.linalg.norm(rows[1]), 1.0)
    assert rows[1] @ rows[3] < 0.9 and not rows[4].any() and not rows[5].any()


def test_caller_encoder_is_normalised_and_batched(spark):
    def factory():
        def model(texts):
            assert len(texts) <= 2
            return [[len(t), 1.0] for t in texts]
        return model

    df = spark.createDataFrame([(i, "x" * i) for i in range(5)], "id int, text string").coalesce(1)
    for r in encode(df, encoder=factory, dimension=2, batch_size=2).collect():
        want = np.array([r.id, 1.0]) / np.hypot(r.id, 1.0)
        assert np.allclose(r.embedding, want, atol=1e-6)


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_more_queries_than_may_be_broadcast_take_one_job(spark, monkeypatch, metric):
    """Blocks are no jobs of their own, whatever their number."""
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(rng.integers(-3, 4, (300, 4)))]
    index = spark.createDataFrame(vectors, "chunk_id long, embedding array<float>")
    queries = spark.createDataFrame(vectors + [(999, None)], "query_id long, query_vector array<float>")
    monkeypatch.setattr(V, "BLOCK_BYTES", 4 * 8 * 100)
    monkeypatch.setattr(V, "LEAST_SHARD", 50)
    found = V.exact_topk(index, queries, 3, metric, broadcast_bytes=4 * 8 * 7)
    assert "FlatMapCoGroups" in found._jdf.queryExecution().optimizedPlan().toString()
    whole = V.exact_topk(index, queries, 3, metric)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.select(found.columns).collect()))
