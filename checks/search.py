"""Embedding, vector search, filters and re-ranking."""

from pyspark.sql import functions as F

from checks.chunks import SQL_CHUNKS, chunks
from checks.fixture import centroids, table
from checks.registry import query
from thermocline.functions.rendering import measurement_phrase
from thermocline.operators import rerank, stats
from thermocline.operators import vectors as V
from thermocline.operators.cells import cell_search, cell_topk, probes_for_recall, with_cells
from thermocline.operators.chunking import explode_measurements
from thermocline.operators.embedding import encode, prepare
from thermocline.plans import retrieval as R
from thermocline.sources import index as index_files
from thermocline.sources.index import check_index
from thermocline.session import scratch_path

K = 5
CELLS = 8
_STORED = {}

# Queries as in fixture.centroids: the direction of every label's mean vector.
SQL_QUERIES = """means AS (SELECT label, i, avg(CAST(x AS double)) AS x FROM (SELECT label, unnest(embedding) AS x,
unnest(range(len(embedding))) AS i FROM embeddings) u GROUP BY label, i),
lengths AS (SELECT label AS l, sqrt(sum(x * x)) AS norm FROM means GROUP BY label),
queries AS (SELECT label AS query_id, list(x / norm ORDER BY i) AS query_vector, CASE WHEN label % 3 = 0 THEN 'Warm water: temperature of each profile'
WHEN label % 3 = 1 THEN 'Salinity and pressure at depth' ELSE 'Anything from the Arctic' END AS query FROM means JOIN lengths ON l = label GROUP BY label),
vectors AS (SELECT vec_id, CAST(embedding AS double[]) AS v, label FROM embeddings)"""
SQL_INDEX = """idx AS (SELECT c.*, e.vec_id, CAST(e.embedding AS double[]) AS v, e.label FROM chunks c JOIN embeddings e ON c.chunk_number % (SELECT count(*) FROM embeddings) = e.vec_id)"""


def _ranked(score, order, limit, source="vectors", key="vec_id", where="", extra=""):
    return (f"SELECT query_id, {key}{extra}, score, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, {key}) AS r "
            f"FROM (SELECT q.query_id, q.query, x.*, {score} AS score FROM queries q CROSS JOIN {source} x) s {where} "
            f"QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score {order}, {key}) <= {limit}")


_IP = "list_inner_product(x.v, q.query_vector)"
_L2 = "list_sum(list_transform(list_zip(x.v, q.query_vector), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
_VISIBLE = "SELECT query_id, {key}, round(score, 6) AS score, CAST(r AS int) AS rank FROM"


def _embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def _search(spark, sf_dir, k=K, metric="ip", **options):
    return V.exact_topk(_embeddings(spark, sf_dir), centroids(spark, sf_dir), k, metric, id_col="vec_id", **options)


def _shown(df):
    return df.withColumn("score", F.round("score", 6))


def index(spark, sf_dir):
    """All chunks, each with one of the given vectors in turn by number; stored once per session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        given = _embeddings(spark, sf_dir)
        vectors = given.select(F.col("vec_id").alias("turn"), "embedding", "label")
        path = scratch_path(spark, "index")
        (chunks(spark, sf_dir).withColumn("turn", F.col("chunk_number") % F.lit(given.count())).join(vectors, "turn")
         .drop("turn").write.parquet(path))
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


@query("v_prepare", f"""WITH {SQL_CHUNKS} SELECT chunk_id, timestamp_text, source, chunk_type,
CAST(len(ms) AS int) AS measurement_count, text FROM chunks""")
def _(spark, sf_dir):
    return prepare(chunks(spark, sf_dir)).select(
        "chunk_id", F.col("timestamp").alias("timestamp_text"), "source", "chunk_type", "measurement_count", "text")


@query("v_embed")
def _(spark, sf_dir):
    """Documents hashed to 384-dimensional unit vectors."""
    found = encode(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("embedding").alias("dimension"),
                        F.round(V.dot(F.col("embedding"), F.col("embedding")), 4).alias("squared_norm"))


@query("v_knn_ip", f"WITH {SQL_QUERIES} {_VISIBLE.format(key='vec_id')} ({_ranked(_IP, 'DESC', K)}) z")
def _(spark, sf_dir):
    return _shown(_search(spark, sf_dir))


@query("v_knn_l2", f"WITH {SQL_QUERIES} {_VISIBLE.format(key='vec_id')} ({_ranked(_L2, 'ASC', K)}) z")
def _(spark, sf_dir):
    return _shown(_search(spark, sf_dir, metric="l2"))


_SELF = "queries AS (SELECT vec_id AS query_id, CAST(embedding AS double[]) AS query_vector, '' AS query FROM embeddings), vectors AS (SELECT vec_id, CAST(embedding AS double[]) AS v FROM embeddings)"


def _self_queries(spark, sf_dir):
    return _embeddings(spark, sf_dir).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query("v_batch_knn", f"WITH {_SELF} {_VISIBLE.format(key='vec_id')} ({_ranked(_IP, 'DESC', K)}) z")
def _(spark, sf_dir):
    """Every vector searched with every vector."""
    return _shown(V.exact_topk(_embeddings(spark, sf_dir), _self_queries(spark, sf_dir), K, id_col="vec_id"))


@query("v_batch_knn_blocks", f"WITH {_SELF} {_VISIBLE.format(key='vec_id')} ({_ranked(_IP, 'DESC', K)}) z")
def _(spark, sf_dir):
    """The same in blocks of 256 queries, as for more queries than may be broadcast at once."""
    return _shown(V.exact_topk(_embeddings(spark, sf_dir), _self_queries(spark, sf_dir), K, id_col="vec_id",
                               broadcast_bytes=1 << 17))


@query("v_threshold", f"""WITH {SQL_QUERIES} {_VISIBLE.format(key='vec_id')} ({_ranked(_IP, 'DESC', 20)}) z WHERE score >= 0.3""")
def _(spark, sf_dir):
    return _shown(rerank.apply_threshold(_search(spark, sf_dir, 20), 0.3))


_FILTERS = {"basin": [1, 2, 3], "latitude": {"min": -60, "max": 60}}
_PASSES = "basin IN (1, 2, 3) AND latitude BETWEEN -60 AND 60"
_POST = f"""found AS ({_ranked(_IP, 'DESC', 2 * K, 'idx', 'chunk_id', extra=', basin, latitude')}),
kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank_now FROM found WHERE {_PASSES})"""


def _retrieved(df):
    return _shown(df).select("query_id", "chunk_id", "score", "rank", "search_rank")


@query("v_prefilter", f"""WITH {SQL_CHUNKS}, {SQL_QUERIES}, {SQL_INDEX}, {_POST} SELECT query_id, chunk_id,
round(score, 6) AS score, CAST(rank_now AS int) AS rank, CAST(r AS int) AS search_rank FROM kept WHERE rank_now <= {K}""")
def _(spark, sf_dir):
    return _retrieved(R.retrieve(index(spark, sf_dir), centroids(spark, sf_dir), K, metadata_filters=_FILTERS))


@query("v_prefilter_pre", f"""WITH {SQL_CHUNKS}, {SQL_QUERIES}, {SQL_INDEX} SELECT query_id, chunk_id, round(score, 6) AS score,
CAST(r AS int) AS rank, CAST(r AS int) AS search_rank FROM ({_ranked(_IP, 'DESC', K, 'idx', 'chunk_id', f'WHERE {_PASSES}')}) z""")
def _(spark, sf_dir):
    return _retrieved(R.retrieve(index(spark, sf_dir), centroids(spark, sf_dir), K, metadata_filters=_FILTERS,
                                 filter_mode="pre"))


@query("f_metadata", f"""WITH {SQL_CHUNKS} SELECT chunk_id, basin, latitude, scheme AS vertical_sampling_scheme FROM chunks
WHERE {_PASSES} AND scheme = 'Primary sampling'""")
def _(spark, sf_dir):
    rows = chunks(spark, sf_dir)
    filters = {**_FILTERS, "vertical_sampling_scheme": "Primary sampling"}
    return rows.filter(rerank.metadata_predicate(rows, filters)).select(
        "chunk_id", "metadata.basin", "metadata.latitude", "metadata.vertical_sampling_scheme")


_SIM = ("least(1e0, CASE WHEN {a}.timestamp_text IS NOT DISTINCT FROM {b}.timestamp_text THEN 0.4e0 ELSE 0e0 END + 0.3e0 * greatest(0e0, 1 - "
        "sqrt(({a}.latitude - {b}.latitude) * ({a}.latitude - {b}.latitude) + ({a}.longitude - {b}.longitude) * ({a}.longitude - {b}.longitude)) / 10) "
        "+ CASE WHEN {a}.basin IS NOT DISTINCT FROM {b}.basin THEN 0.3e0 ELSE 0e0 END)")
_PLACES = ", basin, latitude, longitude, timestamp_text"
_CANDIDATES = f"cand AS ({_ranked(_IP, 'DESC', 2 * K, 'idx', 'chunk_id', extra=_PLACES)})"


def _candidates(spark, sf_dir):
    rows = R.candidates(index(spark, sf_dir), centroids(spark, sf_dir), K)
    return rows.withColumns({c: F.col(f"metadata.{c}") for c in ("latitude", "longitude", "basin")})


@query("v_chunk_similarity", f"""WITH {SQL_CHUNKS}, {SQL_QUERIES}, {SQL_INDEX}, {_CANDIDATES}
SELECT a.query_id, a.chunk_id AS chunk_a, b.chunk_id AS chunk_b, round({_SIM.format(a='a', b='b')}, 6) AS similarity
FROM cand a JOIN cand b ON a.query_id = b.query_id AND a.chunk_id < b.chunk_id""")
def _(spark, sf_dir):
    return rerank.pairwise_similarity(_candidates(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


def _mmr_sql():
    steps = ["m1 AS (SELECT *, 1 AS pick FROM cand WHERE r = 1)"]
    for i in range(2, K + 1):
        steps.append(
            f"m{i} AS (SELECT * FROM m{i - 1} UNION ALL SELECT * EXCLUDE (v), {i} AS pick FROM ("
            f"SELECT c.*, 0.7e0 * c.score - (1 - 0.7e0) * (SELECT max({_SIM.format(a='c', b='m')}) FROM m{i - 1} m WHERE m.query_id = c.query_id) AS v "
            f"FROM cand c WHERE NOT EXISTS (SELECT 1 FROM m{i - 1} m WHERE m.query_id = c.query_id AND m.chunk_id = c.chunk_id)) o "
            f"QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY v DESC, r) = 1)")
    return ", ".join(steps)


@query("v_mmr", f"""WITH {SQL_CHUNKS}, {SQL_QUERIES}, {SQL_INDEX}, {_CANDIDATES}, {_mmr_sql()}
SELECT query_id, chunk_id, round(score, 6) AS score, CAST(pick AS int) AS rank, CAST(r AS int) AS search_rank FROM m{K}""")
def _(spark, sf_dir):
    return _retrieved(R.retrieve(index(spark, sf_dir), centroids(spark, sf_dir), K, strategy="mmr"))


_BOOST = " + ".join(f"CASE WHEN contains(lower(query), '{t}') AND contains(lower(preview), '{t}') THEN 1 ELSE 0 END" for t in rerank.OCEAN_TERMS)
_HYBRID = f"""cand AS ({_ranked(_IP, 'DESC', 2 * K, 'idx', 'chunk_id', extra=', query, preview, ms')}),
boosted AS (SELECT query_id, chunk_id, r, least(1e0, score + ({_BOOST}) * 0.1e0 + CASE WHEN contains(lower(query), 'temperature')
AND len(list_filter(ms, lambda m: m.t > 20)) > 0 THEN 0.05e0 ELSE 0e0 END) AS score FROM cand)"""


@query("v_hybrid", f"""WITH {SQL_CHUNKS}, {SQL_QUERIES}, {SQL_INDEX}, {_HYBRID}
SELECT query_id, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r) AS int) AS rank,
CAST(r AS int) AS search_rank FROM boosted QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r) <= {K}""")
def _(spark, sf_dir):
    return _retrieved(R.retrieve(index(spark, sf_dir), centroids(spark, sf_dir), K, strategy="hybrid"))


def _cells(spark, sf_dir):
    rows = _embeddings(spark, sf_dir).select("vec_id", "embedding")
    centres = V.train_cells(rows, CELLS)
    return V.assign_cells(rows, centres), centres


@query("v_knn_approx")
def _(spark, sf_dir):
    """Share of the exact answers found when probing half of the cells."""
    cells, centres = _cells(spark, sf_dir)
    found = V.approximate_topk(cells, centroids(spark, sf_dir), K, centres=centres, probes=CELLS // 2, id_col="vec_id")
    return V.recall(found, _search(spark, sf_dir, metric="l2"), id_col="vec_id")


@query("v_knn_approx_all_cells", f"WITH {SQL_QUERIES} {_VISIBLE.format(key='vec_id')} ({_ranked(_L2, 'ASC', K)}) z")
def _(spark, sf_dir):
    """Probing every cell is the exact answer."""
    cells, centres = _cells(spark, sf_dir)
    return _shown(V.approximate_topk(cells, centroids(spark, sf_dir), K, centres=centres, probes=CELLS,
                                     id_col="vec_id", per_shard=100))


def stored_cells(spark, sf_dir):
    """All chunks with their vectors in an index of cells, written once per session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, "cells")
    if key not in _STORED:
        path = scratch_path(spark, "index")
        index_files.write_index(with_cells(index(spark, sf_dir), CELLS), path, model="given", cell_rows=200)
        _STORED[key] = path
    return index_files.load_index(spark, _STORED[key]), index_files.load_cells(spark, _STORED[key])


@query("v_index_cells", f"""WITH {SQL_CHUNKS}, {SQL_QUERIES}, {SQL_INDEX} SELECT query_id, chunk_id, round(score, 6) AS score,
CAST(r AS int) AS rank, CAST(r AS int) AS search_rank FROM ({_ranked(_IP, 'DESC', K, 'idx', 'chunk_id')}) z""")
def _(spark, sf_dir):
    """Retrieval from a stored index of cells: all cells probed are the exact answer."""
    rows, cells = stored_cells(spark, sf_dir)
    return _retrieved(R.retrieve(rows, centroids(spark, sf_dir), K, search=cell_search(cells, CELLS)))


@query("v_index_cells_recall", "SELECT CAST(count(DISTINCT label) AS bigint) AS queries, 1 AS recall_ok FROM embeddings")
def _(spark, sf_dir):
    """A search with audited probes finds nine tenths of the exact answers, over all queries."""
    rows, cells = stored_cells(spark, sf_dir)
    queries = centroids(spark, sf_dir)
    found = cell_topk(rows, queries, K, cells=cells, probes=probes_for_recall(rows, queries, K, cells=cells))
    shares = V.recall(found, V.exact_topk(rows, queries, K))
    return shares.agg(F.count(F.lit(1)).alias("queries"),
                      (F.round(F.avg("recall"), 9) >= 0.9).cast("int").alias("recall_ok"))


@query("v_knn_pruned", f"""WITH {SQL_CHUNKS}, {SQL_QUERIES}, {SQL_INDEX} SELECT query_id, chunk_id, round(score, 6) AS score,
CAST(r AS int) AS rank FROM ({_ranked(_L2, 'ASC', K, 'idx', 'chunk_id')}) z""")
def _(spark, sf_dir):
    """The exact answer from the cells that can hold it."""
    rows, cells = stored_cells(spark, sf_dir)
    found = cell_topk(rows, centroids(spark, sf_dir), K, "l2", cells=cells, probes=1, exact=True)
    return _shown(found.drop("cell"))


@query("v_batch_knn_pruned", f"WITH {_SELF} {_VISIBLE.format(key='vec_id')} ({_ranked(_IP, 'DESC', K)}) z")
def _(spark, sf_dir):
    """Every vector searched with every vector, without cells that cannot hold an answer."""
    path = scratch_path(spark, "index")
    index_files.write_index(with_cells(_embeddings(spark, sf_dir), id_col="vec_id"), path, id_col="vec_id")
    found = cell_topk(index_files.load_index(spark, path), _self_queries(spark, sf_dir), K,
                      cells=index_files.load_cells(spark, path), probes=2, exact=True, id_col="vec_id")
    return _shown(found.drop("cell"))


@query("v_profile_phrase", f"""WITH {SQL_CHUNKS} SELECT chunk_id, 'Oceanographic profile with measurements: ' || array_to_string(list_transform(ms[1:5],
lambda m: printf('Depth %.1fm: temperature %.2f°C, salinity %.2f', m.p, m.t, m.s)), '; ') AS query FROM chunks""")
def _(spark, sf_dir):
    """The sentence that stands for a reference profile in a search."""
    return chunks(spark, sf_dir).select("chunk_id", measurement_phrase(F.col("measurements")).alias("query"))


@query("v_profile_similarity")
def _(spark, sf_dir):
    """For the deepest chunk of each basin, the chunks most like it."""
    path = scratch_path(spark, "chunks")
    chunks(spark, sf_dir).write.parquet(path)
    rows = spark.read.parquet(path)
    deepest = rows.groupBy("metadata.basin").agg(F.max_by("measurements", F.struct(
        F.element_at("measurements", -1)["pressure_decibar"], "chunk_id")).alias("measurements"))
    queries = R.profile_queries(deepest.withColumnRenamed("basin", "query_id"))
    return _retrieved(R.retrieve(encode(prepare(rows)), queries, K))


@query("v_index_stats", f"""WITH {SQL_CHUNKS}, {SQL_INDEX}
SELECT 'total' AS kind, 'total_vectors' AS key, CAST(count(*) AS string) AS value FROM idx
UNION ALL SELECT 'total', 'vector_dimension', CAST(max(len(v)) AS string) FROM idx
UNION ALL SELECT 'total', 'total_measurements', CAST(sum(len(ms)) AS string) FROM idx
UNION ALL SELECT 'total', 'earliest', min(timestamp_text) FROM idx
UNION ALL SELECT 'total', 'latest', max(timestamp_text) FROM idx
UNION ALL SELECT 'total', 'distinct_timestamps', CAST(count(DISTINCT timestamp_text) AS string) FROM idx
UNION ALL SELECT 'source', source, CAST(count(*) AS string) FROM idx GROUP BY source
UNION ALL SELECT 'chunk_type', chunk_type, CAST(count(*) AS string) FROM idx GROUP BY chunk_type
UNION ALL SELECT 'basin', CAST(basin AS string), CAST(count(*) AS string) FROM idx GROUP BY basin""")
def _(spark, sf_dir):
    return stats.index_statistics(index(spark, sf_dir))


@query("v_index_check", f"""WITH {SQL_CHUNKS} SELECT (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM chunks) AS metadata_entries,
(SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT chunk_number FROM chunks)) AS vectors_unmatched,
(SELECT count(*) FROM chunks WHERE chunk_number NOT IN (SELECT vec_id FROM embeddings)) AS metadata_unmatched,
CASE WHEN (SELECT count(*) FROM embeddings) = (SELECT count(*) FROM chunks) THEN 1 ELSE 0 END AS consistent""")
def _(spark, sf_dir):
    return check_index(_embeddings(spark, sf_dir), chunks(spark, sf_dir), vector_key="vec_id",
                       metadata_key="chunk_number")


# Statistics of retrieved chunks.
_FOUND = f"found AS ({_ranked(_IP, 'DESC', 20, 'idx', 'chunk_id', extra=', basin, latitude, longitude, ts, ms, scheme, cycle_number, source, chunk_type, preview, query')})"
_RESULTS = f"WITH {SQL_CHUNKS}, {SQL_QUERIES}, {SQL_INDEX}, {_FOUND}"


def results(spark, sf_dir):
    return R.retrieve(index(spark, sf_dir), centroids(spark, sf_dir), 20)


@query("r_score_summary", f"""{_RESULTS} SELECT query_id, count(*) AS total_chunks, round(avg(score), 4) AS average_score,
round(min(score), 4) AS min_score, round(max(score), 4) AS max_score,
round(list_sort(list(score))[count(*) // 2 + 1], 4) AS median_score FROM found GROUP BY query_id""")
def _(spark, sf_dir):
    return stats.score_summary(results(spark, sf_dir))


@query("r_score_bins", f"""{_RESULTS}, labels_all AS (SELECT unnest(['0.0-0.2', '0.2-0.4', '0.4-0.6', '0.6-0.8', '0.8-1.0']) AS label)
SELECT l.label, count(f.label2) AS n FROM labels_all l LEFT JOIN (SELECT CASE WHEN score < 0.2 THEN '0.0-0.2' WHEN score < 0.4 THEN '0.2-0.4'
WHEN score < 0.6 THEN '0.4-0.6' WHEN score < 0.8 THEN '0.6-0.8' ELSE '0.8-1.0' END AS label2 FROM found) f ON f.label2 = l.label GROUP BY l.label""")
def _(spark, sf_dir):
    return stats.score_distribution(results(spark, sf_dir))


@query("r_lat_bands", f"""WITH {SQL_CHUNKS} SELECT label, (SELECT count(*) FROM chunks WHERE CASE WHEN latitude > 30 THEN 1 WHEN latitude < -30 THEN 3 ELSE 2 END = band) AS n
FROM (VALUES (1, 'North (>30°)'), (2, 'Tropical (30°S-30°N)'), (3, 'South (<-30°)')) AS b(band, label)""")
def _(spark, sf_dir):
    return stats.latitude_distribution(chunks(spark, sf_dir), "metadata.latitude")


@query("r_basin_counts", f"{_RESULTS} SELECT 'Basin ' || basin AS label, count(*) AS n FROM found GROUP BY basin")
def _(spark, sf_dir):
    return stats.basin_distribution(results(spark, sf_dir), "metadata.basin")


@query("r_year_counts", f"WITH {SQL_CHUNKS} SELECT CAST(year(ts) AS int) AS year, count(*) AS n FROM chunks GROUP BY 1")
def _(spark, sf_dir):
    return stats.year_distribution(chunks(spark, sf_dir))


@query("r_format_results", f"""{_RESULTS} SELECT query_id, chunk_id, preview AS text, round(score, 4) AS score, latitude, longitude, basin, cycle_number,
scheme AS vertical_sampling_scheme, CAST(len(ms) AS int) AS measurement_count, source, chunk_type, query, CAST(r AS int) AS rank,
'similarity' AS strategy, round(list_max(list_transform(ms, lambda m: m.p)), 1) AS deepest FROM found""")
def _(spark, sf_dir):
    found = results(spark, sf_dir)
    return stats.format_results(found, "query_id").select(
        "query_id", "chunk_id", "text", "score", "metadata.location.latitude", "metadata.location.longitude", "metadata.basin",
        "metadata.cycle_number", "metadata.vertical_sampling_scheme", "metadata.measurement_count", "source",
        "chunk_type", "retrieval_context.query", "retrieval_context.rank", "retrieval_context.strategy",
        F.col("measurements_summary.depth_range.max").alias("deepest"))


# Halves round up on the decimal text of the number, as a product by ten would not.
_HALF_UP = "CAST(CAST(CAST({} AS string) AS decimal(18, {})) AS double)"
_SPAN = ", ".join(
    f"round(list_{f}(list_transform(ms, lambda m: m.{c})), {d}) AS {n}_{f}"
    for c, n, d in (("p", "depth", 1), ("t", "temperature", 3), ("s", "salinity", 3)) for f in ("min", "max"))


_MEANS = ", ".join(
    _HALF_UP.format(f"list_reduce(list_transform(ms, lambda m: m.{c}), lambda a, b: a + b) / len(ms)", d) + f" AS {n}_mean"
    for c, n, d in (("p", "depth", 1), ("t", "temperature", 3), ("s", "salinity", 3)))


@query("r_measure_summary", f"WITH {SQL_CHUNKS} SELECT chunk_id, CAST(len(ms) AS int) AS n, {_SPAN}, {_MEANS} FROM chunks")
def _(spark, sf_dir):
    s = stats.measurement_summary(F.col("measurements"))
    rows = chunks(spark, sf_dir).select("chunk_id", s.alias("s"))
    return rows.select("chunk_id", F.col("s.count").alias("n"), *[
        F.col(f"s.{n}_range.{f}").alias(f"{n}_{f}") for n in ("depth", "temperature", "salinity") for f in ("min", "max", "mean")])


@query("p_source", f"""{_RESULTS}, top AS (SELECT * FROM found), readings AS (SELECT query_id, chunk_id, unnest(ms) AS m FROM top)
SELECT chunk_id, m.p AS pressure_decibar, m.t AS temperature_degc, m.s AS salinity_psu FROM readings""")
def _(spark, sf_dir):
    """Search results as flat rows for a plot."""
    return explode_measurements(results(spark, sf_dir)).select(
        "chunk_id", "pressure_decibar", "temperature_degc", "salinity_psu")
