"""Text or vector queries to ranked chunks, batched over all queries."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from thermocline.functions.rendering import measurement_phrase
from thermocline.operators import rerank
from thermocline.operators.cells import with_cells
from thermocline.operators.chunking import chunk_profiles, explode_measurements, with_preview
from thermocline.operators.embedding import encode, prepare
from thermocline.operators.sqlguard import guarded_sql
from thermocline.operators.vectors import exact_topk, validate_k
from thermocline.schema import VECTOR_DIMENSION
from thermocline.session import durable

STRATEGIES = ("similarity", "mmr", "hybrid")
BROADCAST_RESULTS = 200_000


INDEX_KINDS = ("exact", "cells")


def build_index(profiles: DataFrame, encoder=None, dimension: int = VECTOR_DIMENSION, kind: str = "exact",
                cells: int = None, **chunking) -> DataFrame:
    """Profiles to chunks with text and vector, ready for ``write_index``; with kind "cells" each
    also has the cell it is stored and searched by."""
    if kind not in INDEX_KINDS:
        raise ValueError(f"kind must be one of {INDEX_KINDS}")
    rows = encode(prepare(chunk_profiles(profiles, **chunking)), encoder=encoder, dimension=dimension)
    return with_cells(rows, cells) if kind == "cells" else rows


def text_queries(spark: SparkSession, texts, encoder=None, dimension: int = VECTOR_DIMENSION) -> DataFrame:
    """Query texts, a list or a DataFrame of (query_id, query), with their vectors.

    A query without text is refused: at once in a list, when it is read in a DataFrame.
    """
    if not isinstance(texts, DataFrame):
        if any(not (t or "").strip() for t in texts):
            raise ValueError("a query has no text")
        texts = spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")
    texts = texts.withColumn("query", F.when(F.trim("query") != "", F.col("query"))
                             .otherwise(F.raise_error(F.lit("a query has no text"))))
    return encode(texts, "query", "query_vector", encoder, dimension)


def profile_queries(profiles: DataFrame, encoder=None, dimension: int = VECTOR_DIMENSION,
                    measurements="measurements") -> DataFrame:
    """Reference profiles as queries, through a sentence made of their first measurements."""
    texts = profiles.withColumn("query", measurement_phrase(F.col(measurements)))
    return encode(texts, "query", "query_vector", encoder, dimension)


def candidates(index: DataFrame, queries: DataFrame, k: int, metadata_filters: dict = None,
               score_threshold: float = None, filter_mode: str = "post",
               search=exact_topk) -> DataFrame:
    """The 2k best chunks per query that pass the filters, with text, score and original rank.

    "post" filters what the search found and may return fewer than k; "pre" searches only chunks
    that pass, so that the filter reaches the index scan.
    """
    validate_k(k, score_threshold)
    # Read by the search, to count them and beside the results; what made them may be a whole table.
    queries = durable(queries)
    if metadata_filters and filter_mode == "pre":
        index = index.filter(rerank.metadata_predicate(index, metadata_filters))
    found = search(index, queries, 2 * k)
    query_columns = [c for c in ("query_id", "query") if c in queries.columns]
    keys = [c for c in ("cell", "chunk_id") if c in found.columns and c in index.columns]
    found = found.select("query_id", *keys, "score", "rank")
    rows = index.drop("embedding", "text").join(_few(found, queries, 2 * k), keys)
    rows = with_preview(rows).join(queries.select(query_columns), "query_id")
    if metadata_filters and filter_mode == "post":
        rows = rows.filter(rerank.metadata_predicate(rows, metadata_filters))
    if score_threshold is not None:
        rows = rerank.apply_threshold(rows, score_threshold)
    return rows


def _few(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Top-k results are broadcast to the index, not the index shuffled, when they are few enough."""
    limit = max(1, BROADCAST_RESULTS // k)
    return F.broadcast(found) if queries.limit(limit + 1).count() <= limit else found


def retrieve(index: DataFrame, queries: DataFrame, k: int = 5, *, strategy: str = "similarity",
             metadata_filters: dict = None, score_threshold: float = None,
             filter_mode: str = "post", search=exact_topk) -> DataFrame:
    """The k best chunks per query. ``queries`` has query_id, query and query_vector.

    Adds score, rank (in the final order), search_rank, strategy.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    rows = candidates(index, queries, k, metadata_filters, score_threshold, filter_mode, search)
    if strategy == "hybrid":
        rows = rerank.hybrid(rows, k).withColumns(
            {"search_rank": F.col("rank"), "rank": F.col("hybrid_rank")}).drop("hybrid_rank")
    elif strategy == "mmr":
        flat = rows.withColumns({c: F.col(f"metadata.{c}") for c in ("latitude", "longitude", "basin")})
        order = rerank.mmr(flat, k)
        rows = (rows.withColumnRenamed("rank", "search_rank").join(order, ["query_id", "chunk_id"])
                .filter(F.col("mmr_rank") <= k).withColumnRenamed("mmr_rank", "rank"))
    else:
        rows = rows.withColumn("search_rank", F.col("rank"))
        rows = rerank.take_best(rows, k, F.col("search_rank"))
    return rows.withColumn("strategy", F.lit(strategy))


def plot_source(spark: SparkSession, request: str, index: DataFrame = None, encoder=None,
                dimension: int = VECTOR_DIMENSION, k: int = 20, cap: int = None) -> DataFrame:
    """Rows for a plot: all of a SELECT through the guard, or the readings of the k best chunks of a search."""
    if request.strip().lower().startswith("select"):
        return guarded_sql(spark, request, cap)
    if index is None:
        raise ValueError("a search request needs an index")
    found = retrieve(index, text_queries(spark, [request], encoder, dimension), k=k)
    return explode_measurements(found)
