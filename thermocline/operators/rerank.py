"""Filters and re-ranking of retrieved candidates."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

# Boosted terms.
OCEAN_TERMS = ["temperature", "salinity", "pressure", "depth", "ocean", "water", "profile"]
MMR_LAMBDA = 0.7


def _comparable(data_type, value) -> bool:
    if isinstance(data_type, T.NumericType):
        return isinstance(value, (int, float))
    if isinstance(data_type, T.StringType):
        return isinstance(value, str)
    return value is not None


def metadata_predicate(df: DataFrame, filters: dict, prefix: str = "metadata") -> Column:
    """Conjunction over metadata keys: a scalar is equality, a list is membership, a dict holds
    inclusive ``min`` / ``max``. An unknown key, a null or an incomparable value excludes the row."""
    fields = {f.name: f for f in (df.schema[prefix].dataType if prefix else df.schema)}

    def test(key, wanted):
        if key not in fields:
            return F.lit(False)
        col = F.col(f"{prefix}.{key}" if prefix else key)
        kind = fields[key].dataType
        if isinstance(wanted, dict):
            bounds = {k: v for k, v in wanted.items() if k in ("min", "max")}
            if not all(_comparable(kind, v) for v in bounds.values()):
                return F.lit(False)
            checks = [col >= v if k == "min" else col <= v for k, v in bounds.items()]
            return reduce(lambda a, b: a & b, checks, F.lit(True))
        if isinstance(wanted, (list, tuple)):
            member = col.isin([v for v in wanted if v is not None and _comparable(kind, v)])
            return member | col.isNull() if None in wanted else member
        if wanted is None:
            return col.isNull()
        return col == F.lit(wanted) if _comparable(kind, wanted) else F.lit(False)

    return reduce(lambda a, b: a & b,
                  [F.coalesce(test(k, v), F.lit(False)) for k, v in filters.items()], F.lit(True))


def apply_threshold(results: DataFrame, score_threshold: float) -> DataFrame:
    if not 0 <= score_threshold <= 1:
        raise ValueError("score_threshold must be between 0 and 1")
    return results.filter(F.col("score") >= score_threshold)


def take_best(results: DataFrame, k: int, *order, by="query_id", rank="rank") -> DataFrame:
    """The first k rows per query, renumbered from one."""
    order = order or (F.col("score").desc(), F.col("chunk_id"))
    return (results.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order)))
            .filter(F.col(rank) <= k))


def chunk_similarity(a: str, b: str) -> Column:
    """Similarity of two aliased candidates by time, place and basin; 0 if a coordinate is unknown."""
    def both(name):
        return F.col(f"{a}.{name}"), F.col(f"{b}.{name}")

    (ts_a, ts_b), (lat_a, lat_b), (lon_a, lon_b), (basin_a, basin_b) = map(
        both, ("timestamp", "latitude", "longitude", "basin"))
    distance = F.sqrt((lat_a - lat_b) * (lat_a - lat_b) + (lon_a - lon_b) * (lon_a - lon_b))
    near = F.greatest(F.lit(0.0), 1 - distance / 10)
    total = F.least(F.lit(1.0), F.when(ts_a.eqNullSafe(ts_b), 0.4).otherwise(0.0) + 0.3 * near
                    + F.when(basin_a.eqNullSafe(basin_b), 0.3).otherwise(0.0))
    return F.when(distance.isNull(), 0.0).otherwise(total)


def pairwise_similarity(candidates: DataFrame) -> DataFrame:
    """Similarity of the candidates of one query to each other. Candidates per query are few:
    they are the output of a top-k search."""
    columns = ["query_id", "chunk_id", "timestamp", "latitude", "longitude", "basin"]
    a, b = candidates.select(columns).alias("a"), candidates.select(columns).alias("b")
    return (a.join(b, (F.col("a.query_id") == F.col("b.query_id"))
                   & (F.col("a.chunk_id") < F.col("b.chunk_id")))
            .select("a.query_id", F.col("a.chunk_id").alias("chunk_a"),
                    F.col("b.chunk_id").alias("chunk_b"), chunk_similarity("a", "b").alias("similarity")))


def mmr(candidates: DataFrame, k: int, lambda_param: float = MMR_LAMBDA) -> DataFrame:
    """Greedy diverse re-ranking per query.

    Each pick depends on the earlier ones, so a query's candidates (a bounded top-k result) are
    handled together; queries run in parallel. Needs query_id, chunk_id, score, rank, timestamp,
    latitude, longitude, basin. Adds ``mmr_rank``; k or fewer candidates keep their order.
    """
    schema = T.StructType([candidates.schema["query_id"], candidates.schema["chunk_id"],
                           T.StructField("mmr_rank", T.IntegerType())])

    def pick(group):
        import numpy as np
        group = group.sort_values("rank", kind="stable").reset_index(drop=True)
        n = len(group)
        if n <= k:
            chosen = list(range(n))
        else:
            place = group[["latitude", "longitude"]].to_numpy(float)
            score = group["score"].to_numpy(float)
            when, basin = group["timestamp"].to_numpy(), group["basin"].fillna(-1).to_numpy()
            chosen, closest = [0], np.zeros(n)
            free = np.ones(n, dtype=bool)
            free[0] = False
            while len(chosen) < k:
                last = chosen[-1]
                distance = np.sqrt(((place - place[last]) ** 2).sum(axis=1))
                similar = (0.4 * (when == when[last]) + 0.3 * np.maximum(0.0, 1 - distance / 10)
                           + 0.3 * (basin == basin[last]))
                # An unknown position makes a pair count as unlike.
                closest = np.maximum(closest, np.minimum(np.nan_to_num(similar), 1.0))
                value = np.where(free, lambda_param * score - (1 - lambda_param) * closest, -np.inf)
                best = int(np.argmax(value))
                free[best] = False
                chosen.append(best)
        out = group.loc[chosen, ["query_id", "chunk_id"]].copy()
        out["mmr_rank"] = np.arange(1, len(chosen) + 1, dtype=np.int32)
        return out

    needed = candidates.select("query_id", "chunk_id", "score", "rank", "timestamp",
                               "latitude", "longitude", "basin")
    return needed.groupBy("query_id").applyInPandas(pick, schema)


def hybrid_boost(query: Column, text: Column, measurements: Column) -> Column:
    """Extra score for ocean terms that query and text share, and for warm water when asked about."""
    asked, said = F.lower(query), F.lower(text)
    terms = reduce(lambda a, b: a + b,
                   [(asked.contains(t) & said.contains(t)).cast("int") for t in OCEAN_TERMS])
    warm = asked.contains("temperature") & F.coalesce(
        F.exists(measurements, lambda m: m["temperature_degc"] > 20), F.lit(False))
    return terms * 0.1 + F.when(warm, 0.05).otherwise(0.0)


def hybrid(candidates: DataFrame, k: int) -> DataFrame:
    """Boosted score capped at one, re-sorted; equal scores keep their old order."""
    boost = hybrid_boost(F.col("query"), F.col("text"), F.col("measurements"))
    boosted = candidates.withColumn("score", F.least(F.lit(1.0), F.col("score") + boost))
    return take_best(boosted, k, F.col("score").desc(), F.col("rank"), rank="hybrid_rank")
