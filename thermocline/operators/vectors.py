"""Exact and cell-probing nearest-vector search, batched over many queries."""

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from thermocline.session import durable

# Queries travel to every task in blocks of up to this size.
BROADCAST_BYTES = 32 << 20
# Tasks whose results for a query are merged before all are.
MERGED_TASKS = 256
QUERIES_PER_BLOCK = 2048
VECTORS_PER_SHARD = 50_000
# Queries of one task when there are more than may be broadcast, and vectors that make another task worth while.
BLOCK_BYTES, LEAST_SHARD = 32 << 20, 500


def validate_k(k: int, score_threshold: float = None) -> None:
    if k <= 0:
        raise ValueError("k must be positive")
    if score_threshold is not None and not 0 <= score_threshold <= 1:
        raise ValueError("score_threshold must be between 0 and 1")


def _topk_collector(k: int, largest: bool):
    """Picklable helpers for tasks: a list column to a matrix, and a collector of the k best.

    ``collector(queries, cut)`` returns ``add(ids, vectors, mine, tag)`` and ``result()``; ``mine`` are the places of the
    queries to compare, ``tag`` a number that comes back with a result, ``cut`` what results must not be worse than (badness:
    a squared distance or a negative inner product). Products of tiles of queries and vectors, with an error bound, find the
    candidates that can beat a query's k-th best, which is carried from tile to tile; they are scored again one by one,
    without rounding. They are merged whenever they have grown to a few times the result, so memory stays bounded by
    k x queries.
    """
    import numpy as np

    def matrix(array):
        sizes = set(array.value_lengths().unique().to_pylist())
        if len(sizes) > 1 or sizes & {None, 0}:
            raise ValueError(f"vectors differ in dimension: {sorted(map(str, sizes))}")
        flat = array.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(array), -1).astype(np.float64)

    def collector(queries, cut=None):
        n, dimension = queries.shape
        cut = np.full(n, np.inf) if cut is None else np.array(cut, dtype=np.float64)
        held, size = [], 0
        tile = 1 << 20
        pairs = max(1, 2_000_000 // max(1, dimension))
        squares = (queries ** 2).sum(1)
        # Inner products are estimated in single precision, where no value is beyond its range.
        single = largest and n > 0 and squares.max() < 1e30

        def bounds(kind):
            """What a product of matrices may be off by, relative to the norms of what it multiplies."""
            return 8 * (dimension + 4) * np.finfo(kind).eps

        left = {}

        def of(kind):
            if kind not in left:
                left[kind] = (-queries if largest else queries).astype(kind)
            return left[kind]

        def estimate(rows, vectors, norms, kind):
            """Badness of all pairs by one product, and a bound of its error for each query."""
            dots = of(kind)[rows] @ vectors.astype(kind, copy=False).T
            longest = np.sqrt(norms.max())
            if largest:
                return dots, bounds(kind) * np.sqrt(squares[rows]) * longest + 1e-30
            return squares[rows][:, None] + norms[None, :] - 2 * dots, bounds(kind) * (np.sqrt(squares[rows]) + longest) ** 2

        def exact(q, vectors, r):
            """Badness of single pairs, each summed by itself, so that equal vectors tie in any batch."""
            out = np.empty(len(q))
            for at in range(0, len(q), pairs):
                a, b = queries[q[at:at + pairs]], vectors[r[at:at + pairs]]
                out[at:at + pairs] = -(a * b).sum(1) if largest else ((a - b) ** 2).sum(1)
            return out

        def merge():
            nonlocal held, size
            q, ids, bad, tags = (np.concatenate(parts) for parts in zip(*held))
            order = np.lexsort((ids, bad, q))
            q, ids, bad, tags = q[order], ids[order], bad[order], tags[order]
            place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
            cut[q[place == k - 1]] = bad[place == k - 1]
            top = place < k
            held, size = [(q[top], ids[top], bad[top], tags[top])], int(top.sum())

        def candidates(rows, part, norms, kind):
            """Places in ``rows`` and ``part`` of the pairs that may be among the best; None if too many to be worth it."""
            rough, error = estimate(rows, part, norms, kind)
            if len(part) > k:
                fresh = np.flatnonzero(np.isinf(cut[rows]))
                if len(fresh):
                    some = rough if len(fresh) == len(rough) else rough[fresh]
                    kth = np.partition(some, k - 1, axis=1)[:, k - 1].astype(np.float64)
                    # So many are at least as good; ties with the k-th stay in: they are settled by id.
                    cut[rows[fresh]] = np.minimum(cut[rows[fresh]], kth + error[fresh])
            limit = cut[rows] + error
            if kind == np.float32:
                limit = np.nextafter(np.minimum(limit, 3e38).astype(np.float32), np.float32(np.inf))
            hits = np.flatnonzero(rough <= limit[:, None])
            if kind == np.float32 and len(hits) > max(2 * k * len(rows), rough.size // 8):
                return None
            return np.divmod(hits, len(part))

        def hold(q, r, ids, vectors, tag):
            nonlocal size
            bad = exact(q, vectors, r)
            near = bad <= cut[q]
            if near.any():
                held.append((q[near], ids[r[near]], bad[near], np.full(int(near.sum()), tag)))
                size += int(near.sum())
            if size > 4 * k * n:
                merge()

        def add(ids, vectors, mine=None, tag=0):
            if vectors.shape[1] != dimension:
                raise ValueError(f"vectors of {vectors.shape[1]} elements, queries of {dimension}")
            mine = np.arange(n) if mine is None else mine
            if not len(mine) or not len(ids):
                return
            norms = (vectors ** 2).sum(1)
            odd = ~np.isfinite(norms)
            if odd.any():  # what is no number or endless has no estimate: compared one by one, away from the others
                add(ids[~odd], vectors[~odd], mine, tag)
                for at in np.flatnonzero(odd):
                    hold(mine, np.full(len(mine), at), ids, vectors, tag)
                return
            kind = np.float32 if single and norms.max() < 1e30 else np.float64
            quick = vectors.astype(kind, copy=False)
            step = max(1024, tile // len(mine))
            for at in range(0, len(ids), step):
                part, few = vectors[at:at + step], quick[at:at + step]
                for start in range(0, len(mine), max(1, tile // len(part))):
                    rows = mine[start:start + max(1, tile // len(part))]
                    found = candidates(rows, few, norms[at:at + step], kind)
                    if found is None:
                        found = candidates(rows, part, norms[at:at + step], np.float64)
                    hold(rows[found[0]], found[1], ids[at:at + step], part, tag)

        def result():
            if not held:
                return None
            merge()
            q, ids, bad, tags = held[0]
            return q, ids, (-bad if largest else bad) + 0.0, tags

        return add, result

    return matrix, collector


def _result_schema(queries, index, query_id, id_col):
    return (f"{query_id} {queries.schema[query_id].dataType.simpleString()}, "
            f"{id_col} {index.schema[id_col].dataType.simpleString()}, score double")


def _rank(found: DataFrame, query_id, id_col, k, largest) -> DataFrame:
    score = F.col("score").desc() if largest else F.col("score").asc()
    window = Window.partitionBy(query_id).orderBy(score, F.col(id_col))
    return found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def exact_topk(index: DataFrame, queries: DataFrame, k: int, metric: str = "ip", *,
               id_col="chunk_id", vector_col="embedding", query_id="query_id",
               query_vector="query_vector", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The k best vectors per query: highest inner product ("ip") or smallest squared distance ("l2").

    Each task scans its share of the index in place and emits at most k rows per query, so what is
    shuffled is k x tasks rows per query and never the index or the scored pairs. More queries than
    ``broadcast_bytes`` hold are matched with shards of the index in one job (`_blocks`). Scores are not rounded; ties are settled by id. Vectors of
    another length than the queries are an error.
    """
    validate_k(k)
    largest = metric == "ip"
    index = index.select(id_col, vector_col).filter(F.col(vector_col).isNotNull())
    queries = queries.select(query_id, query_vector).filter(F.col(query_vector).isNotNull())
    block, room = _query_block(queries, broadcast_bytes)
    if block.num_rows == 0:
        return _empty(index, queries, query_id, id_col)
    schema = _result_schema(queries, index, query_id, id_col)

    def ranked(block):
        return _rank(_merge_groups(_scan(index, block, k, largest, schema), query_id, id_col, k, largest),
                     query_id, id_col, k, largest)

    if block.num_rows <= room:
        return ranked(block)
    return _rank(_blocks(index, queries, k, largest, schema, room, query_id, query_vector, id_col, vector_col),
                 query_id, id_col, k, largest)


def _blocks(index, queries, k, largest, schema, room, query_id, query_vector, id_col, vector_col):
    """Top k of each shard of the index for more queries than may be broadcast: one job over all pairs of a shard and a block.

    A block holds about BLOCK_BYTES of queries and a shard at most about VECTORS_PER_SHARD vectors, so a task's memory is
    bounded; the index is copied once for each block and the queries once for each shard. ``room`` queries are compared at once.
    """
    queries, spark = durable(queries), index.sparkSession
    dimension = queries.agg(F.max(F.size(query_vector))).first()[0] or 1
    vectors, asked = index.count(), queries.count()
    # A quarter more, as a hash deals unevenly.
    blocks = max(1, -(-asked * dimension * 8 * 5 // (4 * BLOCK_BYTES)))
    wanted = -(-2 * spark.sparkContext.defaultParallelism // blocks)
    shards = max(1, -(-vectors * 5 // (4 * VECTORS_PER_SHARD)), min(wanted, -(-vectors // LEAST_SHARD)))

    def all_of(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    v = index.withColumn("__shard", F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int")).withColumn("__block", all_of(blocks))
    q = queries.withColumn("__block", F.pmod(F.xxhash64(query_id), F.lit(blocks)).cast("int")).withColumn("__shard", all_of(shards))
    return _grid(v, q, ["__block", "__shard"], k, largest, schema, query_id, query_vector, id_col, vector_col, room)


def _merge_groups(found, query_id, id_col, k, largest):
    """Top k of groups of about MERGED_TASKS tasks, so that no task takes all tasks' rows of a query."""
    group = F.floor(F.spark_partition_id() / MERGED_TASKS).cast("int")
    score = F.col("score").desc() if largest else F.col("score").asc()
    window = Window.partitionBy(query_id, "__group").orderBy(score, F.col(id_col))
    return (found.withColumn("__group", group).withColumn("__place", F.row_number().over(window))
            .filter(F.col("__place") <= k).drop("__group", "__place"))


def _query_block(queries, broadcast_bytes):
    """The queries as far as they may be broadcast, one more if there are more, and that bound."""
    first = 256
    block = queries.limit(first + 1).toArrow()
    dimension = max(1, len(block.column(1)[0])) if block.num_rows else 1
    room = max(1, broadcast_bytes // (8 * dimension))
    if block.num_rows > first and room > first:
        block = queries.limit(room + 1).toArrow()
    return block, room


def _empty(index, queries, query_id, id_col):
    schema = _result_schema(queries, index, query_id, id_col) + ", rank int"
    return index.sparkSession.createDataFrame([], schema)


def _scan(index, block, k, largest, schema):
    matrix, collector = _topk_collector(k, largest)
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast((block.column(0).combine_chunks(),
                                           matrix(block.column(1).combine_chunks())))

    def local_topk(batches):
        import pyarrow as pa
        query_ids, query_matrix = shared.value
        add, result = collector(query_matrix)
        id_type = None
        for batch in batches:
            if batch.num_rows:
                id_type = batch.column(0).type
                add(batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1)))
        best = result()
        if best is not None:
            q, ids, s, _ = best
            yield pa.RecordBatch.from_arrays(
                [query_ids.take(pa.array(q)), pa.array(ids, type=id_type), pa.array(s)],
                names=[f.split()[0] for f in schema.split(", ")])

    return index.mapInArrow(local_topk, schema)


def _grid(index, queries, cell, k, largest, schema, query_id, query_vector, id_col, vector_col, room=None):
    """Match bounded blocks of queries with bounded shards of vectors, cell by cell; ``room`` queries at a time."""
    matrix, collector = _topk_collector(k, largest)
    names = [f.split()[0] for f in schema.split(", ")]

    def cell_topk(left, right):
        import numpy as np
        import pyarrow as pa
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, (
                left.schema.field(query_id).type, right.schema.field(id_col).type, pa.float64()))})
        ids, asked = right.column(id_col).combine_chunks(), left.column(query_id).combine_chunks()
        numbers, vectors = ids.to_numpy(zero_copy_only=False), matrix(right.column(vector_col).combine_chunks())
        queries, parts = matrix(left.column(query_vector).combine_chunks()), []
        step = room or len(queries)
        for at in range(0, len(queries), step):
            add, result = collector(queries[at:at + step])
            add(numbers, vectors)
            q, found, s, _ = result() or (np.zeros(0, dtype=np.int64), numbers[:0], np.zeros(0), None)
            parts.append(pa.table([asked.take(pa.array(q + at)), pa.array(found, type=ids.type), pa.array(s)], names=names))
        return pa.concat_tables(parts)

    return (queries.groupBy(*cell).cogroup(index.groupBy(*cell)).applyInArrow(cell_topk, schema))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, for one-off expressions."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def train_cells(index: DataFrame, cells: int, vector_col="embedding", seed: int = 17):
    """Cluster the whole index; returns the (cells x dimension) centre matrix."""
    points = index.select(array_to_vector(F.col(vector_col)).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(points)
    return np.array(model.clusterCenters())


def assign_cells(df: DataFrame, centres, vector_col="embedding", nearest: int = 1, out="cell") -> DataFrame:
    """Add the nearest centre's number, or one row per each of the ``nearest`` centres.

    ``centres`` is bounded by the number of cells, not by the data.
    """
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(centres, dtype=np.float64))

    def nearest_cells(batches):
        import numpy as np
        import pyarrow as pa
        c = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(batch.schema.get_field_index(vector_col))
            if set(column.value_lengths().unique().to_pylist()) != {c.shape[1]}:
                raise ValueError(f"a vector does not have the centres' {c.shape[1]} elements")
            v = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
            d = (c ** 2).sum(1)[None, :] - 2 * v @ c.T
            order = np.argsort(d, axis=1, kind="stable")[:, :nearest].astype(np.int32)
            rows = np.repeat(np.arange(batch.num_rows), order.shape[1])
            grown = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*grown.columns, pa.array(order.ravel())],
                                             names=[*batch.schema.names, out])

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.IntegerType())])
    return df.filter(F.col(vector_col).isNotNull()).mapInArrow(nearest_cells, schema)


def approximate_topk(index: DataFrame, queries: DataFrame, k: int, metric: str = "l2", *, centres,
                     probes: int = 10, id_col="chunk_id", vector_col="embedding",
                     query_id="query_id", query_vector="query_vector",
                     per_shard: int = VECTORS_PER_SHARD) -> DataFrame:
    """Search only the ``probes`` nearest cells of each query; scores of what is found are exact.

    ``index`` carries a ``cell`` column (see ``assign_cells``); written partitioned by it, only
    probed cells are matched. A crowded cell, or many queries on one cell, is cut into bounded
    shards and blocks by the largest cell's counts, so one cell never lands in one task.
    """
    validate_k(k)
    largest = metric == "ip"
    probed = assign_cells(queries.select(query_id, query_vector), centres, query_vector, probes)
    index = index.select("cell", id_col, vector_col)
    v_sizes = (index.groupBy("cell").agg(F.count(F.lit(1)).alias("v")))
    q_sizes = (probed.groupBy("cell").agg(F.count(F.lit(1)).alias("q")))
    sizes = F.broadcast(v_sizes.join(q_sizes, "cell").select(  # one row per centre
        "cell", F.ceil(F.col("v") / per_shard).cast("int").alias("shards"),
        F.ceil(F.col("q") / QUERIES_PER_BLOCK).cast("int").alias("blocks")))
    v = (index.join(sizes, "cell").withColumn("__shard", F.pmod(F.hash(id_col), F.col("shards")))
         .withColumn("__block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    q = (probed.join(sizes, "cell").withColumn("__block", F.pmod(F.hash(query_id), F.col("blocks")))
         .withColumn("__shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))))
    v, q = v.drop("shards", "blocks"), q.drop("shards", "blocks")
    found = _grid(v, q, ["cell", "__block", "__shard"], k, largest,
                  _result_schema(queries, index, query_id, id_col), query_id, query_vector,
                  id_col, vector_col)
    return _rank(found, query_id, id_col, k, largest)


def recall(approximate: DataFrame, exact: DataFrame, id_col="chunk_id", query_id="query_id") -> DataFrame:
    """Share of the exact answers that the approximate search found, per query."""
    hits = approximate.select(query_id, id_col, F.lit(1).alias("hit"))
    return (exact.select(query_id, id_col).join(hits, [query_id, id_col], "left")
            .groupBy(query_id).agg((F.count("hit") / F.count(F.lit(1))).alias("recall")))
