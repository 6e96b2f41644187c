"""Search in a stored index of cells.

Vectors are stored by cell; a second table describes every cell by its centre (the mean of what the
cell holds), its radius and its count. Approximate search reads the cells nearest to its queries.
Exact search reads them first and then only those further cells that could still hold an answer.
"""

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F, types as T

from thermocline.operators.vectors import (BROADCAST_BYTES, LEAST_SHARD, VECTORS_PER_SHARD, _empty, _merge_groups, _rank,
                                           _result_schema, _topk_collector, assign_cells, train_cells, validate_k)
from thermocline.session import durable

#: Centres travel to every task: at most so many, and so many bytes of them.
MOST_CELLS, CENTRE_BYTES = 4096, 64 << 20
#: Vectors that centres are fitted on, for each cell. All vectors are assigned and described.
FIT_PER_CELL = 256
#: Queries whose distances to all centres a task holds at once.
PROBED_TOGETHER = 256


def with_cells(indexed: DataFrame, cells: int = None, id_col="chunk_id", vector_col="embedding",
               seed: int = 17) -> DataFrame:
    """Add ``cell``; rows without a vector are left out. By default there are about as many cells
    as each cell has vectors, at most ``MOST_CELLS``. Centres are fitted on at most about
    ``FIT_PER_CELL`` vectors a cell, chosen by a hash of the id; every vector is assigned."""
    # One task may read all vectors; the passes that fit and assign centres are for many.
    rows = durable(indexed.filter(F.col(vector_col).isNotNull()).hint("rebalance"))
    count = rows.count()
    if count == 0:
        return rows.withColumn("cell", F.lit(0))
    cells = min(cells or round(count ** 0.5), MOST_CELLS, count)
    if cells < 2:
        return rows.withColumn("cell", F.lit(0))
    buckets = max(1, count // (cells * FIT_PER_CELL))
    sample = rows.filter(F.pmod(F.xxhash64(id_col), F.lit(buckets)) == 0)
    return assign_cells(rows, train_cells(sample, cells, vector_col, seed), vector_col)


def describe_cells(index: DataFrame, vector_col="embedding") -> DataFrame:
    """One row per cell: cell, vectors, centre, radius (the largest distance from the centre)."""
    index = index.select("cell", vector_col).filter(F.col(vector_col).isNotNull())
    means = index.groupBy("cell").agg(
        F.count(F.lit(1)).alias("vectors"),
        vector_to_array(Summarizer.mean(array_to_vector(F.col(vector_col).cast("array<double>")))).alias("centre"))
    means = durable(means)
    numbers, centres, _ = _centres(means)
    shared = index.sparkSession.sparkContext.broadcast((numbers, centres))

    def reach(batches):
        import numpy as np
        import pyarrow as pa
        numbers, centres = shared.value
        far = np.zeros(len(numbers))
        for batch in batches:
            if batch.num_rows:
                own = np.searchsorted(numbers, batch.column(0).to_numpy(zero_copy_only=False))
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                np.maximum.at(far, own, np.sqrt(((v.astype(np.float64) - centres[own]) ** 2).sum(1)))
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(far)], names=["cell", "radius"])

    radii = index.mapInArrow(reach, "cell int, radius double").groupBy("cell").agg(F.max("radius").alias("radius"))
    return means.join(F.broadcast(radii), "cell").select("cell", "vectors", "centre", "radius")


def _centres(cells: DataFrame):
    """Cell numbers in order, their centres and radii, once their number and size are known to be small."""
    rows = cells.orderBy("cell").limit(MOST_CELLS + 1).toArrow()
    if rows.num_rows > MOST_CELLS:
        raise ValueError(f"an index has at most {MOST_CELLS} cells")
    centres = np.array(rows.column("centre").to_pylist(), dtype=np.float64)
    if centres.nbytes > CENTRE_BYTES:
        raise ValueError(f"the centres of an index take at most {CENTRE_BYTES} bytes")
    radii = rows.column("radius").to_numpy() if "radius" in rows.column_names else None
    return rows.column("cell").to_numpy(), centres, radii


def _choose(queries, cells, choose_rows, query_id, query_vector, kept=None):
    """Add the list ``cells`` to search; ``choose_rows(queries, centres, radii, batch)`` gives a mask. With ``kept``, the name
    of a column to keep, cells are bits in their order instead, and queries without a cell are left out."""
    shared = queries.sparkSession.sparkContext.broadcast(cells)

    def chosen(batches):
        import numpy as np
        import pyarrow as pa
        numbers, centres, radii = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, PROBED_TOGETHER):
                part = batch.slice(at, PROBED_TOGETHER)
                vectors = part.column(part.schema.get_field_index(query_vector))
                if set(vectors.value_lengths().unique().to_pylist()) != {centres.shape[1]}:
                    raise ValueError(f"a query does not have the index's {centres.shape[1]} elements")
                q = vectors.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1).astype(np.float64)
                mask = choose_rows(q, centres, radii, part)
                if kept:
                    some = mask.any(1)
                    batch_of = [part.column(part.schema.get_field_index(name)) for name in (query_id, query_vector, kept)]
                    yield pa.RecordBatch.from_arrays([*batch_of, _bit_rows(mask)], names=names).filter(pa.array(some))
                    continue
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], mask.sum(1).cumsum()]).astype(np.int32)),
                    pa.array(numbers[np.nonzero(mask)[1]].astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(query_id)), vectors, lists],
                    names=[query_id, query_vector, "cells"])

    names = [query_id, query_vector, kept, "cells"]
    schema = T.StructType([queries.schema[query_id], queries.schema[query_vector],
                           T.StructField("cells", T.ArrayType(T.IntegerType()))])
    if kept:
        schema = T.StructType([*[queries.schema[name] for name in names[:3]], T.StructField("cells", T.BinaryType())])
    return durable(queries.mapInArrow(chosen, schema))


def _bit_rows(mask):
    """Each row of a mask as bytes."""
    import numpy as np
    import pyarrow as pa
    return pa.array([row.tobytes() for row in np.packbits(mask, axis=1)], pa.binary())


def nearest_cells(queries: DataFrame, cells: DataFrame, probes: int, query_id="query_id",
                  query_vector="query_vector") -> DataFrame:
    """Queries with the ``probes`` cells whose centres are nearest."""
    def nearest(q, centres, radii, part):
        import numpy as np
        far = (centres ** 2).sum(1)[None, :] - 2 * q @ centres.T
        mask = np.zeros(far.shape, dtype=bool)
        order = np.argsort(far, axis=1, kind="stable")[:, :probes]
        np.put_along_axis(mask, order, True, axis=1)
        return mask

    return _choose(queries, _centres(cells), nearest, query_id, query_vector)


def probes_for_recall(index: DataFrame, queries: DataFrame, k: int, metric: str = "ip", *, cells: DataFrame,
                      target: float = 0.9, id_col="chunk_id", vector_col="embedding", query_id="query_id",
                      query_vector="query_vector") -> int:
    """The fewest probes whose search finds ``target`` of the exact results of these queries, all
    together. One exact search tells for any number: a result is found once its cell is probed."""
    names = dict(id_col=id_col, vector_col=vector_col, query_id=query_id, query_vector=query_vector)
    found = cell_topk(index, queries, k, metric, cells=cells, exact=True, **names)
    numbers, centres, _ = _centres(cells)
    shared = queries.sparkSession.sparkContext.broadcast((numbers, centres))

    def places(batches):
        import numpy as np
        import pyarrow as pa
        numbers, centres = shared.value
        for batch in batches:
            if batch.num_rows:
                q = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                at = np.searchsorted(numbers, batch.column(0).to_numpy(zero_copy_only=False))
                far = (centres ** 2).sum(1)[None, :] - 2 * q.astype(np.float64) @ centres.T
                place = np.argsort(np.argsort(far, axis=1, kind="stable"), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(place[np.arange(len(at)), at] + 1), batch.column(2)],
                                                 names=["place", "n"])

    held = found.groupBy(query_id, "cell").agg(F.count(F.lit(1)).alias("n"))
    asked = held.join(queries.select(query_id, query_vector), query_id).select("cell", query_vector, "n")
    by_place = (asked.mapInArrow(places, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
                .orderBy("place").collect())  # at most a row per cell
    total, reached = sum(r.n for r in by_place), 0
    for r in by_place:
        reached += r.n
        if reached >= target * total - 1e-9:
            return r.place
    return 1


def remaining_cells(searched: DataFrame, found: DataFrame, cells: DataFrame, k: int, metric: str,
                    query_id="query_id", query_vector="query_vector", packed: bool = False) -> DataFrame:
    """Queries with the cells not searched yet that could hold something at least as good as the
    k-th result; queries without such a cell are left out.

    No vector of a cell is nearer than the centre less the radius, and none has a larger inner
    product than the centre's plus the radius times the query's length. Rounding is allowed for. ``packed`` gives cells as
    bits, and ``__bad`` of the k-th result beside them.
    """
    largest = metric == "ip"
    bad = -F.col("score") if largest else F.col("score")
    last = found.groupBy(query_id).agg(F.count(F.lit(1)).alias("__n"), F.max(bad).alias("__bad"))
    last = last.select(query_id, F.when(F.col("__n") >= k, F.col("__bad")).alias("__bad"))
    rows = searched.withColumnRenamed("cells", "__done").join(last, query_id, "left").withColumn(
        "__bad", F.coalesce("__bad", F.lit(float("inf"))))

    numbers, centres, radii = _centres(cells)

    def could(q, centres, radii, part):
        import numpy as np
        lengths, squares = np.sqrt((q ** 2).sum(1))[:, None], (centres ** 2).sum(1)[None, :]
        scale = lengths + np.sqrt(squares) + radii[None, :]
        dots = q @ centres.T
        slack = 1e-9 * scale ** 2
        if largest:
            least = -(dots + lengths * radii[None, :])
        else:
            gap = np.sqrt(np.maximum(0, lengths ** 2 + squares - 2 * dots))
            # The root of a small difference is off by up to the root of its rounding.
            least = np.maximum(0, gap - 1e-6 * scale - radii[None, :]) ** 2
        # Written so that a cell of values that are no numbers is searched.
        mask = ~(least - slack > part.column(part.schema.get_field_index("__bad")).to_numpy()[:, None])
        done = part.column(part.schema.get_field_index("__done"))
        at = np.repeat(np.arange(part.num_rows), done.value_lengths().to_numpy(zero_copy_only=False))
        mask[at, np.searchsorted(numbers, done.flatten().to_numpy())] = False
        return mask

    chosen = _choose(rows, (numbers, centres, radii), could, query_id, query_vector, "__bad" if packed else None)
    return chosen if packed else chosen.filter(F.size("cells") > 0)


def pairs_scored(planned: DataFrame, cells: DataFrame) -> DataFrame:
    """One row: how many pairs of query and vector a search of the listed cells compares."""
    pairs = planned.select(F.explode("cells").alias("cell")).join(F.broadcast(cells.select("cell", "vectors")), "cell")
    return pairs.agg(F.coalesce(F.sum("vectors"), F.lit(0).cast("long")).alias("pairs"))


def probed_part(index: DataFrame, planned: DataFrame) -> DataFrame:
    """The rows of the listed cells. Of a table stored by cell no other cell is read."""
    wanted = (planned.select(F.explode("cells").alias("cell")).groupBy("cell")
              .agg(F.count(F.lit(1)).alias("queries")).filter(F.col("queries") > 0))
    return index.join(F.broadcast(wanted), "cell", "left_semi")  # at most MOST_CELLS rows


def _bits(planned, numbers, query_id, query_vector):
    """Queries with the listed cells as bits in the order of ``numbers``."""
    shared = planned.sparkSession.sparkContext.broadcast(numbers)

    def pack(batches):
        import numpy as np
        import pyarrow as pa
        numbers = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, PROBED_TOGETHER):
                part = batch.slice(start, PROBED_TOGETHER)
                lists = part.column(2)
                mask = np.zeros((part.num_rows, len(numbers)), dtype=bool)
                at = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                mask[at, np.searchsorted(numbers, lists.flatten().to_numpy())] = True
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _bit_rows(mask)],
                                                 names=[query_id, query_vector, "cells"])

    schema = T.StructType([planned.schema[query_id], planned.schema[query_vector], T.StructField("cells", T.BinaryType())])
    return planned.select(query_id, query_vector, "cells").mapInArrow(pack, schema)


def _packed(planned, numbers, query_id, query_vector):
    """Queries with the listed cells as bits, the form in which they pass through the driver."""
    return _bits(planned, numbers, query_id, query_vector).toArrow()


def _bit_matrix(array):
    """Cells that are bits, as bytes of a row per query."""
    import numpy as np
    return np.frombuffer(b"".join(array.to_pylist()), dtype=np.uint8).reshape(len(array), -1)


def _with_bit(bits, place):
    """Rows that have a bit; a cell's queries are found when it is searched, as all lists of them may take far more room."""
    import numpy as np
    return np.flatnonzero(bits[:, place >> 3] & (128 >> (place & 7)))


def _scan_cells(index, block, numbers, k, largest, schema):
    """Score the index where it lies; a task holds the k best of each query so far."""
    matrix, collector = _topk_collector(k, largest)
    bits = _bit_matrix(block.column("cells"))
    wanted = numbers[np.unpackbits(np.bitwise_or.reduce(bits, axis=0), count=len(numbers)).astype(bool)]
    cut = block.column("__bad").to_numpy() if "__bad" in block.column_names else None
    shared = index.sparkSession.sparkContext.broadcast((
        block.column(0).combine_chunks(), matrix(block.column(1).combine_chunks()), bits, numbers, cut))
    part = index.sparkSession.createDataFrame([([int(x) for x in wanted],)], "cells array<int>")

    def local_topk(batches):
        import numpy as np
        import pyarrow as pa
        query_ids, queries, bits, described, cut = shared.value
        add, result = collector(queries, cut)
        id_type = None
        for batch in batches:
            numbers = batch.column(0).to_numpy(zero_copy_only=False)
            for number in np.unique(numbers):
                mine = _with_bit(bits, np.searchsorted(described, number))
                if len(mine):
                    part = batch.filter(pa.array(numbers == number))
                    id_type = part.column(1).type
                    add(part.column(1).to_numpy(zero_copy_only=False), matrix(part.column(2)), mine, number)
        best = result()
        if best is not None:
            q, ids, s, cells = best
            yield pa.RecordBatch.from_arrays(
                [query_ids.take(pa.array(q)), pa.array(ids, type=id_type), pa.array(s), pa.array(cells.astype(np.int32))],
                names=[f.split()[0] for f in schema.split(", ")])

    return probed_part(index, part).mapInArrow(local_topk, schema)


def _match_cells(index, planned, k, largest, schema, numbers, sizes, block_queries, query_id, query_vector, id_col, vector_col):
    """Top k of each shard of the index for more queries than may be broadcast, in one job: a task holds a block of queries
    and a shard, which is some cells or a part of a crowded one. Queries go to the shards that hold a cell of theirs, and a
    shard's vectors to the blocks that ask for their cell."""
    spark, count = planned.sparkSession, planned.count()
    blocks = max(1, -(-count * 5 // (4 * block_queries)))
    wanted = -(-2 * spark.sparkContext.defaultParallelism // blocks)
    most = max(1, min(VECTORS_PER_SHARD, max(LEAST_SHARD, -(-int(sizes.sum()) // wanted))))
    # Cells in order fill shards of about ``most`` vectors; one of more has shards of its own.
    parts, first, shard, room = np.maximum(1, -(-sizes // most)), np.zeros(len(sizes), dtype=np.int64), -1, 0
    for i, n in enumerate(sizes):
        if shard < 0 or parts[i] > 1 or n > room:
            first[i] = shard + 1
            shard, room = shard + int(parts[i]), most - int(n) if parts[i] == 1 else 0
        else:
            first[i], room = shard, room - int(n)
    held = np.zeros((len(sizes), shard + 1), dtype=np.float32)
    for i in range(len(sizes)):
        held[i, first[i]:first[i] + parts[i]] = 1
    shared = spark.sparkContext.broadcast((numbers, held))
    planned = planned.withColumn("__block", F.pmod(F.xxhash64(query_id), F.lit(blocks)).cast("int"))

    def to_shards(batches):
        import numpy as np
        import pyarrow as pa
        numbers, held = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, PROBED_TOGETHER):
                part = batch.slice(start, PROBED_TOGETHER)
                bits = _bit_matrix(part.column(part.schema.get_field_index("cells")))
                asked = (np.unpackbits(bits, axis=1, count=len(numbers)).astype(np.float32) @ held) > 0
                rows, shards = np.nonzero(asked)
                grown = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*grown.columns, pa.array(shards.astype(np.int32))],
                                                 names=[*part.schema.names, "__shard"])

    def to_blocks(batches):
        import numpy as np
        import pyarrow as pa
        numbers, _ = shared.value
        asked = {}
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False)
            for block in np.unique(at):
                some = np.bitwise_or.reduce(_bit_matrix(batch.filter(pa.array(at == block)).column(1)), axis=0)
                asked[block] = asked[block] | some if block in asked else some
        for block, some in asked.items():
            cells = numbers[np.unpackbits(some, count=len(numbers)).astype(bool)].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.full(len(cells), block, dtype=np.int32))],
                                             names=["cell", "__block"])

    matrix, collector = _topk_collector(k, largest)
    names = [f.split()[0] for f in schema.split(", ")]

    def matched(left, right):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        asked, ids = left.column(query_id).combine_chunks(), right.column(id_col).combine_chunks()
        best = None
        if left.num_rows and right.num_rows:
            bits = _bit_matrix(left.column("cells"))
            cut = left.column("__bad").to_numpy() if "__bad" in left.column_names else None
            add, result = collector(matrix(left.column(query_vector).combine_chunks()), cut)
            vectors = matrix(right.column(vector_col).combine_chunks())
            # Ids as numbers in their order.
            by_id = pc.sort_indices(ids, null_placement="at_start").to_numpy()
            places = np.empty(len(by_id), dtype=np.int64)
            places[by_id] = np.arange(len(by_id))
            cells = right.column("cell").to_numpy()
            by_cell = np.argsort(cells, kind="stable")
            found, starts = np.unique(cells[by_cell], return_index=True)
            for cell, rows in zip(found, np.split(by_cell, starts[1:])):
                add(places[rows], vectors[rows], _with_bit(bits, np.searchsorted(shared.value[0], cell)), cell)
            best = result()
        q, r, s, tags = best or (np.zeros(0, dtype=np.int64),) * 4
        return pa.table([asked.take(pa.array(q)), ids.take(pa.array(by_id[r] if best else r)), pa.array(s, pa.float64()),
                         pa.array(tags, pa.int32())], names=names)

    queries = planned.mapInArrow(to_shards, T.StructType([*planned.schema.fields, T.StructField("__shard", T.IntegerType())]))
    asked = planned.select("__block", "cells").mapInArrow(to_blocks, "cell int, __block int").distinct()
    rows = [(int(c), int(f), int(p)) for c, f, p in zip(numbers, first, parts)]  # at most MOST_CELLS
    deal = F.broadcast(spark.createDataFrame(rows, "cell int, __first int, __parts int"))
    shard = F.col("__first") + F.pmod(F.xxhash64(id_col), F.col("__parts")).cast("int")
    vectors = (index.join(deal, "cell").withColumn("__shard", shard).drop("__first", "__parts").join(asked, "cell"))
    keys = ["__block", "__shard"]
    return queries.groupBy(*keys).cogroup(vectors.groupBy(*keys)).applyInArrow(matched, schema)


def _search(index, planned, k, metric, cells, query_id, query_vector, id_col, vector_col, broadcast_bytes):
    """The k best of the cells of each query, from each task. ``planned`` has them as bits, and may have a column ``__bad``
    that results must not be worse than."""
    numbers, dimension, sizes = cells
    largest = metric == "ip"
    schema = _result_schema(planned, index, query_id, id_col) + ", cell int"
    index = index.select("cell", id_col, vector_col).filter(F.col(vector_col).isNotNull())
    # A query, its bits and its results.
    room = max(1, broadcast_bytes // (8 * dimension + len(numbers) // 8 + 32 * k))
    block = planned.limit(room + 1).toArrow()
    if block.num_rows == 0:
        return index.sparkSession.createDataFrame([], schema)
    if block.num_rows <= room:
        return _merge_groups(_scan_cells(index, block, numbers, k, largest, schema), query_id, id_col, k, largest)
    return _match_cells(index, planned, k, largest, schema, numbers, sizes, room, query_id, query_vector, id_col, vector_col)


def cell_topk(index: DataFrame, queries: DataFrame, k: int, metric: str = "ip", *, cells: DataFrame,
              probes: int = 10, exact: bool = False, id_col="chunk_id", vector_col="embedding",
              query_id="query_id", query_vector="query_vector",
              broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The k best vectors per query among the ``probes`` nearest cells; with ``exact`` among all.

    ``index`` has a column ``cell`` and ``cells`` describes them (see ``describe_cells``). The exact
    answer takes two searches: the second one leaves out every cell that the k-th result of the
    first rules out. Vectors stay where they are stored; what is shuffled is k rows per query, cell
    and task. Scores, order and ties are those of ``exact_topk``. Adds the column ``cell``.
    """
    validate_k(k)
    if probes <= 0:
        raise ValueError("probes must be positive")
    queries = queries.select(query_id, query_vector).filter(F.col(query_vector).isNotNull())
    numbers, centres, _ = _centres(cells)
    if not len(centres):
        return _empty(index, queries, query_id, id_col).withColumn("cell", F.lit(None).cast("int"))
    counts = {r.cell: r.vectors for r in cells.select("cell", "vectors").collect()}  # at most MOST_CELLS
    described = numbers, centres.shape[1], np.array([counts[n] for n in numbers], dtype=np.int64)
    names = (query_id, query_vector, id_col, vector_col, broadcast_bytes)
    planned = nearest_cells(queries, cells, probes, query_id, query_vector)
    found = _search(index, _bits(planned, numbers, query_id, query_vector), k, metric, described, *names)
    found = _rank(found, query_id, id_col, k, metric == "ip")
    if not exact:
        return found
    found = durable(found)
    rest = remaining_cells(planned, found, cells, k, metric, query_id, query_vector, packed=True)
    more = _search(index, rest, k, metric, described, *names)
    return _rank(found.drop("rank").unionByName(more), query_id, id_col, k, metric == "ip")


def cell_search(cells: DataFrame, probes: int = 10, exact: bool = False):
    """A search for ``retrieve`` over an index that was built with cells."""
    def search(index, queries, k, metric="ip", **names):
        return cell_topk(index, queries, k, metric, cells=cells, probes=probes, exact=exact, **names)

    return search
