"""Near-duplicate vectors through a flat graph, built in overlapping shards and searched from medoids.

Equal vectors are one node. Centres fitted on a bounded sample cut the nodes into shards; each node belongs to the shards
of its OVERLAP nearest centres and is owned by the nearest. In each shard a node gets neighbours by robust pruning, once
among the nodes within the radius and once among those beyond it, so that tight groups stay joined to the rest. The lists
that a node gets in its shards are united into one. A search for all nodes within the radius of a query runs in the
shards of the query's nearest centres: a greedy beam from the shard's medoids, then an expansion of every node in range
until none is left. Nodes in range are counted where they are owned, so nothing counts twice. Every link rests on the
cosine of two vectors in double precision. A task returns counts and a spanning forest of the links it found, never the
links. An audit compares the counts of a bounded set of queries with those of all vectors; the searches are repeated with
more shards and a wider beam until the audit's recall is met, in the end with all shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from thermocline.llm.common import partitions, public_id
from thermocline.llm.dense import common_length, matrix, vectors_of
from thermocline.llm.simhash import _merge, components
from thermocline.session import durable

#: Nodes that a centre stands for, and that one shard or one part of it holds, about; most centres.
PER_CENTRE, SHARD, MOST_CENTRES = 500, 2_000, 4_096
#: Shards a node is built into, and that a query is sent to at first.
OVERLAP, PROBES = 2, 4
#: Neighbours kept by each pruning, its slack, medoids of a shard, width of the beam, nodes of it expanded at once.
DEGREE, ALPHA, MEDOIDS, BEAM, AT_ONCE = 24, 1.2, 8, 24, 4
#: Queries searched at once, and that one task takes in a shard before another one shares its work.
QUERIES, SLICE = 512, 16_000
#: Bytes of the sample that centres are fitted on and of the audit's queries; both also have a number of rows.
SAMPLE_BYTES, SAMPLE_ROWS, AUDIT_BYTES, AUDIT_ROWS = 32 << 20, 40_000, 8 << 20, 2_000
RECALL = 0.995


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest entry is divided out first, so that no square leaves the range of a double."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def fit_centres(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Centres of unit vectors by cosine; an empty one keeps its place."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        nearest = np.concatenate([(sample[i:i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        size = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], centres)
    return centres


def prune(near: np.ndarray, pool: np.ndarray, between: np.ndarray, degree: int, alpha: float) -> list[np.ndarray]:
    """Robust pruning of every row at once: neighbours of row i out of its `pool` (row numbers, -1 for none).

    `near` is the distance to each of the pool, `between` the distances of all rows to each other. The nearest of the
    pool is taken, and all to which it is `alpha` times nearer than row i is are passed over, until `degree` are taken.
    """
    far = np.where(pool >= 0, near, np.inf)
    rows, taken = np.arange(len(pool)), []
    for _ in range(min(degree, pool.shape[1])):
        best = far.argmin(axis=1)
        there = np.isfinite(far[rows, best])
        if not there.any():
            break
        chosen = pool[rows, best]
        taken.append(np.where(there, chosen, -1))
        covered = alpha * between[chosen[:, None], pool] <= far
        far[covered & there[:, None]] = np.inf
        far[rows, best] = np.inf
    return taken


def build(v: np.ndarray, radius: float, degree: int = DEGREE, alpha: float = ALPHA, pool: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) of a shard's graph, both ways: within the radius, and beyond it from the `pool` nearest there."""
    n = len(v)
    distance = np.sqrt(np.maximum(2 - 2 * (v @ v.T), 0))
    np.fill_diagonal(distance, np.inf)
    a, b = [], []
    for inside in (True, False):
        near = np.where((distance <= radius) == inside, distance, np.inf)
        width = min(n, pool)
        at = np.argpartition(near, width - 1, axis=1)[:, :width]
        to = np.take_along_axis(near, at, axis=1)
        for chosen in prune(to, np.where(np.isfinite(to), at, -1), distance, degree, alpha):
            there = np.flatnonzero(chosen >= 0)
            a.append(there)
            b.append(chosen[there])
    a, b = (np.concatenate(x) if x else np.zeros(0, "i8") for x in (a, b))
    pairs = np.unique(np.r_[a * n + b, b * n + a])
    return pairs // n, pairs % n


def medoids_of(v: np.ndarray, most: int) -> np.ndarray:
    """The node nearest to the shard's mean, then those nearest to the means of groups around spread nodes."""
    mean = v.sum(axis=0)
    chosen = [int((v @ mean).argmax())]
    near = v @ v[chosen[0]]
    while len(chosen) < min(most, len(v)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, v @ v[chosen[-1]])
    group = (v @ v[chosen].T).argmax(axis=1)
    out = {chosen[0]}
    for g in range(len(chosen)):
        members = np.flatnonzero(group == g)
        if len(members):
            out.add(int(members[(v[members] @ v[members].sum(axis=0)).argmax()]))
    return np.array(sorted(out))


def search(v: np.ndarray, starts: np.ndarray, edges: np.ndarray, entries: np.ndarray, queries: np.ndarray, own: np.ndarray,
           threshold: float, beam: int = BEAM, at_once: int = AT_ONCE) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs in range that the graph leads to. `starts` and `edges` list neighbours node after node; `own` is
    the query's node if the shard holds it, else -1, and is in range from the start."""
    q, n = len(queries), len(v)
    score, open_ = np.full((q, n), -np.inf), np.zeros((q, n), bool)
    degrees = np.diff(starts)

    def look(row, node):
        """Score pairs not seen before, all in range stay open until they are expanded."""
        fresh = np.unique((row * n + node)[np.isneginf(score[row, node])])
        for i in range(0, len(fresh), 1 << 16):
            r, c = fresh[i:i + (1 << 16)] // n, fresh[i:i + (1 << 16)] % n
            score[r, c] = np.einsum("ij,ij->i", queries[r], v[c])
            open_[r, c] = True

    def expand(row, node):
        for i in range(0, len(row), 1 << 14):
            r, c = row[i:i + (1 << 14)], node[i:i + (1 << 14)]
            open_[r, c] = False
            d = degrees[c]
            at = np.arange(d.sum()) - np.repeat(np.cumsum(d) - d, d) + np.repeat(starts[c], d)
            look(np.repeat(r, d), edges[at])

    look(np.repeat(np.arange(q), len(entries)), np.tile(entries, q))
    known = np.flatnonzero(own >= 0)
    look(known, own[known])
    width, rows = min(beam, n), np.arange(q)
    while len(rows):
        part = score[rows]
        worst = np.partition(part, n - width, axis=1)[:, n - width]
        waiting = np.where(open_[rows], part, -np.inf)
        first = np.argpartition(-waiting, min(at_once, n) - 1, axis=1)[:, :at_once]
        value = np.take_along_axis(waiting, first, axis=1)
        r, c = np.nonzero(np.isfinite(value) & (value >= worst[:, None]))
        expand(rows[r], first[r, c])
        rows = rows[np.unique(r)]
    while True:
        r, c = np.nonzero(open_ & (score >= threshold))
        if not len(r):
            return np.nonzero(score >= threshold)
        expand(r, c)


class Plan:
    """Centres and how many parts each one's shard is cut into by a hash."""

    def __init__(self, centres: np.ndarray, parts: np.ndarray, slices: np.ndarray):
        self.centres, self.parts, self.slices = centres, parts, slices


def _nearest(shared, count: int):
    """A row for each of a node's `count` nearest centres: region, rank, node, salt, copies, v (unit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        width = min(count, len(centres))
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                v = matrix(part.column(3), centres.shape[1])
                close = v @ centres.T
                first = np.argpartition(-close, width - 1, axis=1)[:, :width]
                first = np.take_along_axis(first, np.argsort(-np.take_along_axis(close, first, axis=1), axis=1, kind="stable"), axis=1)
                at = pa.array(np.repeat(np.arange(len(v)), width))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first.ravel().astype("i4")), pa.array(np.tile(np.arange(width, dtype="i4"), len(v))),
                     *[part.column(i).take(at) for i in range(4)]], names=["region", "rank", "node", "salt", "copies", "v"])

    return run


_NEAREST = "region int, rank int, node long, salt int, copies long, v array<double>"


def nearest_regions(nodes: DataFrame, centres: np.ndarray, count: int) -> DataFrame:
    shared = nodes.sparkSession.sparkContext.broadcast(centres)
    return nodes.select("node", "salt", "copies", "v").mapInArrow(_nearest(shared, count), _NEAREST)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Whole groups of rows that agree on the first `keys` columns, of sorted rows."""
    held, at = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([batch.column(i).to_numpy().astype("i8") for i in range(keys)])
        cuts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(ids[:, a].tolist())
            if held and key != at:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            at = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _lists(length: int, radius: float):
    """Adjacency lists of each shard: node, neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _groups(batches, 2):
            ids = shard.column("node").to_numpy()
            a, b = build(matrix(shard.column("v"), length), radius)
            if len(a):
                first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a[first]]), pa.ListArray.from_arrays(pa.array(np.r_[first, len(a)].astype("i4")), pa.array(ids[b]))],
                    names=["node", "neighbours"])

    return run


def build_graph(members: DataFrame, length: int, threshold: float) -> DataFrame:
    """The flat graph: node, neighbours; lists of the overlapping shards of `members` united."""
    dealt = (members.select("region", "part", "node", "v").repartition(partitions(members.sparkSession), "region", "part")
             .sortWithinPartitions("region", "part", "node"))
    lists = dealt.mapInArrow(_lists(length, float(np.sqrt(2 - 2 * threshold))), "node long, neighbours array<long>")
    return lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"))


_FOUND = "node long, found long, other long"


def _searched(length: int, threshold: float, beam: int):
    """Rows sorted by (region, part, slice, kind, node): the shard's nodes, then queries. Counts and forest edges."""

    def flush(v, ids, owned, copies, graph, entries, place, query_ids, queries):
        own = np.array([place.get(i, -1) for i in query_ids.tolist()])
        rows, nodes = search(v, *graph, entries, queries, own, threshold, beam)
        other = ids[nodes] != query_ids[rows]
        rows, nodes = rows[other], nodes[other]
        counts = np.bincount(rows[owned[nodes]], weights=copies[nodes[owned[nodes]]], minlength=len(query_ids)).astype("i8")
        every, at = np.unique(np.r_[query_ids, ids], return_inverse=True)
        label = _merge(np.arange(len(every)), at[rows], at[len(query_ids) + nodes])
        linked = np.flatnonzero(label != np.arange(len(every)))
        hit = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.r_[query_ids[hit], every[linked]]), pa.array(np.r_[counts[hit], np.zeros(len(linked), "i8")]),
             pa.array(np.r_[np.zeros(len(hit), "i8"), every[label[linked]]], mask=np.r_[np.ones(len(hit), bool), np.zeros(len(linked), bool)])],
            names=["node", "found", "other"])

    def shard_of(table):
        ids, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        owned = table.column("rank").to_numpy() == 0
        v = matrix(table.column("v"), length)
        lists = table.column("neighbours").combine_chunks()
        order = np.argsort(ids)
        far = lists.flatten().to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(ids[order], far), len(ids) - 1)
        here = ids[order][at] == far
        sizes = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(ids)), sizes)[here]
        starts = np.r_[0, np.cumsum(np.bincount(row, minlength=len(ids)))]
        return v, ids, owned, copies, (starts, order[at[here]]), medoids_of(v, MEDOIDS), {x: i for i, x in enumerate(ids.tolist())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at = None, None
        for table in _groups(_cut(batches), 4):
            key = tuple(table.column(i)[0].as_py() for i in range(3))
            if table.column("kind")[0].as_py() == 0:
                shard, at = shard_of(table), key
            elif at == key:
                yield flush(*shard, table.column("node").to_numpy(), matrix(table.column("v"), length))

    def _cut(batches):
        """Queries of a shard in blocks: kind counts them from 1 on."""
        key, seen = None, 0
        for batch in batches:
            ids = np.stack([batch.column(i).to_numpy() for i in range(3)])
            kind = batch.column(3).to_numpy().astype("i8").copy()
            for i in np.flatnonzero(kind):
                here = (ids[0, i], ids[1, i], ids[2, i])
                key, seen = here, (seen + 1 if here == key else 0)
                kind[i] = 1 + seen // QUERIES
            yield batch.set_column(3, "kind", pa.array(kind))

    return run


def search_all(members: DataFrame, graph: DataFrame, nodes: DataFrame, plan: Plan, length: int, threshold: float, probes: int,
               beam: int) -> DataFrame:
    """node, found and other: counts of nodes in range by query (their copies included), and edges of a spanning forest."""
    spark = nodes.sparkSession
    shards = spark.createDataFrame([(i, int(p), int(s)) for i, (p, s) in enumerate(zip(plan.parts, plan.slices))],
                                   "region int, parts int, slices int")
    held = (members.join(graph, "node", "left").join(F.broadcast(shards), "region")
            .withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
            .select("region", "part", "slice", F.lit(0).alias("kind"), "node", "rank", "copies", "v",
                    F.coalesce("neighbours", F.array().cast("array<long>")).alias("neighbours")))
    asked = (nearest_regions(nodes, plan.centres, probes).join(F.broadcast(shards), "region")
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("region", "part", F.pmod(F.xxhash64("node", F.lit(7)), F.col("slices")).cast("int").alias("slice"),
                     F.lit(1).alias("kind"), "node", "rank", "copies", "v", F.array().cast("array<long>").alias("neighbours")))
    dealt = (held.unionByName(asked).repartition(partitions(spark), "region", "part", "slice")
             .sortWithinPartitions("region", "part", "slice", "kind", "node"))
    return durable(dealt.mapInArrow(_searched(length, threshold, beam), _FOUND))


def true_counts(nodes: DataFrame, sample: DataFrame, length: int, threshold: float) -> DataFrame:
    """node and truth: how many others are in range of each node of `sample`, a bounded set, by all products."""
    got = sample.select("node", "v").toArrow()
    ids, queries = got.column("node").to_numpy(), matrix(got.column("v"), length) if len(got) else np.zeros((0, length))
    shared = nodes.sparkSession.sparkContext.broadcast((ids, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = shared.value
        total = np.zeros(len(own), "i8")
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                inside = (matrix(part.column(2), length) @ q.T) >= threshold
                inside &= part.column(0).to_numpy()[:, None] != own[None, :]
                total += part.column(1).to_numpy() @ inside
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total)], names=["node", "truth"])

    return nodes.select("node", "copies", "v").mapInArrow(run, "node long, truth long").groupBy("node").agg(F.sum("truth").alias("truth"))


def _sampled(nodes: DataFrame, total: int, most: int, seed: int) -> DataFrame:
    """About `most` nodes by a hash of the vector; all if there are no more."""
    part = min(1 << 30, (most << 30) // max(total, 1))
    return nodes.where(F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(1 << 30)) < part)


def unit_nodes(used: DataFrame, length: int) -> DataFrame:
    """One node for each distinct vector: node, salt, copies, least_id, given (the vector) and v (of length one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = unit(matrix(batch.column(0), length)) if batch.num_rows else np.zeros((0, length))
            made = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, length, dtype="i4")), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, "v"])

    grouped = used.groupBy(F.col("v").alias("given")).agg(F.count("*").alias("copies"), F.min("vec_id").alias("least_id"))
    made = grouped.mapInArrow(run, "given array<double>, copies long, least_id long, v array<double>")
    return durable(made.withColumns({"node": F.monotonically_increasing_id(),
                                     "salt": F.pmod(F.xxhash64("v"), F.lit(1 << 20)).cast("int")}))


def near_links(nodes: DataFrame, length: int, threshold: float, probes: int = PROBES, beam: int = BEAM,
               recall: float = RECALL) -> tuple[DataFrame, float]:
    """(search_all's rows, the recall that the audit measured)."""
    total = nodes.count()
    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * length)))
    sample = matrix(_sampled(nodes, total, most, 1).select("v").toArrow().column("v"), length)
    if not len(sample):
        sample = matrix(nodes.limit(1).select("v").toArrow().column("v"), length)
    k = min(MOST_CENTRES, len(sample), -(-total // PER_CENTRE))
    centres = fit_centres(sample, k)
    sizes = np.zeros(k, "i8")
    for r in nearest_regions(nodes, centres, OVERLAP).groupBy("region").count().collect():  # a row for each centre
        sizes[r["region"]] = r["count"]
    plan = Plan(centres, np.maximum(1, -(-sizes // SHARD)), None)
    parts = nodes.sparkSession.createDataFrame([(i, int(p)) for i, p in enumerate(plan.parts)], "region int, parts int")
    members = durable(nearest_regions(nodes, centres, OVERLAP).join(F.broadcast(parts), "region")
                      .withColumn("part", F.pmod("salt", "parts").cast("int")).drop("parts"))
    graph = durable(build_graph(members, length, threshold))
    audited = _sampled(nodes, total, max(1, min(AUDIT_ROWS, AUDIT_BYTES // (8 * length))), 2)
    truth = {r.node: r.truth for r in true_counts(nodes, audited, length, threshold).collect()}  # a row for each audited node
    while True:
        # A centre's queries are about its share of all that are sent out; slices of a shard repeat its nodes.
        plan.slices = np.maximum(1, -(-(sizes * min(probes, k) // min(OVERLAP, k)) // SLICE))
        found = search_all(members, graph, nodes, plan, length, threshold, probes, beam)
        wanted = sum(truth.values())
        picked = found.join(F.broadcast(audited.select("node")), "node", "left_semi")
        got = {r.node: r.found for r in picked.groupBy("node").agg(F.sum("found").alias("found")).collect()}
        reached = sum(min(got.get(i, 0), n) for i, n in truth.items()) / wanted if wanted else 1.0
        if reached >= recall or (probes >= k and beam >= 2 * SHARD):
            return found, reached
        probes, beam = min(2 * probes, max(k, probes)), 2 * beam


def near_dedup(rows: DataFrame, threshold: float = 0.95, probes: int = PROBES, beam: int = BEAM, recall: float = RECALL) -> DataFrame:
    """Links and components of vectors whose cosine is at least `threshold`.

    Returns a row for each row: vec_id, n_links (other rows linked directly), component_id (least vec_id that links lead
    to, its own included), kept (vec_id = component_id) and audited_recall (one value: the part of all links of about
    2,000 vectors that the search found; the search goes on until it is at least `recall` or all shards were searched).

    Vectors that are null, empty or zero, or hold a null, NaN or infinite entry, link with nothing, and so do those of
    another length than most have. Repeated rows and equal vectors are linked with each other, as are vectors of one
    direction. A null vec_id is one id below all others. An empty table gives no rows; columns other than vec_id and
    embedding are ignored.

    Centres are fitted on about 40,000 vectors or 32 MB of them, whichever is less; every vector is indexed and searched.
    Beyond 2 million vectors shards are cut into parts, all of which a query of that shard visits.
    """
    spark = rows.sparkSession
    used = vectors_of(rows).withColumn("fit", F.col("fit") & F.coalesce(F.exists("v", lambda c: c != 0), F.lit(False)))
    length = common_length(used)
    linked = F.col("fit") & (F.size("v") == length)
    alone = used.where(~linked).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    reached = 1.0
    if length:
        used = used.where(linked).select("vec_id", "v")
        nodes = unit_nodes(used, length)
        found, reached = near_links(nodes, length, threshold, probes, beam, recall)
        counts = found.groupBy("node").agg(F.sum("found").alias("found"))
        edges = found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))
        roots = components(edges)
        classes = (nodes.select("node", "given", "copies", "least_id").join(roots, "node", "left")
                   .withColumn("root", F.coalesce("root", "node")).join(counts, "node", "left"))
        least = classes.groupBy("root").agg(F.min("least_id").alias("component_id"))
        results = classes.join(least, "root").select(
            "given", "component_id", (F.col("copies") - 1 + F.coalesce("found", F.lit(0))).cast("long").alias("n_links"))
        joined = used.join(results.hint("merge"), used["v"] == results["given"]).select("vec_id", "n_links", "component_id")
        alone = alone.unionByName(joined)
    return alone.select(public_id("vec_id").alias("vec_id"), "n_links", public_id("component_id").alias("component_id"),
                        (F.col("vec_id") == F.col("component_id")).alias("kept"), F.lit(float(reached)).alias("audited_recall"))
