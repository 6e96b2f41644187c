"""SimHash near-duplicate detection with bit-sliced comparison.

Fingerprints within `radius` bits agree on at least `blocks - radius` of `blocks` bit blocks, so each distinct
fingerprint goes to one bucket for every choice of that many blocks, and every pair within the radius meets in a
bucket. Inside a bucket the bit planes of 64 fingerprints lie in one machine word; distances of a query to all 64
grow at once in carry-save counters, and a word is abandoned when all its distances exceed the radius. Buckets
that grow large are cut into pieces whose pairs are compared in separate tasks. A task returns links as a forest,
never as all pairs, and components come from alternating star contractions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from thermocline.llm.common import SPACE_CLASS, partitions, public_id, texts
from thermocline.session import durable

_WORD = re.compile(f"[^{SPACE_CLASS}]+".encode())
_SPACES = re.compile(f"[{SPACE_CLASS}]+".encode())
SEED = 42
#: Fingerprints of one bucket that a single task compares; larger buckets are cut into pieces of half as many.
PIECE = 8192
_BITS = 64
_EDGE = "a long, b long"


def simhash(text: bytes, width: int = 4) -> int:
    """Fingerprint of a text; bit i is set if it is set in over half of the shingles' XXH64 values."""
    words = _WORD.findall(text.lower())  # bytes.lower touches A-Z alone
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][:len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1:].tolist())], "<u8")
    ones = np.zeros(_BITS, np.int64)
    for i in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[i:i + 65_536].view(np.uint8), bitorder="little").reshape(-1, _BITS)
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id (null ids as NO_ID) and fp, the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([simhash(t, width) for t in batch.column(1).to_pylist()], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], names=["doc_id", "fp"])

    return texts(docs).select("doc_id", F.col("text").cast("binary")).mapInArrow(run, "doc_id long, fp long")


def block_masks(radius: int, blocks: int) -> list[int]:
    """Bit masks whose agreement finds every pair within the radius."""
    edges = [_BITS * i // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def bit_planes(values: np.ndarray) -> np.ndarray:
    """planes[p, w]: bit p of the 64 fingerprints of word w, fingerprint 64 w + j at bit j."""
    padded = np.zeros(-(-len(values) // 64) * 64, "<u8")
    padded[:len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8), bitorder="little").reshape(-1, 64, _BITS)
    planes = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(planes).view("<u8").reshape(_BITS, -1)


def within_radius(planes: np.ndarray, queries: np.ndarray, query: np.ndarray, word: np.ndarray, radius: int):
    """For pairs of (query index, word index), the words' bits within `radius`: (surviving pairs, masks).

    Distances are held in carry-save counters, one bit of each of 64 distances in a word. Counters wide enough for
    `radius` + 1 start so that exceeding the radius overflows; overflowed bits stay set.
    """
    width = int(radius + 1).bit_length()
    start = (1 << width) - (radius + 1)
    alive = np.arange(len(query))
    full, zero = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0)
    count = [np.full(len(query), full if start >> i & 1 else zero) for i in range(width)]
    over = np.zeros(len(query), "<u8")
    for p in range(0, _BITS, 2):
        q = queries[query]
        a = planes[p][word] ^ (zero - (q >> np.uint64(p) & np.uint64(1)))
        b = planes[p + 1][word] ^ (zero - (q >> np.uint64(p + 1) & np.uint64(1)))
        # Two planes at once: a full adder on the lowest counter bit, its carry ripples upwards.
        low = count[0]
        half = a ^ b
        carry = (a & b) | (low & half)
        count[0] = low ^ half
        for i in range(1, width):
            count[i], carry = count[i] ^ carry, count[i] & carry
        over |= carry
        if p % 8 == 6:
            stay = over != full
            if not stay.all():
                alive, query, word, over = alive[stay], query[stay], word[stay], over[stay]
                count = [c[stay] for c in count]
            if not len(alive):
                break
    return alive, ~over


def forest(values: np.ndarray, last: np.ndarray, radius: int, step: int = 1 << 16) -> np.ndarray:
    """Labels: the least index linked to each of the values, links being pairs i < j <= last[i] within the radius."""
    n = len(values)
    label = np.arange(n)
    planes = bit_planes(values)
    first_word, spans = np.arange(n) // 64, last // 64 - np.arange(n) // 64 + 1
    ends = np.cumsum(spans)
    lo = 0
    while lo < n:
        # As many queries as fill one block of (query, word) pairs, at least one.
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + step, "right")))
        query = np.repeat(np.arange(lo, hi), spans[lo:hi])
        offset = np.arange(len(query)) - np.repeat(ends[lo:hi] - spans[lo:hi] - (ends[lo - 1] if lo else 0), spans[lo:hi])
        word = first_word[query] + offset
        for s in range(0, len(query), step):
            alive, masks = within_radius(planes, values, query[s:s + step], word[s:s + step], radius)
            if not len(alive):
                continue
            row, bit = np.nonzero(np.unpackbits(masks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            i, j = query[s:s + step][alive[row]], word[s:s + step][alive[row]] * 64 + bit
            true = (i < j) & (j < n)
            label = _merge(label, i[true], j[true])
        lo = hi
    return label


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least label of each component after joining i and j."""
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return label
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped


def _compare(radius: int, most: int = 1 << 16):
    """Rows sorted by (mask, key, piece_a, piece_b, fp): compare inside each such group, return star edges."""

    def flush(fps, group):
        order = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        last = np.repeat(np.r_[order[1:], len(group)] - 1, np.diff(np.r_[order, len(group)]))
        values = fps.view("<u8")
        label = forest(values, last, radius)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(fps[linked]), pa.array(fps[label[linked]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_fps, held_group, seen, size = [], [], 0, 0
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)])
            new = np.r_[before is None or bool((keys[:, 0] != before).any()), (keys[:, 1:] != keys[:, :-1]).any(axis=0)]
            before = keys[:, -1].copy()
            group = seen + np.cumsum(new)
            seen = int(group[-1])
            held_fps.append(batch.column(4).to_numpy())
            held_group.append(group)
            size += batch.num_rows
            if size >= most:
                fps, groups = np.concatenate(held_fps), np.concatenate(held_group)
                whole = int(np.searchsorted(groups, groups[-1]))  # the last group may go on in the next batch
                if whole:
                    yield flush(fps[:whole], groups[:whole])
                held_fps, held_group, size = [fps[whole:]], [groups[whole:]], len(fps) - whole
        if size:
            yield flush(np.concatenate(held_fps), np.concatenate(held_group))

    return run


def plan_blocks(n: int, radius: int) -> int:
    """Number of bit blocks such that `n` evenly spread fingerprints would put about a hundred into a bucket."""
    for blocks in range(radius + 1, radius + 5):
        if n >> (_BITS * (blocks - radius) // blocks) <= 100:
            return blocks
    return radius + 4


def near_edges(prints: DataFrame, radius: int = 4, piece: int = PIECE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp`; their components are those of all pairs within the radius."""
    masks = block_masks(radius, plan_blocks(prints.count(), radius))
    mask = F.element_at(F.array(*[F.lit(m - 2 ** 64 if m >= 2 ** 63 else m) for m in masks]), F.col("mask") + 1)
    keyed = (prints.select("fp", F.explode(F.array(*[F.lit(i) for i in range(len(masks))])).alias("mask"))
             .select("mask", F.col("fp").bitwiseAND(mask).alias("key"), "fp"))
    sizes = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
    # Only buckets of two or more are compared; the few large ones are cut into pieces by a hash of the fingerprint.
    placed = keyed.join(sizes, ["mask", "key"])
    cuts = F.when(F.col("n") > piece, F.ceil(F.col("n") / (piece // 2)).cast("int")).otherwise(F.lit(1))
    placed = placed.withColumn("cuts", cuts).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    placed = placed.select("mask", "key", F.least("own", "other").alias("piece_a"),
                           F.greatest("own", "other").alias("piece_b"), "fp")
    dealt = (placed.repartition(partitions(prints.sparkSession), "mask", "key", "piece_a", "piece_b")
             .sortWithinPartitions("mask", "key", "piece_a", "piece_b", "fp"))
    return dealt.mapInArrow(_compare(radius), _EDGE).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node of its component) for the nodes of undirected `edges` (a, b).

    Alternating star contractions: each node's neighbours join its least neighbour. A hub is a hot key of the
    joins only on the side that can be split, since each node has one least neighbour.
    """
    def both(e):
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))

    def least(e):
        return e.groupBy("u").agg(F.min("v").alias("m"))

    edges = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        sides = both(edges)
        large = (sides.join(least(sides).hint("merge"), "u").where("v > u")
                 .select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct())
        small_sides = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least_below = least(small_sides)
        small = (small_sides.join(least_below.hint("merge"), "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
                 .union(least_below.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        edges = durable(small)
        # A forest of stars no longer changes: as many edges as nodes with a smaller root, and no root below another.
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def near_dedup(docs: DataFrame, width: int = 4, radius: int = 4, piece: int = PIECE) -> DataFrame:
    """Components of documents whose fingerprints chain through links of at most `radius` differing bits.

    Returns a row for each input row: doc_id, fingerprint (16 lowercase hex digits), component_id (least doc_id
    that can be reached, the document itself included).

    Texts without a word (null and empty ones too) have fingerprint zero and link like any other; texts of fewer
    than `width` words have one shingle. A null doc_id is one id below all others. Repeated rows get equal results.
    An empty table gives no rows; columns other than doc_id and text are ignored.
    """
    prints = durable(fingerprints(docs, width))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = components(near_edges(nodes.select("fp"), radius, piece))
    classes = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least_ids = classes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = classes.join(least_ids.hint("merge"), "root").select("fp", "component_id")
    # A fingerprint with thousands of copies is hot on the documents' side, which can be split.
    return prints.join(classes.hint("merge"), "fp").select(
        public_id().alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        public_id("component_id").alias("component_id"))
