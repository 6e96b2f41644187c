"""Packing of token ids into fixed rows by best fit, decreasing, written as binary matrices.

Documents are encoded where they are read and dealt, as ids, by hash to shards of bounded size. A shard's pieces, longest
first, go to the open row with the least room that still fits; a segment tree over the possible rooms finds it in
logarithmic time. Nothing crosses shards, so a corpus is packed in one shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from thermocline.llm.bpe import coder, id_type, packer, read_spec
from thermocline.llm.common import NO_ID, partitions, texts

#: Code points that a shard aims at; what a task holds at once.
SHARD_CHARS = 16_000_000
_SCHEMA = ("shard int, row int, n_tokens int, ids binary, positions binary, cu_seqlens array<int>, "
           "doc_ids array<long>, parts array<int>, offsets array<int>")


class RoomTree:
    """Which rooms from 0 to `most` have an open row; finds the least room of at least a given size."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the best fit, the row opened into that room last; None if nothing fits."""
        count, node = self.count, self.size + need
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node *= 2
                node += not count[node]
        room = node - self.size
        self._add(room, -1)
        return room, self.rows[room].pop()

    def _add(self, room: int, by: int) -> None:
        node, count = self.size + room, self.count
        while node:
            count[node] += by
            node >>= 1


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of indices into `lengths`: longest first, ties in the given order, each to the fullest row that fits it."""
    tree, rows = RoomTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if (found := tree.take(lengths[i])) is None:
            rows.append([i])
            tree.put(capacity - lengths[i], len(rows) - 1)
        else:
            room, row = found
            rows[row].append(i)
            tree.put(room - lengths[i], row)
    return rows


def pack_shard(shard: int, docs: list[tuple[int, np.ndarray]], length: int, pad: int, dtype: str) -> pa.RecordBatch:
    """The packed rows of a shard's documents (doc_id, ids)."""
    pieces = [(doc_id, k, ids[k * length:(k + 1) * length]) for doc_id, ids in docs for k in range(-(-len(ids) // length))]
    out: list[list] = [[] for _ in range(9)]
    for row, members in enumerate(best_fit([len(p[2]) for p in pieces], length)):
        sizes = [len(pieces[i][2]) for i in members]
        ends = np.cumsum([0, *sizes])
        line = np.full(length, pad, dtype)
        line[:ends[-1]] = np.concatenate([pieces[i][2] for i in members])
        positions = np.zeros(length, "<u4")
        positions[:ends[-1]] = np.arange(ends[-1]) - np.repeat(ends[:-1], sizes)
        for column, value in zip(out, (shard, row, int(ends[-1]), line.tobytes(), positions.tobytes(), ends.tolist(),
                                       [None if pieces[i][0] == NO_ID else pieces[i][0] for i in members],
                                       [pieces[i][1] for i in members], [pieces[i][1] * length for i in members])):
            column.append(value)
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()),
             pa.list_(pa.int32()), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[x.split()[0] for x in _SCHEMA.split(", ")])


def _encoded(spec):
    """doc_id, text_key, shard and packed ids of each text, its end token last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = packer(spec.value)
        end = np.array(own.own.special["<|endoftext|>"], id_type(own.own)[0]).tobytes()
        for batch in batches:
            made = [own.ids(t) + end for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.binary())], names=["doc_id", "text_key", "shard", "ids"])

    return run


def _packed(length: int, end_id: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for doc_id, shard, ids in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if shard != at and held:
                    yield pack_shard(at, held, length, end_id, dtype)
                    held = []
                at = shard
                held.append((doc_id, np.frombuffer(ids, dtype)))
        if held:
            yield pack_shard(at, held, length, end_id, dtype)

    return run


def pack(docs: DataFrame, path: str, length: int = 2048, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Packed rows of token ids, `length` ids each.

    Returns shard, row (within the shard), n_tokens (without padding), ids (little-endian unsigned, 16 bits if the
    vocabulary allows, else 32; padded with the end token), positions (32 bits each, starting at 0 in every segment),
    cu_seqlens (segment starts and the last end), and for each segment doc_ids, parts and offsets (the first token's
    place in its document).

    Every document is its words' ids and one end token; a longer one is split into parts of `length` ids and a rest, in
    order and without loss. Null and empty texts are an end token alone, a text of any length is taken whole. A null doc_id
    is null in doc_ids. Repeated rows are packed each. Equal lengths are placed by doc_id, then by a hash of the text. An
    empty table gives no rows; columns other than doc_id and text are ignored.

    There are as many shards as the corpus has times `shard_chars` code points, so a document lies in another row, beside
    others, when the table or `shard_chars` grows; what is packed stays the same.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    own = coder(spec.value)
    dtype, end_id = id_type(own)[0], own.special["<|endoftext|>"]
    source = texts(docs).withColumn("text_key", F.xxhash64("text"))
    chars = source.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-chars // shard_chars))
    named = source.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(shards)).cast("int"))
    encoded = named.select("doc_id", "text_key", "shard", "text").mapInArrow(_encoded(spec), "doc_id long, text_key long, shard int, ids binary")
    # Shards go by their number, so that tasks get as many each as can be.
    dealt = encoded.repartitionById(min(shards, max(partitions(docs.sparkSession), 1)), "shard").sortWithinPartitions("shard", "doc_id", "text_key")
    return dealt.mapInArrow(_packed(length, end_id, dtype), _SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """Store packed rows; a reader gets each shard's matrix by stacking `ids` in row order."""
    packed.write.mode("overwrite").parquet(path)


def read_packed(spark, path: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).parquet(path)
