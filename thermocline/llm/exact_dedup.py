"""Exact deduplication by content-defined chunk recipes.

Every normalised text is cut where its own bytes say so. Distinct chunks are compared byte for byte once, which
turns their 64-bit hashes into verified identifiers; texts are then equal if their ordered identifier lists are.
Long documents never move: a chunk moves once for each task that holds it, and a document as a short list.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from thermocline.llm.common import SPACE_CLASS, public_id, texts

#: Cuts fall about every 2^CUT_BITS bytes, never less than MIN_CHUNK apart and never more than MAX_CHUNK.
CUT_BITS, MIN_CHUNK, MAX_CHUNK = 11, 512, 16384
_SPACES = re.compile(f"[{SPACE_CLASS}]+".encode())
_GEAR = np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=2).digest() for i in range(256)), "<u2")


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks. A cut depends on the 16 bytes before it and on the distance from the last cut."""
    size = len(data)
    if size <= MIN_CHUNK:
        return [size]
    # Rolling sum over 16 bytes by doubling: each step joins two neighbouring windows of half the width.
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for width in (1, 2, 4, 8):
        h[width:] += h[:-width] << np.uint16(width)
    at = (np.flatnonzero(h < 1 << (16 - CUT_BITS)) + 1).tolist()
    ends, last = [], 0
    for end in [*at, size]:
        while end - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if end - last >= MIN_CHUNK or (end == size and end > last):
            ends.append(end)
            last = end
    return ends


def chunks(data: bytes) -> list[bytes]:
    ends = cut_points(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def chunk_id(chunk: bytes) -> int:
    return xxhash.xxh3_64_intdigest(chunk) - 2 ** 63


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        recipes, digests = [], []
        for text in batch.column(1).to_pylist():
            text = _SPACES.sub(b" ", text)
            recipes.append([chunk_id(c) for c in chunks(text)])
            digests.append(hashlib.sha256(text).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(recipes, pa.list_(pa.int64())), pa.array(digests, pa.string())],
            names=["doc_id", "recipe", "text_sha256"])


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with their hashes; a batch gives each distinct chunk once."""
    for batch in batches:
        found: dict[bytes, int] = {}
        for text in batch.column(1).to_pylist():
            for chunk in chunks(_SPACES.sub(b" ", text)):
                found.setdefault(chunk, 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array([chunk_id(c) for c in found], pa.int64()), pa.array(list(found), pa.binary())],
            names=["chunk", "body"])


def clashing_chunks(source: DataFrame) -> DataFrame:
    """Hashes that stand for more than one chunk content, with a rank for each content."""
    distinct = source.mapInArrow(_bodies, "chunk long, body binary").distinct()
    clashes = distinct.groupBy("chunk").agg(F.count("*").alias("n")).where("n > 1").select("chunk")
    return clashes


def _clash_free(known: DataFrame, source: DataFrame, clashes: DataFrame) -> DataFrame:
    """Recipes in which a clashing hash is followed by the chunk's content digest, so that unequal chunks differ.

    The documents that hold a clashing hash are found by a semi join on ids; only their texts are read again.
    """
    held = (known.select("doc_id", F.explode("recipe").alias("chunk")).join(clashes, "chunk", "left_semi")
            .select("doc_id").distinct())
    exact = source.join(held, "doc_id", "left_semi").mapInArrow(_verbatim, "doc_id long, recipe array<long>, text_sha256 string")
    return known.join(held, "doc_id", "left_anti").unionByName(exact)


def _verbatim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes of chunk digests of 256 bits, four numbers each."""
    for batch in batches:
        recipes, digests = [], []
        for text in batch.column(1).to_pylist():
            text = _SPACES.sub(b" ", text)
            recipes.append([int(x) for c in chunks(text) for x in np.frombuffer(hashlib.sha256(c).digest(), "<i8")])
            digests.append(hashlib.sha256(text).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(recipes, pa.list_(pa.int64())), pa.array(digests, pa.string())],
            names=["doc_id", "recipe", "text_sha256"])


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Groups of documents that are equal once white-space runs are one space.

    Returns a row for each input row: doc_id, keep_id (least doc_id of the equal texts), group_size (rows),
    kept (doc_id is keep_id) and text_sha256 of the normalised text.

    Null and empty texts are equal to each other and not to a text of white space. A null doc_id counts as less
    than any other. Rows that share a doc_id are counted each; if their texts are equal and their id is the least,
    all of them are marked as kept. An empty table gives no rows; other columns are ignored. A 64-bit hash that
    two different chunks share is noticed when chunks are compared, and its documents are compared by digests of
    256 bits instead.
    """
    source = texts(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    known = source.mapInArrow(_recipes, "doc_id long, recipe array<long>, text_sha256 string")
    clashes = clashing_chunks(source)
    if not clashes.isEmpty():
        known = _clash_free(known, source, clashes)
    groups = known.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # A text with thousands of copies is one hot key of this join; the documents' side can be split at will.
    return known.join(groups.hint("merge"), "recipe").select(
        public_id().alias("doc_id"), public_id("keep_id").alias("keep_id"), "group_size",
        (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256")
