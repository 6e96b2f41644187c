"""Line deduplication: hashes of lines are range-partitioned and sorted by document and position; a stream over
each sorted partition decides which lines go, and documents get compressed keep bitmaps instead of texts.

No task needs the occurrences of a line together. A range may end inside a line's run (a line held by a third
of all documents spans many ranges); each partition therefore reports its first and last run in one row each,
and the totals of those few runs go back to the streams that need them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from thermocline.llm.common import NO_ID, SPACE_BYTES, partitions, public_id, texts
from thermocline.session import durable

_HIT = "hi long, lo long, doc_id long, text_key long, places binary"
_MARK = "text_key long, doc_id long, places binary"
_RUN = "hi long, lo long, n_docs long, top_doc long, least_doc long"


def _line_key(line: bytes, min_chars: int) -> bytes | None:
    key = line.strip(SPACE_BYTES).lower()  # bytes.lower touches A-Z alone
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return key


def _extract(min_chars: int):
    """One row for each document and distinct long line, with the line's positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            his, los, ids, keys, places = [], [], [], [], []
            for doc_id, text_key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found: dict[bytes, list[int]] = {}
                for i, line in enumerate(text.split(b"\n")):
                    if (key := _line_key(line, min_chars)) is not None:
                        found.setdefault(xxhash.xxh3_128_digest(key), []).append(i)
                for digest, at in found.items():
                    his.append(digest[:8])
                    los.append(digest[8:])
                    ids.append(doc_id)
                    keys.append(text_key)
                    places.append(np.array(at, "<u4").tobytes())
                if len(ids) > 20_000:
                    yield _hits(his, los, ids, keys, places)
                    his, los, ids, keys, places = [], [], [], [], []
            if ids:
                yield _hits(his, los, ids, keys, places)

    return run


def _hits(his, los, ids, keys, places):
    return pa.RecordBatch.from_arrays(
        [pa.array(np.frombuffer(b"".join(his), "<i8")), pa.array(np.frombuffer(b"".join(los), "<i8")),
         pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(places, pa.binary())],
        names=["hi", "lo", "doc_id", "text_key", "places"])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last run of a sorted partition: distinct documents, the largest and the least of them."""
    runs: list[list[int]] = []
    for batch in batches:
        hi, lo, doc = (batch.column(i).to_numpy() for i in range(3))
        if not len(hi):
            continue
        starts = np.flatnonzero(np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])
        distinct = np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]) | (doc[1:] != doc[:-1])]
        counts = np.add.reduceat(distinct.astype(np.int64), starts)
        ends = np.r_[starts[1:], len(hi)] - 1
        for i in {0, len(starts) - 1}:
            s, e = starts[i], ends[i]
            new = [int(hi[s]), int(lo[s]), int(counts[i]), int(doc[s]), int(doc[e])]
            if i == 0 and runs and runs[-1][:2] == new[:2]:
                last = runs[-1]
                last[2] += new[2] - (last[4] == new[3])
                last[4] = new[4]
            else:
                runs.append(new)
        if len(runs) > 2:
            runs = [runs[0], runs[-1]]
    if runs:
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in runs], pa.int64()) for i in range(5)],
                                         names=["hi", "lo", "n_docs", "top_doc", "least_doc"])


def _decide(totals: dict, min_docs: int):
    """Stream a sorted partition; a line's rows wait until its document count is known or reaches the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = top = last_doc = None
        seen, crowded, waiting, out = 0, False, [], []
        for batch in batches:
            for hi, lo, doc, text_key, places in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (hi, lo) != key:
                    key, waiting, seen, last_doc = (hi, lo), [], 0, None
                    known = totals.get(key)
                    crowded, top = (known[0] >= min_docs, known[1]) if known else (False, doc)
                if doc != last_doc:
                    seen, last_doc = seen + 1, doc
                    if not crowded and key not in totals and seen >= min_docs:
                        crowded = True
                        out += waiting
                        waiting = []
                if doc != top:
                    if crowded:
                        out.append((text_key, doc, places))
                    elif key not in totals:
                        waiting.append((text_key, doc, places))
            if len(out) > 20_000:
                yield _marks(out)
                out = []
        if out:
            yield _marks(out)

    return run


def _marks(rows):
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))],
        names=["text_key", "doc_id", "places"])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packed positions of each text as one compressed bitmap, cut after the byte of the last position that goes."""
    for batch in batches:
        maps = []
        for places in batch.column(2).to_pylist():
            dropped = np.frombuffer(b"".join(places), "<u4")
            keep = np.ones((int(dropped.max()) // 8 + 1) * 8, bool)
            keep[dropped] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary())],
                                         names=["doc_id", "text_key", "keep"])


def read_bitmap(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """True for each line that stays; lines beyond the bitmap, and all of a text without one, stay."""
    keep = np.ones(n_lines, bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n_lines]
        keep[:len(bits)] = bits
    return keep


def _without(text: bytes, bitmap: bytes | None) -> tuple[bytes, int, int]:
    """The text without the lines that its bitmap drops, its number of lines before, and how many went."""
    if bitmap is None:
        return text, text.count(b"\n") + 1, 0
    lines = text.split(b"\n")
    keep = read_bitmap(bitmap, len(lines))
    return b"\n".join(compress(lines, keep.tolist())), len(lines), len(lines) - int(keep.sum())


def _apply(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, bitmap in zip(*(batch.column(i).to_pylist() for i in range(3))):
                kept, n_lines, n_dropped = _without(text, bitmap)
                rows.append((doc_id, n_lines, n_dropped, bitmap, kept.decode() if with_text else None, hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                             names=["doc_id", "n_lines", "n_dropped", "keep", "text", "kept_sha256"])

    return run


def drop_marks(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Positions that go: text_key, doc_id, places (packed unsigned 32-bit), one row for each document and line."""
    source = texts(docs).select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    n = partitions(docs.sparkSession)
    hits = (source.mapInArrow(_extract(min_chars), _HIT)
            .repartitionByRange(n, "hi", "lo", F.col("doc_id").desc(), "text_key")
            .sortWithinPartitions("hi", "lo", F.col("doc_id").desc(), "text_key"))
    hits = durable(hits)
    # At most two rows for each partition, so this is bounded by the number of tasks and not by the corpus.
    totals: dict = {}
    edges = hits.select("hi", "lo", "doc_id").mapInArrow(_edges, _RUN).collect()
    for r in sorted(edges, key=lambda r: (r.hi, r.lo, -r.top_doc, -r.least_doc)):
        n_docs, top, least = totals.get((r.hi, r.lo), (0, r.top_doc, None))
        totals[r.hi, r.lo] = (n_docs + r.n_docs - (least == r.top_doc), top, r.least_doc)
    return hits.mapInArrow(_decide(totals, min_docs), _MARK)


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, text_key and keep, the bitmap of the lines that stay (`read_bitmap`), for each text that loses a line."""
    marks = drop_marks(docs, min_chars, min_docs).groupBy("doc_id", "text_key").agg(F.collect_set("places").alias("places"))
    return marks.mapInArrow(_bitmaps, "doc_id long, text_key long, keep binary")


def _marked(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """Whole rows in a struct beside their text and its bitmap, null where every line stays."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("doc_id"),
                       F.xxhash64(text).alias("text_key"), text.alias("text"))
    # The bitmap side is hashed, so the texts are shuffled once and never sorted.
    return rows.join(keep_bitmaps(docs, min_chars, min_docs).hint("shuffle_hash"), ["doc_id", "text_key"], "left")


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, with_text: bool = True) -> DataFrame:
    """Documents without the lines that at least `min_docs` documents share, but for the largest doc_id of each.

    A line's key is the line without white space at its ends and with A-Z lowered; keys under `min_chars` code
    points stay. Returns a row for each input row: doc_id, n_lines, n_dropped, keep (zlib-compressed bitmap of the
    lines that stay, null where all do, see `read_bitmap`), text (null unless `with_text`) and kept_sha256.

    Null or empty text: one empty line, kept. A null doc_id is one id below all others. Rows that share a doc_id
    count as one document; identical rows get identical results. A line repeated inside a document goes or stays
    as a whole. An empty table gives no rows. Columns other than doc_id and text are ignored.
    A very long text is one value of one task, as it was when read; its lines are hashed one by one.
    """
    joined = _marked(docs.select("doc_id", "text"), min_chars, min_docs)
    out = joined.select("doc_id", F.col("text").cast("binary"), "keep").mapInArrow(
        _apply(with_text), "doc_id long, n_lines long, n_dropped long, keep binary, text string, kept_sha256 string")
    return out.withColumn("doc_id", public_id())


def dedup_rows(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """The rows of `docs` with all their columns, `text` without the lines that `line_dedup` drops. Null texts stay null."""
    joined = _marked(docs, min_chars, min_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [_without(text, bitmap)[0].decode() for text, bitmap in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string())], names=["row", "kept"])

    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("kept", T.StringType())])
    done = joined.select("row", F.col("text").cast("binary"), "keep").mapInArrow(run, schema)
    return done.select(*[F.when(F.col("row")["text"].isNotNull(), F.col("kept")).alias("text") if c == "text" else F.col("row")[c].alias(c)
                         for c in docs.columns])
