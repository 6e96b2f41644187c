"""BPE encoding and decoding through a table of distinct words.

A tokenizer of the supported kind drops white space and encodes every word by itself, so a text's ids follow from its
words' ids. Frequent words, found in a bounded sample, are encoded once and broadcast; a text becomes the ids of these, with
a hole for every other word. Those other words go by (document, position, word) to where each distinct one is encoded once,
and their ids come back by (document, position) into the holes. Ids become text by a join of (position, id) with the
id-to-piece table.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from thermocline.llm.common import partitions, public_id, texts
from thermocline.session import durable

#: Documents whose words are counted to find frequent ones, the most words that are broadcast and the bytes of one.
HEAD_DOCS, HEAD_WORDS, HEAD_BYTES = 20_000, 300_000, 64
#: Words whose ids a worker remembers, twice over.
MEMORY = 250_000
#: Tasks that share the rows of one long word.
SALTS = 16
#: Repeated ids that are broadcast, 8 MB of them.
REPEATED = 1_000_000
# The word pattern of the supported tokenizer.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters for which Python's classes, lower case and normal form agree with the tokenizer's; other texts are split
#: by the tokenizer itself.
_PLAIN = re.compile("[\t-\r\x20-\x7e\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ž‐-‧€]*")
_PLAIN_WORD = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordCoder:
    """Splits texts into words as a tokenizer does, and encodes single words."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        parts = json.loads(spec)
        steps = [x["type"] for x in parts["normalizer"]["normalizers"]]
        split = parts["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex")
        if steps != ["NFC", "Replace", "Lowercase"] or split != WORD_PATTERN:
            raise ValueError("this tokenizer does not split at white space; word tables do not apply to it")
        self.special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self._marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._letters = _byte_letters()
        self._bytes = {c: b for b, c in enumerate(self._letters)}

    def words(self, text: str) -> list[str]:
        """Words in order, special tokens as they are."""
        if self._marks and self._marks.search(text):
            out: list[str] = []
            for piece in self._marks.split(text):
                if piece in self.special:
                    out.append(piece)
                elif piece:
                    out += self._plain(piece)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return _PLAIN_WORD.findall(text.lower())
        normal = self.tokenizer.normalizer.normalize_str(text)
        return [bytes(self._bytes[c] for c in w).decode("utf-8", "surrogateescape")
                for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def encode(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        letters = word if word.isascii() and word.isprintable() else "".join(
            self._letters[b] for b in word.encode("utf-8", "surrogateescape"))
        return [t.id for t in self.tokenizer.model.tokenize(letters)]

    def pieces(self) -> list[str]:
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        return [self.tokenizer.id_to_token(i) or "" for i in range(size)]


@lru_cache(maxsize=2)
def coder(spec: str) -> WordCoder:
    return WordCoder(spec)


class Memory(dict):
    """What `make` gives for a key, remembered: of the last `most` keys at least, of twice as many at most."""

    def __init__(self, make, most: int = MEMORY):
        super().__init__()
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, key):
        made = self.before.get(key)
        if made is None:
            made = self.make(key)
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[key] = made
        return made


class Packer:
    """Packed ids of whole texts, ids of words remembered."""

    def __init__(self, own: WordCoder, code: str):
        self.own = own
        self.memory = Memory(lambda w: array(code, own.encode(w)).tobytes())

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.memory.__getitem__, self.own.words(text)))


class Holes(dict):
    """Packed ids of the broadcast words; every other word is a hole."""

    def __init__(self, known: dict, hole: bytes):
        super().__init__(known)
        self.hole = hole

    def __missing__(self, word):
        return self.hole


def id_type(own: WordCoder) -> tuple[str, str]:
    """(numpy type, array code) that hold every id and one more number, the greatest, which stands for a hole."""
    return ("<u2", "H") if own.tokenizer.get_vocab_size(with_added_tokens=True) < 1 << 16 else ("<u4", "I")


@lru_cache(maxsize=2)
def packer(spec: str) -> Packer:
    """One for each worker process and tokenizer."""
    own = coder(spec)
    return Packer(own, id_type(own)[1])


def read_spec(path: str) -> str:
    """The tokenizer's description; tasks get it by broadcast, so only the driver needs the file."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def count_floor(counted: DataFrame, most: int, column: str = "n") -> int:
    """A count such that at most `most` rows reach it, from a histogram of a few hundred bins at most."""
    bins = counted.groupBy(F.floor(F.log2(column) * 4).alias("b")).agg(F.count("*").alias("rows")).collect()
    floor, rows = 1, 0
    for r in sorted(bins, key=lambda r: -r.b):
        rows += r.rows
        if rows > most:
            break
        floor = 2 ** (r.b / 4)
    else:
        return 1
    return int(floor) + (floor != int(floor)) if rows > most else 1


def _tally(spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts = coder(spec.value), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(own.words(text))
            if len(counts) > 300_000:
                yield _counted(counts)
                counts = Counter()
        yield _counted(counts)

    return run


def _counted(counts):
    keys = [w.encode("utf-8", "surrogateescape") for w in counts]
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def _encode_words(spec):
    """Rows with `word` last, equal words in a run: the other columns and the word's packed ids; each run is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, word, ids = coder(spec.value), None, b""
        code = id_type(own)[1]
        for batch in batches:
            made = []
            for w in batch.column(batch.num_columns - 1).to_pylist():
                if w != word:
                    word, ids = w, array(code, own.encode(w.decode("utf-8", "surrogateescape"))).tobytes()
                made.append(ids)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.binary())], names=[*batch.schema.names[:-1], "ids"])

    return run


def encode_words(rows: DataFrame, spec) -> DataFrame:
    """`rows` (any columns, `word` last) with ids in place of word: rows are dealt and sorted by word, each distinct one is
    encoded once. Only frequent short words are broadcast, so the rows of a long one are shared by SALTS tasks."""
    salt = F.when(F.octet_length("word") > HEAD_BYTES, F.pmod(F.xxhash64(*[c for c in rows.columns if c != "word"]), F.lit(SALTS)))
    dealt = rows.repartition(partitions(rows.sparkSession), "word", salt).sortWithinPartitions("word")
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "word")
    return dealt.mapInArrow(_encode_words(spec), f"{schema}, ids binary")


_KNOWN: dict = {}


def _known(broadcast) -> dict[str, bytes]:
    """Packed ids of the broadcast words; one dictionary for each worker process and broadcast."""
    key = broadcast._path if hasattr(broadcast, "_path") else id(broadcast)
    if key not in _KNOWN:
        _KNOWN.clear()
        words, ids = broadcast.value
        _KNOWN[key] = {w.decode("utf-8", "surrogateescape"): x for w, x in zip(words, ids)}
    return _KNOWN[key]


def frequent_words(docs: DataFrame, spec, head_docs: int, head_words: int) -> tuple[list[bytes], list[bytes]]:
    """The most frequent words of about `head_docs` documents, chosen by a hash, and their ids; at most `head_words`, of at
    most HEAD_BYTES each, so that both the driver and a worker hold a bounded number of bytes."""
    total = docs.count()
    part = F.pmod(F.xxhash64("doc_id", "text_key", F.lit(1)), F.lit(1 << 20)) < max(1, min(1 << 20, (head_docs << 20) // max(total, 1)))
    counted = (docs.where(part).select("text").mapInArrow(_tally(spec), "word binary, n long")
               .where(F.octet_length("word") <= HEAD_BYTES).groupBy("word").agg(F.sum("n").alias("n")))
    counted = durable(counted)
    kept = counted.where(F.col("n") >= count_floor(counted, head_words)).select(F.col("word").alias("key"), "word")
    table = encode_words(kept, spec).toArrow()
    return table.column("key").to_pylist(), table.column("ids").to_pylist()


def _rare(spec, head):
    """doc_id, text_key, pos and word for every word that is not broadcast; pos counts those words of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = coder(spec.value), _known(head)

        for batch in batches:
            words, counts = [], []
            for text in batch.column(2).to_pylist():
                here = [w.encode("utf-8", "surrogateescape") for w in own.words(text) if w not in known]
                words += here
                counts.append(len(here))
            rows = pa.array(np.repeat(np.arange(len(counts)), counts))
            pos = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts) if words else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(pos.astype("i4")), pa.array(words, pa.binary())],
                names=["doc_id", "text_key", "pos", "word"])

    return run


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, for the shuffle that brings them together with their other words' ids; compressed text
    is smaller than compressed ids."""
    press = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([press(t) for t in batch.column(2).to_pylist()], pa.binary())],
            names=["doc_id", "text_key", "text"])


#: What a caller can have for each document, with its type.
OUTPUTS = {"ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


def fill(holed: list[bytes], rare: list[bytes], dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, the words' ids in `rare` put into the holes in order, and where each text ends."""
    ids = np.frombuffer(b"".join(holed), dtype)
    ends = np.cumsum([len(x) for x in holed], dtype=np.int64) // ids.itemsize
    holes = ids == np.iinfo(dtype).max
    wide = np.ones(len(ids), np.int64)
    wide[holes] = [len(x) // ids.itemsize for x in rare]
    out = np.repeat(ids, wide)
    out[np.repeat(holes, wide)] = np.frombuffer(b"".join(rare), dtype)
    return out, np.r_[0, np.cumsum(wide)][ends]


def named_pieces(ids: np.ndarray, table: pa.Table) -> pa.ChunkedArray:
    """Pieces of ids in order: rows (pos, id) joined with the id-to-piece table (id, piece)."""
    at = pa.table({"pos": pa.array(np.arange(len(ids), dtype="i4")), "id": pa.array(ids)})
    joined = at.join(table, "id", join_type="inner", use_threads=False)
    return joined.column("piece").take(pc.sort_indices(joined.column("pos")))


def _assemble(spec, head, outputs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(spec.value)
        dtype = id_type(own)[0]
        names = own.pieces()
        number = pa.array(np.arange(len(names)).astype(dtype))
        pieces = pa.table({"id": number, "piece": pa.array(names, pa.large_string())})
        decimals = pa.array([str(i) for i in range(len(names))], pa.large_string())
        expand = zstandard.ZstdDecompressor().decompress
        known = Holes(_known(head), np.full(1, np.iinfo(dtype).max, dtype).tobytes()).__getitem__
        for batch in batches:
            for start in range(0, batch.num_rows, 128):  # bounds the ids held at once, whatever the batch
                part = batch.slice(start, 128)
                rare = [x["ids"] for words in part.column(3).to_pylist() for x in words or ()]
                holed = [b"".join(map(known, own.words(expand(x).decode()))) for x in part.column(2).to_pylist()]
                ids, ends = fill(holed, rare, dtype)
                offsets = pa.array(np.r_[0, ends], pa.int64())

                def joined(column):
                    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
                    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, column), pa.scalar(" ", pa.large_string()))

                made = {}
                if "ids" in outputs:
                    made["ids"] = pa.LargeListArray.from_arrays(offsets, pa.array(ids.astype("<i4"))).cast(pa.list_(pa.int32()))
                if "n_tokens" in outputs:
                    made["n_tokens"] = pa.array(np.diff(np.r_[0, ends]), pa.int64())
                if "ids_sha256" in outputs:
                    made["ids_sha256"] = _digests(joined(decimals.take(pa.array(ids))))
                if "decoded" in outputs or "decoded_sha256" in outputs:
                    text = joined(named_pieces(ids, pieces))
                    made["decoded"], made["decoded_sha256"] = text.cast(pa.string()), _digests(text)
                yield pa.RecordBatch.from_arrays([part.column(0), *[made[c] for c in outputs]], names=["doc_id", *outputs])

    return run


def _digests(column) -> pa.Array:
    return pa.array([hashlib.sha256(x.as_buffer() if x.as_buffer() else b"").hexdigest() for x in column], pa.string())


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and text; text_key tells texts of one id apart and is 0 for an id that stands once.

    Zeros take no room in shuffles, where eight random bytes a word would. The repeated ids are broadcast up to REPEATED of
    them; beyond that every row has the hash of its text, with the same results.
    """
    source = texts(docs)
    repeated = durable(source.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    own = F.xxhash64("text")
    if repeated.count() <= REPEATED:
        source = source.join(F.broadcast(repeated.withColumn("again", F.lit(True))), "doc_id", "left")
        own = F.when(F.col("again"), own).otherwise(F.lit(0).cast("long"))
    return source.select("doc_id", own.alias("text_key"), "text")


def encode(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("ids",), head_docs: int = HEAD_DOCS,
           head_words: int = HEAD_WORDS) -> DataFrame:
    """Token ids of whole texts: doc_id and the chosen OUTPUTS, a row for each input row.

    The result is that of the tokenizer's encode without added special tokens, padding or truncation; a special token
    spelled out in a text is that token. `decoded` is its decode with special tokens.

    Null and empty texts have no tokens and decode to an empty text. A null doc_id stays null. Repeated rows get equal
    results. Texts of any length are taken whole, also those without white space; a worker holds 128 at a time. An empty
    table gives no rows; columns other than doc_id and text are ignored. `head_docs` and `head_words` bound the broadcast
    table and change nothing in the result.
    """
    sc = docs.sparkSession.sparkContext
    spec = sc.broadcast(read_spec(path))
    source = _keyed(docs)
    head = sc.broadcast(frequent_words(source, spec, head_docs, head_words))
    rare = source.mapInArrow(_rare(spec, head), "doc_id long, text_key long, pos int, word binary")
    # A short word that many documents hold is in the broadcast table, so its rows make up no large part of what is left.
    grouped = encode_words(rare, spec).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("pos", "ids"))).alias("rare"))
    small = (source.select("doc_id", "text_key", F.col("text").cast("binary"))
             .mapInArrow(_shrink, "doc_id long, text_key long, text binary"))
    joined = small.join(grouped.hint("shuffle_hash"), ["doc_id", "text_key"], "left").select("doc_id", "text_key", "text", "rare")
    schema = ", ".join(["doc_id long", *[f"{c} {OUTPUTS[c]}" for c in outputs]])
    return joined.mapInArrow(_assemble(spec, head, outputs), schema).withColumn("doc_id", public_id())


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Texts of rows (key, ids) through a join of positions with the id-to-piece table: key, decoded.

    The vocabulary has a fixed size, so its table is broadcast. Keys must be unique; null or empty ids give an empty text.
    """
    spark = encoded.sparkSession
    table = WordCoder(read_spec(path)).pieces()
    pieces = spark.createDataFrame(list(enumerate(table)), "id int, piece string")
    at = encoded.select(key, F.posexplode("ids").alias("pos", "id"))
    named = at.join(F.broadcast(pieces), "id").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("p"))
    text = named.select(F.col(key).alias("_key"), F.array_join("p.piece", " ").alias("decoded"))
    return (encoded.select(key).join(text, F.col(key).eqNullSafe(F.col("_key")), "left")
            .select(key, F.coalesce("decoded", F.lit("")).alias("decoded")))
