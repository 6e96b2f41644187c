"""Document fingerprints: a homomorphic multiset hash over paragraphs, in DataFrame functions only.

A paragraph (a line) is hashed into a wide vector: WIDE lanes of 32 uniform bits, and SKETCH lanes that count, over
the paragraph's word shingles, how often a hash bit is set. A document's vector is the sum over its paragraphs, every
lane modulo 2^32, so the order of paragraphs does not matter and paragraphs can be added or taken out later. Equal
multisets have equal vectors; and since each sketch lane is a sum of random signs, the squared distance of two
sketches estimates in how many shingles two documents differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from thermocline.llm.common import SPACE_CLASS, partitions, public_id, texts
from thermocline.session import durable

#: Uniform lanes, two from each seeded hash; sketch lanes, one for each bit of a shingle's hash; words of a shingle.
WIDE, SKETCH, SHINGLE = 16, 64, 3
_LOW = 0xFFFFFFFF
_PAIR = 0x0000000100000001
_WIDE_COLUMNS = [f"wide_{i}" for i in range(WIDE)]
#: Lanes i and i + 32 of the sketch share one long.
_SKETCH_COLUMNS = [f"sketch_{i}" for i in range(SKETCH // 2)]
SUMS = [*_WIDE_COLUMNS, *_SKETCH_COLUMNS, "n_shingles"]


def paragraph_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of the vectors of all lines of `text`, for each combination of the key columns."""
    lines = rows.select(*keys, F.explode(F.split("text", "\n", -1)).alias("line"))
    words = lines.withColumn("words", F.split("line", f"[{SPACE_CLASS}]+", -1))
    heads = F.slice("words", 1, F.greatest(F.size("words") - (SHINGLE - 1), F.lit(1)))
    shingles = F.transform(heads, lambda w, i: F.xxhash64(w, *[F.get("words", i + k) for k in range(1, SHINGLE)]))
    hashed = words.select(*keys, "line", F.posexplode(shingles).alias("at", "h"))
    sums = []
    for i in range(WIDE):
        seeded = F.xxhash64(F.lit(i // 2), "line")
        lane = seeded.bitwiseAND(F.lit(_LOW)) if i % 2 == 0 else F.shiftrightunsigned(seeded, 32)
        sums.append(F.sum(F.when(F.col("at") == 0, lane).otherwise(0)).alias(_WIDE_COLUMNS[i]))
    for i in range(SKETCH // 2):
        sums.append(F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(_PAIR))).alias(_SKETCH_COLUMNS[i]))
    return hashed.groupBy(*keys).agg(*sums, F.count("*").alias("n_shingles"))


def combine(sums: DataFrame, keys: list[str], sign: str | None = None, suffix: str = "") -> DataFrame:
    """Add up rows of sums that share the keys; a `sign` column of 1, 0 or -1 adds, ignores or takes out a row.

    This is insertion and deletion: the sums of a document's paragraphs plus those of new ones minus those of old.
    """
    weight = F.col(sign) if sign else F.lit(1)
    return sums.groupBy(*keys).agg(*[F.sum(F.col(c) * weight).alias(c + suffix) for c in SUMS])


def _mod(column: Column) -> Column:
    return F.pmod(column, F.lit(_LOW + 1))


def vector(suffix: str = "") -> Column:
    """The lanes of sum columns as an array of longs: WIDE / 2 packed pairs, SKETCH / 2 packed pairs, shingle count."""
    wide = [F.shiftleft(_mod(F.col(f"wide_{i + 1}{suffix}")), 32).bitwiseOR(_mod(F.col(f"wide_{i}{suffix}")))
            for i in range(0, WIDE, 2)]
    return F.array(*wide, *[F.col(c + suffix) for c in _SKETCH_COLUMNS], F.col("n_shingles" + suffix))


def as_text(lanes: Column) -> Column:
    """A vector in lowercase hex digits."""
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two vectors from 0 to 1: an estimate of 2 x·y / (x·x + y·y) over the shingles' multisets."""

    def lanes(v):
        """(low lane, high lane) of each packed pair, as sums of signs."""
        n = v[WIDE // 2 + SKETCH // 2]
        return F.transform(F.slice(v, WIDE // 2 + 1, SKETCH // 2), lambda p: F.struct(
            (p.bitwiseAND(F.lit(_LOW)) * 2 - n).cast("double").alias("low"),
            (F.shiftrightunsigned(p, 32) * 2 - n).cast("double").alias("high")))

    def term(x, y):
        low, high = x["low"] - y["low"], x["high"] - y["high"]
        return F.struct((low * low + high * high).alias("apart"),
                        (x["low"] * x["low"] + x["high"] * x["high"] + y["low"] * y["low"] + y["high"] * y["high"]).alias("weight"))

    def ratio(total):
        return F.when(total["weight"] == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - total["apart"] / total["weight"]))

    zero = F.struct(F.lit(0.0).alias("apart"), F.lit(0.0).alias("weight"))
    total = F.aggregate(F.zip_with(lanes(a), lanes(b), term), zero, lambda t, x: F.struct(
        (t["apart"] + x["apart"]).alias("apart"), (t["weight"] + x["weight"]).alias("weight")), ratio)
    return F.when(a == b, 1.0).otherwise(total)


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, vector and fingerprint text of every row's whole text; nothing but sums is shuffled.

    Null or empty text: the vector of one empty paragraph. A null doc_id is one id. Rows that share id and text have
    their results once. An empty table gives no rows; columns other than doc_id and text are ignored.
    """
    source = texts(docs).withColumn("text_key", F.xxhash64("text")).dropDuplicates(["doc_id", "text_key"])
    sums = paragraph_sums(source, ["doc_id", "text_key"])
    return sums.select(public_id().alias("doc_id"), vector().alias("vector")).withColumn("fingerprint", as_text(F.col("vector")))


def _neighbours(source: DataFrame) -> DataFrame:
    """For each distinct (doc_id, text_key): the next row and the one before in ascending order, in a ring.

    Rows are range-partitioned; a window inside each range finds neighbours, and one row for each range links the ends.
    """
    n = partitions(source.sparkSession)
    ranged = durable(source.select("doc_id", "text_key", F.length("text").alias("n")).distinct()
                     .repartitionByRange(n, "doc_id", "text_key").withColumn("part", F.spark_partition_id()))
    here, w = F.struct("doc_id", "text_key", "n"), W.partitionBy("part").orderBy("doc_id", "text_key")
    inner = ranged.withColumn("next", F.lead(here).over(w)).withColumn("prev", F.lag(here).over(w))
    ends = ranged.groupBy("part").agg(F.min(here).alias("first"), F.max(here).alias("last"))
    ring = W.orderBy("part")  # one row for each partition, whatever the corpus
    whole = ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lead("first").over(ring), F.first("first").over(whole)).alias("after"),
                       F.coalesce(F.lag("last").over(ring), F.last("last").over(whole)).alias("ahead"))
    linked = inner.join(F.broadcast(ends), "part")
    after, ahead = F.coalesce("next", "after"), F.coalesce("prev", "ahead")
    return linked.select("doc_id", "text_key", after["doc_id"].alias("next_id"), after["text_key"].alias("next_key"),
                         ahead["doc_id"].alias("prev_id"), ahead["text_key"].alias("prev_key"),
                         F.floor(ahead["n"] / 4).cast("int").alias("give"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses.

    The edit replaces the last floor(n_chars / 4) code points by as many (or all) from the start of the next document
    in ascending doc_id; after the last comes the first. The edited fingerprint is made by deletion and insertion: the
    lines that end before the edit are summed once, then the old or the new rest is added.

    Returns for each distinct row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next. Null text: empty. A null doc_id comes first in the order. Identical rows are one document; rows that
    share an id and not the text are ordered by a hash of the text. A table of one document is its own next. An empty
    table gives no rows; other columns are ignored.
    """
    key, n = ["doc_id", "text_key"], partitions(docs.sparkSession)
    source = texts(docs).withColumn("text_key", F.xxhash64("text"))
    links = _neighbours(source)
    # Texts are dealt once; every later join and sum uses that dealing.
    placed = source.repartition(n, *key).distinct().join(links.hint("shuffle_hash"), key)
    gifts = placed.select(F.col("prev_id").alias("doc_id"), F.col("prev_key").alias("text_key"),
                          F.expr("substring(text, 1, give)").alias("gift"))
    size = F.length("text")
    both = placed.join(gifts, key).withColumn("n_chars", size.cast("long")).withColumn(
        "head", F.expr("substring(text, 1, length(text) - length(text) div 4)"))
    both = both.withColumn("edited", F.concat("head", "gift")).withColumn(
        "cut", F.length("head") - F.length(F.substring_index("head", "\n", -1)))
    parts = F.array(
        F.struct(F.lit(0).alias("part"), F.expr("CASE WHEN cut > 0 THEN substring(text, 1, cut - 1) END").alias("text")),
        F.struct(F.lit(1).alias("part"), F.expr("substring(text, cut + 1)").alias("text")),
        F.struct(F.lit(2).alias("part"), F.expr("substring(edited, cut + 1)").alias("text")))
    carried = [*key, "next_id", "next_key", "n_chars", "edited_sha"]
    pieces = (both.withColumn("edited_sha", F.unhex(F.sha2(F.col("edited").cast("binary"), 256)))
              .select(*carried, F.explode(parts).alias("piece")).select(*carried, "piece.part", "piece.text")
              .where("text IS NOT NULL"))
    sums = paragraph_sums(pieces, [*carried, "part"])
    own = [F.sum(F.when(F.col("part") < 2, F.col(c)).otherwise(0)).alias(c) for c in SUMS]
    new = [F.sum(F.when(F.col("part") != 1, F.col(c)).otherwise(0)).alias(f"{c}_new") for c in SUMS]
    table = durable(sums.groupBy(*carried).agg(*own, *new)
                    .select(*carried, vector().alias("vector"), vector("_new").alias("edited_vector")))
    following = table.select(F.col("doc_id").alias("next_id"), F.col("text_key").alias("next_key"),
                             F.col("vector").alias("next_vector"))
    out = table.join(following, ["next_id", "next_key"])
    return out.select(
        public_id().alias("doc_id"), "n_chars", F.lower(F.hex("edited_sha")).alias("edited_sha256"),
        as_text(F.col("vector")).alias("fingerprint"), as_text(F.col("edited_vector")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"),
        likeness(F.col("vector"), F.col("next_vector")).alias("near_next"))
