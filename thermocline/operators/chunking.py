"""Measurements grouped into nested per-timestamp profile documents."""

from pyspark.sql import Column, DataFrame, functions as F

from thermocline.functions.rendering import (
    LIST_TITLE, measurement_line_length, preview_text, profile_header, profile_text, timestamp_text)
from thermocline.operators.numbering import add_group_offset, add_preceding_sum, add_running_sum
from thermocline.operators.stats import upper_median
from thermocline.schema import (
    CHARS_PER_MEASUREMENT, CHUNK_ID_PREFIX, CHUNK_SIZE_LIMIT, CHUNK_SOURCE, CHUNK_TYPE,
    MEASUREMENT_FIELDS, PROFILE_COLUMNS, SPLIT_CHUNK_TYPE)
from thermocline.session import durable

HOT_ROWS = 100_000
FEW_KEYS = 100_000
_BLOCK_PARTS = 10_000
_META = ["basin", "cycle_number", "vertical_sampling_scheme", "longitude", "latitude"]


def part_size(limit: int) -> int:
    """Measurements per part of a chunk whose text exceeds ``limit``."""
    return max(1, limit // CHARS_PER_MEASUREMENT - 10)


def _text_length(n: Column, body: Column, header: Column) -> Column:
    # One line break per line; numbers from 1000 on outgrow their three-digit field.
    digits = sum((F.greatest(n - (10 ** d - 1), F.lit(0)) for d in range(3, 12)), F.lit(0))
    return F.length(header) + len(LIST_TITLE) + body + n + digits


def group_facts(rows: DataFrame, keys=("timestamp",), limit: int = CHUNK_SIZE_LIMIT) -> DataFrame:
    """One row per group: size, first-row metadata, part count. Partial aggregation only."""
    facts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(measurement_line_length(*map(F.col, MEASUREMENT_FIELDS))).alias("body"),
        F.min(F.struct(*MEASUREMENT_FIELDS, *_META)).alias("first"))
    meta = F.struct(timestamp_text(F.col(keys[0])).alias("timestamp"),
                    *[F.col("first")[c].alias(c) for c in _META])
    length = _text_length(F.col("n"), F.col("body"), profile_header(meta, F.col("n")))
    per_part = part_size(limit)
    return (facts.select(*keys, "n", meta.alias("meta"), (length > limit).alias("split"))
            .withColumn("parts", F.when(F.col("split"), F.ceil(F.col("n") / per_part)).otherwise(F.lit(1)).cast("long")))


def _collected_parts(rows: DataFrame, facts: DataFrame, keys, per_part: int) -> DataFrame:
    """Parts of groups small enough to hold as one row: a single shuffle of the measurements."""
    lists = rows.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(*MEASUREMENT_FIELDS))).alias("all"))
    others = [c for c in facts.columns if c not in keys]
    step = F.when(F.col("split"), F.lit(per_part)).otherwise(F.greatest(F.size("all"), F.lit(1)))
    # Cut before the parts become rows, so that no part carries its whole group along.
    cut = F.expr("transform(sequence(0, size(all) - 1, step), at -> slice(all, at + 1, step))")
    return (lists.join(facts, list(keys)).withColumn("step", step).select(*keys, *others, cut.alias("cut"))
            .select(*keys, *others, F.posexplode("cut").alias("part", "measurements"))
            .select(*keys, "part", "measurements", *others))


def _spread_parts(rows: DataFrame, facts: DataFrame, keys, per_part: int) -> DataFrame:
    """Parts of groups of any size. No task holds a whole group: copies are counted first, positions
    come from a range-partitioned running count, and each part gathers its own few measurements."""
    copies = rows.groupBy(*keys, *MEASUREMENT_FIELDS).agg(F.count(F.lit(1)).alias("copies"))
    placed = add_group_offset(copies, list(keys), MEASUREMENT_FIELDS, "copies", "start")
    first = F.floor(F.col("start") / per_part).cast("long")
    last = F.floor((F.col("start") + F.col("copies") - 1) / per_part).cast("long")
    blocks = (placed.withColumns({"first": first, "last": last})
              .withColumn("block", F.explode(F.expr(f"sequence(first, last, {_BLOCK_PARTS}L)"))))
    block_end = F.least(F.col("block") + (_BLOCK_PARTS - 1), F.col("last"))
    pieces = (blocks.withColumn("block_end", block_end).repartition(*keys, "block")
              .withColumn("part", F.explode(F.sequence("block", "block_end"))))
    low = F.greatest(F.col("start"), F.col("part") * per_part)
    high = F.least(F.col("start") + F.col("copies"), (F.col("part") + 1) * per_part)
    measurement = F.struct(*MEASUREMENT_FIELDS)
    lists = (pieces.withColumn("here", F.array_repeat(measurement, (high - low).cast("int")))
             .groupBy(*keys, "part").agg(F.sort_array(F.flatten(F.collect_list("here"))).alias("measurements")))
    return lists.withColumn("part", F.col("part").cast("int")).join(facts, list(keys))


def chunk_profiles(profiles: DataFrame, limit: int = CHUNK_SIZE_LIMIT, keys=("timestamp",),
                   hot_rows: int = HOT_ROWS, few_keys: int = FEW_KEYS) -> DataFrame:
    """One nested document per key group, split into parts where its text exceeds ``limit``.

    Ids number the documents in key order, parts included. Metadata comes from the first
    measurement by pressure, then by every other column.

    Groups beyond ``hot_rows`` are never held whole. Up to ``few_keys`` groups are numbered in one
    small window and their facts broadcast; beyond that both are distributed.
    """
    keys = list(keys)
    rows = profiles.select(PROFILE_COLUMNS).dropna(subset=keys)
    per_part = part_size(limit)
    stored = durable(group_facts(rows, keys, limit))
    # An unsplit group is bounded by the text limit, so only split groups can be too large.
    sizes = stored.agg(F.count(F.lit(1)).alias("keys"),
                       F.max(F.when(F.col("split"), F.col("n"))).alias("largest")).first()
    few = sizes["keys"] <= few_keys
    number = add_running_sum if few else add_preceding_sum
    facts = number(stored, keys, "parts", "chunks_before")

    def joined(df):
        return F.broadcast(df) if few else df

    if (sizes["largest"] or 0) <= hot_rows:
        parts = _collected_parts(rows, joined(facts), keys, per_part)
    else:
        hot = durable(facts.filter(F.col("split") & (F.col("n") > hot_rows)))
        marks = joined(hot.select(keys))
        parts = (_collected_parts(rows.join(marks, keys, "left_anti"), joined(facts), keys, per_part)
                 .unionByName(_spread_parts(rows.join(marks, keys, "left_semi"), joined(hot), keys, per_part)))
    return _documents(parts, keys, per_part)


def _documents(parts: DataFrame, keys, per_part: int) -> DataFrame:
    size = F.size("measurements")
    part, split = F.col("part"), F.col("split")
    at = part.cast("long") * per_part
    # Fixed text formats.
    base = F.concat(F.lit(CHUNK_ID_PREFIX), _zero_pad(F.col("chunks_before"), 6))
    info = F.concat(F.lit("Part "), (part + 1).cast("string"), F.lit(", depths "),
                    (at + 1).cast("string"), F.lit("-"), (at + size).cast("string"))
    meta = F.struct(
        F.col("meta.timestamp").alias("timestamp"),
        *[F.col("meta")[c].alias(c) for c in _META],
        size.alias("profile_count"),
        F.when(split, info).alias("sub_chunk_info"))
    return parts.select(
        F.when(split, F.concat(base, F.lit("_part_"), _zero_pad(part, 2))).otherwise(base).alias("chunk_id"),
        (F.col("chunks_before") + part).alias("chunk_number"),
        F.col(keys[0]).alias("observed_at"),
        F.col("meta.timestamp").alias("timestamp"),
        meta.alias("metadata"),
        "measurements",
        F.lit(CHUNK_SOURCE).alias("source"),
        F.when(split, SPLIT_CHUNK_TYPE).otherwise(CHUNK_TYPE).alias("chunk_type"))


def _zero_pad(number: Column, width: int) -> Column:
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def with_text(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("text", profile_text(F.col("metadata"), F.col("measurements")))


def with_preview(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("text", preview_text(F.col("metadata"), F.col("measurements")))


def explode_measurements(chunks: DataFrame) -> DataFrame:
    """One flat row per measurement."""
    return (chunks.select("chunk_id", "timestamp", "metadata.latitude", "metadata.longitude",
                          "metadata.basin", "metadata.cycle_number", F.explode("measurements").alias("m"))
            .select("chunk_id", "timestamp", "latitude", "longitude", "basin", "cycle_number", "m.*"))


def chunk_statistics(chunks: DataFrame, limit: int = CHUNK_SIZE_LIMIT) -> DataFrame:
    """Counts, text lengths and measurements per chunk, in one row.

    Everything is derived from the number of chunks per (type, text length, size), which is small.
    """
    sizes = (with_text(chunks)
             .groupBy("chunk_type", F.length("text").alias("text_length"),
                      F.size("measurements").alias("size"))
             .agg(F.count(F.lit(1)).alias("n")))
    n, length, size = F.col("n"), F.col("text_length"), F.col("size")
    median = upper_median(sizes, "text_length", weight="n")
    total = F.sum(n)
    return sizes.agg(
        total.alias("total_chunks"),
        F.min(length).alias("text_min"), F.max(length).alias("text_max"),
        (F.sum(length * n) / total).alias("text_mean"),
        F.min(size).alias("measurements_min"), F.max(size).alias("measurements_max"),
        (F.sum(size * n) / total).alias("measurements_mean"),
        F.sum(size * n).alias("measurements_total"),
        F.sum(F.when(F.col("chunk_type") == CHUNK_TYPE, n).otherwise(0)).alias("whole_chunks"),
        F.sum(F.when(F.col("chunk_type") == SPLIT_CHUNK_TYPE, n).otherwise(0)).alias("split_chunks"),
        F.sum(F.when(length > limit, n).otherwise(0)).alias("oversized_chunks"),
    ).withColumn("text_median_upper", median.scalar())
