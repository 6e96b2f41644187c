"""Mixing sources to target weights: temperature weights by bisection, drawn as budgeted permutations of blocks.

DataFrame functions only. The driver sees sums over sources, never the sources themselves.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from thermocline.llm.common import NO_ID, SPACE_CLASS, public_id
from thermocline.session import durable

#: Tokens that a block aims at, and the most blocks of a source; blocks of larger sources grow instead.
BLOCK_TOKENS, MOST_BLOCKS = 1 << 20, 65_536
#: Size up to which the plan of all sources is broadcast, and the parts of a source beyond it.
BROADCAST_BYTES, SALTS = 16 << 20, 64
#: Exponents tried in one pass over the sources; a pass is worth this many halvings of the interval.
_HALVINGS, _PASSES = 4, 8


def token_counts(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, source and n_tokens (words and one end mark) of each distinct row; null is a source too."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+"))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
                         F.xxhash64(text).alias("text_key"), F.col("source").cast("string").alias("source"),
                         (words + 1).cast("long").alias("n_tokens"))
    # A null source has no "=" before its name, so that it meets no source of the same spelling.
    return rows.distinct().withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))


def temperature(sources: DataFrame, target_entropy: float | None, max_repeat: float | None, budget: int | None) -> dict:
    """Exponent between 0 (equal weights) and 1 (shares as they are), with what the weights need.

    `sources` has key and tokens. The exponent falls from 1 until the entropy of the weights reaches `target_entropy`
    (a part of the logarithm of the number of sources), but not so far that a document would be drawn more often than
    `max_repeat`. Without a `budget`, the budget is the least that draws every source once in full.
    Every pass evaluates the ends of 2^_HALVINGS equal parts of the interval at once.
    """
    total, count = sources.agg(F.sum("tokens").cast("double"), F.count("*")).first()
    share = F.col("tokens") / F.lit(total)

    def measure(exponents):
        columns = []
        for i, x in enumerate(exponents):
            power = F.pow(share, F.lit(float(x)))
            pull = F.pow(share, F.lit(float(x) - 1))
            columns += [F.sum(power).alias(f"z{i}"), F.sum(power * F.log(share)).alias(f"s{i}"),
                        F.max(pull).alias(f"hi{i}"), F.min(pull).alias(f"lo{i}")]
        row = sources.agg(*columns).first()
        out = []
        for i, x in enumerate(exponents):
            z, s, hi, lo = (row[f"{k}{i}"] for k in ("z", "s", "hi", "lo"))
            entropy = math.log(z) - x * s / z
            repeat = hi / lo if budget is None else budget * hi / (total * z)
            out.append((entropy, repeat, z, lo))
        return out

    goal = None if target_entropy is None else target_entropy * math.log(max(count, 1))

    def too_flat(entropy, repeat):
        """A larger exponent is wanted."""
        return (goal is not None and entropy > goal) or (max_repeat is not None and repeat > max_repeat)

    low, high = 0.0, 1.0
    ends = measure([low, high])
    if not too_flat(*ends[0][:2]):
        high = low
    elif too_flat(*ends[1][:2]):
        low = high
    for _ in range(_PASSES if low < high else 0):
        steps = 2 ** _HALVINGS
        grid = [low + (high - low) * i / steps for i in range(1, steps)]
        flat = [too_flat(*m[:2]) for m in measure(grid)]
        k = flat.index(False) if False in flat else len(grid)
        low, high = (grid[k - 1] if k else low), (grid[k] if k < len(grid) else high)
    entropy, repeat, z, lo = measure([high])[0]
    return {"exponent": high, "norm": z, "total": total, "entropy": entropy, "repeat": repeat,
            "budget": float(budget) if budget is not None else total * z / lo if lo else total}


def draw(docs: DataFrame, target_entropy: float | None = None, max_repeat: float | None = 4.0,
         budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 17) -> DataFrame:
    """Documents drawn so that sources get temperature weights of a token budget.

    Returns a row for each draw: doc_id, text_key (xxhash64 of the text), source, n_tokens, draw (0 for the first pass
    over a source, 1 for the second), block and position (0 to 1, where the block lies in the mixture; ordering by it
    interleaves the sources in proportion at every prefix).

    Each source is cut by hash into blocks of about `block_tokens`. Every pass over a source is its own permutation of
    blocks; the last pass stops at the budget, inside one block, where documents follow a hash. A source never gets
    more than its share of the budget and less only by the document that would not fit.

    Null or empty text has one token, its end mark. Null is a source of its own and a null doc_id an id of its own.
    Identical rows count once. Ties between equal hashes fall to doc_id. An empty table gives no rows; columns other
    than doc_id, text and source are ignored.
    """
    rows = durable(token_counts(docs))
    sources = durable(rows.groupBy("key").agg(F.sum("n_tokens").alias("tokens")))
    if sources.isEmpty():
        return _shape(rows.select("*", F.lit(0).alias("draw"), F.lit(0).alias("block"), F.lit(0.0).alias("position")))
    fit = temperature(sources, target_entropy, max_repeat, budget)
    weight = F.pow(F.col("tokens") / F.lit(fit["total"]), F.lit(fit["exponent"])) / F.lit(fit["norm"])
    # The budget in whole tokens; the small term keeps a pass that rounding would leave a token short.
    plan = (sources.withColumn("share", F.floor(weight * F.lit(fit["budget"]) + 1e-6))
            .withColumn("passes", F.floor(F.col("share") / F.col("tokens")).cast("int"))
            .withColumn("rest", F.col("share") - F.col("passes") * F.col("tokens"))
            .withColumn("n_blocks", F.least(F.ceil(F.col("tokens") / block_tokens), F.lit(MOST_BLOCKS)).cast("int")))
    block = F.pmod(F.xxhash64("doc_id", "text_key", F.lit(seed)), F.col("n_blocks")).cast("int")
    placed = _beside(rows, plan.select("key", "n_blocks"), sources).withColumn("block", block)
    blocks = placed.groupBy("key", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    passes = plan.withColumn("draw", F.explode(F.sequence(F.lit(0), F.col("passes"))))
    turn = W.partitionBy("key", "draw").orderBy(F.xxhash64("block", "draw", F.lit(seed)), "block")
    schedule = (blocks.join(passes, "key").withColumn("end", F.sum("block_tokens").over(turn))
                .withColumn("start", F.col("end") - F.col("block_tokens"))
                .withColumn("limit", F.when(F.col("draw") < F.col("passes"), F.col("tokens")).otherwise(F.col("rest")))
                .where("start < limit")
                .select("key", "block", "draw", (F.col("limit") - F.col("start")).alias("room"),
                        (F.col("end") > F.col("limit")).alias("cut"),
                        ((F.col("draw") * F.col("tokens") + F.col("start")) / F.col("share")).alias("position")))
    drawn = placed.join(schedule, ["key", "block"])
    inside = W.partitionBy("key").orderBy(F.xxhash64("doc_id", "text_key", "draw", F.lit(seed)), "doc_id", "text_key")
    partly = drawn.where("cut").withColumn("used", F.sum("n_tokens").over(inside)).where("used <= room").drop("used")
    return _shape(drawn.where("NOT cut").unionByName(partly))


def _beside(rows: DataFrame, plan: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with their source's plan, without dealing a source's rows to one task.

    The plan is broadcast if its names take no more than BROADCAST_BYTES, else it is repeated for each of SALTS parts of
    a source. The rows that come out are the same.
    """
    if sources.agg(F.sum(F.octet_length("key") + 64)).first()[0] <= BROADCAST_BYTES:
        return rows.join(F.broadcast(plan), "key")
    salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SALTS)).cast("int")
    return rows.withColumn("salt", salt).join(salted, ["key", "salt"]).drop("salt")


def _shape(drawn: DataFrame) -> DataFrame:
    return drawn.select(public_id().alias("doc_id"), "text_key", "source", "n_tokens", "draw", "block", "position")
