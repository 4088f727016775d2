"""Weighted rendezvous sharding of stable record keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import lookup_join, materialize

#: Seed of the hash; another value gives another, equally good, placement.
SEED = 7


def rendezvous(key: Column, weights: list[float], seed: int = SEED) -> Column:
    """The shard (position in ``weights``) that ``key`` belongs to.

    Every shard draws u in (0, 1) from a hash of the key and the shard's number and
    waits ``-ln(u) / weight``; the shortest wait wins. The draw of a shard does not
    depend on the others, so a further shard takes keys only into itself, and each
    shard gets keys in proportion to its weight. A shard of weight 0 gets none. Null
    is a key of its own. Ties go to the smaller number.
    """
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must not be negative, and one must be positive")
    text = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))
    waits = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(shard), text), 11)
            wait = -F.log((bits.cast("double") + 0.5) / float(1 << 53)) / float(weight)
            waits.append(F.struct(wait.alias("wait"), F.lit(shard).alias("shard")))
    best = F.least(*waits) if len(waits) > 1 else waits[0]
    return best["shard"].cast("int")


def number_slots(df: DataFrame, group: str, slot: str = "slot") -> DataFrame:
    """Number the rows of every ``group`` (not null) from 0 without gaps.

    The rows are materialised once together with the number of the task that wrote
    them. Counts by (group, task) give each task's part of a group its first number,
    and a window over (group, task) does the rest, so a window holds what one task
    wrote at most, however large a group grows or often a key repeats. The first
    numbers are broadcast after a count, or else joined by (group, task).
    """
    rows = materialize(df.withColumn("__block", F.spark_partition_id()), "slots")
    counts = rows.groupBy(group, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    first = materialize(counts.select(group, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first")), "firsts")
    inside = Window.partitionBy(group, "__block").orderBy(*[F.col(c) for c in df.columns])
    ranked = rows.withColumn("__rank", F.row_number().over(inside) - 1)
    joined = lookup_join(ranked, first, [group, "__block"], "inner", salts=1)
    return joined.select(*df.columns, (F.col("__rank") + F.col("__first")).cast("long").alias(slot))


def shard_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8, weights: list[float] | None = None, seed: int = SEED
) -> DataFrame:
    """Shard, slot and size of every row; native functions only.

    Returns the key, ``size`` (UTF-8 bytes of the text, null: none, plus 1),
    ``text_crc32`` (null text: 0), ``law`` ("key"), ``shard``, ``slot`` (gapless in
    the shard) and ``grown_shard``, the shard with one more shard of mean weight.
    Rows that repeat, with equal or null keys, share a shard and get slots of their
    own; a text's length is bounded by nothing here. An empty table gives an empty
    result. Other columns, whatever their names, are not read.
    """
    weights = weights or [1.0] * shards
    if len(weights) != shards:
        raise ValueError("one weight for each shard")
    grown = [*weights, sum(weights) / len(weights)]
    body = F.coalesce(F.col(text), F.lit(""))
    placed = docs.select(
        F.col(key),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), weights, seed).alias("shard"),
        rendezvous(F.col(key), grown, seed).alias("grown_shard"),
    )
    numbered = number_slots(placed, "shard", "slot")
    return numbered.select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
