"""Sharding: a keyed permutation of global row numbers gives every row its shard and slot.

Rows are numbered without gaps in the order of the given keys (one range shuffle, then an
offset per partition). The number goes through a Feistel network over a * b >= n values; a
result of n or more goes through it again until it falls below n (cycle walking), so the
network permutes 0 .. n-1. Permuted number p lies in shard p mod k at slot p div k: shard sizes
differ by one row at most, and both can be computed for any row number without the table.

Nulls count as the smallest key; equal rows get different numbers, and which of them gets
which is open, as they are equal. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, cut_wide, fresh, table

SHARDS = 8
SEED = 20240607
ROUNDS = 6


def domain(n: int) -> tuple[int, int]:
    """The two sides of the network: a * b >= n, with less than a values too many."""
    a = max(1, math.isqrt(n))
    return a, -(-n // a) if n else 1


def feistel(x: Column, a: int, b: int, seed: int, rounds: int = ROUNDS) -> Column:
    left, right = x % F.lit(a), F.floor(x / F.lit(a)).cast("long")
    right = (x - left) / F.lit(a)
    right = right.cast("long")
    for i in range(rounds):
        if i % 2 == 0:
            left = (left + F.pmod(F.xxhash64(right, F.lit(seed + i).cast("long")), F.lit(a).cast("long"))) % F.lit(a)
        else:
            right = (right + F.pmod(F.xxhash64(left, F.lit(seed + i).cast("long")), F.lit(b).cast("long"))) % F.lit(b)
    return left + right * F.lit(a)


def walks(n: int) -> int:
    """Steps that end every walk: all values too many, or so many that 1 in 10^40 walks is longer."""
    a, b = domain(n)
    over = a * b - n
    if over == 0 or n <= 1:
        return 0
    return min(over, math.ceil(40 / math.log10(a * b / over)))


def permuted(x: Column, n: int, seed: int) -> Column:
    """x of 0 .. n-1 under the permutation."""
    a, b = domain(n)
    first = feistel(x, a, b, seed)
    if not (steps := walks(n)):
        return first
    again = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, lambda at, _: F.when(at < n, at).otherwise(feistel(at, a, b, seed)))
    return F.when(first < n, first).otherwise(again)


def numbered(df: DataFrame, order: list[str], number: str, wide: bool = False) -> tuple[DataFrame, int]:
    """df with the column `number`, 0 .. n-1 in the order of the columns; and n.

    The sorted rows are written once, so that a lost executor can't renumber them.
    """
    at = fresh(df, "_at")
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    rows = (cut_wide if wide else cut)(rows)
    part, start, many = fresh(rows, "_part"), fresh(rows, "_start"), fresh(rows, "_many")
    rows = rows.withColumn(part, F.shiftright(at, 33))
    counts = rows.groupBy(part).agg(F.count("*").alias(many))
    sizes = sorted((r[0], r[1]) for r in counts.collect())  # a row for each partition, whatever the rows
    starts, n = [], 0
    for p, m in sizes:
        starts.append((p, n))
        n += m
    offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], T.StructType([T.StructField(part, T.LongType()), T.StructField(start, T.LongType())]))
    rows = rows.join(F.broadcast(offsets), part).withColumn(number, F.col(start) + F.col(at).bitwiseAND(F.lit(2**33 - 1)))
    return rows.select(*df.columns, number), n


def shard_rows(df: DataFrame, order: list[str], shards: int = SHARDS, seed: int = SEED, wide: bool = False) -> DataFrame:
    """df with shard (int) and slot (long); a column of the same name is replaced."""
    df = df.drop("shard", "slot")
    number = fresh(df, "_row")
    rows, n = numbered(df, order, number, wide)
    to = fresh(rows, "_to")
    rows = rows.withColumn(to, permuted(F.col(number), n, seed))
    slot = (F.col(to) - F.col(to) % shards) / F.lit(shards)
    return rows.select(*df.columns, (F.col(to) % shards).cast("int").alias("shard"), slot.cast("long").alias("slot"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shard_rows(docs, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
