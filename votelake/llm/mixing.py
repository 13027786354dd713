"""Mixing sources to target weights by balanced sampling (cube method).

Every document of a source is to be taken target / size times on average; the whole part of
that is certain, and the fraction is an inclusion probability. The flight phase moves the
probabilities of a few documents at a time along a direction in which the weighted sums of
tokens and of documents don't change, until one is 0 or 1, and goes on with the next. Blocks
of a source fly on their own; what each leaves undecided (three documents at most) meets in
blocks of the next level, until a source has one block; that one's last documents are landed:
first without the documents' total, then by lot. So a source's tokens and documents are off
by a few documents at most, whatever its size.

All draws come from hashes of the source, the block and a seed, so reruns agree. Identical
rows (same id, source and text) share one decision and count with their number. A null text has
size 0. A source of size 0 is taken 0 times. Null sources are a source of their own, the last.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
BLOCK = 20_000
SEED = 7
EPS = 1e-9


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """source, source_size, target. sizes: source, source_size.

    With weight w the targets are least(most * size, w * level); the level at which they add up to the share lies
    between two sources in the order of their size by weight, so running sums over that order find it.
    The windows run over a row for each source.
    """
    ranked = sizes.withColumn("i", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    rows = ranked.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("at", F.col("cap") / F.col("w"))
    order = Window.orderBy("at", "i")
    total = Window.partitionBy(F.lit(0))
    rows = rows.withColumn("full", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("open", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("level", (F.sum("source_size").over(total) * F.lit(share) - F.col("full")) / F.col("open"))
    level = F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", "i", "level"))).over(total)
    return rows.withColumn("lv", level["level"]).select("source", "source_size", F.when(F.col("lv").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * F.col("lv"))).alias("target"))


def fly(p: np.ndarray, x: np.ndarray, rng: random.Random) -> None:
    """Move p in place until too few are open to keep the sums of p * x (a row for each unit)."""
    need = x.shape[1] + 1
    order = [i for i in range(len(p)) if EPS < p[i] < 1 - EPS]
    window, at = order[:need], need
    while len(window) == need:
        u = direction(x[window])
        up = min(((1 - p[i]) if d > 0 else p[i]) / abs(d) for i, d in zip(window, u) if abs(d) > EPS)
        down = min((p[i] if d > 0 else (1 - p[i])) / abs(d) for i, d in zip(window, u) if abs(d) > EPS)
        step = up if rng.random() * (up + down) < down else -down
        for i, d in zip(window, u):
            p[i] = min(1.0, max(0.0, p[i] + step * d))
        window = [i for i in window if EPS < p[i] < 1 - EPS]
        while len(window) < need and at < len(order):
            window.append(order[at])
            at += 1


def direction(x: np.ndarray) -> list[float]:
    """A vector orthogonal to the columns of x, which has one row more than columns (1 or 2)."""
    if x.shape[1] == 1:
        (a,), (b,) = x.tolist()
        u = [b, -a]
    else:
        (a, d), (b, e), (c, f) = x.tolist()
        u = [b * f - c * e, c * d - a * f, a * e - b * d]
    most = max(map(abs, u))
    if most > 1e-12:
        return [v / most for v in u]
    # the rows are dependent: two of them, or one without weight, can move alone
    rows = x.tolist()
    for i in range(len(rows)):
        if max(map(abs, rows[i])) <= 1e-12:
            return [float(k == i) for k in range(len(rows))]
    i, j = 0, 1
    big = max(range(x.shape[1]), key=lambda k: abs(rows[0][k]))
    u = [0.0] * len(rows)
    u[i], u[j] = rows[j][big], -rows[i][big]
    most = max(map(abs, u))
    return [v / most for v in u]


def flown(last_levels: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h", "doc_id", "th"], na_position="last", kind="stable")
        p = rows.p.to_numpy(copy=True)
        x = np.stack((rows["size"].to_numpy(float) * rows.c.to_numpy(), rows.c.to_numpy(float)), 1)
        scale = np.maximum(np.abs(x).max(0), 1.0)
        x = x / scale
        rng = random.Random(f"{SEED}|{key[0]}|{key[1]}|{last_levels}")
        fly(p, x, rng)
        if last_levels:
            fly(p, x[:, :1], rng)
            for i in np.flatnonzero((p > EPS) & (p < 1 - EPS)):
                p[i] = float(rng.random() < p[i])
        return rows.assign(p=p)

    return run


def multiplicities(units: DataFrame, block: int = BLOCK) -> DataFrame:
    """units (doc_id, source, th, size, c, times) with n: how often each row is taken. times: the mean to be met."""
    cols = ["doc_id", "source", "th", "size", "c", "base", "p", "h"]
    schema = "doc_id long, source string, th long, size long, c long, base long, p double, h long, b long"
    state = units.withColumn("base", F.floor("times").cast("long")).withColumn("p", F.col("times") - F.col("base")).withColumn("h", F.xxhash64("doc_id", "th", F.lit(SEED)))
    state = cut(state.select(*cols))
    decided, level = [], 0
    while True:
        open_ = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
        decided.append(state.filter(~open_).select(*cols))
        counts = state.filter(open_).groupBy("source").agg(F.ceil(F.count("*") / block).cast("long").alias("k"))
        most = counts.agg(F.max("k")).first()[0]
        if not most:
            break
        counts = counts.withColumnRenamed("source", "s")
        rows = state.filter(open_).join(counts, F.col("source").eqNullSafe(F.col("s"))).withColumn("b", F.pmod(F.xxhash64("h", F.lit(level)), F.col("k")))
        state = cut(rows.select(*cols, "b").groupBy("source", "b").applyInPandas(flown(most == 1), schema).drop("b"))
        level += 1
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out.withColumn("n", F.col("base") + (F.col("p") > 0.5).cast("long"))


def mixed(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Decisions (doc_id, source, th, size, c, n) and targets for rows (doc_id, source, th, size)."""
    units = cut(rows.groupBy("doc_id", "source", "th", "size").agg(F.count("*").alias("c")))
    goal = targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("c")).cast("long").alias("source_size")))
    g = goal.select(F.col("source").alias("s"), (F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))).alias("times"))
    units = units.join(g, F.col("source").eqNullSafe(F.col("s"))).withColumn("times", F.coalesce("times", F.lit(0.0)))
    return multiplicities(units, block), goal


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """docs' rows as often as the mix takes them, with docs' columns."""
    th, n = fresh(docs, "_th"), fresh(docs, "_n")
    own = docs.withColumn(th, F.xxhash64("text"))
    rows = own.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col(th).alias("th"), words_in(F.col("text")).alias("size"))
    made = mixed(rows, block)[0].filter("n > 0").select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("th").alias("_h"), F.col("n").alias(n))
    taken = own.join(made, (own["doc_id"] == made["_d"]) & own["source"].eqNullSafe(made["_s"]) & (own[th] == made["_h"]))
    if docs.filter("doc_id IS NULL").limit(1).count():  # null ids join apart, so that they aren't one hot key for the rest
        odd = own["doc_id"].isNull() & made["_d"].isNull() & own["source"].eqNullSafe(made["_s"]) & (own[th] == made["_h"])
        taken = taken.unionByName(own.join(made, odd))
    return taken.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*[own[c] for c in docs.columns])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.xxhash64("text").alias("th"), words_in(F.col("text")).alias("size"))
    made, goal = mixed(rows)
    goal = goal.select(F.col("source").alias("s"), "source_size", "target")
    out = made.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))))
    return out.join(goal, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", (F.col("n") * F.col("size")).alias("taken"))
