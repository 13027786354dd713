"""Each row against all of its key's known rows, in blocks: candidates of a key are dealt into parts of bounded size, known rows go past each part.

Rows of a part come sorted, candidates first; they stay in memory as one matrix, and the known rows are met as they stream by, a
chunk a matrix product. So a pair is never a row: what is shuffled is each candidate once and each known row once for each part of its key.
A key with very many candidates is many parts, in as many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sums import codes, matrix

#: Candidates of one part, and known rows that one product takes.
PART, CHUNK = 4096, 1024


class Best:
    """The k largest products with the known rows of each label 0 and 1, from the largest down."""

    kind = pa.list_(pa.list_(pa.float64()))

    def __init__(self, k: int):
        self.k = k

    def start(self, v: np.ndarray, ids: np.ndarray) -> None:
        self.v, self.best = v, [np.full((len(v), 0), 0.0) for _ in range(2)]

    def meet(self, v: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        found = self.v @ v.T
        for side in range(2):
            both = np.hstack([self.best[side], found[:, labels == side]])
            self.best[side] = -np.partition(-both, self.k - 1, axis=1)[:, : self.k] if both.shape[1] > self.k else both

    def end(self) -> list:
        down, up = (-np.sort(-b, axis=1) for b in self.best)
        return [[d.tolist(), u.tolist()] for d, u in zip(down, up)]


class Near:
    """Of the known rows within a cosine distance of unit vectors (a row is always near itself): their number and smallest label."""

    kind = pa.struct([("n", pa.int64()), ("low", pa.int64())])

    def __init__(self, eps: float):
        self.eps = eps

    def start(self, v: np.ndarray, ids: np.ndarray) -> None:
        self.v, self.ids = v, ids
        self.n, self.low = np.zeros(len(v), np.int64), np.full(len(v), np.iinfo(np.int64).max)

    def meet(self, v: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        near = (1 - self.v @ v.T <= self.eps) | (self.ids[:, None] == ids)
        self.n += near.sum(1)
        self.low = np.minimum(self.low, np.where(near, labels, np.iinfo(np.int64).max).min(1))

    def end(self) -> list:
        return [{"n": n, "low": low if n else None} for n, low in zip(self.n.tolist(), self.low.tolist())]


class Extremes:
    """The largest and smallest product with the other known rows of each label."""

    kind = pa.list_(pa.struct([("label", pa.int64()), ("high", pa.float64()), ("low", pa.float64())]))

    def start(self, v: np.ndarray, ids: np.ndarray) -> None:
        self.v, self.ids, self.found = v, ids, {}

    def meet(self, v: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        products = self.v @ v.T
        own = self.ids[:, None] == ids
        for label in np.unique(labels).tolist():
            at = labels == label
            high = np.where(own[:, at], -np.inf, products[:, at]).max(1)
            low = np.where(own[:, at], np.inf, products[:, at]).min(1)
            before = self.found.get(label, (high, low))
            self.found[label] = np.maximum(before[0], high), np.minimum(before[1], low)

    def end(self) -> list:
        found = sorted(self.found.items())
        return [[{"label": label, "high": float(h[i]), "low": float(x[i])} for label, (h, x) in found if np.isfinite(h[i])] for i in range(len(self.v))]


def met(state: Callable, n_keys: int):
    """Rows of keys, _known, _row, _id, _label, _v, sorted by keys and _known: _row and what the state found, for each candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key, rows, vectors, ids, started = state(), None, [], [], [], False

        def begin() -> None:
            nonlocal started
            if not started and rows:
                now.start(np.vstack(vectors), np.concatenate(ids))
                started = True

        def ended() -> Iterator[pa.RecordBatch]:
            begin()
            if started:
                whole = pa.concat_arrays(rows)
                yield pa.RecordBatch.from_arrays([whole, pa.array(now.end(), now.kind)], names=["_row", "found"])

        for batch in batches:
            if not batch.num_rows:
                continue
            run_of = codes(batch.columns[: n_keys + 1], batch.num_rows)
            starts = np.flatnonzero(np.r_[True, np.diff(run_of) != 0]).tolist()
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                part = batch.slice(a, b - a)
                here = tuple(part.column(k)[0].as_py() for k in range(n_keys))
                if here != key:
                    yield from ended()
                    now, key, rows, vectors, ids, started = state(), here, [], [], [], False
                row, ident, label, v = part.columns[n_keys + 1 :]
                own = ident.to_numpy(zero_copy_only=False)
                if not part.column(n_keys)[0].as_py():
                    rows.append(row)
                    vectors.append(matrix(v))
                    ids.append(own)
                elif rows:
                    begin()
                    x, y = matrix(v), label.to_numpy(zero_copy_only=False)
                    for k in range(0, len(x), CHUNK):
                        now.meet(x[k : k + CHUNK], own[k : k + CHUNK], y[k : k + CHUNK])
        yield from ended()

    return run


def against(candidates: DataFrame, known: DataFrame, by: list[str], state: Callable, found: str, part: int = PART) -> DataFrame:
    """_row and found of each candidate (by, _row, _id, _v), from the known rows (by, _id, _label, _v) that share by; all vectors have one width.

    found: the type of what the state's `end` gives. Candidates without known rows have what the state starts with.
    """
    parts = candidates.groupBy(*by).agg(F.ceil(F.count("*") / part).cast("int").alias("_m"))
    kind = candidates.schema["_row"].dataType
    mine = candidates.join(parts, by).select(*by, F.pmod(F.xxhash64("_row"), F.col("_m")).cast("int").alias("_part"), F.lit(0).alias("_known"), "_row", F.col("_id").cast("long").alias("_id"), F.lit(0).cast("long").alias("_label"), F.col("_v").cast("array<double>").alias("_v"))
    passing = known.join(parts, by).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    passing = passing.select(*by, "_part", F.lit(1).alias("_known"), F.lit(None).cast(kind).alias("_row"), F.col("_id").cast("long").alias("_id"), F.col("_label").cast("long").alias("_label"), F.col("_v").cast("array<double>").alias("_v"))
    dealt = mine.unionByName(passing).repartition(*by, "_part").sortWithinPartitions(*by, "_part", "_known")
    return dealt.mapInArrow(met(state, len(by) + 1), f"_row {kind.simpleString()}, found {found}")
