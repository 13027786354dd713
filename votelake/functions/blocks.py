"""Rows of a key packed into blocks of bounded bytes, and rounds of sums over the blocks.

For models of keys with more rows than one task should hold: the rows are laid out once, a block a row of the table, and
each round is one pass of map tasks over blocks. A task adds up what its blocks give for each request, and requests are answered in
batches of bounded size, so what is broadcast and what comes back is bounded too. A lost executor repeats tasks of one round.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sums import array_sums

#: Bytes of vectors in one block.
BLOCK_BYTES = 4 << 20
#: Bytes of requests, and of their sums, that are under way at once.
ROUND_BYTES = 64 << 20


def shared_path(df: DataFrame) -> str:
    """A new path in the folder that spark.checkpoint.dir names; a temporary one only where all runs on this machine. Removed when the driver's JVM ends."""
    context = df.sparkSession.sparkContext
    at = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if at is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        at = tempfile.mkdtemp(prefix="votelake-")
    path = context._jvm.org.apache.hadoop.fs.Path(f"{at.rstrip('/')}/votelake-{uuid.uuid4().hex}")
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def written(df: DataFrame) -> DataFrame:
    """df as a compressed table in the shared folder."""
    at = shared_path(df)
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def pack(rows: DataFrame, by: list[str], label: str, vector: str, ident: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """by, labels, idents, vectors: the rows of each key in blocks of about block_bytes, written once.

    ident (a 64-bit hash or id of the row) deals them. A key's blocks are counted first, so that none is larger than twice the size, near enough.
    """
    size = 8 * F.size(vector)
    blocks = rows.groupBy(*by).agg(F.ceil(F.sum(size) / block_bytes).cast("long").alias("_m"))
    dealt = rows.join(blocks, by).withColumn("_p", F.pmod(F.xxhash64(ident), F.col("_m")))
    one = F.struct(F.col(ident).alias("i"), F.col(label).cast("double").alias("y"), F.col(vector).cast("array<double>").alias("x"))
    packed = dealt.groupBy(*by, "_p").agg(F.collect_list(one).alias("_r"))  # a block
    return written(packed.select(*by, F.col("_r.y").alias("labels"), F.col("_r.i").alias("idents"), F.col("_r.x").alias("vectors")))


def each_block(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple]:
    """key, vectors, labels and idents of each block."""
    for batch in batches:
        keys = zip(*(c.to_pylist() for c in batch.columns[:n_keys]))
        for k, key in enumerate(keys):
            y, i, x = (batch.column(n_keys + c)[k].values for c in range(3))
            y = y.to_numpy(zero_copy_only=False)
            yield key, x.flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1), y, i.to_numpy(zero_copy_only=False)


def round_of_sums(blocks: DataFrame, by: list[str], requests: dict[tuple, list], answer: Callable, width: int) -> dict[int, np.ndarray]:
    """Sums over blocks of answer(x, y, request), by the request's number, with zeros up to width, the largest answer's.

    requests: by key, pairs of (number, request); bounded by the caller, as they are broadcast and their sums come to the driver.
    """
    spark, n_keys = blocks.sparkSession, len(by)
    shared = spark.sparkContext.broadcast(requests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for key, x, y, _ in each_block(batches, n_keys):
            for number, request in shared.value.get(key, ()):
                own = answer(x, y, request)
                held[number] = held[number] + own if number in held else own
        for number, own in held.items():  # as many as requests, which are bounded
            own = np.append(own, np.zeros(width - len(own)))
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([own], pa.list_(pa.float64())), pa.array([1], pa.int64())], names=["number", "sums", "n"])

    wanted = list({key[0] for key in requests})
    rows = blocks.filter(F.col(by[0]).isin(wanted)).select(*by, "labels", "idents", "vectors").mapInArrow(run, "number long, sums array<double>, n long")
    out = {r.number: np.array(r.sums) for r in array_sums(rows, ["number"], "sums").collect()}
    shared.unpersist()
    return out


def round_of_draws(blocks: DataFrame, by: list[str], requests: dict[tuple, list], draw: Callable) -> dict[int, np.ndarray]:
    """The row of the smallest key over blocks of draw(x, y, idents, request), which gives a key and a row or nothing, by the request's number."""
    spark, n_keys = blocks.sparkSession, len(by)
    shared = spark.sparkContext.broadcast(requests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for key, x, y, ids in each_block(batches, n_keys):
            for number, request in shared.value.get(key, ()):
                own = draw(x, y, ids, request)
                if own is not None and (number not in held or own[0] < held[number][0]):
                    held[number] = own
        for number, (k, row) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([k]), pa.array([row], pa.list_(pa.float64()))], names=["number", "key", "row"])

    wanted = list({key[0] for key in requests})
    rows = blocks.filter(F.col(by[0]).isin(wanted)).select(*by, "labels", "idents", "vectors").mapInArrow(run, "number long, key double, row array<double>")
    out = {r.number: np.array(r.row) for r in rows.groupBy("number").agg(F.min_by("row", "key").alias("row")).collect()}
    shared.unpersist()
    return out


def batches_of(rows: Iterator, size: Callable, most: int) -> Iterator[list]:
    """Rows in lists whose sizes add up to at most `most`, or single rows."""
    held, total = [], 0
    for r in rows:
        if held and total + size(r) > most:
            yield held
            held, total = [], 0
        held.append(r)
        total += size(r)
    if held:
        yield held
