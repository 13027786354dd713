"""Element-wise sums of array columns: added up in the tasks before anything is shuffled, then merged.

A task passes on one row for each group it has seen, as wide as the arrays, so that groups times tasks are shuffled at most,
however many rows there are, and no group is gathered. Merging reads rows sorted by group and holds one batch and one group's sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of sums that a task holds before it passes them on.
HELD_BYTES = 32 << 20


def matrix(column: pa.Array) -> np.ndarray:
    """An array column of one width as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def codes(keys: list[pa.Array], n: int) -> np.ndarray:
    """A number for each of n rows, equal just for rows of equal keys; NULLs are equal."""
    out = np.zeros(n, np.int64)
    for c in keys:
        own = pc.dictionary_encode(c, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        out = np.unique(out * (int(own.max()) + 1) + own, return_inverse=True)[1]
    return out


def adder(n_keys: int, n_values: int, schema: pa.Schema, held_bytes: int | None):
    """Rows of keys, array columns and n, added up by key. held_bytes None: rows come sorted by key, and each sum goes out when its key is over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size = 0

        def out_of(keys: list[tuple]) -> pa.RecordBatch:
            rows = [(*key, *own[:-1], own[-1]) for key in keys for own in [held.pop(key)]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            at = codes(batch.columns[:n_keys], batch.num_rows)
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
            parts = [np.add.reduceat(matrix(batch.column(n_keys + k))[order], first, axis=0) for k in range(n_values)]
            n = np.add.reduceat(batch.column(n_keys + n_values).to_numpy(zero_copy_only=False)[order], first).tolist()
            names = list(zip(*(c.take(pa.array(order[first])).to_pylist() for c in batch.columns[:n_keys]))) if n_keys else [()]
            for i, key in enumerate(names):
                own = held.get(key)
                if own is None:
                    held[key] = [*(p[i].copy() for p in parts), n[i]]
                    size += sum(p[i].nbytes for p in parts)
                else:
                    for mine, p in zip(own, parts):
                        mine += p[i]
                    own[-1] += n[i]
            if held_bytes is None:
                last = tuple(c[-1].as_py() for c in batch.columns[:n_keys])
                if done := [key for key in held if key != last]:
                    yield out_of(done)
            elif size > held_bytes:
                yield out_of(list(held))
                size = 0
        if held:
            yield out_of(list(held))

    return run


def array_sums(df: DataFrame, by: list[str], *columns: str) -> DataFrame:
    """by, n (rows) and the element-wise sums of the array columns, each of one width. Rows with a NULL array are left out."""
    rows = df.select(*by, *[F.col(c).cast("array<double>").alias(c) for c in columns], F.lit(1).cast("long").alias("n")).dropna(subset=list(columns))
    ddl = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes)
    schema = to_arrow_schema(rows.schema)
    some = rows.mapInArrow(adder(len(by), len(columns), schema, HELD_BYTES), ddl)
    dealt = some.repartition(*by).sortWithinPartitions(*by) if by else some.repartition(1)  # as many rows as tasks
    return dealt.mapInArrow(adder(len(by), len(columns), schema, None), ddl).select(*by, "n", *columns)
