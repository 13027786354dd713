"""Suffix-array dedup: remove bytes covered by a 200-byte string that starts anywhere else too.

A suffix order of the whole collection would insert one symbol of every document each round, and
need as many rounds as the longest document has bytes. Only windows of `LENGTH` bytes matter, so
the collection is first cut into short documents of equal make:

1. Each window has an anchor: its least `ANCHOR`-byte string by a hash. Equal windows have equal
   anchors at equal places, so repeats can only lie around repeated anchors. Anchors (one in
   about 75 bytes) and a hash of each one's context, all bytes that windows with that anchor can
   cover, are counted by key; anchors that occur once end here.
2. Contexts found twice or more are covered whole, all occurrences of them.
3. What is left of a repeated anchor, its distinct contexts, are the short documents: aligned at
   the anchor and padded. Column-wise construction inserts one symbol of every one each round
   and updates their order, the collection's Burrows-Wheeler transform (the next column read in
   that order) and the common prefixes of neighbours. Where a neighbour shares `LENGTH` bytes
   the window repeats. Columns are kept in blocks; beyond `IN_MEMORY` rows a block is a sequential
   file in the shared folder, read column by column. Beside these a row takes about 80 bytes.

Bytes are compared in step 3; step 2 trusts 128 bits of hash (anchor and context), and rows are told
apart by 128 bits of hash of id and text. An anchor's distinct contexts are sorted in one task.

A null text is empty. Texts shorter than the length stay; very long texts are read whole. Repeated
rows count as other places of the same string, whatever their id. A null id is an id of its own. An
empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, cut_wide, id_or_last, shared_path, small_batches, table, utf8

LENGTH = 200
ANCHOR = 48
BATCH = 1 << 15
IN_MEMORY = 1 << 17
PAD = 256
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
MIX = np.uint64(0xD6E8FEB86659FD93)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n-1 modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 14, 1 << (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def extremes(v: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each run of width values."""
    n, size = len(v) - width + 1, 1
    while size * 2 <= width:
        v = pick(v[:-size], v[size:])
        size *= 2
    return pick(v[:n], v[width - size : width - size + n])


def anchors(raw: bytes, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the strings that are the least in some window."""
    n = len(raw)
    if n < length:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=sums[1:])
    g = (sums[anchor:] - sums[:-anchor]) * powers(INVERSE, n - anchor + 1)
    g ^= g >> np.uint64(32)
    g *= MIX
    v = (g >> np.uint64(32)).astype(np.uint32)
    width = length - anchor + 1
    low = extremes(v, width, np.minimum)
    around = np.zeros(len(low) + 2 * (width - 1), np.uint32)
    around[width - 1 : width - 1 + len(low)] = low
    at = np.flatnonzero(extremes(around, width, np.maximum) == v)
    return at, g[at].view(np.int64)


def anchors_of(length: int, anchor: int):
    side = length - anchor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            many, place, g, c = [], [], [], []
            for text in batch.column(2).to_pylist():
                raw = utf8(text)
                at, own = anchors(raw, length, anchor)
                many.append(len(at))
                place.append(at)
                g.append(own)
                c += [xxhash.xxh64_intdigest(raw[max(0, p - side) : p + length], min(p, side)) for p in at.tolist()]
            columns = [*(np.repeat(k, many) for k in keys), np.concatenate(place).astype(np.int32), np.concatenate(g), np.array(c, np.uint64).view(np.int64)]
            for k in range(0, len(c), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 16)]) for x in columns], names=["t1", "t2", "at", "g", "c"])

    return run


class Columns:
    """A matrix that is filled by rows and read by columns, last first; blocks beyond a number of rows are files in a folder."""

    def __init__(self, width: int, folder: str):
        self.width, self.folder, self.blocks, self.n = width, folder, [], 0

    def add(self, rows: np.ndarray) -> None:
        block = np.ascontiguousarray(rows.T)
        if self.n >= IN_MEMORY:
            files, at = fs.FileSystem.from_uri(f"{self.folder if '://' in self.folder else 'file://' + self.folder}/{uuid.uuid4().hex}")
            files.create_dir(at.rpartition("/")[0])
            with files.open_output_stream(at) as out:
                out.write(block.data)
            block = files, at, files.open_input_file(at), len(rows)
        self.blocks.append(block)
        self.n += len(rows)

    def __getitem__(self, j: int) -> np.ndarray:
        return np.concatenate([b[j] if isinstance(b, np.ndarray) else np.frombuffer(b[2].read_at(2 * b[3], 2 * b[3] * j), np.uint16) for b in self.blocks])

    def close(self) -> None:
        for b in self.blocks:
            if not isinstance(b, np.ndarray):
                b[2].close()
                b[0].delete_file(b[1])


def least_between(d: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of d[a+1 .. b] for each pair a < b."""
    out = d[b]
    far = np.flatnonzero(b - a > 1)
    level, step = d, 1
    lo, hi, span = a[far] + 1, b[far] + 1, (b - a)[far]
    while len(far):
        done = span < 2 * step
        if done.any():
            k = far[done]
            out[k] = np.minimum(level[lo[done]], level[hi[done] - step])
            keep = ~done
            far, lo, hi, span = far[keep], lo[keep], hi[keep], span[keep]
        level = np.minimum(level[:-step], level[step:]) if len(level) > step else level
        step *= 2
    return out


def repeated_runs(columns: Columns, group: np.ndarray, length: int, first: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """row, begin, last: runs of columns where windows begin that lie in first .. end of their row and repeat in its group. Rows are sorted by group."""
    n, starts = columns.n, columns.width - length + 1
    order, common = np.arange(n), np.zeros(n, np.int32)
    last = np.full(n, -1, np.int32)  # where the run that is open in a row ends
    for j in range(columns.width - 1, -1, -1):
        key = group[order] * 512 + columns[j][order]
        to = np.argsort(key, kind="stable")
        sorted_key = key[to]
        same = np.flatnonzero(sorted_key[1:] == sorted_key[:-1]) + 1
        fresh = np.zeros(n, np.int32)
        fresh[same] = 1 + least_between(common, to[same - 1], to[same])
        order, common = order[to], fresh
        if j < starts:
            long = common >= length
            long[:-1] |= long[1:]
            hit = np.zeros(n, bool)
            hit[order[long]] = True
            hit &= (first <= j) & (j + length <= end)
            over = np.flatnonzero(~hit & (last >= 0))
            if len(over):
                yield over, np.full(len(over), j + 1), last[over]
                last[over] = -1
            last[hit & (last < 0)] = j
    over = np.flatnonzero(last >= 0)
    yield over, np.zeros(len(over), np.int64), last[over]


class Contexts:
    """Contexts of whole anchors: their bytes as columns, the rest as arrays."""

    def __init__(self, width: int, side: int, folder: str):
        self.columns, self.side, self.parts = Columns(width, folder), side, []

    def add(self, batch: pa.RecordBatch) -> None:
        if not batch.num_rows:
            return
        *numbers, raw = batch.columns
        numbers = [c.to_numpy(zero_copy_only=False) for c in numbers]
        part = np.full((batch.num_rows, self.columns.width), PAD, np.uint16)
        begin = self.side - numbers[-1]
        end = begin.copy()
        for i, (a, x) in enumerate(zip(begin.tolist(), raw.to_pylist())):
            part[i, a : a + len(x)] = np.frombuffer(x, np.uint8)
            end[i] += len(x)
        self.columns.add(part)
        self.parts.append((*numbers[:-1], begin, end))

    def spans(self, length: int) -> pa.RecordBatch:
        g, t1, t2, at, once, begin, end = (np.concatenate(x) for x in zip(*self.parts))
        self.parts.clear()
        group = np.cumsum(np.diff(g, prepend=g[0]) != 0)
        end[~once] = -1  # those are covered already
        row, a, b = (np.concatenate(x) for x in zip(*repeated_runs(self.columns, group, length, begin, end)))
        self.columns.close()
        place = at[row] - self.side
        return pa.RecordBatch.from_arrays([pa.array(t1[row]), pa.array(t2[row]), pa.array((place + a).astype(np.int32)), pa.array((place + b + length).astype(np.int32))], names=["t1", "t2", "s", "e"])


def repeats_of(length: int, anchor: int, folder: str):
    """Rows (g, t1, t2, at, once, left, bytes), sorted by g, to covered spans (t1, t2, s, e) of rows that occur once."""
    side = length - anchor
    new = lambda: Contexts(2 * side + anchor, side, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = new(), None
        for batch in batches:
            g, begin = batch.column(0).to_numpy(), 0
            if held.columns.n >= BATCH and g[-1] != last:
                begin = int(np.flatnonzero(g != last)[0])
                held.add(batch.slice(0, begin))
                yield held.spans(length)
                held = new()
            held.add(batch.slice(begin))
            last = g[-1]
        if held.columns.n:
            yield held.spans(length)

    return run


def contexts_of(length: int, anchor: int):
    """Texts with the places that are asked for, to the contexts' bytes."""
    side = length - anchor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t1, t2, text, asked in zip(*(batch.column(k).to_pylist() for k in range(4))):
                raw = utf8(text)
                out += [(a["g"], t1, t2, a["at"], a["once"], min(a["at"], side), raw[max(0, a["at"] - side) : a["at"] + length]) for a in asked]
            for k in range(0, len(out), 8192):
                cols = list(zip(*out[k : k + 8192]))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["g", "t1", "t2", "at", "once", "left", "raw"])

    return run


def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and their covered spans to what is left of them."""
    for batch in batches:
        size, gone, runs, kept = [], [], [], []
        for text, s, e in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
            raw = utf8(text)
            size.append(len(raw))
            if not s:
                gone.append(0)
                runs.append(0)
                kept.append(raw)
                continue
            change = np.zeros(len(raw) + 1, np.int64)
            np.add.at(change, np.clip(s, 0, len(raw)), 1)
            np.add.at(change, np.clip(e, 0, len(raw)), -1)
            covered = np.cumsum(change[:-1]) > 0
            gone.append(int(covered.sum()))
            runs.append(int(np.count_nonzero(np.diff(covered.astype(np.int8), prepend=0) == 1)))
            kept.append(np.frombuffer(raw, np.uint8)[~covered].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes: a row for each row of docs."""
    small_batches(docs.sparkSession)
    own = docs.select(id_or_last(F.col("doc_id")).cast("long").alias("id"), "text", F.col("doc_id").cast("long").alias("doc_id"))
    own = own.select(F.xxhash64("id", "text").alias("t1"), F.xxhash64(F.lit(1), "id", "text").alias("t2"), "text", "doc_id")
    places = cut_wide(own.select("t1", "t2", "text").mapInArrow(anchors_of(length, anchor), "t1 long, t2 long, at int, g long, c long"))
    # counts are cut before they are joined, so that the joins deal both sides anew and can split the rows of a hot anchor
    twice = cut(places.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g"))
    found = cut_wide(places.join(twice, "g"))
    contexts = found.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.struct("t1", "t2", "at")).alias("one"))
    contexts = cut_wide(contexts.select("g", "c", (F.col("n") == 1).alias("once"), "one"))
    several = cut(contexts.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g"))
    side = length - anchor
    spans = found.join(contexts.filter("NOT once").select("g", "c"), ["g", "c"], "left_semi").select("t1", "t2", (F.col("at") - side).alias("s"), (F.col("at") + length).alias("e"))
    asked = contexts.join(several, "g").groupBy(F.col("one.t1").alias("t1"), F.col("one.t2").alias("t2")).agg(F.collect_list(F.struct(F.col("g"), F.col("one.at").alias("at"), F.col("once"))).alias("asked"))
    # with all of own's columns, so that this join and the last one share one shuffle of the texts
    texts = own.join(asked, ["t1", "t2"]).dropDuplicates(["t1", "t2"])
    short = texts.select("t1", "t2", "text", "asked", "doc_id").mapInArrow(contexts_of(length, anchor), "g long, t1 long, t2 long, at int, once boolean, left int, raw binary")
    met = short.repartition("g").sortWithinPartitions("g").mapInArrow(repeats_of(length, anchor, shared_path(docs.sparkSession)), "t1 long, t2 long, s int, e int")
    lists = spans.unionByName(met).groupBy("t1", "t2").agg(F.collect_list(F.struct("s", "e")).alias("x")).select("t1", "t2", F.col("x.s").alias("s"), F.col("x.e").alias("e"))
    rest = own.join(lists, ["t1", "t2"], "left").select("doc_id", "text", "s", "e")
    return rest.mapInArrow(without, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
