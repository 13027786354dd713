"""SimHash near-dedup: fingerprints that differ in few bits, compared bit plane by bit plane.

A text's fingerprint has a bit where over half of its shingles' XXH64 hashes have it. For a
radius of r bits the 64 bits are cut into r + 1 blocks: two fingerprints within the radius
agree in one block at least, so each distinct fingerprint goes to one bucket a block. In a
bucket the members' bits are stored as vertical planes, 64 members to a machine word; a query
adds the planes that differ into carry-save counters for 64 distances at once and is given up
as soon as all of them exceed the radius. Links become local components at once (a row for
each linked fingerprint, not for each pair), and stars of minima join these into components.

For a similarity of shingle sets (`one_of_each`) 64 bits are too few: sets that share 0.8 differ in 10 of 64 bits on
average. There, fingerprints have 256 bits over distinct shingles, the radius is `RADIUS`, and the buckets come from
as many drawn bit positions as keep buckets near `FILL` members, in so many tables that a pair at the similarity shares
a bucket with a chance of `RECALL`. The components of these links are candidate groups only. In them shingle sets
are compared exactly, and groups are the components of the pairs that reach the similarity.

Buckets over `CHUNK` members are cut into chunks and each pair of chunks is a bucket of its
own, so no task holds a large bucket and no link is lost.

A null or empty text has fingerprint 0 and is linked like any other. Rows with a null id take
part in links; a component of null ids alone has a null id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, cut_wide, fresh, small_batches, table, utf8

BITS = 64
SEED = 42
CHUNK = 2048
WORDS = 4  # of the wide fingerprints, 64 bits each
#: Sets that share 0.8 have a cosine of 0.89 at least, which turns 0.15 of the bits, 38 of 256; 55 is three deviations more.
RADIUS = 55
#: One deviation more than the mean: tables are enough for pairs that differ in so many bits.
TURNED = 0.173
RECALL = 0.995
FILL = 1024
GROUP_BYTES = 1 << 25
MIX = [(0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9), (0xC2B2AE3D27D4EB4F, 0x94D049BB133111EB), (0x165667B19E3779F9, 0xD6E8FEB86659FD93), (0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD)]
ONE = np.uint64(1)


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of each run of width words, repeats included; of the whole sequence if it is shorter."""
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - width + 1
    hash_of = xxhash.xxh64_intdigest
    return np.fromiter((hash_of(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist())), np.uint64, n)


def majority(h: np.ndarray) -> int:
    """64 bits, unsigned: those that over half the hashes have."""
    on = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 8192):
        on += np.unpackbits(h[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(on * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, width: int) -> int:
    return majority(shingle_hashes(utf8(text).lower().split(), width))


def fingerprints_of(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.int64())], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id and fp (the 64 bits as a long), a row for each row of docs."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(fingerprints_of(width), "doc_id long, fp long")


def planes_of(fps: np.ndarray, slot: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bit p of all members, as words of 64 members; slot: a member's bit; first: where words begin."""
    out = np.empty((BITS * fps.shape[1], len(first)), np.uint64)
    for p in range(len(out)):
        out[p] = np.add.reduceat(((fps[:, p // BITS] >> np.uint64(p % BITS)) & ONE) << slot, first)
    return out


def close_pairs(fps: np.ndarray, bucket: np.ndarray, radius: int, block: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of one bucket within the radius. fps: a row of 64-bit words for each; bucket is sorted."""
    n = len(fps)
    if n < 2:
        return
    begins = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    size = np.diff(np.append(begins, n))
    within = np.arange(n) - np.repeat(begins, size)
    words = -(-size // 64)
    word_base = np.concatenate(([0], np.cumsum(words)[:-1]))
    word = np.repeat(word_base, size) + within // 64
    slot = (within % 64).astype(np.uint64)
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    members = np.add.reduceat(ONE << slot, first)
    planes = planes_of(fps, slot, first)
    left = np.repeat(word_base + words, size) - word  # words from the query's own to the bucket's last
    row_end = np.cumsum(left)
    row = 0
    while row < n:
        upto = max(row + 1, int(np.searchsorted(row_end, row_end[row] - left[row] + block, "right")))
        q = np.repeat(np.arange(row, upto), left[row:upto])
        w = word[q] + np.arange(len(q)) - np.repeat(np.cumsum(left[row:upto]) - left[row:upto], left[row:upto])
        own = w == word[q]
        live = members[w].copy()
        live[own] &= ~((ONE << slot[q[own]]) | ((ONE << slot[q[own]]) - ONE))  # each pair once: later members only
        row = upto
        keep = live != 0
        q, w, live = q[keep], w[keep], live[keep]
        counters = [np.zeros(len(q), np.uint64) for _ in range(radius.bit_length())]
        for p in range(len(planes)):
            if not len(q):
                break
            carry = (planes[p][w] ^ (np.uint64(0) - ((fps[q, p // BITS] >> np.uint64(p % BITS)) & ONE))) & live
            for c in counters:
                c ^= carry
                carry &= ~c  # the bits that went from one to nought
            live &= ~carry
            if p % 8 < 7:
                continue
            over = np.zeros(len(q), np.uint64)
            equal = ~over
            for b, c in reversed(list(enumerate(counters))):
                if radius >> b & 1:
                    equal &= c
                else:
                    over |= equal & c
                    equal &= ~c
            live &= ~over
            if not (keep := live != 0).all():
                q, w, live = q[keep], w[keep], live[keep]
                counters = [c[keep] for c in counters]
        for b in range(64):
            hit = (live >> np.uint64(b)) & ONE != 0
            if hit.any():
                yield q[hit], first[w[hit]] + b


def components(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index that each of n reaches."""
    to = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = to[i], to[j]
            if (a == b).all():
                break
            low = np.minimum(a, b)
            np.minimum.at(to, a, low)
            np.minimum.at(to, b, low)
            to = to[to]
    while (to != to[to]).any():
        to = to[to]
    return to


def links_of(radius: int, first: int):
    """Sorted rows of (t, v, p, node, ..., words of bits from column `first` on) to links (node, the first node of its local component)."""

    def solve(bucket: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        to = components(len(rows), close_pairs(rows[:, first - 3 :].view(np.uint64), bucket, radius))
        at = np.flatnonzero(to != np.arange(len(rows)))
        return pa.RecordBatch.from_arrays([pa.array(rows[at, 0]), pa.array(rows[to[at], 0])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([c.to_numpy() for c in batch.columns], 1))
            if sum(map(len, held)) >= 1 << 17:
                rows = np.concatenate(held)
                held = [rows]
                change = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(1))
                if len(change):
                    end = int(change[-1]) + 1
                    yield solve(numbers(rows[:end]), np.ascontiguousarray(rows[:end, 3:]))
                    held = [rows[end:]]
        if held:
            rows = np.concatenate(held)
            yield solve(numbers(rows), np.ascontiguousarray(rows[:, 3:]))

    def numbers(rows: np.ndarray) -> np.ndarray:
        return np.concatenate(([0], np.cumsum((rows[1:, :3] != rows[:-1, :3]).any(1))))

    return run


def blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, width) of radius + 1 blocks."""
    edges = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def paired(rows: DataFrame, by: list[str], members: Column, salt: str) -> DataFrame:
    """rows with p: a row for each pair of chunks that its chunk is in. members: aggregate, the chunks that a bucket needs."""
    large = rows.groupBy(*by).agg(F.count("*").alias("n"), members.alias("c")).filter("n > 1")
    rows = rows.join(cut(large.select(*by, "c")), by)  # cut, so that the join can split the rows of a hot bucket
    own = F.pmod(F.xxhash64(salt), F.col("c"))
    pair = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("c") - 1), lambda o: F.least(o, own) * F.col("c") + F.greatest(o, own)))
    return rows.withColumn("p", pair).drop("c")


def bucket_links(rows: DataFrame, node: str, words: list[str], radius: int, chunk: int) -> DataFrame:
    """Links a, b that join all nodes within the radius that share a bucket. rows: t, v, node and words (node may be one)."""
    ready = paired(rows, ["t", "v"], F.ceil(F.count("*") / chunk).cast("long"), node).repartition("t", "v", "p").sortWithinPartitions("t", "v", "p", node)
    extra = [w for w in words if w != node]
    return ready.select("t", "v", "p", node, *extra).mapInArrow(links_of(radius, 4 if extra == words else 3), "a long, b long")


def links(fps: DataFrame, radius: int, chunk: int = CHUNK) -> DataFrame:
    """Links a, b between the distinct longs of fps (column fp) that join all within the radius."""
    probes = F.array(*[F.struct(F.lit(i).cast("long").alias("t"), F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << w) - 1)).alias("v")) for i, (a, w) in enumerate(blocks(radius))])
    return bucket_links(fps.select("fp", F.explode(probes).alias("k")).select("k.t", "k.v", "fp"), "fp", ["fp"], radius, chunk)


def connected(edges: DataFrame) -> DataFrame:
    """node, root: every node of the edges a, b with the smallest node it reaches.

    Large stars and small stars in turn; each round is cut, and only two counts reach the driver.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a != b").distinct()
        new = cut(small)
        change = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first(), edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        edges = new
        if change[0] == change[1]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 5, radius: int = 2) -> DataFrame:
    """doc_id, fp and component_id (the smallest id reachable), a row for each row of docs."""
    own = cut(fingerprints(docs, width))
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected(links(distinct.select("fp"), radius))
    classes = cut(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"))
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = cut(classes.join(named, "root").select("fp", "component_id"))  # cut, so that the join can split a hot fingerprint's rows
    return own.join(classes, "fp").select("doc_id", "fp", "component_id")


def wide_fingerprints_of(width: int):
    """Texts to their bytes, a 128-bit hash of their words and 256 bits over their distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, 3 + WORDS), np.uint64)
            for row, text in zip(out, batch.column(0).to_pylist()):
                raw = utf8(text)
                words = raw.lower().split()
                key = xxhash.xxh3_128_intdigest(b" ".join(words))
                row[:3] = len(raw), key >> 64, key & (1 << 64) - 1
                h = np.unique(shingle_hashes(words, width))
                for k, (a, b) in enumerate(MIX):
                    g = (h ^ np.uint64(a)) * np.uint64(b)
                    g = (g ^ (g >> np.uint64(32))) * np.uint64(a)
                    row[3 + k] = majority(g ^ (g >> np.uint64(29)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(c) for c in out.view(np.int64).T)], names=[*batch.schema.names[1:], "size", "k1", "k2", *WIDE])

    return run


WIDE = [f"f{k}" for k in range(WORDS)]


def drawn_bits(n: int) -> np.ndarray:
    """tables x positions: what n fingerprints need for buckets of about FILL members and the recall."""
    width = max(8, math.ceil(math.log2(max(n, 1) / FILL + 1)))
    tables = math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - TURNED) ** width))
    rng = np.random.default_rng(SEED)
    return np.stack([rng.choice(BITS * WORDS, width, replace=False) for _ in range(tables)])


def probes_of(drawn: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.stack([c.to_numpy() for c in batch.columns[1:]], 1)
            bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little")
            for t, at in enumerate(drawn):
                v = bits[:, at].astype(np.int64) @ (1 << np.arange(len(at)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), t, np.int64)), pa.array(v), *batch.columns], names=["t", "v", "node", *WIDE])

    return run


def alike(sets: list[np.ndarray], similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sets whose intersection is the given share of their union."""
    size = np.array([len(x) for x in sets])
    _, at, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    who, shared = np.repeat(np.arange(len(sets)), size), many > 1
    keep = shared[at]
    who, at = who[keep], (np.cumsum(shared) - 1)[at[keep]]
    order = np.argsort(at, kind="stable")
    who, at = who[order], at[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for k in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(at, (k, k + 4096))
        part = np.zeros((len(sets), 4096), np.float32)
        part[who[a:b], at[a:b] - k] = 1
        both += part @ part.T
    i, j = np.nonzero(both >= similarity * (size[:, None] + size - both) - 1e-6 * size)
    yield i[i < j], j[i < j]


def verified(width: int, similarity: float):
    """Rows (root, p, c, text), sorted by root and p, to links of the c whose texts reach the similarity."""

    def solve(nodes: list[int], texts: list[str]) -> pa.RecordBatch:
        sets = [np.unique(shingle_hashes(utf8(t).lower().split(), width)) for t in texts]
        to, own = components(len(sets), alike(sets, similarity)), np.array(nodes, np.int64)
        at = np.flatnonzero(to != np.arange(len(sets)))
        return pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(own[to[at]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, nodes, texts = None, [], []
        for batch in batches:
            for root, p, c, text in zip(*(x.to_pylist() for x in batch.columns)):
                if (root, p) != last and len(nodes) > 1:
                    yield solve(nodes, texts)
                if (root, p) != last:
                    last, nodes, texts = (root, p), [], []
                nodes.append(c)
                texts.append(text)
        if len(nodes) > 1:
            yield solve(nodes, texts)

    return run


def groups_of(rows: DataFrame, width: int, similarity: float, chunk: int) -> DataFrame:
    """r1, r2: the first row of each group of texts. rows: doc_id, r1, r2 (unique), text.

    Rows whose texts have the same words are one class, which its first row stands for: the smallest doc_id, nulls
    last, then the smallest r1 and r2. Only classes are compared.
    """
    small_batches(rows.sparkSession)
    bits = ", ".join(f"{f} long" for f in WIDE)
    own = rows.select("text", "doc_id", "r1", "r2").mapInArrow(wide_fingerprints_of(width), f"doc_id long, r1 long, r2 long, size long, k1 long, k2 long, {bits}")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2", "size", *WIDE)).alias("x")
    classes = own.groupBy("k1", "k2").agg(first).select("x.*", F.xxhash64(*[f"x.{f}" for f in WIDE]).alias("node"), F.monotonically_increasing_id().alias("cls"))
    classes = cut(classes)  # the numbers hold from here on
    nodes = classes.groupBy("node").agg(*[F.min(f).alias(f) for f in WIDE])
    probed = nodes.mapInArrow(probes_of(drawn_bits(classes.count())), f"t long, v long, node long, {bits}")
    near = connected(bucket_links(probed, "node", WIDE, RADIUS, CHUNK))
    groups = cut(classes.join(near, "node", "left").select(F.coalesce("root", "node").alias("root"), "cls", "r1", "r2", "size"))
    need = F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum("size") / GROUP_BYTES)).cast("long")
    asked = paired(groups, ["root"], need, "cls").select("root", "p", "cls", "r1", "r2")
    held = rows.select("r1", "r2", "text").join(asked, ["r1", "r2"]).select("root", "p", "cls", "text")
    linked = connected(held.repartition("root", "p").sortWithinPartitions("root", "p", "cls").mapInArrow(verified(width, similarity), "a long, b long"))
    named = classes.join(linked.withColumnRenamed("node", "cls").withColumnRenamed("root", "g"), "cls", "left")
    return named.groupBy(F.coalesce("g", "cls").alias("g")).agg(F.min(F.struct("none", "doc_id", "r1", "r2")).alias("x")).select("x.r1", "x.r2")


def one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8, chunk: int = 1024) -> DataFrame:
    """One row of docs for each group of near copies: that with the smallest doc_id, null ids last.

    Every row is compared, whatever its id: rows that share an id with different texts, or have none, stay unless their
    text is a near copy. Of a group's rows with the same id the one with the smaller hash of all columns stays, so the
    result is the same in every run; of rows that are equal in all columns one stays. Texts of one word sequence are
    copies, those without words too.
    """
    names = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    r1, r2 = fresh(docs, "_r1"), fresh(docs, "_r2")
    whole = docs.withColumn(r1, F.xxhash64(*names)).withColumn(r2, F.xxhash64(F.lit(1), *names))
    if whole.groupBy(r1, r2).agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        whole = cut_wide(whole.dropDuplicates([r1, r2]))
    rows = whole.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(r1).alias("r1"), F.col(r2).alias("r2"), "text")
    kept = groups_of(rows, width, similarity, chunk).select(F.col("r1").alias(r1), F.col("r2").alias(r2))
    return whole.join(kept, [r1, r2], "left_semi").select(*docs.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, radius=2)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
