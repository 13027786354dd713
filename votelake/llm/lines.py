"""Line dedup: lines that several documents hold stay in the first of them alone.

A line's key is the line without ASCII blanks at its ends, A-Z lower-cased. Documents emit
each key's hash (128 bits) once; a key found in two or more documents goes from all but the
one with the smallest id. Kept lines are joined again in their order.

A null or empty text is one empty line. A null id counts as one document that comes after all
others. Rows that repeat an id are one document: none of them loses a line to another. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, cut_wide, id_or_last, small_batches, table

BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS = 10
MIN_DOCS = 2
HASHES = pa.schema([("id", pa.int64()), ("th", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64())])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def line_hash(line: str, min_chars: int) -> bytes | None:
    key = line.strip(BLANKS)
    return xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= min_chars else None


def keys_of(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths, keys = [], [], []
            for i, th, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = {line_hash(x, min_chars) for x in (text or "").split("\n")}
                own.discard(None)
                keys += own
                ids += [i] * len(own)
                ths += [th] * len(own)
            both = memoryview(b"".join(keys)).cast("q")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ths, pa.int32()), pa.array(both[::2].tolist(), pa.int64()), pa.array(both[1::2].tolist(), pa.int64())], schema=HASHES)

    return run


def without(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, gone = [], [], []
            for text, k1, k2 in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                parts = (text or "").split("\n")
                kept = parts
                if k1:
                    drop = {a.to_bytes(8, "little", signed=True) + b.to_bytes(8, "little", signed=True) for a, b in zip(k1, k2)}
                    kept = [x for x in parts if line_hash(x, min_chars) not in drop]
                texts.append("\n".join(kept))
                lines.append(len(parts))
                gone.append(len(parts) - len(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], names=["doc_id", "text", "n_lines", "n_dropped"])

    return run


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text (kept lines), n_lines, n_dropped: a row for each row of docs."""
    small_batches(docs.sparkSession)
    # th deals the rows of one id, such as null ids: a clash in it is harmless, as a key that goes from an id goes from all of its rows
    own = docs.select(id_or_last(F.col("doc_id")).cast("long").alias("id"), F.hash("text").alias("th"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = cut_wide(own.select("id", "th", "text").mapInArrow(keys_of(min_chars), "id long, th int, k1 long, k2 long"))
    if min_docs == 2:  # two ids differ just when the smallest and the largest do
        held = keys.groupBy("k1", "k2").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    else:
        held = keys.select("id", "k1", "k2").distinct().groupBy("k1", "k2").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter(F.col("n") >= min_docs)
    held = cut(held.select("k1", "k2", "first"))  # so that the join deals both sides anew and can split a hot line's rows
    lost = keys.join(held, ["k1", "k2"]).filter("id > first")
    lists = lost.groupBy("id", "th").agg(F.collect_set(F.struct("k1", "k2")).alias("k")).select("id", "th", F.col("k.k1").alias("k1"), F.col("k.k2").alias("k2"))
    return own.join(lists, ["id", "th"], "left").select("doc_id", "text", "k1", "k2").mapInArrow(without(min_chars), "doc_id long, text string, n_lines long, n_dropped long")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, h.first IS NOT NULL AND doc_id <> h.first AS gone FROM k LEFT JOIN h USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
