"""Spelling variants: words one edit apart, by sorted rotations of the words (permuterm).

A word x c y with a terminator has the rotation y $ x c, which ends in the character c. Words that differ from it by another character
in c's place have rotations with the same prefix y $ x; the word without c is the rotation y $ x itself. So each
rotation goes under the prefix that skips its last character, and as a whole under itself; sorted by prefix, the words of one prefix stand together,
and are all one replacement apart (skipped, skipped) or one insertion (skipped, whole). A prefix has at most one word for each
character of the alphabet and the one that is whole, however many words there are. The scan of a group gives each
member the number of its neighbours there and the best of them, a row a member and no pairs; inserting into a run of equal characters is
counted at the first place of the run alone. Rows grow with the letters of the words.

Words are counted in the tasks before anything is shuffled. A null text has no words; a null id is the empty string before the colon. Repeated rows count each time;
an empty table gives an empty result. Very long texts are read through in one pass.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, table

RUN = re.compile("[a-zÀ-ÿ]+")
MIN_CHARS, MIN_COUNT, TIMES, MARK = 6, 5, 5, "$"
#: One run in so many loses a character.
EVERY = 199
#: Different words that a task holds before it passes their counts on.
HELD = 1 << 18
#: Texts up to this many code points are split at once.
AT_ONCE = 1 << 20
ROTATIONS = "key string, last string, word string, n long"
NEIGHBOURS = "word string, near long, form string, form_n long"


def runs(text: str) -> Counter:
    """How often each run of letters occurs, A-Z lower-cased."""
    text = text.encode().lower().decode()
    return Counter(RUN.findall(text) if len(text) <= AT_ONCE else (m[0] for m in RUN.finditer(text)))


def misspelt(doc_id: int | None, run: str) -> str:
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run[: h % len(run)] + run[h % len(run) + 1 :] if h % EVERY == 0 else run


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def flushed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for run, n in runs(text.as_py() or "").items():
                held[misspelt(doc_id, run)] += n
            if len(held) > HELD:
                yield flushed()
                held.clear()
    if held:
        yield flushed()


def count_words(docs: DataFrame) -> DataFrame:
    """word, n: how often each word occurs in all texts, after the misspellings."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(word_counts, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def rotations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each rotation of word + MARK under its prefix without the last character (last: that character, kept where it doesn't repeat the one before it in the word), and under itself (last: null)."""
    for batch in batches:
        rows = []
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for k in range(len(word) + 1):
                head, tail = word[:k], word[k:]
                rows.append((f"{tail}{MARK}{head}", None, word, n))
                if head:
                    # the character before it, MARK if it is the word's first
                    rows.append((f"{tail}{MARK}{head[:-1]}", "" if head[-2:-1] == head[-1] else head[-1], word, n))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.int64()))] if rows else [pa.array([], k) for k in (pa.string(), pa.string(), pa.string(), pa.int64())], names=["key", "last", "word", "n"])


def better(a: tuple | None, b: tuple | None) -> tuple | None:
    """The more frequent of two (n, word), the smaller word on ties."""
    if a is None or b is None:
        return a or b
    return min(a, b, key=lambda x: (-x[0], x[1]))


def neighbours(group: list[tuple]) -> list[tuple]:
    """word, number of its neighbours, best of them and its n: for the rows (last, word, n) of one prefix."""
    whole = next(((n, word) for last, word, n in group if last is None), None)
    skipped = [(n, word, last) for last, word, n in group if last is not None]
    top = sorted((x[:2] for x in skipped), key=lambda x: (-x[0], x[1]))[:2]
    out, into, best_into = [], 0, None
    for n, word, last in skipped:
        joined = whole if last else None  # a letter put into a run of its like is counted at the run's first place
        near = len(skipped) - 1 + (joined is not None)
        if near:
            best = better(next((t for t in top if t[1] != word), None), joined)
            out.append((word, near, best[1], best[0]))
        if joined:
            into, best_into = into + 1, better(best_into, (n, word))
    if into:
        out.append((whole[1], into, best_into[1], best_into[0]))
    return out


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours of each prefix, over rows sorted by prefix."""
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
    key, group = None, []
    for batch in batches:
        out = []
        for k, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if k != key:
                if len(group) > 1:
                    out += neighbours(group)
                key, group = k, []
            group.append(row)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names=["word", "near", "form", "form_n"])
    if len(group) > 1 and (out := neighbours(group)):
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names=["word", "near", "form", "form_n"])


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best, best_n: for the words (word, n; each once) that have a near word."""
    rows = words.select("word", "n").mapInArrow(rotations, ROTATIONS)
    found = rows.repartition("key").sortWithinPartitions("key").mapInArrow(scan, NEIGHBOURS)
    best = F.min(F.struct((-F.col("form_n")).alias("k"), F.col("form"))).alias("b")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best).select("word", "n_near", F.col("b.form").alias("best"), (-F.col("b.k")).alias("best_n"))


def group_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n, root for words (word, n; each once): form is the most frequent near word, if it is `times` as frequent.

    Each form is `times` as frequent as its word, so a chain of forms has at most log(largest n) / log(times) links, and roots are found
    in the logarithm of that many joins.
    """
    near = words.select("word", "n").join(near_words(words), "word", "left")
    own = F.col("best_n") >= times * F.col("n")
    near = cut(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(own, F.col("best")).alias("form"), F.when(own, F.col("best_n")).alias("form_n")))
    up = cut(near.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        on = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = cut(up.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if up.filter("moved").isEmpty():
            break
        up = up.drop("moved")
    return near.join(up.drop("moved"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_words(table(spark, sf_dir, "documents"))
    words = cut(counted.filter((F.char_length("word") >= MIN_CHARS) & (F.col("n") >= MIN_COUNT)))
    return group_variants(words).select("word", "form", "root", "n", "n_near", "form_n")
