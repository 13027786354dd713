"""Token-ID output: ORC files of token ids in the order of document ids.

Rows are dealt by ranges of doc_id and sorted, so every file holds one range, in order. A row has the document's
ids (with the end id) as an integer array, which ORC stores run-length encoded, and `pos`, the number of ids
before it in its file. Row indexes keep the smallest and largest doc_id of every few rows and a Bloom filter on
doc_id, so a look-up by id skips files, stripes and row groups by their metadata alone. Stripes are smaller than a split: one large
file is read by several tasks. A second small table (`parts`) has each file's first id number, documents, ids and range
of doc_id; a row's global start is its file's start plus pos, whichever task reads it.

A null or empty text has the end id alone. Rows with one doc_id are ordered by a hash of the text, null ids come last; no
id is one task's, as ranges go on inside an id. An empty table gives empty files. Very long texts are encoded by words.

Encoding by words: a tokenizer that lower-cases and drops white space gives a text the ids of its words between ASCII blanks,
one after the other, so words are encoded by the library once and kept (`WordIds`); tests hold this against whole texts. Arrow finds the different
words of a group of texts, and the new ones go to the library in one call. A text that holds a special token's string is encoded whole. For other tokenizers pass by_words=False.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, id_or_last, shared_path, small_batches, table

END_ID = 1
#: Words of up to so many bytes are kept, so many of them.
WORD_BYTES, WORDS = 64, 1 << 20
#: A run of ASCII or Latin-1 letters, and the punctuation that may close it.
RUN, CLOSING = "^[a-zÀ-ÖØ-öø-ÿ]+$", ".,;:!?|)"
#: Bytes of text (or one text, if it is longer) that are encoded together and make one batch of output; bounds what a worker and the ORC writer hold at once.
GROUP_BYTES = 1 << 20
ROWS = "part int, pos long, doc_id long, n_tokens long, ids array<int>"
#: Stripes small enough that several fit a split; an index entry every so many rows.
STRIPE_BYTES, INDEX_ROWS = 8 << 20, 1000


def as_bytes(words: pa.Array) -> list[bytes]:
    return words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()  # far faster than to_pylist


class WordIds(dict):
    """Ids of lower-case words, as little-endian 32-bit integers. New words of a group of texts are encoded by the library in one call."""

    def __init__(self, path: str):
        super().__init__()
        self.first = None
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        self.specials = re.compile(b"|".join(re.escape(t["content"].encode()) for t in made["added_tokens"]) or rb"(?!)", re.IGNORECASE)
        # a special token that ends a word wherever it stands and changes nothing around it
        apart = [t for t in made["added_tokens"] if t["special"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"])]
        self.apart = (apart[0]["content"], apart[0]["id"]) if apart else None
        end = made["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)  # the ids that end a run of letters, if the vocabulary marks them
        if end:
            self.ends[[i for entry, i in self.tokenizer.get_vocab().items() if entry.endswith(end)]] = True

    def whole(self, text: str) -> bytes:
        (made,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)  # fast: without offsets
        return np.array(made.ids, "<u4").tobytes()

    def keep(self, words: list[bytes], ids: list[bytes]) -> None:
        if self.first is None and len(self) >= WORDS // 2:
            self.first = dict(self)  # words that come early are mostly the frequent ones: they stay
        if len(self) + len(words) > WORDS:
            self.clear()
            self.update(self.first or {})
        short = [len(w) <= WORD_BYTES for w in words]
        self.update(zip(compress(words, short), compress(ids, short)))

    def learn_runs(self, runs: list[bytes]) -> list[bytes]:
        """Ids of runs of letters. Where the vocabulary marks the ends of runs they are encoded as one text."""
        flat = self.whole(b" ".join(runs).decode())
        at = (np.flatnonzero(self.ends[np.frombuffer(flat, "<u4")]) + 1) * 4
        if len(at) == len(runs):
            ends = at.tolist()
            found = [flat[a:b] for a, b in zip([0, *ends], ends)]
        else:
            found = [self.whole(r.decode()) for r in runs]
        self.keep(runs, found)
        return found

    def learn_others(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of any kind, from one text in which a special token stands between them."""
        if self.apart and len(words) > 1:
            mark, number = self.apart
            flat = self.whole(mark.encode().join(words).decode())
            at = (np.flatnonzero(np.frombuffer(flat, "<u4") == number) * 4).tolist()
            if len(at) == len(words) - 1:
                return [flat[a:b] for a, b in zip([0, *[i + 4 for i in at]], [*at, len(flat)])]
        return [self.whole(w.decode()) for w in words]

    def learn(self, new: pa.Array) -> list[bytes]:
        """Ids of new words, all different. A run of letters and the punctuation that closes it are apart to the tokenizer, so each is known by itself."""
        heads = pc.ascii_rtrim(new, CLOSING)
        closed = pc.match_substring_regex(heads, RUN)
        words, runs, others = as_bytes(new.filter(closed)), as_bytes(heads.filter(closed)), as_bytes(new.filter(pc.invert(closed)))
        ids = list(map(self.get, runs))
        if None in ids:
            fresh = list(dict.fromkeys([r for r, i in zip(runs, ids) if i is None]))
            made = dict(zip(fresh, self.learn_runs(fresh)))
            ids = [made[r] if i is None else i for r, i in zip(runs, ids)]
        marked = [(k, w[len(r) :]) for k, (w, r) in enumerate(zip(words, runs)) if len(w) > len(r)]
        marks = {m: self.get(m) or self.whole(m.decode()) for m in {m for _, m in marked}}
        for k, m in marked:
            ids[k] += marks[m]
        self.keep([*marks, *[words[k] for k, _ in marked]], [*marks.values(), *[ids[k] for k, _ in marked]])
        if others:
            rest = self.learn_others(others)
            self.keep(others, rest)
            left, right = iter(ids), iter(rest)
            ids = [next(left) if c else next(right) for c in closed.to_pylist()]
        return ids

    def of_plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens' strings, one after the other, and how many each text has."""
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))  # the tokenizer lower-cases too
        unique = split.flatten().dictionary_encode()
        at = unique.indices.to_numpy(zero_copy_only=False)
        found = list(map(self.get, as_bytes(unique.dictionary)))
        new = [k for k, i in enumerate(found) if i is None]
        if new:
            for k, i in zip(new, self.learn(unique.dictionary.take(pa.array(new)))):
                found[k] = i
        flat = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        each = size[at]
        ends = np.append(0, each.cumsum())
        first = (size.cumsum() - size)[at]
        ids = flat[np.repeat(first - ends[:-1], each) + np.arange(ends[-1])]
        words_to = np.append(0, split.value_lengths().to_numpy(zero_copy_only=False).cumsum())
        return ids, np.diff(ends[words_to])

    def of_texts(self, texts: pa.Array, by_words: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after the other, and how many each text has. Texts that go to the library whole stand between runs of others."""
        raws = texts.cast(pa.binary()).to_pylist()
        alone = [k for k, raw in enumerate(raws) if not by_words or self.specials.search(raw)]
        ids, many, begin = [], [], 0
        for k in [*alone, len(raws)]:
            if begin < k:
                own, n = self.of_plain(texts[begin:k])
                ids.append(own)
                many.append(n)
            if k < len(raws):
                ids.append(np.frombuffer(self.whole(raws[k].decode()), "<u4"))
                many.append(np.array([len(ids[-1])]))
            begin = k + 1
        return np.concatenate(ids or [np.empty(0, "<u4")]), np.concatenate(many or [np.empty(0, np.int64)])

    def by_words(self, text: str) -> bytes:
        return self.of_texts(pa.array([text], pa.string()))[0].tobytes()


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of texts of about GROUP_BYTES."""
    begin, held = 0, 0
    for k, size in enumerate(pc.binary_length(texts).to_pylist()):
        if k > begin and held + size > GROUP_BYTES:
            yield begin, k
            begin, held = k, 0
        held += size
    if begin < len(texts):
        yield begin, len(texts)


def token_rows(path: str, end_id: int, by_words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, pos = word_ids(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).fill_null("")
            for a, b in groups(texts):
                ids, many = words.of_texts(texts[a:b], by_words)
                ids = np.insert(ids, many.cumsum(), end_id)
                n = many + 1
                ends = n.cumsum()
                arrays = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.view("<i4")))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, part), pa.int32()), pa.array(pos + ends - n, pa.int64()), doc_ids[a:b], pa.array(n, pa.int64()), arrays], names=["part", "pos", "doc_id", "n_tokens", "ids"])
                pos += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, at: str, path: str, end_id: int = END_ID, by_words: bool = True, stripe_bytes: int = STRIPE_BYTES, index_rows: int = INDEX_ROWS) -> None:
    """Write docs (doc_id, text) as token files under `at`/tokens, and `at`/parts; path: a file of the tokenizers library that every executor has."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # ties of id and text by where the rows were read, so that the largest group can be split: such rows can be told apart by nothing else
    order = [id_or_last(F.col("doc_id")), F.xxhash64("text"), F.monotonically_increasing_id()]
    keyed = own.select("*", *[o.alias(f"_o{k}") for k, o in enumerate(order)])
    dealt = keyed.repartitionByRange(*[F.col(f"_o{k}") for k in range(3)]).sortWithinPartitions("_o0", "_o1", "_o2").select("doc_id", "text")
    rows = dealt.mapInArrow(token_rows(path, end_id, by_words), ROWS)
    options = {"orc.compress": "zstd", "orc.stripe.size": stripe_bytes, "orc.row.index.stride": index_rows, "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": 0.01}
    rows.write.options(**options).orc(f"{at}/tokens")
    own = docs.sparkSession.read.schema(ROWS).orc(f"{at}/tokens")
    sums = own.groupBy("part").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("ids"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file, no more
    cut(sums).select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"), "documents", "ids", "first_doc", "last_doc").write.orc(f"{at}/parts")


def read_parts(spark: SparkSession, at: str) -> DataFrame:
    """part, start (ids of all files before), documents, ids, first_doc, last_doc: a row for each file."""
    return spark.read.schema("part int, start long, documents long, ids long, first_doc long, last_doc long").orc(f"{at}/parts")


def read_tokens(spark: SparkSession, at: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids. doc_ids: only these, found by ranges and Bloom filters."""
    rows = spark.read.schema(ROWS).orc(f"{at}/tokens")
    if doc_ids is not None:
        rows = rows.filter(F.col("doc_id").isin(doc_ids))
    starts = read_parts(spark, at).select("part", F.col("start").alias("_start"))
    # a row for each file: bounded by their number, not by what they hold
    return rows.join(F.broadcast(starts), "part").select("doc_id", (F.col("_start") + F.col("pos")).alias("start"), "n_tokens", "ids")


def read_range(spark: SparkSession, at: str, first: int, last: int) -> DataFrame:
    """Documents with ids numbered from first to before last; files that have none of them are left out by the parts table."""
    parts = read_parts(spark, at).filter((F.col("start") < last) & (F.col("start") + F.col("ids") > first))
    wanted = [r.part for r in parts.select("part").collect()]  # file numbers
    rows = spark.read.schema(ROWS).orc(f"{at}/tokens").filter(F.col("part").isin(wanted)).join(F.broadcast(parts.select("part", F.col("start").alias("_start"))), "part")
    rows = rows.withColumn("start", F.col("_start") + F.col("pos"))
    return rows.filter((F.col("start") < last) & (F.col("start") + F.col("n_tokens") > first)).select("doc_id", "start", "n_tokens", "ids")


def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, arrays of ids, in place of them its crc32."""
    for batch in batches:
        ids = batch.column(batch.num_columns - 1)
        flat = memoryview(ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
        ends = np.append(0, ids.value_lengths().to_numpy(zero_copy_only=False).cumsum() * 4).tolist()
        crc = [zlib.crc32(flat[i:j]) for i, j in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(crc, pa.int64())], names=[*batch.schema.names[:-1], "ids_crc32"])


def op12_token_files(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    at = shared_path(spark)
    write_tokens(table(spark, sf_dir, "documents"), at, path or public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, at).mapInArrow(checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
