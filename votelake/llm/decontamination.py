"""Benchmark decontamination by latent semantic search, with a subsequence and an answer check.

Texts become lower-case words and overlapping windows of words. A window's latent vector is its
TF-IDF row times the leading right singular vectors of a window matrix, over their singular values.
They come from a randomised SVD that is fitted once, on all documents and the whole
benchmark: each round multiplies windows by a thin matrix where they are and
sums the products by term. The terms are the benchmark's words (beyond `SLOTS` of them, words share
slots by hash; none is left out); how many documents hold each is counted over all documents.

Every window of every document is searched. An item is looked at where the words around a window
hold so many of its rarer words that a subsequence of `SHARE` of the item is possible at all (an
exact gate: its most frequent words make up less than what may be missing). There the window is
compared with the item's windows, two words apart, by cosine, and pairs over `COSINE` are checked
on the words around: the longest common subsequence must hold `SHARE` of the item's words and
`ANSWER` of its answer's (the item's last sentence), which also finds paraphrases that keep most
words. Items of fewer than `MIN_WORDS` words are too short for that: they match where all their
words stand consecutively.

The benchmark is searched in blocks of `BLOCK_ITEMS` items, one after the other; a block is all of
it that the driver or a task holds. Each further block reads the documents again.

Null and empty texts match nothing, and neither do items without words. An item without an id is
searched like any other, its matches have a null item_id. Repeated rows match alike; repeated items
match each. Of equally good places of an item the first counts. Empty tables give no matches.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, cut_wide, fresh, small_batches, table, utf8

STEP = 8  # a window is two steps
SLOTS = 1 << 18
RANK = 32
OVER = 8
ROUNDS = 2
SHIFT = 2  # words between an item's windows
PRODUCT_STEPS = 2048  # in one product; its rows stay in the processor's cache
SUM_TERMS = 1024  # whose products one task adds up
BLOCK_ITEMS = 20_000
COSINE = 0.2
SHARE = 0.6
COMMON = 0.3  # of an item's words; less than SHARE
ANSWER = 0.5
MIN_WORDS = 8
MATCH = "array<struct<item_id:long,n_common:long,share:double,cosine:double,first_word:long>>"

#: A-Z to a-z; ASCII signs and controls to blanks.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).translate(FOLD).split()


class Hashed:
    """Slots of words by hash, for a benchmark with more words than slots."""

    def __init__(self, n: int):
        self.n = n

    def get(self, word: bytes, _: int) -> int:
        return xxhash.xxh64_intdigest(word) % self.n


class Terms:
    """Slots of the benchmark's words; all others have the slot `n`, whose weight is 0."""

    def __init__(self, words: list[bytes]):
        small = len(words) <= SLOTS
        self.slots = {w: i for i, w in enumerate(sorted(words))} if small else Hashed(SLOTS)
        self.n = len(words) if small else SLOTS
        self.sorted = pa.array(sorted(words), pa.binary()) if small else None

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.slots.get, words, repeat(self.n)), np.int64, len(words))

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Slots of all words of the texts, one after the other, and how many words each text has; the words are those of `words_of`."""
        texts = texts.cast(pa.string()).fill_null("")
        _, ends, raw = texts.buffers()
        folded = pa.py_buffer((raw.to_pybytes() if raw else b"").translate(FOLD))
        split = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(texts), ends, folded, None, 0, texts.offset))
        words, many = split.flatten().cast(pa.binary()), split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # blanks at a text's ends leave empty words
        if not full.all():
            many = np.bincount(np.repeat(np.arange(len(many)), many)[full], minlength=len(many))
            words = words.filter(pa.array(full))
        if self.sorted is None:
            unique = words.dictionary_encode()
            return self.of(unique.dictionary.to_pylist())[unique.indices.to_numpy(zero_copy_only=False)], many
        return pc.index_in(words, value_set=self.sorted).fill_null(self.n).to_numpy(zero_copy_only=False).astype(np.int64), many


def held_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array({w for text in batch.column(0).to_pylist() for w in words_of(text)}, pa.binary())], names=["term"])


def counted(terms: Broadcast):
    """Slots with the number of documents that hold them; slot -1 has the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, n = terms.value.n + 1, 0
        df = np.zeros(slots, np.int64)
        for batch in batches:
            n += batch.num_rows
            at, many = terms.value.of_texts(batch.column(0))
            held = np.unique(np.repeat(np.arange(len(many)), many) * slots + at)
            df += np.bincount(held % slots, minlength=slots)
        at = np.flatnonzero(df[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["slot", "df"])

    return run


def item_windows(ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A vector for each window, SHIFT words apart, so that one is near wherever a text's windows begin. An item that is shorter is one window; weights has a zero row at its end."""
    each = weights.take(ids, axis=0)
    last = max(0, len(ids) - 2 * STEP)
    return np.stack([each[a : a + 2 * STEP].sum(0) for a in (*range(0, last, SHIFT), last)])


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def product_of(terms: Broadcast, idf: np.ndarray, basis: np.ndarray):
    """Texts to the rows of A'A * basis that they add, by slot (A: unit TF-IDF rows of steps of words)."""
    n = len(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = np.column_stack((idf[:, None] * basis, idf**2)).astype(np.float32)
        out = np.zeros((n, basis.shape[1]), np.float32)

        def add(at: np.ndarray, many: np.ndarray) -> None:
            """at: known slots; many: how many of them each step has."""
            order = np.argsort(-many, kind="stable")
            many, first = many[order], (np.cumsum(many) - many)[order]
            back = np.zeros((len(many), table_.shape[1]), np.float32)
            step = np.empty(len(at), np.int64)
            for k in range(many[0]):  # the steps' words number k; steps that have one come first
                left = int(np.searchsorted(-many, -k))
                back[:left] += table_.take(at[first[:left] + k], axis=0)
                step[first[:left] + k] = np.arange(left)
            back = back[:, :-1] / back[:, -1:]
            order = np.argsort(at, kind="stable")
            at = at[order]
            begin = np.flatnonzero(np.diff(at, prepend=-1))
            out[at[begin]] += np.add.reduceat(back.take(step[order], axis=0), begin)

        for batch in batches:
            at, many = terms.value.of_texts(batch.column(0))
            steps = many // STEP + 1
            step = (np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)) // STEP + np.repeat(np.cumsum(steps) - steps, many)
            known = at < n
            at = at[known].astype(np.uint16 if n < 1 << 16 else np.int64)  # the sort of short integers is linear
            held = np.bincount(step[known])
            held = held[held > 0]
            ends = np.append(0, held.cumsum())
            for k in range(0, len(held), PRODUCT_STEPS):
                part = held[k : k + PRODUCT_STEPS]
                add(at[ends[k] : ends[k + len(part)]], part)
        found = np.flatnonzero(out.any(1))
        for k in range(0, len(found), 4096):
            part = found[k : k + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(list(out[part] * idf[part, None]), pa.list_(pa.float32()))], names=["term", "v"])

    return run


def summed(rows: pd.DataFrame) -> pd.DataFrame:
    terms, to = np.unique(rows.term.to_numpy(), return_inverse=True)
    out = np.zeros((len(terms), len(rows.v.iloc[0])), np.float32)
    np.add.at(out, to, np.stack(rows.v.to_numpy()))
    return pd.DataFrame({"term": terms, "v": list(out)})


def latent_basis(texts: DataFrame, terms: Broadcast, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Leading right singular vectors (slots x rank) of the texts' window matrix over their singular values.

    A randomised subspace iteration; the last product also gives the singular values. Dividing by them keeps the few
    directions that all texts of a language share from ruling the cosine.
    """
    width = min(rank + OVER, len(idf))
    basis = np.random.default_rng(1).standard_normal((len(idf), width)).astype(np.float32)
    for _ in range(ROUNDS):
        basis = np.linalg.qr(basis)[0].astype(np.float32)
        parts = texts.mapInArrow(product_of(terms, idf, basis), "term long, v array<float>")
        rows = parts.groupBy(F.pmod("term", F.lit(max(16, -(-len(idf) // SUM_TERMS)))).alias("b")).applyInPandas(summed, "term long, v array<float>").toArrow()
        product = np.zeros_like(basis)
        if rows.num_rows:
            product[rows["term"].to_numpy()] = np.stack(rows["v"].to_numpy())
        basis, last = product, basis
    power, turn = np.linalg.eigh((last.T @ basis + basis.T @ last).astype(np.float64) / 2)
    strong = [k for k in range(width - 1, max(-1, width - 1 - rank), -1) if power[k] > power[-1] * 1e-7 + 1e-12]
    found = (last @ turn[:, strong] / np.sqrt(power[strong])).astype(np.float32)
    return found / np.sqrt(np.mean(found**2)) if found.size else np.ones((len(idf), 1), np.float32)


class Latent:
    """The benchmark's terms, the documents that hold them, and each term's weights in the latent space."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame):
        spark = docs.sparkSession
        texts = benchmark.filter("text IS NOT NULL").select("text")
        words = texts.mapInArrow(held_terms, "term binary").distinct().limit(SLOTS + 1).collect()
        self.terms = Terms([bytes(r.term) for r in words])
        held = spark.sparkContext.broadcast(self.terms)
        seen = docs.select("text").mapInArrow(counted(held), "slot long, df long").groupBy("slot").agg(F.sum("df").alias("df")).toArrow()
        self.df = np.zeros(self.terms.n + 2, np.int64)
        self.df[seen["slot"].to_numpy()] = seen["df"].to_numpy()  # the last one is slot -1
        n, self.df = int(self.df[-1]), self.df[:-1]
        idf = (np.log((n + 1) / (self.df[:-1] + 1.0)) + 1).astype(np.float32)
        basis = latent_basis(docs.select("text").unionByName(texts), held, idf)
        self.weights = np.concatenate((idf[:, None] * basis, np.zeros((1, basis.shape[1]), np.float32)))
        held.unpersist()


def common_words(masks: dict[bytes, int], n: int, words: list[bytes]) -> int:
    """Length of the longest common subsequence, by rows of bits; masks: where each of the item's n words stands."""
    full = (1 << n) - 1
    v = full
    for w in words:
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def held_words(masks: dict[bytes, int], words: list[bytes]) -> int:
    """How many of the item's words are among words: no subsequence is longer."""
    have = 0
    for w in set(words).intersection(masks):
        have |= masks[w]
    return have.bit_count()


def places(words: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def pairs_from(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs start .. start + size: the run's number and the place, one after the other."""
    run = np.repeat(np.arange(len(size)), size)
    return run, np.arange(len(run)) + np.repeat(start - np.cumsum(size) + size, size)


class Searcher:
    """A block of the benchmark with all that a task needs to look for it."""

    def __init__(self, items: list[tuple[int | None, str]], latent: Latent):
        self.terms, self.weights = latent.terms, latent.weights
        self.items, self.vectors, self.phrases = [], [], {}
        size, need, rare = [], [], []
        for item, text in items:
            words = words_of(text)
            if len(words) < MIN_WORDS:
                if words:
                    self.phrases.setdefault(words[0], []).append((item, words))
                continue
            ids = self.terms.of(words)
            answer = words_of(re.split(r"(?<=[.!?])\s+", text.strip())[-1])
            least = int(np.ceil(SHARE * len(words) - 1e-9))
            slots, many = np.unique(ids, return_counts=True)
            order = np.argsort(-latent.df[slots], kind="stable")
            left = np.cumsum(many[order]) <= COMMON * len(words)  # the most frequent words are not counted
            size.append(len(words))
            need.append(least - int(many[order][left].sum()))
            rare += [(s, len(self.items), m) for s, m in zip(slots[order][~left].tolist(), many[order][~left].tolist())]
            self.vectors.append(unit(item_windows(ids, self.weights)).T.copy())
            self.items.append((item, len(words), places(words), len(answer), places(answer)))
        self.size, self.need = np.array(size, np.int64), np.array(need, np.int64)
        rare.sort()
        slot, self.owner, self.many = np.array(rare, np.int64).reshape(-1, 3).T
        self.first = np.searchsorted(slot, np.arange(self.terms.n + 2))
        self.begins = np.zeros(self.terms.n + 1, bool)  # slots of the phrases' first words
        self.begins[self.terms.of(list(self.phrases))] = True

    def candidates(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, window) pairs around which enough of the item's rarer words stand, sorted."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        slots, to = np.unique(ids, return_inverse=True)
        size = self.first[slots + 1] - self.first[slots]
        run, at = pairs_from(self.first[slots], size)
        enough = np.bincount(self.owner[at], self.many[at], len(self.items)) >= self.need
        if not enough.any():
            return none
        keep = enough[self.owner[at]]
        run, at = run[keep], at[keep]
        # each place of a word, for each of the left items that hold it
        size = np.bincount(run, minlength=len(slots))
        place, k = pairs_from((np.cumsum(size) - size)[to], size[to])
        held = at[k]
        order = np.argsort(held, kind="stable")
        place, held = place[order], held[order]
        owner = self.owner[held]
        n = max(1, -(-len(ids) // STEP) - 1)
        lo = np.clip((place - 2 * STEP - self.size[owner]) // STEP + 1, 0, n - 1)
        hi = np.clip((place + self.size[owner]) // STEP, 0, n - 1)
        again = np.flatnonzero(held[1:] == held[:-1]) + 1
        lo[again] = np.maximum(lo[again], hi[again - 1] + 1)
        some = lo <= hi
        lo, hi, owner, many = lo[some], hi[some], owner[some], self.many[held[some]]
        left = np.flatnonzero(enough)
        row = np.searchsorted(left, owner) * (n + 1)
        change = np.bincount(row + lo, many, len(left) * (n + 1)) - np.bincount(row + hi + 1, many, len(left) * (n + 1))
        item, window = np.nonzero(np.cumsum(change.reshape(len(left), n + 1), axis=1) >= self.need[left, None] - 0.5)
        return left[item], window

    def matches(self, text: str | None) -> list[dict]:
        return self.matches_of(pa.array([text], pa.string()))[0]

    def matches_of(self, texts: pa.Array) -> list[list[dict]]:
        """The matches of each text. Words are made only for texts that may have one."""
        ids, many = self.terms.of_texts(texts)
        ends = many.cumsum()
        return [self.matches_at(text, ids[a:b]) for text, a, b in zip(texts, (ends - many).tolist(), ends.tolist())]

    def matches_at(self, text: pa.StringScalar, ids: np.ndarray) -> list[dict]:
        """The matches of a text with these slots."""
        out = self.whole(words_of(text.as_py())) if self.phrases and self.begins[ids].any() else []
        if not len(ids) or not self.items:
            return out
        item, window = self.candidates(ids)
        if not len(item):
            return out
        words = words_of(text.as_py())
        used = np.unique(window)
        padded = np.full((len(used), 2 * STEP), self.terms.n)
        at = used[:, None] * STEP + np.arange(2 * STEP)
        padded[at < len(ids)] = ids[at[at < len(ids)]]
        v = unit(self.weights.take(padded, axis=0).sum(1))
        begin = np.flatnonzero(np.diff(item, prepend=-1))
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(item)]):
            own = window[a:b]
            near = (v[np.searchsorted(used, own)] @ self.vectors[item[a]]).max(1)
            best = self.best(self.items[item[a]], words, own, near)
            if best:
                out.append(best)
        return out

    @staticmethod
    def best(item: tuple, words: list[bytes], windows: np.ndarray, near: np.ndarray) -> dict | None:
        """The first of the places with the longest subsequence, if any is long enough."""
        name, n, masks, n_answer, answer = item
        found = None
        for i in np.flatnonzero(near >= COSINE).tolist():
            first = max(0, int(windows[i]) * STEP - n)
            around = words[first : (int(windows[i]) + 2) * STEP + n]
            if held_words(masks, around) < max(SHARE * n, found["n_common"] + 1 if found else 0):
                continue
            got = common_words(masks, n, around)
            if got >= SHARE * n and got > (found["n_common"] if found else 0) and common_words(answer, n_answer, around) >= ANSWER * n_answer:
                found = {"item_id": name, "n_common": got, "share": got / n, "cosine": round(float(near[i]), 4), "first_word": first}
        return found

    def whole(self, words: list[bytes]) -> list[dict]:
        """Short items, all of whose words stand consecutively."""
        out = []
        for w in set(words).intersection(self.phrases):
            starts = [i for i, x in enumerate(words) if x == w]
            for name, phrase in self.phrases[w]:
                at = next((i for i in starts if words[i : i + len(phrase)] == phrase), None)
                if at is not None:
                    out.append({"item_id": name, "n_common": len(phrase), "share": 1.0, "cosine": 1.0, "first_word": at})
        return out


def searchers(docs: DataFrame, benchmark: DataFrame) -> Iterator[Searcher]:
    """One for each block of the benchmark, made when it is asked for."""
    small_batches(docs.sparkSession)
    items = benchmark.filter("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = -(-items.count() // BLOCK_ITEMS)
    latent = Latent(docs, items) if blocks else None
    for b in range(blocks):
        own = [(r.item_id, r.text) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]
        yield Searcher(sorted(own, key=lambda x: (x[0] is None, x)), latent)


def search(held: Broadcast):
    @F.pandas_udf(MATCH)
    def matches(texts: pd.Series) -> pd.Series:
        return pd.Series(held.value.matches_of(pa.Array.from_pandas(texts, type=pa.string())))

    return matches


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and item_id, n_common, share, cosine and first_word of each match of docs' text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_common long, share double, cosine double, first_word long")
    for searcher in searchers(docs, benchmark):
        held = docs.sparkSession.sparkContext.broadcast(searcher)
        found = docs.select("doc_id", search(held)("text").alias("m"))
        # outer, as Spark would otherwise filter by the column's size first and search twice
        out = out.unionByName(cut(found.select("doc_id", F.explode_outer("m").alias("m")).filter("m IS NOT NULL").select("doc_id", "m.*")))
        held.unpersist()
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that match no item, with their columns."""
    at = fresh(docs, "_leaks")
    left, ready = docs, None
    for searcher in searchers(docs.select("doc_id", "text"), benchmark):
        if ready is not None:  # one block at a time: the last one's result is written before the next is made
            left = cut_wide(ready)
        held = docs.sparkSession.sparkContext.broadcast(searcher)
        ready = left.withColumn(at, search(held)("text")).filter(F.size(at) == 0).select(*docs.columns)
    return docs if ready is None else ready


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
