"""Cross-tokenizer alignment: where the tokens of two vocabularies end together, and how often their ids meet there.

Each text is tokenised whole by both sides. The token bytes of both, joined, must equal a space and
the text; a text for which they don't has no tokens. Ends that both sides have before a token
marked with a space are anchors; they cut the document into windows of token ids. A window's
alignment depends on its ids alone, so it is kept by the pair of id tuples and met again for every
repeated word: only new windows are walked token by token.

Tokens whose ends coincide form a link. As the bytes of the shorter are a suffix of the longer's,
there are at most as many different id pairs as pairs of entries with that property
(`pair_bound`, some hundred thousand for vocabularies of 50,000), however many documents there are: so the table
of pair counts may be broadcast. No text is shuffled.

A null or empty text has no tokens: zeros, and no groups. Repeated ids and null ids: a row for each
row. Very long texts are encoded in pieces cut before single spaces, where neither kind of tokenizer joins
tokens; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import json
import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_wide, small_batches, table

#: Code points that a tokenizer reads at once; bounds what one very long text costs in memory.
PIECE_CHARS = 1 << 20
#: Windows of up to so many tokens are kept, so many of them; longer ones (no spaces) are walked each time.
WINDOW_TOKENS, WINDOWS = 64, 3 << 17
#: Added to ids of A in a window's key.
OF_A = 1 << 31
#: Bytes of groups in one batch of output.
OUT_BYTES = 8 << 20
#: Links gathered in a task before they are summed.
GATHERED = 1 << 21

SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"


def byte_alphabet() -> dict[str, int]:
    """Byte by the character that stands for it in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted({*range(256)} - {*plain})
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Side:
    """One tokenizer: `encode` of a piece of text that a space comes before, and the bytes of each id."""

    def __init__(self, encode, entries: list[bytes], lossless: bool = False):
        self.encode, self.entries, self.lossless = encode, entries, lossless  # lossless: the ids' bytes are the text's, by construction
        self.length = np.array([len(e) for e in entries], np.int64)
        self.spaced = np.array([e[:1] == b" " for e in entries])
        self.sizes, self.names = self.length.tolist(), [str(i) for i in range(len(entries))]


#: Texts of these alone: letters, numbers and blanks among them are the same in every version of Unicode that a regex engine may know.
SETTLED = re.compile("[\\x00-\u024F\u2010-\u2027\u2030-\u205E\u20AC]*")


def ranked_encoder(vocab: dict[bytes, int], merges: list):
    """An encoder by ranks with the vocabulary of a byte-level tokenizer whose ids are in the order of its merges; none if they aren't."""
    import tiktoken

    ids = [vocab.get(left + right, -1) for left, right in merges]
    if sorted(ids) != ids or ids[:1] == [-1] or len(vocab) != len(merges) + 256:
        return None
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab, special_tokens={}).encode_ordinary


@lru_cache(1)
def byte_side(path: str) -> Side:
    """A byte-level tokenizer file; strings of special tokens inside a text are plain text.

    Where the file's ids are in the order of its merges, texts of settled characters are encoded by rank, which gives the same ids in a third of the time;
    tests hold the two against each other.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer, alphabet = Tokenizer.from_file(path), byte_alphabet()
    tokenizer.encode_special_tokens = True
    vocab, plain = tokenizer.get_vocab(with_added_tokens=True), tokenizer.get_vocab(with_added_tokens=False)
    raw = lambda entry: bytes(map(alphabet.__getitem__, entry))
    entries = [b""] * (max(vocab.values()) + 1)
    for entry, i in vocab.items():
        entries[i] = raw(entry) if entry in plain else entry.encode()
    model = json.loads(tokenizer.to_str())["model"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ranked = ranked_encoder({raw(e): i for e, i in plain.items()}, [(raw(x), raw(y)) for x, y in pairs])

    def encode(text: str) -> list[int]:
        if ranked is not None and (text.isascii() or SETTLED.fullmatch(text)):
            return ranked(" " + text)
        return tokenizer.encode(" " + text, add_special_tokens=False).ids

    made = json.loads(tokenizer.to_str())
    as_it_is = made["normalizer"] is None and made["pre_tokenizer"].get("type") == "ByteLevel" and not made["pre_tokenizer"]["add_prefix_space"]
    return Side(encode, entries, as_it_is and len({bytes([i]) for i in range(256)} & {*entries}) == 256)


@lru_cache(1)
def piece_side(path: str) -> Side:
    """A sentence-piece model with byte fallback, which puts a space before the text itself."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
    return Side(lambda text: model.encode(text, num_threads=1), [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces])


def pieces(text: str, most: int) -> list[str]:
    """The text cut at single spaces between other characters, which go; a piece ends at the first such place after `most` code points."""
    if len(text) <= most:
        return [text]
    out, at, single = [], 0, re.compile(r"(?<=\S) (?=\S)")
    while len(text) - at > most and (m := single.search(text, at + most)):
        out.append(text[at : m.start()])
        at = m.end()
    return [*out, text[at:]]


def groups_of(a: list[int], b: tuple, size_a: list[int], size_b: list[int]) -> list[tuple]:
    """Tokens of both sides cut wherever both end at one byte; none has no bytes, so ends only grow."""
    at_b = dict(zip(accumulate(map(size_b.__getitem__, b)), range(1, len(b) + 1)))
    out, first_i, first_j = [], 0, 0
    for i, end in enumerate(accumulate(map(size_a.__getitem__, a)), 1):
        if j := at_b.get(end):
            out.append((a[first_i:i], b[first_j:j]))
            first_i, first_j = i, j
    return out


class Windows(dict):
    """Alignments by the ids of a window, those of A (marked, so that they are told from B's) and then those of B: the groups as text and the pairs of
    ids that close them, or nothing where the bytes of both sides differ.

    The first half that is met stays, as words that come early are mostly the frequent ones; the other half is forgotten whenever it is full.
    """

    def __init__(self, left: Side, right: Side):
        super().__init__()
        self.left, self.right, self.first = left, right, None

    def __missing__(self, key: bytes) -> tuple[str, tuple] | None:
        left, right, ids = self.left, self.right, struct.unpack(f"<{len(key) // 4}I", key)
        n = next(k for k, i in enumerate(ids) if i < OF_A)
        a, b = [i - OF_A for i in ids[:n]], ids[n:]
        bytes_a, bytes_b = [left.entries[i] for i in a], [right.entries[i] for i in b]
        name_a, name_b, width = left.names, right.names, len(right.names)
        if bytes_a == bytes_b:  # one token each
            value = ";".join([name_a[x] + "|" + name_b[y] for x, y in zip(a, b)]), tuple([x * width + y for x, y in zip(a, b)])
        elif b"".join(bytes_a) == b"".join(bytes_b):
            found = groups_of(a, b, left.sizes, right.sizes)
            text = ";".join([",".join([name_a[i] for i in x]) + "|" + ",".join([name_b[i] for i in y]) for x, y in found])
            value = text, tuple([x[-1] * width + y[-1] for x, y in found])
        else:
            value = None
        if len(ids) <= WINDOW_TOKENS:
            if self.first is None and len(self) >= WINDOWS // 2:
                self.first = dict(self)
            if len(self) >= WINDOWS:
                self.clear()
                self.update(self.first)
            self[key] = value
        return value


def windows_of(a: np.ndarray, b: np.ndarray, left: Side, right: Side) -> list[bytes]:
    """Ids of A and B from each start that both sides share to the next: of tokens marked with a space that start at one byte on both, and of token 0."""
    at_a, at_b = np.flatnonzero(left.spaced[a[1:]]), np.flatnonzero(right.spaced[b[1:]])
    start_a, start_b = left.length[a].cumsum()[at_a], right.length[b].cumsum()[at_b]
    shared = np.zeros(max(start_a[-1] if len(start_a) else 0, start_b[-1] if len(start_b) else 0) + 1, np.uint8)
    shared[start_a] = 1
    shared[start_b] += 1  # starts of one side are all different
    i = np.concatenate([[0], at_a[shared[start_a] == 2] + 1, [len(a)]])
    j = np.concatenate([[0], at_b[shared[start_b] == 2] + 1, [len(b)]])
    both = np.empty(len(a) + len(b), "<u4")  # a window's ids of A, then its ids of B, then the next window's
    both[np.arange(len(a)) + np.repeat(j[:-1], np.diff(i))] = a + OF_A
    both[np.arange(len(b)) + np.repeat(i[1:], np.diff(j))] = b
    packed, ends = both.tobytes(), (4 * (i + j)).tolist()
    return [packed[x:y] for x, y in zip(ends, ends[1:])]


def align(text: str | None, windows: Windows, most: int = PIECE_CHARS) -> tuple[int, int, str, list[int]]:
    """Numbers of tokens, groups as text, and the links as pair codes. The bytes of A's ids are the text's; those of B's are held against them window by window."""
    left, right = windows.left, windows.right
    cut = pieces(text, most) if text else []
    a, b = ([i for piece in cut for i in side.encode(piece)] if len(cut) > 1 else side.encode(*cut) if cut else [] for side in (left, right))
    if not a or not b or not (left.lossless or b"".join(map(left.entries.__getitem__, a)) == f" {text}".encode()):
        return 0, 0, "", []
    ids_a, ids_b = np.array(a, np.uint32), np.array(b, np.uint32)
    if left.length[ids_a].sum() != right.length[ids_b].sum():
        return 0, 0, "", []
    found = list(map(windows.__getitem__, windows_of(ids_a, ids_b, left, right)))
    if None in found:
        return 0, 0, "", []
    return len(a), len(b), ";".join([f[0] for f in found]), list(chain.from_iterable([f[1] for f in found]))


def aligned_rows(path_a: str, path_b: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(byte_side(path_a), piece_side(path_b))
        gc.disable()  # nothing here is in a cycle, and walking all kept windows time and again takes a third of the time
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]
        kinds = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        rows, held = [], 0

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n_a, n_b, groups, links = align(text.as_py(), windows, most)
                pairs, times = np.unique(np.array(links, np.int64), return_counts=True)
                rows.append((doc_id, n_a, n_b, len(links), len(links), groups, pairs, times.astype(np.int32)))
                held += len(groups) + 12 * len(pairs)
                if held > OUT_BYTES:
                    yield batch_of()
                    rows, held = [], 0
        if rows:
            yield batch_of()
        gc.enable()

    return run


def align_tokens(docs: DataFrame, path_a: str, path_b: str, most: int = PIECE_CHARS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups ("a1,a2|b1;a3|b2,b3"), and the different pairs of ids that end together with how often.

    A pair is the id of A times the size of B's vocabulary, plus the id of B. path_a: a byte-level tokenizer file; path_b: a sentence-piece model.
    Both must lie at these paths on every executor.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(aligned_rows(path_a, path_b, most), SCHEMA)


def pair_bound(path_a: str, path_b: str) -> int:
    """How many pairs of entries can end together: one's bytes are a suffix of the other's."""
    a, b = ({e for e in side.entries if e} for side in (byte_side(path_a), piece_side(path_b)))
    tails = lambda e: (e[k:] for k in range(len(e)))
    return sum(t in b for e in a for t in tails(e)) + sum(t in a for e in b for t in tails(e) if t != e)


def summed(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, at = np.unique(pairs, return_inverse=True)
    total = np.zeros(len(own), np.int64)
    np.add.at(total, at, times)
    return own, total


def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each pair of a task."""
    pairs, times, held = [], [], 0
    for batch in batches:
        pairs.append(batch.column(0).flatten().to_numpy(zero_copy_only=False))
        times.append(batch.column(1).flatten().to_numpy(zero_copy_only=False))
        held += len(pairs[-1])
        if held > GATHERED:
            pairs, times = ([x] for x in summed(np.concatenate(pairs), np.concatenate(times)))
            held = 0
    if pairs:
        own, total = summed(np.concatenate(pairs), np.concatenate(times))
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(total, pa.int64())], names=["pair", "n"])


def count_pairs(aligned: DataFrame, width: int) -> DataFrame:
    """pair, id_a, id_b, n (links of all documents), best (n is the largest of its id_b); width: the size of B's vocabulary."""
    counts = aligned.select("pairs", "times").mapInArrow(partial_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = counts.select("pair", F.floor(F.col("pair") / width).alias("id_a"), F.pmod("pair", F.lit(width)).alias("id_b"), "n")
    top = counts.groupBy("id_b").agg(F.max("n").alias("top"))
    return counts.join(top, "id_b").select("pair", "id_a", "id_b", "n", (F.col("n") == F.col("top")).alias("best"))


def score_links(aligned: DataFrame, counts: DataFrame, bound: int) -> DataFrame:
    """aligned with n_best (links whose count is their id_b's largest) and count_sum. counts has at most `bound` rows, see pair_bound."""
    rows = counts.select("pair", "n", "best").sort("pair").toArrow()
    if rows.num_rows > bound:
        raise ValueError(f"{rows.num_rows} pairs of ids, though only {bound} can end together")
    shared = aligned.sparkSession.sparkContext.broadcast(tuple(rows.column(c).to_numpy() for c in ("pair", "n", "best")))
    at = aligned.columns.index("pairs"), aligned.columns.index("times")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            pairs, times = (batch.column(k) for k in at)
            row = np.repeat(np.arange(batch.num_rows), pairs.value_lengths().to_numpy(zero_copy_only=False))
            where, k = np.searchsorted(pair, pairs.flatten().to_numpy(zero_copy_only=False)), times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            out = np.zeros((2, batch.num_rows), np.int64)
            if len(row):
                np.add.at(out[0], row, np.where(best[where], k, 0))
                np.add.at(out[1], row, k * n[where])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out[0]), pa.array(out[1])], names=[*batch.schema.names, "n_best", "count_sum"])

    kinds = ", ".join(f"`{c}` {kind}" for c, kind in aligned.dtypes)
    return aligned.mapInArrow(run, f"{kinds}, n_best long, count_sum long")


def op11_alignment(spark: SparkSession, sf_dir: str, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    path_a, path_b = path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")
    aligned = align_tokens(table(spark, sf_dir, "documents"), path_a, path_b)
    aligned = cut_wide(aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.when(F.col("n_links") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"), "pairs", "times"))
    scored = score_links(aligned, count_pairs(aligned, len(piece_side(path_b).sizes)), pair_bound(path_a, path_b))
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
