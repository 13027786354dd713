"""Text columns and TF-IDF tables (long form: paper_id, term, weight)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STYLES = {"plain": "%s %s", "labelled": "Title: %s Abstract: %s", "instruct": "Instruct: %s\nQuery: %s", "sentence": "%s. %s"}
#: Words or terms that a Python worker works on at once; a longer text is a piece of its own.
PIECE = 1 << 16


def compose_text(title: str, abstract: str, style: str) -> Column:
    return F.format_string(STYLES[style], F.col(title), F.col(abstract))


def mask_latex(text: Column | str) -> Column:
    return F.regexp_replace(text, r"\$[^$\n]*\$", "LATEX_CODE")


def accents() -> tuple[str, str]:
    """Latin letters that are a plain one with marks, and those plain ones; then marks of their own, which have no other side."""
    plain = {chr(c): "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))}
    plain = {c: x for c, x in plain.items() if len(x) == 1 and x.isascii()}
    return "".join(plain) + "".join(map(chr, range(0x300, 0x370))), "".join(plain.values())


def tokens(text: str, stop: list[str]) -> Column:
    """Lower-case words of two or more ASCII letters, digits and underscores that begin with no digit and stand alone, accents stripped; without stop words."""
    plain = F.translate(F.lower(F.col(text)), *accents())
    found = F.regexp_extract_all(plain, F.lit(r"(?<![\p{L}\p{N}_])[a-z_][a-z0-9_]+(?![\p{L}\p{N}_])"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(stop)) if stop else found


def pieces(lists: pa.ListArray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """First row and number of rows of runs of lists that hold at most `most` items together, or of single rows."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, end - at
        at = end


def row_numbers(lists: pa.ListArray) -> np.ndarray:
    """The row of each item."""
    return np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))


def grams(words: pa.ListArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Rows, the different words and pairs of neighbours of each, and how often they occur there; in the order of rows."""
    rows, coded = row_numbers(words), words.flatten().dictionary_encode()
    names, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(names)
    first = rows * n + codes
    near = np.flatnonzero(rows[1:] == rows[:-1])
    found, counts = np.unique(np.concatenate([first * (n + 1) + n, first[near] * (n + 1) + codes[near + 1]]), return_counts=True)  # n: no second word
    first, second = found // (n + 1), found % (n + 1)
    pair = names.take(pa.array(second, pa.int64(), mask=second == n))
    return first // max(n, 1), pc.binary_join_element_wise(names.take(pa.array(first % max(n, 1))), pair, " ", null_handling="skip"), counts


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of each text and how often; texts are counted in pieces, so what a worker holds doesn't grow with the batch."""
    for batch in batches:
        for at, n in pieces(batch.column(1)):
            ids, words = (c.slice(at, n) for c in batch.columns)
            rows, terms, tfs = grams(words)
            ends = pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))], names=["paper_id", "terms", "tfs"])


def count_terms(texts: DataFrame, text: str, stop: list[str]) -> DataFrame:
    """paper_id, terms, tfs: the different words and pairs of neighbours of each text and how often, counted in the row. Nothing is shuffled."""
    kind = dict(texts.dtypes)["paper_id"]
    return texts.select("paper_id", tokens(text, stop).alias("words")).mapInArrow(count_grams, f"paper_id {kind}, terms array<string>, tfs array<bigint>")


def by_term(counted: DataFrame) -> DataFrame:
    """paper_id, term, tf: a row for each term of a text."""
    return counted.select("paper_id", F.explode(F.arrays_zip("terms", "tfs")).alias("e")).select("paper_id", F.col("e.terms").alias("term"), F.col("e.tfs").alias("tf"))


def term_counts(texts: DataFrame, text: str, stop: list[str]) -> DataFrame:
    return by_term(count_terms(texts, text, stop))


def fit_tfidf(counts: DataFrame, texts: DataFrame, max_features: int, min_df: int = 1, max_df: float = 1.0) -> DataFrame:
    """term, df, total, idf of the most frequent terms; idf = ln((1 + n) / (1 + df)) + 1, n the number of texts, which is counted when the plan runs."""
    terms = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).filter(F.col("df") >= min_df)
    terms = terms.crossJoin(F.broadcast(texts.agg(F.count("*").alias("n")))).filter(F.col("df") <= max_df * F.col("n"))  # one row
    return terms.orderBy(F.desc("total"), "term").limit(max_features).select("term", "df", "total", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def transform_tfidf(counted: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """paper_id, term, weight: (1 + ln tf) * idf of each text's terms in the vocabulary, of length 1 for each text; counted: see count_terms.

    A text's terms are one row, so it is weighed and scaled there. The vocabulary, at most max_features rows, is read when the plan is made.
    """
    rows = vocabulary.select("term", "idf").collect()
    shared = counted.sparkSession.sparkContext.broadcast(([r.term for r in rows], [r.idf for r in rows]))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, idf = pa.array(shared.value[0], pa.string()), np.array(shared.value[1], float)
        for batch in batches:
            for at, n in pieces(batch.column(1)):
                ids, terms, tfs = (c.slice(at, n) for c in batch.columns)
                place = pc.index_in(terms.flatten(), value_set=names)
                known = place.is_valid().to_numpy(zero_copy_only=False)
                own, place = row_numbers(terms)[known], place.drop_null()
                w = (1 + np.log(tfs.flatten().to_numpy(zero_copy_only=False)[known])) * idf[place.to_numpy(zero_copy_only=False)]
                length = np.sqrt(np.bincount(own, w * w, n))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(own)), names.take(place), pa.array(w / length[own], pa.float64())], names=["paper_id", "term", "weight"])

    kind = dict(counted.dtypes)["paper_id"]
    return counted.select("paper_id", "terms", "tfs").mapInArrow(weigh, f"paper_id {kind}, term string, weight double")


def mean_tfidf_by_group(weights: DataFrame, groups: DataFrame) -> DataFrame:
    """Mean weight of each term over the papers of a group (papers without the term count as 0)."""
    sizes = groups.groupBy("group").agg(F.countDistinct("paper_id").alias("n"))
    sums = groups.distinct().join(weights, "paper_id").groupBy("group", "term").agg(F.sum("weight").alias("w"))
    return sums.join(sizes, "group").select("group", "term", (F.col("w") / F.col("n")).alias("weight"))


def scaled_difference(means: DataFrame, a: str, b: str) -> DataFrame:
    """term, difference: the weights of group a minus those of b, over the largest absolute difference."""
    d = means.groupBy("term").agg(F.sum(F.when(F.col("group") == a, F.col("weight")).when(F.col("group") == b, -F.col("weight")).otherwise(0.0)).alias("d"))
    top = d.agg(F.max(F.abs("d")).alias("top"))
    return d.crossJoin(F.broadcast(top)).select("term", (F.col("d") / F.when(F.col("top") == 0, 1.0).otherwise(F.col("top"))).alias("difference"))


def scaled_coefficients(coefficients: DataFrame, by: list[str]) -> DataFrame:
    """coefficients (by, term, coef) with coef over the largest absolute one of its group."""
    top = coefficients.groupBy(*by).agg(F.max(F.abs("coef")).alias("_top"))
    return coefficients.join(top, by).select(*by, "term", (F.col("coef") / F.when(F.col("_top") == 0, 1.0).otherwise(F.col("_top"))).alias("coef"))


def score_words(words: list[str], scores: dict[str, float], longest: int) -> tuple[float, int]:
    """Sum and number of greedy matches from the left, the longest phrase first; words without a match score 0."""
    total, found, i = 0.0, 0, 0
    while i < len(words):
        for n in range(min(longest, len(words) - i), 0, -1):
            score = scores.get(" ".join(words[i : i + n]))
            if score is not None:
                total, found, i = total + score, found + 1, i + n
                break
        else:
            i += 1
    return total, found


class Phrases:
    """A vocabulary as a tree of words: by depth the sorted keys node * words + word and the nodes that they lead to; what a phrase scores that ends in a node."""

    def __init__(self, scores: dict[str, float]):
        parts = {t: t.split(" ") for t in scores}
        self.scores, self.longest = scores, max(map(len, parts.values()), default=0)
        number = {w: i for i, w in enumerate(dict.fromkeys(w for p in parts.values() for w in p))}
        nodes, levels = {(): 0}, [{} for _ in range(self.longest)]
        for p in parts.values():
            for d, w in enumerate(p):
                levels[d][nodes[tuple(p[:d])] * len(number) + number[w]] = nodes.setdefault(tuple(p[: d + 1]), len(nodes))
        self.words, self.levels = list(number), [(np.array(sorted(x)), np.array([x[k] for k in sorted(x)])) for x in levels]
        self.ends, self.values = np.zeros(len(nodes), bool), np.zeros(len(nodes))
        for t, p in parts.items():
            if scores[t] is not None:
                self.ends[nodes[tuple(p)]], self.values[nodes[tuple(p)]] = True, scores[t]

    def score(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """score_words of each list."""
        words, rows = lists.flatten(), row_numbers(lists)
        if pc.any(pc.match_substring(words, " ")).as_py():  # one word may then look like a phrase
            found = [score_words(w or [], self.scores, self.longest) for w in lists.to_pylist()]
            return np.array([x for x, _ in found]), np.array([n for _, n in found])
        code = pc.fill_null(pc.index_in(words, value_set=pa.array(self.words, pa.string())), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        length, value = np.zeros(len(code), np.int64), np.zeros(len(code))
        at, node = np.arange(len(code)), np.zeros(len(code), np.int64)
        for depth, (keys, to) in enumerate(self.levels):
            inside = at + depth < len(code)
            at, node = at[inside], node[inside]
            inside = (rows[at + depth] == rows[at]) & (code[at + depth] >= 0)
            at, node = at[inside], node[inside]
            key = node * len(self.words) + code[at + depth]
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[place] == key
            at, node = at[hit], to[place[hit]]
            ends = self.ends[node]
            length[at[ends]], value[at[ends]] = depth + 1, self.values[node[ends]]
        taken, free = length > 0, 0
        several = np.flatnonzero(length > 1)
        for i, n in zip(several.tolist(), length[several].tolist()):
            if i >= free:
                free = i + n
                taken[i + 1 : free] = False
        return np.bincount(rows[taken], value[taken], len(lists)), np.bincount(rows[taken], minlength=len(lists))


def score_text(words: Column, scores: dict[str, float]) -> Column:
    """struct(total, matches) of an array of words; scores is a vocabulary of bounded size."""
    phrases = Phrases(scores)

    @F.arrow_udf("total double, matches long")
    def run(batch: pa.Array) -> pa.Array:
        found = [phrases.score(batch.slice(at, n)) for at, n in pieces(batch)] or [(np.zeros(0), np.zeros(0))]
        total, matches = (np.concatenate(x) for x in zip(*found))
        return pa.StructArray.from_arrays([pa.array(total, pa.float64()), pa.array(matches.astype(np.int64))], ["total", "matches"])

    return run(words)


def hashing_encoder(width: int = 64):
    """Texts to vectors of signed counts of hashed words, of length 1; no model."""
    import zlib

    def encode(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * width
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                v[(h >> 1) % width] += 1.0 if h & 1 else -1.0
            size = sum(x * x for x in v) ** 0.5
            out.append([x / size for x in v] if size else v)
        return out

    return encode


def encode_in_batches(texts: list[str], encode, batch: int, tries: int) -> list[list[float]]:
    """All vectors; a failing batch is tried again at half the size, at most `tries` times."""
    out: list[list[float]] = []
    while len(out) < len(texts):
        try:
            out += encode(texts[len(out) : len(out) + batch])
        except (MemoryError, RuntimeError):
            tries, batch = tries - 1, max(1, batch // 2)
            if tries < 0:
                raise
    return out


def encode_texts(texts: DataFrame, column: str, encode=None, known: DataFrame | None = None, batch: int = 256, tries: int = 20) -> DataFrame:
    """paper_id, embedding of the papers that `known` has no vector of. A NULL text counts as empty."""
    encode = encode or hashing_encoder()
    rows = texts.select("paper_id", F.coalesce(F.col(column), F.lit("")).alias("text"))
    rows = rows if known is None else rows.join(known.select("paper_id"), "paper_id", "left_anti")

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"paper_id": pdf.paper_id, "embedding": encode_in_batches(pdf.text.tolist(), encode, batch, tries)})

    return rows.mapInPandas(run, "paper_id long, embedding array<double>")
