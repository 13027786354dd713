"""Quality rules whose cutoffs come from the corpus: a quantile sketch per language and source.

Each text gives a few rates in parts per million. A sketch is a table of counts over buckets
that are 1/16 of a power of two wide, so sketches merge by adding counts: those of a language
are the sums over its sources, the corpus's the sums over all. A source with fewer than
`min_rows` rows takes its language's sketch, and a language with too few the corpus's. A rate is out of bounds
beyond an upper quantile by more than `reach` spreads of the sketch; where the spread is (almost) nothing, by more than
the rate's floor. Junk-heavy sources don't lift their cutoffs of symbols and repeats: the language's holds there if it is lower.
Rows that fail the fixed base rules don't count in sketches. The cutoffs join the rows by
(lang, source), by broadcast if there are at most MAX_GROUPS of them, so that texts aren't shuffled.

A null text has no words and fails the base rules. Null languages and sources are values of
their own. Repeated rows count each time and get the same verdict. Quantiles are exact up to a bucket's width (interpolated in it), and the same in every run.
An empty table gives an empty result. A very long text is counted as a whole, in memory linear in it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, small_batches, table, utf8

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
MIN_WORDS = 50
MIN_ROWS = 200
MILLION = 1_000_000
#: Rate: numerator, denominator, upper quantile, quantile from which the spread is taken, reach in spreads, floor of the reach in parts per million, whether it is bounded below too.
#: Clean documents repeat lines and words now and then, hence the high quantile there; symbols they hardly have.
RATES = {
    "symbols": ("n_symbols", "word_chars", "q3", "q1", 3, 30_000, False),
    "dup_lines": ("n_dup_lines", "n_lines", "q99", "q2", 1.5, 100_000, False),
    "repeats": ("n_repeat_words", "n_words", "q99", "q2", 2, 100_000, False),
    "word_length": ("word_chars", "n_words", "q3", "q1", 6, 1_000_000, True),
}
QUANTILES = {"q1": 25, "q2": 50, "q3": 75, "q99": 99}


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen, twice = set(), set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    last, n = 0, 0
    for i, w in enumerate(windows):
        if w in twice:
            n += i + 3 - max(i, last)
            last = i + 3
    return n


def counts_of(text: str | None) -> tuple[int, ...]:
    raw = utf8(text)
    words = raw.split()
    blanks = len(raw) - len(raw.translate(None, BLANKS))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), len(text or "") - blanks, symbols, len(lines) - len(set(lines)), repeat_words(words), len(lines)


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def text_counts(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([counts_of(t) for t in texts], columns=list(COUNTS))


text_counts = text_counts.asNondeterministic()  # it isn't random; so the planner evaluates it once a row and doesn't repeat it in filters
#: Cutoffs (a row for each language and source) that may be broadcast.
MAX_GROUPS = 100_000


def base_failed(c) -> Column:
    return (c("n_words") < MIN_WORDS) | (c("n_repeat_words") * 100 > c("n_words") * 50)


def rate(c, name: str) -> Column:
    over, under = RATES[name][:2]
    return F.floor(c(over) * MILLION / F.greatest(c(under), F.lit(1))).cast("long")


def bucket(v: Column) -> Column:
    """0 for 0, else 16 buckets to a power of two."""
    e = F.length(F.bin(v)) - 1
    return F.when(v <= 0, F.lit(0).cast("long")).otherwise((e * 16 + F.floor(v * 16 / F.pow(F.lit(2.0), e)) - 15).cast("long"))


def lower_edge(b: Column) -> Column:
    e = F.floor((b - 1) / 16)
    return F.when(b <= 0, F.lit(0.0)).otherwise(F.pow(F.lit(2.0), e) * ((b - 1) % 16 + 16) / 16)


def sketches(rows: DataFrame, c) -> DataFrame:
    """lang, source, metric, bucket, n: what merges by adding n."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), bucket(rate(c, k)).alias("bucket")) for k in RATES]))
    return rows.filter(~base_failed(c)).select("lang", "source", each.alias("m")).groupBy("lang", "source", "m.metric", "m.bucket").agg(F.count("*").alias("n"))


def limits(sketch: DataFrame, by: list[str]) -> DataFrame:
    """by, metric, rows, low and high: bounds from the merged sketch, low null for rates that have none."""
    merged = sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "metric")
    merged = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("all", F.sum("n").over(w))
    low, high = lower_edge(F.col("bucket")), lower_edge(F.col("bucket") + 1)
    width = F.when(F.col("bucket") <= 0, F.lit(0.0)).otherwise(high - low)
    found = []
    for q, k in QUANTILES.items():
        place = F.col("all") * (k / 100)
        inside = low + width * (place - F.col("upto") + F.col("n")) / F.col("n")
        found.append(F.min(F.when(F.col("upto") >= place, F.struct("bucket", inside.alias("at"))))["at"].alias(q))
    merged = merged.groupBy(*by, "metric").agg(F.max("all").alias("rows"), *found)
    below, above = F.lit(None).cast("double"), F.lit(None).cast("double")
    for k, (_, _, top, start, reach, floor, both) in RATES.items():
        span = F.greatest((F.col(top) - F.col(start)) * reach, F.lit(float(floor)))
        above = F.when(F.col("metric") == k, F.col(top) + span).otherwise(above)
        if both:
            below = F.when(F.col("metric") == k, F.col(start) - span).otherwise(below)
    return merged.select(*by, "metric", "rows", below.alias("low"), above.alias("high"))


def cutoffs(sketch: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """A row for each lang and source in the sketch, with low and high bounds of each rate."""
    own = limits(sketch, ["lang", "source"])
    lang = limits(sketch, ["lang"]).select(F.col("lang").alias("l"), F.col("metric").alias("m"), F.struct("rows", "low", "high").alias("of_lang"))
    total = limits(sketch, []).select(F.col("metric").alias("m2"), F.struct("rows", "low", "high").alias("of_all"))
    found = own.join(lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("metric") == F.col("m"))).join(total, F.col("metric") == F.col("m2"))
    wider = F.when(F.col("of_lang.rows") >= min_rows, F.col("of_lang")).otherwise(F.col("of_all"))
    found = found.withColumn("wider", wider).withColumn("use", F.when(F.col("rows") >= min_rows, F.struct("rows", "low", "high")).otherwise(F.col("wider")))
    bounds = []
    for k, (*_, both) in RATES.items():
        here = F.col("metric") == k
        bounds.append(F.max(F.when(here, F.col("use.high") if both else F.least("use.high", "wider.high"))).alias(f"{k}_high"))
        if both:
            bounds.append(F.max(F.when(here, F.col("use.low"))).alias(f"{k}_low"))
    return found.groupBy("lang", "source").agg(*bounds)


def verdicts(docs: DataFrame, counted: DataFrame | None = None, counts: str = "_counts") -> DataFrame:
    """docs with two booleans in a struct column `counts`_verdict: base_failed and kept; counts stay as `counts`.

    Texts are counted once for the sketches, which are cut, and once for the verdicts. Up to MAX_GROUPS cutoffs are broadcast, so that rows stay where they are.
    """
    small_batches(docs.sparkSession)
    if counted is None:
        counted = docs.withColumn(counts, text_counts("text"))
    c = lambda k: F.col(f"{counts}.{k}")
    bounds = cut(cutoffs(cut(sketches(counted.select("lang", "source", counts), c))))
    few = bounds.count() <= MAX_GROUPS
    bounds = bounds.select(F.struct(*bounds.columns).alias(f"{counts}_bounds"))
    bounds = F.broadcast(bounds) if few else bounds
    b = lambda k: F.col(f"{counts}_bounds.{k}")
    rows = counted.join(bounds, F.col("lang").eqNullSafe(b("lang")) & F.col("source").eqNullSafe(b("source")), "left")
    odd = F.lit(False)
    for k, (*_, both) in RATES.items():
        odd = odd | (rate(c, k) > b(f"{k}_high"))
        if both:
            odd = odd | (rate(c, k) < b(f"{k}_low"))
    failed = F.coalesce(base_failed(c), F.lit(True))
    kept = ~failed & ~F.coalesce(odd, F.lit(False))
    return rows.withColumn(f"{counts}_verdict", F.struct(failed.alias("base_failed"), kept.alias("kept"))).drop(f"{counts}_bounds")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with their columns."""
    counts = fresh(docs, "_counts")
    return verdicts(docs, counts=counts).filter(f"{counts}_verdict.kept").select(*docs.columns)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    counted = cut(docs.select("doc_id", "lang", "source", text_counts("text").alias("_counts")))
    out = verdicts(docs, counted)
    return out.select("doc_id", *[F.col(f"_counts.{k}").alias(k) for k in COUNTS[:5]], "_counts_verdict.base_failed", "_counts_verdict.kept")
