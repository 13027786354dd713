"""URL filters: a sort-merge join of url keys with the intervals of prefix rules.

A key is the host's labels in reverse, each closed by \\x01, then \\x02 and the path, so a
rule's key is a prefix of the keys it fits and covers one interval of them; intervals nest or
lie apart. A rule fits subdomains too: a url asks once for each ancestor of its host (as many
keys as the host has labels). Keys and interval starts are dealt out by key ranges; a rule goes
to every range that its interval meets. Each task sorts its range and sweeps over it once with
a stack of the active rules, whose top is the longest rule for the key.

Range bounds come from a hash sample of bounded size, which decides the balance only. A bound
that occurs several times marks a hot key, whose rows are dealt among those ranges.

Distinct (host, path) are judged once and joined back, so repeated rows get the same verdict.
Null urls and urls without :// have an empty host and path and fit no rule. Of equal rules the
blocking one wins. Empty tables of pages or rules give no rows or no rules.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, table

#: (host, path, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
DEFAULT = "allow"
SAMPLE = 64  # keys a range


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "\x01"), F.lit("\x01"))


def after(key: str) -> str:
    """The least string above all that begin with key."""
    return key[:-1] + chr(ord(key[-1]) + 1) if key and key[-1] < "\U0010fffe" else key + "\U0010ffff"


def bounds_of(probes: DataFrame, ranges: int) -> list[str]:
    sample = probes.select("key").orderBy(F.xxhash64("host", "path", "key")).limit(SAMPLE * ranges).collect()
    keys = sorted(r[0] for r in sample)
    return [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []


def place(bounds: list[str]):
    """Ranges of keys by bisection, ties by the spread."""

    @F.pandas_udf("int")
    def part(keys: pd.Series, spread: pd.Series) -> pd.Series:
        out = []
        for k, s in zip(keys, spread):
            lo, hi = bisect_left(bounds, k), bisect_right(bounds, k)
            out.append(lo + s % (hi - lo + 1))
        return pd.Series(out)

    return part


def met(bounds: list[str]):
    @F.pandas_udf("array<int>")
    def parts(keys: pd.Series) -> pd.Series:
        return pd.Series([list(range(bisect_left(bounds, k), bisect_right(bounds, after(k)) + 1)) for k in keys])

    return parts


def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one or more ranges, each sorted by key, rules first; the stack holds the rules that the key begins with."""
    at, stack = None, []
    for rows in batches:
        out = []
        for part, key, kind, host, path, rule, verdict in rows.itertuples(index=False, name=None):
            if part != at:
                at, stack = part, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, rule, verdict))
            elif stack:
                out.append((host, path, stack[-1][1], stack[-1][2]))
        yield pd.DataFrame(out, columns=["host", "path", "rule", "verdict"])


def longest_rules(urls: DataFrame, rules: DataFrame, ranges: int | None = None) -> DataFrame:
    """host, path, rule, verdict for those distinct (host, path) of urls that a rule fits. rules: host, path, verdict."""
    spark = urls.sparkSession
    small_batches(spark)
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    ancestor = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, -i, i), ".")))
    probes = distinct.filter("host <> ''").select("host", "path", ancestor.alias("up")).select("host", "path", F.concat(reversed_host(F.col("up")), F.lit("\x02"), F.col("path")).alias("key"))
    given = rules.select(F.concat(reversed_host(F.col("host")), F.lit("\x02"), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), "verdict")
    bounds = bounds_of(probes, ranges)
    events = probes.select(place(bounds)("key", F.pmod(F.hash("host", "path"), F.lit(1 << 20))).alias("part"), "key", F.lit(1).alias("kind"), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    events = events.unionByName(given.select(F.explode(met(bounds)("key")).alias("part"), "key", F.lit(0).alias("kind"), F.lit("").alias("host"), F.lit("").alias("path"), "rule", "verdict"))
    swept = events.repartition(ranges, "part").sortWithinPartitions("part", "key", "kind", F.desc("verdict")).mapInPandas(sweep, "host string, path string, rule string, verdict string")
    best = swept.groupBy("host", "path").agg(F.max(F.struct(F.char_length("rule").alias("n"), "verdict", "rule")).alias("best"))
    return best.select("host", "path", "best.rule", "best.verdict")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict: a row for each row of pages (page_id, url)."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    best = cut(longest_rules(rows.filter("host <> ''"), rules))  # cut, so that the join can split the rows of a hot url
    judged = rows.filter("host <> ''").join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    return judged.unionByName(rows.filter("host = ''").withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default)))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


SQL = r"""
WITH u AS (SELECT page_id, row_number() OVER () AS r, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT u.r, max({'n': length(h || p), 'v': v, 'rule': h || p}) AS best FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY u.r)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.v, 'allow') AS verdict FROM u LEFT JOIN m USING (r)
"""
