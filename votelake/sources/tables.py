"""Reading, checking and writing the model's tables.

Times are microseconds since 1970 (column t), so that differences are integers. Ratings are 1
(up), 0 (down) and 2 (neutral).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NEUTRAL = 2


def keep(df: DataFrame, ids: DataFrame | None, column: str, columns: list[str] | None) -> DataFrame:
    df = df if ids is None else df.join(ids.select(column).distinct(), column, "left_semi")
    return df.select(*columns) if columns else df


def load_ratings(spark: SparkSession, path: str, users: DataFrame | None = None, columns: list[str] | None = None, include_neutral: bool = False) -> DataFrame:
    df = spark.read.parquet(path)
    return keep(df if include_neutral else df.filter(F.col("rating") != NEUTRAL), users, "user_id", columns)


def load_papers(spark: SparkSession, path: str, papers: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    return keep(spark.read.parquet(path), papers, "paper_id", columns)


def load_embeddings(spark: SparkSession, path: str, ids: DataFrame | None = None, kind: str = "array<float>") -> DataFrame:
    return keep(spark.read.parquet(path), ids, "paper_id", None).withColumn("embedding", F.col("embedding").cast(kind))


def load_word_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    return word_vectors(spark.read.text(path), dim)


def word_vectors(lines: DataFrame, dim: int) -> DataFrame:
    """word and vec from text lines (value) of a word and dim numbers."""
    parts = F.split("value", " ")
    return lines.select(parts[0].alias("word"), F.slice(parts, 2, dim).cast("array<float>").alias("vec"))


def read_raw_votes(spark: SparkSession, url: str, table: str, partition_column: str, partitions: int, bounds: tuple[int, int] | None = None, neutral: bool = False, **options: str) -> DataFrame:
    """Up and down votes with a time (or the neutral ones), from a database, read in ranges of the partition column; the conditions and columns are the database's.

    bounds: of the ranges; without them one query asks the database for the smallest and largest value. Rows beyond the bounds are in the first and last range.
    """
    source = lambda **more: spark.read.format("jdbc").options(url=url, **options, **more).load()
    if bounds is None:
        ends = source(query=f"SELECT MIN({partition_column}) AS LOW, MAX({partition_column}) AS HIGH FROM {table}").first()
        bounds = (0, 1) if ends[0] is None else (int(ends[0]), max(int(ends[1]), int(ends[0]) + 1))
    df = source(dbtable=table, partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return raw_votes(df.toDF(*[c.lower() for c in df.columns]), neutral)


def raw_votes(votes: DataFrame, neutral: bool = False) -> DataFrame:
    """Up and down votes (or the neutral ones, rating 0) with a time."""
    return votes.filter((F.col("rating") == 0 if neutral else F.col("rating").isin(-1, 1)) & F.col("time").isNotNull())


def cache_ids(cache: DataFrame) -> DataFrame:
    """The distinct papers of the cache."""
    return cache.select("paper_id").filter("paper_id IS NOT NULL").distinct()


def load_papers_texts(spark: SparkSession, path: str, papers: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    return keep(spark.read.parquet(path), papers, "paper_id", columns)


def load_significant_categories(spark: SparkSession, path: str, users: DataFrame | None = None) -> DataFrame:
    return keep(spark.read.parquet(path), users, "user_id", ["user_id", "rank", "category", "proportion"])


def repeated_ids(embeddings: DataFrame) -> DataFrame:
    """paper_id and n of the ids that an embedding table holds more than once."""
    return embeddings.groupBy("paper_id").agg(F.count("*").alias("n")).filter("n > 1")


def check_selections(selections: DataFrame) -> DataFrame:
    """One row: users and those that are in more than one selection (user_id, selection)."""
    per = selections.groupBy("user_id").agg(F.countDistinct("selection").alias("n"))
    return per.agg(F.count("*").alias("n_users"), F.count_if(F.col("n") > 1).alias("n_overlapping"))


def check_texts(papers: DataFrame, texts: DataFrame) -> DataFrame:
    """One row: papers without a text and texts without a paper."""
    a, b = papers.select("paper_id").distinct().withColumn("a", F.lit(1)), texts.select("paper_id").distinct().withColumn("b", F.lit(1))
    return a.join(b, "paper_id", "full").agg(F.count_if(F.col("b").isNull()).alias("n_without_text"), F.count_if(F.col("a").isNull()).alias("n_without_paper"))


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    out = df.write.mode("overwrite").option("compression", "gzip")
    (out.partitionBy(*by) if by else out).parquet(path)


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def check_ratings(ratings: DataFrame) -> DataFrame:
    """One row: rows, NULLs, and votes whose session goes back while time goes on."""
    w = Window.partitionBy("user_id").orderBy("t", "paper_id")
    back = F.coalesce(F.col("session_id") < F.lag("session_id").over(w), F.lit(False))
    rows = ratings.withColumn("back", back)
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in ("user_id", "paper_id", "rating", "t", "session_id")]
    return rows.agg(F.count("*").alias("n_rows"), *nulls, F.count_if("back").alias("n_back"))


def check_papers(papers: DataFrame) -> DataFrame:
    """One row: rows, repeated ids, NULL flags, papers with one of l1 and l2 alone."""
    counts = papers.groupBy("paper_id").agg(F.count("*").alias("n"), F.count_if(F.col("in_cache").isNull()).alias("no_flag"), F.count_if(F.col("l1").isNull() != F.col("l2").isNull()).alias("half"))
    return counts.agg(F.sum("n").alias("n_rows"), F.count_if(F.col("n") > 1).alias("n_repeated"), F.sum("no_flag").alias("n_no_flag"), F.sum("half").alias("n_half"))


def check_categories(categories: DataFrame, least: float = 0.1, most: int = 4) -> DataFrame:
    per = categories.groupBy("user_id").agg(F.count("*").alias("n"), F.min("proportion").alias("p"))
    return per.agg(F.count("*").alias("n_users"), F.count_if(F.col("n") > most).alias("n_too_many"), F.count_if(F.col("p") < least).alias("n_too_small"))


# The driver's tables under the names of the model.


def papers_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("paper_id"), "label")
    known = F.col("paper_id") % 17 != 0
    l1 = F.concat(F.lit("C"), F.col("label").cast("string"))
    return e.select("paper_id", (F.col("paper_id") % 4 == 0).alias("in_cache"), F.when(known, l1).alias("l1"), F.when(known, F.concat(l1, F.lit("."), (F.col("paper_id") % 3).cast("string"))).alias("l2"))


def embeddings_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("paper_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def raw_votes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, paper_id, vote (-1, 0, 1), ts."""
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    vote = F.when(F.col("event_type").isin("click", "purchase"), 1).when(F.col("event_type").isin("error", "signup"), -1).otherwise(0)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", (F.col("event_id") % n).alias("paper_id"), vote.alias("vote"), "ts")


def texts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(F.col("doc_id").alias("paper_id"), F.split("text", "\n")[0].alias("title"), F.col("text").alias("abstract"), F.col("source").alias("authors"))
