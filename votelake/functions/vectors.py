"""Vectors as array<double> columns: normal forms, cosines from sums, standardising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sums import array_sums


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column | str) -> Column:
    """v over its length, which is computed once; a zero vector stays."""
    length = F.transform(F.array(norm(v)), lambda n: F.when(n == 0, 1.0).otherwise(n))
    return F.element_at(F.transform(length, lambda n: F.transform(col(v), lambda x: x / n)), 1)


def concat_embeddings(a: Column | str, b: Column | str) -> Column:
    return F.concat(col(a), col(b))


def temporal_decay(days: Column | str, rate: float) -> Column:
    return F.exp(-F.lit(rate) * col(days))


def sigmoid(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def sigmoid_predict(predictions: DataFrame) -> DataFrame:
    """predictions with proba = sigmoid(logit) and pred = 1 where the logit is above 0."""
    return predictions.withColumn("proba", sigmoid("logit")).withColumn("pred", (F.col("logit") > 0).cast("int"))


def sinusoidal_encoding(days: Column | str, dim: int) -> Column:
    """sin and cos in turn at 10000 ** (-2i / dim)."""
    angle = lambda i: col(days) * F.pow(F.lit(10000.0), -2.0 * F.floor(i / 2) / dim)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(i % 2 == 0, F.sin(angle(i))).otherwise(F.cos(angle(i))))


def vector_sums(df: DataFrame, by: list[str], v: str) -> DataFrame:
    """by, n, sum: element-wise sums; a task passes on one row for each of its groups."""
    return array_sums(df, by, v).select(*by, "n", F.col(v).alias("sum"))


def mean_vectors(df: DataFrame, by: list[str], v: str) -> DataFrame:
    return vector_sums(df, by, v).withColumn("mean", F.transform("sum", lambda x: x / F.col("n")))


def unit_sums(df: DataFrame, by: list[str], v: str) -> DataFrame:
    """by, n, sum of the unit vectors, and nz, how many of the vectors aren't zero: one pass, the count as one more place of the array."""
    rows = df.select(*by, F.concat(l2_normalize(v), F.array((norm(v) > 0).cast("double"))).alias("_u"))
    return array_sums(rows, by, "_u").select(*by, "n", F.slice("_u", F.lit(1), F.size("_u") - 1).alias("sum"), F.element_at("_u", -1).alias("nz"))


def mean_pairwise_cosine(df: DataFrame, by: list[str], v: str) -> DataFrame:
    """by, n, cosine: the mean over pairs of a group, (|S|^2 - n_nonzero) / (n (n - 1)) from the sum S of unit vectors; NULL for one vector.

    Linear in the rows: no pair is made.
    """
    n = F.col("n")
    return unit_sums(df, by, v).select(*by, "n", F.when(n > 1, (dot("sum", "sum") - F.col("nz")) / (n * (n - 1))).alias("cosine"))


def mean_cosine_between(a: DataFrame, b: DataFrame, by: list[str], v: str) -> DataFrame:
    """Mean cosine between the vectors of a and of b that share by; 0 where one side is empty."""
    sa = vector_sums(a.select(*by, l2_normalize(v).alias("u")), by, "u").select(*by, F.col("n").alias("na"), F.col("sum").alias("sa"))
    sb = vector_sums(b.select(*by, l2_normalize(v).alias("u")), by, "u").select(*by, F.col("n").alias("nb"), F.col("sum").alias("sb"))
    return sa.join(sb, by, "full").select(*by, F.coalesce(dot("sa", "sb") / (F.col("na") * F.col("nb")), F.lit(0.0)).alias("cosine"))


def standardize(df: DataFrame, fit: DataFrame, v: str) -> DataFrame:
    """z-scores by the mean and population deviation of fit's vectors; a dimension that doesn't vary is only centred."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    both = Summarizer.metrics("mean", "variance", "count").summary(F.col("_x"))
    stats = fit.select(array_to_vector(F.col(v).cast("array<double>")).alias("_x")).agg(both.alias("s"))  # a row as wide as the vectors
    stats = stats.select(vector_to_array("s.mean").alias("_m"), vector_to_array("s.variance").alias("_q"), F.col("s.count").alias("_n"))
    st = F.arrays_zip("_m", F.transform("_q", lambda q: F.sqrt(q * (F.col("_n") - 1) / F.col("_n"))).alias("_s"))
    z = F.zip_with(col(v), F.col("st"), lambda x, s: (x - s["_m"]) / F.when(s["_s"] == 0, 1.0).otherwise(s["_s"]))
    return df.crossJoin(F.broadcast(stats.select(st.alias("st")))).withColumn(v, z).drop("st")


def override_embeddings(a: DataFrame, b: DataFrame) -> DataFrame:
    """All ids of both; b's vector where both have one."""
    return a.select("paper_id", F.col("embedding").alias("_a")).join(b.select("paper_id", F.col("embedding").alias("_b")), "paper_id", "full").select("paper_id", F.coalesce("_b", "_a").alias("embedding"))


def category_cohesion(embeddings: DataFrame, papers: DataFrame, level: str = "l1") -> DataFrame:
    rows = embeddings.join(papers.select("paper_id", level).filter(F.col(level).isNotNull()), "paper_id")
    return mean_pairwise_cosine(rows, [level], "embedding")


def subcategory_cohesion(embeddings: DataFrame, papers: DataFrame) -> DataFrame:
    """l1 and the mean cohesion of its l2 groups of two or more papers."""
    inner = category_cohesion(embeddings, papers, "l2").filter("n >= 2")
    named = papers.select("l1", "l2").filter("l1 IS NOT NULL AND l2 IS NOT NULL").distinct()
    return named.join(inner, "l2").groupBy("l1").agg(F.count("*").alias("n_groups"), F.avg("cosine").alias("cosine"))


def category_separation(embeddings: DataFrame, papers: DataFrame, reference: str, level: str = "l1") -> DataFrame:
    """Mean cosine between the papers of each category and those of the reference; for the reference itself, between its own papers."""
    rows = embeddings.join(papers.select("paper_id", level).filter(F.col(level).isNotNull()), "paper_id")
    sums = vector_sums(rows.select(level, l2_normalize("embedding").alias("u")), [level], "u")
    ref = sums.filter(F.col(level) == reference).select(F.col("n").alias("_n"), F.col("sum").alias("_s"))
    own = category_cohesion(embeddings, papers, level).select(level, F.col("cosine").alias("_own"))
    between = sums.crossJoin(F.broadcast(ref)).join(own, level)  # ref: one row
    return between.select(level, F.when(F.col(level) == reference, F.col("_own")).otherwise(dot("sum", "_s") / (F.col("n") * F.col("_n"))).alias("cosine"))


def category_centroids(embeddings: DataFrame, papers: DataFrame, reference: str, level: str = "l1") -> DataFrame:
    """Length of each category's mean vector and its cosine to the reference category's."""
    means = mean_vectors(embeddings.join(papers.select("paper_id", level).filter(F.col(level).isNotNull()), "paper_id"), [level], "embedding")
    ref = means.filter(F.col(level) == reference).select(F.col("mean").alias("ref"))
    return means.crossJoin(F.broadcast(ref)).select(level, "n", norm("mean").alias("length"), (dot("mean", "ref") / (norm("mean") * norm("ref"))).alias("cosine"))


def merge_embedding_batches(*batches: DataFrame) -> DataFrame:
    """All batches as one table; repeated_ids shows what they must not share."""
    out = batches[0].select("paper_id", "embedding")
    for b in batches[1:]:
        out = out.unionByName(b.select("paper_id", "embedding"))
    return out


def repeated_ids(embeddings: DataFrame) -> DataFrame:
    return embeddings.groupBy("paper_id").agg(F.count("*").alias("n")).filter("n > 1")


def filter_embeddings(embeddings: DataFrame, ids: DataFrame) -> DataFrame:
    return embeddings.join(ids.select("paper_id"), "paper_id", "left_semi")


def compare_embeddings(before: DataFrame, after: DataFrame, papers: DataFrame, level: str = "l1") -> DataFrame:
    """Cohesion of each category before and after, and the difference."""
    a, b = (category_cohesion(e, papers, level).select(level, F.col("cosine").alias(n)) for e, n in ((before, "before"), (after, "after")))
    return a.join(b, level, "full").select(level, "before", "after", (F.col("after") - F.col("before")).alias("difference"))


def category_measures(embeddings: DataFrame, papers: DataFrame, references: list[str], level: str = "l1") -> DataFrame:
    """measure, reference, category, cosine: cohesion, cohesion of the subcategories (both without a reference), and for each reference category centroid (cosine of the mean vectors) and separation (mean cosine of the papers)."""
    none, name = F.lit(None).cast("string"), F.col(level).alias("category")
    out = category_cohesion(embeddings, papers, level).select(F.lit("cohesion").alias("measure"), none.alias("reference"), name, "cosine")
    out = out.unionByName(subcategory_cohesion(embeddings, papers).select(F.lit("subcategories").alias("measure"), none.alias("reference"), F.col("l1").alias("category"), "cosine"))
    for r in references:
        for measure, found in (("centroid", category_centroids), ("separation", category_separation)):
            out = out.unionByName(found(embeddings, papers, r, level).select(F.lit(measure).alias("measure"), F.lit(r).alias("reference"), name, "cosine"))
    return out


def compare_measures(before: DataFrame, after: DataFrame, papers: DataFrame, references: list[str], level: str = "l1") -> DataFrame:
    """category_measures before and after, for the papers that have a vector before, and the difference."""
    after = filter_embeddings(after, before)
    a, b = (category_measures(e, papers, references, level).withColumnRenamed("cosine", n) for e, n in ((before, "before"), (after, "after")))
    b = b.withColumnsRenamed({c: f"_{c}" for c in ("measure", "reference", "category")})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("measure", "reference", "category")]
    return a.join(b, same[0] & same[1] & same[2]).select("measure", "reference", "category", "before", "after", (F.col("after") - F.col("before")).alias("difference"))


def cluster_similarity(embeddings: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Per cluster: mean cosine inside, mean cosine to all other clusters, and (inside - outside) / the larger. From sums; clusters are few."""
    rows = embeddings.join(labels.select("paper_id", label).filter(F.col(label).isNotNull()), "paper_id")
    sums = unit_sums(rows, [label], "embedding")
    whole = vector_sums(rows.select(l2_normalize("embedding").alias("u")), [], "u").select(F.col("n").alias("_n"), F.col("sum").alias("_s"))
    n, rest = F.col("n"), F.col("_n") - F.col("n")
    own = dot("sum", "sum")
    out = sums.crossJoin(F.broadcast(whole)).select(label, "n", F.when(n > 1, (own - F.col("nz")) / (n * (n - 1))).alias("inside"), F.when(rest > 0, (dot("sum", "_s") - own) / (n * rest)).alias("outside"))
    return out.withColumn("score", (F.col("inside") - F.col("outside")) / F.greatest("inside", "outside"))


def category_vectors(words: DataFrame, vectors: DataFrame, norm_to: str = "none", beside: int = 0) -> DataFrame:
    """category, vec: weighted sums of word vectors (words: category, word, weight; vectors: word, vec), as they are (none), of length 1 (unit) or 0.5 (half), or
    of their share of a width when they stand beside vectors of `beside` places (proportional). A word without a vector adds nothing."""
    parts = words.join(vectors, "word").select("category", F.transform("vec", lambda x: x * F.col("weight")).alias("v"))
    sums = vector_sums(parts, ["category"], "v").select("category", F.col("sum").alias("vec"))
    if norm_to == "none":
        return sums
    size = {"unit": F.lit(1.0), "half": F.lit(0.5), "proportional": F.size("vec") / (F.size("vec") + beside)}[norm_to]
    return sums.withColumn("vec", F.transform(l2_normalize("vec"), lambda x: x * size))


def paper_category_vectors(papers: DataFrame, names: DataFrame, vectors: DataFrame, width: int, level: str = "l1") -> DataFrame:
    """paper_id, category, vec: the vector of each paper's category under its new name (names: original, category); zeros for papers without a category.

    A category that names or vectors don't have gives NULL, which the caller may check for.
    """
    zeros = F.array_repeat(F.lit(0.0), width)
    renamed = papers.select("paper_id", F.col(level).alias("original")).join(names, "original", "left").join(vectors.select("category", "vec"), "category", "left")
    return renamed.select("paper_id", "category", F.when(F.col("original").isNull(), zeros).otherwise(F.col("vec")).alias("vec"))


def pca(df: DataFrame, fit: DataFrame, v: str, dim: int) -> DataFrame:
    """df with v centred by fit's mean, projected on fit's first dim components and of length 1; as it is where dim isn't below the width.

    Spark's PCA sums a covariance as large as the width squared; the sign of a component is free.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    first = fit.select(F.size(v).alias("w")).first()
    if first is None or dim >= first["w"]:
        return df
    mean = mean_vectors(fit, [], v).select(F.col("mean").alias("_m"))
    centred = lambda d: d.crossJoin(F.broadcast(mean)).withColumn("_c", array_to_vector(F.zip_with(v, "_m", lambda x, m: x - m)))
    model = PCA(k=dim, inputCol="_c", outputCol="_p").fit(centred(fit))
    return model.transform(centred(df)).withColumn(v, l2_normalize(vector_to_array("_p"))).drop("_m", "_c", "_p")
