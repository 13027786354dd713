"""Sample weights and scorers without a fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, l2_normalize, vector_sums
from .products import Best, against


#: Of a count: what a scheme by transformed counts weighs classes by.
TRANSFORMED = {
    "constant": lambda n: F.lit(1.0), "cube_root": F.cbrt, "logarithm": lambda n: F.log(n + 1), "square_root": F.sqrt, "linear": lambda n: n.cast("double"), "square": lambda n: F.pow(n, F.lit(2.0)), "exponential": F.exp,
}


def transformed_weights(rated: Column, other: Column, total: Column, kind: str, both: bool, importance: Column | float) -> tuple[Column, Column]:
    """Weights of a rated and an unrated class of one label, which share the weight of all rows by importance * f(n).

    both: f transforms both counts; else the unrated count is taken as it is, and a constant is a half.
    """
    f = TRANSFORMED[kind]
    a = importance * (F.lit(0.5) if kind == "constant" and not both else f(rated))
    b = (1 - importance) * (f(other) if both else other.cast("double"))
    one = F.when(other == 0, F.when(rated > 0, 1 / rated)).when(rated > 0, a / ((a + b) * rated)).otherwise(0.0)
    two = F.when(other > 0, b / ((a + b) * other)).otherwise(0.0)
    return one * total, two * total


def class_weights(counts: DataFrame, scheme: str, v: Column | float = 0.9, neg_scale: Column | float = 1.0, cache_scale: Column | float = 1.0, pos_importance: Column | float = 1.0) -> DataFrame:
    """counts (n_pos, n_neg, n_cache, and n_base if there are further positives) with w_pos, w_neg, w_cache (and w_base).

    cache_v: up-votes carry the weight of all rows, down-votes and cache share as much in proportion v to 1 - v a row;
    cache_v_s_normalized scales up-votes by 1 - neg_scale too; no_v: each class has weight 1 (the cache cache_scale);
    both_<kind> and rated_<kind>: transformed_weights, down-votes with importance v against the cache, up-votes with
    pos_importance against the base. A class without rows has NULL (cache_v) or 0. Parameters may be columns of counts.
    """
    p, n, c = F.col("n_pos"), F.col("n_neg"), F.col("n_cache")
    style, _, kind = scheme.partition("_")
    base = None
    if scheme == "no_v":
        share = lambda top, k: F.when(k > 0, top / k).otherwise(0.0)
        pos, neg, cache = share(F.lit(1.0), p), share(F.lit(1.0), n), share(F.lit(cache_scale) if isinstance(cache_scale, float) else cache_scale, c)
    elif scheme in ("cache_v", "cache_v_s_normalized"):
        total, low = p + n + c, v * n + (1 - v) * c
        pos, unit = F.when(p > 0, total / p), F.when(low > 0, total / low)
        neg, cache = v * unit, (1 - v) * unit
        pos = pos * (1 - neg_scale) if scheme == "cache_v_s_normalized" else pos
    elif style in ("both", "rated") and kind in TRANSFORMED:
        more = F.col("n_base") if "n_base" in counts.columns else F.lit(0)
        total = p + n + c + more
        pos, base = transformed_weights(p, more, total, kind, style == "both", pos_importance)
        neg, cache = transformed_weights(n, c, total, kind, style == "both", v)
    else:
        raise ValueError(f"unknown scheme {scheme}")
    out = counts.select("*", pos.alias("w_pos"), (neg * neg_scale).alias("w_neg"), (cache * neg_scale).alias("w_cache"))
    return out if base is None or "n_base" not in counts.columns else out.withColumn("w_base", base)


def similarity_to_likes(votes: DataFrame, embeddings: DataFrame, rating: int = 0) -> DataFrame:
    """user_id, paper_id, t, similarity: mean cosine of each vote with the rating to the user's up-votes, from the sum of their unit vectors."""
    unit = votes.join(embeddings.select("paper_id", l2_normalize("embedding").alias("u")), "paper_id")
    likes = vector_sums(unit.filter("rating = 1"), ["user_id"], "u")
    return unit.filter(F.col("rating") == rating).join(likes, "user_id").select("user_id", "paper_id", "t", (dot("u", "sum") / F.col("n")).alias("similarity"))


def similarity_weights(similarities: DataFrame, scaling: str, param: float | None = None) -> DataFrame:
    """weight of each row from its similarity, mean 1 for each user; rows that all get 0 weigh 1 each."""
    s, user = F.col("similarity"), Window.partitionBy("user_id")

    def inside(low: Column, high: Column | None = None) -> Column:
        return F.when((s >= low) & (F.lit(True) if high is None else s <= high), 1.0).otherwise(0.0)

    top = F.max("similarity").over(user)
    raw = {
        "clip": lambda: F.greatest(s, F.lit(0.0)),
        "linear": lambda: s + 1,
        "softmax": lambda: F.exp((s - top) / param),
        "inverse": lambda: F.greatest(1 - s, F.lit(0.0)),
        "gaussian": lambda: F.exp(-((s - param) * (s - param)) / (2 * 0.15**2)),
        "percentile": lambda: inside(F.percentile("similarity", param / 100).over(user), F.percentile("similarity", 1 - param / 100).over(user)),
        "threshold": lambda: inside(F.lit(0.2 if param is None else param)),
        "none": lambda: s,
    }[scaling]()
    rows = similarities.withColumn("_w", raw)
    total = F.sum("_w").over(user)
    return rows.withColumn("weight", F.when(total == 0, 1.0).otherwise(F.col("_w") * F.count("*").over(user) / total)).drop("_w")


def max_pooling_scores(pairs: DataFrame, likes: DataFrame, embeddings: DataFrame) -> DataFrame:
    """pairs (user_id, paper_id, t, ...) with logit: the largest product with a liked vector, 0 without likes. Products are taken in blocks."""
    cand = candidates(pairs, embeddings)
    liked = likes.select("user_id", "paper_id").distinct().join(embeddings.withColumnRenamed("embedding", "_v"), "paper_id").select("user_id", F.col("paper_id").alias("_id"), F.lit(1).alias("_label"), "_v")
    best = against(cand, liked, ["user_id"], lambda: Best(1), "array<array<double>>")
    return best.select("_row.*", F.coalesce(F.get(F.col("found")[1], F.lit(0)), F.lit(0.0)).alias("logit"))


def candidates(pairs: DataFrame, embeddings: DataFrame) -> DataFrame:
    rows = pairs.distinct().join(embeddings.withColumnRenamed("embedding", "_v"), "paper_id")
    return rows.select("user_id", F.struct(*pairs.columns).alias("_row"), F.col("paper_id").alias("_id"), "_v")


def knn_scores(pairs: DataFrame, votes: DataFrame, embeddings: DataFrame, ks: list[int], alpha: float = 1.0) -> DataFrame:
    """pairs with k and knn for each k: alpha * (softmax-weighted mean of the k largest cosines to up-votes minus the same for down-votes); a missing side counts 0.

    The largest cosines are kept while the votes go past a block of pairs; a pair of a user without votes has no row.
    """
    unit = embeddings.select("paper_id", l2_normalize("embedding").alias("embedding"))
    known = votes.filter("rating <> 2").select("user_id", "paper_id", F.col("rating").alias("_label")).distinct()
    known = known.join(unit.withColumnRenamed("embedding", "_v"), "paper_id").select("user_id", F.col("paper_id").alias("_id"), "_label", "_v")
    most = max(ks)
    near = against(candidates(pairs, unit), known, ["user_id"], lambda: Best(most), "array<array<double>>").filter("size(found[0]) + size(found[1]) > 0")
    near = near.withColumn("k", F.explode(F.array(*[F.lit(k).cast("long") for k in ks])))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)

    def side(r: int) -> Column:
        top = F.slice(F.col("found")[r], F.lit(1), F.col("k").cast("int"))
        return F.when(F.size(top) > 0, total(F.transform(top, lambda s: F.exp(s) * s)) / total(F.transform(top, F.exp))).otherwise(0.0)

    return near.select("_row.*", "k", (alpha * (side(1) - side(0))).alias("knn"))


def knn_score(pairs: DataFrame, votes: DataFrame, embeddings: DataFrame, k: int = 3, alpha: float = 1.0) -> DataFrame:
    return knn_scores(pairs, votes, embeddings, [k], alpha).drop("k")
