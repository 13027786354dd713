"""Scores and quality measures of predictions (user_id, split, paper_id, label, logit)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, mean_vectors, sigmoid, sigmoid_predict
from .large_models import MAX_BYTES, Fit, fit_large, sums_at, with_ones

EPS = 1e-15


def mean_positive_embedding(votes: DataFrame, embeddings: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or ["user_id"]
    return mean_vectors(votes.filter("rating = 1").join(embeddings, "paper_id"), by, "embedding").select(*by, F.col("mean").alias("profile"))


def predict(profiles: DataFrame, pairs: DataFrame, embeddings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """pairs with logit = profile . vector (0 without a profile). Vectors are joined last."""
    rows = pairs.join(profiles, by or ["user_id"], "left").join(embeddings, "paper_id")
    return rows.withColumn("logit", F.coalesce(dot("profile", "embedding"), F.lit(0.0))).drop("profile", "embedding")


def predict_models(models: DataFrame, pairs: DataFrame, embeddings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """pairs with logit = coef . vector + intercept, proba and pred of the models (by, coef, intercept); by may hold the session, for models of their own."""
    rows = pairs.join(models.select(*(by or ["user_id"]), "coef", "intercept"), by or ["user_id"]).join(embeddings, "paper_id")
    return sigmoid_predict(rows.withColumn("logit", dot("coef", "embedding") + F.col("intercept")).drop("coef", "intercept", "embedding"))


def classification_outcome(label: str = "label", proba: str = "proba") -> Column:
    p, y = F.col(proba) >= 0.5, F.col(label) == 1
    return F.when(p & y, "TP").when(p, "FP").when(y, "FN").otherwise("TN")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def classification_metrics(predictions: DataFrame, by: list[str]) -> DataFrame:
    yes, pos = F.col("logit") > 0, F.col("label") == 1
    counts = predictions.groupBy(*by).agg(F.count_if(yes & pos).alias("tp"), F.count_if(yes & ~pos).alias("fp"), F.count_if(~yes & ~pos).alias("tn"), F.count_if(~yes & pos).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    recall, spec = ratio(tp, tp + fn), ratio(tn, tn + fp)
    return counts.select(*by, "tp", "fp", "tn", "fn", ((tp + tn) / (tp + fp + tn + fn)).alias("accuracy"), recall.alias("recall"), spec.alias("specificity"), ((recall + spec) / 2).alias("balanced_accuracy"), ratio(tp, tp + fp).alias("precision"), ((tp + fn) / (tp + fp + tn + fn)).alias("label_share"), ((tp + fp) / (tp + fp + tn + fn)).alias("prediction_share"))


def log_loss(predictions: DataFrame, by: list[str]) -> DataFrame:
    p = F.least(F.greatest(sigmoid("logit"), F.lit(EPS)), F.lit(1 - EPS))
    one = F.when(F.col("label") == 1, -F.log(p)).otherwise(-F.log(1 - p))
    return predictions.groupBy(*by).agg(F.avg(one).alias("log_loss"), F.avg(F.when(F.col("label") == 1, one)).alias("log_loss_pos"), F.avg(F.when(F.col("label") == 0, one)).alias("log_loss_neg"))


def confidence_metrics(predictions: DataFrame, by: list[str]) -> DataFrame:
    p = sigmoid("logit")
    yes, pos = F.col("logit") > 0, F.col("label") == 1
    half = lambda c: F.coalesce(F.avg(F.when(c, p)), F.lit(0.5))
    return predictions.groupBy(*by).agg(F.avg(p).alias("conf_all"), half(yes & pos).alias("conf_tp"), half(yes & ~pos).alias("conf_fp"), half(~yes & ~pos).alias("conf_tn"), half(~yes & pos).alias("conf_fn"), F.min(F.when(pos, p)).alias("conf_pos_min"), F.avg(F.when(pos, p)).alias("conf_pos"), F.avg((p > 0.05).cast("double")).alias("share_above"))


def sample_confidence(samples: DataFrame) -> DataFrame:
    """user_id, the largest probability of the user's sampled negatives (user_id, logit) and the share of them above 0.05."""
    p = sigmoid("logit")
    return samples.groupBy("user_id").agg(F.max(p).alias("conf_samples_max"), F.avg((p > 0.05).cast("double")).alias("samples_above"))


def auroc(predictions: DataFrame, by: list[str]) -> DataFrame:
    """From ranks, ties sharing their mean rank; NULL without both labels."""
    w = Window.partitionBy(*by)
    ties = Window.partitionBy(*by, "logit")
    rows = predictions.withColumn("r", F.rank().over(w.orderBy("logit")) + (F.count("*").over(ties) - 1) / 2)
    pos = F.col("label") == 1
    agg = rows.groupBy(*by).agg(F.sum(F.when(pos, F.col("r"))).alias("s"), F.count_if(pos).alias("p"), F.count_if(~pos).alias("n"))
    return agg.select(*by, F.when((F.col("p") > 0) & (F.col("n") > 0), (F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("n"))).alias("auroc"))


def rank_positives(pos: DataFrame, negatives: DataFrame, keys: list[str]) -> DataFrame:
    """rank = 1 + negatives with a logit at least the up-vote's (pessimistic). keys join an up-vote to its negatives."""
    neg = negatives.select(*keys, F.col("logit").alias("neg_logit"))
    return pos.join(neg, keys, "left").groupBy(*pos.columns).agg((1 + F.count_if(F.col("neg_logit") >= F.col("logit"))).alias("rank"))


def rank_positives_by_kind(pos: DataFrame, explicit: DataFrame, samples: DataFrame, keys: list[str]) -> DataFrame:
    """pos with rank_explicit (among its explicit negatives, by keys), rank_samples (among its user's sampled ones) and rank_all; pessimistic on ties."""
    e = rank_positives(pos, explicit, keys).withColumnRenamed("rank", "rank_explicit")
    s = samples.select("user_id", F.col("logit").alias("_s"))
    both = e.join(s, "user_id", "left").groupBy(*e.columns).agg((1 + F.count_if(F.col("_s") >= F.col("logit"))).alias("rank_samples"))
    return both.withColumn("rank_all", F.col("rank_explicit") + F.col("rank_samples") - 1)


def softmax_by_kind(pos: DataFrame, explicit: DataFrame, samples: DataFrame, keys: list[str], temperature: float) -> DataFrame:
    """Per up-vote, from a softmax over it, its explicit and its user's sampled negatives: its share, the explicit ones' mean, the samples' largest, InfoNCE."""
    own = pos.withColumn("z0", F.col("logit") / temperature)
    e = explicit.select(*keys, F.lit(True).alias("given"), (F.col("logit") / temperature).alias("z"))
    s = own.select(*keys).join(samples.select("user_id", F.lit(False).alias("given"), (F.col("logit") / temperature).alias("z")), "user_id").select(*e.columns)
    sums = own.join(e.unionByName(s), keys).groupBy(*own.columns).agg(F.greatest(F.max("z"), F.max("z0")).alias("m"), F.collect_list(F.struct("given", "z")).alias("zs"))  # as many as an up-vote has negatives
    each = F.transform("zs", lambda x: F.struct(x["given"].alias("given"), F.exp(x["z"] - F.col("m")).alias("w")))
    sums = sums.withColumn("w0", F.exp(F.col("z0") - F.col("m"))).withColumn("ws", each).withColumn("total", F.col("w0") + F.aggregate("ws", F.lit(0.0), lambda a, x: a + x["w"]))
    of = lambda given: F.transform(F.filter("ws", lambda x: x["given"] == given), lambda x: x["w"] / F.col("total"))
    mean = F.when(F.size(of(True)) > 0, F.aggregate(of(True), F.lit(0.0), lambda a, x: a + x) / F.size(of(True)))
    share = F.col("w0") / F.col("total")
    return sums.select(*pos.columns, share.alias("share"), mean.alias("explicit_mean"), F.array_max(of(False)).alias("samples_max"), (-F.log(share + 1e-10)).alias("info_nce"))


def ranking_metrics(ranked: DataFrame, by: list[str]) -> DataFrame:
    r = F.col("rank")
    return ranked.groupBy(*by).agg(F.avg(1 / F.log2(r + 1)).alias("ndcg"), F.avg(1 / r).alias("mrr"), F.avg((r == 1).cast("double")).alias("hr1"), F.min(1 / F.log2(r + 1)).alias("ndcg_min"))


def softmax_metrics(pos: DataFrame, negatives: DataFrame, keys: list[str], temperature: float) -> DataFrame:
    """Per up-vote: its softmax share among its negatives and InfoNCE = -ln(share + 1e-10)."""
    neg = negatives.select(*keys, (F.col("logit") / temperature).alias("z"))
    rows = pos.withColumn("z0", F.col("logit") / temperature).join(neg, keys)
    top = F.greatest(F.max("z"), F.max("z0"))
    sums = rows.groupBy(*pos.columns, "z0").agg(top.alias("m"), F.collect_list("z").alias("zs"))  # as many as an up-vote has negatives
    share = F.exp(F.col("z0") - F.col("m")) / (F.exp(F.col("z0") - F.col("m")) + F.aggregate("zs", F.lit(0.0), lambda s, z: s + F.exp(z - F.col("m"))))
    return sums.withColumn("share", share).select(*pos.columns, "share", (-F.log(F.col("share") + 1e-10)).alias("info_nce"))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float, rounds: int = 100) -> np.ndarray:
    """Coefficients and intercept minimising |w|^2 / 2 + c * sum(weight * log-loss); the intercept isn't penalised. Damped Newton."""
    return converged_fit(x, y, weight, c, rounds)[0]


def converged_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float, rounds: int = 100) -> tuple[np.ndarray, bool]:
    """fit_logistic and whether it ended by its own rule."""
    z, fit = with_ones(x), Fit(c, x.shape[1])
    for _ in range(rounds):
        if fit.done:
            break
        fit.advance(sums_at(z, y, weight, fit.at()))
    return fit.theta, fit.converged


#: Papers of the shared cache that a fit may hold; the matrix goes to every task.
MAX_CACHE = 20_000
def train_user_models(votes: DataFrame, embeddings: DataFrame, weights: DataFrame, cache: DataFrame | None = None, by: list[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """by, combination_idx, coef, intercept, converged: logistic fits of each user's rated votes and the shared cache papers as negatives.

    weights: by, combination_idx, c, w_pos, w_neg (and w_cache): a row for each fit, see class_weights. Votes and
    weights of a user meet once, for all combinations. cache: paper_id, at most MAX_CACHE. by: user_id, or with more
    keys (a fold) for more fits. Users whose rated vectors exceed max_bytes go to fit_large; votes are counted first.
    """
    by = by or ["user_id"]
    spark = votes.sparkSession
    extra = None
    if cache is not None:
        rows = embeddings.join(cache.select("paper_id").distinct(), "paper_id", "left_semi").select("paper_id", "embedding").limit(MAX_CACHE + 1).collect()
        if len(rows) > MAX_CACHE:
            raise ValueError(f"a cache of more than {MAX_CACHE} papers")
        extra = spark.sparkContext.broadcast(np.array([r.embedding for r in sorted(rows)]) if rows else None)

    def fit(key: tuple, own: pd.DataFrame, grid: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(grid):
            x, y = np.stack(own.embedding.to_numpy()), own.rating.to_numpy(float)
            shared = extra.value if extra is not None else None
            if shared is not None:
                x, y = np.vstack([x, shared]), np.append(y, np.zeros(len(shared)))
            for g in grid.itertuples():
                w = np.where(y == 1, g.w_pos, g.w_neg)
                if shared is not None:
                    w[len(own) :] = g.w_cache
                theta, converged = converged_fit(x, y, w, g.c)
                out.append((*key, g.combination_idx, theta[:-1], theta[-1], converged))
        return pd.DataFrame(out, columns=[*by, "combination_idx", "coef", "intercept", "converged"])

    mine = votes.filter("rating <> 2")
    rated = mine.withColumn("_h", F.xxhash64(*votes.columns)).join(embeddings, "paper_id").select(*by, "rating", "embedding", "_h")
    keys = ", ".join(f"{k} {dict(votes.dtypes)[k]}" for k in by)
    weights = weights.select(*[F.col(c).alias(c) for c in weights.columns])  # columns of its own, where it comes from the same votes
    width = embeddings.select(F.size("embedding").alias("w")).first()
    most = max(1, max_bytes // (8 * (width["w"] if width else 1)))
    many = mine.groupBy(*by).agg(F.count("*").alias("_m")).filter(F.col("_m") > most).select(*by)
    schema = f"{keys}, combination_idx int, coef array<double>, intercept double, converged boolean"
    if many.isEmpty():
        return rated.drop("_h").groupBy(*by).cogroup(weights.groupBy(*by)).applyInPandas(fit, schema)
    small = rated.drop("_h").join(many, by, "left_anti").groupBy(*by).cogroup(weights.join(many, by, "left_anti").groupBy(*by)).applyInPandas(fit, schema)
    return small.unionByName(fit_large(rated.join(many, by, "left_semi"), weights, by, extra))


def hyperparameter_values(given) -> list:
    """A list as it is; linspace(low, high, n) or logspace(low, high, n) written out; anything else as a list of one. NULL is an error."""
    import re

    if given is None:
        raise ValueError("a hyperparameter without values")
    m = re.fullmatch(r"(?:np\.)?(linspace|logspace)\(\s*([^,()]+),\s*([^,()]+),\s*(\d+)\s*\)", given) if isinstance(given, str) else None
    if m:
        return [float(x) for x in {"linspace": np.linspace, "logspace": np.logspace}[m[1]](float(m[2]), float(m[3]), int(m[4]))]
    return list(given) if isinstance(given, (list, tuple)) else [given]


def hyperparameter_grid(spark, **values) -> DataFrame:
    """The product of the values, combination_idx from 0 in the order given; see hyperparameter_values."""
    import itertools

    rows = [(i, *c) for i, c in enumerate(itertools.product(*map(hyperparameter_values, values.values())))]
    return spark.createDataFrame(rows, ["combination_idx", *values])
