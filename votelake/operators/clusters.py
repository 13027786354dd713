"""Users with several interests: density clusters of up-votes, weights by cluster, models by cluster.

A user's distinct votes are one group of a helper; its memory is linear in them (distances are taken in blocks of rows). Users with
more than a helper should hold go another way to the same result: in blocks, over as many tasks as they need.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import written
from ..functions.vectors import dot, l2_normalize, mean_pairwise_cosine, unit_sums
from .large_models import MAX_BYTES, cluster_fits_large
from .products import Extremes, Near, against
from .scoring import fit_logistic, rank_positives, ranking_metrics

ROWS = 1024
#: Up-votes of a user that one task clusters by density; the time of that is quadratic in them.
MAX_LIKES = 20_000
#: Share of the scale after and before clustering in the scheme `middle`; scale of the scheme `fixed_neg_scale`.
AFTER, FIXED_SCALE = 0.6, 0.88


def density_clusters(x: np.ndarray, eps: float, least: int) -> np.ndarray:
    """Cluster of each row by cosine distance, numbered by their first core row; -1: noise.

    A core row has `least` rows within eps, itself included. Cores within eps share a cluster; another row within eps of
    cores joins the first of their clusters. A zero row is at distance 1 from all but itself.
    """
    size = np.linalg.norm(x, axis=1, keepdims=True)
    unit = x / np.where(size == 0, 1, size)

    def near(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
        return (1 - unit[rows] @ unit[to].T <= eps) | (rows[:, None] == to)

    everything = np.arange(len(x))
    parts = [everything[k : k + ROWS] for k in range(0, len(x), ROWS)]
    core = np.concatenate([near(p, everything).sum(1) >= least for p in parts])
    cores, out = np.flatnonzero(core), np.full(len(x), -1)
    if not len(cores):
        return out
    root = np.arange(len(cores))
    while True:
        low = root.copy()
        for k in range(0, len(cores), ROWS):
            mine = near(cores[k : k + ROWS], cores)
            low[k : k + ROWS] = np.where(mine, root, len(cores)).min(1)
        np.minimum.at(low, root, low.copy())  # a root follows the least that its members see
        low = np.minimum(low, low[low])
        if (low == root).all():
            break
        root = low
    out[cores] = np.unique(root, return_inverse=True)[1]
    rest = np.flatnonzero(~core)
    for k in range(0, len(rest), ROWS):
        part = rest[k : k + ROWS]
        first = np.where(near(part, cores), out[cores], len(cores)).min(1)
        out[part] = np.where(first < len(cores), first, -1)
    return out


def dbscan_user_clusters(votes: DataFrame, embeddings: DataFrame, eps: float = 0.4, least: int = 3, max_likes: int = MAX_LIKES) -> DataFrame:
    """user_id, paper_id, cluster of the papers that the user voted up; noise is left out.

    Users with more than max_likes of them are clustered in blocks over many tasks; likes are counted first.
    """
    likes = votes.filter("rating = 1").select("user_id", "paper_id").distinct().join(embeddings.select("paper_id", "embedding"), "paper_id")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("paper_id")
        found = density_clusters(np.stack(pdf.embedding.to_numpy()).astype(float), eps, least)
        return pd.DataFrame({"user_id": pdf.user_id, "paper_id": pdf.paper_id, "cluster": found})[found >= 0]

    schema = "user_id long, paper_id long, cluster int"
    many = likes.groupBy("user_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > max_likes).select("user_id")
    if many.isEmpty():
        return likes.groupBy("user_id").applyInPandas(run, schema)
    small = likes.join(many, "user_id", "left_anti").groupBy("user_id").applyInPandas(run, schema)
    return small.unionByName(density_clusters_in_blocks(likes.join(many, "user_id", "left_semi"), eps, least))


def density_clusters_in_blocks(likes: DataFrame, eps: float, least: int) -> DataFrame:
    """What density_clusters finds for each user's likes (user_id, paper_id, embedding), without a user in one task.

    Near rows are counted and met in blocks, and no pair of them is a row. Cores start as their own roots; each round every
    root goes to the smallest root that one of its members is near, and on to where that one goes. Sets of one root are
    connected, so they move whole, and the rounds are few: sets at least double until they are done. What a round reads is written to the shared folder.
    """
    unit = written(likes.select("user_id", "paper_id", l2_normalize("embedding").alias("_v")))
    by, found = ["user_id"], "struct<n:bigint,low:bigint>"
    row = lambda *more: F.struct("user_id", "paper_id", *more).alias("_row")
    known = lambda df, label: df.select("user_id", F.col("paper_id").alias("_id"), F.col(label).alias("_label"), "_v")
    met = lambda df, others, *more: against(df.select("user_id", row(*more), F.col("paper_id").alias("_id"), "_v"), others, by, lambda: Near(eps), found)
    core = met(unit, known(unit, "paper_id")).filter(F.col("found.n") >= least).select("_row.*")
    cores = written(unit.join(core, ["user_id", "paper_id"], "left_semi").withColumn("root", F.col("paper_id")))
    while True:
        low = met(cores, known(cores, "root"), "root").select("_row.user_id", "_row.root", F.col("found.low").alias("low"))
        to = written(low.groupBy("user_id", "root").agg(F.min("low").alias("to")))
        if to.filter("to < root").isEmpty():
            break
        further = to.select("user_id", F.col("root").alias("to"), F.col("to").alias("further"))
        moved = to.join(further, ["user_id", "to"]).select("user_id", "root", F.col("further").alias("_new"))
        cores = written(cores.join(moved, ["user_id", "root"]).select("user_id", "paper_id", "_v", F.col("_new").alias("root")))
    number = to.select("user_id", "root", (F.row_number().over(Window.partitionBy("user_id").orderBy("root")) - 1).alias("cluster"))  # a row for each cluster
    rest = unit.join(cores.select("user_id", "paper_id"), ["user_id", "paper_id"], "left_anti")
    edge = met(rest, known(cores, "root")).select("_row.*", F.col("found.low").alias("root")).filter("root IS NOT NULL")
    return cores.select("user_id", "paper_id", "root").unionByName(edge).join(number, ["user_id", "root"]).select("user_id", "paper_id", "cluster")


def cluster_extremes(clusters: DataFrame, embeddings: DataFrame) -> DataFrame:
    """user_id, cluster, other, high, mean, low: the mean over a cluster's papers of their largest, mean and smallest cosine to the papers of the user's cluster `other`; for the cluster itself, to its other papers.

    clusters: user_id, paper_id, cluster (a number). Largest and smallest are exact, met in blocks; means come from sums.
    """
    rows = clusters.join(embeddings.select("paper_id", "embedding"), "paper_id")
    unit = rows.select("user_id", "cluster", F.col("paper_id").alias("_id"), F.col("cluster").cast("long").alias("_label"), l2_normalize("embedding").alias("_v"))
    each = against(unit.select("user_id", F.struct("user_id", "cluster", "_id").alias("_row"), "_id", "_v"), unit.drop("cluster"), ["user_id"], Extremes, "array<struct<label:bigint,high:double,low:double>>")
    each = each.select("_row.user_id", "_row.cluster", F.explode("found").alias("f"))
    ends = each.groupBy("user_id", "cluster", F.col("f.label").alias("other")).agg(F.avg("f.high").alias("high"), F.avg("f.low").alias("low"))
    sums = unit_sums(rows, ["user_id", "cluster"], "embedding")
    other = sums.select("user_id", F.col("cluster").cast("long").alias("other"), F.col("n").alias("_n"), F.col("sum").alias("_s"))
    inside = F.when(F.col("n") > 1, (dot("sum", "sum") - F.col("nz")) / (F.col("n") * (F.col("n") - 1)))
    mean = F.when(F.col("cluster") == F.col("other"), inside).otherwise(dot("sum", "_s") / (F.col("n") * F.col("_n")))
    means = sums.join(other, "user_id").select("user_id", "cluster", "other", mean.alias("mean"))  # clusters of a user: few
    return means.join(ends, ["user_id", "cluster", "other"], "left").select("user_id", "cluster", "other", "high", "mean", "low")


def cluster_separation(extremes: DataFrame) -> DataFrame:
    """user_id, cluster, high, mean, low over the other clusters, and silhouette: (inside - outside) / the larger, of the means; from cluster_extremes."""
    own = F.col("cluster") == F.col("other")
    out = extremes.groupBy("user_id", "cluster").agg(*[F.avg(F.when(~own, F.col(c))).alias(c) for c in ("high", "mean", "low")], F.max(F.when(own, F.col("mean"))).alias("inside"))
    return out.withColumn("silhouette", (F.col("inside") - F.col("mean")) / F.greatest("inside", "mean"))


def multi_interest_users(votes: DataFrame, papers: DataFrame, embeddings: DataFrame, n: int, categories: int = 2, papers_each: int = 3, clusters: int = 2, eps: float = 0.4, least: int = 3) -> DataFrame:
    """user_id, distance: the n users of most mean distance between up-votes among those with enough categories and clusters; ties by id."""
    likes = votes.filter("rating = 1").select("user_id", "paper_id").distinct()
    wide = likes.join(papers.filter("l1 IS NOT NULL AND l2 IS NOT NULL"), "paper_id").groupBy("user_id", "l1", "l2").agg(F.count("*").alias("k")).filter(F.col("k") >= papers_each)
    broad = wide.groupBy("user_id").agg(F.count("*").alias("g")).filter(F.col("g") >= categories).select("user_id")
    likes = likes.join(broad, "user_id", "left_semi")
    dense = dbscan_user_clusters(likes.withColumn("rating", F.lit(1)), embeddings, eps, least).groupBy("user_id").agg(F.countDistinct("cluster").alias("c")).filter(F.col("c") >= clusters).select("user_id")
    spread = mean_pairwise_cosine(likes.join(dense, "user_id", "left_semi").join(embeddings, "paper_id"), ["user_id"], "embedding")
    return spread.select("user_id", (1 - F.coalesce("cosine", F.lit(1.0))).alias("distance")).orderBy(F.desc("distance"), "user_id").limit(n)


def cluster_weights(counts: DataFrame, pos_scheme: str, neg_scheme: str, alpha: float, v: float = 0.9, neg_scale: float = 0.5) -> DataFrame:
    """counts (n_pos_in, n_pos_out, n_neg_in, n_neg_out, n_cache) with the weights of a row of each (w_pos_in, ...).

    All rows together weigh as many as they are. Down-votes and cache have neg_scale of it, v to 1 - v a row; up-votes the rest.
    Inside a cluster up-votes have a share n / (n + alpha), or more if they are more (absolute), or weigh alpha to 1 - alpha
    a row (relative). Down-votes weigh alike (none; fixed_neg_scale; middle: with a scale between that of the cluster before and
    after), are split as up-votes by the same rule (same_alpha) or in the up-votes' proportion (same_ratio).
    A kind without rows has weight 0, and the other side then has all.
    """
    if pos_scheme not in ("absolute", "relative") or neg_scheme not in ("none", "fixed_neg_scale", "middle", "same_alpha", "same_ratio") or (pos_scheme, neg_scheme) == ("absolute", "middle"):
        raise ValueError(f"unknown schemes {pos_scheme}, {neg_scheme}")
    p, po, n, no, c = (F.col(k).cast("double") for k in ("n_pos_in", "n_pos_out", "n_neg_in", "n_neg_out", "n_cache"))

    def share(a: Column, b: Column) -> Column:
        """What the rows inside weigh of a kind's 1."""
        inside = F.greatest(a / (a + alpha), a / (a + b)) if pos_scheme == "absolute" else alpha * a / (alpha * a + (1 - alpha) * b)
        return F.when(a == 0, 0.0).when(b == 0, 1.0).otherwise(inside)

    each = lambda w, k: F.when(k > 0, w / k).otherwise(0.0)
    scale, own = F.lit(FIXED_SCALE if neg_scheme == "fixed_neg_scale" else neg_scale), share(p, po)
    if neg_scheme == "middle":  # the scale as odds; before: by the share of rows, after: by the share of weight
        odds = neg_scale / (1 - neg_scale) * (AFTER + (1 - AFTER) * own * (p + po) / p)
        scale = F.when(p > 0, odds / (1 + odds)).otherwise(neg_scale)
    whole, low = p + po + n + no + c, v * (n + no) + (1 - v) * c
    neg = F.when(low > 0, whole * scale * v * (n + no) / low)
    part = {"same_alpha": share(n, no), "same_ratio": F.when(n == 0, 0.0).when(no == 0, 1.0).otherwise(own)}.get(neg_scheme, n / F.greatest(n + no, F.lit(1.0)))
    ups = whole * (1 - scale)
    return counts.select(
        "*", each(ups * own, p).alias("w_pos_in"), each(ups * (1 - own), po).alias("w_pos_out"), each(neg * part, n).alias("w_neg_in"), each(neg * (1 - part), no).alias("w_neg_out"),
        F.when((c > 0) & (low > 0), whole * scale * (1 - v) / low).otherwise(0.0).alias("w_cache"),
    )


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 50) -> np.ndarray:
    """Centres by Lloyd's rounds from k-means++ seeds; fewer where rows repeat."""
    rng = np.random.default_rng(seed)
    centres = x[rng.integers(len(x))][None]
    while len(centres) < k:
        far = ((x[:, None] - centres) ** 2).sum(2).min(1)
        if far.sum() <= 0:
            break
        centres = np.vstack([centres, x[rng.choice(len(x), p=far / far.sum())]])
    for _ in range(rounds):
        to = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        new = np.stack([x[to == j].mean(0) if (to == j).any() else centres[j] for j in range(len(centres))])
        if np.allclose(new, centres):
            break
        centres = new
    return centres


def cluster_user_models(votes: DataFrame, embeddings: DataFrame, k: int | None = None, **options) -> DataFrame:
    """user_id, cluster (-1: the user's global model), centre, coef, intercept.

    k: number of clusters of up-votes (none: one for 25, 1 to 10). A cluster of fewer than `least` up-votes has a centre and no model,
    and a user whose up-votes are outside the limits has the global model only. In a cluster's model its up-votes weigh alpha
    and the others 1 - alpha, scaled to their number. options: see models_for_ks.
    """
    return models_for_ks(votes, embeddings, votes.select("user_id").distinct().withColumn("k", F.lit(k).cast("int")), **options).drop("k")


def models_for_ks(votes: DataFrame, embeddings: DataFrame, ks: DataFrame, c: float = 1.0, neg_weight: float = 1.0, alpha: float = 0.8, least: int = 5, limits: tuple[int, int] = (20, 100_000), seed: int = 42, max_bytes: int = MAX_BYTES) -> DataFrame:
    """k, user_id, cluster, centre, coef, intercept for each (user_id, k) of ks, all from one pass over a user's votes. The global model is fitted once.

    Users whose rated vectors exceed max_bytes go to cluster_fits_large, in rounds over blocks; votes are counted first.
    """
    rows = votes.filter("rating <> 2").join(embeddings, "paper_id").select("user_id", "paper_id", "rating", "embedding")
    ks = ks.select(F.col("user_id").alias("user_id"), F.col("k").cast("int").alias("k"))  # columns of its own, where it comes from the same votes

    def fit(key: tuple, pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        columns = ["k", "user_id", "cluster", "centre", "coef", "intercept"]
        if not len(pdf) or not len(own):
            return pd.DataFrame([], columns=columns)
        pdf = pdf.sort_values(["paper_id", "rating"])
        x, y = np.stack(pdf.embedding.to_numpy()).astype(float), pdf.rating.to_numpy(float)
        base, out = np.where(y == 1, 1.0, neg_weight), []
        whole, n = fit_logistic(x, y, base, c), int(y.sum())
        for k in own.k:
            k = None if pd.isna(k) else int(k)
            out.append((k, key[0], -1, None, whole[:-1], whole[-1]))
            if not limits[0] <= n <= limits[1]:
                continue
            centres = k_means(x[y == 1], k or min(10, max(1, n // 25)), seed ^ int(key[0]))
            to = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
            for j, centre in enumerate(centres):
                inside = (to == j) & (y == 1)
                if inside.sum() < least:
                    out.append((k, key[0], j, centre, None, None))
                    continue
                w = np.where(inside, alpha, 1 - alpha)
                theta = fit_logistic(x, y, np.where(y == 1, w * n / w[y == 1].sum(), base), c)
                out.append((k, key[0], j, centre, theta[:-1], theta[-1]))
        return pd.DataFrame(out, columns=columns).astype({"k": "Int64"})

    schema = "k int, user_id long, cluster int, centre array<double>, coef array<double>, intercept double"
    size = rows.groupBy("user_id").agg(F.sum(8 * F.size("embedding")).alias("_b"), F.count_if(F.col("rating") == 1).alias("n_pos"))
    many = size.filter(F.col("_b") > max_bytes).select("user_id", "n_pos")
    if many.isEmpty():
        return rows.groupBy("user_id").cogroup(ks.groupBy("user_id")).applyInPandas(fit, schema)
    small = rows.join(many, "user_id", "left_anti").groupBy("user_id").cogroup(ks.groupBy("user_id")).applyInPandas(fit, schema)
    rule = F.least(F.lit(10), F.greatest(F.lit(1), F.floor(F.col("n_pos") / 25)))
    wanted = ks.join(many, "user_id").withColumn("clusters", F.when(F.col("n_pos").between(*limits), F.coalesce("k", rule)).otherwise(0).cast("int"))
    return small.unionByName(cluster_fits_large(rows.join(many, "user_id", "left_semi"), wanted, c, neg_weight, alpha, least, seed, schema))


def cluster_scores(models: DataFrame, pairs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """pairs (user_id, paper_id) with cluster, fallback and logit, and k if the models have it: by the model of the nearest centre, by the global one where that has none (fallback) or the user has no centres (cluster -1).

    A pair gets its vector first and then meets its user's models, so that models are shuffled once for each user, not once for each pair.
    """
    by = [c for c in ("user_id", "k") if c in models.columns]
    one = F.struct("cluster", "centre", "coef", "intercept")
    of_user = models.repartition("user_id").groupBy(*by).agg(F.collect_list(one).alias("ms"))  # as many as a user has clusters, and one
    rows = pairs.join(embeddings, "paper_id").join(of_user, "user_id")
    away = lambda m: F.aggregate(F.zip_with(m["centre"], "embedding", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    near = F.array_min(F.transform(F.filter("ms", lambda m: m["cluster"] >= 0), lambda m: F.struct(away(m).alias("d"), m["cluster"].alias("cluster"))))["cluster"]
    rows = rows.withColumn("cluster", F.coalesce(near, F.lit(-1)))
    own = F.get(F.filter("ms", lambda m: (m["cluster"] == F.col("cluster")) & m["coef"].isNotNull()), F.lit(0))
    rows = rows.withColumn("own", own).withColumn("fallback", F.col("own").isNull())
    use = F.coalesce(F.col("own"), F.get(F.filter("ms", lambda m: m["cluster"] == -1), F.lit(0)))
    rows = rows.withColumn("m", use)
    return rows.withColumn("logit", dot("m.coef", "embedding") + F.col("m.intercept")).select(*pairs.columns, *by[1:], "cluster", "fallback", "logit")


def hold_out(votes: DataFrame, n_pos: int, n_neg: int, few: int = 10, n_few: int = 4) -> DataFrame:
    """votes with held: each user's first n_pos up-votes and first n_neg down-votes (n_few where there are at most `few`), by time."""
    mine = Window.partitionBy("user_id", "rating")
    place = F.row_number().over(mine.orderBy("t", "paper_id"))
    many = F.when(F.col("rating") == 1, F.lit(n_pos)).when(F.count("*").over(mine) <= few, F.lit(n_few)).otherwise(F.lit(n_neg))
    return votes.filter("rating <> 2").withColumn("held", place <= many)


def choose_k(votes: DataFrame, embeddings: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 7), n_pos: int = 4, n_neg: int = 8, **options) -> DataFrame:
    """user_id, k and ndcg: the number of clusters whose models rank the held-out up-votes best among the held-out down-votes; the smaller of equal ones.

    A row for each user with votes left on both sides. options: see cluster_user_models.
    """
    parts = hold_out(votes, n_pos, n_neg)
    train, held = parts.filter("NOT held"), parts.filter("held").select("user_id", "paper_id", "t", "rating")
    each = train.select("user_id").distinct().withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    scored = written(cluster_scores(models_for_ks(train, embeddings, each, **options), held, embeddings).select("user_id", "k", "paper_id", "t", "rating", "logit"))  # else models are fitted for both sides
    by = ["user_id", "k"]
    ranked = rank_positives(scored.filter("rating = 1").select(*by, "paper_id", "t", "logit"), scored.filter("rating = 0"), by)
    found = ranking_metrics(ranked, by).select(*by, F.round("ndcg", 9).alias("ndcg"))
    order = Window.partitionBy("user_id").orderBy(F.desc("ndcg"), "k")
    return found.withColumn("_i", F.row_number().over(order)).filter("_i = 1").drop("_i")


def models_by_chosen_k(votes: DataFrame, embeddings: DataFrame, chosen: DataFrame, **options) -> DataFrame:
    """cluster_user_models on all votes of the users in chosen, each with its own k."""
    return models_for_ks(votes, embeddings, chosen.select("user_id", "k"), **options).drop("k")
