"""How votes, scores, models and interests move along sessions, days and the up-votes so far."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, l2_normalize, mean_cosine_between, mean_pairwise_cosine, unit_sums, vector_sums
from .prepare import by_user
from .reports import EXACT_ROWS, group_score_table, quantiles
from .weights import max_pooling_scores


def window_places(rows: DataFrame, axis: str, width: int) -> DataFrame:
    """rows for each place i whose window [i - width, i + width] holds them, and steps, the window's places.

    Windows are clipped to 0 and the largest axis value; rows without one are left out. Fan-out: 2 * width + 1.
    """
    top = rows.agg(F.max(axis).cast("long").alias("_top"))  # one row
    low, high = F.greatest(F.col(axis).cast("long") - width, F.lit(0)), F.least(F.col(axis).cast("long") + width, F.col("_top"))
    out = rows.filter(F.col(axis).isNotNull()).crossJoin(F.broadcast(top)).withColumn("i", F.explode(F.sequence(low, high)))
    steps = F.least(F.col("i") + width, F.col("_top")) - F.greatest(F.col("i") - width, F.lit(0)) + 1
    return out.withColumn("steps", steps).drop("_top")


def over_users(values: DataFrame, users: DataFrame, by: list[str], exact_up_to: int = EXACT_ROWS) -> DataFrame:
    """Mean, deviation, median, quartiles and number of the users' values v, and the share of users that have one.

    Quartiles of groups of more than exact_up_to users come from a sketch, see quantiles.
    """
    known = values.filter("v IS NOT NULL")
    out = known.groupBy(*by).agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.count("*").alias("n_users"))
    out = out.join(quantiles(known, by, "v", {"median": 0.5, "low": 0.25, "high": 0.75}, exact_up_to), by)
    total = users.agg(F.countDistinct("user_id").alias("_n"))  # one row
    out = out.crossJoin(F.broadcast(total)).withColumn("share", F.col("n_users") / F.col("_n"))
    return out.select(*by, "mean", "std", "median", "low", "high", "n_users", "share")


def window_scores(rows: DataFrame, axis: str, width: int, value: str, kind: str = "mean", of: str | None = None) -> DataFrame:
    """i, user_id, v: the user's mean value in the window around i (mean), its sum a place (rate), or its sum over that of `of` (portion).

    rate and portion take rows with any of what they count, so a user without them in a window isn't among its users.
    """
    if kind == "mean":
        return window_places(rows.filter(F.col(value).isNotNull()), axis, width).groupBy("i", "user_id").agg(F.avg(value).alias("v"))
    if kind == "rate":
        return window_places(rows.filter(F.col(value) > 0), axis, width).groupBy("i", "user_id").agg((F.sum(value) / F.first("steps")).alias("v"))
    if kind == "portion":
        return window_places(rows.filter(F.col(of) > 0), axis, width).groupBy("i", "user_id").agg((F.sum(value) / F.sum(of)).alias("v"))
    raise ValueError(f"unknown kind {kind}")


def place_sums(votes: DataFrame, axis: str, by_kind: list[str]) -> DataFrame:
    """user_id, _at, the further keys, n and v: sums of unit vectors, with the number of those that aren't zero as their last place."""
    rows = votes.filter("rating IN (0, 1)").filter(F.col(axis).isNotNull())
    sums = unit_sums(rows.withColumn("_at", F.col(axis).cast("long")), ["user_id", "_at", *by_kind], "embedding")
    return sums.select("user_id", "_at", *by_kind, "n", F.concat("sum", F.array("nz")).alias("v"))


def among(s: np.ndarray, n: int) -> float | None:
    """Mean cosine among n vectors with this sum of units."""
    return float((s[:-1] @ s[:-1] - s[-1]) / (n * (n - 1))) if n > 1 else None


def between(a: np.ndarray, n: int, b: np.ndarray, m: int) -> float | None:
    return float(a[:-1] @ b[:-1] / (n * m)) if n and m else None


def cosines_of(width: int):
    """Windows along each user's places. Rows: user_id, _at (NULL: the user's first part), rating, n, v, _top, sorted by these. Held: the places of one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        user, start, places, next_i, top = None, {}, deque(), 0, 0

        def up_to(last: int) -> None:
            """Answers of the windows from next_i on, up to the one around last."""
            nonlocal next_i
            for i in range(next_i, last + 1):
                while places and places[0][0] < i - width:
                    places.popleft()
                near = [p for p in places if p[0] <= i + width]
                if near:
                    one = [[p[1][r] for p in near if r in p[1]] for r in (0, 1)]
                    (s0, n0), (s1, n1) = ((sum(v for v, _ in side), sum(n for _, n in side)) for side in one)
                    both = [p[1] for p in near if len(p[1]) == 2]
                    found = {"all": among(s0 + s1, n0 + n1), "pos": among(s1, n1) if n1 else None, "neg": among(s0, n0) if n0 else None}
                    if both:
                        found["pos_neg"] = between(sum(p[1][0] for p in both), sum(p[1][1] for p in both), sum(p[0][0] for p in both), sum(p[0][1] for p in both))
                    if start:
                        found = {"start_rated": between(s0 + s1, n0 + n1, sum(v for v, _ in start.values()), sum(n for _, n in start.values())), "start_pos": between(s1, n1, *start[1]) if n1 and 1 in start else None}
                    out.extend((i, user, name, v) for name, v in found.items() if v is not None)
            next_i = max(next_i, last + 1)

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out) if out else ([], [], [], []), (pa.int64(), pa.int64(), pa.string(), pa.float64()))], names=["i", "user_id", "measure", "v"])

        for batch in batches:
            for k, (u, at, rating, n, t) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("user_id", "_at", "rating", "n", "_top")))):
                v = batch.column("v")[k].values.to_numpy()
                if u != user:
                    if places:
                        up_to(min(places[-1][0] + width, top))
                    user, start, places, next_i = u, {}, deque(), 0
                top = t
                if at is None:
                    start[rating] = v, n
                elif places and places[-1][0] == at:
                    places[-1][1][rating] = v, n
                else:
                    if places:  # windows that this place is beyond are whole
                        up_to(min(places[-1][0] + width, at - width - 1))
                    next_i = max(next_i, at - width)
                    places.append((at, {rating: (v, n)}))
            yield flushed()
            out.clear()
        if places:
            up_to(min(places[-1][0] + width, top))
        yield flushed()

    return run


WINDOWED = "i long, user_id long, measure string, v double"


def windowed(sums: DataFrame, width: int, start: DataFrame | None = None) -> DataFrame:
    top = sums.agg(F.max("_at").alias("_top"))  # one row
    rows = sums if start is None else sums.unionByName(start)
    rows = rows.select("user_id", "_at", F.col("rating").cast("int").alias("rating"), "n", "v").crossJoin(F.broadcast(top))
    return rows.repartition("user_id").sortWithinPartitions("user_id", F.asc_nulls_first("_at"), "rating").mapInArrow(cosines_of(width), WINDOWED)


def window_cosines(votes: DataFrame, axis: str, width: int) -> DataFrame:
    """i, user_id, measure, v: mean cosine among the votes of the window around i (all), among up-votes (pos), among
    down-votes (neg), and between both in places that hold both (pos_neg).

    A place is one row, its sum of unit vectors; each user's places are read once, in order, with one window of them held. No pair is made.
    """
    return windowed(place_sums(votes, axis, ["rating"]), width)


def window_start_cosines(votes: DataFrame, axis: str, width: int) -> DataFrame:
    """i, user_id, measure, v: mean cosine between the validation votes of the window around i and the user's training votes: of all (start_rated) and of up-votes (start_pos).

    votes: user_id, rating, split, embedding and the axis, such as the session. Users without training votes have no row.
    """
    train = votes.filter("split = 'train'")
    start = place_sums(train.withColumn("_zero", F.lit(0)), "_zero", ["rating"]).withColumn("_at", F.lit(None).cast("long"))
    sums = place_sums(votes.filter("split = 'val'"), axis, ["rating"])
    return windowed(sums.join(train.select("user_id").distinct(), "user_id", "left_semi"), width, start)


def days_since_first(rows: DataFrame, by: list[str], day: int = 86_400_000_000) -> DataFrame:
    """rows with days: time since the user's first row (in each part of by), in days."""
    return rows.withColumn("days", (F.col("t") - F.min("t").over(Window.partitionBy("user_id", *by))) / day)


def metric_slopes(rows: DataFrame, axis: str, value: str, by: list[str] | None = None) -> DataFrame:
    """user_id (and by), slope of the least-squares line of value over axis (sessions, or days since the part's first vote), and n; NULL where the axis doesn't vary.

    Sums that merge: no user is gathered.
    """
    keys = ["user_id", *(by or [])]
    known = rows.filter(F.col(value).isNotNull() & F.col(axis).isNotNull())
    return known.groupBy(*keys).agg(F.regr_slope(F.col(value).cast("double"), F.col(axis).cast("double")).alias("slope"), F.count("*").alias("n"))


def session_edges(metrics: DataFrame, value: str, share: float = 0.25) -> DataFrame:
    """Per user, from sessions (user_id, session_id, t, n, value as the mean of n): the mean over what the first and last
    share of sessions hold (one session at least), and over sessions that start in the first and last share of the time."""
    rows = metrics.withColumn("_i", F.row_number().over(by_user().orderBy("session_id"))).withColumn("_n", F.count("*").over(by_user()))
    rows = rows.withColumn("_a", F.min("t").over(by_user())).withColumn("_z", F.max("t").over(by_user()))
    many, span = F.greatest(F.lit(1), F.floor(F.col("_n") * share)), (F.col("_z") - F.col("_a")) * share
    mean = lambda c: F.sum(F.when(c, F.col(value) * F.col("n"))) / F.sum(F.when(c, F.col("n")))
    return rows.groupBy("user_id").agg(
        mean(F.col("_i") <= many).alias("first_sessions"), mean(F.col("_i") > F.col("_n") - many).alias("last_sessions"),
        mean(F.col("t") <= F.col("_a") + span).alias("first_times"), mean(F.col("t") >= F.col("_z") - span).alias("last_times"),
    )


def binned_sessions(sessions: DataFrame, axis: str, width: int, top: int, value: str, sums: list[str], by: list[str] | None = None) -> DataFrame:
    """Sessions (user_id, session_id, split, n_pos, axis, value) by user and bin = axis // width, at most top // width.

    Training sessions after the first other one are left out. Sums and the last axis value of a bin; value is weighted
    by n_pos, NULL where no session of the bin has one. by: further keys, such as k.
    """
    keys = [*(by or []), "user_id"]
    first = F.min(F.when(F.col("split") != "train", F.col("session_id"))).over(Window.partitionBy(*keys))
    kept = sessions.withColumn("_f", first).filter("split <> 'train' OR _f IS NULL OR session_id < _f")
    kept = kept.withColumn("bin", F.least(F.floor(F.col(axis) / width), F.lit(top // width).cast("long")))
    has = F.col(value).isNotNull()
    mean = F.sum(F.col(value) * F.col("n_pos")) / F.sum(F.when(has, F.col("n_pos")))
    return kept.groupBy(*keys, "bin").agg(*[F.sum(c).alias(c) for c in sums if c != axis], F.max_by(axis, "session_id").alias(axis), mean.alias(value))


def bins_by_k(binned: DataFrame, value: str, ks: list[int]) -> DataFrame:
    """bin, and for each k the mean over users of value and the number of users that have one."""
    names = [F.when(F.col("k") == k, F.col(value)) for k in ks]
    return binned.groupBy("bin").agg(*[F.avg(c).alias(f"mean_{k}") for k, c in zip(ks, names)], *[F.count(c).alias(f"n_users_{k}") for k, c in zip(ks, names)])


def best_k_table(results: DataFrame, score: str) -> DataFrame:
    """results (user_id, k, score, value): best_k, score, k, value, n_users, where best_k is each user's k of the best
    score (the smaller at equal value) and k = NULL is the value at it; best_k = NULL stands for all users.

    A user without some k counts where there is a value.
    """
    own = results.filter(F.col("score") == score).groupBy("user_id").agg((-F.max(F.struct("value", (-F.col("k")).alias("k")))["k"]).alias("best_k"))
    rows = results.join(own, "user_id")
    ks = F.explode(F.when(F.col("k") == F.col("best_k"), F.array(F.col("k"), F.lit(None))).otherwise(F.array("k")))
    rows = rows.select("best_k", "score", "value", ks.alias("k")).withColumn("best_k", F.explode(F.array(F.col("best_k"), F.lit(None))))
    return rows.groupBy("best_k", "score", "k").agg(F.avg("value").alias("value"), F.count("*").alias("n_users"))


def fold_spread(results: DataFrame, best: int) -> DataFrame:
    """score, std: deviation over folds of the mean over users, of the best combination."""
    means = results.filter(F.col("combination_idx") == best).groupBy("fold_idx", "score").agg(F.avg("value").alias("v"))
    return means.groupBy("score").agg(F.stddev_samp("v").alias("std"), F.count("*").alias("n_folds"))


def largest_coefficients(coef: Column | str, n: int) -> Column:
    """Places (from 0) of the n coefficients largest in size."""
    c = F.col(coef) if isinstance(coef, str) else coef
    order = F.array_sort(F.transform(c, lambda x, i: F.struct((-F.abs(x)).alias("a"), i.alias("i"))))
    return F.transform(F.slice(order, 1, n), lambda e: e["i"])


def model_shape(models: DataFrame, least: float = 1e-3, n: int = 10) -> DataFrame:
    """Of each session's model (user_id, session_id, coef): mean size and deviation of the coefficients, share of at least
    `least` in size, number that isn't 0, and the share of the n largest that are also the previous and the first model's."""
    order = by_user().orderBy("session_id")
    rows = models.select("user_id", "session_id", "coef", largest_coefficients("coef", n).alias("_t"))
    rows = rows.withColumn("_p", F.lag("_t").over(order)).withColumn("_f", F.when(F.row_number().over(order) > 1, F.first("_t").over(order)))
    size, total = F.size("coef"), lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    mean = total(F.col("coef")) / size
    return rows.select(
        "user_id", "session_id", (total(F.transform("coef", F.abs)) / size).alias("mean_abs"), F.sqrt(F.greatest(dot("coef", "coef") / size - mean * mean, F.lit(0.0))).alias("std"),
        (F.size(F.filter("coef", lambda x: F.abs(x) >= least)) / size).alias("share_nonzero"), F.size(F.filter("coef", lambda x: x != 0)).cast("long").alias("n_nonzero"),
        (F.size(F.array_intersect("_t", "_p")) / n).alias("overlap_prev"), (F.size(F.array_intersect("_t", "_f")) / n).alias("overlap_first"),
    )


def successive_sessions(split: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Per user: whether the training part is one session (1 or 0), and the mean cosine between the up-votes of each validation session and the next one with any."""
    single = split.filter("split = 'train'").groupBy("user_id").agg((F.countDistinct("session_id") == 1).cast("int").alias("single_session"))
    up = split.filter("split = 'val' AND rating = 1").join(embeddings, "paper_id")
    sums = vector_sums(up.select("user_id", "session_id", l2_normalize("embedding").alias("u")), ["user_id", "session_id"], "u")
    order = by_user().orderBy("session_id")
    step = dot("sum", F.lag("sum").over(order)) / (F.col("n") * F.lag("n").over(order))
    return single.join(sums.withColumn("c", step).groupBy("user_id").agg(F.avg("c").alias("val_successive")), "user_id", "left")


def attach_columns(sessions: DataFrame, runs: list[DataFrame], columns: list[str]) -> DataFrame:
    """Sessions with the columns averaged over runs (user_id, session_id, columns), such as the best k or the votes scored
    by the global model, and split = val where a run has the session; NULL and train elsewhere."""
    rows = runs[0].select("user_id", "session_id", *columns)
    for r in runs[1:]:
        rows = rows.unionByName(r.select("user_id", "session_id", *columns))
    values = rows.groupBy("user_id", "session_id").agg(*[F.avg(c).alias(c) for c in columns], F.lit("val").alias("split"))
    return sessions.join(values, ["user_id", "session_id"], "left").withColumn("split", F.coalesce("split", F.lit("train")))


def decay_with_cache(history: DataFrame, rate: float, n_cache: int, neg_scale: float = 0.5, v: float = 0.9, mode: str = "joint", day: int = 86_400_000_000) -> DataFrame:
    """Rows of a history with weight and w_cache, the weight of each of n_cache unrated rows beside them.

    Weights decay by whole days before the session. Down-votes and cache share neg_scale in proportion v to 1 - v a row.
    separate: up-votes sum to 1 and down-votes decay among themselves; positives: only up-votes decay, and have 1 -
    neg_scale in all; joint: one decay for both, scaled so that up-votes keep (1 - neg_scale) of it. All times the number
    of rows and cache. NULL where the cache and the down-votes weigh nothing.
    """
    whole = Window.partitionBy("user_id", "val_session")
    up = F.col("rating") == 1
    d = F.exp(-rate * F.floor((F.col("val_t") - F.col("t")) / day))
    rows = history.withColumn("_d", d).withColumn("_p", F.coalesce(F.sum(F.when(up, F.col("_d"))).over(whole), F.lit(0.0))).withColumn("_q", F.coalesce(F.sum(F.when(~up, F.col("_d"))).over(whole), F.lit(0.0)))
    rows = rows.withColumn("_n", F.count_if(~up).over(whole)).withColumn("_r", F.count("*").over(whole) + n_cache)
    q, n, decay = F.col("_q"), F.col("_n"), F.col("_d")
    share = v * n + (1 - v) * n_cache
    unit = F.when(share > 0, F.lit(neg_scale) / share)
    if mode == "joint":
        level = (1 + neg_scale) / (F.col("_p") + neg_scale * q)
        pos, neg, cache = level * (1 - neg_scale) * decay, level * unit * v * n * decay, level * unit * (1 - v) * q
    elif mode == "separate":
        pos, neg, cache = decay / F.col("_p"), unit * v * n * decay / q, unit * (1 - v)
    elif mode == "positives":
        pos, neg, cache = (1 - neg_scale) * decay / F.col("_p"), unit * v, unit * (1 - v)
    else:
        raise ValueError(f"unknown mode {mode}")
    return rows.withColumn("weight", F.col("_r") * F.when(up, pos).otherwise(neg)).withColumn("w_cache", F.col("_r") * cache).drop("_d", "_p", "_q", "_n", "_r")


def largest_similarity_to_likes(votes: DataFrame, embeddings: DataFrame, rating: int = 0) -> DataFrame:
    """user_id, paper_id, t, similarity: the largest cosine of each vote with the rating to the user's up-votes."""
    unit = embeddings.select("paper_id", l2_normalize("embedding").alias("embedding"))
    rows = votes.filter(F.col("rating") == rating).select("user_id", "paper_id", "t")
    likes = votes.filter("rating = 1")
    return max_pooling_scores(rows.join(likes.select("user_id").distinct(), "user_id", "left_semi"), likes, unit).withColumnRenamed("logit", "similarity")


def interest_contrasts(split: DataFrame, embeddings: DataFrame, closest: DataFrame) -> DataFrame:
    """Per user, as the mean over all that could be drawn and not over a few draws: cosine of training up-votes to
    validation up-votes; of up-votes to down-votes; of an up-vote to its closest down-votes (closest_negatives); and,
    over sessions with two up-votes or more, among their up-votes."""
    rows = split.join(embeddings, "paper_id")
    up, user = rows.filter("rating = 1"), ["user_id"]
    out = mean_cosine_between(up.filter("split = 'train'"), up.filter("split = 'val'"), user, "embedding").withColumnRenamed("cosine", "drawn_to_val")
    out = out.join(mean_cosine_between(up, rows.filter("rating = 0"), user, "embedding").withColumnRenamed("cosine", "to_random_down"), "user_id", "full")
    unit = embeddings.select("paper_id", l2_normalize("embedding").alias("u"))
    near = closest.join(unit, "paper_id").join(unit.select(F.col("paper_id").alias("neg_paper_id"), F.col("u").alias("d")), "neg_paper_id")
    each = near.groupBy("user_id", "paper_id", "t").agg(F.avg(dot("u", "d")).alias("c"))
    out = out.join(each.groupBy("user_id").agg(F.avg("c").alias("to_closest_down")), "user_id", "left")
    within = mean_pairwise_cosine(up, ["user_id", "session_id"], "embedding").filter("n > 1")
    return out.join(within.groupBy("user_id").agg(F.avg("cosine").alias("within_sessions")), "user_id", "left")


def contrasts_by_group(contrasts: DataFrame, groups: DataFrame) -> DataFrame:
    """Mean, deviation, median and users of each column of contrasts by group (user_id, group) and over all."""
    columns = [c for c in contrasts.columns if c != "user_id"]
    return group_score_table(contrasts.unpivot(["user_id"], columns, "score", "value").filter("value IS NOT NULL"), groups)
