"""Tables over results (long form: user_id, fold_idx, combination_idx, score, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a group whose quantiles are exact, which keeps its distinct values in one buffer; beyond it they come from a sketch that is off by at most a part
#: 1 / ACCURACY of the group's ranks, in bounded memory.
EXACT_ROWS, ACCURACY = 1_000_000, 10_000


def quantiles(rows: DataFrame, by: list[str], value: str, at: dict[str, float], exact_up_to: int = EXACT_ROWS, accuracy: int = ACCURACY) -> DataFrame:
    """by and a column for each share in `at`: exact (between two values, their weighted mean) for groups of at most exact_up_to values, from a mergeable sketch for others."""
    known = rows.filter(F.col(value).isNotNull())
    many = known.groupBy(*by).agg((F.count("*") > exact_up_to).alias("_many"))
    sized = known.join(many, by) if by else known.crossJoin(F.broadcast(many))  # one row
    names = list(at)
    exact = sized.filter("NOT _many").groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(at[n]) for n in names])).alias("_q"))
    rough = sized.filter("_many").groupBy(*by).agg(F.percentile_approx(F.col(value).cast("double"), [at[n] for n in names], accuracy).alias("_q"))
    return exact.unionByName(rough).filter("_q IS NOT NULL").select(*by, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])


def average_over_folds(results: DataFrame) -> DataFrame:
    return results.groupBy("user_id", "combination_idx", "score").agg(F.avg("value").alias("value"), F.stddev_pop("value").alias("std"))


def average_over_users(results: DataFrame, median: bool = False) -> DataFrame:
    by = ["combination_idx", "score"]
    out = results.groupBy(*by).agg(F.avg("value").alias("value"), F.stddev_samp("value").alias("std"))
    return out.drop("value").join(quantiles(results, by, "value", {"value": 0.5}), by).select(*by, "value", "std") if median else out


def average_over_seeds(runs: list[DataFrame]) -> DataFrame:
    """Mean and std of each score over the runs, by user, fold (if there are folds) and combination."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    keys = [c for c in ("user_id", "fold_idx", "combination_idx", "score") if c in out.columns]
    return out.groupBy(*keys).agg(F.avg("value").alias("value"), F.stddev_pop("value").alias("std"))


def first_of(rows: DataFrame, by: list[str], value: Column, n: int) -> DataFrame:
    """The first n rows of each group by value and user, with their place _i: first n of each of 64 parts, then of these, so that no task orders a whole group."""
    part = F.pmod(F.xxhash64("user_id"), F.lit(64))
    some = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*by, part).orderBy(value, "user_id"))).filter(F.col("_i") <= n)
    return some.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(value, "user_id"))).filter(F.col("_i") <= n)


def average_extreme_users(results: DataFrame, n: int, worst: bool = True, lower_better: tuple[str, ...] = ()) -> DataFrame:
    """Mean over the n worst (or best) users of each combination and score; higher is better but for the scores in lower_better."""
    signed = F.when(F.col("score").isin(*lower_better), -F.col("value")).otherwise(F.col("value")) if lower_better else F.col("value")
    return first_of(results, ["combination_idx", "score"], signed if worst else -signed, n).groupBy("combination_idx", "score").agg(F.avg("value").alias("value"), F.stddev_samp("value").alias("std"))


def best_combinations(means: DataFrame, score: str, n: int = 1, increase_better: bool = True) -> DataFrame:
    order = F.desc("value") if increase_better else F.asc("value")
    return means.filter(F.col("score") == score).orderBy(order, "combination_idx").limit(n)


def best_combination_per_user(results: DataFrame, score: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(F.desc("value"), "combination_idx")
    return results.filter(F.col("score") == score).withColumn("i", F.row_number().over(order)).filter("i = 1").drop("i")


def val_upper_bounds(results: DataFrame, score: str, n: int) -> DataFrame:
    """One row: the mean over users of each user's best value of the score, and the mean over the n worst of them."""
    best = best_combination_per_user(results, score).withColumn("combination_idx", F.lit(0))
    worst = average_extreme_users(best, n).select(F.col("value").alias("worst"))
    return best.agg(F.avg("value").alias("value"), F.count("*").alias("n_users")).crossJoin(F.broadcast(worst))  # one row each


def performance_gain(results: DataFrame, score: str, best: int, n: int) -> DataFrame:
    """Users with the largest distance between their own best combination and the best overall one."""
    own = best_combination_per_user(results, score).select("user_id", F.col("value").alias("own"))
    all_ = results.filter((F.col("score") == score) & (F.col("combination_idx") == best)).select("user_id", F.col("value").alias("overall"))
    return own.join(all_, "user_id").withColumn("gain", F.abs(F.col("own") - F.col("overall"))).orderBy(F.desc("gain"), "user_id").limit(n)


def compare_runs(old: DataFrame, new: DataFrame, score: str, n: int, increase_better: bool = True) -> DataFrame:
    """The n best and n worst users by new minus old, or by old minus new where less is better."""
    d = new.filter(F.col("score") == score).select("user_id", F.col("value").alias("new")).join(old.filter(F.col("score") == score).select("user_id", F.col("value").alias("old")), "user_id").withColumn("diff", (F.col("new") - F.col("old")) if increase_better else (F.col("old") - F.col("new")))
    return d.orderBy(F.desc("diff"), "user_id").limit(n).withColumn("side", F.lit("best")).unionByName(d.orderBy("diff", "user_id").limit(n).withColumn("side", F.lit("worst")))


def users_info_summary(info: DataFrame, columns: list[str]) -> DataFrame:
    long = info.unpivot([], columns, "statistic", "value").withColumn("value", F.col("value").cast("double"))
    out = long.groupBy("statistic").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return out.join(quantiles(long, ["statistic"], "value", {"median": 0.5}), "statistic", "left").select("statistic", "low", "high", "median", "mean", "std")


def group_score_table(results: DataFrame, groups: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Mean, std, median and users of each score by group (user_id, group) and overall (group "all"). Named groups without users have NULLs and n = 0."""
    every = results.select("user_id").distinct().withColumn("group", F.lit("all"))
    rows = groups.select("user_id", "group").unionByName(every).join(results, "user_id")
    by = ["group", "score"]
    out = rows.groupBy(*by).agg(F.avg("value").alias("value"), F.stddev_samp("value").alias("std"), F.count("*").alias("n"))
    out = out.join(quantiles(rows, by, "value", {"median": 0.5}), by, "left").select(*by, "value", "std", "median", "n")
    if not names:
        return out
    wanted = results.select("score").distinct().withColumn("group", F.explode(F.array(*[F.lit(x) for x in [*names, "all"]])))
    return wanted.join(out, ["group", "score"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def assemble_results(results: DataFrame, scores: list[str]) -> DataFrame:
    return results.groupBy("user_id", "combination_idx").pivot("score", scores).agg(F.first("value"))


def metric_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.corr(x, y).alias("r"), F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"))


def temporal_windows(values: DataFrame, axis: str, width: int, value: str) -> DataFrame:
    """For each place i the users' means over [i - width, i + width], clipped to the range; then mean, deviation and number of users.

    values has a row for each user and axis value at most, so the fan-out is 2 * width + 1.
    """
    top = values.agg(F.max(axis).alias("_top"))
    at = F.explode(F.sequence(F.greatest(F.col(axis) - width, F.lit(0)), F.least(F.col(axis) + width, F.col("_top"))))
    per = values.crossJoin(F.broadcast(top)).withColumn("i", at).groupBy("i", "user_id").agg(F.avg(value).alias("v"))
    return per.groupBy("i").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.count("*").alias("n_users"))


def first_vs_other_sessions(sessions: DataFrame, value: str) -> DataFrame:
    """Mean over users of the first session's value and of the later sessions' mean."""
    per = sessions.groupBy("user_id").agg(F.avg(F.when(F.col("session_id") == 0, F.col(value))).alias("a"), F.avg(F.when(F.col("session_id") > 0, F.col(value))).alias("b"))
    return per.agg(F.avg("a").alias("first"), F.avg("b").alias("others"), F.count("b").alias("n_users"))


def session_position_scores(metrics: DataFrame, value: str) -> DataFrame:
    """Per user over sessions (user_id, session_id, value): the first, middle (index n // 2) and last one, mean, median and deviation."""
    order = Window.partitionBy("user_id").orderBy("session_id")
    rows = metrics.withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", F.count("*").over(Window.partitionBy("user_id")))
    at = lambda c: F.max(F.when(F.col("_i") == c, F.col(value)))
    return rows.groupBy("user_id").agg(at(F.lit(0)).alias("first"), at(F.floor(F.col("_n") / 2)).alias("middle"), at(F.col("_n") - 1).alias("last"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("std"))


def metrics_by_bins(metrics: DataFrame, axis: str, width: int, top: int, value: str) -> DataFrame:
    """bin = axis // width, at most top: mean over users of their means, and the number of users."""
    per = metrics.withColumn("bin", F.least(F.floor(F.col(axis) / width), F.lit(top).cast("long"))).groupBy("bin", "user_id").agg(F.avg(value).alias("v"))
    return per.groupBy("bin").agg(F.avg("v").alias("mean"), F.count("*").alias("n_users"))


def best_k_summary(results: DataFrame, score: str) -> DataFrame:
    """results (user_id, k, score, value): each user's best k (the smaller at equal value), then users and mean best value for each best k."""
    own = results.filter(F.col("score") == score).groupBy("user_id").agg(F.max(F.struct("value", (-F.col("k")).alias("k"))).alias("b"))
    return own.groupBy((-F.col("b.k")).alias("best_k")).agg(F.count("*").alias("n_users"), F.avg("b.value").alias("value"))


def category_mode_match(votes: DataFrame, level: str = "l1") -> DataFrame:
    """Per user: 1 if up-votes and down-votes have the same most frequent category (the smallest name at equal count), else 0."""
    counts = votes.filter((F.col("rating") <= 1) & F.col(level).isNotNull()).groupBy("user_id", "rating", level).agg(F.count("*").alias("n"))
    mode = counts.groupBy("user_id", "rating").agg(F.min(F.struct((-F.col("n")).alias("n"), level)).alias("m"))
    sides = mode.groupBy("user_id").agg(F.max(F.when(F.col("rating") == 1, F.col(f"m.{level}"))).alias("a"), F.max(F.when(F.col("rating") == 0, F.col(f"m.{level}"))).alias("b"))
    return sides.select("user_id", F.coalesce((F.col("a") == F.col("b")).cast("int"), F.lit(0)).alias("matches"))


def hyperparameter_curve(means: DataFrame, grid: DataFrame, x: str) -> DataFrame:
    """Scores along x for each setting of the other hyperparameters; curve numbers these settings from 0. The grid is small."""
    others = [c for c in grid.columns if c not in ("combination_idx", x)]
    curve = (F.dense_rank().over(Window.orderBy(*others)) - 1) if others else F.lit(0)
    return means.join(F.broadcast(grid.withColumn("curve", curve)), "combination_idx").select("curve", x, "score", "value", "std")


def user_groups(users: DataFrame, score: str, columns: list[str], n: int | None = None) -> DataFrame:
    """group, user_id: head and tail by score, and the users with the largest and smallest of each column; users of is_other as `other`.

    n: 75 of 500 users or more, else a sixth (one at least); one count of users.
    """
    if n is None:
        total = users.count()
        n = 75 if total >= 500 else max(1, int(total * 0.16667))
    out = users.filter("is_other").select(F.lit("other").alias("group"), "user_id")
    for c in [score, *columns]:
        for label, order in (("high", F.desc(c)), ("low", F.asc(c))):
            out = out.unionByName(users.orderBy(order, "user_id").limit(n).select(F.lit(f"{c}_{label}").alias("group"), "user_id"))
    return out


def extreme_predictions(predictions: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """The n most and n least probable papers of each outcome of a user, with titles. predictions: user_id, paper_id, t, proba, outcome."""
    w = Window.partitionBy("user_id", "outcome")
    rows = predictions.withColumn("_a", F.row_number().over(w.orderBy(F.desc("proba"), "paper_id", "t"))).withColumn("_b", F.row_number().over(w.orderBy("proba", "paper_id", "t")))
    side = F.explode(F.array_compact(F.array(F.when(F.col("_a") <= n, F.struct(F.lit("high").alias("side"), F.col("_a").alias("place"))), F.when(F.col("_b") <= n, F.struct(F.lit("low").alias("side"), F.col("_b").alias("place"))))))
    rows = rows.filter((F.col("_a") <= n) | (F.col("_b") <= n)).select("user_id", "outcome", "paper_id", "t", "proba", side.alias("_s"))
    return rows.join(texts.select("paper_id", "title"), "paper_id", "left").select("user_id", "outcome", "_s.side", "_s.place", "paper_id", "title", "proba")


def worst_users(results: DataFrame, score: str, sizes: list[int]) -> DataFrame:
    """combination_idx and the mean of its worst users' scores, for each size."""
    rows = first_of(results.filter(F.col("score") == score), ["combination_idx"], F.col("value"), max(sizes))
    return rows.groupBy("combination_idx").agg(*[F.avg(F.when(F.col("_i") <= k, F.col("value"))).alias(f"worst_{k}") for k in sizes])


def attach_metrics_to_sessions(sessions: DataFrame, runs: list[DataFrame], value: str) -> DataFrame:
    """Sessions with the value averaged over runs (user_id, session_id, value); NULL where no run has one."""
    both = runs[0]
    for r in runs[1:]:
        both = both.unionByName(r)
    return sessions.join(both.groupBy("user_id", "session_id").agg(F.avg(value).alias(value)), ["user_id", "session_id"], "left")


def validation_summary(results: DataFrame, groups: DataFrame) -> DataFrame:
    """group, score: mean over the group's users and over all of them (group `all`)."""
    return group_score_table(results, groups).select("group", "score", "value", "n")


def differences_to_baseline(results: DataFrame, baseline: DataFrame, score: str, sizes: list[int]) -> DataFrame:
    """combination_idx and the mean differences of the score to the baseline (user_id, score, value) of its worst and best users, for each size."""
    base = baseline.filter(F.col("score") == score).select("user_id", F.col("value").alias("_b"))
    diff = results.filter(F.col("score") == score).join(base, "user_id").select("combination_idx", "user_id", (F.col("value") - F.col("_b")).alias("value"))
    out = None
    for side, order in (("worst", F.col("value")), ("best", -F.col("value"))):
        rows = first_of(diff, ["combination_idx"], order, max(sizes))
        means = rows.groupBy("combination_idx").agg(*[F.avg(F.when(F.col("_i") <= k, F.col("value"))).alias(f"{side}_{k}") for k in sizes])
        out = means if out is None else out.join(means, "combination_idx")
    return out


def lowest_positives(predictions: DataFrame, texts: DataFrame, n: int = 100) -> DataFrame:
    """Each user's n up-votes of the lowest probability with titles, place 1 the most probable of them; n_all: how many up-votes there are. predictions: user_id, paper_id, t, label, proba."""
    user = Window.partitionBy("user_id")
    rows = predictions.filter("label = 1").withColumn("_i", F.row_number().over(user.orderBy("proba", "paper_id", "t"))).withColumn("n_all", F.count("*").over(user))
    rows = rows.filter(F.col("_i") <= n).withColumn("place", F.least(F.col("n_all"), F.lit(n)) - F.col("_i") + 1)
    return rows.join(texts.select("paper_id", "title"), "paper_id", "left").select("user_id", F.col("place").cast("long").alias("place"), "paper_id", "t", "title", "proba", "n_all")


def drawn_papers(predictions: DataFrame, texts: DataFrame, n: int, seed: int) -> DataFrame:
    """n drawn papers of each user and label with titles, by probability: the most probable first for up-votes, last for the others; n_all: how many there are."""
    key = F.md5(F.concat_ws("|", F.lit(seed), F.lit("drawn"), "user_id", "paper_id", "t"))
    side = Window.partitionBy("user_id", "label")
    rows = predictions.withColumn("_i", F.row_number().over(side.orderBy(key, "paper_id", "t"))).withColumn("n_all", F.count("*").over(side)).filter(F.col("_i") <= n)
    order = F.when(F.col("label") == 1, -F.col("proba")).otherwise(F.col("proba"))
    rows = rows.withColumn("place", F.row_number().over(side.orderBy(order, "paper_id", "t")).cast("long"))
    return rows.join(texts.select("paper_id", "title"), "paper_id", "left").select("user_id", "label", "place", "paper_id", "t", "title", "proba", "n_all")
