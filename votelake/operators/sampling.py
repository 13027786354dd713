"""Negative samples: quotas by category, closest votes in time, pools and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .splits import draw


def category_quota(ratios: DataFrame, n: int, seed: int) -> DataFrame:
    """category, quota: floor(n * ratio), the remainder one each to categories in drawn order. A row for each category."""
    q = ratios.withColumn("whole", F.floor(F.col("ratio") * n + 1e-10)).withColumn("cut", F.col("ratio") * n - F.col("whole") > 1e-10)
    left = F.lit(n) - F.sum("whole").over(Window.partitionBy(F.lit(0)))
    order = F.row_number().over(Window.orderBy(F.desc("cut"), draw(seed, "quota", "category"), "category"))
    return q.select("category", (F.col("whole") + (order <= left).cast("long")).alias("quota"))


def sample_by_category(papers: DataFrame, quota: DataFrame, seed: int, exclude: DataFrame | None = None) -> DataFrame:
    """quota papers of each l1 in drawn order; rank is the place in it.

    Papers beyond four times the quota's expected draw are dropped before the ranking by a bound on the drawn key, so a
    large category isn't sorted whole; where the bound left too few, all its papers are ranked.
    """
    pool = papers.filter("l1 IS NOT NULL")
    pool = pool if exclude is None else pool.join(exclude.select("paper_id"), "paper_id", "left_anti")
    pool = pool.withColumn("key", draw(seed, "paper", "paper_id"))
    sizes = pool.groupBy("l1").agg(F.count("*").alias("size")).join(quota, F.col("l1") == F.col("category")).select("category", "quota", "size")
    bound = F.lpad(F.lower(F.hex(F.least(F.lit(2**32 - 1), F.ceil((F.col("quota") * 4 + 64) / F.col("size") * 2**32)).cast("long"))), 8, "0")
    near = pool.join(F.broadcast(sizes.withColumn("bound", bound)), F.col("l1") == F.col("category")).filter(F.substring("key", 1, 8) <= F.col("bound"))
    short = near.groupBy("category").agg(F.count("*").alias("got"), F.max("quota").alias("q"), F.max("size").alias("s")).filter("got < least(q, s)").select("category")
    rest = pool.join(F.broadcast(sizes.join(short, "category", "left_semi")), F.col("l1") == F.col("category")).drop("size")
    both = near.join(F.broadcast(short), "category", "left_anti").select("paper_id", "category", "quota", "key").unionByName(rest.select("paper_id", "category", "quota", "key"))
    order = Window.partitionBy("category").orderBy("key", "paper_id")
    return both.withColumn("rank", F.row_number().over(order)).filter("rank <= quota").select("paper_id", "category", "rank")


def user_category_ratios(users: DataFrame, ratios: DataFrame, significant: DataFrame) -> DataFrame:
    """Ratios without the user's significant categories, adding up to 1 again."""
    rows = users.select("user_id").distinct().crossJoin(F.broadcast(ratios)).join(significant.select("user_id", "category"), ["user_id", "category"], "left_anti")
    return rows.withColumn("ratio", F.col("ratio") / F.sum("ratio").over(Window.partitionBy("user_id")))


def closest_negatives(votes: DataFrame, k: int = 4, causal: bool = False) -> DataFrame:
    """For each up-vote the k down-votes of the user nearest in time (earlier first, then smaller paper_id); causal: of
    the same or a later session. place is the rank.

    Only the k times of down-votes up to the up-vote's and the k after it can be among them, so each up-vote meets those
    by number: the work grows with k, not with the user's down-votes.
    """
    votes = votes.filter("rating <> 2").select("user_id", "session_id", "paper_id", "rating", "t")
    user = Window.partitionBy("user_id")
    times = votes.withColumn("down", F.when(F.col("rating") == 0, F.col("t")))
    new = F.when(F.col("down").isNotNull() & ~F.col("down").eqNullSafe(F.max("down").over(user.orderBy("t", "rating", "paper_id").rowsBetween(Window.unboundedPreceding, -1))), 1).otherwise(0)
    times = times.withColumn("new", new).withColumn("j", F.sum("new").over(user.orderBy("t").rangeBetween(Window.unboundedPreceding, 0)))
    downs = times.filter("rating = 0").select("user_id", F.col("session_id").alias("neg_session"), F.col("t").alias("neg_t"), F.col("paper_id").alias("neg_paper_id"), F.col("j").alias("n"))
    ups = times.filter("rating = 1").select("user_id", "session_id", "paper_id", "t", F.explode(F.sequence(F.col("j") - k + 1, F.col("j") + k)).alias("n"))
    met = ups.join(downs, ["user_id", "n"])
    met = met.filter("neg_session >= session_id") if causal else met
    order = Window.partitionBy("user_id", "paper_id", "t").orderBy(F.abs(F.col("t") - F.col("neg_t")), "neg_t", "neg_paper_id")
    return met.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("user_id", "session_id", "paper_id", "t", "neg_paper_id", "neg_t", "place")


def random_negatives(votes: DataFrame, k: int, seed: int) -> DataFrame:
    """One drawn set of k down-votes for each user."""
    order = Window.partitionBy("user_id").orderBy(draw(seed, "neg", "user_id", "paper_id", "t"), "paper_id", "t")
    return votes.filter("rating = 0").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("user_id", "paper_id", "t", "place")


def random_negatives_each(votes: DataFrame, k: int, seed: int) -> DataFrame:
    """For each up-vote k drawn down-votes of its user.

    A drawn set for each up-vote is a run of k places, from a drawn start, in one drawn order of the user's down-votes,
    so that up-votes aren't joined with all of them: every down-vote is as likely, and a set has no vote twice.
    """
    order = Window.partitionBy("user_id").orderBy(draw(seed, "neg", "user_id", "paper_id", "t"), "paper_id", "t")
    neg = votes.filter("rating = 0").withColumn("at", F.row_number().over(order) - 1).select("user_id", F.col("paper_id").alias("neg_paper_id"), F.col("t").alias("neg_t"), "at")
    sizes = neg.groupBy("user_id").agg(F.count("*").alias("n"))
    start = F.conv(F.substring(draw(seed, "each", "user_id", "paper_id", "t"), 1, 8), 16, 10).cast("long") % F.col("n")
    asked = votes.filter("rating = 1").join(sizes, "user_id").withColumn("place", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(k), F.col("n")))))
    asked = asked.withColumn("at", (start + F.col("place") - 1) % F.col("n")).select("user_id", "paper_id", "t", "place", "at")
    return asked.join(neg, ["user_id", "at"]).select("user_id", "paper_id", "t", "place", "neg_paper_id", "neg_t")


def ranking_negatives_pool(split: DataFrame, n_removed: int = 4) -> DataFrame:
    """Down-votes by split; the validation pool also has the first down-votes of the removed tail."""
    order = Window.partitionBy("user_id").orderBy("t", "paper_id")
    down = split.filter("rating = 0")
    tail = down.filter("split = 'removed'").withColumn("i", F.row_number().over(order)).filter(F.col("i") <= n_removed).drop("i").withColumn("split", F.lit("val"))
    return down.filter("split <> 'removed'").unionByName(tail)


def user_quotas(ratios: DataFrame, n: int, seed: int) -> DataFrame:
    """user_id, category, quota: category_quota for each user's own ratios (user_id, category, ratio), drawn by user."""
    mine = Window.partitionBy("user_id")
    q = ratios.withColumn("whole", F.floor(F.col("ratio") * n + 1e-10)).withColumn("cut", F.col("ratio") * n - F.col("whole") > 1e-10)
    order = F.row_number().over(mine.orderBy(F.desc("cut"), draw(seed, "quota", "user_id", "category"), "category"))
    return q.select("user_id", "category", (F.col("whole") + (order <= F.lit(n) - F.sum("whole").over(mine)).cast("long")).alias("quota"))


def user_negative_samples(pool: DataFrame, quotas: DataFrame) -> DataFrame:
    """user_id, paper_id: the first papers of each category of the pool, as many as the user's quota."""
    q = quotas.select("user_id", "category", "quota")
    return q.join(pool, "category").filter(F.col("rank") <= F.col("quota")).select("user_id", "paper_id", "category")


def exclude_papers(cache: DataFrame, used: DataFrame) -> DataFrame:
    return cache.join(used.select("user_id", "paper_id").distinct(), ["user_id", "paper_id"], "left_anti")


def user_cache(users: DataFrame, cache: DataFrame, used: DataFrame, extras: DataFrame | None = None) -> DataFrame:
    """The shared cache and the user's extras (user_id, paper_id) without what the user has rated or been given. cache: of a fixed, small size."""
    rows = users.select("user_id").distinct().crossJoin(cache.select("paper_id"))
    rows = rows if extras is None else rows.unionByName(extras.select("user_id", "paper_id")).distinct()
    return exclude_papers(rows, used)


def cache_papers(papers: DataFrame, n: int, seed: int, ratios: DataFrame | None = None, everywhere: bool = False) -> DataFrame:
    """n drawn papers of in_cache; by the ratios of categories if they are given, or of all papers."""
    if ratios is not None:
        return sample_by_category(papers, category_quota(ratios, n, seed), seed).select("paper_id")
    return (papers if everywhere else papers.filter("in_cache")).withColumn("key", draw(seed, "cache", "paper_id")).orderBy("key", "paper_id").limit(n).select("paper_id")


def user_sampling_weights(ratings: DataFrame, power: float) -> DataFrame:
    counts = ratings.groupBy("user_id").agg(F.count("*").alias("n")).withColumn("w", F.pow("n", F.lit(power)))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("w").alias("total")))).select("user_id", (F.col("w") / F.col("total")).alias("weight"))  # one row


def relevant_papers(*parts: DataFrame) -> DataFrame:
    out = parts[0].select("paper_id")
    for p in parts[1:]:
        out = out.unionByName(p.select("paper_id"))
    return out.distinct()


def missing_embeddings(wanted: DataFrame, embeddings: DataFrame) -> DataFrame:
    return wanted.select("paper_id").distinct().join(embeddings.select("paper_id"), "paper_id", "left_anti")


def stratified_eval_users(users: DataFrame, n_other: int, n_ends: int, n_rest: int, seed: int) -> DataFrame:
    """user_id, selection of users (user_id, n_val_sessions, is_other): val and test each get n_other users of is_other,
    n_ends with the most and n_ends with the fewest sessions, and n_rest drawn ones; a user taken once isn't taken again;
    all others are `other`. Each pick is a distributed top-k; only picks of fixed size are ranked in one task."""
    left = users.withColumn("_d", draw(seed, "eval", "user_id"))
    picks = None
    for own, n, order in (("is_other", n_other, ["_d"]), (None, n_ends, [F.desc("n_val_sessions")]), (None, n_ends, [F.asc("n_val_sessions")]), (None, n_rest, ["_d"])):
        pool = left if picks is None else left.join(picks.select("user_id"), "user_id", "left_anti")
        pick = (pool.filter(own) if own else pool).orderBy(*order, "user_id").limit(2 * n)
        pick = pick.withColumn("_i", F.row_number().over(Window.orderBy(*order, "user_id")))
        pick = pick.select("user_id", F.when(F.col("_i") % 2 == 1, "val").otherwise("test").alias("selection"))
        picks = pick if picks is None else picks.unionByName(pick)
    return users.select("user_id").join(picks, "user_id", "left").select("user_id", F.coalesce("selection", F.lit("other")).alias("selection"))


def capped_category_negatives(papers: DataFrame, most: int, seed: int, exclude: DataFrame) -> DataFrame:
    """At most `most` drawn papers of each l1, none of them excluded."""
    quota = papers.filter("l1 IS NOT NULL").select(F.col("l1").alias("category")).distinct().withColumn("quota", F.lit(most).cast("long"))
    return sample_by_category(papers, quota, seed, exclude)


def training_groups(votes: DataFrame, m: int, seed: int, k: int = 4) -> DataFrame:
    """Per user one drawn up-vote of the m most recent, and k drawn of the m down-votes nearest to it in time."""
    user = Window.partitionBy("user_id")
    ups = votes.filter("rating = 1").withColumn("_i", F.row_number().over(user.orderBy(F.desc("t"), F.desc("paper_id")))).filter(F.col("_i") <= m)
    one = ups.withColumn("_k", F.row_number().over(user.orderBy(draw(seed, "up", "user_id", "paper_id", "t"), "paper_id", "t"))).filter("_k = 1").select("user_id", "paper_id", "t")
    near = closest_negatives(votes, m).join(one, ["user_id", "paper_id", "t"], "left_semi")
    order = user.orderBy(draw(seed, "down", "user_id", "neg_paper_id", "neg_t"), "neg_paper_id", "neg_t")
    return near.withColumn("slot", F.row_number().over(order)).filter(F.col("slot") <= k).select("user_id", "paper_id", "t", "neg_paper_id", "neg_t", "slot")


def bounded_user_samples(votes: DataFrame, n: int, min_pos: int, min_neg: int, seed: int) -> DataFrame:
    """n rated votes of each user in drawn order, with at least min_pos up-votes and min_neg down-votes; users that can't give them go."""
    user = Window.partitionBy("user_id")
    key = draw(seed, "sample", "user_id", "paper_id", "t")
    rows = votes.filter("rating <> 2").withColumn("_k", key)
    up = F.col("rating") == 1
    rows = rows.withColumn("_i", F.row_number().over(user.orderBy("_k", "paper_id", "t"))).withColumn("_j", F.row_number().over(Window.partitionBy("user_id", "rating").orderBy("_k", "paper_id", "t")))
    rows = rows.withColumn("_p", F.count_if(up).over(user)).withColumn("_n", F.count_if(~up).over(user)).withColumn("_c", F.count_if(up & (F.col("_i") <= n)).over(user))
    low, high = F.greatest(F.lit(min_pos), n - F.col("_n")), F.least(F.col("_p"), F.lit(n - min_neg))
    take = F.greatest(low, F.least(high, F.col("_c")))
    kept = rows.filter(low <= high).filter(F.col("_j") <= F.when(up, take).otherwise(n - take))
    return kept.select("user_id", "paper_id", "rating", "t")


def uniform(key: Column) -> Column:
    """[0, 1) from the first 32 bits of a drawn key."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def category_weighted_draw(papers: DataFrame, ratios: DataFrame, n: int, seed: int) -> DataFrame:
    """n draws with replacement: draw, category (by ratio), paper_id (uniform within it).

    A paper's number within its category is an offset of its drawn bucket (of 256) and its place there, so no task
    numbers a whole category. ratios: a row for each category; those without papers are left out.
    """
    rows = papers.filter("l1 IS NOT NULL").select("paper_id", F.col("l1").alias("category"), F.substring(draw(seed, "row", "paper_id"), 1, 2).alias("b"))
    before = Window.partitionBy("category").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("category", "b").agg(F.count("*").alias("c")).withColumn("off", F.coalesce(F.sum("c").over(before), F.lit(0))).withColumn("size", F.sum("c").over(Window.partitionBy("category")))
    numbered = rows.join(F.broadcast(sizes), ["category", "b"]).withColumn("i", F.col("off") + F.row_number().over(Window.partitionBy("category", "b").orderBy("paper_id")) - 1)
    held = ratios.join(F.broadcast(sizes.select("category", "size").distinct()), "category")
    total = F.sum("ratio").over(Window.partitionBy(F.lit(0)))
    upto = F.sum("ratio").over(Window.orderBy("category").rowsBetween(Window.unboundedPreceding, 0))
    edges = held.select("category", "size", ((upto - F.col("ratio")) / total).alias("lo"), (upto / total).alias("hi"), (F.row_number().over(Window.orderBy(F.desc("category"))) == 1).alias("last"))
    draws = papers.sparkSession.range(n).select(F.col("id").alias("draw"), uniform(draw(seed, "cat", "id")).alias("u"), uniform(draw(seed, "within", "id")).alias("x"))
    met = draws.join(F.broadcast(edges), (F.col("u") >= F.col("lo")) & ((F.col("u") < F.col("hi")) | F.col("last")))
    met = met.select("draw", "category", F.floor(F.col("x") * F.col("size")).alias("i"))
    return met.join(numbered.select("category", "i", "paper_id"), ["category", "i"]).select("draw", "category", "paper_id")


def training_examples(split: DataFrame, selection: DataFrame, papers: DataFrame) -> DataFrame:
    """Votes of the training users and of the training part of validation users, with categories and second; place: up-votes first, then down-votes, in time order."""
    rows = split.filter("rating <> 2").join(selection, "user_id").filter("selection = 'train' OR (selection = 'val' AND split = 'train')")
    rows = rows.join(papers.select("paper_id", "l1", "l2"), "paper_id", "left").withColumn("second", F.floor(F.col("t") / 1_000_000))
    order = Window.partitionBy("user_id").orderBy(F.desc("rating"), "t", "paper_id")
    return rows.select("user_id", "paper_id", "rating", "l1", "l2", "second", F.row_number().over(order).alias("place"))
