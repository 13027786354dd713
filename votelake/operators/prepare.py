"""Votes: recoding, sessions, counters, categories, user statistics.

All windows are by user in time order with paper_id as tie-breaker, so one shuffle by user_id
serves the whole chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP = 420 * 60 * 1_000_000
DAY = 24 * 60 * 60 * 1_000_000



def by_user():
    return Window.partitionBy("user_id")


def in_time():
    return by_user().orderBy("t", "paper_id")


def recode_votes(raw: DataFrame) -> DataFrame:
    """rating 1, 0, 2 from vote 1, -1, 0; t in microseconds, floored to milliseconds; votes without a time go."""
    rating = F.when(F.col("vote") == -1, 0).when(F.col("vote") == 0, 2).otherwise(1)
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    return raw.filter("ts IS NOT NULL").select("user_id", "paper_id", rating.alias("rating"), (t - F.pmod(t, F.lit(1000))).alias("t"))


def filter_categorised(votes: DataFrame, papers: DataFrame) -> DataFrame:
    return votes.join(papers.filter("l1 IS NOT NULL AND l2 IS NOT NULL").select("paper_id"), "paper_id", "left_semi").select(*votes.columns)


def flag_membership(papers: DataFrame, votes: DataFrame) -> DataFrame:
    """in_ratings: the paper has a vote that isn't neutral."""
    voted = votes.filter("rating <> 2").select("paper_id").distinct().withColumn("in_ratings", F.lit(True))
    return papers.join(voted, "paper_id", "left").withColumn("in_ratings", F.coalesce("in_ratings", F.lit(False)))


def complete_categories(ids: DataFrame, categories: DataFrame) -> DataFrame:
    """Categories for all ids, NULL where there are none; categories of unknown ids go."""
    return ids.join(categories, "paper_id", "left")


def attach_categories(votes: DataFrame, papers: DataFrame) -> DataFrame:
    return votes.join(papers.select("paper_id", "l1", "l2"), "paper_id", "left").select(*votes.columns, "l1", "l2")


def index_categories(papers: DataFrame, level: str = "l1") -> DataFrame:
    """Index of the category: 0 for NULL, else 1.. in alphabetical order."""
    names = papers.select(level).filter(F.col(level).isNotNull()).distinct()
    names = names.withColumn("idx", F.row_number().over(Window.orderBy(level)))  # as many rows as there are categories
    return papers.join(names, level, "left").select("paper_id", F.coalesce("idx", F.lit(0)).alias(f"{level}_idx"))


def sessionize(votes: DataFrame, gap: int = GAP) -> DataFrame:
    """session_id from 0: a new session where the gap to the user's vote before exceeds the limit."""
    new = F.coalesce((F.col("t") - F.lag("t").over(in_time()) > gap).cast("long"), F.lit(1))
    return votes.withColumn("_new", new).withColumn("session_id", F.sum("_new").over(in_time().rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")


def assign_neutral_to_sessions(rated: DataFrame, neutral: DataFrame, gap: int = GAP) -> DataFrame:
    """Neutral votes in the session of the user's nearest rated vote (the earlier one at equal distance), if within the gap; with the rated votes.

    A nearest as-of join by one union and two windows: linear in the user's votes.
    """
    both = rated.select("user_id", "paper_id", "rating", "t", "session_id").unionByName(neutral.select("user_id", "paper_id", "rating", "t", F.lit(None).cast("long").alias("session_id")))
    order = by_user().orderBy("t", "rating", "paper_id")  # at one time rated votes come before neutral ones
    at = F.when(F.col("session_id").isNotNull(), F.struct("t", "session_id"))
    both = both.withColumn("_a", F.last(at, True).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.first(at, True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    back, ahead = F.col("t") - F.col("_a.t"), F.col("_b.t") - F.col("t")
    nearest = F.when(ahead.isNull() | (back <= ahead), F.col("_a.session_id")).otherwise(F.col("_b.session_id"))
    session = F.when(F.col("rating") != 2, F.col("session_id")).when(F.least(back, ahead) <= gap, nearest)
    return both.withColumn("session_id", session).filter("session_id IS NOT NULL").drop("_a", "_b")


def add_counters(ratings: DataFrame) -> DataFrame:
    """Down-votes still to come (this session and later) and up-votes that came before (earlier sessions)."""
    by_session = by_user().orderBy("session_id")
    down, up = (F.col("rating") == 0).cast("long"), (F.col("rating") == 1).cast("long")
    ahead = F.sum(down).over(by_session.rangeBetween(0, Window.unboundedFollowing))
    before = F.coalesce(F.sum(up).over(by_session.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ratings.withColumn("n_negrated_still_to_come", ahead).withColumn("n_posrated_came_before", before)


def prepared(raw: DataFrame, papers: DataFrame) -> DataFrame:
    """All steps from raw votes to sessions and counters, neutral votes included."""
    votes = filter_categorised(recode_votes(raw), papers)
    return add_counters(assign_neutral_to_sessions(sessionize(votes.filter("rating <> 2")), votes.filter("rating = 2")))


def n_if(condition: Column) -> Column:
    return F.count_if(condition)


def days(low: Column, high: Column) -> Column:
    return F.floor((high - low) / DAY)


def user_info(ratings: DataFrame) -> DataFrame:
    up = F.col("rating") == 1
    return ratings.groupBy("user_id").agg(
        n_if(up).alias("n_posrated"), n_if(F.col("rating") == 0).alias("n_negrated"), F.countDistinct("session_id").alias("n_sessions"),
        F.countDistinct(F.when(up, F.col("session_id"))).alias("n_sessions_pos"), days(F.min("t"), F.max("t")).alias("time_range_days"),
    )


def user_info_by_split(ratings: DataFrame) -> DataFrame:
    """The same for each split, the range of up-votes, and the share of rated votes in the training part."""
    aggs = []
    for s in ("train", "val"):
        here, up = F.col("split") == s, (F.col("split") == s) & (F.col("rating") == 1)
        t_up = F.when(up, F.col("t"))
        aggs += [n_if(up).alias(f"{s}_n_pos"), n_if(here & (F.col("rating") == 0)).alias(f"{s}_n_neg"), F.countDistinct(F.when(here, F.col("session_id"))).alias(f"{s}_n_sessions"), days(F.min(t_up), F.max(t_up)).alias(f"{s}_days_pos")]
    share = F.round(n_if(F.col("split") == "train") / n_if(F.col("split").isin("train", "val")), 6)
    return ratings.filter("rating <> 2").groupBy("user_id").agg(*aggs, share.alias("train_rated_ratio"))


def user_category_distribution(votes: DataFrame) -> DataFrame:
    """Share of each l1 among a user's up-votes (long form)."""
    counts = votes.filter("rating = 1 AND l1 IS NOT NULL").groupBy("user_id", "l1").agg(F.count("*").alias("n"))
    return counts.select("user_id", F.col("l1").alias("category"), (F.col("n") / F.sum("n").over(by_user())).alias("proportion"))


def category_matrix(shares: DataFrame, categories: list[str]) -> DataFrame:
    """Wide form with a column for each category, 0 where there are no votes."""
    return shares.groupBy("user_id").pivot("category", categories).agg(F.first("proportion")).fillna(0.0)


def significant_categories(shares: DataFrame, least: float = 0.1, top: int = 4) -> DataFrame:
    rank = F.row_number().over(by_user().orderBy(F.desc("proportion"), "category"))
    return shares.withColumn("rank", rank).filter((F.col("proportion") >= least) & (F.col("rank") <= top)).select("user_id", "rank", "category", "proportion")


def users_not_in_category(categories: DataFrame, category: str) -> DataFrame:
    return categories.filter((F.col("rank") == 1) & (F.col("category") != category)).select("user_id")


def users_of_many_sessions(split: DataFrame, least: int) -> DataFrame:
    """user_id of users with up-votes in at least so many validation sessions."""
    found = split.filter("split = 'val' AND rating = 1").groupBy("user_id").agg(F.countDistinct("session_id").alias("s"))
    return found.filter(F.col("s") >= least).select("user_id")


def select_users(votes: DataFrame, lists: DataFrame, names: list[str], excluding: list[str] | None = None) -> DataFrame:
    """votes of the users in any of the named lists (lists: user_id, selection) and in none of those excluded. No names: all users but the excluded."""
    users = lists.select("user_id", "selection")
    kept = votes.join(users.filter(F.col("selection").isin(names)).select("user_id").distinct(), "user_id", "left_semi") if names else votes
    return kept.join(users.filter(F.col("selection").isin(excluding)).select("user_id").distinct(), "user_id", "left_anti") if excluding else kept


def filter_users_min_votes(ratings: DataFrame, min_pos: int, min_neg: int, min_sessions: int = 0) -> DataFrame:
    counts = ratings.groupBy("user_id").agg(n_if(F.col("rating") == 1).alias("p"), n_if(F.col("rating") == 0).alias("n"), F.countDistinct("session_id").alias("s"))
    return ratings.join(counts.filter((F.col("p") >= min_pos) & (F.col("n") >= min_neg) & (F.col("s") >= min_sessions)), "user_id", "left_semi")


def filter_users_activity(ratings: DataFrame, min_sessions: int, min_days: int) -> DataFrame:
    active = ratings.groupBy("user_id").agg(F.countDistinct("session_id").alias("s"), days(F.min("t"), F.max("t")).alias("d"))
    return ratings.join(active.filter((F.col("s") >= min_sessions) & (F.col("d") >= min_days)), "user_id", "left_semi")


def split_head_tail(ratings: DataFrame, k: int = 4) -> DataFrame:
    return ratings.withColumn("part", F.when(F.col("n_negrated_still_to_come") >= k, "head").otherwise("tail"))


def session_table(ratings: DataFrame) -> DataFrame:
    r = F.col("rating")
    return ratings.groupBy("user_id", "session_id").agg(n_if(r == 0).alias("n_neg"), n_if(r == 1).alias("n_pos"), n_if(r == 2).alias("n_neutral"), n_if(r != 2).alias("n_rated"), F.count("*").alias("n_all"), F.min("t").alias("t_min"))


def session_days_passed(sessions: DataFrame) -> DataFrame:
    return sessions.withColumn("days_passed", days(F.min("t_min").over(by_user()), F.col("t_min")))


def cumulative_votes(sessions: DataFrame) -> DataFrame:
    run = by_user().orderBy("session_id").rowsBetween(Window.unboundedPreceding, 0)
    return sessions.withColumn("n_pos_cum", F.sum("n_pos").over(run)).withColumn("n_rated_cum", F.sum("n_rated").over(run))


def category_distribution(papers: DataFrame, level: str = "l1", ids: DataFrame | None = None) -> DataFrame:
    """Papers and their share by category, NULL being one; of the given ids (rated, cached, liked papers) if there are any."""
    papers = papers if ids is None else papers.join(ids.select("paper_id").distinct(), "paper_id", "left_semi")
    counts = papers.groupBy(level).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))


def user_top_categories(shares: DataFrame, n: int = 3) -> DataFrame:
    return shares.withColumn("rank", F.row_number().over(by_user().orderBy(F.desc("proportion"), "category"))).filter(F.col("rank") <= n)


def mid_time_session(sessions: DataFrame) -> DataFrame:
    """The last session that starts at or before the middle of the user's session starts."""
    mid = (F.min("t_min").over(by_user()) + F.max("t_min").over(by_user())) / 2
    return sessions.withColumn("_mid", mid).groupBy("user_id").agg(F.max(F.when(F.col("t_min") <= F.col("_mid"), F.col("session_id"))).alias("mid_session"))


def epoch_and_days(ratings: DataFrame) -> DataFrame:
    """Votes with epoch (whole seconds since 1970) and days (whole days since the user's first vote)."""
    first = F.min("t").over(Window.partitionBy("user_id"))
    return ratings.withColumn("epoch", F.floor(F.col("t") / 1_000_000).cast("long")).withColumn("days", F.floor((F.col("t") - first) / 86_400_000_000).cast("long"))
