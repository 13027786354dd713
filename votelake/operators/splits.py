"""Train and validation parts, user selections, folds.

Random choices follow md5(seed|salt|id), then id: the same in every engine and partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prepare import by_user, n_if


def draw(seed: int, salt: str, *ids: Column | str) -> Column:
    """The sort key of a seeded draw."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *[F.col(i).cast("string") if isinstance(i, str) else i.cast("string") for i in ids]))


def session_split(ratings: DataFrame, min_train_pos: int, min_train_neg: int, min_val_pos: int, min_val_neg: int, min_sessions: int = 1, test_size: float = 0.2) -> DataFrame:
    """Rated votes with split: of all cuts before a session that leave both parts enough votes, the one whose
    validation share is nearest to test_size (at equal distance the later one); users without any go.

    Works on a row for each session: running sums instead of a rescan for each cut.
    """
    up, down = n_if(F.col("rating") == 1), n_if(F.col("rating") == 0)
    s = ratings.groupBy("user_id", "session_id").agg(up.alias("p"), down.alias("q"))
    before = by_user().orderBy("session_id").rowsBetween(Window.unboundedPreceding, -1)
    s = s.select("user_id", "session_id", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in "pq"], *[F.sum(c).over(by_user()).alias(f"{c}1") for c in "pq"], F.count("*").over(by_user()).alias("n"))
    cuts = s.select("user_id", F.col("session_id").alias("cut"), "p0", "q0", "p1", "q1", "n")
    ends = s.filter("session_id = n - 1").select("user_id", F.col("n").alias("cut"), F.col("p1").alias("p0"), F.col("q1").alias("q0"), "p1", "q1", "n")
    cuts = cuts.unionByName(ends).filter((F.col("n") >= min_sessions) & (F.col("p0") >= min_train_pos) & (F.col("q0") >= min_train_neg) & (F.col("p1") - F.col("p0") >= min_val_pos) & (F.col("q1") - F.col("q0") >= min_val_neg))
    off = F.abs((F.col("p1") + F.col("q1") - F.col("p0") - F.col("q0")) / (F.col("p1") + F.col("q1")) - test_size)
    best = cuts.groupBy("user_id").agg(F.min(F.struct(off.alias("off"), (-F.col("cut")).alias("cut"))).alias("b")).select("user_id", (-F.col("b.cut")).alias("cut"))
    return ratings.join(best, "user_id").withColumn("split", F.when(F.col("session_id") < F.col("cut"), "train").otherwise("val")).select(*ratings.columns, "split")


def sequence_train_split(ratings: DataFrame, excluded: DataFrame | None = None, min_before: int = 3) -> DataFrame:
    """val from the second session on where enough up-votes came before; users with an up-vote in val."""
    rows = ratings.withColumn("split", F.when((F.col("session_id") >= 1) & (F.col("n_posrated_came_before") >= min_before), "val").otherwise("train"))
    rows = rows.withColumn("_has", F.max(((F.col("split") == "val") & (F.col("rating") == 1)).cast("int")).over(by_user())).filter("_has = 1").drop("_has")
    return rows if excluded is None else rows.join(excluded, "user_id", "left_anti")


def collapse_val_sessions(ratings: DataFrame) -> DataFrame:
    """All validation votes get the first validation session; the old one stays as old_session_id."""
    first = F.min(F.when(F.col("split") == "val", F.col("session_id"))).over(by_user())
    return ratings.withColumn("old_session_id", F.col("session_id")).withColumn("session_id", F.when(F.col("split") == "val", first).otherwise(F.col("session_id")))


def val_session_offset(ratings: DataFrame) -> DataFrame:
    first = F.min(F.when(F.col("split") == "val", F.col("session_id"))).over(by_user())
    return ratings.withColumn("_first", first).filter("split = 'val'").withColumn("offset", F.col("session_id") - F.col("_first")).drop("_first")


def append_removed(split: DataFrame, tail: DataFrame) -> DataFrame:
    """The tail's votes of the split's users, as split = removed."""
    own = tail.join(split.select("user_id").distinct(), "user_id", "left_semi").withColumn("split", F.lit("removed"))
    return split.unionByName(own.select(*split.columns))


def filter_users_first_split(split: DataFrame, max_train_pos: int = 40, min_train_neg: int = 8, min_val_pos: int = 10, min_val_neg: int = 4, min_val_sessions: int = 3) -> DataFrame:
    t, v, up, down = F.col("split") == "train", F.col("split") == "val", F.col("rating") == 1, F.col("rating") == 0
    c = split.groupBy("user_id").agg(n_if(t & up).alias("tp"), n_if(t & down).alias("tn"), n_if(v & up).alias("vp"), n_if(v & down).alias("vn"), F.countDistinct(F.when(v & up, F.col("session_id"))).alias("vs"))
    good = c.filter((F.col("tp") <= max_train_pos) & (F.col("tn") >= min_train_neg) & (F.col("vp") >= min_val_pos) & (F.col("vn") >= min_val_neg) & (F.col("vs") >= min_val_sessions))
    return split.join(good, "user_id", "left_semi")


def drawn_places(users: DataFrame, seed: int, salt: str) -> DataFrame:
    """Distinct user_id with place, 1 .. n in drawn order.

    The order is cut into 4,096 ranges of the drawn key, which is uniform; users are numbered in each, and the ranges'
    sizes (4,096 rows at most) give the offsets. So no task orders all users.
    """
    own = users.select("user_id").distinct().withColumn("_key", draw(seed, salt, "user_id")).withColumn("_range", F.substring("_key", 1, 3))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = own.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_key", "user_id")) + F.col("_start")
    return own.join(F.broadcast(starts), "_range").select("user_id", place.cast("long").alias("place"))


def partition_users(eligible: DataFrame, others: DataFrame, n_test: int, seed: int) -> DataFrame:
    """user_id and selection: the eligible as test (n_test of them) and val, all others as train."""
    own = drawn_places(eligible, seed, "users").select("user_id", F.when(F.col("place") <= n_test, "test").otherwise("val").alias("selection"))
    rest = others.select("user_id").distinct().join(own, "user_id", "left_anti").withColumn("selection", F.lit("train"))
    return own.unionByName(rest)


def remap_users(users: DataFrame, seed: int) -> DataFrame:
    """A random bijection of user ids to 0 .. n-1."""
    return drawn_places(users, seed, "remap").select("user_id", (F.col("place") - 1).alias("new_id"))


def random_split(ratings: DataFrame, test_size: float, seed: int, stratify: bool = True) -> DataFrame:
    keys = ["user_id", "rating"] if stratify else ["user_id"]
    w = Window.partitionBy(*keys)
    i = F.row_number().over(w.orderBy(draw(seed, "split", "user_id", "paper_id", "t"), "paper_id", "t"))
    return ratings.withColumn("split", F.when(i <= F.round(F.count("*").over(w) * test_size), "val").otherwise("train"))


def kfold(ratings: DataFrame, k: int, seed: int, stratified: bool = True) -> DataFrame:
    keys = ["user_id", "rating"] if stratified else ["user_id"]
    order = Window.partitionBy(*keys).orderBy(draw(seed, "fold", "user_id", "paper_id", "t"), "paper_id", "t")
    return ratings.withColumn("fold_idx", (F.row_number().over(order) - 1) % k)


def fold_splits(folds: DataFrame, k: int) -> DataFrame:
    """Votes with fold_idx as k training runs: each vote once a run, with split val in the run of its own fold and train in the others."""
    runs = folds.withColumnRenamed("fold_idx", "_own").withColumn("fold_idx", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return runs.withColumn("split", F.when(F.col("_own") == F.col("fold_idx"), "val").otherwise("train")).drop("_own")


def users_by_val_sessions(split: DataFrame, n: int, largest: bool = True) -> DataFrame:
    """Users with the most (or fewest) validation sessions that have an up-vote."""
    c = split.groupBy("user_id").agg(F.countDistinct(F.when((F.col("split") == "val") & (F.col("rating") == 1), F.col("session_id"))).alias("n_val_sessions"))
    return c.orderBy(F.desc("n_val_sessions") if largest else F.asc("n_val_sessions"), "user_id").limit(n)
