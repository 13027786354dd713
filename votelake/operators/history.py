"""Histories before validation sessions, their weights and models, and how interests move."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, mean_cosine_between, mean_pairwise_cosine, norm, unit_sums
from .prepare import DAY, by_user
from .scoring import fit_logistic

SESSION = ["user_id", "val_session"]


def history_for_session(votes: DataFrame, min_pos: int = 5, max_rated: int = 500, max_sessions: int = 10, max_days: int = 200) -> DataFrame:
    """A row for each vote in the training history of each (user, validation session); val_t is the session's first time.

    The history has the last max_sessions sessions that end within max_days; where these hold fewer than min_pos
    up-votes it goes back to the latest session from which there are enough, or to the first. Of it the last max_rated
    votes stay. Starts are found by frames over a row for each session, so votes are joined once, with bounded ranges.
    """
    s = votes.groupBy("user_id", "session_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count_if(F.col("rating") == 1).alias("up"), F.max((F.col("split") == "val").cast("int")).alias("val"))
    s = s.withColumn("before", F.coalesce(F.sum("up").over(by_user().orderBy("session_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # all on one sort of a user's sessions: the last max_sessions before a session are a frame of rows, and those from which enough
    # up-votes follow are a frame of values of the running number, which only grows
    late = F.collect_list(F.struct("session_id", "t1")).over(by_user().orderBy("session_id").rowsBetween(-max_sessions, -1))
    enough = F.max("session_id").over(by_user().orderBy("before").rangeBetween(Window.unboundedPreceding, -min_pos)) if min_pos > 0 else F.col("session_id")
    s = s.withColumn("_late", late).withColumn("_enough", enough).filter("val = 1")
    recent = F.filter("_late", lambda h: (h["session_id"] >= F.col("session_id") - max_sessions) & (h["t1"] >= F.col("t0") - max_days * DAY))
    first = F.least(F.coalesce(F.array_min(F.transform(recent, lambda h: h["session_id"])), F.col("session_id")), F.coalesce("_enough", F.lit(0)))
    starts = s.select("user_id", F.col("session_id").alias("val_session"), F.col("t0").alias("val_t"), first.alias("start"))
    # sessions are numbered without gaps, so a start and an end name all that lie between; votes meet only histories that they are in
    named = starts.filter("start < val_session").withColumn("session_id", F.explode(F.sequence(F.col("start").cast("long"), F.col("val_session").cast("long") - 1)))
    rows = votes.join(named, ["user_id", "session_id"])
    place = F.row_number().over(Window.partitionBy(*SESSION).orderBy(F.desc("t"), F.desc("paper_id")))
    return rows.withColumn("place", place).filter(F.col("place") <= max_rated).select(*SESSION, "val_t", "paper_id", "rating", "t", "session_id")


def decay_weights(history: DataFrame, rate: float, mode: str = "joint") -> DataFrame:
    """weight = exp(-rate * whole days before the session), scaled to mean 1 over the history (joint), over each label (separate), or over up-votes with 1 for the others (positives)."""
    raw = F.exp(-rate * F.floor((F.col("val_t") - F.col("t")) / DAY))
    w = Window.partitionBy(*SESSION) if mode == "joint" else Window.partitionBy(*SESSION, "rating")
    rows = history.withColumn("_w", raw)
    scaled = F.col("_w") * F.count("*").over(w) / F.sum("_w").over(w)
    return rows.withColumn("weight", F.when(F.col("rating") == 1, scaled).otherwise(1.0) if mode == "positives" else scaled).drop("_w")


def mean_decay(votes: DataFrame, grid: DataFrame) -> DataFrame:
    """combination_idx, rate, scale and weight: the mean of exp(-rate * scale * days before the user's last vote), for each row of a grid of rates and scales."""
    days = votes.select(((F.max("t").over(by_user()) - F.col("t")) / DAY).alias("d"))
    each = [F.struct(F.lit(r.combination_idx).alias("combination_idx"), F.lit(r.rate).alias("rate"), F.lit(r.scale).alias("scale")) for r in grid.collect()]  # rows of parameters
    rows = days.withColumn("g", F.explode(F.array(*each)))
    return rows.groupBy("g").agg(F.avg(F.exp(-F.col("g.rate") * F.col("g.scale") * F.col("d"))).alias("weight")).select("g.*", "weight")


def train_session_models(history: DataFrame, embeddings: DataFrame, c: float = 1.0) -> DataFrame:
    """user_id, session_id, coef, intercept: a logistic model of each history; a group has max_rated rows at most."""
    rows = history.join(embeddings, "paper_id").select(*SESSION, "rating", "weight", "embedding")

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        theta = fit_logistic(np.stack(pdf.embedding.to_numpy()), pdf.rating.to_numpy(float), pdf.weight.to_numpy(float), c)
        return pd.DataFrame({"user_id": [key[0]], "session_id": [key[1]], "coef": [theta[:-1]], "intercept": [theta[-1]]})

    return rows.groupBy(*SESSION).applyInPandas(fit, "user_id long, session_id long, coef array<double>, intercept double")


def model_drift(models: DataFrame) -> DataFrame:
    """Length and largest coefficient of each session's model, and its distance and cosine to the one before and to the first."""
    order = by_user().orderBy("session_id")
    rows = models.withColumn("_p", F.lag("coef").over(order)).withColumn("_f", F.first("coef").over(order))
    out = ["user_id", "session_id", norm("coef").alias("length"), F.array_max(F.transform("coef", F.abs)).alias("largest")]
    for name, other in (("prev", "_p"), ("first", "_f")):
        gap = F.zip_with("coef", other, lambda x, y: x - y)
        out += [norm(gap).alias(f"dist_{name}"), (dot("coef", other) / (norm("coef") * norm(other))).alias(f"cos_{name}")]
    return rows.select(*out)


def with_vectors(votes: DataFrame, embeddings: DataFrame) -> DataFrame:
    return votes.join(embeddings, "paper_id")


def missing_vectors(votes: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row: votes and papers voted on, and how many of them have no vector, which with_vectors leaves out."""
    papers = votes.groupBy("paper_id").agg(F.count("*").alias("_n"))
    known = papers.join(embeddings.select("paper_id").distinct().withColumn("_has", F.lit(True)), "paper_id", "left")
    gone = F.col("_has").isNull()
    return known.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name) for name, c in (
        ("n_votes", F.col("_n")), ("n_papers", F.lit(1)), ("n_votes_missing", F.when(gone, F.col("_n")).otherwise(0)), ("n_papers_missing", gone.cast("int")),
    )])


def interest_drift(split: DataFrame, embeddings: DataFrame, n: int = 10) -> DataFrame:
    """Per user: mean cosine of the first and of the last n training up-votes to the validation up-votes, and among the latter."""
    up = split.filter("rating = 1")
    train = up.filter("split = 'train'").withColumn("a", F.row_number().over(by_user().orderBy("t", "paper_id"))).withColumn("b", F.row_number().over(by_user().orderBy(F.desc("t"), F.desc("paper_id"))))
    val = with_vectors(up.filter("split = 'val'"), embeddings)
    first, last = (mean_cosine_between(with_vectors(train.filter(F.col(c) <= n), embeddings), val, ["user_id"], "embedding").withColumnRenamed("cosine", name) for c, name in (("a", "first_to_val"), ("b", "last_to_val")))
    return first.join(last, "user_id").join(mean_pairwise_cosine(val, ["user_id"], "embedding").select("user_id", F.col("cosine").alias("within_val")), "user_id")


def cohesion_so_far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """user_id, c of each validation session, from sums of sessions (user_id, session_id, n, sum, nz, val) sorted by user and session."""
    user, total, n, nz = None, 0.0, 0, 0.0
    for batch in batches:
        users, found = [], []
        for k, (u, more, z, val) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("user_id", "n", "nz", "val")))):
            if u != user:
                user, total, n, nz = u, 0.0, 0, 0.0
            total, n, nz = total + batch.column("sum")[k].values.to_numpy(), n + more, nz + z
            if val and n > 1:
                users.append(u)
                found.append((total @ total - nz) / (n * (n - 1)))
        yield pa.RecordBatch.from_arrays([pa.array(users, pa.int64()), pa.array(found, pa.float64())], names=["user_id", "c"])


def history_cohesion(split: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Per user: mean over validation sessions with up-votes of the mean cosine among all up-votes so far.

    A session is one row, its sum of unit vectors; these are added up along each user's sessions in one sorted pass. No pair and no history is built.
    """
    up = with_vectors(split.filter("rating = 1"), embeddings)
    val = up.groupBy("user_id", "session_id").agg(F.max((F.col("split") == "val").cast("int")).alias("val"))
    sums = unit_sums(up, ["user_id", "session_id"], "embedding").join(val, ["user_id", "session_id"])
    rows = sums.repartition("user_id").sortWithinPartitions("user_id", "session_id").select("user_id", "session_id", "n", "sum", "nz", "val")
    return rows.mapInArrow(cohesion_so_far, "user_id long, c double").groupBy("user_id").agg(F.avg("c").alias("cohesion"), F.count("c").alias("n_sessions"))


def user_geometry(split: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Per user: cohesion of the training up-votes, and their mean cosine to those of the first, middle and last validation session."""
    up = split.filter("rating = 1")
    train = with_vectors(up.filter("split = 'train'"), embeddings)
    val = up.filter("split = 'val'").withColumn("i", F.dense_rank().over(by_user().orderBy("session_id")) - 1).withColumn("n", F.max("i").over(by_user()) + 1)
    out = mean_pairwise_cosine(train, ["user_id"], "embedding").select("user_id", F.col("cosine").alias("train_cohesion"))
    for name, at in (("first", F.lit(0)), ("middle", F.floor(F.col("n") / 2)), ("last", F.col("n") - 1)):
        here = with_vectors(val.filter(F.col("i") == at), embeddings)
        out = out.join(mean_cosine_between(train, here, ["user_id"], "embedding").withColumnRenamed("cosine", f"train_to_{name}"), "user_id")
    return out


def choose_path(ks: list[int], value: np.ndarray, logit: np.ndarray, up: int, down: int) -> list[int]:
    """A place in ks for each row (session): the best value within the steps from the place before; values 1e-6 apart
    are equal, and of equal ones the nearest to the place before stays, then the smaller. A row without a value (NaN)
    takes the lowest logit."""
    out: list[int] = []
    for v, x in zip(value, logit):
        at = range(len(ks)) if not out else range(max(0, out[-1] - down), min(len(ks), out[-1] + up + 1))
        score = -x if np.isnan(v).all() else np.where(np.isnan(v), -np.inf, v)
        top = max(score[i] for i in at)
        out.append(min((i for i in at if score[i] >= top - 1e-6), key=lambda i: (abs(i - out[-1]) if out else 0, i)))
    return out


def best_k_path(metrics: DataFrame, ks: list[int], up: int = 1, down: int = 1) -> DataFrame:
    """user_id, session_id, best_k from metrics (user_id, session_id, k, value, logit), one row for each session and k.

    Each session's choice bounds the next one's, so a user's sessions go in order; a group holds sessions times ks small rows.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="session_id", columns="k").sort_index()
        pick = choose_path(ks, wide["value"].reindex(columns=ks).to_numpy(float), wide["logit"].reindex(columns=ks).to_numpy(float), up, down)
        return pd.DataFrame({"user_id": key[0], "session_id": wide.index.to_numpy(), "best_k": [ks[i] for i in pick]})

    return metrics.select("user_id", "session_id", "k", "value", "logit").groupBy("user_id").applyInPandas(run, "user_id long, session_id long, best_k long")
