import numpy as np
import pytest
from pyspark.sql import functions as F

from votelake.functions import text as T
from votelake.functions import vectors as V
from votelake.operators import prepare as P
from votelake.operators import sampling as S
from votelake.operators import scoring as M
from votelake.operators import splits as X

MIN = 60_000_000


def votes(spark, rows):
    return spark.createDataFrame(rows, "user_id long, paper_id long, rating int, t long")


def test_sessions_break_after_the_gap_only(spark):
    rows = [(1, 1, 1, 0), (1, 2, 1, 420 * MIN), (1, 3, 0, 840 * MIN + 1000), (1, 4, 0, 1260 * MIN + 999), (2, 1, 1, 5)]
    got = {(r.user_id, r.paper_id): r.session_id for r in P.sessionize(votes(spark, rows)).collect()}
    assert got == {(1, 1): 0, (1, 2): 0, (1, 3): 1, (1, 4): 1, (2, 1): 0}


def test_neutral_votes_take_the_nearest_session(spark):
    rated = P.sessionize(votes(spark, [(1, 1, 1, 0), (1, 2, 1, 1000 * MIN)]))
    neutral = votes(spark, [(1, 10, 2, 500 * MIN), (1, 11, 2, 420 * MIN), (1, 12, 2, 579 * MIN), (1, 13, 2, 580 * MIN), (1, 14, 2, 1420 * MIN), (1, 15, 2, 1420 * MIN + 1000), (1, 16, 2, -5), (2, 1, 2, 0)])
    got = {r.paper_id: r.session_id for r in P.assign_neutral_to_sessions(rated, neutral).filter("rating = 2").collect()}
    assert got == {11: 0, 13: 1, 14: 1, 16: 0}
    tie = P.assign_neutral_to_sessions(P.sessionize(votes(spark, [(1, 1, 1, 0), (1, 2, 1, 800 * MIN)])), votes(spark, [(1, 9, 2, 400 * MIN)]))
    assert [r.session_id for r in tie.filter("rating = 2").collect()] == [0]


def test_split_edges(spark):
    rows = [(1, i, 1, i) for i in range(10)]
    one = votes(spark, rows).withColumn("session_id", (F.col("paper_id") / 5).cast("long"))
    assert X.session_split(one, 1, 1, 1, 1).count() == 0
    got = X.session_split(one, 0, 0, 0, 0, 1, 1.0)
    assert {r.split for r in got.collect()} == {"val"} and got.count() == 10
    assert {(r.session_id, r.split) for r in X.session_split(one, 0, 0, 0, 0, 1, 0.5).collect()} == {(0, "train"), (1, "val")}


@pytest.mark.parametrize("causal", [False, True])
def test_closest_negatives_brute_force(spark, causal):
    rng = np.random.default_rng(4)
    rows = [(int(u), i, int(rng.integers(0, 2)), int(rng.integers(0, 40)) * 200 * MIN) for u in range(4) for i in range(30)]
    df = P.sessionize(votes(spark, rows))
    data = df.collect()
    want = set()
    for u in data:
        if u.rating == 1:
            d = sorted((abs(u.t - n.t), n.t, n.paper_id) for n in data if n.user_id == u.user_id and n.rating == 0 and (not causal or n.session_id >= u.session_id))
            want |= {(u.user_id, u.paper_id, x[2], k + 1) for k, x in enumerate(d[:4])}
    assert {(r.user_id, r.paper_id, r.neg_paper_id, r.place) for r in S.closest_negatives(df, 4, causal).collect()} == want


def test_quota_is_exact(spark):
    ratios = spark.createDataFrame([("a", 1 / 3), ("b", 1 / 3), ("c", 1 / 3)], "category string, ratio double")
    for n in (0, 1, 100):
        q = [r.quota for r in S.category_quota(ratios, n, 1).collect()]
        assert sum(q) == n and max(q) - min(q) <= 1


def test_sample_falls_back_to_all_rows(spark):
    papers = spark.range(50).select(F.col("id").alias("paper_id"), F.lit("a").alias("l1"))
    quota = spark.createDataFrame([("a", 60)], "category string, quota long")
    assert S.sample_by_category(papers, quota, 1).count() == 50


def test_cosine_closed_form(spark):
    rows = [("z", [0.0, 0.0]), ("z", [1.0, 0.0]), ("one", [1.0, 2.0]), ("o", [1.0, 0.0]), ("o", [0.0, 3.0]), ("s", [2.0, 2.0]), ("s", [1.0, 1.0])]
    got = {r.g: r.cosine for r in V.mean_pairwise_cosine(spark.createDataFrame(rows, "g string, v array<double>"), ["g"], "v").collect()}
    assert got["one"] is None and got["z"] == 0 and got["o"] == 0 and abs(got["s"] - 1) < 1e-12


def test_rank_is_pessimistic(spark):
    pos = spark.createDataFrame([(1, 0.5), (2, 0.1)], "k long, logit double")
    neg = spark.createDataFrame([(1, 0.5), (1, 0.5), (1, 0.4)], "k long, logit double")
    assert {r.k: r["rank"] for r in M.rank_positives(pos, neg, ["k"]).collect()} == {1: 3, 2: 1}


def test_logistic_optimum():
    rng = np.random.default_rng(0)
    x, w = rng.normal(size=(200, 6)), rng.uniform(0.5, 2, 200)
    y = (x[:, 0] + rng.normal(size=200) > 0).astype(float)
    theta = M.fit_logistic(x, y, w, 0.7)
    p = 1 / (1 + np.exp(-(x @ theta[:-1] + theta[-1])))
    g = np.append(theta[:-1] + 0.7 * x.T @ (w * (p - y)), 0.7 * (w * (p - y)).sum())
    assert np.abs(g).max() < 1e-6


def test_tfidf_rows_have_length_one(spark):
    docs = spark.createDataFrame([(1, "Red fox the red"), (2, "fox"), (3, ""), (4, None)], "paper_id long, abstract string")
    c = T.count_terms(docs, "abstract", ["the"])
    w = T.transform_tfidf(c, T.fit_tfidf(T.by_term(c), docs, 10)).groupBy("paper_id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert {r.paper_id for r in w} == {1, 2} and all(abs(r.s - 1) < 1e-12 for r in w)
    assert {r.term for r in T.by_term(c).filter("paper_id = 1").collect()} == {"red", "fox", "red fox", "fox red"}


def test_tokens_stand_alone_without_accents(spark):
    docs = spark.createDataFrame([(1, "9abc ñandú ÉTÉ über_2 a straße x1 e\u0301te\u0301 abc-def ab9")], "paper_id long, abstract string")
    assert docs.select(T.tokens("abstract", ["et al"])).first()[0] == ["nandu", "ete", "uber_2", "x1", "ete", "abc", "def", "ab9"]


def test_user_models_with_cache_reach_the_optimum(spark):
    rng = np.random.default_rng(2)
    emb = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(40)], "paper_id long, embedding array<double>")
    rated = votes(spark, [(u, i, int(rng.integers(0, 2)), i) for u in (1, 2) for i in range(20)])
    weights = spark.createDataFrame([(1, 0, 0.5, 1.0, 2.0, 0.3), (1, 1, 2.0, 1.0, 1.0, 0.1), (2, 0, 1.0, 3.0, 1.0, 0.2), (9, 0, 1.0, 1.0, 1.0, 1.0)], "user_id long, combination_idx int, c double, w_pos double, w_neg double, w_cache double")
    cache = spark.createDataFrame([(i,) for i in range(30, 40)], "paper_id long")
    got = M.train_user_models(rated, emb, weights, cache).collect()
    assert {(r.user_id, r.combination_idx) for r in got} == {(1, 0), (1, 1), (2, 0)}
    vectors, labels = {r.paper_id: r.embedding for r in emb.collect()}, {(r.user_id, r.paper_id): r.rating for r in rated.collect()}
    grid = {(r.user_id, r.combination_idx): r for r in weights.collect()}
    for r in got:
        g = grid[r.user_id, r.combination_idx]
        x = np.array([vectors[i] for i in (*range(20), *range(30, 40))])
        y = np.array([labels[r.user_id, i] for i in range(20)] + [0] * 10)
        w = np.where(y == 1, g.w_pos, g.w_neg)
        w[20:] = g.w_cache
        p = 1 / (1 + np.exp(-(x @ np.array(r.coef) + r.intercept)))
        slope = np.append(np.array(r.coef) + g.c * x.T @ (w * (p - y)), g.c * (w * (p - y)).sum())
        assert np.abs(slope).max() < 1e-6


def test_places_are_drawn_without_gaps(spark):
    users = spark.range(500).select((F.col("id") % 400).alias("user_id"))
    got = X.drawn_places(users, 3, "x").collect()
    assert sorted(r.place for r in got) == list(range(1, 401)) and len({r.user_id for r in got}) == 400
