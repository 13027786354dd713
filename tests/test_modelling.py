import numpy as np
import pytest
from pyspark.sql import functions as F

from votelake.functions import text as T
from votelake.functions import vectors as V
from votelake.operators import history as H
from votelake.operators import reports as R
from votelake.operators import sampling as S
from votelake.operators import weights as W

DAY = 86_400_000_000
VOTES = "user_id long, paper_id long, rating int, t long, session_id long, split string"


def sessions(spark, ups):
    """One session a day with so many up-votes and one down-vote; the last is the validation session."""
    rows = [(1, 10 * s + i, 1 if i < n else 0, s * DAY + i, s, "val" if s == len(ups) - 1 else "train") for s, n in enumerate(ups) for i in range(n + 1)]
    return spark.createDataFrame(rows, VOTES)


@pytest.mark.parametrize(("ups", "min_pos", "m", "d", "want"), [([2, 1, 1, 1, 0], 3, 1, 99, {1, 2, 3}), ([1, 5, 0, 0, 3], 1, 2, 99, {1, 2, 3}), ([3, 3, 3], 1, 9, 1, {1}), ([1, 1, 1], 9, 1, 99, {0, 1}), ([1, 4, 0, 0, 0], 2, 9, 0, {1, 2, 3})])
def test_history_goes_back_to_enough_up_votes(spark, ups, min_pos, m, d, want):
    got = H.history_for_session(sessions(spark, ups), min_pos, 100, m, d).collect()
    assert {r.session_id for r in got} == want


def test_history_keeps_the_last_votes(spark):
    got = H.history_for_session(sessions(spark, [3, 3, 3]), 1, 2, 9, 99).collect()
    assert sorted(r.paper_id for r in got) == [12, 13]


@pytest.mark.parametrize("mode", ["joint", "separate", "positives"])
def test_decay_weights_have_mean_one(spark, mode):
    rows = H.decay_weights(H.history_for_session(sessions(spark, [1, 2, 1, 1]), 1), 0.3, mode).collect()
    groups = [rows] if mode == "joint" else [[r for r in rows if r.rating == k] for k in (0, 1)]
    for g in groups:
        assert abs(sum(r.weight for r in g) - len(g)) < 1e-9


@pytest.mark.parametrize(("scaling", "param"), [("clip", None), ("linear", None), ("softmax", 0.5), ("inverse", None), ("gaussian", 0.3), ("percentile", 10), ("threshold", None), ("none", None)])
def test_similarity_weights(spark, scaling, param):
    sims = [-0.4, 0.1, 0.25, 0.9]
    df = spark.createDataFrame([(1, i, 0, s) for i, s in enumerate(sims)] + [(2, 9, 0, -1.0)], "user_id long, paper_id long, t long, similarity double")
    got = {r.paper_id: r.weight for r in W.similarity_weights(df, scaling, param).collect()}
    s = np.array(sims)
    raw = {"clip": np.maximum(s, 0), "linear": s + 1, "softmax": np.exp(s / 0.5), "inverse": np.maximum(1 - s, 0), "gaussian": np.exp(-((s - 0.3) ** 2) / 0.045), "percentile": ((s >= np.percentile(s, 10)) & (s <= np.percentile(s, 90))) * 1.0, "threshold": (s >= 0.2) * 1.0, "none": s}[scaling]
    assert np.allclose([got[i] for i in range(4)], raw / raw.sum() * 4)
    assert abs(got[9] - 1) < 1e-9


def test_class_weights_without_a_class(spark):
    c = spark.createDataFrame([(0, 2, 0), (2, 0, 4)], "n_pos long, n_neg long, n_cache long")
    a, b = W.class_weights(c, "no_v").orderBy("n_pos").collect()
    assert (a.w_pos, a.w_neg, a.w_cache) == (0, 0.5, 0) and (b.w_pos, b.w_neg, b.w_cache) == (0.5, 0, 0.25)
    a, b = W.class_weights(c, "cache_v", 0.5).orderBy("n_pos").collect()
    assert a.w_pos is None and a.w_neg == 1 and b.w_pos == 3 and b.w_cache == 1.5


def test_missing_sides(spark):
    pairs = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "user_id long, paper_id long, t long")
    emb = spark.createDataFrame([(1, [1.0, 0.0]), (2, [3.0, 4.0])], "paper_id long, embedding array<double>")
    likes = spark.createDataFrame([(1, 2, 1, 0)], "user_id long, paper_id long, rating int, t long")
    assert {r.user_id: r.logit for r in W.max_pooling_scores(pairs, likes, emb).collect()} == {1: 3.0, 2: 0.0}
    assert {r.user_id: round(r.knn, 9) for r in W.knn_score(pairs, likes, emb).collect()}[1] == 0.6


def test_score_words_takes_the_longest():
    scores = {"a": 1.0, "a b": 5.0, "b c d": 7.0}
    assert T.score_words("a b c d x a".split(), scores, 3) == (6.0, 2)
    assert T.score_words("b c d".split(), scores, 3) == (7.0, 1) and T.score_words([], scores, 3) == (0.0, 0) and T.score_words(["q"], {}, 0) == (0.0, 0)


def test_score_text_over_rows(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "k long, w array<string>")
    got = {r.k: (r.s.total, r.s.matches) for r in df.select("k", T.score_text(F.col("w"), {"a b": 2.0}).alias("s")).collect()}
    assert got == {1: (2.0, 1), 2: (0.0, 0), 3: (0.0, 0)}


def test_pca_keeps_the_plane(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2)) @ rng.normal(size=(2, 5)) + 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "paper_id long, embedding array<double>")
    got = np.array([r.embedding for r in V.pca(df, df, "embedding", 2).orderBy("paper_id").collect()])
    c = x - x.mean(0)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    assert got.shape == (60, 2) and np.allclose(np.linalg.norm(got, axis=1), 1)
    u = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:2]
    p = (x - x.mean(0)) @ u.T
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    assert np.allclose(np.abs(got), np.abs(p), atol=1e-6)
    assert V.pca(df, df, "embedding", 5) is df


def test_bounded_samples(spark):
    rows = [(1, i, int(i < 30), i) for i in range(40)] + [(2, i, 1, i) for i in range(40)] + [(3, i, int(i < 2), i) for i in range(40)]
    got = S.bounded_user_samples(spark.createDataFrame(rows, "user_id long, paper_id long, rating int, t long"), 20, 2, 8, 1).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("rating").alias("p")).collect()
    assert {r.user_id for r in got} == {1, 3} and all(r.n == 20 and 2 <= r.p <= 12 for r in got)


def test_stratified_users_are_disjoint(spark):
    users = spark.range(40).select(F.col("id").alias("user_id"), (F.col("id") % 7).alias("n_val_sessions"), (F.col("id") < 3).alias("is_other"))
    got = S.stratified_eval_users(users, 2, 3, 4, 1).groupBy("selection").count().collect()
    assert {r.selection: r["count"] for r in got} == {"val": 2 + 3 + 3 + 4, "test": 1 + 3 + 3 + 4, "other": 40 - 23}


def test_weighted_draw_follows_the_ratios(spark):
    papers = spark.range(300).select(F.col("id").alias("paper_id"), F.when(F.col("id") < 200, "a").when(F.col("id") < 290, "b").alias("l1"))
    ratios = spark.createDataFrame([("a", 0.25), ("b", 0.75), ("none", 0.5)], "category string, ratio double")
    got = S.category_weighted_draw(papers, ratios, 4000, 3)
    n = {r.category: r["count"] for r in got.groupBy("category").count().collect()}
    assert sum(n.values()) == 4000 and abs(n["a"] - 1000) < 120
    assert got.join(papers, "paper_id").filter("category <> l1").count() == 0 and got.select("paper_id").distinct().count() > 285


def test_mode_ties_go_to_the_smaller_name(spark):
    rows = [(1, 1, "b"), (1, 1, "a"), (1, 0, "a"), (2, 1, "a"), (3, 1, "a"), (3, 0, "b")]
    got = R.category_mode_match(spark.createDataFrame(rows, "user_id long, rating int, l1 string"))
    assert {r.user_id: r.matches for r in got.collect()} == {1: 1, 2: 0, 3: 0}


def test_best_k_path_is_bounded_by_steps(spark):
    nan = float("nan")
    value = np.array([[0.1, 0.2, 0.9], [0.9, 0.5, 0.5], [nan, nan, nan], [0.4, 0.4 + 1e-8, 0.1]])
    logit = np.array([[0, 0, 0], [0, 0, 0], [0.1, 0.3, 0.2], [0, 0, 0]], float)
    assert H.choose_path([1, 3, 5], value, logit, 1, 1) == [2, 2, 2, 1]
    rows = [(1, s, k, None if np.isnan(value[s, i]) else float(value[s, i]), float(logit[s, i])) for s in range(4) for i, k in enumerate((1, 3, 5))]
    got = H.best_k_path(spark.createDataFrame(rows, "user_id long, session_id long, k long, value double, logit double"), [1, 3, 5]).orderBy("session_id").collect()
    assert [r.best_k for r in got] == [5, 5, 5, 3]


def test_encoding_halves_failing_batches_and_skips_known(spark):
    sizes = []

    def encode(texts):
        sizes.append(len(texts))
        if len(texts) > 2:
            raise RuntimeError
        return [[float(len(t))] for t in texts]

    assert T.encode_in_batches(["a", "bb", "ccc", "", "e"], encode, 8, 20) == [[1.0], [2.0], [3.0], [0.0], [1.0]] and sizes == [5, 4, 2, 2, 1]
    with pytest.raises(RuntimeError):
        T.encode_in_batches(["a"] * 9, encode, 8, 0)
    texts = spark.createDataFrame([(1, "red fox"), (2, None), (3, "red fox"), (4, "x")], "paper_id long, abstract string")
    got = {r.paper_id: r.embedding for r in T.encode_texts(texts, "abstract", known=texts.filter("paper_id = 4")).collect()}
    assert set(got) == {1, 2, 3} and got[1] == got[3] and set(got[2]) == {0.0} and abs(sum(x * x for x in got[1]) - 1) < 1e-12
