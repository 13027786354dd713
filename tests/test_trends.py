import numpy as np
import pytest
from pyspark.sql import functions as F

from votelake.operators import trends as N

DAY = 86_400_000_000
HIST = "user_id long, val_session long, val_t long, paper_id long, rating int, t long"


def test_windows_are_clipped_and_users_counted(spark):
    rows = spark.createDataFrame([(1, 0, 4), (1, 1, 0), (1, 3, 2), (2, 0, 0), (3, None, 5)], "user_id long, session_id long, n long")
    rates = {(r.i, r.user_id): r.v for r in N.window_scores(rows, "session_id", 1, "n", "rate").collect()}
    assert rates == {(0, 1): 2.0, (1, 1): 4 / 3, (2, 1): 2 / 3, (3, 1): 1.0}
    means = {(r.i, r.user_id): r.v for r in N.window_scores(rows, "session_id", 1, "n").collect()}
    assert means[(0, 1)] == 2.0 and means[(0, 2)] == 0.0 and means[(2, 1)] == 1.0
    out = {r.i: r for r in N.over_users(N.window_scores(rows, "session_id", 1, "n"), rows, ["i"]).collect()}
    assert out[0].n_users == 2 and out[0].share == pytest.approx(2 / 3) and (out[0].median, out[0].low, out[0].high) == (1.0, 0.5, 1.5)
    rough = {r.i: r.n_users for r in N.over_users(N.window_scores(rows, "session_id", 1, "n"), rows, ["i"], 100).collect()}
    assert rough == {i: r.n_users for i, r in out.items()}
    with pytest.raises(ValueError):
        N.window_scores(rows, "session_id", 1, "n", "other")


def test_windows_of_an_empty_table(spark):
    rows = spark.createDataFrame([], "user_id long, session_id long, n long")
    assert N.over_users(N.window_scores(rows, "session_id", 1, "n"), rows, ["i"]).collect() == []


def test_window_cosines_against_pairs(spark):
    draw = np.random.default_rng(3)
    rows = [(u, s, int(draw.integers(0, 2)), [float(x) for x in draw.normal(size=4)]) for u in (1, 2) for s in range(4) for _ in range(3)] + [(1, 0, 1, [0.0] * 4), (1, 0, 2, [1.0] * 4)]
    got = {(r.i, r.user_id, r.measure): r.v for r in N.window_cosines(spark.createDataFrame(rows, "user_id long, session_id long, rating int, embedding array<double>"), "session_id", 1).collect()}
    unit = [(u, s, r, np.array(v) / (np.linalg.norm(v) or 1)) for u, s, r, v in rows if r < 2]
    want = {}
    for u in (1, 2):
        for i in range(4):
            here = [x for x in unit if x[0] == u and abs(x[1] - i) <= 1]
            kinds = {s: {x[2] for x in here if x[1] == s} for s in range(4)}
            pick = {"all": lambda a, b: True, "pos": lambda a, b: a[2] == b[2] == 1, "neg": lambda a, b: a[2] == b[2] == 0, "pos_neg": lambda a, b: a[2] != b[2] and len(kinds[a[1]]) == len(kinds[b[1]]) == 2}
            for name, takes in pick.items():
                c = [float(a[3] @ b[3]) for k, a in enumerate(here) for b in here[k + 1 :] if takes(a, b)]
                if c:
                    want[(i, u, name)] = np.mean(c)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_session_edges(spark):
    m = spark.createDataFrame([(1, s, t * DAY, n, v) for s, t, n, v in [(2, 0, 1, 0.1), (3, 1, 3, 0.5), (5, 2, 1, 0.9), (6, 50, 2, 0.2), (8, 100, 1, 0.4)]] + [(2, 0, 5, 2, 0.7)], "user_id long, session_id long, t long, n long, v double")
    a, b = N.session_edges(m, "v").orderBy("user_id").collect()
    assert (a.first_sessions, a.last_sessions, a.last_times) == (0.1, 0.4, 0.4) and a.first_times == pytest.approx((0.1 + 1.5 + 0.9) / 5)
    assert {b.first_sessions, b.last_sessions, b.first_times, b.last_times} == {0.7}


def test_bins_drop_late_training_sessions(spark):
    rows = [(1, 0, "train", 3, 3, None), (1, 1, "val", 2, 5, 0.5), (1, 2, "train", 9, 14, None), (1, 3, "val", 6, 20, 1.0), (2, 0, "train", 1, 1, None)]
    s = spark.createDataFrame(rows, "user_id long, session_id long, split string, n_pos long, cum long, v double").withColumn("k", F.lit(2))
    got = {(r.user_id, r.bin): (r.n_pos, r.cum, r.v) for r in N.binned_sessions(s, "cum", 5, 10, "v", ["n_pos"], ["k"]).collect()}
    assert got == {(1, 0): (3, 3, None), (1, 1): (2, 5, 0.5), (1, 2): (6, 20, 1.0), (2, 0): (1, 1, None)}
    wide = {r.bin: (r.mean_2, r.n_users_2) for r in N.bins_by_k(N.binned_sessions(s, "cum", 5, 10, "v", ["n_pos"], ["k"]), "v", [2]).collect()}
    assert wide == {0: (None, 0), 1: (0.5, 1), 2: (1.0, 1)}


def test_best_k_table_ties_and_missing_k(spark):
    r = spark.createDataFrame([(1, 1, "ndcg", 0.5), (1, 2, "ndcg", 0.5), (2, 2, "ndcg", 0.9), (1, 1, "mrr", 0.1), (1, 2, "mrr", 0.3), (2, 2, "mrr", 0.7)], "user_id long, k int, score string, value double")
    got = {(x.best_k, x.score, x.k): (round(x.value, 6), x.n_users) for x in N.best_k_table(r, "ndcg").collect()}
    assert got[(1, "mrr", None)] == (0.1, 1) and got[(1, "mrr", 2)] == (0.3, 1) and (2, "ndcg", 1) not in got
    assert got[(None, "ndcg", 2)] == (0.7, 2) and got[(None, "ndcg", 1)] == (0.5, 1) and got[(None, "mrr", None)] == (0.4, 2)


def test_model_shape(spark):
    models = spark.createDataFrame([(1, 0, [0.0, 0.0005, -3.0, 1.0]), (1, 4, [2.0, 0.0, 1.0, 0.0])], "user_id long, session_id long, coef array<double>")
    a, b = N.model_shape(models, n=2).orderBy("session_id").collect()
    assert a.overlap_prev is None and a.overlap_first is None and (b.overlap_prev, b.overlap_first) == (0.5, 0.5)
    assert (a.share_nonzero, a.n_nonzero) == (0.5, 3) and a.std == pytest.approx(np.std([0.0, 0.0005, -3.0, 1.0])) and a.mean_abs == pytest.approx(4.0005 / 4)


def test_attached_columns(spark):
    s = spark.createDataFrame([(1, 0), (1, 1)], "user_id long, session_id long")
    run = spark.createDataFrame([(1, 1, 2, 0.5)], "user_id long, session_id long, best_k int, share double")
    a, b = N.attach_columns(s, [run, run.withColumn("best_k", F.lit(4))], ["best_k", "share"]).orderBy("session_id").collect()
    assert (a.split, a.best_k) == ("train", None) and (b.split, b.best_k, b.share) == ("val", 3.0, 0.5)


@pytest.mark.parametrize("mode", ["joint", "separate", "positives"])
def test_decay_with_cache_totals(spark, mode):
    rows = [(1, 9, 10 * DAY, i, r, d * DAY) for i, (r, d) in enumerate([(1, 0), (1, 7), (0, 3), (0, 9)])]
    got = N.decay_with_cache(spark.createDataFrame(rows, HIST), 0.2, 6, 0.4, 0.9, mode).orderBy("paper_id").collect()
    up, down, cache = sum(r.weight for r in got[:2]), sum(r.weight for r in got[2:]), 6 * got[0].w_cache
    total = {"joint": 1.4, "separate": 1.4, "positives": 1.0}[mode]
    if mode == "joint":  # up-votes keep 1 - s of their share of the decay, the others s of theirs
        p, q = sum(np.exp(-0.2 * np.array([10, 3]))), sum(np.exp(-0.2 * np.array([7, 1])))
        assert up / (down + cache) == pytest.approx(0.6 * p / (0.4 * q))
    else:
        assert up + down + cache == pytest.approx(10 * total)
    assert (got[1].weight > got[0].weight) and (down / cache == pytest.approx(0.9 * 2 / (0.1 * 6)))
    assert N.decay_with_cache(spark.createDataFrame(rows[:2], HIST), 0.2, 0, mode=mode).first().w_cache is None
    with pytest.raises(ValueError):
        N.decay_with_cache(spark.createDataFrame(rows, HIST), 0.2, 6, mode="other")


def test_contrasts_without_some_side(spark):
    emb = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "paper_id long, embedding array<double>")
    split = spark.createDataFrame([(1, 0, 1, 1, 0, "train"), (1, 1, 1, 2, 0, "train"), (1, 2, 1, 3, 1, "val"), (1, 0, 0, 4, 1, "val"), (2, 0, 1, 1, 0, "train")], "user_id long, paper_id long, rating int, t long, session_id long, split string")
    closest = spark.createDataFrame([(1, 0, 1, 0), (1, 1, 2, 0)], "user_id long, paper_id long, t long, neg_paper_id long")
    a, b = N.interest_contrasts(split, emb, closest).orderBy("user_id").collect()
    assert a.drawn_to_val == pytest.approx(0.5**0.5) and a.to_random_down == pytest.approx((1 + 0.5**0.5) / 3)
    assert a.to_closest_down == pytest.approx(0.5) and a.within_sessions == pytest.approx(0.0)
    assert (b.to_closest_down, b.within_sessions) == (None, None)
    near = N.largest_similarity_to_likes(split, emb).collect()
    assert [(r.user_id, r.paper_id, r.similarity) for r in near] == [(1, 0, 1.0)]
    table = {(r.group, r.score): r.n for r in N.contrasts_by_group(N.interest_contrasts(split, emb, closest), spark.createDataFrame([(1, "x")], "user_id long, group string")).collect()}
    assert table[("x", "to_closest_down")] == 1 and table[("all", "drawn_to_val")] == 2
    sliding = {r.user_id: (r.single_session, r.val_successive) for r in N.successive_sessions(split, emb).collect()}
    assert sliding == {1: (1, None), 2: (1, None)}
