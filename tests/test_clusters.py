import itertools
import math
import re

import numpy as np
import pytest

from votelake.operators import clusters as C


def brute_clusters(x, eps, least):
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    near = 1 - unit @ unit.T <= eps
    np.fill_diagonal(near, True)
    core, out, label = near.sum(1) >= least, [-1] * len(x), 0
    for i in range(len(x)):
        if not core[i] or out[i] >= 0:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if out[j] < 0:
                out[j] = label
                if core[j]:
                    todo += np.flatnonzero(near[j]).tolist()
        label += 1
    return out


def test_density_clusters_against_brute_force(monkeypatch):
    monkeypatch.setattr(C, "ROWS", 7)
    rng = np.random.default_rng(3)
    for _ in range(40):
        x = rng.normal(size=(rng.integers(1, 60), 3))
        x[rng.random(len(x)) < 0.1] = 0
        eps = rng.choice([0.02, 0.05, 0.1])
        assert C.density_clusters(x, eps, 3).tolist() == brute_clusters(x, eps, 3)


def blobs(spark, users):
    """user: up-votes by direction; papers are two categories of directions, and a down-vote each."""
    rng, votes, papers, emb = np.random.default_rng(1), [], [], []
    for user, sizes in users.items():
        for axis, n in enumerate(sizes):
            for i in range(n + 1):
                paper = user * 1000 + axis * 100 + i
                papers.append((paper, "c", f"c.{axis}"))
                emb.append((paper, (np.eye(4)[axis] * (1 if i < n else -1) + rng.normal(scale=0.05, size=4)).tolist()))
                votes.append((user, paper, 1 if i < n else 0))
    return spark.createDataFrame(votes, "user_id long, paper_id long, rating int"), spark.createDataFrame(papers, "paper_id long, l1 string, l2 string"), spark.createDataFrame(emb, "paper_id long, embedding array<double>")


def test_multi_interest_users(spark):
    votes, papers, emb = blobs(spark, {1: [5, 5], 2: [9], 3: [4, 4, 4], 4: [5, 2], 5: [2, 2, 2]})
    found = {}
    for r in C.dbscan_user_clusters(votes, emb).collect():
        found.setdefault((r.user_id, r.cluster), set()).add(r.paper_id // 100 % 10)
    assert found == {(1, 0): {0}, (1, 1): {1}, (2, 0): {0}, (3, 0): {0}, (3, 1): {1}, (3, 2): {2}, (4, 0): {0}}
    assert [r.user_id for r in C.multi_interest_users(votes, papers, emb, 9).collect()] == [3, 1]
    assert C.multi_interest_users(votes.filter("user_id = 2"), papers, emb, 9).collect() == []


def test_models_by_cluster(spark):
    votes, _, emb = blobs(spark, {1: [12, 12, 2], 2: [3]})
    models = C.cluster_user_models(votes, emb, k=3)
    assert sorted((r.user_id, r.cluster, r.coef is None) for r in models.collect())[-1] == (2, -1, False)
    rows = C.cluster_scores(models, votes.select("user_id", "paper_id", "rating"), emb).collect()
    assert len(rows) == 12 + 12 + 2 + 3 + 3 + 1
    assert {(r.cluster, r.fallback) for r in rows if r.user_id == 2} == {(-1, False)}
    assert {r.fallback for r in rows if r.user_id == 1 and r.rating == 1 and r.paper_id // 100 % 10 == 2} == {True}
    assert {r.fallback for r in rows if r.user_id == 1 and r.rating == 1 and r.paper_id // 100 % 10 < 2} == {False}
    ups, downs = ([r.logit for r in rows if r.rating == k] for k in (1, 0))
    assert np.mean(ups) > np.mean(downs)


def test_k_means_repeated_rows():
    assert len(C.k_means(np.ones((5, 2)), 3, 1)) == 1
    got = C.k_means(np.array([[0.0, 0], [0, 1], [9, 0], [9, 1]]), 2, 1)
    assert sorted(got.tolist()) == [[0.0, 0.5], [9.0, 0.5]]


@pytest.mark.parametrize(("pos", "neg"), [x for x in itertools.product(("absolute", "relative"), ("none", "fixed_neg_scale", "middle", "same_alpha", "same_ratio")) if x != ("absolute", "middle")])
def test_cluster_weights_add_up(spark, pos, neg):
    given = [(3, 5, 2, 4, 10), (3, 0, 2, 0, 10), (0, 5, 0, 4, 10), (4, 4, 0, 3, 0), (2, 6, 3, 0, 5)]
    df = spark.createDataFrame(given, "n_pos_in long, n_pos_out long, n_neg_in long, n_neg_out long, n_cache long")
    for r in C.cluster_weights(df, pos, neg, 0.7, 0.9, 0.4).collect():
        whole = r.n_pos_in + r.n_pos_out + r.n_neg_in + r.n_neg_out + r.n_cache
        total = sum(n * w for n, w in zip(r[:5], r[5:]))
        assert math.isclose(total, whole)
        if r.n_neg_in + r.n_neg_out and r.n_cache and neg == "none":
            assert math.isclose((r.w_neg_in or r.w_neg_out) / r.w_cache, 9)
        if pos == "relative" and r.n_pos_in and r.n_pos_out:
            assert math.isclose(r.w_pos_in / r.w_pos_out, 0.7 / 0.3)
    if (pos, neg) == ("relative", "middle"):
        r = C.cluster_weights(df, pos, neg, 0.7, 0.9, 0.4).first()
        a = 0.7 / (0.7 * 3 + 0.3 * 5)
        before, after = 0.4 / (0.6 * 3 / 8), 0.4 / (0.6 * 3 * a)
        x = (0.6 * after + 0.4 * before) * 3 * a
        assert math.isclose(r.w_pos_in, 24 * (1 - x / (1 + x)) * a)


def test_chosen_k_has_the_best_ranking(spark):
    rng = np.random.default_rng(5)
    centres = np.eye(6) * 4
    rows, vectors = [], []
    for u in (1, 2):
        for i in range(60):
            up = i % 3 != 0
            at = centres[i % (2 if u == 1 else 3)] if up else centres[3 + i % 3]
            vectors.append((u * 100 + i, (at + rng.normal(size=6)).tolist()))
            rows.append((u, u * 100 + i, int(up), i))
    votes = spark.createDataFrame(rows, "user_id long, paper_id long, rating int, t long")
    emb = spark.createDataFrame(vectors, "paper_id long, embedding array<double>")
    held = C.hold_out(votes, 4, 8).filter("held").collect()
    assert {(u, r): sorted(x.t for x in held if (x.user_id, x.rating) == (u, r)) for u in (1, 2) for r in (0, 1)} == {(u, r): ([0, 3, 6, 9, 12, 15, 18, 21] if r == 0 else [1, 2, 4, 5]) for u in (1, 2) for r in (0, 1)}
    chosen = {r.user_id: r for r in C.choose_k(votes, emb, (1, 3), least=2, limits=(8, 1000)).collect()}
    assert set(chosen) == {1, 2}
    train, rest = C.hold_out(votes, 4, 8).filter("NOT held"), C.hold_out(votes, 4, 8).filter("held")
    for k in (1, 3):
        scored = C.cluster_scores(C.cluster_user_models(train, emb, k=k, least=2, limits=(8, 1000)), rest.select("user_id", "paper_id", "rating"), emb).collect()
        for u in (1, 2):
            up, down = ([r.logit for r in scored if r.user_id == u and r.rating == v] for v in (1, 0))
            mean = np.mean([1 / np.log2(2 + sum(d >= x for d in down)) for x in up])
            assert mean <= chosen[u].ndcg + 1e-8 and (k != chosen[u].k or abs(mean - chosen[u].ndcg) < 1e-8)
    models = C.models_by_chosen_k(votes, emb, spark.createDataFrame([(u, r.k) for u, r in chosen.items()], "user_id long, k int"), least=2, limits=(8, 1000)).collect()
    assert {m.user_id for m in models} == {1, 2}


def shuffled(df) -> list[tuple[str, str]]:
    """What each exchange of the plan is dealt by, and its columns."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [(by, columns) for columns, by in re.findall(r"\) Exchange\nInput \[\d+\]: (.*)\nArguments: (\w+\([^,]*)", text)]


def test_models_are_made_once_and_not_shuffled_for_each_pair(spark):
    votes, emb = random_likes(spark, 3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        models = C.cluster_user_models(votes, emb, k=3, least=2, limits=(8, 1000))
        by_paper = [columns for by, columns in shuffled(C.cluster_scores(models, votes.select("user_id", "paper_id", "rating"), emb)) if "paper_id" in by]
        assert by_paper and not any("ms#" in columns for columns in by_paper)
        chosen = C.choose_k(votes, emb, (1, 3), least=2, limits=(8, 1000))
        assert "FlatMapCoGroups" not in chosen._jdf.queryExecution().executedPlan().toString()
        assert chosen.count() == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def random_likes(spark, seed, users=3):
    rng = np.random.default_rng(seed)
    vectors = [(i, (rng.normal(size=3) + 4 * np.eye(3)[i % 3] * (i % 5 > 0)).tolist() if i != 7 else [0.0] * 3) for i in range(150)]
    emb = spark.createDataFrame(vectors, "paper_id long, embedding array<double>")
    rows = [(u, p, int(rng.random() < 0.8), p) for u in range(users) for p in range(150) if rng.random() < 0.8]
    return spark.createDataFrame(rows, "user_id long, paper_id long, rating int, t long"), emb


@pytest.mark.parametrize("eps", [0.02, 0.2, 0.004])
def test_density_clusters_in_blocks_equal_those_of_one_task(spark, eps, monkeypatch):
    votes, emb = random_likes(spark, 11)
    monkeypatch.setattr(C.against, "__defaults__", (16,))  # many parts
    one = {tuple(r) for r in C.dbscan_user_clusters(votes, emb, eps, 3).collect()}
    split = {tuple(r) for r in C.dbscan_user_clusters(votes, emb, eps, 3, max_likes=20).collect()}
    assert one == split and len({r[2] for r in one}) > 1


def test_extremes_of_clusters_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(C.against, "__defaults__", (16,))
    votes, emb = random_likes(spark, 5)
    clusters = votes.filter("rating = 1").selectExpr("user_id", "paper_id", "int(paper_id % 4) AS cluster").unionByName(spark.createDataFrame([(9, 1, 0), (9, 2, 1)], "user_id long, paper_id long, cluster int"))
    v = {r.paper_id: np.array(r.embedding) / (np.linalg.norm(r.embedding) or 1) for r in emb.collect()}
    own = {}
    for r in clusters.collect():
        own.setdefault((r.user_id, r.cluster), []).append(r.paper_id)
    got = {(r.user_id, r.cluster, r.other): (r.high, r.mean, r.low) for r in C.cluster_extremes(clusters, emb).collect()}
    assert len(got) == 3 * 16 + 4
    for (u, a, b), (high, mean, low) in got.items():
        rows = [[float(v[p] @ v[q]) for q in own[u, b] if p != q] for p in own[u, a]]
        if not rows[0]:
            assert high is None and low is None and mean is None
            continue
        assert np.allclose((high, low), (np.mean([max(r) for r in rows]), np.mean([min(r) for r in rows])))
        if 7 not in own[u, a] or a != b:
            assert np.isclose(mean, np.mean([x for r in rows for x in r]))
    out = {(r.user_id, r.cluster): r for r in C.cluster_separation(C.cluster_extremes(clusters, emb)).collect()}
    assert np.isclose(out[1, 0].high, np.mean([got[1, 0, b][0] for b in (1, 2, 3)])) and out[9, 0].silhouette is None


def test_models_of_clusters_in_rounds_equal_those_of_one_task(spark):
    rng = np.random.default_rng(8)
    emb = spark.createDataFrame([(i, (rng.normal(size=2) * 0.1 + [(0, 9), (9, 0), (-9, -9)][i % 3]).tolist()) for i in range(90)], "paper_id long, embedding array<double>")
    votes = spark.createDataFrame([(u, p, int(rng.random() < 0.7), p) for u in (1, 2) for p in range(90)], "user_id long, paper_id long, rating int, t long")
    ks = spark.createDataFrame([(1, 3), (1, 1), (2, 3), (2, None)], "user_id long, k int")
    sorted_ = lambda models: sorted(((r.user_id, r.k or 0, [round(x, 5) + 0.0 for x in r.centre or []], [round(x, 4) + 0.0 for x in [*(r.coef or []), r.intercept or 0]]) for r in models.collect()))
    one = sorted_(C.models_for_ks(votes, emb, ks))
    split = sorted_(C.models_for_ks(votes, emb, ks, max_bytes=100))
    assert len(one) == 4 + 2 * 3 + 1 + 2 and len(one) == len(split)
    for a, b in zip(one, split):
        assert a[:2] == b[:2] and np.allclose(a[3], b[3], atol=1e-3) and np.allclose(a[2], b[2], atol=1e-4) or (a[1] == 0)


def test_large_means_start_far_apart_and_end_at_means(spark):
    from votelake.functions.blocks import pack
    from votelake.operators import large_models as L

    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(200, 2)) * 0.2 + c for c in ((0, 0), (20, 0), (0, 20), (20, 20))])
    rows = spark.createDataFrame([(1, i, int(i % 10 > 0), v.tolist()) for i, v in enumerate(x)], "user_id long, paper_id long, rating int, embedding array<double>")
    centres, counts = L.k_means_large(pack(rows, ["user_id"], "rating", "embedding", "paper_id", 800), ["user_id"], {(1,): (4, 5)})[(1,)]
    assert counts.tolist() == [180] * 4
    up = np.arange(800) % 10 > 0
    want = [x[k * 200 : (k + 1) * 200][up[k * 200 : (k + 1) * 200]].mean(0) for k in range(4)]
    assert all(min(np.abs(c - w).max() for w in want) < 1e-9 for c in centres)
    same = spark.createDataFrame([(1, i, 1, [1.0, 2.0]) for i in range(9)], "user_id long, paper_id long, rating int, embedding array<double>")
    assert len(L.k_means_large(pack(same, ["user_id"], "rating", "embedding", "paper_id"), ["user_id"], {(1,): (3, 5)})[(1,)][0]) == 1
