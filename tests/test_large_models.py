import numpy as np
import pytest
from pyspark.sql import functions as F

from votelake.functions import blocks, sums
from votelake.operators import large_models as L
from votelake.operators import scoring as M


def by_key(models):
    return {(r.user_id, r.combination_idx): (np.append(r.coef, r.intercept), r.converged) for r in models.collect()}


@pytest.mark.parametrize("cached", [True, False])
def test_fits_in_rounds_equal_fits_in_one_task(spark, cached, monkeypatch):
    rng = np.random.default_rng(5)
    emb = spark.createDataFrame([(i, (rng.normal(size=3) * 4).tolist()) for i in range(60)], "paper_id long, embedding array<double>")
    rows = [(u, i % 50, int(rng.integers(0, 3)), i) for u, n in ((1, 50), (2, 9), (3, 80)) for i in range(n)]
    votes = spark.createDataFrame(rows, "user_id long, paper_id long, rating int, t long")
    weights = spark.createDataFrame([(u, k, c, 1.0, 2.0, 0.3) for u in (1, 2, 3, 9) for k, c in ((0, 0.5), (1, 50.0))], "user_id long, combination_idx int, c double, w_pos double, w_neg double, w_cache double")
    cache = spark.createDataFrame([(i,) for i in range(50, 60)], "paper_id long") if cached else None
    weights = weights if cached else weights.drop("w_cache")
    one = by_key(M.train_user_models(votes, emb, weights, cache))
    monkeypatch.setattr(L, "BLOCK_BYTES", 200)
    monkeypatch.setattr(L.fit_large, "__defaults__", (100, 200))
    monkeypatch.setattr(L, "ROUND_BYTES", 300)  # two fits at once
    many = by_key(M.train_user_models(votes, emb, weights, cache, max_bytes=15 * 24))
    assert one.keys() == many.keys() and len(one) == 6
    assert all(one[k][1] and many[k][1] and np.allclose(one[k][0], many[k][0], atol=1e-6) for k in one)


def test_every_order_of_sums_converges_in_a_few_rounds():
    """160 deals of 100,000 votes over parts: the sums differ by rounding, and each fit must end by its own rule."""
    rng = np.random.default_rng(2)
    x, truth = rng.normal(size=(100_000, 4)) * 3, rng.normal(size=4)
    y = (rng.random(100_000) < 1 / (1 + np.exp(-x @ truth))).astype(float)
    w = np.where(y == 1, 1.0, 2.0)
    z = L.with_ones(x)
    for deal in range(160):
        few = slice(0, 2000) if deal else slice(None)
        parts = np.array_split(rng.permutation(len(z[few])), 4 + deal % 5)
        fit, rounds = L.Fit(50.0 if deal % 2 else 0.5, 4), 0
        while not fit.done:
            fit.advance(sum(L.sums_at(z[few][p], y[few][p], w[few][p], fit.at()) for p in parts))
            rounds += 1
        assert fit.converged and rounds <= 20
        if deal > 2:
            other = M.fit_logistic(z[few][:, :4], y[few], w[few], fit.c)
            assert np.allclose(fit.theta, other, atol=1e-7)


def test_a_fit_that_does_not_end_says_so():
    x = np.array([[1.0], [-1.0]])
    assert M.converged_fit(x, np.array([1.0, 0.0]), np.ones(2), 1.0)[1]
    assert not M.converged_fit(x, np.array([1.0, 0.0]), np.ones(2), 1.0, rounds=2)[1]


def test_a_user_of_many_votes(spark):
    emb = spark.range(500).select(F.col("id").alias("paper_id"), F.array(*[F.sin(F.col("id") * k) * 3 for k in (1, 2, 3)]).alias("embedding"))
    votes = spark.range(100_000).select(F.lit(7).cast("long").alias("user_id"), (F.col("id") % 500).alias("paper_id"), (F.xxhash64("id") % 2 == 0).cast("int").alias("rating"), F.col("id").alias("t"))
    weights = spark.createDataFrame([(7, 0, 1.0, 1.0, 1.0)], "user_id long, combination_idx int, c double, w_pos double, w_neg double")
    whole = by_key(M.train_user_models(votes, emb, weights))
    split = by_key(M.train_user_models(votes, emb, weights, max_bytes=1 << 19))
    assert split[7, 0][1] and np.allclose(whole[7, 0][0], split[7, 0][0], atol=1e-6)


def test_blocks_hold_every_row_once_and_stay_small(spark):
    rows = spark.range(3000).select((F.col("id") % 2 * F.lit(5)).alias("user_id"), F.col("id").alias("h"), (F.col("id") % 3).alias("y"), F.array(F.col("id") * 1.0, F.lit(1.0)).alias("v"))
    got = blocks.pack(rows, ["user_id"], "y", "v", "h", block_bytes=1600).collect()
    assert len(got) == 2 * 15 and max(len(r.labels) for r in got) < 200
    assert sorted(i for r in got for i in r.idents) == list(range(3000))
    assert all(v == [i, 1.0] and y == i % 3 and r.user_id == i % 2 * 5 for r in got for i, y, v in zip(r.idents, r.labels, r.vectors))


def test_array_sums_shuffle_a_row_for_each_group_and_task(spark):
    rows = spark.range(1000, numPartitions=3).select(F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("g"), F.concat(F.lit("a"), F.col("id") % 2).alias("s"), F.array(F.col("id") * 1.0, F.lit(1.0)).alias("v"), F.array(F.col("id") * 2.0).alias("w"))
    rows = rows.unionByName(spark.createDataFrame([(9, "x", None, [1.0])], "g long, s string, v array<double>, w array<double>"))
    out = sums.array_sums(rows, ["g", "s"], "v", "w")
    got = {(r.g, r.s): (r.n, r.v, r.w) for r in out.collect()}
    want = {}
    for i in range(1000):
        n, v, w = want.get(k := (i % 5 or None, f"a{i % 2}"), (0, [0.0, 0.0], [0.0]))
        want[k] = n + 1, [v[0] + i, v[1] + 1], [w[0] + 2 * i]
    assert got == want
    assert sums.array_sums(rows, [], "w").collect()[0].n == 1001
    assert sums.array_sums(rows.limit(0), ["g"], "v").collect() == []
    dealt = sums.adder(1, 1, sums.to_arrow_schema(out.select("g", "v", "n").schema), sums.HELD_BYTES)
    import pyarrow as pa

    one = pa.RecordBatch.from_arrays([pa.array([1, 2] * 50, pa.int64()), pa.array([[1.0]] * 100, pa.list_(pa.float64())), pa.array([1] * 100, pa.int64())], names=["g", "v", "n"])
    assert [b.num_rows for b in dealt(iter([one] * 20))] == [2]
