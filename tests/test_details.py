import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from votelake.functions import text as T
from votelake.functions import vectors as V
from votelake.operators import history as H
from votelake.operators import prepare as P
from votelake.operators import reports as R
from votelake.operators import scoring as M
from votelake.operators import trends as N
from votelake.operators import weights as W
from votelake.operators.products import Best, against
from votelake.plans.queries import Tables
from votelake.sources import tables as D

SMALL = "/root/testdata/sf0.01"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_votes_from_a_database_are_read_in_ranges_with_the_conditions_pushed_down(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/votes;create=true"
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = [(i, i % 7, i % 3 - 1, None if i % 10 == 0 else f"2024-01-01 00:00:{i % 60:02d}") for i in range(100)]
    votes = spark.createDataFrame(rows, "user_id int, paper_id int, rating int, time string").withColumn("time", F.col("time").cast("timestamp"))
    votes.write.format("jdbc").options(url=url, dbtable="votes", createTableColumnTypes="rating INT", **driver).save()
    quoted = {"table": "(SELECT \"user_id\" AS USER_ID, \"paper_id\" AS PAPER_ID, \"rating\" AS RATING, \"time\" AS TIME FROM votes) v", **driver}
    table = quoted.pop("table")
    got = D.read_raw_votes(spark, url, table, "USER_ID", 4, **quoted)
    assert sorted(r.user_id for r in got.collect()) == [i for i, _, rating, time in rows if rating in (-1, 1) and time]
    assert got.rdd.getNumPartitions() == 4 and max(map(len, got.rdd.glom().collect())) < 25
    plan = plan_of(got)
    assert "PushedFilters" in plan and "RATING" in plan and "IsNotNull(TIME)" in plan.replace("*", "")
    neutral = D.read_raw_votes(spark, url, table, "USER_ID", 3, bounds=(10, 20), neutral=True, **quoted)
    assert sorted(r.user_id for r in neutral.collect()) == [i for i, _, rating, time in rows if rating == 0 and time]


def test_word_vectors_from_lines(spark, tmp_path):
    (tmp_path / "v.txt").write_text("the 1 2 3\nfox -0.5 0 1e-1\n")
    got = {r.word: r.vec for r in D.load_word_vectors(spark, str(tmp_path / "v.txt"), 2).collect()}
    assert got == {"the": [1.0, 2.0], "fox": [-0.5, 0.0]}


def test_users_in_two_selections(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, "c")], "user_id long, selection string")
    assert tuple(D.check_selections(rows).first()) == (3, 1)
    votes = spark.createDataFrame([(u, u * 10) for u in (1, 1, 2, 3, 4)], "user_id long, paper_id long")
    assert sorted(r.user_id for r in P.select_users(votes, rows, ["a", "c"], ["b"]).collect()) == [2, 3]
    assert sorted(r.user_id for r in P.select_users(votes, rows, [], ["b"]).collect()) == [2, 3, 4]


def test_quantiles_are_exact_in_small_groups_and_near_in_large_ones(spark):
    rows = spark.range(50_000).select((F.col("id") % 50 == 0).alias("g"), F.pmod(F.xxhash64("id"), F.lit(100_003)).alias("v"))
    at = {"median": 0.5, "low": 0.25}
    exact = {r.g: r for r in R.quantiles(rows, ["g"], "v", at).collect()}
    found = R.quantiles(rows, ["g"], "v", at, exact_up_to=2000, accuracy=200)
    assert "percentile_approx" in plan_of(found)
    near = {r.g: r for r in found.collect()}
    values = np.array([r.v for r in rows.filter("NOT g").collect()])
    assert near[True] == exact[True]
    for name, share in at.items():
        assert np.isclose(exact[False][name], np.quantile(values, share))
        assert abs((values <= near[False][name]).mean() - share) <= 1 / 200 + 1 / len(values)
    assert R.quantiles(rows, [], "v", at).count() == 1


def test_all_is_counted_once(spark):
    results = spark.createDataFrame([(u, "ndcg", float(u)) for u in range(6)], "user_id long, score string, value double")
    groups = spark.createDataFrame([(u, "main" if u < 2 else "other") for u in range(6)], "user_id long, group string")
    assert {r.group: (r.n, r.value) for r in R.validation_summary(results, groups).collect()} == {"main": (2, 0.5), "other": (4, 3.5), "all": (6, 2.5)}


def test_best_products_in_parts_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    cand = [(int(rng.integers(0, 3)), i, rng.normal(size=3).tolist()) for i in range(90)] + [(8, 500, [1.0, 0.0, 0.0])]
    known = [(int(rng.integers(0, 3)), i, int(rng.integers(0, 2)), rng.normal(size=3).tolist()) for i in range(70)]
    c = spark.createDataFrame(cand, "user_id long, _id long, _v array<double>").withColumn("_row", F.struct("user_id", "_id"))
    k = spark.createDataFrame(known, "user_id long, _id long, _label int, _v array<double>").repartition(5)
    monkeypatch.setattr("votelake.operators.products.CHUNK", 4)
    got = {r._row._id: r.found for r in against(c, k, ["user_id"], lambda: Best(3), "array<array<double>>", part=7).collect()}
    assert len(got) == 91 and got[500] == [[], []]
    for user, i, v in cand[:-1]:
        for label in (0, 1):
            want = sorted((float(np.dot(v, x)) for u, _, r, x in known if u == user and r == label), reverse=True)[:3]
            assert np.allclose(got[i][label], want)


def test_scores_by_likes_make_no_row_for_a_pair(spark):
    emb = spark.range(50).select(F.col("id").alias("paper_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    likes = spark.range(40).select(F.lit(1).cast("long").alias("user_id"), F.col("id").alias("paper_id"))
    pairs = spark.range(50).select((F.col("id") % 2 + 1).alias("user_id"), F.col("id").alias("paper_id"), F.col("id").alias("t"))
    got = {r.paper_id: r.logit for r in W.max_pooling_scores(pairs, likes, emb).collect()}
    assert len(got) == 50
    for p in range(50):
        want = max(np.cos(p - q) for q in range(40)) if p % 2 == 0 else 0.0
        assert np.isclose(got[p], want)


def brute_starts(sessions, min_pos, max_sessions, max_days):
    out = {}
    for v, (t0, _, _, val) in sessions.items():
        earlier = [h for h in sessions if h < v]
        if not val or not earlier:
            continue
        recent = [h for h in earlier if h >= v - max_sessions and sessions[h][1] >= t0 - max_days * P.DAY]
        ups = lambda h: sum(sessions[x][2] for x in earlier if x >= h)
        enough = [h for h in earlier if ups(h) >= min_pos]
        out[v] = min(min(recent, default=v), max(enough, default=0))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_history_starts_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    rows, day = [], 0
    for s in range(30):
        day += int(rng.integers(1, 30))
        rows += [(1, 100 * s + i, int(rng.random() < 0.3), day * P.DAY + i, s, "val" if s > 8 else "train") for i in range(int(rng.integers(1, 5)))]
    votes = spark.createDataFrame(rows, "user_id long, paper_id long, rating int, t long, session_id long, split string")
    sessions = {}
    for _, _, rating, t, s, split in rows:
        a, b, up, _ = sessions.get(s, (t, t, 0, split == "val"))
        sessions[s] = min(a, t), max(b, t), up + (rating == 1), split == "val"
    got = H.history_for_session(votes, 4, 500, 3, 40)
    first = {r.val_session: r.s for r in got.groupBy("val_session").agg(F.min("session_id").alias("s")).collect()}
    assert first == brute_starts(sessions, 4, 3, 40)
    assert plan_of(got).count("CartesianProduct") == 0


def test_slopes(spark):
    rows = spark.createDataFrame([(1, s, 2.0 * s + 1) for s in range(5)] + [(2, 3, 1.0), (3, 1, None), (4, 0, 1.0), (4, 2, 0.0)], "user_id long, session_id long, value double")
    assert {r.user_id: (r.slope, r.n) for r in N.metric_slopes(rows, "session_id", "value").collect()} == {1: (2.0, 5), 2: (None, 1), 4: (-0.5, 2)}


def test_values_of_hyperparameters():
    assert M.hyperparameter_values("linspace(0, 1, 3)") == [0.0, 0.5, 1.0] and M.hyperparameter_values("np.logspace(-1, 1, 3)") == [0.1, 1.0, 10.0]
    assert M.hyperparameter_values([1, 2]) == [1, 2] and M.hyperparameter_values("l2") == ["l2"] and M.hyperparameter_values(3) == [3]
    assert M.hyperparameter_values("linspace(0, 1, 3); x") == ["linspace(0, 1, 3); x"]
    with pytest.raises(ValueError):
        M.hyperparameter_values(None)


def test_category_vectors_with_new_names(spark):
    words = spark.createDataFrame([("a", "w", 2.0), ("a", "x", 1.0), ("b", "x", 1.0)], "category string, word string, weight double")
    vectors = spark.createDataFrame([("w", [0.0, 2.0]), ("x", [3.0, 0.0])], "word string, vec array<double>")
    got = {r.category: r.vec for r in V.category_vectors(words, vectors, "proportional", 6).collect()}
    assert np.allclose(got["a"], [0.15, 0.2]) and np.allclose(got["b"], [0.25, 0.0])
    papers = spark.createDataFrame([(1, "A"), (2, None), (3, "Z")], "paper_id long, l1 string")
    names = spark.createDataFrame([("A", "b")], "original string, category string")
    out = {r.paper_id: r.vec for r in V.paper_category_vectors(papers, names, V.category_vectors(words, vectors), 2).collect()}
    assert out == {1: [3.0, 0.0], 2: [0.0, 0.0], 3: None}


def test_missing_vectors(spark):
    votes = spark.createDataFrame([(1, 1), (2, 1), (1, 2), (3, 9)], "user_id long, paper_id long")
    emb = spark.createDataFrame([(2, [1.0]), (2, [1.0])], "paper_id long, embedding array<double>")
    assert tuple(H.missing_vectors(votes, emb).first()) == (4, 3, 3, 2)
    assert tuple(H.missing_vectors(votes.limit(0), emb).first()) == (0, 0, 0, 0)


def test_counting_terms_shuffles_nothing(spark):
    docs = spark.createDataFrame([(1, "red fox, red fox"), (2, None)], "paper_id long, abstract string")
    counted = T.count_terms(docs, "abstract", [])
    assert "Exchange" not in plan_of(counted)
    assert {r.paper_id: dict(zip(r.terms, r.tfs)) for r in counted.collect()} == {1: {"red": 2, "fox": 2, "red fox": 2, "fox red": 1}, 2: {}}


def peak_mb(run) -> float:
    """Of Python, numpy and Arrow while run goes."""
    held = pa.default_memory_pool()
    pa.set_memory_pool(pool := pa.proxy_memory_pool(held))
    tracemalloc.start()
    try:
        run()
        return (tracemalloc.get_traced_memory()[1] + pool.max_memory()) / 1e6
    finally:
        tracemalloc.stop()
        pa.set_memory_pool(held)


def test_counting_terms_holds_a_piece_of_a_batch():
    """400,000 words in one batch, all pairs different: all counts at once took 79 MB."""
    words = [[f"w{(i * 7 + j * j) % 5000}" for j in range(1000)] for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(words, pa.list_(pa.string()))], names=["paper_id", "words"])
    sizes = []
    assert peak_mb(lambda: sizes.extend(len(out.column(1).flatten()) for out in T.count_grams(iter([batch])))) < 40
    assert max(sizes) <= 2 * 65536
    got = {i: dict(zip(terms, tfs)) for out in T.count_grams(iter([batch])) for i, terms, tfs in zip(*(c.to_pylist() for c in out.columns))}
    assert got == {i: dict(Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])) for i, w in enumerate(words)}


def test_weighing_terms_holds_a_piece_of_a_batch(spark, monkeypatch):
    """600,000 terms in one batch: all rows at once took 59 MB."""
    rows = [(i, [f"w{(i + j) % 900}" for j in range(300)], [1 + (i + j) % 3 for j in range(300)]) for i in range(2000)]
    counted = spark.createDataFrame(rows[:1], "paper_id long, terms array<string>, tfs array<bigint>")
    idf = {f"w{j}": 1 + j / 100 for j in range(0, 900, 2)}
    vocabulary = spark.createDataFrame(list(idf.items()), "term string, idf double")
    monkeypatch.setattr(type(counted), "mapInArrow", lambda self, f, schema: f)
    weigh = T.transform_tfidf(counted, vocabulary)
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())))], names=["paper_id", "terms", "tfs"])
    sizes = []
    assert peak_mb(lambda: sizes.extend(out.num_rows for out in weigh(iter([batch])))) < 40
    assert sum(sizes) == 300_000 and max(sizes) <= 65536
    got = [r for out in weigh(iter([batch])) for r in zip(*(c.to_pylist() for c in out.columns))]
    want = []
    for i, terms, tfs in rows:
        own = [(i, term, (1 + np.log(tf)) * idf[term]) for term, tf in zip(terms, tfs) if term in idf]
        want += [(i, term, w / np.sqrt(sum(x * x for _, _, x in own))) for _, term, w in own]
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([r[2] for r in got], [r[2] for r in want], rtol=1e-12)
    empty = T.transform_tfidf(counted, vocabulary.limit(0))
    assert sum(out.num_rows for out in empty(iter([batch]))) == 0


def test_texts_are_not_scored_word_by_word(spark, monkeypatch):
    words = [[f"w{(i * 7 + j * j) % 5000}" for j in range(1000)] for i in range(100)] + [None]
    batch, scores = pa.array(words, pa.list_(pa.string())), {"w1": 1.0, "w1 w4": 4.0}
    want = [T.score_words(w or [], scores, 2) for w in words]
    runs, calls = [], []
    for kind, given in (("pandas_udf", batch.to_pandas), ("arrow_udf", lambda: batch)):  # the function, without Spark
        monkeypatch.setattr(T.F, kind, lambda schema, given=given: lambda run: lambda column: runs.append((run, given)))
    one = T.score_words
    monkeypatch.setattr(T, "score_words", lambda *given: calls.append(given) or one(*given))
    T.score_text(F.lit(None), scores)
    (run, given) = runs[0]
    got = run(given())
    assert not calls
    assert [(r["total"], r["matches"]) for r in got.to_pylist()] == want


def test_scores_of_pieces_are_those_of_each_list():
    rng = np.random.default_rng(5)
    for trial in range(300):
        letters = ["a", "b", "c", "d"] + (["a b"] if trial % 10 == 0 else []) + ([""] if trial % 7 == 0 else [])
        scores = {" ".join(rng.choice(letters, rng.integers(1, 5))): float(rng.normal()) for _ in range(rng.integers(0, 12))}
        lists = [None if rng.random() < 0.1 else list(rng.choice([*letters, "e"], rng.integers(0, 12))) for _ in range(20)]
        total, matches = T.Phrases(scores).score(pa.array(lists, pa.list_(pa.string())))
        longest = max((len(t.split(" ")) for t in scores), default=0)
        assert list(zip(total.tolist(), matches.tolist())) == [T.score_words(x or [], scores, longest) for x in lists]


def test_comparisons_read_results_that_are_made_once(spark):
    """Both runs, the best and the worst users come from one written table."""
    known = entry.queries()
    for name in ("t6_compare_runs", "t6_compare_runs_less_is_better", "t8_differences_to_baseline"):
        assert "MapInArrow" not in plan_of(known[name](spark, SMALL)), name


def test_ranks_from_one_product_for_each_paper(spark):
    t = Tables(spark, SMALL)
    ups = t.pred.filter("label = 1").drop("label")
    want = M.rank_positives(ups, t.negs, ["user_id", "paper_id", "t"])
    got = t.ranked.select(want.columns)
    assert want.count() > 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
