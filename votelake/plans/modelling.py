"""Queries over histories, weights, samples, sessions' scores and embedding tables; they join the library's others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import clusters as C
from ..operators import history as H
from ..operators import prepare as P
from ..operators import reports as R
from ..operators import sampling as S
from ..operators import scoring as M
from ..operators import splits as X
from ..operators import weights as W
from ..sources import tables as D
from .queries import QUERIES, SEED, SQL, STOP, TFIDF, Tables, flagship, query, rounded

__all__ = ["QUERIES", "SQL", "flagship"]

HIST = """, ss AS (SELECT *, coalesce(sum(up) OVER (PARTITION BY user_id ORDER BY session_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM (SELECT user_id, session_id, min(t) AS t0, max(t) AS t1, count(*) FILTER (rating = 1) AS up, bool_or(split = 'val') AS val FROM split GROUP BY ALL)),
st AS (SELECT v.user_id, v.session_id AS val_session, v.t0 AS val_t, least(coalesce(min(h.session_id) FILTER (h.session_id >= v.session_id - 4 AND h.t1 >= v.t0 - 10 * 86400000000), v.session_id), coalesce(max(h.session_id) FILTER (v.bef - h.bef >= 5), 0)) AS start FROM ss v JOIN ss h ON v.user_id = h.user_id AND h.session_id < v.session_id WHERE v.val GROUP BY v.user_id, v.session_id, v.t0),
hist AS (SELECT * FROM (SELECT s.user_id, val_session, val_t, paper_id, rating, t, session_id, row_number() OVER (PARTITION BY s.user_id, val_session ORDER BY t DESC, paper_id DESC) AS place FROM split s JOIN st ON s.user_id = st.user_id AND s.session_id >= start AND s.session_id < val_session) WHERE place <= 40)"""
LIKES = ", lk AS (SELECT user_id, paper_id, t, session_id, split, u, row_number() OVER (PARTITION BY user_id ORDER BY t, paper_id) AS i FROM split JOIN unitv USING (paper_id) WHERE rating = 1)"
SESS_METRIC = ", sm AS (SELECT user_id, session_id, round(avg(1 / rank), 9) AS mrr FROM ranked WHERE split = 'val' GROUP BY ALL)"


def hist(t: Tables):
    return H.history_for_session(t.split, 5, 40, 4, 10)


def session_metric(t: Tables):
    m = M.ranking_metrics(t.ranked.filter("split = 'val'"), ["user_id", "session_id"])
    return m.select("user_id", "session_id", F.round("mrr", 9).alias("mrr"))


def transformed(t: Tables):
    counts = P.user_info(t.split.filter("split = 'train'")).select("user_id", F.col("n_posrated").alias("n_pos"), F.col("n_negrated").alias("n_neg"), F.lit(50).alias("n_cache"))
    return reduce(lambda a, b: a.unionByName(b), [W.class_weights(counts, f"{style}_{kind}", 0.7).select("user_id", F.lit(f"{style}_{kind}").alias("scheme"), "w_pos", "w_neg", "w_cache") for style in ("both", "rated") for kind in W.TRANSFORMED])


def appended(t: Tables):
    return X.append_removed(t.split.select("user_id", "paper_id", "rating", "t", "split"), P.split_head_tail(t.rat).filter("part = 'tail'"))


def user_counts(t: Tables):
    other = P.users_not_in_category(t.signif, "C0").withColumn("is_other", F.lit(True))
    c = t.split.groupBy("user_id").agg(F.countDistinct(F.when((F.col("split") == "val") & (F.col("rating") == 1), F.col("session_id"))).alias("n_val_sessions"), F.count("*").alias("n_votes"))
    return c.join(other, "user_id", "left").withColumn("is_other", F.coalesce("is_other", F.lit(False)))


USERS = ", uc AS (SELECT user_id, count(DISTINCT session_id) FILTER (split = 'val' AND rating = 1) AS n_val_sessions, count(*) AS n_votes, user_id IN (SELECT user_id FROM signif WHERE rank = 1 AND category <> 'C0') AS is_other FROM split GROUP BY 1)"

query("f8_select_users", "SELECT user_id, paper_id, t FROM sess WHERE user_id NOT IN (SELECT user_id FROM signif WHERE rank = 1 AND category <> 'C0')")(lambda t: t.sess.join(P.users_not_in_category(t.signif, "C0"), "user_id", "left_anti").select("user_id", "paper_id", "t"))
query("j6_ranking_pool", ", a AS (SELECT user_id, paper_id, rating, t, split FROM split UNION ALL SELECT user_id, paper_id, rating, t, 'removed' FROM rat WHERE n_negrated_still_to_come < 4 AND user_id IN (SELECT user_id FROM best)) SELECT user_id, paper_id, t, split FROM a WHERE rating = 0 AND split <> 'removed' UNION ALL SELECT user_id, paper_id, t, 'val' FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, paper_id) AS i FROM a WHERE rating = 0 AND split = 'removed') WHERE i <= 4")(lambda t: S.ranking_negatives_pool(appended(t)).select("user_id", "paper_id", "t", "split"))
query("w7_history", HIST + " SELECT user_id, val_session, paper_id, rating, t, session_id FROM hist")(lambda t: hist(t).drop("val_t"))
query("m3_decay_weights", HIST + ", w AS (SELECT *, exp(-0.1 * ((val_t - t) // 86400000000)) AS w FROM hist) SELECT user_id, val_session, paper_id, t, round(w * count(*) OVER x / sum(w) OVER x, 6) AS weight FROM w WINDOW x AS (PARTITION BY user_id, val_session)")(lambda t: rounded(H.decay_weights(hist(t), 0.1).select("user_id", "val_session", "paper_id", "t", "weight")))
query("m7_session_models")(lambda t: H.train_session_models(H.decay_weights(hist(t), 0.01), t.emb))
query("m16_model_drift", ", sp0 AS (SELECT user_id, session_id, pos, avg(x) AS m FROM (SELECT user_id, session_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM split JOIN emb USING (paper_id) WHERE rating = 1) GROUP BY ALL), sp AS (SELECT user_id, session_id, list(m ORDER BY pos) AS c FROM sp0 GROUP BY ALL), d AS (SELECT *, lag(c) OVER w AS p, first(c) OVER w AS f FROM sp WINDOW w AS (PARTITION BY user_id ORDER BY session_id)) SELECT user_id, session_id, round(sqrt(list_dot_product(c, c)), 6) AS length, round(list_max(list_transform(c, lambda x: abs(x))), 6) AS largest, round(list_distance(c, p), 6) AS dist_prev, round(list_dot_product(c, p) / sqrt(list_dot_product(c, c)) / sqrt(list_dot_product(p, p)), 6) AS cos_prev, round(list_distance(c, f), 6) AS dist_first, round(list_dot_product(c, f) / sqrt(list_dot_product(c, c)) / sqrt(list_dot_product(f, f)), 6) AS cos_first FROM d")(lambda t: rounded(H.model_drift(M.mean_positive_embedding(t.split, t.emb, ["user_id", "session_id"]).withColumnRenamed("profile", "coef"))))
query("e14_interest_drift", LIKES + ", tr AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, paper_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, paper_id DESC) AS b FROM lk WHERE split = 'train'), va AS (SELECT * FROM lk WHERE split = 'val') SELECT * FROM (SELECT user_id, round(avg(list_dot_product(tr.u, va.u)) FILTER (a <= 10), 6) AS first_to_val, round(avg(list_dot_product(tr.u, va.u)) FILTER (b <= 10), 6) AS last_to_val FROM tr JOIN va USING (user_id) GROUP BY 1) JOIN (SELECT x.user_id, round(avg(list_dot_product(x.u, y.u)), 6) AS within_val FROM va x JOIN va y ON x.user_id = y.user_id AND x.i < y.i GROUP BY 1) USING (user_id)")(lambda t: rounded(H.interest_drift(t.split, t.emb)))
query("e15_history_cohesion", LIKES + ", pr AS (SELECT a.user_id, greatest(a.session_id, b.session_id) AS s, sum(list_dot_product(a.u, b.u)) AS d, count(*) AS n FROM lk a JOIN lk b ON a.user_id = b.user_id AND a.i < b.i GROUP BY ALL), c AS (SELECT v.user_id, v.session_id, sum(d) / sum(n) AS c FROM (SELECT DISTINCT user_id, session_id FROM lk WHERE split = 'val') v JOIN pr ON pr.user_id = v.user_id AND pr.s <= v.session_id GROUP BY ALL) SELECT user_id, round(avg(c), 6) AS cohesion, count(c) AS n_sessions FROM c GROUP BY 1")(lambda t: rounded(H.history_cohesion(t.split, t.emb)))
query("k9_user_geometry", LIKES + ", va AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY session_id) - 1 AS k FROM lk WHERE split = 'val'), vn AS (SELECT *, max(k) OVER (PARTITION BY user_id) + 1 AS n FROM va), tr AS (SELECT * FROM lk WHERE split = 'train') SELECT * FROM (SELECT a.user_id, round(avg(list_dot_product(a.u, b.u)), 6) AS train_cohesion FROM tr a JOIN tr b ON a.user_id = b.user_id AND a.i < b.i GROUP BY 1) JOIN (SELECT user_id, round(avg(list_dot_product(tr.u, vn.u)) FILTER (k = 0), 6) AS train_to_first, round(avg(list_dot_product(tr.u, vn.u)) FILTER (k = n // 2), 6) AS train_to_middle, round(avg(list_dot_product(tr.u, vn.u)) FILTER (k = n - 1), 6) AS train_to_last FROM tr JOIN vn USING (user_id) GROUP BY 1) USING (user_id)")(lambda t: rounded(H.user_geometry(t.split, t.emb)))
query("e13_similarity_to_likes", LIKES + " SELECT s.user_id, s.paper_id, s.t, round(avg(list_dot_product(x.u, lk.u)), 6) AS similarity FROM split s JOIN unitv x USING (paper_id) JOIN lk ON lk.user_id = s.user_id WHERE s.rating = 0 GROUP BY ALL")(lambda t: rounded(W.similarity_to_likes(t.split, t.emb)))
query("m4_similarity_weights", LIKES + ", si AS (SELECT s.user_id, s.paper_id, s.t, avg(list_dot_product(x.u, lk.u)) AS s FROM split s JOIN unitv x USING (paper_id) JOIN lk ON lk.user_id = s.user_id WHERE s.rating = 0 AND s.split = 'train' AND lk.split = 'train' GROUP BY ALL) SELECT user_id, paper_id, t, round(exp(s / 0.5) * count(*) OVER w / sum(exp(s / 0.5)) OVER w, 6) AS softmax, round((s + 1) * count(*) OVER w / sum(s + 1) OVER w, 6) AS linear FROM si WINDOW w AS (PARTITION BY user_id)")(lambda t: (lambda s: rounded(W.similarity_weights(W.similarity_weights(s, "softmax", 0.5).withColumnRenamed("weight", "softmax"), "linear").select("user_id", "paper_id", "t", "softmax", F.col("weight").alias("linear"))))(W.similarity_to_likes(t.split.filter("split = 'train'"), t.emb)))
query("m1_transformed_weights", ", c AS (SELECT user_id, count(*) FILTER (rating = 1) AS p, count(*) FILTER (rating = 0) AS n, 50 AS c FROM split WHERE split = 'train' GROUP BY 1), k AS (SELECT *, unnest(['constant', 'cube_root', 'logarithm', 'square_root', 'linear', 'square', 'exponential']) AS kind FROM c), f AS (SELECT *, CASE kind WHEN 'constant' THEN 1 WHEN 'cube_root' THEN cbrt(n) WHEN 'logarithm' THEN ln(n + 1) WHEN 'square_root' THEN sqrt(n) WHEN 'linear' THEN n WHEN 'square' THEN n * n ELSE exp(n) END AS fn, CASE kind WHEN 'constant' THEN 1 WHEN 'cube_root' THEN cbrt(c) WHEN 'logarithm' THEN ln(c + 1) WHEN 'square_root' THEN sqrt(c) WHEN 'linear' THEN c WHEN 'square' THEN c * c ELSE exp(c) END AS fc FROM k), w AS (SELECT user_id, 'both_' || kind AS scheme, p, n, c, 0.7::DOUBLE * fn AS a, 0.3::DOUBLE * fc AS b FROM f UNION ALL SELECT user_id, 'rated_' || kind, p, n, c, 0.7::DOUBLE * CASE WHEN kind = 'constant' THEN 0.5 ELSE fn END, 0.3::DOUBLE * c FROM f) SELECT user_id, scheme, round((p + n + c) / p, 6) AS w_pos, round(CASE WHEN n > 0 THEN a / ((a + b) * n) * (p + n + c) ELSE 0 END, 6) AS w_neg, round(b / ((a + b) * c) * (p + n + c), 6) AS w_cache FROM w")(lambda t: rounded(transformed(t)))
query("m1_class_weights", ", c AS (SELECT user_id, count(*) FILTER (rating = 1) AS p, count(*) FILTER (rating = 0) AS n, 50 AS c FROM split WHERE split = 'train' GROUP BY 1) SELECT user_id, round((p + n + c) / p, 6) AS w_pos, round(0.7::DOUBLE * (p + n + c) / (0.7::DOUBLE * n + 0.3::DOUBLE * c) * 2, 6) AS w_neg, round(0.3::DOUBLE * (p + n + c) / (0.7::DOUBLE * n + 0.3::DOUBLE * c) * 2, 6) AS w_cache FROM c")(lambda t: rounded(W.class_weights(P.user_info(t.split.filter("split = 'train'")).select("user_id", F.col("n_posrated").alias("n_pos"), F.col("n_negrated").alias("n_neg"), F.lit(50).alias("n_cache")), "cache_v", 0.7, 2.0).select("user_id", "w_pos", "w_neg", "w_cache")))
query("m9_max_pooling", "SELECT s.user_id, s.paper_id, s.t, round(max(list_dot_product(x.v, y.v)), 6) AS logit FROM split s JOIN emb x USING (paper_id) JOIN split l ON l.user_id = s.user_id AND l.split = 'train' AND l.rating = 1 JOIN emb y ON y.paper_id = l.paper_id WHERE s.split = 'val' GROUP BY ALL")(lambda t: rounded(W.max_pooling_scores(t.split.filter("split = 'val'").select("user_id", "paper_id", "t"), t.split.filter("split = 'train' AND rating = 1"), t.emb)))
query("m10_knn_score", ", kn AS (SELECT DISTINCT user_id, paper_id, rating FROM split WHERE split = 'train'), si AS (SELECT s.user_id, s.paper_id, s.t, kn.rating, list_dot_product(x.u, y.u) AS d, row_number() OVER (PARTITION BY s.user_id, s.paper_id, s.t, kn.rating ORDER BY list_dot_product(x.u, y.u) DESC) AS i FROM split s JOIN unitv x USING (paper_id) JOIN kn ON kn.user_id = s.user_id JOIN unitv y ON y.paper_id = kn.paper_id WHERE s.split = 'val'), m AS (SELECT user_id, paper_id, t, rating, sum(exp(d) * d) / sum(exp(d)) AS m FROM si WHERE i <= 3 GROUP BY ALL) SELECT user_id, paper_id, t, round(0.5::DOUBLE * sum(CASE rating WHEN 1 THEN m ELSE -m END), 6) AS knn FROM m GROUP BY ALL")(lambda t: rounded(W.knn_score(t.split.filter("split = 'val'").select("user_id", "paper_id", "t"), t.split.filter("split = 'train'"), t.emb, 3, 0.5)))
query("w9_session_positions", SESS_METRIC + ", x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY session_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM sm) SELECT user_id, round(max(mrr) FILTER (i = 0), 6) AS first, round(max(mrr) FILTER (i = n // 2), 6) AS middle, round(max(mrr) FILTER (i = n - 1), 6) AS last, round(avg(mrr), 6) AS mean, round(median(mrr), 6) AS median, round(stddev_samp(mrr), 6) AS std FROM x GROUP BY 1")(lambda t: rounded(R.session_position_scores(session_metric(t), "mrr")))
query("a15_metrics_by_bins", SESS_METRIC + " SELECT bin, round(avg(v), 6) AS mean, count(*) AS n_users FROM (SELECT least(session_id // 3, 10) AS bin, user_id, avg(mrr) AS v FROM sm GROUP BY ALL) GROUP BY 1")(lambda t: rounded(R.metrics_by_bins(session_metric(t), "session_id", 3, 10, "mrr")))
query("a16_best_k", "SELECT k AS best_k, count(*) AS n_users, round(avg(value), 6) AS value FROM (SELECT user_id, combination_idx AS k, round(value, 9) AS value, row_number() OVER (PARTITION BY user_id ORDER BY round(value, 9) DESC, combination_idx) AS i FROM res WHERE score = 'ndcg') WHERE i = 1 GROUP BY 1")(lambda t: rounded(R.best_k_summary(t.res.select("user_id", F.col("combination_idx").alias("k"), "score", F.round("value", 9).alias("value")), "ndcg")))
query("a17_mode_match", ", c AS (SELECT *, row_number() OVER (PARTITION BY user_id, rating ORDER BY n DESC, l1) AS i FROM (SELECT user_id, rating, l1, count(*) AS n FROM sess JOIN papers USING (paper_id) GROUP BY ALL)), m AS (SELECT user_id, max(l1) FILTER (rating = 1) AS a, max(l1) FILTER (rating = 0) AS b FROM c WHERE i = 1 GROUP BY 1) SELECT user_id, coalesce((a = b)::INT, 0) AS matches FROM m")(lambda t: R.category_mode_match(P.attach_categories(t.sess, t.papers)))
query("a19_curve", "SELECT combination_idx AS curve, 0.1::DOUBLE AS c, score, round(avg(value), 6) AS value, round(stddev_samp(value), 6) AS std FROM res GROUP BY ALL")(lambda t: rounded(R.hyperparameter_curve(R.average_over_users(t.res), t.spark.createDataFrame([(0, 0.1, 1.0), (1, 0.1, 2.0)], "combination_idx int, c double, neg_weight double"), "c")))
query("t2_user_groups", USERS + ", n AS (SELECT CASE WHEN count(*) >= 500 THEN 75 ELSE greatest(1, floor(count(*) * 0.16667)::INT) END AS n FROM uc), r AS (SELECT user_id, is_other, n, row_number() OVER (ORDER BY n_votes DESC, user_id) AS a, row_number() OVER (ORDER BY n_votes, user_id) AS b, row_number() OVER (ORDER BY n_val_sessions DESC, user_id) AS c, row_number() OVER (ORDER BY n_val_sessions, user_id) AS d FROM uc, n) SELECT 'other' AS \"group\", user_id FROM r WHERE is_other UNION ALL SELECT 'n_votes_high', user_id FROM r WHERE a <= n UNION ALL SELECT 'n_votes_low', user_id FROM r WHERE b <= n UNION ALL SELECT 'n_val_sessions_high', user_id FROM r WHERE c <= n UNION ALL SELECT 'n_val_sessions_low', user_id FROM r WHERE d <= n")(lambda t: R.user_groups(user_counts(t), "n_votes", ["n_val_sessions"]))
query("t7_extreme_predictions", ", o AS (SELECT user_id, paper_id, t, round(1 / (1 + exp(-logit)), 9) AS proba, CASE WHEN logit >= 0 AND label = 1 THEN 'TP' WHEN logit >= 0 THEN 'FP' WHEN label = 1 THEN 'FN' ELSE 'TN' END AS outcome FROM pred), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, outcome ORDER BY proba DESC, paper_id, t) AS a, row_number() OVER (PARTITION BY user_id, outcome ORDER BY proba, paper_id, t) AS b FROM o), s AS (SELECT *, 'high' AS side, a AS place FROM r WHERE a <= 3 UNION ALL SELECT *, 'low', b FROM r WHERE b <= 3) SELECT user_id, outcome, side, place, paper_id, string_split(text, chr(10))[1] AS title, round(proba, 6) AS proba FROM s LEFT JOIN documents ON doc_id = paper_id")(lambda t: rounded(R.extreme_predictions(t.pred.withColumn("proba", F.round(V.sigmoid("logit"), 9)).withColumn("outcome", F.when(F.col("logit") >= 0, F.when(F.col("label") == 1, "TP").otherwise("FP")).otherwise(F.when(F.col("label") == 1, "FN").otherwise("TN"))), D.texts_of(t.spark, t.dir), 3)))
query("t8_worst_users", "SELECT combination_idx, round(avg(value) FILTER (i <= 1), 6) AS worst_1, round(avg(value) FILTER (i <= 3), 6) AS worst_3, round(avg(value) FILTER (i <= 10), 6) AS worst_10 FROM (SELECT combination_idx, round(value, 9) AS value, row_number() OVER (PARTITION BY combination_idx ORDER BY round(value, 9), user_id) AS i FROM res WHERE score = 'ndcg') GROUP BY 1")(lambda t: rounded(R.worst_users(t.res.withColumn("value", F.round("value", 9)), "ndcg", [1, 3, 10])))
query("k10_session_metrics_attached", SESS_METRIC + " SELECT s.user_id, s.session_id, s.n_rated, round(mrr * 0.75, 6) AS mrr FROM sessions s LEFT JOIN sm USING (user_id, session_id)")(lambda t: rounded(R.attach_metrics_to_sessions(P.session_table(t.rat).select("user_id", "session_id", "n_rated"), [session_metric(t), session_metric(t).withColumn("mrr", F.col("mrr") / 2)], "mrr")))
query("k12_validation_summary", ", g AS (SELECT user_id, CASE WHEN category = 'C0' THEN 'main' ELSE 'other' END AS g FROM signif WHERE rank = 1 UNION ALL SELECT DISTINCT user_id, 'all' FROM res) SELECT g AS \"group\", score, round(avg(value), 6) AS value, count(*) AS n FROM res JOIN g USING (user_id) WHERE combination_idx = 1 GROUP BY ALL")(lambda t: rounded(R.validation_summary(t.res.filter("combination_idx = 1"), t.signif.filter("rank = 1").select("user_id", F.when(F.col("category") == "C0", "main").otherwise("other").alias("group")))))
query("x2_stratified_users", USERS + ", d AS (SELECT *, md5('42|eval|' || user_id) AS k FROM uc), p1 AS (SELECT user_id, row_number() OVER (ORDER BY k, user_id) AS i FROM d WHERE is_other QUALIFY i <= 8), p2 AS (SELECT user_id, row_number() OVER (ORDER BY n_val_sessions DESC, user_id) AS i FROM d WHERE user_id NOT IN (SELECT user_id FROM p1) QUALIFY i <= 6), p3 AS (SELECT user_id, row_number() OVER (ORDER BY n_val_sessions, user_id) AS i FROM d WHERE user_id NOT IN (SELECT user_id FROM p1 UNION SELECT user_id FROM p2) QUALIFY i <= 6), p4 AS (SELECT user_id, row_number() OVER (ORDER BY k, user_id) AS i FROM d WHERE user_id NOT IN (SELECT user_id FROM p1 UNION SELECT user_id FROM p2 UNION SELECT user_id FROM p3) QUALIFY i <= 10), p AS (FROM p1 UNION ALL FROM p2 UNION ALL FROM p3 UNION ALL FROM p4) SELECT user_id, CASE WHEN i IS NULL THEN 'other' WHEN i % 2 = 1 THEN 'val' ELSE 'test' END AS selection FROM d LEFT JOIN p USING (user_id)")(lambda t: S.stratified_eval_users(user_counts(t), 4, 3, 5, SEED))
query("x8_user_cache_extras", ", cc AS (SELECT paper_id FROM papers WHERE in_cache ORDER BY md5('42|cache|' || paper_id), paper_id LIMIT 50) SELECT user_id, paper_id FROM (SELECT u.user_id, cc.paper_id FROM (SELECT DISTINCT user_id FROM sess) u CROSS JOIN cc UNION SELECT user_id, paper_id FROM signif JOIN pool USING (category)) WHERE (user_id, paper_id) NOT IN (SELECT user_id, paper_id FROM sess)")(lambda t: S.user_cache(t.sess, S.cache_papers(t.papers, 50, SEED), t.sess, t.signif.join(t.pool.drop("rank"), "category")))
query("x11_capped_negatives", "SELECT paper_id, category, rank::INT AS rank FROM (SELECT paper_id, l1 AS category, row_number() OVER (PARTITION BY l1 ORDER BY md5('42|paper|' || paper_id), paper_id) AS rank FROM papers WHERE l1 IS NOT NULL AND paper_id NOT IN (SELECT paper_id FROM split JOIN (SELECT user_id, row_number() OVER (ORDER BY md5('42|users|' || user_id), user_id) AS i FROM best) USING (user_id) WHERE i <= 4)) WHERE rank <= 7")(lambda t: S.capped_category_negatives(t.papers, 7, SEED, t.split.join(X.partition_users(t.split, t.split, 4, SEED).filter("selection = 'test'"), "user_id", "left_semi").select("paper_id").distinct()))
query("x15_training_groups", ", r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, paper_id DESC) AS i FROM sess WHERE rating = 1), o AS (SELECT user_id, paper_id, t FROM r WHERE i <= 6 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY md5('42|up|' || user_id || '|' || paper_id || '|' || t), paper_id, t) = 1), c AS (SELECT o.*, d.paper_id AS neg_paper_id, d.t AS neg_t, row_number() OVER (PARTITION BY o.user_id ORDER BY abs(o.t - d.t), d.t, d.paper_id) AS place FROM o JOIN sess d ON d.user_id = o.user_id AND d.rating = 0) SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5('42|down|' || user_id || '|' || neg_paper_id || '|' || neg_t), neg_paper_id, neg_t) AS slot FROM c WHERE place <= 6) WHERE slot <= 4")(lambda t: S.training_groups(t.sess, 6, SEED))
query("x16_bounded_samples", ", k AS (SELECT *, md5('42|sample|' || user_id || '|' || paper_id || '|' || t) AS k FROM sess), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k, paper_id, t) AS i, row_number() OVER (PARTITION BY user_id, rating ORDER BY k, paper_id, t) AS j FROM k), c AS (SELECT user_id, count(*) FILTER (rating = 1) AS p, count(*) FILTER (rating = 0) AS n, count(*) FILTER (rating = 1 AND i <= 20) AS c FROM r GROUP BY 1), x AS (SELECT user_id, greatest(5, 20 - n, least(p, 12, c)) AS take FROM c WHERE greatest(5, 20 - n) <= least(p, 12)) SELECT user_id, paper_id, rating, t FROM r JOIN x USING (user_id) WHERE j <= CASE rating WHEN 1 THEN take ELSE 20 - take END")(lambda t: S.bounded_user_samples(t.sess, 20, 5, 8, SEED))
query("x17_weighted_draw", ", z AS (SELECT l1 AS category, count(*) AS size FROM papers WHERE l1 IS NOT NULL GROUP BY 1), e AS (SELECT category, size, (sum(ratio) OVER (ORDER BY category) - ratio) / sum(ratio) OVER () AS lo, sum(ratio) OVER (ORDER BY category) / sum(ratio) OVER () AS hi, category = max(category) OVER () AS fin FROM ratios JOIN z USING (category)), d AS (SELECT i AS draw, ('0x' || substr(md5('42|cat|' || i), 1, 8))::BIGINT / 4294967296 AS u, ('0x' || substr(md5('42|within|' || i), 1, 8))::BIGINT / 4294967296 AS x FROM range(500) r(i)), p AS (SELECT paper_id, l1 AS category, row_number() OVER (PARTITION BY l1 ORDER BY substr(md5('42|row|' || paper_id), 1, 2), paper_id) - 1 AS i FROM papers WHERE l1 IS NOT NULL) SELECT draw, e.category, paper_id FROM d JOIN e ON u >= lo AND (u < hi OR fin) JOIN p ON p.category = e.category AND p.i = floor(x * size)")(lambda t: S.category_weighted_draw(t.papers, t.ratios, 500, SEED))
query("x18_training_examples", ", s AS (SELECT user_id, CASE WHEN i <= 10 THEN 'test' WHEN i IS NULL THEN 'train' ELSE 'val' END AS selection FROM (SELECT DISTINCT user_id FROM split) LEFT JOIN (SELECT user_id, row_number() OVER (ORDER BY md5('42|users|' || user_id), user_id) AS i FROM (SELECT user_id FROM split GROUP BY 1 HAVING count(*) FILTER (rating = 1) >= 30 AND count(*) FILTER (rating = 0) >= 20 AND count(DISTINCT session_id) >= 5)) USING (user_id)) SELECT user_id, paper_id, rating, l1, l2, t // 1000000 AS second, row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, t, paper_id) AS place FROM split JOIN s USING (user_id) LEFT JOIN papers USING (paper_id) WHERE selection = 'train' OR (selection = 'val' AND split = 'train')")(lambda t: S.training_examples(t.split, X.partition_users(P.filter_users_min_votes(t.split, 30, 20, 5), t.split, 10, SEED), t.papers))
query("v2_concat", "SELECT paper_id, 2 * len(v) AS width, round(v[1], 6) AS middle FROM emb")(lambda t: t.emb.withColumn("e", V.concat_embeddings("embedding", "embedding")).select("paper_id", F.size("e").alias("width"), F.round(F.element_at("e", F.size("embedding") + 1), 6).alias("middle")))
query("v3_category_vectors", ", s AS (SELECT l1 AS category, pos, sum(x / (1 + paper_id % 3)) AS x FROM (SELECT l1, paper_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM emb JOIN papers USING (paper_id) WHERE l1 IS NOT NULL) GROUP BY ALL) SELECT category, round(sum(x / n), 6) AS total FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY category)) AS n FROM s) GROUP BY 1")(lambda t: V.category_vectors(t.papers.filter("l1 IS NOT NULL").select(F.col("l1").alias("category"), F.col("paper_id").alias("word"), (1 / (1 + F.col("paper_id") % 3)).alias("weight")), t.emb.select(F.col("paper_id").alias("word"), F.col("embedding").alias("vec")), "unit").select("category", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("total")))
query("v6_sinusoidal", ", d AS (SELECT user_id, session_id, (t_min - min(t_min) OVER (PARTITION BY user_id)) // 86400000000 AS d FROM sessions) SELECT user_id, session_id, round(sin(d), 6) AS s0, round(cos(d), 6) AS c0, round(sin(d * 0.01::DOUBLE), 6) AS s1, round(cos(d * 0.01::DOUBLE), 6) AS c1 FROM d")(lambda t: P.session_days_passed(P.session_table(t.rat)).withColumn("e", V.sinusoidal_encoding("days_passed", 4)).select("user_id", "session_id", *[F.round(F.element_at("e", i + 1), 6).alias(n) for i, n in enumerate(("s0", "c0", "s1", "c1"))]))
query("v10_score_text")(lambda t: D.texts_of(t.spark, t.dir).select("paper_id", T.score_text(T.tokens("abstract", STOP), {r.term: r.idf for r in T.fit_tfidf(T.term_counts(D.texts_of(t.spark, t.dir), "abstract", STOP), D.texts_of(t.spark, t.dir), 500, 2).select("term", "idf").collect()}).alias("s")).select("paper_id", "s.total", "s.matches"))


def tfidf_means(t: Tables):
    counts = T.count_terms(D.texts_of(t.spark, t.dir), "abstract", STOP)
    weights = T.transform_tfidf(counts, T.fit_tfidf(T.by_term(counts), D.texts_of(t.spark, t.dir), 500, 2))
    groups = D.texts_of(t.spark, t.dir).select("paper_id", F.when(F.col("paper_id") % 2 == 0, "a").otherwise("b").alias("group"))
    return T.mean_tfidf_by_group(weights, groups)


query("e3_tfidf_difference", TFIDF + ", x AS (SELECT paper_id, term, (1 + ln(tf)) * idf AS w FROM tc JOIN voc USING (term)), y AS (SELECT paper_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY paper_id)) AS w FROM x), z AS (SELECT term, coalesce(sum(w) FILTER (paper_id % 2 = 0), 0) / (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id % 2 = 0) - coalesce(sum(w) FILTER (paper_id % 2 <> 0), 0) / (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id % 2 <> 0) AS d FROM y GROUP BY 1) SELECT term, round(d / max(abs(d)) OVER (), 6) AS difference FROM z")(lambda t: rounded(T.scaled_difference(tfidf_means(t), "a", "b")))
query("e5_merge_batches", "SELECT count(*) AS n, 0::BIGINT AS n_repeated FROM emb")(lambda t: (lambda m: m.agg(F.count("*").alias("n")).crossJoin(V.repeated_ids(m).agg(F.count("*").alias("n_repeated"))))(V.merge_embedding_batches(t.emb.filter("paper_id % 2 = 0"), t.emb.filter("paper_id % 2 <> 0"))))
query("e7_filter_embeddings", "SELECT paper_id, round(v[1], 6) AS first FROM emb WHERE paper_id IN (SELECT paper_id FROM sess)")(lambda t: V.filter_embeddings(t.emb, t.sess).select("paper_id", F.round(F.element_at("embedding", 1), 6).alias("first")))
query("e9_pca")(lambda t: V.pca(t.emb, t.emb.filter("paper_id % 4 = 0"), "embedding", 16))
query("e12_compare", ", c AS (SELECT p.l1, avg(list_dot_product(x.u, y.u)) AS a, avg(list_dot_product(list_transform(x.v, lambda e: e + 0.1::DOUBLE), list_transform(y.v, lambda e: e + 0.1::DOUBLE)) / x.n / y.n) AS b FROM papers p JOIN papers q ON p.l1 = q.l1 AND p.paper_id < q.paper_id JOIN (SELECT paper_id, v, u, sqrt(list_dot_product(list_transform(v, lambda e: e + 0.1::DOUBLE), list_transform(v, lambda e: e + 0.1::DOUBLE))) AS n FROM emb JOIN unitv USING (paper_id)) x ON x.paper_id = p.paper_id JOIN (SELECT paper_id, v, u, sqrt(list_dot_product(list_transform(v, lambda e: e + 0.1::DOUBLE), list_transform(v, lambda e: e + 0.1::DOUBLE))) AS n FROM emb JOIN unitv USING (paper_id)) y ON y.paper_id = q.paper_id GROUP BY 1) SELECT l1, round(a, 6) AS before, round(b, 6) AS after, round(b - a, 6) AS difference FROM c")(lambda t: rounded(V.compare_embeddings(t.emb, t.emb.withColumn("embedding", F.transform("embedding", lambda x: x + 0.1)), t.papers)))
query("e16_cluster_similarity", ", u AS (SELECT paper_id, l1, u FROM unitv JOIN papers USING (paper_id) WHERE l1 IS NOT NULL), c AS (SELECT a.l1, count(DISTINCT a.paper_id) AS n, avg(list_dot_product(a.u, b.u)) FILTER (a.l1 = b.l1) AS i, avg(list_dot_product(a.u, b.u)) FILTER (a.l1 <> b.l1) AS o FROM u a JOIN u b ON a.paper_id <> b.paper_id GROUP BY 1) SELECT l1, n, round(i, 6) AS inside, round(o, 6) AS outside, round((i - o) / greatest(i, o), 6) AS score FROM c")(lambda t: rounded(V.cluster_similarity(t.emb, t.papers, "l1")))
query("e4_encode_texts")(lambda t: T.encode_texts(D.texts_of(t.spark, t.dir), "abstract", known=t.emb))


def by_k(t: Tables):
    """Mean nDCG and mean score of each validation session for scorers by the k nearest votes."""
    val = t.split.filter("split = 'val'").select("user_id", "session_id", "paper_id", "t", F.col("rating").alias("label"))
    rows = W.knn_scores(val, t.split.filter("split = 'train'"), t.emb, [1, 3, 5, 7]).withColumn("logit", F.round("knn", 9)).drop("knn")
    session = ["user_id", "session_id", "k"]
    ups = rows.filter("label = 1").select(*session, "paper_id", "t", "logit")
    ranked = M.rank_positives(ups, rows.filter("label = 0").select(*session, "logit"), session)
    value = ranked.groupBy(*session).agg(F.avg(1 / F.log2(F.col("rank") + 1)).alias("value"))
    return rows.groupBy(*session).agg(F.avg("logit").alias("logit")).join(value, session, "left")


query("m14_best_k_path")(lambda t: H.best_k_path(by_k(t), [1, 3, 5, 7]))


def cluster_counts(t: Tables):
    """Votes in and out of the first category, and a cache of 20."""
    inside = F.col("l1") == "C0"
    rows = t.split.join(t.papers.select("paper_id", "l1"), "paper_id")
    kinds = [F.count_if((F.col("rating") == r) & i).alias(f"n_{k}_{w}") for r, k in ((1, "pos"), (0, "neg")) for i, w in ((inside, "in"), (~inside, "out"))]
    return rows.groupBy("user_id").agg(*kinds).withColumn("n_cache", F.lit(20).cast("long"))


COUNTED = """, k0 AS (SELECT user_id, count(*) FILTER (rating = 1 AND l1 = 'C0') AS n_pos_in, count(*) FILTER (rating = 1 AND l1 <> 'C0') AS n_pos_out, count(*) FILTER (rating = 0 AND l1 = 'C0') AS n_neg_in, count(*) FILTER (rating = 0 AND l1 <> 'C0') AS n_neg_out, 20::BIGINT AS n_cache FROM split JOIN papers USING (paper_id) GROUP BY ALL),
k AS (SELECT *, (n_pos_in + n_pos_out + n_neg_in + n_neg_out + n_cache)::DOUBLE AS whole, 0.9::DOUBLE * (n_neg_in + n_neg_out) + 0.1::DOUBLE * n_cache AS low FROM k0)"""
SPLIT_SQL = """, s AS (SELECT *, CASE WHEN n_pos_in = 0 THEN 0 WHEN n_pos_out = 0 THEN 1 ELSE {pos} END AS sp, {neg} AS sn FROM k)
SELECT user_id, n_pos_in, n_pos_out, n_neg_in, n_neg_out, n_cache, round(CASE WHEN n_pos_in > 0 THEN whole * 0.5 * sp / n_pos_in ELSE 0 END, 9) AS w_pos_in, round(CASE WHEN n_pos_out > 0 THEN whole * 0.5 * (1 - sp) / n_pos_out ELSE 0 END, 9) AS w_pos_out,
 round(CASE WHEN n_neg_in > 0 THEN whole * 0.5 * 0.9 * (n_neg_in + n_neg_out) / low * sn / n_neg_in ELSE 0 END, 9) AS w_neg_in, round(CASE WHEN n_neg_out > 0 THEN whole * 0.5 * 0.9 * (n_neg_in + n_neg_out) / low * (1 - sn) / n_neg_out ELSE 0 END, 9) AS w_neg_out, round(whole * 0.5 * 0.1 / low, 9) AS w_cache FROM s"""
query("m5_cluster_weights_absolute", COUNTED + SPLIT_SQL.format(pos="greatest(n_pos_in / (n_pos_in + 3.0::DOUBLE), n_pos_in / (n_pos_in + n_pos_out))", neg="CASE WHEN n_neg_in = 0 THEN 0 WHEN n_neg_out = 0 THEN 1 ELSE CASE WHEN n_pos_in = 0 THEN 0 WHEN n_pos_out = 0 THEN 1 ELSE greatest(n_pos_in / (n_pos_in + 3.0::DOUBLE), n_pos_in / (n_pos_in + n_pos_out)) END END"))(
    lambda t: rounded(C.cluster_weights(cluster_counts(t), "absolute", "same_ratio", 3.0), 9)
)
query("m5_cluster_weights_relative", COUNTED + SPLIT_SQL.format(pos="0.8::DOUBLE * n_pos_in / (0.8::DOUBLE * n_pos_in + 0.2::DOUBLE * n_pos_out)", neg="CASE WHEN n_neg_in = 0 THEN 0 WHEN n_neg_out = 0 THEN 1 ELSE 0.8::DOUBLE * n_neg_in / (0.8::DOUBLE * n_neg_in + 0.2::DOUBLE * n_neg_out) END"))(
    lambda t: rounded(C.cluster_weights(cluster_counts(t), "relative", "same_alpha", 0.8), 9)
)
query("m11_cluster_scores")(lambda t: C.cluster_scores(C.cluster_user_models(t.split.filter("split = 'train'"), t.emb, k=3, least=2, limits=(8, 100_000)), t.split.filter("split = 'val'").select("user_id", "paper_id", "session_id"), t.emb).withColumn("logit", F.round("logit", 6)))
query("m13_choose_k")(lambda t: C.choose_k(t.split.filter("split = 'train'"), t.emb, (1, 3, 5), 3, 6, least=2, limits=(8, 100_000)))
query("x9_random_negatives_each", ", ng AS (SELECT user_id, paper_id AS neg_paper_id, t AS neg_t, row_number() OVER (PARTITION BY user_id ORDER BY md5('42|neg|' || user_id || '|' || paper_id || '|' || t), paper_id, t) - 1 AS pl, count(*) OVER (PARTITION BY user_id) AS n FROM sess WHERE rating = 0), up AS (SELECT user_id, paper_id, t, ('0x' || left(md5('42|each|' || user_id || '|' || paper_id || '|' || t), 8))::BIGINT AS h, unnest([1, 2, 3, 4])::BIGINT AS place FROM sess WHERE rating = 1) SELECT user_id, paper_id, t, place, neg_paper_id, neg_t FROM up JOIN ng USING (user_id) WHERE place <= n AND (h % n + place - 1) % n = pl")(lambda t: S.random_negatives_each(t.sess, 4, SEED))
query("t4_val_upper_bounds", ", b AS (SELECT user_id, max(round(value, 9)) AS v FROM res WHERE score = 'ndcg' GROUP BY 1) SELECT round(avg(v), 6) AS value, count(*) AS n_users, (SELECT round(avg(v), 6) FROM (SELECT v FROM b ORDER BY v, user_id LIMIT 10)) AS worst FROM b")(lambda t: rounded(R.val_upper_bounds(t.res.withColumn("value", F.round("value", 9)), "ndcg", 10)))
query("e11_subcategory_cohesion", ", c AS (SELECT p.l1, p.l2, avg(list_dot_product(x.u, y.u)) AS cosine FROM papers p JOIN papers q ON p.l2 = q.l2 AND p.paper_id < q.paper_id JOIN unitv x ON x.paper_id = p.paper_id JOIN unitv y ON y.paper_id = q.paper_id GROUP BY 1, 2) SELECT l1, count(*) AS n_groups, round(avg(cosine), 6) AS cosine FROM c GROUP BY 1")(lambda t: rounded(V.subcategory_cohesion(t.emb, t.papers)))
query("e11_separation", "SELECT p.l1, round(avg(list_dot_product(x.u, y.u)), 6) AS cosine FROM papers p JOIN papers q ON q.l1 = 'C0' AND p.paper_id <> q.paper_id JOIN unitv x ON x.paper_id = p.paper_id JOIN unitv y ON y.paper_id = q.paper_id WHERE p.l1 IS NOT NULL GROUP BY 1")(lambda t: rounded(V.category_separation(t.emb, t.papers, "C0")))
query("e3_scaled_coefficients", TFIDF + " SELECT substr(term, 1, 1) AS \"group\", term, round(idf / max(abs(idf)) OVER (PARTITION BY substr(term, 1, 1)), 6) AS coef FROM voc")(lambda t: rounded(T.scaled_coefficients(T.fit_tfidf(T.term_counts(D.texts_of(t.spark, t.dir), "abstract", STOP), D.texts_of(t.spark, t.dir), 500, 2).select(F.substring("term", 1, 1).alias("group"), "term", F.col("idf").alias("coef")), ["group"])))
query("a7_category_distribution_of_liked", "SELECT l2, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM papers WHERE paper_id IN (SELECT paper_id FROM rat WHERE rating = 1) GROUP BY 1")(lambda t: P.category_distribution(t.papers, "l2", t.rat.filter("rating = 1")))
query("t6_compare_runs_less_is_better", ", r AS (SELECT a.user_id, round(b.value, 9) AS new, round(a.value, 9) AS old, round(a.value, 9) - round(b.value, 9) AS diff FROM res a JOIN res b ON a.user_id = b.user_id AND a.combination_idx = 0 AND b.combination_idx = 1 AND a.score = 'mrr' AND b.score = 'mrr'), k AS ((SELECT *, 'best' AS side FROM r ORDER BY diff DESC, user_id LIMIT 5) UNION ALL (SELECT *, 'worst' AS side FROM r ORDER BY diff, user_id LIMIT 5)) SELECT user_id, round(new, 6) AS new, round(old, 6) AS old, round(diff, 6) AS diff, side FROM k")(lambda t: rounded(R.compare_runs(*t.runs("mrr"), "mrr", 5, False)))
