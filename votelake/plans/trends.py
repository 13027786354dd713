"""Queries over windows, bins, models and interests along time; they join the library's others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import prepare as P
from ..operators import scoring as M
from ..operators import trends as N
from ..operators import weights as W
from .modelling import HIST, LIKES, QUERIES, SQL, flagship, hist
from .queries import Tables, query, rounded

__all__ = ["QUERIES", "SQL", "flagship"]

OVER = "round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(median(v), 6) AS median, round(quantile_cont(v, 0.25), 6) AS low, round(quantile_cont(v, 0.75), 6) AS high, count(*) AS n_users"
HITS = ", hk AS (SELECT user_id, session_id, k, round(avg((rank <= k)::INT), 9) AS value FROM ranked, unnest([1, 2, 4]) u(k) WHERE split = 'val' GROUP BY ALL)"
MODES = ["joint", "separate", "positives"]
SCALINGS = {"clip": None, "linear": None, "softmax": 0.5, "inverse": None, "gaussian": 0.3, "percentile": 10, "threshold": 0.1}


def session_days(t: Tables):
    return P.session_days_passed(P.session_table(t.rat))


def hits(t: Tables):
    """Share of a validation session's up-votes among the first k."""
    near = t.ranked.filter("split = 'val'").withColumn("k", F.explode(F.array(*[F.lit(k) for k in (1, 2, 4)])))
    return near.groupBy("user_id", "session_id", "k").agg(F.round(F.avg((F.col("rank") <= F.col("k")).cast("double")), 9).alias("value"))


def session_mrr(t: Tables):
    rows = t.ranked.filter("split = 'val'").groupBy("user_id", "session_id").agg(F.avg(1 / F.col("rank")).alias("mrr"), F.count("*").alias("n"))
    return rows.join(P.session_table(t.rat).select("user_id", "session_id", F.col("t_min").alias("t")), ["user_id", "session_id"])


def session_means(t: Tables):
    return M.mean_positive_embedding(t.split, t.emb, ["user_id", "session_id"]).withColumnRenamed("profile", "coef")


def bins(t: Tables):
    counts = P.cumulative_votes(P.session_table(t.sess))
    split = t.split.groupBy("user_id", "session_id").agg(F.first("split").alias("split"))
    all_k = counts.join(split, ["user_id", "session_id"]).withColumn("k", F.explode(F.array(*[F.lit(k) for k in (1, 2, 4)])))
    rows = all_k.join(hits(t), ["user_id", "session_id", "k"], "left")
    return N.binned_sessions(rows, "n_pos_cum", 5, 40, "value", ["n_pos", "n_neg", "n_rated"], ["k"])


BINS = HITS + """, cs AS (SELECT user_id, session_id, p AS n_pos, q AS n_neg, p + q AS n_rated, sum(p) OVER (PARTITION BY user_id ORDER BY session_id) AS cum FROM byses),
sp AS (SELECT DISTINCT user_id, session_id, split FROM split),
al AS (SELECT cs.*, split, k, value FROM cs JOIN sp USING (user_id, session_id) CROSS JOIN unnest([1, 2, 4]) u(k) LEFT JOIN hk USING (user_id, session_id, k)),
bi AS (SELECT k, user_id, least(cum // 5, 8)::BIGINT AS bin, sum(n_pos)::BIGINT AS n_pos, sum(n_neg)::BIGINT AS n_neg, sum(n_rated)::BIGINT AS n_rated, arg_max(cum, session_id)::BIGINT AS n_pos_cum, sum(value * n_pos) / sum(n_pos) FILTER (value IS NOT NULL) AS value FROM al GROUP BY ALL)"""


def contrasts(t: Tables):
    return N.interest_contrasts(t.split, t.emb, t.closest.join(t.split.select("user_id").distinct(), "user_id", "left_semi"))


CONTRASTS = LIKES + """, dn AS (SELECT user_id, u FROM split JOIN unitv USING (paper_id) WHERE rating = 0),
c1 AS (SELECT a.user_id, avg(list_dot_product(a.u, b.u)) AS drawn_to_val FROM lk a JOIN lk b ON a.user_id = b.user_id AND a.split = 'train' AND b.split = 'val' GROUP BY 1),
c2 AS (SELECT a.user_id, avg(list_dot_product(a.u, b.u)) AS to_random_down FROM lk a JOIN dn b ON a.user_id = b.user_id GROUP BY 1),
c3 AS (SELECT user_id, avg(c) AS to_closest_down FROM (SELECT c.user_id, c.paper_id, c.t, avg(list_dot_product(a.u, b.u)) AS c FROM closest c JOIN best USING (user_id) JOIN unitv a ON a.paper_id = c.paper_id JOIN unitv b ON b.paper_id = c.neg_paper_id GROUP BY ALL) GROUP BY 1),
c4 AS (SELECT user_id, avg(c) AS within_sessions FROM (SELECT a.user_id, a.session_id, avg(list_dot_product(a.u, b.u)) AS c FROM lk a JOIN lk b ON a.user_id = b.user_id AND a.session_id = b.session_id AND a.i < b.i GROUP BY ALL) GROUP BY 1),
ct AS (SELECT user_id, drawn_to_val, to_random_down, to_closest_down, within_sessions FROM c1 FULL JOIN c2 USING (user_id) LEFT JOIN c3 USING (user_id) LEFT JOIN c4 USING (user_id))"""


def scalings(t: Tables):
    s = N.largest_similarity_to_likes(t.split.filter("split = 'train'"), t.emb).withColumn("similarity", F.round("similarity", 9))
    return reduce(lambda a, b: a.unionByName(b), [W.similarity_weights(s, k, p).select(F.lit(k).alias("scaling"), "user_id", "paper_id", "t", "weight") for k, p in SCALINGS.items()])


query("w8_window_rates", ", x AS (SELECT user_id, session_id, n_pos FROM sessions WHERE n_pos > 0), p AS (SELECT i, user_id, sum(n_pos) / any_value(least(i + 2, m) - greatest(i - 2, 0) + 1) AS v FROM x, (SELECT max(session_id) AS m FROM x), range(0, (SELECT max(session_id) + 1 FROM x)) r(i) WHERE abs(i - session_id) <= 2 GROUP BY i, user_id) SELECT i, " + OVER + ", round(count(*) / (SELECT count(DISTINCT user_id) FROM sessions), 6) AS share FROM p GROUP BY 1")(lambda t: rounded(N.over_users(N.window_scores(P.session_table(t.rat), "session_id", 2, "n_pos", "rate"), P.session_table(t.rat), ["i"])))
query("w8_window_portions_by_day", ", x AS (SELECT user_id, n_pos, n_rated, (t_min - min(t_min) OVER (PARTITION BY user_id)) // 86400000000 AS d FROM sessions), p AS (SELECT i, user_id, sum(n_pos) / sum(n_rated) AS v FROM x, range(0, (SELECT max(d) + 1 FROM x WHERE n_rated > 0)) r(i) WHERE n_rated > 0 AND abs(i - d) <= 3 GROUP BY ALL) SELECT i, " + OVER + ", round(count(*) / (SELECT count(DISTINCT user_id) FROM sessions), 6) AS share FROM p GROUP BY 1")(lambda t: rounded(N.over_users(N.window_scores(session_days(t), "days_passed", 3, "n_pos", "portion", "n_rated"), session_days(t), ["i"])))
query("w8_window_cosines", """, r AS (SELECT user_id, session_id, rating, u, row_number() OVER (PARTITION BY user_id ORDER BY t, paper_id) AS id, (count(*) FILTER (rating = 1) OVER q > 0) AND (count(*) FILTER (rating = 0) OVER q > 0) AS two FROM sess JOIN unitv USING (paper_id) WINDOW q AS (PARTITION BY user_id, session_id)),
w AS (SELECT *, unnest(range(greatest(session_id - 1, 0), least(session_id + 1, (SELECT max(session_id) FROM r)) + 1)) AS i FROM r),
d AS (SELECT a.user_id, a.i, a.rating AS x, b.rating AS y, a.two AND b.two AS two, list_dot_product(a.u, b.u) AS d FROM w a JOIN w b ON a.user_id = b.user_id AND a.i = b.i AND a.id < b.id),
c AS (SELECT i, user_id, avg(d) AS "all", avg(d) FILTER (x = 1 AND y = 1) AS pos, avg(d) FILTER (x = 0 AND y = 0) AS neg, avg(d) FILTER (x <> y AND two) AS pos_neg FROM d GROUP BY ALL),
l AS (UNPIVOT c ON "all", pos, neg, pos_neg INTO NAME measure VALUE v)
SELECT measure, i, """ + OVER + ", round(count(*) / (SELECT count(DISTINCT user_id) FROM sess), 6) AS share FROM l GROUP BY ALL")(lambda t: rounded(N.over_users(N.window_cosines(t.sess.join(t.emb, "paper_id"), "session_id", 1), t.sess, ["measure", "i"])))
query("w9_session_edges", ", m AS (SELECT user_id, session_id, avg(1 / rank) AS mrr, count(*) AS n FROM ranked WHERE split = 'val' GROUP BY ALL), x AS (SELECT m.*, t_min AS t, row_number() OVER w AS i, count(*) OVER q AS c, min(t_min) OVER q AS a, max(t_min) OVER q AS z FROM m JOIN sessions USING (user_id, session_id) WINDOW w AS (PARTITION BY user_id ORDER BY session_id), q AS (PARTITION BY user_id)) SELECT user_id, " + ", ".join(f"round(sum(mrr * n) FILTER ({c}) / sum(n) FILTER ({c}), 6) AS {k}" for k, c in {"first_sessions": "i <= greatest(1, c // 4)", "last_sessions": "i > c - greatest(1, c // 4)", "first_times": "t <= a + (z - a) / 4", "last_times": "t >= z - (z - a) / 4"}.items()) + " FROM x GROUP BY 1")(lambda t: rounded(N.session_edges(session_mrr(t), "mrr")))
query("a15_binned_sessions", BINS + " SELECT k, user_id, bin, n_pos, n_neg, n_rated, n_pos_cum, round(value, 6) AS value FROM bi")(lambda t: rounded(bins(t)))
query("a15_bins_by_k", BINS + " SELECT bin, " + ", ".join(f"round(avg(value) FILTER (k = {k}), 6) AS mean_{k}, count(value) FILTER (k = {k}) AS n_users_{k}" for k in (1, 2, 4)) + " FROM bi GROUP BY 1")(lambda t: rounded(N.bins_by_k(bins(t), "value", [1, 2, 4])))
query("a16_best_k_table", ", r AS (SELECT user_id, combination_idx AS k, score, round(value, 9) AS value FROM res), o AS (SELECT user_id, k AS best_k FROM r WHERE score = 'ndcg' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, k) = 1), x AS (SELECT best_k, score, k, value FROM r JOIN o USING (user_id) UNION ALL SELECT best_k, score, NULL, value FROM r JOIN o USING (user_id) WHERE k = best_k), y AS (SELECT * FROM x UNION ALL SELECT NULL, score, k, value FROM x) SELECT best_k, score, k, round(avg(value), 6) AS value, count(*) AS n_users FROM y GROUP BY ALL")(lambda t: rounded(N.best_k_table(t.res.select("user_id", F.col("combination_idx").alias("k"), "score", F.round("value", 9).alias("value")), "ndcg")))
query("a19_fold_spread", "SELECT score, round(stddev_samp(v), 6) AS std, count(*) AS n_folds FROM (SELECT combination_idx, score, avg(value) AS v FROM res GROUP BY ALL) GROUP BY 1")(lambda t: rounded(N.fold_spread(t.res.withColumnRenamed("combination_idx", "fold_idx").withColumn("combination_idx", F.lit(0)), 0)))
query("m16_model_shape", ", m0 AS (SELECT user_id, session_id, pos, avg(x) AS m FROM (SELECT user_id, session_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM split JOIN emb USING (paper_id) WHERE rating = 1) GROUP BY ALL), g AS (SELECT user_id, session_id, avg(abs(m)) AS mean_abs, stddev_pop(m) AS std, avg((abs(m) >= 0.001)::INT) AS share_nonzero, count(*) FILTER (m <> 0) AS n_nonzero FROM m0 GROUP BY ALL), tp AS (SELECT user_id, session_id, list(pos) AS top FROM (SELECT *, row_number() OVER (PARTITION BY user_id, session_id ORDER BY abs(m) DESC, pos) AS i FROM m0) WHERE i <= 10 GROUP BY ALL), l AS (SELECT *, lag(top) OVER w AS p, CASE WHEN row_number() OVER w > 1 THEN first(top) OVER w END AS f FROM tp WINDOW w AS (PARTITION BY user_id ORDER BY session_id)) SELECT user_id, session_id, round(mean_abs, 6) AS mean_abs, round(std, 6) AS std, round(share_nonzero, 6) AS share_nonzero, n_nonzero, CASE WHEN p IS NOT NULL THEN len(list_intersect(top, p)) / 10 END AS overlap_prev, CASE WHEN f IS NOT NULL THEN len(list_intersect(top, f)) / 10 END AS overlap_first FROM g JOIN l USING (user_id, session_id)")(lambda t: rounded(N.model_shape(session_means(t))))
query("k9_successive_sessions", LIKES + ", s AS (SELECT user_id, (count(DISTINCT session_id) = 1)::INT AS single_session FROM split WHERE split = 'train' GROUP BY 1), va AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY session_id) AS k FROM lk WHERE split = 'val'), c AS (SELECT a.user_id, a.k, avg(list_dot_product(a.u, b.u)) AS c FROM va a JOIN va b ON a.user_id = b.user_id AND b.k = a.k + 1 GROUP BY ALL) SELECT user_id, single_session, round(avg(c), 6) AS val_successive FROM s LEFT JOIN c USING (user_id) GROUP BY ALL")(lambda t: rounded(N.successive_sessions(t.split, t.emb)))
query("k10_attached_columns", HITS + ", b AS (SELECT user_id, session_id, min(k) AS best_k, max(value) AS value FROM (SELECT *, max(value) OVER (PARTITION BY user_id, session_id) AS m FROM hk) WHERE value = m GROUP BY ALL) SELECT s.user_id, s.session_id, n_rated, best_k::DOUBLE AS best_k, round(value, 6) AS value, CASE WHEN best_k IS NULL THEN 'train' ELSE 'val' END AS split FROM sessions s LEFT JOIN b USING (user_id, session_id)")(lambda t: rounded(N.attach_columns(P.session_table(t.rat).select("user_id", "session_id", "n_rated"), [hits(t).groupBy("user_id", "session_id").agg((-F.max(F.struct("value", (-F.col("k")).alias("k")))["k"]).alias("best_k"), F.max("value").alias("value"))], ["best_k", "value"])))
query("m3_decay_with_cache", HIST + ", d AS (SELECT *, exp(-0.1 * ((val_t - t) // 86400000000)) AS d FROM hist), x AS (SELECT *, coalesce(sum(d) FILTER (rating = 1) OVER w, 0) AS p, coalesce(sum(d) FILTER (rating = 0) OVER w, 0) AS q, count(*) FILTER (rating = 0) OVER w AS n, count(*) OVER w + 50 AS r FROM d WINDOW w AS (PARTITION BY user_id, val_session)), y AS (SELECT *, 0.5::DOUBLE / (0.9::DOUBLE * n + 0.1::DOUBLE * 50) AS f, 1.5::DOUBLE / (p + 0.5::DOUBLE * q) AS g FROM x), z AS (SELECT *, 'joint' AS mode, CASE rating WHEN 1 THEN g * 0.5::DOUBLE * d ELSE g * f * 0.9::DOUBLE * n * d END AS a, g * f * 0.1::DOUBLE * q AS b FROM y UNION ALL SELECT *, 'separate', CASE rating WHEN 1 THEN d / p ELSE f * 0.9::DOUBLE * n * d / q END, f * 0.1::DOUBLE FROM y UNION ALL SELECT *, 'positives', CASE rating WHEN 1 THEN 0.5::DOUBLE * d / p ELSE f * 0.9::DOUBLE END, f * 0.1::DOUBLE FROM y) SELECT mode, user_id, val_session, paper_id, t, round(r * a, 6) AS weight, round(r * b, 6) AS w_cache FROM z")(lambda t: rounded(reduce(lambda a, b: a.unionByName(b), [N.decay_with_cache(hist(t), 0.1, 50, mode=m).select(F.lit(m).alias("mode"), "user_id", "val_session", "paper_id", "t", "weight", "w_cache") for m in MODES])))
query("m4_largest_similarity_weights", LIKES + """, si AS (SELECT s.user_id, s.paper_id, s.t, round(max(list_dot_product(x.u, lk.u)), 9) AS s FROM split s JOIN unitv x USING (paper_id) JOIN lk ON lk.user_id = s.user_id WHERE s.rating = 0 AND s.split = 'train' AND lk.split = 'train' GROUP BY s.user_id, s.paper_id, s.t),
st AS (SELECT user_id, quantile_cont(s, 0.1) AS lo, quantile_cont(s, 0.9) AS hi FROM si GROUP BY 1),
ra AS (SELECT si.*, unnest(['clip', 'linear', 'softmax', 'inverse', 'gaussian', 'percentile', 'threshold']) AS scaling, unnest([greatest(s, 0), s + 1, exp(s / 0.5), greatest(1 - s, 0), exp(-(s - 0.3) * (s - 0.3) / 0.045), (s >= lo AND s <= hi)::INT, (s >= 0.1)::INT]::DOUBLE[]) AS w FROM si JOIN st USING (user_id))
SELECT scaling, user_id, paper_id, t, round(CASE WHEN sum(w) OVER x = 0 THEN 1 ELSE w * count(*) OVER x / sum(w) OVER x END, 6) AS weight FROM ra WINDOW x AS (PARTITION BY scaling, user_id)""")(lambda t: rounded(scalings(t)))
query("e14_interest_contrasts", CONTRASTS + " SELECT user_id, round(drawn_to_val, 6) AS drawn_to_val, round(to_random_down, 6) AS to_random_down, round(to_closest_down, 6) AS to_closest_down, round(within_sessions, 6) AS within_sessions FROM ct")(lambda t: rounded(contrasts(t)))
query("e14_contrasts_by_group", CONTRASTS + ", g AS (SELECT user_id, CASE WHEN category = 'C0' THEN 'main' ELSE 'other' END AS g FROM signif WHERE rank = 1 UNION ALL SELECT user_id, 'all' FROM ct), l AS (UNPIVOT ct ON drawn_to_val, to_random_down, to_closest_down, within_sessions INTO NAME score VALUE value) SELECT g AS \"group\", score, round(avg(value), 6) AS value, round(stddev_samp(value), 6) AS std, round(median(value), 6) AS median, count(*) AS n FROM l JOIN g USING (user_id) GROUP BY ALL")(lambda t: rounded(N.contrasts_by_group(contrasts(t), t.signif.filter("rank = 1").select("user_id", F.when(F.col("category") == "C0", "main").otherwise("other").alias("group")))))
