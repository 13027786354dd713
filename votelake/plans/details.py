"""Queries over clusters' extremes, slopes, lists of users, differences and what is missing; they join the library's others."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import clusters as C
from ..operators import history as H
from ..operators import prepare as P
from ..operators import reports as R
from ..operators import scoring as M
from ..operators import splits as X
from ..operators import trends as N
from ..sources import tables as D
from .queries import SEED, Tables, query, rounded
from .trends import HITS, OVER, QUERIES, SQL, flagship, hits

__all__ = ["QUERIES", "SQL", "flagship"]

LISTS = ", pt AS (SELECT user_id, CASE WHEN i <= 10 THEN 'test' WHEN i IS NULL THEN 'train' ELSE 'val' END AS selection FROM (SELECT DISTINCT user_id FROM split) LEFT JOIN (SELECT user_id, row_number() OVER (ORDER BY md5('42|users|' || user_id), user_id) AS i FROM (SELECT user_id FROM split GROUP BY 1 HAVING count(*) FILTER (rating = 1) >= 30 AND count(*) FILTER (rating = 0) >= 20 AND count(DISTINCT session_id) >= 5)) USING (user_id)), ul AS (FROM pt UNION ALL SELECT user_id, 'high_sessions' FROM (SELECT user_id FROM split WHERE split = 'val' AND rating = 1 GROUP BY 1 HAVING count(DISTINCT session_id) >= 3))"


def lists(t: Tables):
    """Users by the name of a selection: the drawn parts, and those of many validation sessions."""
    parts = X.partition_users(P.filter_users_min_votes(t.split, 30, 20, 5), t.split, 10, SEED)
    return parts.select("user_id", "selection").unionByName(P.users_of_many_sessions(t.split, 3).withColumn("selection", F.lit("high_sessions")))


def dense(eps: float) -> str:
    """Density clusters of each user's up-votes from all pairs: cores, what they reach, and the edge."""
    return f""", lu AS (SELECT DISTINCT user_id, paper_id, u FROM sess JOIN unitv USING (paper_id) WHERE rating = 1),
pr AS (SELECT a.user_id, a.paper_id, b.paper_id AS other FROM lu a JOIN lu b USING (user_id) WHERE a.paper_id = b.paper_id OR 1 - list_dot_product(a.u, b.u) <= {eps}),
co AS (SELECT user_id, paper_id FROM pr GROUP BY ALL HAVING count(*) >= 3),
ce AS (SELECT pr.* FROM pr JOIN co USING (user_id, paper_id) JOIN co b ON b.user_id = pr.user_id AND b.paper_id = pr.other),
rt AS (SELECT user_id, paper_id, min(root) AS root FROM (WITH RECURSIVE re AS (SELECT user_id, paper_id, paper_id AS root FROM co UNION SELECT ce.user_id, ce.other, re.root FROM re JOIN ce ON ce.user_id = re.user_id AND ce.paper_id = re.paper_id) FROM re) GROUP BY ALL),
ed AS (SELECT pr.user_id, pr.paper_id, min(root) AS root FROM pr JOIN rt ON rt.user_id = pr.user_id AND rt.paper_id = pr.other WHERE (pr.user_id, pr.paper_id) NOT IN (SELECT (user_id, paper_id) FROM co) GROUP BY ALL),
cl AS (SELECT user_id, paper_id, (dense_rank() OVER (PARTITION BY user_id ORDER BY root) - 1)::INT AS cluster FROM (FROM rt UNION ALL FROM ed))"""


def interests(t: Tables):
    """Up-votes by the number of their paper's l1."""
    likes = t.split.filter("rating = 1 AND split = 'train'").select("user_id", "paper_id").distinct()
    return likes.join(P.index_categories(t.papers).withColumnRenamed("l1_idx", "cluster"), "paper_id")


PAIRS = """, it AS (SELECT DISTINCT user_id, paper_id, CASE WHEN l1 IS NULL THEN 0 ELSE 1 + (SELECT count(DISTINCT l1) FROM papers q WHERE q.l1 < p.l1) END::INT AS cluster, u FROM split JOIN papers p USING (paper_id) JOIN unitv USING (paper_id) WHERE rating = 1 AND split = 'train'),
ea AS (SELECT a.user_id, a.paper_id, a.cluster, b.cluster AS other, max(list_dot_product(a.u, b.u)) AS high, avg(list_dot_product(a.u, b.u)) AS mean, min(list_dot_product(a.u, b.u)) AS low FROM it a JOIN it b ON a.user_id = b.user_id AND a.paper_id <> b.paper_id GROUP BY ALL),
ex AS (SELECT user_id, a.cluster, b.cluster AS other FROM (SELECT DISTINCT user_id, cluster FROM it) a JOIN (SELECT DISTINCT user_id, cluster FROM it) b USING (user_id)),
ez AS (SELECT user_id, cluster, other::BIGINT AS other, avg(high) AS high, avg(mean) AS mean, avg(low) AS low FROM ex LEFT JOIN ea USING (user_id, cluster, other) GROUP BY ALL)"""
START = """, vr AS (SELECT user_id, session_id, rating, u, split FROM split JOIN unitv USING (paper_id)),
wi AS (SELECT user_id, i, rating, u FROM vr, range(0, (SELECT max(session_id) + 1 FROM split WHERE split = 'val')) r(i) WHERE split = 'val' AND abs(i - session_id) <= 1),
sr AS (SELECT i, wi.user_id, avg(list_dot_product(wi.u, vr.u)) AS start_rated, avg(list_dot_product(wi.u, vr.u)) FILTER (wi.rating = 1 AND vr.rating = 1) AS start_pos FROM wi JOIN vr ON wi.user_id = vr.user_id AND vr.split = 'train' GROUP BY ALL),
sl AS (SELECT i, user_id, measure, v FROM (UNPIVOT sr ON start_rated, start_pos INTO NAME measure VALUE v))"""


def session_hits(t: Tables):
    return hits(t).filter("k = 2")


def shifted(t: Tables):
    """Other vectors of the same papers: the last half of the places doubled, and some papers without."""
    far = F.transform("embedding", lambda x, i: F.when(i >= F.size("embedding") / 2, x * 2).otherwise(x))
    return t.emb.filter("paper_id % 11 <> 0").withColumn("embedding", far)


def proba(t: Tables):
    return t.pred.withColumn("proba", F.round(V.sigmoid("logit"), 9))


PROBA = ", o AS (SELECT user_id, paper_id, t, split, label, round(1 / (1 + exp(-logit)), 9) AS proba FROM pred)"
RES9 = ", r9 AS (SELECT user_id, combination_idx, round(value, 9) AS value FROM res WHERE score = 'ndcg'), dd AS (SELECT r9.combination_idx, user_id, round(r9.value - b.value, 9) AS d FROM r9 JOIN (SELECT user_id, value FROM r9 WHERE combination_idx = 0) b USING (user_id) WHERE r9.combination_idx = 1), di AS (SELECT *, row_number() OVER (ORDER BY d, user_id) AS a, row_number() OVER (ORDER BY -d, user_id) AS b FROM dd)"


def texts(t: Tables):
    return D.texts_of(t.spark, t.dir)


query("s2_check_selections", LISTS + " SELECT count(*) AS n_users, count(*) FILTER (n > 1) AS n_overlapping FROM (SELECT user_id, count(DISTINCT selection) AS n FROM ul GROUP BY 1)")(lambda t: D.check_selections(lists(t)))
query("s8_word_vectors", "SELECT 'p' || paper_id AS word, round(list_sum(list_transform(v[1:5], lambda x: round(x, 4))), 4) AS total FROM emb")(lambda t: D.word_vectors(t.emb.select(F.concat_ws(" ", F.concat(F.lit("p"), "paper_id"), F.array_join(F.transform("embedding", lambda x: F.round(x, 4).cast("string")), " ")).alias("value")), 5).select("word", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 4).alias("total")))
query("f8_named_lists", LISTS + " SELECT user_id, paper_id, t FROM split WHERE user_id IN (SELECT user_id FROM ul WHERE selection IN ('val', 'high_sessions')) AND user_id NOT IN (SELECT user_id FROM ul WHERE selection = 'test')")(lambda t: P.select_users(t.split, lists(t), ["val", "high_sessions"], ["test"]).select("user_id", "paper_id", "t"))
query("j11_missing_vectors", "SELECT count(*) AS n_votes, count(DISTINCT paper_id) AS n_papers, count(*) FILTER (paper_id % 11 = 0) AS n_votes_missing, count(DISTINCT paper_id) FILTER (paper_id % 11 = 0) AS n_papers_missing FROM rat")(lambda t: H.missing_vectors(t.rat, shifted(t)))
query("a18_slopes_by_session", HITS + " SELECT user_id, CASE WHEN min(session_id) < max(session_id) THEN round(regr_slope(value, session_id), 6) + 0.0::DOUBLE END AS slope, count(*) AS n FROM hk WHERE k = 2 GROUP BY 1")(lambda t: rounded(N.metric_slopes(session_hits(t), "session_id", "value")))
query("a18_slopes_by_day", ", rk AS (SELECT user_id, split, t, 1 / rank AS v, (t - min(t) OVER (PARTITION BY user_id, split)) / 86400000000 AS d FROM ranked) SELECT user_id, split, round(regr_slope(v, d), 6) AS slope, count(*) AS n FROM rk GROUP BY ALL")(lambda t: rounded(N.metric_slopes(N.days_since_first(t.ranked, ["split"]).withColumn("v", 1 / F.col("rank")), "days", "v", ["split"])))
query("w8_window_start_cosines", START + " SELECT measure, i, " + OVER + ", round(count(*) / (SELECT count(DISTINCT user_id) FROM split), 6) AS share FROM sl GROUP BY ALL")(lambda t: rounded(N.over_users(N.window_start_cosines(t.split.join(t.emb, "paper_id"), "session_id", 1), t.split, ["measure", "i"])))
query("e16_cluster_extremes", PAIRS + " SELECT user_id, cluster, other, round(high, 6) + 0.0::DOUBLE AS high, round(mean, 6) + 0.0::DOUBLE AS mean, round(low, 6) + 0.0::DOUBLE AS low FROM ez")(lambda t: rounded(C.cluster_extremes(interests(t), t.emb)))
query("e16_cluster_separation", PAIRS + ", se AS (SELECT user_id, cluster, avg(high) FILTER (cluster <> other) AS high, avg(mean) FILTER (cluster <> other) AS mean, avg(low) FILTER (cluster <> other) AS low, max(mean) FILTER (cluster = other) AS inside FROM ez GROUP BY ALL) SELECT user_id, cluster, round(high, 6) + 0.0::DOUBLE AS high, round(mean, 6) + 0.0::DOUBLE AS mean, round(low, 6) + 0.0::DOUBLE AS low, round(inside, 6) + 0.0::DOUBLE AS inside FROM se")(lambda t: rounded(C.cluster_separation(C.cluster_extremes(interests(t), t.emb)).drop("silhouette")))
query("m12_dbscan_user_clusters", dense(0.75) + " SELECT * FROM (SELECT user_id, paper_id, cluster FROM cl)")(lambda t: C.dbscan_user_clusters(t.sess, t.emb, eps=0.75))
query("t9_multi_interest_users", dense(0.72) + """, wd AS (SELECT user_id FROM (SELECT user_id, l1, l2 FROM lu JOIN papers USING (paper_id) WHERE l1 IS NOT NULL AND l2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 2) GROUP BY 1 HAVING count(*) >= 2),
sp AS (SELECT a.user_id, avg(list_dot_product(a.u, b.u)) AS c FROM lu a JOIN lu b ON a.user_id = b.user_id AND a.paper_id < b.paper_id WHERE a.user_id IN (FROM wd) AND a.user_id IN (SELECT user_id FROM cl GROUP BY 1 HAVING count(DISTINCT cluster) >= 2) GROUP BY 1)
SELECT user_id, round(1 - c, 6) AS distance FROM sp ORDER BY round(1 - c, 12) DESC, user_id LIMIT 100""")(lambda t: rounded(C.multi_interest_users(t.sess, t.papers, t.emb, 100, papers_each=2, clusters=2, eps=0.72)))
query("t7_lowest_positives", PROBA + ", l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY proba, paper_id, t) AS i, count(*) OVER (PARTITION BY user_id) AS n_all FROM o WHERE label = 1 AND split = 'val') SELECT user_id, (least(n_all, 5) - i + 1)::BIGINT AS place, paper_id, t, string_split(text, chr(10))[1] AS title, round(proba, 6) AS proba, n_all FROM l LEFT JOIN documents ON doc_id = paper_id WHERE i <= 5")(lambda t: rounded(R.lowest_positives(proba(t).filter("split = 'val'"), texts(t), 5)))
query("t7_drawn_papers", PROBA + ", l AS (SELECT *, row_number() OVER (PARTITION BY user_id, label ORDER BY md5('42|drawn|' || user_id || '|' || paper_id || '|' || t), paper_id, t) AS i, count(*) OVER (PARTITION BY user_id, label) AS n_all FROM o WHERE split = 'train') SELECT user_id, label, row_number() OVER (PARTITION BY user_id, label ORDER BY CASE label WHEN 1 THEN -proba ELSE proba END, paper_id, t) AS place, paper_id, t, string_split(text, chr(10))[1] AS title, round(proba, 6) AS proba, n_all FROM l LEFT JOIN documents ON doc_id = paper_id WHERE i <= 4")(lambda t: rounded(R.drawn_papers(proba(t).filter("split = 'train'"), texts(t), 4, SEED)))
query("t8_differences_to_baseline", RES9 + " SELECT 1::INT AS combination_idx, " + ", ".join(f"round(avg(d) FILTER ({c} <= {k}), 6) AS {side}_{k}" for side, c in (("worst", "a"), ("best", "b")) for k in (1, 3, 10)) + " FROM di")(lambda t: rounded(R.differences_to_baseline(*t.runs("ndcg")[::-1], "ndcg", [1, 3, 10])))
query("v3_paper_category_vectors", ", s AS (SELECT l1 AS category, pos, sum(x) AS x FROM (SELECT l1, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM emb JOIN papers USING (paper_id) WHERE l1 IS NOT NULL) GROUP BY ALL), n AS (SELECT category, sum(x) / sqrt(sum(x * x)) * count(*) / (count(*) + 32) AS total FROM s GROUP BY 1) SELECT paper_id, 'N' || substr(l1, 2) AS category, round(coalesce(total, 0), 6) AS total FROM papers LEFT JOIN n ON l1 = category")(lambda t: rounded(V.paper_category_vectors(t.papers, t.papers.filter("l1 IS NOT NULL").select(F.col("l1").alias("original"), F.concat(F.lit("N"), F.substring("l1", 2, 9)).alias("category")).distinct(), V.category_vectors(t.papers.filter("l1 IS NOT NULL").select(F.concat(F.lit("N"), F.substring("l1", 2, 9)).alias("category"), F.col("paper_id").alias("word"), F.lit(1.0).alias("weight")), t.emb.select(F.col("paper_id").alias("word"), F.col("embedding").alias("vec")), "proportional", 32), 64).select("paper_id", "category", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("total"))))
query("e12_compare_measures", """, bf AS (SELECT paper_id, v FROM emb WHERE paper_id % 11 <> 0), af AS (SELECT paper_id, list_transform(v, lambda x, i: CASE WHEN i > len(v) / 2 THEN 2 * x ELSE x END) AS v FROM bf),
bo AS (SELECT 0 AS w, paper_id, v, l1, l2 FROM bf JOIN papers USING (paper_id) UNION ALL SELECT 1, paper_id, v, l1, l2 FROM af JOIN papers USING (paper_id)), bu AS (SELECT *, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM bo WHERE l1 IS NOT NULL),
mv AS (SELECT w, l1, list(m ORDER BY pos) AS m FROM (SELECT w, l1, pos, avg(x) AS m FROM (SELECT w, l1, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM bu) GROUP BY ALL) GROUP BY ALL),
me AS (SELECT a.w, 'cohesion' AS measure, NULL::VARCHAR AS reference, a.l1 AS category, avg(list_dot_product(a.u, b.u)) AS c FROM bu a JOIN bu b ON a.w = b.w AND a.l1 = b.l1 AND a.paper_id < b.paper_id GROUP BY ALL
UNION ALL SELECT w, 'subcategories', NULL, l1, avg(c) FROM (SELECT a.w, a.l1, a.l2, avg(list_dot_product(a.u, b.u)) AS c FROM bu a JOIN bu b ON a.w = b.w AND a.l2 = b.l2 AND a.paper_id < b.paper_id GROUP BY ALL) GROUP BY ALL
UNION ALL SELECT a.w, 'centroid', b.l1, a.l1, list_dot_product(a.m, b.m) / sqrt(list_dot_product(a.m, a.m) * list_dot_product(b.m, b.m)) FROM mv a JOIN mv b ON a.w = b.w AND b.l1 IN ('C0', 'C1')
UNION ALL SELECT a.w, 'separation', b.l1, a.l1, avg(list_dot_product(a.u, b.u)) FROM bu a JOIN bu b ON a.w = b.w AND a.paper_id <> b.paper_id AND b.l1 IN ('C0', 'C1') GROUP BY ALL)
SELECT a.measure, a.reference, a.category, round(a.c, 6) AS before, round(b.c, 6) AS after, round(b.c - a.c, 6) AS difference FROM me a JOIN me b ON a.w = 0 AND b.w = 1 AND a.measure = b.measure AND a.reference IS NOT DISTINCT FROM b.reference AND a.category = b.category""")(lambda t: rounded(V.compare_measures(t.emb.filter("paper_id % 11 <> 0"), shifted(t), t.papers, ["C0", "C1"])))
query("m2_grid_of_decays", ", g AS (SELECT 4 * i + j AS combination_idx, 0.5 * i AS rate, pow(10::DOUBLE, j - 2) AS scale FROM range(3) a(i), range(4) b(j)), d AS (SELECT user_id, paper_id, (max(t) OVER (PARTITION BY user_id) - t) / 86400000000 AS d FROM sess) SELECT combination_idx::BIGINT AS combination_idx, round(rate, 6)::DOUBLE AS rate, round(scale, 6) AS scale, round(avg(exp(-rate * scale * d)), 6) AS weight FROM g CROSS JOIN d GROUP BY ALL")(lambda t: rounded(H.mean_decay(t.sess, M.hyperparameter_grid(t.spark, rate="linspace(0, 1, 3)", scale="logspace(-2, 1, 4)"))))
