"""The library's queries over the given tables, and the same results in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..functions.blocks import shared_path
from ..functions.blocks import written as written_once
from ..operators import prepare as P
from ..operators import reports as R
from ..operators import sampling as S
from ..operators import scoring as M
from ..operators import splits as X
from ..operators import weights as W
from ..sources import tables as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SEED = 42
RATIOS = [("C0", 0.25), ("C1", 0.2), ("C2", 0.15), ("C3", 0.1), ("C4", 0.1), ("C5", 0.08), ("C6", 0.05), ("C7", 0.04), ("C8", 0.02), ("C9", 0.01)]
STOP = ["the", "of", "and", "in", "to", "et", "de", "la", "et al"]

BASE = """WITH papers AS (SELECT vec_id AS paper_id, vec_id % 4 = 0 AS in_cache, CASE WHEN vec_id % 17 <> 0 THEN 'C' || label END AS l1, CASE WHEN vec_id % 17 <> 0 THEN 'C' || label || '.' || (vec_id % 3) END AS l2 FROM embeddings),
emb AS (SELECT vec_id AS paper_id, embedding::DOUBLE[] AS v FROM embeddings),
votes AS (SELECT user_id, event_id % (SELECT count(*) FROM embeddings) AS paper_id, CASE WHEN event_type IN ('click', 'purchase') THEN 1 WHEN event_type IN ('error', 'signup') THEN 0 ELSE 2 END AS rating, epoch_us(ts) // 1000 * 1000 AS t FROM events WHERE ts IS NOT NULL),
cat AS (SELECT v.* FROM votes v JOIN papers p USING (paper_id) WHERE l1 IS NOT NULL AND l2 IS NOT NULL),
s0 AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 25200000000 THEN 0 ELSE 1 END AS new FROM cat WHERE rating < 2 WINDOW w AS (PARTITION BY user_id ORDER BY t, paper_id)),
sess AS (SELECT user_id, paper_id, rating, t, (sum(new) OVER (PARTITION BY user_id ORDER BY t, paper_id ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS session_id FROM s0),
near AS (SELECT n.user_id, n.paper_id, n.rating, n.t, s.session_id, row_number() OVER (PARTITION BY n.user_id, n.paper_id, n.t ORDER BY abs(s.t - n.t), s.t, s.session_id) AS i FROM cat n JOIN sess s USING (user_id) WHERE n.rating = 2 AND abs(s.t - n.t) <= 25200000000),
every AS (SELECT * FROM sess UNION ALL SELECT user_id, paper_id, rating, t, session_id FROM near WHERE i = 1),
rat AS (SELECT *, (count(*) FILTER (rating = 0) OVER (PARTITION BY user_id ORDER BY session_id RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS n_negrated_still_to_come,
  (count(*) FILTER (rating = 1) OVER (PARTITION BY user_id ORDER BY session_id RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT AS n_posrated_came_before FROM every),
byses AS (SELECT user_id, session_id, count(*) FILTER (rating = 1) AS p, count(*) FILTER (rating = 0) AS q FROM sess GROUP BY ALL),
cand AS (SELECT c.user_id, c.cut, sum(b.p) FILTER (b.session_id < cut) AS p0, sum(b.q) FILTER (b.session_id < cut) AS q0, sum(b.p) FILTER (b.session_id >= cut) AS p1, sum(b.q) FILTER (b.session_id >= cut) AS q1, count(*) AS n
  FROM (SELECT DISTINCT user_id, unnest([session_id, session_id + 1]) AS cut FROM byses) c JOIN byses b USING (user_id) GROUP BY ALL),
best AS (SELECT user_id, cut FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs((p1 + q1) / (p0 + q0 + p1 + q1) - 0.2::DOUBLE), cut DESC) AS i FROM cand WHERE n >= 5 AND p0 >= 8 AND q0 >= 8 AND p1 >= 2 AND q1 >= 2) WHERE i = 1),
split AS (SELECT s.*, CASE WHEN session_id < cut THEN 'train' ELSE 'val' END AS split FROM sess s JOIN best USING (user_id)),
shares AS (SELECT user_id, l1 AS category, n / sum(n) OVER (PARTITION BY user_id) AS proportion FROM (SELECT user_id, l1, count(*) AS n FROM rat JOIN papers USING (paper_id) WHERE rating = 1 GROUP BY ALL)),
signif AS (SELECT user_id, rank, category, proportion FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY proportion DESC, category) AS rank FROM shares) WHERE proportion >= 0.1 AND rank <= 4),
sessions AS (SELECT user_id, session_id, count(*) FILTER (rating = 0) AS n_neg, count(*) FILTER (rating = 1) AS n_pos, count(*) FILTER (rating = 2) AS n_neutral, count(*) FILTER (rating <> 2) AS n_rated, count(*) AS n_all, min(t) AS t_min FROM rat GROUP BY ALL),
ratios(category, ratio) AS (VALUES ('C0', 0.25::DOUBLE), ('C1', 0.2), ('C2', 0.15), ('C3', 0.1), ('C4', 0.1), ('C5', 0.08), ('C6', 0.05), ('C7', 0.04), ('C8', 0.02), ('C9', 0.01)),
quota AS (SELECT category, (whole + (row_number() OVER (ORDER BY cut DESC, md5('42|quota|' || category), category) <= 20 - sum(whole) OVER ())::INT)::BIGINT AS quota FROM (SELECT category, floor(ratio * 20 + 1e-10) AS whole, ratio * 20 - floor(ratio * 20 + 1e-10) > 1e-10 AS cut FROM ratios)),
pool AS (SELECT paper_id, category, rank FROM (SELECT paper_id, l1 AS category, quota, row_number() OVER (PARTITION BY l1 ORDER BY md5('42|paper|' || paper_id), paper_id) AS rank FROM papers JOIN quota ON l1 = category) WHERE rank <= quota),
closest AS (SELECT * FROM (SELECT u.user_id, u.session_id, u.paper_id, u.t, d.paper_id AS neg_paper_id, d.t AS neg_t, d.session_id AS neg_session, row_number() OVER (PARTITION BY u.user_id, u.paper_id, u.t ORDER BY abs(u.t - d.t), d.t, d.paper_id) AS place FROM sess u JOIN sess d USING (user_id) WHERE u.rating = 1 AND d.rating = 0) WHERE place <= 4),
unitv AS (SELECT paper_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM emb),
prof0 AS (SELECT user_id, pos, avg(x) AS m FROM (SELECT user_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM split JOIN emb USING (paper_id) WHERE split = 'train' AND rating = 1) GROUP BY ALL),
prof AS (SELECT user_id, list(m ORDER BY pos) AS profile FROM prof0 GROUP BY user_id),
pred AS (SELECT s.user_id, s.split, s.session_id, s.paper_id, s.t, s.rating AS label, round(list_dot_product(profile, v), 9) AS logit FROM split s JOIN prof USING (user_id) JOIN emb USING (paper_id)),
negs AS (SELECT c.user_id, c.paper_id, c.t, round(list_dot_product(profile, v), 9) AS logit FROM closest c JOIN prof USING (user_id) JOIN emb ON emb.paper_id = c.neg_paper_id),
ranked AS (SELECT p.user_id, p.split, p.session_id, p.paper_id, p.t, p.logit, 1 + count(*) FILTER (n.logit >= p.logit) AS rank FROM pred p LEFT JOIN negs n USING (user_id, paper_id, t) WHERE p.label = 1 GROUP BY ALL),
metr AS (SELECT user_id, split, avg(1 / log2(rank + 1)) AS ndcg, avg(1 / rank) AS mrr, avg((rank = 1)::INT) AS hr1, min(1 / log2(rank + 1)) AS ndcg_min FROM ranked GROUP BY ALL),
res AS (SELECT user_id, CASE split WHEN 'train' THEN 0 ELSE 1 END AS combination_idx, unnest(['ndcg', 'mrr', 'hr1']) AS score, unnest([ndcg, mrr, hr1]) AS value FROM metr)
"""


class Tables:
    """The model's tables, derived from the given ones; each is lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.papers, self.emb = D.papers_of(spark, sf_dir), D.embeddings_of(spark, sf_dir)
        self.raw = D.raw_votes_of(spark, sf_dir)
        self.votes = P.recode_votes(self.raw)

    @property
    def cat(self) -> DataFrame:
        return P.filter_categorised(self.votes, self.papers)

    @property
    def sess(self) -> DataFrame:
        return P.sessionize(self.cat.filter("rating <> 2"))

    @property
    def rat(self) -> DataFrame:
        return P.prepared(self.raw, self.papers)

    @property
    def split(self) -> DataFrame:
        return X.session_split(self.sess, 8, 8, 2, 2, 5, 0.2)

    @property
    def shares(self) -> DataFrame:
        return P.user_category_distribution(P.attach_categories(self.rat, self.papers))

    @property
    def signif(self) -> DataFrame:
        return P.significant_categories(self.shares)

    @property
    def ratios(self) -> DataFrame:
        return self.spark.createDataFrame(RATIOS, "category string, ratio double")

    @property
    def quota(self) -> DataFrame:
        return S.category_quota(self.ratios, 20, SEED)

    @property
    def pool(self) -> DataFrame:
        return S.sample_by_category(self.papers, self.quota, SEED)

    @property
    def user_negs(self) -> DataFrame:
        own = S.user_category_ratios(self.sess, self.ratios, self.signif)
        return S.user_negative_samples(self.pool, S.user_quotas(own, 10, SEED))

    @property
    def samples(self) -> DataFrame:
        return self.scored(self.user_negs.join(self.profiles.select("user_id"), "user_id", "left_semi").select("user_id", "paper_id")).select("user_id", "paper_id", "logit")

    @property
    def closest(self) -> DataFrame:
        return S.closest_negatives(self.sess)

    @cached_property
    def profiles(self) -> DataFrame:
        """One DataFrame, so that a plan that needs it in several places shuffles its sums once."""
        return M.mean_positive_embedding(self.split.filter("split = 'train'"), self.emb)

    def scored(self, pairs: DataFrame) -> DataFrame:
        return M.predict(self.profiles, pairs, self.emb).withColumn("logit", F.round("logit", 9))

    @property
    def pred(self) -> DataFrame:
        return self.scored(self.split.withColumnRenamed("rating", "label").join(self.profiles.select("user_id"), "user_id", "left_semi")).select("user_id", "split", "session_id", "paper_id", "t", "label", "logit")

    @property
    def negs(self) -> DataFrame:
        c = self.closest.select("user_id", F.col("paper_id").alias("pos"), "t", F.col("neg_paper_id").alias("paper_id"))
        return self.scored(c).select("user_id", F.col("pos").alias("paper_id"), "t", "logit")

    @cached_property
    def logits(self) -> DataFrame:
        """user_id, paper_id, logit of what users with a profile have rated: one product for a paper, however many votes and negatives have it."""
        pairs = self.sess.select("user_id", "paper_id").distinct().join(self.profiles.select("user_id"), "user_id", "left_semi")
        return self.scored(pairs).select("user_id", "paper_id", "logit")

    @property
    def ranked(self) -> DataFrame:
        ups = self.split.filter("rating = 1").select("user_id", "split", "session_id", "paper_id", "t").join(self.logits, ["user_id", "paper_id"])
        downs = self.closest.select("user_id", F.col("paper_id").alias("pos"), "t", F.col("neg_paper_id").alias("paper_id")).join(self.logits, ["user_id", "paper_id"])
        return M.rank_positives(ups.select("user_id", "split", "session_id", "paper_id", "t", "logit"), downs.select("user_id", F.col("pos").alias("paper_id"), "t", "logit"), ["user_id", "paper_id", "t"])

    @property
    def res(self) -> DataFrame:
        m = M.ranking_metrics(self.ranked, ["user_id", "split"])
        return m.unpivot(["user_id", "split"], ["ndcg", "mrr", "hr1"], "score", "value").select("user_id", F.when(F.col("split") == "train", 0).otherwise(1).alias("combination_idx"), "score", "value")

    def runs(self, score: str) -> list[DataFrame]:
        """Rows of the score (rounded to 9 digits) of combinations 0 and 1, which take the place of two runs. Written once, as comparisons read them several times."""
        rows = written_once(self.res.filter(F.col("score") == score).withColumn("value", F.round("value", 9)))
        return [rows.filter(F.col("combination_idx") == i) for i in (0, 1)]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = BASE + sql
        return f

    return add


def by_rating(k: int) -> str:
    return f"count(*) FILTER (rating = {k})"


query("s2_check_ratings", "SELECT count(*) AS n_rows, count(*) FILTER (user_id IS NULL) AS null_user_id, count(*) FILTER (paper_id IS NULL) AS null_paper_id, count(*) FILTER (rating IS NULL) AS null_rating, count(*) FILTER (t IS NULL) AS null_t, count(*) FILTER (session_id IS NULL) AS null_session_id, count(*) FILTER (session_id < p) AS n_back FROM (SELECT *, lag(session_id) OVER (PARTITION BY user_id ORDER BY t, paper_id) AS p FROM rat)")(lambda t: D.check_ratings(t.rat))
query("s2_check_papers", "SELECT sum(n)::BIGINT AS n_rows, count(*) FILTER (n > 1) AS n_repeated, 0::BIGINT AS n_no_flag, 0::BIGINT AS n_half FROM (SELECT paper_id, count(*) AS n FROM papers GROUP BY 1)")(lambda t: D.check_papers(t.papers))
query("s2_check_categories", "SELECT count(*) AS n_users, count(*) FILTER (n > 4) AS n_too_many, count(*) FILTER (p < 0.1) AS n_too_small FROM (SELECT user_id, count(*) AS n, min(proportion) AS p FROM signif GROUP BY 1)")(lambda t: D.check_categories(t.signif))
query("s3_papers_texts", "SELECT doc_id AS paper_id, string_split(text, chr(10))[1] AS title, source AS authors FROM documents")(lambda t: D.texts_of(t.spark, t.dir).select("paper_id", "title", "authors"))
query("s7_embeddings", "SELECT paper_id, len(v) AS width, round(v[1], 6) AS first FROM emb")(lambda t: t.emb.select("paper_id", F.size("embedding").alias("width"), F.round(F.element_at("embedding", 1), 6).alias("first")))
query("f1_recode_votes", "SELECT * FROM votes")(lambda t: t.votes)
query("f2_filter_categorised", "SELECT * FROM cat")(lambda t: t.cat.select("user_id", "paper_id", "rating", "t"))
query("f3_min_votes", f"SELECT * FROM sess WHERE user_id IN (SELECT user_id FROM sess GROUP BY 1 HAVING {by_rating(1)} >= 20 AND {by_rating(0)} >= 20 AND count(DISTINCT session_id) >= 5)")(lambda t: P.filter_users_min_votes(t.sess, 20, 20, 5).select("user_id", "paper_id", "rating", "t", "session_id"))
query("f4_activity", "SELECT DISTINCT user_id FROM sess GROUP BY 1 HAVING count(DISTINCT session_id) >= 30 AND (max(t) - min(t)) // 86400000000 >= 28")(lambda t: P.filter_users_activity(t.sess, 30, 28).select("user_id").distinct())
query("f5_head_tail", "SELECT user_id, paper_id, t, CASE WHEN n_negrated_still_to_come >= 4 THEN 'head' ELSE 'tail' END AS part FROM rat")(lambda t: P.split_head_tail(t.rat).select("user_id", "paper_id", "t", "part"))
query("f6_first_split", f"SELECT DISTINCT user_id FROM split GROUP BY user_id HAVING count(*) FILTER (split = 'train' AND rating = 1) <= 40 AND count(*) FILTER (split = 'train' AND rating = 0) >= 8 AND count(*) FILTER (split = 'val' AND rating = 1) >= 3 AND count(*) FILTER (split = 'val' AND rating = 0) >= 3 AND count(DISTINCT session_id) FILTER (split = 'val' AND rating = 1) >= 2")(lambda t: X.filter_users_first_split(t.split, 40, 8, 3, 3, 2).select("user_id").distinct())
query("f7_not_in_category", "SELECT user_id FROM signif WHERE rank = 1 AND category <> 'C0'")(lambda t: P.users_not_in_category(t.signif, "C0"))
query("f9_outcome", "SELECT user_id, paper_id, t, CASE WHEN logit >= 0 AND label = 1 THEN 'TP' WHEN logit >= 0 THEN 'FP' WHEN label = 1 THEN 'FN' ELSE 'TN' END AS outcome FROM pred")(lambda t: t.pred.withColumn("proba", V.sigmoid("logit")).select("user_id", "paper_id", "t", M.classification_outcome().alias("outcome")))
query("j1_flag_membership", "SELECT paper_id, in_cache, paper_id IN (SELECT paper_id FROM votes WHERE rating <> 2) AS in_ratings FROM papers")(lambda t: P.flag_membership(t.papers, t.votes).select("paper_id", "in_cache", "in_ratings"))
query("j2_complete_categories", "SELECT DISTINCT v.paper_id, l1, l2 FROM votes v LEFT JOIN papers p ON v.paper_id = p.paper_id AND l1 IS NOT NULL")(lambda t: P.complete_categories(t.votes.select("paper_id").distinct(), t.papers.filter("l1 IS NOT NULL").select("paper_id", "l1", "l2")))
query("j3_attach_categories", "SELECT v.*, l1, l2 FROM votes v LEFT JOIN papers USING (paper_id)")(lambda t: P.attach_categories(t.votes, t.papers))
query("j4_neutral_sessions", "SELECT * FROM every")(lambda t: P.assign_neutral_to_sessions(t.sess, t.cat.filter("rating = 2")))
query("j5_closest_negatives", "SELECT user_id, paper_id, t, neg_paper_id, place FROM closest")(lambda t: t.closest.select("user_id", "paper_id", "t", "neg_paper_id", "place"))
query("j5_closest_negatives_causal", "SELECT * FROM (SELECT u.user_id, u.paper_id, u.t, d.paper_id AS neg_paper_id, row_number() OVER (PARTITION BY u.user_id, u.paper_id, u.t ORDER BY abs(u.t - d.t), d.t, d.paper_id) AS place FROM sess u JOIN sess d USING (user_id) WHERE u.rating = 1 AND d.rating = 0 AND d.session_id >= u.session_id) WHERE place <= 4")(lambda t: S.closest_negatives(t.sess, 4, True).select("user_id", "paper_id", "t", "neg_paper_id", "place"))
query("j7_user_cache", "SELECT u.user_id, c.paper_id FROM (SELECT DISTINCT user_id FROM sess) u CROSS JOIN (SELECT paper_id FROM papers WHERE in_cache ORDER BY md5('42|cache|' || paper_id), paper_id LIMIT 50) c WHERE (u.user_id, c.paper_id) NOT IN (SELECT user_id, paper_id FROM sess)")(lambda t: S.user_cache(t.sess, S.cache_papers(t.papers, 50, SEED), t.sess))
query("j8_missing_embeddings", "SELECT DISTINCT doc_id AS paper_id FROM documents WHERE doc_id NOT IN (SELECT paper_id FROM emb)")(lambda t: S.missing_embeddings(D.texts_of(t.spark, t.dir), t.emb))
query("j9_remap_users", "SELECT user_id, row_number() OVER (ORDER BY md5('42|remap|' || user_id), user_id) - 1 AS new_id FROM (SELECT DISTINCT user_id FROM votes)")(lambda t: X.remap_users(t.votes, SEED))
query("j10_index_categories", "SELECT paper_id, CASE WHEN l1 IS NULL THEN 0 ELSE dense_rank() OVER (ORDER BY l1 NULLS LAST) END AS l1_idx FROM papers")(lambda t: P.index_categories(t.papers))
query("j11_attach_embeddings", "SELECT user_id, count(*) AS n, round(sum(v[1]), 6) AS s FROM sess JOIN emb USING (paper_id) GROUP BY 1")(lambda t: t.sess.join(t.emb, "paper_id").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum(F.element_at("embedding", 1)), 6).alias("s")))
query("a1_user_info", f"SELECT user_id, {by_rating(1)} AS n_posrated, {by_rating(0)} AS n_negrated, count(DISTINCT session_id) AS n_sessions, count(DISTINCT session_id) FILTER (rating = 1) AS n_sessions_pos, ((max(t) - min(t)) // 86400000000)::BIGINT AS time_range_days FROM rat GROUP BY 1")(lambda t: P.user_info(t.rat))
SPLIT_INFO = "SELECT user_id, " + ", ".join(f"count(*) FILTER (split = '{s}' AND rating = 1) AS {s}_n_pos, count(*) FILTER (split = '{s}' AND rating = 0) AS {s}_n_neg, count(DISTINCT session_id) FILTER (split = '{s}') AS {s}_n_sessions, ((max(t) FILTER (split = '{s}' AND rating = 1) - min(t) FILTER (split = '{s}' AND rating = 1)) // 86400000000)::BIGINT AS {s}_days_pos" for s in ("train", "val")) + ", round(count(*) FILTER (split = 'train') / count(*), 6) AS train_rated_ratio FROM split GROUP BY 1"
query("a2_user_info_by_split", SPLIT_INFO)(lambda t: P.user_info_by_split(t.split))
query("a3_category_matrix", "SELECT user_id, " + ", ".join(f"round(coalesce(max(proportion) FILTER (category = 'C{i}'), 0), 6) AS C{i}" for i in range(10)) + " FROM shares GROUP BY 1")(lambda t: rounded(P.category_matrix(t.shares, [f"C{i}" for i in range(10)])))
query("a4_significant_categories", "SELECT user_id, rank::INT AS rank, category, round(proportion, 6) AS proportion FROM signif")(lambda t: rounded(t.signif))
query("a5_session_table", "SELECT * FROM sessions")(lambda t: P.session_table(t.rat))
query("a6_session_days", "SELECT user_id, session_id, (t_min - min(t_min) OVER (PARTITION BY user_id)) // 86400000000 AS days_passed FROM sessions")(lambda t: P.session_days_passed(P.session_table(t.rat)).select("user_id", "session_id", "days_passed"))
query("a7_category_distribution", "SELECT l1, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM papers GROUP BY 1")(lambda t: P.category_distribution(t.papers))
query("a8_top_categories", "SELECT * FROM (SELECT user_id, category, round(proportion, 6) AS proportion, (row_number() OVER (PARTITION BY user_id ORDER BY proportion DESC, category))::INT AS rank FROM shares) WHERE rank <= 3")(lambda t: rounded(P.user_top_categories(t.shares)))
query("a9_over_folds", "SELECT user_id, score, round(avg(value), 6) AS value, round(stddev_pop(value), 6) AS std FROM res GROUP BY ALL")(lambda t: rounded(R.average_over_folds(t.res.withColumn("combination_idx", F.lit(0))).drop("combination_idx")))
query("a10_over_users", "SELECT combination_idx, score, round(avg(value), 6) AS value, round(stddev_samp(value), 6) AS std FROM res GROUP BY ALL")(lambda t: rounded(R.average_over_users(t.res)))
query("a10_median_over_users", "SELECT combination_idx, score, round(median(value), 6) AS value, round(stddev_samp(value), 6) AS std FROM res GROUP BY ALL")(lambda t: rounded(R.average_over_users(t.res, True)))
query("a11_over_seeds", "SELECT user_id, combination_idx, score, round(avg(value), 9) AS value, round(stddev_pop(value), 9) AS std FROM (SELECT * FROM res UNION ALL SELECT user_id, combination_idx, score, value / 2 FROM res) GROUP BY ALL")(lambda t: rounded(R.average_over_seeds([t.res, t.res.withColumn("value", F.col("value") / 2)]), 9))
query("a12_extreme_users", "SELECT combination_idx, score, round(avg(value), 6) AS value, round(stddev_samp(value), 6) AS std FROM (SELECT *, row_number() OVER (PARTITION BY combination_idx, score ORDER BY value, user_id) AS i FROM res) WHERE i <= 10 GROUP BY ALL")(lambda t: rounded(R.average_extreme_users(t.res, 10)))
INFO = ["n_posrated", "n_negrated", "n_sessions"]
query("a13_info_summary", ", info AS (SELECT user_id, count(*) FILTER (rating = 1) AS n_posrated, count(*) FILTER (rating = 0) AS n_negrated, count(DISTINCT session_id) AS n_sessions FROM rat GROUP BY 1) SELECT statistic, min(value)::DOUBLE AS low, max(value)::DOUBLE AS high, median(value) AS median, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM (UNPIVOT info ON n_posrated, n_negrated, n_sessions INTO NAME statistic VALUE value) GROUP BY 1")(lambda t: rounded(R.users_info_summary(P.user_info(t.rat), INFO)))
query("a14_group_scores", ", g AS (SELECT DISTINCT user_id, CASE WHEN user_id % 3 = 0 THEN 'a' ELSE 'b' END AS g FROM votes UNION ALL SELECT DISTINCT user_id, 'all' FROM res WHERE combination_idx = 1), n AS (SELECT unnest(['a', 'b', 'none', 'all']) AS g, unnest([['ndcg', 'mrr', 'hr1'], ['ndcg', 'mrr', 'hr1'], ['ndcg', 'mrr', 'hr1'], ['ndcg', 'mrr', 'hr1']]) AS scores), w AS (SELECT g, unnest(scores) AS score FROM n) SELECT w.g AS \"group\", w.score, round(avg(value), 6) AS value, round(stddev_samp(value), 6) AS std, round(median(value), 6) AS median, count(value) AS n FROM w LEFT JOIN (SELECT g.g, r.score, r.value FROM g JOIN res r USING (user_id) WHERE combination_idx = 1) x ON w.g = x.g AND w.score = x.score GROUP BY 1, 2")(lambda t: rounded(R.group_score_table(t.res.filter("combination_idx = 1"), t.votes.select("user_id", F.when(F.col("user_id") % 3 == 0, "a").otherwise("b").alias("group")).distinct(), ["a", "b", "none"])))
query("a18_correlation", "SELECT round(corr(n_neg, n_pos), 6) AS r, round(regr_slope(n_pos, n_neg), 6) AS slope, round(regr_intercept(n_pos, n_neg), 6) AS intercept FROM sessions")(lambda t: rounded(R.metric_correlation(P.session_table(t.rat), "n_neg", "n_pos")))
query("w1_sessionize", "SELECT * FROM sess")(lambda t: t.sess.select("user_id", "paper_id", "rating", "t", "session_id"))
query("w2_w3_counters", "SELECT * FROM rat")(lambda t: t.rat)
query("w4_cumulative", "SELECT user_id, session_id, (sum(n_pos) OVER w)::BIGINT AS n_pos_cum, (sum(n_rated) OVER w)::BIGINT AS n_rated_cum FROM sessions WINDOW w AS (PARTITION BY user_id ORDER BY session_id ROWS UNBOUNDED PRECEDING)")(lambda t: P.cumulative_votes(P.session_table(t.rat)).select("user_id", "session_id", "n_pos_cum", "n_rated_cum"))
query("w5_session_split", "SELECT * FROM split")(lambda t: t.split.select("user_id", "paper_id", "rating", "t", "session_id", "split"))
query("w6_sequence_split", "SELECT user_id, paper_id, t, split FROM (SELECT *, max((split = 'val' AND rating = 1)::INT) OVER (PARTITION BY user_id) AS has FROM (SELECT *, CASE WHEN session_id >= 1 AND n_posrated_came_before >= 3 THEN 'val' ELSE 'train' END AS split FROM rat)) WHERE has = 1")(lambda t: X.sequence_train_split(t.rat).select("user_id", "paper_id", "t", "split"))
query("w8_temporal_windows", ", x AS (SELECT user_id, session_id, n_pos::DOUBLE AS v FROM sessions), p AS (SELECT i, user_id, avg(v) AS v FROM x, range(0, (SELECT max(session_id) + 1 FROM x)) r(i) WHERE abs(i - session_id) <= 2 GROUP BY ALL) SELECT i, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, count(*) AS n_users FROM p GROUP BY 1")(lambda t: rounded(R.temporal_windows(P.session_table(t.rat), "session_id", 2, "n_pos")))
query("w10_mid_session", "SELECT user_id, max(session_id) FILTER (t_min <= mid) AS mid_session FROM (SELECT *, (min(t_min) OVER w + max(t_min) OVER w) / 2 AS mid FROM sessions WINDOW w AS (PARTITION BY user_id)) GROUP BY 1")(lambda t: P.mid_time_session(P.session_table(t.rat)))
query("w11_collapse_val", "SELECT user_id, paper_id, t, session_id AS old_session_id, CASE WHEN split = 'val' THEN min(session_id) FILTER (split = 'val') OVER (PARTITION BY user_id) ELSE session_id END AS session_id FROM split")(lambda t: X.collapse_val_sessions(t.split).select("user_id", "paper_id", "t", "old_session_id", "session_id"))
query("w12_first_vs_others", "SELECT round(avg(a), 6) AS first, round(avg(b), 6) AS others, count(b) AS n_users FROM (SELECT user_id, avg(n_pos) FILTER (session_id = 0) AS a, avg(n_pos) FILTER (session_id > 0) AS b FROM sessions GROUP BY 1)")(lambda t: rounded(R.first_vs_other_sessions(P.session_table(t.rat), "n_pos")))
query("w13_val_offset", "SELECT user_id, paper_id, t, session_id - cut AS \"offset\" FROM (SELECT *, min(session_id) OVER (PARTITION BY user_id) AS cut FROM split WHERE split = 'val')")(lambda t: X.val_session_offset(t.split).select("user_id", "paper_id", "t", "offset"))
query("t1_val_sessions", "SELECT user_id, count(DISTINCT session_id) FILTER (split = 'val' AND rating = 1) AS n_val_sessions FROM split GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")(lambda t: X.users_by_val_sessions(t.split, 20))
query("t3_best_combinations", "SELECT combination_idx, score, round(avg(value), 6) AS value FROM res WHERE score = 'ndcg' GROUP BY ALL ORDER BY value DESC, combination_idx LIMIT 1")(lambda t: rounded(R.best_combinations(R.average_over_users(t.res), "ndcg").drop("std")))
query("t4_best_per_user", "SELECT user_id, combination_idx, score, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(value, 9) DESC, combination_idx) AS i FROM res WHERE score = 'ndcg') WHERE i = 1")(lambda t: rounded(R.best_combination_per_user(t.res.withColumn("value", F.round("value", 9)), "ndcg")))
query("t5_gain", ", r AS (SELECT user_id, combination_idx, round(value, 9) AS value FROM res WHERE score = 'ndcg') SELECT a.user_id, round(own, 6) AS own, round(value, 6) AS overall, round(own - value, 6) AS gain FROM (SELECT user_id, max(value) AS own FROM r GROUP BY 1) a JOIN r b ON a.user_id = b.user_id AND b.combination_idx = 1 ORDER BY own - value DESC, a.user_id LIMIT 10")(lambda t: rounded(R.performance_gain(t.res.withColumn("value", F.round("value", 9)), "ndcg", 1, 10)))
query("t6_compare_runs", ", r AS (SELECT a.user_id, round(b.value, 9) AS new, round(a.value, 9) AS old, round(b.value, 9) - round(a.value, 9) AS diff FROM res a JOIN res b ON a.user_id = b.user_id AND a.combination_idx = 0 AND b.combination_idx = 1 AND a.score = 'mrr' AND b.score = 'mrr'), k AS ((SELECT *, 'best' AS side FROM r ORDER BY diff DESC, user_id LIMIT 5) UNION ALL (SELECT *, 'worst' AS side FROM r ORDER BY diff, user_id LIMIT 5)) SELECT user_id, round(new, 6) AS new, round(old, 6) AS old, round(diff, 6) AS diff, side FROM k")(lambda t: rounded(R.compare_runs(*t.runs("mrr"), "mrr", 5)))
query("x1_partition_users", "SELECT user_id, CASE WHEN i IS NULL THEN 'train' WHEN i <= 10 THEN 'test' ELSE 'val' END AS selection FROM (SELECT DISTINCT user_id FROM sess) LEFT JOIN (SELECT user_id, row_number() OVER (ORDER BY md5('42|users|' || user_id), user_id) AS i FROM best) USING (user_id)")(lambda t: X.partition_users(t.split, t.sess, 10, SEED))
query("x3_category_quota", ", r AS (SELECT l1 AS category, count(*)::DOUBLE / sum(count(*)) OVER () AS ratio FROM papers WHERE l1 IS NOT NULL GROUP BY 1) SELECT category, (whole + (row_number() OVER (ORDER BY cut DESC, md5('42|quota|' || category), category) <= 97 - sum(whole) OVER ())::INT)::BIGINT AS quota FROM (SELECT category, floor(ratio * 97 + 1e-10) AS whole, ratio * 97 - floor(ratio * 97 + 1e-10) > 1e-10 AS cut FROM r)")(lambda t: S.category_quota(P.category_distribution(t.papers.filter("l1 IS NOT NULL")).select(F.col("l1").alias("category"), F.col("share").alias("ratio")), 97, SEED))
query("x4_sample_by_category", "SELECT paper_id, category, rank::INT AS rank FROM pool")(lambda t: t.pool)
query("x5_user_ratios", "SELECT user_id, category, round(ratio / sum(ratio) OVER (PARTITION BY user_id), 6) AS ratio FROM (SELECT DISTINCT user_id FROM sess) CROSS JOIN ratios WHERE (user_id, category) NOT IN (SELECT user_id, category FROM signif)")(lambda t: rounded(S.user_category_ratios(t.sess, t.ratios, t.signif)))
UQUOTA = """, uratio AS (SELECT user_id, category, ratio / sum(ratio) OVER (PARTITION BY user_id) AS ratio FROM (SELECT DISTINCT user_id FROM sess) CROSS JOIN ratios WHERE (user_id, category) NOT IN (SELECT (user_id, category) FROM signif)),
uquota AS (SELECT user_id, category, (whole + (row_number() OVER (PARTITION BY user_id ORDER BY cut DESC, md5('42|quota|' || user_id || '|' || category), category) <= 10 - sum(whole) OVER (PARTITION BY user_id))::INT)::BIGINT AS quota FROM (SELECT user_id, category, floor(ratio * 10 + 1e-10) AS whole, ratio * 10 - floor(ratio * 10 + 1e-10) > 1e-10 AS cut FROM uratio)),
usamp AS (SELECT user_id, paper_id, pool.category FROM uquota JOIN pool ON pool.category = uquota.category AND rank <= quota),
slog AS (SELECT user_id, paper_id, round(list_dot_product(profile, v), 9) AS logit FROM usamp JOIN prof USING (user_id) JOIN emb USING (paper_id)),
rkind AS (SELECT r.user_id, r.paper_id, r.t, r.logit, r.rank AS rank_explicit, 1 + count(*) FILTER (s.logit >= r.logit) AS rank_samples FROM ranked r LEFT JOIN slog s USING (user_id) GROUP BY ALL)"""
query("x6_user_negatives", UQUOTA + " SELECT user_id, paper_id, category FROM usamp")(lambda t: t.user_negs)
query("x7_cache_papers", "SELECT paper_id FROM papers WHERE in_cache ORDER BY md5('42|cache|' || paper_id), paper_id LIMIT 50")(lambda t: S.cache_papers(t.papers, 50, SEED))
query("x9_random_negatives", "SELECT * FROM (SELECT user_id, paper_id, t, (row_number() OVER (PARTITION BY user_id ORDER BY md5('42|neg|' || user_id || '|' || paper_id || '|' || t), paper_id, t))::INT AS place FROM sess WHERE rating = 0) WHERE place <= 4")(lambda t: S.random_negatives(t.sess, 4, SEED))
query("x10_relevant_papers", "SELECT paper_id FROM sess UNION SELECT paper_id FROM pool")(lambda t: S.relevant_papers(t.sess, t.pool))
query("x12_random_split", "SELECT user_id, paper_id, t, CASE WHEN row_number() OVER (PARTITION BY user_id, rating ORDER BY md5('42|split|' || user_id || '|' || paper_id || '|' || t), paper_id, t) <= round(count(*) OVER (PARTITION BY user_id, rating) * 0.2::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM sess")(lambda t: X.random_split(t.sess, 0.2, SEED).select("user_id", "paper_id", "t", "split"))
query("x13_kfold", "SELECT user_id, paper_id, t, ((row_number() OVER (PARTITION BY user_id, rating ORDER BY md5('42|fold|' || user_id || '|' || paper_id || '|' || t), paper_id, t) - 1) % 5)::INT AS fold_idx FROM sess")(lambda t: X.kfold(t.sess, 5, SEED).select("user_id", "paper_id", "t", "fold_idx"))
query("x14_sampling_weights", "SELECT user_id, round(w / sum(w) OVER (), 6) AS weight FROM (SELECT user_id, sqrt(count(*)) AS w FROM sess GROUP BY 1)")(lambda t: rounded(S.user_sampling_weights(t.sess, 0.5)))
query("x19_append_removed", "SELECT user_id, paper_id, t, split FROM split UNION ALL SELECT user_id, paper_id, t, 'removed' FROM rat WHERE n_negrated_still_to_come < 4 AND user_id IN (SELECT user_id FROM best)")(lambda t: X.append_removed(t.split.select("user_id", "paper_id", "t", "split"), P.split_head_tail(t.rat).filter("part = 'tail'")))
query("v1_l2_normalize", "SELECT paper_id, round(list_dot_product(u, u), 6) AS length, round(u[1], 6) AS first FROM unitv")(lambda t: t.emb.withColumn("u", V.l2_normalize("embedding")).select("paper_id", F.round(V.dot("u", "u"), 6).alias("length"), F.round(F.element_at("u", 1), 6).alias("first")))
query("v4_mean_pairwise_cosine", "SELECT a.user_id, round(avg(list_dot_product(x.u, y.u)), 6) AS cosine FROM (SELECT user_id, paper_id, row_number() OVER (PARTITION BY user_id ORDER BY t, paper_id) AS i FROM split WHERE rating = 1) a JOIN (SELECT user_id, paper_id, row_number() OVER (PARTITION BY user_id ORDER BY t, paper_id) AS i FROM split WHERE rating = 1) b ON a.user_id = b.user_id AND a.i < b.i JOIN unitv x ON x.paper_id = a.paper_id JOIN unitv y ON y.paper_id = b.paper_id GROUP BY 1")(lambda t: rounded(V.mean_pairwise_cosine(t.split.filter("rating = 1").join(t.emb, "paper_id"), ["user_id"], "embedding").select("user_id", "cosine")))
query("v5_decay", "SELECT user_id, session_id, round(exp(-0.01 * ((t_min - min(t_min) OVER (PARTITION BY user_id)) // 86400000000)), 6) AS weight FROM sessions")(lambda t: P.session_days_passed(P.session_table(t.rat)).select("user_id", "session_id", F.round(V.temporal_decay("days_passed", 0.01), 6).alias("weight")))
query("v8_compose_text", "SELECT doc_id AS paper_id, md5('Title: ' || string_split(text, chr(10))[1] || ' Abstract: ' || text) AS digest FROM documents")(lambda t: D.texts_of(t.spark, t.dir).select("paper_id", F.md5(T.compose_text("title", "abstract", "labelled")).alias("digest")))
query("v9_mask_latex", "SELECT doc_id AS paper_id, md5(regexp_replace('a $x$ ' || text, '\\$[^$\\n]*\\$', 'LATEX_CODE', 'g')) AS digest FROM documents")(lambda t: D.texts_of(t.spark, t.dir).select("paper_id", F.md5(T.mask_latex(F.concat(F.lit("a $x$ "), "abstract"))).alias("digest")))
TFIDF = ", tok AS (SELECT doc_id AS paper_id, list_filter(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z_][a-z0-9_]+') AND w NOT IN ('the', 'of', 'and', 'in', 'to', 'et', 'de', 'la', 'et al')) AS w FROM documents), tc AS (SELECT paper_id, term, count(*) AS tf FROM (SELECT paper_id, unnest(w) AS term FROM tok UNION ALL SELECT paper_id, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2])) FROM tok WHERE len(w) > 1) GROUP BY ALL), voc AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS total, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tc GROUP BY 1 HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 500)"
query("e1_fit_tfidf", TFIDF + " SELECT term, df, total, round(idf, 6) AS idf FROM voc")(lambda t: rounded(T.fit_tfidf(T.term_counts(D.texts_of(t.spark, t.dir), "abstract", STOP), D.texts_of(t.spark, t.dir), 500, 2)))
query("e2_transform_tfidf", TFIDF + ", x AS (SELECT paper_id, term, (1 + ln(tf)) * idf AS w FROM tc JOIN voc USING (term)) SELECT paper_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY paper_id)), 6) AS weight FROM x")(lambda t: rounded((lambda c: T.transform_tfidf(c, T.fit_tfidf(T.by_term(c), D.texts_of(t.spark, t.dir), 500, 2)))(T.count_terms(D.texts_of(t.spark, t.dir), "abstract", STOP))))
query("e6_override", "SELECT paper_id, round(CASE WHEN paper_id % 2 = 0 THEN 2 * v[1] ELSE v[1] END, 6) AS first FROM emb")(lambda t: V.override_embeddings(t.emb, t.emb.filter("paper_id % 2 = 0").withColumn("embedding", F.transform("embedding", lambda x: x * 2))).select("paper_id", F.round(F.element_at("embedding", 1), 6).alias("first")))
query("e8_standardize", ", f AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM emb WHERE paper_id % 4 = 0) GROUP BY 1) SELECT paper_id, round(sum((x - m) / s), 3) AS total FROM (SELECT paper_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM emb) JOIN f USING (pos) GROUP BY 1")(lambda t: V.standardize(t.emb, t.emb.filter("paper_id % 4 = 0"), "embedding").select("paper_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 3).alias("total")))
query("e10_centroids", ", m AS (SELECT l1, list(x ORDER BY pos) AS m, max(n) AS n FROM (SELECT l1, pos, avg(x) AS x, count(*) AS n FROM (SELECT l1, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM emb JOIN papers USING (paper_id) WHERE l1 IS NOT NULL) GROUP BY ALL) GROUP BY 1) SELECT a.l1, a.n, round(sqrt(list_dot_product(a.m, a.m)), 6) AS length, round(list_dot_product(a.m, b.m) / sqrt(list_dot_product(a.m, a.m)) / sqrt(list_dot_product(b.m, b.m)), 6) AS cosine FROM m a JOIN m b ON b.l1 = 'C0'")(lambda t: rounded(V.category_centroids(t.emb, t.papers, "C0")))
query("e11_cohesion", "SELECT p.l1, count(DISTINCT p.paper_id) + 1 AS n, round(avg(list_dot_product(x.u, y.u)), 6) AS cosine FROM papers p JOIN papers q ON p.l1 = q.l1 AND p.paper_id < q.paper_id JOIN unitv x ON x.paper_id = p.paper_id JOIN unitv y ON y.paper_id = q.paper_id GROUP BY 1")(lambda t: rounded(V.category_cohesion(t.emb, t.papers)))
query("m2_grid", "SELECT (row_number() OVER () - 1)::BIGINT AS combination_idx, c, neg_weight, n FROM (SELECT c, neg_weight, (SELECT count(*) FROM sess) AS n FROM (VALUES (0.1::DOUBLE), (1.0)) a(c), (VALUES (1.0::DOUBLE), (2.0)) b(neg_weight) ORDER BY 1, 2)")(lambda t: M.hyperparameter_grid(t.spark, c=[0.1, 1.0], neg_weight=[1.0, 2.0]).crossJoin(F.broadcast(t.sess.agg(F.count("*").alias("n")))))
CACHE = 50


def fits(t: Tables, by: list[str], votes: DataFrame) -> DataFrame:
    """Weights of each user's votes (by fold too) and the shared cache, for a grid of two combinations."""
    grid = M.hyperparameter_grid(t.spark, c=[0.1, 1.0], v=[0.7]).withColumn("combination_idx", F.col("combination_idx").cast("int"))
    counts = votes.groupBy(*by).agg(F.count_if(F.col("rating") == 1).alias("n_pos"), F.count_if(F.col("rating") == 0).alias("n_neg"), F.lit(CACHE).cast("long").alias("n_cache"))
    return W.class_weights(counts.crossJoin(F.broadcast(grid)), "cache_v", F.col("v"), 2.0)


def trained(t: Tables) -> DataFrame:
    votes = t.split.filter("split = 'train'")
    return M.train_user_models(votes, t.emb, fits(t, ["user_id"], votes), S.cache_papers(t.papers, CACHE, SEED))


def trained_by_fold(t: Tables) -> DataFrame:
    votes = X.fold_splits(X.kfold(t.split, 3, SEED).drop("split"), 3).filter("split = 'train'").withColumn("fold_idx", F.col("fold_idx").cast("int"))
    return M.train_user_models(votes, t.emb, fits(t, ["user_id", "fold_idx"], votes), S.cache_papers(t.papers, CACHE, SEED), ["user_id", "fold_idx"])


query("m6_user_models")(trained)
query("m6_user_models_by_fold")(trained_by_fold)
query("m15_predict_models", "SELECT s.user_id, split, paper_id, t, round(x, 6) AS logit, round(1 / (1 + exp(-x)), 6) AS proba, (x > 0)::INT AS pred FROM (SELECT s.*, list_dot_product(profile, v) + s.user_id % 7 / 10 - 0.3::DOUBLE AS x FROM split s JOIN prof USING (user_id) JOIN emb USING (paper_id)) s")(lambda t: rounded(M.predict_models(t.profiles.select("user_id", F.col("profile").alias("coef"), (F.col("user_id") % 7 / 10 - 0.3).alias("intercept")), t.split.select("user_id", "split", "paper_id", "t"), t.emb)))
query("v7_sigmoid_predict", "SELECT user_id, paper_id, t, round(1 / (1 + exp(-logit)), 6) AS proba, (logit > 0)::INT AS pred FROM pred")(lambda t: rounded(V.sigmoid_predict(t.pred).select("user_id", "paper_id", "t", "proba", "pred")))
query("v11_epoch_days", "SELECT user_id, paper_id, t, t // 1000000 AS epoch, (t - min(t) OVER (PARTITION BY user_id)) // 86400000000 AS days FROM sess")(lambda t: P.epoch_and_days(t.sess).select("user_id", "paper_id", "t", "epoch", "days"))
query("k4_sample_confidence", UQUOTA + " SELECT user_id, round(max(1 / (1 + exp(-logit))), 6) AS conf_samples_max, round(avg((1 / (1 + exp(-logit)) > 0.05)::INT), 6) AS samples_above FROM slog GROUP BY 1")(lambda t: rounded(M.sample_confidence(t.samples)))
query("k5_rank_by_kind", UQUOTA + " SELECT user_id, paper_id, t, rank_explicit, rank_samples, rank_explicit + rank_samples - 1 AS rank_all FROM rkind")(lambda t: M.rank_positives_by_kind(t.pred.filter("label = 1").select("user_id", "paper_id", "t", "logit"), t.negs, t.samples, ["user_id", "paper_id", "t"]).drop("logit"))
query("k7_softmax_by_kind", UQUOTA + ", z AS (SELECT user_id, paper_id, t, TRUE AS given, exp(logit / 0.5) AS w FROM negs UNION ALL SELECT p.user_id, p.paper_id, p.t, FALSE, exp(s.logit / 0.5) FROM pred p JOIN slog s USING (user_id) WHERE label = 1), y AS (SELECT p.user_id, p.paper_id, p.t, exp(p.logit / 0.5) AS w0, sum(w) AS others, avg(w) FILTER (given) AS e, max(w) FILTER (NOT given) AS s FROM pred p JOIN z USING (user_id, paper_id, t) WHERE label = 1 GROUP BY p.user_id, p.paper_id, p.t, p.logit) SELECT user_id, paper_id, t, round(w0 / (w0 + others), 6) AS share, round(e / (w0 + others), 6) AS explicit_mean, round(s / (w0 + others), 6) AS samples_max, round(-ln(w0 / (w0 + others) + 1e-10), 6) AS info_nce FROM y")(lambda t: rounded(M.softmax_by_kind(t.pred.filter("label = 1").select("user_id", "paper_id", "t", "logit"), t.negs, t.samples, ["user_id", "paper_id", "t"], 0.5).drop("logit")))
query("x13_fold_splits", "SELECT user_id, paper_id, t, unnest([0, 1, 2]) AS fold_idx, CASE WHEN (row_number() OVER (PARTITION BY user_id, rating ORDER BY md5('42|fold|' || user_id || '|' || paper_id || '|' || t), paper_id, t) - 1) % 3 = unnest([0, 1, 2]) THEN 'val' ELSE 'train' END AS split FROM sess")(lambda t: X.fold_splits(X.kfold(t.sess, 3, SEED), 3).select("user_id", "paper_id", "t", F.col("fold_idx").cast("int").alias("fold_idx"), "split"))
query("x7_cache_by_ratio", "SELECT paper_id FROM pool")(lambda t: S.cache_papers(t.papers, 20, SEED, t.ratios))
query("x7_cache_everywhere", "SELECT paper_id FROM papers ORDER BY md5('42|cache|' || paper_id), paper_id LIMIT 30")(lambda t: S.cache_papers(t.papers, 30, SEED, everywhere=True))
query("s2_check_texts", "SELECT count(*) FILTER (p.paper_id IS NOT NULL AND d.doc_id IS NULL) AS n_without_text, count(*) FILTER (p.paper_id IS NULL) AS n_without_paper FROM papers p FULL JOIN documents d ON p.paper_id = d.doc_id")(lambda t: D.check_texts(t.papers, D.texts_of(t.spark, t.dir)))
query("s7_repeated_ids", "SELECT paper_id, count(*) AS n FROM (SELECT * FROM emb UNION ALL SELECT * FROM emb WHERE paper_id % 10 = 0) GROUP BY 1 HAVING count(*) > 1")(lambda t: D.repeated_ids(t.emb.unionByName(t.emb.filter("paper_id % 10 = 0"))))


def written(t: Tables, df: DataFrame) -> str:
    """The path of df as a table in the shared folder; it is removed when the driver's JVM ends."""
    at = shared_path(df)
    D.write_table(df, at)
    return at


def results(t: Tables) -> DataFrame:
    at = shared_path(t.raw)
    D.write_results(rounded(t.res), at)
    return D.read_results(t.spark, at, "user_id long, combination_idx int, score string, value double")


query("s1_s5_load_ratings", "SELECT user_id, paper_id, rating, session_id FROM rat WHERE rating <> 2 AND user_id IN (SELECT user_id FROM best)")(lambda t: D.load_ratings(t.spark, written(t, t.rat), t.split, ["user_id", "paper_id", "rating", "session_id"]))
query("s3_load_papers", "SELECT paper_id, l1, l2 FROM papers WHERE paper_id IN (SELECT paper_id FROM sess)")(lambda t: D.load_papers(t.spark, written(t, t.papers), t.sess, ["paper_id", "l1", "l2"]))
query("s3_load_significant_categories", "SELECT user_id, rank::INT AS rank, category, round(proportion, 6) AS proportion FROM signif WHERE user_id IN (SELECT user_id FROM best)")(lambda t: rounded(D.load_significant_categories(t.spark, written(t, t.signif.withColumn("rank", F.col("rank").cast("int"))), t.split)))
query("s4_raw_votes", "SELECT user_id, event_id % (SELECT count(*) FROM embeddings) AS paper_id, CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE -1 END AS rating FROM events WHERE ts IS NOT NULL AND event_type IN ('click', 'purchase', 'error', 'signup')")(lambda t: D.raw_votes(t.raw.select("user_id", "paper_id", F.col("vote").alias("rating"), F.col("ts").alias("time"))).drop("time"))
query("s4_cache_ids", "SELECT DISTINCT event_id % (SELECT count(*) FROM embeddings) AS paper_id FROM events WHERE event_type = 'view'")(lambda t: D.cache_ids(t.raw.filter("vote = 0")))
query("s6_results", "SELECT user_id, combination_idx, score, round(value, 6) AS value FROM res")(results)
query("m8_m15_predict", "SELECT user_id, split, paper_id, t, label, round(logit, 6) AS logit FROM pred")(lambda t: rounded(t.pred.drop("session_id")))
query("k1_classification", "SELECT user_id, split, tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(r, 6) AS recall, round(s, 6) AS specificity, round((r + s) / 2, 6) AS balanced_accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round((tp + fn) / (tp + fp + tn + fn), 6) AS label_share, round((tp + fp) / (tp + fp + tn + fn), 6) AS prediction_share FROM (SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS s FROM (SELECT user_id, split, count(*) FILTER (logit > 0 AND label = 1) AS tp, count(*) FILTER (logit > 0 AND label = 0) AS fp, count(*) FILTER (logit <= 0 AND label = 0) AS tn, count(*) FILTER (logit <= 0 AND label = 1) AS fn FROM pred GROUP BY ALL))")(lambda t: rounded(M.classification_metrics(t.pred, ["user_id", "split"])))
query("k2_log_loss", ", x AS (SELECT user_id, split, label, CASE WHEN label = 1 THEN ln(1 + exp(-logit)) ELSE ln(1 + exp(logit)) END AS l FROM pred) SELECT user_id, split, round(avg(l), 6) AS log_loss, round(avg(l) FILTER (label = 1), 6) AS log_loss_pos, round(avg(l) FILTER (label = 0), 6) AS log_loss_neg FROM x GROUP BY ALL")(lambda t: rounded(M.log_loss(t.pred, ["user_id", "split"])))
query("k3_auroc", "SELECT a.user_id, a.split, round(avg(CASE WHEN a.logit > b.logit THEN 1 WHEN a.logit = b.logit THEN 0.5 ELSE 0 END), 6) AS auroc FROM pred a JOIN pred b ON a.user_id = b.user_id AND a.split = b.split WHERE a.label = 1 AND b.label = 0 GROUP BY ALL")(lambda t: rounded(M.auroc(t.pred, ["user_id", "split"])))
query("k4_confidence", ", x AS (SELECT *, 1 / (1 + exp(-logit)) AS p FROM pred) SELECT user_id, split, round(avg(p), 6) AS conf_all, round(coalesce(avg(p) FILTER (logit > 0 AND label = 1), 0.5), 6) AS conf_tp, round(coalesce(avg(p) FILTER (logit > 0 AND label = 0), 0.5), 6) AS conf_fp, round(coalesce(avg(p) FILTER (logit <= 0 AND label = 0), 0.5), 6) AS conf_tn, round(coalesce(avg(p) FILTER (logit <= 0 AND label = 1), 0.5), 6) AS conf_fn, round(min(p) FILTER (label = 1), 6) AS conf_pos_min, round(avg(p) FILTER (label = 1), 6) AS conf_pos, round(avg((p > 0.05)::INT), 6) AS share_above FROM x GROUP BY ALL")(lambda t: rounded(M.confidence_metrics(t.pred, ["user_id", "split"])))
query("k5_rank_positives", "SELECT user_id, paper_id, t, rank FROM ranked")(lambda t: t.ranked.select("user_id", "paper_id", "t", "rank"))
query("k6_ranking_metrics", "SELECT user_id, split, round(ndcg, 6) AS ndcg, round(mrr, 6) AS mrr, round(hr1, 6) AS hr1, round(ndcg_min, 6) AS ndcg_min FROM metr")(lambda t: rounded(M.ranking_metrics(t.ranked, ["user_id", "split"])))
query("k7_softmax", ", x AS (SELECT p.user_id, p.paper_id, p.t, exp(p.logit / 0.5) / (exp(p.logit / 0.5) + sum(exp(n.logit / 0.5))) AS share FROM pred p JOIN negs n USING (user_id, paper_id, t) WHERE p.label = 1 GROUP BY p.user_id, p.paper_id, p.t, p.logit) SELECT user_id, paper_id, t, round(share, 6) AS share, round(-ln(share + 1e-10), 6) AS info_nce FROM x")(lambda t: rounded(M.softmax_metrics(t.pred.filter("label = 1").select("user_id", "paper_id", "t", "logit"), t.negs, ["user_id", "paper_id", "t"], 0.5).drop("logit")))
query("k8_session_metrics", "SELECT user_id, split, session_id, round(avg(1 / log2(rank + 1)), 6) AS ndcg, round(avg(1 / rank), 6) AS mrr, round(avg((rank = 1)::INT), 6) AS hr1, round(min(1 / log2(rank + 1)), 6) AS ndcg_min FROM ranked GROUP BY ALL")(lambda t: rounded(M.ranking_metrics(t.ranked, ["user_id", "split", "session_id"])))
query("k11_assemble", "SELECT user_id, combination_idx, round(max(value) FILTER (score = 'ndcg'), 6) AS ndcg, round(max(value) FILTER (score = 'mrr'), 6) AS mrr, round(max(value) FILTER (score = 'hr1'), 6) AS hr1 FROM res GROUP BY ALL")(lambda t: rounded(R.assemble_results(t.res, ["ndcg", "mrr", "hr1"])))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: sessions, split, counts."""
    return QUERIES["a2_user_info_by_split"](spark, sf_dir)
