"""Logistic fits of keys with more rows than one task should hold: Newton's rounds, each one pass of sums over the key's blocks."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import BLOCK_BYTES, ROUND_BYTES, batches_of, pack, round_of_draws, round_of_sums, shared_path

#: A fit ends when Newton's decrement is this part of the loss: a relative rule, as sums over more votes resolve less.
DECREMENT = 1e-12
HALVINGS = 30
#: Bytes of a user's vectors that one task fits; users with more are fitted in rounds over blocks.
MAX_BYTES = 64 << 20


def with_ones(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def sums_at(z: np.ndarray, y: np.ndarray, weight: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Weighted log-loss, its gradient and its Hessian at theta, in one vector."""
    m = z @ theta
    p = 1 / (1 + np.exp(-m))
    curve = (z * (weight * p * (1 - p))[:, None]).T @ z
    return np.concatenate([[weight @ (np.logaddexp(0, m) - y * m)], z.T @ (weight * (p - y)), curve.ravel()])


def n_sums(width: int) -> int:
    return 1 + (width + 1) + (width + 1) ** 2


@dataclass
class Fit:
    """A damped Newton fit of |w|^2 / 2 + c * weighted log-loss; the intercept isn't penalised.

    Each call of `advance` takes the sums at `at()`: it goes there if the loss fell enough, else halves the step. Once the decrement is
    below the relative bound, the last step is taken whole and the fit is done; a step that has been halved too often ends it unconverged.
    """

    c: float
    width: int
    theta: np.ndarray = field(init=False)
    step: np.ndarray = field(init=False)
    size: float = 1.0
    value: float = np.inf
    slope: float = 0.0
    done: bool = False
    converged: bool = False

    def __post_init__(self) -> None:
        self.theta, self.step = np.zeros(self.width + 1), np.zeros(self.width + 1)

    def at(self) -> np.ndarray:
        return self.theta - self.size * self.step

    def advance(self, sums: np.ndarray) -> None:
        k, trial = self.width + 1, self.at()
        ridge = np.append(np.ones(k - 1), 0.0)
        value = 0.5 * ridge @ trial**2 + self.c * sums[0]
        room = DECREMENT * (1 + abs(value))  # differences of the loss below this are rounding
        if not value <= self.value - 1e-4 * self.size * self.slope + room:
            self.size /= 2
            self.done = self.size < 0.5**HALVINGS
            return
        g = ridge * trial + self.c * sums[1 : k + 1]
        d = np.linalg.solve(self.c * sums[k + 1 :].reshape(k, k) + np.diag(ridge + 1e-10), g)
        self.theta, self.step, self.size, self.value, self.slope = trial, d, 1.0, value, float(g @ d)
        if self.slope <= room:
            self.theta, self.done, self.converged = trial - d, True, True


def fit_large(rated: DataFrame, weights: DataFrame, by: list[str], extra: Broadcast | None, rounds: int = 100, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """by, combination_idx, coef, intercept, converged for the keys of rated.

    rated: by, rating, embedding and _h, a hash of the vote; weights: by, combination_idx, c, w_pos, w_neg and perhaps w_cache. Votes are
    laid out in blocks once. Fits go in batches whose Hessians are bounded; a batch ends when its fits are done, or after the rounds, which `converged` tells.
    """
    spark = rated.sparkSession
    blocks = pack(rated, by, "rating", "embedding", "_h", block_bytes)
    first = blocks.select(F.size(F.col("vectors")[0]).alias("w")).first()
    keys = ", ".join(f"{k} {dict(rated.dtypes)[k]}" for k in by)
    schema = f"{keys}, combination_idx int, coef array<double>, intercept double, converged boolean"
    if first is None:
        return spark.createDataFrame([], schema)
    width, out = first["w"], shared_path(rated)
    spark.createDataFrame([], schema).write.parquet(out)
    w_cache = F.col("w_cache") if "w_cache" in weights.columns else F.lit(0.0)
    wanted = weights.join(blocks.select(*by).distinct(), by, "left_semi").select(*by, F.col("combination_idx").cast("int").alias("combination_idx"), *[F.col(c).cast("double").alias(c) for c in ("c", "w_pos", "w_neg")], w_cache.cast("double").alias("w_cache"))
    for rows in batches_of(wanted.sort(*by, "combination_idx").toLocalIterator(), lambda _: 8 * (width + 1) ** 2, ROUND_BYTES):
        fits = [Fit(r.c, width) for r in rows]
        for _ in range(rounds):
            requests: dict[tuple, list] = {}
            for k, (r, fit) in enumerate(zip(rows, fits)):
                if not fit.done:
                    requests.setdefault(tuple(r[b] for b in by), []).append((k, (fit.at(), r.w_pos, r.w_neg)))
            if not requests:
                break
            for k, sums in round_of_sums(blocks, by, requests, votes_at, n_sums(width)).items():
                if extra is not None and extra.value is not None:
                    z = with_ones(extra.value)
                    sums = sums + sums_at(z, np.zeros(len(z)), np.full(len(z), rows[k].w_cache), fits[k].at())
                fits[k].advance(sums)
        found = [(*(r[b] for b in by), r.combination_idx, f.theta[:-1].tolist(), float(f.theta[-1]), f.converged) for r, f in zip(rows, fits)]
        spark.createDataFrame(found, schema).write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)


def votes_at(x: np.ndarray, y: np.ndarray, request: tuple) -> np.ndarray:
    at, w_pos, w_neg = request
    return sums_at(with_ones(x), y, np.where(y == 1, w_pos, w_neg), at)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and its squared distance; a centre at a time, so that no third dimension is held."""
    far = np.stack([((x - c) ** 2).sum(1) for c in centres])
    return far.argmin(0), far.min(0)


def draws_at(x: np.ndarray, y: np.ndarray, ids: np.ndarray, request: tuple) -> tuple[float, np.ndarray] | None:
    """An up-vote drawn in proportion to its squared distance from the centres: the smallest exponential key, which merges by minimum."""
    centres, seed = request
    x, ids = x[y == 1], ids[y == 1]
    if not len(x):
        return None
    far = nearest(x, centres)[1] if len(centres) else np.ones(len(x))
    key = np.where(far > 0, -np.log(drawn(ids, seed)) / np.where(far > 0, far, 1), np.inf)
    best = int(key.argmin())
    return (float(key[best]), x[best]) if np.isfinite(key[best]) else None


def drawn(ids: np.ndarray, seed: int) -> np.ndarray:
    """A number in (0, 1) for each id and seed."""
    mixed = ids.astype(np.int64).view(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return ((mixed >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def means_at(x: np.ndarray, y: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Sums and numbers of the up-votes nearest to each centre."""
    x = x[y == 1]
    out = np.zeros((len(centres), centres.shape[1] + 1))
    if len(x):
        np.add.at(out, nearest(x, centres)[0], with_ones(x))
    return out.ravel()


def cluster_votes_at(x: np.ndarray, y: np.ndarray, request: tuple) -> np.ndarray:
    """Sums of a cluster's fit: its up-votes weigh w_in, others w_out; j None: all up-votes weigh w_in."""
    at, centres, j, w_in, w_out, w_neg = request
    inside = np.ones(len(x), bool) if j is None else nearest(x, centres)[0] == j
    return sums_at(with_ones(x), y, np.where(y == 1, np.where(inside, w_in, w_out), w_neg), at)


def k_means_large(blocks: DataFrame, by: list[str], wanted: dict[tuple, tuple[int, int]], rounds: int = 50) -> dict[tuple, np.ndarray]:
    """Centres of each key's up-votes and how many are nearest, as rows: k-means++ draws, then Lloyd's rounds, all keys of the batch together.

    wanted: k and seed by key. A round is one pass over the blocks.
    """
    centres = {key: np.zeros((0, 0)) for key in wanted}
    for j in range(max((k for k, _ in wanted.values()), default=0)):
        ask = {key: [(i, (centres[key], seed + j))] for i, (key, (k, seed)) in enumerate(wanted.items()) if k > j and len(centres[key]) == j}
        if not ask:
            break
        got = round_of_draws(blocks, by, ask, draws_at)
        for key, [(i, _)] in ask.items():
            if i in got:
                centres[key] = np.vstack([*centres[key], got[i]])
    counts = {key: np.zeros(len(c)) for key, c in centres.items()}
    open_ = {key for key, c in centres.items() if len(c)}
    for last in [False] * rounds + [True]:
        asked = list(open_ if not last else [key for key, c in centres.items() if len(c)])
        wide = lambda key: centres[key].size + len(centres[key])
        got = round_of_sums(blocks, by, {key: [(i, centres[key])] for i, key in enumerate(asked)}, means_at, max(map(wide, asked))) if asked else {}
        for i, key in enumerate(asked):
            sums = got[i][: wide(key)].reshape(len(centres[key]), -1)
            counts[key] = sums[:, -1]
            new = np.where(sums[:, -1:] > 0, sums[:, :-1] / np.maximum(sums[:, -1:], 1), centres[key])
            if last:
                continue
            if np.allclose(new, centres[key]):
                open_.discard(key)
            else:
                centres[key] = new
    return {key: (centres[key], counts[key]) for key in wanted}


def cluster_fits_large(rows: DataFrame, wanted: DataFrame, c: float, neg_weight: float, alpha: float, least: int, seed: int, schema: str, block_bytes: int = BLOCK_BYTES, rounds: int = 100) -> DataFrame:
    """k, user_id, cluster, centre, coef, intercept: what models_for_ks gives, for users of many votes, in rounds over blocks.

    rows: user_id, paper_id, rating, embedding; wanted: user_id, k, n_pos and clusters, how many there shall be (0: the global model alone).
    """
    spark, by = rows.sparkSession, ["user_id"]
    blocks = pack(rows, by, "rating", "embedding", "paper_id", block_bytes)
    first = blocks.select(F.size(F.col("vectors")[0]).alias("w")).first()
    if first is None:
        return spark.createDataFrame([], schema)
    width, out = first["w"], shared_path(rows)
    spark.createDataFrame([], schema).write.parquet(out)
    weight = lambda r: 8 * (width + 1) ** 2 * (1 + r.clusters) + 4096
    for batch in batches_of(wanted.sort("user_id", "k").toLocalIterator(), weight, ROUND_BYTES):
        groups = [{} for _ in batch]
        turns: dict[int, list] = {}  # a user with several k has them one after the other, as a request is by user
        seen: Counter = Counter()
        for i, r in enumerate(batch):
            if r.clusters:
                turns.setdefault(seen[r.user_id], []).append(i)
                seen[r.user_id] += 1
        for now in turns.values():
            found = k_means_large(blocks, by, {(batch[i].user_id,): (batch[i].clusters, seed ^ batch[i].user_id) for i in now})
            for i in now:
                groups[i] = dict(zip(("centres", "counts"), found[(batch[i].user_id,)]))
        fits = []
        for i, r in enumerate(batch):
            fits.append((i, None, Fit(c, width), (None, None, 1.0, 1.0, neg_weight)))
            n = r.n_pos
            for j, held in enumerate(groups[i].get("counts", [])):
                if held >= least:
                    scale = n / (alpha * held + (1 - alpha) * (n - held))
                    fits.append((i, j, Fit(c, width), (groups[i]["centres"], j, alpha * scale, (1 - alpha) * scale, neg_weight)))
        for _ in range(rounds):
            requests: dict[tuple, list] = {}
            for number, (i, _, fit, spec) in enumerate(fits):
                if not fit.done:
                    requests.setdefault((batch[i].user_id,), []).append((number, (fit.at(), *spec)))
            if not requests:
                break
            for number, sums in round_of_sums(blocks, by, requests, cluster_votes_at, n_sums(width)).items():
                fits[number][2].advance(sums)
        models = {(i, j): fit for i, j, fit, _ in fits}
        rows_out = []
        for i, r in enumerate(batch):
            whole = models[i, None]
            rows_out.append((r.k, r.user_id, -1, None, whole.theta[:-1].tolist(), float(whole.theta[-1])))
            for j, centre in enumerate(groups[i].get("centres", [])):
                fit = models.get((i, j))
                rows_out.append((r.k, r.user_id, j, centre.tolist(), fit.theta[:-1].tolist() if fit else None, float(fit.theta[-1]) if fit else None))
        spark.createDataFrame(rows_out, schema).write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)
