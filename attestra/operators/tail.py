"""Tail correction on the driver: a Gaussian process over at most 300 rare rows, and the choice of where to look next."""

from __future__ import annotations

import sys
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.functions import random as rnd
from attestra.operators.distance import explored_distance

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class AmplifierConfig:
    max_obs: int = 300
    noise: float = 0.1
    max_features: int = 0
    iterations: int = 500
    obs_per_dim: int = 2
    seconds: float = 120.0


@dataclass(frozen=True)
class ScoutConfig:
    candidates: int = 100
    explored_penalty: float = 0.7


def select_features(df: DataFrame, columns: list[str], k: int) -> list[str]:
    """The k columns of largest variance (all for k = 0)."""
    if not 0 < k < len(columns):
        return list(columns)
    v = df.agg(*[F.var_pop(F.col(c).cast("double")).alias(c) for c in columns]).first()
    return sorted(columns, key=lambda c: (-(v[c] or 0.0), c))[:k]


def minimise(f, x: np.ndarray, iterations: int, seconds: float, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with backtracking. f gives value and gradient; time bounds it."""
    end, pairs = time.monotonic() + seconds, []
    value, g = f(x)
    for _ in range(iterations):
        if np.max(np.abs(g)) < 1e-5 or time.monotonic() > end:
            break
        q, alphas = g.copy(), []
        for s, y, rho in reversed(pairs):
            a = rho * s @ q
            alphas.append(a)
            q -= a * y
        if pairs:
            s, y, _ = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, rho), a in zip(pairs, reversed(alphas), strict=True):
            q += s * (a - rho * y @ q)
        step, slope = 1.0 if pairs else min(1.0, 1.0 / max(1e-12, np.abs(g).sum())), -(g @ q)
        if slope >= 0:
            pairs, q, slope = [], g.copy(), -(g @ g)
        for _ in range(30):
            new_value, new_g = f(x - step * q)
            if np.isfinite(new_value) and new_value <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = -step * q, new_g - g
        if s @ y > 1e-12:
            pairs = [*pairs[-(memory - 1) :], (s, y, 1.0 / (s @ y))]
        x, value, g = x + s, new_value, new_g
    return x


@dataclass
class GaussianProcess:
    """Squared-exponential kernel with a length for every feature."""

    x: np.ndarray
    log_params: np.ndarray  # log variance, log noise, log lengths
    alpha: np.ndarray
    inverse: np.ndarray
    mean: float
    warning: str | None = None

    def kernel(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        lengths = np.exp(self.log_params[2:])
        d = (((a[:, None, :] - b[None, :, :]) / lengths) ** 2).sum(axis=2)
        return np.exp(self.log_params[0] - 0.5 * d)

    def posterior(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = self.kernel(a, self.x)
        return self.mean + k @ self.alpha, np.maximum(np.exp(self.log_params[0]) - np.einsum("ij,jk,ik->i", k, self.inverse, k), 1e-12)

    def covariance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.kernel(a, b) - self.kernel(a, self.x) @ self.inverse @ self.kernel(b, self.x).T

    @property
    def relevance(self) -> np.ndarray:
        inverse = np.exp(-self.log_params[2:])
        return inverse / inverse.max()


def fit_gp(x: np.ndarray, y: np.ndarray, cfg: AmplifierConfig = AmplifierConfig()) -> GaussianProcess:
    """Marginal likelihood by gradient on log parameters; the noise stays within [1e-4, 1]."""
    n, d = x.shape
    mean = float(y.mean()) if n else 0.0
    r = y - mean
    start = np.concatenate([[np.log(max(r.var(), 1e-3)), np.log(cfg.noise)], np.full(d, 0.5 * np.log(max(d, 1)))])
    squares = (x[:, None, :] - x[None, :, :]) ** 2

    def bounded(p: np.ndarray) -> np.ndarray:
        out = np.clip(p, -12, 12)
        out[1] = np.clip(p[1], np.log(1e-4), 0.0)
        return out

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        q = bounded(p)
        scaled = squares * np.exp(-2 * q[2:])
        k = np.exp(q[0] - 0.5 * scaled.sum(axis=2))
        full = k + (np.exp(q[1]) + 1e-8) * np.eye(n)
        try:
            low = np.linalg.cholesky(full)
        except np.linalg.LinAlgError:
            return np.inf, np.zeros_like(p)
        inverse = np.linalg.inv(full)
        a = inverse @ r
        value = 0.5 * r @ a + np.log(np.diag(low)).sum() + 0.5 * n * np.log(2 * np.pi)
        outer = inverse - np.outer(a, a)
        g = np.empty_like(p)
        g[0] = 0.5 * (outer * k).sum()
        g[1] = 0.5 * np.exp(q[1]) * np.trace(outer)
        g[2:] = 0.5 * np.einsum("ij,ijk->k", outer * k, scaled)
        return float(value), np.where(q == p, g, 0.0)

    p = bounded(minimise(loss, start, cfg.iterations, cfg.seconds)) if n > 1 else start
    gp = GaussianProcess(x, p, np.zeros(n), np.zeros((n, n)), mean)
    gp.inverse = np.linalg.inv(gp.kernel(x, x) + (np.exp(p[1]) + 1e-8) * np.eye(n))
    gp.alpha = gp.inverse @ r
    if n < cfg.obs_per_dim * d:
        gp.warning = f"{n} observations for {d} dimensions"
    return gp


def fit_correction(rare: DataFrame, columns: list[str], p_normal, cfg: AmplifierConfig = AmplifierConfig()) -> tuple[GaussianProcess, list[str]]:
    """A process over how unlike normal the last max_obs rare rows are. p_normal: column of P(normal | row)."""
    chosen = select_features(rare, columns, cfg.max_features)
    rows = rare.select("__rid", *[F.col(c).cast("double").alias(c) for c in chosen], (1.0 - p_normal).alias("__r")).orderBy(F.desc("__rid")).limit(cfg.max_obs).collect()
    x = np.array([[r[c] for c in chosen] for r in rows], dtype=float).reshape(len(rows), len(chosen))
    return fit_gp(x, np.array([r["__r"] for r in rows], dtype=float), cfg), chosen


def _corrector(handed, columns: list[str], continuous: list[bool]):
    def correct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gp = GaussianProcess(*handed.value)
        for pdf in batches:
            mean, var = gp.posterior(pdf[columns].to_numpy(float))
            shift = mean + np.sqrt(var) * pdf["__e"].to_numpy(float)
            out = pdf.copy()
            for c, w, use in zip(columns, gp.relevance, continuous, strict=True):
                if use:
                    out[c] = out[c] + w * shift
            yield out

    return correct


def sample_correction(base: DataFrame, gp: GaussianProcess, columns: list[str], continuous: list[bool], seed: int, key: str = "draw") -> DataFrame:
    """base with a draw of the process added to its continuous columns by their relevance."""
    handed = base.sparkSession.sparkContext.broadcast((gp.x, gp.log_params, gp.alpha, gp.inverse, gp.mean))
    rows = base.withColumns({c: F.col(c).cast("double") for c in columns}).withColumn("__e", rnd.normal(seed, "correction", key))
    return rows.mapInPandas(_corrector(handed, columns, continuous), rows.schema).drop("__e")


def score_candidates(gp: GaussianProcess, candidates: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Mean over targets of half the log of 1 / (1 - rho**2): what a candidate tells about them."""
    cov = gp.covariance(candidates, targets)
    _, a = gp.posterior(candidates)
    _, b = gp.posterior(targets)
    rho2 = np.clip(cov**2 / np.outer(a, b), 0.0, 1.0 - 1e-9)
    return 0.5 * np.log(1.0 / (1.0 - rho2)).mean(axis=1)


def explored_penalty(scores: np.ndarray, candidates: np.ndarray, anchors: np.ndarray | None, penalty: float = 0.7) -> np.ndarray:
    """scores lowered near explored anchors; nothing changes without anchors of the same width."""
    if anchors is None or not len(anchors) or anchors.shape[1] != candidates.shape[1]:
        return scores
    sd = candidates.std(axis=0)
    sd = np.where(sd > 1e-8, sd, 1.0)
    return scores * (1.0 - penalty * np.exp(-explored_distance(candidates / sd, anchors / sd)))


def select_target(gp: GaussianProcess, sd: np.ndarray, seed: int, cfg: ScoutConfig = ScoutConfig(), anchors: np.ndarray | None = None) -> dict:
    """The best of noisy copies of rare rows, and the upper half of the most relevant feature as the region to weight."""
    rng = np.random.default_rng(seed)
    candidates = gp.x[rng.integers(len(gp.x), size=cfg.candidates)] + 0.5 * sd * rng.standard_normal((cfg.candidates, gp.x.shape[1]))
    scores = explored_penalty(score_candidates(gp, candidates, gp.x), candidates, anchors, cfg.explored_penalty)
    best = int(scores.argmax())
    return {"feature": int(gp.relevance.argmax()), "low": 0.5, "high": 1.0, "score": float(scores[best]), "anchor": candidates[best]}
