"""Ordinary and logistic regression from sufficient statistics, and the certificate that compares two fits.

The table is read in map-side aggregates of p*p sums; only matrices of the size of the model meet on the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.stats import normal_quantile, t_quantile
from attestra.operators.ingest import IngestError, coerce_numeric

RIDGE, MOST_STEPS, STEP_TOLERANCE, LEAST_WEIGHT = 1e-10, 100, 1e-10, 1e-12
METRIC_VERSION = "1"


class EstimandError(ValueError):
    """A regression that can't be fitted, with the reason."""


@dataclass(frozen=True)
class Estimand:
    """outcome ~ predictors by family ols or logit; targets (all predictors by default) must be preserved by rule
    consistent, within_ci or significant."""

    outcome: str
    predictors: tuple[str, ...]
    family: str = "ols"
    targets: tuple[str, ...] = ()
    ci_level: float = 0.95
    rule: str = "consistent"

    def __post_init__(self):
        if not self.outcome or not self.predictors:
            raise EstimandError("an outcome and predictors are needed")
        if self.family not in ("ols", "logit"):
            raise EstimandError(f"unknown family {self.family!r}")
        if self.rule not in ("consistent", "within_ci", "significant"):
            raise EstimandError(f"unknown rule {self.rule!r}")
        if not 0 < self.ci_level < 1:
            raise EstimandError("ci_level must lie between 0 and 1")

    @property
    def wanted(self) -> tuple[str, ...]:
        return self.targets or self.predictors


@dataclass
class Fit:
    names: list[str]
    coef: np.ndarray
    se: np.ndarray
    n: int
    critical: float
    family: str
    extra: dict = field(default_factory=dict)

    def packed(self) -> dict[str, dict[str, float]]:
        return {k: {"coef": float(b), "se": float(s), "ci_low": float(b - self.critical * s), "ci_high": float(b + self.critical * s)} for k, b, s in zip(self.names, self.coef, self.se, strict=True)}


def design(df: DataFrame, spec: Estimand) -> DataFrame:
    """The used columns as doubles without incomplete rows."""
    missing = [c for c in (spec.outcome, *spec.predictors) if c not in df.columns]
    if missing:
        raise EstimandError(f"no such columns: {', '.join(missing)}")
    try:
        return coerce_numeric(df, [spec.outcome, *spec.predictors])
    except IngestError as e:
        raise EstimandError(str(e)) from None


def _sums(pairs: list[Column], names: list[str]) -> list[Column]:
    return [F.sum(p).alias(n) for p, n in zip(pairs, names, strict=True)]


def _solve(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = a + RIDGE * np.eye(len(a))
    try:
        inverse = np.linalg.inv(a)
    except np.linalg.LinAlgError:
        raise EstimandError("the predictors are not independent") from None
    return np.linalg.solve(a, b), inverse


def _moments(rows: DataFrame, spec: Estimand, by: list[str]) -> list:
    """Per group: n, means, and sums of products about the means, in two aggregates."""
    cols = [spec.outcome, *spec.predictors]
    means = rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)])
    joined = rows.join(F.broadcast(means), by) if by else rows.crossJoin(F.broadcast(means))
    centred = [F.col(c) - F.col(f"m_{i}") for i, c in enumerate(cols)]
    products = [F.sum(centred[i] * centred[j]).alias(f"s_{i}_{j}") for i in range(len(cols)) for j in range(i + 1)]
    return joined.groupBy(*by).agg(F.first("n").alias("n"), *[F.first(f"m_{i}").alias(f"m_{i}") for i in range(len(cols))], *products).collect()


def _ols_of(r, spec: Estimand) -> Fit:
    p = len(spec.predictors)
    n = r["n"] or 0
    if n <= p + 1:
        raise EstimandError(f"{n} complete rows for {p + 1} coefficients")
    s = np.array([[r[f"s_{max(i, j)}_{min(i, j)}"] for j in range(p + 1)] for i in range(p + 1)], dtype=float)
    means = np.array([r[f"m_{i}"] for i in range(p + 1)], dtype=float)
    sxx, sxy = s[1:, 1:], s[1:, 0]
    scale = np.sqrt(np.maximum(np.diag(sxx), 1e-300))
    slopes, inverse = _solve(sxx / np.outer(scale, scale), sxy / scale)
    slopes, inverse = slopes / scale, inverse / np.outer(scale, scale)
    rss = max(0.0, float(s[0, 0] - 2 * slopes @ sxy + slopes @ sxx @ slopes))
    var = rss / (n - p - 1)
    coef = np.concatenate([[means[0] - slopes @ means[1:]], slopes])
    se = np.sqrt(np.concatenate([[var * (1 / n + means[1:] @ inverse @ means[1:])], var * np.diag(inverse)]))
    return Fit(["intercept", *spec.predictors], coef, se, n, t_quantile(0.5 + spec.ci_level / 2, n - p - 1), "ols", {"sigma2": var})


def fit_ols(df: DataFrame, spec: Estimand) -> Fit:
    """Least squares on centred, scaled predictors; standard errors with n - p degrees of freedom, t intervals."""
    rows = _moments(design(df, spec), spec, [])
    if not rows:
        raise EstimandError("no complete rows")
    return _ols_of(rows[0], spec)


def fit_logit(df: DataFrame, spec: Estimand) -> Fit:
    """Newton steps on standardised predictors, one aggregate each; standard errors from the information, z intervals."""
    x = design(df, spec).cache()
    try:
        p = len(spec.predictors)
        y = F.col(spec.outcome)
        stats = x.agg(F.count("*").alias("n"), F.count_if(~y.isin(0.0, 1.0)).alias("bad"), *[f(c).alias(f"{k}{i}") for i, c in enumerate(spec.predictors) for k, f in (("m", F.avg), ("d", F.stddev_pop))]).first()
        if stats["bad"]:
            raise EstimandError("the outcome of a logit must be 0 or 1")
        n = stats["n"]
        if n <= p + 1:
            raise EstimandError(f"{n} complete rows for {p + 1} coefficients")
        mean = np.array([stats[f"m{i}"] for i in range(p)])
        sd = np.array([stats[f"d{i}"] or 1.0 for i in range(p)])
        z = [F.lit(1.0), *[(F.col(c) - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(spec.predictors, mean, sd, strict=True)]]
        beta = np.zeros(p + 1)

        def step(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            eta = sum((F.lit(float(v)) * c for v, c in zip(b, z, strict=True)), F.lit(0.0))
            mu = 1.0 / (1.0 + F.exp(-eta))
            rows = x.select(mu.alias("mu"), y.alias("y"), *[c.alias(f"z{i}") for i, c in enumerate(z)])
            w = F.greatest(F.col("mu") * (1 - F.col("mu")), F.lit(LEAST_WEIGHT))
            zz = [F.col(f"z{i}") for i in range(p + 1)]
            r = rows.agg(*[F.sum(zz[i] * (F.col("y") - F.col("mu"))).alias(f"g{i}") for i in range(p + 1)], *[F.sum(w * zz[i] * zz[j]).alias(f"h_{i}_{j}") for i in range(p + 1) for j in range(i + 1)]).first()
            return np.array([r[f"g{i}"] for i in range(p + 1)]), np.array([[r[f"h_{max(i, j)}_{min(i, j)}"] for j in range(p + 1)] for i in range(p + 1)])

        inverse = None
        for _ in range(MOST_STEPS):
            g, h = step(beta)
            move, inverse = _solve(h, g)
            beta = beta + move
            if np.max(np.abs(move)) < STEP_TOLERANCE:
                break
        back = np.eye(p + 1)
        for i in range(p):
            back[i + 1, i + 1] = 1 / sd[i]
            back[0, i + 1] = -mean[i] / sd[i]
        cov = back @ inverse @ back.T
        return Fit(["intercept", *spec.predictors], back @ beta, np.sqrt(np.maximum(np.diag(cov), 0)), n, normal_quantile(0.5 + spec.ci_level / 2), "logit")
    finally:
        x.unpersist()


def fit_estimand(df: DataFrame, spec: Estimand) -> Fit:
    return fit_ols(df, spec) if spec.family == "ols" else fit_logit(df, spec)


def certify(real: Fit, synth: Fit, spec: Estimand) -> dict:
    """Verdicts by target. A target that a fit lacks has preserved None and does not count."""
    a, b = real.packed(), synth.packed()
    z_cut = normal_quantile(0.5 + spec.ci_level / 2)
    targets = []
    for t in spec.wanted:
        if t not in a or t not in b:
            targets.append({"coefficient": t, "preserved": None})
            continue
        x, y = a[t], b[t]
        spread = math.hypot(x["se"], y["se"])
        delta = y["coef"] - x["coef"]
        z = abs(delta) / spread if spread else (0.0 if delta == 0 else math.inf)
        row = {"coefficient": t, "theta_real": x["coef"], "se_real": x["se"], "theta_synth": y["coef"], "se_synth": y["se"], "z": z,
               "margin": z_cut - z, "consistent": z <= z_cut, "within_ci": x["ci_low"] <= y["coef"] <= x["ci_high"], "real_significant": not x["ci_low"] <= 0 <= x["ci_high"]}
        same = row["real_significant"] == (not y["ci_low"] <= 0 <= y["ci_high"]) and (not row["real_significant"] or x["coef"] * y["coef"] > 0)
        row["preserved"] = {"consistent": row["consistent"], "within_ci": row["within_ci"], "significant": same}[spec.rule]
        targets.append(row)
    known = [t["preserved"] for t in targets if t["preserved"] is not None]
    return {"targets": targets, "certified": bool(known) and all(known)}


def evaluate(real: DataFrame, synth: DataFrame, spec: Estimand | None) -> dict:
    """status not_declared, uncertifiable (with reason), certified or not_preserved."""
    if spec is None:
        return {"status": "not_declared", "targets": []}
    try:
        out = certify(fit_estimand(real, spec), fit_estimand(synth, spec), spec)
    except (EstimandError, np.linalg.LinAlgError) as e:
        return {"status": "uncertifiable", "reason": str(e), "targets": []}
    return {"status": "certified" if out["certified"] else "not_preserved", **out}


def reference_aggregate(df: DataFrame, spec: Estimand) -> dict:
    """The disclosed real coefficients with their standard errors."""
    fit = fit_estimand(df, spec)
    return {"family": spec.family, "n": fit.n, "theta": fit.packed()}


def certify_dataset(real: DataFrame, synth: DataFrame, spec: Estimand, source: str = "synthetic") -> dict:
    return {"source": source, "metric_version": METRIC_VERSION, **evaluate(real, synth, spec)}


def certify_many(real: DataFrame, sources: DataFrame, spec: Estimand, by: str = "source") -> dict[str, dict]:
    """Certificates of every source in one union table: real is fitted once, OLS sources all in one aggregate by the
    source column; logits one by one."""
    first = fit_estimand(real, spec)
    if spec.family == "ols":
        rows = sources.select(F.col(by).alias("__by"), *[F.expr(f"try_cast(`{c}` as double)").alias(c) for c in (spec.outcome, *spec.predictors)]).dropna()
        fits = {}
        for r in _moments(rows, spec, ["__by"]):
            try:
                fits[r["__by"]] = _ols_of(r, spec)
            except EstimandError as e:
                fits[r["__by"]] = str(e)
    else:
        names = [r[0] for r in sources.select(by).distinct().collect()]
        fits = {}
        for name in names:
            try:
                fits[name] = fit_logit(sources.where(F.col(by) == name), spec)
            except EstimandError as e:
                fits[name] = str(e)
    out = {}
    for name, fit in sorted(fits.items(), key=lambda x: str(x[0])):
        if isinstance(fit, str):
            out[name] = {"source": name, "metric_version": METRIC_VERSION, "status": "uncertifiable", "reason": fit, "targets": []}
        else:
            verdict = certify(first, fit, spec)
            out[name] = {"source": name, "metric_version": METRIC_VERSION, "status": "certified" if verdict["certified"] else "not_preserved", **verdict}
    return out
