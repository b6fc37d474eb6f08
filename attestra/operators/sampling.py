"""Seeded samplers. Every draw is a hash of seed, stream and row number, so results do not depend on partitioning."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import random as rnd
from attestra.functions.ordered import average_ranks, quantiles, row_numbers
from attestra.functions.stats import normal_cdf_column, normal_quantile_column
from attestra.operators.fidelity import smoothed_frequencies
from attestra.operators.ingest import FieldMeta

#: Boosting rounds of a fitted outcome, as in the reference.
ROUNDS = 200


@dataclass(frozen=True)
class PriorConfig:
    max_rows: int = 5000
    noise_scale: float = 0.10


def numbered(df: DataFrame) -> tuple[DataFrame, int]:
    """df with __k, consecutive from 0 by __rid, and the number of rows."""
    return row_numbers(df, ["__rid"], "__k"), df.count()


def bootstrap(df: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows with replacement, numbered by draw."""
    rows, size = numbered(df)
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), rnd.index(size, seed, "bootstrap", "id").alias("__k"))
    return draws.join(rows, "__k").drop("__k")


def independent_columns(df: DataFrame, columns: list[str], n: int, seed: int) -> DataFrame:
    """n rows whose columns are drawn apart: the marginals stay, what ties them goes."""
    rows, size = numbered(df)
    out = df.sparkSession.range(n).select(F.col("id").alias("draw"))
    for c in columns:
        picked = df.sparkSession.range(n).select(F.col("id").alias("draw"), rnd.index(size, seed, f"column/{c}", "id").alias("__k"))
        out = out.join(picked.join(rows.select("__k", c), "__k").select("draw", c), "draw")
    return out


def noised(df: DataFrame, predictors: list[str], n: int, seed: int, scale: float = 0.5) -> DataFrame:
    """A bootstrap with noise of scale sample deviations on the predictors."""
    sd = df.agg(*[F.stddev_samp(c).alias(c) for c in predictors]).first()
    rows = bootstrap(df, n, seed)
    return rows.withColumns({c: F.col(c) + scale * float(sd[c] or 0.0) * rnd.normal(seed, f"noise/{c}", "draw") for c in predictors})


# -- grounded sampling --------------------------------------------------------------------------------------------

def naive_bayes_normal(df: DataFrame, columns: list[str], moments: dict[bool, list[tuple[float, float]]], prior: dict[bool, float]) -> Column:
    """P(normal | row) of a Gaussian naive Bayes model as one expression. moments: rare -> (mean, variance) by column."""
    def log_density(rare: bool) -> Column:
        terms = F.lit(math.log(max(prior[rare], 1e-300)))
        for c, (m, v) in zip(columns, moments[rare], strict=True):
            terms = terms - 0.5 * (F.lit(math.log(2 * math.pi * v)) + (F.col(c).cast("double") - F.lit(m)) ** 2 / F.lit(v))
        return terms

    return 1.0 / (1.0 + F.exp(log_density(True) - log_density(False)))


def fit_naive_bayes(df: DataFrame, columns: list[str], rare: str = "__rare") -> tuple[dict, dict]:
    rows = df.groupBy(rare).agg(F.count("*").alias("n"), *[f(F.col(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("v", F.var_pop))]).collect()
    total = sum(r["n"] for r in rows)
    moments = {r[rare]: [(r[f"m{i}"], (r[f"v{i}"] or 0.0) + 1e-6) for i in range(len(columns))] for r in rows}
    return moments, {r[rare]: r["n"] / total for r in rows}


def target_weights(df: DataFrame, feature: str, low: float, high: float) -> DataFrame:
    """df with weight: 2 where feature lies within its quantiles low to high, else 1, normalised to sum to one."""
    a, b = quantiles(df, feature, [low, high])
    out = df.withColumn("weight", F.when(F.col(feature).between(a, b), 2.0).otherwise(1.0))
    total = out.agg(F.sum("weight")).first()[0]
    return out.withColumn("weight", F.col("weight") / total)


def grounded_batch(anchors: DataFrame, continuous: list[str], n: int, seed: int, noise: float = 0.10, weight: str | None = None) -> DataFrame:
    """n anchors with replacement (by weight, where given: whole counts at rejection of uniform draws), noise of noise
    deviations on the continuous columns."""
    sd = anchors.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in continuous]).first() if continuous else {}
    rows, size = numbered(anchors)
    draws = anchors.sparkSession.range(n).withColumnRenamed("id", "draw")
    if weight is None:
        picked = draws.withColumn("__k", rnd.index(size, seed, "anchor", "draw"))
    else:
        top = anchors.agg(F.max(weight)).first()[0]
        tries = draws.select("draw", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("try"))
        tries = tries.withColumn("__k", rnd.index(size, seed, "anchor", "draw", "try")).withColumn("__u", rnd.uniform(seed, "accept", "draw", "try"))
        ok = tries.join(rows.select("__k", F.col(weight).alias("__w")), "__k").where((F.col("__u") * F.lit(float(top)) <= F.col("__w")) | (F.col("try") == 31))
        picked = ok.groupBy("draw").agg(F.min_by("__k", "try").alias("__k"))
    out = picked.join(rows, "__k").drop("__k", "__rid")
    return out.withColumns({c: F.col(c).cast("double") + noise * float(sd[c] or 0.0) * rnd.normal(seed, f"grounded/{c}", "draw") for c in continuous})


# -- copulas --------------------------------------------------------------------------------------------------------

def normal_scores(df: DataFrame, c: str, name: str = "score") -> DataFrame:
    """df with the normal quantile of average rank over n + 1; a constant column scores 0."""
    n, k = df.agg(F.count(c), F.approx_count_distinct(c)).first()
    if k <= 1:
        return df.withColumn(name, F.lit(0.0))
    ranked = average_ranks(df, c, "__r")
    return ranked.withColumn(name, normal_quantile_column(F.col("__r") / F.lit(float(n + 1)))).drop("__r")


def copula_factor(df: DataFrame, columns: list[str]) -> np.ndarray:
    """The Cholesky factor of the scores' correlations, shrunk by a thousandth; identity where they are not finite."""
    scored = df
    for i, c in enumerate(columns):
        scored = normal_scores(scored, c, f"__s{i}")
    d = len(columns)
    r = scored.agg(*[F.avg(F.col(f"__s{i}") * F.col(f"__s{j}")).alias(f"p_{i}_{j}") for i in range(d) for j in range(i + 1)]).first()
    cov = np.array([[r[f"p_{max(i, j)}_{min(i, j)}"] or 0.0 for j in range(d)] for i in range(d)], dtype=float)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = 0.999 * cov / np.outer(sd, sd) + 0.001 * np.eye(d)
    np.fill_diagonal(corr, 1.0)
    if not np.isfinite(corr).all():
        return np.eye(d)
    try:
        return np.linalg.cholesky(corr)
    except np.linalg.LinAlgError:
        return np.eye(d)


def copula_uniforms(spark, factor: np.ndarray, n: int, seed: int) -> DataFrame:
    """(draw, u0, u1, ...): dependent uniforms."""
    d = len(factor)
    base = spark.range(n).select(F.col("id").alias("draw"), *[rnd.normal(seed, f"copula/{j}", "id").alias(f"z{j}") for j in range(d)])
    mixed = [sum((F.lit(float(factor[i, j])) * F.col(f"z{j}") for j in range(i + 1)), F.lit(0.0)) for i in range(d)]
    return base.select("draw", *[normal_cdf_column(m).alias(f"u{i}") for i, m in enumerate(mixed)])


def exact_inverse(draws: DataFrame, u: str, df: DataFrame, c: str) -> DataFrame:
    """draws with u replaced by the value between its neighbours among all sorted values of column c of df."""
    x = df.select(F.col(c).cast("double").alias("__x")).where(F.col("__x").isNotNull() & ~F.isnan("__x"))
    n = x.count()
    if not n:
        return draws.withColumn(u, F.lit(math.nan))
    ranked = row_numbers(x, ["__x"], "__k")
    low = ranked.select(F.col("__k").alias("__low"), F.col("__x").alias("__a"))
    high = ranked.select(F.col("__k").alias("__high"), F.col("__x").alias("__b"))
    place = F.least(F.greatest(F.col(u), F.lit(0.0)), F.lit(1.0)) * F.lit(float(n - 1))
    at = draws.withColumn("__p", place).withColumn("__low", F.floor("__p").cast("long"))
    at = at.withColumn("__high", F.least(F.col("__low") + 1, F.lit(n - 1).cast("long")))
    value = F.col("__a") + (F.col("__p") - F.col("__low")) * (F.col("__b") - F.col("__a"))
    return at.join(low, "__low").join(high, "__high").withColumn(u, value).select(*draws.columns)


def discrete_inverse(u: Column, shares: list[tuple[object, float]]) -> Column:
    """The first value whose running share reaches u."""
    out, total = F.lit(shares[-1][0]), 0.0
    steps = []
    for v, p in shares:
        total += p
        steps.append((v, total))
    for v, t in reversed(steps[:-1]):
        out = F.when(u <= t, F.lit(v)).otherwise(out)
    return out


def parametric_batch(df: DataFrame, fields: dict[str, FieldMeta], n: int, seed: int) -> DataFrame:
    """n rows of a Gaussian copula over all features: continuous ones by quantile inverse, others by their smoothed
    frequencies."""
    names = [m.name for m in fields.values() if not m.is_identifier]
    coded = df
    for m in fields.values():
        if m.kind == "categorical" and m.name in names:
            coded = coded.withColumn(m.name, F.array_position(F.array(*[F.lit(v) for v in m.categories]), F.col(m.name)).cast("double"))
        elif m.name in names:
            coded = coded.withColumn(m.name, F.col(m.name).cast("double"))
    u = copula_uniforms(df.sparkSession, copula_factor(coded, names), n, seed)
    out = []
    for i, c in enumerate(names):
        m = fields[c]
        if m.kind == "continuous":
            u = exact_inverse(u, f"u{i}", df, c)
            out.append(F.col(f"u{i}").alias(c))
        else:
            values = m.categories if m.kind == "categorical" else sorted(set(m.numeric_values))
            shares = {r["value"]: r["p"] for r in smoothed_frequencies(df, c, values).collect()}
            out.append(discrete_inverse(F.col(f"u{i}"), [(v, shares[v]) for v in values]).alias(c))
    return u.select("draw", *out)


def copula_baseline(df: DataFrame, columns: list[str], n: int, seed: int, binary: tuple[str, ...] = ()) -> DataFrame:
    """n rows of a Gaussian copula with plotting positions (rank - 1/2) / n, scores held within 5, quantiles for marginals;
    binary columns are cut at one half."""
    size = df.count()
    scored = df
    for i, c in enumerate(columns):
        ranked = average_ranks(scored, c, "__r")
        score = normal_quantile_column((F.col("__r") - 0.5) / F.lit(float(size)))
        scored = ranked.withColumn(f"__s{i}", F.least(F.greatest(score, F.lit(-5.0)), F.lit(5.0))).drop("__r")
    d = len(columns)
    r = scored.agg(*[F.covar_pop(f"__s{i}", f"__s{j}").alias(f"p_{i}_{j}") for i in range(d) for j in range(i + 1)]).first()
    cov = np.array([[r[f"p_{max(i, j)}_{min(i, j)}"] or 0.0 for j in range(d)] for i in range(d)], dtype=float)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    factor = np.linalg.cholesky(cov / np.outer(sd, sd) + 1e-9 * np.eye(d))
    u = copula_uniforms(df.sparkSession, factor, n, seed)
    for i, c in enumerate(columns):
        u = exact_inverse(u, f"u{i}", df, c)
    out = [F.col(f"u{i}").alias(c) for i, c in enumerate(columns)]
    made = u.select("draw", *out)
    return made.withColumns({c: (F.col(c) >= 0.5).cast("double") for c in binary}) if binary else made


#: A partition of a fit takes so many cells, or more where that would make more partitions than a shuffle has.
_PART = 10_000


def _cells(df: DataFrame, outcome: str, predictors: list[str], apart: bool = False) -> DataFrame:
    """The distinct predictors x0, x1, ... of df, cached: w rows hold them, with a mean outcome y and a sum rest of squares
    about it. apart: of each outcome. Squared loss and mixtures weigh a cell as they weigh its rows, so a fit over cells is a
    fit over all rows; only a mixture's start draws from cells. Incomplete rows are left out, as in the reference."""
    rows = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(predictors)], F.col(outcome).cast("double").alias("label")).dropna()
    by = [*[f"x{i}" for i in range(len(predictors))], *(["label"] if apart else [])]
    grouped = rows.groupBy(*by).agg(F.count("*").cast("double").alias("w"), F.avg("label").alias("y"), (F.var_pop("label") * F.count("*")).alias("rest")).cache()
    parts = min(math.ceil(grouped.count() / _PART), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cells = (grouped.repartition(parts, *by) if parts > 1 else grouped.coalesce(1)).sortWithinPartitions(*by).cache()
    cells.count()
    grouped.unpersist()
    return cells


def _residual_sd(told: DataFrame) -> float:
    """The deviation of all rows' outcomes from what a model told of their cells."""
    gap = F.col("y") - F.col("prediction")
    n, mean = told.agg(F.sum("w"), F.sum(F.col("w") * gap) / F.sum("w")).first()
    return math.sqrt(told.agg(F.sum(F.col("rest") + F.col("w") * (gap - F.lit(mean)) ** 2)).first()[0] / n) if n else 0.0


def conditional_outcome(df: DataFrame, x: DataFrame, outcome: str, predictors: list[str], seed: int, key: str = "draw", trees: int = ROUNDS, depth: int = 3) -> DataFrame:
    """x (key, predictors, from real rows or any sampler) with an outcome: what boosted trees on df say of it, with noise of
    the residual deviation."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    cells = _cells(df, outcome, predictors)
    train = VectorAssembler(inputCols=[f"x{i}" for i in range(len(predictors))], outputCol="features").transform(cells)
    model = GBTRegressor(labelCol="y", weightCol="w", featuresCol="features", maxIter=trees, maxDepth=depth, seed=seed).fit(train)
    resid = _residual_sd(model.transform(train))
    cells.unpersist()
    typed = [F.col(c).cast("double").alias(c) for c in predictors]
    told = model.transform(VectorAssembler(inputCols=predictors, outputCol="features").transform(x.select(key, *typed)))
    return told.select(key, *predictors, (F.col("prediction") + F.lit(resid) * rnd.normal(seed, "outcome", key)).alias(outcome))


# -- constraints ------------------------------------------------------------------------------------------------------

def apply_constraints(df: DataFrame, fields: dict[str, FieldMeta], key: str = "draw") -> DataFrame:
    """Continuous columns within the real range, whole ones rounded half to even; binary ones at the nearer value;
    identifiers minted beyond the real ones, in the order of key."""
    out, ids = {}, []
    for m in fields.values():
        if m.is_identifier:
            ids.append(m)
        elif m.name not in df.columns:
            continue
        elif m.kind == "continuous":
            held = F.least(F.greatest(F.col(m.name).cast("double"), F.lit(float(m.low))), F.lit(float(m.high)))
            out[m.name] = F.rint(held) if m.is_integer else held
        elif m.kind == "binary" and m.numeric_values and not isinstance(m.numeric_values[0], bool):
            low, high = m.numeric_values
            out[m.name] = F.when(F.col(m.name) >= (low + high) / 2, F.lit(high)).otherwise(F.lit(low))
    held = df.withColumns(out) if out else df
    if not ids:
        return held
    rows = row_numbers(held.drop(*[m.name for m in ids]), [key], "__k")
    minted = {m.name: (F.col("__k") + F.lit(int(m.high) + 1)) if m.high is not None else F.concat(F.lit(f"{m.name}-"), F.col("__k").cast("string")) for m in ids}
    return rows.withColumns(minted).drop("__k")


# -- estimand-preserving ----------------------------------------------------------------------------------------------

def estimand_preserving(df: DataFrame, outcome: str, predictors: list[str], n: int, seed: int, binary: bool, trees: int = ROUNDS, depth: int = 3) -> DataFrame:
    """Predictors from a Gaussian mixture, the outcome from boosted trees given them: a coin of the fitted chance, or the
    fitted mean with noise of the residual deviation."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import GBTRegressor

    cells = _cells(df, outcome, predictors, apart=binary)
    total = cells.agg(F.sum("w").alias("n"), *[(F.sum(F.col("w") * F.col(f"x{i}")) / F.sum("w")).alias(f"m{i}") for i in range(len(predictors))]).first()
    mean = [total[f"m{i}"] for i in range(len(predictors))]
    spread = cells.agg(*[F.sqrt(F.sum(F.col("w") * (F.col(f"x{i}") - F.lit(m)) ** 2) / F.sum("w")) for i, m in enumerate(mean)]).first()
    sd = [s or 1.0 for s in spread]
    z = cells.select("w", "y", "rest", *[((F.col(f"x{i}") - F.lit(m)) / F.lit(s)).alias(f"z{i}") for i, (m, s) in enumerate(zip(mean, sd, strict=True))])
    assembler = VectorAssembler(inputCols=[f"z{i}" for i in range(len(predictors))], outputCol="features")
    x = assembler.transform(z).cache()
    mixture = GaussianMixture(k=max(1, min(20, int(total["n"]) // 50)), seed=seed, featuresCol="features", weightCol="w").fit(x)
    parts = [(w, np.array(r["mean"]), np.linalg.cholesky(np.array(r["cov"].toArray()) + 1e-6 * np.eye(len(predictors)))) for w, r in zip(mixture.weights, mixture.gaussiansDF.collect(), strict=True)]
    learner = GBTClassifier if binary else GBTRegressor
    model = learner(labelCol="y", weightCol="w", featuresCol="features", maxIter=trees, maxDepth=depth, seed=seed).fit(x)
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), rnd.uniform(seed, "part", "id").alias("__u"), *[rnd.normal(seed, f"mix/{j}", "id").alias(f"e{j}") for j in range(len(predictors))])
    bounds = np.cumsum([w for w, _, _ in parts])
    cols = []
    for i in range(len(predictors)):
        c = None
        for b, (_, m, low) in list(zip(bounds, parts, strict=True))[::-1]:
            v = F.lit(float(m[i])) + sum((F.lit(float(low[i, j])) * F.col(f"e{j}") for j in range(i + 1)), F.lit(0.0))
            c = v if c is None else F.when(F.col("__u") <= float(b), v).otherwise(c)
        cols.append(c.alias(f"z{i}"))
    told = model.transform(assembler.transform(draws.select("draw", *cols)))
    if binary:
        chance = vector_to_array("probability")[1]
        y = (rnd.uniform(seed, "outcome", "draw") < chance).cast("double")
    else:
        y = F.col("prediction") + F.lit(_residual_sd(model.transform(x))) * rnd.normal(seed, "outcome", "draw")
    x.unpersist()
    cells.unpersist()
    return told.select("draw", y.alias(outcome), *[(F.col(f"z{i}") * F.lit(s) + F.lit(m)).alias(c) for i, (c, m, s) in enumerate(zip(predictors, mean, sd, strict=True))])
