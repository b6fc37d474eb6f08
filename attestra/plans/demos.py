"""Runs that put operators together: which sources keep a conclusion, and what common checks say of those that do not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.operators import distance, evaluate, fidelity, ingest, sampling
from attestra.operators.regression import Estimand, certify_many

#: Cut-offs (KS, correlation shift, train-on-synthetic ratio) from strict to lenient.
CUTOFFS = ((0.10, 0.10, 0.95), (0.15, 0.10, 0.95), (0.20, 0.20, 0.85))


def sources(real: DataFrame, spec: Estimand, n: int, seed: int, trees: int = sampling.ROUNDS) -> dict[str, DataFrame]:
    """Seven synthetic tables of real (with __rid): two controls, and five samplers."""
    cols = [spec.outcome, *spec.predictors]
    rows = real.select("__rid", *[F.col(c).cast("double").alias(c) for c in cols])
    binary = (spec.outcome,) if spec.family == "logit" else ()
    made = {
        "bootstrap": sampling.bootstrap(rows, n, seed),
        "independent": sampling.independent_columns(rows, cols, n, seed),
        "noised": sampling.noised(rows, list(spec.predictors), n, seed),
        "copula": sampling.copula_baseline(rows, cols, n, seed, binary),
        "smote": distance.smote(rows, cols, n, seed),
        "grounded": sampling.grounded_batch(rows, list(spec.predictors), n, seed),
        "estimand_preserving": sampling.estimand_preserving(rows, spec.outcome, list(spec.predictors), n, seed, spec.family == "logit", trees),
    }
    if spec.family == "logit":
        made["smote"] = made["smote"].withColumn(spec.outcome, (F.col(spec.outcome) >= 0.5).cast("double"))
    else:
        made["conditional_on_real_x"] = sampling.conditional_outcome(rows, made["bootstrap"], spec.outcome, list(spec.predictors), seed, trees=trees)
        made["conditional_on_copula_x"] = sampling.conditional_outcome(rows, made["copula"], spec.outcome, list(spec.predictors), seed, trees=trees)
    return {k: v.select(*cols) for k, v in made.items()}


def certify_sources(real: DataFrame, spec: Estimand, n: int = 6000, seed: int = 7) -> dict[str, dict]:
    """Certificates by source, from one union table."""
    both = None
    for name, df in sources(real, spec, n, seed).items():
        part = df.withColumn("source", F.lit(name))
        both = part if both is None else both.unionByName(part)
    return certify_many(real, both, spec)


def standard_checks(real: DataFrame, synth: DataFrame, spec: Estimand, tstr: float | None = None) -> dict:
    """Largest KS distance, largest correlation shift, the ratio handed in, and which cut-offs they pass."""
    cols = [spec.outcome, *spec.predictors]
    ks = fidelity.marginal_ks(real, synth, list(spec.predictors))
    shift = fidelity.correlation_shift(real, synth, cols).first()["max_shift"]
    passed = [ks <= a and (shift or 0.0) <= b and (tstr is None or tstr >= c) for a, b, c in CUTOFFS]
    return {"ks": ks, "correlation_shift": shift, "tstr": tstr, "passed": passed}


def boosted_ratio(real: DataFrame, synth: DataFrame, spec: Estimand, seed: int = 7) -> float:
    """ROC-AUC on real test rows of boosted trees trained on synth, over trained on real."""
    flagged = [df.select(*[F.col(c).cast("double").alias(c) for c in spec.predictors], (F.col(spec.outcome) == 1).alias("__rare"), *(["__rid"] if "__rid" in df.columns else [])) for df in (real, synth)]
    train, test = evaluate.stratified_split(flagged[0], 0.3, seed)
    out = evaluate.measure_tstr(train, test, flagged[1], list(spec.predictors), (seed,), min_test_rare=1)
    return next((r["roc_ratio"] for r in out.get("rows", []) if r["model"] == "boosted"), float("nan"))


def mechanism_gap(real: DataFrame, made: dict[str, DataFrame], outcome: str, by: str) -> dict[str, dict]:
    """How much the mean outcome rises over the levels of by (rounded, -2 to 4), for real and each source, and the largest
    single step."""
    out = {}
    for name, df in {"real": real, **made}.items():
        level = F.least(F.greatest(F.rint(F.col(by).cast("double")), F.lit(-2.0)), F.lit(4.0))
        rows = fidelity.grouped_rate(df, outcome, level).orderBy("level").collect()
        out[name] = {"rise": rows[-1]["rate"] - rows[0]["rate"] if rows else None, "biggest_step": max((r["step"] for r in rows if r["step"] is not None), default=None)}
    return out


def control_rates(real: DataFrame, spec: Estimand, seeds: range, n: int = 6000) -> dict:
    """How often the bootstrap is refused and independent columns are certified; all seeds are fitted in one union."""
    rows, both = ingest.with_row_id(real), None
    for s in seeds:
        for name, df in (("positive", sampling.bootstrap(rows, n, s)), ("negative", sampling.independent_columns(rows, [spec.outcome, *spec.predictors], n, s))):
            part = df.select(spec.outcome, *spec.predictors).withColumn("source", F.lit(f"{name}:{s}"))
            both = part if both is None else both.unionByName(part)
    status = {k: v["status"] for k, v in certify_many(real, both, spec).items()}
    return {"positive_refused": sum(v != "certified" for k, v in status.items() if k.startswith("positive")), "negative_certified": sum(v == "certified" for k, v in status.items() if k.startswith("negative")), "seeds": len(seeds)}
