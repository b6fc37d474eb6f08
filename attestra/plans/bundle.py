"""Audit bundles: disclosed aggregates, manifest, explanation, and the check that recomputes them."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from attestra import __version__
from attestra.functions.ordered import quantile_table
from attestra.operators.fidelity import class_moments, correlations, fisher_rank
from attestra.operators.regression import METRIC_VERSION, Estimand, evaluate, reference_aggregate
from attestra.plans.scenario import schema_hash
from attestra.sources.tables import canonical_hash

#: Metric -> version, tolerance, whether the bundle's own aggregates suffice to recompute it.
METRICS = {
    "correlation": {"version": "1", "tolerance": 5e-4, "recomputable": True},
    "separation": {"version": "1", "tolerance": 1e-4, "recomputable": True},
    "class_counts": {"version": "1", "tolerance": 0.0, "recomputable": True},
    "estimand": {"version": METRIC_VERSION, "tolerance": 1e-6, "recomputable": True},
    "tvd": {"version": "1", "tolerance": 1e-6, "recomputable": False},
    "wasserstein": {"version": "1", "tolerance": 1e-6, "recomputable": False},
    "coverage": {"version": "1", "tolerance": 1e-6, "recomputable": False},
    "nearest_distance": {"version": "1", "tolerance": 1e-6, "recomputable": False},
}
MIN_BUCKET = 10


def metric_versions() -> dict[str, str]:
    return {k: v["version"] for k, v in METRICS.items()}


def tolerance(metric: str) -> float:
    return METRICS[metric]["tolerance"]


def reference_aggregates(df: DataFrame, columns: list[str], spec: Estimand | None = None) -> dict:
    """What of a table with __rare is disclosed: class counts, rare correlations, moments by class, and rare deciles only
    from MIN_BUCKET rare rows on."""
    counts = {str(r["__rare"]).lower(): r["count"] for r in df.groupBy("__rare").count().collect()}
    rare = df.where("__rare")
    out = {
        "class_counts": counts,
        "correlations": [{"a": r["a"], "b": r["b"], "r": None if r["r"] is None else round(r["r"], 8)} for r in correlations(rare, columns).collect()] if len(columns) > 1 else [],
        "moments": [r.asDict() for r in class_moments(df, columns).orderBy("feature", "rare").collect()],
    }
    if counts.get("true", 0) >= MIN_BUCKET:
        out["deciles"] = quantile_table(rare, columns, [k / 10 for k in range(11)])
    else:
        out["deciles"] = None
    if spec is not None:
        out["estimand"] = reference_aggregate(df, spec)
    return out


def explanation(report: dict) -> dict:
    """The parts of a generation report that a reader needs, by heading."""
    return {k: report.get(k) for k in ("gates", "separation", "provenance", "utility", "estimand", "privacy", "passed")}


def manifest(seed: int, fields: dict, config: dict, artefacts: dict[str, str]) -> dict:
    return {"seed": seed, "schema": schema_hash(fields), "config": config, "package_version": __version__, "metric_versions": metric_versions(), "artefacts": artefacts}


def digest(obj: dict) -> str:
    return hashlib.sha256(json.dumps(obj, sort_keys=True, default=str).encode()).hexdigest()


def write_bundle(out_dir: str, batch: DataFrame, fields: dict, columns: list[str], seed: int, config: dict, report: dict, spec: Estimand | None = None, real: DataFrame | None = None) -> dict:
    """batch.parquet, reference_aggregates.json, explanation.json and, last, manifest.json with their hashes."""
    d = Path(out_dir)
    d.mkdir(parents=True, exist_ok=True)
    batch.write.mode("overwrite").parquet(str(d / "batch.parquet"))
    rows = batch.sparkSession.read.parquet(str(d / "batch.parquet"))
    delivered = {"synthetic": reference_aggregates(rows, columns), "real": reference_aggregates(real, columns, spec) if real is not None else None}
    if spec is not None and real is not None:
        delivered["estimand"] = evaluate(real, rows, spec)
    delivered["separation"] = [r.asDict() for r in fisher_rank(rows, columns).orderBy("rank").collect()]
    told = explanation(report)
    artefacts = {"batch": canonical_hash(rows), "reference_aggregates": digest(delivered), "explanation": digest(told)}
    for name, obj in (("reference_aggregates", delivered), ("explanation", told), ("manifest", manifest(seed, fields, {**config, "columns": columns, "estimand": None if spec is None else spec.__dict__}, artefacts))):
        (d / f"{name}.json").write_text(json.dumps(obj, sort_keys=True, default=str))
    return artefacts


def verify_bundle(spark: SparkSession, out_dir: str) -> dict:
    """Hashes of every artefact, then every statistic that the delivered rows give again."""
    d = Path(out_dir)
    man, agg, told = (json.loads((d / f"{n}.json").read_text()) for n in ("manifest", "reference_aggregates", "explanation"))
    rows = spark.read.parquet(str(d / "batch.parquet")).cache()
    checks: list[dict] = []

    def check(name: str, ok: bool | None, detail: str = "") -> None:
        checks.append({"check": name, "passed": ok, "detail": detail})

    found = {"batch": canonical_hash(rows), "reference_aggregates": digest(agg), "explanation": digest(told)}
    for k, v in man["artefacts"].items():
        check(f"hash:{k}", found[k] == v)
    check("metric_versions", True, "" if man["metric_versions"] == metric_versions() else "other metric versions; tolerances may not apply")
    columns, own = man["config"]["columns"], agg["synthetic"]
    counts = {str(r["__rare"]).lower(): r["count"] for r in rows.groupBy("__rare").count().collect()}
    check("class_counts", counts == own["class_counts"], f"{counts}")
    if len(columns) > 1:
        now = {(r["a"], r["b"]): r["r"] for r in correlations(rows.where("__rare"), columns).collect()}
        worst = max((abs((now[(r["a"], r["b"])] or 0.0) - (r["r"] or 0.0)) for r in own["correlations"]), default=0.0)
        check("correlation", worst <= tolerance("correlation"), f"{worst:.2g}")
    now = {r["feature"]: r["separation"] for r in fisher_rank(rows, columns).collect()}
    worst = max((abs(now[r["feature"]] - r["separation"]) for r in agg["separation"]), default=0.0)
    check("separation", worst <= tolerance("separation"), f"{worst:.2g}")
    e = man["config"].get("estimand")
    if e and agg.get("estimand", {}).get("status") in ("certified", "not_preserved"):
        spec = Estimand(**{**e, "predictors": tuple(e["predictors"]), "targets": tuple(e["targets"])})
        own_fit = reference_aggregate(rows, spec)["theta"]
        worst = max((abs(own_fit[t["coefficient"]]["coef"] - t["theta_synth"]) for t in agg["estimand"]["targets"] if t["preserved"] is not None), default=0.0)
        check("estimand", worst <= tolerance("estimand") * max(1.0, max(abs(x["coef"]) for x in own_fit.values())), f"{worst:.2g}")
    for k, v in METRICS.items():
        if not v["recomputable"]:
            check(k, None, "needs the real rows")
    rows.unpersist()
    return {"passed": all(c["passed"] for c in checks if c["passed"] is not None), "checks": checks}
