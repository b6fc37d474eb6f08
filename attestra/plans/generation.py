"""Rare-class generation end to end: one pass, tuning, delivery, campaigns, screening, trade-offs."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators import evaluate as ev
from attestra.operators import fidelity, ingest, privacy, regression, sampling, tail
from attestra.operators.fidelity import AuditorConfig
from attestra.operators.ingest import FieldMeta, IngestConfig, RareEvent
from attestra.operators.regression import Estimand
from attestra.plans import bundle, scenario
from attestra.sources.tables import load, write_batch

MODES, PRIVACY = ("faithful", "balanced", "boost"), ("none", "floored")
MIN_RARE_SHARE = 0.25
NOISES = (0.05, 0.08, 0.10, 0.13, 0.16, 0.20)
DELTAS = (0.3, 0.5, 0.8)
#: Where each part of a run takes its seeds from: tuning, delivery, normal part, lift, floor.
OFFSETS = {"tune": 7000, "final": 9000, "normal": 7777, "lift": 12345, "floor": 4242}


@dataclass
class Ingested:
    """A flagged table (__rid, __rare), its label and the profile of its features."""

    rows: DataFrame
    label: str
    rare: RareEvent
    fields: dict[str, FieldMeta]
    n_rare: int
    n_normal: int

    @property
    def features(self) -> list[str]:
        return [m.name for m in self.fields.values() if not m.is_identifier]

    @property
    def continuous(self) -> list[str]:
        return privacy.continuous_columns(self.fields, self.label)

    @property
    def discrete(self) -> list[str]:
        return [m.name for m in self.fields.values() if m.kind != "continuous" and not m.is_identifier]

    def part(self, rare: bool) -> DataFrame:
        return self.rows.where("__rare" if rare else "not __rare")


def ingest_table(spark: SparkSession, source: str | DataFrame, label: str = "", rare: RareEvent | None = None, cfg: IngestConfig = IngestConfig()) -> Ingested:
    """load, find the label, fill nulls, flag the rare class, profile. The result is cached."""
    df = load(spark, source) if isinstance(source, str) else source
    label = label or (rare.column if rare else "") or ingest.detect_target(df, cfg)
    rare = rare or RareEvent(label)
    rows = ingest.with_row_id(ingest.impute(df, label))
    rows = ingest.flag_rare(rows, rare, cfg).cache()
    k, n = rows.agg(F.count_if("__rare"), F.count("*")).first()
    fields = {c: m for c, m in ingest.field_profile(rows.drop("__rid", "__rare")).items() if c != label}
    return Ingested(rows, label, rare, fields, k, n - k)


def _label_value(data: Ingested, rare: bool):
    """The commonest label of a class, ties to the smallest."""
    counts = data.part(rare).groupBy(data.label).agg(F.count("*").alias("n"))
    return counts.agg(F.min_by(data.label, F.struct(-F.col("n"), F.col(data.label)))).first()[0]


def _finish(batch: DataFrame, data: Ingested, rare: bool, coded: bool) -> DataFrame:
    """Constraints, label, categories, in that order."""
    held = sampling.apply_constraints(batch, {k: m for k, m in data.fields.items() if not m.is_identifier})
    labelled = held.withColumn(data.label, F.lit(_label_value(data, rare)))
    return ingest.decode_categories(labelled, data.fields) if coded else labelled


def make_rare(data: Ingested, n: int, seed: int, noise: float, private: bool, anchors: np.ndarray | None = None) -> tuple[DataFrame, dict]:
    """n rare rows: the base sampler (a copula where private), the tail correction, constraints, and the verbatim guard."""
    told: dict = {"base": "parametric" if private else "grounded"}
    rare = data.part(True)
    if private:
        batch = _finish(sampling.parametric_batch(rare, data.fields, n, seed), data, True, coded=False)
    else:
        coded = ingest.encode_categories(data.rows, {c: data.fields[c] for c in data.features})
        rare_coded = coded.where("__rare")
        # P(normal): real normal rows against standard normal rows, of which there are a twentieth
        sample = ingest.exact_sample(coded.where("not __rare"), 5000, seed)
        moments, _ = sampling.fit_naive_bayes(sample, data.features)
        moments, prior = {False: moments[False], True: [(0.0, 1.0)] * len(data.features)}, {False: 1 / 1.05, True: 0.05 / 1.05}
        gp, chosen = tail.fit_correction(rare_coded, data.features, sampling.naive_bayes_normal(rare_coded, data.features, moments, prior))
        sd = rare_coded.agg(*[F.stddev_pop(c).alias(c) for c in chosen]).first()
        target = tail.select_target(gp, np.array([sd[c] or 0.0 for c in chosen]), seed, anchors=anchors)
        told |= {"target": chosen[target["feature"]], "target_score": target["score"], "anchor": target["anchor"].tolist(), "gp_warning": gp.warning}
        weighted = sampling.target_weights(rare_coded, chosen[target["feature"]], target["low"], target["high"])
        base = sampling.grounded_batch(weighted, data.continuous, n, seed, noise, "weight").drop("weight", "__rare", data.label)
        moved = tail.sample_correction(base, gp, chosen, [c in data.continuous for c in chosen], seed)
        batch = _finish(moved, data, True, coded=True)
    batch = batch.withColumn("__rid", F.col("draw"))
    batch, told["n_duplicates"] = privacy.guard_duplicates(batch, rare, data.continuous, data.discrete, seed)
    # the guard's noise may leave the real range or whole numbers
    batch = sampling.apply_constraints(batch, {c: data.fields[c] for c in data.continuous})
    return batch.drop("__rid"), told


def make_normal(data: Ingested, n: int, seed: int, noise: float) -> DataFrame:
    """n normal rows around real ones."""
    coded = ingest.encode_categories(data.part(False), {c: data.fields[c] for c in data.features})
    base = sampling.grounded_batch(coded, data.continuous, n, seed, noise).drop("__rare", data.label)
    return _finish(base, data, False, coded=True)


def _audit(data: Ingested, batch: DataFrame, rare: bool, coverage: float, check: bool) -> dict:
    return fidelity.audit(data.part(rare), batch, {c: data.fields[c] for c in data.features}, AuditorConfig(coverage=coverage), check)


def one_pass(data: Ingested, n: int, seed: int, noise: float, private: bool, coverage: float, lift: bool = False, anchors: np.ndarray | None = None) -> dict:
    """A rare batch and its audit; lift is only measured if the audit passes, and never with rows of the test part."""
    batch, told = make_rare(data, n, seed, noise, private, anchors)
    batch = batch.cache()
    report = _audit(data, batch, True, coverage, True)
    out = {"batch": batch, "report": report, "told": told, "lift": None}
    if lift and report["passed"]:
        out["lift"] = measure(data, n, seed + OFFSETS["lift"], noise)
    return out


def measure(data: Ingested, n: int, seed: int, noise: float) -> dict:
    """Lift of the generator that delivers, tail correction included, fitted on the train part only."""

    def generate(train: DataFrame) -> DataFrame:
        part = replace(data, rows=train)
        batch, _ = make_rare(part, n, seed, noise, False)
        return ingest.encode_categories(batch, {c: data.fields[c] for c in data.features})

    coded = lambda df: ingest.encode_categories(df, {c: data.fields[c] for c in data.features})
    return ev.measure_lift(data.rows, data.features, generate, seed=seed, coded=coded)


def autotune(data: Ingested, n: int, seed: int, mode: str, coverage: float, noises: tuple[float, ...] = NOISES) -> tuple[float, list[dict]]:
    """The best noise: most columns passed for faithful, else most lift among those that pass the audit."""
    trail = []
    for i, noise in enumerate(noises):
        p = one_pass(data, n, seed + OFFSETS["tune"] + i, noise, False, coverage, lift=mode != "faithful")
        gain = (p["lift"] or {}).get("lift")
        trail.append({"noise": noise, "passed": p["report"]["passed"], "score": p["report"]["score"], "lift": gain})
        p["batch"].unpersist()
    if mode == "faithful":
        best = max(trail, key=lambda t: (t["passed"], t["score"], -t["noise"]))
    else:
        best = max(trail, key=lambda t: (t["passed"], t["lift"] if t["lift"] is not None else -1.0, t["score"], -t["noise"]))
    return best["noise"], trail


def generate(spark: SparkSession, source: str | DataFrame, label: str = "", rare: RareEvent | None = None, n_rows: int = 300, mode: str = "balanced", seed: int = 42, auto: bool = True,
             noise_scale: float | None = None, coverage: float | None = None, rare_ratio: float | None = None, private: str = "floored", delta: float = 0.5, out_dir: str | None = None,
             use_case: scenario.Scenario | None = None, estimand: Estimand | None = None) -> dict:
    """A delivered table of n_rows rows with both classes, its gates, and an audit bundle in out_dir. A batch that fails
    is delivered with passed False."""
    if use_case is not None:
        label, mode, private, delta = use_case.label or label, use_case.mode, use_case.privacy, use_case.delta
        coverage, estimand = use_case.gates.coverage if coverage is None else coverage, use_case.estimand or estimand
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if private not in PRIVACY:
        raise ValueError(f"private must be one of {PRIVACY}")
    if not 0 < delta <= 2:
        raise ValueError("delta must lie in (0, 2]")
    if rare_ratio is not None and not 0 < rare_ratio < 1:
        raise ValueError("rare_ratio must lie in (0, 1)")
    coverage = (0.30 if mode == "boost" else 0.50) if coverage is None else coverage
    data = ingest_table(spark, source, label, rare)
    share = rare_ratio if rare_ratio is not None else max(data.n_rare / (data.n_rare + data.n_normal), MIN_RARE_SHARE)
    n_rare = max(1, round(n_rows * share))
    n_rare = min(n_rare, n_rows - 1) if n_rows > 1 else n_rare
    noise, trail = autotune(data, n_rare, seed, mode, coverage) if auto else (0.10 if noise_scale is None else noise_scale, [])
    final = seed + OFFSETS["final"]
    rare_part = one_pass(data, n_rare, final, noise, private == "floored", coverage, lift=not auto and mode != "faithful")
    normal = make_normal(data, n_rows - n_rare, final + OFFSETS["normal"], noise).cache()
    normal_report = _audit(data, normal, False, coverage, False)
    cols = [c for c in data.fields if not data.fields[c].is_identifier] + [data.label]
    both = normal.select(*cols, F.lit("normal").alias("part"), F.col("draw")).unionByName(rare_part["batch"].select(*cols, F.lit("rare").alias("part"), (F.col("draw") + n_rows).alias("draw")))
    both = sampling.apply_constraints(both, {c: m for c, m in data.fields.items() if m.is_identifier}).withColumn("__rid", F.col("draw"))
    floor = None
    if private == "floored":
        both, floor = privacy.floor_delivered(both, data.part(True), data.fields, data.label, delta, final + OFFSETS["floor"])
    both = both.withColumn("__rare", F.col("part") == "rare").drop("draw").cache()
    delivered_rare = both.where("__rare")
    report = _audit(data, delivered_rare, True, coverage, True) if private == "floored" else rare_part["report"]
    assessed = privacy.assess(delivered_rare, data.part(True), data.continuous, data.discrete, delta if private == "floored" else 0.0)
    claims, verdicts = scenario.resolve(data.fields, use_case.columns if use_case else [])
    violations = [r.asDict() for r in fidelity.conformance(both, scenario.rules(claims), data.label).collect()]
    kept = regression.evaluate(data.rows, both, estimand)
    passed = report["passed"] and not violations and (private != "floored" or floor.skipped is not None or floor.passed)
    told = {
        "gates": {"rare": report, "normal": normal_report, "conformance": violations}, "separation": [r.asDict() for r in fidelity.fisher_rank(both, data.continuous or data.features[:0]).collect()] if data.continuous else [],
        "provenance": {**rare_part["told"], "noise": noise, "trail": trail, "verdicts": verdicts}, "utility": rare_part["lift"], "estimand": kept, "privacy": {"floor": asdict(floor) if floor else None, "assessed": asdict(assessed)}, "passed": bool(passed),
    }
    out_dir = out_dir or tempfile.mkdtemp(prefix="attestra-run-")
    Path(out_dir).mkdir(parents=True, exist_ok=True)
    path = write_batch(both.drop("__rid"), str(Path(out_dir) / "pass_0_accepted.parquet"))
    bundle.write_bundle(out_dir, both.drop("__rid"), data.fields, data.continuous, seed, {"mode": mode, "n_rows": n_rows, "noise": noise, "privacy": private, "delta": delta}, told, estimand, data.rows)
    (Path(out_dir) / "scenario.yaml").write_text((use_case or scenario.Scenario(label=data.label, mode=mode, privacy=private, delta=delta, columns=claims, estimand=estimand)).to_yaml())
    return {"passed": bool(passed), "out_dir": out_dir, "path": path, "rows": both.drop("__rid"), "n_rare": n_rare, "n_normal": n_rows - n_rare, "noise": noise, "trail": trail, "explanation": told}


def run_campaign(spark: SparkSession, source: str | DataFrame, label: str = "", rare: RareEvent | None = None, n_rows: int = 300, max_passes: int = 5, coverage: float = 0.80, private: str = "none", seed: int = 42, out_dir: str | None = None) -> dict:
    """Passes with seeds seed, seed + 1, ...; accepted batches are written, and where a pass looked lowers the next ones'
    interest there."""
    import json

    data = ingest_table(spark, source, label, rare)
    out = Path(out_dir or tempfile.mkdtemp(prefix="attestra-campaign-"))
    out.mkdir(parents=True, exist_ok=True)
    anchors, passes = [], []
    for k in range(max_passes):
        p = one_pass(data, n_rows, seed + k, 0.10, private == "floored", coverage, lift=True, anchors=np.array(anchors) if anchors else None)
        if p["told"].get("anchor"):
            anchors.append(p["told"]["anchor"])
        row = {"pass": k, "accepted": p["report"]["passed"], "score": p["report"]["score"], "lift": (p["lift"] or {}).get("lift"), "path": None}
        if row["accepted"]:
            row["path"] = write_batch(p["batch"], str(out / f"pass_{k}_accepted.parquet"))
        p["batch"].unpersist()
        passes.append(row)
    accepted = [r for r in passes if r["accepted"]]
    best = max(accepted, key=lambda r: r["lift"] if r["lift"] is not None else -1.0, default=None)
    summary = {"passes": passes, "n_accepted": len(accepted), "n_rejected": len(passes) - len(accepted), "best_lift": best["lift"] if best else None, "best_batch_path": best["path"] if best else None}
    (out / "campaign_summary.json").write_text(json.dumps(summary))
    return {**summary, "out_dir": str(out)}


def evaluate_surrogate(spark: SparkSession, source: str | DataFrame, label: str = "", rare: RareEvent | None = None, test_size: float = 0.30, seeds: tuple[int, ...] = (42, 53, 61), make: Callable[[Ingested], DataFrame] | None = None, seed: int = 42) -> dict:
    """Train-on-synthetic test-on-real: the surrogate comes from the train part only, whose profile is used throughout."""
    data = ingest_table(spark, source, label, rare)
    train, test = ev.stratified_split(data.rows, test_size, seed)
    part = ingest_table(spark, train.drop("__rid", "__rare"), data.label, data.rare)
    feats = {c: data.fields[c] for c in data.features}

    def surrogate(d: Ingested) -> DataFrame:
        r, _ = make_rare(d, d.n_rare, seed, 0.10, False)
        return make_normal(d, d.n_normal, seed + OFFSETS["normal"], 0.10).select(*d.features).withColumn("__rare", F.lit(False)).unionByName(r.select(*d.features).withColumn("__rare", F.lit(True)))

    made = (make or surrogate)(part)
    coded = [ingest.encode_categories(x.select("__rare", *data.features), feats) for x in (train, test, made)]
    return ev.measure_tstr(*coded, data.features, seeds)


def screen(spark: SparkSession, source: str | DataFrame, label: str = "", rare: RareEvent | None = None, seed: int = 42) -> dict:
    data = ingest_table(spark, source, label, rare)
    coded = ingest.encode_categories(data.rows, {c: data.fields[c] for c in data.features})

    def own(train: DataFrame) -> DataFrame:
        rows = train.where("__rare")
        return sampling.grounded_batch(rows, data.continuous, rows.count(), seed)

    return ev.screen(coded, data.features, own, seed, fidelity.fisher_cv(coded, data.features))


def diagnose(result: dict) -> list[str]:
    """Why a generation failed, in plain words."""
    out, gates = [], result["explanation"]["gates"]
    for r in gates["rare"]["columns"]:
        if not r["passed"]:
            out.append(f"{r['column']}: its distribution is too far from the real one")
    if gates["rare"]["correlation_shift"] is not None and gates["rare"]["correlation_shift"] > AuditorConfig().correlation:
        out.append("correlations between columns have moved")
    if gates["rare"]["coverage"] is not None and gates["rare"]["coverage"] < AuditorConfig().coverage:
        out.append("parts of the real rare class are not covered")
    out += [f"{v['column']}: {v['n_rows']} rows with {v['violation']}" for v in gates["conformance"]]
    floor = result["explanation"]["privacy"]["floor"]
    if floor and not floor["passed"] and not floor["skipped"]:
        out.append("some rows could not be moved to the distance floor")
    return out


def explore_options(spark: SparkSession, source: str | DataFrame, label: str = "", rare: RareEvent | None = None, n_rows: int = 300, seed: int = 42, deltas: tuple[float, ...] = DELTAS) -> dict:
    """The trade-off between floor and fidelity: no floor and each delta; the largest passing delta is recommended."""
    options = []
    for private, delta in (("none", 0.5), *[("floored", d) for d in deltas]):
        r = generate(spark, source, label, rare, n_rows, seed=seed, auto=False, private=private, delta=delta)
        options.append({"privacy": private, "delta": delta if private == "floored" else None, "passed": r["passed"], "score": r["explanation"]["gates"]["rare"]["score"], "reasons": diagnose(r)})
    best = max((o for o in options if o["passed"] and o["delta"] is not None), key=lambda o: o["delta"], default=None)
    return {"options": options, "recommended": best}


