"""Runs over settings and tables: privacy modes, noise scales, and a comparison with kept figures."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from attestra.operators.ingest import RareEvent
from attestra.plans import bundle, generation

#: How far a figure may move from a kept one: shares and shifts, lift, and wall time as factor and seconds on top.
TOLERANCES = {"score": 0.05, "coverage": 0.05, "correlation_shift": 0.05, "lift": 0.08}
TIME_FACTOR, TIME_MORE = 4.0, 5.0


def figures(spark: SparkSession, source: str | DataFrame, label: str, rare: RareEvent | None = None, n_rows: int = 400, seed: int = 11, **options) -> dict:
    """What one generation gives, its bundle verified and its wall time taken."""
    started = time.monotonic()
    r = generation.generate(spark, source, label, rare, n_rows, seed=seed, **options)
    verified = bundle.verify_bundle(spark, r["out_dir"])["passed"]
    told = r["explanation"]
    report, floor = told["gates"]["rare"], told["privacy"]["floor"]
    return {
        "passed": r["passed"], "verified": verified, "score": report["score"], "coverage": report["coverage"], "correlation_shift": report["correlation_shift"], "lift": (told["utility"] or {}).get("lift"),
        "min_distance": told["privacy"]["assessed"]["low"], "floor_skipped": floor["skipped"] if floor else None, "seconds": time.monotonic() - started,
    }


def compare(now: dict[str, dict], kept: dict[str, dict]) -> list[str]:
    """What is worse in now than in kept, by run: other verdicts, figures beyond their tolerance, time beyond its budget;
    runs that are missing."""
    out = [f"{name}: no run" for name in kept if name not in now]
    for name, old in kept.items():
        new = now.get(name, {})
        for key, most in TOLERANCES.items():
            if new and (old.get(key) is None) != (new.get(key) is None):
                out.append(f"{name}: {key} {old.get(key)} -> {new.get(key)}")
            elif new and old.get(key) is not None and abs(new[key] - old[key]) > most:
                out.append(f"{name}: {key} {old[key]:.4f} -> {new[key]:.4f}")
        out += [f"{name}: {key} no longer holds" for key in ("passed", "verified") if new and old.get(key) and not new.get(key)]
        if new and new["seconds"] > old["seconds"] * TIME_FACTOR + TIME_MORE:
            out.append(f"{name}: {new['seconds']:.1f} s, {old['seconds']:.1f} s before")
    return out


def privacy_sweep(spark: SparkSession, sources: dict[str, tuple[str | DataFrame, str]], n_rows: int = 400, seed: int = 7, delta: float = 0.5, mode: str = "balanced") -> dict[str, dict]:
    """figures() of each named (table, label), without and with the distance floor, without tuning."""
    return {f"{name}/{private}": figures(spark, df, label, n_rows=n_rows, seed=seed, auto=False, private=private, delta=delta, mode=mode) for name, (df, label) in sources.items() for private in generation.PRIVACY}


def noise_sweep(spark: SparkSession, source: str | DataFrame, label: str, rare: RareEvent | None = None, noises: tuple[float, ...] = (0.02, 0.05, 0.08, 0.10, 0.15, 0.20, 0.30), seeds: tuple[int, ...] = (42, 43), n_rows: int = 300) -> list[dict]:
    """Score, verdict and lift of one pass for each noise scale and seed, over one ingested table."""
    data = generation.ingest_table(spark, source, label, rare)
    out = []
    for noise in noises:
        for seed in seeds:
            p = generation.one_pass(data, n_rows, seed, noise, False, 0.50, lift=True)
            out.append({"noise": noise, "seed": seed, "passed": p["report"]["passed"], "score": p["report"]["score"], "lift": (p["lift"] or {}).get("lift")})
            p["batch"].unpersist()
    return out
