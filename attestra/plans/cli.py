"""Command line: test, ingest, run, generate, explore, propose, doctor, certify, verify, screen.

certify exits with 0 (certified), 1 (not preserved) or 2 (can't be certified), with and without --json.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from attestra.operators import ingest, regression
from attestra.operators.ingest import RareEvent
from attestra.operators.regression import Estimand
from attestra.plans import bundle, generation, scenario
from attestra.sources.tables import load, load_for_certify


def scalar(text: str):
    """A number or boolean where text is one."""
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False}.get(text.lower(), text)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="attestra")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("test")
    for name in ("ingest", "run", "generate", "explore", "propose", "doctor", "screen"):
        s = sub.add_parser(name)
        s.add_argument("file")
        s.add_argument("--label", default="")
        s.add_argument("--mode", choices=("label", "percentile", "imbalance"), default="percentile" if name in ("ingest", "run") else "label")
        s.add_argument("--value")
        s.add_argument("--percentile", type=float, default=0.05)
        s.add_argument("--imbalance-ratio", type=float, default=0.01)
        s.add_argument("--lower", action="store_true")
        s.add_argument("--rows", type=int, default=300)
        s.add_argument("--seed", type=int, default=42)
        s.add_argument("--out")
        s.add_argument("--privacy", choices=generation.PRIVACY, default="none" if name == "run" else "floored")
        s.add_argument("--delta", type=float, default=0.5)
        s.add_argument("--intent", choices=generation.MODES, default="balanced")
        s.add_argument("--no-auto", action="store_true")
        s.add_argument("--scenario")
        s.add_argument("--passes", type=int, default=5)
        s.add_argument("--json", action="store_true")
    c = sub.add_parser("certify")
    c.add_argument("real")
    c.add_argument("synthetic")
    c.add_argument("--outcome", required=True)
    c.add_argument("--predictors", required=True)
    c.add_argument("--family", choices=("ols", "logit"), default="ols")
    c.add_argument("--targets", default="")
    c.add_argument("--ci-level", type=float, default=0.95)
    c.add_argument("--rule", choices=("consistent", "within_ci", "significant"), default="consistent")
    c.add_argument("--json", action="store_true")
    v = sub.add_parser("verify")
    v.add_argument("bundle")
    v.add_argument("--json", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("attestra").getOrCreate()

    def show(obj) -> None:
        print(json.dumps(obj, indent=None if getattr(a, "json", False) else 2, default=str))

    if a.command == "test":
        show({"spark": spark.version, "rows": spark.range(3).count()})
        return 0
    if a.command == "certify":
        try:
            real, synth = load_for_certify(spark, a.real), load_for_certify(spark, a.synthetic)
            spec = Estimand(a.outcome, tuple(x.strip() for x in a.predictors.split(",")), a.family, tuple(x.strip() for x in a.targets.split(",") if x.strip()), a.ci_level, a.rule)
        except Exception as e:  # a file or declaration that can't be read
            show({"status": "uncertifiable", "reason": str(e)[:500]})
            return 2
        out = regression.certify_dataset(real, synth, spec, a.synthetic)
        show(out)
        return {"certified": 0, "not_preserved": 1}.get(out["status"], 2)
    if a.command == "verify":
        out = bundle.verify_bundle(spark, a.bundle)
        show(out)
        return 0 if out["passed"] else 1
    rare = None
    if a.mode != "label" or a.value is not None:
        if not a.label:
            print("--label names the column of the rare class", file=sys.stderr)
            return 2
        rare = RareEvent(a.label, a.mode, None if a.value is None else scalar(a.value), a.percentile, not a.lower, a.imbalance_ratio)
    try:
        if a.command == "ingest":
            d = generation.ingest_table(spark, a.file, a.label, rare)
            show({"label": d.label, "n_rare": d.n_rare, "n_normal": d.n_normal, "fields": [m.to_dict() for m in d.fields.values()]})
            return 0
        if a.command == "doctor":
            found = ingest.preflight(load(spark, a.file), a.label or ingest.detect_target(load(spark, a.file)), rare)
            show(found)
            return 1 if any(f["level"] == "unsupported" for f in found) else 0
        if a.command == "propose":
            d = generation.ingest_table(spark, a.file, a.label, rare)
            print(scenario.Scenario(label=d.label, columns=[scenario.structural(m) for m in d.fields.values()]).to_yaml())
            return 0
        if a.command == "run":
            out = generation.run_campaign(spark, a.file, a.label, rare, a.rows, a.passes, private=a.privacy, seed=a.seed, out_dir=a.out)
            show(out)
            return 0 if out["n_accepted"] else 1
        if a.command == "generate":
            use_case = scenario.Scenario.from_yaml(open(a.scenario, encoding="utf-8").read()) if a.scenario else None
            out = generation.generate(spark, a.file, a.label, rare, a.rows, a.intent, a.seed, not a.no_auto, private=a.privacy, delta=a.delta, out_dir=a.out, use_case=use_case)
            show({k: v for k, v in out.items() if k != "rows"})
            return 0 if out["passed"] else 1
        if a.command == "explore":
            show(generation.explore_options(spark, a.file, a.label, rare, a.rows, a.seed))
            return 0
        show(generation.screen(spark, a.file, a.label, rare, a.seed))
        return 0
    except (ValueError, FileNotFoundError) as e:
        show({"error": str(e)})
        return 2


if __name__ == "__main__":
    sys.exit(main())
