"""Sweeps over settings, and the comparison with kept figures."""

import copy

from attestra.plans import sweeps
from attestra.sources import tables


def test_privacy_sweep_and_comparison(spark):
    df = tables.fraud_sample(spark, 600, 0.05).cache()
    found = sweeps.privacy_sweep(spark, {"fraud": (df, "is_fraud")}, n_rows=40, mode="faithful")
    assert list(found) == ["fraud/none", "fraud/floored"] and all(r["verified"] and r["seconds"] > 0 for r in found.values())
    assert found["fraud/floored"]["min_distance"] >= found["fraud/none"]["min_distance"]
    assert sweeps.compare(found, found) == []
    worse = copy.deepcopy(found)
    worse["fraud/none"]["score"] -= 0.2
    worse["fraud/none"]["verified"] = False
    worse["fraud/floored"]["seconds"] = worse["fraud/floored"]["seconds"] * 4 + 6
    assert len(sweeps.compare(worse, found)) == 3 and sweeps.compare({}, found) == ["fraud/none: no run", "fraud/floored: no run"]


def test_noise_sweep(spark):
    df = tables.fraud_sample(spark, 400, 0.08).cache()
    rows = sweeps.noise_sweep(spark, df, "is_fraud", noises=(0.1,), seeds=(1,), n_rows=30)
    assert [(r["noise"], r["seed"]) for r in rows] == [(0.1, 1)] and all(0 <= r["score"] <= 1 for r in rows)
