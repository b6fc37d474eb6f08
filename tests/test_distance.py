"""Distance joins, floor and interpolation against plain numpy, below and beyond the sizes that one task holds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.operators import distance, privacy


def points(spark, x, names=("a", "b", "c")):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "__rid long, " + ", ".join(f"{c} double" for c in names[: x.shape[1]]))


def made(rng, n, d):
    x = rng.normal(size=(n, d)).round(1)
    x[: n // 3, 0] = 0.0  # a value that a third of the rows has
    x[n // 2 : n // 2 + n // 10] = x[n // 2]  # and a point of many rows
    return x


@pytest.fixture(params=["few", "leaves"])
def size(request, monkeypatch):
    if request.param == "leaves":
        monkeypatch.setattr(distance, "FEW_ROWS", 10)
        monkeypatch.setattr(distance, "LEAF_ROWS", 16)
        monkeypatch.setattr(distance, "SHARE_ROWS", 20)
        monkeypatch.setattr(privacy, "MOST_REAL", 10)
    return request.param


def gaps(x, y, scale):
    return np.sqrt((((x[:, None] - y[None]) / scale) ** 2).sum(axis=2))


@pytest.mark.parametrize("d", [3])
def test_nearest(spark, size, d):
    rng = np.random.default_rng(d)
    x, y = made(rng, 150, d), made(rng, 300, d)
    cols = ["a", "b", "c"][:d]
    scale = np.where(y.std(axis=0) >= 1e-8, y.std(axis=0), 1)
    got = {r["__rid"]: r["distance"] for r in distance.nearest(points(spark, x), points(spark, y), cols).collect()}
    assert [got[i] for i in range(150)] == pytest.approx(gaps(x, y, scale).min(axis=1))
    q = distance.nearest_quantiles(points(spark, x), points(spark, y), cols).first()
    want = gaps(x, y, scale).min(axis=1)
    assert tuple(q) == pytest.approx((want.min(), *np.quantile(want, [0.1, 0.5, 0.9])))
    assert distance.nearest(points(spark, x), points(spark, y).limit(0), cols).where("distance < 1e300").count() == 0


def test_smote_neighbours(spark, size):
    y = made(np.random.default_rng(4), 200, 2)
    df = points(spark, y)
    scale = y.std(axis=0)
    names = ["__x0", "__x1"]
    rows = df.select(F.col("__rid").alias("__ref"), *distance._scaled(["a", "b"], distance.scales(df, ["a", "b"])))
    got = {r["__own"]: r for r in distance.neighbours(rows.withColumnRenamed("__ref", "__own"), rows, names, 5, keyed=True).collect()}
    d = gaps(y, y, scale)
    np.fill_diagonal(d, np.inf)
    for i in range(200):
        assert got[i]["dist"] == pytest.approx(np.sort(d[i])[:5], abs=1e-9) and i not in got[i]["ids"]
        assert d[i][got[i]["ids"]] == pytest.approx(np.sort(d[i])[:5], abs=1e-9)
    out = distance.smote(df, ["a", "b"], 100, 3).toPandas()
    assert len(out) == 100 and out.notna().all().all()
    on_a_segment = lambda p: any(np.linalg.norm(p - y[i]) + np.linalg.norm(p - y[j]) <= np.linalg.norm(y[i] - y[j]) + 1e-9 for i in range(200) for j in got[i]["ids"])
    assert all(on_a_segment(p) for p in out[["a", "b"]].to_numpy())


def test_floor(spark, size):
    rng = np.random.default_rng(8)
    real, synth = made(rng, 60, 2), made(rng, 40, 2)
    synth[:10] = real[:10]
    moved, report = privacy.enforce_distance_floor(points(spark, synth), points(spark, real), ["a", "b"], 0.2, 5)
    x = moved.orderBy("__rid").toPandas()[["a", "b"]].to_numpy()
    box = privacy._Box(real.min(axis=0), real.max(axis=0), real.std(axis=0), 0.2, 5)
    want, projected, respawned = privacy.floor_rows(synth, np.arange(40), np.unique(real, axis=0) / real.std(axis=0), box)
    assert np.allclose(x, want, atol=1e-9) and (report.n_projected, report.n_respawned) == (projected.sum(), respawned.sum())
    low = gaps(x, real, real.std(axis=0)).min(axis=1)
    assert report.low == pytest.approx(low.min()) and report.passed == (low.min() >= 0.2 - 1e-9)


def test_verbatim_by_brute_force(spark):
    rng = np.random.default_rng(2)
    real = np.column_stack([np.zeros(120), rng.normal(size=120), rng.integers(0, 3, 120)])  # a column of one value
    synth = real[rng.integers(0, 120, 200)] + np.column_stack([np.zeros(200), rng.normal(scale=1.5e-3, size=200), np.zeros(200)])
    kinds = lambda x: spark.createDataFrame([(i, float(a), float(b), int(k)) for i, (a, b, k) in enumerate(x)], "__rid long, a double, b double, k int")
    got = {r[0] for r in distance.verbatim(kinds(synth), kinds(real), ["a", "b"], ["k"]).collect()}
    scale = np.array([1.0, real[:, 1].std()])
    d = gaps(synth[:, :2], real[:, :2], scale)
    assert got == {i for i in range(200) if ((d[i] <= 1e-3) & (real[:, 2] == synth[i, 2])).any()} and 20 < len(got) < 200
