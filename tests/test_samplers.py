"""Every sampler against a plain version of it: the draws are hashes, which xxhash gives as well."""

import math
import struct

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from attestra.operators import distance, ingest, privacy, sampling
from attestra.plans import registry

N, SEED = 500, 7


def uniform(stream, *keys, seed=SEED):
    """Spark's xxhash64 of a long, a string and keys, one after the other, as a number in [0, 1)."""
    h = 42
    for part in (struct.pack("<q", seed), stream.encode(), *[struct.pack("<q", k) if not isinstance(k, np.int32) else struct.pack("<i", k) for k in keys]):
        h = xxhash.xxh64_intdigest(part, h)
    return (h >> 11) * 2.0**-53


def normal(stream, *keys):
    return math.sqrt(-2 * math.log(1 - uniform(f"{stream}/u", *keys))) * math.cos(2 * math.pi * uniform(f"{stream}/v", *keys))


def index(n, stream, *keys):
    return min(math.floor(uniform(stream, *keys) * n), n - 1)


@pytest.fixture(scope="module")
def real(sf_dir):
    return pd.read_parquet(f"{sf_dir}/customer.parquet")[["c_custkey", "c_acctbal", "c_nationkey"]].sort_values("c_custkey").reset_index(drop=True)


def drawn(spark, sf_dir, name):
    out = registry.QUERIES[name](spark, sf_dir).toPandas().sort_values("draw").reset_index(drop=True)
    assert len(out) == N
    return out


def test_bootstrap(spark, sf_dir, real):
    out = drawn(spark, sf_dir, "sample_bootstrap")
    want = real.iloc[[index(len(real), "bootstrap", i) for i in range(N)]].reset_index(drop=True)
    assert (out[real.columns] == want).all().all()


def test_independent(spark, sf_dir, real):
    out = drawn(spark, sf_dir, "sample_independent")
    for c in ("c_acctbal", "c_nationkey"):
        assert out[c].tolist() == [real[c][index(len(real), f"column/{c}", i)] for i in range(N)]


def test_noised(spark, sf_dir, real):
    out = drawn(spark, sf_dir, "sample_noised")
    sd = real.c_acctbal.std(ddof=1)
    want = [real.c_acctbal[index(len(real), "bootstrap", i)] + 0.5 * sd * normal("noise/c_acctbal", i) for i in range(N)]
    assert out.c_acctbal.tolist() == pytest.approx(want)


def test_grounded(spark, sf_dir, real):
    out = drawn(spark, sf_dir, "sample_grounded")
    sd = real.c_acctbal.std(ddof=0)
    at = [index(len(real), "anchor", i) for i in range(N)]
    assert out.c_nationkey.tolist() == real.c_nationkey[at].tolist()
    assert out.c_acctbal.tolist() == pytest.approx([real.c_acctbal[k] + 0.10 * sd * normal("grounded/c_acctbal", i) for i, k in enumerate(at)])


def test_grounded_by_weight(spark, real):
    rows = ingest.with_row_id(spark.createDataFrame(real), ["c_custkey"]).withColumn("w", F.when(F.col("c_nationkey") < 5, 2.0).otherwise(1.0))
    out = sampling.grounded_batch(rows, [], N, SEED, weight="w").toPandas().sort_values("draw")
    weight = np.where(real.c_nationkey < 5, 2.0, 1.0)
    want = []
    for i in range(N):
        for t in range(32):
            k = index(len(real), "anchor", i, np.int32(t))
            if t == 31 or uniform("accept", i, np.int32(t)) * 2.0 <= weight[k]:
                want.append(real.c_custkey[k])
                break
    assert out.c_custkey.tolist() == want


def phi(x):
    return 0.5 * math.erfc(-x / math.sqrt(2))


def test_copula(spark, sf_dir, real):
    from statistics import NormalDist

    out = drawn(spark, sf_dir, "sample_copula")
    cols = ["c_acctbal", "c_nationkey"]
    score = np.array([[NormalDist().inv_cdf(v / (len(real) + 1)) for v in real[c].rank()] for c in cols])
    cov = score @ score.T / len(real)
    sd = np.sqrt(np.diag(cov))
    corr = 0.999 * cov / np.outer(sd, sd) + 0.001 * np.eye(2)
    np.fill_diagonal(corr, 1.0)
    low = np.linalg.cholesky(corr)
    for j, c in enumerate(cols):
        x = np.sort(real[c].to_numpy(float))
        u = [phi(sum(low[j, k] * normal(f"copula/{k}", i) for k in range(j + 1))) for i in range(N)]
        assert out[c].tolist() == pytest.approx(np.interp(np.array(u) * (len(x) - 1), np.arange(len(x)), x).tolist(), abs=1e-5)


def test_smote(spark, sf_dir, real):
    out = drawn(spark, sf_dir, "sample_smote")
    x = real[["c_acctbal", "c_nationkey"]].to_numpy(float)
    z = x / x.std(axis=0)
    gap = ((z[:, None] - z[None]) ** 2).sum(axis=2)
    np.fill_diagonal(gap, np.inf)
    near = np.argsort(gap, axis=1, kind="stable")[:, :5]
    for i in range(N):
        k, j = index(len(x), "row", i), index(5, "neighbour", i)
        want = x[k] + uniform("mix", i) * (x[near[k, j]] - x[k])
        assert out.loc[i, ["c_acctbal", "c_nationkey"]].astype(float).tolist() == pytest.approx(want.tolist(), abs=1e-9)


def test_floor(spark, sf_dir, real):
    out = registry.QUERIES["distance_floor"](spark, sf_dir).toPandas().sort_values("draw")
    x = real[["c_acctbal", "c_nationkey"]].to_numpy(float)
    scale = x.std(axis=0)
    started = np.array([x[index(len(x), "bootstrap", i)] for i in range(200)])
    box = privacy._Box(x.min(axis=0), x.max(axis=0), scale, 0.05, SEED)
    want, _, _ = privacy.floor_rows(started, np.arange(200), np.unique(x / scale, axis=0), box)
    got = out[["c_acctbal", "c_nationkey"]].to_numpy(float)
    low = np.sqrt((((got[:, None] - x[None]) / scale) ** 2).sum(axis=2)).min(axis=1)
    assert np.allclose(got, want) and (low >= 0.05 - 1e-9).mean() > 0.95 and (got >= box.low).all() and (got <= box.high).all()


def test_estimand_preserving_keeps_the_line(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 2))
    y = 1 + 2 * x[:, 0] - x[:, 1] + rng.normal(scale=0.3, size=1500)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "a": x[:, 0], "b": x[:, 1]}))
    made = sampling.estimand_preserving(df, "y", ["a", "b"], 2000, 3, binary=False, trees=40).toPandas()
    beta = np.linalg.lstsq(np.column_stack([np.ones(2000), made[["a", "b"]]]), made.y, rcond=None)[0]
    assert beta == pytest.approx([1, 2, -1], abs=0.2) and distance.scales(spark.createDataFrame(made), ["a", "b"]) == pytest.approx([1, 1], abs=0.15)


def test_fits_over_cells_are_fits_over_rows(spark, monkeypatch):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rng = np.random.default_rng(9)
    rows = pd.DataFrame({"a": rng.integers(0, 6, 3000).astype(float), "b": rng.integers(0, 4, 3000).astype(float)})
    rows["y"] = rows.a * rows.b + rng.normal(size=3000)
    df = spark.createDataFrame(rows)
    plain = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    model = GBTRegressor(labelCol="y", maxIter=8, maxDepth=3, seed=SEED).fit(plain)
    told = model.transform(plain).toPandas()
    want = told.groupby(["a", "b"]).prediction.first()
    fitted, fit = [], GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, data: fitted.append(data.count()) or fit(self, data))
    holed = df.unionByName(spark.createDataFrame([(None, 1.0, 5.0), (1.0, float("nan"), 5.0), (1.0, 1.0, None)], df.schema))
    x = df.select("a", "b").distinct().selectExpr("cast(a * 4 + b as long) as draw", "a", "b")
    got = sampling.conditional_outcome(holed, x, "y", ["a", "b"], SEED, trees=8).toPandas()
    noise = np.array([normal("outcome", int(i)) for i in got.draw])
    sd = np.std(told.y - told.prediction)
    assert fitted == [24] and np.allclose(got.y, [want[a, b] + sd * e for a, b, e in zip(got.a, got.b, noise, strict=True)], atol=1e-5)


def test_estimand_preserving_fits_cells(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.clustering import GaussianMixture

    fitted = []
    for learner in (GaussianMixture, GBTClassifier):
        monkeypatch.setattr(learner, "fit", lambda self, data, fit=learner.fit: fitted.append((data.count(), data.agg({"w": "sum"}).first()[0])) or fit(self, data))
    rng = np.random.default_rng(4)
    a = rng.integers(0, 12, 2400).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"y": (rng.uniform(size=2400) < (a + 1) / 14).astype(float), "a": a, "b": rng.integers(0, 12, 2400).astype(float)}))
    made = sampling.estimand_preserving(df, "y", ["a", "b"], 1500, 3, binary=True, trees=8).toPandas()
    cells = df.distinct().count()
    assert fitted == [(cells, 2400.0)] * 2 and cells < 300
    assert made.a.mean() == pytest.approx(a.mean(), abs=0.5) and np.polyfit(made.a, made.y, 1)[0] == pytest.approx(1 / 14, abs=0.015)
