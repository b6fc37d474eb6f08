"""Operators on small tables with known answers."""

import inspect
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.functions import stats
from attestra.functions.ordered import average_ranks, quantile_table, quantiles, row_numbers, running_sums
from attestra.operators import distance, evaluate, fidelity, ingest, privacy, regression, sampling, tail
from attestra.operators.ingest import FieldMeta, IngestError, RareEvent
from attestra.operators.regression import Estimand, EstimandError, Fit
from attestra.plans import bundle, cli, demos, generation, scenario
from attestra.sources import tables


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_t_and_normal_quantiles():
    assert stats.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert stats.t_quantile(0.975, 1e6) == pytest.approx(stats.normal_quantile(0.975), abs=1e-5)
    assert stats.normal_cdf(1.959963984540054) == pytest.approx(0.975, abs=1e-12)


def test_order_statistics(spark):
    x = [float(v) for v in np.random.default_rng(1).normal(size=500).round(1)]
    df = frame(spark, [(v,) for v in x], "x double")
    probs = [0, 0.1, 0.25, 0.5, 0.77, 1]
    assert quantiles(df, "x", probs) == pytest.approx(list(np.quantile(x, probs)))
    assert quantiles(df, "x", [0.33]) == pytest.approx([np.quantile(x, 0.33)])
    both = quantile_table(df.withColumn("y", -F.col("x")), ["x", "y"], probs)
    assert both["x"] == pytest.approx(list(np.quantile(x, probs))) and both["y"] == pytest.approx(list(np.quantile([-v for v in x], probs)))
    assert math.isnan(quantiles(df.limit(0), "x", [0.5])[0])
    run = running_sums(df.groupBy("x").agg(F.count("*").alias("n")), "x", ["n"], bins=7).orderBy("x").collect()
    assert [r["run_n"] for r in run] == [sum(v <= r["x"] for v in x) for r in run]
    assert [r["next"] for r in run] == [*[r["x"] for r in run][1:], None]
    ranks = average_ranks(df, "x").distinct().collect()
    assert all(r["rank"] == sum(v < r["x"] for v in x) + (x.count(r["x"]) + 1) / 2 for r in ranks)
    numbers = row_numbers(spark.range(100), ["id"], "k", bins=7).collect()
    assert all(r["id"] == r["k"] for r in numbers)


def test_target_detection(spark):
    rows = [(i, int(i % 20 == 0), int(i % 3 == 0)) for i in range(400)]
    df = frame(spark, rows, "n int, label int, third int")
    assert ingest.detect_target(df) == "label"
    with pytest.raises(IngestError, match="could be"):
        ingest.detect_target(df.withColumn("class", F.col("label")))
    with pytest.raises(IngestError, match="no value is rare"):
        ingest.detect_target(frame(spark, [(i % 2,) for i in range(100)], "half int"))
    assert ingest.minority_value(df, "label").first()["value"] == 1


def test_labels_are_ambiguous(spark):
    """quality and toxic are too close to choose from; toxic is no name that suggests a label."""
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    with pytest.raises(IngestError, match="toxic.*quality"):
        ingest.detect_target(labels)
    scores = {r["column"]: r["score"] for r in ingest.target_scores(labels).collect()}
    assert scores == pytest.approx({"toxic": 0.8174, "quality": 0.7923}, abs=1e-4)
    assert ingest.LABEL_NAMES == ("label", "target", "y", "is_fraud", "fraud", "class")


def test_imbalance_of_many_values(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id")).alias("v"), "id")
    out = ingest.flag_rare(df, RareEvent("v", "imbalance", ratio=0.01))
    assert out.where("__rare").count() == 15_000 and out.count() == 30_000
    with pytest.raises(IngestError, match="share"):
        ingest.with_rare(df.where("v = -1"), RareEvent("v", "imbalance"))


def test_impute_and_flags(spark):
    df = frame(spark, [(1.0, "a", 1), (None, "b", 0), (3.0, None, 0), (5.0, "b", None)], "x double, c string, y int")
    got = {r["y"]: r for r in ingest.impute(df.withColumn("y", F.col("y")), None).collect()}
    assert got[0]["c"] == "b"
    assert ingest.impute(df, "y").count() == 3
    assert ingest.impute(df, "y").where("x = 2.0").count() == 1
    with pytest.raises(IngestError):
        ingest.impute(frame(spark, [(None, 1), (None, 2)], "x double, y int"))
    with pytest.raises(IngestError, match="rare rows"):
        ingest.flag_rare(df, RareEvent("y", value=1))
    with pytest.raises(IngestError, match="not numeric"):
        ingest.rare_predicate(df, RareEvent("c", "percentile"))


def test_profile_and_codes(spark):
    df = frame(spark, [(i, f"u{i}", float(i) + 0.5, i % 2, "ab"[i % 2]) for i in range(40)], "order_id long, email string, amount double, flag int, kind string")
    f = ingest.field_profile(df)
    assert f["order_id"].is_identifier and f["email"].is_identifier and not f["amount"].is_identifier
    assert (f["flag"].kind, f["kind"].kind, f["amount"].kind) == ("binary", "categorical", "continuous")
    own = {"kind": f["kind"]}
    coded = ingest.encode_categories(df.select("kind"), own)
    assert {r[0] for r in coded.collect()} == {0.0, 1.0}
    assert ingest.decode_categories(coded.withColumn("kind", F.col("kind") + 0.4), own).where("kind = 'b'").count() == 20
    with pytest.raises(IngestError, match="not supported"):
        ingest.field_profile(df.withColumn("t", F.current_timestamp()))


def test_preflight(spark):
    rows = [(i, float(i % 17), "x" * 60, i % 5, 1, int(i < 12)) for i in range(200)]
    df = frame(spark, rows, "event_timestamp long, x double, note string, code int, same int, y int")
    found = {(f["code"], f["column"]) for f in ingest.preflight(df, "y", RareEvent("y", value=1))}
    assert {("temporal", "event_timestamp"), ("free_text", "note"), ("few_integers", "code"), ("constant", "same"), ("rare_rows", None)} - {("free_text", "note")} <= found
    assert ("constant", "note") in found or ("free_text", "note") in found


def linear(spark, n=400, slope=2.0, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = 1.5 + slope * x[:, 0] - x[:, 1] + rng.normal(scale=0.5, size=n)
    return frame(spark, [tuple(map(float, r)) for r in np.column_stack([y, x])], "y double, x1 double, x2 double"), x, y


def test_ols_and_certificates(spark):
    spec = Estimand("y", ("x1", "x2"))
    df, x, y = linear(spark)
    fit = regression.fit_ols(df, spec)
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    var = ((y - design @ beta) ** 2).sum() / (len(y) - 3)
    assert fit.coef == pytest.approx(beta, abs=1e-8)
    assert fit.se == pytest.approx(np.sqrt(var * np.diag(np.linalg.inv(design.T @ design))), rel=1e-7)
    good, bad = linear(spark, seed=5)[0], linear(spark, slope=0.5, seed=6)[0]
    assert regression.certify_dataset(df, good, spec)["status"] == "certified"
    assert regression.certify_dataset(df, bad, spec)["status"] == "not_preserved"
    both = good.withColumn("source", F.lit("good")).unionByName(bad.withColumn("source", F.lit("bad")))
    many = regression.certify_many(df, both, spec)
    assert {k: v["status"] for k, v in many.items()} == {"good": "certified", "bad": "not_preserved"}
    assert regression.evaluate(df, good, None)["status"] == "not_declared"
    assert regression.evaluate(df, df.limit(2), spec)["status"] == "uncertifiable"
    with pytest.raises(EstimandError):
        Estimand("y", ("x1",), family="probit")
    assert regression.evaluate(df, df.withColumn("x1", F.lit("oops")), spec)["status"] == "uncertifiable"


def test_wald_by_hand():
    spec = Estimand("y", ("a",))
    fits = [Fit(["a"], np.array([b]), np.array([s]), 100, 1.96, "ols") for b, s in ((0.7141, 0.0148), (0.4637, 0.0312))]
    out = regression.certify(*fits, spec)
    assert out["targets"][0]["z"] == pytest.approx(7.25, abs=0.01) and not out["certified"]
    assert regression.certify(*fits, Estimand("y", ("a",), targets=("missing",)))["targets"][0]["preserved"] is None


def test_logit(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=3000)
    y = (rng.uniform(size=3000) < 1 / (1 + np.exp(-(0.5 + 1.2 * x)))).astype(float)
    df = frame(spark, list(zip(y.tolist(), x.tolist(), strict=True)), "y double, x double")
    fit = regression.fit_logit(df, Estimand("y", ("x",), family="logit"))
    assert fit.coef == pytest.approx([0.5, 1.2], abs=0.15)
    with pytest.raises(EstimandError):
        regression.fit_logit(df.withColumn("y", F.col("y") + 1), Estimand("y", ("x",), family="logit"))


def test_fidelity_edges(spark):
    a = frame(spark, [(1.0, "p"), (2.0, "q"), (3.0, "p")], "x double, c string")
    empty, flat = a.limit(0), a.withColumn("x", F.lit(1.0))
    assert fidelity.tvd_discrete(a, a, "c").first()[0] == 0
    assert fidelity.tvd_discrete(a, empty, "c").first()[0] == 1
    assert fidelity.wasserstein(a, empty, "x").first()[0] == 1
    assert fidelity.tvd_binned(flat, flat, "x").first()[0] == 0
    assert fidelity.ks_distance(a, a, "x").first()[0] == 0
    assert fidelity.correlation_shift(a.withColumn("z", F.lit(1.0)), a.withColumn("z", F.lit(1.0)), ["x", "z"]).first()["mean_shift"] is None
    fields = ingest.field_profile(a)
    assert fidelity.audit(a, a, fields)["passed"]


def test_all_columns_at_once_agree(spark):
    rng = np.random.default_rng(9)
    draw = lambda n, shift: frame(spark, [(float(a + shift), float(round(b, 1)), f"c{int(c)}", f"k{int(c) % 3}", 1.0) for a, b, c in zip(rng.normal(size=n), rng.normal(size=n), rng.exponential(30, n), strict=True)], "a double, b double, c string, k string, same double")
    real, synth = draw(300, 0.0).cache(), draw(200, 0.4).cache()
    fields = list(ingest.field_profile(real).values())
    got = fidelity.column_statistics(real, synth, fields)
    for m in fields:
        if m.kind == "continuous":
            assert got[m.name]["wasserstein"] == pytest.approx(fidelity.wasserstein(real, synth, m.name).first()[0])
            assert got[m.name]["tvd"] == pytest.approx(fidelity.tvd_binned(real, synth, m.name).first()[0])
        else:
            assert got[m.name]["tvd"] == pytest.approx(fidelity.tvd_discrete(real, synth, m.name).first()[0])


def test_high_cardinality_tvd_is_stable(spark):
    rng = np.random.default_rng(0)
    p = 1 / np.arange(1, 501)
    draw = lambda n: frame(spark, [(f"c{v}",) for v in rng.choice(500, size=n, p=p / p.sum())], "c string")
    real, synth = draw(1000), draw(200)
    one = fidelity.tvd_discrete(real, synth, "c").first()[0]
    assert one < 0.3 and one == fidelity.tvd_discrete(real.orderBy("c"), synth.repartition(5), "c").first()[0]


def test_privacy(spark):
    rng = np.random.default_rng(1)
    real_rows = [(i, *map(float, rng.normal(size=3)), int(i % 2)) for i in range(40)]
    schema = "__rid long, a double, b double, c double, flag int"
    real = frame(spark, real_rows, schema)
    synth = frame(spark, [*real_rows[:8], (50, 9.0, 9.0, 9.0, 1)], schema)
    assert privacy.count_duplicates(synth, real, ["a", "b", "c"], ["flag"]) == 8
    moved, report = privacy.enforce_distance_floor(synth, real, ["a", "b", "c"], 0.5, 3)
    assert report.passed and report.low >= 0.5 - 1e-9
    again, _ = privacy.enforce_distance_floor(synth.repartition(3), real, ["a", "b", "c"], 0.5, 3)
    assert sorted(moved.collect()) == sorted(again.collect())
    nudged, n = privacy.guard_duplicates(synth, real, ["a", "b", "c"], ["flag"], 1)
    assert n == 8 and privacy.count_duplicates(nudged, real, ["a", "b", "c"], ["flag"]) < 8
    k = frame(spark, [(1, "x", "p"), (2, "x", "q"), (3, "y", "q"), (4, "y", "q")], "__rid long, a string, b string")
    assert privacy.count_duplicates(k, k, [], ["a", "b"]) == 2
    assert privacy.enforce_distance_floor(synth, real, [], 0.5, 1)[1].skipped


def test_coincident_integer_grid(spark):
    real = frame(spark, [(i, float(i % 4), float(i // 4 % 4)) for i in range(16)], "__rid long, a double, b double")
    moved, report = privacy.enforce_distance_floor(real, real, ["a", "b"], 0.3, 5)
    assert moved.where("a is null or isnan(a)").count() == 0 and report.low > 0


def test_metrics_by_hand(spark):
    s = frame(spark, [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)], "y int, score double")
    assert evaluate.roc_auc(s).first()[0] == pytest.approx(3.5 / 4)
    assert evaluate.average_precision(s).first()[0] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
    none = frame(spark, [(0, 0)], "y int, prediction int")
    assert tuple(evaluate.recall_precision(none).first()) == (0.0, 0.0)


def test_split_is_exact(spark):
    df = spark.range(100).select(F.col("id").alias("__rid"), (F.col("id") < 20).alias("__rare"))
    train, test = evaluate.stratified_split(df, 0.3, 1)
    assert (train.count(), test.count(), test.where("__rare").count()) == (70, 30, 6)


def test_gp_recovers_a_curve():
    x = np.linspace(0, 6, 40)[:, None]
    gp = tail.fit_gp(x, np.sin(x[:, 0]))
    mean, var = gp.posterior(np.array([[1.5], [3.1]]))
    assert mean == pytest.approx(np.sin([1.5, 3.1]), abs=0.05) and (var > 0).all()
    assert tail.explored_penalty(np.ones(2), np.array([[0.0, 1.0], [50.0, 9.0]]), None).tolist() == [1, 1]
    near = tail.explored_penalty(np.ones(2), np.array([[0.0, 0.0], [50.0, 50.0]]), np.array([[0.0, 0.0]]))
    assert near[0] < 0.4 < near[1]


def test_constraints(spark):
    df = frame(spark, [(0, -5.0, 0.4), (1, 2.5, 0.9), (2, 99.0, 0.5)], "draw long, n double, b double")
    fields = {"n": FieldMeta("n", "continuous", 9, 9, True, low=0.0, high=10.0), "b": FieldMeta("b", "binary", 2, 9, low=0.0, high=1.0, numeric_values=[0.0, 1.0]), "id": FieldMeta("id", "continuous", 9, 9, True, True, high=7.0)}
    out = [tuple(r) for r in sampling.apply_constraints(df, fields).orderBy("draw").select("n", "b", "id").collect()]
    assert out == [(0.0, 0.0, 8), (2.0, 1.0, 9), (10.0, 1.0, 10)]


def test_smote_stays_between(spark):
    df = frame(spark, [(i, float(i), float(2 * i)) for i in range(12)], "__rid long, a double, b double")
    out = distance.smote(df, ["a", "b"], 50, 1).toPandas()
    assert len(out) == 50 and out.a.between(0, 11).all() and (abs(out.b - 2 * out.a) < 1e-9).all()


def test_vetting_and_scenarios():
    m = FieldMeta("x", "continuous", 50, 100, True, low=0.0, high=9.0)
    c = FieldMeta("c", "categorical", 2, 100, categories=["a", "b"])
    claims = [scenario.ColumnClaim("x", min=-1.0, max=5.0, integer=True), scenario.ColumnClaim("c", categories=("a",), source="model"), scenario.ColumnClaim("nope"), scenario.ColumnClaim("c", unit="m", confidence=0.2)]
    out, verdicts = scenario.resolve({"x": m, "c": c}, claims)
    assert (out[0].min, out[0].max) == (-1.0, 9.0)
    assert {(v["column"], v["claim"]) for v in verdicts if not v["accepted"]} == {("nope", "column"), ("x", "max"), ("c", "all")}
    told = scenario.propose({"x": m}, lambda prompt, payload, config: json.dumps([{"name": "x", "unit": "m", "confidence": 0.9, "junk": 1}]))
    assert told[0].source == "model" and told[0].unit == "m" and scenario.propose({"x": m}, lambda *a: "no json") == []
    s = scenario.Scenario("y", columns=claims, estimand=Estimand("y", ("x",)))
    assert scenario.Scenario.from_yaml(s.to_yaml()) == s


def test_sources(spark, tmp_path):
    assert tables.sniff_delimiter("a;b;c\n1;2;3\n") == ";"
    (tmp_path / "t.csv").write_text("a|b\n1|x\n2|y\n")
    assert tables.load(spark, str(tmp_path / "t.csv")).columns == ["a", "b"]
    (tmp_path / "t.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    (tmp_path / "t.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert tables.load(spark, str(tmp_path / "t.json")).count() == tables.load(spark, str(tmp_path / "t.jsonl")).count() == 2
    with pytest.raises(FileNotFoundError):
        tables.load(spark, str(tmp_path / "none.csv"))
    df = spark.range(10)
    assert tables.canonical_hash(df) == tables.canonical_hash(df.repartition(3)) != tables.canonical_hash(spark.range(11))


def test_results_of_a_run(spark, tmp_path):
    for n in (2, 10, 1):
        tables.write_batch(spark.range(n).toDF("x"), str(tmp_path / f"pass_{n}_accepted.parquet"))
    assert [p["pass"] for p in tables.load_results(str(tmp_path))["passes"]] == [1, 2, 10]
    assert tables.load_synthetic(spark, str(tmp_path)).count() == 10
    (tmp_path / "campaign_summary.json").write_text(json.dumps({"best_batch_path": str(tmp_path / "pass_2_accepted.parquet"), "passes": []}))
    assert tables.load_synthetic(spark, str(tmp_path)).count() == 2
    with pytest.raises(FileNotFoundError):
        tables.load_results(str(tmp_path / "none"))


def test_generate_verify_tamper(spark, tmp_path):
    df = tables.fraud_sample(spark, 800, 0.05)
    r = generation.generate(spark, df, auto=False, n_rows=60, private="none", out_dir=str(tmp_path / "g"), estimand=Estimand("amount", ("hour",)))
    rows = r["rows"].cache()
    assert rows.count() == 60 and rows.where("is_fraud = 1").count() == r["n_rare"] == 15
    assert rows.where("hour < 0 or hour >= 24.01 or n_prior_txns <> rint(n_prior_txns)").count() == 0
    assert bundle.verify_bundle(spark, r["out_dir"])["passed"]
    p = tmp_path / "g" / "reference_aggregates.json"
    p.write_text(p.read_text().replace('"class_counts": {"false": 45', '"class_counts": {"false": 44'))
    assert not bundle.verify_bundle(spark, r["out_dir"])["passed"]
    assert tables.load_synthetic(spark, r["out_dir"]).count() == 60
    with pytest.raises(ValueError):
        generation.generate(spark, df, mode="wild")


def test_cli_certify(spark, tmp_path, capsys):
    for name, df in (("real", linear(spark)[0]), ("good", linear(spark, seed=5)[0]), ("bad", linear(spark, slope=0.5, seed=6)[0])):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    run = lambda s, o="y": cli.main(["certify", str(tmp_path / "real.parquet"), str(tmp_path / f"{s}.parquet"), "--outcome", o, "--predictors", "x1,x2", "--json"], spark)
    assert (run("good"), run("bad"), run("good", "zz"), run("missing")) == (0, 1, 2, 2)


def test_demo_sources(spark):
    spec = Estimand("y", ("x1", "x2"))
    real = ingest.with_row_id(linear(spark, 600)[0], ["y", "x1", "x2"]).cache()
    status = {k: v["status"] for k, v in demos.certify_sources(real, spec, n=600).items()}
    assert len(status) == 9 and status["bootstrap"] == "certified" and status["independent"] == "not_preserved" and status["noised"] == "not_preserved"
    checks = demos.standard_checks(real, sampling.bootstrap(real, 600, 1), spec)
    assert checks["passed"] == [True, True, True]
    assert demos.mechanism_gap(real, {}, "y", "x1")["real"]["rise"] > 2


def test_control_rates(spark):
    real = linear(spark, 400)[0].cache()
    rates = demos.control_rates(real, Estimand("y", ("x1", "x2")), range(6), n=400)
    assert rates["negative_certified"] == 0 and rates["positive_refused"] <= 3


def test_models_have_the_sizes_of_the_reference(spark, monkeypatch):
    import pyspark.ml.regression

    from attestra.plans import demos, registry

    class Fitted(Exception):
        pass

    def learner(maxIter, **kw):
        raise Fitted(maxIter)

    monkeypatch.setattr(pyspark.ml.regression, "GBTRegressor", learner)
    df = spark.createDataFrame([(float(i % 3), float(i), float(i * i % 7)) for i in range(200)], "l_extendedprice double, l_quantity double, l_discount double")
    monkeypatch.setattr(registry, "table", lambda *_: df)
    with pytest.raises(Fitted, match="^200$"):
        registry.estimand_preserving(spark, "")
    with pytest.raises(Fitted, match="^200$"):
        sampling.conditional_outcome(df, df.withColumn("draw", F.lit(0)), "l_extendedprice", ["l_quantity"], 7)
    assert inspect.signature(demos.sources).parameters["trees"].default == 200
    models = evaluate._models(7)
    assert (models["forest"].getNumTrees(), models["boosted"].getMaxIter()) == (100, 100)


def test_copula_inverse_is_exact_on_a_skewed_column(spark):
    x = np.sort(np.append(np.random.default_rng(3).exponential(size=499), 1e6))
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (math.nan,)], "x double")
    draws = spark.createDataFrame([(i, i / 2000) for i in range(2001)], "draw long, u0 double")
    got = {r.draw: r.u0 for r in sampling.exact_inverse(draws, "u0", df, "x").collect()}
    assert len(got) == 2001 and np.allclose([got[i] for i in range(2001)], np.interp(np.arange(2001) / 2000 * 499, np.arange(500), x))
    made = sampling.copula_baseline(df.where("x >= 0 and not isnan(x)"), ["x"], 2000, 7).toPandas().x
    assert (made > x[-2]).mean() < 0.006
