"""Detection lift, train-on-synthetic test-on-real, and their metrics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from statistics import median

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.functions.ordered import ranked_value, running_sums
from attestra.operators.distance import smote


@dataclass(frozen=True)
class ExaminerConfig:
    trees: int = 100
    test_size: float = 0.30
    max_normal: int = 10_000
    min_test_rare: int = 10


def stratified_split(df: DataFrame, test_size: float, seed: int, rare: str = "__rare", key: str = "__rid") -> tuple[DataFrame, DataFrame]:
    """(train, test): each class is cut at the quantile of a hash of its row ids, to the exact number of rows."""
    # the hash is a whole number below 2**53, so its order statistics are exact as doubles; ties go by key
    hashed = df.withColumn("__h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11).cast("double"))
    picked, narrow = F.lit(False), hashed.select(rare, key, "__h").cache()
    for r in narrow.groupBy(rare).count().collect():
        k = round(r["count"] * test_size)
        if k:
            part = narrow.where(F.col(rare) == r[rare])
            cut = ranked_value(part, "__h", k - 1)
            below = part.where(F.col("__h") < cut).count()
            last = [x[0] for x in part.where(F.col("__h") == cut).select(key).orderBy(key).limit(k - below).collect()]
            picked = picked | ((F.col(rare) == r[rare]) & ((F.col("__h") < cut) | ((F.col("__h") == cut) & F.col(key).isin(last))))
    narrow.unpersist()
    return hashed.where(~picked).drop("__h"), hashed.where(picked).drop("__h")


def score_counts(scored: DataFrame) -> DataFrame:
    """(x, pos, neg) by distinct score, x being the score's negative, so best come first."""
    return scored.groupBy((-F.col("score").cast("double")).alias("x")).agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum(1 - F.col("y").cast("long")).alias("neg"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """(roc_auc) of rows (y 0/1, score): the chance that a positive outranks a negative, ties by half."""
    run = running_sums(score_counts(scored), "x", ["pos", "neg"])
    pairs = F.sum(F.col("neg") * (F.col("run_pos") - F.col("pos") / 2))
    return run.agg(F.try_divide(pairs, (F.sum("pos") * F.sum("neg")).cast("double")).alias("roc_auc"))


def average_precision(scored: DataFrame) -> DataFrame:
    """(average_precision): precision at each distinct score times the recall it adds."""
    run = running_sums(score_counts(scored), "x", ["pos", "neg"])
    return run.agg(F.try_divide(F.sum(F.col("pos") * F.col("run_pos") / (F.col("run_pos") + F.col("run_neg"))), F.sum("pos").cast("double")).alias("average_precision"))


def recall_precision(predicted: DataFrame) -> DataFrame:
    """(recall, precision) of rows (y, prediction); nothing to divide by gives 0."""
    hit = F.count_if((F.col("y") == 1) & (F.col("prediction") == 1))
    return predicted.agg(F.coalesce(F.try_divide(hit, F.count_if(F.col("y") == 1)), F.lit(0.0)).alias("recall"), F.coalesce(F.try_divide(hit, F.count_if(F.col("prediction") == 1)), F.lit(0.0)).alias("precision"))


def _rows(df: DataFrame, columns: list[str], rare: str = "__rare") -> DataFrame:
    filled = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in columns]
    return VectorAssembler(inputCols=columns, outputCol="features").transform(df.select(*filled, F.col(rare).cast("int").cast("double").alias("y")))


def _balanced(rows: DataFrame) -> DataFrame:
    n, k = rows.agg(F.count("*"), F.sum("y")).first()
    return rows.withColumn("w", F.when(F.col("y") == 1, n / (2.0 * max(1.0, k))).otherwise(n / (2.0 * max(1.0, n - k))))


def _forest(train: DataFrame, trees: int, seed: int):
    return RandomForestClassifier(labelCol="y", weightCol="w", numTrees=trees, seed=seed).fit(_balanced(train))


def measure_lift(df: DataFrame, columns: list[str], generate: Callable[[DataFrame], DataFrame], cfg: ExaminerConfig = ExaminerConfig(), seed: int = 42, coded: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict:
    """Recall of a balanced forest on real test rows with and without synthetic rare rows, which come from the train
    part only. coded makes numbers of real rows; generate() gets them as they are and gives numbers."""
    sample = df.where("not __rare").orderBy(F.xxhash64(F.lit(seed), "__rid"), "__rid").limit(cfg.max_normal).unionByName(df.where("__rare")).cache()
    train, test = stratified_split(sample, cfg.test_size, seed)
    held = [sample]
    try:
        if test.where("__rare").count() < cfg.min_test_rare:
            return {"status": "insufficient_rare_rows"}
        # forests read their rows several times
        base, real = _rows(coded(train), columns).cache(), _rows(coded(test), columns).cache()
        made = _rows(generate(train).withColumn("__rare", F.lit(True)), columns).cache()
        held += [base, real, made]
        scores = [recall_precision(_forest(t, cfg.trees, seed).transform(real)).first() for t in (base, base.unionByName(made))]
    finally:
        for x in held:
            x.unpersist()
    return {"status": "ok", "baseline_recall": scores[0]["recall"], "augmented_recall": scores[1]["recall"], "lift": scores[1]["recall"] - scores[0]["recall"], "precision": scores[1]["precision"]}


def _models(seed: int) -> dict:
    return {
        "logistic": LogisticRegression(labelCol="y", weightCol="w", maxIter=50),
        "forest": RandomForestClassifier(labelCol="y", weightCol="w", numTrees=100, seed=seed),
        "boosted": GBTClassifier(labelCol="y", weightCol="w", maxIter=100, maxDepth=3, seed=seed),
    }


def measure_tstr(train: DataFrame, test: DataFrame, synth: DataFrame, columns: list[str], seeds: tuple[int, ...] = (42, 53, 61), min_test_rare: int = 10) -> dict:
    """Medians over models and seeds of synthetic-trained over real-trained ROC-AUC and average precision, on real test
    rows. Ratios above 1.05 are flagged."""
    if test.where("__rare").count() < min_test_rare:
        return {"status": "insufficient_rare_rows"}
    if any(df.select("__rare").distinct().count() < 2 for df in (train, synth)):
        return {"status": "one_class"}
    real, own, made = _rows(test, columns), _balanced(_rows(train, columns)), _balanced(_rows(synth, columns))
    rows = []
    for seed in seeds:
        for name, model in _models(seed).items():
            got = {}
            for side, data in (("real", own), ("synth", made)):
                scored = model.fit(data).transform(real).select(F.col("y").cast("int").alias("y"), vector_to_array("probability")[1].alias("score")).cache()
                got[side] = (roc_auc(scored).first()[0], average_precision(scored).first()[0])
                scored.unpersist()
            rows.append({"model": name, "seed": seed, "roc_ratio": got["synth"][0] / got["real"][0], "ap_ratio": got["synth"][1] / max(got["real"][1], 1e-12)})
    roc = median(r["roc_ratio"] for r in rows)
    return {"status": "ok", "roc_ratio": roc, "ap_ratio": median(r["ap_ratio"] for r in rows), "suspicious": roc > 1.05, "rows": rows}


def smote_lift(df: DataFrame, columns: list[str], seed: int = 42, cfg: ExaminerConfig = ExaminerConfig(trees=50)) -> dict:
    """measure_lift() with as many interpolated rows as the train part has rare ones."""
    def generate(train: DataFrame) -> DataFrame:
        rare = train.where("__rare")
        return smote(rare, columns, rare.count(), seed)

    return measure_lift(df, columns, generate, cfg, seed)


def screen(df: DataFrame, columns: list[str], generate: Callable[[DataFrame], DataFrame], seed: int = 42, separation_cv: float | None = None) -> dict:
    """Which of own generation and interpolation lifts recall more; where neither can be measured, the spread of class
    separations decides."""
    own, other = measure_lift(df, columns, generate, seed=seed), smote_lift(df, columns, seed)
    if own["status"] != "ok" or other["status"] != "ok":
        return {"winner": "own" if (separation_cv or 0.0) >= 0.5 else "smote", "basis": "separation", "confidence": None, "own": own, "smote": other}
    total = abs(own["lift"]) + abs(other["lift"])
    return {"winner": "own" if own["lift"] >= other["lift"] else "smote", "basis": "lift", "confidence": abs(own["lift"] - other["lift"]) / total if total else 0.0, "own": own, "smote": other}
