"""How close a synthetic table's columns are to a real one's."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.ordered import row_numbers, running_sums
from attestra.operators.distance import covered
from attestra.operators.ingest import FieldMeta


@dataclass(frozen=True)
class AuditorConfig:
    tvd: float = 0.15
    wasserstein: float = 0.50
    coverage: float = 0.80
    many_categories: int = 50
    correlation: float = 0.25


def tvd_discrete(real: DataFrame, synth: DataFrame, c: str, most: int = 50) -> DataFrame:
    """(tvd): half the sum of |P - Q| over the values of c. Beyond `most` real values the commonest K = min(values,
    max(20, rows of synth // 5)) stand for themselves, ties by text, and the rest together. An empty side gives 1."""
    def counts(df: DataFrame, n: str) -> DataFrame:
        return df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).agg(F.count("*").alias(n))

    both = counts(real, "r").join(counts(synth, "s"), "v", "full").select("v", F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("s", F.lit(0)).alias("s"))
    total = both.agg(F.coalesce(F.sum("r"), F.lit(0)).alias("nr"), F.coalesce(F.sum("s"), F.lit(0)).alias("ns"), F.count_if(F.col("r") > 0).alias("k")).first()
    nr, ns, k = total
    if not nr or not ns:
        return real.sparkSession.range(1).select(F.lit(1.0).alias("tvd"))
    if k > most:
        top = min(k, max(20, ns // 5))
        # rows are numbered over range partitions, so no task gets all that are kept
        ranked = row_numbers(both.withColumn("__down", -F.col("r")), ["__down", "v"], "__k")
        both = ranked.groupBy(F.when((F.col("__k") < top) & (F.col("r") > 0), F.col("v")).alias("v")).agg(F.sum("r").alias("r"), F.sum("s").alias("s"))
    return both.agg((0.5 * F.sum(F.abs(F.col("r") / nr - F.col("s") / ns))).alias("tvd"))


def tvd_binned(real: DataFrame, synth: DataFrame, c: str, bins: int = 20) -> DataFrame:
    """(tvd) over equal bins of the pooled range, the last one closed; a constant column gives 0."""
    rows = real.select(F.col(c).cast("double").alias("x"), F.lit(0).alias("side")).unionByName(synth.select(F.col(c).cast("double").alias("x"), F.lit(1).alias("side"))).where("x is not null")
    low, high, nr, ns = rows.agg(F.min("x"), F.max("x"), F.count_if(F.col("side") == 0), F.count_if(F.col("side") == 1)).first()
    if low is None or low == high or not nr or not ns:
        return real.sparkSession.range(1).select(F.lit(0.0 if nr and ns else 1.0).alias("tvd"))
    cell = F.least(F.floor((F.col("x") - low) / ((high - low) / bins)), F.lit(bins - 1))
    counts = rows.groupBy(cell.alias("cell")).agg(F.count_if(F.col("side") == 0).alias("r"), F.count_if(F.col("side") == 1).alias("s"))
    return counts.agg((0.5 * F.sum(F.abs(F.col("r") / nr - F.col("s") / ns))).alias("tvd"))


def cdf_gaps(real: DataFrame, synth: DataFrame, c: str) -> tuple[DataFrame, int, int]:
    """One row for each value x of either side: run_r, run_s (rows up to x), next (the value after); and both sizes."""
    rows = real.select(F.col(c).cast("double").alias("x"), F.lit(1).alias("r"), F.lit(0).alias("s")).unionByName(synth.select(F.col(c).cast("double").alias("x"), F.lit(0).alias("r"), F.lit(1).alias("s")))
    values = rows.where("x is not null").groupBy("x").agg(F.sum("r").alias("r"), F.sum("s").alias("s"))
    nr, ns = values.agg(F.coalesce(F.sum("r"), F.lit(0)), F.coalesce(F.sum("s"), F.lit(0))).first()
    return running_sums(values, "x", ["r", "s"]), nr, ns


def wasserstein(real: DataFrame, synth: DataFrame, c: str) -> DataFrame:
    """(w1): the area between the two distribution functions over the real population deviation (1 if that is nothing);
    an empty side gives 1."""
    gaps, nr, ns = cdf_gaps(real, synth, c)
    if not nr or not ns:
        return real.sparkSession.range(1).select(F.lit(1.0).alias("w1"))
    sd = real.agg(F.stddev_pop(F.col(c).cast("double"))).first()[0] or 0.0
    sd = sd if sd > 1e-8 else 1.0
    area = F.abs(F.col("run_r") / nr - F.col("run_s") / ns) * (F.col("next") - F.col("x"))
    return gaps.agg((F.coalesce(F.sum(area), F.lit(0.0)) / sd).alias("w1"))


def ks_distance(real: DataFrame, synth: DataFrame, c: str) -> DataFrame:
    """(ks): the largest gap between the two distribution functions."""
    gaps, nr, ns = cdf_gaps(real, synth, c)
    if not nr or not ns:
        return real.sparkSession.range(1).select(F.lit(1.0).alias("ks"))
    return gaps.agg(F.max(F.abs(F.col("run_r") / nr - F.col("run_s") / ns)).alias("ks"))


def marginal_ks(real: DataFrame, synth: DataFrame, columns: list[str]) -> float:
    return max((ks_distance(real, synth, c).first()[0] for c in columns), default=0.0)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of every pair, in one aggregate; a constant column's are null."""
    x = {c: F.col(c).cast("double") for c in columns}
    pairs = list(combinations(columns, 2))
    aggs = [F.covar_pop(x[a], x[b]).alias(f"c{i}") for i, (a, b) in enumerate(pairs)] + [F.var_pop(x[c]).alias(f"v_{j}") for j, c in enumerate(columns)]
    place = {c: j for j, c in enumerate(columns)}
    one = df.agg(*aggs)
    def r(i: int, a: str, b: str) -> Column:
        spread = F.sqrt(F.col(f"v_{place[a]}") * F.col(f"v_{place[b]}"))
        return F.when(spread > 1e-300, F.col(f"c{i}") / spread)

    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r(i, a, b).alias("r")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("p")).select("p.*")


def correlation_shift(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """(mean_shift, max_shift) of |r_real - r_synth| over pairs that both sides have; null where there are none."""
    if len(columns) < 2 or real.limit(3).count() < 3 or synth.limit(3).count() < 3:
        return real.sparkSession.range(1).select(F.lit(None).cast("double").alias("mean_shift"), F.lit(None).cast("double").alias("max_shift"))
    other = correlations(synth, columns).withColumnRenamed("r", "q")
    gap = F.abs(F.col("r") - F.col("q"))
    return correlations(real, columns).join(F.broadcast(other), ["a", "b"]).agg(F.avg(gap).alias("mean_shift"), F.max(gap).alias("max_shift"))


def coverage_rate(real: DataFrame, synth: DataFrame, columns: list[str]) -> float:
    """The share of real rows with a synthetic row within sqrt(dimensions), columns scaled by the real deviations."""
    return covered(real, synth, columns).agg(F.coalesce(F.avg(F.col("covered").cast("double")), F.lit(0.0))).first()[0]


def column_statistics(real: DataFrame, synth: DataFrame, fields: list[FieldMeta], most: int = 50, bins: int = 20) -> dict[str, dict]:
    """column -> its statistics as wasserstein(), tvd_binned() and tvd_discrete() give them, for all columns in two passes:
    one over (column, value) counts of both sides for numbers, one for categories."""
    numbers = [m.name for m in fields if m.kind == "continuous"]
    others = [m.name for m in fields if m.kind != "continuous"]
    out: dict[str, dict] = {}

    def counts(names: list[str], kind: str) -> DataFrame:
        def side(df: DataFrame, r: int) -> DataFrame:
            pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("x")) for c in names])
            return df.select(F.explode(pairs).alias("p"), F.lit(r).alias("r"), F.lit(1 - r).alias("s")).select("p.*", "r", "s")

        return side(real, 1).unionByName(side(synth, 0)).where("x is not null").groupBy("column", "x").agg(F.sum("r").alias("r"), F.sum("s").alias("s"))

    if numbers:
        values = counts(numbers, "double").cache()
        facts = {r["column"]: r for r in values.groupBy("column").agg(F.sum("r").alias("nr"), F.sum("s").alias("ns"), F.min("x").alias("low"), F.max("x").alias("high")).collect()}
        sd = real.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in numbers]).first()
        run = running_sums(values, "x", ["r", "s"], by="column")
        share = F.broadcast(real.sparkSession.createDataFrame([(c, float(f["nr"]), float(f["ns"]), f["low"], f["high"]) for c, f in facts.items()], "column string, nr double, ns double, low double, high double")) if facts else None
        area, cells = {}, {}
        if share is not None:
            gap = F.abs(F.try_divide("run_r", "nr") - F.try_divide("run_s", "ns")) * (F.col("next") - F.col("x"))
            area = {r["column"]: r["a"] for r in run.join(share, "column").groupBy("column").agg(F.sum(gap).alias("a")).collect()}
            cell = F.least(F.floor(F.try_divide(F.col("x") - F.col("low"), (F.col("high") - F.col("low")) / bins)), F.lit(bins - 1))
            per = values.join(share, "column").groupBy("column", cell.alias("cell")).agg(F.try_divide(F.sum("r"), F.first("nr")).alias("p"), F.try_divide(F.sum("s"), F.first("ns")).alias("q"))
            cells = {r["column"]: r["t"] for r in per.groupBy("column").agg((0.5 * F.sum(F.abs(F.col("p") - F.col("q")))).alias("t")).collect()}
        values.unpersist()
        for c in numbers:
            f, spread = facts.get(c), sd[c] or 0.0
            whole = f is not None and f["nr"] > 0 and f["ns"] > 0
            out[c] = {"wasserstein": (area.get(c) or 0.0) / (spread if spread > 1e-8 else 1.0) if whole else 1.0, "tvd": (0.0 if f["low"] == f["high"] else cells[c]) if whole else 1.0}
    if others:
        both = counts(others, "string").cache()
        facts = {r["column"]: r for r in both.groupBy("column").agg(F.sum("r").alias("nr"), F.sum("s").alias("ns"), F.count_if(F.col("r") > 0).alias("k")).collect()}
        top = F.lit(None).cast("long")
        for c, f in facts.items():
            keep = f["k"] if f["k"] <= most else min(f["k"], max(20, f["ns"] // 5))
            top = F.when(F.col("column") == c, F.lit(keep if f["k"] > most else None).cast("long")).otherwise(top)
        # one numbering over all columns; a column's ranks count from its first row
        ranked = row_numbers(both.withColumn("__down", -F.col("r")), ["column", "__down", "x"], "__k")
        firsts = F.broadcast(ranked.groupBy("column").agg(F.min("__k").alias("__first")))
        ranked = ranked.join(firsts, "column").withColumn("rank", F.col("__k") - F.col("__first") + 1)
        bucketed = ranked.withColumn("top", top).withColumn("v", F.when(F.col("top").isNull() | ((F.col("rank") <= F.col("top")) & (F.col("r") > 0)), F.col("x")))
        rows = bucketed.groupBy("column", "v").agg(F.sum("r").alias("r"), F.sum("s").alias("s"))
        w = Window.partitionBy("column")
        told = rows.select("column", F.abs(F.try_divide("r", F.sum("r").over(w)) - F.try_divide("s", F.sum("s").over(w))).alias("d")).groupBy("column").agg((0.5 * F.sum("d")).alias("t"))
        tvd = {r["column"]: r["t"] for r in told.collect()}
        both.unpersist()
        for c in others:
            f = facts.get(c)
            out[c] = {"tvd": tvd[c] if f is not None and f["nr"] > 0 and f["ns"] > 0 else 1.0}
    return out


def audit(real: DataFrame, synth: DataFrame, fields: dict[str, FieldMeta], cfg: AuditorConfig = AuditorConfig(), check_coverage: bool = True) -> dict:
    """The fidelity report: per column its statistic and verdict, correlation shift, coverage, passed. Identifiers are
    left out and named."""
    left_out, used = [m.name for m in fields.values() if m.is_identifier], [m for m in fields.values() if not m.is_identifier]
    found = column_statistics(real, synth, used, cfg.many_categories)
    columns = []
    for m in used:
        stat = found[m.name]
        passed = stat["wasserstein"] <= cfg.wasserstein if m.kind == "continuous" else stat["tvd"] <= cfg.tvd
        columns.append({"column": m.name, "kind": m.kind, **stat, "passed": bool(passed)})
    numeric = [m.name for m in fields.values() if m.kind in ("continuous", "binary") and not m.is_identifier]
    shift = correlation_shift(real, synth, numeric).first()["mean_shift"]
    coverage = coverage_rate(real, synth, numeric) if check_coverage and numeric else None
    passed = all(r["passed"] for r in columns) and (shift is None or shift <= cfg.correlation) and (coverage is None or coverage >= cfg.coverage)
    return {"columns": columns, "correlation_shift": shift, "coverage": coverage, "left_out": left_out, "passed": bool(passed), "score": fidelity_score(columns)}


def fidelity_score(columns: list[dict]) -> float:
    return sum(r["passed"] for r in columns) / len(columns) if columns else 0.0


# -- class separation and disclosure -------------------------------------------------------------------------------

def fisher_rank(df: DataFrame, columns: list[str], rare: str = "__rare") -> DataFrame:
    """(feature, separation, rank): squared difference of class means over the sum of class variances, rounded to six
    places, in one aggregate."""
    aggs = []
    for i, c in enumerate(columns):
        for side, name in ((F.col(rare), "r"), (~F.col(rare), "n")):
            x = F.when(side, F.col(c).cast("double"))
            aggs += [F.avg(x).alias(f"m{name}{i}"), F.var_pop(x).alias(f"v{name}{i}")]
    one = df.agg(*aggs)
    score = [F.round((F.col(f"mr{i}") - F.col(f"mn{i}")) ** 2 / (F.col(f"vr{i}") + F.col(f"vn{i}") + 1e-8), 6) for i in range(len(columns))]
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), s.alias("separation")) for c, s in zip(columns, score, strict=True)])).alias("f")).select("f.*")
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("separation"), "feature")))


def fisher_cv(df: DataFrame, columns: list[str], rare: str = "__rare") -> float:
    """Spread over mean of the separations; 0 where the mean is nothing."""
    mean, sd = fisher_rank(df, columns, rare).agg(F.avg("separation"), F.stddev_pop("separation")).first()
    return sd / mean if mean else 0.0


def class_moments(df: DataFrame, columns: list[str], rare: str = "__rare") -> DataFrame:
    """(feature, rare, n, mean, var): population moments by class."""
    one = df.groupBy(F.col(rare).alias("rare")).agg(F.count("*").alias("n"), *[f(F.col(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("v", F.var_pop))])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("mean"), F.col(f"v{i}").alias("var")) for i, c in enumerate(columns)])
    return one.select("rare", "n", F.explode(rows).alias("f")).select("f.feature", "rare", "n", "f.mean", "f.var")


def smoothed_frequencies(df: DataFrame, c: str, categories: list) -> DataFrame:
    """(value, p) for each category: count plus one half, normalised; absent ones included."""
    spark = df.sparkSession
    listed = spark.createDataFrame([(v,) for v in categories], f"value {df.schema[c].dataType.simpleString()}")
    counts = df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n"))
    rows = listed.join(counts, "value", "left").select("value", (F.coalesce("n", F.lit(0)) + 0.5).alias("n"))
    total = rows.agg(F.sum("n")).first()[0]
    return rows.select("value", (F.col("n") / total).alias("p"))


def conformance(df: DataFrame, rules: dict[str, dict], label: str | None = None) -> DataFrame:
    """(column, violation, n_rows) in one aggregate. rules: column -> min, max, integer, values, identifier; the label is
    exempt, and identifiers are only held to be unique (each null after the first counts)."""
    aggs, names = [], []
    for c, rule in rules.items():
        if c == label or c not in df.columns:
            continue
        x = F.col(c).cast("double") if any(k in rule for k in ("min", "max", "integer")) else None
        if rule.get("identifier"):
            aggs.append(F.count("*") - F.count_distinct(c) - F.least(F.count_if(F.col(c).isNull()), F.lit(1)))
            names.append((c, "duplicate"))
            continue
        if rule.get("min") is not None:
            aggs.append(F.count_if(x < rule["min"]))
            names.append((c, "below_min"))
        if rule.get("max") is not None:
            aggs.append(F.count_if(x > rule["max"]))
            names.append((c, "above_max"))
        if rule.get("integer"):
            aggs.append(F.count_if(x != F.floor(x)))
            names.append((c, "non_integer"))
        if rule.get("values") is not None:
            aggs.append(F.count_if(~F.coalesce(F.col(c).cast("string").isin([str(v) for v in rule["values"]]), F.lit(False))))
            names.append((c, "outside_set"))
    if not aggs:
        return df.sparkSession.createDataFrame([], "column string, violation string, n_rows bigint")
    one = df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(v).alias("violation"), F.col(f"a{i}").cast("long").alias("n_rows")) for i, (c, v) in enumerate(names)])
    return one.select(F.explode(rows).alias("r")).select("r.*").where("n_rows > 0")


def grouped_rate(df: DataFrame, value: str, by: Column, least: int = 30) -> DataFrame:
    """(level, n, rate, step): mean of value by level, levels of fewer than `least` rows left out; step is the change
    from the level before."""
    rates = df.groupBy(by.alias("level")).agg(F.count("*").alias("n"), F.avg(F.col(value).cast("double")).alias("rate")).where(F.col("n") >= least)
    return rates.withColumn("step", F.col("rate") - F.lag("rate").over(Window.orderBy("level")))


def sweep_summary(rows: DataFrame) -> DataFrame:
    """rows (coefficient, theta_real, theta_synth, certified) of many seeds: mean bias, spread and certified share."""
    return rows.groupBy("coefficient").agg(F.avg(F.col("theta_synth") - F.col("theta_real")).alias("mean_bias"), F.stddev_pop("theta_synth").alias("spread"), F.avg(F.col("certified").cast("double")).alias("certified_rate"))
