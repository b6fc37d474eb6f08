"""Global order statistics without a single-partition sort: quantiles, running sums, row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a pass over a range, and rows of a range that a single task may sort.
CELLS, FEW = 1024, 50_000


def _rank_value(df: DataFrame, c: str, k: int, low: float, high: float, below: int) -> float:
    """The k-th smallest value (from 0) of a double column within [low, high]; below values are under low. Each pass
    counts cells of the range in one map-side aggregate and goes on in one of them."""
    while low < high:
        width = (high - low) / CELLS
        inside = df.where((F.col(c) >= low) & (F.col(c) <= high))
        cell = F.lit(0) if width <= 0 else F.least(F.floor((F.col(c) - low) / width), F.lit(CELLS - 1))
        rows = inside.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(c).alias("low"), F.max(c).alias("high")).orderBy("cell").collect()
        for r in rows:
            if below + r["n"] > k:
                if r["n"] <= FEW:
                    part = df.where((F.col(c) >= r["low"]) & (F.col(c) <= r["high"])).select(c).orderBy(c).limit(k - below + 1).collect()
                    return float(part[-1][0])
                if len(rows) == 1 and (r["low"], r["high"]) == (low, high):
                    part = df.where((F.col(c) >= low) & (F.col(c) <= high)).groupBy(c).count().orderBy(c)
                    for v, n in part.toLocalIterator():
                        below += n
                        if below > k:
                            return float(v)
                low, high = float(r["low"]), float(r["high"])
                break
            below += r["n"]
    return low


def ranked_value(df: DataFrame, c: str, k: int) -> float:
    """The k-th smallest value (from 0) of a double column without nulls."""
    low, high = df.agg(F.min(c), F.max(c)).first()
    return _rank_value(df, c, k, float(low), float(high), 0)


def quantiles(df: DataFrame, c: str, probs: list[float]) -> list[float]:
    """Exact quantiles with linear interpolation of a numeric column; nulls and NaN are left out, none left gives NaN."""
    x = df.select(F.col(c).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    n, low, high = x.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return [float("nan")] * len(probs)
    if n <= FEW:  # so many fit the driver, in one pass
        values = sorted(r[0] for r in x.collect())
        known = dict(enumerate(values))
    else:
        known = {0: float(low), n - 1: float(high)}
    ranks = sorted({k for p in probs for k in (int(p * (n - 1)), min(n - 1, int(p * (n - 1)) + 1))} - set(known))
    if len(ranks) > 3:  # many at once: one running sum over the distinct values
        run = running_sums(x.groupBy("x").agg(F.count("*").alias("n")), "x", ["n"])
        wanted = F.filter(F.array(*[F.lit(k) for k in ranks]), lambda k: (k >= F.col("run_n") - F.col("n")) & (k < F.col("run_n")))
        known |= {r["k"]: r["x"] for r in run.select("x", F.explode(wanted).alias("k")).collect()}

    def at(k: int) -> float:
        if k not in known:
            known[k] = _rank_value(x, "x", k, float(low), float(high), 0)
        return known[k]

    out = []
    for p in probs:
        place = p * (n - 1)
        k = int(place)
        a = at(k)
        out.append(a if place == k else a + (at(k + 1) - a) * (place - k))
    return out


def _bin(c: str, bounds: list[float]) -> Column:
    if not bounds:
        return F.lit(0)
    return F.aggregate(F.array(*[F.lit(float(b)) for b in bounds]), F.lit(0), lambda a, b: a + (F.col(c) > b).cast("int"))


def running_sums(df: DataFrame, order: str, sums: list[str], bins: int = 64, by: str | None = None) -> DataFrame:
    """df, with one row for each value of order (and of by, a column of few values), plus run_<c> (sum of c up to and with
    the row) and next (the following value of order). The rows are cut into bins at approximate quantiles; only the bins'
    totals meet in one task."""
    group = [by] if by else []
    cut = F.percentile_approx(order, [i / bins for i in range(1, bins)], 1000).alias("bounds")
    found = df.groupBy(*group).agg(cut).collect()
    bounds = {r[by] if by else None: sorted(set(r["bounds"] or [])) for r in found}
    if by:
        place = F.lit(0)
        for k, v in bounds.items():
            place = F.when(F.col(by) == F.lit(k), _bin(order, v)).otherwise(place)
    else:
        place = _bin(order, bounds.get(None, []))
    binned = df.withColumn("__bin", place)
    totals = binned.groupBy(*group, "__bin").agg(*[F.sum(c).alias(f"__{c}") for c in sums], F.min(order).alias("__first"))
    over = Window.partitionBy(*group).orderBy("__bin")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "__bin", *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__off_{c}") for c in sums], F.lead("__first").over(over).alias("__after"))
    w = Window.partitionBy(*group, "__bin").orderBy(order)
    joined = binned.join(F.broadcast(offsets), [*group, "__bin"])
    return joined.select(*df.columns, *[(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col(f"__off_{c}")).alias(f"run_{c}") for c in sums], F.coalesce(F.lead(order).over(w), F.col("__after")).alias("next"))


def quantile_table(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list[float]]:
    """quantiles() of several columns, from one running sum over (column, value) counts."""
    if not columns:
        return {}
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.select(F.explode(pairs).alias("p")).select("p.*").where(F.col("x").isNotNull() & ~F.isnan("x"))
    values = long.groupBy("column", "x").agg(F.count("*").alias("n")).cache()
    sizes = {r["column"]: r["n"] for r in values.groupBy("column").agg(F.sum("n").alias("n")).collect()}
    ranks = {c: sorted({k for p in probs for k in (int(p * (n - 1)), min(n - 1, int(p * (n - 1)) + 1))}) for c, n in sizes.items()}
    wanted = F.array().cast("array<bigint>")
    for c, ks in ranks.items():
        wanted = F.when(F.col("column") == c, F.array(*[F.lit(k).cast("bigint") for k in ks])).otherwise(wanted)
    found: dict[tuple[str, int], float] = {}
    if sizes:
        run = running_sums(values, "x", ["n"], by="column").withColumn("ks", wanted)
        hit = F.filter("ks", lambda k: (k >= F.col("run_n") - F.col("n")) & (k < F.col("run_n")))
        found = {(r["column"], r["k"]): r["x"] for r in run.select("column", "x", F.explode(hit).alias("k")).collect()}
    values.unpersist()

    def at(c: str, p: float) -> float:
        n = sizes.get(c, 0)
        if not n:
            return float("nan")
        place = p * (n - 1)
        k = int(place)
        a = found[(c, k)]
        return a if place == k else a + (found[(c, k + 1)] - a) * (place - k)

    return {c: [at(c, p) for p in probs] for c in columns}


def row_numbers(df: DataFrame, order: list[str], name: str = "row", bins: int = 64) -> DataFrame:
    """df with consecutive numbers from 0 by order: rows are range-partitioned, numbered within their partition, and
    moved on by the sizes of the partitions before."""
    spread = df.repartitionByRange(bins, *order).withColumn("__part", F.spark_partition_id())
    within = spread.withColumn("__k", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = within.groupBy("__part").agg(F.count("*").alias("__n"))
    offset = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    return within.join(F.broadcast(offset), "__part").select(*df.columns, (F.col("__k") + F.col("__off") - 1).cast("long").alias(name))


def average_ranks(df: DataFrame, c: str, name: str = "rank") -> DataFrame:
    """df with the average rank of c, ties sharing it; counts by value are summed in bins and joined back."""
    counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("__n"))
    ranked = running_sums(counts.withColumn("__x", F.col(c).cast("double")), "__x", ["__n"])
    avg = ranked.select(c, (F.col("run___n") - (F.col("__n") - 1) / 2).alias(name))
    return df.join(avg, c, "left").select(*df.columns, name)
