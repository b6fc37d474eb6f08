"""Distance-shaped joins: nearest row, near-verbatim rows, unique tuples, coverage, interpolation between neighbours.

Distances are Euclidean over columns divided by the reference side's population deviation (1 where that is under 1e-8).
Up to FEW_ROWS distinct references are handed to every task. More are dealt into the leaves of a k-d tree: a query is first
held against its own leaf, and then only against the leaves whose box is nearer than what it found there. Both sides meet
by leaf in a shuffle; a leaf with many queries is searched by several tasks. Distances are exact either way.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import random as rnd
from attestra.functions.ordered import quantiles, row_numbers

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Distinct references that are handed to every task; rows of a leaf and queries of a task beyond that; leaves at most.
FEW_ROWS, LEAF_ROWS, SHARE_ROWS, MOST_LEAVES = 20_000, 4096, 50_000, 10_000
VERBATIM_TOLERANCE = 1e-3


def scales(df: DataFrame, columns: list[str]) -> list[float]:
    r = df.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    return [x if (x := r[i]) is not None and x >= 1e-8 else 1.0 for i in range(len(columns))]


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(y)))
    for i in range(x.shape[1]):
        out += (x[:, i, None] - y[None, :, i]) ** 2
    return out


def closest(x: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distances and ids of the k rows of y (ids ascending) that are nearest to each row of x, ties to the smaller id; inf
    and -1 beyond len(y). A row whose id is own is left out."""
    dist, found = np.full((len(x), k), np.inf), np.full((len(x), k), -1, np.int64)
    step, most = max(1, (1 << 21) // max(1, len(y))), min(k, len(y))
    for i in range(0, len(x) if most else 0, step):
        d = squared_distances(x[i : i + step], y)
        if own is not None:
            d[own[i : i + step, None] == ids[None, :]] = np.inf
        order = d.argmin(axis=1)[:, None] if k == 1 else np.argsort(d, axis=1, kind="stable")[:, :most]
        near = np.sqrt(np.take_along_axis(d, order, axis=1))
        dist[i : i + step, :most], found[i : i + step, :most] = near, np.where(np.isfinite(near), ids[order], -1)
    return dist, found


class Tree:
    """Cuts of a k-d tree over a sample: plain arrays, so that workers need no class to read them."""

    @staticmethod
    def cuts(sample: np.ndarray, leaves: int) -> np.ndarray:
        """Rows (dimension, value, left, right); a child of -1 - k is leaf k. Cuts halve the widest dimension."""
        rows: list[list[float]] = []
        leaf = [0]

        def grow(part: np.ndarray, n: int) -> int:
            spread = np.ptp(part, axis=0) if len(part) else np.zeros(sample.shape[1])
            if n <= 1 or not len(part) or spread.max() <= 0:
                leaf[0] += 1
                return -leaf[0]
            dim = int(spread.argmax())
            value = float(np.median(part[:, dim]))
            if value >= part[:, dim].max():  # the largest value has over half of the rows
                value = float(part[part[:, dim] < value, dim].max())
            at = len(rows)
            rows.append([dim, value, 0, 0])
            low = part[:, dim] <= value
            rows[at][2] = grow(part[low], n // 2)
            rows[at][3] = grow(part[~low], n - n // 2)
            return at

        grow(sample, leaves)
        return np.array(rows or [[0, np.inf, -1, -1]], dtype=float)

    @staticmethod
    def leaves(cuts: np.ndarray, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while (open_ := at >= 0).any():
            c = cuts[at[open_]]
            low = x[open_, c[:, 0].astype(int)] <= c[:, 1]
            at[open_] = np.where(low, c[:, 2], c[:, 3]).astype(np.int64)
        return -1 - at


def _at_leaf(cuts: np.ndarray, names: list[str]):
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(leaf=Tree.leaves(cuts, pdf[names].to_numpy(float)))

    return place


def _beyond(boxes: tuple[np.ndarray, np.ndarray, np.ndarray], names: list[str], k: int):
    """Rows with dist and ids as far as they are known, once for each further leaf whose box may hold something nearer."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaf, low, high = boxes
        for pdf in batches:
            x, reach = pdf[names].to_numpy(float), np.stack(pdf["dist"].to_numpy())[:, k - 1] if len(pdf) else np.zeros(0)
            own = pdf["leaf"].to_numpy()
            for i in range(0, len(pdf), max(1, (1 << 21) // max(1, len(leaf) * len(names)))):
                j = min(len(pdf), i + max(1, (1 << 21) // max(1, len(leaf) * len(names))))
                gap = np.zeros((j - i, len(leaf)))
                for d in range(len(names)):
                    v = x[i:j, d, None]
                    gap += np.maximum(np.maximum(low[None, :, d] - v, v - high[None, :, d]), 0.0) ** 2
                row, col = np.nonzero((np.sqrt(gap) <= reach[i:j, None] * (1 + 1e-12)) & (leaf[None, :] != own[i:j, None]))
                yield pdf.iloc[i + row].drop(columns=["dist", "ids"]).assign(leaf=leaf[col])

    return spread


def _visit(names: list[str], k: int, keyed: bool):
    def visit(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("__ref")
        own = left["__own"].to_numpy() if keyed else None
        dist, ids = closest(left[names].to_numpy(float), right[names].to_numpy(float), right["__ref"].to_numpy(), k, own)
        return left.assign(dist=list(dist), ids=list(ids))

    return visit


def _handed(handed, names: list[str], k: int, keyed: bool):
    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y, ids = handed.value
        for pdf in batches:
            dist, found = closest(pdf[names].to_numpy(float), y, ids, k, pdf["__own"].to_numpy() if keyed else None)
            yield pdf.assign(dist=list(dist), ids=list(found))

    return look


def neighbours(points: DataFrame, refs: DataFrame, names: list[str], k: int, keyed: bool = False, distinct: bool = False) -> DataFrame:
    """points (names, and with keyed __own) with dist and ids, arrays of the k nearest rows of refs (names, __ref), nearest
    first, ties to the smaller __ref; inf and -1 where there are fewer. With keyed a row whose __ref is __own is left out.
    Points should be distinct; of references that coincide only the first k + 1 count, with distinct there are none."""
    refs = refs.select(*names, F.col("__ref").cast("long").alias("__ref"))
    if not distinct:
        over = Window.partitionBy(*names).orderBy("__ref")
        refs = refs.withColumn("__n", F.row_number().over(over)).where(F.col("__n") <= k + 1).drop("__n")
    few = refs.limit(FEW_ROWS + 1).collect()
    told = ", ".join([*[f"`{c}` {points.schema[c].dataType.simpleString()}" for c in points.columns], "dist array<double>", "ids array<bigint>"])
    if len(few) <= FEW_ROWS:
        rows = sorted(few, key=lambda r: r["__ref"])
        y = np.array([[r[c] for c in names] for r in rows], dtype=float).reshape(len(rows), len(names))
        handed = points.sparkSession.sparkContext.broadcast((y, np.array([r["__ref"] for r in rows], np.int64)))
        return points.mapInPandas(_handed(handed, names, k, keyed), told)
    leaves = min(MOST_LEAVES, math.ceil(refs.count() / LEAF_ROWS))
    sample = refs.orderBy(F.xxhash64("__ref", *names), "__ref").select(*names).limit(32 * leaves).collect()
    cuts = Tree.cuts(np.array([tuple(r) for r in sample], dtype=float), leaves)
    plain = lambda df: ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in df.columns], "leaf bigint"])
    refs = refs.mapInPandas(_at_leaf(cuts, names), plain(refs))
    boxes = refs.groupBy("leaf").agg(*[f(c).alias(f"{t}{i}") for i, c in enumerate(names) for t, f in (("l", F.min), ("h", F.max))]).collect()
    low, high = (np.array([[r[f"{t}{i}"] for i in range(len(names))] for r in boxes], dtype=float) for t in "lh")

    def met(asked: DataFrame) -> DataFrame:
        shares = F.broadcast(asked.groupBy("leaf").agg((F.floor(F.count("*") / SHARE_ROWS) + 1).alias("__s")))  # one row a leaf
        left = asked.join(shares, "leaf").withColumn("__share", F.pmod(F.xxhash64(*names), "__s")).drop("__s")
        right = refs.join(shares, "leaf").select("leaf", *names, "__ref", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__s") - 1)).alias("__share"))
        out = ", ".join([*[f"`{c}` {t}" for c, t in left.dtypes], "dist array<double>", "ids array<bigint>"])
        return left.groupBy("leaf", "__share").cogroup(right.groupBy("leaf", "__share")).applyInPandas(_visit(names, k, keyed), out).drop("__share")

    first = met(points.mapInPandas(_at_leaf(cuts, names), plain(points)))
    more = met(first.mapInPandas(_beyond((np.array([r["leaf"] for r in boxes]), low, high), names, k), plain(points)))
    both = first.unionByName(more).select(*points.columns, F.explode(F.arrays_zip("dist", "ids")).alias("p")).where("p.ids >= 0")
    best = F.slice(F.array_sort(F.collect_list("p")), 1, k)
    found = both.groupBy(*points.columns).agg(best.alias("p"))
    pad = lambda c, v: F.concat(F.col(f"p.{c}"), F.array_repeat(F.lit(v), k - F.size("p")))
    return found.select(*points.columns, pad("dist", math.inf).alias("dist"), pad("ids", -1).cast("array<bigint>").alias("ids"))


def _scaled(columns: list[str], scale: list[float]) -> list[Column]:
    """__x0, __x1, ...: columns over their scale, null as nothing; adding nothing turns a negative zero into zero."""
    return [(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) / F.lit(float(s)) + F.lit(0.0)).alias(f"__x{i}") for i, (c, s) in enumerate(zip(columns, scale, strict=True))]


def nearest(queries: DataFrame, refs: DataFrame, columns: list[str], scale: list[float] | None = None) -> DataFrame:
    """queries with distance to the nearest reference row; infinite without columns or references. Only distinct points are
    searched."""
    if not columns:
        return queries.withColumn("distance", F.lit(math.inf))
    scale = scale or scales(refs, columns)
    names = [f"__x{i}" for i in range(len(columns))]
    asked = queries.select("*", *_scaled(columns, scale))
    points = refs.select(*_scaled(columns, scale)).distinct().withColumn("__ref", F.lit(0))
    found = neighbours(asked.select(*names).distinct(), points, names, 1, distinct=True).select(*names, F.get("dist", F.lit(0)).alias("distance"))
    return asked.join(found, names, "left").withColumn("distance", F.coalesce("distance", F.lit(math.inf))).select(*queries.columns, "distance")


def nearest_quantiles(queries: DataFrame, refs: DataFrame, columns: list[str]) -> DataFrame:
    """(low, p10, p50, p90) of the distances."""
    d = nearest(queries, refs, columns).select("distance").cache()
    try:
        low = d.agg(F.min("distance")).first()[0]
        if low is None or math.isinf(low):
            row = (low,) * 4
        else:
            row = (low, *quantiles(d, "distance", [0.1, 0.5, 0.9]))
    finally:
        d.unpersist()
    return queries.sparkSession.createDataFrame([row], "low double, p10 double, p50 double, p90 double")


def verbatim(synth: DataFrame, real: DataFrame, continuous: list[str], discrete: list[str], key: str = "__rid", tolerance: float = VERBATIM_TOLERANCE) -> DataFrame:
    """(key) of synthetic rows within tolerance deviations of a real row on the continuous columns and equal on all
    discrete ones. Cells over all continuous columns bound the candidates, so a column of few values makes no hot cell; a
    real row stands in the cells that its ball touches, distinct rows once. Without continuous columns a tuple counts
    that exactly one real row has."""
    if not continuous:
        once = real.groupBy(*discrete).agg(F.count("*").alias("__n")).where("__n = 1")
        return synth.join(once, [F.equal_null(synth[c], once[c]) for c in discrete], "left_semi").select(key)
    scale = scales(real, continuous)

    def side(df: DataFrame, tag: str, around: bool) -> DataFrame:
        x = [F.col(c).cast("double") / F.lit(s) for c, s in zip(continuous, scale, strict=True)]
        rows = df.select(*([] if around else [key]), *[v.alias(f"{tag}{i}") for i, v in enumerate(x)], *[F.col(c).alias(f"__d{i}") for i, c in enumerate(discrete)])
        if around:
            rows = rows.distinct()
        for i in range(len(continuous)):  # cells are four tolerances wide, so few balls touch two in a column
            at = lambda off, i=i: F.floor((F.col(f"{tag}{i}") + off) / F.lit(4 * tolerance))
            rows = rows.withColumn(f"__c{i}", F.explode(F.array_distinct(F.array(at(-tolerance), at(tolerance)))) if around else at(0.0))
        return rows

    s, r = side(synth, "s", False), side(real, "r", True)
    names = [*[f"__c{i}" for i in range(len(continuous))], *[f"__d{i}" for i in range(len(discrete))]]
    on = [F.equal_null(s[c], r[c]) for c in names]
    gap = reduce(lambda a, b: a + b, [(F.col(f"s{i}") - F.col(f"r{i}")) ** 2 for i in range(len(continuous))])
    return s.join(r, reduce(lambda a, b: a & b, [*on, gap <= tolerance * tolerance]), "left_semi").select(key)


def covered(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """real with covered: whether a synthetic row lies within sqrt(number of columns)."""
    d = nearest(real, synth, columns, scales(real, columns) if columns else None)
    return d.withColumn("covered", F.col("distance") <= math.sqrt(max(1, len(columns)))).drop("distance")


def explored_distance(candidates: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """For each candidate the smallest mean absolute difference to an anchor."""
    return np.abs(candidates[:, None, :] - anchors[None, :, :]).mean(axis=2).min(axis=1)


def smote(minority: DataFrame, columns: list[str], n: int, seed: int, k: int = 5) -> DataFrame:
    """n rows between a minority row (with __rid) and one of its k nearest neighbours. Neighbours are only looked up for
    the rows that are drawn."""
    scale = scales(minority, columns)
    names = [f"__x{i}" for i in range(len(columns))]
    rows = minority.select("__rid", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"__y{i}") for i, c in enumerate(columns)], *_scaled(columns, scale))
    numbered = row_numbers(rows, ["__rid"], "__k")
    size = minority.count()
    if size < 2:
        raise ValueError("SMOTE needs two rows")
    k = min(k, size - 1)
    draws = minority.sparkSession.range(n).select(F.col("id").alias("draw"), rnd.index(size, seed, "row", "id").alias("__k"), rnd.index(k, seed, "neighbour", "id").alias("__j"), rnd.uniform(seed, "mix", "id").alias("__u"))
    picked = draws.join(numbered, "__k")
    asked = picked.select(F.col("__rid").alias("__own"), *names).distinct()
    near = neighbours(asked, rows.select(F.col("__rid").alias("__ref"), *names), names, k, keyed=True).select(F.col("__own").alias("__rid"), "ids")
    told = picked.join(near, "__rid").withColumn("__other", F.get("ids", F.col("__j").cast("int")))
    other = rows.select(F.col("__rid").alias("__other"), *[F.col(f"__y{i}").alias(f"__z{i}") for i in range(len(columns))])
    joined = told.join(other, "__other")
    return joined.select("draw", *[(F.col(f"__y{i}") + F.col("__u") * (F.col(f"__z{i}") - F.col(f"__y{i}"))).alias(c) for i, c in enumerate(columns)])
