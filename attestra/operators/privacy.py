"""Distance floor and verbatim guard for synthetic rare rows."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.functions import random as rnd
from attestra.functions.ordered import row_numbers
from attestra.operators.distance import _scaled, closest, nearest_quantiles, neighbours, scales, verbatim
from attestra.operators.ingest import FieldMeta
from attestra.sources.tables import checkpointed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROJECTIONS, RESPAWNS, NUDGE, SLACK = 8, 64, 5e-3, 1e-9
#: Distinct real rows that a task may hold for the floor; beyond that every round is a search of its own.
MOST_REAL = 200_000


@dataclass
class PrivacyReport:
    delta: float
    low: float
    p10: float
    p50: float
    p90: float
    n_projected: int = 0
    n_respawned: int = 0
    n_duplicates: int = 0
    passed: bool = True
    skipped: str | None = None


def continuous_columns(fields: dict[str, FieldMeta], label: str | None = None) -> list[str]:
    return [m.name for m in fields.values() if m.kind == "continuous" and m.name != label and not m.is_identifier]


def _rng(seed: int, rid: int, part: int) -> np.random.Generator:
    return np.random.default_rng([seed & 0xFFFFFFFF, int(rid) & 0xFFFFFFFFFFFF, part])


@dataclass(frozen=True)
class _Box:
    """The real rows' bounds and deviations, the floor, and the seed of its draws."""

    low: np.ndarray
    high: np.ndarray
    scale: np.ndarray
    delta: float
    seed: int

    def pushed(self, x: np.ndarray, near: np.ndarray, rids: np.ndarray, part: int) -> np.ndarray:
        """Rows moved straight away from the nearest real row (near, scaled) to the floor, within the real range; one that
        coincides with it goes along a random axis."""
        away = x / self.scale - near
        size = np.linalg.norm(away, axis=1)
        for i in np.flatnonzero(size < 1e-12):
            rng = _rng(self.seed, rids[i], part)
            away[i], size[i] = 0.0, 1.0
            away[i, rng.integers(x.shape[1])] = rng.choice([-1.0, 1.0])
        return np.clip((near + away / size[:, None] * self.delta * (1 + SLACK)) * self.scale, self.low, self.high)

    def spawned(self, rid: int) -> np.ndarray:
        return _rng(self.seed, rid, PROJECTIONS).uniform(self.low, self.high, size=(RESPAWNS, len(self.low)))


def floor_rows(x: np.ndarray, rids: np.ndarray, scaled: np.ndarray, box: _Box) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, projected, respawned): rows moved until every real row is at least delta deviations away. What eight steps
    do not free starts anew at the first of 64 uniform points that is free, else at the farthest of them."""
    ids = np.arange(len(scaled))

    def look(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dist, found = closest(points / box.scale, scaled, ids, 1)
        return dist[:, 0], found[:, 0]

    x, projected, respawned = x.copy(), np.zeros(len(x), bool), np.zeros(len(x), bool)
    dist, at = look(x)
    for part in range(PROJECTIONS):
        near = np.flatnonzero(dist < box.delta)
        if not len(near):
            break
        x[near] = box.pushed(x[near], scaled[at[near]], rids[near], part)
        projected[near] = True
        dist[near], at[near] = look(x[near])
    for i in np.flatnonzero(dist < box.delta):
        points = box.spawned(rids[i])
        far = look(points)[0]
        free = np.flatnonzero(far >= box.delta)
        x[i], respawned[i] = points[free[0] if len(free) else int(far.argmax())], True
    return x, projected, respawned


def _floored(handed, columns: list[str]):
    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scaled, *box = handed.value
        for pdf in batches:
            x, projected, respawned = floor_rows(pdf[columns].to_numpy(float), pdf["__rid"].to_numpy(), scaled, _Box(*box))
            out = pdf.copy()
            out[columns] = x
            yield out.assign(__projected=projected, __respawned=respawned)

    return move


def _pushed(box: _Box, columns: list[str], part: int):
    def push(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                near = pdf[[f"__n{i}" for i in range(len(columns))]].to_numpy(float)
                out = pdf.copy()
                out[columns] = box.pushed(pdf[columns].to_numpy(float), near, pdf["__rid"].to_numpy(), part)
                yield out

    return push


def _spawned(box: _Box, columns: list[str]):
    def spawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rid in pdf["__rid"]:
                points = pd.DataFrame(box.spawned(rid), columns=columns)
                yield points.assign(__rid=rid, __try=np.arange(len(points)))

    return spawn


def _floor_by_rounds(rows: DataFrame, refs: DataFrame, columns: list[str], box: _Box) -> DataFrame:
    """floor_rows() with more real rows than a task may hold: each round is a search for the rows that are still near."""
    names = [f"__x{i}" for i in range(len(columns))]
    numbered = checkpointed(row_numbers(refs, names, "__ref"))
    at = numbered.select(F.col("__ref").alias("__at"), *[F.col(c).alias(f"__n{i}") for i, c in enumerate(names)])

    def looked(df: DataFrame) -> DataFrame:
        """df with __d and the nearest real row."""
        asked = df.select("*", *_scaled(columns, box.scale.tolist()))
        found = neighbours(asked.select(*names).distinct(), numbered, names, 1, distinct=True).select(*names, F.get("dist", F.lit(0)).alias("__d"), F.get("ids", F.lit(0)).alias("__at"))
        return asked.join(found, names).join(at, "__at").drop("__at", *names)

    state = rows.withColumns({"__projected": F.lit(False), "__respawned": F.lit(False)})
    cols, done = state.columns, None
    for part in range(PROJECTIONS + 1):
        seen = checkpointed(looked(state))
        free = seen.where(F.col("__d") >= box.delta).select(*cols)
        done = free if done is None else done.unionByName(free)
        near = seen.where(F.col("__d") < box.delta)
        if part == PROJECTIONS or near.limit(1).count() == 0:
            break
        state = near.mapInPandas(_pushed(box, columns, part), near.schema).select(*cols).withColumn("__projected", F.lit(True))
    if near.limit(1).count() == 0:
        return done
    typed = ", ".join([*[f"`{c}` double" for c in columns], "__rid bigint", "__try bigint"])
    tries = looked(near.select(F.col("__rid").cast("long").alias("__rid")).mapInPandas(_spawned(box, columns), typed))
    order = F.struct((F.col("__d") < box.delta).alias("near"), F.when(F.col("__d") < box.delta, -F.col("__d")).otherwise(F.lit(0.0)).alias("far"), "__try")
    best = tries.groupBy("__rid").agg(F.min_by(F.struct(*columns), order).alias("__b"))
    moved = near.select(*[c for c in cols if c not in columns]).join(best, "__rid").withColumn("__respawned", F.lit(True))
    return done.unionByName(moved.select(*[F.col(f"__b.{c}").alias(c) if c in columns else F.col(c) for c in cols]))


def enforce_distance_floor(synth: DataFrame, real: DataFrame, columns: list[str], delta: float, seed: int) -> tuple[DataFrame, PrivacyReport]:
    """synth (with __rid) moved to the floor, and the report on the final rows. Rows do not depend on each other, so one pass
    with the distinct real rows at hand does it, or rounds of searches where these are too many."""
    if not columns or real.limit(1).count() == 0 or synth.limit(1).count() == 0:
        return synth, PrivacyReport(delta, math.inf, math.inf, math.inf, math.inf, skipped="no continuous columns or rows")
    scale = scales(real, columns)
    bounds = real.agg(*[f(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"{t}{i}") for i, c in enumerate(columns) for t, f in (("l", F.min), ("h", F.max))]).first()
    low, high = (np.array([bounds[f"{t}{i}"] for i in range(len(columns))]) for t in "lh")
    refs = real.select(*_scaled(columns, scale)).distinct()
    typed = synth.withColumns({c: F.col(c).cast("double") for c in columns})
    if refs.count() <= MOST_REAL:
        scaled = np.array([tuple(r) for r in refs.orderBy(*refs.columns).collect()], dtype=float)
        handed = synth.sparkSession.sparkContext.broadcast((scaled, low, high, np.array(scale), delta, seed))
        schema = typed.withColumn("__projected", F.lit(True)).withColumn("__respawned", F.lit(True)).schema
        moved = typed.mapInPandas(_floored(handed, columns), schema).cache()
    else:
        moved = checkpointed(_floor_by_rounds(typed, refs, columns, _Box(low, high, np.array(scale), delta, seed)))
    p, r = moved.agg(F.count_if("__projected"), F.count_if("__respawned")).first()
    out = moved.drop("__projected", "__respawned")
    q = nearest_quantiles(out, real, columns).first()
    return out, PrivacyReport(delta, q["low"], q["p10"], q["p50"], q["p90"], p, r, passed=q["low"] >= delta - SLACK)


def guard_duplicates(synth: DataFrame, real: DataFrame, continuous: list[str], discrete: list[str], seed: int) -> tuple[DataFrame, int]:
    """synth with near-verbatim rows nudged by small noise, and their number; rows without continuous columns are counted
    and stay."""
    hits = verbatim(synth, real, continuous, discrete).distinct().cache()
    n = hits.count()
    if not continuous or not n:
        return synth, n
    scale = scales(real, continuous)
    marked = synth.join(hits.withColumn("__hit", F.lit(True)), "__rid", "left")
    nudged = {c: F.when(F.col("__hit"), F.col(c) + NUDGE * s * rnd.normal(seed, f"nudge/{c}", "__rid")).otherwise(F.col(c)) for c, s in zip(continuous, scale, strict=True)}
    return marked.withColumns(nudged).drop("__hit"), n


def count_duplicates(synth: DataFrame, real: DataFrame, continuous: list[str], discrete: list[str]) -> int:
    return verbatim(synth, real, continuous, discrete).distinct().count()


def assess(synth: DataFrame, real: DataFrame, continuous: list[str], discrete: list[str], delta: float = 0.0) -> PrivacyReport:
    """Distances of delivered rare rows to real ones, and how many are verbatim."""
    n = count_duplicates(synth, real, continuous, discrete) if continuous or discrete else 0
    if not continuous:
        return PrivacyReport(delta, math.inf, math.inf, math.inf, math.inf, n_duplicates=n, passed=n == 0)
    q = nearest_quantiles(synth, real, continuous).first()
    return PrivacyReport(delta, q["low"], q["p10"], q["p50"], q["p90"], n_duplicates=n, passed=q["low"] >= delta - SLACK and n == 0)


def floor_delivered(batch: DataFrame, real: DataFrame, fields: dict[str, FieldMeta], label: str | None, delta: float, seed: int) -> tuple[DataFrame, PrivacyReport]:
    """The floor on a batch's rare rows (part = 'rare'), wider by what rounding whole columns may undo; they are rounded
    again after it."""
    columns = continuous_columns(fields, label)
    why = "no_label" if label is None else "no_continuous_features" if not columns else "no_rare_rows" if batch.where("part = 'rare'").limit(1).count() == 0 else None
    if why:
        return batch, PrivacyReport(delta, math.inf, math.inf, math.inf, math.inf, skipped=why)
    scale = dict(zip(columns, scales(real, columns), strict=True))
    whole = [c for c in columns if fields[c].is_integer]
    wide = delta + math.sqrt(sum((0.5 / scale[c]) ** 2 for c in whole))
    moved, report = enforce_distance_floor(batch.where("part = 'rare'"), real, columns, wide, seed)
    if whole:
        moved = moved.withColumns({c: F.rint(c) for c in whole})
        q = nearest_quantiles(moved, real, columns).first()
        report.low, report.p10, report.p50, report.p90 = q["low"], q["p10"], q["p50"], q["p90"]
    report.delta, report.passed = delta, report.low >= delta - SLACK
    rest = batch.where("part <> 'rare'").withColumns({c: F.col(c).cast("double") for c in columns})
    return rest.unionByName(moved.select(rest.columns)), report
