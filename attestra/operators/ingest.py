"""From a flat table to a flagged one: target detection, imputation, rare class, field profile, preflight."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.functions.ordered import quantiles, row_numbers


class IngestError(ValueError):
    """A table that can't be used, with the reason."""


@dataclass(frozen=True)
class IngestConfig:
    percentile: float = 0.05
    min_rare: int = 10
    max_cardinality: int = 20
    max_ratio: float = 0.35
    saturation: int = 50
    ambiguity: float = 0.05


#: Column names that suggest a label, as the reference has them.
LABEL_NAMES = ("label", "target", "y", "is_fraud", "fraud", "class")


@dataclass(frozen=True)
class RareEvent:
    """Which rows are rare. mode label: column equals value (the least frequent where None); percentile: a tail of a
    numeric column; imbalance: all values whose share is at most ratio."""

    column: str
    mode: str = "label"
    value: object = None
    percentile: float = 0.05
    upper: bool = True
    ratio: float = 0.01


@dataclass
class FieldMeta:
    name: str
    kind: str  # continuous, categorical or binary
    cardinality: int
    n: int
    is_integer: bool = False
    is_identifier: bool = False
    low: float | None = None
    high: float | None = None
    categories: list = field(default_factory=list)
    numeric_values: list = field(default_factory=list)

    def to_dict(self) -> dict:
        return asdict(self)


NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, NUMERIC)


def with_row_id(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """df with __rid, consecutive from 0 by order (all columns by default)."""
    return df if "__rid" in df.columns else row_numbers(df, order or df.columns, "__rid")


# -- targets -----------------------------------------------------------------------------------------------------

def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n): counts of every value of the columns, in one aggregate."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))


def minority_value(df: DataFrame, c: str) -> DataFrame:
    """(value, n, ratio): the least frequent value, ties to the smallest; ratio is its share of the non-null rows."""
    counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n"))
    return counts.agg(F.min_by("value", F.struct("n", "value")).alias("value"), F.min("n").alias("n"), F.sum("n").alias("total")).select("value", "n", (F.col("n") / F.col("total")).alias("ratio"))


def target_scores(df: DataFrame, cfg: IngestConfig = IngestConfig(), columns: list[str] | None = None) -> DataFrame:
    """(column, cardinality, n_rare, ratio, score) of every column that could be a label."""
    columns = columns or [c for c in df.columns if c != "__rid"]
    n_rows = F.sum("n").over(_by_column())
    counts = value_counts(df, columns).withColumn("all", n_rows).where("value is not null")
    facts = counts.groupBy("column").agg(F.count("*").alias("cardinality"), F.min("n").alias("n_rare"), F.first("all").alias("all"))
    ratio = F.col("n_rare") / F.col("all")
    named = F.lower("column").isin(*LABEL_NAMES)
    few = F.when(F.col("cardinality") == 2, 1.0).otherwise(1.0 / (F.col("cardinality") - 1))
    score = 0.5 * (1 - ratio / cfg.max_ratio) + 0.25 * few + 0.25 * F.least(F.lit(1.0), F.col("n_rare") / cfg.saturation) + F.when(named, 0.15).otherwise(0.0)
    able = F.col("cardinality").between(2, cfg.max_cardinality) & (F.col("n_rare") >= cfg.min_rare) & (ratio <= cfg.max_ratio)
    return facts.where(able).select("column", "cardinality", "n_rare", ratio.alias("ratio"), score.alias("score"))


def _by_column():
    from pyspark.sql import Window

    return Window.partitionBy("column")


def target_choice(df: DataFrame, cfg: IngestConfig = IngestConfig(), columns: list[str] | None = None) -> tuple[str | None, list]:
    """The best label column, None where there is none or where the two best are within cfg.ambiguity of each other, and
    the four best rows of target_scores()."""
    best = target_scores(df, cfg, columns).orderBy(F.desc("score"), "column").limit(4).collect()
    clear = len(best) == 1 or len(best) > 1 and best[0]["score"] - best[1]["score"] >= cfg.ambiguity
    return (best[0]["column"] if clear else None), best


def detect_target(df: DataFrame, cfg: IngestConfig = IngestConfig()) -> str:
    """The best label column. Two best within cfg.ambiguity of each other, or none at all, raise IngestError."""
    found, best = target_choice(df, cfg)
    if not best:
        reasons = "; ".join(f"{r['column']}: {r['reason']}" for r in diagnose_targets(df, cfg).limit(8).collect())
        raise IngestError(f"no label column found ({reasons or 'no column of few values'}); name one")
    if found is None:
        raise IngestError("several columns could be the label: " + ", ".join(f"{r['column']} ({r['score']:.3f})" for r in best) + "; name one")
    return found


def diagnose_targets(df: DataFrame, cfg: IngestConfig = IngestConfig()) -> DataFrame:
    """(column, reason): why columns of few values are no label."""
    counts = value_counts(df, [c for c in df.columns if c != "__rid"]).where("value is not null")
    facts = counts.groupBy("column").agg(F.count("*").alias("k"), F.min("n").alias("low"), F.sum("n").alias("all")).where(F.col("k") <= cfg.max_cardinality)
    reason = (F.when(F.col("k") < 2, F.lit("one value only"))
              .when(F.col("low") < cfg.min_rare, F.concat(F.lit("rarest value in "), F.col("low").cast("string"), F.lit(f" rows, {cfg.min_rare} needed")))
              .when(F.col("low") / F.col("all") > cfg.max_ratio, F.lit("no value is rare")))
    return facts.select("column", reason.alias("reason")).where("reason is not null").orderBy("column")


# -- cleaning ----------------------------------------------------------------------------------------------------

def fill_values(df: DataFrame, label: str | None = None) -> DataFrame:
    """One row: for each column the value that stands for null (median of numbers, mode of others, smallest on ties)."""
    cols = [c for c in df.columns if c not in (label, "__rid")]
    return df.agg(*[(F.percentile(F.col(c).cast("double"), F.lit(0.5)) if is_numeric(df, c) else F.mode(F.col(c), True)).alias(c) for c in cols])


def impute(df: DataFrame, label: str | None = None) -> DataFrame:
    """df without rows of null label, nulls filled: medians by refinement over the table, modes by counts. A column
    that is null throughout raises IngestError."""
    if label is not None:
        df = df.dropna(subset=[label])
    cols = [c for c in df.columns if c not in (label, "__rid")]
    filled = df.agg(*[F.count(c).alias(c) for c in cols], F.count("*").alias("__n")).first()
    empty = [c for c in cols if filled[c] == 0]
    if filled["__n"] and empty:
        raise IngestError(f"no values in {', '.join(empty)}")
    fills = {}
    for c in cols:
        if filled[c] < filled["__n"]:
            if is_numeric(df, c):
                fills[c] = F.coalesce(F.col(c).cast("double"), F.lit(quantiles(df, c, [0.5])[0]))
            else:
                counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("__k"))
                top = counts.agg(F.min_by(c, F.struct(-F.col("__k"), F.col(c)))).first()[0]
                fills[c] = F.coalesce(F.col(c), F.lit("UNKNOWN" if top is None else top))
    return df.withColumns(fills) if fills else df


def rare_predicate(df: DataFrame, rare: RareEvent) -> Column:
    """The boolean column that a rare event of mode label or percentile describes, from aggregates over df."""
    c = F.col(rare.column)
    if rare.mode == "label":
        value = rare.value if rare.value is not None else minority_value(df, rare.column).first()["value"]
        return F.coalesce(c == F.lit(value), F.lit(False))
    if rare.mode == "percentile":
        if not is_numeric(df, rare.column):
            raise IngestError(f"{rare.column} is not numeric")
        cut = quantiles(df, rare.column, [1 - rare.percentile if rare.upper else rare.percentile])[0]
        return F.coalesce(c >= cut if rare.upper else c <= cut, F.lit(False))
    raise IngestError(f"unknown mode {rare.mode}")


def with_rare(df: DataFrame, rare: RareEvent, name: str = "__rare") -> DataFrame:
    """df with the boolean column that rare describes. The values of a small share are joined, however many they are."""
    if rare.mode != "imbalance":
        return df.withColumn(name, rare_predicate(df, rare))
    counts = df.where(F.col(rare.column).isNotNull()).groupBy(F.col(rare.column).alias("__v")).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    values = counts.where(F.col("__n") <= rare.ratio * total).select("__v")
    if values.limit(1).count() == 0:
        raise IngestError(f"no value of {rare.column} has a share of {rare.ratio} or less")
    joined = df.join(values, df[rare.column] == F.col("__v"), "left")
    return joined.withColumn(name, F.col("__v").isNotNull()).drop("__v")


def flag_rare(df: DataFrame, rare: RareEvent, cfg: IngestConfig = IngestConfig()) -> DataFrame:
    """df with __rare. Fewer than cfg.min_rare rare rows, or no others, raise IngestError."""
    out = with_rare(df, rare)
    n, k = out.agg(F.count("*"), F.count_if("__rare")).first()
    if k < cfg.min_rare or k == n:
        raise IngestError(f"{k} rare rows of {n}; at least {cfg.min_rare} and one other are needed")
    return out


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as doubles, what is no number null, rows with a null left out. A column without numbers raises."""
    out = df.select(*[F.expr(f"try_cast(`{c}` as double)").alias(c) for c in columns])
    seen = out.agg(*[F.count(c).alias(c) for c in columns]).first()
    if bad := [c for c in columns if not seen[c]]:
        raise IngestError(f"no numbers in {', '.join(bad)}")
    return out.dropna()


def trim_upper(df: DataFrame, c: str, p: float = 0.995) -> DataFrame:
    return df.where(F.col(c) <= quantiles(df, c, [p])[0])


def last_rows(df: DataFrame, n: int, key: str = "__rid") -> DataFrame:
    """The n rows of largest key, a bounded sample by order."""
    return df.orderBy(F.desc(key)).limit(n)


def exact_sample(df: DataFrame, n: int, seed: int, key: str = "__rid") -> DataFrame:
    """n rows without replacement, the same for any partitioning."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


# -- profile -----------------------------------------------------------------------------------------------------

def profile_frame(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n, cardinality, low, high, integral, identifier): the profile as a table, in one aggregate; low and high
    are null for what is not numeric."""
    columns = columns or [c for c in df.columns if not c.startswith("__")]
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(columns):
        aggs.append(F.count_distinct(c).alias(f"d{i}"))
        if is_numeric(df, c):
            x = F.col(c).cast("double")
            aggs += [F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}"), F.bool_and(x == F.floor(x)).alias(f"i{i}")]
    one = df.agg(*aggs)
    rows = []
    for i, c in enumerate(columns):
        num = is_numeric(df, c)
        low, high, whole = (F.col(f"l{i}"), F.col(f"h{i}"), F.coalesce(F.col(f"i{i}"), F.lit(False))) if num else (F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(False))
        idlike = F.lit(bool(c.lower() == "id" or c.lower().endswith(("_id", "id_", "key", "uuid")) or c.lower().startswith("id_")))
        unique = (F.col("n") >= 20) & (F.col(f"d{i}") >= 0.99 * F.col("n")) & (whole | idlike | F.lit(not num))
        rows.append(F.struct(F.lit(c).alias("column"), F.col("n"), F.col(f"d{i}").alias("cardinality"), low.alias("low"), high.alias("high"), whole.alias("integral"), unique.alias("identifier")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


#: Categories that the driver may hold for one column.
MOST_CATEGORIES = 100_000


def field_profile(df: DataFrame, columns: list[str] | None = None) -> dict[str, FieldMeta]:
    """column -> FieldMeta. A numeric column of two values is binary, other numbers continuous, the rest categorical;
    times and nested types are refused."""
    columns = columns or [c for c in df.columns if not c.startswith("__")]
    for c in columns:
        if not isinstance(df.schema[c].dataType, (*NUMERIC, T.StringType, T.BooleanType)):
            raise IngestError(f"{c}: {df.schema[c].dataType.simpleString()} is not supported")
    out = {}
    for r in profile_frame(df, columns).collect():
        c = r["column"]
        numeric = is_numeric(df, c)
        boolean = isinstance(df.schema[c].dataType, T.BooleanType)
        kind = "binary" if boolean or (numeric and r["cardinality"] == 2) else "continuous" if numeric else "categorical"
        meta = FieldMeta(c, kind, r["cardinality"], r["n"], bool(r["integral"]), bool(r["identifier"]), r["low"], r["high"])
        if kind == "categorical" and not meta.is_identifier:
            if meta.cardinality > MOST_CATEGORIES:
                raise IngestError(f"{c} has {meta.cardinality} categories")
            meta.categories = sorted(x[0] for x in df.select(c).where(F.col(c).isNotNull()).distinct().collect())
        elif kind == "binary":
            meta.numeric_values = [r["low"], r["high"]] if numeric else [False, True]
        out[c] = meta
    return out


def encode_categories(df: DataFrame, fields: dict[str, FieldMeta]) -> DataFrame:
    """Features as doubles: categories by their place in the sorted list, -1 if unknown; booleans as 0 and 1."""
    def code(m: FieldMeta) -> Column:
        if m.kind == "categorical":
            place = F.array_position(F.array(*[F.lit(v) for v in m.categories]) if m.categories else F.array().cast("array<string>"), F.col(m.name))
            return (F.coalesce(place, F.lit(0)) - 1).cast("double")
        return F.col(m.name).cast("double")

    return df.select(*[c for c in df.columns if c not in fields], *[code(m).alias(m.name) for m in fields.values()])


def decode_categories(df: DataFrame, fields: dict[str, FieldMeta]) -> DataFrame:
    """Codes back to categories: rounded half to even, held within the list."""
    out = df
    for m in fields.values():
        if m.kind == "categorical" and m.categories and m.name in df.columns:
            place = F.greatest(F.lit(0), F.least(F.lit(len(m.categories) - 1), F.rint(m.name).cast("int")))
            out = out.withColumn(m.name, F.element_at(F.array(*[F.lit(v) for v in m.categories]), place + 1))
    return out


def column_profiles(df: DataFrame, fields: dict[str, FieldMeta], n_samples: int = 5) -> DataFrame:
    """(column, cardinality, unique_ratio, minority_ratio, samples): samples are the first distinct values by __rid."""
    counts = value_counts(df, list(fields)).where("value is not null")
    firsts = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in fields])).alias("p"), "__rid").groupBy("p.column", "p.value").agg(F.min("__rid").alias("at"))
    from pyspark.sql import Window

    top = firsts.where("value is not null").withColumn("k", F.row_number().over(Window.partitionBy("column").orderBy("at"))).where(F.col("k") <= n_samples)
    samples = top.groupBy("column").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]).alias("samples"))
    facts = counts.groupBy("column").agg(F.count("*").alias("cardinality"), F.sum("n").alias("all"), F.min("n").alias("low"))
    return facts.join(samples, "column").select("column", "cardinality", (F.col("cardinality") / F.col("all")).alias("unique_ratio"), (F.col("low") / F.col("all")).alias("minority_ratio"), "samples")


# -- preflight ---------------------------------------------------------------------------------------------------

def preflight(df: DataFrame, label: str, rare: RareEvent | None = None) -> list[dict]:
    """Findings (level, code, column) about a table, before anything is run: unsupported or warn."""
    found: list[dict] = []

    def say(level: str, code: str, column: str | None = None) -> None:
        found.append({"level": level, "code": code, "column": column})

    temporal = [c for c in df.columns if isinstance(df.schema[c].dataType, (T.TimestampType, T.DateType, T.TimestampNTZType)) or any(w in c.lower().split("_") for w in ("timestamp", "datetime", "date", "time"))]
    for c in temporal:
        say("unsupported", "temporal", c)
    features = [c for c in df.columns if c not in (label, "__rid", *temporal)]
    facts = {r["column"]: r for r in profile_frame(df, features).collect()} if features else {}
    n, k = with_rare(df, rare or RareEvent(label)).agg(F.count("*"), F.count_if("__rare")).first()
    if k < 10:
        say("unsupported", "rare_rows")
    elif k < 14:
        say("warn", "rare_rows")
    strings = [c for c in features if isinstance(df.schema[c].dataType, T.StringType)]
    long_text = df.agg(*[F.avg(F.length(c)).alias(c) for c in strings]).first() if strings else {}
    continuous = [c for c in features if is_numeric(df, c) and facts[c]["cardinality"] > 2]
    if not continuous:
        say("warn", "no_continuous")
    for c in features:
        d = facts[c]["cardinality"]
        if d <= 1:
            say("warn", "constant", c)
        elif is_numeric(df, c) and facts[c]["integral"] and 2 < d <= 8:
            say("warn", "few_integers", c)
        elif c in strings and (long_text[c] or 0) > 40:
            say("unsupported", "free_text", c)
        elif c in strings and d > 50:
            say("warn", "many_categories", c)
    if len(features) > k:
        say("warn", "more_features_than_rare_rows")
    return found
