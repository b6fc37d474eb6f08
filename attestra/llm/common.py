"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of a word: space, and tab to carriage return.
SPACE = " \t-\r"


def ship(module: str) -> None:
    """Functions of this module go to the executors with their code, which then need no copy of the library."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


def held(handed, kind, key: str = "content"):
    """kind(content) of a broadcast {key: content}, built once in a worker for all its tasks: the broadcast's value
    stays there. What is handed on is plain, so workers need no class to read it."""
    value = handed.value
    if kind.__name__ not in value:
        value[kind.__name__] = kind(value[key])
    return value[kind.__name__]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: list[str] = []
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. Where that is unset: a folder of our
    own until the program ends if driver and executors are one process, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is unset; on a cluster it must name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="attestra-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, its size is known to the optimizer, and
    no executor has to survive for it to be read again. It goes when the program ends, or with settled()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/attestra/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    system, at = _file_system(spark, path)
    system.deleteOnExit(at)
    for paths in _open:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> tuple[DataFrame, str]:
    """make() as a written table, and its path; other tables that were written on the way are deleted."""
    paths: list[str] = []
    _open.append(paths)
    try:
        out = written(make(), label)
    finally:
        _open.remove(paths)
    for path in paths[:-1]:
        delete(spark, path)
    return out, paths[-1]


def delete(spark: SparkSession, path: str) -> None:
    system, at = _file_system(spark, path)
    system.delete(at, True)


def beside(docs: DataFrame, own: tuple[str, ...], operate: Callable[[DataFrame], DataFrame], added: tuple[str, ...] = ()) -> DataFrame:
    """operate on docs' own columns, with the others packed away so that no name clashes. docs' columns come back in their
    order, then the added ones, which replace columns of these names."""
    rest = [c for c in docs.columns if c not in own]
    packed = docs.select(*own, F.struct(*([F.col(f"`{c}`") for c in rest] or [F.lit(0).alias("none")])).alias("__rest"))
    out = operate(packed)
    kept = [F.col(c) if c in own else F.col("__rest")[c].alias(c) for c in docs.columns if c not in added]
    return out.select(*kept, *added)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Maximal runs of characters other than SPACE, as an array; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def text_key(text: Column) -> Column:
    """Tells texts of rows with the same id apart; null and empty alike."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def running(steps: Column, most: bool = False) -> Column:
    """Running sums, or with most running maxima, of an array of numbers, by doubling: round k takes in what stands 2**k
    places before."""

    def summed(whole: Column) -> Column:
        def add(acc: Column, k: Column) -> Column:
            gap = F.call_function("shiftleft", F.lit(1), k)
            if most:
                return F.transform(acc, lambda x, i: F.greatest(x, F.when(i >= gap, F.get(acc, i - gap))))
            return F.transform(acc, lambda x, i: x + F.when(i >= gap, F.get(acc, i - gap)).otherwise(0))

        rounds = F.filter(F.sequence(F.lit(0), F.lit(30)), lambda k: F.call_function("shiftleft", F.lit(1), k) < F.size(whole))
        return F.aggregate(rounds, whole, add)

    return let(steps, summed)


def spans(text: Column, pattern: str) -> Column:
    """Every leftmost non-overlapping match of pattern: array<struct<start,end,match>> in code points, end
    exclusive. What split() cuts out is what regexp_extract_all() finds, so running lengths give the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kind = "array<struct<start:int,end:int,match:string>>"

    def placed(hit: Column) -> Column:
        gaps = F.slice(F.transform(F.split(text, pattern, -1), F.length), F.lit(1), F.size(hit))
        ends = running(F.zip_with(hit, gaps, lambda m, g: g + F.length(m)))
        return F.zip_with(hit, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("match")))

    return let(found, lambda hit: F.when(F.size(hit) > 0, placed(hit)).otherwise(F.array().cast(kind)))


#: Code points of a piece of a text, see chunks().
CHUNK = 256


def chunks(text: Column) -> Column:
    """A text in pieces of CHUNK code points, so that a part of it is found without a walk from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def part(pieces: Column, start: Column, end: Column) -> Column:
    """Code points start to end, exclusive, of the text whose chunks() are pieces."""
    low = F.call_function("div", start, F.lit(CHUNK)).cast("int")
    n = F.call_function("div", end, F.lit(CHUNK)).cast("int") - low + 1
    return F.substring(F.concat_ws("", F.slice(pieces, low + 1, n)), start % CHUNK + 1, F.greatest(end - start, F.lit(0)))


def hot_keys_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner", share: int = 1000) -> DataFrame:
    """left joined with right, which has one row for each key and, in weight, the number of left's rows with it.
    Keys with at least total/share of left's rows are joined by broadcast: there are at most share of them,
    whatever the input's size. The others have few rows each and are shuffled. how: inner or left."""
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    floor = max(1, total // share)
    hot = right.where(F.col(weight) >= floor).drop(weight)
    cold = right.where(F.col(weight) < floor).drop(weight)
    names = hot.select(*keys, F.lit(True).alias("__hot"))
    tagged = left.join(F.broadcast(names), keys, "left")
    in_hot = tagged.where("__hot").drop("__hot").join(F.broadcast(hot), keys, "inner")
    rest = tagged.where("__hot is null").drop("__hot").join(cold, keys, how)
    return in_hot.unionByName(rest)
