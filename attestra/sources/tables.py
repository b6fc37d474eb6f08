"""Reading and writing flat tables, batches and reports."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import random as rnd

DELIMITERS = ",;\t|"
SNIFF_BYTES = 16 << 10


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


_own: list[str] = []


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the folder that spark.checkpoint.dir names: lineage ends there. A folder of our own only
    where that is unset and driver and executors are one process. The table goes when the program ends."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is unset; on a cluster it must name a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="attestra-"))
        folder = f"file://{_own[0]}"
    path = f"{folder.rstrip('/')}/attestra/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def sniff_delimiter(sample: str) -> str:
    """The delimiter of a CSV sample; where that can't be told, the commonest candidate of the header, else a comma."""
    try:
        return csv.Sniffer().sniff(sample, delimiters=DELIMITERS).delimiter
    except csv.Error:
        head = sample.split("\n", 1)[0]
        best = max(DELIMITERS, key=head.count)
        return best if head.count(best) else ","


def read_csv(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    if sep is None:
        lines = [r[0] for r in spark.read.text(path).limit(200).collect()]
        sep = sniff_delimiter("\n".join(lines)[:SNIFF_BYTES])
    return spark.read.csv(path, sep=sep, header=True, inferSchema=True)


def load(spark: SparkSession, path: str) -> DataFrame:
    """A table by its suffix: json and jsonl (lines, or one array), parquet and pq, else CSV with a sniffed delimiter."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    suffix = Path(path).suffix.lower()
    if suffix == ".jsonl":
        return spark.read.json(path)
    if suffix == ".json":
        first = spark.read.text(path).where(F.length(F.trim("value")) > 0).limit(1).collect()
        return spark.read.json(path, multiLine=bool(first) and first[0][0].lstrip().startswith("["))
    if suffix in (".parquet", ".pq"):
        return spark.read.parquet(path)
    return read_csv(spark, path)


def load_for_certify(spark: SparkSession, path: str) -> DataFrame:
    """Parquet by suffix, else comma-separated CSV."""
    return spark.read.parquet(path) if path.endswith(".parquet") else read_csv(spark, path, ",")


def write_batch(df: DataFrame, path: str) -> str:
    """df as Parquet, by a partition column `part` where it has one."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy("part") if "part" in df.columns else writer).parquet(path)
    return path


def persist_ingest(df: DataFrame, fields: list[dict], base: str) -> None:
    """A flagged table partitioned by __rare, and its field profile as JSON lines."""
    df.write.mode("overwrite").partitionBy("__rare").parquet(f"{base}.rows.parquet")
    spark = df.sparkSession
    spark.createDataFrame([(json.dumps(f, default=str),) for f in fields], "value string").coalesce(1).write.mode("overwrite").text(f"{base}.fields.jsonl")


def _found(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match pattern, in whatever store Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return [x.getPath().toString() for x in p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []]


def load_results(run_dir: str, spark: SparkSession | None = None) -> dict:
    """The campaign summary of a run, or what its batches show. Listed and read through Spark, so runs may lie in any
    store."""
    spark = spark or SparkSession.builder.getOrCreate()
    summary = _found(spark, f"{run_dir}/campaign_summary.json")
    if summary:
        return json.loads(spark.read.text(summary[0], wholetext=True).first()[0])
    batches = sorted(_found(spark, f"{run_dir}/pass_*_accepted.parquet"), key=_pass_number)
    if not batches:
        raise FileNotFoundError(f"no results in {run_dir}")
    return {"passes": [{"pass": _pass_number(b), "path": b} for b in batches], "best_batch_path": batches[-1]}


def _pass_number(path: str) -> int:
    return int(path.rsplit("/", 1)[-1].split("_")[1])


def load_synthetic(spark: SparkSession, run_dir: str) -> DataFrame:
    """The best batch of a run, else the one of the highest pass number."""
    found = load_results(run_dir, spark)
    path = found.get("best_batch_path") or found["passes"][-1]["path"]
    return spark.read.parquet(path)


def preview(df: DataFrame, n: int, key: str = "__rid") -> DataFrame:
    return (df.orderBy(key) if key in df.columns else df).limit(n)


def canonical_hash(df: DataFrame) -> str:
    """A digest of the rows that does not depend on their order, partitioning or file format: count and two sums of
    hashes over all columns."""
    cols = sorted(df.columns)
    h = [F.xxhash64(F.lit(k), *[F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in cols]) for k in (1, 2)]
    n, a, b = df.agg(F.count("*"), *[F.sum(x.cast("decimal(38,0)")) for x in h]).first()
    return hashlib.sha256(json.dumps([cols, n, str(a), str(b)]).encode()).hexdigest()


def to_csv_text(df: DataFrame, most: int = 100_000) -> str:
    """A small table as CSV for download; larger ones are refused rather than cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write a file instead")
    out = io.StringIO()
    w = csv.writer(out)
    w.writerow(df.columns)
    w.writerows(rows)
    return out.getvalue()


def fraud_sample(spark: SparkSession, n: int = 2000, rate: float = 0.03, seed: int = 7) -> DataFrame:
    """Transactions with a rare fraudulent class: amount, n_prior_txns, hour, merchant_risk, is_fraud."""
    base = spark.range(n).withColumnRenamed("id", "__rid")
    rare = F.col("__rid") < max(1, round(n * rate))

    def gauss(stream: str) -> Column:
        return rnd.normal(seed, stream, "__rid")

    amount = F.exp(F.when(rare, 5.5 + 0.8 * gauss("amount")).otherwise(3.5 + gauss("amount")))
    prior = F.greatest(F.lit(0.0), F.rint(F.when(rare, 3 + 1.7 * gauss("prior")).otherwise(12 + 3.5 * gauss("prior"))))
    hour = F.pmod(F.when(rare, 2 + 2 * gauss("hour")).otherwise(14 + 4 * gauss("hour")), F.lit(24.0))
    risk = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(rare, 0.7 + 0.15 * gauss("risk")).otherwise(0.3 + 0.15 * gauss("risk"))))
    rows = base.select("__rid", F.round(amount, 2).alias("amount"), prior.alias("n_prior_txns"), F.round(hour, 2).alias("hour"), F.round(risk, 4).alias("merchant_risk"), rare.cast("int").alias("is_fraud"))
    return rows.orderBy(rnd.order_key(seed, "__rid")).drop("__rid")


def credit_features(raw: DataFrame, limit: str, bill: str, columns: dict[str, str]) -> DataFrame:
    """Derived credit columns: log_limit, the log of the limit (at least 1), and utilization, bill over limit within
    [-1, 3], both to four places; columns renames the others."""
    ratio = F.try_divide(F.col(bill).cast("double"), F.col(limit).cast("double"))
    return raw.select(*[F.col(a).alias(b) for a, b in columns.items()], F.round(F.log(F.greatest(F.col(limit).cast("double"), F.lit(1.0))), 4).alias("log_limit"), F.round(F.least(F.lit(3.0), F.greatest(F.lit(-1.0), ratio)), 4).alias("utilization"))
