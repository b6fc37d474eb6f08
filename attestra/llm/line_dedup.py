"""Operator 5, line dedup: overlapping windows of three lines, the first occurrence of each stays.

A window is three consecutive lines of a text (cut at line feeds) that are not all blank; 128 bits of hash stand for
it. A map-side sum finds the windows that occur twice or more anywhere and the first place of each, the smallest
(doc_id, position). Every line that a later occurrence covers goes.

Defined results: null text is empty; a text of fewer than three lines keeps them all; a null doc_id comes after all
others; of rows that share an id, windows at the same place are one occurrence; an occurrence that overlaps the first
one is a later one too, so a run of one line shrinks to a single one; a text may lose all its lines and is empty then; an
empty table gives no rows; doc_id may be of any type that can be ordered; other columns are kept, one named n_lines or
n_removed is replaced by the result's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.llm.common import beside, hot_keys_join, let, read_table, text_key, written

WINDOW = 3
WORD = "[^ \t-\r]"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _windows(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as (doc_id, key, pos, at, h1, h2), one row for each window; at orders the occurrences."""

    lines = docs.select("doc_id", text_key(F.col("text")).alias("key"), _lines(F.col("text")).alias("l"))
    # plain columns from here on, which run as generated code; past the end there are nulls
    after = [F.slice("l", F.lit(k + 1), F.size("l")).alias(f"l{k}") for k in range(1, WINDOW)]
    placed = lines.where(F.size("l") >= WINDOW).select("doc_id", "key", F.posexplode(F.arrays_zip(F.col("l").alias("l0"), *after)).alias("pos", "w"))
    whole = placed.where(F.col(f"w.l{WINDOW - 1}").isNotNull()).select("doc_id", "key", "pos", F.concat_ws("\n", *[F.col(f"w.l{k}") for k in range(WINDOW)]).alias("w"))
    rows = whole.where(F.col("w").rlike(WORD)).select("doc_id", "key", "pos", F.xxhash64("w").alias("h1"), F.xxhash64(F.lit(WINDOW), "w").alias("h2"))
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):  # as a number, which a map-side sum keeps in place
        at = F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).cast("decimal(20,0)") * F.lit(2**31).cast("decimal(10,0)") + F.col("pos")
    else:
        at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "pos")
    return rows.select("doc_id", "key", "pos", at.alias("at"), "h1", "h2")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with text less the lines of later occurrences, and n_lines and n_removed."""
    return beside(docs, ("doc_id", "text"), _dedup_lines, ("n_lines", "n_removed"))


def _dedup_lines(docs: DataFrame) -> DataFrame:
    windows = _windows(docs)
    repeated = windows.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n >= 2")
    repeated = written(repeated, "line-windows")
    total = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    later = hot_keys_join(windows, repeated, ["h1", "h2"], "n", total).where("at > first")
    gone = later.groupBy("doc_id", "key").agg(F.collect_set("pos").alias("__pos")).withColumnsRenamed({"doc_id": "__id", "key": "__key"})
    joined = docs.join(gone.hint("merge"), docs["doc_id"].eqNullSafe(F.col("__id")) & (text_key(docs["text"]) == F.col("__key")), "left")
    covered = F.array_distinct(F.flatten(F.transform("__pos", lambda p: F.sequence(p, p + WINDOW - 1))))

    def cut(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
        return F.struct(F.size(lines).cast("long").alias("n"), let(kept, lambda k: F.struct(F.size(k).cast("long").alias("n"), F.concat_ws("\n", F.transform(k, lambda i: F.get(lines, i))).alias("text"))).alias("kept"))

    out = joined.withColumn("__cut", F.when(F.col("__pos").isNotNull(), let(_lines(F.col("text")), cut)))
    whole = F.size(_lines(F.col("text"))).cast("long")
    out = out.withColumns({"n_lines": F.coalesce("__cut.n", whole), "n_removed": F.coalesce(F.col("__cut.n") - F.col("__cut.kept.n"), F.lit(0))})
    return out.withColumn("text", F.when(F.col("__cut").isNotNull(), F.col("__cut.kept.text")).otherwise(F.col("text"))).drop("__id", "__key", "__pos", "__cut")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents, how many go, and the digest of what stays."""
    out = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP5_SQL = r"""
with l as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
w as (select doc_id, i, ls[i + 1] || chr(10) || ls[i + 2] || chr(10) || ls[i + 3] as w from l, unnest(range(0, len(ls) - 2)) as t(i)),
n as (select doc_id, i, row_number() over (partition by w order by doc_id, i) as k from w where regexp_matches(w, '[^ \t-\r]')),
gone as (select distinct doc_id, i + d as i from n, unnest(range(0, 3)) as t(d) where k > 1),
lines as (select doc_id, i, ls[i + 1] as line from l, unnest(range(0, len(ls))) as t(i))
select lines.doc_id, count(*) as n_lines, count(gone.i) as n_removed,
  sha256(coalesce(string_agg(line, chr(10) order by lines.i) filter (where gone.i is null), '')) as kept_sha256
from lines left join gone on gone.doc_id = lines.doc_id and gone.i = lines.i group by lines.doc_id
"""
