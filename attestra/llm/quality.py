"""Operator 7, quality rules: hashed n-gram log-likelihood ratio against trusted documents, and two base rules.

Words and word pairs fall by hash into `buckets` buckets. Two multinomials over the buckets, both with add-one
smoothing, are counted: one over all documents, one over a trusted sample, which is at most `trusted` documents
labelled as good and not as toxic (those with the smallest hash of their id). A document's score is the mean over its n-grams of the log
ratio of trusted to raw, in whole millionths so that sums are exact; scores under `threshold` are rejected.

Defined results: null text has no words, fails the base rules and scores 0; a document without labels counts in the
raw corpus only; with no trusted document all scores are 0; rows that share a trusted id are all trusted; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.common import SPACE, let, read_table, words

BUCKETS, TRUSTED, THRESHOLD = 10_000, 20_000, -0.15
MILLION = 1_000_000
MIN_WORDS, MOST_REPEATED = 10, 20
REPEAT = 5


def _bucket(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    """At most `most` ids of documents with quality 1 that are not toxic: those whose hash is smallest."""
    clean = F.coalesce(F.col("toxic"), F.lit(0)) == 0 if "toxic" in labels.columns else F.lit(True)
    good = labels.where(clean).where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def bucket_counts(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, good): n-grams of all documents and of the trusted ones. trusted is bounded, see trusted_ids()."""
    marked = docs.select("doc_id", words(F.col("text")).alias("w")).join(F.broadcast(trusted.select("doc_id", F.lit(1).alias("good"))), "doc_id", "left")
    pairs = F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b"))
    rows = marked.select(F.coalesce("good", F.lit(0)).alias("good"), F.inline(pairs).alias("a", "b"))
    one = F.xxhash64("a")
    grams = rows.select("good", F.explode(F.array(_bucket(one, buckets), F.when(F.col("b").isNotNull(), _bucket(F.xxhash64(one, F.xxhash64("b")), buckets)))).alias("bucket"))
    return grams.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").cast("long").alias("good"))


def weights(counts: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The log ratio of each bucket in millionths. The driver gets one row a bucket."""
    raw, good = [0] * buckets, [0] * buckets
    for b, r, g in counts.select("bucket", "raw", "good").collect():
        raw[b], good[b] = r, g
    all_raw, all_good = sum(raw) + buckets, sum(good) + buckets
    if all_good == buckets:
        return [0] * buckets
    return [round(MILLION * (math.log((g + 1) / all_good) - math.log((r + 1) / all_raw))) for r, g in zip(raw, good, strict=True)]


def _repeat_words(hashes: Column) -> Column:
    """Words that lie in windows of REPEAT words found twice or more in the text."""

    def covered(windows: Column) -> Column:
        ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            def again(x: Column, k: Column) -> Column:
                return F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])

            return F.sort_array(F.array_compact(F.transform(s, again)))

        def total(at: Column) -> Column:
            steps = F.transform(at, lambda x, k: F.least(F.lit(REPEAT), F.coalesce(F.get(at, k + 1) - x, F.lit(REPEAT))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return let(let(ranked, places), total)

    def window(i: Column) -> Column:
        return F.xxhash64(*[F.get(hashes, i + k) for k in range(REPEAT)])

    all_windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - REPEAT), window)
    some = let(all_windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0))
    return F.when(F.size(hashes) >= REPEAT, some).otherwise(0).cast("long")


def _total_weight(hashes: Column, weight: Column, buckets: int) -> Column:
    def gram(acc: Column, i: Column) -> Column:
        one = F.get(hashes, i)
        two = F.when(i > 0, F.get(weight, _bucket(F.xxhash64(F.get(hashes, i - 1), one), buckets))).otherwise(0)
        return acc + F.get(weight, _bucket(one, buckets)) + two

    n = F.size(hashes)
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0).cast("long"), gram)).otherwise(0)


def judge(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted: int = TRUSTED, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text, ...) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score (mean log ratio in
    millionths, rounded down), base_failed and kept."""
    weight = weights(bucket_counts(docs.select("doc_id", "text"), trusted_ids(labels, trusted), buckets), buckets)
    held = F.expr(f"cast(split('{','.join(map(str, weight))}', ',') as array<bigint>)")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))

    def verdict(h: Column) -> Column:
        measures = F.struct(F.size(h).cast("long").alias("n"), _repeat_words(h).alias("again"), _total_weight(h, held, buckets).alias("sum"))

        def told(m: Column) -> Column:
            failed = (m["n"] < MIN_WORDS) | (100 * m["again"] > MOST_REPEATED * m["n"])
            score = F.when(m["n"] > 0, F.floor(m["sum"] / (2 * m["n"] - 1))).otherwise(0).cast("long")
            return F.struct(m["n"].alias("n_words"), m["again"].alias("n_repeat_words"), score.alias("score"), failed.alias("base_failed"), (~failed & (score >= round(threshold * MILLION))).alias("kept"))

        return let(measures, told)

    # one expression, so that a filter on kept that moves below still evaluates it once
    facts = docs.withColumn("__v", let(F.transform(words(F.col("text")), lambda w: F.xxhash64(w)), verdict))
    v = F.col("__v")
    return facts.withColumns({
        "n_words": v["n_words"],
        "word_chars": (F.length(text) - F.regexp_count(text, F.lit(f"[{SPACE}]"))).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": v["n_repeat_words"], "score": v["score"], "base_failed": v["base_failed"], "kept": v["kept"],
    }).drop("__v")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all documents."""
    out = judge(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept")
