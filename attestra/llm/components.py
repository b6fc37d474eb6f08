"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import hot_keys_join, written


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of any orderable type as (node, root): root is the smallest node that node reaches. Links to
    oneself give no row. Every round is written to the shared folder; a node of many links is joined by broadcast of
    its single minimum."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
        low = low.select("a", F.least("a", "low").alias("low"), "n")
        large = hot_keys_join(both, low, ["a"], "n", 2 * state[0]).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = written(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
        joined = hot_keys_join(large, low, ["a"], "n", state[0])
        small = joined.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b"))).distinct()
        edges = written(small, "small-star")
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _state(edges: DataFrame) -> tuple[int, int]:
    n, total = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
    return n, total
