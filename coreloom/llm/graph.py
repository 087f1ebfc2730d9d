"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _mark(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) links of longs -> (node, root): every node that has a link, with the smallest node it reaches.

    Alternating large-star and small-star steps, each of which keeps at most as many rows as there are links;
    the table is written after each round, so lost executors cost one round. Links of a node to itself and
    nulls are ignored; repeats are harmless; no links give no rows.
    """
    clean = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = scratch.put("links-0", clean)
    mark, k = _mark(now), 0
    while mark[0]:
        k += 1
        # least and large are written, so that the joins read both sides by plain shuffles, of which Spark splits a hot key
        both = now.union(now.select("b", "a"))
        least = scratch.put(f"least-{k}", both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = scratch.put(f"large-{k}", both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        roots = scratch.put(f"roots-{k}", large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(roots, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(roots.select("a", "m")).distinct()
        after = scratch.put(f"links-{k}", small)
        was, mark, now = mark, _mark(after), after
        scratch.drop(f"links-{k - 1}", f"least-{k}", f"large-{k}", f"roots-{k}")
        if was == mark:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
