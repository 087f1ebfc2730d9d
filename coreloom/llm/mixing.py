"""Mixing sources to target weights by capped water-filling.

Each source gets its weight's share of all words, but at most `max_epochs` times its own; the excess goes to the
others by weight until no source is above. A source's documents are all repeated floor(target / size) times; the
rest is one more repetition of a seeded sample: documents in the order of a hash of their id and size, up to the point
that comes nearest to the target.

A null source is a source of its own, after all others; a null text or size counts 0 words; a null doc_id hashes as
the empty text. Rows that agree in doc_id and size are sampled alike. A source without words has target 0. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, text_of, with_position

#: Values of the sampling hash. A source's sample is cut at a value: to 1/BINS of the source, or to a document.
BINS, SPAN = 1 << 16, 1 << 8
WEIGHTS = (1, 2, 3)


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def dice(doc_id: Column, size: Column, seed: int) -> Column:
    """0 to BINS - 1, by doc_id, size and seed."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(size, F.lit(0)).cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 4), 16, 10).cast("int")


def targets(sources: DataFrame, max_epochs: int, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target. sources: a row (source, source_size) for each source; weights repeat in order.

    Each round is one aggregation of the table of sources, of which two sums come to the driver.
    """
    placed = with_position(sources, ["source"], scratch, "sources", partitions=1 + sources.count() // 100_000)
    weight = F.element_at(F.lit(list(weights)).cast("array<double>"), (F.col("position") % len(weights) + 1).cast("int"))
    rows = scratch.put("weights", placed.select("source", "source_size", weight.alias("weight"), (F.lit(max_epochs) * F.col("source_size")).alias("most")))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        above = F.col("weight") * level > F.col("most")
        taken, free, n = rows.agg(F.sum(F.when(above, F.col("most"))), F.sum(F.when(~above, F.col("weight"))), F.count(F.when(above, 1))).first()
        if n == full or not free:
            break
        level, full = (total - (taken or 0)) / free, n
    return rows.select("source", "source_size", F.least(F.col("weight") * level, F.col("most").cast("double")).alias("target"))


def mix(docs: DataFrame, max_epochs: int = 3, seed: int = 7, sizes: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, source, size and others) with source_size, target and repeats, how often the mix has the row.
    sizes: doc_id, source and size of docs, where a table of these is cheaper to read than docs."""
    scratch = Scratch(docs.sparkSession, "mix")
    sized = (docs if sizes is None else sizes).select("doc_id", "source", F.coalesce("size", F.lit(0)).alias("size"))
    bins = scratch.put("bins", sized.groupBy("source", dice(F.col("doc_id"), F.col("size"), seed).alias("bin")).agg(F.sum("size").alias("words")))
    goal = targets(bins.groupBy("source").agg(F.sum("words").alias("source_size")), max_epochs, scratch)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    goal = scratch.put("goal", goal.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    # words up to each bin, by way of spans of SPAN bins: no window sees more than SPAN rows, however large the source
    span = F.floor(F.col("bin") / F.lit(SPAN)).cast("int")
    ahead = Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = bins.groupBy("source", span.alias("span")).agg(F.sum("words").alias("w")).withColumn("before", F.coalesce(F.sum("w").over(ahead), F.lit(0)))
    within = Window.partitionBy("source", "span").orderBy("bin")
    b, s, g = bins.withColumn("span", span).withColumn("upto", F.sum("words").over(within)).alias("b"), spans.alias("s"), goal.alias("g")
    summed = b.join(s, F.col("b.source").eqNullSafe(F.col("s.source")) & (F.col("b.span") == F.col("s.span"))).select("b.source", "bin", "words", (F.col("upto") + F.col("before")).alias("sum")).alias("u")
    upto = summed.join(g, F.col("u.source").eqNullSafe(F.col("g.source"))).select("u.source", "bin", "words", "rest", "sum")
    # a bin is in if that brings the sum nearer to the rest
    cut = upto.where((F.col("words") > 0) & (F.col("sum") - F.col("words") / 2 <= F.col("rest")) & (F.col("rest") > 0)).groupBy("source").agg(F.max("bin").alias("cut"))
    c = cut.alias("c")
    plan = scratch.put("plan", goal.alias("g").join(c, F.col("g.source").eqNullSafe(F.col("c.source")), "left").select(F.col("g.source").alias("_source"), "source_size", "target", F.col("whole").alias("_whole"), F.coalesce("cut", F.lit(-1)).alias("_cut")))
    scratch.drop("bins", "goal", "weights", "sources")
    kept = docs.drop("source_size", "target", "repeats")
    joined = kept.join(plan, F.col("source").eqNullSafe(F.col("_source")), "left")
    once_more = (dice(F.col("doc_id"), F.col("size"), seed) <= F.col("_cut")).cast("int")
    return joined.withColumn("repeats", F.col("_whole") + once_more).drop("_source", "_whole", "_cut")


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", n_words(text_of()))
