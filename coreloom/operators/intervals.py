"""Interval logs: validation, order, overlaps and gaps, boundaries, and labelled points.

Intervals are rows (bgs_id, source, top_m, base_m, lith_class, confidence), half-open [top, base). A log is the rows
of one (bgs_id, source).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vocab import CLASSES, class_index, is_evidence

# Greatest plausible depth, tolerance of an overlap, and the limits of the soft checks.
MAX_DEPTH_M = 3000.0
TOUCH = 1e-6
LENGTH_FACTOR, LENGTH_EXTRA, GAP_M, FIRST_TOP_M = 1.15, 1.0, 0.5, 0.5
LOG = ("bgs_id", "source")


def _log(*order: str) -> Window:
    return Window.partitionBy(*LOG).orderBy(*order)


def validate(intervals: DataFrame) -> DataFrame:
    """intervals with lith_class stripped and upper-cased, and `reject`, the first rule that a row breaks (null: none)."""
    top, base, conf = F.col("top_m"), F.col("base_m"), F.col("confidence")
    name = F.upper(F.trim("lith_class"))
    missing = lambda ok: ~F.coalesce(ok, F.lit(False))
    reject = (
        F.when(missing((top >= 0) & (top <= MAX_DEPTH_M)), "top_range")
        .when(missing((base > 0) & (base <= MAX_DEPTH_M)), "base_range")
        .when(missing(name.isin(*CLASSES)), "lith_class")
        .when(conf.isNotNull() & missing(conf.between(0, 1)), "confidence")
        .when(base <= top, "base_not_below_top")
    )
    return intervals.withColumns({"lith_class": name, "reject": reject})


def sequence(intervals: DataFrame) -> DataFrame:
    """intervals with seq, the place in the log by top from 0; ties by base."""
    return intervals.withColumn("seq", (F.row_number().over(_log("top_m", "base_m")) - 1).cast("long"))


def overlaps(intervals: DataFrame) -> DataFrame:
    """Rows whose next interval of the log starts above their base: bgs_id, source, top_m, base_m, next_top_m."""
    following = F.lead("top_m").over(_log("top_m", "base_m"))
    return intervals.withColumn("next_top_m", following).where(F.col("next_top_m") < F.col("base_m") - TOUCH).select(*LOG, "top_m", "base_m", "next_top_m")


def profile(intervals: DataFrame) -> DataFrame:
    """Per log: n_intervals, first_top_m, base_depth_m, gaps_m (unlogged thickness between consecutive intervals)."""
    gap = F.greatest(F.lead("top_m").over(_log("top_m", "base_m")) - F.col("base_m"), F.lit(0.0))
    return intervals.withColumn("gap", gap).groupBy(*LOG).agg(
        F.count(F.lit(1)).alias("n_intervals"), F.min("top_m").alias("first_top_m"), F.max("base_m").alias("base_depth_m"), F.coalesce(F.sum("gap"), F.lit(0.0)).alias("gaps_m")
    )


def plausibility(profiles: DataFrame, index: DataFrame) -> DataFrame:
    """profiles with warnings, an array of the soft checks that a log fails. index: bgs_id, length_m."""
    joined = profiles.join(index.select("bgs_id", "length_m"), "bgs_id", "left")
    checks = F.array(
        F.when(F.col("base_depth_m") > F.col("length_m") * LENGTH_FACTOR + LENGTH_EXTRA, "deeper_than_index"),
        F.when(F.col("gaps_m") > GAP_M, "gaps"),
        F.when(F.col("first_top_m") > FIRST_TOP_M, "starts_below_surface"),
    )
    return joined.withColumn("warnings", F.array_compact(checks))


def boundaries(intervals: DataFrame) -> DataFrame:
    """Distinct tops and bases (to the millimetre) of each log: bgs_id, source, depth_m."""
    return intervals.select(*LOG, F.explode(F.array(F.round("top_m", 3), F.round("base_m", 3))).alias("depth_m")).distinct()


def from_bases(bases: DataFrame) -> DataFrame:
    """Rows (bgs_id, base_m, ...) as intervals: each starts where the one above ends, the first at 0."""
    order = Window.partitionBy("bgs_id").orderBy("base_m")
    return bases.withColumn("top_m", F.lag("base_m", 1, 0.0).over(order))


def not_increasing(depths: DataFrame) -> DataFrame:
    """Logs in which some depth_m isn't below the one before it in order of seq: bgs_id, n_breaks."""
    order = Window.partitionBy("bgs_id").orderBy("seq")
    broken = F.col("depth_m") <= F.lag("depth_m").over(order)
    return depths.withColumn("broken", broken).groupBy("bgs_id").agg(F.count_if("broken").alias("n_breaks")).where("n_breaks > 0")


def zip_in_order(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs rows of left and right (bgs_id, seq, ...) of the same bgs_id by place; sites with unequal counts are left
    out, as their pairs can't be told."""
    def placed(df: DataFrame) -> DataFrame:
        own = Window.partitionBy("bgs_id")
        return df.withColumn("place", F.row_number().over(own.orderBy("seq"))).withColumn("n", F.count(F.lit(1)).over(own)).drop("seq")

    return placed(left).join(placed(right), ["bgs_id", "place", "n"]).drop("n")


def first_source(intervals: DataFrame) -> DataFrame:
    """One log for each site: gold sources before others, then by name."""
    order = Window.partitionBy("bgs_id").orderBy(~F.startswith("source", F.lit("gold:")), "source")
    return intervals.withColumn("rank", F.dense_rank().over(order)).where("rank = 1").drop("rank")


def sample_depths(top: Column, base: Column, step: float) -> Column:
    """Array of top + step/2 + k*step below base. More are generated than needed, then filtered: a computed count is
    wrong where floating point puts the last one on the base."""
    n = F.ceil((base - top) / step).cast("int")
    depths = F.transform(F.sequence(F.lit(0), n), lambda k: top + step / 2 + k * step)
    return F.when(n > 0, F.filter(depths, lambda d: d < base)).otherwise(F.array().cast("array<double>"))


def discretise(intervals: DataFrame, sites: DataFrame, step: float = 0.5) -> DataFrame:
    """Labelled points of the evidence classes: bgs_id, ord, x, y, z, cls. z is the elevation if the site has a ground
    level, minus the depth if not; see `frame`. Logs without a site are left out."""
    rows = intervals.where(is_evidence(F.col("lith_class"))).join(sites.select("bgs_id", "easting", "northing", "ground_level_m"), "bgs_id")
    depths = rows.select("*", F.posexplode(sample_depths(F.col("top_m"), F.col("base_m"), step)).alias("k", "depth_m"))
    return depths.select(
        "bgs_id", (F.col("seq") * 1_000_000 + F.col("k")).alias("ord"), F.col("easting").alias("x"), F.col("northing").alias("y"),
        F.coalesce(F.col("ground_level_m") - F.col("depth_m"), -F.col("depth_m")).alias("z"), class_index(F.col("lith_class")).alias("cls"),
    )


def frame(sites: DataFrame) -> DataFrame:
    """One row: frame, 'elevation' or 'depth'; mixed sites are an error, as their z can't be compared."""
    known, n = F.count("ground_level_m"), F.count(F.lit(1))
    mixed = F.raise_error(F.lit("mixed frames: some sites have ground levels and some do not")).cast("string")
    return sites.agg(F.when((known == n) | (n == 0), "elevation").when(known == 0, "depth").otherwise(mixed).alias("frame"))


def eligible_sites(sites: DataFrame) -> DataFrame:
    """If any site has a ground level, those without one go; otherwise all stay, for the depth frame."""
    some = sites.agg(F.count("ground_level_m").alias("n_known"))
    return sites.join(F.broadcast(some), F.lit(True)).where((F.col("n_known") == 0) | F.col("ground_level_m").isNotNull()).drop("n_known")
