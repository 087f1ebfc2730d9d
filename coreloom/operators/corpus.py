"""The corpus of sites, scans and logs: upserts, work lists, counts, and the lookups that serve it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import BBox, in_bbox
from .intervals import first_source

GOLD, EXTRACTED = "gold:", "extract:"
NOTIFICATION = r"(?iU)NOTIFICATION\s+ONLY"


def is_notification(name: Column) -> Column:
    return F.coalesce(name.rlike(NOTIFICATION), F.lit(False))


def normalise_index(raw: DataFrame) -> DataFrame:
    """bgs_id, reference, name, easting, northing, length_m, length_raw, notification_only of index records whose ids
    and lengths are doubles; a negative length says unknown and is kept as length_raw alone."""
    length = F.col("length").try_cast("double")
    return raw.select(
        F.col("id").cast("long").alias("bgs_id"), "reference", "name", "easting", "northing", F.when(length >= 0, length).alias("length_m"), length.cast("double").alias("length_raw"), is_notification(F.col("name")).alias("notification_only")
    )


def upsert(stored: DataFrame, new: DataFrame, key: str | tuple[str, ...], order: str | None = None) -> DataFrame:
    """stored with new rows in place of those of their key; of several new rows of a key, that last in `order` (null
    first), or of the largest values without one. New rows whose key has a null have no place and are left out."""
    keys = [key] if isinstance(key, str) else list(key)
    one = F.struct(*(c for c in new.columns if c not in keys))
    rank = F.struct(F.col(order).isNotNull().alias("known"), F.col(order).alias("order")) if order else one  # a struct is never null
    last = new.dropna(subset=keys).groupBy(*keys).agg(F.max_by(one, rank).alias("_last")).select(*keys, "_last.*")
    return stored.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*stored.columns))


def replace_logs(stored: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("bgs_id", "source"), loaded: DataFrame | None = None) -> DataFrame:
    """stored without any log that `loaded` (new by default) names, and with the new rows. A log loaded without rows
    therefore goes."""
    named = (new if loaded is None else loaded).select(*keys).distinct()
    return stored.join(named, list(keys), "left_anti").unionByName(new)


def store_logs(intervals: DataFrame, meta: DataFrame, new: DataFrame, new_meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(intervals, meta) once logs are loaded: new_meta names them, a row for each (bgs_id, source), and new has their
    intervals, if they have any."""
    keys = ("bgs_id", "source")
    return replace_logs(intervals, new, keys, new_meta), upsert(meta, new_meta, keys)


def append_rows(df: DataFrame, path: str, at: str = "fetched_at") -> None:
    """Appends attempts or runs to the table at path, each with the time `at`; no row is ever changed."""
    df.withColumn(at, F.current_timestamp()).write.mode("append").parquet(path)


def run_rows(metrics: DataFrame, source: str) -> DataFrame:
    """metrics with run_id, the time in UTC, and source: rows for append_rows(..., at='ran_at')."""
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return metrics.select(F.date_format(now, "yyyyMMdd'T'HHmmss'Z'").alias("run_id"), F.lit(source).alias("source"), *metrics.columns)


def _rename(fs, a, b) -> bool:
    return fs.rename(a, b)


def swap_in(df: DataFrame, path: str) -> None:
    """Writes df to path as a new table, moves the old one aside and the new one in, and only then deletes the old one.

    If the new one can't be moved in, the old one is moved back, and that is an error. Between the two moves no table
    stands at path; where a driver was lost just then, the next call puts the old one back before it begins.
    """
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    now, new, old = (jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + s) for s in ("", "_new", "_old"))
    fs = now.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(old) and not fs.exists(now) and not _rename(fs, old, now):
        raise OSError(f"{path}_old can't be moved back")
    fs.delete(new, True)
    df.write.parquet(str(new))
    fs.delete(old, True)
    had = fs.exists(now)
    if had and not _rename(fs, now, old):
        raise OSError(f"{path} can't be moved aside")
    if not _rename(fs, new, now):
        if had and not _rename(fs, old, now):
            raise OSError(f"{path} can't be replaced, nor put back: it is at {path}_old")
        raise OSError(f"{path} can't be replaced")
    fs.delete(old, True)


def completeness(received: DataFrame, declared: DataFrame) -> DataFrame:
    """Areas whose count of received rows differs from the declared number: area, n_received, declared. A declared
    number of -1 says unknown and passes."""
    got = received.groupBy("area").agg(F.count(F.lit(1)).alias("n_received"))
    rows = declared.join(got, "area", "left").select("area", F.coalesce("n_received", F.lit(0)).alias("n_received"), "declared")
    return rows.where((F.col("declared") >= 0) & (F.col("declared") != F.col("n_received")))


def scan_worklist(boreholes: DataFrame, scans: DataFrame, box: BBox, cap: int, skip_notification: bool = True) -> DataFrame:
    """Sites in the box without a good scan, longest first (unknown last), then by id, up to `cap`."""
    rows = boreholes.where(in_bbox(F.col("easting"), F.col("northing"), box))
    rows = rows.where(~F.col("notification_only")) if skip_notification else rows
    return rows.join(scans.where("ok").select("bgs_id"), "bgs_id", "left_anti").orderBy(F.desc_nulls_last("length_m"), "bgs_id").limit(cap).select("bgs_id", "length_m")


def extract_worklist(boreholes: DataFrame, scans: DataFrame, intervals: DataFrame, source: str, box: BBox, cap: int) -> DataFrame:
    """Good scans of sites in the box that have no log of the source yet, by site, up to `cap`."""
    sites = boreholes.where(in_bbox(F.col("easting"), F.col("northing"), box)).select("bgs_id", "length_m")
    done = intervals.where(F.col("source") == source).select("bgs_id")
    return scans.where("ok").join(sites, "bgs_id").join(done, "bgs_id", "left_anti").orderBy("bgs_id", "event_id").limit(cap).select("bgs_id", "event_id", "length_m")


def count_sites(boreholes: DataFrame, scans: DataFrame, box: BBox) -> DataFrame:
    """One row: boreholes, with_depth, notification_only, with_scan in the box."""
    good = scans.where("ok").select("bgs_id").distinct().withColumn("good", F.lit(1))
    rows = boreholes.where(in_bbox(F.col("easting"), F.col("northing"), box)).join(good, "bgs_id", "left")
    return rows.agg(F.count(F.lit(1)).alias("boreholes"), F.count("length_m").alias("with_depth"), F.count_if("notification_only").alias("notification_only"), F.count("good").alias("with_scan"))


def _beside(*frames: DataFrame) -> DataFrame:
    """One row of the columns of frames of one row; those after the first may have none."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(F.broadcast(f), F.lit(True), "left")
    return out


def summary(boreholes: DataFrame, scans: DataFrame, intervals: DataFrame, eval_runs: DataFrame, model_runs: DataFrame) -> DataFrame:
    """One row of counts over the corpus."""
    of = lambda prefix: F.countDistinct(F.when(F.startswith("source", F.lit(prefix)), F.col("bgs_id")))
    return _beside(
        boreholes.agg(F.count(F.lit(1)).alias("boreholes"), F.count("length_m").alias("with_depth"), F.count_if("notification_only").alias("notification_only")),
        scans.agg(F.countDistinct(F.when(F.col("ok"), F.col("bgs_id"))).alias("scans_ok"), F.count_if(~F.col("ok")).alias("scans_failed")),
        intervals.agg(of(GOLD).alias("logs_gold"), of(EXTRACTED).alias("logs_extracted")),
        eval_runs.agg(F.count(F.lit(1)).alias("eval_runs")), model_runs.agg(F.count(F.lit(1)).alias("model_runs")),
    )


def pipeline_status(counts: DataFrame, eval_runs: DataFrame, model_runs: DataFrame, at: str = "ran_at") -> DataFrame:
    """The row of summary with the latest eval run's columns as eval_* and the latest model run's as model_*; nulls where
    nothing has run. Runs of one time: the larger row."""
    def latest(runs: DataFrame, prefix: str) -> DataFrame:
        last = runs.agg(F.max(F.struct(at, *(c for c in runs.columns if c != at))).alias("r")).where("r is not null")
        return last.select(*(F.col("r")[c].alias(f"{prefix}_{c}") for c in runs.columns))

    return _beside(counts, latest(eval_runs, "eval"), latest(model_runs, "model"))


def load_sites(meta: DataFrame, boreholes: DataFrame, source: str) -> DataFrame:
    """bgs_id, easting, northing, ground_level_m of the source's logs: the position on the log before that of the
    index; without either a log has no site."""
    b = boreholes.select("bgs_id", F.col("easting").alias("be"), F.col("northing").alias("bn"))
    rows = meta.where(F.col("source") == source).join(b, "bgs_id", "left")
    rows = rows.select("bgs_id", F.coalesce("easting", "be").alias("easting"), F.coalesce("northing", "bn").alias("northing"), "ground_level_m")
    return rows.where("easting is not null and northing is not null")


def load_logs(intervals: DataFrame, source: str) -> DataFrame:
    """bgs_id, n_intervals and the intervals of each log of the source as an array in order of seq."""
    one = F.struct("seq", "top_m", "base_m", "lith_class", "confidence")
    return intervals.where(F.col("source") == source).groupBy("bgs_id").agg(F.count(F.lit(1)).alias("n_intervals"), F.array_sort(F.collect_list(one)).alias("intervals"))


def unmapped(intervals: DataFrame, source: str) -> DataFrame:
    """One row: n, the sites of the source with a placeholder id (below 0)."""
    return intervals.where((F.col("source") == source) & (F.col("bgs_id") < 0)).agg(F.countDistinct("bgs_id").alias("n"))


def placeholder_id(hole: Column) -> Column:
    """A negative id from a hole's name, the same in every run."""
    return -(F.crc32(hole.cast("binary")) % 2_000_000_000 + 1)


def id_collisions(holes: DataFrame) -> DataFrame:
    """Placeholder ids that several names share: bgs_id, n_names. holes: hole."""
    return holes.groupBy(placeholder_id(F.col("hole")).alias("bgs_id")).agg(F.countDistinct("hole").alias("n_names")).where("n_names > 1")


def nearest(boreholes: DataFrame, meta: DataFrame, scans: DataFrame, intervals: DataFrame, x: float, y: float, k: int = 5) -> DataFrame:
    """The k (1 to 50) sites nearest to a point, from the index and from logs that state a place the index lacks, with
    has_scan and log_sources. Scans and logs are looked up for these k alone."""
    own = meta.where("easting is not null").join(boreholes.select("bgs_id"), "bgs_id", "left_anti").select("bgs_id", F.lit("log-stated position").alias("name"), "easting", "northing")
    sites = boreholes.select("bgs_id", "name", "easting", "northing").unionByName(own)
    d = F.hypot(F.col("easting") - x, F.col("northing") - y)
    top = sites.withColumn("distance_m", d).orderBy("distance_m", "bgs_id").limit(max(1, min(50, k)))
    near = F.broadcast(top.select("bgs_id").distinct())  # 50 ids at most
    scanned = scans.where("ok").join(near, "bgs_id").select("bgs_id").distinct().withColumn("has_scan", F.lit(True))
    sources = intervals.join(near, "bgs_id").groupBy("bgs_id").agg(F.array_sort(F.collect_set("source")).alias("log_sources"))
    rows = top.join(scanned, "bgs_id", "left").join(sources, "bgs_id", "left")
    return rows.select("bgs_id", "name", "easting", "northing", F.round("distance_m", 1).alias("distance_m"), F.coalesce("has_scan", F.lit(False)).alias("has_scan"), F.coalesce("log_sources", F.array().cast("array<string>")).alias("log_sources"))


def borehole_log(intervals: DataFrame, meta: DataFrame, source: str | None = None) -> DataFrame:
    """The intervals of every site's log in seq: of the source asked for, else of gold before others and then by name;
    with available_sources and the log's own columns of meta."""
    every = intervals.groupBy("bgs_id").agg(F.array_sort(F.collect_set("source")).alias("available_sources"))
    rows = first_source(intervals) if source is None else intervals.where(F.col("source") == source)
    return rows.join(every, "bgs_id").join(meta, ["bgs_id", "source"], "left")


def latest_run(runs: DataFrame, at: str, *ties: str) -> DataFrame:
    return runs.orderBy(F.desc(at), *(F.desc(t) for t in ties)).limit(1)


def aoi_probe(boreholes: DataFrame, areas: list[tuple[str, BBox]]) -> DataFrame:
    """area, n and distinct_counts (whether all areas' counts differ), also for areas without sites."""
    spark = boreholes.sparkSession
    names = spark.createDataFrame([(a,) for a, _ in areas], "area string")
    inside = F.array_compact(F.array(*(F.when(in_bbox(F.col("easting"), F.col("northing"), b), F.lit(a)) for a, b in areas)))
    got = boreholes.select(F.explode(inside).alias("area")).groupBy("area").agg(F.count(F.lit(1)).alias("n"))
    rows = names.join(got, "area", "left").select("area", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    differ = rows.agg((F.countDistinct("n") == F.count(F.lit(1))).alias("distinct_counts"))
    return rows.join(F.broadcast(differ), F.lit(True))


def depth_stats(profiles: DataFrame) -> DataFrame:
    """One row: n, shallowest, upper_median (the element at n div 2 in order), deepest of base_depth_m.

    The element is found by exact counts per value, so no task holds all depths.
    """
    counts = profiles.groupBy("base_depth_m").agg(F.count(F.lit(1)).alias("c"))
    n = profiles.agg(F.count(F.lit(1)).alias("n"), F.min("base_depth_m").alias("shallowest"), F.max("base_depth_m").alias("deepest"))
    half = profiles.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY base_depth_m)").alias("lower"))
    upto = counts.join(F.broadcast(half), F.lit(True)).agg(F.sum(F.when(F.col("base_depth_m") <= F.col("lower"), F.col("c"))).alias("upto"), F.min(F.when(F.col("base_depth_m") > F.col("lower"), F.col("base_depth_m"))).alias("next"), F.max("lower").alias("lower"))
    rows = n.join(F.broadcast(upto), F.lit(True))
    return rows.select("n", "shallowest", F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("lower")).otherwise(F.col("next")).alias("upper_median"), "deepest")


def coverage_km2(sites: DataFrame, profiles: DataFrame, min_depth: float = 5.0) -> DataFrame:
    """Per square kilometre: n_sites and n_deep, those at least min_depth deep."""
    cell = lambda c: F.floor(F.col(c) / 1000).cast("long")
    rows = sites.join(profiles.groupBy("bgs_id").agg(F.max("base_depth_m").alias("d")), "bgs_id")
    return rows.groupBy(cell("easting").alias("km_e"), cell("northing").alias("km_n")).agg(F.count(F.lit(1)).alias("n_sites"), F.count_if(F.col("d") >= min_depth).alias("n_deep"))


def verify_scans(scans: DataFrame, boreholes: DataFrame) -> DataFrame:
    """scans (bgs_id, stamp_id, stamp_reference, stamp_easting, stamp_northing, and row ids) with `outcome`: missing (where
    scans has the column `found` and it isn't true: no such file), unstamped, other_id, other_reference, other_place or
    verified; the first check that fails decides."""
    gone = ~F.coalesce(F.col("found"), F.lit(False)) if "found" in scans.columns else F.lit(False)
    b = boreholes.select("bgs_id", F.col("reference").alias("_ref"), F.col("easting").alias("_e"), F.col("northing").alias("_n"))
    far = F.hypot(F.col("stamp_easting") - F.col("_e"), F.col("stamp_northing") - F.col("_n")) > 1.0
    outcome = (
        F.when(gone, "missing").when(F.col("stamp_id").isNull(), "unstamped").when(F.col("stamp_id") != F.col("bgs_id"), "other_id")
        .when((F.col("_ref") != "") & (F.col("stamp_reference") != F.col("_ref")), "other_reference").when(far, "other_place").otherwise("verified")
    )
    return scans.join(b, "bgs_id", "left").withColumn("outcome", outcome).drop("_ref", "_e", "_n")
