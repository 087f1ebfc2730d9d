"""Queries over the corpus of sites, scans and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import corpus, intervals
from .derived import Frames
from .registry import query

BOX = (383000.0, 203000.0, 386000.0, 206500.0)
AREAS = [("pilot", (382500.0, 202500.0, 385000.0, 205000.0)), ("valleys", (382500.0, 202500.0, 386000.0, 206000.0)), ("county", (380000.0, 200000.0, 390000.0, 210000.0)), ("sea", (0.0, 0.0, 1.0, 1.0))]
POINT = (385010.0, 205010.0)
INSIDE = f"easting BETWEEN {BOX[0]} AND {BOX[2]} AND northing BETWEEN {BOX[1]} AND {BOX[3]}"
NOTED = "coalesce(regexp_matches(name, '(?i)NOTIFICATION\\s+ONLY'), false)"


@query(f"SELECT CAST(id AS BIGINT) AS bgs_id, reference, name, easting, northing, CASE WHEN length >= 0 THEN length END AS length_m, length AS length_raw, {NOTED} AS notification_only FROM {{index_raw}}")
def normalise_index(f: Frames) -> DataFrame:
    return corpus.normalise_index(f.index_raw)


@query(f"SELECT CAST(id AS BIGINT) AS bgs_id, {NOTED} AS notification_only FROM {{index_raw}}")
def notification_flag(f: Frames) -> DataFrame:
    return f.index_raw.select(F.col("id").cast("long").alias("bgs_id"), corpus.is_notification(F.col("name")).alias("notification_only"))


@query(f"SELECT bgs_id, easting, northing FROM {{boreholes}} WHERE {INSIDE}")
def bbox_filter(f: Frames) -> DataFrame:
    return f.boreholes.where(corpus.in_bbox(F.col("easting"), F.col("northing"), BOX)).select("bgs_id", "easting", "northing")


@query("""
    SELECT d.area, CAST(count(r.area) AS BIGINT) AS n_received, CAST(d.declared AS BIGINT) AS declared
    FROM (SELECT CAST(c_custkey AS BIGINT) AS area, CASE WHEN c_custkey % 11 = 0 THEN -1 ELSE coalesce(n, 0) + CASE WHEN c_custkey % 7 = 0 THEN 3 ELSE 0 END END AS declared
          FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey) d
    LEFT JOIN (SELECT o_custkey AS area FROM orders) r ON d.area = r.area GROUP BY d.area, d.declared HAVING d.declared >= 0 AND d.declared <> count(r.area)""")
def completeness_check(f: Frames) -> DataFrame:
    n = f.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    more = F.when(F.col("c_custkey") % 7 == 0, 3).otherwise(0)
    declared = F.when(F.col("c_custkey") % 11 == 0, F.lit(-1)).otherwise(F.coalesce("n", F.lit(0)) + more)
    said = f.customer.join(n, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("c_custkey").alias("area"), declared.cast("long").alias("declared"))
    return corpus.completeness(f.orders.select(F.col("o_custkey").alias("area")), said)


_GOOD = "SELECT bgs_id FROM {scans} WHERE ok"


@query(f"SELECT bgs_id, length_m FROM {{boreholes}} WHERE {INSIDE} AND NOT notification_only AND bgs_id NOT IN ({_GOOD}) ORDER BY length_m DESC NULLS LAST, bgs_id LIMIT 50")
def scan_worklist(f: Frames) -> DataFrame:
    return corpus.scan_worklist(f.boreholes, f.scans, BOX, 50)


@query(f"""SELECT s.bgs_id, s.event_id, b.length_m FROM {{scans}} s JOIN {{boreholes}} b ON s.bgs_id = b.bgs_id
    WHERE s.ok AND {INSIDE} AND s.bgs_id NOT IN (SELECT bgs_id FROM {{intervals}} WHERE source = 'extract:mock/v1') ORDER BY s.bgs_id, s.event_id LIMIT 50""")
def extract_worklist(f: Frames) -> DataFrame:
    return corpus.extract_worklist(f.boreholes, f.scans, f.intervals, "extract:mock/v1", BOX, 50)


@query(f"""SELECT CAST(count(*) AS BIGINT) AS boreholes, CAST(count(length_m) AS BIGINT) AS with_depth, CAST(count(*) FILTER (notification_only) AS BIGINT) AS notification_only, CAST(count(s.bgs_id) AS BIGINT) AS with_scan
    FROM {{boreholes}} b LEFT JOIN (SELECT DISTINCT bgs_id FROM {{scans}} WHERE ok) s ON b.bgs_id = s.bgs_id WHERE {INSIDE}""")
def count_boreholes(f: Frames) -> DataFrame:
    return corpus.count_sites(f.boreholes, f.scans, BOX)


_SUMMARY = """SELECT * FROM (SELECT CAST(count(*) AS BIGINT) AS boreholes, CAST(count(length_m) AS BIGINT) AS with_depth, CAST(count(*) FILTER (notification_only) AS BIGINT) AS notification_only FROM {boreholes}) a,
    (SELECT CAST(count(DISTINCT bgs_id) FILTER (ok) AS BIGINT) AS scans_ok, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS scans_failed FROM {scans}) b,
    (SELECT CAST(count(DISTINCT bgs_id) FILTER (source LIKE 'gold:%') AS BIGINT) AS logs_gold, CAST(count(DISTINCT bgs_id) FILTER (source LIKE 'extract:%') AS BIGINT) AS logs_extracted FROM {intervals}) c,
    (SELECT CAST(count(*) AS BIGINT) AS eval_runs FROM {runs}) d, (SELECT CAST(count(*) AS BIGINT) AS model_runs FROM {model_runs}) e"""


def _summary(f: Frames) -> DataFrame:
    return corpus.summary(f.boreholes, f.scans, f.intervals, f.runs, f.model_runs)


@query(_SUMMARY)
def corpus_summary(f: Frames) -> DataFrame:
    return _summary(f)


def _latest(runs: str, prefix: str, cols: str) -> str:
    names = cols.split(", ")
    return f"(SELECT {', '.join(f'{c} AS {prefix}_{c}' for c in names)} FROM {{{runs}}} ORDER BY ran_at DESC, {', '.join(f'{c} DESC' for c in names if c != 'ran_at')} LIMIT 1)"


@query(f"SELECT * FROM ({_SUMMARY}) s, {_latest('runs', 'eval', 'run_key, ran_key, ran_at, boundary_recall, lithology_f1, n_gold')} a, {_latest('model_runs', 'model', 'run_key, ran_at, frame, n_boreholes, accuracy')} b")
def pipeline_status(f: Frames) -> DataFrame:
    return corpus.pipeline_status(_summary(f), f.runs, f.model_runs)


_SITES = "SELECT m.bgs_id, coalesce(m.easting, b.easting) AS easting, coalesce(m.northing, b.northing) AS northing, m.ground_level_m FROM {log_meta} m LEFT JOIN {boreholes} b ON m.bgs_id = b.bgs_id WHERE m.source = 'gold:ags'"


@query(f"SELECT * FROM ({_SITES}) s WHERE easting IS NOT NULL AND northing IS NOT NULL")
def load_sites(f: Frames) -> DataFrame:
    return corpus.load_sites(f.log_meta, f.boreholes, "gold:ags")


@query("SELECT bgs_id, CAST(count(*) AS BIGINT) AS n_intervals, string_agg(CAST(seq AS VARCHAR) || ':' || lith_class, ',' ORDER BY seq) AS listed FROM {intervals} WHERE source = 'gold:ags' GROUP BY bgs_id")
def load_logs(f: Frames) -> DataFrame:
    found = corpus.load_logs(f.intervals, "gold:ags")
    return found.select("bgs_id", "n_intervals", F.array_join(F.transform("intervals", lambda x: F.concat_ws(":", x["seq"].cast("string"), x["lith_class"])), ",").alias("listed"))


@query("SELECT CAST(count(DISTINCT bgs_id) AS BIGINT) AS n FROM {log_meta} WHERE source = 'gold:ags' AND bgs_id < 0")
def unmapped_gold(f: Frames) -> DataFrame:
    return corpus.unmapped(f.log_meta, "gold:ags")


_NEW = "SELECT bgs_id + 100 AS bgs_id, concat('new ', CAST(k AS VARCHAR(5))) AS name, easting, northing, length_m, length_raw, reference, notification_only, k FROM {boreholes} b, (SELECT n_nationkey AS k FROM {nation}) n WHERE k <= bgs_id % 3"


@query(f"""WITH n AS ({_NEW}), l AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY bgs_id ORDER BY k DESC) = 1)
    SELECT bgs_id, name, length_m FROM l UNION ALL SELECT bgs_id, name, length_m FROM {{boreholes}} WHERE bgs_id NOT IN (SELECT bgs_id FROM l)""")
def upsert_boreholes(f: Frames) -> DataFrame:
    new = f.spark.sql(_NEW, boreholes=f.boreholes, nation=f.nation)
    return corpus.upsert(f.boreholes, new, "bgs_id", "k").select("bgs_id", "name", "length_m")


@query("""WITH n AS (SELECT bgs_id + 7 AS bgs_id, source, seq, top_m + 1.0D AS top_m, base_m + 1.0D AS base_m FROM {intervals} WHERE source = 'gold:ags')
    SELECT * FROM n UNION ALL SELECT bgs_id, source, seq, top_m, base_m FROM {intervals} i WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.bgs_id = i.bgs_id AND n.source = i.source)""")
def replace_intervals(f: Frames) -> DataFrame:
    stored = f.intervals.select("bgs_id", "source", "seq", "top_m", "base_m")
    new = stored.where("source = 'gold:ags'").withColumns({"bgs_id": F.col("bgs_id") + 7, "top_m": F.col("top_m") + 1.0, "base_m": F.col("base_m") + 1.0})
    return corpus.replace_logs(stored, new)


@query(f"""WITH s AS (SELECT bgs_id, name, easting, northing FROM {{boreholes}} UNION ALL SELECT bgs_id, 'log-stated position', easting, northing FROM {{log_meta}} WHERE easting IS NOT NULL AND bgs_id NOT IN (SELECT bgs_id FROM {{boreholes}})),
    t AS (SELECT *, sqrt(pow(easting - {POINT[0]}, 2) + pow(northing - {POINT[1]}, 2)) AS d FROM s ORDER BY d, bgs_id LIMIT 5)
    SELECT bgs_id, name, easting, northing, round(d, 1) AS distance_m, (SELECT count(*) FROM {{scans}} c WHERE c.bgs_id = t.bgs_id AND c.ok) > 0 AS has_scan,
           coalesce((SELECT string_agg(DISTINCT source, ',' ORDER BY source) FROM {{intervals}} i WHERE i.bgs_id = t.bgs_id), '') AS log_sources FROM t""")
def nearest_boreholes(f: Frames) -> DataFrame:
    found = corpus.nearest(f.boreholes, f.log_meta, f.scans, f.intervals, *POINT, k=5)
    return found.withColumn("log_sources", F.array_join("log_sources", ","))


@query("""SELECT x.bgs_id, x.source, a.available_sources, m.easting, m.northing, m.ground_level_m, seq, top_m, base_m, lith_class, confidence
    FROM (SELECT *, dense_rank() OVER (PARTITION BY bgs_id ORDER BY CASE WHEN source LIKE 'gold:%' THEN 0 ELSE 1 END, source) AS r FROM {intervals}) x
    JOIN (SELECT bgs_id, string_agg(DISTINCT source, ',' ORDER BY source) AS available_sources FROM {intervals} GROUP BY bgs_id) a ON x.bgs_id = a.bgs_id
    LEFT JOIN {log_meta} m ON x.bgs_id = m.bgs_id AND x.source = m.source WHERE r = 1""")
def borehole_log(f: Frames) -> DataFrame:
    return corpus.borehole_log(f.intervals, f.log_meta).withColumn("available_sources", F.array_join("available_sources", ","))


@query("SELECT run_key, ran_key, ran_at, round(boundary_recall, 6) AS boundary_recall FROM {runs} ORDER BY ran_at DESC, run_key DESC, ran_key DESC, boundary_recall DESC LIMIT 1")
def latest_run(f: Frames) -> DataFrame:
    return corpus.latest_run(f.runs, "ran_at", "run_key", "ran_key", "boundary_recall").select("run_key", "ran_key", "ran_at", F.round("boundary_recall", 6).alias("boundary_recall"))


_BOXES = ", ".join(f"('{a}', {', '.join(map(str, b))})" for a, b in AREAS)
_PROBE = f"SELECT a.area, CAST(count(b.bgs_id) AS BIGINT) AS n FROM (VALUES {_BOXES}) a(area, x0, y0, x1, y1) LEFT JOIN {{boreholes}} b ON b.easting BETWEEN x0 AND x1 AND b.northing BETWEEN y0 AND y1 GROUP BY a.area"


@query(f"SELECT area, n, (SELECT count(DISTINCT n) = count(*) FROM ({_PROBE}) q) AS distinct_counts FROM ({_PROBE}) p")
def aoi_probe(f: Frames) -> DataFrame:
    return corpus.aoi_probe(f.boreholes, AREAS)


_DEPTHS = "SELECT bgs_id, max(base_m) AS base_depth_m FROM {intervals} WHERE source = 'gold:ags' GROUP BY bgs_id"


@query(f"SELECT CAST(count(*) AS BIGINT) AS n, min(base_depth_m) AS shallowest, list_extract(list_sort(list(base_depth_m)), 1 + count(*) // 2) AS upper_median, max(base_depth_m) AS deepest FROM ({_DEPTHS}) d")
def depth_stats(f: Frames) -> DataFrame:
    return corpus.depth_stats(intervals.profile(f.intervals.where("source = 'gold:ags'")))


@query(f"""SELECT CAST(floor(easting / 1000) AS BIGINT) AS km_e, CAST(floor(northing / 1000) AS BIGINT) AS km_n, CAST(count(*) AS BIGINT) AS n_sites, CAST(count(*) FILTER (base_depth_m >= 5) AS BIGINT) AS n_deep
    FROM {{sites}} s JOIN ({_DEPTHS}) d ON s.bgs_id = d.bgs_id GROUP BY ALL""")
def coverage_km2(f: Frames) -> DataFrame:
    return corpus.coverage_km2(f.sites, intervals.profile(f.intervals.where("source = 'gold:ags'")))


@query()
def id_collision(f: Frames) -> DataFrame:
    """Names that do share an id among names that don't: plumless and buckeroo are a known pair of equal crc32."""
    known = f.spark.createDataFrame([("plumless",), ("buckeroo",)], "hole string")
    holes = f.orders.select(F.concat(F.lit("BH"), F.col("o_orderkey").cast("string")).alias("hole")).unionByName(f.part.select(F.col("p_name").alias("hole"))).unionByName(known)
    return corpus.id_collisions(holes)
