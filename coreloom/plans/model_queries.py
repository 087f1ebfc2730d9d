"""Queries over the kernel model, its validation and the voxel grid."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import to_grid, to_wgs84
from ..functions.vocab import CLASSES, EVIDENCE
from ..operators import flow, spatial, voxels
from ..operators.lineage import cut, shared_dir
from .derived import VIEWS, Frames
from .registry import query

LH, LV = 600.0, 2.5
GRID = voxels.Grid(382500.0, 202500.0, 387500.0, 207500.0, 250.0, 5.0, 55.0, 105.0)
PEEL, MAX_ENTROPY = 90.0, 0.6


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _mean_sql(queries: str, known: str, length: float) -> str:
    """qid, w, m: kernel means in SQL."""
    r = 3 * length
    d2 = f"(pow((q.easting - s.easting) / {length}, 2) + pow((q.northing - s.northing) / {length}, 2))"
    return f"""SELECT q.qid, sum(exp(-{d2})) AS w, sum(exp(-{d2}) * s.ground_level_m) / sum(exp(-{d2})) AS m
        FROM (SELECT *, floor(easting / {r}) + di AS cx, floor(northing / {r}) + dj AS cy FROM ({queries}) a, (VALUES (-1), (0), (1)) b(di), (VALUES (-1), (0), (1)) c(dj)) q
        JOIN (SELECT *, floor(easting / {r}) AS cx, floor(northing / {r}) AS cy FROM ({known}) k) s ON q.cx = s.cx AND q.cy = s.cy WHERE {d2} <= 9 GROUP BY q.qid"""


def _filled_sql(sites: str) -> str:
    known, missing = f"SELECT * FROM {sites} WHERE ground_level_m IS NOT NULL", f"SELECT bgs_id AS qid, easting, northing FROM {sites} WHERE ground_level_m IS NULL"
    return f"""SELECT s.bgs_id, round(coalesce(s.ground_level_m, e.m), 6) AS ground_level_m, s.ground_level_m IS NULL AND e.m IS NOT NULL AS gl_estimated
    FROM {sites} s LEFT JOIN (SELECT * FROM ({_mean_sql(missing, known, 300.0)}) x WHERE w >= 0.05) e ON s.bgs_id = e.qid"""


def _filled(sites: DataFrame) -> DataFrame:
    return rounded(spatial.estimate_ground_levels(sites).select("bgs_id", "ground_level_m", "gl_estimated"), "ground_level_m")


@query(_filled_sql("{sites}"))
def estimate_gl(f: Frames) -> DataFrame:
    """In a fixed box, denser as there are more sites."""
    return _filled(f.sites)


@query(_filled_sql("{gap_sites}"))
def estimate_gl_even(f: Frames) -> DataFrame:
    """At the same density, however many sites there are."""
    return _filled(f.gap_sites)


_COLUMNS = f"SELECT CAST(i + {GRID.nx} * j AS BIGINT) AS qid, i, j, {GRID.x0} + (i + 0.5) * {GRID.cell_xy} AS easting, {GRID.y0} + (j + 0.5) * {GRID.cell_xy} AS northing FROM range({GRID.nx}) a(i), range({GRID.ny}) b(j)"


def _surface_sql(sites: str) -> str:
    known = f"SELECT * FROM {sites} WHERE ground_level_m IS NOT NULL"
    return f"""SELECT c.qid, c.i, c.j, c.easting, c.northing, coalesce(m.m, (SELECT avg(ground_level_m) FROM {sites})) AS surface
        FROM ({_COLUMNS}) c LEFT JOIN (SELECT * FROM ({_mean_sql(_COLUMNS, known, 300.0)}) y WHERE w > 1e-6) m ON c.qid = m.qid"""


@query(f"SELECT qid, round(surface, 6) AS surface FROM ({_surface_sql('{sites}')}) s")
def kernel_surface(f: Frames) -> DataFrame:
    return rounded(spatial.kernel_surface(GRID.columns(f.spark), f.sites).select("qid", "surface"), "surface")


def _weigh_sql(queries: str, lh: float, lv: float, extra: str = "") -> str:
    """qid, cls, w: the kernel weight of each class of {samples} at each query."""
    rh, rv = 3 * lh, 3 * lv
    d2 = f"(pow((q.x - s.x) / {lh}, 2) + pow((q.y - s.y) / {lh}, 2) + pow((q.z - s.z) / {lv}, 2))"
    around = ", ".join(f"(VALUES (-1), (0), (1)) {t}({c})" for t, c in (("t1", "di"), ("t2", "dj"), ("t3", "dk")))
    return f"""SELECT q.qid, s.cls, sum(exp(-{d2})) AS w
        FROM (SELECT *, floor(x / {rh}) + di AS cx, floor(y / {rh}) + dj AS cy, floor(z / {rv}) + dk AS cz FROM ({queries}) a, {around}) q
        JOIN (SELECT *, floor(x / {rh}) AS cx, floor(y / {rh}) AS cy, floor(z / {rv}) AS cz FROM {{samples}} b) s ON q.cx = s.cx AND q.cy = s.cy AND q.cz = s.cz {extra}
        WHERE {d2} <= 9 GROUP BY q.qid, s.cls"""


def _vote_sql(queries: str, lh: float, lv: float, extra: str = "") -> str:
    """qid, evidence, cls, p_max, entropy."""
    p = "greatest((1.0 / 15 + w) / (1 + t), 1e-12)"
    return f"""SELECT qid, max(t) AS evidence, arg_max(cls, (w, -cls)) AS cls, max({p}) AS p_max,
               -(sum({p} * ln({p})) + (15 - count(*)) * max(greatest((1.0 / 15) / (1 + t), 1e-12) * ln(greatest((1.0 / 15) / (1 + t), 1e-12)))) / ln(15) AS entropy
        FROM (SELECT *, sum(w) OVER (PARTITION BY qid) AS t FROM ({_weigh_sql(queries, lh, lv, extra)}) k) v GROUP BY qid"""


_LOO = _vote_sql("SELECT * FROM {samples}", LH, LV, "AND q.bgs_id <> s.bgs_id")


def _loo_votes(f: Frames) -> DataFrame:
    return spatial.vote_among(f.samples, [(LH, LV)], exclude_own=True)


@query(f"SELECT qid, CAST(cls AS INT) AS cls, round(w, 6) AS w FROM ({_weigh_sql('SELECT * FROM {samples}', 300.0, LV)}) k")
def kernel_vote(f: Frames) -> DataFrame:
    return rounded(spatial.weigh_among(f.samples, [(300.0, LV)]).select("qid", "cls", "w"), "w")


@query(f"SELECT qid, CAST(cls AS INT) AS cls, round(evidence, 6) AS evidence, round(p_max, 6) AS p_max FROM ({_LOO}) v")
def kernel_argmax(f: Frames) -> DataFrame:
    return rounded(_loo_votes(f).select("qid", "cls", "evidence", "p_max"), "evidence", "p_max")


@query(f"SELECT qid, round(entropy, 6) AS entropy FROM ({_LOO}) v")
def voxel_entropy(f: Frames) -> DataFrame:
    return rounded(_loo_votes(f).select("qid", "entropy"), "entropy")


_BASE = """
    SELECT qid, ocls AS cls FROM (
        SELECT q.qid, arg_min(s.cls, (abs(q.z - s.z), s.ord)) AS ocls, min(abs(q.z - s.z)) AS dz
        FROM {samples} q JOIN (
            SELECT a.bgs_id, arg_min(b.bgs_id, (pow(a.x - b.x, 2) + pow(a.y - b.y, 2), b.bgs_id)) AS other
            FROM (SELECT DISTINCT bgs_id, x, y FROM {samples}) a JOIN (SELECT DISTINCT bgs_id, x, y FROM {samples}) b ON a.bgs_id <> b.bgs_id GROUP BY a.bgs_id) n ON q.bgs_id = n.bgs_id
        JOIN {samples} s ON s.bgs_id = n.other GROUP BY q.qid) z WHERE dz <= 3"""


@query(f"SELECT qid, CAST(cls AS INT) AS cls FROM ({_BASE}) b")
def nn_baseline(f: Frames) -> DataFrame:
    return spatial.baseline(f.samples)


_LOO_ROW = f"""
    WITH v AS ({_LOO}), j AS (SELECT s.qid, s.bgs_id, v.cls = s.cls AS hit, v.p_max >= 0.8 AS sure, coalesce(v.evidence >= 0.05, false) AS ok FROM {{samples}} s LEFT JOIN v ON s.qid = v.qid),
    b AS (SELECT count(*) FILTER (b.cls = s.cls) AS base FROM ({_BASE}) b JOIN {{samples}} s ON b.qid = s.qid),
    t AS (SELECT CAST(count(DISTINCT bgs_id) AS BIGINT) AS n_sites, CAST(count(*) AS BIGINT) AS n_points, count(*) FILTER (ok AND hit) / count(*) AS accuracy, max(base) / count(*) AS baseline_accuracy,
                 count(*) FILTER (ok AND sure AND hit) / nullif(count(*) FILTER (ok AND sure), 0) AS calibration, count(*) FILTER (ok AND sure) / count(*) AS confident_fraction, count(*) FILTER (ok) / count(*) AS constrained_fraction FROM j, b)
    """
_LOO_COLS = ("accuracy", "baseline_accuracy", "gain_pp", "calibration", "confident_fraction", "constrained_fraction")
_LOO_OUT = "n_sites, n_points, " + ", ".join(f"round({'100 * (accuracy - baseline_accuracy)' if c == 'gain_pp' else c}, 6) AS {c}" for c in _LOO_COLS)


def _loo_row(f: Frames) -> DataFrame:
    return spatial.leave_one_out(f.samples, [(LH, LV)])


@query(_LOO_ROW + f"SELECT {_LOO_OUT} FROM t")
def loo_validate(f: Frames) -> DataFrame:
    return rounded(_loo_row(f).drop("lh", "lv"), *_LOO_COLS)


@query(_LOO_ROW + f"""SELECT {_LOO_OUT}, coalesce(100 * (accuracy - baseline_accuracy) >= 5, false) AS gain_ok, coalesce(calibration >= 0.75, false) AS calibration_ok, n_sites >= 30 AS enough_sites,
    coalesce(100 * (accuracy - baseline_accuracy) >= 5, false) AND coalesce(calibration >= 0.75, false) AND n_sites >= 30 AS gates_passed FROM t""")
def model_gates(f: Frames) -> DataFrame:
    return rounded(spatial.model_gates(_loo_row(f)).drop("lh", "lv"), *_LOO_COLS)


@query()
def tune(f: Frames) -> DataFrame:
    return spatial.tune(f.samples)


# --- voxels

_CENTRES = f"SELECT CAST(qid + {GRID.nx * GRID.ny} * k AS BIGINT) AS qid, i, j, k, easting AS x, northing AS y, surface, {GRID.z0} + (k + 0.5) * {GRID.cell_z} AS z, {GRID.z0} + (k + 1) * {GRID.cell_z} <= surface + 1e-9 AS below FROM ({_surface_sql('{world_sites}')}) s, range({GRID.nz}) r(k)"
_VOXELS = f"""
    SELECT CAST(c.i AS INT) AS i, CAST(c.j AS INT) AS j, CAST(c.k AS INT) AS k, c.qid AS idx, c.surface, CASE WHEN NOT below THEN 255 WHEN v.cls IS NULL THEN 254 ELSE v.cls END AS class_idx, coalesce(v.entropy, 1.0) AS entropy, v.cls IS NOT NULL AS constrained
    FROM ({_CENTRES}) c LEFT JOIN (SELECT * FROM ({_vote_sql(f'SELECT * FROM ({_CENTRES}) e WHERE below', LH, LV)}) w WHERE evidence >= 0.05) v ON c.qid = v.qid"""


def _baked(f: Frames) -> DataFrame:
    return voxels.bake(GRID, f.samples, f.world_sites, LH, LV)


@query(f"SELECT i, j, k, idx, CAST(class_idx AS INT) AS class_idx, round(entropy, 6) AS entropy, constrained FROM ({_VOXELS}) v")
def voxel_grid(f: Frames) -> DataFrame:
    return rounded(_baked(f).drop("surface"), "entropy")


@query(f"SELECT idx FROM ({_VOXELS}) v WHERE class_idx <> 255 AND {GRID.z0} + (k + 1) * {GRID.cell_z} <= {PEEL} + 1e-6 AND entropy <= {MAX_ENTROPY}")
def voxel_visibility(f: Frames) -> DataFrame:
    return voxels.visible(_baked(f), GRID, PEEL, MAX_ENTROPY).select("idx")


@query(f"SELECT CAST(class_idx AS INT) AS class_idx, CAST(count(*) AS BIGINT) AS n FROM ({_VOXELS}) v WHERE class_idx <> 255 AND {GRID.z0} + (k + 1) * {GRID.cell_z} <= {PEEL} + 1e-6 AND entropy <= {MAX_ENTROPY} GROUP BY class_idx")
def class_histogram(f: Frames) -> DataFrame:
    return voxels.histogram(voxels.visible(_baked(f), GRID, PEEL, MAX_ENTROPY))


_POINTS = "SELECT bgs_id AS pid, easting - 500.0D AS x, northing AS y, 50.0D + (bgs_id % 60) AS z FROM {sites}"
_AT = ("surface", "entropy", "voxel_easting", "voxel_northing", "z_base", "z_top")


@query(f"""
    SELECT p.pid, CASE WHEN v.class_idx IS NULL THEN 'outside' WHEN v.class_idx = 255 THEN 'air' WHEN v.class_idx = 254 THEN 'unconstrained' ELSE 'class' END AS status,
           CASE CASE WHEN v.class_idx < 254 THEN v.class_idx END {' '.join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CLASSES))} END AS lith_class,
           CASE WHEN v.class_idx < 254 THEN round(1 - round(v.entropy, 6), 2) WHEN v.class_idx = 254 THEN 0.0 END::DOUBLE AS certainty,
           CASE WHEN v.class_idx < 255 THEN round(v.entropy, 6) END AS entropy, coalesce(v.constrained, false) AS constrained, round(v.surface, 6) AS surface,
           CASE WHEN v.class_idx < 255 THEN round({GRID.x0} + (v.i + 0.5) * {GRID.cell_xy}, 6)::DOUBLE END AS voxel_easting, CASE WHEN v.class_idx < 255 THEN round({GRID.y0} + (v.j + 0.5) * {GRID.cell_xy}, 6)::DOUBLE END AS voxel_northing,
           CASE WHEN v.class_idx < 255 THEN round({GRID.z0} + v.k * {GRID.cell_z}, 6)::DOUBLE END AS z_base, CASE WHEN v.class_idx < 255 THEN round({GRID.z0} + (v.k + 1) * {GRID.cell_z}, 6)::DOUBLE END AS z_top
    FROM ({_POINTS}) p LEFT JOIN ({_VOXELS}) v ON floor((p.x - {GRID.x0}) / {GRID.cell_xy}) = v.i AND floor((p.y - {GRID.y0}) / {GRID.cell_xy}) = v.j AND floor((p.z - {GRID.z0}) / {GRID.cell_z}) = v.k""")
def subsurface_at(f: Frames) -> DataFrame:
    """From the stored table of voxels, which is made once for all points."""
    path = f"{shared_dir(f.spark)}/voxels-{uuid.uuid4().hex}"
    voxels.store(rounded(_baked(f), "entropy"), GRID, path)
    grid, table = voxels.stored(f.spark, path)
    return rounded(voxels.lookup(table, grid, f.spark.sql(_POINTS, sites=f.sites)), *_AT)


@query(f"""WITH v AS ({_VOXELS}) SELECT idx, i, j, k, CAST(class_idx AS INT) AS class_idx, round(round(entropy, 6), 2) AS entropy FROM v""")
def model_decode(f: Frames) -> DataFrame:
    """The voxels after a round trip through layers of arrays, as the viewer's file has them."""
    return voxels.decode(voxels.layers(rounded(_baked(f), "entropy")), GRID).withColumn("entropy", F.round("entropy", 2))


# --- from stored logs to gates

AREA = (383_300.0, 0.0, 414_000.0, 1e12)
_AREA_SITES = f"SELECT * FROM (SELECT m.bgs_id, coalesce(m.easting, b.easting) AS easting, coalesce(m.northing, b.northing) AS northing, m.ground_level_m FROM {{world_meta}} m LEFT JOIN {{world_sites}} b ON m.bgs_id = b.bgs_id) q WHERE easting BETWEEN {AREA[0]} AND {AREA[2]} AND northing BETWEEN {AREA[1]} AND {AREA[3]}"
#: In SQL alone; Spark takes the operators' way.
VIEWS["area_sites"] = _AREA_SITES
VIEWS["area_filled"] = f"SELECT s.bgs_id, s.easting, s.northing, coalesce(s.ground_level_m, e.m) AS ground_level_m, s.ground_level_m IS NOT NULL AS stated FROM {{area_sites}} s LEFT JOIN (SELECT * FROM ({_mean_sql('SELECT bgs_id AS qid, easting, northing FROM {area_sites} WHERE ground_level_m IS NULL', 'SELECT * FROM {area_sites} WHERE ground_level_m IS NOT NULL', LH)}) x WHERE w >= 0.05) e ON s.bgs_id = e.qid WHERE coalesce(s.ground_level_m, e.m) IS NOT NULL"
VIEWS["area_samples"] = f"""
    SELECT g.bgs_id * 1000000 + g.seq * 100 + k AS qid, g.bgs_id, g.seq * 1000000 + k AS ord, s.easting AS x, s.northing AS y, s.ground_level_m - (g.top_m + 0.25D + 0.5D * k) AS z,
           CASE g.lith_class WHEN 'LIMESTONE' THEN {EVIDENCE.index('LIMESTONE')} WHEN 'MARL' THEN {EVIDENCE.index('MARL')} ELSE {EVIDENCE.index('MUDSTONE')} END AS cls
    FROM {{world_logs}} g JOIN {{area_filled}} s ON g.bgs_id = s.bgs_id LATERAL VIEW explode(sequence(0L, CAST(floor((g.base_m - g.top_m) * 2) AS BIGINT))) t AS k
    WHERE g.top_m + 0.25D + 0.5D * k < g.base_m AND g.lith_class <> 'UNKNOWN'"""


@query(_LOO_ROW.replace("{samples}", "{area_samples}") + f"""SELECT {LH}::DOUBLE AS lh, {LV}::DOUBLE AS lv, {_LOO_OUT}, coalesce(100 * (accuracy - baseline_accuracy) >= 5, false) AS gain_ok, coalesce(calibration >= 0.75, false) AS calibration_ok, n_sites >= 30 AS enough_sites,
    coalesce(100 * (accuracy - baseline_accuracy) >= 5, false) AND coalesce(calibration >= 0.75, false) AND n_sites >= 30 AS gates_passed, 'elevation' AS frame,
    (SELECT CAST(count(*) FILTER (stated) AS BIGINT) FROM {{area_filled}}) AS n_stated, (SELECT CAST(count(*) FILTER (NOT stated) AS BIGINT) FROM {{area_filled}}) AS n_estimated FROM t""")
def model_flow(f: Frames) -> DataFrame:
    s = flow.Settings(length_h=LH, length_v=LV)
    sites = cut(flow.model_sites(f.world_meta, f.world_sites, "gold:ags", AREA, LH))
    return rounded(flow.fitted_row(f.world_logs, sites, s), *_LOO_COLS)


@query("SELECT bgs_id, round(max(z) - min(z) + 0.5, 6) AS extent_m FROM {samples} GROUP BY bgs_id")
def sample_extent(f: Frames) -> DataFrame:
    return rounded(voxels.sample_extent(f.samples), "extent_m")


@query("SELECT floor(lo / 2.5) * 2.5 AS z0, ceil(greatest(hi, coalesce(top, hi)) / 2.5) * 2.5 AS z1, round(mean_gl, 6) AS mean_gl FROM (SELECT min(z) AS lo, max(z) AS hi FROM {samples}) a, (SELECT max(ground_level_m) AS top, avg(ground_level_m) AS mean_gl FROM {world_sites}) b")
def grid_bounds(f: Frames) -> DataFrame:
    return rounded(voxels.grid_bounds(f.samples, f.world_sites, 2.5), "mean_gl")


@query()
def crs_roundtrip(f: Frames) -> DataFrame:
    there = f.sites.withColumn("w", to_wgs84(F.col("easting"), F.col("northing")))
    back = there.withColumn("g", to_grid(F.col("w.lon"), F.col("w.lat")))
    return back.select("bgs_id", "w.lon", "w.lat", F.hypot(F.col("g.easting") - F.col("easting"), F.col("g.northing") - F.col("northing")).alias("error_m"))
