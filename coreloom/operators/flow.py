"""The model from stored logs to gates, voxels and a run row."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import BBox, in_bbox
from . import corpus, intervals, spatial, voxels
from .lineage import cut


@dataclass(frozen=True)
class Settings:
    length_h: float = 300.0
    length_v: float = 2.5
    min_evidence: float = spatial.MIN_EVIDENCE
    cell_xy: float = 125.0
    cell_z: float = 2.5
    sample_step_m: float = 0.5
    min_gain_pp: float = 5.0
    min_calibration: float = 0.75
    min_sites: int = 30


@dataclass(frozen=True)
class Fitted:
    """sites and samples of the model, one row of metrics with frame and gates, and the grid and its voxels where it was
    baked (None elsewhere)."""

    sites: DataFrame
    samples: DataFrame
    metrics: DataFrame
    grid: voxels.Grid | None = None
    baked: DataFrame | None = None

    def publish(self, source: str, model_path: str, runs_path: str, name: str = "model") -> None:
        """Writes the voxels, if there are any, as the viewer's file, with whether the gates were passed and the metrics of the
        validation in it, and appends the run's row to the table of runs."""
        row = self.metrics.first().asDict()
        if self.baked is not None:
            said = {k: v for k, v in row.items() if k not in ("frame", "gates_passed")}
            lengths = {"length_h": row["lh"], "length_v": row["lv"]}
            voxels.export_json(self.baked, self.grid, model_path, name, row["frame"], lengths, gates_passed=row["gates_passed"], validation=said)
        corpus.append_rows(self.run_rows(source, model_path if self.baked is not None else None), runs_path, at="ran_at")

    def run_rows(self, source: str, model_path: str | None = None) -> DataFrame:
        return corpus.run_rows(self.metrics.withColumn("model_path", F.lit(model_path).cast("string")), source)


def model_sites(meta: DataFrame, boreholes: DataFrame, source: str, box: BBox, length: float) -> DataFrame:
    """The source's sites inside the box, with ground levels estimated where they are missing; if any level is stated,
    sites that still have none go. stated says which were."""
    sites = corpus.load_sites(meta, boreholes, source).where(in_bbox(F.col("easting"), F.col("northing"), box))
    stated = sites.withColumn("stated", F.col("ground_level_m").isNotNull())
    return intervals.eligible_sites(spatial.estimate_ground_levels(stated, length))


def model_samples(logs: DataFrame, sites: DataFrame, step: float) -> DataFrame:
    """Labelled points with qid, their key."""
    points = intervals.discretise(logs, sites, step)
    return points.withColumn("qid", F.struct("bgs_id", "ord"))


def grid_over(samples: DataFrame, sites: DataFrame, box: BBox, s: Settings, frame: str) -> voxels.Grid:
    """The grid of the box: from two cells below the deepest sample to a cell above the highest ground level, or to 0
    in the depth frame."""
    lo = samples.agg(F.min("z")).first()[0]
    top = sites.agg(F.max("ground_level_m")).first()[0] + s.cell_z if frame == "elevation" else 0.0
    return voxels.Grid(*box, s.cell_xy, s.cell_z, math.floor((lo - 2 * s.cell_z) / s.cell_z) * s.cell_z, top)


def fitted_row(logs: DataFrame, sites: DataFrame, s: Settings, tuned: bool = False, samples: DataFrame | None = None) -> DataFrame:
    """One row: lengths, metrics of leaving one site out, gates, frame, and how many ground levels are stated and
    estimated."""
    samples = cut(model_samples(logs, sites, s.sample_step_m)) if samples is None else samples
    result = spatial.tune(samples) if tuned else spatial.leave_one_out(samples, [(s.length_h, s.length_v)], s.min_evidence)
    gated = spatial.model_gates(result, s.min_gain_pp, s.min_calibration, s.min_sites)
    levels = sites.agg(F.count_if("stated").alias("n_stated"), F.count_if("gl_estimated").alias("n_estimated"))
    return gated.join(F.broadcast(intervals.frame(sites)), F.lit(True)).join(F.broadcast(levels), F.lit(True))  # a row each


def fit(logs: DataFrame, meta: DataFrame, boreholes: DataFrame, source: str, box: BBox, s: Settings = Settings(), tuned: bool = False, bake: bool = True, force: bool = False) -> Fitted:
    """Loads the source's logs and sites in the box, validates the kernel model by leaving one site out (or tunes its
    lengths), applies the gates, and bakes voxels if they pass or if forced. An area without samples is an error. The
    estimates of ground levels and the surface keep the configured length, whatever lengths are tuned to."""
    sites = cut(model_sites(meta, boreholes, source, box, s.length_h))
    samples = cut(model_samples(logs.where(F.col("source") == source), sites, s.sample_step_m))
    if samples.isEmpty():
        raise ValueError(f"no logs of {source} with a position inside {box}")
    metrics = cut(fitted_row(logs, sites, s, tuned, samples))
    row = metrics.first()
    if not bake or not (row.gates_passed or force):
        return Fitted(sites, samples, metrics)
    grid = grid_over(samples, sites, box, s, row.frame)
    return Fitted(sites, samples, metrics, grid, voxels.bake(grid, samples, sites, row.lh, row.lv, s.length_h, fallback=0.0 if row.frame == "depth" else None))
