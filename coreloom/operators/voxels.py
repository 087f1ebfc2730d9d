"""The voxel grid: generation, lookup, visibility, histogram, and its compact JSON form.

A voxel is (i, j, k) with index i + nx * (j + ny * k). class_idx is a class, AIR above ground, or UNCONSTRAINED where
there is too little evidence; the last has entropy 1 and `constrained` false, never a class.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocab import AIR, EVIDENCE, UNCONSTRAINED, class_name
from ..sources import files
from ..sources.lines import carried, counted, file_lines
from .lineage import cut, shared_dir
from .spatial import MIN_EVIDENCE, kernel_surface, vote, weigh

SKIN = 1e-9
PEEL = 1e-6
#: Added to the extent of a site's samples; a fixed value, whatever the step.
EXTENT_EXTRA = 0.5


@dataclass(frozen=True)
class Grid:
    x0: float
    y0: float
    x1: float
    y1: float
    cell_xy: float
    cell_z: float
    z0: float
    z1: float

    @property
    def nx(self) -> int:
        return math.ceil((self.x1 - self.x0) / self.cell_xy)

    @property
    def ny(self) -> int:
        return math.ceil((self.y1 - self.y0) / self.cell_xy)

    @property
    def nz(self) -> int:
        return math.ceil((self.z1 - self.z0) / self.cell_z)

    def columns(self, spark: SparkSession) -> DataFrame:
        """qid, i, j, easting, northing of each column's centre."""
        rows = spark.range(self.nx * self.ny).withColumnRenamed("id", "qid")
        i, j = F.col("qid") % self.nx, F.floor(F.col("qid") / self.nx)
        return rows.select("qid", i.cast("int").alias("i"), j.cast("int").alias("j"), (self.x0 + (i + 0.5) * self.cell_xy).alias("easting"), (self.y0 + (j + 0.5) * self.cell_xy).alias("northing"))


def bake(grid: Grid, samples: DataFrame, sites: DataFrame, lh: float = 300.0, lv: float = 2.5, surface_length: float = 300.0, fallback: float | None = None) -> DataFrame:
    """i, j, k, idx, surface, class_idx, entropy, constrained of every voxel. The surface keeps its own length, whatever
    lengths the vote was tuned to."""
    spark = samples.sparkSession
    surface = kernel_surface(grid.columns(spark), sites, surface_length, fallback).select("qid", "i", "j", "easting", "northing", "surface")
    layers = F.explode(F.sequence(F.lit(0), F.lit(grid.nz - 1))).alias("k")
    voxels = surface.select(F.col("qid").alias("column"), "i", "j", F.col("easting").alias("x"), F.col("northing").alias("y"), "surface", layers)
    voxels = voxels.withColumns({
        "idx": F.col("column") + F.lit(grid.nx * grid.ny).cast("long") * F.col("k"), "z": grid.z0 + (F.col("k") + 0.5) * grid.cell_z,
        "below": grid.z0 + (F.col("k") + 1) * grid.cell_z <= F.col("surface") + SKIN,
    })
    asked = voxels.where("below").select(F.col("idx").alias("qid"), "x", "y", "z")
    voted = vote(weigh(asked, samples, [(lh, lv)])).where(F.col("evidence") >= MIN_EVIDENCE).select(F.col("qid").alias("idx"), "cls", F.col("entropy").alias("e"))
    out = voxels.join(voted, "idx", "left")
    return out.select(
        "i", "j", "k", "idx", "surface", F.when(~F.col("below"), AIR).otherwise(F.coalesce("cls", F.lit(UNCONSTRAINED))).alias("class_idx"),
        F.coalesce("e", F.lit(1.0)).alias("entropy"), F.col("e").isNotNull().alias("constrained"),
    )


def lookup(voxels: DataFrame, grid: Grid, points: DataFrame) -> DataFrame:
    """points (pid, x, y, z) with status (outside, air, unconstrained, class), lith_class, certainty, entropy, constrained,
    surface, and the voxel's centre and z range. The stored flag says what is constrained, not the rounded entropy; an
    unconstrained voxel has certainty 0, air none; outside all is null."""
    at = points.withColumns({
        "i": F.floor((F.col("x") - grid.x0) / grid.cell_xy).cast("int"), "j": F.floor((F.col("y") - grid.y0) / grid.cell_xy).cast("int"), "k": F.floor((F.col("z") - grid.z0) / grid.cell_z).cast("int"),
    })
    got = at.join(voxels.select("i", "j", "k", "class_idx", "entropy", "constrained", "surface"), ["i", "j", "k"], "left")
    c = F.col("class_idx")
    status = F.when(c.isNull(), "outside").when(c == AIR, "air").when(c == UNCONSTRAINED, "unconstrained").otherwise("class")
    known, solid = status == "class", status.isin("class", "unconstrained")
    return got.select(
        "pid", status.alias("status"), F.when(known, class_name(c)).alias("lith_class"), F.when(known, F.round(1 - F.col("entropy"), 2)).when(solid, F.lit(0.0)).alias("certainty"),
        F.when(solid, F.col("entropy")).alias("entropy"), F.coalesce(F.col("constrained"), F.lit(False)).alias("constrained"), "surface",
        F.when(solid, grid.x0 + (F.col("i") + 0.5) * grid.cell_xy).alias("voxel_easting"), F.when(solid, grid.y0 + (F.col("j") + 0.5) * grid.cell_xy).alias("voxel_northing"),
        F.when(solid, grid.z0 + F.col("k") * grid.cell_z).alias("z_base"), F.when(solid, grid.z0 + (F.col("k") + 1) * grid.cell_z).alias("z_top"),
    )


def visible(voxels: DataFrame, grid: Grid, peel: float, max_entropy: float) -> DataFrame:
    """Voxels below ground whose top isn't above `peel` and whose entropy isn't above `max_entropy`."""
    top = grid.z0 + (F.col("k") + 1) * grid.cell_z
    return voxels.where((F.col("class_idx") != AIR) & (top <= peel + PEEL) & (F.col("entropy") <= max_entropy))


def histogram(voxels: DataFrame) -> DataFrame:
    """class_idx, n of the classes that occur."""
    return voxels.groupBy("class_idx").agg(F.count(F.lit(1)).alias("n"))


def sample_extent(samples: DataFrame) -> DataFrame:
    """bgs_id, extent_m: how far a site's samples reach, plus EXTENT_EXTRA."""
    return samples.groupBy("bgs_id").agg((F.max("z") - F.min("z") + EXTENT_EXTRA).alias("extent_m"))


def grid_bounds(samples: DataFrame, sites: DataFrame, cell_z: float) -> DataFrame:
    """One row: z0 and z1 in whole cells around all samples and ground levels, and mean_gl."""
    z = samples.agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    gl = sites.agg(F.max("ground_level_m").alias("top"), F.avg("ground_level_m").alias("mean_gl"))
    rows = z.join(F.broadcast(gl), F.lit(True))
    return rows.select((F.floor(F.col("lo") / cell_z) * cell_z).alias("z0"), (F.ceil(F.greatest("hi", F.coalesce("top", "hi")) / cell_z) * cell_z).alias("z1"), "mean_gl")


def morton(i: Column, j: Column, k: Column) -> Column:
    """Place on the curve of interleaved bits of three indices below 2^20."""
    def spread(c: Column) -> Column:
        v = c.cast("long")
        for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return spread(i).bitwiseOR(F.shiftleft(spread(j), 1)).bitwiseOR(F.shiftleft(spread(k), 2))


def store(voxels: DataFrame, grid: Grid, path: str, block_bytes: int = 1 << 20) -> None:
    """Writes baked voxels as a table at path, in the order of a curve through the grid: files and their row groups are
    small boxes of it, so that what looks a place up reads few. The grid is written beside it."""
    spark = voxels.sparkSession
    laid = voxels.withColumn("at", morton(F.col("i"), F.col("j"), F.col("k")))
    ordered = laid.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "at").sortWithinPartitions("at")
    ordered.write.mode("overwrite").option("parquet.block.size", block_bytes).option("parquet.page.size", 1 << 16).parquet(f"{path}/voxels")
    files.create(spark, f"{path}/grid.json", json.dumps(asdict(grid)))


def stored(spark: SparkSession, path: str) -> tuple[Grid, DataFrame]:
    """(grid, voxels) of a table that `store` has written."""
    return Grid(**json.loads(files.read_text(spark, f"{path}/grid.json"))), spark.read.parquet(f"{path}/voxels")


def at_point(voxels: DataFrame, grid: Grid, x: float, y: float, z: float) -> DataFrame:
    """As lookup, of one point; the stored table's statistics leave a row group or so to read."""
    point = voxels.sparkSession.createDataFrame([(0, x, y, z)], "pid long, x double, y double, z double")
    at = [math.floor((v - o) / c) for v, o, c in ((x, grid.x0, grid.cell_xy), (y, grid.y0, grid.cell_xy), (z, grid.z0, grid.cell_z))]
    inside = all(0 <= a < n for a, n in zip(at, (grid.nx, grid.ny, grid.nz)))
    here = sum((a >> b & 1) << 3 * b + d for d, a in enumerate(at) for b in range(20)) if inside else -1
    return lookup(voxels.where(F.col("at") == here), grid, point)


def layers(voxels: DataFrame) -> DataFrame:
    """k, class_idx and entropy (arrays in order of idx, rounded as the viewer has them) and the counts of each layer."""
    one = F.struct("idx", "class_idx", F.round("entropy", 2).alias("e"))
    rows = voxels.groupBy("k").agg(F.array_sort(F.collect_list(one)).alias("v"), F.count_if("constrained").alias("constrained"), F.count_if(F.col("class_idx") != AIR).alias("below"))
    return rows.select("k", F.col("v.class_idx").alias("class_idx"), F.col("v.e").alias("entropy"), "constrained", "below")


#: Values of a line of the JSON form.
LINE = 4096


def _array(values: DataFrame, path: str) -> list[str]:
    """Writes the column v of values (idx, v) in order of idx (from 0, without gaps), LINE values a line, with commas between; the files, in
    order. A line is the longest row of it."""
    spark = values.sparkSession
    line = F.floor(F.col("idx") / LINE).alias("line")
    rows = values.groupBy(line).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.col("v").cast("string").alias("v")))), lambda x: x["v"]), ",").alias("value"))
    text = rows.select("line", F.when(F.col("line") > 0, F.concat(F.lit(","), F.col("value"))).otherwise(F.col("value")).alias("value"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text.repartitionByRange(parts, "line").sortWithinPartitions("line").select("value").write.text(path)
    return [f"{path}/{n}" for n in files.names(spark, path) if n.startswith("part-")]


def export_json(voxels: DataFrame, grid: Grid, path: str, name: str = "model", frame: str = "elevation", params: dict | None = None, **more: object) -> None:
    """The compact JSON form for a viewer, one file. Executors write the arrays as lines; their files are put end to end,
    byte by byte. more: further fields."""
    spark = voxels.sparkSession
    counts = voxels.agg(F.count_if("constrained"), F.count_if(F.col("class_idx") != AIR)).first()
    head = {
        "synthetic": False, "name": name, "frame": frame, "origin_bng": [grid.x0, grid.y0], "cell_xy": grid.cell_xy, "cell_z": grid.cell_z, "nx": grid.nx, "ny": grid.ny, "nz": grid.nz, "z0": grid.z0,
        "classes": list(EVIDENCE), "constrained_voxels": counts[0], "below_ground_voxels": counts[1], "params": params or {}, **more,
    }
    scratch = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    arrays = {"surface": voxels.where("k = 0").select("idx", F.round("surface", 1).alias("v")), "class_idx": voxels.select("idx", F.col("class_idx").alias("v")), "entropy": voxels.select("idx", F.round("entropy", 2).alias("v"))}
    parts: list[str | list[str]] = [json.dumps(head, separators=(",", ":"))[:-1]]
    for field, values in arrays.items():
        parts += [f',"{field}":[', _array(values, f"{scratch}/{field}"), "]"]
    files.create(spark, path, *parts, "}\n")
    files.delete(spark, scratch)


def preview(spark: SparkSession, grid: Grid, seed: int = 1) -> DataFrame:
    """A made-up grid in the form of bake, for trying a viewer: layers that dip and wave under a rolling surface, and less
    certain with distance from a few made-up sites."""
    def dice(*salt: object) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), *(s if isinstance(s, Column) else F.lit(s) for s in salt)), F.lit(1000)) / 1000.0

    order = [EVIDENCE.index(c) for c in ("TOPSOIL", "CLAY", "SAND", "MARL", "LIMESTONE", "MUDSTONE")]
    u, v = F.col("i") / F.lit(float(grid.nx)), F.col("j") / F.lit(float(grid.ny))
    height = grid.z1 - grid.z0
    columns = grid.columns(spark).select("qid", "i", "j", (grid.z0 + height * (0.75 + 0.12 * F.sin(3 * u + 2 * dice("a")) * F.cos(2 * v))).alias("surface"), (1.5 * F.sin(5 * u) + 4 * v).alias("dip"))
    rows = columns.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(grid.nz - 1))))
    top = grid.z0 + (F.col("k") + 1) * grid.cell_z
    place = F.least(F.greatest(F.floor((F.col("surface") - top + F.col("dip")) / F.lit(height / len(order) / 1.5)), F.lit(0)), F.lit(len(order) - 1)).cast("int")
    far = F.least(*(F.hypot(u - dice("x", n), v - dice("y", n)) for n in range(6)))
    below, known = top <= F.col("surface") + SKIN, far < 0.35
    return rows.select(
        "i", "j", "k", (F.col("qid") + F.lit(grid.nx * grid.ny).cast("long") * F.col("k")).alias("idx"), "surface",
        F.when(~below, AIR).when(~known, UNCONSTRAINED).otherwise(F.element_at(F.lit(order).cast("array<int>"), place + 1)).alias("class_idx"),
        F.when(below & known, F.round(F.least(far * 2 + 0.1 * dice("e", F.col("qid"), F.col("k")), F.lit(0.99)), 4)).otherwise(1.0).alias("entropy"), (below & known).alias("constrained"),
    )


def decode(stacked: DataFrame, grid: Grid) -> DataFrame:
    """idx, i, j, k, class_idx, entropy of layers; a layer whose arrays don't have the grid's size is an error."""
    n = grid.nx * grid.ny
    bad = F.raise_error(F.lit("array lengths differ from the grid")).cast("array<int>")
    rows = stacked.withColumn("class_idx", F.when((F.size("class_idx") == n) & (F.size("entropy") == n), F.col("class_idx")).otherwise(bad))
    at = rows.select("k", F.posexplode(F.arrays_zip("class_idx", "entropy")).alias("at", "v"))
    return at.select((F.col("at") + F.lit(n).cast("long") * F.col("k")).alias("idx"), (F.col("at") % grid.nx).alias("i"), F.floor(F.col("at") / grid.nx).cast("int").alias("j"), "k", "v.class_idx", "v.entropy")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """idx, i, j, k, class_idx, entropy of a grid in JSON form; arrays of the wrong length are an error.

    The file is read as the texts between its commas, in as many tasks as it has splits; a text that opens an array names
    the field of those after it. So no task holds an array, whether it stands on one line or on many.
    """
    texts = file_lines(spark, path, ",")
    opened = F.nullif(F.regexp_extract("line", r'"(\w+)"\s*:\s*\[', 1), F.lit(""))
    named = carried(texts.withColumn("one", F.regexp_extract("line", r'"(\w+)"\s*:\s*[-\d{\[]', 1)), "at", field=opened)
    number = F.regexp_extract("line", r'(-?\d[-+.0-9eE]*)[\s\]}]*$', 1).try_cast("double")
    size = {r.one: int(r.v) for r in named.where(F.col("one").isin("nx", "ny", "nz")).select("one", number.alias("v")).collect()}
    n, layer = size["nx"] * size["ny"] * size["nz"], size["nx"] * size["ny"]

    def values(field: str) -> DataFrame:
        own = (F.col("field") == field) & number.isNotNull() & ((F.col("one") == "") | (F.col("one") == field))
        rows = counted(named.where(own).select("path", "chunk", "at", number.alias(field)), "at", "idx", F.lit(1).cast("long"))
        return cut(rows.select((F.col("idx") - 1).alias("idx"), field))

    found = {f: values(f) for f in ("class_idx", "entropy", "surface")}
    if [found[f].count() for f in found] != [n, n, layer]:
        raise ValueError("array lengths differ from the grid")
    at = F.col("idx")
    rows = found["class_idx"].join(found["entropy"], "idx")
    return rows.select("idx", (at % size["nx"]).cast("int").alias("i"), (F.floor(at / size["nx"]) % size["ny"]).cast("int").alias("j"), F.floor(at / layer).cast("int").alias("k"), F.col("class_idx").cast("int").alias("class_idx"), "entropy")
