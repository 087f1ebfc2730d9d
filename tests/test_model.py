import json
import math
import random
import threading
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from coreloom.functions.geo import envelope, in_bbox, to_grid, to_wgs84
from coreloom.functions.vocab import AIR, EVIDENCE, UNCONSTRAINED
from coreloom.operators import corpus, flow, spatial, tables, tiles, voxels

LIME, MARL, MUD = (EVIDENCE.index(c) for c in ("LIMESTONE", "MARL", "MUDSTONE"))


@pytest.fixture(scope="module")
def world(spark):
    """Flat layers under a sloping surface, seen by 40 sites."""
    rng, sites, samples = random.Random(4), [], []
    for i in range(40):
        x, y = 382500 + rng.random() * 5000, 202500 + rng.random() * 5000
        gl, depth = 100 - 0.002 * (x - 382500), 15 + rng.random() * 25
        sites.append((i, x, y, gl))
        for k in range(int(depth / 0.5)):
            z = gl - 0.25 - 0.5 * k
            samples.append((i * 1000 + k, i, k, x, y, z, LIME if z > 85 else MARL if z > 80 else MUD))
    s = spark.createDataFrame(samples, "qid long, bgs_id long, ord long, x double, y double, z double, cls int").repartition(4).persist()
    return spark.createDataFrame(sites, "bgs_id long, easting double, northing double, ground_level_m double").persist(), s, samples


def brute_loo(samples, lh, lv):
    correct = constrained = 0
    for q in samples:
        w = {}
        for s in samples:
            d2 = ((q[3] - s[3]) / lh) ** 2 + ((q[4] - s[4]) / lh) ** 2 + ((q[5] - s[5]) / lv) ** 2
            if s[1] != q[1] and d2 <= 9:
                w[s[6]] = w.get(s[6], 0) + math.exp(-d2)
        if sum(w.values()) >= 0.05:
            constrained += 1
            correct += min(w, key=lambda c: (-w[c], c)) == q[6]
    return correct / len(samples), constrained / len(samples)


def test_layers_are_found_again(world):
    row = spatial.leave_one_out(world[1], [(600.0, 2.5)]).first()
    assert row.accuracy > 0.9 and row.gain_pp > 5 and row.calibration > 0.9
    assert spatial.model_gates(spatial.leave_one_out(world[1], [(600.0, 2.5)])).first().gates_passed


def test_leave_one_out_and_tune_against_brute_force(world):
    grid_h, grid_v = (300.0, 600.0), (2.5, 5.0)
    few = [s for s in world[2] if s[1] < 14]
    df = world[1].where("bgs_id < 14").persist()
    want = {(h, v): brute_loo(few, h, v) for h in grid_h for v in grid_v}
    for r in spatial.leave_one_out(df, list(want)).collect():
        assert (r.accuracy, r.constrained_fraction) == pytest.approx(want[r.lh, r.lv])
    best = spatial.tune(df, grid_h, grid_v).first()
    assert (best.lh, best.lv) == max(want, key=lambda p: want[p][0])  # the first of equals


def test_nearest_other_reaches_isolated_points(spark):
    rows = [(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 90_000.0, 0.0), (4, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "bgs_id long, x double, y double")
    assert {r.bgs_id: r.nearest for r in spatial.nearest_other(df, 2).collect()} == {1: 4, 2: 1, 3: 2, 4: 1}
    assert spatial.nearest_other(df.where("bgs_id = 1")).count() == 0


def test_ground_levels(spark):
    rows = [(1, 0.0, 0.0, 10.0), (2, 100.0, 0.0, None), (3, 1e6, 0.0, None)]
    df = spark.createDataFrame(rows, "bgs_id long, easting double, northing double, ground_level_m double")
    got = {r.bgs_id: (r.ground_level_m, r.gl_estimated) for r in spatial.estimate_ground_levels(df).collect()}
    assert got == {1: (10.0, False), 2: (10.0, True), 3: (None, False)}
    column = spark.createDataFrame([(0, 5e6, 0.0)], "qid long, easting double, northing double")
    assert spatial.kernel_surface(column, df).first().surface == 10.0
    assert spatial.kernel_surface(column, df.where("bgs_id = 3"), fallback=7.0).first().surface == 7.0
    with pytest.raises(Exception, match="no ground levels"):
        spatial.kernel_surface(column, df.where("bgs_id = 3")).collect()


def test_baked_grid(spark, world, tmp_path):
    grid = voxels.Grid(382500.0, 202500.0, 387500.0, 207500.0, 250.0, 5.0, 55.0, 105.0)
    assert (grid.nx, grid.ny, grid.nz) == (20, 20, 10)
    baked = voxels.bake(grid, world[1], world[0], 600.0, 2.5).persist()
    rows = baked.collect()
    assert len(rows) == 4000 and len({r.idx for r in rows}) == 4000
    assert all(r.entropy == 1.0 and not r.constrained for r in rows if r.class_idx in (AIR, UNCONSTRAINED))
    assert all(r.idx == r.i + 20 * (r.j + 20 * r.k) for r in rows)
    points = spark.createDataFrame([(1, 385000.0, 205000.0, 87.0), (2, 385000.0, 205000.0, 104.9), (3, 100.0, 100.0, 90.0)], "pid long, x double, y double, z double")
    got = {r.pid: (r.status, r.lith_class) for r in voxels.lookup(baked, grid, points).collect()}
    assert got == {1: ("class", "LIMESTONE"), 2: ("air", None), 3: ("outside", None)}
    path = str(tmp_path / "m.json")
    voxels.export_json(baked, grid, path, gates_passed=True)
    body = json.loads((tmp_path / "m.json").read_text())
    by_idx = sorted(rows, key=lambda r: r.idx)
    assert body["class_idx"] == [r.class_idx for r in by_idx] and body["entropy"] == [round(r.entropy, 2) for r in by_idx] and len(body["surface"]) == 400
    assert body["gates_passed"] is True and body["below_ground_voxels"] == sum(r.class_idx != AIR for r in rows) and body["constrained_voxels"] == sum(r.constrained for r in rows)
    back = {r.idx: (r.i, r.j, r.k, r.class_idx, r.entropy) for r in voxels.read_json(spark, path).collect()}
    assert back == {r.idx: (r.i, r.j, r.k, r.class_idx, round(r.entropy, 2)) for r in rows}
    (tmp_path / "line.json").write_text(json.dumps(body, separators=(", ", " : ")))  # all on one line
    assert {r.idx: (r.i, r.j, r.k, r.class_idx, r.entropy) for r in voxels.read_json(spark, str(tmp_path / "line.json")).collect()} == back
    (tmp_path / "bad.json").write_text(json.dumps(body | {"entropy": body["entropy"][1:]}))
    with pytest.raises(ValueError, match="array lengths"):
        voxels.read_json(spark, str(tmp_path / "bad.json"))


def test_voxel_store(spark, world, tmp_path):
    """Kept in the order of a curve: a lookup reads the boxes about its points, and needs no kernel."""
    grid, path = voxels.Grid(0.0, 0.0, 6400.0, 6400.0, 100.0, 5.0, 0.0, 80.0), str(tmp_path / "store")
    made = voxels.preview(spark, grid, seed=2)
    voxels.store(made, grid, path, block_bytes=1 << 14)
    again, table = voxels.stored(spark, path)
    assert again == grid and table.count() == grid.nx * grid.ny * grid.nz
    rng = random.Random(1)
    rows = [(n, rng.uniform(-50, 6500), rng.uniform(0, 6400), rng.uniform(0, 79)) for n in range(60)] + [(60, -1.0, 5.0, 5.0), (61, 5.0, 5.0, 80.0)]
    points = spark.createDataFrame(rows, "pid long, x double, y double, z double")
    want = sorted(voxels.lookup(made, grid, points).collect())
    assert sorted(voxels.lookup(table, grid, points).collect()) == want and {r.status for r in want} >= {"outside", "air", "class"}
    for n, x, y, z in rows[:3]:
        found = voxels.at_point(table, grid, x, y, z)
        assert [tuple(r)[1:] for r in found.collect()] == [tuple(r)[1:] for r in want if r.pid == n]
    assert "PushedFilters: [IsNotNull(at), EqualTo(at," in found._jdf.queryExecution().toString()
    codes = [r.at for r in table.select("at").collect()]
    assert len(set(codes)) == len(codes)
    import pyarrow.parquet as pq
    groups = [pq.ParquetFile(f).metadata.num_row_groups for f in (tmp_path / "store" / "voxels").glob("*.parquet")]
    assert sum(groups) > 8


def test_dense_places_are_even_units(spark):
    """A third of all places in one spot: no unit has more rows of a side than its block, and sums are exact."""
    rng = random.Random(2)
    known = [(0.5 * rng.random(), 0.5 * rng.random(), float(i % 7)) for i in range(1500)] + [(rng.uniform(0, 5000), rng.uniform(0, 5000), float(i % 5)) for i in range(3000)] + [(7.0, 7.0, 2.0)] * 500
    asked = [(i, x, y) for i, (x, y, _) in enumerate(known[::9])]
    k = spark.createDataFrame(known, "easting double, northing double, v double")
    q = spark.createDataFrame(asked, "qid long, easting double, northing double")
    got = {r.qid: (r.weight, r["mean"]) for r in spatial.kernel_mean(q, k, 100.0, "v").collect()}
    for i, x, y in asked[::5]:
        w = [(math.exp(-d2), v) for a, b, v in known if (d2 := ((x - a) / 100) ** 2 + ((y - b) / 100) ** 2) <= 9]
        assert got[i] == pytest.approx((sum(a for a, _ in w), sum(a * v for a, v in w) / sum(a for a, _ in w)))
    places = lambda df: df.select(F.col("easting").alias("x"), F.col("northing").alias("y")).distinct()
    sizes = tiles.in_units(places(q), places(k), 300.0, lambda a, b: pd.DataFrame({"n": [len(a)], "m": [len(b)]}), "n int, m int", block=64).collect()
    assert max(r.n for r in sizes) <= 3 * 64 and max(r.m for r in sizes) <= 3 * 64


def test_nearest_other_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.uniform(0, 1000), rng.uniform(0, 50)) for i in range(600)] + [(1000 + i, 5.0, 5.0) for i in range(300)] + [(2000 + i, float(i % 20), float(i // 20)) for i in range(200)] + [(5000, 1e6, 1e6)]
    want = {i: min(((x - a) ** 2 + (y - b) ** 2, j) for j, a, b in rows if j != i)[1] for i, x, y in rows}
    df = spark.createDataFrame(rows, "bgs_id long, x double, y double")
    for tile in (20, 5000):
        assert {r.bgs_id: r.nearest for r in tiles.nearest_other(df, tile).collect()} == want
    assert tiles.nearest_other(df.limit(0)).count() == 0


def test_baseline_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for b in range(40):
        x, y, top = rng.uniform(0, 500), rng.uniform(0, 500), rng.choice([10.0, 12.5, 40.0])
        rows += [(b * 1000 + k, b, k, x, y, top - 0.5 * (k // 2) if b % 3 else top + 0.7 * k, rng.randrange(4)) for k in range(rng.randint(1, 30))]
    want, place = {}, {r[1]: r[3:5] for r in rows}
    for q, b, _, x, y, z, _ in rows:
        other = min(((x - px) ** 2 + (y - py) ** 2, j) for j, (px, py) in place.items() if j != b)[1]
        dz, _, cls = min((abs(z - r[5]), r[2], r[6]) for r in rows if r[1] == other)
        if dz <= 3:
            want[q] = cls
    df = spark.createDataFrame(rows, "qid long, bgs_id long, ord long, x double, y double, z double, cls int").repartition(5)
    assert {r.qid: r.cls for r in spatial.baseline(df).collect()} == want


def test_grid_transform(spark):
    rows = spark.createDataFrame([(382930.0, 204720.0), (651409.903, 313177.270)], "e double, n double")
    got = rows.select("e", "n", to_wgs84(F.col("e"), F.col("n")).alias("w")).select("e", "n", "w", to_grid(F.col("w.lon"), F.col("w.lat")).alias("g")).collect()
    for r in got:
        assert math.hypot(r.g.easting - r.e, r.g.northing - r.n) < 0.01
    assert got[1].w.lon == pytest.approx(1.716, abs=1e-3) and got[1].w.lat == pytest.approx(52.658, abs=1e-3)
    box = rows.limit(1).select(envelope(F.lit(0.0), F.lit(0.0), F.lit(5000.0), F.lit(5000.0)).alias("b")).first().b
    assert box.west < box.east and box.south < box.north
    assert rows.select(in_bbox(F.col("e"), F.col("n"), (382930.0, 0.0, 382930.0, 204720.0)).alias("i")).first().i


def test_corpus(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "bgs_id long, name string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "bgs_id long, name string, o int")
    assert {tuple(r) for r in corpus.upsert(old, new, "bgs_id", "o").collect()} == {(1, "a"), (2, "y"), (3, "z")}
    logs = spark.createDataFrame([(1, "s", 0), (1, "t", 0)], "bgs_id long, source string, seq int")
    gone = corpus.replace_logs(logs, logs.limit(0), loaded=spark.createDataFrame([(1, "s")], "bgs_id long, source string"))
    assert [tuple(r) for r in gone.collect()] == [(1, "t", 0)]


def test_placeholder_ids(spark):
    holes = [f"BH{i}" for i in range(500)]
    got = {r.h: r.i for r in spark.createDataFrame([(h,) for h in holes], "h string").select("h", corpus.placeholder_id(F.col("h")).alias("i")).collect()}
    assert got == {h: -(zlib.crc32(h.encode()) % 2_000_000_000 + 1) for h in holes}
    df = spark.createDataFrame([(h,) for h in [*holes, "BH1"]], "hole string")
    assert corpus.id_collisions(df).count() == 0
    assert zlib.crc32(b"plumless") == zlib.crc32(b"buckeroo")
    both = df.union(spark.createDataFrame([("plumless",), ("buckeroo",), ("plumless",)], "hole string"))
    assert [tuple(r) for r in corpus.id_collisions(both).collect()] == [(-(zlib.crc32(b"plumless") % 2_000_000_000 + 1), 2)]


def test_upsert_of_unordered_rows_and_null_keys(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "bgs_id long, name string")
    new = spark.createDataFrame([(1, "x", None), (2, "y", None), (2, "z", 0), (None, "n", 1)], "bgs_id long, name string, o int")
    assert {tuple(r) for r in corpus.upsert(old, new, "bgs_id", "o").collect()} == {(1, "x"), (2, "z")}


def test_loaded_logs_and_runs(spark, tmp_path):
    logs = spark.createDataFrame([(1, "s", 0), (1, "t", 0), (2, "s", 0)], "bgs_id long, source string, seq int")
    meta = spark.createDataFrame([(1, "s", 5.0), (2, "s", 6.0)], "bgs_id long, source string, ground_level_m double")
    new, said = spark.createDataFrame([(1, "s", 7)], logs.schema), spark.createDataFrame([(1, "s", 9.0), (2, "s", None)], meta.schema)
    i, m = corpus.store_logs(logs, meta, new, said)
    assert sorted(tuple(r) for r in i.collect()) == [(1, "s", 7), (1, "t", 0)] and {tuple(r) for r in m.collect()} == {(1, "s", 9.0), (2, "s", None)}
    path = str(tmp_path / "runs")
    for n in (3, 4):
        corpus.append_rows(corpus.run_rows(spark.createDataFrame([(n,)], "n_gold int"), "extract:x"), path, at="ran_at")
    runs = spark.read.parquet(path)
    assert runs.count() == 2 and all(len(r.run_id) == 16 and r.source == "extract:x" for r in runs.collect())
    row = corpus.pipeline_status(spark.range(1).select(F.lit(1).alias("boreholes")), runs, runs.limit(0)).first()
    assert (row.boreholes, row.eval_n_gold, row.model_n_gold) == (1, 4, None)


def test_swap_in(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    for n in (3, 5):
        corpus.swap_in(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    rename = corpus._rename
    monkeypatch.setattr(corpus, "_rename", lambda fs, a, b: not str(a).endswith("_new") and rename(fs, a, b))
    with pytest.raises(OSError, match="can't be replaced"):
        corpus.swap_in(spark.range(9), path)
    assert spark.read.parquet(path).count() == 5
    monkeypatch.setattr(corpus, "_rename", rename)
    (tmp_path / "t").rename(tmp_path / "t_old")  # as a driver lost between the moves leaves it
    corpus.swap_in(spark.range(2), path)
    assert spark.read.parquet(path).count() == 2 and not (tmp_path / "t_old").exists()


def test_versioned_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    t = tables.Table(spark, path, part="source")
    with pytest.raises(FileNotFoundError):
        t.read()
    rows = lambda *r: spark.createDataFrame(r, "id long, source string")
    t.replace(rows((1, "a"), (2, "b"), (3, None)))
    old = t.read()
    parts = t.manifest()["parts"]
    t.replace(rows((7, "b"), (8, "c")))
    assert {tuple(r) for r in t.read().collect()} == {(1, "a"), (3, None), (7, "b"), (8, "c")}
    assert {tuple(r) for r in old.collect()} == {(1, "a"), (2, "b"), (3, None)}  # a reader goes on with its version
    assert t.manifest()["parts"]["a"] == parts["a"]  # its rows weren't rewritten
    t.replace(rows((9, "c")), also=("a",))
    assert {tuple(r) for r in t.read().collect()} == {(3, None), (7, "b"), (9, "c")}
    t.append(rows((10, "z")))
    assert t.read().count() == 4 and t.read(1).count() == 3
    before = t.manifest()
    t.append(rows((11, "z")))
    with pytest.raises(RuntimeError, match="changed meanwhile"):
        t._commit(before, t.read().schema, before["parts"])  # what another writer began with
    t.vacuum(keep=1)
    assert len(t.versions()) == 1 and t.read().count() == 5 and len(list((tmp_path / "t" / "data").iterdir())) == len(t.manifest()["parts"])


def test_readers_meet_a_table_at_any_time(spark, tmp_path):
    t, seen, stop = tables.Table(spark, str(tmp_path / "t")), [], threading.Event()
    t.replace(spark.range(1))

    def read():
        while not stop.is_set():
            seen.append(t.read().count())

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(2, 22):
        t.replace(spark.range(n))
    stop.set()
    reader.join()
    assert seen and seen == sorted(seen) and set(seen) <= set(range(1, 22)) and t.read().count() == 21


def test_model_flow_from_stored_logs(spark, world, tmp_path):
    """The flat world as logs and meta rows: validated, gated, baked, and a run row; once more in the depth frame."""
    logs, meta = [], []
    for i, x, y, gl in (tuple(r) for r in world[0].collect()):
        depth = 15 + (i * 7) % 25
        tops = [0.0, gl - 85, gl - 80]
        for seq, (a, z, c) in enumerate(zip(tops, [*tops[1:], depth], ("LIMESTONE", "MARL", "MUDSTONE"))):
            if z > max(a, 0):
                logs.append((i, "gold:ags", seq, max(a, 0.0), float(z), c))
        meta.append((i, "gold:ags", x, y, None if i == 3 else gl))
    logs = spark.createDataFrame(logs, "bgs_id long, source string, seq long, top_m double, base_m double, lith_class string")
    meta = spark.createDataFrame([*meta, (99, "gold:ags", 0.0, 0.0, 1.0)], "bgs_id long, source string, easting double, northing double, ground_level_m double")
    none = spark.createDataFrame([], "bgs_id long, easting double, northing double")
    box, s = (382500.0, 202500.0, 387500.0, 207500.0), flow.Settings(length_h=600.0, cell_xy=500.0, cell_z=5.0)
    got = flow.fit(logs, meta, none, "gold:ags", box, s)
    row = got.metrics.first()
    assert row.accuracy > 0.9 and row.gain_pp > 5 and row.calibration > 0.9 and row.gates_passed and row.frame == "elevation"
    assert (row.n_sites, row.n_stated, row.n_estimated) == (40, 39, 1)
    assert (got.grid.nx, got.grid.ny) == (10, 10) and got.baked.count() == 100 * got.grid.nz
    got.publish("gold:ags", str(tmp_path / "m.json"), str(tmp_path / "runs"), "Flat world")
    body = json.loads((tmp_path / "m.json").read_text())
    assert body["gates_passed"] is True and body["validation"]["accuracy"] == row.accuracy and body["frame"] == "elevation" and body["name"] == "Flat world" and len(body["class_idx"]) == 100 * got.grid.nz
    kept = spark.read.parquet(str(tmp_path / "runs")).collect()
    assert [(r.source, r.model_path, r.gates_passed) for r in kept] == [("gold:ags", str(tmp_path / "m.json"), True)]
    run = got.run_rows("gold:ags", "m.json").first()
    assert run.source == "gold:ags" and run.model_path == "m.json" and run.accuracy == row.accuracy
    deep = flow.fit(logs, meta.withColumn("ground_level_m", F.lit(None).cast("double")), none, "gold:ags", box, s, force=True)
    assert deep.metrics.first().frame == "depth" and deep.grid.z1 == 0.0 and deep.baked.agg({"surface": "max"}).first()[0] == 0.0
    with pytest.raises(ValueError, match="no logs of gold:x"):
        flow.fit(logs, meta, none, "gold:x", box, s)


def test_preview(spark):
    grid = voxels.Grid(0.0, 0.0, 1000.0, 800.0, 100.0, 5.0, 0.0, 100.0)
    rows = voxels.preview(spark, grid, seed=3).collect()
    assert len(rows) == grid.nx * grid.ny * grid.nz == len({r.idx for r in rows}) and len({r.class_idx for r in rows}) > 3
    assert all(r.constrained == (r.class_idx not in (AIR, UNCONSTRAINED)) and (r.constrained or r.entropy == 1.0) for r in rows)
    assert sorted(rows) == sorted(voxels.preview(spark, grid, seed=3).collect())


@pytest.fixture(scope="module")
def crowd(spark):
    """Samples at a hundred places, of which many are close together, two share a place and one is tall."""
    rng, rows = random.Random(9), []
    for i in range(100):
        x, y = (rng.random() * 4000, rng.random() * 4000) if i % 3 else (500 + rng.random() * 50, 500 + rng.random() * 50)
        if i == 7:
            x, y = rows[0][3:5]
        rows += [(i * 10_000 + k, i, k, x, y, 60 - 0.5 * k + rng.random() / 100, rng.randrange(4)) for k in range(3000 if i == 3 else rng.randint(1, 30))]
    return spark.createDataFrame(rows, "qid long, bgs_id long, ord long, x double, y double, z double, cls int").persist()


@pytest.mark.parametrize("exclude_own", [True, False])
@pytest.mark.parametrize("many", [4096, 60, 1])
def test_samples_among_themselves_in_whole_cells_and_in_parts(crowd, exclude_own, many):
    params = [(150.0, 2.5), (600.0, 1.5)]
    others = crowd.select("*")  # queries of their own: sums by query
    weights = spatial.weigh(others, crowd, params, exclude_own)
    want = {(r.lh, r.lv, r.qid, r.cls): r.w for r in weights.collect()}
    got = {(r.lh, r.lv, r.qid, r.cls): r.w for r in spatial.weigh_among(crowd, params, exclude_own, 16, many).collect()}
    assert got == {k: pytest.approx(w) for k, w in want.items()}
    want = {(r.lh, r.lv, r.qid): (r.evidence, r.p_max, r.entropy) for r in spatial.vote(weights).collect()}
    named = crowd.withColumn("qid", F.struct("bgs_id", "ord"))
    for samples, key in ((crowd, lambda q: q), (named, lambda q: q.bgs_id * 10_000 + q.ord)):
        got = {(r.lh, r.lv, key(r.qid)): (r.evidence, r.p_max, r.entropy) for r in spatial.vote_among(samples, params, exclude_own, 16, many).collect()}
        assert got == {k: pytest.approx(w, abs=1e-9) for k, w in want.items()}


def test_votes_among_samples_shuffle_no_weights(crowd):
    assert "Aggregate" not in spatial.vote_among(crowd, [(600.0, 2.5)], True)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("many", [4096, 20])
def test_leave_one_out_and_baseline_alike_in_cells_and_in_parts(crowd, many):
    rows = crowd.where("bgs_id <> 3 and (bgs_id % 9 < 5 or bgs_id = 98)").withColumn("x", F.when(F.col("bgs_id") == 98, 90_000.0).otherwise(F.col("x"))).persist()  # a site far off
    few = [tuple(r) for r in rows.collect()]
    got = spatial.leave_one_out(rows, [(600.0, 2.5)], cell=16, many=many).first()
    assert (got.accuracy, got.constrained_fraction) == pytest.approx(brute_loo(few, 600.0, 2.5))
    sites = spatial._sites(rows, F.col("qid"))
    want = {r.qid: r.cls for r in spatial._baseline(sites).collect()}
    assert {r.qid: r.cls for r in spatial.baseline(rows, 16, many).collect()} == want
    assert got.baseline_accuracy == pytest.approx(sum(want.get(r[0]) == r[6] for r in few) / len(few))
    assert got.n_points == len(few)


def test_samples_far_from_all_queries_are_not_stacked(crowd, monkeypatch):
    asked = crowd.where("bgs_id = 0 and ord = 0").select("qid", "x", "y", "z")
    held, plain = [], spatial._stacks
    monkeypatch.setattr(spatial, "_stacks", lambda df, *more: held.append(plain(df, *more)) or held[-1])
    want = {r.cls: r.w for r in spatial.weigh(asked, crowd, [(600.0, 2.5)]).collect()}
    both = [h.count() for h in held]
    far = crowd.unionByName(crowd.withColumn("x", F.col("x") + 50_000))
    assert {r.cls: r.w for r in spatial.weigh(asked, far, [(600.0, 2.5)]).collect()} == pytest.approx(want)
    assert [h.count() for h in held[2:]] == both and both[1] < 100
