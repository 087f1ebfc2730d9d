"""Loads of gold logs, and pages that link to the next."""

import json

import pytest

from coreloom.operators import corpus, gold
from coreloom.sources import paged, records

STORED = "bgs_id long, source string, seq long, top_m double, base_m double, lith_class string, confidence double"
META = "bgs_id long, source string, easting double, northing double, ground_level_m double"


def file_of(holes):
    text = '"GROUP","LOCA"\n"HEADING","LOCA_ID","LOCA_NATE","LOCA_NATN","LOCA_GL"\n' + "".join(f'"DATA","{h}","{i}","2",""\n' for i, h in enumerate(holes))
    text += '"GROUP","GEOL"\n"HEADING","LOCA_ID","GEOL_TOP","GEOL_BASE","GEOL_DESC"\n'
    return text + "".join(f'"DATA","{h}","{a}","{b}","{d}"\n' for h, rows in holes.items() for a, b, d in rows)


def load(spark, texts, ids=None):
    files = spark.createDataFrame(list(texts.items()), "path string, value string")
    known = spark.createDataFrame(list(ids.items()), "hole string, bgs_id long") if ids else None
    return gold.load_ags(records.ags_strata(records.csv_rows(records.text_lines(files)), known), files)


def test_load_of_exchange_files(spark):
    one = file_of({"B1": [("1", "2", "SAND"), ("0", "1", "soft CLAY"), ("3", "2", "PEAT")], "B2": [("0", "4000", "CLAY"), ("x", "1", "CLAY")]})
    two = file_of({"B1": [("0", "5", "LIMESTONE")], "B3": [("0", "1", "who knows")]})
    found = load(spark, {"1": one, "2": two, "3": "", "4": "no such thing"}, {"B1": 77, "B3": 5})
    assert sorted((r.path, r.n_logs, r.n_strata, r.n_rejected) for r in found.outcomes.collect()) == [("1", 1, 2, 3), ("2", 2, 2, 0), ("3", 0, 0, 0), ("4", 0, 0, 0)]
    logs = sorted((r.bgs_id, r.seq, r.top_m, r.base_m, r.lith_class, r.confidence) for r in found.logs.collect())
    assert logs == [(5, 0, 0.0, 1.0, "UNKNOWN", 0.0), (77, 0, 0.0, 5.0, "LIMESTONE", 0.9)]  # the later file holds
    assert {(r.bgs_id, r.hole, r.easting, r.n_intervals, r.total_depth_m) for r in found.meta.collect()} == {(5, "B3", 1.0, 1, 1.0), (77, "B1", 0.0, 1, 5.0)}
    stored = spark.createDataFrame([(77, "gold:ags", 0, 0.0, 9.0, "CLAY", 0.5), (77, "other", 0, 0.0, 9.0, "CLAY", 0.5), (8, "gold:ags", 0, 0.0, 9.0, "CLAY", None)], STORED)
    meta = spark.createDataFrame([(77, "gold:ags", 9.0, 9.0, 9.0)], META)
    after, said = found.store(stored, meta)
    assert sorted((r.bgs_id, r.source, r.lith_class) for r in after.collect()) == [(5, "gold:ags", "UNKNOWN"), (8, "gold:ags", "CLAY"), (77, "gold:ags", "LIMESTONE"), (77, "other", "CLAY")]
    assert {(r.bgs_id, r.easting, r.ground_level_m) for r in said.collect()} == {(5, 1.0, None), (77, 0.0, None)}


def test_names_that_share_an_id_stop_a_load(spark):
    text = file_of({"plumless": [("0", "1", "CLAY")], "buckeroo": [("0", "1", "CLAY")]})
    with pytest.raises(ValueError, match="placeholder ids of several names"):
        load(spark, {"1": text})
    assert load(spark, {"1": text}, {"plumless": 1}).logs.count() == 2
    assert corpus.unmapped(load(spark, {"1": text}, {"plumless": 1}).logs, "gold:ags").first().n == 1


def test_load_of_sheets(spark):
    words = [("s1", 0, x, y, x + 20, y + 8, t) for x, y, t in ((273.0, 150.0, "Depth"), (313.0, 150.0, "Level"), (353.0, 150.0, "Legend"), (549.0, 130.0, "Depth"))]
    for i, (depth, text) in enumerate((("1.00", "CLAY"), ("2.50", "SAND"))):
        words += [("s1", 0, 275.0, 200.0 + 40 * i, 295.0, 208.0, depth), ("s1", 0, 400.0, 200.0 + 40 * i, 420.0, 208.0, text)]
    words += [("s2", 0, 20.0 + 30 * i, 400.0, 40.0 + 30 * i, 408.0, t) for i, t in enumerate("No strata infomation is available".split())]
    df = spark.createDataFrame(words, "sheet string, page int, x0 double, y0 double, x1 double, y1 double, text string")
    index = spark.createDataFrame([("s1", -5, 1.0, 2.0), ("s2", -6, 1.0, 2.0)], "sheet string, bgs_id long, easting double, northing double")
    found = gold.load_sheets(df, index)
    assert sorted((r.bgs_id, r.source, r.seq, r.base_m, r.lith_class) for r in found.logs.collect()) == [(-5, "gold:gwbv", 0, 1.0, "CLAY"), (-5, "gold:gwbv", 1, 2.5, "SAND")]
    assert {(r.sheet, r.n_logs, r.n_strata, r.reason) for r in found.outcomes.collect()} == {("s1", 1, 2, None), ("s2", 0, 0, "no_log_data")}
    assert [(r.bgs_id, r.easting, r.northing) for r in found.meta.collect()] == [(-5, 1.0, 2.0)]


def server(folder, n, declared=None):
    for i in range(n):
        links = [{"rel": "self", "href": "x"}] + ([{"rel": "next", "href": f"p{i + 1}.json"}] if i + 1 < n else [])
        feature = {"id": float(i), "properties": {"bgs_id": float(i), "name": "BH", "easting": 1.0, "northing": 2.0, "length": 3.0}}
        (folder / f"p{i}.json").write_text(json.dumps({"features": [feature, feature], "numberMatched": declared if declared is not None else 2 * n, "links": links}))
    return f"file://{folder}/p0.json"


def test_pages_that_link_to_the_next(spark, tmp_path):
    url, landed = server(tmp_path, 5), str(tmp_path / "landed")
    got = paged.fetch(spark, url, {}, landed, at_once=2, pause=0)
    paged.check(got)
    assert sorted(r.page for r in got.collect()) == [0, 1, 2, 3, 4]
    assert records.index_records(records.landed_pages(got)).count() == 10
    assert paged.fetch(spark, url, {}, landed, pause=0).count() == 5  # nothing is asked for again


def test_a_fetch_goes_on_where_it_was_interrupted(spark, tmp_path):
    url, landed = server(tmp_path, 6), str(tmp_path / "landed")
    gone = (tmp_path / "p4.json").read_text()
    (tmp_path / "p4.json").unlink()
    with pytest.raises(Exception, match="p4.json"):
        paged.fetch(spark, url, {}, landed, at_once=2, pause=0)
    half = spark.read.parquet(landed)
    assert sorted(r.page for r in half.collect()) == [0, 1, 2, 3]
    with pytest.raises(ValueError, match="pages are missing"):
        paged.check(half)
    (tmp_path / "p4.json").write_text(gone)
    (tmp_path / "p0.json").unlink()  # not asked for again
    got = paged.fetch(spark, url, {}, landed, at_once=2, pause=0)
    paged.check(got)
    assert got.count() == 6


def test_a_wrong_number_of_features(spark, tmp_path):
    got = paged.fetch(spark, server(tmp_path, 2, declared=9), {}, str(tmp_path / "landed"), pause=0)
    with pytest.raises(ValueError, match="4 features received, 9 declared"):
        paged.check(got)
