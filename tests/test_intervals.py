import random

import pytest
from pyspark.sql import functions as F

from coreloom.functions.text import classify
from coreloom.functions.vocab import CLASSES, EVIDENCE
from coreloom.operators import evaluate, intervals

LOG = "bgs_id long, source string, seq long, top_m double, base_m double, lith_class string, confidence double"


def logs(spark, rows):
    return spark.createDataFrame([(*r[:2], i, *r[2:]) for i, r in enumerate(rows)], LOG)


@pytest.mark.parametrize(("text", "cls", "confidence"), [
    ("Soft grey sandy CLAY", "CLAY", 0.9), ("MADE GROUND: ash and brick", "MADE_GROUND", 0.9), ("Sandy CLAY over LIMESTONE", "LIMESTONE", 0.9), ("COBBLES in a matrix", "GRAVEL", 0.9),
    ("brown peat", "PEAT", 0.7), ("weathered oolitic rock", "LIMESTONE", 0.7), ("sandy clay", "CLAY", 0.5), ("clay with sand", "SAND", 0.5), ("marly clay", "MARL", 0.5),
    ("soil report", "UNKNOWN", 0.0), ("dark soil", "TOPSOIL", 0.7), ("nothing to see", "UNKNOWN", 0.0), ("", "UNKNOWN", 0.0), (None, "UNKNOWN", 0.0), (" \n ", "UNKNOWN", 0.0), ("chalké", "CHALK", 0.7), ("x" * 100_000 + " clay", "CLAY", 0.7),
])
def test_classify(spark, text, cls, confidence):
    row = spark.createDataFrame([(text,)], "t string").select(classify(F.col("t")).alias("c")).first().c
    assert (row.lith_class, row.confidence) == (cls, confidence)


def test_vocabulary():
    assert len(CLASSES) == 17 and len(EVIDENCE) == 15


def test_validate_names_the_first_broken_rule(spark):
    rows = [(1, "s", 0.0, 1.0, " clay ", 0.5), (1, "s", -1.0, 1.0, "CLAY", None), (1, "s", 0.0, 3001.0, "CLAY", None), (1, "s", 0.0, 1.0, "BASALT", None), (1, "s", 0.0, 1.0, "CLAY", 1.1), (1, "s", 2.0, 1.0, "CLAY", None), (1, "s", None, 1.0, "CLAY", None)]
    got = {r.seq: r.reject for r in intervals.validate(logs(spark, rows)).collect()}
    assert got == {0: None, 1: "top_range", 2: "base_range", 3: "lith_class", 4: "confidence", 5: "base_not_below_top", 6: "top_range"}


def test_overlap_and_gaps(spark):
    rows = [(1, "s", 0.0, 2.0, "CLAY", None), (1, "s", 1.5, 3.0, "SAND", None), (1, "s", 4.0, 5.0, "SAND", None), (2, "s", 0.0, 1.0, "CLAY", None), (2, "s", 1.0 - 1e-7, 2.0, "CLAY", None)]
    df = logs(spark, rows)
    assert [(r.bgs_id, r.base_m) for r in intervals.overlaps(df).collect()] == [(1, 2.0)]
    p = {r.bgs_id: r for r in intervals.profile(df).collect()}
    assert (p[1].base_depth_m, p[1].gaps_m, p[2].gaps_m) == (5.0, 1.0, 0.0)


def test_discretise_stops_below_the_base(spark):
    sites = spark.createDataFrame([(1, 5.0, 6.0, 100.0), (2, 0.0, 0.0, None)], "bgs_id long, easting double, northing double, ground_level_m double")
    rows = [(1, "s", 0.0, 1.0, "CLAY", None), (1, "s", 1.0, 1.2, "SAND", None), (1, "s", 2.0, 9.0, "UNKNOWN", None), (2, "s", 0.0, 0.6, "PEAT", None), (3, "s", 0.0, 5.0, "PEAT", None)]
    got = sorted((r.bgs_id, r.z) for r in intervals.discretise(logs(spark, rows), sites).collect())
    assert got == [(1, 99.25), (1, 99.75), (2, -0.25)]
    with pytest.raises(Exception, match="mixed frames"):
        intervals.frame(sites).collect()


def evaluated(spark, gold, pred, tolerance=0.25):
    g, p = logs(spark, gold), logs(spark, pred)
    return evaluate.per_site(evaluate.compared(g, p, tolerance)), evaluate.depth_confusion(g, p)


def test_evaluation_by_hand(spark):
    gold = [(1, "g", 0.0, 1.0, "CLAY", None), (1, "g", 1.0, 2.0, "SAND", None), (2, "g", 0.0, 1.0, "CLAY", None)]
    pred = [(1, "p", 0.0, 1.1, "CLAY", 0.9), (1, "p", 1.1, 2.0, "SAND", None)]
    sites, confusion = evaluated(spark, gold, pred)
    rows = {r.bgs_id: r for r in sites.collect()}
    assert (rows[1].boundary_hits, rows[1].gold_boundaries, rows[1].samples, rows[1].correct) == (3, 3, 20, 19)
    assert (rows[2].boundary_recall, rows[2].boundary_precision, rows[2].depth_accuracy) == (0.0, None, 0.0)
    assert {(r.bgs_id, r.gold_class, r.pred_class): r.n for r in confusion.collect()} == {(1, "CLAY", "CLAY"): 10, (1, "SAND", "CLAY"): 1, (1, "SAND", "SAND"): 9, (2, "CLAY", "__MISSING__"): 10}
    narrow, _ = evaluated(spark, gold, pred, 0.05)
    assert {r.bgs_id: r.boundary_hits for r in narrow.collect()} == {1: 2, 2: 0}


def test_macro_f1_counts_gold_classes_only(spark):
    rows = [(1, "CLAY", "CLAY", 8), (1, "CLAY", "__MISSING__", 2), (1, "SAND", "SAND", 5)]
    got = evaluate.macro_f1(spark.createDataFrame(rows, "bgs_id long, gold_class string, pred_class string, n long")).first().lithology_f1
    assert got == pytest.approx((2 * 1 * 0.8 / 1.8 + 1) / 2)


def test_empty_and_null_confidence(spark):
    empty = logs(spark, [(1, "p", 0.0, 1.0, "CLAY", None)]).limit(0)
    assert evaluate.macro_f1(evaluate.depth_confusion(empty, empty)).first().lithology_f1 is None
    row = evaluate.evaluate(empty, empty).first()
    assert row.n_gold == 0 and row.gates_passed is False
    silent = evaluate.confidence_warnings(evaluate.confidence_bands(logs(spark, [(1, "p", 0.0, 1.0, "CLAY", None)]))).first()
    assert silent.no_confidences and not silent.collapsed
    same = evaluate.confidence_warnings(evaluate.confidence_bands(logs(spark, [(1, "p", float(i), i + 1.0, "CLAY", 0.96) for i in range(10)]))).first()
    assert same.collapsed


def test_report(spark, tmp_path):
    gold = [(1, "g", 0.0, 1.0, "CLAY", None)]
    sites, _ = evaluated(spark, gold, gold)
    g = logs(spark, gold)
    text, body = evaluate.report(evaluate.evaluate(g, g), evaluate.confidence_bands(g), "test")
    assert "100.0%" in text and '"n_gold": 1' in body
    evaluate.site_report(sites, str(tmp_path / "sites"))
    assert [(r.bgs_id, r.boundary_recall) for r in spark.read.json(str(tmp_path / "sites")).collect()] == [(1, 1.0)]


def test_a_log_that_overlaps_itself_counts_each_depth_once(spark):
    gold = [(1, "g", 0.0, 2.0, "CLAY", None)]
    pred = [(1, "p", 0.0, 1.5, "CLAY", None), (1, "p", 1.0, 2.0, "SAND", None), (1, "p", 0.5, 1.2, "PEAT", None)]
    _, confusion = evaluated(spark, gold, pred)
    assert {r.pred_class: r.n for r in confusion.collect()} == {"CLAY": 15, "SAND": 5}


def test_boundary_counts_against_brute_force(spark):
    rng = random.Random(3)
    side = lambda name: [(i, name, *sorted((round(rng.random() * 9, 2), round(rng.random() * 9, 2))), "CLAY", None) for i in range(30) for _ in range(rng.randint(0, 12))]
    gold, pred = side("g"), side("p")
    marks = lambda rows, i: {x for r in rows if r[0] == i for x in r[2:4]}
    near = lambda a, b: sum(any(abs(x - y) <= 0.05 + 1e-9 for y in b) for x in a)
    pairs = {i: (marks(gold, i), marks(pred, i)) for i in range(30)}
    want = {i: (len(g), near(g, p), len(p), near(p, g)) for i, (g, p) in pairs.items() if g}
    got = evaluate.boundary_counts(logs(spark, gold), logs(spark, pred), 0.05 + 1e-9).collect()
    assert {r.bgs_id: (r.gold_boundaries, r.boundary_hits, r.pred_boundaries, r.pred_hits) for r in got} == want
