"""Queries over interval logs and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import KEYWORDS, MADE_GROUND, PRINCIPAL_OTHER, PRINCIPAL_SELF, classify
from ..functions.vocab import CLASSES, EVIDENCE, MISSING, class_name
from ..operators import evaluate, intervals
from .derived import Frames
from .registry import query

TOLERANCE = 0.15
_CLASSES = ", ".join(f"'{c}'" for c in CLASSES)


def gold(f: Frames) -> DataFrame:
    return f.intervals.where("source = 'gold:ags'")


def pred(f: Frames) -> DataFrame:
    return f.intervals.where("source = 'extract:mock/v1'")


# some rows broken in each way
_DIRTY = """
    SELECT bgs_id, source, seq, CASE WHEN bgs_id % 23 = 0 THEN -1.0D ELSE top_m END AS top_m,
           CASE WHEN bgs_id % 29 = 0 THEN 4000.0D WHEN bgs_id % 31 = 0 THEN top_m - 0.5D ELSE base_m END AS base_m,
           CASE WHEN bgs_id % 37 = 0 THEN 'BASALT' WHEN bgs_id % 5 = 0 THEN lower(concat(' ', lith_class, ' ')) ELSE lith_class END AS lith_class,
           CASE WHEN bgs_id % 41 = 0 THEN 1.5D ELSE confidence END AS confidence
    FROM {intervals}"""
# every fourth interval starts 10 cm higher, or 20 cm lower
_SHIFTED = "SELECT bgs_id, source, seq, CASE WHEN seq % 4 = 2 THEN top_m - 0.1D WHEN seq % 4 = 3 THEN top_m + 0.2D ELSE top_m END AS top_m, base_m, lith_class, confidence FROM {intervals}"


def _sql(f: Frames, text: str, **more: DataFrame) -> DataFrame:
    return f.spark.sql(text, intervals=f.intervals, **more)


@query(f"""
    SELECT bgs_id, source, seq, upper(trim(lith_class)) AS lith_class,
           CASE WHEN NOT (top_m >= 0 AND top_m <= 3000) THEN 'top_range' WHEN NOT (base_m > 0 AND base_m <= 3000) THEN 'base_range'
                WHEN upper(trim(lith_class)) NOT IN ({_CLASSES}) THEN 'lith_class' WHEN confidence IS NOT NULL AND NOT (confidence BETWEEN 0 AND 1) THEN 'confidence'
                WHEN base_m <= top_m THEN 'base_not_below_top' END AS reject
    FROM ({_DIRTY}) d""")
def interval_validate(f: Frames) -> DataFrame:
    return intervals.validate(_sql(f, _DIRTY)).select("bgs_id", "source", "seq", "lith_class", "reject")


@query("SELECT bgs_id, source, top_m, base_m, CAST(row_number() OVER (PARTITION BY bgs_id, source ORDER BY top_m, base_m) - 1 AS BIGINT) AS seq FROM {intervals}")
def interval_seq(f: Frames) -> DataFrame:
    return intervals.sequence(f.intervals.drop("seq")).select("bgs_id", "source", "top_m", "base_m", "seq")


@query(f"""
    SELECT * FROM (SELECT bgs_id, source, top_m, base_m, lead(top_m) OVER (PARTITION BY bgs_id, source ORDER BY top_m, base_m) AS next_top_m FROM ({_SHIFTED}) s) t
    WHERE next_top_m < base_m - 1e-6""")
def interval_overlap(f: Frames) -> DataFrame:
    return intervals.overlaps(_sql(f, _SHIFTED))


_PROFILE = f"""
    SELECT bgs_id, source, CAST(count(*) AS BIGINT) AS n_intervals, min(top_m) AS first_top_m, max(base_m) AS base_depth_m, coalesce(sum(greatest(nxt - base_m, 0)), 0) AS gaps_m
    FROM (SELECT *, lead(top_m) OVER (PARTITION BY bgs_id, source ORDER BY top_m, base_m) AS nxt FROM ({_SHIFTED}) s) t GROUP BY bgs_id, source"""


@query(f"SELECT bgs_id, source, n_intervals, first_top_m, base_depth_m, round(gaps_m, 6) AS gaps_m FROM ({_PROFILE}) p")
def log_profile(f: Frames) -> DataFrame:
    return intervals.profile(_sql(f, _SHIFTED)).withColumn("gaps_m", F.round("gaps_m", 6))


@query(f"""
    SELECT p.bgs_id, source, concat_ws(',', CASE WHEN base_depth_m > length_m * 1.15 + 1 THEN 'deeper_than_index' END, CASE WHEN round(gaps_m, 6) > 0.5 THEN 'gaps' END,
           CASE WHEN first_top_m > 0.5 THEN 'starts_below_surface' END) AS warnings
    FROM ({_PROFILE}) p LEFT JOIN {{boreholes}} b ON p.bgs_id = b.bgs_id""")
def plausibility(f: Frames) -> DataFrame:
    found = intervals.plausibility(intervals.profile(_sql(f, _SHIFTED)).withColumn("gaps_m", F.round("gaps_m", 6)), f.boreholes)
    return found.select("bgs_id", "source", F.array_join("warnings", ",").alias("warnings"))


@query("SELECT bgs_id, source, round(top_m, 3) AS depth_m FROM {intervals} UNION SELECT bgs_id, source, round(base_m, 3) AS depth_m FROM {intervals}")
def boundaries(f: Frames) -> DataFrame:
    return intervals.boundaries(f.intervals)


@query("SELECT bgs_id, base_m, lag(base_m, 1, 0::DOUBLE) OVER (PARTITION BY bgs_id ORDER BY base_m) AS top_m FROM {intervals} WHERE source = 'gold:ags'")
def depths_to_intervals(f: Frames) -> DataFrame:
    return intervals.from_bases(gold(f).select("bgs_id", "base_m"))


@query("""
    SELECT bgs_id, CAST(count(*) FILTER (depth_m <= prev) AS BIGINT) AS n_breaks
    FROM (SELECT bgs_id, depth_m, lag(depth_m) OVER (PARTITION BY bgs_id ORDER BY seq) AS prev
          FROM (SELECT bgs_id, seq, CASE WHEN (bgs_id + seq) % 19 = 0 THEN top_m ELSE base_m END AS depth_m FROM {intervals} WHERE source = 'gold:ags') a) b
    GROUP BY bgs_id HAVING count(*) FILTER (depth_m <= prev) > 0""")
def monotonic_check(f: Frames) -> DataFrame:
    depth = F.when((F.col("bgs_id") + F.col("seq")) % 19 == 0, F.col("top_m")).otherwise(F.col("base_m"))
    return intervals.not_increasing(gold(f).withColumn("depth_m", depth))


@query("""
    WITH l AS (SELECT bgs_id, base_m, row_number() OVER (PARTITION BY bgs_id ORDER BY seq) AS place, count(*) OVER (PARTITION BY bgs_id) AS n FROM {intervals} WHERE source = 'gold:ags'),
         r AS (SELECT bgs_id, lith_class, row_number() OVER (PARTITION BY bgs_id ORDER BY seq) AS place, count(*) OVER (PARTITION BY bgs_id) AS n
               FROM {intervals} WHERE source = 'extract:mock/v1' AND (bgs_id + seq) % 37 <> 0)
    SELECT l.bgs_id, CAST(l.place AS BIGINT) AS place, base_m, lith_class FROM l JOIN r ON l.bgs_id = r.bgs_id AND l.place = r.place AND l.n = r.n""")
def zip_pairs(f: Frames) -> DataFrame:
    right = pred(f).where((F.col("bgs_id") + F.col("seq")) % 37 != 0).select("bgs_id", "seq", "lith_class")
    return intervals.zip_in_order(gold(f).select("bgs_id", "seq", "base_m"), right).withColumn("place", F.col("place").cast("long"))


@query(f"""
    SELECT g.bgs_id, g.seq - 1 AS seq, k, round(s.easting, 6) AS x, round(s.northing, 6) AS y, CAST(g.cls AS INT) AS cls,
           round(coalesce(s.ground_level_m - (g.top_cm + 25 + 50 * k) / 100.0D, -(g.top_cm + 25 + 50 * k) / 100.0D), 6) AS z
    FROM {{gold}} g JOIN {{sites}} s ON g.bgs_id = s.bgs_id LATERAL VIEW explode(sequence(0L, CAST(floor((g.base_cm - g.top_cm) / 50) AS BIGINT))) t AS k
    WHERE g.top_cm + 25 + 50 * k < g.base_cm AND g.cls < {len(EVIDENCE)} AND g.bgs_id % 6 <> 1""")
def discretise(f: Frames) -> DataFrame:
    found = intervals.discretise(gold(f), f.sites)
    return found.select("bgs_id", F.floor(F.col("ord") / 1_000_000).alias("seq"), (F.col("ord") % 1_000_000).alias("k"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("z", 6).alias("z"), "cls")


@query("SELECT bgs_id, easting, northing, ground_level_m FROM {sites} WHERE ground_level_m IS NOT NULL OR (SELECT count(ground_level_m) FROM {sites}) = 0")
def site_eligibility(f: Frames) -> DataFrame:
    return intervals.eligible_sites(f.sites)


# --- text

#: One phrase for each way a description can be read.
PHRASES = (
    "Soft grey sandy CLAY", "MADE GROUND: brick rubble", "made-ground with clay", "marly clay", "Silty SAND over LIMESTONE", "weathered oolitic limestone", "shale with thin coal seam", "topsoil", "soil report", "dark soil", "cobbles and boulders",
    "COBBLES", "no recovery", "void", "", "   ", "unclassified", "sandy clay with gravel", "gravelly sand", "PEAT", "peaty topsoil", "chalky marl", "OOLITE and SHALE",
)


def _texts(f: Frames) -> DataFrame:
    phrases = f.spark.createDataFrame([(p,) for p in PHRASES], "text string")
    return f.part.select(F.concat_ws(" ", "p_type", "p_name").alias("text")).unionByName(phrases).distinct()


def _duck_last(pattern: str) -> str:
    text = "t"
    if "(?!" in pattern:  # no lookahead there: the words that it excludes are masked at their length
        text, pattern = r"regexp_replace(t, '(?i)\bsoil(\s+report)', 'XXXX\1', 'g')", pattern.replace(r"(?!\s+report)", "")
    p = f"'(?i){pattern}'"
    return f"CASE WHEN regexp_matches({text}, {p}) THEN length(t) - length(list_extract(regexp_split_to_array({text}, {p}), -1)) - length(list_extract(regexp_extract_all({text}, {p}), -1)) END"


_HITS = ", ".join(f"{{{{'at': {_duck_last(p)}, 'c': '{c}'}}}}" for p, c in KEYWORDS)
_OTHER = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PRINCIPAL_OTHER.items()) + " ELSE w END"
_PRINCIPALS = ", ".join(f"'{w}'" for w in (*PRINCIPAL_SELF, *PRINCIPAL_OTHER))
_HITS = _HITS.replace("{{", "{").replace("}}", "}")


def _normalise_sql() -> str:
    values = ", ".join(f"('{p}')" for p in PHRASES)
    return f"""
    SELECT text, CASE WHEN t = '' THEN 'UNKNOWN' WHEN made THEN 'MADE_GROUND' WHEN w IS NOT NULL THEN {_OTHER} WHEN len(h) = 0 THEN 'UNKNOWN' ELSE list_extract(list_sort(h), -1).c END AS lith_class,
           CASE WHEN t = '' THEN 0.0 WHEN made OR w IS NOT NULL THEN 0.9 WHEN len(h) = 0 THEN 0.0 WHEN len(h) = 1 THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence,
           CASE WHEN t = '' THEN 'empty' WHEN made OR w IS NOT NULL THEN 'principal-capitals' WHEN len(h) = 0 THEN 'no-match' WHEN len(h) = 1 THEN 'single-keyword' ELSE 'last-of-several' END AS rule
    FROM (SELECT text, t, regexp_matches(t, '{MADE_GROUND}') AS made, list_extract(list_filter(regexp_extract_all(t, '\\b[A-Z]{{4,}}\\b'), lambda x: x IN ({_PRINCIPALS})), -1) AS w,
                 list_filter([{_HITS}], lambda x: x.at IS NOT NULL) AS h
          FROM (SELECT DISTINCT text, trim(text) AS t FROM (SELECT concat_ws(' ', p_type, p_name) AS text FROM part UNION ALL SELECT * FROM (VALUES {values}) v) u) a) b"""


@query(name="normalise_text")
def normalise_text(f: Frames) -> DataFrame:
    return _texts(f).select("text", classify(F.col("text")).alias("c")).select("text", "c.*")


from .registry import ORACLE_SQL  # noqa: E402

ORACLE_SQL["normalise_text"] = _normalise_sql()


# --- evaluation

_MARKS = "SELECT bgs_id, top_cm AS d FROM {%s} UNION SELECT bgs_id, base_cm AS d FROM {%s}"
_GM, _PM = _MARKS % ("gold", "gold"), _MARKS % ("pred", "pred")
_EVAL = f"""
    WITH gm AS ({_GM}), pm AS ({_PM}),
    gh AS (SELECT bgs_id, CAST(count(*) AS BIGINT) AS gold_boundaries, CAST(count(*) FILTER (EXISTS (SELECT 1 FROM pm WHERE pm.bgs_id = gm.bgs_id AND abs(pm.d - gm.d) <= TOL)) AS BIGINT) AS boundary_hits FROM gm GROUP BY bgs_id),
    ph AS (SELECT bgs_id, CAST(count(*) AS BIGINT) AS pred_boundaries, CAST(count(*) FILTER (EXISTS (SELECT 1 FROM gm WHERE pm.bgs_id = gm.bgs_id AND abs(pm.d - gm.d) <= TOL)) AS BIGINT) AS pred_hits FROM pm GROUP BY bgs_id),
    ks AS (SELECT bgs_id, cls, unnest(range((top_cm + 9) // 10, (base_cm + 9) // 10)) AS k FROM {{gold}}),
    conf AS (SELECT k.bgs_id, k.cls AS g, p.cls AS p, count(*) AS n FROM ks k LEFT JOIN {{pred}} p ON p.bgs_id = k.bgs_id AND k.k * 10 >= p.top_cm AND k.k * 10 < p.base_cm GROUP BY ALL),
    dep AS (SELECT bgs_id, CAST(sum(n) AS BIGINT) AS samples, CAST(coalesce(sum(n) FILTER (g = p), 0) AS BIGINT) AS correct FROM conf GROUP BY bgs_id),
    per AS (SELECT gh.bgs_id, gold_boundaries, boundary_hits, coalesce(pred_boundaries, 0) AS pred_boundaries, coalesce(pred_hits, 0) AS pred_hits, coalesce(samples, 0) AS samples, coalesce(correct, 0) AS correct
            FROM gh LEFT JOIN ph ON gh.bgs_id = ph.bgs_id LEFT JOIN dep ON gh.bgs_id = dep.bgs_id),
    gc AS (SELECT g AS c, sum(n) AS ng, coalesce(sum(n) FILTER (g = p), 0) AS tp FROM conf GROUP BY g), pc AS (SELECT p AS c, sum(n) AS np FROM conf WHERE p IS NOT NULL GROUP BY p),
    f1 AS (SELECT avg(2 * tp / (ng + coalesce(np, 0))) AS lithology_f1 FROM gc LEFT JOIN pc ON gc.c = pc.c),
    pool AS (SELECT CAST(count(*) AS BIGINT) AS n_gold, sum(boundary_hits) / sum(gold_boundaries) AS boundary_recall, sum(pred_hits) / sum(pred_boundaries) AS boundary_precision, sum(correct) / sum(samples) AS depth_accuracy FROM per)
    """.replace("TOL", str(round(TOLERANCE * 100)))


def whole(f: Frames, name: str) -> DataFrame:
    """The view gold or pred as intervals in metres."""
    v = getattr(f, name)
    return v.select("bgs_id", "seq", (F.col("top_cm") / 100.0).alias("top_m"), (F.col("base_cm") / 100.0).alias("base_m"), class_name(F.col("cls")).alias("lith_class"))


@query(_EVAL + "SELECT bgs_id, gold_boundaries AS n, boundary_hits AS hits FROM gh")
def boundary_match(f: Frames) -> DataFrame:
    found = evaluate.boundary_counts(whole(f, "gold"), whole(f, "pred"), TOLERANCE + 1e-9)
    return found.select("bgs_id", F.col("gold_boundaries").alias("n"), F.col("boundary_hits").alias("hits"))


_NAME = "CASE {0} " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CLASSES)) + f" ELSE '{MISSING}' END"


@query(_EVAL + f"SELECT bgs_id, {_NAME.format('g')} AS gold_class, {_NAME.format('p')} AS pred_class, CAST(n AS BIGINT) AS n FROM conf")
def depth_confusion(f: Frames) -> DataFrame:
    return evaluate.depth_confusion(whole(f, "gold"), whole(f, "pred"))


@query(_EVAL + "SELECT round(lithology_f1, 9) AS lithology_f1 FROM f1")
def macro_f1(f: Frames) -> DataFrame:
    found = evaluate.macro_f1(evaluate.depth_confusion(whole(f, "gold"), whole(f, "pred")))
    return found.select(F.round("lithology_f1", 9).alias("lithology_f1"))


def _per_site(f: Frames) -> DataFrame:
    return evaluate.per_site(evaluate.compared(whole(f, "gold"), whole(f, "pred"), TOLERANCE + 1e-9))


@query(_EVAL + """SELECT *, round(boundary_hits / nullif(gold_boundaries, 0), 9) AS boundary_recall, round(pred_hits / nullif(pred_boundaries, 0), 9) AS boundary_precision, round(correct / nullif(samples, 0), 9) AS depth_accuracy FROM per""")
def eval_per_borehole(f: Frames) -> DataFrame:
    return _per_site(f).withColumns({c: F.round(c, 9) for c in ("boundary_recall", "boundary_precision", "depth_accuracy")})


@query(_EVAL + "SELECT n_gold, round(boundary_recall, 9) AS boundary_recall, round(boundary_precision, 9) AS boundary_precision, round(depth_accuracy, 9) AS depth_accuracy FROM pool")
def eval_pooled(f: Frames) -> DataFrame:
    return evaluate.pooled(_per_site(f)).select("n_gold", *(F.round(c, 9).alias(c) for c in ("boundary_recall", "boundary_precision", "depth_accuracy")))


@query(_EVAL + """SELECT n_gold, round(boundary_recall, 9) AS boundary_recall, round(boundary_precision, 9) AS boundary_precision, round(depth_accuracy, 9) AS depth_accuracy, round(lithology_f1, 9) AS lithology_f1,
    n_gold >= 20 AS enough_gold, coalesce(boundary_recall >= 0.85, false) AS recall_ok, coalesce(lithology_f1 >= 0.8, false) AS f1_ok, n_gold >= 20 AND coalesce(boundary_recall >= 0.85, false) AND coalesce(lithology_f1 >= 0.8, false) AS gates_passed FROM pool, f1""")
def eval_gates(f: Frames) -> DataFrame:
    found = evaluate.evaluate(whole(f, "gold"), whole(f, "pred"), evaluate.Gates(boundary_tolerance_m=TOLERANCE + 1e-9))
    return found.withColumns({c: F.round(c, 9) for c in ("boundary_recall", "boundary_precision", "depth_accuracy", "lithology_f1")})


@query("""SELECT CAST(count(*) AS BIGINT) AS n_gold, CAST(count(p.bgs_id) AS BIGINT) AS n_pred, CAST(count(*) - count(p.bgs_id) AS BIGINT) AS n_missing
    FROM (SELECT DISTINCT bgs_id FROM {intervals} WHERE source = 'gold:ags') g LEFT JOIN (SELECT DISTINCT bgs_id FROM {intervals} WHERE source = 'extract:mock/v1') p ON g.bgs_id = p.bgs_id""")
def eval_coverage(f: Frames) -> DataFrame:
    return evaluate.coverage(gold(f), pred(f))


_BANDS = """
    SELECT b.band, CAST(count(i.bgs_id) AS BIGINT) AS n FROM (VALUES ('none'), ('<0.5'), ('0.5-0.8'), ('0.8-0.95'), ('>=0.95')) b(band)
    LEFT JOIN (SELECT bgs_id, CASE WHEN confidence IS NULL THEN 'none' WHEN confidence < 0.5 THEN '<0.5' WHEN confidence < 0.8 THEN '0.5-0.8' WHEN confidence < 0.95 THEN '0.8-0.95' ELSE '>=0.95' END AS band
               FROM {intervals} WHERE source = 'extract:mock/v1') i ON i.band = b.band GROUP BY b.band"""


@query(_BANDS)
def confidence_bands(f: Frames) -> DataFrame:
    return evaluate.confidence_bands(pred(f))


@query(f"""SELECT max(CASE WHEN band = 'none' THEN n END) = sum(n) AND sum(n) > 0 AS no_confidences,
    NOT (max(CASE WHEN band = 'none' THEN n END) = sum(n) AND sum(n) > 0) AND count(*) FILTER (band <> 'none' AND n > 0) <= 1 AND sum(n) >= 10 AS collapsed FROM ({_BANDS}) b""")
def confidence_warnings(f: Frames) -> DataFrame:
    return evaluate.confidence_warnings(evaluate.confidence_bands(pred(f)))
