"""Predicted logs held against gold ones: boundaries within a tolerance, classes sampled along the depth, gates.

gold and pred are intervals (bgs_id, seq, top_m, base_m, lith_class, confidence) of one source each. A gold site
without a predicted log scores as all missing. Each side is grouped by site once, its log an array (no log is longer than
its 3,000 m), and all counts of a site come from the same pass over the two arrays.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import MISSING
from .lineage import cut
from .tiles import ramps

# Confidence bands, and how many intervals make a collapsed scale worth a warning.
BANDS = ("none", "<0.5", "0.5-0.8", "0.8-0.95", ">=0.95")
COLLAPSE_N = 10
COUNTS = ("gold_boundaries", "boundary_hits", "pred_boundaries", "pred_hits", "samples", "correct")


@dataclass(frozen=True)
class Gates:
    boundary_tolerance_m: float = 0.25
    min_boundary_recall: float = 0.85
    min_lithology_f1: float = 0.80
    min_gold_boreholes: int = 20


class _Logs:
    """The intervals of a batch of sites, end to end, in the order of site and seq: site, top, base, cls (codes), and the
    distinct boundaries (of_site, mark), in order."""

    def __init__(self, arrays: pa.Array, names: pa.Array):
        at = arrays.offsets.to_numpy().astype(np.int64)
        sizes = np.where(arrays.is_valid().to_numpy(zero_copy_only=False), np.diff(at), 0)
        rows = arrays.flatten()
        value = lambda c: pc.fill_null(rows.field(c), np.nan).to_numpy(zero_copy_only=False).astype(float)
        self.n, self.site = len(arrays), np.repeat(np.arange(len(arrays)), sizes)
        self.cls = pc.index_in(rows.field("cls"), value_set=names).to_numpy(zero_copy_only=False)
        self.top, self.base = value("top"), value("base")
        of, mark = np.concatenate((self.site, self.site)), np.concatenate((value("top_mark"), value("base_mark")))
        order = np.lexsort((mark, of))
        of, mark = of[order], mark[order]
        keep = ~np.isnan(mark) & np.concatenate(([True] * (len(of) > 0), (of[1:] != of[:-1]) | (mark[1:] != mark[:-1])))
        self.of_site, self.mark = of[keep], mark[keep]

    def clip(self) -> None:
        """Takes from each interval what earlier ones of its log (by seq) reach below: each depth belongs to the first
        interval that has it, as long as logs go downwards."""
        values, rank = np.unique(self.base, return_inverse=True)  # ranks, so that no depth is rounded
        reach = np.maximum.accumulate(self.site * (len(values) + 1) + rank) if len(rank) else rank
        above = np.concatenate((self.base[:0], np.full(min(1, len(rank)), np.nan), values[(reach[:-1] - self.site[:-1] * (len(values) + 1))]))
        above[np.concatenate(([True] * (len(rank) > 0), self.site[1:] != self.site[:-1]))] = np.nan
        top = np.fmax(self.top, above)
        keep = top < self.base
        self.site, self.top, self.base, self.cls = self.site[keep], top[keep], self.base[keep], self.cls[keep]

    def per_site(self, rows: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(rows, weights, minlength=self.n).astype(np.int64)


def _hits(a: _Logs, b: _Logs, tolerance: float) -> np.ndarray:
    """How many boundaries of each site's log in a have one of b within the tolerance."""
    if not len(a.mark) or not len(b.mark):
        return np.zeros(a.n, np.int64)
    low = min(a.mark.min(), b.mark.min())
    span = 2 * (max(a.mark.max(), b.mark.max()) - low) + 1
    at = np.searchsorted(b.of_site * span + (b.mark - low), a.of_site * span + (a.mark - low))
    hit = np.zeros(len(a.mark), bool)
    for k in (-2, -1, 0, 1):  # a rounded key may be one off
        j = np.clip(at + k, 0, len(b.mark) - 1)
        hit |= (b.of_site[j] == a.of_site) & (np.abs(b.mark[j] - a.mark) <= tolerance)
    return a.per_site(a.of_site[hit])


def samples_above(depth: np.ndarray, step: float) -> np.ndarray:
    """How many depths k*step (to six decimals, k from 0) lie above `depth`."""
    k = np.floor(depth / step)
    return np.maximum(k - 1, 0) + sum(((k + d >= 0) & (np.round((k + d) * step, 6) < depth)).astype(float) for d in (-1, 0, 1))


def _confusion(g: _Logs, p: _Logs, step: float, k: int) -> np.ndarray:
    """Rows (site, gold code, predicted code or k, samples) of the classes at the samples of gold, each once, in order."""
    def between(top: np.ndarray, base: np.ndarray) -> np.ndarray:
        return np.maximum(samples_above(base, step) - samples_above(top, step), 0)

    g.clip(), p.clip()
    keys, n = [(g.site * k + g.cls) * (k + 1) + k], [between(g.top, g.base)]
    if len(p.site) and len(g.site):
        low = min(g.top.min(), p.top.min())
        span = 2 * (max(g.base.max(), p.base.max()) - low) + 1
        # those whose base is below the gold top and whose top is above the gold base: a run, a row wider for rounding
        a = np.searchsorted(p.site * span + (p.base - low), g.site * span + (g.top - low)) - 1
        z = np.searchsorted(p.site * span + (p.top - low), g.site * span + (g.base - low)) + 1
        a, z = np.maximum(a, 0), np.minimum(z, len(p.site))
        size = np.maximum(z - a, 0)
        i, j = np.repeat(np.arange(len(g.site)), size), np.repeat(a, size) + ramps(size)
        top, base = np.maximum(g.top[i], p.top[j]), np.minimum(g.base[i], p.base[j])
        meet = (g.site[i] == p.site[j]) & (top < base)
        i, j, shared = i[meet], j[meet], between(top[meet], base[meet])
        keys += [(g.site[i] * k + g.cls[i]) * (k + 1) + p.cls[j], (g.site[i] * k + g.cls[i]) * (k + 1) + k]
        n += [shared, -shared]
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, np.concatenate(n), minlength=len(found)).astype(np.int64)
    found, total = found[total > 0], total[total > 0]
    return np.stack((found // (k + 1) // k, found // (k + 1) % k, found % (k + 1), total))


def compared(gold: DataFrame, pred: DataFrame, tolerance: float = 0.25, step: float = 0.1) -> DataFrame:
    """bgs_id, COUNTS and confusion (an array of gold_class, pred_class, n) of each gold site.

    Boundaries are distinct to the millimetre; a hit is one with a boundary of the other side within the tolerance.
    Depths are sampled every `step` in gold by the classes there; gaps in gold aren't sampled, and where a log overlaps
    itself, its first interval counts. Samples are counted, not made: a gold and a predicted interval share those between
    the deeper top and the shallower base. Intervals without both depths have no samples.
    """
    @F.arrow_udf("struct<" + ", ".join(f"{c}: bigint" for c in COUNTS) + ", confusion: array<struct<gold_class: string, pred_class: string, n: bigint>>>")
    def count(gold: pa.Array, pred: pa.Array) -> pa.Array:
        names = pc.unique(pa.concat_arrays([pc.drop_null(x.flatten().field("cls")) for x in (gold, pred)]))
        names = pa.concat_arrays([names, pa.nulls(1, pa.string())])
        g, p, k = _Logs(gold, names), _Logs(pred, names), len(names)
        marks = (g.per_site(g.of_site), _hits(g, p, tolerance), p.per_site(p.of_site), _hits(p, g, tolerance))
        site, a, b, n = _confusion(g, p, step, k)
        cells = pa.StructArray.from_arrays([names.take(pa.array(a)), pa.concat_arrays([names, pa.array([MISSING])]).take(pa.array(b)), pa.array(n)], ["gold_class", "pred_class", "n"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(site, np.arange(g.n + 1)), pa.int32()), cells)
        counts = (*marks, g.per_site(site, n), g.per_site(site[a == b], n[a == b]))
        return pa.StructArray.from_arrays([*(pa.array(c) for c in counts), lists], [*COUNTS, "confusion"])

    def logs(df: DataFrame, name: str) -> DataFrame:
        one = F.struct("seq", F.col("top_m").alias("top"), F.col("base_m").alias("base"), F.col("lith_class").alias("cls"), F.round("top_m", 3).alias("top_mark"), F.round("base_m", 3).alias("base_mark"))
        return df.groupBy("bgs_id").agg(F.sort_array(F.collect_list(one)).alias(name))

    both = logs(gold, "_gold").join(logs(pred, "_pred"), "bgs_id", "left")
    return both.select("bgs_id", count("_gold", "_pred").alias("c")).select("bgs_id", "c.*")


def boundary_counts(gold: DataFrame, pred: DataFrame, tolerance: float) -> DataFrame:
    """bgs_id, gold_boundaries, boundary_hits, pred_boundaries, pred_hits of each site with a gold boundary."""
    return compared(gold, pred, tolerance).where("gold_boundaries > 0").select("bgs_id", *COUNTS[:4])


def depth_confusion(gold: DataFrame, pred: DataFrame, step: float = 0.1) -> DataFrame:
    """bgs_id, gold_class, pred_class, n: how many samples of a site have these classes."""
    return compared(gold, pred, step=step).select("bgs_id", F.inline("confusion"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def macro_f1(confusion: DataFrame) -> DataFrame:
    """One row, lithology_f1: the mean F1 of the gold classes; null without any."""
    pooled = confusion.groupBy("gold_class", "pred_class").agg(F.sum("n").alias("n"))
    gold = pooled.groupBy(F.col("gold_class").alias("c")).agg(F.sum("n").alias("n_gold"), F.coalesce(F.sum(F.when(F.col("gold_class") == F.col("pred_class"), F.col("n"))), F.lit(0)).alias("tp"))
    pred = pooled.groupBy(F.col("pred_class").alias("c")).agg(F.sum("n").alias("n_pred"))
    rows = gold.join(pred, "c", "left").fillna(0, ["n_pred"])
    f1 = F.coalesce(2 * F.col("tp") / F.nullif(F.col("n_gold") + F.col("n_pred"), F.lit(0)), F.lit(0.0))
    return rows.agg(F.avg(f1).alias("lithology_f1"))


def per_site(sites: DataFrame) -> DataFrame:
    """A row of counts and ratios for each site of `compared` that has a gold boundary."""
    rows = sites.where("gold_boundaries > 0").select("bgs_id", *COUNTS)
    return rows.withColumns({
        "boundary_recall": ratio(F.col("boundary_hits"), F.col("gold_boundaries")),
        "boundary_precision": ratio(F.col("pred_hits"), F.col("pred_boundaries")),
        "depth_accuracy": ratio(F.col("correct"), F.col("samples")),
    })


def pooled(sites: DataFrame) -> DataFrame:
    """One row over all sites: n_gold, boundary_recall, boundary_precision, depth_accuracy."""
    return sites.agg(
        F.count(F.lit(1)).alias("n_gold"),
        ratio(F.sum("boundary_hits"), F.sum("gold_boundaries")).alias("boundary_recall"),
        ratio(F.sum("pred_hits"), F.sum("pred_boundaries")).alias("boundary_precision"),
        ratio(F.sum("correct"), F.sum("samples")).alias("depth_accuracy"),
    )


def coverage(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row: n_gold, n_pred (gold sites with a predicted log) and n_missing."""
    has = pred.select("bgs_id").distinct().withColumn("has", F.lit(1))
    rows = gold.select("bgs_id").distinct().join(has, "bgs_id", "left")
    return rows.agg(F.count(F.lit(1)).alias("n_gold"), F.count("has").alias("n_pred"), F.count_if(F.col("has").isNull()).alias("n_missing"))


def band(confidence: Column) -> Column:
    return F.when(confidence.isNull(), "none").when(confidence < 0.5, "<0.5").when(confidence < 0.8, "0.5-0.8").when(confidence < 0.95, "0.8-0.95").otherwise(">=0.95")


def confidence_bands(pred: DataFrame) -> DataFrame:
    """band, n for every band, also those without intervals."""
    counted = pred.groupBy(band(F.col("confidence")).alias("band")).agg(F.count(F.lit(1)).alias("n"))
    every = pred.sparkSession.createDataFrame([(b,) for b in BANDS], "band string")
    return every.join(counted, "band", "left").select("band", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def confidence_warnings(bands: DataFrame) -> DataFrame:
    """One row: no_confidences, collapsed (at most one band is used, over COLLAPSE_N intervals or more)."""
    none = F.coalesce(F.sum(F.when(F.col("band") == "none", F.col("n"))), F.lit(0))
    used, total = F.count_if((F.col("band") != "none") & (F.col("n") > 0)), F.sum("n")
    silent = (none > 0) & (none == total)
    return bands.agg(silent.alias("no_confidences"), (~silent & (used <= 1) & (total >= COLLAPSE_N)).alias("collapsed"))


def gates(metrics: DataFrame, g: Gates = Gates()) -> DataFrame:
    """metrics (n_gold, boundary_recall, lithology_f1) with a boolean for each gate and gates_passed; null fails."""
    at_least = lambda c, least: F.coalesce(F.col(c) >= least, F.lit(False))
    rows = metrics.withColumns({
        "enough_gold": at_least("n_gold", g.min_gold_boreholes), "recall_ok": at_least("boundary_recall", g.min_boundary_recall), "f1_ok": at_least("lithology_f1", g.min_lithology_f1),
    })
    return rows.withColumn("gates_passed", F.col("enough_gold") & F.col("recall_ok") & F.col("f1_ok"))


def evaluate(gold: DataFrame, pred: DataFrame, g: Gates = Gates()) -> DataFrame:
    """One row of pooled metrics and gates. One pass over the logs: a site's counts and its confusion are rows of one
    aggregation, of a row for each pair of classes and one for the counts, which is written."""
    sites = compared(gold, pred, g.boundary_tolerance_m)
    own = F.struct(F.lit(None).cast("string").alias("gold_class"), F.lit(None).cast("string").alias("pred_class"), F.lit(None).cast("long").alias("n"), *COUNTS)
    cell = lambda c: F.struct(c["gold_class"].alias("gold_class"), c["pred_class"].alias("pred_class"), c["n"].alias("n"), *(F.lit(None).cast("long").alias(x) for x in COUNTS))
    rows = sites.select(F.inline(F.concat(F.filter(F.array(own), lambda x: x["gold_boundaries"] > 0), F.transform("confusion", cell))))
    sums = cut(rows.groupBy("gold_class", "pred_class").agg(F.count("gold_boundaries").alias("n_gold"), F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in COUNTS)))
    row = sums.agg(
        F.coalesce(F.sum("n_gold"), F.lit(0)).alias("n_gold"), ratio(F.sum("boundary_hits"), F.sum("gold_boundaries")).alias("boundary_recall"),
        ratio(F.sum("pred_hits"), F.sum("pred_boundaries")).alias("boundary_precision"), ratio(F.sum("correct"), F.sum("samples")).alias("depth_accuracy"),
    )
    return gates(row.join(F.broadcast(macro_f1(sums.where("n is not null"))), F.lit(True)), g)


def report(metrics: DataFrame, bands: DataFrame, source: str) -> tuple[str, str]:
    """(markdown, JSON) of a metric row and the bands; site_report has a row for each site."""
    m, b = metrics.first().asDict(), {r.band: r.n for r in bands.collect()}
    share = lambda v: "n/a" if v is None else f"{100 * v:.1f}%"
    names = ("boundary_recall", "boundary_precision", "depth_accuracy", "lithology_f1")
    lines = [f"# Evaluation of {source}", "", f"Gold sites: {m['n_gold']}. Gates {'passed' if m['gates_passed'] else 'not passed'}.", "", "| metric | value |", "|-|-|"]
    lines += [f"| {n} | {share(m[n])} |" for n in names]
    lines += ["", "Confidence: " + ", ".join(f"{k} {b.get(k, 0)}" for k in BANDS)]
    return "\n".join(lines) + "\n", json.dumps({"source": source, **m, "confidence_bands": b}, indent=1)


def site_report(sites: DataFrame, path: str) -> None:
    """Writes the rows of per_site, by site, as JSON lines under path; nulls stay out."""
    sites.orderBy("bgs_id").write.json(path)
