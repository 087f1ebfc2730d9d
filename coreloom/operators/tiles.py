"""Work on places dealt into even units: pairs within a reach, and the nearest place of another site.

What lies within a reach of each other meets in square cells; of a cell with many rows, both sides are dealt into blocks,
and each pair of blocks is a unit of its own. So no unit grows with a cell, however dense it is, and a row is sent to as
many units as there are blocks that it has to meet. Units run in NumPy, in a stream of rows sorted by unit.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut

#: Rows of each side of a unit, at most about.
BLOCK = 1024
#: Places of a tile, as long as there are few enough tiles; the table of their boxes goes to every task.
TILE, MOST_TILES = 2048, 1 << 16
#: Places of a leaf of the tree in a tile.
LEAF = 128
#: Distances that are computed at once.
PAIRS = 1 << 22
#: Rows of a cell, and rows about it, that `around` takes as one unit. Cells up to which their sizes go to every task.
ROWS, MANY, SENT = 1024, 4096, 1 << 19

UNIT = ("_cx", "_cy", "_i", "_j")


def extent(places: DataFrame) -> tuple[int, float, float, float, float]:
    """(rows, least x, least y, width, height) of places with x and y."""
    r = places.agg(F.count(F.lit(1)), F.min("x"), F.min("y"), F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    return (r[0], *(float(v or 0.0) for v in r[1:]))


def by_unit(batches: Iterator[pd.DataFrame], unit_columns: tuple[str, ...] = UNIT) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """(queries, points) of each unit, from rows that are sorted by unit."""
    held: list[pd.DataFrame] = []
    now = None

    def done() -> tuple[pd.DataFrame, pd.DataFrame]:
        rows = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        return rows[rows._asks], rows[~rows._asks]

    for b in batches:
        keys = b[list(unit_columns)].to_numpy()
        ends = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for a, z in zip([0, *ends], [*ends, len(b)]):
            if a == z:
                continue
            unit = tuple(keys[a])
            if held and unit != now:
                yield done()
                held = []
            held.append(b.iloc[a:z])
            now = unit
    if held:
        yield done()


def in_units(queries: DataFrame, points: DataFrame, reach: float, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, block: int = BLOCK) -> DataFrame:
    """What run(queries, points) gives over units in which every query (x, y and more) meets every point (likewise) whose
    coordinates each differ by `reach` at most; it meets others too. A query with many points about it is in several
    units: what run says of a query is a part of a sum. Both sides are read twice."""
    spark = queries.sparkSession
    n, x0, y0, w, h = extent(queries.select("x", "y"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    block = max(16, min(block, n // (4 * tasks)))
    side = max(reach, math.sqrt(w * h * block / max(n, 1) / 2))
    cell = lambda c, o: F.floor((c - F.lit(o)) / F.lit(side)).cast("long")
    q = queries.withColumns({"_cx": cell(F.col("x"), x0), "_cy": cell(F.col("y"), y0)})
    spread = lambda c, o: F.explode(F.sequence(cell(F.col(c) - reach, o), cell(F.col(c) + reach, o)))
    p = points.withColumn("_cx", spread("x", x0)).withColumn("_cy", spread("y", y0))
    count = lambda df, name: df.groupBy("_cx", "_cy").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias(name))
    sizes = cut(count(q, "_nq").join(count(p, "_np"), ["_cx", "_cy"]))
    if sizes.count() <= SENT:  # else the rows are shuffled once more
        sizes = F.broadcast(sizes)
    deal = lambda df, n: F.pmod(F.xxhash64(*(c for c in df.columns if not c.startswith("_") and df.schema[c].dataType.typeName() != "array")), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = q.join(sizes, ["_cx", "_cy"]).withColumns({"_i": deal(queries, "_nq"), "_j": every("_np"), "_asks": F.lit(True)}).drop("_nq", "_np")
    held = p.join(sizes, ["_cx", "_cy"]).withColumns({"_j": deal(points, "_np"), "_i": every("_nq"), "_asks": F.lit(False)}).drop("_nq", "_np")

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for a, b in by_unit(batches):
            if len(a) and len(b):
                yield run(a, b)

    both = asked.unionByName(held, allowMissingColumns=True)
    return both.repartition(*UNIT).sortWithinPartitions(*UNIT).mapInPandas(over, schema)


def around(rows: DataFrame, reach: float, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, cell: int = ROWS, many: int = MANY) -> tuple[DataFrame, DataFrame | None]:
    """(What run(queries, points) gives over square cells of about `cell` rows; the rows of cells that have more than `many`
    points, which are left to in_units: None if there are none). The queries are the rows (x, y and more) of a cell, the
    points these and all others within `reach` of it, so what run says of a query is whole: no sums are shuffled. A row is
    sent once to each cell that it is within reach of. Rows are read twice."""
    spark = rows.sparkSession
    n, x0, y0, w, h = extent(rows.select("x", "y"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    side = max(reach, math.sqrt(w * h * max(16, min(cell, n // (4 * tasks))) / max(n, 1)))
    at = lambda c, o: F.floor((c - F.lit(o)) / F.lit(side)).cast("long")
    own = rows.where("x is not null and y is not null").withColumns({"_ox": at(F.col("x"), x0), "_oy": at(F.col("y"), y0)})
    spread = lambda c, o: F.explode(F.sequence(at(F.col(c) - reach, o), at(F.col(c) + reach, o)))
    sent = own.withColumn("_cx", spread("x", x0)).withColumn("_cy", spread("y", y0))
    sent = sent.withColumn("_asks", (F.col("_cx") == F.col("_ox")) & (F.col("_cy") == F.col("_oy"))).drop("_ox", "_oy")
    sizes = cut(sent.groupBy("_cx", "_cy").agg(F.count(F.lit(1)).alias("_n"), F.max("_asks").alias("_some")))
    out = sizes.where((F.col("_n") > many) | ~F.col("_some")).select("_cx", "_cy")  # of too many points, or without a query
    left = sent.join(F.broadcast(out) if out.count() <= SENT else out, ["_cx", "_cy"], "left_anti")

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for a, b in by_unit(batches, ("_cx", "_cy")):
            yield run(a, pd.concat((a, b), ignore_index=True))

    found = left.repartition("_cx", "_cy").sortWithinPartitions("_cx", "_cy").mapInPandas(over, schema)
    dense = sizes.where((F.col("_n") > many) & F.col("_some")).select(F.col("_cx").alias("_ox"), F.col("_cy").alias("_oy"))
    return found, own.join(dense, ["_ox", "_oy"], "left_semi").drop("_ox", "_oy") if dense.head(1) else None


def stacked(df: DataFrame, place: list[str], fields: list[str]) -> DataFrame:
    """A row for each place, with the fields of its rows as arrays, in the order of the fields. A log reaches 3,000 m at
    most, so what stands above each other is bounded by the step of its samples."""
    rows = df.groupBy(*place).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_s"))
    return rows.select(*place, *(F.col("_s")[f].alias(f"{f}s") for f in fields))


def flat(arrays: pd.Series, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, all values) of a column of arrays."""
    sizes = np.fromiter(map(len, arrays), np.int64, len(arrays))
    return np.concatenate(([0], sizes.cumsum())), np.concatenate([np.asarray(a, dtype) for a in arrays]) if len(arrays) else np.zeros(0, dtype)


def ramps(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each size, one after the other."""
    ends = sizes.cumsum()
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


# --- the nearest place of another site


def nearest(q: tuple[np.ndarray, np.ndarray, np.ndarray], p: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(squared distance, id) of the nearest p of another id for each q (ids, x, y); ties to the smaller id; infinite without."""
    best, who = np.full(len(q[0]), np.inf), np.zeros(len(q[0]), np.int64)
    step = max(1, PAIRS // max(1, len(p[0])))
    for i in range(0, len(q[0]) if len(p[0]) else 0, step):
        s = slice(i, i + step)
        d2 = np.square(q[1][s, None] - p[1][None]) + np.square(q[2][s, None] - p[2][None])
        d2[q[0][s, None] == p[0][None]] = np.inf
        best[s] = d2.min(1)
        who[s] = np.where(d2 == best[s, None], p[0][None], np.iinfo(np.int64).max).min(1)
    return best, who


def _box(p: tuple[np.ndarray, np.ndarray, np.ndarray], at: np.ndarray) -> np.ndarray:
    """x0, x1, y0, y1 of each run of places that begins at one of `at`."""
    return np.stack([f.reduceat(c, at) for c in p[1:] for f in (np.minimum, np.maximum)])


def _gap2(lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> np.ndarray:
    return np.square(np.maximum(np.maximum(lo - hi2, lo2 - hi), 0.0))


class Leaves:
    """A tile's places, in the order of the curve, under leaves with boxes."""

    def __init__(self, p: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.p, self.at = p, np.arange(0, len(p[0]), LEAF)
        self.box = _box(p, self.at)

    def nearest(self, q: tuple[np.ndarray, np.ndarray, np.ndarray], radius2: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """As nearest, within the squared radius of each query; queries in the order of the curve share their leaves."""
        best, who = np.full(len(q[0]), np.inf), np.zeros(len(q[0]), np.int64)
        for i in range(0, len(q[0]), LEAF):
            s = slice(i, i + LEAF)
            part = tuple(c[s] for c in q)
            x0, x1, y0, y1 = (f(c) for c in part[1:] for f in (np.min, np.max))
            far = _gap2(x0, x1, self.box[0], self.box[1]) + _gap2(y0, y1, self.box[2], self.box[3])
            order = np.argsort(far, kind="stable")
            worst = np.inf if radius2 is None else radius2[s].max()
            b, w = np.full(len(part[0]), np.inf), np.zeros(len(part[0]), np.int64)
            for k in range(0, len(order), 4):
                leaves = order[k : k + 4]
                if far[leaves[0]] > min(worst, b.max()):
                    break
                take = np.concatenate([np.arange(self.at[n], min(self.at[n] + LEAF, len(self.p[0]))) for n in leaves])
                d, c = nearest(part, tuple(v[take] for v in self.p))
                closer = (d < b) | (d == b) & (c < w)
                b, w = np.where(closer, d, b), np.where(closer, c, w)
            best[s], who[s] = b, w
        return best, who


def _curve(c: Column, lo: float, size: float) -> Column:
    """16 bits of a coordinate, with gaps between them."""
    v = F.least(F.floor((c - lo) * (65535.0 / max(size, 1e-9))), F.lit(65535)).cast("long")
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def morton(x: Column, y: Column, x0: float, y0: float, w: float, h: float) -> Column:
    """Place on the curve of interleaved bits."""
    return _curve(x, x0, w).bitwiseOR(F.shiftleft(_curve(y, y0, h), 1))


def nearest_other(places: DataFrame, tile: int = TILE) -> DataFrame:
    """bgs_id, nearest: for each place (bgs_id, x, y) the nearest place of another id; ties to the smaller id. A site alone
    has none.

    Places are dealt in the order of a space-filling curve into even tiles, each with a tree of boxes. Each place is asked
    of its own tile; only where another tile's box is no farther than what was found there is it asked of that one too.
    """
    n, x0, y0, w, h = extent(places)
    tiles = max(1, min(MOST_TILES, -(-n // tile)))
    keyed = places.select("bgs_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), morton(F.col("x"), F.col("y"), x0, y0, w, h).alias("key"))
    columns = "tile int, bgs_id long, x double, y double, d2 double, nearest long"

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = list(batches)
        if rows:
            t = pd.concat(rows, ignore_index=True)
            p = (t.bgs_id.to_numpy(np.int64), t.x.to_numpy(float), t.y.to_numpy(float))
            d2, who = Leaves(p).nearest(p)
            yield pd.DataFrame({"tile": np.int32(TaskContext.get().partitionId()), "bgs_id": p[0], "x": p[1], "y": p[2], "d2": d2, "nearest": who})

    first = cut(keyed.repartitionByRange(tiles, "key", "bgs_id").sortWithinPartitions("key", "bgs_id").mapInPandas(own, columns))
    boxes = first.groupBy("tile").agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).orderBy("tile").collect()  # MOST_TILES rows at most
    names, box = np.array([b[0] for b in boxes], np.int32), np.array([b[1:] for b in boxes], float).reshape(-1, 4).T

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t, rows in b.groupby("tile", sort=False):
                x, y, d2 = rows.x.to_numpy(), rows.y.to_numpy(), rows.d2.to_numpy()
                near = np.flatnonzero((_gap2(x.min(), x.max(), box[0], box[1]) + _gap2(y.min(), y.max(), box[2], box[3]) <= d2.max()) & (names != t))
                for k in near:
                    at = np.flatnonzero(_gap2(x, x, box[0, k], box[1, k]) + _gap2(y, y, box[2, k], box[3, k]) <= d2)
                    if len(at):
                        yield rows.iloc[at].assign(tile=names[k])

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for a, p in by_unit(batches):
            if len(a) and len(p):
                q, held = ((r.bgs_id.to_numpy(np.int64), r.x.to_numpy(float), r.y.to_numpy(float)) for r in (a, p))
                d2, who = Leaves(held).nearest(q, a.d2.to_numpy())
                yield pd.DataFrame({"bgs_id": q[0], "d2": d2, "nearest": who})

    asked = first.mapInPandas(others, columns).withColumn("_asks", F.lit(True))
    # a tile that very many ask is dealt into parts, each of which has its places
    parts = asked.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / F.lit(8 * tile)).cast("int").alias("parts"))
    deal = lambda df, j: df.join(parts, "tile").withColumn("_j", j).drop("parts")
    both = deal(asked, F.pmod(F.xxhash64("bgs_id"), F.col("parts")).cast("int")).unionByName(deal(first.withColumn("_asks", F.lit(False)), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
    both = both.withColumns({"_cx": F.col("tile"), "_cy": F.lit(0), "_i": F.lit(0), "key": morton(F.col("x"), F.col("y"), x0, y0, w, h)}).drop("tile")
    found = both.repartition("_cx", "_j").sortWithinPartitions("_cx", "_j", "key").mapInPandas(answer, "bgs_id long, d2 double, nearest long")
    best = first.select("bgs_id", "d2", "nearest").unionByName(found).where(F.col("d2") < F.lit(float("inf")))
    return best.groupBy("bgs_id").agg(F.min(F.struct("d2", "nearest")).alias("b")).select("bgs_id", "b.nearest")
