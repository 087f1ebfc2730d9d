"""Approximate nearest neighbours along shifted space-filling curves.

Vectors are scaled to length 1 and projected, differently for each ordering, to DIRECTIONS of several bits each, after a
shift by a whole vector of the ordering's own; the rows lie along the Hilbert curve of these coordinates. Each ordering is
range-partitioned by key and gives every row a rank; a query meets the rows whose rank differs from its own by the window
at most. The rows of all windows are held against it in eight-bit precision; the best of all orderings are merged, their
vectors fetched by id, and reranked by the exact cosine.

The window is fitted: CALIBRATION queries, those of smallest hash, are answered by a scan of all rows, and the window is the
least that holds the share AIM of their neighbours in one ordering or another. So it adapts to how well the curves keep
what is near together: closely, where vectors lie in groups; hardly, where they are spread evenly over many dimensions.
Every row is indexed, every query answered; one that meets fewer than k rows of other ids meets all rows of an ordering.

Of equal vectors only the k + 1 rows of smallest id can be among anybody's k nearest, so the others are left out of the
curves; as queries, their nearest are the first k of their equals. Null vectors, vectors of zeros, and vectors with null
or non-finite components take no part, nor do rows whose id is null, nor vectors of another length than most have (of two
lengths as frequent, the larger counts). Repeated ids are rows of their own, but a row is never a neighbour of its own id.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, with_position

#: Orderings, directions of each, and bits of a direction.
ORDERINGS, DIRECTIONS, BITS = 16, 8, 6
#: Rows of an ordering that one task holds at once, and queries that it holds against them at once.
BLOCK, ASKED = 4096, 64
#: Queries that the window is fitted to, and the share of their neighbours that windows must hold.
CALIBRATION, AIM = 128, 0.95
#: Candidates that a task gathers before it sorts them, and queries that it keeps count of.
PENDING, SLOTS = 200_000, 1_000_000


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Key along the Hilbert curve of each row of integer coordinates below 2^bits (at most 63 bits in all).

    From the highest bit down: a coordinate's bit says whether the sub-cube is entered mirrored or with this axis
    exchanged for the first; then the bits are read as a Gray code.
    """
    x = cells.astype(np.int64).T.copy()
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for axis in x:
            high = (axis >> b & 1).astype(bool)
            swap = np.where(high, 0, (x[0] ^ axis) & low)
            x[0] ^= np.where(high, low, swap)
            axis ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | (axis >> b & 1)
    return key


class Curve:
    """An ordering: its directions, orthonormal among themselves and with those of its neighbours, and its shift."""

    def __init__(self, ordering: int, length: int, seed: int):
        d = min(DIRECTIONS, length)
        per = length // d  # orderings that share one basis
        basis = np.linalg.qr(np.random.default_rng([seed, ordering // per]).standard_normal((length, length)))[0]
        self.directions = basis[:, ordering % per * d : (ordering % per + 1) * d] * math.sqrt(length)
        self.shift = np.random.default_rng([seed, ordering, 1]).uniform(0, 1, d)

    def key(self, unit: np.ndarray) -> np.ndarray:
        """Keys of unit vectors: places along the directions, in standard deviations of a random one up to four, are
        shifted by up to the whole range, and the range is twice as wide for it."""
        place = (np.clip(unit @ self.directions / 8 + 0.5, 0, 1) + self.shift) / 2
        return hilbert(np.minimum((place * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec (array<double>) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: F.coalesce((F.abs(x) < float("inf")), F.lit(False)))
    rows = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).where(finite & F.exists("vec", lambda x: x != 0))
    lengths = rows.groupBy(F.size("vec").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).head(1)
    return rows.where(F.size("vec") == lengths[0]["length"]) if lengths else rows


def _matrix(col) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.float64) for x in col])


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def coded(unit: np.ndarray) -> np.ndarray:
    """Eight bits for each component, of the largest."""
    return np.rint(unit * (127 / np.abs(unit).max(axis=1, keepdims=True))).astype(np.int8)


def decoded(codes: pd.Series) -> np.ndarray:
    """Unit vectors of codes, in single precision."""
    x = np.stack([np.frombuffer(c, np.int8) for c in codes]).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def scan(rows: DataFrame, asked: list, k: int) -> DataFrame:
    """ask (place in asked), row, score: the k nearest of rows(row, id, vec) to each of `asked` (row, id, vec), which go
    to every task, by a product of matrices."""
    sent = rows.sparkSession.sparkContext.broadcast(([a.id for a in asked], [bytes(a.vec) for a in asked]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = np.array(sent.value[0], np.int64), units(_matrix(sent.value[1]))
        best, found = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        for b in batches:
            for at in range(0, len(b), 1024):
                part = b.iloc[at : at + 1024]
                s = q @ units(_matrix(part.vec)).T
                s[ids[:, None] == part.id.to_numpy()] = -np.inf
                s, row = np.concatenate((best, s), axis=1), np.concatenate((found, np.broadcast_to(part.row.to_numpy(), s.shape)), axis=1)
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                best, found = np.take_along_axis(s, top, 1), np.take_along_axis(row, top, 1)
        ask, place = np.nonzero(best > -np.inf)
        yield pd.DataFrame({"ask": ask, "row": found[ask, place], "score": best[ask, place]})

    near = rows.select("row", "id", "vec").mapInPandas(run, "ask long, row long, score double")
    return near.withColumn("n", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "row"))).where(F.col("n") <= k).drop("n")


def fitted(shown: DataFrame, placed: DataFrame, n: int, k: int) -> int:
    """The window: a difference in rank. placed: ordering, rank and row of every row shown."""
    asked = shown.where("is_query").orderBy(F.xxhash64("id"), "row").limit(CALIBRATION).select("row", "id", "vec").collect()
    near = scan(shown, asked, k).collect() if asked else []  # CALIBRATION x k rows
    if not near:
        return n
    pairs = [(asked[r.ask].row, r.row) for r in near]
    wanted = shown.sparkSession.createDataFrame([(r,) for r in {x for p in pairs for x in p}], "row long")
    rank: dict[int, np.ndarray] = {}
    for r in placed.join(F.broadcast(wanted), "row").select("ordering", "rank", "row").collect():
        rank.setdefault(r.row, np.zeros(ORDERINGS, np.int64))[r.ordering] = r["rank"]
    apart = np.array([np.abs(rank[a] - rank[b]).min() for a, b in pairs])
    return int(max(np.quantile(apart, AIM, method="higher"), 2 * k + 2))


class Best:
    """The best few candidates of each query, from many windows."""

    def __init__(self, few: int):
        self.few = few
        self.clear()

    def clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.least = np.empty(0)
        self.pending: list[tuple] = []
        self.n = 0

    def slots(self, queries: np.ndarray) -> np.ndarray:
        """Places in `least`, the scores that candidates must reach."""
        out = np.array([self.slot.setdefault(q, len(self.slot)) for q in queries.tolist()], np.int64)
        if len(self.slot) > len(self.least):
            self.least = np.concatenate((self.least, np.full(len(self.slot), -np.inf)))
        return out

    def add(self, slots: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> None:
        self.pending.append((slots, rows, scores))
        self.n += len(slots)
        if self.n > PENDING:
            self.sort()

    def sort(self) -> None:
        slot, row, score = (np.concatenate(x) for x in zip(*self.pending))
        once = np.unique(np.stack((slot, row)), axis=1, return_index=True)[1]
        slot, row, score = slot[once], row[once], score[once]
        order = np.lexsort((-score, slot))
        slot, row, score = slot[order], row[order], score[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        full, keep = rank == self.few - 1, rank < self.few
        self.least[slot[full]] = score[full]
        self.pending, self.n = [(slot[keep], row[keep], score[keep])], 0

    def take(self) -> pd.DataFrame:
        if not self.pending:
            return pd.DataFrame({"query": [], "row": [], "score": []}).astype({"query": "int64", "row": "int64", "score": "float64"})
        self.sort()
        slot, row, score = self.pending[0]
        out = pd.DataFrame({"query": np.fromiter(self.slot, np.int64, len(self.slot))[slot], "row": row, "score": score})
        self.clear()
        return out


def meet(dealt: DataFrame, few: int) -> DataFrame:
    """query, row, score: the best few that windows give each query. dealt: within partitions, block by block, the rows
    (`asks` false) before the queries, these with the ranks that they meet; both in order of rank."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, now, held, table = Best(few), None, [], None
        for b in batches:
            key = b[["ordering", "block", "asks"]].to_numpy(np.int64)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(b)]):
                part, group = b.iloc[lo:hi], tuple(key[lo, :2])
                if group != now:
                    now, held, table = group, [], None
                if not key[lo, 2]:
                    held.append(part[["row", "id", "code", "rank"]])
                    continue
                if table is None:
                    have = pd.concat(held)
                    table = have.row.to_numpy(np.int64), have.id.to_numpy(np.int64), decoded(have.code), have["rank"].to_numpy(np.int64)
                rows, ids, code, ranks = table
                slots, own, first, last = best.slots(part.row.to_numpy(np.int64)), part.id.to_numpy(np.int64), part["first"].to_numpy(np.int64), part["last"].to_numpy(np.int64)
                q = decoded(part.code)
                for i in range(0, len(q), ASKED):
                    c = slice(i, i + ASKED)
                    a, z = np.searchsorted(ranks, first[c].min()), np.searchsorted(ranks, last[c].max(), side="right")
                    s = q[c] @ code[a:z].T
                    inside = (first[c, None] <= ranks[None, a:z]) & (ranks[None, a:z] <= last[c, None])
                    x, y = np.nonzero(inside & (s > best.least[slots[c]][:, None]) & (own[c, None] != ids[None, a:z]))
                    if len(x):
                        best.add(slots[c][x], rows[a + y], s[x, y].astype(np.float64))
            if len(best.slot) > SLOTS:
                yield best.take()
        yield best.take()

    return dealt.mapInPandas(run, "query long, row long, score double")


def visited(placed: DataFrame, asked: DataFrame, few: int) -> DataFrame:
    """As meet. placed: ordering, rank, row, id and code of all rows; asked: the same of queries, with the first and last rank
    that they meet."""
    block = lambda c: F.floor(F.col(c) / F.lit(BLOCK)).cast("long")
    cols = ["ordering", "block", "asks", "rank", "row", "id", "code", "first", "last"]
    none = F.lit(None).cast("long")
    held = placed.withColumns({"block": block("rank"), "asks": F.lit(False), "first": none, "last": none})
    asks = asked.withColumns({"block": F.explode(F.sequence(block("first"), block("last"))), "asks": F.lit(True)})
    order = ["ordering", "block", "asks", "rank"]
    return meet(held.select(cols).union(asks.select(cols)).repartition("ordering", "block").sortWithinPartitions(*order), few)


def search(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 11, measured: dict | None = None) -> DataFrame:
    """query_id, rank, id, score: of each row of vectors for which is_query(id column) holds, the k nearest found.
    measured: gets the number of rows on the curves, of queries, and of rows that these meet in all their windows."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "ann")

    def to_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b.id, "vec": [np.asarray(x, np.float64).tobytes() for x in b.vec]})

    rows = usable(vectors, id_col, vec_col).mapInPandas(to_bytes, "id long, vec binary")
    rows = scratch.put("rows", rows.withColumn("is_query", is_query(F.col("id"))).withColumn("row", F.monotonically_increasing_id()))
    place = F.row_number().over(Window.partitionBy("vec").orderBy("id", "row"))
    shown = scratch.put("shown", rows.withColumn("copy", place).where(F.col("copy") <= k + 1))
    n, length = shown.count(), next((len(r.vec) // 8 for r in shown.select("vec").head(1)), 1)
    curves = [Curve(o, length, seed) for o in range(ORDERINGS)]

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = units(_matrix(b.vec))
                code = [c.tobytes() for c in coded(x)]
                for o, c in enumerate(curves):
                    yield pd.DataFrame({"ordering": o, "key": c.key(x), "row": b.row, "id": b.id, "is_query": b.is_query, "code": code})

    keys = shown.select("row", "id", "vec", "is_query").mapInPandas(keyed, "ordering int, key long, row long, id long, is_query boolean, code binary")
    ranked = with_position(keys, ["ordering", "key", "row"], scratch, "keys")  # n rows of each ordering, one after the other
    placed = scratch.put("curves", ranked.select("ordering", (F.col("position") - F.col("ordering") * F.lit(n).cast("long")).alias("rank"), "row", "id", "is_query", "code"))
    scratch.drop("keys")
    window = fitted(shown, placed, n, k) if n else 0
    most = F.lit(max(n - 1, 0)).cast("long")
    asked = placed.where("is_query").withColumns({"first": F.greatest(F.col("rank") - window, F.lit(0)), "last": F.least(F.col("rank") + window, most)})
    if measured is not None:
        met = asked.agg(F.sum(F.col("last") - F.col("first"))).first()[0]
        measured |= {"rows": n, "queries": shown.where("is_query").count(), "met": met or 0, "window": window}

    # the best of all partitions; then exact scores of twice as many as are asked for
    order = Window.partitionBy("query").orderBy(F.desc("score"), "row")
    best = lambda met: met.groupBy("query", "row").agg(F.max("score").alias("score")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= 2 * k + 2).select("query", "row")
    pairs = scratch.put("pairs", best(visited(placed, asked, 2 * k + 2)))
    enough = pairs.groupBy("query").count().where(F.col("count") >= min(k, n - 1))
    short = scratch.put("short", shown.where("is_query").join(enough, shown.row == enough["query"], "left_anti").select("row"))
    if 2 * window + 1 < n and short.head(1):
        one = placed.where("ordering = 0")
        whole = one.join(short, "row").withColumns({"first": F.lit(0).cast("long"), "last": most})
        pairs = scratch.put("pairs-of-all", pairs.join(short, pairs["query"] == short.row, "left_anti").union(best(visited(one, whole, 2 * k + 2))))
        scratch.drop("pairs")
    scratch.drop("curves")
    copies = shown.groupBy("vec").agg(F.collect_list("row").alias("firsts"))  # k + 1 at most
    late = rows.where("is_query").join(shown.select("row"), "row", "left_anti").join(copies, "vec")
    pairs = pairs.union(late.select(F.col("row").alias("query"), F.explode("firsts").alias("row")))
    asker = rows.select(F.col("row").alias("query"), F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    both = pairs.join(rows.select("row", "id", "vec"), "row").join(asker, "query").where("id <> query_id")

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"query_id": b.query_id, "id": b.id, "score": cosines(_matrix(b.vec), _matrix(b.query_vec))})

    scored = both.select("query_id", "id", "vec", "query_vec").mapInPandas(exact, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.groupBy("query_id", "id").agg(F.max("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
