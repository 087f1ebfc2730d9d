"""Jaccard join of texts on word n-grams, by signature trees.

A text is the set of its distinct shingles. Sets that reach a similarity share a token among the first few of each, in any
one order of all tokens (rare ones first, here). Every token that two sets or more have among their first has a head, the
least of these sets, and the sets that have tokens of one head are a cell, so that sets that share many tokens meet in one
cell or a few. The sets of a cell are the leaves of a signature tree: sorted by cell, class and size, each run of sets is a
node, and runs of nodes are nodes again. A node holds the OR of its sets' token bitmaps and the range of their sizes, cells
and classes. Pairs of nodes are visited from the top (Spark joins nodes of many sets) down (tasks go on within them); a pair
is left where its cells or sizes can't fit, where all its sets are of one class already, or where the bits that the two
bitmaps share leave less overlap possible than the similarity needs.

Classes are what makes large groups of near copies cheap: before the trees are visited, each set is verified against one
representative of each of its cells, and what these links connect is one class, inside which no pair is visited.

Pairs never become rows. The first visit of two top nodes gives the sets of which a pair is left; their texts are read once
more. A second visit leaves out pairs by bitmaps as wide as large sets need, a third verifies pairs on the sets themselves
and gives no more links than connect what is similar: of a visit, fewer than it has sets. A pair whose sets are connected
already, by classes or by earlier links, isn't verified.

Tokens are 64-bit hashes, sets are known by 64-bit hashes of all their tokens. Tokens are ordered by the
count of their rarest word, from a table of 2^20 counts over all rows, whatever their number. It, classes and representatives change cost only; every two sets of the
similarity or more end in one class.

A text of fewer words than a shingle is one shingle; a null text, or one without words, is empty and linked with nothing.
Null doc_ids take part; a class without any other has none. Repeated rows are of one class. An empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, Scratch, remixed, rows_at_once, set_id, with_position
from .graph import components

#: log2 of the table of word counts, which goes to every task.
COUNT_BITS, SEGMENT = 20, 4096
#: Bits of a set's bitmap, of the wider one at least.
BITS = 2048
#: Sets of a top node, which is one task's work with itself and with each other node that isn't pruned; children of a node.
BLOCK, FAN = 512, 8
#: A cell's representatives are the sets that come first in these orders; sets are verified against those of the cells of
#: their first tokens of those that others have too. Speed only.
ORDERS, EARLY = (0, 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D, 0x14057B7EF767814F), 8
#: How far representatives' links are followed for classes. Speed only.
STEPS = 3
#: Pairs of bitmaps that are held against each other at once.
PAIRS = 1 << 15
#: Rows that a task is handed, and turns to arrays, at once.
ROWS = 1000
#: Sets that a task is handed with their tokens at once.
SETS = 200
#: Bytes of text whose words are hashed at once, if no single text is longer; words of so many bytes are hashed one by one.
TEXTS, LONG = 1 << 20, 256
SPACE_BYTES = np.isin(np.arange(256), np.frombuffer(SPACES.encode(), np.uint8))
#: Up to so many sets that have to be read again are sent to every task as a filter; more are joined by a shuffle. Speed only.
SENT = 1 << 20
#: What stands for a null doc_id.
LAST = (1 << 63) - 1


def needed(a, b, percent: int):
    """The least overlap of sets of sizes a and b (or more) at which they are similar."""
    return -(-percent * (a + b) // (100 + percent))


def n_first(size: int, percent: int) -> int:
    """How many of a set's tokens have one in common with those of any similar set."""
    return size - -(-percent * size // 100) + 1


def word_hashes(b: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each word, of its bytes eight at a time. b: bytes, with eight after the last word."""
    eight = np.ndarray((len(b) - 7,), "<u8", b, strides=(1,))
    masks = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    h = remixed(remixed(sizes.astype(np.uint64), 1) ^ eight[starts] & masks[np.minimum(sizes, 8)], 2)
    more, at = np.flatnonzero(sizes > 8), 8
    while len(more) and at < LONG:
        h[more] = remixed(h[more] ^ eight[starts[more] + at] & masks[np.minimum(sizes[more] - at, 8)], 3)
        at += 8
        more = more[sizes[more] > at]
    for i in more:
        h[i] = xxhash.xxh64_intdigest(b[starts[i] : starts[i] + sizes[i]].tobytes(), 42)
    return h


def texts_at_once(texts: Iterable[bytes | None]) -> Iterator[list[bytes]]:
    part: list[bytes] = []
    size = 0
    for t in texts:
        if part and size + len(t or b"") > TEXTS:
            yield part
            part, size = [], 0
        part.append(t or b"")
        size += len(part[-1])
    if part:
        yield part


def words_of_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, place of each text's first word and the number of all)."""
    b = np.frombuffer((b" ".join(texts) + b" " * 8).lower(), np.uint8)  # lower() of bytes: A-Z alone
    edge = np.flatnonzero(np.diff(SPACE_BYTES[b], prepend=True))  # words begin and end by turns
    starts = edge[::2]
    return word_hashes(b, starts, edge[1::2] - starts), np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))


def token_sets(texts: Iterable[bytes | None], shingle: int, heat: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """(sorted distinct tokens, heat of each) of each text: a shingle's hash is made of its words' hashes and their places,
    its heat is that of its rarest word."""
    for part in texts_at_once(texts):
        h, first = words_of_texts(part)
        warm = None if heat is None else heat[(h & np.uint64(len(heat) - 1)).astype(np.int64)]

        def combined(a: int, z: int, k: int) -> tuple[np.ndarray, np.ndarray | None]:
            n = z - a - k + 1
            total = np.full(n, k, np.uint64)
            for i in range(k):
                total += remixed(h[a + i : a + i + n], i + 4)
            low = None if warm is None else np.minimum.reduce([warm[a + i : a + i + n] for i in range(k)])
            return remixed(total, 0), low

        tokens, low = combined(0, len(h), shingle) if len(h) >= shingle else (h[:0], None)
        for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
            k = min(shingle, z - a)
            if not k:
                yield h[:0], np.zeros(0, np.uint8)
                continue
            t, w = (tokens[a : z - k + 1], None if low is None else low[a : z - k + 1]) if k == shingle else combined(a, z, k)
            if w is None:
                yield np.unique(t), None
            else:
                t, at = np.unique(t, return_index=True)
                yield t, w[at]


def word_heat(docs: DataFrame) -> np.ndarray:
    """By the lowest COUNT_BITS bits of a word's hash, how often such words occur, in four steps for each power of two."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for b in batches:
            for part in texts_at_once(b._text):
                total += np.bincount((words_of_texts(part)[0] & np.uint64(len(total) - 1)).astype(np.int64), minlength=len(total))
        parts = total.reshape(-1, SEGMENT)
        some = np.flatnonzero(parts.any(1))
        yield pd.DataFrame({"part": some.astype(np.int32), "counts": [parts[i].tobytes() for i in some]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, counts in zip(b.part.tolist(), b.counts):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts, np.int64)
        yield pd.DataFrame({"part": np.array(list(sums), np.int32), "counts": [x.tobytes() for x in sums.values()]})

    schema = "part int, counts binary"
    n = np.zeros(1 << COUNT_BITS, np.int64)
    counted = docs.select(F.col("text").cast("binary").alias("_text")).mapInPandas(count, schema).repartition("part").mapInPandas(add, schema)
    with rows_at_once(docs.sparkSession, ROWS):
        found = counted.collect()  # 2^COUNT_BITS numbers
    for part, counts in found:
        n[part * SEGMENT : (part + 1) * SEGMENT] = np.frombuffer(counts, np.int64)
    return (4 * np.log2(n + 1)).astype(np.uint8)


def few_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for at in range(0, len(b), ROWS):
            yield b.iloc[at : at + ROWS]


def bitmap(tokens: np.ndarray, n: int = BITS) -> np.ndarray:
    bits = np.zeros(n, np.uint8)
    bits[(tokens >> np.uint64(COUNT_BITS)).astype(np.int64) % n] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def wide_bitmap(tokens: np.ndarray) -> np.ndarray:
    """A bitmap of a power of two of bits, two for each token at least."""
    return bitmap(tokens, max(BITS, 1 << (2 * len(tokens)).bit_length()))


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap as it is with so many words, which are no more than it has."""
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


def shingled(docs: DataFrame, shingle: int, percent: int, heat: np.ndarray) -> DataFrame:
    """Of every row of docs: doc_id, text_hash, set (its id), size, first (the tokens that come first) and bits."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in few_rows(batches):
            sets, first, bits = [], [], []
            for h, warm in token_sets(b._text, shingle, heat):
                order = warm.astype(np.uint64) << np.uint64(56) | remixed(h, 5) >> np.uint64(8)
                sets.append(h)
                first.append(h[np.argsort(order, kind="stable")[: n_first(len(h), percent)]].view(np.int64) if len(h) else np.zeros(0, np.int64))
                bits.append(bitmap(h))
            yield b.drop(columns="_text").assign(set=np.array([set_id(h) for h in sets], np.int64), size=np.array([len(h) for h in sets], np.int64), first=first, bits=bits)

    src = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("_text"))
    return src.mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, set long, size long, first array<long>, bits array<long>")


def _shared_bits(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(q))), F.lit(0), lambda n, k: n + k)


def _enough(x: str, y: str, percent: int) -> Column:
    """May sets of nodes x and y (prefixes of size0, size1, spare and bits) overlap enough?"""
    c = lambda p, n: F.col(f"{p}_{n}")
    most = _shared_bits(f"{x}_bits", f"{y}_bits") + F.least(c(x, "spare"), c(y, "spare"))
    return _fits(c(x, "size0"), c(x, "size1"), c(y, "size0"), c(y, "size1"), percent) & (most * (100 + percent) >= percent * (c(x, "size0") + c(y, "size0")))


def possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of sets that their sizes and bitmaps leave."""
    side = lambda k, p: nodes.select(F.col("set").alias(k), *(F.col(c).alias(f"{p}_{n}") for n, c in (("size0", "size"), ("size1", "size"), ("spare", "spare"), ("bits", "bits"))))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").where(_enough("x", "y", percent)).select("a", "b")


def read_again(docs: DataFrame, nodes: DataFrame, some: DataFrame, shingle: int, scratch: Scratch, name: str) -> DataFrame:
    """set, tokens and wide (bitmap) of the sets that `some` lists once each; their texts are read once more."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in few_rows(batches):
            sets = [h for h, _ in token_sets(b._text, shingle)]
            right = np.array([set_id(h) for h in sets], np.int64) == b.set.to_numpy()
            yield b[["set"]].assign(tokens=[h.view(np.int64) for h in sets], wide=[wide_bitmap(h) for h in sets])[right]

    wanted = scratch.put(f"{name}-wanted", some.join(nodes.select("set", "doc", "text_hash"), "set"))
    texts = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("_text"))
    sent = F.broadcast(wanted) if wanted.count() <= SENT else wanted
    found = texts.join(sent, ["doc", "text_hash"]).select("set", "_text").mapInPandas(run, "set long, tokens array<long>, wide array<long>")
    with rows_at_once(docs.sparkSession, ROWS):
        sets = scratch.put(f"{name}-sets", found)
    if not sets.groupBy("set").count().where("count > 1").isEmpty():  # rows that repeat a doc_id and its text
        sets = scratch.put(f"{name}-once", sets.dropDuplicates(["set"]))
    return sets


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """Those of the pairs (a, b) of sets that are similar."""
    sets = read_again(docs, nodes, pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct(), shingle, scratch, name)
    left, right = sets.select(F.col("set").alias("a"), F.col("tokens").alias("_x")), sets.select(F.col("set").alias("b"), F.col("tokens").alias("_y"))
    # apart, so that the overlap is counted once
    counted = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("_x").alias("x"), F.size("_y").alias("y"), F.explode(F.array(F.size(F.array_intersect("_x", "_y")))).alias("shared"))
    links = scratch.put(f"{name}-links", counted.where(F.col("shared") * 100 >= percent * (F.col("x") + F.col("y") - F.col("shared"))).select("a", "b"))
    scratch.drop(f"{name}-wanted", f"{name}-sets", f"{name}-once")
    return links


def _fits(lo_a, hi_a, lo_b, hi_b, percent: int):
    """Can sizes in these ranges belong to similar sets?"""
    return (100 * hi_a >= percent * lo_b) & (100 * hi_b >= percent * lo_a)


class Tree:
    """Levels of nodes over sorted sets; level 0 has the sets themselves, each level up a node for FAN of those below."""

    def __init__(self, cell: np.ndarray, size: np.ndarray, cls: np.ndarray, bits: np.ndarray):
        spare = size - np.bitwise_count(bits).sum(1, dtype=np.int64)  # tokens that share their bit with another of their set
        self.levels = [(cell, cell, size, size, cls, cls, spare, bits)]
        while len(self.levels[-1][0]) > 1:
            below = self.levels[-1]
            at = np.arange(0, len(below[0]), FAN)
            low, high = np.minimum.reduceat, np.maximum.reduceat
            self.levels.append((*(f(c, at) for f, c in zip((low, high) * 3 + (high,), below)), np.bitwise_or.reduceat(below[-1], at, axis=0)))


def _alive(x: tuple, y: tuple, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of node a of level x and node b of level y may hold similar sets of one cell and two classes."""
    (c0, c1, s0, s1, k0, k1, spare, bits), (d0, d1, t0, t1, l0, l1, other, also) = x, y
    ok = (c0[a] <= d1[b]) & (d0[b] <= c1[a]) & ~((k0[a] == k1[a]) & (l0[b] == l1[b]) & (k0[a] == l0[b])) & _fits(s0[a], s1[a], t0[b], t1[b], percent)
    left = np.flatnonzero(ok)
    for i in range(0, len(left), PAIRS):
        some = left[i : i + PAIRS]
        p, q = a[some], b[some]
        shared = np.bitwise_count(bits[p] & also[q]).sum(1, dtype=np.int64) + np.minimum(spare[p], other[q])
        ok[some] = shared >= needed(s0[p], t0[q], percent)
    return ok


def meet(x: Tree, y: Tree, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places (in x, in y) of sets that may be similar; if y is x, each pair once."""
    top = max(len(x.levels), len(y.levels))
    level = lambda t, k: t.levels[min(k, len(t.levels) - 1)]
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for k in range(top - 1, -1, -1):
        alive = _alive(level(x, k), level(y, k), a, b, percent)
        a, b = a[alive], b[alive]
        if k:
            step = np.arange(FAN)
            down = lambda n, t: n[:, None] * FAN + step if k < len(t.levels) else n[:, None] + 0 * step[:1]
            p, q = down(a, x), down(b, y)
            a, b = np.repeat(p, q.shape[1], axis=1).ravel(), np.tile(q, p.shape[1]).ravel()
            inside = (a < len(level(x, k - 1)[0])) & (b < len(level(y, k - 1)[0]))
            if x is y:
                inside &= (a < b) if k == 1 else (a <= b)
            a, b = a[inside], b[inside]
    return (a[:0], b[:0]) if x is y and top == 1 else (a, b)


def units(members: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Of each unit (i, j), two top nodes that may hold similar sets (or one, with itself): block, position, head, set, size,
    cls and bits of its sets. members: head (the cell), set, size, cls, low (a size that a class has once), bits and spare."""
    words = range(BITS // 64)
    placed = with_position(members, ["head", "low", "cls", "size", "set"], scratch, "placed").withColumn("block", F.floor(F.col("position") / F.lit(BLOCK)))
    ends = [f("head", "position").alias(f"head{k}") for k, f in enumerate((F.min_by, F.max_by))]
    tops = placed.groupBy("block").agg(*ends, *(f(c).alias(f"{c}{k}") for c in ("size", "cls") for k, f in enumerate((F.min, F.max))), F.max("spare").alias("spare"), *(F.bit_or(F.get("bits", F.lit(w))).alias(f"w{w}") for w in words))
    tops = scratch.put("tops", tops.withColumn("bits", F.array(*(f"w{w}" for w in words))).drop(*(f"w{w}" for w in words)))
    # in the order of cells, two nodes have at most one cell in common: the last of one, the first of the other
    x, y = (tops.select(*(F.col(c).alias(f"{p}_{c}") for c in tops.columns)) for p in "xy")
    pairs = x.join(y, (F.col("x_head1") == F.col("y_head0")) & (F.col("x_block") < F.col("y_block")))
    settled = (F.col("x_cls0") == F.col("x_cls1")) & (F.col("y_cls0") == F.col("y_cls1")) & (F.col("x_cls0") == F.col("y_cls0"))
    left = pairs.where(~settled & _enough("x", "y", percent))
    of_unit = tops.select(F.col("block").alias("i"), F.col("block").alias("j")).union(left.select("x_block", "y_block"))
    of_block = of_unit.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    return placed.join(of_block, "block").select("i", "j", "block", "position", "head", "set", "size", "cls", "bits")


def by_unit(dealt: DataFrame, visit: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """visit(the rows of a unit, by position) of every unit."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, now = [], None  # the rows so far of the unit at hand
        for batch in batches:
            for unit, rows in batch.groupby(["i", "j"], sort=False):
                if held and unit != now:
                    yield visit(pd.concat(held, ignore_index=True))
                    held = []
                held.append(rows)
                now = unit
        if held:
            yield visit(pd.concat(held, ignore_index=True))

    # by range, which deals out rows evenly
    return dealt.repartitionByRange("i", "j").sortWithinPartitions("i", "j", "position").mapInPandas(run, schema)


def pairs_of(unit: pd.DataFrame, bits: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a unit's rows that the trees leave."""
    head, size, cls, block = (unit[c].to_numpy() for c in ("head", "size", "cls", "block"))  # in order of position: a cell is a run
    cell = np.concatenate(([0], (head[1:] != head[:-1]).cumsum()))
    sides = [np.flatnonzero(block == k) for k in np.unique(block)]
    trees = [Tree(cell[s], size[s], cls[s], bits[s]) for s in sides]
    a, b = meet(trees[0], trees[-1], percent) if len(sides) > 1 or unit.i[0] == unit.j[0] else (sides[0][:0], sides[0][:0])
    return sides[0][a], sides[-1][b]


def wide_enough(wide: list[np.ndarray], size: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs (a, b) their wide bitmaps leave; those of BITS bits have been held against each other before."""
    left = np.ones(len(a), bool)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        words = min(len(wide[x]), len(wide[y]))
        if words > BITS // 64:
            p, q = folded(wide[x], words), folded(wide[y], words)
            spare = min(size[x] - np.bitwise_count(p).sum(dtype=np.int64), size[y] - np.bitwise_count(q).sum(dtype=np.int64))
            left[k] = np.bitwise_count(p & q).sum(dtype=np.int64) + spare >= needed(size[x], size[y], percent)
    return left


def forest(sets: list[np.ndarray], cls: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Of the similar ones among the pairs (a, b), as many as connect all classes that all of them connect."""
    root = list(range(int(cls.max(initial=-1)) + 1))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    links = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(cls[x]), find(cls[y])
        if p != q:
            shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if shared >= needed(len(sets[x]), len(sets[y]), percent):
                root[p] = q
                links.append((x, y))
    return links


def tree_links(docs: DataFrame, nodes: DataFrame, members: DataFrame, shingle: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) of similar sets that, with those within classes, connect what all pairs of the cells do."""
    kept = ["i", "j", "block", "position", "head", "set", "size", "cls"]
    schema = ", ".join(f"{c} long" for c in kept)

    def hopeful(unit: pd.DataFrame) -> pd.DataFrame:
        a, b = pairs_of(unit, np.stack(unit.bits.to_list()).view(np.uint64), percent)
        return unit.iloc[np.union1d(a, b)][kept]

    def likely(unit: pd.DataFrame) -> pd.DataFrame:
        wide = [x.view(np.uint64) for x in unit.wide]
        a, b = pairs_of(unit, np.stack([folded(x, BITS // 64) for x in wide]), percent)
        left = wide_enough(wide, unit["size"].to_numpy(), a, b, percent)
        return unit.iloc[np.union1d(a[left], b[left])][kept]

    def linked(unit: pd.DataFrame) -> pd.DataFrame:
        sets, wide = ([x.view(np.uint64) for x in unit[c]] for c in ("tokens", "wide"))
        a, b = pairs_of(unit, np.stack([folded(x, BITS // 64) for x in wide]), percent)
        left = wide_enough(wide, unit["size"].to_numpy(), a, b, percent)
        found = forest(sets, np.unique(unit.cls, return_inverse=True)[1], a[left], b[left], percent)
        return pd.DataFrame(unit.set.to_numpy()[np.array(found, np.int64).reshape(-1, 2)], columns=["a", "b"])

    some = scratch.put("hopeful", by_unit(units(members, scratch, percent), hopeful, schema))
    sets = read_again(docs, nodes, some.select("set").distinct(), shingle, scratch, "trees")
    with rows_at_once(docs.sparkSession, SETS):
        some = scratch.put("likely", by_unit(some.join(sets.select("set", "wide"), "set"), likely, schema))
        sent = F.broadcast(some) if some.count() <= SENT // 4 else some
        links = scratch.put("trees-links", by_unit(sets.join(sent, "set"), linked, "a long, b long"))
    scratch.drop("placed", "tops", "hopeful", "likely", "trees-wanted", "trees-sets", "trees-once")
    return links


def labelled(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label): of each set that has links, the least set within STEPS links. Two sets of one label are linked, if by
    others; the converse needn't hold."""
    both = links.union(links.select("b", "a"))
    now = scratch.put("labels-0", both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label")))
    for k in range(1, STEPS):
        near = both.join(now, both.b == now.node).groupBy("a").agg(F.min("label").alias("near"))
        now = scratch.put(f"labels-{k}", now.join(near, now.node == near.a).select("node", F.least("label", "near").alias("label")))
    return now


def similar_sets(docs: DataFrame, shingle: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows, roots): doc_id, set and size of every row of docs; and (node, root), the sets that have a link with one that
    stands for their class."""
    spark = docs.sparkSession
    heat = word_heat(docs)
    with rows_at_once(spark, ROWS):
        rows = scratch.put("rows", shingled(docs, shingle, percent, heat))
    of_set = rows.where("size > 0").groupBy("set").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "text_hash")).alias("row"), *(F.first(c).alias(c) for c in ("size", "first", "bits")))
    spare = F.col("size") - F.aggregate("bits", F.lit(0), lambda n, w: n + F.bit_count(w))  # tokens that share their bit with another of their set
    nodes = scratch.put("nodes", of_set.select("set", "row.*", "size", "first", "bits", spare.alias("spare")))
    entries = nodes.select("set", F.posexplode("first").alias("at", "token"))
    orders = [F.min(F.col("set").bitwiseXOR(F.lit(x))).bitwiseXOR(F.lit(x)).alias(f"h{i}") for i, x in enumerate(ORDERS)]
    cells = entries.groupBy("token").agg(F.count(F.lit(1)).alias("n"), orders[0]).where("n > 1")
    place = F.row_number().over(Window.partitionBy("set").orderBy("at"))  # of its tokens that are in cells
    met = scratch.put("met", entries.join(cells, "token").join(nodes.select("set", "size"), "set").withColumn("at", place))

    # most tokens are in one set alone, so the other representatives are of what is left
    others = scratch.put("others", met.where("n > 2").groupBy("token").agg(*orders[1:]))
    early = met.where(F.col("at") <= EARLY)
    more_heads = early.where("n > 2").join(others, "token").select("set", "size", F.explode(F.array(*(f"h{i}" for i in range(1, len(ORDERS))))).alias("head"))
    asked = early.select("set", "size", F.col("h0").alias("head")).union(more_heads).where("set <> head").distinct()
    of_head = nodes.select(F.col("set").alias("head"), F.col("size").alias("head_size"))
    to_heads = asked.join(of_head, "head").where(_fits(F.col("size"), F.col("size"), F.col("head_size"), F.col("head_size"), percent)).select(F.least("set", "head").alias("a"), F.greatest("set", "head").alias("b")).distinct()
    links = verified(docs, nodes, scratch.put("to-heads", possible(to_heads, nodes, percent)), shingle, percent, scratch, "heads")
    classes = labelled(links, scratch)
    sized = classes.join(nodes.select(F.col("set").alias("label"), F.col("size").alias("low")), "label")
    of_cell = met.select(F.col("h0").alias("head"), "set", "size").distinct()
    named = scratch.put("named", of_cell.join(sized, of_cell["set"] == sized.node, "left").select("head", "set", "size", F.coalesce("label", "set").alias("cls"), F.coalesce("low", "size").alias("low")))
    mixed = named.groupBy("head").agg(F.min("cls").alias("c0"), F.max("cls").alias("c1")).where("c0 <> c1").select("head")
    members = named.join(mixed, "head").join(nodes.select("set", "bits", "spare"), "set")
    more = tree_links(docs, nodes, members, shingle, percent, scratch)
    roots = components(links.union(more), Scratch(spark, "components"))
    scratch.drop("met", "others", "to-heads", "named", "nodes", *(f"labels-{k}" for k in range(STEPS)))
    return rows.select("doc_id", "set", "size"), roots


def join(docs: DataFrame, shingle: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles (the size of its set) and component_id (the smallest doc_id that links reach) of every row of docs:
    sets are linked if their Jaccard similarity is `percent` percent or more."""
    scratch = Scratch(docs.sparkSession, "sigtree")
    rows, roots = similar_sets(docs, shingle, percent, scratch)
    firsts = rows.where("size > 0").groupBy("set").agg(F.min("doc_id").alias("first"))
    linked = scratch.put("linked", roots.join(firsts, roots.node == firsts["set"]).select("set", "root", "first"))
    least = scratch.put("least", linked.groupBy("root").agg(F.min("first").alias("component_id")))
    linked = linked.join(least, "root").select("set", "component_id")
    named = scratch.put("classes-of-sets", firsts.join(linked, "set", "left").select("set", F.coalesce("component_id", "first").alias("component_id")))
    full = rows.where("size > 0").join(named, "set").select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    return full.union(rows.where("size = 0").select("doc_id", "size", "doc_id"))
