"""SimHash near-duplicates by the generalised pigeonhole principle.

Bits that go together are grouped into partitions; each partition gets its own threshold, -1 (unused) or more,
such that the thresholds plus one sum to radius + 1. Two fingerprints within the radius then agree within the
threshold in at least one partition. The thresholds are chosen by dynamic programming over estimated candidate
counts. Probes enumerate the variants of a partition's value, meet the indexed values in buckets, and are verified
on all 64 bits there. A bucket gives back the classes that its links make, as links of their members to one of them,
never all pairs.

For similar rather than nearly equal texts the radius is wider, and 64 bits no longer tell strangers apart in a large
corpus: `similar` takes four fingerprints of the distinct shingles, probes with each of them and holds all 256 bits
against those of the texts met. What these links connect is then joined by the shingles themselves.

Empty and null texts have fingerprint zero and link like any other. Repeated rows share a fingerprint. Rows whose
doc_id is null take part; a component's id is its smallest doc_id that isn't null. An empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sigtree
from .common import Scratch, remixed, set_id, signed
from .graph import components

BITS = 64
#: A bucket with more fingerprints takes the way for large buckets. Speed only: links are the same either way.
BUCKET = 2048
#: The same for wider radiuses, where all pairs within a bucket have to be seen in any case.
WIDE_BUCKET = 1 << 16
#: What shuffling a probe key costs, in verifications of a pair side by side in memory.
KEY_COST = 2000.0
#: Keys that a fingerprint may probe with, in a plan. Memory of a row only: which plan is cheapest is a matter of n.
MOST_KEYS = 1 << 16
#: Pairs of a bucket that are verified at once.
PAIRS = 1 << 22
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16
#: Fingerprints of a text that may be similar to others.
WORDS = 4
#: Up to so many texts that have to be read again are sent to every task; more are joined by a shuffle. Speed only.
SENT = 1 << 20


def shingle_hashes(text: bytes | None, k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each k-word shingle, repeats included (fewer words: of the whole sequence; none: empty)."""
    words = (text or b"").lower().split()  # on bytes: A-Z alone, and exactly SPACE
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.fromiter(map(len, words), np.int64, len(words)).cumsum() + np.arange(len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.fromiter((digest(joined[i:j], seed) for i, j in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())), np.uint64, len(words) - k + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Signed 64-bit value; a bit is set if it is in over half the hashes."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), CHUNK):
        counts += np.unpackbits(hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id and `fp` of every row of docs."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(fp=np.array([fingerprint(shingle_hashes(t, shingle)) for t in b.pop("_text")], np.int64))

    return docs.select("doc_id", F.col("text").cast("binary").alias("_text")).mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def sketches(docs: DataFrame, shingle: int, cols: tuple[str, ...]) -> DataFrame:
    """`cols` of every row of docs, and of its distinct shingles: `set` (their id), `size`, `fp0` and so on (the WORDS
    fingerprints) and `wide` (these and the id as bytes); `text_hash`, by which to find the text again."""
    names = [f"fp{k}" for k in range(WORDS)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t, shingle)) for t in b.pop("_text")]
            ids = np.array([set_id(h) for h in sets], np.int64)
            fps = np.array([[fingerprint(remixed(h, k) if k else h) for k in range(WORDS)] for h in sets], np.int64).reshape(-1, WORDS)
            wide = [row.tobytes() for row in np.column_stack((fps, ids))]
            yield b.assign(set=ids, size=np.array([len(h) for h in sets], np.int64), **dict(zip(names, fps.T)), wide=wide)

    src = docs.select(*cols, F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("_text"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema if f.name != "_text")
    return src.mapInPandas(run, f"{fields}, set long, size long, {', '.join(f'{n} long' for n in names)}, wide binary")


def bit_counts(fps: DataFrame) -> np.ndarray:
    """64 x 64 counts of bits that are set together (the diagonal: of each bit), over all rows of fps."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BITS, BITS))
        for b in batches:
            bits = np.unpackbits(b.fp.to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            total += bits.T @ bits
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "n": total.ravel().astype(np.int64)})

    out = np.zeros((BITS, BITS))
    for i, j, n in fps.select("fp").mapInPandas(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n")).collect():  # 4,096 rows
        out[i, j] = n
    return out


def group_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Deals the bits into parts of equal width; each takes the bits most correlated with those it has."""
    left, groups = set(range(BITS)), []
    for p in range(parts):
        width = BITS // parts + (p < BITS % parts)
        pool = sorted(left)
        sub = corr[np.ix_(pool, pool)]
        own = [pool[int(np.argmax(sub.sum(0)))]]
        while len(own) < width:
            rest = [b for b in pool if b not in own]
            own.append(rest[int(np.argmax(corr[np.ix_(rest, own)].sum(1)))])
        groups.append(sorted(own))
        left -= set(own)
    return groups


def plan(counts: np.ndarray, n: int, radius: int) -> list[tuple[int, list[int]]]:
    """[(threshold, bits of the partition)] of least estimated cost; unused partitions are left out.

    A partition's candidates at threshold t are estimated as n^2/2 times the probability that two rows differ in
    t of its bits or fewer, from each bit's share of ones. A probe key costs as much as KEY_COST verifications.
    """
    share = np.diag(counts) / max(n, 1)
    differ = np.clip(2 * share * (1 - share), 1e-6, 1)
    sd = np.sqrt(np.clip(share * (1 - share), 1e-9, None))
    corr = np.abs((counts / max(n, 1) - np.outer(share, share)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    best: tuple[float, list] = (math.inf, [])
    for parts in range(1, min(radius + 1, 16) + 1):
        groups = group_bits(corr, parts)
        costs = []  # of each partition, by threshold + 1
        for g in groups:
            dist = np.array([1.0])
            for b in g:
                dist = np.convolve(dist, [1 - differ[b], differ[b]])
            keys = np.cumsum([math.comb(len(g), t) for t in range(min(len(g), radius) + 1)])
            costs.append([0.0] + [n * n / 2 * dist[: t + 1].sum() + KEY_COST * n * (1 + keys[t] / 2) if keys[t] <= MOST_KEYS else math.inf for t in range(len(keys))])
        table = {0: (0.0, ())}  # budget used -> cost and thresholds
        for c in costs:
            after: dict[int, tuple[float, tuple]] = {}
            for used, (cost, chosen) in table.items():
                for up in range(min(len(c) - 1, radius + 1 - used) + 1):
                    if (x := (cost + c[up], (*chosen, up - 1))) < after.get(used + up, (math.inf,)):
                        after[used + up] = x
            table = after
        if radius + 1 in table and table[radius + 1][0] < best[0]:
            best = (table[radius + 1][0], [(t, g) for t, g in zip(table[radius + 1][1], groups) if t >= 0])
    return best[1]


def probe_keys(fp: Column, parts: list[tuple[int, list[int]]]) -> Column:
    """Array of (p, key, own): the value in each partition, and its variants within the threshold that are larger
    (of two values that differ, the smaller one probes)."""
    arrays = []
    for p, (t, bits) in enumerate(parts):
        value = fp.bitwiseAND(F.lit(signed(sum(1 << b for b in bits))))
        arrays.append(F.array(F.struct(F.lit(p).alias("p"), value.alias("key"), F.lit(True).alias("own"))))
        if t > 0:
            flips = F.lit([signed(sum(1 << b for b in c)) for k in range(1, t + 1) for c in combinations(bits, k)]).cast("array<bigint>")
            probes = F.filter(F.transform(flips, lambda e, v=value: v.bitwiseXOR(e)), lambda x, v=value: x > v)
            arrays.append(F.transform(probes, lambda x, p=p: F.struct(F.lit(p).alias("p"), x.alias("key"), F.lit(False).alias("own"))))
    return F.concat(*arrays) if len(arrays) > 1 else arrays[0]


def join_classes(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """label (of each node, a smaller node of its class or itself) after the links x-y have joined classes."""
    while True:
        a, b = label[x], label[y]
        apart = a != b
        if not apart.any():
            return label
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (up := label[label]).tobytes() != label.tobytes():
            label = up


def _verify(held: int, values: np.ndarray, radius: int, wide: np.ndarray | None, most: int) -> list[tuple[int, int]]:
    """Links (smallest of the class by place, member) of the classes that form where the first `held` values lie within
    the radius of others. wide: a row each of the WORDS fingerprints, of whose bits `most` may differ, and of the id that
    stands for the value in links."""
    label = np.arange(len(values))
    rows = max(1, PAIRS // len(values))
    for i in range(0, held, rows):
        x, y = np.nonzero(np.bitwise_count(values[i : min(i + rows, held), None] ^ values[None, :]) <= radius)
        x += i
        if wide is not None:
            differ = np.zeros(len(x), np.int64)
            for k in range(WORDS):
                differ += np.bitwise_count(wide[x, k] ^ wide[y, k])
            x, y = x[differ <= most], y[differ <= most]
        label = join_classes(label, x, y)
    member = np.flatnonzero(label != np.arange(len(values)))
    ids = (values if wide is None else wide[:, WORDS]).view(np.int64)
    return list(zip(ids[label[member]].tolist(), ids[member].tolist()))


def _bucket_links(rows: DataFrame, radius: int, most: int) -> DataFrame:
    """Links within buckets: rows with the lists held and probes, and if most > 0 `wide` of each."""
    cols = ["held", "probes", *(["held_wide", "probes_wide"] if most else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            for held, probes, *wide in zip(*(batch[c] for c in cols)):
                values = np.concatenate((np.asarray(held, np.int64), np.asarray(probes, np.int64))).view(np.uint64)
                more = np.frombuffer(b"".join((*wide[0], *wide[1])), np.uint64).reshape(len(values), -1) if most else None
                out += _verify(len(held), values, radius, more, most)
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return rows.select(*cols).mapInPandas(run, "a long, b long")


def links(fps: DataFrame, radius: int, scratch: Scratch, most: int = 0) -> DataFrame:
    """Links (a, b) that connect whatever distinct fingerprints lie within `radius` bits of each other.

    fps: the column fp, without repeats; with most > 0 also wide (see sketches): fp is one of its fingerprints and may
    repeat, links are between ids and differ in at most `most` of all the bits. No cap: a bucket of very many rows is dealt out. Within radius 2, two
    fingerprints share a value that each reaches by flipping one bit or none, so these values (at most 65 holders
    each) link its members in work proportional to their number. Beyond, its members are dealt into blocks, and
    each pair of blocks is verified in a task of its own.
    """
    counts = bit_counts(fps)
    n = fps.count()
    parts = plan(counts, n, radius)
    wide = ["wide"] if most else []
    keyed = fps.select("fp", *wide, F.inline(probe_keys(F.col("fp"), parts)))
    bucket = BUCKET if radius <= 2 and not most else WIDE_BUCKET
    sizes = keyed.groupBy("p", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket)
    large = scratch.put("large", sizes)
    cold = keyed.join(large, ["p", "key"], "left_anti") if (any_large := bool(large.head(1))) else keyed
    if most:  # rows are shorter than lists of one row
        cold = cold.repartition("p", "key")
    lists = [F.collect_list(F.when(own, F.col(c))).alias(name + suffix) for name, own in (("held", F.col("own")), ("probes", ~F.col("own"))) for c, suffix in (("fp", ""), *((("wide", "_wide"),) if most else ()))]
    buckets = cold.groupBy("p", "key").agg(*lists).where((F.size("held") > 0) & (F.size("held") + F.size("probes") > 1))
    out = _bucket_links(buckets, radius, most)
    if any_large and radius <= 2 and not most:
        flips = F.lit([0] + [signed(1 << b) for b in range(BITS)]).cast("array<bigint>")
        hot = keyed.join(large, ["p", "key"]).select("fp").distinct()
        near = hot.select("fp", F.explode(F.transform(flips, lambda e: F.col("fp").bitwiseXOR(e))).alias("mid"))
        ends = near.groupBy("mid").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
        out = out.union(ends.select("a", F.explode("all").alias("b")).where("a <> b"))
    elif any_large:
        hot = keyed.join(large, ["p", "key"]).withColumn("blocks", F.ceil(F.col("n") / F.lit(bucket / 2)).cast("int")).withColumn("block", F.pmod(F.xxhash64("fp", *wide), F.col("blocks")).cast("int"))
        dealt = hot.select("p", "key", "fp", *wide, "own", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        dealt = dealt.select("p", "key", "fp", *wide, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "own")
        pairs = dealt.groupBy("p", "key", "i", "j").agg(*lists)
        out = out.union(_bucket_links(pairs.where(F.size("held") > 0), radius, most))
    return out


def _classes(fps: DataFrame, distinct: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """fps with component_id, from the links found between the distinct fingerprints (fp, first)."""
    roots = components(found, scratch)
    linked = scratch.put("linked", roots.join(distinct, roots.node == distinct.fp).select("node", "root", "first"))
    least = scratch.put("least", linked.groupBy("root").agg(F.min("first").alias("component_id")))
    named = linked.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    classes = scratch.put("classes", distinct.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")))
    return fps.join(classes, "fp")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp (long) and component_id of every row of docs; see the module."""
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.put("fps", fingerprints(docs, shingle))
    distinct = scratch.put("distinct", fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    return _classes(fps, distinct, links(distinct.select("fp"), radius, scratch), scratch).select("doc_id", "fp", "component_id")


def radius_of(similarity: float, bits: int, deviations: float) -> int:
    """Bits of `bits` in which texts of that Jaccard similarity of their shingles differ, and so many standard
    deviations more. A bit differs with the angle between the texts' shingle vectors over pi."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * share + deviations * math.sqrt(bits * share * (1 - share)))


def similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`cols`, root and component_id (its smallest doc_id) of every row of docs (cols have doc_id): components of texts
    whose sets of shingles have that Jaccard similarity or more. Texts that meet in any of the WORDS fingerprints, with
    a radius that holds three of four pairs just at the similarity, and differ in few enough of all bits are
    candidates; what has a candidate goes through the exact join of signature trees, in which large groups of near copies
    cost what their number does. Texts without words are alike."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "similar")
    fps = scratch.put("fps", sketches(docs, shingle, cols))
    rest = [F.min(c).alias(c) for c in ("text_hash", "size", "wide", *(f"fp{k}" for k in range(WORDS)))]
    nodes = scratch.put("nodes", fps.groupBy("set").agg(F.min("doc_id").alias("first"), *rest))
    live, radius, most = nodes.where("size > 0"), radius_of(similarity, BITS, 0.5), radius_of(similarity, WORDS * BITS, 4)
    met = [scratch.put(f"met-{k}", links(live.select(F.col(f"fp{k}").alias("fp"), "wide"), radius, Scratch(spark, "similar"), most)) for k in range(WORDS)]
    near = components(reduce(DataFrame.union, met), Scratch(spark, "similar"))
    groups = scratch.put("groups", near.join(nodes, near.node == nodes.set).select("set", "text_hash"))
    scratch.drop(*(f"met-{k}" for k in range(WORDS)))
    sent = F.broadcast(groups) if groups.count() <= SENT else groups
    texts = docs.select(F.xxhash64("text").alias("text_hash"), "text").join(sent, "text_hash").groupBy("set").agg(F.first("text").alias("text"))
    texts = scratch.put("texts", texts.withColumnRenamed("set", "doc_id"))
    same = scratch.put("same", sigtree.join(texts, shingle, round(100 * similarity)).select(F.col("doc_id").alias("node"), F.col("component_id").alias("root")))
    scratch.drop("groups", "texts")
    named = scratch.put("named", nodes.join(same, nodes.set == same.node, "left").select("set", "first", F.coalesce("root", "set").alias("root")))
    least = scratch.put("least", named.groupBy("root").agg(F.min("first").alias("component_id")))
    return fps.join(named.join(least, "root").select("set", "root", "component_id"), "set").select(*cols, "root", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each component of similar texts: that of the smallest (doc_id, hash of the text), null ids
    last. Other columns pass through; of rows that agree in doc_id and text, any one stays."""
    key = {"_null": F.col("doc_id").isNull(), "_doc": F.coalesce("doc_id", F.lit(0)), "_hash": F.xxhash64("text")}
    found = similar(docs.select("doc_id", "text", F.xxhash64("text").alias("_hash")), shingle, similarity, ("doc_id", "_hash"))
    rows = found.select("root", F.col("doc_id").isNull().alias("_null"), F.coalesce("doc_id", F.lit(0)).alias("_doc"), "_hash")
    counted = rows.groupBy("root", "_null", "_doc", "_hash").agg(F.count(F.lit(1)).alias("_n"))
    stay = counted.groupBy("root").agg(F.min(F.struct("_null", "_doc", "_hash", "_n")).alias("s")).select("s.*")
    kept = docs.withColumns(key).join(stay, list(key))
    once = kept.where("_n = 1").unionByName(kept.where("_n > 1").dropDuplicates(list(key)))
    return once.select(*(F.col(f"`{c}`") for c in docs.columns))
