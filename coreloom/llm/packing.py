"""Variable-capacity best-fit packing of documents into training sequences.

Sizes are counts of words. A text longer than the largest permitted sequence is cut into pieces of that length and
a rest. Pieces are dealt into shards of SHARD_ITEMS at most, by place in a hash order, so shards are of one size
whatever the keys; in a shard the longest piece comes first and goes to the open bin that it leaves least room in.
Where none has room, a bin is opened: of all permitted lengths that hold the piece, the one of least cost for each
word that it can be expected to hold, given the pieces still to come. In the end each bin shrinks to the
shortest permitted length that holds its contents. A shard adds a few bins that aren't full; nothing else is lost by
sharding.

A null text or a text without words has no piece to pack: one row of length 0 without a bin. Null doc_ids and
repeated rows are packed row by row. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_of, with_position
from .mixing import n_words

LENGTHS = (512, 1024, 2048, 4096)
SHARD_ITEMS = 4096
#: What a sequence of the largest length costs for attention, as a share of what its words cost.
QUADRATIC = 0.25


def costs(lengths: tuple[int, ...], quadratic: float = QUADRATIC) -> list[float]:
    """Cost of a sequence of each length: its words, and attention over all pairs of them."""
    top = max(lengths)
    return [c + quadratic * c * c / top for c in lengths]


def best_fit(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS, quadratic: float = QUADRATIC) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each of the sizes (1 to max(lengths)), and the length of each bin."""
    lengths = tuple(sorted(lengths))
    cost, top = costs(lengths, quadratic), lengths[-1]
    order = np.argsort(-sizes, kind="stable")
    tree = [0] * (top + 1)  # words still to come, by size, as a binary indexed tree

    def add(size: int, words: int) -> None:
        while size <= top:
            tree[size] += words
            size += size & -size

    def to_come(most: int) -> int:
        """Words in pieces of size `most` or less that are still to come."""
        total = 0
        while most > 0:
            total += tree[most]
            most &= most - 1
        return total

    for size, n in zip(*(x.tolist() for x in np.unique(sizes, return_counts=True))):
        add(size, size * n)

    open_at: list[list[int]] = [[] for _ in range(top + 1)]  # bins by the room they have
    rooms = 0  # bit r: there is a bin with room r
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    capacity: list[int] = []
    room_of: list[int] = []
    for k in order.tolist():
        size = int(sizes[k])
        add(size, -size)
        if fits := rooms >> size:
            room = size + (fits & -fits).bit_length() - 1
            b = open_at[room].pop()
            if not open_at[room]:
                rooms ^= 1 << room
        else:
            b = len(capacity)
            room = min((cost[j] / (size + min(c - size, to_come(c - size))), c) for j, c in enumerate(lengths) if c >= size)[1]
            capacity.append(room)
            room_of.append(room)
        bins[k], offsets[k] = b, capacity[b] - room
        room_of[b] = rest = room - size
        if rest:
            open_at[rest].append(b)
            rooms |= 1 << rest
    used = np.array(capacity, np.int64) - np.array(room_of, np.int64)
    return bins, offsets, np.array(lengths, np.int64)[np.searchsorted(lengths, used)]


def pieces(docs: DataFrame, longest: int) -> DataFrame:
    """doc_id, piece (from 0), start and length (in words) of each piece of each row of docs."""
    sized = docs.select("doc_id", F.xxhash64(text_of()).alias("_text"), n_words(text_of()).alias("_n"))
    count = F.greatest(F.lit(1), F.ceil(F.col("_n") / longest)).cast("int")
    rows = sized.select("doc_id", "_text", "_n", F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"))
    start = F.col("piece").cast("long") * longest
    return rows.select("doc_id", "_text", "piece", start.alias("start"), F.least(F.col("_n") - start, F.lit(longest)).alias("length"))


def pack(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, quadratic: float = QUADRATIC, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """doc_id, piece, start, length of all pieces, with bin (shard:number), capacity and offset (words before it)."""
    scratch = Scratch(docs.sparkSession, "packing")
    keyed = pieces(docs, max(lengths)).withColumn("_h", F.xxhash64("doc_id", "_text", "piece")).withColumn("_id", F.monotonically_increasing_id())
    rows = with_position(keyed, ["_h", "doc_id", "piece", "_id"], scratch, "pieces").withColumn("shard", F.floor(F.col("position") / shard_items).cast("long"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "position"], ascending=[False, True], kind="stable")
        bins, offsets, capacity = best_fit(group.length.to_numpy(np.int64), lengths, quadratic)
        return group.assign(bin=[f"{s}:{b}" for s, b in zip(group["shard"], bins)], capacity=capacity[bins] if len(bins) else [], offset=offsets)[["doc_id", "piece", "start", "length", "bin", "capacity", "offset"]]

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    packed = rows.where("length > 0").select("doc_id", "piece", "start", "length", "shard", "position").groupBy("shard").applyInPandas(run, f"doc_id {doc_id}, piece int, start long, length long, bin string, capacity long, offset long")
    none = rows.where("length = 0").select("doc_id", "piece", "start", "length", F.lit(None).cast("string").alias("bin"), F.lit(None).cast("long").alias("capacity"), F.lit(None).cast("long").alias("offset"))
    return packed.unionByName(none)
