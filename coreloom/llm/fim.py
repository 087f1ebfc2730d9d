"""Fill-in-the-middle transformation by overlapping chunks.

A text is a row of units (lines, words or characters), and a unit begins where a character and the one before it say so:
after a newline, or at a word's first letter. The texts of a batch lie in memory end to end; that row of bytes is dealt
into chunks that overlap by one byte, so that every pair of neighbours is seen in some chunk, and each chunk counts the
units and characters that begin in it. Prefix sums of the counts tell which chunk owns the cut of a given rank; only that
chunk is looked through again. No list of units is ever made, and a text of any length costs two passes over its bytes.

What leaves Python are the places of the two cuts; texts are put together by Spark.

A null text is empty. An empty text, or one that has a marker in it, stays as it is (form plain), and so do texts that the
rate leaves out. The dice are of the doc_id alone (null: the empty text): rows that repeat one are cut alike if equal. An
empty table gives no rows; other columns pass through, and of two columns of one name, ours replaces theirs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Bytes of a chunk.
CHUNK = 1 << 16
#: Bytes of text of which a batch is cut at once, at most, if no single text is longer.
BATCH = 1 << 24
MARKS = ("<P>", "<S>", "<M>")
SPACES = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))


def _leads(b: np.ndarray) -> np.ndarray:
    """Is a byte the first of a character?"""
    return (b & 0xC0) != 0x80


#: By unit: does a unit begin at `b`, which follows `before`? The first byte of a text always begins one.
BEGINS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "line": lambda before, b: before == 10,
    "word": lambda before, b: SPACES[before] & ~SPACES[b],
    "char": lambda before, b: _leads(b),
}


def cuts(data: np.ndarray, offsets: np.ndarray, draws: np.ndarray, unit: str, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """(n, places): how many units each text has, and for each text the places (in characters) at which its units number
    draws % (n + 1) begin; a cut after the last unit is at the text's end. data: the bytes of the texts, end to end;
    offsets: where each begins, and the end; draws: a row of numbers for each text."""
    sizes = np.diff(offsets)
    n_chunks = -(-sizes // chunk)
    first = np.concatenate(([0], n_chunks.cumsum()))  # of each text's chunks
    owner = np.repeat(np.arange(len(sizes)), n_chunks)
    starts = offsets[owner] + (np.arange(len(owner)) - first[owner]) * chunk
    ends = np.minimum(starts + chunk, offsets[owner + 1])

    def boundaries(a: int, z: int, is_first: bool) -> np.ndarray:
        b = data[a:z]
        begins = BEGINS[unit](data[a - 1 : z - 1] if a else np.concatenate((b[:1], b[:-1])), b)
        if is_first:
            begins[0] = True
        return begins

    head = np.zeros(len(owner), bool)
    head[first[:-1][n_chunks > 0]] = True
    units, chars = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
    for k, (a, z, h) in enumerate(zip(starts.tolist(), ends.tolist(), head.tolist())):
        units[k], chars[k] = np.count_nonzero(boundaries(a, z, h)), np.count_nonzero(_leads(data[a:z]))
    units_to, chars_to = np.concatenate(([0], units.cumsum())), np.concatenate(([0], chars.cumsum()))
    n = units_to[first[1:]] - units_to[first[:-1]]
    length = chars_to[first[1:]] - chars_to[first[:-1]]
    ranks = draws % (n[:, None] + 1)
    places = np.where(ranks == n[:, None], length[:, None], 0)
    text, which = np.nonzero((ranks > 0) & (ranks < n[:, None]))
    wanted = units_to[first[text]] + ranks[text, which]  # units before it, in all chunks
    at = np.searchsorted(units_to, wanted, side="right") - 1  # the chunk in which unit number `wanted`, from 0, begins
    for t, w, k, r in zip(text.tolist(), which.tolist(), at.tolist(), (wanted - units_to[at]).tolist()):
        a, z = int(starts[k]), int(ends[k])
        byte = np.flatnonzero(boundaries(a, z, bool(head[k])))[r]
        places[t, w] = chars_to[k] - chars_to[first[t]] + np.count_nonzero(_leads(data[a : a + byte]))
    return n, places


def cut_places(docs: DataFrame, unit: str) -> DataFrame:
    """docs (with `_text` and the numbers _h1 and _h2) with `_cuts`: n, and the smaller and larger place."""
    @F.arrow_udf("struct<n: bigint, a: bigint, b: bigint>")
    def placed(it: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, h1, h2 in it:
            text = text.cast(pa.large_binary())
            draws = np.column_stack((h1.to_numpy(zero_copy_only=False), h2.to_numpy(zero_copy_only=False)))
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
            data = np.frombuffer(text.buffers()[2], np.uint8) if len(text) and text.buffers()[2] is not None else np.zeros(0, np.uint8)
            out, i = [], 0
            while i < len(text):  # as many texts as have BATCH bytes together, or one that has more
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BATCH, side="right")) - 1)
                n, places = cuts(data, offsets[i : j + 1], draws[i:j], unit)
                out.append((n, places.min(1), places.max(1)))
                i = j
            cols = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out) if out else ((), (), ()))]
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], ["n", "a", "b"])

    return docs.withColumn("_cuts", placed("_text", "_h1", "_h2"))


def draw(doc_id: Column, seed: int, k: int) -> Column:
    """The k-th number (from 1) of 32 bits that a document draws."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 8 * k - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame, unit: str = "line", rate: int = 100, spm: int = 50, seed: int = 7) -> DataFrame:
    """docs with n (units), form (psm, spm or plain), prefix_chars and middle_chars (null if plain) and output. Of texts
    that can be cut, `rate` percent are, and `spm` percent of these begin with their suffix."""
    rows = docs.drop("n", "form", "prefix_chars", "middle_chars", "output", "_text", "_h1", "_h2", "_cuts")
    rows = cut_places(rows.withColumns({"_text": text_of(), "_h1": draw(F.col("doc_id"), seed, 1), "_h2": draw(F.col("doc_id"), seed, 2)}), unit)
    text, a, b = F.col("_text"), F.col("_cuts.a").cast("int"), F.col("_cuts.b").cast("int")
    plain = (text == "") | text.rlike("<[PSM]>") | (draw(F.col("doc_id"), seed, 3) % 100 >= rate)
    form = F.when(plain, "plain").when(draw(F.col("doc_id"), seed, 4) % 100 < spm, "spm").otherwise("psm")
    prefix, middle, suffix = F.substring(text, F.lit(1), a), F.substring(text, a + 1, b - a), F.substring(text, b + 1, F.char_length(text))
    p, s, m = (F.lit(x) for x in MARKS)
    rows = rows.withColumn("form", form)
    output = F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    cut = F.col("form") != "plain"
    return rows.withColumns({"n": F.col("_cuts.n"), "prefix_chars": F.when(cut, F.col("_cuts.a")), "middle_chars": F.when(cut, F.col("_cuts.b") - F.col("_cuts.a")), "output": output}).drop("_text", "_h1", "_h2", "_cuts")


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed, from output and form alone."""
    parts = F.split(output, "<[PSM]>", -1)  # nothing, then two parts in the form's order, then the middle
    of = lambda *places: F.concat(*(F.get(parts, F.lit(i)) for i in places))
    return F.when(form == "plain", output).when(form == "psm", of(1, 3, 2)).otherwise(of(2, 3, 1))
