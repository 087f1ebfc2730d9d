"""Audit of how filters interact, by the subset-zeta transform.

Each filter gives a document one bit: does it fail? Documents with the same bits in the same part are one count, so a part
is a table of 2^F counts, whatever it holds. The zeta transform turns that table into the survivors of every subset of
filters at once: survivors(S) = sum of the counts whose bits lie outside S. An order of filters is a chain of subsets, each
step of it the difference of two neighbours: 2^F numbers answer all F! orders, for documents and, alike, for those of a label.

The copies filter needs no window and no join on texts: of each text the least doc_id is found by an aggregation, and a row
is a copy if its (text, doc_id) isn't that one. Texts are scanned once; what follows reads a table of narrow rows.

A null or empty text has no words: it fails the word count and nothing else, but for being a copy of another empty one. A
null part is the empty string. A null doc_id counts as one document after all others and has no labels. Rows that agree in
text and doc_id are no copies of each other. Labels of a repeated doc_id count if any of its rows has them. An empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, let, text_of, words_of

#: What stands for a null doc_id: after all others.
LAST = (1 << 63) - 1
#: The filters of one document, by letter: who fails.
FILTERS = {
    "A": lambda text, n, distinct: n < 200,
    "B": lambda text, n, distinct: 100 * distinct < 50 * n,
    "C": lambda text, n, distinct: 100 * F.char_length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * F.char_length(text),
    "D": lambda text, n, distinct: text.rlike(r"[#$%&*|]"),
}
#: The filter that takes more than one document to judge: a copy of an earlier one's text.
COPY = "E"
LETTERS = "".join(FILTERS) + COPY


def failures(docs: DataFrame, part: str = "source") -> DataFrame:
    """doc, part, hash (SHA-256 of the text) and mask (a bit for each of FILTERS) of every row of docs."""
    def of(words: Column) -> Column:
        n, distinct = F.size(words), F.size(F.array_distinct(words))
        return reduce(Column.__add__, [F.when(fails(text_of(), n, distinct), 1 << i).otherwise(0) for i, fails in enumerate(FILTERS.values())])

    return docs.select(F.coalesce("doc_id", F.lit(LAST)).cast("long").alias("doc"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.unhex(F.sha2(text_of().cast("binary"), 256)).alias("hash"), let(words_of(text_of()), of).alias("mask"))


def masks(docs: DataFrame, labels: DataFrame, scratch: Scratch, part: str = "source") -> DataFrame:
    """part, mask (a bit for each of LETTERS), n, n_good and n_toxic, the counts of documents with that mask."""
    rows = scratch.put("rows", failures(docs, part))
    first = rows.groupBy("hash").agg(F.min("doc").alias("doc")).withColumn("is_first", F.lit(True))  # a hot text is one row a task
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    counted = rows.groupBy("doc", "hash", "part", "mask").agg(F.count(F.lit(1)).alias("n"))  # repeated rows become one
    judged = counted.join(first, ["hash", "doc"], "left").join(marks, "doc", "left")  # keys with doc_id: none is hot
    copy = F.when(F.col("is_first"), 0).otherwise(1 << len(FILTERS))
    has = lambda c: F.when(F.col(c) == 1, F.col("n")).otherwise(0)
    return judged.groupBy("part", (F.col("mask") + copy).alias("mask")).agg(F.sum("n").alias("n"), F.sum(has("good")).alias("n_good"), F.sum(has("toxic")).alias("n_toxic"))


def survivors(counts: Column, filters: int) -> Column:
    """Array over all subsets S of the filters (as bits): how many documents no filter of S fails, from an array of counts
    by mask. One pass a filter: the zeta transform over subsets, read at S's complement."""
    def add(sums: Column, bit: int) -> Column:
        return let(sums, lambda a: F.transform(a, lambda x, m: x + F.when(F.shiftright(m, bit).bitwiseAND(1) == 1, F.get(a, m - (1 << bit))).otherwise(0)))

    full = (1 << filters) - 1
    return let(reduce(add, range(filters), counts), lambda z: F.transform(z, lambda _, s: F.get(z, full - s)))


def orders(letters: str) -> list[tuple[str, int, int, int]]:
    """(order, step from 1, subset before the step, the step's filter by place) of each step of each order."""
    at = {x: i for i, x in enumerate(letters)}
    return [(o := "".join(p), k + 1, sum(1 << at[x] for x in p[:k]), at[p[k]]) for p in permutations(letters) for k in range(len(p))]


def audit(counts: DataFrame, scratch: Scratch, letters: str = LETTERS) -> DataFrame:
    """A row for each part, order and step: see the contract of op12. counts: part, mask, n, n_good, n_toxic."""
    names, size = ("n", "n_good", "n_toxic"), 1 << len(letters)
    by_part = counts.groupBy("part").agg(*(F.expr(f"array({', '.join(f'sum(if(mask = {m}, {c}, 0L))' for m in range(size))})").alias(c) for c in names))
    # written, or each of the many places below that read an array would compute it anew
    s = scratch.put("survivors", by_part.select("part", "n", *(survivors(F.col(c), len(letters)).alias(f"s_{c}") for c in names)))
    scratch.drop("rows")
    steps = orders(letters)
    often = Counter((before, at) for _, _, before, at in steps)  # in how many orders a subset comes just before a filter
    shapley = [" + ".join(f"{k} * (s_n[{b}] - s_n[{b | 1 << i}])" for (b, at), k in sorted(often.items()) if at == i) for i in range(len(letters))]
    fails = [f"s_n[0] - s_n[{1 << i}]" for i in range(len(letters))]
    s = s.withColumns({"shapley": F.expr(f"array({', '.join(shapley)})"), "fails": F.expr(f"array({', '.join(fails)})")})
    each = ", ".join(f"struct('{o}' AS filter_order, {k} AS step, {b} AS before, {b | 1 << i} AS after, {i} AS at, {1 << i} AS only)" for o, k, b, i in steps)
    rows = s.withColumn("x", F.expr(f"explode(array({each}))")).select("*", "x.*")
    gone = lambda c: F.get(f"s_{c}", F.col("before")) - F.get(f"s_{c}", F.col("after"))
    return rows.select(
        "part", "filter_order", "step", F.get("s_n", F.col("after")).alias("kept"), gone("n").alias("removed"), (F.get("fails", F.col("at")) - gone("n")).alias("redundant"),
        F.get("n", F.col("only")).alias("unique_fails"), gone("n_good").alias("good_lost"), gone("n_toxic").alias("toxic_lost"), F.get("shapley", F.col("at")).alias("shapley"),
    )
