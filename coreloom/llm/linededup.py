"""Line deduplication by range-partitioned hashes.

Every long enough line gives (hash, document, position). The rows are range-partitioned by hash with documents and
positions sorted within, so that the first occurrence of a line streams by before the others. A line so common that
its hash would fill much of a partition is salted by document; its first document is then the least of those that its
salts report. What comes back per document is a bitmap of its lines, never text: a run (start, n) for each stretch of
lines to drop, all other lines stay. `apply` cuts the texts by these bitmaps.

A null or empty text is one empty line. A null doc_id counts as one document after all others. Rows with the same
doc_id are one document: the first document keeps all its lines. An empty table gives no rows. Other columns pass
through `apply` untouched. Time is linear in a line's length and in the number of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, Scratch, ascii_lower, let, text_of

#: A line is salted if it makes up more than 1/HOT_SHARE of a partition's even share of the rows, and gets a salt for
#: each such part; at most HOT_SHARE lines a partition can be. MOST_HOT is the limit of approx_top_k. Speed only.
HOT_SHARE, MOST_HOT = 8, 100_000
#: What stands for a null doc_id: after all others.
LAST = (1 << 63) - 1


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """h1, h2 (a 128-bit hash of the line's key), doc, row (a hash of the text), pos of each long enough line."""
    texts = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64(text_of()).alias("row"), F.split(text_of(), "\n").alias("lines"))
    lines = texts.select("doc", "row", F.posexplode("lines").alias("pos", "line"))  # apart, or the hash would be taken for each line
    keyed = lines.where(F.char_length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"), "doc", "row", "pos")


def dropped(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc, row and pos of every line to drop."""
    spark = docs.sparkSession
    scratch, parts = Scratch(spark, "lines"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = scratch.put("rows", occurrences(docs, min_chars))
    total, most = rows.count(), min(MOST_HOT, HOT_SHARE * parts)
    top = rows.agg(F.expr(f"approx_top_k(h1, {most}, {10 * most})").alias("top")).first()["top"]  # `most` items at most
    hot = [(x["item"], -(-x["count"] * most // total)) for x in top if x["count"] * most > total]
    salted = rows.withColumn("salt", F.lit(-1).cast("long"))
    if hot:
        salts = spark.createDataFrame(hot, "h1 long, salts long")
        salted = rows.join(F.broadcast(salts), "h1", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc"), F.col("salts")), F.lit(-1))).drop("salts")
    dealt = salted.repartitionByRange(parts, "h1", "salt")
    order = Window.partitionBy("h1", "salt", "h2").orderBy("doc", "pos")  # needs no further shuffle
    streamed = dealt.withColumn("first", F.first("doc").over(order))
    if hot:
        streamed = scratch.put("streamed", streamed)
        scratch.drop("rows")
        firsts = streamed.where("salt >= 0").groupBy("h1", "h2").agg(F.min("first").alias("least"))  # a row for each hot line
        common = streamed.where("salt >= 0").join(F.broadcast(firsts), ["h1", "h2"]).withColumn("first", F.col("least")).drop("least")
        streamed = streamed.where("salt < 0").unionByName(common)
    return streamed.where("doc <> first").select("doc", "row", "pos")


def runs(positions: Column) -> Column:
    """The runs (start, n) of a sorted array of places."""
    opens = F.filter(positions, lambda p, i: F.coalesce(F.when(i > 0, F.get(positions, i - 1)) != p - 1, F.lit(True)))
    closes = F.filter(positions, lambda p, i: F.coalesce(F.get(positions, i + 1) != p + 1, F.lit(True)))
    return F.zip_with(opens, closes, lambda a, z: F.struct(a.alias("start"), (z - a + 1).alias("n")))


def bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc, row (a hash of the text) and `gone`, the runs of lines to drop, of the documents that lose lines."""
    return dropped(docs, min_chars).groupBy("doc", "row").agg(let(F.sort_array(F.collect_set("pos")), runs).alias("gone"))


def apply(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """docs with n_lines, n_dropped and `kept`, the text of the lines that stay."""
    keys = {"_doc": F.coalesce("doc_id", F.lit(LAST)), "_row": F.xxhash64(text_of())}
    found = bitmaps(docs, min_chars).select(F.col("doc").alias("_doc"), F.col("row").alias("_row"), F.col("gone").alias("_gone"))
    joined = docs.withColumns(keys).join(found, ["_doc", "_row"], "left").drop("_doc", "_row")
    lines, gone = F.split(text_of(), "\n"), F.col("_gone")
    n = F.coalesce(F.aggregate(gone, F.lit(0), lambda a, g: a + g["n"]), F.lit(0))
    kept = F.when(gone.isNull(), text_of()).otherwise(F.array_join(let(lines, lambda x: _without(x, gone)), "\n"))
    return joined.withColumns({"n_lines": F.size(lines).cast("long"), "n_dropped": n.cast("long"), "kept": kept}).drop("_gone")


def _without(lines: Column, gone: Column) -> Column:
    """lines without those in the runs `gone`: the stretches between them, put together."""
    froms = F.concat(F.array(F.lit(0)), F.transform(gone, lambda g: g["start"] + g["n"]))
    tos = F.concat(F.transform(gone, lambda g: g["start"]), F.array(F.size(lines)))
    stays = F.filter(F.zip_with(froms, tos, lambda a, z: F.struct(a.alias("a"), (z - a).alias("n"))), lambda x: x["n"] > 0)
    return F.flatten(F.transform(stays, lambda x: F.slice(lines, x["a"] + 1, x["n"])))
