"""What the training-data operators share: reading tables, shared scratch tables, text helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import owned, shared_dir, written

#: White space of all word rules: space and U+0009 to U+000D, as a pattern and as characters.
SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written to the shared folder. Writing one cuts the lineage: an executor that is lost
    later costs only the work done since. lineage.release deletes what is left of them once results are consumed."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, owned(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        return written(df, self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing will read any more."""
        for name in names:
            self._drop(name)

    def _drop(self, name: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def rows_at_once(spark: SparkSession, n: int) -> Iterator[None]:
    """What runs inside hands Python at most n rows at once: by default it is 10,000, whole texts of which an executor holds
    twice for each of its tasks, as Arrow's buffers in the JVM and as objects of the worker, and neither gives them back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(min(n, int(was)) if int(was) > 0 else n))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def words_of(text: Column) -> Column:
    """Words: runs of anything but SPACE."""
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. lower() does just that on pure ASCII and has a fast path for it."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc_mod(col: str, n: int) -> Column:
    """crc32 of an id as text, modulo n (null: the empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def with_position(df: DataFrame, keys: list[str], scratch: Scratch, name: str, partitions: int | None = None) -> DataFrame:
    """Adds `position`, the row's place (from 0) in the order of `keys`, without one task seeing all rows:
    range-partitioned and sorted rows are written once, then each partition gets the count of rows before it."""
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.asc_nulls_last(k) for k in keys]
    ordered = scratch.put(name, df.repartitionByRange(parts, *cols).sortWithinPartitions(*cols)
                          .withColumn("_part", F.spark_partition_id())
                          .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each partition
    before, offsets = 0, []
    for part, n in sorted(sizes):
        offsets.append((part, before))
        before += n
    offset = spark.createDataFrame(offsets or [(0, 0)], "_part int, _before long")
    return ordered.join(F.broadcast(offset), "_part").withColumn("position", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def remixed(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Further 64 bits from each hash: the splitmix64 finaliser of the hash plus `turn` steps."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15 * turn & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def set_id(hashes: np.ndarray) -> int:
    """Signed 64-bit id of a set of shingles, from its sorted distinct hashes."""
    return signed(xxhash.xxh64_intdigest(hashes.tobytes(), 42))
