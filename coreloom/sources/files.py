"""Small files and moves of files by Hadoop's file systems: paths may be anywhere that Spark reads and writes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if there is no such folder."""
    fs, p = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create(spark: SparkSession, path: str, *parts: str | list[str], overwrite: bool = True) -> None:
    """A file of texts and, where a part is a list, of the bytes of the files that it names, one after the other; their
    bytes pass by in small buffers. Without overwrite it is an error if the file is there."""
    fs, p = _at(spark, path)
    out = fs.create(p, overwrite)
    try:
        for part in parts:
            if isinstance(part, str):
                out.write(bytearray(part.encode()))
                continue
            for name in part:
                source, q = _at(spark, name)
                stream = source.open(q)
                try:
                    spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
                finally:
                    stream.close()
    finally:
        out.close()
