"""Pages of GeoJSON that link to the next, as a Spark data source.

One partition asks one page after the other, with a pause between; the first by the address and parameters given, each
other by the link of relation "next" that the page before it has, which has all parameters in itself. Pages land in a
table as they came, some at a time, so that a fetch that was interrupted goes on after the last page that has landed; what
has landed is checked against the number that the server declares before anything is made of it.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import files

SCHEMA = "page long, url string, body string, next string, number_matched long, n_features long"


def next_link(page: dict) -> str | None:
    return next((x["href"] for x in page.get("links") or [] if x.get("rel") == "next" and x.get("href")), None)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.first, self.pages = options["url"], int(options.get("first", 0)), int(options.get("pages", 100))
        self.pause, self.tries = float(options.get("pause", 2.0)), int(options.get("tries", 3))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def _get(self, url: str) -> str:
        for n in range(self.tries):
            try:
                with urllib.request.urlopen(url, timeout=60) as r:
                    return r.read().decode()
            except OSError:
                if n + 1 == self.tries:
                    raise
                time.sleep(self.pause * 2**n)
        raise AssertionError

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        url: str | None = self.url
        for n in range(self.pages):
            if not url:
                return
            if n:
                time.sleep(self.pause)
            body = self._get(url)
            page = json.loads(body)
            after = next_link(page)
            after = urllib.parse.urljoin(url, after) if after else None
            yield self.first + n, url, body, after, page.get("numberMatched"), len(page.get("features") or [])
            url = after


class PagedSource(DataSource):
    """Options: url, first (the number of its page), pages (how many to ask for at most), pause (seconds) and tries."""

    @classmethod
    def name(cls) -> str:
        return "paged_features"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


def fetch(spark: SparkSession, url: str, params: dict[str, str], landed: str, at_once: int = 20, pause: float = 2.0) -> DataFrame:
    """The pages of url, landed at the path `landed`, those of an earlier call included; see check."""
    spark.dataSource.register(PagedSource)
    query = urllib.parse.urlencode(params)
    ask, first = url + (("&" if "?" in url else "?") + query if query else ""), 0
    while True:
        if files.exists(spark, landed):
            last = spark.read.schema(SCHEMA).parquet(landed).agg(F.max(F.struct("page", "next")).alias("p")).first().p
            if last is not None:
                ask, first = last["next"], last["page"] + 1
        if not ask:
            return spark.read.schema(SCHEMA).parquet(landed)
        some = spark.read.format("paged_features").options(url=ask, first=first, pages=at_once, pause=pause).load()
        some.write.mode("append").parquet(landed)


def check(pages: DataFrame) -> None:
    """An error if the pages have another number of features than the server declares (it may declare none, or -1), or if
    the last of them has a next one."""
    row = pages.agg(F.coalesce(F.sum("n_features"), F.lit(0)).alias("got"), F.max("number_matched").alias("declared"), F.max(F.struct("page", "next")).alias("last"), F.countDistinct("page").alias("n")).first()
    if row.last is not None and (row.last["next"] or row.n != row.last["page"] + 1):
        raise ValueError("pages are missing")
    if row.declared is not None and row.declared >= 0 and row.declared != row.got:
        raise ValueError(f"{row.got} features received, {row.declared} declared")
