"""Tables of versions: a manifest names the folders of each, and readers take the newest manifest.

A version is written beside the one in use and comes into use when its manifest is created, in one step that fails if
another writer was faster. So there is always a table, a reader goes on with the version that it began with, and what is
loaded anew rewrites only its own part: each part (say, a source) is a folder, and other parts' folders are named again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import files

MANIFESTS = "_manifests"


class Table:
    """A table at a path, its parts told apart by the column `part` (None: one part)."""

    def __init__(self, spark: SparkSession, path: str, part: str | None = None):
        self.spark, self.path, self.part = spark, path.rstrip("/"), part

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in files.names(self.spark, f"{self.path}/{MANIFESTS}") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict | None:
        found = self.versions()
        if not found:
            return None
        return json.loads(files.read_text(self.spark, f"{self.path}/{MANIFESTS}/{max(found) if version is None else version:012d}.json"))

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if m is None:
            raise FileNotFoundError(f"no table at {self.path}")
        schema = T.StructType.fromJson(m["schema"])
        folders = [f"{self.path}/{f}" for f in m["parts"].values()]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _put(self, df: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    def _commit(self, before: dict | None, schema: T.StructType, parts: dict[str, str]) -> int:
        """Creates the next manifest; if another writer has, what was read is out of date, and that is an error."""
        version = (before["version"] if before else 0) + 1
        if self.versions() and max(self.versions()) >= version:
            raise RuntimeError(f"{self.path} was changed meanwhile")
        body = json.dumps({"version": version, "schema": schema.jsonValue(), "parts": parts})
        try:
            files.create(self.spark, f"{self.path}/{MANIFESTS}/{version:012d}.json", body, overwrite=False)
        except Exception as e:
            raise RuntimeError(f"{self.path} was changed meanwhile") from e
        return version

    def replace(self, df: DataFrame, also: tuple[str, ...] = ()) -> int:
        """Puts df in place of the parts that its rows name, and of the parts `also`, which may have got empty; without
        parts in place of all. Other parts stay as they are, unread. Gives the new version."""
        before = self.manifest()
        if self.part is None:
            return self._commit(before, df.schema, {"": self._put(df)})
        names = {r[0] for r in df.select(F.coalesce(F.col(self.part).cast("string"), F.lit("")).alias("p")).distinct().collect()}  # as many as there are sources
        parts = {k: v for k, v in (before["parts"] if before else {}).items() if k not in names | set(also)}
        parts |= {n: self._put(df.where(F.coalesce(F.col(self.part).cast("string"), F.lit("")) == n)) for n in sorted(names)}
        return self._commit(before, df.schema, parts)

    def append(self, df: DataFrame) -> int:
        """Adds rows as a part of their own."""
        before = self.manifest()
        return self._commit(before, df.schema, (before["parts"] if before else {}) | {f"+{uuid.uuid4().hex}": self._put(df)})

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all but the newest `keep` versions, and the folders that only they name."""
        found = sorted(self.versions())
        old, kept = found[:-keep], found[-keep:]
        used = {f for v in kept for f in self.manifest(v)["parts"].values()}
        gone = {f for v in old for f in self.manifest(v)["parts"].values()} - used
        for v in old:
            files.delete(self.spark, f"{self.path}/{MANIFESTS}/{v:012d}.json")
        for f in gone:
            files.delete(self.spark, f"{self.path}/{f}")
