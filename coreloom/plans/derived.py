"""Survey tables derived from the star schema, as one SQL text for both engines.

Names in braces are tables or other views. A literal such as 0.5D is a double; DuckDB gets it as a cast.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..functions.vocab import CLASSES, EVIDENCE
from ..operators.lineage import cut

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_NAMES = "CASE cls " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CLASSES)) + " END"

VIEWS: dict[str, str] = {
    # positions; every seventh has no ground level
    "sites": """
        SELECT o_orderkey AS bgs_id, 382500.0D + (o_orderkey * 7919) % 5000 AS easting, 202500.0D + (o_orderkey * 104729) % 5000 AS northing,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 60.0D + (o_orderkey % 400) / 10.0D END AS ground_level_m
        FROM {orders}""",
    "bounds": """
        SELECT bgs_id, seq, l_partkey, th, CAST(sum(th) OVER (PARTITION BY bgs_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS base_cm
        FROM (SELECT l_orderkey AS bgs_id, l_partkey, 50 + CAST(l_quantity AS INT) * 10 AS th,
                     row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq
              FROM {lineitem}) b""",
    "gold": "SELECT bgs_id, seq, base_cm - th AS top_cm, base_cm, l_partkey % 17 AS cls FROM {bounds}",
    "pred": """
        SELECT bgs_id, seq, CASE WHEN seq = 1 THEN 0 ELSE top_cm + (bgs_id * 31 + (seq - 1) * 17) % 51 - 25 END AS top_cm,
               base_cm + (bgs_id * 31 + seq * 17) % 51 - 25 AS base_cm, CASE WHEN (bgs_id + seq) % 5 = 0 THEN (cls + 1) % 17 ELSE cls END AS cls
        FROM {gold} WHERE bgs_id % 10 <> 3""",
    # the index of sites, as it comes: a length of -2 says unknown, '4-' plays notification only
    "index_raw": """
        SELECT CAST(o_orderkey AS DOUBLE) AS id, 382500.0D + (o_orderkey * 7919) % 5000 AS easting, 202500.0D + (o_orderkey * 104729) % 5000 AS northing,
               CASE WHEN o_orderkey % 11 = 0 THEN -2.0D ELSE CAST(o_orderkey % 97 AS DOUBLE) / 2.0D END AS length,
               CASE WHEN o_orderpriority LIKE '4-%' THEN 'Site Notification  Only' WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS name,
               CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR(20)) END AS reference
        FROM {orders}""",
    "boreholes": """
        SELECT CAST(id AS BIGINT) AS bgs_id, reference, name, easting, northing, CASE WHEN length >= 0 THEN length END AS length_m, length AS length_raw,
               coalesce(lower(name) LIKE '%notification  only%', false) AS notification_only
        FROM {index_raw}""",
    # attempts to fetch; a site may have many
    "scans": """
        SELECT event_id, user_id AS bgs_id, event_type IN ('view', 'purchase') AS ok, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
               CAST(value * 100 AS BIGINT) AS bytes, ts AS fetched_at
        FROM {events}""",
    "intervals": f"""
        SELECT bgs_id, 'gold:ags' AS source, CAST(seq - 1 AS BIGINT) AS seq, top_cm / 100.0D AS top_m, base_cm / 100.0D AS base_m, {_NAMES} AS lith_class,
               CASE WHEN bgs_id % 9 = 0 THEN NULL ELSE ((bgs_id + seq) % 101) / 100.0D END AS confidence
        FROM {{gold}} WHERE bgs_id % 6 <> 1
        UNION ALL
        SELECT bgs_id, 'extract:mock/v1' AS source, CAST(seq - 1 AS BIGINT) AS seq, top_cm / 100.0D AS top_m, base_cm / 100.0D AS base_m, {_NAMES} AS lith_class,
               CASE WHEN bgs_id % 9 = 0 THEN NULL ELSE ((bgs_id * 3 + seq * 7) % 101) / 100.0D END AS confidence
        FROM {{pred}}""",
    "log_meta": """
        SELECT bgs_id, 'gold:ags' AS source, CASE WHEN bgs_id % 4 = 0 THEN NULL ELSE easting + 1.0D END AS easting,
               CASE WHEN bgs_id % 4 = 0 THEN NULL ELSE northing - 1.0D END AS northing, ground_level_m
        FROM {sites} WHERE bgs_id % 6 <> 1
        UNION ALL
        SELECT -1 - bgs_id AS bgs_id, 'gold:ags' AS source, CASE WHEN bgs_id % 2 = 0 THEN NULL ELSE easting END AS easting, northing, ground_level_m
        FROM {sites} WHERE bgs_id % 50 = 7""",
    "runs": """
        SELECT l_orderkey AS run_key, l_suppkey AS ran_key, l_shipdate AS ran_at, l_discount * 10 AS boundary_recall, l_tax * 12 AS lithology_f1, CAST(l_quantity AS BIGINT) AS n_gold
        FROM {lineitem}""",
    "model_runs": """
        SELECT o_orderkey AS run_key, o_orderdate AS ran_at, CASE WHEN o_orderkey % 2 = 0 THEN 'elevation' ELSE 'depth' END AS frame, o_custkey AS n_boreholes, o_totalprice AS accuracy
        FROM {orders}""",
    # a layered world for the kernel: the class follows the elevation, so neighbours agree; sites stand about 800 m
    # apart, however many there are
    "world_sites": """
        SELECT bgs_id, easting, northing, 100.0D - 0.0005D * (easting - 382500.0D) AS ground_level_m
        FROM (SELECT o_orderkey AS bgs_id, 382500.0D + o_orderkey % 40 * 800 + (o_orderkey * 7919) % 400 AS easting,
                     202500.0D + (o_orderkey - o_orderkey % 40) * 20 + (o_orderkey * 104729) % 400 AS northing FROM {orders}) o""",
    "gap_sites": "SELECT bgs_id, easting, northing, CASE WHEN bgs_id % 7 = 0 THEN NULL ELSE ground_level_m END AS ground_level_m FROM {world_sites}",
    "world": """
        SELECT g.bgs_id, g.seq, k, s.easting AS x, s.northing AS y, s.ground_level_m - (g.top_cm / 100.0D + 0.25D + 0.5D * k) AS z, g.top_cm
        FROM {gold} g JOIN {world_sites} s ON g.bgs_id = s.bgs_id LATERAL VIEW explode(sequence(0L, CAST(floor((g.base_cm - g.top_cm) / 50) AS BIGINT))) t AS k
        WHERE g.top_cm / 100.0D + 0.25D + 0.5D * k < g.base_cm / 100.0D""",
    # the same world as stored logs: an interval has the class of its middle, or none that is evidence; some logs state
    # no place and some no ground level
    "world_meta": """
        SELECT bgs_id, 'gold:ags' AS source, CASE WHEN bgs_id % 4 = 0 THEN NULL ELSE easting END AS easting, CASE WHEN bgs_id % 4 = 0 THEN NULL ELSE northing END AS northing,
               CASE WHEN bgs_id % 7 = 0 THEN NULL ELSE ground_level_m END AS ground_level_m
        FROM {world_sites} WHERE bgs_id % 6 <> 1""",
    "world_logs": """
        SELECT g.bgs_id, 'gold:ags' AS source, CAST(g.seq - 1 AS BIGINT) AS seq, g.top_cm / 100.0D AS top_m, g.base_cm / 100.0D AS base_m,
               CASE WHEN g.cls >= 15 THEN 'UNKNOWN' WHEN s.ground_level_m - (g.top_cm + g.base_cm) / 200.0D > 85.0D THEN 'LIMESTONE' WHEN s.ground_level_m - (g.top_cm + g.base_cm) / 200.0D > 80.0D THEN 'MARL' ELSE 'MUDSTONE' END AS lith_class
        FROM {gold} g JOIN {world_sites} s ON g.bgs_id = s.bgs_id""",
    "samples": f"""
        SELECT bgs_id * 1000000 + seq * 100 + k AS qid, bgs_id, seq * 100 + k AS ord, x, y, z, CASE WHEN z > 85.0D THEN {EVIDENCE.index('LIMESTONE')} WHEN z > 80.0D THEN {EVIDENCE.index('MARL')} ELSE {EVIDENCE.index('MUDSTONE')} END AS cls
        FROM {{world}}""",
}


def needs(name: str) -> list[str]:
    """The views that a view needs, before it."""
    found: list[str] = []
    for x in re.findall(r"\{(\w+)\}", VIEWS[name]):
        if x in VIEWS:
            found += [y for y in (*needs(x), x) if y not in found]
    return found


def duck(sql: str) -> str:
    """SQL for DuckDB: doubles as casts, table names bare, and the views that it uses in front."""
    used: list[str] = []
    for x in re.findall(r"\{(\w+)\}", sql):
        if x in VIEWS:
            used += [y for y in (*needs(x), x) if y not in used]
    each = lambda s: re.sub(r"LATERAL VIEW explode\(sequence\(0L, (.+)\)\) (\w+) AS (\w+)", r", LATERAL (SELECT unnest(range(0, 1 + \1)) AS \3) \2", s)
    plain = lambda s: re.sub(r"\b(\d+(?:\.\d+)?)D\b", r"\1::DOUBLE", re.sub(r"\{(\w+)\}", r"\1", each(s)))
    views = ",\n".join(f"{x} AS ({plain(VIEWS[x])})" for x in used)
    body = plain(sql).strip()
    if not views:
        return body
    return f"WITH {views}, {body[5:]}" if body.startswith("WITH ") else f"WITH {views}\n{body}"


class Frames:
    """The tables of a folder and the views over them as DataFrames: frames.gold, frames.orders."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._known: dict[str, DataFrame] = {}
        self._once: set[str] = set()

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in VIEWS and name not in TABLES:
            raise AttributeError(name)
        if name not in self._known:
            if name in TABLES:
                self._known[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                used = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
                self._known[name] = self.spark.sql(VIEWS[name], **{x: getattr(self, x) for x in used})
        return self._known[name]

    def once(self, name: str) -> DataFrame:
        """A view, written once for the queries that read it several times; views over it read what is written."""
        if name not in self._once:
            self._known[name] = cut(getattr(self, name), "zstd")
            self._once.add(name)
        return self._known[name]

    @cached_property
    def area(self) -> tuple[float, float, float, float]:
        return (383000.0, 203000.0, 386000.0, 206500.0)
