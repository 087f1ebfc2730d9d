"""Every survey query that SQL can express, held against DuckDB."""

import pytest

from coreloom.plans import registry
from coreloom.plans.derived import Frames

from .oracle import SF_DIR, compare


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    compare(spark, registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_every_query_without_sql_is_tested_elsewhere():
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == {"crs_roundtrip", "id_collision", "tune"}


def test_runs_take_every_row(spark):
    frames = Frames(spark, SF_DIR)
    assert frames.runs.count() == frames.lineitem.count()
