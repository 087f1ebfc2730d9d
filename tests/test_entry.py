"""The entry without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__
from coreloom.operators import lineage

ROOT = Path(__file__).resolve().parents[1]


def test_entry_gives_one_row_of_gates(spark):
    row = __spark_entry__.entry(spark).first()
    assert row.n_gold > 0 and 0 < row.boundary_recall < 1


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_imports_without_the_llm_folders(tmp_path):
    shutil.copytree(ROOT / "coreloom", tmp_path / "coreloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'eval_gates' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)


def test_the_rest_passes_without_the_llm_folders(tmp_path):
    """Tests of records and intervals, in a copy that has neither folder nor the pipeline."""
    gone = shutil.ignore_patterns("llm", "__pycache__")
    for folder in ("coreloom", "tests"):
        shutil.copytree(ROOT / folder, tmp_path / folder, ignore=gone)
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    run = subprocess.run([sys.executable, "-B", "-m", "pytest", "tests/test_intervals.py", "-q", "-x", "-p", "no:cacheprovider"], cwd=tmp_path, capture_output=True, text=True)
    assert run.returncode == 0, run.stdout[-2000:]


def test_release_deletes_what_was_cut(spark):
    lineage.release(spark)
    kept = lineage.cut(spark.range(3))
    assert kept.count() == 3 and lineage.release(spark) == 1 and lineage.release(spark) == 0
    assert not Path(lineage.shared_dir(spark).removeprefix("file://")).joinpath(Path(kept.inputFiles()[0]).parent.name).exists()
