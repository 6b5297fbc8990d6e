"""Every registered linkage query against DuckDB; those without SQL must give rows of a stable schema."""

import pytest
from compare import connect, oracle_rows, rows_of

from linkweave import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_duckdb(spark, con, name):
    assert rows_of(catalog.QUERIES[name](spark, SF)) == oracle_rows(con, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_gives_rows(spark, name):
    if name.startswith("gbt"):
        pytest.skip("too few matches at this size; see test_models")
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    lists = entry.entry(spark)
    assert lists.columns == ["source1_entity_id", "matched_entity_ids"] and lists.count() == 50


def test_entry_imports_without_the_optional_part(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "linkweave", tmp_path / "linkweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    found = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True)
    assert found.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.ORACLES))], found.stderr[-500:]
