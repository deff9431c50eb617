import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from quarry import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _plain(value):
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    return str(value)


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = own.queries()[name](spark, SF)
    columns = sorted(found.columns)
    got = sorted(tuple(_plain(r[c]) for c in columns) for r in found.collect())
    result = con.execute(own.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(_plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_the_rest_imports_without_the_llm_folders(tmp_path):
    root = Path(__file__).resolve().parents[1]
    skip = lambda folder, names: [n for n in names if n in ("llm", ".git", "__pycache__")]
    shutil.copytree(root, tmp_path / "repo", ignore=skip)
    for gone in ((), ("corpus_pipeline.py",)):
        for name in gone:
            (tmp_path / "repo" / name).unlink()
        code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op1_') for n in q) and 'pipeline' not in q and e.oracle_sql()"
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True)
