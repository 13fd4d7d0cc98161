"""Every registered query of the engine against its SQL on the smallest tables."""

import os

import duckdb
import pytest
from backmatch import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_equals_sql(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = db.execute(queries.ORACLE_SQL[name])
    at = [[d[0] for d in found.description].index(c) for c in cols]
    assert sorted(map(tuple, df.select(*cols).collect()), key=str) == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=str)


def test_entry_module_works_without_the_optional_part(tmp_path):
    """With the optional folder and the pipeline gone, the entry module still imports."""
    import shutil
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{top}/backmatch", tmp_path / "backmatch", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{top}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) == set(e.queries()) and len(e.queries()) > 30"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
