"""Every registered query against its SQL on the smallest driver tables, and the entry module without the training-data subpackage."""

import glob
import os
import subprocess
import sys

import pytest

from studyplane.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(x):
    return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else repr(x)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    cursor = duck.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_module_without_the_subpackage(tmp_path):
    """The entry module imports, and knows its other queries, where the subpackage and the pipeline are gone."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for p in ("__spark_entry__.py", "studyplane"):
        os.system(f"cp -r {root}/{p} {tmp_path}/")
    os.system(f"rm -rf {tmp_path}/studyplane/llm")
    code = "import __spark_entry__ as e; assert 'pipeline' not in e.queries() and len(e.queries()) > 40 and set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}).returncode == 0
