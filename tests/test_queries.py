import glob
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(df, columns):
    df = df[columns].astype(object)
    return sorted(map(repr, df.where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_like_sql(spark, small, duck, name):
    a, b = entry.queries()[name](spark, small).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and len(a)
    assert plain(a, sorted(a.columns)) == plain(b, sorted(a.columns))


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_the_llm_part():
    """The registry, and all outside sparkwright.llm, work where that subpackage and the pipeline are gone."""
    code = "import sys; sys.modules['sparkwright.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'order_reconcile' in e.queries() and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_a_missing_package_is_an_error():
    """Where the subpackage is there but what it needs is not, its queries do not vanish silently."""
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__"
    if os.path.isdir(os.path.join(ROOT, "sparkwright", "llm")):
        assert b"xxhash" in subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).stderr


def test_nothing_else_imports_the_llm_part():
    for d, _, names in os.walk(os.path.join(ROOT, "sparkwright")):
        if os.path.basename(d) != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert "sparkwright.llm" not in open(os.path.join(d, n)).read()
