"""Every core query against its SQL on the smallest tables, and the package without its subpackage for training data."""

import datetime as dt
import glob
import math
import os
import subprocess
import sys

import pytest

from orrery.plans import catalog

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
have = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def _plain(v):
    if isinstance(v, list | tuple):
        return tuple(map(_plain, v))
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(DATA + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


@have
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    sql = catalog.oracle_sql().get(name)
    if sql:
        r = duck.execute(sql)
        names = [x[0] for x in r.description]
        assert sorted(names) == cols
        assert rows == sorted((tuple(_plain(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_core_stands_alone():
    code = "import sys; sys.modules['orrery.llm'] = None; import __spark_entry__ as e; assert 'p2_found' in e.queries() and not any(k.startswith('p1_') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    for dirpath, _, files in os.walk(os.path.join(ROOT, "orrery")):
        if os.path.basename(dirpath) != "llm" and "/llm" not in dirpath:
            for f in files:
                if f.endswith(".py"):
                    assert "orrery.llm" not in open(os.path.join(dirpath, f), encoding="utf-8").read(), f
