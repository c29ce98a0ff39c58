"""Every registered query against its SQL, over the smallest tables."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from quillon.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def plain(rows):
    def value(v):
        if isinstance(v, float):
            return None if v != v else round(v, 6) + 0.0
        return [value(x) for x in v] if isinstance(v, (list, tuple)) else v

    return sorted((tuple(value(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = plain(df.select(*columns).collect())
    assert got
    if name in catalog.ORACLE_SQL:
        want = duck.execute(f"select {', '.join(columns)} from ({catalog.ORACLE_SQL[name]})").fetchall()
        assert got == plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_subpackage():
    """The registry alone knows of the subpackage llm, and guards its import."""
    top = os.path.dirname(os.path.abspath(entry.__file__))
    for folder, _, names in os.walk(os.path.join(top, "quillon")):
        for n in names:
            if n.endswith(".py") and os.sep + "llm" not in folder:
                assert not re.search(r"\bllm\b", open(os.path.join(folder, n)).read()), n
