import importlib
import os
from pathlib import Path

import duckdb
import pytest

from scholion.plans import catalog

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
NAMES = sorted(catalog.oracle_sql())


def plain(v):
    return round(v, 6) if isinstance(v, float) else None if v is None else str(v)


@needs_data
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = catalog.queries()[name](spark, DATA)
    names = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    rel = con.sql(catalog.oracle_sql()[name])
    at = [rel.columns.index(c) for c in names]
    assert sorted(rel.columns) == names
    assert rows == sorted((tuple(plain(x[i]) for i in at) for x in rel.fetchall()), key=str)


def test_every_sql_has_its_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and catalog.FLAGSHIP in catalog.queries()


def test_core_does_not_import_the_llm_folder():
    root = Path(importlib.import_module("scholion").__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "scholion.llm" not in f.read_text(), f
