"""Every registered query against its SQL twin (DuckDB) at sf0.01."""

import pytest
import sys, os
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E
from conftest import SF01
from oracle_harness import compare
from salescope.plans import catalog


@pytest.mark.parametrize("key", sorted(catalog.ORACLE))
def test_query_matches_sql_twin(spark, key):
    res = compare(spark, SF01, [key], verbose=False)[key]
    assert res[0] == "ok", res


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 10 and df.columns == ["country", "sales"]


def test_every_query_has_twin():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE",
                 "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


def test_result_types_match_sql_twins(spark):
    from conftest import SF001
    from oracle_harness import duck

    con = duck(SF001)
    qs = catalog.QUERIES
    bad = []
    for k, sql in sorted(catalog.ORACLE.items()):
        rel = con.sql(sql)
        want = dict(zip(rel.columns, [str(t) for t in rel.types]))
        got = {f.name: f.dataType.simpleString() for f in qs[k](spark, SF001).schema.fields}
        for c, t in got.items():
            if SPARK_TO_DUCK.get(t, t) != want.get(c):
                bad.append((k, c, t, want.get(c)))
    assert not bad, bad
