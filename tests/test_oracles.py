"""Every query with an oracle gives DuckDB's rows on the small tables."""

import os

import duckdb
import pytest

from loomwright.plans import registry

DATA = "/root/testdata/sf0.001"


def _norm(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    got = registry.queries()[name](spark, DATA)
    cur = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = sorted(repr([_norm(dict(zip(names, r))[c]) for c in sorted(names)]) for r in cur.fetchall())
    assert sorted(got.columns) == sorted(names)
    assert sorted(repr([_norm(r[c]) for c in sorted(got.columns)]) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_queries_without_oracle_give_rows(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    rows = registry.queries()[name](spark, DATA).collect()
    assert rows and len(set(map(tuple, rows))) >= 1 and any(v is not None for v in rows[0])
