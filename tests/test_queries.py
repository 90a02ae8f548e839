"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from lattica.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(round(r[i], 6) if isinstance(r[i], float) else r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = QUERIES[name](spark, SF)
    if name not in ORACLES:  # checked by tests/test_operators.py
        assert found.count() > 0
        return
    want = db.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(columns, want.fetchall())
